"""Similarity between all entities: pairs, their statistics, neighbours and comparisons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinscope.config import METRICS
from kinscope.operators.blocks import PLACES, Block, multiply, packed, rounded
from kinscope.operators.scoring import DIGITS, best_places, block_score, set_score
from kinscope.operators.vectors import entity_totals


# Products of a step that only counts: the more, the fewer rows it sends.
COUNTED = 1 << 22


def pair_similarity(space: DataFrame, metric: str = "cosine", above: float | None = None) -> DataFrame:
    """(left_id, right_id, score, shared) with left_id < right_id: every pair that shares a feature, or of these the ones that score above a bound.

    Each two blocks of entities are multiplied in one task (`blocks.multiply`), so no pair is shuffled; features that one
    entity alone has are left out, while lengths and totals stay those of the full vectors. Pairs that share nothing score
    0 and have no row; `dense` adds them. Scores are clipped to 0..1 and rounded.
    """

    def emit(a: Block, b: Block, rows: slice, dot: np.ndarray, matched: np.ndarray) -> pa.RecordBatch | None:
        i, j = np.nonzero(matched)
        m = matched[i, j].astype(np.int64)
        value = rounded(block_score(metric, dot[i, j], m, a.n[rows][i], b.n[j], a.t[rows][i], b.t[j]))
        if above is not None:
            kept = value > above
            i, j, m, value = i[kept], j[kept], m[kept], value[kept]
        # Blocks are cut by hashes, so either may have the lower id.
        one, two = a.ids[rows].take(pa.array(i)), b.ids.take(pa.array(j))
        turned = pa.array(j < np.searchsorted(b.text, a.text[rows])[i])
        one, two = pc.if_else(turned, two, one), pc.if_else(turned, one, two)
        return pa.RecordBatch.from_arrays([one, two, pa.array(value), pa.array(m)], ["left_id", "right_id", "score", "shared"])

    return multiply(_one_side(space, metric, True), None, emit, "left_id string, right_id string, score double, shared bigint", unit=metric == "weighted_jaccard")


def _one_side(space: DataFrame, metric: str, apart: bool = False) -> DataFrame:
    """The packed vectors of a space. With `apart`, those of the cosine as weights and their lengths: a weight is the same in all of them."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    apart = apart and metric == "cosine"
    value = {"cosine": F.col("w") if apart else F.col("u"), "jaccard": F.lit(0.0), "weighted_jaccard": F.col("w")}[metric]
    return packed(space.select(F.col("entity_id").alias("id"), "feature_id", "w", "u"), None, value, over=F.col("w") / F.col("u") if apart else None)[0]


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair."""
    turned = pairs.select(*[F.col({"left_id": "right_id", "right_id": "left_id"}.get(c, c)).alias(c) for c in pairs.columns])
    return pairs.unionByName(turned)


def dense(pairs: DataFrame, entities: DataFrame, metric: str = "cosine", limit: int = 4_000) -> DataFrame:
    """(left_id, right_id, score): the full square matrix, zeros and diagonal included, for a number of entities that a matrix suits.

    The diagonal is 1; for Jaccard an entity without features has 0, as its union is empty. The zero pairs come from
    pairing all ids, which is what the matrix asks for, so the number of entities is checked against `limit`: more are an
    error, and `pair_similarity` is the form for them.
    """
    ids = entities.select("entity_id", "features")
    if ids.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} entities: a full matrix does not suit them")
    grid = ids.select(F.col("entity_id").alias("left_id"), F.col("features").alias("own")).crossJoin(ids.select(F.col("entity_id").alias("right_id")))
    self_score = F.when((F.lit(metric) != "cosine") & (F.col("own") == 0), 0.0).otherwise(1.0)
    filled = grid.join(symmetric(pairs).select("left_id", "right_id", "score"), ["left_id", "right_id"], "left")
    return filled.select("left_id", "right_id", F.when(F.col("left_id") == F.col("right_id"), self_score).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))


def matrix_frame(full: DataFrame, ids: list[str]) -> DataFrame:
    """A labelled square table, one column an entity; `ids` are the columns."""
    return full.groupBy("left_id").pivot("right_id", ids).agg(F.first("score")).orderBy("left_id")


def score_counts(space: DataFrame, metric: str = "cosine") -> DataFrame:
    """(score, times): how many pairs have each positive rounded score, counted where the pairs are made."""

    def emit(a: Block, b: Block, rows: slice, dot: np.ndarray, matched: np.ndarray) -> pa.RecordBatch | None:
        i, j = np.nonzero(matched)
        value = block_score(metric, dot[i, j], matched[i, j].astype(np.int64), a.n[rows][i], b.n[j], a.t[rows][i], b.t[j])
        times = np.bincount(np.floor(value * PLACES + 0.5).astype(np.int64))
        at = np.flatnonzero(times[1:]) + 1
        return pa.RecordBatch.from_arrays([pa.array(at / PLACES), pa.array(times[at])], ["score", "times"])

    counts = multiply(_one_side(space, metric, True), None, emit, "score double, times bigint", unit=metric == "weighted_jaccard", held=COUNTED)
    return counts.groupBy("score").agg(F.sum("times").alias("times"))


def similarity_stats(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: pairs, mean, median, p90 and max over all pairs, those that share nothing included as zeros.

    `pairs` are pairs with their score, or counts of scores (`score_counts`).

    Quantiles interpolate linearly, exactly, and without building the zero pairs: the place of a quantile in the sorted
    list of all pairs is known, and places below the number of zeros hold 0.
    """
    n = entities.agg(F.countDistinct("entity_id").alias("n")).select((F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"))
    ranked = pairs if "times" in pairs.columns else pairs.groupBy("score").agg(F.count(F.lit(1)).alias("times"))
    ranked = ranked.where("score > 0")
    total = ranked.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("positive"), F.coalesce(F.sum(F.col("score") * F.col("times")), F.lit(0.0)).alias("sum"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max"))
    whole = n.crossJoin(F.broadcast(total))
    # Distinct rounded scores number at most 10^DIGITS, so one ordered pass over them is bounded.
    upto = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    ladder = ranked.withColumn("upto", F.sum("times").over(upto)).crossJoin(F.broadcast(whole)).withColumn("upto", F.col("upto") + F.col("pairs") - F.col("positive"))

    def value(q: float):
        place = F.lit(q) * (F.col("pairs") - 1)
        zero = F.col("pairs") - F.col("positive")
        low, high = F.floor(place), F.ceil(place)
        first = lambda p: F.coalesce(F.min(F.when((p >= zero) & (F.col("upto") > p), F.col("score"))), F.lit(0.0))
        return first(low), first(high), F.max(place - low)

    l5, h5, w5 = value(0.5)
    l9, h9, w9 = value(0.9)
    got = ladder.agg(l5.alias("l5"), h5.alias("h5"), w5.alias("w5"), l9.alias("l9"), h9.alias("h9"), w9.alias("w9"))
    mid = lambda a, b, w: F.coalesce(F.col(a) + (F.col(b) - F.col(a)) * F.col(w), F.lit(0.0))
    rows = whole.crossJoin(F.broadcast(got))
    return rows.select("pairs", F.round(F.coalesce(F.col("sum") / F.nullif(F.col("pairs"), F.lit(0)), F.lit(0.0)), DIGITS).alias("mean"), F.round(mid("l5", "h5", "w5"), DIGITS).alias("median"), F.round(mid("l9", "h9", "w9"), DIGITS).alias("p90"), "max")


def nearest_in(space: DataFrame, metric: str = "cosine", k: int = 8) -> DataFrame:
    """What `nearest` gives for all pairs of a space, without making these: a block gives no more than its own k best of each entity."""
    side = _one_side(space, metric)

    def emit(a: Block, b: Block, rows: slice, dot: np.ndarray, matched: np.ndarray) -> pa.RecordBatch | None:
        at = np.minimum(np.searchsorted(b.text, a.text[rows]), len(b.text) - 1)
        own = np.flatnonzero(b.text[at] == a.text[rows])
        matched[own, at[own]] = 0
        if len(b.text) > k:
            value = block_score(metric, dot, matched, a.n[rows][:, None], b.n[None], a.t[rows][:, None], b.t[None])
            best = best_places(value, matched, k)
            i, j = np.nonzero(best >= 0)[0], best[best >= 0]
        else:
            i, j = np.nonzero(matched)
        m = matched[i, j].astype(np.int64)
        value = rounded(block_score(metric, dot[i, j], m, a.n[rows][i], b.n[j], a.t[rows][i], b.t[j]))
        return pa.RecordBatch.from_arrays([a.ids[rows].take(pa.array(i)), b.ids.take(pa.array(j)), pa.array(value), pa.array(m)], ["entity_id", "neighbour_id", "score", "shared"])

    rows = multiply(side, side, emit, "entity_id string, neighbour_id string, score double, shared bigint", unit=metric == "weighted_jaccard")
    order = Window.partitionBy("entity_id").orderBy(F.desc("score"), "neighbour_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("entity_id", "rank", "neighbour_id", "score", "shared")


def nearest(pairs: DataFrame, k: int = 8) -> DataFrame:
    """(entity_id, rank, neighbour_id, score, shared): the k best neighbours of every entity that shares anything; equal scores go by id."""
    rows = symmetric(pairs).select(F.col("left_id").alias("entity_id"), F.col("right_id").alias("neighbour_id"), "score", "shared")
    order = Window.partitionBy("entity_id").orderBy(F.desc("score"), "neighbour_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("entity_id", "rank", "neighbour_id", "score", "shared")


def neighbour_table(space: DataFrame, entity: str, metric: str = "cosine", limit: int = 15) -> DataFrame:
    """(rank, entity_id, score, features, shared, mean_shared_w, max_shared_w) for one entity against all others."""
    own = space.where(F.col("entity_id") == entity).select("feature_id", F.col("u").alias("own_u"), F.col("w").alias("own_w"))
    hit = space.where(F.col("entity_id") != entity).join(own, "feature_id")
    hit = hit.groupBy("entity_id").agg(F.sum(F.col("u") * F.col("own_u")).alias("dot"), F.count(F.lit(1)).alias("shared"), F.sum("w").alias("shared_w"), F.avg("w").alias("mean_shared_w"), F.max("w").alias("max_shared_w"))
    totals = entity_totals(space)
    mine = totals.where(F.col("entity_id") == entity).select(F.col("features").alias("own_n"), F.col("total").alias("own_t"))
    rows = hit.join(totals, "entity_id").crossJoin(F.broadcast(mine))
    raw = F.col("dot") if metric == "cosine" else set_score(metric, F.col("shared"), F.col("features"), F.col("own_n"), F.col("shared_w"), F.col("total"), F.col("own_t"))
    rows = rows.withColumn("score", F.round(F.least(F.lit(1.0), raw), DIGITS))
    # One entity's list: `limit` rows come out of a distributed top-k before they get their rank.
    top = rows.orderBy(F.desc("score"), "entity_id").limit(limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "entity_id")))
    return ranked.select("rank", "entity_id", "score", "features", "shared", F.round("mean_shared_w", DIGITS).alias("mean_shared_w"), F.round("max_shared_w", DIGITS).alias("max_shared_w"))


def rank_shift(first: DataFrame, second: DataFrame) -> DataFrame:
    """(entity_id, rank_first, rank_second, shift) of two neighbour tables, entities of either; a place that is missing is null."""
    a = first.select("entity_id", F.col("rank").alias("rank_first"))
    b = second.select("entity_id", F.col("rank").alias("rank_second"))
    return a.join(b, "entity_id", "full_outer").withColumn("shift", F.col("rank_first") - F.col("rank_second"))


def compare(space: DataFrame, left: str, right: str) -> DataFrame:
    """(feature_id, side, w): every feature of either entity, on the side both, left or right."""
    a = space.where(F.col("entity_id") == left).select("feature_id", F.col("w").alias("wa"))
    b = space.where(F.col("entity_id") == right).select("feature_id", F.col("w").alias("wb"))
    side = F.when(F.col("wa").isNull(), "right").when(F.col("wb").isNull(), "left").otherwise("both")
    return a.join(b, "feature_id", "full_outer").select("feature_id", side.alias("side"), F.round(F.coalesce("wa", "wb"), DIGITS).alias("w"))


def comparison_summary(space: DataFrame, left: str, right: str) -> DataFrame:
    """One row: shared, only_left, only_right, jaccard, cosine, and the mean weight of shared features."""
    both = space.where(F.col("entity_id").isin(left, right)).groupBy("feature_id").agg(F.max(F.when(F.col("entity_id") == left, F.col("u"))).alias("ua"), F.max(F.when(F.col("entity_id") == right, F.col("u"))).alias("ub"), F.max("w").alias("w"))
    has = F.col("ua").isNotNull() & F.col("ub").isNotNull()
    row = both.agg(F.count_if(has).alias("shared"), F.count_if(F.col("ub").isNull()).alias("only_left"), F.count_if(F.col("ua").isNull()).alias("only_right"), F.sum(F.col("ua") * F.col("ub")).alias("dot"), F.avg(F.when(has, F.col("w"))).alias("mean_w"))
    union = F.col("shared") + F.col("only_left") + F.col("only_right")
    return row.select("shared", "only_left", "only_right", F.round(F.coalesce(F.col("shared") / F.nullif(union, F.lit(0)), F.lit(0.0)), DIGITS).alias("jaccard"), F.round(F.least(F.lit(1.0), F.coalesce("dot", F.lit(0.0))), DIGITS).alias("cosine"), F.round(F.coalesce("mean_w", F.lit(0.0)), DIGITS).alias("mean_shared_w"))


def shared_heat(space: DataFrame, heated: DataFrame, left: str, right: str) -> DataFrame:
    """One row: the number of features two entities share and the mean heat of these; 0 without any."""
    both = space.where(F.col("entity_id").isin(left, right)).groupBy("feature_id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").join(heated.select("feature_id", "heat"), "feature_id")
    return both.agg(F.count(F.lit(1)).alias("shared"), F.round(F.coalesce(F.avg("heat"), F.lit(0.0)), DIGITS).alias("mean_heat"))
