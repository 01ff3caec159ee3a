"""Which entities behave like each of many queries: scores, ranks and evidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinscope.config import METRICS, Config
from kinscope.operators.blocks import PLACES, Block, multiply, once_each, packed, rounded
from kinscope.operators.vectors import feature_lists, known_lists, query_vectors

DIGITS = 6


def query_frame(spark, features: dict[str, list[str]]) -> DataFrame:
    """(query_id, feature_id) of a few queries held by the caller."""
    return spark.createDataFrame([(q, f) for q, own in features.items() for f in own], "query_id string, feature_id string")


def known_features(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, feature_id, known) of every distinct feature of each query."""
    return query_vectors(queries, weights).select("query_id", "feature_id", "known")


def score(space: DataFrame, queries: DataFrame, weights: DataFrame, config: Config = Config()) -> DataFrame:
    """(query_id, entity_id, score, coverage, matched, known): every entity that shares a feature with a query.

    Blocks of queries meet blocks of entities (`blocks.multiply`), so no pair is shuffled; equal
    entities are multiplied once. Entities that share nothing
    score 0 and have no row. Scores are clipped to 0..1, multiplied by coverage (share of the query's known features that
    the entity has) where the correction is on, whatever the metric, and rounded before ranking, so that the order of
    summation cannot change ranks. A query without a known feature, or whose vector has no length, has no rows.
    """
    return _scored(space, queries, weights, config, None)


def leading(space: DataFrame, queries: DataFrame, weights: DataFrame, config: Config = Config(), n: int | None = None) -> DataFrame:
    """The n best rows of `score` for each query, by default all that ranks, lists, evidence and confidence need; a block gives no more than its own n best."""
    n = max(2, config.top_k) if n is None else n
    return leaders(_scored(space, queries, weights, config, n), n)


def _scored(space: DataFrame, queries: DataFrame, weights: DataFrame, config: Config, best: int | None) -> DataFrame:
    config.validate()
    q = query_vectors(queries, weights).where("known").select(F.col("query_id").alias("id"), "feature_id", "w", "u")
    entities = space.select(F.col("entity_id").alias("id"), "feature_id", "w", "u")
    mine, theirs = {"cosine": (F.col("u"), F.col("u")), "jaccard": (F.lit(0.0), F.lit(0.0)), "weighted_jaccard": (F.lit(1.0), F.col("w"))}[config.metric]
    left, right = packed(q, entities, mine, theirs)
    right = once_each(right)
    metric, corrected, power = config.metric, config.coverage_correction, config.coverage_power

    def emit(a: Block, b: Block, rows: slice, dot: np.ndarray, matched: np.ndarray) -> pa.RecordBatch | None:
        known = a.n[rows].astype(float)[:, None]
        if best is not None and len(b.ids) > best:
            value = block_score(metric, dot, matched, known, b.n[None], a.t[rows][:, None], b.t[None])
            if corrected:
                value *= (matched / known) ** power if power != 1 else matched / known
            at = best_places(value, matched, best)
            i, j = np.nonzero(at >= 0)[0], at[at >= 0]
        else:
            i, j = np.nonzero(matched)
        m, known = matched[i, j].astype(np.int64), a.n[rows][i]
        value = block_score(metric, dot[i, j], m, known, b.n[j], a.t[rows][i], b.t[j])
        coverage = m / known
        if corrected:
            value = value * coverage**power
        # The n best rows are among the n lowest ids of the n best classes, classes in the order of score and lowest id.
        which, entity = b.expanded(j, best)
        return pa.RecordBatch.from_arrays([a.ids[rows].take(pa.array(i[which])), entity, *[pa.array(x[which]) for x in (rounded(value), rounded(coverage), m, known)]], ["query_id", "entity_id", "score", "coverage", "matched", "known"])

    return multiply(left, right, emit, "query_id string, entity_id string, score double, coverage double, matched bigint, known bigint", whole=best is None)


def block_score(metric: str, dot: np.ndarray, shared: np.ndarray, own: np.ndarray, other: np.ndarray, own_total: np.ndarray, other_total: np.ndarray) -> np.ndarray:
    """`set_score` or the cosine of arrays, within 0 and 1."""
    if metric == "cosine":
        return np.clip(dot, 0, 1)
    over, union = (shared, own + other - shared) if metric == "jaccard" else (dot, own_total + other_total - dot)
    return np.clip(np.divide(over, union, out=np.zeros(np.shape(union)), where=union != 0), 0, 1)


def best_places(value: np.ndarray, matched: np.ndarray, n: int) -> np.ndarray:
    """The columns of each row's n best values, rounded, of equal ones the first; -1 where fewer share anything."""
    many = value.shape[1]
    # A whole number that orders by rounded value, then by place; exact in doubles.
    key = np.floor(value * PLACES + 0.5) * many
    key += np.arange(many - 1, -1, -1)
    key[matched == 0] = -1
    at = np.argpartition(key, many - n, axis=1)[:, many - n :]
    return np.where(np.take_along_axis(key, at, axis=1) >= 0, at, -1)


def set_score(metric: str, matched: Column, own: Column, other: Column, shared: Column, own_total: Column, other_total: Column) -> Column:
    """Jaccard by counts or by weights; 0 for an empty union."""
    if metric == "jaccard":
        return F.coalesce(matched / F.nullif((own + other - matched).cast("double"), F.lit(0.0)), F.lit(0.0))
    if metric == "weighted_jaccard":
        return F.coalesce(shared / F.nullif(own_total + other_total - shared, F.lit(0.0)), F.lit(0.0))
    raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")


def ranking(by: str = "query_id"):
    return Window.partitionBy(by).orderBy(F.desc("score"), "entity_id")


def leaders(scores: DataFrame, n: int) -> DataFrame:
    """The n best rows of each query. Whatever needs no more, ranks and the runner-up, may be computed from these alone."""
    return scores.withColumn("__p", F.row_number().over(ranking())).where(F.col("__p") <= n).drop("__p")


def rank(scores: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds `rank`, dense from 1, and keeps ranks up to top_k of scores above 0 and from min_score; equal scores go by id."""
    kept = scores.where((F.col("score") > 0) & (F.col("score") >= config.min_score))
    return kept.withColumn("rank", F.row_number().over(ranking())).where(F.col("rank") <= config.top_k)


def runner_up(scores: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, top_score, runner_up): over all entities, not only those shown; null where there is one entity only.

    Entities without a row score 0, so the runner-up of a query with one hit among many entities is 0.
    """
    two = scores.withColumn("p", F.row_number().over(ranking())).where("p <= 2")
    both = two.groupBy("query_id").agg(F.max(F.when(F.col("p") == 1, F.col("score"))).alias("top_score"), F.max(F.when(F.col("p") == 2, F.col("score"))).alias("second"))
    n = entities.agg(F.countDistinct("entity_id").alias("n"))
    return both.crossJoin(F.broadcast(n)).select("query_id", "top_score", F.when(F.col("n") >= 2, F.coalesce("second", F.lit(0.0))).alias("runner_up"))


def mass(metric: str) -> Column:
    """What a matched feature contributes to the score: w squared for cosine, w for weighted Jaccard, 1 for Jaccard."""
    return {"cosine": F.col("w") * F.col("w"), "weighted_jaccard": F.col("w"), "jaccard": F.lit(1.0)}[metric]


def evidence(ranked: DataFrame, space: DataFrame, queries: DataFrame, weights: DataFrame, config: Config = Config()) -> DataFrame:
    """(query_id, entity_id, place, feature_id, feature_name, w, share): the features that carry each candidate's score, greatest share first."""
    q = query_vectors(queries, weights).where("known").select("query_id", "feature_id")
    hit = ranked.select("query_id", "entity_id").join(q, "query_id").join(space.select("entity_id", "feature_id", "w"), ["entity_id", "feature_id"])
    own = Window.partitionBy("query_id", "entity_id")
    total = F.sum(mass(config.metric)).over(own)
    hit = hit.withColumn("share", F.round(F.coalesce(mass(config.metric) / F.nullif(total, F.lit(0.0)), F.lit(0.0)), DIGITS))
    hit = hit.withColumn("place", F.row_number().over(own.orderBy(F.desc("share"), "feature_id"))).where(F.col("place") <= config.max_evidence)
    return hit.join(weights.select("feature_id", "feature_name"), "feature_id").select("query_id", "entity_id", "place", "feature_id", "feature_name", F.round("w", DIGITS).alias("w"), "share")


def matched_and_missing(ranked: DataFrame, space: DataFrame, queries: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, entity_id, matched_ids, missing_ids): sorted lists of the query's known features the candidate has and lacks."""
    rows = with_features(ranked.select("query_id", "entity_id"), space, known_lists(queries, weights).where(F.size("asked") > 0))
    own = F.coalesce("own", F.array().cast("array<string>"))
    return rows.select("query_id", "entity_id", F.array_sort(F.array_intersect("asked", own)).alias("matched_ids"), F.array_sort(F.array_except("asked", own)).alias("missing_ids"))


def with_features(rows: DataFrame, space: DataFrame, asked: DataFrame) -> DataFrame:
    """Adds to pairs (query_id, entity_id) both sides' features as lists, `asked` and `own`: one row a query or entity is shuffled, none a feature."""
    return rows.join(asked, "query_id").join(feature_lists(space, "entity_id", "own"), "entity_id", "left")


def relative_gap(ranked: DataFrame) -> DataFrame:
    """Adds `gap`: how far a candidate lies behind the one before it, as a share of that one's score; null for the first."""
    before = F.lag("score").over(Window.partitionBy("query_id").orderBy("rank"))
    return ranked.withColumn("gap", F.round((before - F.col("score")) / F.nullif(before, F.lit(0.0)), DIGITS))
