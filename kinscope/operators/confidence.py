"""How far the best answer to a query can be trusted: rarity, margin and sufficiency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinscope.config import Config
from kinscope.operators.scoring import DIGITS, leaders, rank, runner_up, with_features
from kinscope.operators.vectors import known_lists
from kinscope.operators.weighting import normalized_rarity


def margin_component(top: Column, second: Column, saturation: float = 0.15) -> Column:
    """How far the best leads, relative to its score and saturated: 1 without a runner-up, 0 for a best score of 0 or less."""
    lead = (top - second) / F.nullif(top, F.lit(0.0))
    return F.when(top <= 0, 0.0).when(second.isNull(), 1.0).otherwise(F.least(F.lit(1.0), lead / F.lit(saturation)))


def sufficiency_component(known: Column, least: int = 3, enough: int = 12) -> Column:
    """0 up to `least` known features, 1 from `enough`, linear between; a step at `least` if `enough` is not above it."""
    if enough <= least:
        return F.when(known >= least, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (known - F.lit(least)) / F.lit(float(enough - least))))


def level(score: Column, known: Column, config: Config = Config()) -> Column:
    """high, medium or low; always low below the least number of known features."""
    return F.when(known < config.min_known, "low").when(score >= config.high_level, "high").when(score >= config.medium_level, "medium").otherwise("low")


def confidence(scores: DataFrame, space: DataFrame, queries: DataFrame, weights: DataFrame, config: Config = Config()) -> DataFrame:
    """(query_id, rarity, margin, sufficiency, score, level, weakest): one row for every query.

    The margin uses the runner-up of the full ranking, so it does not depend on top_k. Rarity is of the best candidate's
    matched features, by smoothed idf. A query without candidates has all components 0 and level low. weakest is the
    least component; of equals the first of rarity, margin, sufficiency.
    """
    asked = known_lists(queries, weights)
    scores = leaders(scores, max(2, config.top_k))
    known = asked.select("query_id", F.size("asked").cast("bigint").alias("known"))
    best = rank(scores, config).where("rank = 1").select("query_id", "entity_id")
    hit = with_features(best, space, asked).select("query_id", "entity_id", F.explode(F.array_intersect("asked", "own")).alias("feature_id"))
    rows = known.join(best, "query_id", "left").join(normalized_rarity(hit, weights, ["query_id"]), "query_id", "left").join(runner_up(scores, space), "query_id", "left")
    none = F.col("entity_id").isNull()
    part = lambda c: F.when(none, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    rows = rows.select("query_id", "known", part(F.col("rarity")).alias("rarity"), part(margin_component(F.col("top_score"), F.col("runner_up"), config.margin_saturation)).alias("margin"), part(sufficiency_component(F.col("known"), config.min_known, config.saturation_known)).alias("sufficiency"))
    total = sum(F.lit(w) * F.col(c) for c, w in config.component_weights.items())
    rows = rows.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), DIGITS))
    least = F.least("rarity", "margin", "sufficiency")
    weakest = F.when(F.col("rarity") == least, "rarity").when(F.col("margin") == least, "margin").otherwise("sufficiency")
    return rows.select("query_id", "known", *[F.round(c, DIGITS).alias(c) for c in ("rarity", "margin", "sufficiency")], "score", level(F.col("score"), F.col("known"), config).alias("level"), weakest.alias("weakest"))


def reasons(breakdown: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds `reasons`: a sentence for each weak component, the weakest first; equals in the order rarity, margin, sufficiency."""
    said = {
        "rarity": "The shared features are common to many entities.",
        "margin": "The runner-up is close behind the best candidate.",
        "sufficiency": "The query has few known features.",
    }
    items = F.array(*[F.struct(F.col(c).alias("value"), F.lit(i).alias("place"), F.lit(text).alias("text")) for i, (c, text) in enumerate(said.items())])
    weak = F.filter(F.array_sort(items), lambda x: x["value"] <= config.weak_component)
    return breakdown.withColumn("reasons", F.transform(weak, lambda x: x["text"]))
