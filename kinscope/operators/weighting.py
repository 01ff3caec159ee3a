"""How common each feature is, and what weight that gives it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinscope.config import SCHEMES
from kinscope.functions.text import fold, fold_text


def entity_count(edges: DataFrame) -> DataFrame:
    """One row: n, the number of entities."""
    return edges.agg(F.countDistinct("entity_id").alias("n"))


def feature_frequency(edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(feature_id, feature_name, entity_count, entity_ratio): in how many entities each feature occurs.

    Repeated edges count once: the pair is aggregated first, so that no task has to hold the entities of a common
    feature. A feature without a name keeps its id as name. No edges, no rows.
    """
    counts = edges.groupBy("feature_id", "entity_id").agg(F.lit(1).alias("one")).groupBy("feature_id").agg(F.count(F.lit(1)).alias("entity_count"))
    counts = counts.crossJoin(F.broadcast(entity_count(edges))).withColumn("entity_ratio", F.col("entity_count") / F.col("n"))
    named = counts.withColumn("feature_name", F.col("feature_id"))
    if names is not None:
        named = counts.join(names.select("feature_id", F.col("feature_name").alias("own")), "feature_id", "left").withColumn("feature_name", F.coalesce("own", "feature_id"))
    return named.select("feature_id", "feature_name", "entity_count", "entity_ratio")


def coverage_summary(frequency: DataFrame) -> DataFrame:
    """One row: the number of features, and the shares that one entity has and that more than half have; 0 without features."""
    share = lambda c: F.coalesce(F.avg(c.cast("int").cast("double")), F.lit(0.0))
    return frequency.agg(F.count(F.lit(1)).alias("features"), share(F.col("entity_count") == 1).alias("singleton_share"), share(F.col("entity_ratio") > 0.5).alias("commodity_share"))


def idf(df: Column, n: Column, smoothing: float = 1.0) -> Column:
    """ln((n + s) / (df + s)) + 1; an error for n <= 0 or df < 0."""
    value = F.ln((n + F.lit(smoothing)) / (df + F.lit(smoothing))) + F.lit(1.0)
    return F.when((n <= 0) | (df < 0), F.raise_error("idf needs at least one entity and no negative count").cast("double")).otherwise(value)


def weight(df: Column, n: Column, scheme: str, smoothing: float = 1.0) -> Column:
    """The weight of a feature by scheme: smooth_idf, plain_idf (0 for a feature that all have) or binary."""
    if scheme == "smooth_idf":
        return idf(df, n, smoothing)
    if scheme == "plain_idf":
        return F.when(df > 0, F.ln(n / df)).otherwise(F.lit(0.0))
    if scheme == "binary":
        return F.lit(1.0)
    raise ValueError(f"scheme must be one of {SCHEMES}, not {scheme!r}")


def feature_weights(edges: DataFrame, scheme: str = "smooth_idf", smoothing: float = 1.0, names: DataFrame | None = None) -> DataFrame:
    """(feature_id, feature_name, entity_count, entity_ratio, weight, rarity) of every feature.

    `rarity` is always the smoothed idf, whatever the scheme of `weight`: it serves confidence, not scoring.
    """
    rows = feature_frequency(edges, names).crossJoin(F.broadcast(entity_count(edges)))
    n = F.col("n")
    return rows.withColumn("weight", weight(F.col("entity_count"), n, scheme, smoothing)).withColumn("rarity", idf(F.col("entity_count"), n, smoothing)).drop("n")


def band(weights: DataFrame) -> DataFrame:
    """Adds `band`: distinctive (up to 3 entities), commodity (ratio of 0.40 or more), else middle."""
    return weights.withColumn("band", F.when(F.col("entity_count") <= 3, "distinctive").when(F.col("entity_ratio") >= 0.40, "commodity").otherwise("middle"))


def share_band(ratio: Column) -> Column:
    """The display band of a share: distinctive up to 0.05, common from 0.35, else usual."""
    return F.when(ratio <= 0.05, "distinctive").when(ratio >= 0.35, "common").otherwise("usual")


def heat(weights: DataFrame) -> DataFrame:
    """Adds `heat`: rarity scaled to 0..1 over all features; 1 where all are equally rare."""
    span = weights.agg(F.min("rarity").alias("low"), F.max("rarity").alias("high"))
    value = F.when(F.col("high") > F.col("low"), (F.col("rarity") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))).otherwise(F.lit(1.0))
    return weights.crossJoin(F.broadcast(span)).withColumn("heat", value).drop("low", "high")


def normalized_rarity(features: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rarity): the mean rarity of each group's features over the greatest rarity of all; unknown ids count as the least rare.

    A group without features has no row here; where it must have one, its rarity is 0.
    """
    span = weights.agg(F.min("rarity").alias("low"), F.max("rarity").alias("high"))
    rows = features.select(*by, "feature_id").join(weights.select("feature_id", "rarity"), "feature_id", "left").crossJoin(F.broadcast(span))
    mean = rows.groupBy(*by).agg(F.avg(F.coalesce("rarity", "low")).alias("mean"), F.max("high").alias("high"))
    return mean.select(*by, F.when(F.col("high") > 0, F.col("mean") / F.nullif(F.col("high"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("rarity"))


# The phases of an intrusion in the order of a matrix's columns.
CATEGORY_ORDER = ["reconnaissance", "resource-development", "initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion", "stealth", "defense-impairment", "credential-access", "discovery", "lateral-movement", "collection", "command-and-control", "exfiltration", "impact"]


def category_place(category: Column) -> Column:
    """The column of a category in the matrix; unknown ones come after all known."""
    at = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), category)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(CATEGORY_ORDER)))


def category_title(category: Column) -> Column:
    """A category's name for display: words from its hyphens, each with a capital; in known ones 'and' stays small."""
    title = F.initcap(F.regexp_replace(category, "-", " "))
    return F.when(category_place(category) < len(CATEGORY_ORDER), F.regexp_replace(title, " And ", " and ")).otherwise(title)


def category_table(features: DataFrame) -> DataFrame:
    """(place, category, title, features) of features (technique_id, category), in the order of the matrix, unknown categories last by name."""
    counts = features.groupBy("category").agg(F.countDistinct("technique_id").alias("features"))
    return counts.select(category_place(F.col("category")).alias("place"), "category", category_title(F.col("category")).alias("title"), "features").orderBy("place", "category")


def matrix_view(heated: DataFrame, categories: DataFrame, text: str = "") -> DataFrame:
    """(column, row, category, feature_id, feature_name, heat): the features of each category, hottest first, those whose id or name holds the text."""
    needle = fold_text(text).strip()
    rows = heated.join(categories, "feature_id")
    if needle:
        rows = rows.where((F.instr(F.lower("feature_id"), needle) > 0) | (F.instr(fold(F.col("feature_name")), needle) > 0))
    order = Window.partitionBy("category").orderBy(F.desc(F.round("heat", 6)), "feature_id")
    return rows.select(category_place(F.col("category")).alias("column"), F.row_number().over(order).alias("row"), "category", "feature_id", "feature_name", "heat")
