"""Weighted vectors of entities and queries, kept long: one row for each feature an entity has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinscope.runtime import distinct_by


def vocabulary(edges: DataFrame) -> DataFrame:
    """(feature_id): every feature in use, sorted."""
    return edges.select("feature_id").distinct().orderBy("feature_id")


def vector_space(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(entity_id, feature_id, w, u): the weight of each feature an entity has, and that over the entity's length.

    Presence is w > 0, so a feature whose weight is 0 is absent; an entity left without features has no rows.
    A feature without a weight is an error. Repeated edges count once.
    """
    # One shuffle by entity serves the distinct rows as well as the lengths.
    rows = distinct_by(edges, "entity_id", "feature_id").join(weights.select("feature_id", F.col("weight").cast("double").alias("w")), "feature_id", "left")
    w = F.when(F.col("w").isNull(), F.raise_error(F.concat(F.lit("feature without a weight: "), F.col("feature_id"))).cast("double")).otherwise(F.col("w"))
    rows = rows.select("entity_id", "feature_id", w.alias("w")).where("w > 0")
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("entity_id")))
    return rows.withColumn("u", F.col("w") / length)


def query_vectors(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, feature_id, known, w, u): each distinct feature of a query; unknown ones have no weight.

    `known` means: in the weight table. The length is taken over known features; u is 0 where the length is 0.
    """
    rows = distinct_by(queries, "query_id", "feature_id").join(weights.select("feature_id", F.col("weight").cast("double").alias("w")), "feature_id", "left")
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_id")))
    return rows.select("query_id", "feature_id", F.col("w").isNotNull().alias("known"), "w", F.when(length > 0, F.col("w") / F.nullif(length, F.lit(0.0))).otherwise(F.when(F.col("w").isNotNull(), 0.0)).alias("u"))


def feature_lists(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the set of each entity's or query's feature ids as one row; null ids are left out."""
    return rows.groupBy(key).agg(F.collect_set("feature_id").alias(name))


def known_lists(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, asked): the set of each query's features that are in the weight table; an empty one where none is."""
    known = queries.join(weights.select(F.col("feature_id").alias("__f")), F.col("feature_id") == F.col("__f"), "left")
    return feature_lists(known.select("query_id", F.col("__f").alias("feature_id")), "query_id", "asked")


def to_binary(space: DataFrame) -> DataFrame:
    """(entity_id, feature_id, present): 1 for each feature of positive weight."""
    return space.where("w > 0").select("entity_id", "feature_id", F.lit(1).alias("present"))


def entity_totals(space: DataFrame) -> DataFrame:
    """(entity_id, features, total): how many features an entity has, and the sum of their weights."""
    return space.groupBy("entity_id").agg(F.count(F.lit(1)).alias("features"), F.sum("w").alias("total"))
