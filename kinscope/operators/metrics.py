"""Quality of retrieval: accuracy, ranks, breakdowns and the paired test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinscope.operators.scoring import DIGITS

# Trials have (entity_id, rank, sample_size, feature_count, level); rank -1 is a miss.


def top_k(k: int) -> Column:
    return F.coalesce(F.avg(F.col("rank").between(1, k).cast("int").cast("double")), F.lit(0.0))


def reciprocal_rank() -> Column:
    return F.coalesce(F.avg(F.when(F.col("rank") >= 1, 1 / F.col("rank")).otherwise(0.0)), F.lit(0.0))


def bucket(n: Column) -> Column:
    """The size bucket of an entity by its features."""
    return F.when(n < 5, "00-04").when(n <= 10, "05-10").when(n <= 20, "11-20").when(n <= 35, "21-35").when(n <= 50, "36-50").otherwise("51+")


def _figures() -> list[Column]:
    r = lambda c, name: F.round(c, DIGITS).alias(name)
    return [F.count(F.lit(1)).alias("trials"), F.countDistinct("entity_id").alias("entities"), r(top_k(1), "top1"), r(top_k(3), "top3"), r(top_k(5), "top5"), r(reciprocal_rank(), "mrr"), r(F.avg(F.when(F.col("rank") >= 1, F.col("rank"))), "mean_rank"), F.count_if(F.col("rank") < 1).alias("misses")]


def report(trials: DataFrame) -> DataFrame:
    """One row for all trials and one for each sample size, level and size bucket: one pass over grouping sets.

    Columns: dimension (all, sample_size, level, bucket), value, the figures, and each row's share of all trials.
    """
    rows = trials.withColumn("bucket", bucket(F.col("feature_count"))).withColumn("sample_size", F.col("sample_size").cast("string"))
    sets = [["sample_size"], ["level"], ["bucket"], []]
    keys = [F.col("sample_size"), F.col("level"), F.col("bucket")]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(F.grouping_id().alias("gid"), *_figures())
    # grouping_id: a bit is set where the column is rolled up; from the left sample_size, level, bucket.
    dimension = F.when(F.col("gid") == 7, "all").when(F.col("gid") == 3, "sample_size").when(F.col("gid") == 5, "level").otherwise("bucket")
    out = out.withColumn("dimension", dimension).withColumn("value", F.coalesce("sample_size", "level", "bucket", F.lit("all"))).drop("gid", "sample_size", "level", "bucket")
    whole = out.where("dimension = 'all'").select(F.col("trials").alias("whole"))
    out = out.crossJoin(F.broadcast(whole)).withColumn("share", F.round(F.coalesce(F.col("trials") / F.nullif(F.col("whole"), F.lit(0)), F.lit(0.0)), DIGITS)).drop("whole")
    return out.select("dimension", "value", "trials", "entities", "top1", "top3", "top5", "mrr", "mean_rank", "misses", "share")


def per_entity(trials: DataFrame) -> DataFrame:
    """(entity_id, trials, top1): the share of an entity's trials that found it first."""
    return trials.groupBy("entity_id").agg(F.count(F.lit(1)).alias("trials"), F.round(top_k(1), DIGITS).alias("top1"))


def hardest(trials: DataFrame, limit: int = 10) -> DataFrame:
    """The entities found least, those with more trials first among equals."""
    return per_entity(trials).orderBy("top1", F.desc("trials"), "entity_id").limit(limit)


def paired_test(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: entities, delta, better, worse, tied, p of two runs over the same entities.

    Wilcoxon's signed ranks, two-sided: differences of 0 drop out, equal ones share their mean rank; p is the normal
    approximation with the correction for ties and without one for continuity, NaN if all are tied.
    """
    a = first.groupBy("entity_id").agg(top_k(1).alias("a"))
    b = second.groupBy("entity_id").agg(top_k(1).alias("b"))
    d = a.join(b, "entity_id").withColumn("d", F.round(F.col("a") - F.col("b"), 9))
    # Mean ranks need only how often each size of difference occurs.
    sizes = d.where("d <> 0").groupBy(F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    below = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.withColumn("r", F.coalesce(F.sum("t").over(below), F.lit(0)) + (F.col("t") + 1) / 2)
    s = ranks.agg(F.sum(F.col("r") * F.col("up")).alias("w"), F.sum("t").alias("n"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    head = d.agg(F.count(F.lit(1)).alias("entities"), F.round(F.avg("d"), DIGITS).alias("delta"), F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") < 0).alias("worse"), F.count_if(F.col("d") == 0).alias("tied"))
    both = head.crossJoin(F.broadcast(s))
    row = both.first()
    p = float("nan")
    if row["n"]:
        n = row["n"]
        spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - row["ties"] / 48)
        p = math.erfc(abs(row["w"] - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread > 0 else float("nan")
    return both.select("entities", "delta", "better", "worse", "tied", F.lit(p).alias("p"))
