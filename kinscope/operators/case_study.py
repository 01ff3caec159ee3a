"""A close look at one entity, and reports as tables and text."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinscope.config import METRICS, Config
from kinscope.operators.pairs import neighbour_table, rank_shift
from kinscope.operators.scoring import DIGITS, evidence, query_frame, rank, score
from kinscope.operators.weighting import band


def feature_table(space: DataFrame, weights: DataFrame, entity: str) -> DataFrame:
    """(place, feature_id, feature_name, weight, entity_count, band) of one entity's features, heaviest first."""
    own = space.where(F.col("entity_id") == entity).select("feature_id").join(band(weights), "feature_id")
    # The features of one entity: a few hundred rows at most.
    return own.withColumn("place", F.row_number().over(Window.orderBy(F.desc("weight"), "feature_id"))).select("place", "feature_id", "feature_name", F.round("weight", DIGITS).alias("weight"), "entity_count", "band")


def contrast_queries(features: DataFrame, most: int = 8) -> dict[str, list[str]]:
    """Two queries out of a feature table: the rarest and the most common of its features, half of them at most and `most` each."""
    ids = [r["feature_id"] for r in features.orderBy("place").select("feature_id").collect()]
    n = min(most, len(ids) // 2)
    return {"rare": ids[:n], "common": ids[len(ids) - n :] if n else []}


def candidates_frame(ranked: DataFrame, target: str) -> DataFrame:
    """A query's candidates with a flag on the entity looked at."""
    return ranked.select("query_id", "rank", "entity_id", "score", "coverage", "matched", (F.col("entity_id") == target).alias("is_target")).orderBy("query_id", "rank")


def case_study(space: DataFrame, weights: DataFrame, entity: str, config: Config = Config(), limit: int = 15) -> dict[str, DataFrame]:
    """Tables by name: features, neighbours by each metric, the shift from cosine to Jaccard, and both contrast queries by each metric with evidence."""
    out = {"features": feature_table(space, weights, entity)}
    for metric in METRICS:
        out[f"neighbours_{metric}"] = neighbour_table(space, entity, metric, limit)
    out["rank_shift"] = rank_shift(out["neighbours_cosine"], out["neighbours_jaccard"])
    queries = query_frame(space.sparkSession, contrast_queries(out["features"]))
    for metric in METRICS:
        own = replace(config, metric=metric)
        ranked = rank(score(space, queries, weights, own), own)
        out[f"contrast_{metric}"] = candidates_frame(ranked, entity)
        out[f"evidence_{metric}"] = evidence(ranked, space, queries, weights, own)
    return out


def write_case_study(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def report_row(report: DataFrame, label: str) -> DataFrame:
    """The overall row of a report as one flat row for display: shares to four places, ranks to three."""
    whole = report.where("dimension = 'all'")
    return whole.select(F.lit(label).alias("label"), "trials", "entities", *[F.round(c, 4).alias(c) for c in ("top1", "top3", "top5", "mrr")], F.round("mean_rank", 3).alias("mean_rank"), "misses")


def text_table(df: DataFrame, limit: int = 50) -> str:
    """The first rows of a table as aligned text."""
    rows = [df.columns, *[["-" if v is None else str(v) for v in r] for r in df.limit(limit).collect()]]
    width = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in rows]
    return "\n".join([lines[0], "  ".join("-" * w for w in width), *lines[1:]])


def write_report(report: DataFrame, folder: str) -> None:
    """A report as a table by dimension, partitioned, for a scan that wants one breakdown."""
    report.write.mode("overwrite").partitionBy("dimension").parquet(folder)
