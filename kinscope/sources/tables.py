"""Reading and writing the artefacts of a build, and edges out of test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinscope.functions.ids import id_set
from kinscope.runtime import current_rows, table

# The column contract of each artefact, in order.
CONTRACTS = {
    "edges": ["entity_id", "feature_id"],
    "features": ["feature_id", "feature_name", "categories"],
    "entities": ["entity_id", "entity_name", "aliases", "feature_ids"],
    "weights": ["feature_id", "feature_name", "entity_count", "entity_ratio", "weight", "rarity"],
    "space": ["entity_id", "feature_id", "w", "u"],
    "pairs": ["left_id", "right_id", "score", "shared"],
    "clusters": ["entity_id", "cluster_id"],
    "layout": ["entity_id", "x", "y"],
    "trials": ["trial_id", "entity_id", "sample_size", "feature_count", "noise_count", "rank", "top_score", "confidence", "level"],
}
MADE_BY = {"edges": "normalize", "features": "normalize", "entities": "normalize", "weights": "feature_weights", "space": "vector_space", "pairs": "pair_similarity", "clusters": "clusters", "layout": "layout", "trials": "run_trials"}


class MissingArtefact(FileNotFoundError):
    """An artefact that has not been built; the message names the operator that makes it."""


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write(df: DataFrame, folder: str, name: str) -> None:
    """Writes an artefact as Parquet in the order of its contract; a missing column is an error, further ones are left out. An empty artefact is refused."""
    missing = [c for c in CONTRACTS[name] if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks the columns {missing}")
    if df.isEmpty():
        raise ValueError(f"{name} is empty")
    df.select(*CONTRACTS[name]).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Reads an artefact; where it is missing, the error names the operator that makes it."""
    path = f"{folder}/{name}.parquet"
    if not exists(spark, path):
        raise MissingArtefact(f"{path} is missing; {MADE_BY.get(name, 'a build')} makes it")
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header by a declared schema; `columns` must be there."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    if columns and (missing := [c for c in columns if c not in df.columns]):
        raise ValueError(f"{path} lacks the columns {missing}")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; lists are joined by bars, as cells hold no arrays."""
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON document or list of documents by a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column."""
    return df.select(*[F.nanvl(c, F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def optional_csv(spark: SparkSession, path: str, schema: str, drop: tuple[str, ...] = ("notes",)) -> DataFrame:
    """A report table if it is there, else an empty one; notes are dropped, NaN becomes null."""
    df = spark.read.schema(schema).option("header", True).csv(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return without_nan(df.drop(*drop))


def event_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(entity_id, feature_id): users and the kinds of events they had, event type and key of the properties."""
    e = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("entity_id"), F.concat_ws("|", "event_type", F.get_json_object("props", "$.k")).alias("feature_id"))
    return e.where("entity_id is not null and feature_id is not null").distinct()


def order_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(entity_id, feature_id): customers and the brand and type of parts they ordered."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    l = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")  # noqa: E741
    p = table(spark, folder, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("feature_id"))
    rows = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("o_custkey").cast("string").alias("entity_id"), "feature_id").distinct()


def actor_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(entity_id, feature_id): actors and the technique ids of their current rows."""
    rows = current_rows(table(spark, folder, "actors"), "actor_id", "built_at", "technique_ids")
    return rows.select(F.col("actor_id").alias("entity_id"), F.explode(id_set(F.col("technique_ids"))).alias("feature_id"))


def actor_entities(spark: SparkSession, folder: str) -> DataFrame:
    """(entity_id, entity_name, aliases) of every actor's current row."""
    rows = current_rows(table(spark, folder, "actors"), "actor_id", "built_at", "name", "aliases")
    return rows.select(F.col("actor_id").alias("entity_id"), F.col("name").alias("entity_name"), "aliases")


def technique_names(spark: SparkSession, folder: str) -> DataFrame:
    """(feature_id, feature_name) of the catalogue."""
    return table(spark, folder, "techniques").groupBy(F.col("technique_id").alias("feature_id")).agg(F.min("technique_name").alias("feature_name"))
