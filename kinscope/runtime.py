"""Session, shared work folder and small planning helpers that every operator uses."""

from __future__ import annotations

import atexit
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A table that took so many seconds has its shuffle files let go once it is written.
LONG = 2.0
# Spark's setting by which a statement deletes its shuffle files at its end.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def session(app: str = "kinscope", **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE, Arrow. Cluster settings win where they are set."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the package to the session's Python workers, once; on a cluster they need not have it installed."""
    import shutil
    import tempfile
    from pathlib import Path

    sc = spark.sparkContext
    if not getattr(sc, "_kinscope", False):
        here = Path(__file__).resolve().parent
        made = tempfile.mkdtemp(prefix="kinscope-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(f"{made}/kinscope", "zip", here.parent, here.name))
        sc._kinscope = True


def work_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder of its own; on a cluster that would be a
    machine-local place which other executors cannot read, so there it is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or (sc._jsc.sc().getCheckpointDir().get() if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if folder:
        return folder
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    folder = "file://" + tempfile.mkdtemp(prefix="kinscope-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame, name: str, *, lean: bool = False, **write_options: str) -> DataFrame:
    """Writes `df` as Parquet into the shared work folder and reads it back: lineage is cut, and the stage survives lost executors.

    With `lean` the shuffle files of this go at once, for large ones that would else lie beside those of the next steps.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/kinscope/{name}-{uuid.uuid4().hex}"
    began = time.monotonic()
    before = spark.conf.get(FREED, None)
    if lean:
        spark.conf.set(FREED, "true")
    try:
        df.write.options(**write_options).parquet(path)
    finally:
        if lean:
            spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    if time.monotonic() - began > LONG:
        # Spark deletes shuffle files when the JVM collects their plan, which may otherwise be never.
        spark.sparkContext._jvm.System.gc()
    if not _written:
        atexit.register(forget)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def let_go(*tables: DataFrame) -> None:
    """Deletes tables that `materialise` gave, once all that reads them is written itself."""
    for df in tables:
        own = (df.sparkSession, df._written_at)
        _written.remove(own)
        _delete(*own)


def forget() -> None:
    """Deletes the tables that `materialise` wrote; runs at exit as well."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone, and its folder with it
            return


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partitioned by columns into as many tasks as the session shuffles into.

    For steps whose work is large against their bytes: without a number AQE would join partitions by size and leave few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def distinct_by(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The distinct rows of key and columns, shuffled once by the key: what groups, windows or joins by the key then needs no further shuffle.

    For rows that are distinct already or nearly so, as repeated ones are not combined before they are sent.
    """
    return df.select(key, *columns).repartition(key).distinct()


def numbered(df: DataFrame, by: str) -> DataFrame:
    """(by, number): each value's place among the sorted ones, from 0. Places are counted inside ranges of values, and one row a range is added up."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(df.select(by).repartitionByRange(parts, by).withColumn("part", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    inside = rows.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1)
    return inside.join(before, "part").select(by, (F.col("i") + F.col("before")).alias("number"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test or warehouse table by name."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current_rows(df: DataFrame, key: str, stamp: str, *columns: str) -> DataFrame:
    """The latest row of every key, as `key` and `columns`.

    `max_by` is combined on the map side, so a key that holds a third of all rows sends one row a task into the
    shuffle. Null keys are left out; a null stamp counts as the oldest; rows that share the latest stamp are taken
    to be equal, as the tables promise (for unequal ones any of them is taken).
    """
    old = F.lit("0001-01-01 00:00:00").cast("timestamp").cast(df.schema[stamp].dataType)
    picked = F.max_by(F.struct(*columns), F.coalesce(F.col(stamp), old)).alias("row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(picked).select(key, "row.*")
