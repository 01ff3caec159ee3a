"""Observations as a stream: windows over event time, and scoring of cases as they grow. An extension; the batch operators do the work."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinscope.config import Config
from kinscope.operators.scoring import rank, score
from kinscope.runtime import work_folder


def observation_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """An unbounded table of the Parquet files that arrive in a folder; of a single file, that file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", path.rpartition("/")[2]).parquet(path.rpartition("/")[0])


def windowed_counts(events: DataFrame, stamp: str, kind: str, *, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, kind, events): counts by tumbling window of event time; what comes later than the watermark is left out.

    Event time without a zone is read in the session's, which is UTC.
    """
    rows = events.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late).groupBy(F.window(stamp, window), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("events"))
    return rows.select(F.col("window.start").alias("window_start"), "kind", "events")


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there, and gives its final table. For bounded aggregates only: the sink is memory."""
    table = f"{name}_{uuid.uuid4().hex[:8]}"
    state = f"{work_folder(stream.sparkSession)}/{table}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(table).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(table)


def score_cases(cases: DataFrame, space: DataFrame, weights: DataFrame, sink: Callable[[DataFrame, int], None], config: Config = Config(), state: str | None = None):
    """Starts a stream of (query_id, feature_id) that calls `sink(candidates, batch)` for the cases each batch touches.

    `foreachBatch` hands each batch to the batch scoring; the same batch number may come again after a failure, so a
    sink that overwrites by batch number is exactly-once. Each batch is scored by itself. `state` is the folder that a
    restarted stream goes on from; unset, the stream starts afresh in a folder of its own.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(rank(score(space, batch, weights, config), config), number)

    state = state or f"{work_folder(space.sparkSession)}/score-cases-{uuid.uuid4().hex}"
    return cases.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start()


def rank_changes(answers: DataFrame) -> DataFrame:
    """(query_id, revision, entity_id, rank, before, change) of (query_id, revision, entity_id, rank): new, up, down or same against the entity's last rank."""
    from pyspark.sql import Window

    before = F.lag("rank").over(Window.partitionBy("query_id", "entity_id").orderBy("revision"))
    rows = answers.withColumn("before", before)
    change = F.when(F.col("before").isNull(), "new").when(F.col("rank") < F.col("before"), "up").when(F.col("rank") > F.col("before"), "down").otherwise("same")
    return rows.select("query_id", "revision", "entity_id", "rank", "before", change.alias("change"))
