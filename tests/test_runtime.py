"""Current rows, written tables and the work folder."""

import datetime as dt
import time

import pytest

from kinscope import runtime


def test_current_rows(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [("a", "old", t(1)), ("a", "new", t(3)), ("a", "new", t(3)), ("b", None, t(2)), ("b", "older", t(1)), ("c", "only", None), (None, "x", t(1))]
    df = spark.createDataFrame(rows, "k string, v string, at timestamp")
    assert {r["k"]: r["v"] for r in runtime.current_rows(df, "k", "at", "v").collect()} == {"a": "new", "b": None, "c": "only"}
    assert runtime.current_rows(df.limit(0), "k", "at", "v").count() == 0


def test_materialised_tables_cut_lineage(spark):
    df = runtime.materialise(spark.range(10).withColumnRenamed("id", "n"), "ten")
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().toString()
    assert all(runtime.work_folder(spark) in f for f in df.inputFiles())


def test_lean_tables_leave_no_shuffle_files(spark):
    java = spark._jvm.scala.jdk.javaapi.CollectionConverters
    files = lambda: {f.getPath() for f in java.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, setting = files(), spark.conf.get(runtime.FREED, None)
    df = runtime.materialise(spark.range(1000).groupBy("id").count(), "counts", lean=True)
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and df.count() == 1000 and spark.conf.get(runtime.FREED, None) == setting


def test_work_folder_is_shared_or_local(spark):
    assert runtime.work_folder(spark)


def test_spread_keeps_the_number_of_tasks(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert runtime.spread(spark.range(100), "id").rdd.getNumPartitions() == n


def test_full_matrix_is_bounded(spark):
    from kinscope.operators import pairs

    ids = spark.createDataFrame([(str(i), 1) for i in range(5)], "entity_id string, features int")
    none = spark.createDataFrame([], "left_id string, right_id string, score double, shared bigint")
    assert pairs.dense(none, ids).count() == 25
    with pytest.raises(ValueError, match="full matrix"):
        pairs.dense(none, ids, limit=4)


def test_tables_that_nothing_reads_any_more_are_deleted(spark):
    from pathlib import Path

    df, kept = runtime.materialise(spark.range(3), "three"), runtime.materialise(spark.range(4), "four")
    runtime.let_go(df)
    here = lambda x: Path(x._written_at.removeprefix("file:")).exists()
    assert not here(df) and here(kept) and kept.count() == 4
