from pyspark.sql import functions as F

from kinscope.config import Config
from kinscope.operators import benchmark, service


def test_labels_of_equal_settings_share_one_run(spark, monkeypatch):
    edges = spark.createDataFrame([(f"e{i}", f"f{x}") for i in range(6) for x in range(i, i + 12)], "entity_id string, feature_id string")
    plan = benchmark.hashed_plan(edges)
    whole, ran = benchmark.run_trials, []
    monkeypatch.setattr(benchmark, "run_trials", lambda e, p, c: (ran.append(c), whole(e, p, c))[1])
    rows = benchmark.run_comparisons(edges, plan).collect()
    assert len(ran) == len({str(c) for c in benchmark.comparisons().values()}) == 6
    by = {label: sorted(tuple(r)[:-1] for r in rows if r["label"] == label) for label in benchmark.comparisons()}
    assert all(by.values()) and by["scheme smooth_idf"] == by["min_features 5"] == by["coverage on"]
    own = benchmark.report(whole(edges, plan, Config(scheme="binary"))).collect()
    assert by["scheme binary"] == sorted(tuple(r) for r in own)


def test_clusters_of_the_overview_need_no_pairs(spark):
    edges = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "g")], "entity_id string, feature_id string")
    weights = service.heat(benchmark.feature_weights(edges))
    assigned = edges.select("entity_id", F.lit(0).alias("cluster_id"))

    def never():
        raise AssertionError("pairs were made")

    station = service.Station(edges, weights, benchmark.vector_space(edges, weights), edges.select("entity_id", F.col("entity_id").alias("entity_name")), never, assigned)
    assert [tuple(r) for r in station.groups().collect()] == [(0, 3, "f")]
