"""Hand-computed numbers and invariants of weights, vectors, scores and confidence."""

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kinscope.config import Config
from kinscope.operators import clustering, confidence, metrics, pairs, sampling, scoring, service, vectors, weighting

EDGES = "entity_id string, feature_id string"
WEIGHTS = "feature_id string, feature_name string, entity_count bigint, entity_ratio double, weight double, rarity double"


def weights(spark, **w):
    return spark.createDataFrame([(f, f, 1, 0.1, float(x), float(x)) for f, x in w.items()], WEIGHTS)


def one(df):
    return df.first().asDict()


def test_rarer_features_weigh_more(spark):
    edges = spark.createDataFrame([(f"e{i}", f) for f, n in (("T1", 10), ("T2", 50)) for i in range(n)] + [(f"e{i}", "T0") for i in range(100)], EDGES)
    w = {r["feature_id"]: r for r in weighting.feature_weights(edges).collect()}
    assert w["T1"]["weight"] == pytest.approx(math.log(101 / 11) + 1)
    assert w["T1"]["weight"] > w["T2"]["weight"] > w["T0"]["weight"] >= 1
    plain = {r["feature_id"]: r["weight"] for r in weighting.feature_weights(edges, "plain_idf").collect()}
    assert plain["T0"] == 0
    assert {r["weight"] for r in weighting.feature_weights(edges, "binary").collect()} == {1.0}
    with pytest.raises(ValueError):
        weighting.feature_weights(edges, "other")


def test_no_edges_no_rows(spark):
    none = spark.createDataFrame([], EDGES)
    assert weighting.feature_weights(none).count() == 0
    assert one(weighting.coverage_summary(weighting.feature_frequency(none))) == {"features": 0, "singleton_share": 0.0, "commodity_share": 0.0}


def test_universal_feature_of_plain_idf_is_absent(spark):
    edges = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y")], EDGES)
    space = vectors.vector_space(edges, weighting.feature_weights(edges, "plain_idf"))
    assert [(r["entity_id"], r["feature_id"]) for r in space.collect()] == [("a", "y")]


def test_feature_without_weight_is_an_error(spark):
    edges = spark.createDataFrame([("a", "x")], EDGES)
    with pytest.raises(Exception, match="without a weight"):
        vectors.vector_space(edges, weights(spark, y=1)).collect()


def test_vectors_have_length_one(spark):
    edges = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("a", "x")], EDGES)
    space = vectors.vector_space(edges, weights(spark, x=3, y=4))
    lengths = {r["entity_id"]: r["n"] for r in space.groupBy("entity_id").agg(F.sum(F.col("u") * F.col("u")).alias("n")).collect()}
    assert lengths == {"a": pytest.approx(1), "b": pytest.approx(1)}


def test_query_vector_knows_known_and_unknown(spark):
    q = scoring.query_frame(spark, {"q": ["T1", "T99", "T2"]})
    rows = {r["feature_id"]: (r["known"], r["w"]) for r in vectors.query_vectors(q, weights(spark, T1=2, T2=3, T3=4)).collect()}
    assert rows == {"T1": (True, 2.0), "T2": (True, 3.0), "T99": (False, None)}


def test_rarity_of_unknown_counts_as_the_least(spark):
    got = weighting.normalized_rarity(spark.createDataFrame([("q", f) for f in ("T1", "T2", "T99")], "query_id string, feature_id string"), weights(spark, T1=10, T2=2, T3=5), ["query_id"])
    assert got.first()["rarity"] == pytest.approx((10 + 2 + 2) / 3 / 10)


@pytest.mark.parametrize(("top", "second", "want"), [(0.8, 0.76, 1 / 3), (0.8, None, 1.0), (0.0, 0.5, 0.0)])
def test_margin(spark, top, second, want):
    df = spark.createDataFrame([(top, second)], "a double, b double")
    assert df.select(confidence.margin_component(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize(("n", "want"), [(2, 0), (7, 4 / 9), (15, 1)])
def test_sufficiency(spark, n, want):
    assert spark.range(1).select(confidence.sufficiency_component(F.lit(n))).first()[0] == pytest.approx(want)
    assert spark.range(1).select(confidence.sufficiency_component(F.lit(n), 3, 3)).first()[0] == (1.0 if n >= 3 else 0.0)


def world(spark):
    edges = spark.createDataFrame([("G1", "T1"), ("G1", "T2"), ("G2", "T2"), ("G2", "T3")], EDGES)
    w = weights(spark, T1=5, T2=2, T3=4)
    return edges, w, vectors.vector_space(edges, w)


@pytest.mark.parametrize("metric", ["cosine", "jaccard", "weighted_jaccard"])
def test_best_match_first(spark, metric):
    _, w, space = world(spark)
    q = scoring.query_frame(spark, {"q": ["T1", "T2"]})
    config = Config(metric=metric)
    rows = scoring.rank(scoring.score(space, q, w, config), config).orderBy("rank").collect()
    assert (rows[0]["entity_id"], rows[0]["score"], rows[0]["matched"]) == ("G1", 1.0, 2)


def test_unknown_query_gives_a_low_empty_result(spark):
    _, w, space = world(spark)
    q = scoring.query_frame(spark, {"q": ["T99"]})
    assert scoring.score(space, q, w).count() == 0
    row = one(confidence.confidence(scoring.score(space, q, w), space, q, w))
    assert (row["level"], row["score"], row["known"]) == ("low", 0.0, 0)
    flat = service.result_rows(space, q, w, spark.createDataFrame([], "entity_id string, entity_name string")).collect()
    assert len(flat) == 1 and flat[0]["entity_id"] is None


def test_coverage_correction_multiplies(spark):
    _, w, space = world(spark)
    q = scoring.query_frame(spark, {"q": ["T1", "T2"]})
    on = {r["entity_id"]: r["score"] for r in scoring.score(space, q, w).collect()}
    off = {r["entity_id"]: r["score"] for r in scoring.score(space, q, w, Config(coverage_correction=False)).collect()}
    assert on["G2"] == pytest.approx(off["G2"] * 0.5, abs=1e-6)


def test_confidence_does_not_depend_on_top_k(spark):
    _, w, space = world(spark)
    q = scoring.query_frame(spark, {"q": ["T1", "T2"]})
    s = scoring.score(space, q, w)
    assert one(confidence.confidence(s, space, q, w, Config(top_k=1))) == one(confidence.confidence(s, space, q, w))


def test_evidence_adds_up_to_the_cosine(spark):
    _, w, space = world(spark)
    q = scoring.query_frame(spark, {"q": ["T1", "T2"]})
    ranked = scoring.rank(scoring.score(space, q, w))
    rows = scoring.evidence(ranked, space, q, w).where("entity_id = 'G1'").orderBy("place").collect()
    assert [r["feature_id"] for r in rows] == ["T1", "T2"]
    assert [r["share"] for r in rows] == [pytest.approx(25 / 29, abs=1e-6), pytest.approx(4 / 29, abs=1e-6)]


def test_reasons_name_weak_parts_worst_first(spark):
    rows = spark.createDataFrame([("q", 0.9, 0.2, 0.0)], "query_id string, rarity double, margin double, sufficiency double")
    got = confidence.reasons(rows).first()["reasons"]
    assert len(got) == 2 and "few known" in got[0] and "close behind" in got[1]


def test_pairs_are_symmetric_and_zero_pairs_come_with_dense(spark):
    edges = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], EDGES)
    space = vectors.vector_space(edges, weights(spark, x=1, y=1))
    got = pairs.pair_similarity(space)
    assert [tuple(r)[:3] for r in got.collect()] == [("a", "c", 1.0)]
    full = {(r[0], r[1]): r[2] for r in pairs.dense(got, vectors.entity_totals(space)).collect()}
    assert len(full) == 9 and full["a", "a"] == 1 and full["a", "b"] == 0 and full["c", "a"] == 1
    frame = pairs.matrix_frame(pairs.dense(got, vectors.entity_totals(space)), ["a", "b", "c"])
    assert frame.columns == ["left_id", "a", "b", "c"]
    stats = one(pairs.similarity_stats(got, edges))
    assert stats["pairs"] == 3 and stats["max"] == 1.0 and stats["median"] == 0.0 and stats["mean"] == pytest.approx(1 / 3, abs=1e-6) and stats["p90"] == pytest.approx(0.8)


def test_cluster_lift(spark):
    edges = spark.createDataFrame([("A1", "T1"), ("A1", "T2"), ("A2", "T1"), ("A2", "T2"), ("B1", "T1"), ("B1", "T3"), ("B2", "T1"), ("B2", "T3"), ("N1", "T4")], EDGES)
    own = spark.createDataFrame([("A1", 0), ("A2", 0), ("B1", 1), ("B2", 1), ("N1", -1)], "entity_id string, cluster_id int")
    rows = {(r["cluster_id"], r["feature_id"]): r["lift"] for r in clustering.cluster_profile(own, edges).collect()}
    assert rows[0, "T2"] == pytest.approx(1 / (2 / 5)) and rows[0, "T1"] == pytest.approx(1 / (4 / 5))
    assert not any(f == "T4" for _, f in rows)
    assert clustering.cluster_profile(own, edges, top_n=1).count() == 2
    names = spark.createDataFrame([("T2", "two")], "feature_id string, feature_name string")
    labels = {r["cluster_id"]: r["label"] for r in clustering.cluster_labels(clustering.cluster_profile(own, edges), names).collect()}
    assert labels == {0: "two · T1", 1: "T3 · T1"}


def test_clusters_and_map(spark):
    rows = [(f"{g}{i}", f"{g}{k}") for g in "ab" for i in range(4) for k in range(6) if (i + k) % 5] + [("z", "zz")]
    edges = spark.createDataFrame(rows, EDGES)
    space = vectors.vector_space(edges, weighting.feature_weights(edges))
    sim = pairs.pair_similarity(space)
    got = {r["entity_id"]: r["cluster_id"] for r in clustering.clusters(sim, edges).collect()}
    assert {got[f"a{i}"] for i in range(4)} == {0} and {got[f"b{i}"] for i in range(4)} == {1} and got["z"] == -1
    fixed = {r["cluster_id"] for r in clustering.clusters(sim, edges, n_clusters=2).collect()}
    assert 0 in fixed
    place = {r["entity_id"]: (r["x"], r["y"]) for r in clustering.layout(sim, edges).collect()}
    assert max(abs(v) for p in place.values() for v in p) == pytest.approx(1)
    assert clustering.layout(sim, edges).collect() == clustering.layout(sim, edges).collect()
    apart = lambda p, q: math.dist(place[p], place[q])
    assert apart("a0", "a1") < apart("a0", "b0")
    with pytest.raises(ValueError):
        clustering.clusters(sim, edges, limit=3)


def test_clusters_of_a_hundred_thousand_entities(spark):
    """Groups of ten, alike among themselves; a link to the next group is too weak for the average, not for the nearest."""
    n = 100_000
    inside = spark.range(n).select((F.col("id") - F.col("id") % 10).alias("g"), "id").select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"), "g").select("id", (F.col("g") + F.col("k")).alias("other")).where("id < other")
    name = lambda c: F.format_string("e%06d", F.col(c))
    sim = inside.select(name("id").alias("left_id"), name("other").alias("right_id"), F.lit(0.8).alias("score"))
    bridges = spark.range(n).where("id % 1000 = 9").select(name("id").alias("left_id"), F.format_string("e%06d", F.col("id") + 1).alias("right_id"), F.lit(0.9).alias("score"))
    ids = spark.range(n + 5).select(name("id").alias("entity_id"))
    got = clustering.clusters(sim.unionByName(bridges), ids)
    sizes = got.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("low")).where("cluster_id >= 0")
    assert got.count() == n + 5 and got.where("cluster_id = -1").count() == 5
    # The two ends of a bridge join first; they stay together, and each group's other nine as well.
    assert sizes.count() == n // 10 and sizes.where("low <> format_string('e%06d', cluster_id * 10)").where("n not in (8, 9, 10, 11, 2)").count() == 0
    single = clustering.clusters(sim.unionByName(bridges), ids, replace(Config(), linkage="single"))
    assert single.where("cluster_id >= 0").select("cluster_id").distinct().count() == n // 10 - n // 1000
    places = clustering.layout(sim.unionByName(bridges), ids, limit=200)
    assert places.count() == n + 5 and places.where("x is null or abs(x) > 1 or abs(y) > 1").count() == 0


def test_entities_beyond_the_landmarks_are_placed_by_their_distances(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    at = rng.uniform(-0.35, 0.35, (160, 2))
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    rows = [(f"e{i:03}", f"e{j:03}", float(1 - d[i, j])) for i in range(160) for j in range(i + 1, 160)]
    sim = spark.createDataFrame(rows, "left_id string, right_id string, score double")
    ids = spark.createDataFrame([(f"e{i:03}",) for i in range(160)], "entity_id string")
    got = {r["entity_id"]: (r["x"], r["y"]) for r in clustering.layout(sim, ids, limit=40).collect()}
    p = np.array([got[f"e{i:03}"] for i in range(160)])
    away = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    up = np.triu_indices(160, 1)
    assert np.corrcoef(d[up], away[up])[0, 1] > 0.999


def _made_space(spark):
    """Sixty entities of three kinds, some equal, one alone."""
    import random

    rng = random.Random(5)
    own = {f"e{i:02d}": rng.sample(range(20 * (i % 3), 20 * (i % 3) + 26), 9) for i in range(60)}
    own["e61"] = own["e62"] = own["e03"]
    edges = spark.createDataFrame([(e, f"f{k}") for e, ks in own.items() for k in ks] + [("z", "zz")], EDGES)
    return edges, vectors.vector_space(edges, weighting.feature_weights(edges)).cache()


def test_clusters_of_a_space_equal_those_of_all_pairs(spark):
    edges, space = _made_space(spark)
    sim = pairs.pair_similarity(space).cache()
    config = replace(Config(), distance_threshold=0.6, min_cluster=2)
    want = sorted(map(tuple, clustering.clusters(sim, edges, config).collect()))
    assert len({c for _, c in want}) > 3
    # In one task, and in a distributed round or two before it.
    for groups in (100, 40):
        assert sorted(map(tuple, clustering.clusters_in(space, edges, config, task_groups=groups).collect())) == want


def test_clusters_of_a_space_have_no_limit(spark, monkeypatch):
    monkeypatch.setattr(clustering, "MATRIX_LIMIT", 3)
    edges = spark.range(2_000).select(F.format_string("e%04d", "id").alias("entity_id"), F.explode(F.array(F.lit("all"), F.concat(F.lit("k"), F.col("id") % 4), F.concat(F.lit("m"), F.col("id") % 500))).alias("feature_id"))
    space = vectors.vector_space(edges, weighting.feature_weights(edges))
    got = clustering.clusters_in(space, edges, replace(Config(), distance_threshold=0.999), task_groups=400)
    assert got.count() == 2_000 and got.select("cluster_id").distinct().count() == 1


def test_map_of_a_space_equals_that_of_all_pairs(spark):
    edges, space = _made_space(spark)
    sim = pairs.pair_similarity(space).cache()
    for limit in (100, 25):
        want = {r["entity_id"]: (r["x"], r["y"]) for r in clustering.layout(sim, edges, limit=limit).collect()}
        got = {r["entity_id"]: (r["x"], r["y"]) for r in clustering.layout_in(space, edges, limit=limit).collect()}
        assert got.keys() == want.keys() and all(math.dist(got[e], want[e]) < 1e-3 for e in want)


def test_places_of_many_landmarks_start_from_the_same_eigenvectors(monkeypatch):
    import numpy as np

    at = np.random.default_rng(1).normal(size=(120, 3)) * [3, 2, 0.5]
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    want = clustering.positions(d)
    monkeypatch.setattr(clustering, "EIGEN_ALL", 10)
    assert np.abs(clustering.positions(d) - want).max() < 1e-4


def test_the_map_brings_no_pairs_to_the_driver(spark, monkeypatch):
    edges, space = _made_space(spark)
    collected = []
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    kept = Classic.toPandas
    monkeypatch.setattr(Classic, "toPandas", lambda self: collected.append(self.columns) or kept(self))
    clustering.layout(pairs.pair_similarity(space), edges, limit=25).collect()
    clustering.layout_in(space, edges, limit=25).collect()
    assert collected and not any({"left_id", "i"} & set(c) for c in collected)


def test_metrics(spark):
    t = spark.createDataFrame([("a", r, 3, n, "high") for r, n in ((1, 7), (3, 15), (5, 60), (-1, 60))], "entity_id string, rank int, sample_size int, feature_count int, level string")
    rows = {(r["dimension"], r["value"]): r for r in metrics.report(t).collect()}
    whole = rows["all", "all"]
    assert (whole["top1"], whole["top3"], whole["top5"], whole["misses"]) == (0.25, 0.5, 0.75, 1)
    assert whole["mean_rank"] == 3 and whole["mrr"] == pytest.approx((1 + 1 / 3 + 1 / 5) / 4, abs=1e-6)
    assert {v for d, v in rows if d == "bucket"} == {"05-10", "11-20", "51+"}
    empty = metrics.report(t.limit(0)).where("dimension = 'all'").collect()
    assert not empty or empty[0]["top1"] == 0


def test_paired_test_matches_the_formula(spark):
    a = spark.createDataFrame([(f"e{i}", 1 if i < 15 else -1) for i in range(20)], "entity_id string, rank int")
    b = spark.createDataFrame([(f"e{i}", 1 if i < 3 or i > 17 else -1) for i in range(20)], "entity_id string, rank int")
    row = one(metrics.paired_test(a, b))
    assert (row["better"], row["worse"], row["tied"]) == (12, 2, 6)
    n, w = 14, 7.5 * 12
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (14**3 - 14) / 48)
    assert row["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert math.isnan(one(metrics.paired_test(a, a))["p"])


def test_plans_skip_and_never_pad(spark):
    rows = [("big", f"T{i:02}") for i in range(20)] + [("mid", f"T{i:02}") for i in range(8)] + [("small", f"T{i:02}") for i in range(5)]
    edges = spark.createDataFrame(rows, EDGES)
    hashed = sampling.hashed_plan(edges, repeats=3, noise_ratio=0.5)
    rows, own = hashed.collect(), {(r[0], r[1]) for r in edges.collect()}
    for r in rows:
        assert ((r["entity_id"], r["feature_id"]) in own) != r["is_noise"]
    size = {(r["trial_id"], r["is_noise"]): r["count"] for r in hashed.groupBy("trial_id", "is_noise").count().collect()}
    # Big lacks nothing, so no noise is there to draw; mid draws 4 and wants 2.
    assert size == {(f"big/{i}", False): 10 for i in range(3)} | {(f"mid/{i}", False): 4 for i in range(3)} | {(f"mid/{i}", True): 2 for i in range(3)}
    assert [r["entity_id"] for r in sampling.skipped(edges).collect()] == ["small"]
    assert {r["sample_size"]: r["trials"] for r in sampling.plan_summary(sampling.fixed_plan(edges, sizes=(3, 8), trials=1)).collect()} == {3: 3, 8: 2}


def test_noise_follows_prevalence(spark, monkeypatch):
    edges = spark.createDataFrame([(f"e{i}", "T9001") for i in range(100)] + [("e0", "T9002"), ("me", "T9003")], EDGES)
    trials = spark.createDataFrame([(f"t{i}", "me", 1) for i in range(200)], "trial_id string, entity_id string, want int")
    drawn = [r["feature_id"] for r in sampling.sample_noise(edges, trials).collect()]
    assert len(drawn) == 200 and set(drawn) <= {"T9001", "T9002"} and drawn.count("T9001") > 150
    # The pool ends; rounds go on until it does, and a pool that draws hardly reach is sorted.
    most = spark.createDataFrame([("a", "e5", 5), ("b", "e0", 5), ("c", "me", 5)], "trial_id string, entity_id string, want int")
    want = {("a", "T9002"), ("a", "T9003"), ("b", "T9003"), ("c", "T9001"), ("c", "T9002")}
    assert {(r["trial_id"], r["feature_id"]) for r in sampling.sample_noise(edges, most).collect()} == want
    monkeypatch.setattr(sampling, "FIRST_DRAWS", 1)
    monkeypatch.setattr(sampling, "MOST_DRAWS", 3)
    assert {(r["trial_id"], r["feature_id"]) for r in sampling.sample_noise(edges, most).collect()} == want
    assert sampling.sample_noise(spark.createDataFrame([], EDGES), most).count() == 0


def test_config_is_checked():
    for bad in ({"scheme": "x"}, {"metric": "x"}, {"top_k": 0}, {"linkage": "ward"}, {"component_weights": {"rarity": 1.0}}):
        with pytest.raises(ValueError):
            replace(Config(), **bad).validate()


def test_service(spark):
    edges, w, space = world(spark)
    sim = pairs.pair_similarity(space)
    own = spark.createDataFrame([("G1", 0), ("G2", 0)], "entity_id string, cluster_id int")
    names = spark.createDataFrame([("G1", "one")], "entity_id string, entity_name string")
    station = service.Station(edges, w, space, names, sim, own)
    result = station.ask(["T1", "T2", "T99"])
    assert [r["entity_name"] for r in result["candidates"].orderBy("rank").collect()] == ["one", "G2"]
    assert "Unknown" in service.markdown(result) and "one (G1)" in service.markdown(result)
    assert '"techniqueID": "T1"' in service.navigator_layer(result, w)
    assert result["probe"].count() == 1
    assert station.dossier("g1")["summary"].first()["features"] == 2
    assert [r["entity_id"] for r in station.dossier("G1")["mates"].collect()] == ["G2"]
    assert station.compare("G1", "G2")["summary"].first()["shared"] == 1
    assert [r["feature_id"] for r in station.noise(["T1", "T2"], 0.5).collect()] == ["T3"]
    assert station.blind_case(fraction=1.0, least=1)[0] in {"G1", "G2"}
    assert station.overview()["clusters"].first()["size"] == 2
    with pytest.raises(service.NotFound):
        station.dossier("nobody")
    for bad in (dict(features=["x"] * 401), dict(features=["x" * 41]), dict(features="x" * 16_001), dict(features=[], top_k=51), dict(features=[], ratio=float("nan")), dict(features=[], ratio=0)):
        with pytest.raises(service.BadRequest):
            service.check_request(**bad)
