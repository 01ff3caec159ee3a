import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinscope.config import Config
from kinscope.operators import blocks, pairs, scoring
from kinscope.operators.confidence import confidence
from kinscope.operators.sampling import hashed_plan
from kinscope.operators.vectors import vector_space
from kinscope.operators.weighting import feature_weights
from kinscope.plans.registry import QUERIES


@pytest.fixture(scope="module")
def made(spark):
    """Sixty entities of uneven size, among them equal ones, and their vectors as Python dicts."""
    rng = random.Random(3)
    own = {f"é{i:02d}" if i % 7 == 0 else f"e{i:02d}": rng.sample(range(40), rng.randint(1, 20)) for i in range(58)}
    own["z1"] = own["z2"] = [1, 2, 3]
    edges = spark.createDataFrame([(e, f"f{x}") for e, xs in own.items() for x in xs], "entity_id string, feature_id string")
    weights = feature_weights(edges).cache()
    space = vector_space(edges, weights).cache()
    vectors = {}
    for r in space.collect():
        vectors.setdefault(r["entity_id"], {})[r["feature_id"]] = (r["w"], r["u"])
    return weights, space, vectors


@pytest.fixture
def small(monkeypatch):
    """Several blocks, few dense features, few products at once."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 17)
    monkeypatch.setattr(blocks, "DENSE", 5)
    monkeypatch.setattr(blocks, "HELD", 64)


def _value(metric, a, b):
    both = a.keys() & b.keys()
    if metric == "cosine":
        return sum(a[f][1] * b[f][1] for f in both)
    if metric == "jaccard":
        return len(both) / len(a.keys() | b.keys())
    shared = sum(a[f][0] for f in both)
    return shared / (sum(w for w, _ in a.values()) + sum(w for w, _ in b.values()) - shared)


@pytest.mark.parametrize("metric", ["cosine", "jaccard", "weighted_jaccard"])
def test_pairs_of_blocks_equal_brute_force(made, small, metric):
    _, space, v = made
    got = {(r["left_id"], r["right_id"]): (r["score"], r["shared"]) for r in pairs.pair_similarity(space, metric).collect()}
    want = {(a, b): (_value(metric, v[a], v[b]), len(v[a].keys() & v[b].keys())) for a, b in itertools.combinations(sorted(v), 2) if v[a].keys() & v[b].keys()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-6 and got[k][1] == want[k][1] for k in want)
    counts = {r["score"]: r["times"] for r in pairs.score_counts(space, metric).collect()}
    assert counts == {s: sum(x == s for x, _ in got.values()) for s in {x for x, _ in got.values()}}
    key = ["entity_id", "rank", "neighbour_id", "score", "shared"]
    listed = lambda df: sorted(tuple(r) for r in df.select(*key).collect())
    assert listed(pairs.nearest_in(space, metric)) == listed(pairs.nearest(pairs.pair_similarity(space, metric)))


@pytest.mark.parametrize("metric", ["cosine", "jaccard", "weighted_jaccard"])
@pytest.mark.parametrize("corrected", [True, False])
def test_leaders_of_blocks_equal_those_of_all_scores(made, small, metric, corrected):
    weights, space, v = made
    config = Config(metric=metric, coverage_correction=corrected)
    asked = space.where(F.col("entity_id").isin("e01", "é07", "z1")).select(F.col("entity_id").alias("query_id"), "feature_id")
    scores = scoring.score(space, asked, weights, config)
    got = {(r["query_id"], r["entity_id"]): r["score"] for r in scores.collect()}
    for q, e in itertools.product(("e01", "é07", "z1"), v):
        both = v[q].keys() & v[e].keys()
        assert ((q, e) in got) == bool(both)
        if both:
            assert abs(got[q, e] - min(1, _value(metric, v[q], v[e])) * (len(both) / len(v[q]) if corrected else 1)) < 1e-6
    listed = lambda df: sorted(map(tuple, df.collect()))
    assert listed(scoring.leading(space, asked, weights, config)) == listed(scoring.leaders(scores, 10))


def test_pairs_and_scores_are_not_shuffled(made):
    weights, space, _ = made
    asked = space.select(F.col("entity_id").alias("query_id"), "feature_id")
    for df in (pairs.pair_similarity(space), pairs.pair_similarity(space, "jaccard"), scoring.score(space, asked, weights), scoring.score(space, asked, weights, Config(metric="weighted_jaccard"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # The pairs come out of the last step: nothing joins or aggregates them.
        assert plan.lstrip().startswith("MapInArrow") and "Join" not in plan and "Aggregate" not in plan


def test_pairs_of_a_feature_of_all_are_whole(spark):
    """Each vector is sent once for each block of the other side."""
    edges = spark.range(3000).select(F.col("id").cast("string").alias("entity_id"), F.lit("f").alias("feature_id"))
    space = vector_space(edges, feature_weights(edges))
    assert pairs.pair_similarity(space).count() == 3000 * 2999 // 2


def _repeated(spark):
    """Each of ninety vectors under forty ids."""
    rng = random.Random(7)
    own = [rng.sample(range(40), rng.randint(2, 9)) for _ in range(90)]
    edges = spark.createDataFrame([(f"e{k:02d}-{i:02d}", f"f{x}") for i, xs in enumerate(own) for k in range(40) for x in xs], "entity_id string, feature_id string")
    weights = feature_weights(edges).cache()
    return vector_space(edges, weights).cache(), weights


def test_equal_vectors_are_multiplied_once(spark, monkeypatch):
    space, weights = _repeated(spark)
    asked = space.where("entity_id like 'e00-0%' or entity_id like 'e17-1%'").select(F.col("entity_id").alias("query_id"), "feature_id")
    one = blocks.packed(space.select(F.col("entity_id").alias("id"), "feature_id", "w", "u"), None, F.col("u"))[0]
    assert blocks.classes(one).count() <= 90
    monkeypatch.setattr(blocks, "CLASS_IDS", 7)
    got = blocks.classes(one).collect()
    assert sorted(e for r in got for e in r["members"]) == sorted(r[0] for r in space.select("entity_id").distinct().collect())
    scores = scoring.score(space, asked, weights)
    shared = asked.join(space, "feature_id").groupBy("query_id", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    key = lambda df, c: {(r["query_id"], r["entity_id"]): r[c] for r in df.collect()}
    assert key(scores, "matched") == key(shared, "n") and scores.count() == shared.count()
    listed = lambda df: sorted(map(tuple, df.collect()))
    assert listed(scoring.leading(space, asked, weights)) == listed(scoring.leaders(scores, 10))


def _left_over(run):
    """Names of the tables that a query has written and not let go, and its result."""
    from kinscope import runtime

    before = list(runtime._written)
    out = run()
    return sorted(path.rsplit("/", 1)[1].rsplit("-", 1)[0] for own in runtime._written if own not in before for path in own[1:]), out


@pytest.mark.parametrize("name", ["scores_cosine", "pairs_weighted_jaccard"])
def test_tables_no_longer_read_are_gone_before_the_products(spark, folder, name):
    left, out = _left_over(lambda: QUERIES[name](spark, folder))
    assert not {"edges", "weights", "space", "queries", "codes"} & set(left)
    assert out.count() > 0


def test_different_vectors_are_not_shuffled_into_classes(spark, made):
    weights, space, v = made
    asked = space.select(F.col("entity_id").alias("query_id"), "feature_id")
    left, scores = _left_over(lambda: scoring.score(space, asked, weights))
    assert "classes" not in left and {r["entity_id"] for r in scores.where("query_id = 'e01'").collect()} == {e for e in v if v[e].keys() & v["e01"].keys()}
    equal, weights = _repeated(spark)
    assert "classes" in _left_over(lambda: scoring.score(equal, equal.where("entity_id = 'e00-01'").select(F.col("entity_id").alias("query_id"), "feature_id"), weights))[0]


def test_large_vectors_are_not_repeated_for_more_tasks(spark, monkeypatch):
    edges = spark.range(3000).select(F.col("id").cast("string").alias("entity_id"), F.explode(F.array(F.lit("f"), F.lit("g"))).alias("feature_id"))
    space = vector_space(edges, feature_weights(edges)).cache()
    assert pairs.pair_similarity(space).rdd.getNumPartitions() == 6
    monkeypatch.setattr(blocks, "REPEATED", 1_500)
    few = pairs.pair_similarity(space)
    assert few.rdd.getNumPartitions() == 1 and few.count() == 3000 * 2999 // 2


def _shuffled(spark, run):
    """Bytes of the shuffle files that a run leaves, and its result."""
    files = lambda: {f.getPath(): f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().endswith(".data")}
    before = files()
    out = run()
    return sum(n for path, n in files().items() if path not in before), out


@pytest.fixture(scope="module")
def drawn(spark):
    """Two thousand entities of sixty features each or nearly so, out of five hundred."""
    rows = spark.range(120_000).select((F.col("id") % 2_000).cast("string").alias("entity_id"), F.concat(F.lit("f"), F.pmod(F.xxhash64("id"), F.lit(500)).cast("string")).alias("feature_id")).distinct().cache()
    return vector_space(rows, feature_weights(rows)).cache()


def _sent_small(spark, space, metric, monkeypatch):
    """An only side is sent once for each of four blocks: in less than 120 bytes a vector of some 56 features."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 500)
    got = pairs.pair_similarity(space, metric)
    assert got.rdd.getNumPartitions() == 10
    moved, rows = _shuffled(spark, lambda: got.agg(F.count("shared"), F.sum("shared")).first())
    shared = space.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    assert rows[1] == shared and 0 < moved < 120 * 4 * 2_000


def test_pairs_weighted_jaccard_shuffle_little(spark, drawn, monkeypatch):
    _sent_small(spark, drawn, "weighted_jaccard", monkeypatch)


def test_distances_shuffle_little(spark, drawn, monkeypatch):
    _sent_small(spark, drawn, "cosine", monkeypatch)


def test_bundles_keep_vectors_whole(spark):
    """Gaps of any size, values that differ between vectors, more bundles than one, and a vector without entries."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(11)
    for top, own in ((90, False), (60_000, False), (2_000_000_000, False), (300, True)):
        codes = [sorted(rng.sample(range(top), k)) for k in (5, 0, 40, 1)]
        values = [[rng.random() if own else float(c % 7) for c in x] for x in codes]
        t = pa.table({"block": pa.array([1, 0, 1, 1], pa.int32()), "id": ["b", "é", "a", "c"], "n": [7, 8, 9, 10], "t": [0.5, 1.5, 2.5, 3.5], "code": pa.array(codes, pa.list_(pa.int32())), "value": pa.array(values, pa.list_(pa.float64())), "over": [1.0, 2.0, 4.0, 3.0]})
        batches = t.to_batches(max_chunksize=3)
        bundles = [x for b in (batches[:1], batches[1:]) for r in blocks._bundles(iter(b)) for x in r.to_pylist() if x["block"] == 1]
        assert len(bundles) == 2
        got = blocks._opened([x["vectors"] for x in bundles])
        assert got.ids.to_pylist() == ["a", "b", "c"] and got.n.tolist() == [9, 7, 10] and got.t.tolist() == [2.5, 0.5, 3.5]
        for place, i in enumerate((2, 0, 3)):
            assert got.code[got.row == place].tolist() == codes[i]
            assert np.array_equal(got.value[got.row == place], np.array(values[i]) / t["over"][i].as_py())


def test_lists_and_confidence_shuffle_no_row_a_feature(made):
    weights, space, v = made
    asked = space.where(F.col("entity_id").isin("e01", "é07")).select(F.col("entity_id").alias("query_id"), "feature_id")
    asked = asked.unionByName(asked).unionByName(asked.select("query_id", F.lit("nobody's").alias("feature_id")))
    best = scoring.leading(space, asked, weights)
    lists = scoring.matched_and_missing(scoring.rank(best), space, asked, weights)
    for r in lists.collect():
        assert r["matched_ids"] == sorted(v[r["query_id"]].keys() & v[r["entity_id"]].keys())
        assert r["missing_ids"] == sorted(v[r["query_id"]].keys() - v[r["entity_id"]].keys())
    for df in (lists, confidence(best, space, asked, weights)):
        joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x and "entity_id" in x]
        assert joins and not any("feature_id" in x for x in joins)


def test_a_space_is_shuffled_once(made, spark):
    edges = spark.createDataFrame([("a", "f"), ("a", "f"), ("a", "g"), ("b", "g")], "entity_id string, feature_id string")
    weights = spark.createDataFrame([("f", 3.0), ("g", 4.0)], "feature_id string, weight double")
    space = vector_space(edges, F.broadcast(weights))
    assert sorted((r["entity_id"], r["feature_id"], r["u"]) for r in space.collect()) == [("a", "f", 0.6), ("a", "g", 0.8), ("b", "g", 1.0)]
    plan = space._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_draws_are_not_shuffled_again(made, spark):
    edges = made[1].select("entity_id", "feature_id")
    plan = hashed_plan(edges)
    rows = plan.collect()
    assert len({(r["trial_id"], r["feature_id"]) for r in rows}) == len(rows)
    assert {r["trial_id"].rsplit("/", 1)[0] for r in rows} == {r["entity_id"] for r in rows}
    assert "hashpartitioning(trial_id" not in plan._jdf.queryExecution().executedPlan().toString()
