"""The synthetic dataset from first table to answers, and the commands."""

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kinscope.__main__ import main
from kinscope.operators import benchmark, case_study, clustering, pairs, service, vectors, weighting
from kinscope.plans.build import Workspace, build_dataset, build_engine, ensure_built, load, load_cached, read_manifest, read_provenance, trust, write_manifest, write_provenance, write_regime
from kinscope.sources import mock
from kinscope.sources.tables import MissingArtefact


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    w = Workspace(spark, str(tmp_path_factory.mktemp("work")))
    with pytest.raises(MissingArtefact):
        build_engine(w)
    rows = mock.entities(spark)
    build_dataset(w, rows, mock.edges(rows), mock.catalogue(spark))
    assert ensure_built(w) and not ensure_built(w)
    return w


def test_synthetic_dataset(spark):
    rows = mock.entities(spark)
    truth = mock.ground_truth(rows).collect()
    assert len(truth) == 15 and min(r["features"] for r in truth) >= 10
    assert sorted(spark.createDataFrame(truth).groupBy("family").count().toPandas()["count"]) == [3] * 5
    assert rows.collect() == mock.entities(spark).collect() and rows.collect() != mock.entities(spark, 1).collect()
    s = weighting.coverage_summary(weighting.feature_frequency(mock.edges(rows), mock.catalogue(spark))).first()
    assert s["singleton_share"] > 0 and s["commodity_share"] > 0


def rand(a, b):
    pairs_ = list(combinations(a, 2))
    same = lambda g: [g[x] == g[y] for x, y in pairs_]
    x, y = same(a), same(b)
    n, both, sx, sy = len(pairs_), sum(p and q for p, q in zip(x, y)), sum(x), sum(y)
    expected = sx * sy / n
    return (both - expected) / ((sx + sy) / 2 - expected)


def test_clusters_find_the_families(spark, space):
    truth = {r["entity_id"]: r["family"] for r in mock.ground_truth(mock.entities(spark)).collect()}
    got = {r["entity_id"]: r["cluster_id"] for r in space.read("clusters").collect()}
    assert set(got) == set(truth) and rand(truth, got) >= 0.9


def test_map_follows_distance(space):
    place = {r["entity_id"]: (r["x"], r["y"]) for r in space.read("layout").collect()}
    assert all(abs(v) <= 1 for p in place.values() for v in p)
    score = {(r["left_id"], r["right_id"]): r["score"] for r in space.read("pairs").collect()}
    a, b = zip(*[(math.dist(place[i], place[j]), 1 - score.get((i, j), 0)) for i, j in combinations(sorted(place), 2)])
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    r = sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
    assert r > 0.6


def test_service_over_a_folder(spark, space):
    station = load(space)
    answer = station.ask(service.parse_features(spark, "T1566,T1078;T1047 T1003 T1560.001 T1567"))
    best = answer["candidates"].where("rank = 1").first()
    family = {r["entity_id"]: r["family"] for r in mock.ground_truth(mock.entities(spark)).collect()}
    assert family[best["entity_id"]] == "espionage"
    assert {r["entity_id"] for r in answer["field"].collect()} >= {best["entity_id"]}
    assert station.overview()["clusters"].count() >= 4


def test_case_study(space):
    tables = case_study.case_study(space.read("space"), space.read("weights"), "mock--silent-heron")
    assert tables["features"].count() >= 10 and tables["contrast_cosine"].where("query_id = 'rare' and rank = 1").first()["is_target"]
    assert "feature_id" in case_study.text_table(tables["features"])
    assert tables["rank_shift"].count() >= 1


def test_rarity_changes_the_ranking(space):
    v = space.read("space")
    cosine = pairs.pair_similarity(v).orderBy(F.desc("score")).limit(15).collect()
    jaccard = pairs.pair_similarity(v, "jaccard").orderBy(F.desc("score")).limit(15).collect()
    assert [r[:2] for r in cosine] != [r[:2] for r in jaccard]
    assert vectors.entity_totals(v).count() == 15 and clustering.cluster_profile(space.read("clusters"), space.read("edges")).count() > 0


def test_commands(spark, tmp_path, capsys):
    folder = str(tmp_path / "w")
    assert main(["--folder", folder, "mock"]) == 0
    assert main(["--folder", folder, "build", "--skip-clusters"]) == 0
    assert main(["--folder", folder, "query", "T1566, T1078, T1047"]) == 0
    assert main(["--folder", folder, "search", "phish"]) == 0
    said = capsys.readouterr().out
    assert "Nearest" in said and "T1566" in said


def test_reports_manifest_and_provenance(spark, space, tmp_path):
    import json

    available, tables = trust(space, "B")
    assert not available and all(t.count() == 0 for t in tables.values())
    report, test = benchmark.run_regime(space.read("edges"), "B", repeats=1)
    write_regime(space, report, test, "B")
    available, tables = trust(space, "B")
    assert available and tables["summary"].count() == 3 and "notes" not in tables["summary"].columns and tables["significance"].count() == 1
    assert tables["by_size"].count() >= 1 and tables["calibration"].count() >= 1
    assert read_manifest(space) == {}
    write_manifest(space, "synthetic", seed="1")
    assert read_manifest(space)["rows"]["entities"] == 15 and read_manifest(space)["seed"] == "1"
    path = str(tmp_path / "bundle.json")
    with open(path, "w") as f:
        json.dump({"type": "bundle", "id": "b", "objects": [{"type": "x-mitre-collection", "id": "c", "x_mitre_version": "9.1"}]}, f)
    assert read_provenance(spark, path) == {}
    write_provenance(spark, path, "https://example.org/b.json", etag="e")
    got = read_provenance(spark, path)
    assert (got["version"], got["etag"], got["last_modified"]) == ("9.1", "e", None) and len(got["sha256"]) == 64 and got["size_bytes"] > 10


def test_exports(spark, space):
    import json

    station = load_cached(space)
    answer = station.ask(["T1566", "T1078", "T1047", "T1003", "T9999"])
    layer = json.loads(service.navigator_layer(answer, station.weights, version="19.2"))
    assert layer["versions"]["attack"] == "19" and layer["metadata"][1]["value"] in ("high", "medium", "low")
    assert {t["techniqueID"] for t in layer["techniques"]} == {"T1566", "T1078", "T1047", "T1003"} and all(t["color"].startswith("#") for t in layer["techniques"])
    assert "Decided by" in service.markdown(answer)
    listed = space.read("features").select(F.col("feature_id").alias("technique_id"), F.explode("categories").alias("category"))
    rows = station.categories(listed.unionByName(listed.limit(1).withColumn("category", F.lit("my-own")))).collect()
    assert rows[0]["title"] == "Reconnaissance" and rows[-1]["title"] == "My Own" and "Command and Control" in {r["title"] for r in rows}
