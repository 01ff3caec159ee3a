"""Ids, texts, bundles, artefacts and streams on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from kinscope.functions import ids, text
from kinscope.operators import normalize, search
from kinscope.operators.components import components
from kinscope.sources import bundle, tables
from kinscope.streaming.observations import rank_changes, score_cases


def value(spark, c, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(c).first()[0]


@pytest.mark.parametrize(("raw", "want"), [(" t1059.003 ", "T1059"), ("T1", "T1"), ("  ", ""), (None, None)])
def test_roll_up(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "c string").select(ids.roll_up(F.col("c"))).first()[0] == want


def test_id_lists(spark):
    df = spark.createDataFrame([(["t2.1", None, " ", "T1", "T2"],), (None,), ([],)], "c array<string>")
    assert [r[0] for r in df.select(ids.id_list(F.col("c"))).collect()] == [["T1", "T2", "T2"], [], []]
    assert [r[0] for r in df.select(ids.id_set(F.col("c"))).collect()] == [["T1", "T2"], [], []]


def test_codecs(spark):
    df = spark.createDataFrame([("a| b||",), (None,)], "c string")
    assert [r[0] for r in df.select(ids.split_list(F.col("c"))).collect()] == [["a", "b"], []]
    assert value(spark, ids.join_list(F.array(F.lit("a"), F.lit(""), F.lit("b")))) == "a|b"


def test_typed_lists(spark):
    blob = "t1566.001, T1078; T9999\nnot-an-id|t1566"
    assert value(spark, text.typed_ids(F.lit(blob))) == ["T1566", "T1078", "T9999", "NOT-AN-ID"]
    assert value(spark, text.looks_like_list(F.lit(blob))) and not value(spark, text.looks_like_list(F.lit("just words")))
    assert value(spark, ids.parse_ids(F.lit("T2.1 t1,T2"))) == ["T1", "T2"]


def test_slugs_and_keys(spark):
    assert value(spark, text.slug(F.lit("Éclair  Group!"))) == "eclair-group"
    df = spark.createDataFrame([("apt",), ("ab",), ("heron",)], "s string")
    assert [r[0] for r in df.select(text.alias_key(F.col("s"))).collect()] == [None, None, "heron"]
    assert value(spark, text.fold(F.lit("İstanbul IĞDIR Çay"))) == "istanbul igdir cay" == text.fold_text("İstanbul IĞDIR Çay")
    assert value(spark, text.clean_aliases(F.lit("One"), F.array(*[F.lit(x) for x in (" one ", "Two", "TWO", "", "three")]))) == ["Two", "three"]


def test_search(spark):
    f = spark.createDataFrame([("T1566", "Phishing", 0.2), ("T1598", "Phishing for Information", 0.9), ("T1003", "OS Credential Dumping", 0.5)], "feature_id string, feature_name string, heat double")
    find = lambda q: [r["feature_id"] for r in search.search_features(f, q).orderBy("place").collect()]
    assert find("t1566") == ["T1566"] and find("phish") == ["T1598", "T1566"] and find("dump") == ["T1003"] and find("dumping os") == ["T1003"] and find(" ") == []
    e = spark.createDataFrame([("G1", "Silent Heron", ["HERON-07"]), ("G2", "Pale", ["Heron Crew", None])], "entity_id string, entity_name string, aliases array<string>")
    rows = search.search_entities(e, "heron").orderBy("place").collect()
    assert [(r["entity_id"], r["matched_alias"]) for r in rows] == [("G2", "Heron Crew"), ("G1", None)]
    assert search.resolve(e, "g1").first()["entity_id"] == "G1" and search.resolve(e, "x").count() == 0


def reference(source, i):
    return [{"source_name": source, "external_id": i}]


def objects():
    actor = lambda i, a, name, **k: {"type": "intrusion-set", "id": i, "name": name, "external_references": reference("mitre-attack", a), **k}
    tech = lambda i, a, name, sub=False, phase="execution", **k: {"type": "attack-pattern", "id": i, "name": name, "x_mitre_is_subtechnique": sub, "external_references": reference("mitre-attack", a), "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": phase}], **k}
    uses = lambda s, t, **k: {"type": "relationship", "id": f"r{s}{t}", "relationship_type": "uses", "source_ref": s, "target_ref": t, **k}
    return [
        {"type": "x-mitre-collection", "id": "c", "x_mitre_version": "9.9"},
        actor("a1", "G0001", "Alpha", aliases=["Alpha", "Shared Bear"]),
        actor("a2", "G0002", "Beta", aliases=["shared-bear", "Beta Two"]),
        actor("a3", "G0003", "Gamma"),
        actor("a4", "G0004", "Old", revoked=True),
        actor("a5", "G0005", "Older", x_mitre_deprecated=True),
        {"type": "intrusion-set", "id": "a6", "name": "No reference"},
        tech("t1", "T1059", "Interpreter"),
        tech("t2", "T1059.001", "Shell", True, "persistence"),
        tech("t3", "T1059.004", "Unix Shell", True),
        tech("t4", "T1566", "Phishing"),
        tech("t5", "T1000", "Gone", revoked=True),
        uses("a1", "t2"), uses("a1", "t3"), uses("a2", "t4"), uses("a3", "t1"), uses("a2", "t2"), uses("a4", "t1"), uses("a1", "t5"), uses("a3", "t4", revoked=True),
    ]


def test_bundle(spark, tmp_path):
    path = tmp_path / "bundle.json"
    path.write_text(json.dumps({"type": "bundle", "id": "b", "objects": objects()}, indent=1))
    read = bundle.read_objects(spark, str(path))
    assert bundle.version(read).first()["version"] == "9.9"
    parsed = bundle.parse(read)
    assert sorted(r["attack_id"] for r in parsed.entities.collect()) == ["G0001", "G0002", "G0003"]
    assert sorted(r["attack_id"] for r in parsed.features.collect()) == ["T1059", "T1059.001", "T1059.004", "T1566"]
    stats = parsed.stats.first()
    assert (stats["entities_revoked"], stats["entities_deprecated"], stats["entities_dropped"], stats["features_revoked"], stats["uses"]) == (1, 1, 2, 1, 5)
    done = normalize.normalize(parsed.entities, parsed.features, parsed.uses, min_features=1)
    assert {r["entity_id"]: r["feature_ids"] for r in done.entities.collect()} == {"G0001": ["T1059", "T1566"], "G0003": ["T1059"]}
    assert next(r["aliases"] for r in done.entities.collect() if r["entity_id"] == "G0001") == ["Shared Bear", "Beta", "shared-bear", "Beta Two"]
    row = done.catalogue.where("feature_id = 'T1059'").first()
    assert row["feature_name"] == "Interpreter" and set(row["categories"]) == {"execution", "persistence"}
    merge = done.merges.first()
    assert (merge["canonical_id"], merge["merged_ids"], merge["shared_aliases"]) == ("G0001", ["G0001", "G0002"], ["shared-bear"])
    counts = done.stats.first()
    assert (counts["edges_before_rollup"], counts["edges_after_rollup"], counts["merges"], counts["entities_final"]) == (5, 4, 1, 2)
    assert normalize.normalize(parsed.entities, parsed.features, parsed.uses).entities.count() == 0
    assert bundle.checksum(spark, str(path)).first()["length"] == path.stat().st_size
    path.write_text('{"type": "grouping", "objects": []}')
    with pytest.raises(Exception, match="not a bundle"):
        bundle.read_objects(spark, str(path)).collect()


def test_components(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "e"), ("f", None), ("g", "g")], "u string, v string")
    nodes = spark.createDataFrame([("x",)], "node string")
    assert {r[0]: r[1] for r in components(edges, nodes).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "g": "g", "x": "x"}


def test_artefacts(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1)], "entity_id string, feature_id string, extra int")
    tables.write(df, str(tmp_path), "edges")
    assert tables.read(spark, str(tmp_path), "edges").columns == ["entity_id", "feature_id"]
    with pytest.raises(ValueError, match="lacks"):
        tables.write(df.drop("feature_id"), str(tmp_path), "edges")
    with pytest.raises(ValueError, match="empty"):
        tables.write(df.limit(0), str(tmp_path), "edges")
    with pytest.raises(tables.MissingArtefact, match="vector_space"):
        tables.read(spark, str(tmp_path), "space")
    lists = spark.createDataFrame([("a", ["x", "y"], float("nan"))], "id string, l array<string>, v double")
    tables.write_csv(lists, str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), "id string, l string, v double").first()["l"] == "x|y"
    assert tables.without_nan(lists).first()["v"] is None
    assert tables.optional_csv(spark, str(tmp_path / "none.csv"), "a string, notes string").columns == ["a"]
    tables.write_json(lists.select("id", "l"), str(tmp_path / "j"))
    assert tables.read_json(spark, str(tmp_path / "j"), "id string, l array<string>").first()["l"] == ["x", "y"]


def test_streamed_cases_are_scored(spark, tmp_path):
    from kinscope.operators import vectors, weighting

    edges = spark.createDataFrame([("G1", "T1"), ("G1", "T2"), ("G2", "T2")], "entity_id string, feature_id string")
    w = weighting.feature_weights(edges)
    space = vectors.vector_space(edges, w)
    spark.createDataFrame([("q", "T1"), ("q", "T2")], "query_id string, feature_id string").write.parquet(str(tmp_path / "cases"))
    got = []
    cases = spark.readStream.schema("query_id string, feature_id string").parquet(str(tmp_path / "cases"))
    score_cases(cases, space, w, lambda df, n: got.extend(df.collect())).awaitTermination()
    assert next(r["entity_id"] for r in got if r["rank"] == 1) == "G1"
    answers = spark.createDataFrame([("q", 1, "a", 2), ("q", 2, "a", 1), ("q", 2, "b", 2)], "query_id string, revision int, entity_id string, rank int")
    assert {(r["entity_id"], r["revision"]): r["change"] for r in rank_changes(answers).collect()} == {("a", 1): "new", ("a", 2): "up", ("b", 2): "new"}
