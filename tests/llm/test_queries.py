import pytest

from kinscope.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, con, name):
    same(spark, folder, QUERIES[name], ORACLES[name], con)


def rows(spark, folder, name):
    return QUERIES[name](spark, folder).collect()


def test_neighbours_come_in_lists_of_ten(spark, folder):
    from collections import Counter

    got = Counter(r["actor_id"] for r in rows(spark, folder, "p1_neighbours"))
    assert got and set(got.values()) == {min(10, len(got) - 1)}


def test_families_agree_in_both_forms(spark, folder):
    found = rows(spark, folder, "p3_found")
    size = {r["lead_id"]: r["size"] for r in rows(spark, folder, "p3_families")}
    assert {r["lead_id"] for r in found} == set(size) and len(found) == sum(size.values()) - len(size)


def test_groups_of_names_are_their_pairs(spark, folder):
    group = {r["attack_id"]: r["group_id"] for r in rows(spark, folder, "p7_groups")}
    pairs = {(r["attack_id_a"], r["attack_id_b"]) for r in rows(spark, folder, "p7_found")}
    assert pairs == {(a, b) for a in group for b in group if a < b and group[a] == group[b]}


def test_every_document_is_encoded_and_scored(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    ids = QUERIES["p8_ids"](spark, folder)
    assert ids.count() == docs and ids.where("ids is null").count() == 0
    scored = rows(spark, folder, "p10_scores")
    assert len(scored) == docs == sum(r["documents"] for r in rows(spark, folder, "p10_rates"))
    assert {r["doc_id"] for r in rows(spark, folder, "p10_found")} == {r["doc_id"] for r in scored if r["abusive"]}


def test_mix_stays_within_repeats(spark, folder):
    report = {r["source"]: r for r in rows(spark, folder, "p9_report")}
    uses = QUERIES["p9_mix"](spark, folder).groupBy("source").count().collect()
    assert uses and all(r["count"] <= report[r["source"]]["documents"] * report[r["source"]]["max_repeats"] for r in uses)
    assert abs(sum(r["share_reached"] for r in report.values()) - 1) < 1e-9
