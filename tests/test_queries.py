import os

import pytest

from kinscope.plans.registry import ORACLES, QUERIES
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, con, name):
    same(spark, folder, QUERIES[name], ORACLES[name], con)


def test_queries_without_sql_give_what_their_inputs_hold(spark, folder):
    from kinscope.sources.tables import event_edges

    users = {r[0] for r in event_edges(spark, folder).select("entity_id").distinct().collect()}
    own = {r["entity_id"]: r["cluster_id"] for r in QUERIES["entity_clusters"](spark, folder).collect()}
    assert set(own) == users and min(own.values()) >= -1
    places = QUERIES["entity_map"](spark, folder).collect()
    assert {r["entity_id"] for r in places} == users and max(max(abs(r["x"]), abs(r["y"])) for r in places) == 1
    import json

    documents = {r["query_id"]: json.loads(r["document"]) for r in QUERIES["query_documents"](spark, folder).collect()}
    ranked = QUERIES["candidates"](spark, folder).collect()
    assert {(q, c["entity_id"], c["rank"], c["score"]) for q, d in documents.items() for c in d.get("candidates") or []} == {(r["query_id"], r["entity_id"], r["rank"], r["score"]) for r in ranked}


def test_entry(spark, folder):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    rows = e.entry(spark).collect()
    assert rows and {"query_id", "entity_id", "score", "level"} <= set(rows[0].asDict())


def test_alias_keys_of_all_names_equal_brute_force(spark):
    import re
    import unicodedata

    import pandas as pd

    from kinscope.functions.text import ALIAS_STOPLIST

    larger = "/root/testdata/sf0.01"
    if not os.path.isdir(larger):
        pytest.skip("no test tables")
    want, other = set(), 0
    for r in pd.read_parquet(f"{larger}/raw_actors.parquet")[["attack_id", "name", "aliases"]].itertuples():
        for n in [r.name, *(r.aliases if r.aliases is not None else [])]:
            if n is None:
                continue
            key = re.sub("[^a-z0-9]+", "-", unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode().lower()).strip("-")
            if len(key) >= 3 and key not in ALIAS_STOPLIST:
                want.add((r.attack_id, key))
                other += not n.isascii()
    assert other
    assert {tuple(r) for r in QUERIES["alias_keys"](spark, larger).select("attack_id", "key").collect()} == want
