"""Frequency, co-occurrence, set joins and components against brute force, and their edge cases."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinscope.llm import cooccurrence, setjoin
from kinscope.llm.components import connected_components, merge_edges
from kinscope.llm.cooccurrence import co_occurrence
from kinscope.llm.frequency import term_frequency
from kinscope.llm.setjoin import expand_pairs, similar_sets

ROWS = "id string, ids array<string>, term string, rep string, u string, items string"


def table(spark, rows):
    return spark.createDataFrame([(i, x, "clash", "clash", "clash", "clash") for i, x in rows], ROWS)


def random_sets(n, seed, vocabulary=40, sizes=(1, 14)):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            base = list(rng.choice(out)[1])
            for _ in range(rng.randint(0, 2)):
                if base and rng.random() < 0.5:
                    base.pop(rng.randrange(len(base)))
                else:
                    base.append(f"t{rng.randrange(vocabulary):03}")
            own = base
        else:
            own = [f"t{min(int(rng.expovariate(4 / vocabulary)), vocabulary - 1):03}" for _ in range(rng.randint(*sizes))]
        out.append((f"r{i:04}", own))
    return out


def test_frequency(spark):
    rows = [("a", ["x", "x", "y"]), ("b", ["x", None]), ("c", []), ("d", None), ("e", ["x", "z"]), ("e", ["x", "z"])]
    got = {r["term"]: (r["occurrences"], r["records"], r["share"], r["mark"]) for r in term_frequency(table(spark, rows), F.col("ids"), rare_records=1).collect()}
    assert got == {"x": (5, 4, 1.0, "common"), "y": (1, 1, 0.25, "rare"), "z": (2, 2, 0.5, None)}
    assert term_frequency(table(spark, []), F.col("ids")).count() == 0


@pytest.mark.parametrize(("block", "dense", "flush"), [(512, 4, 1 << 21), (4, 1, 50), (3, 2, 7)])
def test_gram_blocks_and_listed_pairs(monkeypatch, block, dense, flush):
    monkeypatch.setattr(cooccurrence, "BLOCK", block)
    monkeypatch.setattr(cooccurrence, "DENSE_BLOCKS", dense)
    monkeypatch.setattr(cooccurrence, "FLUSH", flush)
    rows = [sorted(set(x)) for _, x in random_sets(120, 1)]
    want = Counter(p for x in rows for p in combinations(x, 2)) + Counter((t, t) for x in rows for t in x)
    users = Counter(t for x in rows for t in x)
    g, got = cooccurrence._Gram(sorted(users, key=lambda w: (-users[w], w))[: block * dense]), Counter()
    batches = []
    for lo in range(0, len(rows), 17):
        part = rows[lo : lo + 17]
        code = g.codes([t for x in part for t in x])
        batches += g.add(np.repeat(np.arange(len(part)), [len(x) for x in part]), code, len(part))
    for b in [*batches, *g.close()]:
        for a, c, n in zip(*(b.column(i).to_pylist() for i in range(3))):
            got[a, c] += n
    assert got == want


def test_co_occurrence(spark):
    rows = [("a", ["x", "y", "y"]), ("b", ["x", "y"]), ("c", ["z", None]), ("d", []), ("e", None), ("f", ["x"])]
    got = {(r["item_a"], r["item_b"]): (r["both"], r["users_a"], r["users_b"], r["records"], r["lift"]) for r in co_occurrence(table(spark, rows), F.col("ids")).collect()}
    assert got == {("x", "y"): (2, 3, 2, 4, pytest.approx(4 * 2 / 6))}
    assert co_occurrence(table(spark, rows), F.col("ids"), min_lift=2).count() == 0
    assert co_occurrence(table(spark, []), F.col("ids")).count() == 0


@pytest.mark.parametrize(("share", "blocks"), [(0.0, 4), (0.0, 1), (0.01, 4)])
def test_twenty_thousand_items_equal_brute_force(spark, monkeypatch, share, blocks):
    monkeypatch.setattr(cooccurrence, "DENSE_BLOCKS", blocks)
    monkeypatch.setattr(cooccurrence, "NAMES", 3_000)
    rng = np.random.default_rng(4)
    rows = [(str(i), [f"w{int(w)}" for w in np.unique(np.minimum(rng.zipf(1.15, 25), 20_000))]) for i in range(1_500)]
    rows += [(f"x{i}", [f"w{j}" for j in range(i * 9, i * 9 + 9)]) for i in range(2_300)]
    users, both = Counter(t for _, x in rows for t in x), Counter(p for _, x in rows for p in combinations(sorted(x), 2))
    assert len(users) > 20_000
    got = {(r["item_a"], r["item_b"]): (r["both"], r["users_a"], r["users_b"]) for r in co_occurrence(table(spark, rows), F.col("ids"), min_share=share).collect()}
    assert got == {p: (n, users[p[0]], users[p[1]]) for p, n in both.items() if n >= share * len(rows)}


def links_of(spark, left, right=None, **kw):
    links, members = similar_sets(table(spark, left), None if right is None else table(spark, right), **kw)
    return {tuple(r) for r in expand_pairs(links, members).select("left_id", "right_id").collect()}


def brute(left, right, threshold, least):
    a = [(i, set(x) - {None}) for i, x in left if i is not None and x]
    b = [(i, set(x) - {None}) for i, x in right or [] if i is not None and x]
    out = set()
    for k, (i, x) in enumerate(a):
        for j, y in [*a[k + 1 :], *b]:
            if min(len(x), len(y)) >= least and 5 * len(x & y) >= round(5 * threshold) * len(x | y):
                out.add((min(i, j), max(i, j)))
    return {p for p in out if p[0] != p[1]}


@pytest.mark.parametrize(("threshold", "least", "hot"), [(0.8, 5, 32_768), (0.8, 1, 5), (0.6, 2, 20), (1.0, 1, 3)])
def test_set_join_equals_brute_force(spark, threshold, least, hot):
    left, right = random_sets(260, 2), [(f"c{i}", x) for i, (_, x) in enumerate(random_sets(90, 3))] + [(f"d{i}", x) for i, (_, x) in enumerate(random_sets(260, 2)[:60])]
    assert links_of(spark, left, right, threshold=threshold, min_size=least, list_rows=hot) == brute(left, right, threshold, least)


def test_set_join_large_sets(spark):
    left = random_sets(150, 5, vocabulary=200, sizes=(8, 60))
    assert links_of(spark, left, threshold=0.8, list_rows=10) == brute(left, None, 0.8, 1)


def test_sets_of_two_thousand_tokens_equal_brute_force(spark):
    rng = random.Random(8)
    left = []
    for n in (2_000, 600, 161, 130, 128, 104, 103):
        for _ in range(4):
            base = rng.sample(range(6_000), n)
            # Near the threshold on both sides of it, and across the sizes where keys change.
            for change in (0, 0.05, 0.1, 0.111, 0.12, 0.2):
                kept = base[int(n * change) :]
                left += [(f"{len(left)}", [f"t{x}" for x in kept]), (f"{len(left)}b", [f"t{x}" for x in [*kept, *rng.sample(range(6_000, 9_000), int(n * change))]])]
    want = brute(left, None, 0.8, 1)
    assert links_of(spark, left, threshold=0.8, list_rows=7) == want == links_of(spark, left, threshold=0.8) and len(want) > 300
    assert len(setjoin._keys(10_000, setjoin.Fraction("0.8"))) == 2_001


def test_set_join_edge_cases(spark):
    five = list("abcde")
    left = [("p", five), ("q", five), ("q", five), ("s", [*five, None, "a"]), ("t", None), ("u", []), (None, five), ("v", list("abcd"))]
    assert links_of(spark, left, threshold=0.8, min_size=5) == {("p", "q"), ("p", "s"), ("q", "s")}
    assert links_of(spark, [("a", list("abcde")), ("b", list("abcd"))], threshold=0.8) == {("a", "b")}
    assert links_of(spark, [], [("c", five), ("d", five)]) == set()
    assert links_of(spark, [], []) == set()


def test_a_third_of_equal_sets_stays_one_class(spark):
    rows = random_sets(60, 7) + [(f"s{i:03}", list("abcdefgh")) for i in range(30)] + [("near", list("abcdefghi"))]
    links, members = similar_sets(table(spark, rows), threshold=0.8)
    assert members.where("rep = 'ls000'").count() == 30
    assert links.where("rep_a = 'ls000' or rep_b = 'ls000'").count() == 1


def components_of(pairs):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("task_edges", [1_000_000, 40, 3])
def test_components_of_chains_stars_and_random_edges(spark, task_edges):
    rng = random.Random(4)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    star = [("s000", f"s{i:03}") for i in range(1, 60)]
    loose = [(f"x{rng.randrange(90):02}", f"x{rng.randrange(90):02}") for _ in range(60)]
    pairs = chain + star + loose + loose[:9]
    rng.shuffle(pairs)
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs] + [(None, "n", 1), ("n", None, 1)], "u string, v string, node int").repartition(5)
    assert {r["node"]: r["root"] for r in connected_components(df, task_edges=task_edges).collect()} == components_of(pairs)


def test_no_edges_no_components(spark):
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_merge_rows(spark):
    rows = [(" g2 ", ["G1", None, "g2"]), (None, ["g3", " "]), ("G4", None), (None, None), ("g1", ["G9"]), ("g1", ["G9"])]
    df = spark.createDataFrame([(c, m, 0) for c, m in rows], "canonical_id string, merged_ids array<string>, ids int")
    got = {r["node"]: r["root"] for r in connected_components(merge_edges(df, "canonical_id", "merged_ids")).collect()}
    assert got == {"G1": "G1", "G2": "G1", "G9": "G1", "G3": "G3", "G4": "G4"}


def test_id_lists_are_those_of_the_expressions(spark):
    from kinscope.functions.ids import id_list, id_set
    from kinscope.llm.common import id_lists

    rows = [("a", [" t1001.002", "T1001", None, "", "  ", "t1.2.3", "é.x"]), ("b", None), ("c", []), ("d", ["T2", "t2 ", ".5"]), (None, ["x"])]
    df = table(spark, rows)
    for repeats, of in ((False, id_set), (True, id_list)):
        want = {(r["id"], tuple(r["x"])) for r in df.select("id", of(F.col("ids")).alias("x")).collect()}
        assert {(r["id"], tuple(r["ids"])) for r in id_lists(df, "id", "ids", repeats=repeats).collect()} == want
    assert id_lists(df.limit(0), "id", "ids").count() == 0
