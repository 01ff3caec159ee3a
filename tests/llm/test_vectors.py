"""Nearest vectors and families against brute force, and their edge cases."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest

from kinscope.llm import families as families_module
from kinscope.llm import knn
from kinscope.llm.families import agglomerate, families, typical_members
from kinscope.llm.knn import hilbert, nearest

SCHEMA = "id string, vec array<float>, at timestamp, key string, ix int, nk string"
T0 = dt.datetime(2024, 1, 1)


def table(spark, rows, partitions=3):
    rows = [(i, None if v is None else [float(x) for x in v], T0 + dt.timedelta(days=d), "clash", 7, "clash") for i, v, d in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def blobs(n, groups, width, seed=0, spread=0.5):
    rng = np.random.default_rng(seed)
    centre = rng.random((groups, width)) * (rng.random((groups, width)) < 0.2)
    x = centre[rng.integers(0, groups, n)] + spread * rng.random((n, width)) * (rng.random((n, width)) < 0.05)
    return x.astype(np.float32)


def brute(ids, x, k):
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {ids[i]: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-round(s[i, j], 6), ids[j])) if j != i][:k] for i in range(len(ids))}, s


def test_hilbert_neighbours_touch():
    grid = np.array([(a, b) for a in range(16) for b in range(16)])
    path = grid[np.argsort(hilbert(grid, 4))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_small_tables_are_exact(spark):
    x = blobs(300, 12, 40)
    x[np.linalg.norm(x, axis=1) == 0, 0] = 1
    ids = [f"v{i:04}" for i in range(300)]
    got = {}
    for r in nearest(table(spark, [(i, v, 0) for i, v in zip(ids, x)]), "id", "vec", "at", k=5).collect():
        got.setdefault(r["key"], []).append((r["neighbour"], r["similarity"]))
    want, s = brute(ids, x, 5)
    place = {e: i for i, e in enumerate(ids)}
    for e, near in want.items():
        assert len(got[e]) == 5
        for n, sim in got[e]:
            assert sim == pytest.approx(s[place[e], place[n]], abs=1e-5)
        assert min(sim for _, sim in got[e]) == pytest.approx(min(s[place[e], place[n]] for n in near), abs=1e-5)


def test_recall_over_many_ranges(spark):
    x = blobs(6_000, 60, 96, seed=1)
    x[np.linalg.norm(x, axis=1) == 0, 0] = 1
    ids = [f"v{i:05}" for i in range(len(x))]
    found = nearest(table(spark, [(i, v, 0) for i, v in zip(ids, x)], 4), "id", "vec", "at", k=10, task_rows=1_500)
    got = {}
    for r in found.collect():
        got.setdefault(r["key"], set()).add(r["neighbour"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(2)
    hits = total = 0
    for i in rng.choice(len(x), 300, replace=False):
        s = u @ u[i]
        s[i] = -2
        bound = np.sort(s)[-10]
        hits += sum(s[int(n[1:])] >= bound - 1e-6 for n in got[ids[i]])
        total += 10
    assert hits / total >= 0.9


def test_current_row_null_zero_and_equal_vectors(spark):
    rows = [("a", [1, 0, 0], 0), ("a", [0, 1, 0], 1), ("b", [0, 1, 0], 0), ("c", [0, 2, 0], 0), ("d", [0, 0, 0], 0), ("e", None, 5), ("e", [0, 1, 0], 0), ("f", [float("nan"), 1, 0], 0), ("g", [0, 1, 0.1], 0), ("h", [0, 1], 0), ("a", [0, 1, 0], 1)]
    got = {}
    for r in nearest(table(spark, rows), "id", "vec", "at", k=3).collect():
        got.setdefault(r["key"], []).append((r["neighbour"], round(r["similarity"], 4)))
    assert set(got) == {"a", "b", "c", "g", "h"}
    assert sorted(got["a"]) == [("b", 1.0), ("c", 1.0), ("h", 1.0)] and sorted(n for n, _ in got["g"]) == ["a", "b", "c"]


def test_a_third_of_equal_vectors_gets_the_lowest_ids(spark):
    x = blobs(200, 10, 30, seed=3)
    x[np.linalg.norm(x, axis=1) == 0, 0] = 1
    rows = [(f"v{i:03}", v, 0) for i, v in enumerate(x)] + [(f"s{i:03}", np.ones(30), 0) for i in range(100)]
    got = {}
    for r in nearest(table(spark, rows), "id", "vec", "at", k=4).collect():
        got.setdefault(r["key"], set()).add(r["neighbour"])
    assert got["s050"] == {"s000", "s001", "s002", "s003"} and got["s001"] == {"s000", "s002", "s003", "s004"}


def test_threshold_is_decided_in_double_precision(spark):
    # cos = 0.6 exactly up to float32 input; 3-4-5 triangle.
    rows = [("a", [1, 0], 0), ("b", [3, 4], 0), ("c", [2.9999, 4], 0)]
    got = {tuple(sorted((r["key"], r["neighbour"]))) for r in nearest(table(spark, rows), "id", "vec", "at", k=2, exact_at=(0.6,), at_least=0.6).collect()}
    assert ("a", "b") in got and ("a", "c") not in got


def test_lists_hold_only_what_is_asked_for():
    x = blobs(700, 9, 60, seed=3)
    x[np.linalg.norm(x, axis=1) == 0, 0] = 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names = pa.array([f"v{i:03}" for i in range(len(x))])
    whole, asked = knn._Best(len(x), 6, names), knn._Best(len(x), 6, names)
    knn._windows(x, np.arange(len(x)), whole, lambda a, b, s: s, 1)
    knn._windows(x, np.arange(len(x)), asked, lambda a, b, s: s, 1, 0.97)
    kept = whole.sim >= 0.97
    assert 0 < kept.sum() < kept.size
    assert (asked.code == np.where(kept, whole.code, -1)).all()


def test_fewer_vectors_than_asked_for_are_not_their_own_neighbours(spark):
    got = nearest(table(spark, [("a", [1, 0], 0), ("b", [1, 1], 0), ("c", [0, 1], 0)]), "id", "vec", "at", k=10).collect()
    assert sorted((r["key"], r["neighbour"]) for r in got) == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b")]


def test_no_vectors_no_rows(spark):
    assert nearest(table(spark, []), "id", "vec", "at").count() == 0
    assert nearest(table(spark, [("a", [1, 2], 0)]), "id", "vec", "at").count() == 0
    assert families(table(spark, []), "id", "vec", "at").count() == 0
    assert families(table(spark, [("a", [1, 2], 0)]), "id", "vec", "at").count() == 0


def test_best_lists_break_ties_by_id():
    import pyarrow as pa

    best = knn._Best(1, 2, pa.array(["d", "c", "b", "a"]))
    best.add(np.array([0, 0, 0, 0]), np.array([0, 1, 2, 3]), np.full(4, 0.5, np.float32))
    assert best.code[0].tolist() == [3, 2]
    best.add(np.array([0]), np.array([0]), np.array([0.9], np.float32))
    assert best.code[0].tolist() == [0, 3]


def planted(seed=0):
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for f in range(14):
        core = rng.choice(200, 12, replace=False)
        for m in range(int(rng.integers(6, 40))):
            v = np.zeros(200, np.float32)
            v[rng.choice(core, 9, replace=False)] = 1
            v[rng.choice(200, 3, replace=False)] = 1
            truth[f"f{f:02}m{m:03}"] = f
            rows.append((f"f{f:02}m{m:03}", v, 0))
    for i in range(30):
        v = np.zeros(200, np.float32)
        v[rng.choice(200, 12, replace=False)] = 1
        rows.append((f"z{i:03}", v, 0))
    return rows, truth


def test_families_are_found_and_strangers_left_out(spark):
    rows, truth = planted()
    got = families(table(spark, rows), "id", "vec", "at")
    lead = {r["key"]: r["lead"] for r in got.collect()}
    assert set(truth) <= set(lead)
    groups = {}
    for e, f in truth.items():
        groups.setdefault(f, set()).add(lead[e])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert sum(e.startswith("z") for e in lead) <= 2
    for e, top in lead.items():
        assert top <= e
    top = typical_members(got, 3).collect()
    assert {r["rank"] for r in top} == {1, 2, 3} and len(top) == 3 * len(groups)


def test_small_families_are_found_where_few_left_over_rows_are_drawn_as_seeds(spark, monkeypatch):
    from kinscope.llm import families as module

    monkeypatch.setattr(module, "REST_SEEDS", 64)
    monkeypatch.setattr(module, "REST_FACTOR", 1.0)
    rng, rows = np.random.default_rng(7), []
    for i in range(1_500):
        rows.append((f"z{i}", np.bincount(rng.choice(400, 10, replace=False), minlength=400), 0))
    for f in range(12):
        core = rng.choice(400, 6, replace=False)
        for k in range(5):
            rows.append((f"f{f}-{k}", np.bincount(np.concatenate([core, rng.choice(np.setdiff1d(np.arange(400), core), 4, replace=False)]), minlength=400), 0))
    got = {r["key"]: r["lead"] for r in families(table(spark, rows), "id", "vec", "at").collect()}
    for f in range(12):
        assert {got.get(f"f{f}-{k}") for k in range(5)} == {f"f{f}-0"}


def test_agglomeration_is_average_linkage():
    rng = np.random.default_rng(4)
    x = rng.random((12, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    count, total = agglomerate(np.ones(12), x, 0.9)
    groups = [[i] for i in range(12)]
    while True:
        best = max(((x[a] @ x[b].T).mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best[0] < 0.9:
            break
        groups[best[1]] += groups.pop(best[2])
    assert sorted(count.astype(int)) == sorted(map(len, groups))


def test_equal_rows_share_a_family(spark):
    got = {r["key"]: (r["lead"], r["size"]) for r in families(table(spark, [(f"e{i}", [1, 2, 3], 0) for i in range(6)] + [("x", [-1, 0, 0], 0)]), "id", "vec", "at").collect()}
    assert got == {f"e{i}": ("e0", 6) for i in range(6)}


def test_families_of_a_whole_table_are_those_of_average_linkage(spark):
    """sf0.01: every vector, against average linkage of all of them."""
    import os

    import pandas as pd

    from kinscope.operators.clustering import linkage_labels

    larger = "/root/testdata/sf0.01"
    if not os.path.isdir(larger):
        pytest.skip("no test tables")
    rows = pd.read_parquet(f"{larger}/vector_space.parquet").sort_values("built_at", kind="stable").drop_duplicates("actor_id", keep="last")
    rows = rows[[v is not None and bool(np.any(np.asarray(v, float))) for v in rows.vec]]
    x = np.stack([np.asarray(v, float) for v in rows.vec])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = pd.DataFrame({"id": rows.actor_id.to_numpy(), "label": linkage_labels(1 - x @ x.T, threshold=1 - 0.36)})
    own = own[own.groupby("label").id.transform("size") >= 5]
    want = set(zip(own.id, own.groupby("label").id.transform("min")))
    got = {(r["key"], r["lead"]) for r in families(spark.read.parquet(f"{larger}/vector_space.parquet"), "actor_id", "vec", "built_at").collect()}
    assert len(got & want) >= 0.998 * len(want) and len(got) <= 1.002 * len(want)


def test_nearest_of_many_centres_by_their_groups(monkeypatch):
    monkeypatch.setattr(families_module, "GROUPED", 1_000)
    x = blobs(12_000, 400, 256, seed=5)
    x = x[np.linalg.norm(x, axis=1) > 0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres, rows = x[:2_000], x[2_000:8_000]
    who, best = families_module._Centres.of(centres, True).nearest(rows)
    _, want = families_module._nearest(rows, centres)
    assert np.allclose(best, (rows * centres[who]).sum(axis=1), atol=1e-5)
    assert (best >= want - 1e-5).mean() > 0.97
    few = families_module._Centres.of(centres[:900], True)
    assert len(few.heads) == 0 and (few.nearest(rows)[0] == families_module._nearest(rows, centres[:900])[0]).all()


def test_families_by_groups_of_centres_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    kinds = [rng.choice(64, 6, replace=False) for _ in range(12)]
    rows = [(f"k{i:03}", np.bincount(kinds[i % 12], minlength=64) + 0.1 * np.bincount(rng.choice(64, 2), minlength=64), 0) for i in range(240)]
    listed = lambda: sorted(map(tuple, families(table(spark, rows), "id", "vec", "at", dims=64).select("key", "lead", "size").collect()))
    want = listed()
    used = []
    monkeypatch.setattr(families_module, "GROUPED", 16)
    monkeypatch.setattr(families_module, "PROBES", 3)
    of = families_module._Centres.of
    monkeypatch.setattr(families_module._Centres, "of", staticmethod(lambda *a: used.append(of(*a)) or used[-1]))
    assert listed() == want and len(want) > 200 and any(len(c.heads) for c in used)


@pytest.mark.parametrize("low", [0.0, -0.3])
def test_leading_axes_leave_out_most_products_and_no_nearest(monkeypatch, low):
    rng = np.random.default_rng(5)
    x = blobs(6_000, 300, 200, seed=5, spread=0.2) + low * (rng.random((6_000, 200)) < 0.02)
    x = np.concatenate([families_module._unit(x), np.zeros((3, 200), np.float32), families_module._unit(rng.random((50, 200)))])
    centres = np.concatenate([x[rng.choice(6_000, 600, replace=False)], np.zeros((1, 200), np.float32)])
    centres[7] = centres[5]
    who, best = families_module._nearest(x, centres)
    whole = []
    plain = families_module._nearest
    monkeypatch.setattr(families_module, "_nearest", lambda rows, c: (whole.append(len(rows)), plain(rows, c))[1])
    got, product = families_module._Centres.of(centres).nearest(x)
    assert np.abs(product - best).max() < 1e-5
    assert (np.abs((x * centres[got]).sum(axis=1) - best) < 1e-5).all() and not (got == 7).any()
    assert sum(whole) < len(x) / 3


def test_seeds_are_the_first_of_the_race_over_all_rows(spark):
    x = families_module._unit(blobs(3_000, 20, 60, seed=6) + 0.001)
    keys = [f"k{i:05}" for i in range(3_000)]
    rows = families_module.pack_vectors(table(spark, [(k, v, 0) for k, v in zip(keys, x)]), "id", "vec", "at").repartition(2).cache()
    got = families_module._seeds(rows, 30, 512, 4)
    full = np.zeros((3_000, 512), np.float32)
    full[:, np.arange(60) * 40_503 % 512] = x
    centres = np.zeros((0, 512), np.float32)
    for r in range(4):
        far = np.maximum(1 - (full @ centres.T).max(axis=1), 1e-12) if r else np.ones(3_000)
        race = -np.log(families_module._uniform(keys, 4 + r)) / far
        centres = np.vstack([centres, full[np.argsort(race)[: 10 if r else 1]]])
    assert np.abs(got - centres).max() < 1e-5
