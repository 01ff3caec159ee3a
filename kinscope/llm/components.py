"""Problem 4: consolidating pairwise matches into groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinscope.llm.common import column, roots
from kinscope.runtime import materialise

TASK_EDGES = 1_000_000


def _forest(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(root, node) of every node that is not the least of its component: a spanning forest of stars."""
    d = pa.chunked_array([u, v]).combine_chunks().dictionary_encode()
    names, index = d.dictionary, np.asarray(d.indices)
    order = np.asarray(pc.sort_indices(names))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    code = rank[index]
    root = roots(code[: len(u)], code[len(u) :], len(names))
    node = np.flatnonzero(root != np.arange(len(root)))
    return names.take(pa.array(order[root[node]])), names.take(pa.array(order[node]))


def _union_find(it: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Union-find within one edge partition; holds at most about twice `limit` edges, and passes on forests of bounded chunks where a partition is larger."""

    def out(root: pa.Array, node: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([root, node], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    n = 0
    for b in it:
        held.append(b)
        n += b.num_rows
        if n >= 2 * limit:
            t = pa.Table.from_batches(held)
            reduced = out(*_forest(column(t, "u"), column(t, "v")))
            held, n = [reduced], reduced.num_rows
            if n >= limit:
                yield reduced
                held, n = [], 0
    if held:
        t = pa.Table.from_batches(held)
        yield out(*_forest(column(t, "u"), column(t, "v")))


def connected_components(edges: DataFrame, *, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root): every node of the edges (u, v), both strings, with the least node joined to it directly or through others.

    Union-find runs inside the partitions of the edges as they lie; only spanning forests are kept. Forests then merge
    level by level into as few partitions as hold `task_edges` edges each; each level loses the edges that closed a
    cycle between forests, so the next has fewer partitions. Each level is a written table, so a lost executor costs one level. If the forests of all tasks together no longer fit one task (more
    than `task_edges` nodes remain), the rest is contracted by alternating large-star and small-star rounds, which need
    no task that sees a whole component.
    Edges with a null end are left out; a loop (u = u) gives its node; repeated edges change nothing; no edges, no rows.
    Other columns of `edges` are ignored.
    """
    edges = edges.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v")).where("u is not null and v is not null")

    def merged(df: DataFrame) -> DataFrame:
        return df.mapInArrow(lambda it: _union_find(it, task_edges), "u string, v string")

    loops = edges.where("u = v").select("u").distinct()
    forest = materialise(merged(edges.where("u <> v")), "forest")
    n, parts = forest.count(), None
    while parts != 1:
        want = max(1, -(-n // task_edges))
        if parts is not None and want >= parts:
            break
        # A node is at most once in each forest, so no value of v is hot, and forests meet where they share a node.
        forest = materialise(merged(forest.repartition(want, "v")), "forest")
        n, parts = forest.count(), want
    if parts > 1:
        forest = _stars(forest)
    found = forest.select(F.col("v").alias("node"), F.col("u").alias("root"))
    tops = forest.select(F.col("u").alias("node")).distinct()
    loops = loops.select(F.col("u").alias("node"))
    alone = tops.unionByName(loops).distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    return found.unionByName(alone)


def _stars(forest: DataFrame) -> DataFrame:
    """Alternating large-star and small-star contraction until nothing changes; (u, v) with u the least of v's component."""
    state, edges = None, forest
    while True:
        both = edges.select("u", "v").union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        large = materialise(large, "large-star")
        down = large.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y"))
        least = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(least, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).union(least.select("m", "x").toDF("u", "v"))
        edges = materialise(small.where("u <> v").distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges
        state = now


def merge_edges(df: DataFrame, head: str, members: str) -> DataFrame:
    """(u, v): a star over all ids named in a row, whose hub is the least of them; a row of one id is a loop.

    Ids are trimmed and upper-cased; nulls and blanks are left out.
    """
    ids = F.concat(F.array(F.col(head)), F.coalesce(F.col(members), F.array().cast("array<string>")))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform(ids, lambda x: F.upper(F.trim(x))), lambda x: x.isNotNull() & (x != ""))))
    rows = df.select(ids.alias("ids")).where(F.size("ids") > 0)
    ends = F.when(F.size("ids") == 1, F.col("ids")).otherwise(F.slice("ids", 2, 1 << 30))
    return rows.select(F.get("ids", F.lit(0)).alias("u"), F.explode(ends).alias("v"))
