"""Sparse vectors multiplied block by block: every pair that shares a feature, or the best of each, without a shuffle of the pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinscope.runtime import let_go, materialise, numbered

# The most vectors and entries of a block, the features multiplied as dense columns, and the products held at once.
BLOCK_ROWS, BLOCK_ENTRIES, DENSE, HELD = 12_000, 1_000_000, 1_024, 1 << 20
# The left of two sides is never held dense, so its blocks may be larger: the fewer blocks, the less is shuffled.
LEFT_ROWS, LEFT_ENTRIES = 60_000, 2_000_000
# Entries that a side may be repeated to for the sake of more tasks, where the other side is no larger.
REPEATED = 2_000_000
# The most ids gathered in one row, kept in one row of a class, and in one block of classes.
GATHERED, CLASS_IDS, BLOCK_IDS = 1_000_000, 8_192, 200_000
# The most entries of a bundle of vectors, and of ids as many.
BUNDLED = 2_000_000
# The share of different vectors above which classes are not worth their shuffle, and the rows handed to the JVM at once.
DIFFERENT, SENT = 0.8, 16_384
PLACES = 1e6


@dataclass
class Block:
    """Vectors of one side, sorted by id (text holds the same for comparing): entry i belongs to vector row[i] and has feature code[i] and value[i]; n and t are figures of each vector."""

    ids: pa.Array
    text: np.ndarray
    n: np.ndarray
    t: np.ndarray
    row: np.ndarray
    code: np.ndarray
    value: np.ndarray
    members: pa.ListArray | None = None

    def expanded(self, j: np.ndarray, most: int | None = None) -> tuple[np.ndarray, pa.Array]:
        """For vectors j that stand for several ids each: (which of j, id) of all of them, or of the `most` lowest of each."""
        if self.members is None:
            return np.arange(len(j)), self.ids.take(pa.array(j))
        size = np.asarray(self.members.value_lengths()).astype(np.int64)
        first = np.cumsum(size) - size
        times = size[j] if most is None else np.minimum(size[j], most)
        which = np.repeat(np.arange(len(j)), times)
        at = np.repeat(first[j] - (np.cumsum(times) - times), times) + np.arange(len(which))
        return which, self.members.flatten().take(pa.array(at))


# Turns (left, right, rows of the left, dot, matched) into a table of results, or None.
Emit = Callable[[Block, Block, slice, np.ndarray, np.ndarray], "pa.RecordBatch | None"]


def rounded(x: np.ndarray) -> np.ndarray:
    """Non-negative numbers to six places, halves up."""
    return np.floor(x * PLACES + 0.5) / PLACES


def pack(rows: DataFrame, codes: DataFrame, value: Column, over: Column | None = None) -> DataFrame:
    """(id, n, t, code, value): one row a vector of `rows` (id, feature_id, w, u), with the features both sides have; n and t are of all its features.

    With `over`, a figure that is the same in all rows of a vector, it is a column too, and values stand for what they are over it.
    """
    entry = F.when(F.col("number").isNotNull(), F.struct(F.col("number").cast("int").alias("c"), value.cast("double").alias("v")))
    figures = [F.count(F.lit(1)).alias("n"), F.sum("w").alias("t"), *([] if over is None else [F.max(over).alias("over")])]
    own = rows.join(codes, "feature_id", "left").groupBy("id").agg(*figures, F.array_sort(F.collect_list(entry)).alias("own"))
    return own.where(F.size("own") > 0).select("id", "n", "t", *([] if over is None else ["over"]), F.col("own.c").alias("code"), F.col("own.v").alias("value"))


def classes(vectors: DataFrame) -> DataFrame:
    """(id, n, t, code, value, members): equal vectors of `pack` as one row, under their lowest id; all ids, sorted, are its members.

    Equal means but for the order of summation. A class of very many ids is several rows.
    """
    parts = -(-vectors.count() // GATHERED)
    alike = [F.pmod(F.xxhash64("id"), F.lit(max(1, parts))).alias("part"), F.col("code"), "n", F.round(F.col("t") * 1e9).cast("bigint").alias("about_t"), F.transform("value", lambda v: F.round(v * 1e9).cast("bigint")).alias("about")]
    rows = vectors.groupBy(*alike).agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("t").alias("t"), F.min_by("value", "id").alias("value"))
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / CLASS_IDS).cast("int")), lambda k: F.slice("ids", k * CLASS_IDS + 1, CLASS_IDS)))
    return rows.select("n", "t", "code", "value", cut.alias("members")).select(F.col("members")[0].alias("id"), "n", "t", "code", "value", "members")


def once_each(vectors: DataFrame) -> DataFrame:
    """Written vectors of `pack` as their `classes`, if many may be equal, else as they are."""
    rows, different = vectors.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("code"), 0.02)).first()
    if different > DIFFERENT * rows:
        return vectors
    own = materialise(classes(vectors), "classes")
    let_go(vectors)
    return own


def _block(ids: pa.Array, n: np.ndarray, t: np.ndarray, size: np.ndarray, code: np.ndarray, value: np.ndarray, members: pa.ListArray | None = None) -> Block:
    """The block of vectors in any order, of `size` entries each."""
    text = np.array(ids.to_numpy(zero_copy_only=False), dtype=str)
    order = np.argsort(text, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Block(ids.take(pa.array(order)), text[order], n[order], t[order], np.repeat(place, size), code, value, members.take(pa.array(order)) if members is not None else None)


def _read(batches: list[pa.RecordBatch]) -> Block:
    t = pa.Table.from_batches(batches)
    code = t["code"].combine_chunks()
    return _block(t["id"].combine_chunks(), t["n"].to_numpy(), t["t"].to_numpy(), np.asarray(code.value_lengths()), np.asarray(code.flatten()), np.asarray(t["value"].combine_chunks().flatten()), t["members"].combine_chunks() if "members" in t.column_names else None)


def _bundle(t: pa.RecordBatch) -> bytes:
    """Vectors of `pack`, compressed: gaps between codes instead of codes, and the value of each code once where it is the same in all of them, as weights are."""
    code, value = np.asarray(t["code"].flatten()), np.asarray(t["value"].flatten())
    size = np.asarray(t["code"].value_lengths()).astype(np.int32)
    first = (np.cumsum(size) - size)[size > 0]
    gap = np.diff(code, prepend=code[:1])
    gap[first] = code[first]
    known, at = np.unique(code, return_inverse=True)
    by = np.empty(len(known))
    by[at] = value
    alike = bool((by[at] == value).all())
    kind = next((k for k in (np.uint8, np.uint16) if gap.min(initial=0) >= 0 and gap.max(initial=0) <= np.iinfo(k).max), np.int32)
    columns = {"id": t["id"], "n": t["n"], "t": t["t"], "size": size, "gap": gap.astype(kind), "known": known if alike else known[:0], "value": by if alike else value}
    if "over" in t.schema.names:
        columns["over"] = t["over"]
    out = pa.BufferOutputStream()
    rows = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in columns.values()], list(columns))
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(rows)
    return out.getvalue().to_pybytes()


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, vectors): the vectors of each block in a task, bundled."""
    held, entries = [], 0

    def bundled() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        own = np.asarray(t["block"])
        found = np.unique(own)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([_bundle(t.filter(pa.array(own == k))) for k in found], pa.binary())], ["block", "vectors"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            entries += len(batch["code"].flatten()) + batch.num_rows
        if entries > BUNDLED:
            yield bundled()
            held, entries = [], 0
    if held:
        yield bundled()


def _opened(bundles: list[bytes]) -> Block:
    ids, figures = [], []
    for bundle in bundles:
        t = pa.ipc.open_stream(bundle).read_next_batch()
        c = {k: t[k].flatten() for k in t.schema.names}
        ids.append(c.pop("id"))
        c = {k: np.asarray(x) for k, x in c.items()}
        size = c["size"]
        # Codes are running sums of the gaps inside a vector.
        upto = np.append(0, np.cumsum(c["gap"], dtype=np.int64))
        code = upto[1:] - np.repeat(upto[np.cumsum(size) - size], size)
        value = c["value"][np.searchsorted(c["known"], code)] if len(c["known"]) else c["value"]
        figures.append((c["n"], c["t"], size, code.astype(np.int32), value / np.repeat(c["over"], size) if "over" in c else value))
    return _block(pa.concat_arrays(ids), *[np.concatenate(x) for x in zip(*figures)])


def _products(a: Block, b: Block, held: int, most: int, whole: bool) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, dot, matched) of a few vectors of `a` after another against all of `b`: the features most pairs share as matrices, the others as listed pairs."""
    common = np.intersect1d(a.code, b.code)
    if not len(common):
        return

    def side(x: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, x.code), len(common) - 1)
        kept = common[at] == x.code
        return x.row[kept], at[kept], x.value[kept]

    (ar, ac, av), (br, bc, bv) = side(a), side(b)
    weight = np.bincount(ac, minlength=len(common)).astype(float) * np.bincount(bc, minlength=len(common))
    place = np.empty(len(common), np.int64)
    place[np.argsort(-weight, kind="stable")] = np.arange(len(common))
    ac, bc = place[ac], place[bc]
    head, many = min(len(common), most), len(b.ids)
    in_head = bc < head
    dense, has = np.zeros((head, many)), np.zeros((head, many), np.float32)
    dense[bc[in_head], br[in_head]], has[bc[in_head], br[in_head]] = bv[in_head], 1
    tail = np.argsort(bc[~in_head], kind="stable")
    tc, tr, tv = bc[~in_head][tail], br[~in_head][tail], bv[~in_head][tail]
    order = np.argsort(ar, kind="stable")
    ar, ac, av = ar[order], ac[order], av[order]
    step = max(1, held // max(1, many, len(b.members.flatten()) if whole and b.members is not None else 0))
    for lo in range(0, len(a.ids), step):
        hi = min(lo + step, len(a.ids))
        i, j = np.searchsorted(ar, [lo, hi])
        r, c, v = ar[i:j] - lo, ac[i:j], av[i:j]
        own = c < head
        left, one = np.zeros((hi - lo, head)), np.zeros((hi - lo, head), np.float32)
        left[r[own], c[own]], one[r[own], c[own]] = v[own], 1
        dot, matched = left @ dense, one @ has
        if len(tc):
            r, c, v = r[~own], c[~own], v[~own]
            first, last = np.searchsorted(tc, c, "left"), np.searchsorted(tc, c, "right")
            times = last - first
            # Listed in portions: a portion is at most `held` pairs and one entry's.
            cut = np.cumsum(times)
            k = 0
            while k < len(c):
                until = max(k + 1, int(np.searchsorted(cut, (cut[k - 1] if k else 0) + held, "right")))
                t = times[k:until]
                at = np.repeat(first[k:until] - (np.cumsum(t) - t), t) + np.arange(t.sum())
                flat = np.repeat(r[k:until], t) * many + tr[at]
                np.add.at(dot.ravel(), flat, np.repeat(v[k:until], t) * tv[at])
                np.add.at(matched.ravel(), flat, np.float32(1))
                k = until
        yield slice(lo, hi), dot, matched


def multiply(left: DataFrame, right: DataFrame | None, emit: Emit, schema: str, *, unit: bool = False, held: int | None = None, whole: bool = False) -> DataFrame:
    """What `emit` makes of every block of `left` against every block of `right`, both as `pack` gives them; a `right` of None is `left` itself, and each two blocks meet once.

    With `unit` the values of the right count as 1, so that a product is the sum of the left's values. The right may be
    `classes`; where `emit` gives a row for each of their ids, `whole` makes the steps as much shorter.
    Vectors are hashed into blocks of bounded size, and a task holds one block of each side. So what is shuffled are the
    vectors, once for each block of the other side, and never the pairs. Those of an only side are sent in bundles, as all
    of them are repeated for each block.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sizes(df: DataFrame) -> tuple[int, int, int]:
        return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("code")), F.lit(0)), F.coalesce(F.sum(F.size("members")), F.lit(0)) if "members" in df.columns else F.lit(0)).first())

    def needed(rows: int, entries: int, ids: int = 0) -> int:
        return max(1, -(-rows // BLOCK_ROWS), -(-entries // BLOCK_ENTRIES), -(-ids // BLOCK_IDS))

    def hashed(df: DataFrame, n: int, side: int) -> DataFrame:
        return df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("side", F.lit(side))

    if right is None:
        rows, entries, _ = sizes(left)
        # More blocks for the sake of more tasks, as long as what is repeated for them stays small.
        n = max(needed(rows, entries), min(int((2 * parts) ** 0.5) + 1, rows // 1_000, 4 * REPEATED // max(1, entries)))
        cells = n * (n + 1) // 2
        # Blocks i <= j meet in the cell j (j + 1) / 2 + i.
        other = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
        bundles = left.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).mapInArrow(_bundles, "block int, vectors binary")
        met = bundles.select("*", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
        both = met.withColumn("cell", (F.col("hi") * (F.col("hi") + 1) / 2 + F.col("lo")).cast("int")).withColumn("side", (F.col("block") == F.col("hi")).cast("int"))
        columns = ["vectors"]
    else:
        rows, entries, _ = sizes(left)
        n = max(1, -(-rows // LEFT_ROWS), -(-entries // LEFT_ENTRIES))
        others, theirs, ids = sizes(right)
        m = needed(others, theirs, ids)
        # More tasks by smaller blocks, as long as what is repeated for them stays small.
        m = max(m, min(2 * parts // n, max(others, ids) // 1_000, others, max(theirs, REPEATED) // max(1, entries)))
        # Tasks are about equally long: a last round of few of them would leave the other cores without work.
        cores = left.sparkSession.sparkContext.defaultParallelism
        m = max(needed(others, theirs, ids), m - m % cores)
        n = max(n, min(2 * parts // m, rows // 100, max(entries, REPEATED) // max(1, theirs)))
        cells = n * m
        ours = hashed(left, n, 0).select("*", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("other")).withColumn("cell", F.col("block") * m + F.col("other"))
        theirs = hashed(right, m, 1).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")).withColumn("cell", F.col("other") * m + F.col("block"))
        columns = ["id", "n", "t", "code", "value", "members"] if "members" in right.columns else ["id", "n", "t", "code", "value"]
        both = ours.unionByName(theirs, allowMissingColumns=True)
    alone, held, most, sent = right is None, held or HELD, DENSE, SENT

    def read(batches: list[pa.RecordBatch]) -> Block:
        return _opened([x.as_py() for batch in batches for x in batch["vectors"]]) if alone else _read(batches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for batch in batches:
            side = np.asarray(batch["side"])
            for k in (0, 1):
                if (side == k).any():
                    sides[k].append(batch.filter(pa.array(side == k)))
        if not sides[1] or not (sides[0] or alone):
            return
        b, a = (read(x) if x else None for x in (sides[1], sides[0]))
        a = a or b
        if unit:
            b = replace(b, value=np.ones(len(b.value)))
        for rows, dot, matched in _products(a, b, held, most, whole):
            if not sides[0]:
                matched[np.arange(len(b.ids))[None] <= np.arange(rows.start, rows.stop)[:, None]] = 0
            out = emit(a, b, rows, dot, matched)
            # In portions that stay in a core's cache while the JVM reads them.
            for lo in range(0, out.num_rows if out is not None else 0, sent):
                yield out.slice(lo, sent)

    return both.select("cell", "side", *columns).repartitionById(cells, "cell").select("side", *columns).mapInArrow(run, schema)


def codes(first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """(feature_id, number) of the features that both sides have, or that more than one vector of the only side has."""
    if second is None:
        shared = first.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("feature_id")
    else:
        shared = second.select("feature_id").distinct().join(first.select("feature_id").distinct(), "feature_id", "left_semi")
    return numbered(shared, "feature_id")


def packed(first: DataFrame, second: DataFrame | None, value: Column, other: Column | None = None, over: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Both sides (id, feature_id, w, u) packed and written once; the second may be None. `over` is for an only side (`pack`)."""
    known = materialise(codes(first, second), "codes")
    a = materialise(pack(first, known, value, over), "packed", lean=True)
    b = None if second is None else materialise(pack(second, known, value if other is None else other), "packed")
    let_go(known)
    return a, b
