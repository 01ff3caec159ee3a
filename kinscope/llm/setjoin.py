"""Problem 5: all similar pairs between set-valued records, by a size-aware overlap join."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinscope.llm.common import offsets_of, one
from kinscope.runtime import materialise, spread

SMALL, MIDDLE = 9, 128
HOT = 32_768
# Lists that are split number at most so many: of longer tables only longer lists are split.
MOST_HOT = 1 << 20
HEAVY_SHARE = 512


def _mix(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of several columns of 64-bit words."""
    h = np.full(parts[0].shape, 0x9E3779B97F4A7C15, dtype=np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _keys(n: int, t: Fraction) -> list[tuple[int, ...]]:
    """Which places of a set of n tokens, rarest first, make its keys.

    A small set gives all subsets as large as the overlap that some partner size asks for; two small sets above the
    threshold share one of them. A set that can have a larger partner gives its list keys: two sets that share at least
    ceil(t * n) tokens share k of the first n - ceil(t * n) + k. Lists are of pairs of tokens where the larger set has up
    to MIDDLE tokens, and of single tokens beyond, where pairs would be too many.
    """
    need = lambda m: ceil(t * (n + m) / (1 + t))
    out: list[tuple[int, ...]] = []
    low, high = ceil(t * n), floor(n / t)
    if n <= SMALL:
        out += [c for o in sorted({need(m) for m in range(low, min(high, SMALL) + 1)}) if o <= n for c in combinations(range(n), o)]
    if high > SMALL and n <= MIDDLE:
        out += list(combinations(range(min(n, n - low + 2)), min(2, n)))
    if high > MIDDLE:
        out += [(i,) for i in range(n - low + 1)]
    return out


def _key_rows(shared, t: Fraction, full: bool):
    """Arrow function: sets to key rows. `full` adds what the scan needs, and spreads keys of hot lists over a grid.

    shared: a broadcast of (heavy tokens, how often they come, hot keys, into how many chunks these are split).
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, weight, hot, hot_parts = shared.value
        for b in it:
            lists = b.column("tokens")
            off = offsets_of(lists)
            tok = np.asarray(lists.values, dtype=np.int64)[off[0] : off[-1]]
            size = np.diff(off)
            row = np.repeat(np.arange(len(size)), size)
            at = np.searchsorted(heavy, tok)
            at[at == len(heavy)] = 0
            df = np.where(heavy[at] == tok, weight[at], 0) if len(heavy) else np.zeros(len(tok), np.int64)
            tok = tok[np.lexsort((tok, df, row))].view(np.uint64)
            start = off[:-1] - off[0]
            sketch = np.bitwise_xor.reduceat(np.uint64(1) << (tok >> np.uint64(58)), start) if len(tok) else np.empty(0, np.uint64)
            for n in np.unique(size):
                places = _keys(int(n), t)
                if not places:
                    continue
                rows = np.flatnonzero(size == n)
                words = tok[start[rows][:, None] + np.arange(n)]
                by_length: dict[int, list[tuple[int, ...]]] = {}
                for p in places:
                    by_length.setdefault(len(p), []).append(p)
                for length, group in by_length.items():
                    pick = np.array(group)
                    for lo in range(0, len(rows), max(1, (1 << 20) // len(group))):
                        part = slice(lo, lo + max(1, (1 << 20) // len(group)))
                        w = words[part]
                        key = _mix(np.full((len(w), len(group)), length, np.uint64), *[w[:, pick[:, k]] for k in range(length)]).view(np.int64).ravel()
                        who = np.repeat(rows[part], len(group))
                        # A key of one token has its place: what comes before it is not shared, if it is the first one shared.
                        place = np.tile(pick[:, 0] if length == 1 and n > SMALL else np.zeros(len(group), np.int64), len(w))
                        if not full:
                            yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])
                            continue
                        cell = np.zeros(len(key), np.int64)
                        if len(hot):
                            k = np.searchsorted(hot, key)
                            k[k == len(hot)] = 0
                            is_hot = hot[k] == key
                            s = np.where(is_hot, hot_parts[k], 1)
                            chunk = _mix(np.asarray(b.column("mark"), dtype=np.int64)[who].view(np.uint64)).astype(np.int64) & 0x7FFFFFFF
                            chunk %= s
                            again = np.repeat(np.arange(len(key)), s)
                            other = np.arange(len(again)) - np.repeat(np.cumsum(s) - s, s)
                            mine = chunk[again]
                            low, high = np.minimum(mine, other), np.maximum(mine, other)
                            cell = (low << 40) | (high << 16) | (mine == high).astype(np.int64) << 1 | (mine == low)
                            key, who, place = key[again], who[again], place[again]
                        else:
                            cell = np.full(len(key), 3, np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cell >> 16), pa.array((cell & 3).astype(np.int8)), b.column("mark").take(pa.array(who)), pa.array((size[who] * 2 + np.asarray(b.column("left"))[who]).astype(np.int32)), pa.array(sketch[who].view(np.int64)), pa.array(place.astype(np.int32))], names=["key", "cell", "side", "mark", "size", "sketch", "place"])

    return run


def _scan(t: Fraction):
    """Arrow function: all lists of a task; gives the pairs that may reach the threshold.

    Sketches differ in no more bits than the threshold lets sets differ, and what follows the shared token in both sets
    is enough for the overlap that their sizes ask for.
    """
    num, den = t.denominator - t.numerator, t.denominator + t.numerator

    def fits(xa, xb, sa, sb, pa_, pb) -> np.ndarray:
        na, nb = sa >> 1, sb >> 1
        total = na + nb
        return (np.bitwise_count(xa ^ xb).astype(np.int32) * den <= total * num) & ((sa | sb) & 1 == 1) & (np.minimum(na - pa_, nb - pb).astype(np.int64) * den >= total.astype(np.int64) * t.numerator)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = one(it)
        if table is None:
            return
        get = lambda c: table.column(c).chunk(0)
        key, cell, side, size, place = (np.asarray(get(c)) for c in ("key", "cell", "side", "size", "place"))
        sketch = np.asarray(get("sketch")).view(np.uint64)
        marks, code = np.unique(np.asarray(get("mark")), return_inverse=True)
        code = code.astype(np.int64)
        order = np.lexsort((code, size >> 1, cell, key))
        key, cell, side, size, sketch, code, place = (x[order] for x in (key, cell, side, size, sketch, code, place))
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]), True])
        found: list[np.ndarray] = []
        held = 0

        def put(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal found, held
            a, b = code[i], code[j]
            found.append(np.minimum(a, b) << 32 | np.maximum(a, b))
            held += len(i)
            if held > 1 << 22:
                found = [np.unique(np.concatenate(found))]
                held = len(found[0]) // 2

        count = np.diff(cut)
        for g in np.unique(count[(count > 1) & (count <= 48)]):
            i, j = np.triu_indices(g, 1)
            starts = cut[:-1][count == g]
            for lo in range(0, len(starts), max(1, (1 << 19) // len(i))):
                s = starts[lo : lo + max(1, (1 << 19) // len(i))][:, None]
                a, b = (s + i).ravel(), (s + j).ravel()
                # In a grid cell of two chunks only pairs across them count; elsewhere every row has both sides.
                ok = fits(sketch[a], sketch[b], size[a], size[b], place[a], place[b]) & ((side[a] | side[b]) == 3)
                put(a[ok], b[ok])
        for k in np.flatnonzero(count > 48):
            lo, hi = cut[k], cut[k + 1]
            for x in range(lo, hi, 512):
                a = slice(x, min(x + 512, hi))
                # Rows ascend in size: beyond the largest partner of the block's largest set there is nothing to find.
                top = np.searchsorted(size[lo:hi] >> 1, (size[a.stop - 1] >> 1) / float(t) + 1e-9, "right") + lo
                for y in range(x, top, 4096):
                    b = slice(y, min(y + 4096, top))
                    ok = fits(sketch[a, None], sketch[None, b], size[a, None], size[None, b], place[a, None], place[None, b]) & ((side[a, None] | side[None, b]) == 3)
                    i, j = np.nonzero(ok)
                    i, j = i + a.start, j + b.start
                    put(i[i < j], j[i < j])
        if found:
            pairs = np.unique(np.concatenate(found))
            for lo in range(0, len(pairs), 1 << 16):
                p = pairs[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(marks[p >> 32]), pa.array(marks[p & 0xFFFFFFFF])], names=["x", "y"])

    return run


def similar_sets(left: DataFrame, right: DataFrame | None = None, *, threshold: float = 0.8, min_size: int = 1, list_rows: int = HOT) -> tuple[DataFrame, DataFrame]:
    """All pairs of sets with shared / united >= threshold: within `left`, and between `right` and `left` where given.

    Inputs are (id string, ids array<string>); repeated ids in a list count once. Gives (links, members):
    members = (rep, part, id), part 'l' or 'r': records with equal sets form a class, named by its least part and id;
    links = (rep_a, rep_b, shared, united) between different classes, no link between classes of `right` only.
    Records of one class are linked by being in it. `expand_pairs` turns both into pairs of records.

    Small sets meet in their threshold-sized subsets; large sets scan inverted lists, keyed by their rarest tokens: pairs
    of them up to MIDDLE tokens, single ones beyond, with the bounds of length and place. Lists above `list_rows` are
    split into a grid of chunk pairs, so no task scans more than two chunks of a list at once. The scan compares 64-bit
    sketches, a lower bound of the sets' difference, so it loses nothing; survivors are checked on the sets themselves.
    Nothing is capped or sampled.
    Null ids, null lists, null items and sets below `min_size` link nothing; an empty table gives no rows; exactly
    `threshold` counts. Repeats of a whole row change nothing; an id with several different sets is linked by each.
    """
    t = Fraction(str(threshold))
    parts = left.select(F.lit("l").alias("part"), F.col("id").cast("string").alias("id"), "ids")
    if right is not None:
        parts = parts.unionByName(right.select(F.lit("r").alias("part"), F.col("id").cast("string").alias("id"), "ids"))
    ids = F.array_sort(F.array_distinct(F.filter("ids", lambda x: x.isNotNull())))
    parts = parts.select("part", "id", ids.alias("ids")).where(F.col("id").isNotNull() & (F.size("ids") >= min_size))
    parts = materialise(parts.withColumn("h", F.xxhash64("ids")), "set-records")
    tag = F.concat("part", "id")
    grouped = parts.groupBy("h", "ids").agg(F.min(tag).alias("rep"), F.max(F.when(F.col("part") == "l", 1).otherwise(0)).alias("left"))
    sets = materialise(grouped.select("rep", "ids", "left", F.xxhash64("rep").alias("mark"), F.transform("ids", lambda x: F.xxhash64(x)).alias("tokens")), "sets")
    sizes = [(r["n"], r["count"]) for r in sets.groupBy(F.size("ids").alias("n")).count().collect()]
    n, keys = sum(c for _, c in sizes), sum(c * len(_keys(size, t)) for size, c in sizes)
    # A token in one of 512 sets or more is heavy. At most 512 times the mean set size tokens can be, whatever the data.
    heavy = sorted(sets.select(F.explode("tokens").alias("t")).groupBy("t").count().where(F.col("count") * HEAVY_SHARE >= max(n, 1)).collect())
    tokens, weight = np.array([r[0] for r in heavy], np.int64), np.array([r[1] for r in heavy], np.int64)
    none = np.empty(0, np.int64)
    sc, source = sets.sparkSession.sparkContext, sets.select("rep", "left", "mark", "tokens")
    # Lists above `list_rows` number at most keys / list_rows, so at most MOST_HOT of 16 bytes.
    list_rows = max(list_rows, -(-keys // MOST_HOT))
    hot = sorted(source.mapInArrow(_key_rows(sc.broadcast((tokens, weight, none, none)), t, False), "key bigint").groupBy("key").count().where(F.col("count") > list_rows).collect())
    shared = sc.broadcast((tokens, weight, np.array([r[0] for r in hot], np.int64), np.array([-(-r[1] // list_rows) for r in hot], np.int64)))
    rows = source.mapInArrow(_key_rows(shared, t, True), "key bigint, cell bigint, side tinyint, mark bigint, size int, sketch bigint, place int")
    # Sets go by their marks until they are checked: sets that share a mark are all checked, so nothing rests on marks being unique.
    pairs = spread(rows, "key", "cell").mapInArrow(_scan(t), "x bigint, y bigint").distinct()
    a = sets.select(F.col("mark").alias("x"), F.col("rep").alias("rep_x"), F.col("ids").alias("ids_x"))
    b = sets.select(F.col("mark").alias("y"), F.col("rep").alias("rep_y"), F.col("ids").alias("ids_y"))
    checked = pairs.join(a, "x").join(b, "y").where("x <> y or rep_x < rep_y").withColumn("shared", F.size(F.array_intersect("ids_x", "ids_y")).cast("bigint"))
    checked = checked.withColumn("united", F.size("ids_x") + F.size("ids_y") - F.col("shared")).where(F.col("shared") * t.denominator >= F.col("united") * t.numerator)
    links = checked.select(F.least("rep_x", "rep_y").alias("rep_a"), F.greatest("rep_x", "rep_y").alias("rep_b"), "shared", "united")
    members = parts.join(sets.select(F.xxhash64("ids").alias("h"), F.col("ids").alias("own"), "rep"), "h").where("ids = own").select("rep", "part", "id").distinct()
    return links, members


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(left_id, right_id), smaller first: every linked pair of records, those of one class included, but none of two records of part 'r'.

    Only classes that have a link or more than one record take part in the joins.
    """
    own = members.select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")).groupBy("rep_a", "rep_b").count().where("count > 1").drop("count")
    both = links.select("rep_a", "rep_b").unionByName(own)
    x = members.select(F.col("rep").alias("rep_a"), F.col("part").alias("part_a"), F.col("id").alias("a"))
    y = members.select(F.col("rep").alias("rep_b"), F.col("part").alias("part_b"), F.col("id").alias("b"))
    pairs = both.join(x, "rep_a").join(y, "rep_b").where("(rep_a <> rep_b or (part_a = part_b and a < b) or part_a < part_b) and (part_a = 'l' or part_b = 'l')")
    return pairs.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")).distinct()
