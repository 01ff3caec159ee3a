"""Problem 3: grouping records into similarity clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinscope.llm.common import binary, flat, one, pack_vectors
from kinscope.runtime import materialise

DIMS = 512
SEED_FACTOR = 4.0
SEED_ROUNDS = 3
# k-means ends when a round brings the rows nearer to their centres by less than SETTLED of their mean product, or after ROUNDS.
SETTLED, ROUNDS = 0.01, 12
REST_FACTOR, REST_SEEDS = 16.0, 4_096
# Few rows get a seed for four of them, up to so many: families are small there.
FEW_SEEDS = 2_048
# From so many centres on, seeding and k-means hold a row against those of its PROBES nearest groups of like centres, of
# sqrt(centres) groups. Whether a row fits a family is always decided against all of them.
GROUPED, PROBES = 4_096, 8
# From LED centres on, those that cannot be a row's nearest are told by LEADING axes of the centres; where up to FEW are left,
# these are multiplied one by one. SLACK is above what single precision gets wrong.
LED, LEADING, FEW, SLACK = 256, 128, 12, 1e-5
_ODD = 40_503


def buckets(ix: pa.Array, vx: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of hashed weighted features; the values of a row have length 1.

    A feature's bucket is its number times an odd constant, modulo a power of two: features with numbers below `dims`
    never share a bucket, so cosines are those of the features themselves. Higher numbers wrap round, with a sign.
    """
    axis, counts = flat(ix, "<u2")
    value = flat(vx, "<f4")[0].astype(np.float64)
    row = np.repeat(np.arange(len(counts)), counts)
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=len(counts)))
    sign = np.where(axis.astype(np.int64) // dims % 2 == 0, 1.0, -1.0)
    return row, axis.astype(np.int64) * _ODD % dims, sign * value / np.maximum(norm, 1e-300)[row]


def hashed(ix: pa.Array, vx: pa.Array, dims: int) -> np.ndarray:
    """Dense rows (float32) of `buckets`."""
    row, bucket, value = buckets(ix, vx, dims)
    if not len(row) or flat(ix, "<u2")[0].max() < dims:
        out = np.zeros(len(ix) * dims, np.float32)
        out[row * dims + bucket] = value
        return out.reshape(-1, dims)
    return np.bincount(row * dims + bucket, weights=value, minlength=len(ix) * dims).astype(np.float32).reshape(-1, dims)


def _blocks(t: pa.Table | None, dims: int, rows: int = 8_192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    for lo in range(0, t.num_rows if t is not None else 0, rows):
        part = t.slice(lo, rows).combine_chunks()
        yield part, hashed(part.column("ix").chunk(0), part.column("vx").chunk(0), dims)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre with the greatest product for each row, and that product; the lower number wins a tie."""
    who, best = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    for lo in range(0, len(x), 2048):
        s = x[lo : lo + 2048] @ centres.T
        who[lo : lo + 2048] = s.argmax(axis=1)
        best[lo : lo + 2048] = s[np.arange(len(s)), who[lo : lo + 2048]]
    return who, best


class _Led:
    """Finds what `_nearest` finds, but for products that differ by rounding alone, without most of the products.

    Rows and centres are turned to the principal axes of the centres. Beyond the leading axes a product is at most that of
    the two remainders' lengths, so these axes bound it; a centre whose bound is below a product that is known is left out.
    Rows that keep more than FEW centres are held against all.
    """

    def __init__(self, centres: np.ndarray, axes: np.ndarray) -> None:
        self.used = np.flatnonzero(centres.any(axis=0))
        self.rows, self.axes = np.ascontiguousarray(centres[:, self.used]), np.ascontiguousarray(axes[self.used])
        lead = (self.rows @ self.axes).astype(np.float64)
        rest = np.sqrt(np.maximum((self.rows.astype(np.float64) ** 2).sum(axis=1) - (lead**2).sum(axis=1), 0) + SLACK / 10)
        self.part = np.column_stack([lead, rest]).astype(np.float32)

    @staticmethod
    def axes_of(centres: np.ndarray) -> np.ndarray:
        c = centres.astype(np.float32)
        return np.linalg.eigh((c.T @ c).astype(np.float64))[1][:, ::-1][:, :LEADING].astype(np.float32)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        who, best = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
        for lo in range(0, len(x), 2048):
            row = np.take(x[lo : lo + 2048], self.used, axis=1)
            lead = row @ self.axes
            rest = np.sqrt(np.maximum(np.einsum("ij,ij->i", row, row) - np.einsum("ij,ij->i", lead, lead), 0) + SLACK / 10)
            bound = np.column_stack([lead, rest]) @ self.part.T
            known = np.einsum("ij,ij->i", row, self.rows[bound.argmax(axis=1)]) - SLACK
            near = np.packbits(bound >= known[:, None], axis=1)
            few = np.bitwise_count(near).sum(axis=1, dtype=np.int64) <= FEW
            own, wide = lo + np.flatnonzero(few), near.shape[1]
            if len(own):
                eight = np.flatnonzero(near[few])
                at, bit = np.nonzero(np.unpackbits(near[few].ravel()[eight][:, None], axis=1))
                i, j = eight[at] // wide, eight[at] % wide * 8 + bit
                product = np.einsum("ij,ij->i", row[few][i], self.rows[j])
                first = np.searchsorted(i, np.arange(len(own)))
                best[own] = np.maximum.reduceat(product, first)
                who[own] = np.minimum.reduceat(np.where(product == best[own][i], j, len(self.rows)), first)
            own = lo + np.flatnonzero(~few)
            if len(own):
                who[own], best[own] = _nearest(row[~few], self.rows)
        return who, best


@dataclass
class _Centres:
    """Centres to find the nearest of; where asked for and there are many, by groups of like ones."""

    rows: np.ndarray
    number: np.ndarray
    heads: np.ndarray
    ends: np.ndarray
    axes: np.ndarray | None = None
    led: _Led | None = None

    @staticmethod
    def of(centres: np.ndarray, grouped: bool = False) -> _Centres:
        if not grouped or len(centres) < GROUPED:
            return _Centres(centres, np.arange(len(centres)), centres[:0], np.empty(0, np.int64), _Led.axes_of(centres) if len(centres) >= LED else None)
        unit = _unit(centres)
        heads = unit[np.random.default_rng(len(centres)).choice(len(unit), math.ceil(math.sqrt(len(unit))), replace=False)]
        for _ in range(6):
            who = _nearest(unit, heads)[0]
            used, who = np.unique(who, return_inverse=True)
            order = np.argsort(who, kind="stable")
            heads = _unit(np.add.reduceat(unit[order], np.searchsorted(who[order], np.arange(len(used)))))
        order = np.argsort(who, kind="stable")
        return _Centres(centres[order], order, heads, np.searchsorted(who[order], np.arange(len(heads) + 1)))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`_nearest` among the centres of each row's nearest groups."""
        if self.axes is not None:
            if self.led is None:
                self.led = _Led(self.rows, self.axes)
            return self.led.nearest(x)
        if not len(self.heads):
            return _nearest(x, self.rows)
        who, best = np.full(len(x), len(self.rows)), np.full(len(x), -2, np.float32)
        probes = min(PROBES, len(self.heads))
        group = np.argpartition(-(x @ self.heads.T), probes - 1, axis=1)[:, :probes].ravel()
        order = np.argsort(group, kind="stable")
        cut = np.searchsorted(group[order], np.arange(len(self.heads) + 1))
        row = order // probes
        for g in np.flatnonzero(np.diff(cut)):
            own, lo = row[cut[g] : cut[g + 1]], self.ends[g]
            s = x[own] @ self.rows[lo : self.ends[g + 1]].T
            at = s.argmax(axis=1)
            top, number = s[np.arange(len(own)), at], self.number[lo + at]
            better = (top > best[own]) | ((top == best[own]) & (number < who[own]))
            best[own[better]], who[own[better]] = top[better], number[better]
        return who, best


def _sent(rows: DataFrame, *arrays):
    """Arrays of one row a centre as a broadcast: they go to each executor once, not with every task."""
    return rows.sparkSession.sparkContext.broadcast(arrays)


def _unit(m: np.ndarray) -> np.ndarray:
    return (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _uniform(keys: list[str], seed: int) -> np.ndarray:
    import xxhash

    return (np.array([xxhash.xxh64_intdigest(k, seed=seed) >> 11 for k in keys], np.float64) + 0.5) / 2.0**53


def _seeds(rows: DataFrame, want: int, dims: int, seed: int) -> np.ndarray:
    """Parallel oversampled seeding: each round draws many rows at once, with odds by their squared distance to the centres so far.

    The draw is an exponential race, so one pass suffices: each row gets -ln(u) / distance with u hashed from its key,
    and the lowest win. No row needs to know the sum of all distances, and of a row that cannot win by its -ln(u) the
    distance is not asked.
    """
    centres = np.zeros((0, dims), np.float32)
    each = max(1, -(-want // SEED_ROUNDS))
    for r in range(SEED_ROUNDS + 1):
        take = 1 if r == 0 else each
        sent = _sent(rows, _Centres.of(centres, True) if len(centres) else None)

        def race(it: Iterator[pa.RecordBatch], take=take, r=r, sent=sent) -> Iterator[pa.RecordBatch]:
            t = one(it)
            if t is None:
                return
            centres = sent.value[0]
            drawn = -np.log(_uniform(t.column("key").to_pylist(), seed + r))
            place = np.argsort(drawn, kind="stable")
            # A row has length 1 unless several of its up to 65,536 axes wrap into one bucket; so no distance is above this.
            longest = 1.0 if flat(t.column("ix").chunk(0), "<u2")[0].max(initial=0) < dims else math.sqrt(65_536 / dims)
            most = 1.001 + longest * (float(np.linalg.norm(centres.rows, axis=1).max()) if centres else 0)
            won, race = np.empty(0, np.int64), np.empty(0)
            for lo in range(0, len(place), 1_024):
                at = place[lo : lo + 1_024]
                if len(race) == take and drawn[at[0]] / most > race[-1]:
                    break
                part = t.take(pa.array(at)).combine_chunks()
                x = hashed(part.column("ix").chunk(0), part.column("vx").chunk(0), dims)
                far = np.maximum(1 - centres.nearest(x)[1], 0) if centres else np.ones(len(x))
                won, race = np.concatenate([won, at]), np.concatenate([race, drawn[at] / np.maximum(far, 1e-12)])
                first = np.lexsort((won, race))[:take]
                won, race = won[first], race[first]
            best = t.take(pa.array(won)).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(race), *(best.column(c).chunk(0) for c in ("key", "ix", "vx"))], ["race", "key", "ix", "vx"])

        won = rows.mapInArrow(race, "race double, key string, ix binary, vx binary").orderBy("race", "key").limit(take).toArrow().combine_chunks()
        sent.destroy()
        if won.num_rows:
            centres = np.vstack([centres, hashed(won.column("ix").chunk(0), won.column("vx").chunk(0), dims)])
    return centres


def _sums(rows: DataFrame, centres: np.ndarray, dims: int, at_least: float | np.ndarray, every: bool = False, grouped: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Per centre, the number of rows nearest to it (with a product of at least `at_least`, one bound or one a centre) and their sum; and the sum of all those products.

    With `every`, a row counts for each centre whose bound it reaches, not for the nearest alone. With `grouped`, the nearest
    of many centres is looked for in its nearest groups alone.
    Each task sends one row a centre it met, only with the buckets in use; these are added by a shuffle, not on the
    driver, so what the driver gets is one row a centre.
    """
    bounds = np.broadcast_to(np.asarray(at_least, np.float32), len(centres)).copy()
    sent = _sent(rows, centres if every else _Centres.of(centres, grouped), bounds)
    many = len(centres)

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, bound = sent.value
        total = np.zeros((many, dims), np.float64)
        count = np.zeros(many, np.int64)
        near_by = np.zeros(many)
        for t, x in _blocks(one(it), dims):
            if every:
                for lo in range(0, len(x), 2048):
                    near = x[lo : lo + 2048] @ centres.T >= bound
                    own, c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                    total[c] += near[np.ix_(own, c)].T.astype(np.float32) @ x[lo : lo + 2048][own]
                    count += near.sum(axis=0)
                continue
            who, best = centres.nearest(x)
            keep = best >= bound[who]
            row, bucket, value = buckets(t.column("ix").chunk(0), t.column("vx").chunk(0), dims)
            own = keep[row]
            np.add.at(total.reshape(-1), who[row[own]] * dims + bucket[own], value[own])
            count += np.bincount(who[keep], minlength=many)
            near_by += np.bincount(who[keep], weights=best[keep], minlength=many)
        c = np.flatnonzero(count)
        at, bucket = np.nonzero(total[c])
        size = np.bincount(at, minlength=len(c))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(count[c]), pa.array(near_by[c]), binary(bucket.astype("<u2"), size), binary(total[c][at, bucket].astype("<f4"), size)], names=["c", "n", "p", "ix", "s"])

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = one(it)
        if t is None:
            return
        c, at = np.unique(np.asarray(t.column("c").chunk(0)), return_inverse=True)
        bucket, size = flat(t.column("ix").chunk(0), "<u2")
        total = np.bincount(np.repeat(at, size) * dims + bucket, weights=flat(t.column("s").chunk(0), "<f4")[0], minlength=len(c) * dims).reshape(-1, dims)
        n, p = (np.bincount(at, weights=np.asarray(t.column(k).chunk(0))) for k in "np")
        at, bucket = np.nonzero(total)
        size = np.bincount(at, minlength=len(c))
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n.astype(np.int64)), pa.array(p), binary(bucket.astype("<u2"), size), binary(total[at, bucket].astype("<f4"), size)], names=["c", "n", "p", "ix", "s"])

    kind = "c int, n bigint, p double, ix binary, s binary"
    got = rows.mapInArrow(part, kind).repartition("c").mapInArrow(add, kind).toArrow().combine_chunks()
    sent.destroy()
    if not got.num_rows:
        return np.zeros(0), np.zeros((0, dims)), 0.0
    order = np.argsort(np.asarray(got.column("c").chunk(0)))
    bucket, size = flat(got.column("ix").chunk(0), "<u2")
    total = np.zeros((len(order), dims))
    total[np.repeat(np.arange(len(order)), size), bucket] = flat(got.column("s").chunk(0), "<f4")[0]
    return np.asarray(got.column("n").chunk(0))[order].astype(np.float64), total[order], float(np.asarray(got.column("p").chunk(0)).sum())


def _closest(mean: np.ndarray, rows: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the groups `rows` the greatest product with another of the groups `among`, and that group; a bounded block of products at a time."""
    top, arg = np.full(len(rows), -2, np.float32), np.zeros(len(rows), np.int64)
    if not len(among):
        return top, arg
    other = mean[among]
    step = max(1, (1 << 24) // len(among))
    for lo in range(0, len(rows), step):
        own = rows[lo : lo + step]
        s = mean[own] @ other.T
        at = np.searchsorted(among, own).clip(0, len(among) - 1)
        same = np.flatnonzero(among[at] == own)
        s[same, at[same]] = -2
        best = s.argmax(axis=1)
        top[lo : lo + step], arg[lo : lo + step] = s[np.arange(len(own)), best], among[best]
    return top, arg


def agglomerate(count: np.ndarray, total: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Joins groups by average linkage while the average cosine between two groups' members is at least `threshold`.

    The average cosine between two groups of unit vectors is the product of their means, so groups are told by count and
    sum alone and the result is that of average linkage over all members. Two groups that are each other's nearest join
    sooner or later in any order, as no join brings a third group nearer than both were; so all such pairs join in one
    round. No matrix of all groups is held, only the nearest other group of each.
    """
    used = np.flatnonzero(count > 0)
    count, total = count[used].astype(np.float64), total[used].astype(np.float64)
    mean = (total / count[:, None]).astype(np.float32)
    live = np.arange(len(count))
    alive = np.ones(len(count), bool)
    top, arg = _closest(mean, live, live)
    while True:
        near = live[top[live] >= threshold]
        i = near[(arg[arg[near]] == near) & (near < arg[near])]
        if not len(i):
            if not len(near):
                break
            # Equal products may leave no pair that is each other's first choice.
            i = near[[top[near].argmax()]]
        j = arg[i]
        i, j = np.minimum(i, j), np.maximum(i, j)
        count[i] += count[j]
        total[i] += total[j]
        mean[i] = total[i] / count[i, None]
        alive[j] = False
        live = np.flatnonzero(alive)
        gone = np.zeros(len(alive), bool)
        gone[i] = gone[j] = True
        stale = live[gone[live] | gone[arg[live]]]
        top[stale], arg[stale] = _closest(mean, stale, live)
        rest = live[~(gone[live] | gone[arg[live]])]
        new, which = _closest(mean, rest, i)
        better = new > top[rest]
        top[rest[better]], arg[rest[better]] = new[better], which[better]
    return count[alive], total[alive]


def _found(rows: DataFrame, want: int, dims: int, threshold: float, least: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, means) of the families that one run of seeding, k-means and joining finds among the rows."""
    centres = _seeds(rows, want, dims, seed)
    count, total, before = np.zeros(0), np.zeros((0, dims)), None
    for _ in range(ROUNDS):
        count, total, near = _sums(rows, centres, dims, -1.0, grouped=True)
        if before is not None and near - before < SETTLED * abs(before):
            break
        centres, before = _unit(total), near
    size, means = _joined(count, total, threshold, least)
    # Every row to the nearest mean, if it fits there, until the families stay: rows that only a split centre had drawn in fall out.
    for _ in range(ROUNDS):
        if not len(means):
            break
        before = size
        size, means = _joined(*_sums(rows, means, dims, threshold)[:2], threshold, least)
        if len(size) == len(before) and np.abs(np.sort(size) - np.sort(before)).sum() <= SETTLED * size.sum():
            break
    return size, means


def _drawn(rows: DataFrame, last: tuple[int, str] | None, dims: int) -> tuple[np.ndarray, tuple[int, str] | None]:
    """The next REST_SEEDS rows after `last` in the order of their hashed keys, and the place of the last of them."""
    hashes = rows.withColumn("h", F.xxhash64("key"))
    if last is not None:
        hashes = hashes.where((F.col("h") > last[0]) | ((F.col("h") == last[0]) & (F.col("key") > last[1])))
    t = hashes.orderBy("h", "key").limit(REST_SEEDS).toArrow().combine_chunks()
    if not t.num_rows:
        return np.zeros((0, dims), np.float32), None
    return hashed(t.column("ix").chunk(0), t.column("vx").chunk(0), dims), (t.column("h")[-1].as_py(), t.column("key")[-1].as_py())


def _around(rows: DataFrame, seeds: np.ndarray, dims: int, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, means) of the families among the neighbourhoods of the seeds: of each one, whatever the others are.

    The members of a family have an average of at least `threshold` to the others, so each has a neighbour at
    `threshold`. The rows that near to a seed are its neighbourhood; those unlike the average of it fall out in two passes.
    """
    count, total, _ = _sums(rows, seeds, dims, threshold, every=True)
    size, means = count[count > 1], (total[count > 1] / count[count > 1, None]).astype(np.float32)
    for strict in (False, True):
        if not len(means):
            return np.zeros(0), np.zeros((0, dims), np.float32)
        count, total, _ = _sums(rows, means, dims, _member(size, threshold) if strict else threshold, every=True)
        # Seeds of one family have the same neighbourhood by now, or nearly.
        _, first = np.unique(np.round(np.column_stack([count, total]), 4), axis=0, return_index=True)
        first = np.sort(first[count[first] >= least])
        size, means = count[first], (total[first] / count[first, None]).astype(np.float32)
    own = ((total[first] ** 2).sum(axis=1) - size) / np.maximum(size * (size - 1), 1)
    size, means = size[own >= threshold], means[own >= threshold]
    # Neighbourhoods share rows: of those that would join only the largest stays, and each row then counts for the nearest.
    kept: list[int] = []
    for k in np.argsort(-size, kind="stable"):
        if not kept or (means[kept] @ means[k]).max() < threshold:
            kept.append(int(k))
    size, means = size[kept], means[kept]
    return _joined(*_sums(rows, means, dims, _member(size, threshold))[:2], threshold, least) if len(means) else (size, means)


def _joined(count: np.ndarray, total: np.ndarray, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, means) of the families that the groups join to."""
    if not len(count):
        return count, np.zeros((0, total.shape[1]), np.float32)
    count, total = agglomerate(count, total, threshold)
    # The members of a family are alike among themselves: a member's product with itself is left out of the average.
    own = ((total**2).sum(axis=1) - count) / np.maximum(count * (count - 1), 1)
    big = (count >= least) & (own >= threshold)
    return count[big], (total[big] / count[big, None]).astype(np.float32)


def _member(size: np.ndarray, threshold: float) -> np.ndarray:
    """The product with its family's mean, itself included, at which a member's average to the other members is the threshold."""
    return threshold + (1 - threshold) / np.maximum(size, 1)


def families(df: DataFrame, key: str, vec: str, stamp: str, *, threshold: float = 0.36, least: int = 5, dims: int = DIMS, seed_factor: float = SEED_FACTOR) -> DataFrame:
    """(key, lead, typicality, size): every key whose current vector belongs to a family; lead is the family's lowest key.

    Vectors are hashed weighted features (`hashed`). k-means with parallel oversampled seeding splits them into
    seed_factor * sqrt(rows) centres (at least a quarter of the rows, up to FEW_SEEDS), in rounds until they settle (SETTLED). Centres then join by average cosine, exactly
    as average linkage would, while it is at least `threshold`; every row then goes to the nearest family mean of at least
    `threshold`, until the families stay. The rows left over go through the same again, with relatively more seeds, until a round finds no family.
    Then every row still left over is held against its own neighbourhood among them, REST_SEEDS at a time, until a sweep
    over all of them finds no further family of `least` rows: at every size alike, and quadratic in the rows left over.
    typicality is the cosine to the family's centre.
    Rows that fit no family are left out, as are null, all-zero and non-finite vectors. The driver holds the count and sum
    of each centre and family, in broadcasts as well, and no product of all centres with all.
    Equal rows fall into the same family; an empty table gives no rows. Keys are compared as strings.
    """
    packed = materialise(pack_vectors(df.withColumn(key, F.col(key).cast("string")), key, vec, stamp).select("key", "ix", "vx"), "family-vectors")
    rest, size, means = packed, np.zeros(0), np.zeros((0, dims), np.float32)
    n, r = packed.count(), 0

    def outside(rows: DataFrame, means: np.ndarray, bound: np.ndarray, n: int) -> tuple[DataFrame, int]:
        """The rows that fit none of the families, and their number."""

        sent = _sent(rows, _Centres.of(means) if len(means) else None, bound)

        def left(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            means, bound = sent.value
            for t, x in _blocks(one(it), dims):
                if means:
                    who, best = means.nearest(x)
                    t = t.filter(pa.array(best < bound[who]))
                yield from t.combine_chunks().to_batches()

        rows = materialise(rows.mapInArrow(left, "key string, ix binary, vx binary").coalesce(max(1, n // 20_000)), "family-rest")
        sent.destroy()
        return rows, rows.count()

    want = max(math.ceil(seed_factor * math.sqrt(n)), min(n // 4, FEW_SEEDS))
    while n >= least:
        own, new = _found(rest, min(n, max(16, want)), dims, threshold, least, 1000 * r)
        if r and len(new):
            # Few rows, so that a stray one weighs much: those unlike the others of their family fall out before it counts as one.
            own, new = _joined(*_sums(rest, new, dims, _member(own, threshold))[:2], threshold, least)
        if r and not len(new):
            break
        size, means, before = np.concatenate([size, own]), np.vstack([means, new]), n
        (rest, n), r = outside(rest, new, _member(own, threshold), n), r + 1
        if r > 1 and n == before:
            break
        want = max(math.ceil(REST_FACTOR * math.sqrt(n)), min(n // 2, REST_SEEDS))
    # Drawn seeds miss small families among many rows, so every row left over is a seed once, a bounded number at a time.
    last, found = None, False
    while n >= least:
        seeds, last = _drawn(rest, last, dims)
        if last is None:
            if not found:
                break
            # Rows seen before the last find may have lost neighbours that hid a family.
            found = False
            continue
        own, new = _around(rest, seeds, dims, threshold, least)
        if len(new):
            before = n
            rest, n = outside(rest, new, _member(own, threshold), n)
            if n < before:
                size, means, found = np.concatenate([size, own]), np.vstack([means, new]), True
    if len(means):
        # Families of different rounds meet here, and every row is held against all of them.
        size, means = _joined(*_sums(packed, means, dims, _member(size, threshold))[:2], threshold, least)
    if not len(means):
        return packed.select("key", F.lit("").alias("lead"), F.lit(0.0).alias("typicality"), F.lit(0).cast("bigint").alias("size")).limit(0)

    sent = _sent(packed, _Centres.of(means), _member(size, threshold), np.maximum(np.linalg.norm(means, axis=1), 1e-12))

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, bound, norm = sent.value
        for t, x in _blocks(one(it), dims):
            who, best = means.nearest(x)
            keep = np.flatnonzero(best >= bound[who])
            yield pa.RecordBatch.from_arrays([t.column("key").chunk(0).take(pa.array(keep)), pa.array(who[keep].astype(np.int32)), pa.array((best / norm[who])[keep].astype(np.float64))], names=["key", "family", "typicality"])

    own = materialise(packed.mapInArrow(assign, "key string, family int, typicality double"), "family-members")
    sent.destroy()
    named = own.groupBy("family").agg(F.min("key").alias("lead"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return own.join(named, "family").select("key", "lead", "typicality", "size")


def typical_members(members: DataFrame, top: int = 5) -> DataFrame:
    """(lead, size, rank, key, typicality): the `top` members nearest to each family's centre; ties by key."""
    from pyspark.sql import Window

    ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy("lead").orderBy(F.desc(F.round("typicality", 6)), "key")))
    return ranked.where(F.col("rank") <= top).select("lead", "size", "rank", "key", F.round("typicality", 6).alias("typicality"))
