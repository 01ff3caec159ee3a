"""Problem 1: the most similar vectors of every vector, by shifted space-filling curves."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinscope.llm.common import binary, dense, flat, one, pack_vectors
from kinscope.runtime import materialise

AXES, BITS = 8, 6
ORDERINGS, LOCAL_ORDERINGS = 2, 3
# Vectors are ordered by the place of their nearest centre first: so many for the table, and for a range.
CENTRES, LOCAL_CENTRES, LOCAL_SAMPLE = 512, 128, 4_096
TASK_ROWS, WINDOW, BLOCK, CELLS = 49_152, 256, 256, 64
SAMPLE_ROWS = 20_000
SEPARATOR = "\x1f"


def hilbert(q: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points, one row a point, by John Skilling's transposed form."""
    x = q.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[n - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _principal(x: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(axis=0)
    c = (x - mean).T @ (x - mean)
    _, e = np.linalg.eigh(c.astype(np.float64))
    return mean, np.ascontiguousarray(e[:, ::-1][:, :components]).astype(np.float32)


def _centres(x: np.ndarray, count: int, seed: int, rounds: int = 4) -> np.ndarray:
    """Unit centres of a sample of unit rows, by a few rounds of k-means."""
    c = x[np.random.default_rng(seed).choice(len(x), min(count, len(x)), replace=False)].copy()
    for _ in range(rounds):
        who = _owner(x, c)
        total = np.zeros_like(c)
        np.add.at(total, who, x)
        size = np.linalg.norm(total, axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def _owner(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The centre nearest to each row."""
    width = min(x.shape[1], c.shape[1])
    return np.concatenate([(x[lo : lo + 8192, :width] @ c[:, :width].T).argmax(axis=1) for lo in range(0, len(x), 8192)] or [np.empty(0, np.int64)])


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The place of each key among the sorted ones."""
    out = np.empty(len(keys), np.int64)
    out[np.argsort(keys, kind="stable")] = np.arange(len(keys))
    return out


def _axes(r: int, z: np.ndarray) -> np.ndarray:
    """The principal axes of the r-th curve: the next eight, so that each curve tells apart what those before could not."""
    n = z.shape[1]
    return z[:, [(r * AXES + i) % n for i in range(min(AXES, n))]]


def _grid(y: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int) -> np.ndarray:
    """Shifted integer coordinates: the middle four fifths of the curve's cube, moved by a seeded shift."""
    shift = np.random.default_rng(seed + 1).uniform(0, 0.2, size=y.shape[1])
    unit = (y - low) / np.maximum(high - low, 1e-9) * 0.8 + shift
    return np.clip((unit * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def _hash(keys: pa.Array) -> np.ndarray:
    """15 bits of each key, to order rows that fall on one place of the curve."""
    d = keys.dictionary_encode()
    import xxhash

    own = np.array([xxhash.xxh32_intdigest(str(k)) & 0x7FFF for k in d.dictionary.to_pylist()], np.int64)
    return own[np.asarray(d.indices)] if len(own) else np.empty(0, np.int64)


@dataclass
class _Curves:
    """The projection, fitted on a bounded sample, and of every ordering the places where its ranges begin, and where their outer parts end and begin."""

    mean: np.ndarray
    basis: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    centres: list[np.ndarray]
    order: list[np.ndarray]
    bounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def project(self, x: np.ndarray) -> np.ndarray:
        width = min(x.shape[1], len(self.mean))
        return x[:, :width] @ self.basis[:width] - self.mean @ self.basis

    def place(self, s: int, x: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """63 bits: the place of the row's nearest centre on the curve, then the row's own, then its salt."""
        y = _axes(s, self.project(x))
        own = hilbert(_grid(y, self.low[s], self.high[s], 200 + s), BITS) >> 10
        return self.order[s][_owner(x, self.centres[s])] << 53 | own << 15 | salt

    @staticmethod
    def fit(x: np.ndarray, orderings: int) -> _Curves:
        mean, basis = _principal(x, AXES * orderings)
        c = _Curves(mean, basis, [], [], [], [], [(np.empty(0, np.int64),) * 3] * orderings)
        z = c.project(x)
        for s in range(orderings):
            low, high = np.quantile(_axes(s, z), [0.001, 0.999], axis=0)
            c.low.append(low)
            c.high.append(high)
            c.centres.append(_centres(x, CENTRES, 300 + s))
            y = _axes(s, c.project(c.centres[s]))
            c.order.append(_ranks(hilbert(_grid(y, *np.quantile(y, [0.001, 0.999], axis=0), 200 + s), BITS)))
        return c

    def measure(self, rows: DataFrame, n: int, parts: int) -> None:
        """Sets the bounds of `parts` even ranges out of the places of all n rows.

        The places alone are sorted by ranges of Spark's own. Each task gives their number and every step-th of them,
        where a step is half a range's outer part; with the numbers before it the rank of these in the whole table is
        known. So the driver gets 2 * CELLS places a range, and a bound is off by less than a step.
        """
        if parts < 2:
            return
        orderings, sent = len(self.low), rows.sparkSession.sparkContext.broadcast(self)
        even = -(-n // parts)
        edge = max(1, even // CELLS)
        step = max(1, edge // 2)

        def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                if b.num_rows:
                    x, salt = dense(b.column("ix"), b.column("vx"), int(flat(b.column("ix"), "<u2")[0].max()) + 1), _hash(b.column("key"))
                    for s in range(orderings):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), s, np.int32)), pa.array(sent.value.place(s, x, salt))], names=["s", "place"])

        def picked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, held = [0] * orderings, [[] for _ in range(orderings)]
            for b in it:
                which, place = np.asarray(b.column("s")), np.asarray(b.column("place"))
                for s in np.unique(which):
                    own = place[which == s]
                    held[s].append(own[-seen[s] % step :: step])
                    seen[s] += len(own)
            yield pa.RecordBatch.from_arrays([pa.array(range(orderings), pa.int32()), pa.array(seen, pa.int64()), pa.array([np.concatenate(h) if h else np.empty(0, np.int64) for h in held], pa.list_(pa.int64()))], names=["s", "n", "places"])

        keyed = materialise(rows.mapInArrow(places, "s int, place bigint"), "places")
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = keyed.repartitionByRange(tasks, "s", "place").sortWithinPartitions("s", "place")
        got = ranges.mapInArrow(picked, "s int, n bigint, places array<bigint>").where("n > 0").toArrow().combine_chunks()
        which, many = np.asarray(got.column("s")), np.asarray(got.column("n"))
        for s in range(orderings):
            # Ranges of places do not overlap, so the first place tells a task's turn.
            own = sorted(((np.asarray(got.column("places")[int(i)].values), int(many[i])) for i in np.flatnonzero(which == s)), key=lambda x: x[0][0])
            before = np.cumsum([0, *(m for _, m in own[:-1])])
            place = np.concatenate([p for p, _ in own])
            rank = np.concatenate([b + step * np.arange(len(p)) for b, (p, _) in zip(before, own)])
            at = lambda r: place[np.searchsorted(rank, r, "right") - 1]  # noqa: B023, E731
            firsts = np.arange(0, n, even)
            end = np.iinfo(np.int64).max
            self.bounds[s] = (at(firsts[1:]), at(firsts + edge), np.where(firsts + even < n, at(np.minimum(firsts + even - edge, n - 1)), end))

    def spread(self, s: int, x: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, partition, guest): each row goes to the partition of its range; rows of a range's outer parts also visit the neighbour."""
        begin, low, high = self.bounds[s]
        rows = np.arange(len(x))
        if not len(begin):
            return rows, np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        place = self.place(s, x, salt)
        part = np.searchsorted(begin, place, "right")
        up = rows[(place >= high[part]) & (part < len(begin))]
        down = rows[(place < low[part]) & (part > 0)]
        return np.concatenate([rows, up, down]), np.concatenate([part, part[up] + 1, part[down] - 1]), np.concatenate([np.zeros(len(rows), bool), np.ones(len(up) + len(down), bool)])


class _Best:
    """The k best of each row so far; codes are places in `names`. Equal similarities go to the lower id."""

    def __init__(self, rows: int, k: int, names: pa.Array) -> None:
        self.names, self.rank = names, None
        self.code = np.full((rows, k), -1, np.int64)
        self.sim = np.full((rows, k), -np.inf, np.float32)
        self.k = k

    def add(self, row: np.ndarray, code: np.ndarray, sim: np.ndarray) -> None:
        """Takes in pairs that are not in the lists yet; no pair may come twice in one call."""
        if (self.code[:, 0] >= 0).any():
            new = np.ones(len(row), bool)
            for j in range(self.k):
                new &= self.code[row, j] != code
            row, code, sim = row[new], code[new], sim[new]
        if not len(row):
            return
        flag = np.zeros(len(self.code), bool)
        flag[row] = True
        hit = np.flatnonzero(flag)
        old = self.code[hit].ravel() >= 0
        row = np.concatenate([row, np.repeat(hit, self.k)[old]])
        code = np.concatenate([code, self.code[hit].ravel()[old]])
        sim = np.concatenate([sim, self.sim[hit].ravel()[old]])
        # One sortable number: the row, then the similarity from high to low.
        bits = (-sim).view(np.uint32).astype(np.int64)
        key = row << 32 | np.where(bits >> 31 == 1, bits ^ 0xFFFFFFFF, bits ^ 0x80000000)
        order = np.argsort(key)
        key = key[order]
        if (key[1:] == key[:-1]).any():
            order = self.by_id(order, key, code)
        row, code, sim = row[order], code[order], sim[order]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
        keep = place < self.k
        self.code[hit], self.sim[hit] = -1, -np.inf
        self.code[row[keep], place[keep]] = code[keep]
        self.sim[row[keep], place[keep]] = sim[keep]


    def by_id(self, order: np.ndarray, key: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The order with runs of equal keys put by id. Few runs are sorted one by one; for many, all ids get ranks once."""
        same = key[1:] == key[:-1]
        if self.rank is None and same.sum() <= 2_000:
            order = order.copy()
            begin = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)) == 1)
            end = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)) == -1)
            for lo, hi in zip(begin, end + 1):
                order[lo:hi] = sorted(order[lo:hi].tolist(), key=lambda i: self.names[int(code[i])].as_py())
            return order
        if self.rank is None:
            by_name = np.asarray(pc.sort_indices(self.names))
            self.rank = np.empty(len(by_name), np.int64)
            self.rank[by_name] = np.arange(len(by_name))
        return order[np.lexsort((self.rank[code[order]], key))]


def _windows(x: np.ndarray, code: np.ndarray, best: _Best, exact, seed: int, floor: float = -2.0) -> None:
    """Finds neighbours of a similarity of at least `floor` within one range of a curve: the range is ordered anew by several curves of its own
    centres and principal axes, and on each every vector meets those within `WINDOW` places, or more, by block products."""
    n = len(x)
    if n < 2:
        return
    whole = n <= BLOCK
    sub = x[:: max(1, n // 2000)]
    mean, basis = _principal(sub, AXES * LOCAL_ORDERINGS) if not whole else (None, None)
    z = (x - mean) @ basis if not whole else None
    for r in range(1 if whole else LOCAL_ORDERINGS):
        if whole:
            order = np.arange(n)
        else:
            y = _axes(r, z)
            low, high = np.quantile(y[:: max(1, n // 5000)], [0.001, 0.999], axis=0)
            own = hilbert(_grid(y, low, high, seed + 10 * r), BITS)
            pick = np.random.default_rng(seed + r).choice(n, min(n, LOCAL_SAMPLE), replace=False)
            c = _centres(x[pick], min(LOCAL_CENTRES, n // 4), seed + r)
            yc = ((c - mean) @ basis)[:, : min(AXES, basis.shape[1])]
            centre = _ranks(hilbert(_grid(yc, *np.quantile(yc, [0.001, 0.999], axis=0), seed + r), BITS))
            order = np.lexsort((own, centre[_owner(x, c)]))
        xo, least = x[order], np.maximum(best.sim[order, -1], np.float32(floor))
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo in range(0, n, BLOCK):
            hi = min(lo + BLOCK, n)
            top = min(hi + WINDOW, n)
            # Each pair is multiplied once, and serves both of its ends.
            s = xo[lo:hi] @ xo[lo:top].T
            s[np.arange(hi - lo), np.arange(hi - lo)] = -np.inf
            if s.shape[1] > best.k:
                _raise(least[lo:hi], s, best.k)
                if top > hi:
                    _raise(least[hi:top], s[:, hi - lo :].T, best.k)
            at = np.flatnonzero(s >= least[lo:hi, None])
            i, j = np.divmod(at, s.shape[1])
            got.append((lo + i, lo + j, s.ravel()[at]))
            if top > hi:
                tail = s[:, hi - lo :]
                at = np.flatnonzero(tail >= least[None, hi:top])
                i, j = np.divmod(at, tail.shape[1])
                got.append((hi + j, lo + i, tail[i, j]))
        row, other, sim = (np.concatenate(c) for c in zip(*got))
        row, other = order[row], order[other]
        sim = np.clip(exact(row, other, sim), -1, 1)
        best.add(row, code[other], sim)


def _raise(least: np.ndarray, s: np.ndarray, k: int) -> None:
    """Raises each row's bound to the k-th best of the block, if that is higher: its ties stay in, and no row has more than k others to take in.

    Where the rows have no more than k such others on average, the bounds stay.
    """
    if s.shape[1] >= k and np.count_nonzero(s >= least[:, None]) > k * len(s):
        np.maximum(least, -np.partition(-s, k - 1, axis=1)[:, k - 1], out=least)


def nearest(df: DataFrame, key: str, vec: str, stamp: str, *, k: int = 10, exact_at: tuple[float, ...] = (), at_least: float | None = None, orderings: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """(key, neighbour, similarity): the k most similar current vectors by cosine of every key's current vector.

    Vectors are projected on principal axes fitted on `SAMPLE_ROWS` rows (those with the lowest hashed keys; all rows are
    indexed, and the bounds of the ranges come from all rows) and ordered along `orderings` Hilbert curves (unset, ORDERINGS and one
    more for every tenfold of ranges), each with a shift of its own: first by the place of the
    nearest of CENTRES centres of the sample (others for each curve), so that like vectors stay together however many
    ranges there are, then by the vector's own place over eight further axes. An ordering is one
    shuffle: rows go to range partitions of about `task_rows`, the outermost cells of a range to its neighbour as well.
    Within a range, curves of the range's own centres and axes give the windows in which vectors are compared exactly;
    each vector's list travels on with it to the next ordering, so no pair of vectors is ever shuffled.
    Keys of equal vectors share one representative in the curves and are put back at the end, so a vector that a third
    of all keys have costs no more. Ties go to the lower key.
    At a similarity in `exact_at` values that float32 cannot tell from it are decided in double precision.
    `at_least` keeps only neighbours of that similarity or more (of the k best).
    Null, all-zero and non-finite vectors have no neighbours and are none; fewer than k others give fewer rows;
    an empty table gives none. Keys are compared as strings. Other columns are ignored.
    """
    packed = materialise(pack_vectors(df.withColumn(key, F.col(key).cast("string")), key, vec, stamp), "vectors")
    packed = packed.withColumn("h", F.xxhash64("ix", "vx")).withColumn("g", F.xxhash64("vx", "ix", F.lit(1)))
    classes = materialise(packed.groupBy("h", "g").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g", "rep"), "equal-vectors")
    equal = not classes.isEmpty()
    members = packed.select("key", "h", "g").join(classes, ["h", "g"]).select("key", "rep")
    rows = packed.select("key", "ix", "vx")
    if equal:
        members = materialise(members, "equal-members")
        rows = rows.join(members.where("key <> rep").select("key"), "key", "left_anti")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS).toArrow()
    if not sample.num_rows:
        return packed.select("key", F.lit("").alias("neighbour"), F.lit(0.0).alias("similarity")).limit(0)
    sample = sample.combine_chunks()
    ix, vx = (sample.column(c).chunk(0) for c in ("ix", "vx"))
    width = int(flat(ix, "<u2")[0].max()) + 1
    parts = max(1, -(-n // task_rows))
    # Each ordering splits some neighbours, the more ranges the more: one ordering more for every tenfold of ranges.
    orderings = orderings or ORDERINGS + math.ceil(math.log10(parts))
    curves = _Curves.fit(dense(ix, vx, width), orderings)
    curves.measure(rows, n, parts)
    # Bounded: the centres of every ordering, and three places a range.
    curves = df.sparkSession.sparkContext.broadcast(curves)
    lists = "nk string, ns binary"

    def send(s: int, x: np.ndarray, cols: list[pa.Array], nk: pa.Array, ns: pa.Array) -> Iterator[pa.RecordBatch]:
        row, part, guest = curves.value.spread(s, x, _hash(cols[0]))
        at = pa.array(row)
        core = int((~guest).sum())
        lists = [pa.concat_arrays([c.take(at[:core]), pa.nulls(len(row) - core, c.type)]) for c in (nk, ns)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(guest), *[c.take(at) for c in cols], *lists], names=["part", "guest", "key", "ix", "vx", "nk", "ns"])

    def start(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                cols = [b.column(c) for c in ("key", "ix", "vx")]
                none = pa.nulls(b.num_rows, pa.string()), pa.nulls(b.num_rows, pa.binary())
                yield from send(0, dense(cols[1], cols[2], int(flat(cols[1], "<u2")[0].max()) + 1), cols, *none)

    def stage(s: int):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = one(it)
            if t is None:
                return
            t = t.sort_by([("part", "ascending"), ("key", "ascending")]).combine_chunks()
            part = np.asarray(t.column("part"))
            for p in np.unique(part):
                lo, hi = np.searchsorted(part, [p, p + 1])
                yield from search(s, t.slice(lo, hi - lo).combine_chunks())

        return run

    def search(s: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, ix, vx, nk, ns = (t.column(c).chunk(0) for c in ("key", "ix", "vx", "nk", "ns"))
        x = dense(ix, vx, int(flat(ix, "<u2")[0].max()) + 1)
        known_sim, count = flat(ns, "<f4")
        known = pc.split_pattern(nk.filter(pa.array(count > 0)), SEPARATOR).flatten()
        d = pa.concat_arrays([keys.cast(pa.string()), known.cast(pa.string())]).dictionary_encode()
        code, names = np.asarray(d.indices).astype(np.int64), d.dictionary
        best = _Best(len(keys), k, names)
        if len(known):
            row = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            best.code[row, place] = code[len(keys) :]
            best.sim[row, place] = known_sim
        axis, many = flat(ix, "<u2")
        value = flat(vx, "<f4")[0].astype(np.float64)
        begin = np.concatenate([[0], np.cumsum(many)])

        def exact(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> np.ndarray:
            for edge in exact_at:
                up = np.float32(edge) if float(np.float32(edge)) >= edge else np.nextafter(np.float32(edge), np.float32(2))
                for i in np.flatnonzero(np.abs(sim - edge) < 1e-5):
                    pa_, pb_ = slice(begin[a[i]], begin[a[i] + 1]), slice(begin[b[i]], begin[b[i] + 1])
                    _, u, v = np.intersect1d(axis[pa_], axis[pb_], assume_unique=True, return_indices=True)
                    true = (value[pa_][u] @ value[pb_][v]) / np.sqrt((value[pa_] @ value[pa_]) * (value[pb_] @ value[pb_]))
                    sim[i] = max(up, np.float32(true)) if true >= edge else min(np.nextafter(up, np.float32(-2)), np.float32(true))
            return sim

        # Of the k best only those of `at_least` come out, so no others need to be found or travel along; what is that near is decided at the end.
        _windows(x, code[: len(keys)], best, exact, 1000 * (s + 1), -2.0 if at_least is None else at_least - 1e-4)
        core = np.flatnonzero(~np.asarray(t.column("guest")))
        have = best.code[core] >= 0
        ends = pa.array(np.concatenate([[0], np.cumsum(have.sum(axis=1))]).astype(np.int32))
        own = pa.ListArray.from_arrays(ends, names.take(pa.array(best.code[core][have])))
        new_k = pc.binary_join(own, SEPARATOR) if s + 1 < orderings else own
        new_s = binary(best.sim[core][have].astype("<f4"), have.sum(axis=1))
        cols = [c.take(pa.array(core)) for c in (keys, ix, vx)]
        if s + 1 < orderings:
            yield from send(s + 1, x[core], cols, new_k, new_s)
        else:
            yield pa.RecordBatch.from_arrays([cols[0], new_k, pa.ListArray.from_arrays(ends, pa.array(best.sim[core][have]))], names=["key", "nk", "ns"])

    chain = rows.mapInArrow(start, f"part int, guest boolean, key string, ix binary, vx binary, {lists}")
    for s in range(orderings):
        chain = chain.repartitionById(parts, "part")
        chain = chain.mapInArrow(stage(s), f"part int, guest boolean, key string, ix binary, vx binary, {lists}" if s + 1 < orderings else "key string, nk array<string>, ns array<float>")
    found = chain.select("key", F.explode(F.arrays_zip("nk", "ns")).alias("x")).select("key", F.col("x.nk").alias("neighbour"), F.col("x.ns").cast("double").alias("similarity"))
    if at_least is not None:
        found = found.where(F.col("similarity") >= at_least)
    return _put_back(found, members, k) if equal else found


def _put_back(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Lists of representatives to lists of all keys. Of a class at most the k + 1 lowest keys can be in a list."""
    from pyspark.sql import Window

    low = members.withColumn("p", F.row_number().over(Window.partitionBy("rep").orderBy("key"))).where(F.col("p") <= k + 1)
    low = low.groupBy("rep").agg(F.collect_list("key").alias("low"))
    wide = found.join(low, found["neighbour"] == low["rep"], "left").select(found["key"].alias("own"), F.explode(F.coalesce("low", F.array("neighbour"))).alias("neighbour"), "similarity")
    # Inner joins can be split where a class holds a third of all keys; only rows of classes need one.
    wide = wide.join(low.select(F.col("rep").alias("own"), F.lit(True).alias("many")), "own", "left")
    single = wide.where("many is null").select(F.col("own").alias("key"), "neighbour", "similarity")
    wide = single.unionByName(wide.where("many").join(members.select(F.col("rep").alias("own"), F.col("key").alias("member")), "own").select(F.col("member").alias("key"), "neighbour", "similarity"))
    same = members.join(low, "rep").select("key", F.explode("low").alias("neighbour"), F.lit(1.0).alias("similarity")).where("key <> neighbour")
    ranked = wide.unionByName(same).withColumn("p", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour")))
    return ranked.where(F.col("p") <= k).drop("p")
