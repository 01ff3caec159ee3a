"""What the operators of this package share: baskets, packed sparse vectors, union-find on arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinscope.runtime import current_rows, table


def baskets(spark: SparkSession, folder: str) -> DataFrame:
    """(actor_id, ids): the set of technique ids of every actor's current row; possibly empty."""
    return id_lists(current_rows(table(spark, folder, "actors"), "actor_id", "built_at", "technique_ids"), "actor_id", "technique_ids")


def id_lists(df: DataFrame, key: str, ids: str, *, repeats: bool = False) -> DataFrame:
    """(key, ids): `functions.ids.id_set` of every row (with `repeats`, `id_list`), by whole batches.

    Each distinct text of a batch is tidied once, and lists are put in order as numbers. A null list is empty.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = b.column("ids")
            off = offsets_of(lists)
            count = np.where(np.asarray(lists.is_null()), 0, np.diff(off)) if len(lists) else np.empty(0, np.int64)
            words = lists.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
            index = np.asarray(words.indices.fill_null(len(words.dictionary)), np.int64)
            tidy = [w.strip(" ").upper().split(".", 1)[0].strip(" ") for w in words.dictionary.to_pylist()] + [""]
            known = sorted(set(tidy) - {""})
            place = {w: i for i, w in enumerate(known)}
            code = np.array([place.get(w, -1) for w in tidy], np.int64)[index]
            row = np.repeat(np.arange(len(lists)), np.diff(off))
            ok = (code >= 0) & (count[row] > 0)
            both = row[ok] << 32 | code[ok]
            both = np.sort(both) if repeats else np.unique(both)
            ends = np.searchsorted(both >> 32, np.arange(len(lists) + 1))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(known, pa.string()).take(pa.array(both & 0xFFFFFFFF)))], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(ids).cast("array<string>").alias("ids"))
    return rows.mapInArrow(run, f"key {kind}, ids array<string>").withColumnRenamed("key", key)


def one(it: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a task as one table without chunks; None for a task without rows."""
    batches = [b for b in it if b.num_rows]
    return pa.Table.from_batches(batches).combine_chunks() if batches else None


def column(t: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    c = t.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def offsets_of(a: pa.Array) -> np.ndarray:
    """Offsets of a list, string or binary array as int64, with regard to slices."""
    wide = pa.types.is_large_list(a.type) or pa.types.is_large_binary(a.type) or pa.types.is_large_string(a.type)
    if pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
        return np.asarray(a.offsets, dtype=np.int64)
    raw = np.frombuffer(a.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[a.offset : a.offset + len(a) + 1].astype(np.int64)


def binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column out of one flat array, `counts` items a row."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * data.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]).cast(pa.binary())


def flat(a: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of `binary`: all items, and how many each row has. Null rows count as empty."""
    if a.null_count:
        a = a.fill_null(b"")
    off = offsets_of(a)
    size = np.dtype(dtype).itemsize
    data = a.buffers()[2]
    items = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]].copy().view(dtype) if data is not None and len(a) else np.empty(0, dtype)
    return items, np.diff(off) // size


def pack_vectors(df: DataFrame, key: str, vec: str, stamp: str) -> DataFrame:
    """(key, ix, vx): the current vector of every key as packed non-zero axes (uint16) and values (float32).

    A vector that is null, all zero or not finite in every axis packs to nothing, and so hides older ones of its key.
    Vectors may differ in length; missing axes are zero. Up to 65,536 axes.
    """

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            v = b.column("vec")
            off, n = offsets_of(v), len(v)
            values = np.asarray(v.values.fill_null(0.0) if v.values.null_count else v.values, dtype=np.float32)[off[0] : off[-1]]
            rows = np.repeat(np.arange(n), np.diff(off))
            axis = np.arange(len(values)) - np.repeat(off[:-1] - off[0], np.diff(off))
            if len(axis) and axis.max() > 65535:
                raise ValueError("a vector has more than 65,536 axes")
            bad = np.zeros(n, dtype=bool)
            bad[rows[~np.isfinite(values)]] = True
            bad |= np.asarray(v.is_null())
            keep = (values != 0) & ~bad[rows]
            counts = np.bincount(rows[keep], minlength=n)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("stamp"), binary(axis[keep].astype("<u2"), counts), binary(values[keep].astype("<f4"), counts)], names=["key", "stamp", "ix", "vx"])

    kind = df.schema[stamp].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(stamp).alias("stamp"), F.col(vec).cast("array<float>").alias("vec"))
    packed = rows.mapInArrow(pack, f"key {df.schema[key].dataType.simpleString()}, stamp {kind}, ix binary, vx binary")
    return current_rows(packed, "key", "stamp", "ix", "vx").where(F.length("ix") > 0)


def dense(ix: pa.Array, vx: pa.Array, width: int) -> np.ndarray:
    """Unit rows (float32) of packed vectors; norms are taken in double precision."""
    axis, counts = flat(ix, "<u2")
    values, _ = flat(vx, "<f4")
    rows = np.repeat(np.arange(len(counts)), counts)
    norm = np.sqrt(np.bincount(rows, weights=values.astype(np.float64) ** 2, minlength=len(counts)))
    out = np.zeros((len(counts), width), dtype=np.float32)
    out[rows, axis] = values / np.maximum(norm, 1e-300)[rows]
    return out


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of everything joined to each of n nodes by the edges (u, v): union by hooking and path halving on whole arrays."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return label
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
