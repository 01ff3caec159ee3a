"""Problem 8: encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARIES = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern published with the byte-level vocabularies, by which text splits before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_CHARS = 1 << 16
PIECE_BYTES = 1 << 12


class ByteBpe:
    """A byte-level BPE of a rank file. Special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {b: a for a, b in self.ranks.items()}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.run = regex.compile(rf"\S{{{PIECE_BYTES // 4},}}|\s{{{PIECE_BYTES // 4},}}")

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty give []. A lone surrogate, which UTF-8 cannot hold, counts as U+FFFD."""
        if not text:
            return []
        if len(text) < PIECE_BYTES // 4 or not self.run.search(text):
            return self.core.encode_ordinary(text)
        out: list[int] = []
        for m in self.pattern.finditer(text):
            out += self.piece(m[0].encode("utf-8", "replace"))
        return out

    def piece(self, data: bytes, limit: int = PIECE_BYTES) -> list[int]:
        """Ids of one unsplit piece. A long one is a tree: leaves are encoded side by side, then joined upwards."""
        if len(data) <= limit:
            return self.core._encode_single_piece(data)
        cuts = list(range(0, len(data), limit))
        with ThreadPoolExecutor(4) as pool:
            level = list(pool.map(lambda lo: self.core._encode_single_piece(data[lo : lo + limit]), cuts))
            while len(level) > 1:
                pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
                level = list(pool.map(lambda p: self.join(*p) if len(p) == 2 else p[0], pairs))
        return level[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenation of two encoded halves of a piece.

        A window around the join is encoded afresh and grows until its first ids equal those of the left half and its
        last ids those of the right. A sequence in which all neighbours also stand side by side in some true encoding is
        itself the encoding of its bytes, so what lies outside the agreeing window stays.
        """
        reach = 8
        while True:
            a, b = min(reach, len(left)), min(reach, len(right))
            fresh = self.core._encode_single_piece(b"".join(self.bytes_of[i] for i in left[len(left) - a :] + right[:b]))
            if (a == len(left) or fresh[:2] == left[len(left) - a :][:2]) and (b == len(right) or fresh[-2:] == right[:b][-2:]):
                return left[: len(left) - a] + fresh + right[b:]
            reach *= 2


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def _chunks(text: str, size: int) -> list[str]:
    """Cuts of a long text before white space that follows other text. The pattern always splits there, and nothing left
    of such a place depends on what is right of it, so encodings of the chunks simply follow each other."""
    out, lo = [], 0
    place = regex.compile(r"(?<=\S)\s")
    while len(text) - lo > size:
        m = place.search(text, lo + size)
        if not m:
            break
        out.append(text[lo : m.start()])
        lo = m.start()
    return [*out, text[lo:]]


def encode(df: DataFrame, key: str, text: str, *, vocabulary: str = BYTE_BPE_50K, folder: str = VOCABULARIES, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(key, ids): the ids of every row's whole text, without special tokens.

    Rows are encoded where they lie. Only texts above `chunk_chars` characters are cut, spread over all tasks and put
    together again, so that one giant text does not hold one task; a long run without white space or break is encoded
    as a tree of halves (see `ByteBpe`). Null and empty texts give []. Keys may repeat or be null: each row gives a row.
    The vocabulary file must be readable at `folder` on every executor.
    """
    path = os.path.join(folder, vocabulary)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def ids(texts: list[str | None]) -> pa.Array:
        bpe = tokenizer(path)
        lists = [bpe.encode(t) for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter((i for x in lists for i in x), dtype=np.int32, count=ends[-1])))

    def plain(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column("key"), ids(part.column("text").to_pylist())], names=["key", "ids"])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row, t in enumerate(b.column("text").to_pylist()):
                parts = _chunks(t, chunk_chars)
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array([row] * len(parts))), pa.array([b.column("row")[row].as_py()] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=["key", "row", "part", "text"])

    def piecewise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("row"), b.column("part"), ids(b.column("text").to_pylist())], names=["key", "row", "part", "ids"])

    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk_chars).mapInArrow(plain, f"key {kind}, ids array<int>")
    # The number of a row only tells equal keys apart: it is the text's own hash, so a recomputed task numbers alike.
    long = rows.where(F.length("text") > chunk_chars).withColumn("row", F.xxhash64("text")).groupBy("key", "row", "text").count()
    parts = long.select("key", "row", "text").mapInArrow(cut, f"key {kind}, row bigint, part int, text string")
    # A partition for each chunk's own hash: chunks of one text go to different tasks.
    parts = parts.repartition(F.xxhash64("key", "row", "part")).mapInArrow(piecewise, f"key {kind}, row bigint, part int, ids array<int>")
    whole = parts.groupBy("key", "row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])).alias("ids"))
    times = long.select(F.col("key").alias("k"), F.col("row").alias("r"), "count")
    whole = whole.join(times, F.col("key").eqNullSafe(F.col("k")) & (F.col("row") == F.col("r"))).select("key", "ids", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("again"))
    return short.unionByName(whole.select("key", "ids")).withColumnRenamed("key", key)


def token_counts(df: DataFrame, keep: list[str], text: str, *, vocabulary: str = BYTE_BPE_50K, folder: str = VOCABULARIES) -> DataFrame:
    """(keep..., tokens): the number of ids of every row's whole text; 0 for null and empty texts. Column `tokens` must not be in `keep`."""
    path = os.path.join(folder, vocabulary)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in it:
            n = pa.array([len(bpe.encode(t)) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "tokens"])

    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(count, f"{fields}, tokens bigint")
