"""Problem 2: items that appear together, by a blocked Gram matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinscope.llm.common import offsets_of
from kinscope.runtime import materialise

BLOCK = 512
DENSE_BLOCKS = 4
FLUSH, NAMES = 1 << 21, 1 << 20


class _Gram:
    """Upper triangle of sum(X' X) of one task.

    Items are in the order of how many records they are in. The leading `DENSE_BLOCKS` blocks of them (`head`) are
    multiplied as dense 0/1 blocks; of the rarer rest, pairs are listed and counted, as a product of blocks that are
    nearly empty comes to. Memory is bounded: `DENSE_BLOCKS` dense blocks a side, at most about `FLUSH` listed pairs and
    `NAMES` names of rare items before they are passed on.
    """

    def __init__(self, head: list[str]) -> None:
        self.top = head
        self.head = len(head)
        self.code: dict[str, int] = {}
        self.names: list[str] = []
        self.forget()
        side = -(-self.head // BLOCK) * BLOCK
        self.dense = np.zeros((side, side))
        self.keys: list[np.ndarray] = []
        self.held = 0

    def forget(self) -> None:
        self.names = list(self.top)
        self.code = {w: i for i, w in enumerate(self.top)}

    def codes(self, words: list[str], rest: bool = True) -> np.ndarray:
        """The number of each item; -1 for those outside the head, if `rest` does not count."""
        for w in words:
            if rest and w not in self.code:
                self.code[w] = len(self.names)
                self.names.append(w)
        return np.array([self.code.get(w, -1) for w in words], dtype=np.int64)

    def add(self, row: np.ndarray, item: np.ndarray, rows: int) -> Iterator[pa.RecordBatch]:
        head = item < self.head
        if head.any():
            blocks = [(b, head & (item // BLOCK == b)) for b in range(-(-len(self.dense) // BLOCK))]
            mats = []
            for b, own in blocks:
                if own.any():
                    x = np.zeros((rows, BLOCK), dtype=np.float32)
                    x[row[own], item[own] - b * BLOCK] = 1
                    mats.append((b, x))
            for k, (a, xa) in enumerate(mats):
                for b, xb in mats[k:]:
                    self.dense[a * BLOCK : (a + 1) * BLOCK, b * BLOCK : (b + 1) * BLOCK] += xa.T @ xb
        if not head.all():
            yield from self.listed(row, item, head)

    def listed(self, row: np.ndarray, item: np.ndarray, head: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((item, row))
        row, item, head = row[order], item[order], head[order]
        start = np.searchsorted(row, row, "left")
        # Codes ascend within a record: each rare item pairs with all items before it, and with itself.
        place = np.flatnonzero(~head)
        length = place - start[place] + 1
        ends = np.cumsum(length)
        lo = 0
        while lo < len(place):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + FLUSH, "right")))
            n, p = length[lo:hi], place[lo:hi]
            left = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[p], n)
            self.keys.append(item[left] << 32 | item[np.repeat(p, n)])
            self.held += len(left)
            lo = hi
            if self.held >= FLUSH:
                yield from self.flush()

    def batch(self, a: np.ndarray, b: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        names = pa.array(self.names, pa.string())
        x, y = names.take(pa.array(a)), names.take(pa.array(b))
        turn = pc.greater(x, y)
        return pa.RecordBatch.from_arrays([pc.if_else(turn, y, x), pc.if_else(turn, x, y), pa.array(count, pa.int64())], names=["item_a", "item_b", "both"])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            key, count = np.unique(np.concatenate(self.keys), return_counts=True)
            self.keys, self.held = [], 0
            yield self.batch(key >> 32, key & 0xFFFFFFFF, count)

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self.flush()
        for lo in range(0, len(self.dense), BLOCK):
            a, b = np.nonzero(np.triu(self.dense[lo : lo + BLOCK], lo))
            if len(a):
                yield self.batch(a + lo, b, self.dense[a + lo, b].astype(np.int64))


def pair_counts(df: DataFrame, items: Column, head: list[str], rest: bool = True) -> DataFrame:
    """(item_a, item_b, both) with item_a <= item_b: the records that hold both; item_a = item_b gives an item's users.

    `head`: the commonest items, at most DENSE_BLOCKS * BLOCK; without `rest`, no others count. `items` must hold no item
    twice in a record. Each task multiplies its records block by block and sends one row for each pair it met; a further
    aggregation adds these. Null lists and null items count for nothing; an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(head)

    def gram(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Gram(shared.value)
        for b in it:
            lists = b.column("items")
            off = offsets_of(lists)
            words = lists.values.slice(off[0], off[-1] - off[0])
            rows = np.repeat(np.arange(len(lists)), np.diff(off))
            d = words.dictionary_encode()
            index = np.asarray(d.indices.fill_null(-1))
            rows, index = rows[index >= 0], index[index >= 0]
            code = g.codes(d.dictionary.to_pylist(), rest)[index] if len(index) else index
            rows, code = rows[code >= 0], code[code >= 0]
            for lo in range(0, len(lists), 4096):
                own = slice(*np.searchsorted(rows, [lo, lo + 4096]))
                yield from g.add(rows[own] - lo, code[own], min(4096, len(lists) - lo))
            if len(g.names) > g.head + NAMES:
                yield from g.flush()
                g.forget()
        yield from g.close()

    parts = df.select(items.cast("array<string>").alias("items")).where(F.size("items") > 0).mapInArrow(gram, "item_a string, item_b string, both bigint")
    return parts.groupBy("item_a", "item_b").agg(F.sum("both").alias("both"))


def co_occurrence(df: DataFrame, items: Column, *, min_share: float = 0.0, min_lift: float = 0.0) -> DataFrame:
    """(item_a, item_b, both, users_a, users_b, records, lift) of each pair with item_a < item_b that occurs together.

    records: rows with any item; lift = records * both / (users_a * users_b), how much more often than chance.
    Only pairs with both >= min_share * records and lift >= min_lift are given; where the items that themselves reach
    min_share fit the dense blocks, all others leave before the product. Repeats of an item in a row count once.
    A row of null or no items counts for nothing; an empty table gives an empty result.
    """
    held = materialise(df.select(F.array_distinct(F.filter(items, lambda x: x.isNotNull())).cast("array<string>").alias("items")).where(F.size("items") > 0), "baskets")
    users = materialise(held.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")), "item-users")
    records = held.count()
    head = DENSE_BLOCKS * BLOCK
    # At most one item more than the dense blocks hold.
    common = [r["item"] for r in users.where(F.col("n") >= min_share * records).orderBy(F.desc("n"), "item").limit(head + 1).collect()]
    counts = pair_counts(held, F.col("items"), common[:head], rest=len(common) > head).where(F.col("item_a") < F.col("item_b"))
    pairs = counts.where(F.col("both") >= min_share * records).withColumn("records", F.lit(records).cast("bigint"))
    pairs = pairs.join(users.toDF("item_a", "users_a"), "item_a").join(users.toDF("item_b", "users_b"), "item_b")
    pairs = pairs.withColumn("lift", F.col("records") * F.col("both") / (F.col("users_a") * F.col("users_b"))).where(F.col("lift") >= min_lift)
    return pairs.select("item_a", "item_b", "both", "users_a", "users_b", "records", "lift")
