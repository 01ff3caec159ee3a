"""Recall of problem 1 against brute force: python -m tests.llm.recall FOLDER [COPIES].

Every current vector is indexed; the queries are 1,000 of them, drawn by hash. COPIES > 1 indexes that many copies of
the table, each with its axes turned by another step, so that every copy has families of its own.
"""

import sys
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kinscope.llm.knn import nearest
from kinscope.runtime import current_rows, materialise, session, ship


def turned(df, copies):
    """`copies` copies of (key, vec, at); the vectors of copy c are turned by 31 * c axes."""

    def run(parts):
        for p in parts:
            for c in range(copies):
                yield p.assign(key=p.key + f"/{c}", vec=[np.roll(v, 31 * c) if v is not None else None for v in p.vec])

    return df.mapInPandas(run, df.schema) if copies > 1 else df


def main(folder, copies=1, queries=1_000):
    spark = session("recall", **{"spark.master": "local[8]", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "48", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    rows = current_rows(spark.read.parquet(f"{folder}/vector_space.parquet"), "actor_id", "built_at", "vec").select(F.col("actor_id").alias("key"), "vec", F.lit(0).alias("at"))
    rows = materialise(turned(rows.where(F.size("vec") > 0).where(F.exists("vec", lambda v: v != 0)), copies), "recall-rows")
    began = time.time()
    found = materialise(nearest(rows, "key", "vec", "at"), "recall-found")
    took = time.time() - began
    asked = rows.orderBy(F.xxhash64("key", F.lit(3))).limit(queries).toPandas()
    q = np.stack(asked.vec).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)

    def block(parts):
        for p in parts:
            x = np.stack(p.vec).astype(np.float32)
            s = q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
            s[asked.key.to_numpy()[:, None] == p.key.to_numpy()[None]] = -2
            top = np.argsort(-s, axis=1)[:, :11]
            yield pd.DataFrame({"key": np.repeat(asked.key.to_numpy(), top.shape[1]), "sim": np.take_along_axis(s, top, 1).ravel().astype(float)})

    best = rows.mapInPandas(block, "key string, sim double").toPandas().sort_values(["key", "sim"], ascending=[True, False])
    best["place"] = best.groupby("key").cumcount()
    tenth = best[best.place == 9].set_index("key").sim
    alike = best[(best.place < 10) & (best.sim >= 0.85)].groupby("key").size()
    own = found.join(F.broadcast(spark.createDataFrame(asked[["key"]])), "key").toPandas()
    # A neighbour as near as the tenth counts, whichever of equals it is.
    hit = own[own.similarity >= own.key.map(tenth) - 1e-5].groupby("key").size().clip(upper=10)
    close = own[own.similarity >= 0.85 - 1e-6].groupby("key").size()
    print(f"vectors {rows.count()}, seconds {took:.0f}, recall of the ten nearest {hit.sum() / (10 * len(asked)):.4f}, of those at 0.85 or more {np.minimum(close.reindex(alike.index).fillna(0), alike).sum() / max(alike.sum(), 1):.4f}")


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 1)
