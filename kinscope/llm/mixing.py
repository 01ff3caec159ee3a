"""Problem 9: mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinscope.runtime import materialise

ROUNDS = 4
GRID = 16


def _uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the row's key and the seed only."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _draw(u: Column, rate: Column, cap: Column, most: int) -> Column:
    """Inverse Poisson distribution: the number of n with P(X <= n) < u, cut at the cap. A null rate means the cap itself."""
    term, cdf, count = F.exp(-rate), F.exp(-rate), F.lit(0)
    for n in range(most):
        count = count + F.when(u > cdf, 1).otherwise(0)
        term = term * rate / F.lit(float(n + 1))
        cdf = cdf + term
    return F.when(rate.isNull(), cap).otherwise(F.least(count, cap)).cast("int")


def _mean(rate: float, cap: int) -> float:
    """Expected repeats at a rate, cut at the cap."""
    term, total, mean = math.exp(-rate), math.exp(-rate), 0.0
    for n in range(1, cap + 1):
        mean += 1 - total
        term *= rate / n
        total += term
    return mean


def _rate(mean: float, cap: int) -> float | None:
    """The rate whose draws, cut at the cap, have that mean; None where only the cap itself reaches it."""
    if mean >= cap * (1 - 1e-9):
        return None
    lo, hi = 0.0, 1.0
    while _mean(hi, cap) < mean and hi < 700:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _mean(mid, cap) < mean else (lo, mid)
    return hi


def mix(docs: DataFrame, targets: DataFrame, *, total: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Draws repeats of documents so that sources reach target shares of all tokens.

    docs: (doc_id, source, tokens); targets: (source, target_share, max_repeats), a bounded table, one row a source.
    Gives (draws, report): draws = (doc_id, source, copy, place), one row a use, copy from 1 and place a seeded random
    number to sort or range-partition by (the global shuffle); report = one row for each source of either table with its
    share reached.

    Each document draws from a Poisson distribution whose mean is the source's repetition rate, by inverting the
    distribution at a number hashed from its id, cut at max_repeats. `total` is the mix's size in tokens; unset, it is
    the largest at which every listed source that has tokens can reach its share within its cap. Shares of sources
    without tokens are spread over the others. As draws only rise with the rate, the rate is then refined: one pass
    sums, for a grid of rates a source, the tokens drawn, and the next grid lies around the rate that came nearest, so
    the share is met up to about one document instead of Poisson noise. A cap reached in full takes every document
    max_repeats times.

    A document without tokens, of an unlisted or null source, or whose source has a share or cap that is null or
    not positive is never drawn; it is in the report with its source. Ids may repeat: equal ids draw alike.
    An empty table gives no draws.
    """
    docs = materialise(docs.select("doc_id", "source", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")), "mix-sizes")
    spark = docs.sparkSession
    plan = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.collect() if r["source"] is not None and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0}
    listed = docs.where(F.col("source").isin(list(plan)) & (F.col("tokens") > 0)) if plan else docs.limit(0)
    have = {r["source"]: r["n"] for r in listed.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    shares = sum(plan[s][0] for s in have)
    aim = {s: plan[s][0] / shares for s in have}
    if total is None:
        total = int(min((plan[s][1] * have[s] / aim[s] for s in have), default=0))
    cap = {s: int(plan[s][1]) for s in have}
    want = {s: aim[s] * total for s in have}
    most = max(cap.values(), default=0)
    rate = {s: _rate(want[s] / have[s], cap[s]) for s in have}
    rows = listed.withColumn("u", _uniform(F.col("doc_id"), seed))
    width = {s: 0.5 for s in have}
    for _ in range(ROUNDS):
        open_ = [s for s in have if rate[s] is not None]
        if not open_:
            break
        # Beyond 700 the first term of the distribution is no number any more.
        grid = {s: sorted({min(700.0, rate[s] * math.exp(width[s] * (2 * i / GRID - 1))) for i in range(GRID + 1)}) for s in open_}
        steps = spark.createDataFrame([(s, x, cap[s]) for s in open_ for x in grid[s]], "source string, rate double, cap int")
        drawn = rows.join(F.broadcast(steps), "source").groupBy("source", "rate").agg(F.sum(F.col("tokens") * _draw(F.col("u"), F.col("rate"), F.col("cap"), most)).alias("n"))
        best = {}
        for r in drawn.collect():
            gap = abs(r["n"] - want[r["source"]])
            if r["source"] not in best or (gap, r["rate"]) < best[r["source"]]:
                best[r["source"]] = (gap, r["rate"])
        for s in open_:
            rate[s], width[s] = best[s][1], width[s] * 2.5 / GRID
    final = spark.createDataFrame([(s, rate[s], cap[s]) for s in have], "source string, rate double, cap int")
    used = rows.join(F.broadcast(final), "source").withColumn("repeats", _draw(F.col("u"), F.col("rate"), F.col("cap"), most)).where("repeats > 0")
    copies = used.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy"))
    draws = copies.withColumn("place", _uniform(F.xxhash64("doc_id", "copy"), seed + 1))

    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens_available"))
    taken = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens_used"), F.max("repeats").alias("most_repeats"), F.count(F.lit(1)).alias("documents_used"))
    both = sizes.join(targets.where("source is not null").select("source", "target_share", "max_repeats"), "source", "full_outer").join(taken, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    both = both.select("source", "target_share", "max_repeats", zero("documents"), zero("tokens_available"), zero("documents_used"), zero("tokens_used"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    whole = both.agg(F.sum("tokens_used").alias("all"))
    report = both.crossJoin(F.broadcast(whole)).withColumn("share_reached", F.coalesce(F.col("tokens_used") / F.nullif(F.col("all"), F.lit(0)), F.lit(0.0))).drop("all")
    return draws, report
