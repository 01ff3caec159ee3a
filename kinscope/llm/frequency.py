"""Problem 6: frequency of every distinct value or term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinscope.runtime import materialise


def term_frequency(df: DataFrame, terms: Column, *, rare_records: int = 2, common_share: float = 0.5) -> DataFrame:
    """(term, occurrences, records, share, mark) of every distinct term of an array column, over all rows of `df`.

    Every row emits each of its terms with one occurrence, and with one record at the term's first place in the
    sorted list; Spark combines these by hash in each task before the one shuffle, so a term in every row sends one
    row a task. The number of rows with any term travels as a null term through the same aggregation.
    `share` is records / rows with any term. `mark` is 'rare' up to `rare_records` records, 'common' above
    `common_share` of those rows, else null ('rare' where both hold, as in tiny tables).
    Null lists and null terms count for nothing; an empty table gives an empty result; repeated terms in a row raise
    occurrences only. Other columns of `df` are not touched, whatever their names.
    """
    sorted_terms = F.array_sort(F.filter(terms, lambda x: x.isNotNull()))
    rows = df.select(sorted_terms.alias("terms")).where(F.size("terms") > 0)
    first = F.transform("terms", lambda x, i: F.struct(x.alias("term"), F.when((i == 0) | (x != F.get("terms", i - 1)), 1).otherwise(0).cast("bigint").alias("first")))
    total = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).cast("bigint").alias("first")))
    counts = rows.select(F.explode(F.concat(total, first)).alias("t")).groupBy("t.term").agg(F.count(F.lit(1)).alias("occurrences"), F.sum("t.first").alias("records"))
    # One row a distinct term, written once and read for both the total and the rows.
    counts = materialise(counts, "term-counts")
    n = counts.agg(F.max(F.when(F.col("term").isNull(), F.col("records"))).alias("n"))
    marked = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > common_share * F.col("n"), "common")
    return counts.crossJoin(F.broadcast(n)).where(F.col("term").isNotNull()).select("term", "occurrences", "records", (F.col("records") / F.col("n")).alias("share"), marked.alias("mark"))
