"""Identifier and list expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def roll_up(c: Column) -> Column:
    """Trimmed of spaces, upper-cased, cut at the first dot: the parent id. Null stays null; blank gives ''."""
    return F.trim(F.split_part(F.upper(F.trim(c)), F.lit("."), F.lit(1)))


def clean_id(c: Column) -> Column:
    """Trimmed and upper-cased; a blank id is null."""
    tidy = F.upper(F.trim(c))
    return F.when(tidy != "", tidy)


def id_list(c: Column) -> Column:
    """Every usable id of a list, rolled up, repeats kept, sorted. Null and blank entries are dropped; a null list is empty."""
    rolled = F.transform(F.coalesce(c, F.array().cast("array<string>")), roll_up)
    return F.array_sort(F.filter(rolled, lambda x: x.isNotNull() & (x != "")))


def id_set(c: Column) -> Column:
    """`id_list` with every id once."""
    return F.array_distinct(id_list(c))


def is_feature_id(c: Column) -> Column:
    """Whether the text has the shape T0000 or T0000.000, in any case and with outer spaces."""
    return F.coalesce(F.upper(F.trim(c)).rlike(r"^T[0-9]{4}(\.[0-9]{3})?$"), F.lit(False))


def join_list(c: Column) -> Column:
    """List to bar-joined text; empty items are left out, a null list gives ''."""
    return F.array_join(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), "|")


def split_list(c: Column) -> Column:
    """Bar-joined text to list; items are trimmed, empty ones dropped, null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def parse_ids(c: Column) -> Column:
    """Free text to a sorted set of rolled-up ids; white space, commas and semicolons separate."""
    return id_set(F.split(F.coalesce(c, F.lit("")), r"[\s,;]+"))
