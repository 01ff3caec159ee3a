"""Text expressions: slugs, folding for search, and lists of ids typed by people."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinscope.functions.ids import is_feature_id, roll_up

# Words too general to tell that two records are the same.
ALIAS_STOPLIST = ["apt", "ta", "unc", "group", "team", "crew", "gang", "actor", "threat", "cluster", "operation", "campaign", "unknown", "unattributed", "g"]
MIN_ALIAS = 3

_PLAIN = r"^[\x00-\x7F]*$"


@F.pandas_udf(StringType())
def _to_ascii(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


@F.pandas_udf(StringType())
def _without_marks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", t)))


def slug(c: Column) -> Column:
    """Compatibility-decomposed ASCII in lower case, all else runs of one hyphen, none at the ends.

    For ASCII text, which needs no decomposition, use `ascii_slug`: it stays inside the JVM.
    """
    return ascii_slug(_to_ascii(c))


def ascii_slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def alias_key(s: Column) -> Column:
    """The key by which aliases meet, out of a slug: null if it is short or says nothing."""
    return F.when((F.length(s) >= MIN_ALIAS) & ~s.isin(ALIAS_STOPLIST), s)


def fold(c: Column) -> Column:
    """Lower case by the Turkish rule of dotted and dotless i, accents off, dotless i as i: what a search compares."""
    lowered = F.lower(F.translate(F.coalesce(c, F.lit("")), "İI", "iı"))
    return F.translate(F.when(lowered.rlike(_PLAIN), lowered).otherwise(_without_marks(lowered)), "ı", "i")


def fold_text(text: str) -> str:
    """`fold` of one text held by the caller."""
    text = "".join(c for c in unicodedata.normalize("NFD", text.translate(str.maketrans("İI", "iı")).lower()) if not 0x300 <= ord(c) <= 0x36F)
    return text.replace("ı", "i")


def tokens(c: Column) -> Column:
    """The parts of a typed list; white space, commas, semicolons and bars separate."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[\s,;|]+"), lambda x: x != "")


def typed_ids(c: Column) -> Column:
    """Distinct parts of a typed list in order, upper-cased; only valid ids are rolled up."""
    return F.array_distinct(F.transform(tokens(c), lambda x: F.when(is_feature_id(x), roll_up(x)).otherwise(F.upper(x))))


def looks_like_list(c: Column) -> Column:
    """Whether at least half of two or more parts are ids."""
    parts = tokens(c)
    return (F.size(parts) > 1) & (F.size(F.filter(parts, is_feature_id)) >= F.ceil(F.size(parts) / 2))


def clean_aliases(name: Column, aliases: Column) -> Column:
    """Aliases trimmed, blanks and the name itself left out, the first of equal spellings kept, in order."""
    tidy = F.filter(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "") & (F.lower(x) != F.coalesce(F.lower(name), F.lit(""))))
    lower = F.transform(tidy, F.lower)
    return F.filter(F.transform(tidy, lambda x, i: F.when(F.array_position(lower, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())
