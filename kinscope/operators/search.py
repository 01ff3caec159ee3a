"""Text search over features and entities, in tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinscope.functions.text import fold, fold_text


def search_features(features: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """(place, feature_id, feature_name, score) of features (feature_id, feature_name, heat) for a typed text.

    Tiers: the id itself, an id it begins (shorter ids first), a name it begins, a word of a name it begins, a name that
    contains it, a name with all its words. Then by heat, and id. One letter only finds ids. A blank text finds nothing.
    """
    needle = fold_text(query).strip()
    words = needle.split()
    id_, name = F.lower("feature_id"), fold(F.col("feature_name"))
    score = F.when(id_ == needle, 1000).when(id_.startswith(needle), F.lit(800) - F.length("feature_id"))
    if len(needle) > 1:
        score = score.when(name.startswith(needle), 600).when(F.exists(F.split(name, "[^a-z0-9]+"), lambda w: w.startswith(needle)), 500).when(F.instr(name, needle) > 0, 400)
        if len(words) > 1:
            every = F.lit(True)
            for w in words:
                every = every & (F.instr(name, w) > 0)
            score = score.when(every, 300)
    rows = features.withColumn("score", score.otherwise(0) if needle else F.lit(0)).where("score > 0")
    top = rows.orderBy(F.desc("score"), F.desc("heat"), "feature_id").limit(limit)
    # At most `limit` rows are ranked in one place.
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("heat"), "feature_id"))).select("place", "feature_id", "feature_name", "score")


def search_entities(entities: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """(place, entity_id, entity_name, matched_alias, score) of entities (entity_id, entity_name, aliases) for a typed text.

    Tiers: the id itself, an id it begins, the name it begins, any alias it begins, a name or alias that contains it.
    matched_alias is the first alias that contains it where the name does not.
    """
    needle = fold_text(query).strip()
    id_, name = F.lower("entity_id"), fold(F.col("entity_name"))
    # Aliases are folded as one text, so that a row calls the folding once; the separator is in no folded alias that matters.
    folded = F.split(fold(F.array_join(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.coalesce(F.regexp_replace(a, "\n", " "), F.lit(""))), "\n")), "\n")
    rows = entities.withColumn("__name", name).withColumn("__aliases", folded)
    begins = F.col("__name").startswith(needle) | F.exists("__aliases", lambda a: a.startswith(needle))
    holds = (F.instr("__name", needle) > 0) | F.exists("__aliases", lambda a: F.instr(a, needle) > 0)
    score = F.when(id_ == needle, 1000).when(id_.startswith(needle), 800).when(F.col("__name").startswith(needle), 700).when(begins, 600).when(holds, 400).otherwise(0)
    rows = rows.withColumn("score", score if needle else F.lit(0)).where("score > 0")
    alias = F.get(F.filter(F.zip_with(F.coalesce("aliases", F.array().cast("array<string>")), "__aliases", lambda a, f: F.when(F.instr(f, needle) > 0, a)), lambda a: a.isNotNull()), F.lit(0))
    rows = rows.withColumn("matched_alias", F.when(F.instr("__name", needle) > 0, F.lit(None).cast("string")).otherwise(alias))
    top = rows.orderBy(F.desc("score"), "entity_name", "entity_id").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "entity_name", "entity_id"))).select("place", "entity_id", "entity_name", "matched_alias", "score")


def resolve(entities: DataFrame, wanted: str) -> DataFrame:
    """The entity of that id; where there is none, those whose id differs in case only."""
    hit = entities.where(F.lower("entity_id") == wanted.lower())
    exact = hit.agg(F.count_if(F.col("entity_id") == wanted).alias("exact"))
    return hit.crossJoin(F.broadcast(exact)).where((F.col("entity_id") == wanted) | (F.col("exact") == 0)).drop("exact")
