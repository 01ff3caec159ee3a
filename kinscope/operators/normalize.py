"""From raw records to entities and edges: identities, catalogue, roll-up, sparse filter and counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinscope.functions.ids import roll_up
from kinscope.functions.text import alias_key, slug
from kinscope.operators.components import components
from kinscope.runtime import distinct_by


def feature_catalogue(raw: DataFrame) -> DataFrame:
    """(feature_id, feature_name, categories) of raw features (attack_id, name, is_sub, categories, pos), one row a parent id.

    The last parent record's name wins, else the first sub-record's; categories are joined in the order first seen.
    """
    rows = raw.withColumn("feature_id", roll_up(F.col("attack_id"))).where("feature_id <> ''")
    name = F.coalesce(F.max_by(F.when(~F.col("is_sub"), F.col("name")), F.when(~F.col("is_sub"), F.col("pos"))), F.min_by("name", F.when(F.col("is_sub"), F.col("pos"))))
    listed = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("categories", F.array().cast("array<string>")).alias("c"))))
    return rows.groupBy("feature_id").agg(name.alias("feature_name"), F.array_distinct(F.flatten(F.transform(listed, lambda x: x["c"]))).alias("categories"))


def alias_keys(raw: DataFrame) -> DataFrame:
    """(attack_id, key): the usable keys of each record's name and aliases."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = raw.select("attack_id", F.explode(names).alias("text")).where("text is not null").select("attack_id", alias_key(slug(F.col("text"))).alias("key"))
    return rows.where("key is not null").distinct()


def alias_groups(raw: DataFrame) -> DataFrame:
    """(attack_id, root): records that share a key, directly or through others, with their lowest id.

    Each key makes a star to its lowest record, so a key that many share gives as many edges as records, not pairs.
    """
    keys = alias_keys(raw)
    hub = keys.groupBy("key").agg(F.min("attack_id").alias("u"))
    edges = keys.join(hub, "key").select("u", F.col("attack_id").alias("v"))
    return components(edges, raw.select(F.col("attack_id").alias("node"))).select(F.col("node").alias("attack_id"), "root")


def shared_keys(raw: DataFrame, groups: DataFrame) -> DataFrame:
    """(root, key): alias keys that more than one record of a group has."""
    return alias_keys(raw).join(groups, "attack_id").groupBy("root", "key").agg(F.countDistinct("attack_id").alias("n")).where("n > 1").select("root", "key")


def merges(raw: DataFrame, groups: DataFrame) -> DataFrame:
    """(canonical_id, canonical_name, merged_ids, merged_names, shared_aliases) of every group of two or more records."""
    rows = raw.select("attack_id", "name").join(groups, "attack_id")
    listed = F.array_sort(F.collect_list(F.struct("attack_id", "name")))
    own = rows.groupBy("root").agg(listed.alias("m")).where(F.size("m") > 1)
    keys = shared_keys(raw, groups).groupBy("root").agg(F.array_sort(F.collect_list("key")).alias("shared_aliases"))
    return own.join(keys, "root", "left").select(F.col("root").alias("canonical_id"), F.get("m", F.lit(0))["name"].alias("canonical_name"), F.transform("m", lambda x: x["attack_id"]).alias("merged_ids"), F.transform("m", lambda x: x["name"]).alias("merged_names"), F.coalesce("shared_aliases", F.array().cast("array<string>")).alias("shared_aliases"))


def merged_aliases(raw: DataFrame, groups: DataFrame) -> DataFrame:
    """(root, aliases): all other names of a group, the canonical one left out, one of each spelling, in order of record and listing."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = raw.select("attack_id", F.posexplode(names).alias("pos", "text")).join(groups, "attack_id").withColumn("text", F.trim("text")).where("text <> ''")
    canonical = raw.select(F.col("attack_id").alias("root"), F.lower(F.trim("name")).alias("own"))
    rows = rows.join(canonical, "root").where("lower(text) <> own").withColumn("k", F.lower("text"))
    first = rows.withColumn("p", F.row_number().over(Window.partitionBy("root", "k").orderBy("attack_id", "pos"))).where("p = 1")
    listed = F.array_sort(F.collect_list(F.struct("attack_id", "pos", "text")))
    return first.groupBy("root").agg(F.transform(listed, lambda x: x["text"]).alias("aliases"))


def sparse_filter(edges: DataFrame, min_features: int = 5) -> DataFrame:
    """The distinct edges of entities with at least `min_features` features."""
    distinct = distinct_by(edges, "entity_id", "feature_id")
    kept = distinct.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_features)
    return distinct.join(kept.select("entity_id"), "entity_id", "left_semi")


def used_features(catalogue: DataFrame, edges: DataFrame) -> DataFrame:
    """The catalogue cut to features in use."""
    return catalogue.join(edges.select("feature_id").distinct(), "feature_id", "left_semi")


@dataclass(frozen=True)
class Normalized:
    """What one run of normalisation gives; every member is a DataFrame."""

    entities: DataFrame
    edges: DataFrame
    catalogue: DataFrame
    merges: DataFrame
    stats: DataFrame


def normalize(raw_entities: DataFrame, raw_features: DataFrame, uses: DataFrame, min_features: int = 5) -> Normalized:
    """Raw records to entities, edges, catalogue, merges and counters.

    raw_entities (stix_id, attack_id, name, aliases); raw_features (stix_id, attack_id, name, is_sub, categories, pos);
    uses (source_ref, target_ref), distinct. Edges are rolled up to parent ids and moved to each group's lowest id.
    """
    groups = alias_groups(raw_entities)
    catalogue = feature_catalogue(raw_features)
    who = raw_entities.select(F.col("stix_id").alias("source_ref"), F.col("attack_id").alias("entity"))
    what = raw_features.select(F.col("stix_id").alias("target_ref"), F.col("attack_id").alias("feature"))
    resolved = uses.join(who, "source_ref").join(what, "target_ref").select("entity", "feature").distinct()
    rolled = resolved.select("entity", roll_up(F.col("feature")).alias("feature_id")).distinct()
    edges = rolled.join(groups, rolled["entity"] == groups["attack_id"]).select(F.col("root").alias("entity_id"), "feature_id").distinct()
    kept = sparse_filter(edges, min_features)
    lists = edges.groupBy("entity_id").agg(F.array_sort(F.collect_list("feature_id")).alias("feature_ids"))
    canonical = raw_entities.join(groups.select("root").distinct(), F.col("attack_id") == F.col("root"), "left_semi").select(F.col("attack_id").alias("entity_id"), F.col("name").alias("entity_name"))
    everyone = canonical.join(merged_aliases(raw_entities, groups).withColumnRenamed("root", "entity_id"), "entity_id", "left").join(lists, "entity_id", "left")
    empty = F.array().cast("array<string>")
    everyone = everyone.select("entity_id", "entity_name", F.coalesce("aliases", empty).alias("aliases"), F.coalesce("feature_ids", empty).alias("feature_ids"))
    final = everyone.where(F.size("feature_ids") >= min_features)
    merged = merges(raw_entities, groups)
    used = used_features(catalogue, kept)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = [one(resolved, "edges_before_rollup"), one(rolled, "edges_after_rollup"), one(raw_features, "features_before_rollup"), one(catalogue, "features_after_rollup"), one(raw_entities, "entities_before_merge"), one(everyone, "entities_after_merge"), one(merged, "merges"), one(final, "entities_final"), one(used, "features_final"), one(kept, "edges_final")]
    stats = counts[0]
    for c in counts[1:]:
        stats = stats.crossJoin(F.broadcast(c))
    stats = stats.withColumn("edges_merged_by_rollup", F.col("edges_before_rollup") - F.col("edges_after_rollup")).withColumn("entities_dropped_sparse", F.col("entities_after_merge") - F.col("entities_final"))
    return Normalized(final, kept, used, merged, stats)
