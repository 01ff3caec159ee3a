"""Reading a STIX 2.1 bundle as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinscope.functions.text import clean_aliases

SCHEMA = """type string, id string, objects array<struct<
  type: string, id: string, name: string, aliases: array<string>,
  revoked: boolean, x_mitre_deprecated: boolean, x_mitre_is_subtechnique: boolean, x_mitre_version: string,
  relationship_type: string, source_ref: string, target_ref: string,
  external_references: array<struct<source_name: string, external_id: string>>,
  kill_chain_phases: array<struct<kill_chain_name: string, phase_name: string>>>>"""
SOURCE, KILL_CHAIN = "mitre-attack", "mitre-attack"


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(pos, o): the objects of a bundle file in order. A JSON document of another type is an error."""
    doc = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    checked = F.when(F.col("type").eqNullSafe("bundle"), F.col("objects")).otherwise(F.raise_error(F.concat(F.lit("not a bundle: "), F.coalesce("type", F.lit("no type")))).cast(doc.schema["objects"].dataType))
    return doc.select(F.posexplode(checked).alias("pos", "o"))


def checksum(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def version(objects: DataFrame) -> DataFrame:
    """One row: the version of the first collection object; null without one."""
    return objects.where("o.type = 'x-mitre-collection'").agg(F.min_by("o.x_mitre_version", "pos").alias("version"))


def external_id(references: Column) -> Column:
    """The first non-empty id a reference of the known source gives, trimmed; null without one."""
    own = F.filter(references, lambda r: (r["source_name"] == SOURCE) & (F.coalesce(r["external_id"], F.lit("")) != ""))
    return F.trim(F.get(own, F.lit(0))["external_id"])


@dataclass(frozen=True)
class Bundle:
    entities: DataFrame
    features: DataFrame
    uses: DataFrame
    stats: DataFrame


def parse(objects: DataFrame, *, keep_revoked: bool = False, keep_deprecated: bool = False) -> Bundle:
    """Entities, features and uses of a bundle.

    Objects without an external id are skipped, entities without a name too; of equal STIX ids the last counts. Revoked
    and deprecated objects and relationships are dropped before uses are resolved; what is both counts as revoked.
    """
    flags = lambda df: df.withColumn("revoked", F.coalesce("o.revoked", F.lit(False))).withColumn("deprecated", F.coalesce("o.x_mitre_deprecated", F.lit(False)))

    def records(kind: str) -> DataFrame:
        rows = flags(objects.where(F.col("o.type") == kind)).withColumn("attack_id", external_id(F.col("o.external_references"))).where("attack_id is not null and attack_id <> ''")
        if kind == "intrusion-set":
            rows = rows.where("trim(o.name) <> ''")
        return rows.groupBy(F.col("o.id").alias("stix_id")).agg(F.max_by(F.struct("o", "attack_id", "revoked", "deprecated", "pos"), "pos").alias("r")).select("stix_id", "r.*")

    good = (F.lit(keep_revoked) | ~F.col("revoked")) & (F.lit(keep_deprecated) | ~F.col("deprecated"))
    actors, techniques = records("intrusion-set"), records("attack-pattern")
    name = F.trim("o.name")
    entities = actors.where(good).select("stix_id", "attack_id", name.alias("name"), clean_aliases(name, F.col("o.aliases")).alias("aliases"))
    phases = F.transform(F.filter(F.coalesce("o.kill_chain_phases", F.array().cast("array<struct<kill_chain_name:string,phase_name:string>>")), lambda p: p["kill_chain_name"] == KILL_CHAIN), lambda p: p["phase_name"])
    features = techniques.where(good).select("stix_id", "attack_id", name.alias("name"), F.coalesce("o.x_mitre_is_subtechnique", F.lit(False)).alias("is_sub"), phases.alias("categories"), "pos")
    links = flags(objects.where("o.type = 'relationship' and o.relationship_type = 'uses'")).where("not revoked and not deprecated").select("o.source_ref", "o.target_ref")
    uses = links.join(entities.select(F.col("stix_id").alias("source_ref")), "source_ref", "left_semi").join(features.select(F.col("stix_id").alias("target_ref")), "target_ref", "left_semi").distinct()
    count = lambda df, p: df.agg(F.count(F.lit(1)).alias(f"{p}_total"), F.count_if("revoked").alias(f"{p}_revoked"), F.count_if(F.col("deprecated") & ~F.col("revoked")).alias(f"{p}_deprecated"), F.count_if(~good).alias(f"{p}_dropped"))
    stats = count(actors, "entities").crossJoin(F.broadcast(count(techniques, "features"))).crossJoin(F.broadcast(uses.agg(F.count(F.lit(1)).alias("uses"))))
    return Bundle(entities, features, uses, stats)
