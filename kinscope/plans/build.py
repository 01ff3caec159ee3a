"""From edges to a folder of artefacts, and back to a query service."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinscope.config import Config
from kinscope.operators.clustering import clusters_in, layout
from kinscope.operators.pairs import pair_similarity
from kinscope.operators.service import Station
from kinscope.operators.vectors import vector_space
from kinscope.operators.weighting import feature_weights
from kinscope.sources import bundle
from kinscope.sources.tables import CONTRACTS, exists, optional_csv, read, write, write_csv


@dataclass(frozen=True)
class Workspace:
    """A folder with one Parquet table an artefact."""

    spark: SparkSession
    folder: str

    def has(self, name: str) -> bool:
        return exists(self.spark, f"{self.folder}/{name}.parquet")

    def read(self, name: str) -> DataFrame:
        return read(self.spark, self.folder, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        write(df, self.folder, name)
        return self.read(name)


REPORTS = {
    "summary": "run string, trials bigint, entities bigint, top1 double, top3 double, top5 double, mrr double, mean_rank double, misses bigint, notes string",
    "calibration": "run string, value string, trials bigint, top1 double, share double",
    "by_size": "run string, value string, trials bigint, top1 double, share double",
    "significance": "regime string, entities bigint, delta double, better bigint, worse bigint, tied bigint, p double",
}


def write_regime(space: Workspace, report: DataFrame, test: DataFrame, regime: str) -> None:
    """The report of one regime's runs as four CSV tables: the whole, by level, by size of entity, and the paired test."""
    folder = f"{space.folder}/reports/{regime}"
    row = lambda d, *columns: report.where(F.col("dimension") == d).select("run", *columns)
    write_csv(row("all", "trials", "entities", "top1", "top3", "top5", "mrr", "mean_rank", "misses").withColumn("notes", F.lit(None).cast("string")), f"{folder}/summary.csv")
    write_csv(row("level", "value", "trials", "top1", "share"), f"{folder}/calibration.csv")
    write_csv(row("bucket", "value", "trials", "top1", "share"), f"{folder}/by_size.csv")
    write_csv(test.select(F.lit(regime).alias("regime"), "entities", "delta", "better", "worse", "tied", "p"), f"{folder}/significance.csv")


def trust(space: Workspace, regime: str) -> tuple[bool, dict[str, DataFrame]]:
    """(available, tables): the four tables of a regime, without notes, NaN as null; empty ones where the regime has not been run."""
    folder = f"{space.folder}/reports/{regime}"
    return exists(space.spark, f"{folder}/summary.csv"), {name: optional_csv(space.spark, f"{folder}/{name}.csv", schema) for name, schema in REPORTS.items()}


def write_manifest(space: Workspace, source: str, config: Config = Config(), **about: str) -> None:
    """What a build was made of: source, version, settings and rows of each artefact that is there, as one JSON document."""
    rows = {name: space.read(name).count() for name in CONTRACTS if space.has(name)}
    document = {"source": source, "scheme": config.scheme, "metric": config.metric, "min_features": config.min_features, "rows": rows, **about}
    _write_text(space.spark, f"{space.folder}/manifest.json", json.dumps(document, sort_keys=True))


def read_manifest(space: Workspace) -> dict:
    """The manifest; an empty one where there is none."""
    return _read_json(space.spark, f"{space.folder}/manifest.json")


def write_provenance(spark: SparkSession, path: str, url: str, *, etag: str | None = None, last_modified: str | None = None) -> None:
    """Where a bundle came from, its version, size and checksum, in a file beside it."""
    own = bundle.checksum(spark, path).first()
    about = {"url": url, "version": bundle.version(bundle.read_objects(spark, path)).first()["version"], "size_bytes": own["length"], "sha256": own["sha256"], "etag": etag, "last_modified": last_modified}
    _write_text(spark, f"{path}.meta.json", json.dumps(about, sort_keys=True))


def read_provenance(spark: SparkSession, path: str) -> dict:
    """What `write_provenance` left beside a bundle; empty without it."""
    return _read_json(spark, f"{path}.meta.json")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if exists(spark, path) else {}


def build_dataset(space: Workspace, entities: DataFrame, edges: DataFrame, catalogue: DataFrame) -> None:
    """Writes the first stage: entities, edges and the features in use. An empty one is refused."""
    space.write(edges, "edges")
    space.write(entities, "entities")
    space.write(catalogue.join(edges.select("feature_id").distinct(), "feature_id", "left_semi"), "features")


def build_engine(space: Workspace, config: Config = Config(), *, with_clusters: bool = True, with_pairs: bool = True) -> None:
    """Writes the second stage out of the first: weights, vectors, pairs, clusters and map.

    Pairs grow with the square of the users of a feature; they, and clusters and map, can be left out.
    """
    config.validate()
    edges = space.read("edges")
    weights = space.write(feature_weights(edges, config.scheme, config.smoothing, space.read("features")), "weights")
    vectors = space.write(vector_space(edges, weights), "space")
    if with_pairs or with_clusters:
        pairs = space.write(pair_similarity(vectors, config.metric), "pairs")
        if with_clusters:
            space.write(clusters_in(vectors, vectors, config, pairs=pairs), "clusters")
            space.write(layout(pairs, vectors), "layout")


def ensure_built(space: Workspace, config: Config = Config()) -> bool:
    """Builds the engine if its vectors are missing; whether it had to."""
    if space.has("space"):
        return False
    build_engine(space, config)
    return True


def load(space: Workspace, config: Config = Config()) -> Station:
    """The service over a folder; what is missing of pairs, clusters and map is computed when it is asked for."""
    vectors, weights, edges = space.read("space"), space.read("weights"), space.read("edges")
    pairs = space.read("pairs") if space.has("pairs") else pair_similarity(vectors, config.metric)
    own = space.read("clusters") if space.has("clusters") else clusters_in(vectors, vectors, config, pairs=pairs)
    names = space.read("entities").select("entity_id", "entity_name")
    return Station(edges, weights, vectors, names, pairs, own, config, space.read("layout") if space.has("layout") else None)


def load_cached(space: Workspace, config: Config = Config()) -> Station:
    """`load` with its tables kept in memory and on disk of the executors, for a service that answers many questions."""
    station = load(space, config)
    kept = [getattr(station, name).persist() for name in ("edges", "weights", "space", "names", "pairs", "clusters")]
    return Station(*kept, config, station.places.persist() if station.places is not None else None)
