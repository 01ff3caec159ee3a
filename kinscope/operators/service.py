"""The query service: one object over the artefacts of a dataset that answers what a front end asks."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinscope.config import Config
from kinscope.functions.ids import parse_ids
from kinscope.operators.clustering import cluster_labels, cluster_profile, layout
from kinscope.operators.confidence import confidence, reasons
from kinscope.operators.pairs import compare, comparison_summary, nearest, neighbour_table
from kinscope.operators.sampling import _mark, noise_pool
from kinscope.operators.scoring import DIGITS, evidence, known_features, leading, matched_and_missing, query_frame, rank, score
from kinscope.operators.search import resolve
from kinscope.operators.weighting import category_table, heat
from kinscope.runtime import materialise

DISCLAIMER = "Scores measure likeness of behaviour. They are no statement about who is behind it."


class BadRequest(ValueError):
    """A request beyond the bounds the service sets."""


class NotFound(KeyError):
    """No such entity."""


def check_request(features: list[str] | str, top_k: int | None = None, ratio: float | None = None, config: Config = Config()) -> None:
    """Bounds of a request, held before anything is planned: they also bound what a query can broadcast."""
    if isinstance(features, str):
        if len(features) > config.max_blob_chars:
            raise BadRequest(f"more than {config.max_blob_chars} characters")
    else:
        if len(features) > config.max_query_features:
            raise BadRequest(f"more than {config.max_query_features} features")
        if any(not isinstance(f, str) or len(f) > config.max_id_chars for f in features):
            raise BadRequest(f"feature ids are texts of up to {config.max_id_chars} characters")
    if top_k is not None and not 1 <= top_k <= config.max_top_k:
        raise BadRequest(f"top_k lies within 1 and {config.max_top_k}")
    if ratio is not None and not (ratio == ratio and 0 < ratio <= 1):
        raise BadRequest("ratio lies above 0 and up to 1")


def parse_features(spark: SparkSession, blob: str) -> list[str]:
    """The distinct rolled-up ids of a typed text, sorted, within the bounds of a request."""
    check_request(blob)
    own = spark.range(1).select(parse_ids(F.lit(blob))).first()[0]
    check_request(own)
    return own


@dataclass
class Station:
    """Artefacts of a dataset. DataFrames are lazy: what a question does not touch costs nothing. Pairs may be a function that makes them when they are first asked for."""

    edges: DataFrame
    weights: DataFrame
    space: DataFrame
    names: DataFrame
    pairs: DataFrame | Callable[[], DataFrame]
    clusters: DataFrame
    config: Config = Config()
    places: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.space.sparkSession

    def similar(self) -> DataFrame:
        """The pairs, made where they are not yet."""
        if not isinstance(self.pairs, DataFrame):
            self.pairs = self.pairs()
        return self.pairs

    def map(self) -> DataFrame:
        """(entity_id, x, y): the stored layout, computed where there is none."""
        if self.places is None:
            self.places = layout(self.similar(), self.space)
        return self.places

    def ask(self, features: list[str], top_k: int | None = None) -> dict[str, DataFrame]:
        """candidates, lists, evidence, confidence, known features, the field of all scores and the probe's place for one query."""
        check_request(features, top_k, config=self.config)
        own = replace(self.config, top_k=top_k) if top_k else self.config
        q = query_frame(self.spark, {"q": features})
        scores = materialise(score(self.space, q, self.weights, own), "scores")
        ranked = rank(scores, own).join(self.names, "entity_id", "left").withColumn("entity_name", F.coalesce("entity_name", "entity_id"))
        return {
            "candidates": ranked,
            "lists": matched_and_missing(ranked, self.space, q, self.weights),
            "evidence": evidence(ranked, self.space, q, self.weights, own),
            "confidence": reasons(confidence(scores, self.space, q, self.weights, own), own),
            "known": known_features(q, self.weights),
            "field": scores.where("score > 0").select("entity_id", F.round("score", 4).alias("score")),
            "probe": self.probe(scores),
        }

    def probe(self, scores: DataFrame) -> DataFrame:
        """(query_id, x, y): the centre of the five best entities' places, weighted by the square of their score."""
        top = scores.withColumn("p", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id"))).where("p <= 5 and score > 0")
        w = F.col("score") * F.col("score")
        rows = top.join(self.map(), "entity_id").groupBy("query_id").agg(*[F.round(F.sum(w * F.col(c)) / F.sum(w), 5).alias(c) for c in ("x", "y")])
        return rows.select("query_id", "x", "y")

    def overview(self) -> dict[str, DataFrame]:
        """Features by heat, entities with their cluster and place, clusters with size and label."""
        counts = self.space.groupBy("entity_id").agg(F.count(F.lit(1)).alias("features"))
        return {
            "features": heat(self.weights).select("feature_id", "feature_name", "entity_count", F.round("entity_ratio", 4).alias("entity_ratio"), F.round("heat", 4).alias("heat")),
            "entities": counts.join(self.names, "entity_id", "left").join(self.clusters, "entity_id", "left").join(self.map(), "entity_id", "left"),
            "clusters": self.groups(),
        }

    def groups(self) -> DataFrame:
        """(cluster_id, size, label): the clusters; neither pairs nor map are touched."""
        sizes = self.clusters.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
        return sizes.join(cluster_labels(cluster_profile(self.clusters, self.edges), self.weights.select("feature_id", "feature_name")), "cluster_id", "left")

    def categories(self, listed: DataFrame) -> DataFrame:
        """(place, category, title, features) of the categories (technique_id, category) in use, in the order of the matrix."""
        return category_table(listed.join(self.weights.select(F.col("feature_id").alias("technique_id")), "technique_id", "left_semi"))

    def _one(self, entity: str) -> str:
        found = resolve(self.space.select("entity_id").distinct(), entity).limit(1).collect()
        if not found:
            raise NotFound(entity)
        return found[0]["entity_id"]

    def dossier(self, entity: str) -> dict[str, DataFrame]:
        """Features by weight, mean weight, cluster mates and eight neighbours of one entity; the id may differ in case."""
        own = self._one(entity)
        mine = self.space.where(F.col("entity_id") == own)
        cluster = self.clusters.where((F.col("entity_id") == own) & (F.col("cluster_id") >= 0)).select("cluster_id")
        if isinstance(self.pairs, DataFrame):
            near = nearest(self.pairs.where((F.col("left_id") == own) | (F.col("right_id") == own)), 8).where(F.col("entity_id") == own)
        else:
            near = neighbour_table(self.space, own, self.config.metric, 8).select(F.lit(own).alias("entity_id"), "rank", F.col("entity_id").alias("neighbour_id"), "score", "shared")
        return {
            "features": mine.join(self.weights.select("feature_id", "feature_name"), "feature_id").orderBy(F.desc("w"), "feature_id"),
            "summary": mine.agg(F.count(F.lit(1)).alias("features"), F.round(F.avg("w"), DIGITS).alias("mean_weight")),
            "mates": self.clusters.join(F.broadcast(cluster), "cluster_id").where(F.col("entity_id") != own).select("entity_id"),
            "neighbours": near,
        }

    def compare(self, left: str, right: str) -> dict[str, DataFrame]:
        a, b = self._one(left), self._one(right)
        return {"features": compare(self.space, a, b), "summary": comparison_summary(self.space, a, b)}

    def noise(self, features: list[str], ratio: float, *, hidden: str | None = None, seed: int = 1337) -> DataFrame:
        """(feature_id): max(1, round(n * ratio)) features the query, and the hidden entity, lack; odds by prevalence."""
        check_request(features, ratio=ratio, config=self.config)
        pool = noise_pool(self.edges).where(~F.col("feature_id").isin(features))
        if hidden is not None:
            pool = pool.join(self.edges.where(F.col("entity_id") == hidden).select("feature_id"), "feature_id", "left_anti")
        race = -F.ln(F.greatest(_mark(F.lit(str(seed)), "feature_id"), F.lit(1e-15))) / F.col("n")
        return pool.orderBy(race, "feature_id").limit(max(1, round(len(features) * ratio))).select("feature_id")

    def blind_case(self, *, fraction: float = 0.5, ratio: float | None = None, seed: int = 1337, least: int = 10) -> tuple[str, list[str]]:
        """(entity, features): an entity chosen by seed out of those with at least `least` features, or out of all, and part of its features."""
        check_request([], ratio=fraction, config=self.config)
        counts = self.space.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
        order = _mark(F.lit(str(seed)), "entity_id")
        row = counts.orderBy(F.when(F.col("n") >= least, 0).otherwise(1), order, "entity_id").first()
        if row is None:
            raise NotFound("no entities")
        size = min(row["n"], max(3, int(row["n"] * fraction)))
        own = self.space.where(F.col("entity_id") == row["entity_id"]).orderBy(_mark(F.lit(f"{seed}f"), "feature_id"), "feature_id").limit(size)
        features = sorted(r["feature_id"] for r in own.collect())
        if ratio:
            features = sorted({*features, *(r["feature_id"] for r in self.noise(features, ratio, hidden=row["entity_id"], seed=seed).collect())})
        return row["entity_id"], features


def _leading(space: DataFrame, queries: DataFrame, weights: DataFrame, config: Config) -> DataFrame:
    """The best rows of each query, written once: ranks, lists, evidence and confidence need no others."""
    return materialise(leading(space, queries, weights, config), "leaders")


def result_rows(space: DataFrame, queries: DataFrame, weights: DataFrame, names: DataFrame, config: Config = Config()) -> DataFrame:
    """One row for every query and candidate: rank, score, coverage, lists, evidence as text, and the query's confidence; the flat form of a result.

    A query without candidates has one row with a null candidate and level low.
    """
    scores = _leading(space, queries, weights, config)
    ranked = rank(scores, config)
    lists = matched_and_missing(ranked, space, queries, weights)
    proof = evidence(ranked, space, queries, weights, config)
    listed = F.array_sort(F.collect_list(F.struct("place", F.concat_ws(" ", "feature_id", F.format_number("share", 4)).alias("t"))))
    proof = proof.groupBy("query_id", "entity_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "; ").alias("evidence"))
    sure = confidence(scores, space, queries, weights, config).select("query_id", F.col("known").alias("known_features"), F.col("score").alias("confidence"), "level", "weakest")
    rows = sure.join(ranked.drop("known"), "query_id", "left").join(lists, ["query_id", "entity_id"], "left").join(proof, ["query_id", "entity_id"], "left").join(names, "entity_id", "left")
    return rows.select("query_id", "known_features", "confidence", "level", "weakest", F.col("rank").cast("bigint").alias("rank"), "entity_id", F.coalesce("entity_name", "entity_id").alias("entity_name"), "score", "coverage", F.array_join("matched_ids", ",").alias("matched"), F.array_join("missing_ids", ",").alias("missing"), "evidence")


def nested_results(space: DataFrame, queries: DataFrame, weights: DataFrame, config: Config = Config()) -> DataFrame:
    """One row a query with its candidates, evidence and confidence nested, as a document."""
    scores = _leading(space, queries, weights, config)
    ranked = rank(scores, config)
    proof = evidence(ranked, space, queries, weights, config).groupBy("query_id", "entity_id").agg(F.array_sort(F.collect_list(F.struct("place", "feature_id", "feature_name", "w", "share"))).alias("evidence"))
    lists = matched_and_missing(ranked, space, queries, weights)
    rows = ranked.join(lists, ["query_id", "entity_id"]).join(proof, ["query_id", "entity_id"], "left")
    nested = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity_id", "score", "coverage", "matched_ids", "missing_ids", "evidence"))).alias("candidates"))
    sure = reasons(confidence(scores, space, queries, weights, config), config)
    out = sure.select("query_id", F.struct("rarity", "margin", "sufficiency", "score", "level", "reasons").alias("confidence"))
    return out.join(nested, "query_id", "left").withColumn("disclaimer", F.lit(DISCLAIMER))


def heat_colour(heat: float) -> str:
    """A colour between pale and dark red for a heat of 0 to 1."""
    low, high = (0xF4, 0xE9, 0xD8), (0xB3, 0x1B, 0x1B)
    at = min(max(heat, 0.0), 1.0)
    return "#" + "".join(f"{round(a + (b - a) * at):02x}" for a, b in zip(low, high))


def navigator_layer(result: dict[str, DataFrame], weights: DataFrame, name: str = "kinscope", version: str | None = None) -> str:
    """A layer document of one query's result: each known feature with its heat, its colour, and whether the best candidate has it."""
    top = result["candidates"].where("rank = 1").limit(1).collect()
    lists = {r["entity_id"]: r["matched_ids"] for r in result["lists"].collect()}
    shared = set(lists.get(top[0]["entity_id"], [])) if top else set()
    rows = result["known"].where("known").join(heat(weights).select("feature_id", "heat"), "feature_id").orderBy("feature_id").collect()
    sure = result["confidence"].first()
    said = lambda f: f"shared with {top[0]['entity_name']}" if f in shared else "not seen in the nearest candidate"
    layer = {
        "name": f"{name}: nearest {top[0]['entity_name']}" if top else name,
        "versions": {"attack": (version or "").split(".")[0] or None, "navigator": "5.1.0", "layer": "4.5"},
        "domain": "enterprise-attack",
        "description": f"The score is a feature's rarity (0 to 1). {DISCLAIMER}",
        "techniques": [{"techniqueID": r["feature_id"], "score": round(r["heat"], 4), "color": heat_colour(r["heat"]), "comment": said(r["feature_id"]), "enabled": True, "showSubtechniques": False} for r in rows],
        "gradient": {"colors": [heat_colour(0), heat_colour(1)], "minValue": 0, "maxValue": 1},
        "legendItems": [],
        "metadata": [{"name": "dataset", "value": version or "?"}, {"name": "confidence", "value": sure["level"] if sure else "low"}],
        "hideDisabled": False,
    }
    return json.dumps(layer, ensure_ascii=False)


def markdown(result: dict[str, DataFrame]) -> str:
    """A short report of one query's result."""
    known = sorted((r["feature_id"], r["known"]) for r in result["known"].collect())
    sure = result["confidence"].first()
    lines = ["## Nearest behaviour", "", f"**Observed ({sum(k for _, k in known)}):** {', '.join(f for f, k in known if k) or '-'}"]
    if any(not k for _, k in known):
        lines.append(f"**Unknown:** {', '.join(f for f, k in known if not k)}")
    rows = result["candidates"].orderBy("rank").limit(5).collect()
    if not rows:
        return "\n".join([*lines, "", "No entity shares a known feature.", "", f"> {DISCLAIMER}"])
    lines += ["", f"Nearest: **{rows[0]['entity_name']} ({rows[0]['entity_id']})**. Confidence: **{sure['level']}** ({sure['score']:.2f}).", "", "| # | entity | score | shared |", "|---|---|---|---|"]
    lines += [f"| {r['rank']} | {r['entity_name']} ({r['entity_id']}) | {r['score']:.3f} | {r['matched']}/{r['known']} |" for r in rows]
    proof = result["evidence"].where(F.col("entity_id") == rows[0]["entity_id"]).orderBy("place").limit(5).collect()
    lines += ["", f"**Decided by:** {', '.join(f'{r['feature_id']} {r['share']:.0%}' for r in proof)}"]
    return "\n".join([*lines, "", f"> {DISCLAIMER}"])


def result_document(result: DataFrame) -> DataFrame:
    """(query_id, document): each nested result as JSON text."""
    return result.select("query_id", F.to_json(F.struct(*[c for c in result.columns])).alias("document"))
