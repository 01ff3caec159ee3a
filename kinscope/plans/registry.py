"""All queries of the core over the test tables, with SQL that says the same. Each runs over whole tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinscope.config import Config
from kinscope.functions import ids, text
from kinscope.operators import benchmark, case_study, clustering, metrics, normalize, pairs, sampling, scoring, search, service, vectors, weighting
from kinscope.operators.benchmark import run_trials
from kinscope.operators.components import components
from kinscope.operators.confidence import confidence
from kinscope.plans.sql import ORACLES as ORACLES
from kinscope.sources import bundle
from kinscope.sources.tables import actor_edges, actor_entities, event_edges, order_edges, technique_names
from kinscope.runtime import current_rows, let_go, materialise, table
from kinscope.streaming.observations import observation_stream, rank_changes, run_once, windowed_counts

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _r(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six places."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _weights(spark: SparkSession, folder: str, scheme: str = "smooth_idf") -> DataFrame:
    return weighting.feature_weights(event_edges(spark, folder), scheme)


def _written_space(spark: SparkSession, folder: str) -> DataFrame:
    """The space out of edges and weights that are written once; for what reads it several times."""
    e = materialise(event_edges(spark, folder), "edges", lean=True)
    w = materialise(weighting.feature_weights(e), "weights", lean=True)
    s = materialise(vectors.vector_space(e, w), "space", lean=True)
    let_go(e, w)
    return s


def _space(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.vector_space(event_edges(spark, folder), _weights(spark, folder))


def _queries(spark: SparkSession, folder: str, edges: DataFrame | None = None) -> DataFrame:
    """(query_id, feature_id): every feature of every user whose id is divisible by 20, and one feature nobody has."""
    known = (event_edges(spark, folder) if edges is None else edges).where(F.col("entity_id").cast("bigint") % 20 == 0).select(F.col("entity_id").alias("query_id"), "feature_id")
    return known.unionByName(known.select("query_id").distinct().withColumn("feature_id", F.lit("unseen|0")))


@query
def feature_frequency(spark, folder):
    return _r(weighting.feature_frequency(actor_edges(spark, folder), technique_names(spark, folder)), "entity_ratio")


@query
def frequency_summary(spark, folder):
    return _r(weighting.coverage_summary(weighting.feature_frequency(actor_edges(spark, folder))), "singleton_share", "commodity_share")


@query
def feature_weights(spark, folder):
    """All three schemes."""
    out = None
    for scheme in ("smooth_idf", "plain_idf", "binary"):
        rows = _weights(spark, folder, scheme).select(F.lit(scheme).alias("scheme"), "feature_id", "weight", "rarity")
        out = rows if out is None else out.unionByName(rows)
    return _r(out, "weight", "rarity")


@query
def feature_bands(spark, folder):
    rows = weighting.heat(weighting.band(_weights(spark, folder)))
    return _r(rows.select("feature_id", "entity_count", "band", "heat", weighting.share_band(F.col("entity_ratio")).alias("share_band")), "heat")


@query
def vector_space(spark, folder):
    return _r(_space(spark, folder), "w", "u")


@query
def query_vectors(spark, folder):
    return _r(vectors.query_vectors(_queries(spark, folder), _weights(spark, folder)), "w", "u")


@query
def entity_totals(spark, folder):
    return _r(vectors.entity_totals(vectors.vector_space(actor_edges(spark, folder), weighting.feature_weights(actor_edges(spark, folder)))), "total")


def _stored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights, space, queries), each written once as an engine's build does; the edges they come from are let go."""
    e = materialise(event_edges(spark, folder), "edges")
    w = materialise(weighting.feature_weights(e), "weights")
    s, q = materialise(vectors.vector_space(e, w), "space"), materialise(_queries(spark, folder, e), "queries")
    let_go(e)
    return w, s, q


def _scores(spark, folder, **config):
    w, s, q = _stored(spark, folder)
    rows = scoring.score(s, q, w, Config(**config))
    # The scores come out of packed vectors, which are written by now.
    let_go(w, s, q)
    return rows


def _leading(spark, folder):
    """(leaders, weights, space, queries)."""
    w, s, q = _stored(spark, folder)
    return materialise(scoring.leading(s, q, w), "leaders"), w, s, q


@query
def scores_cosine(spark, folder):
    return _scores(spark, folder)


@query
def scores_cosine_uncorrected(spark, folder):
    return _scores(spark, folder, coverage_correction=False)


@query
def scores_jaccard(spark, folder):
    return _scores(spark, folder, metric="jaccard")


@query
def scores_weighted_jaccard(spark, folder):
    return _scores(spark, folder, metric="weighted_jaccard")


@query
def candidates(spark, folder):
    return scoring.rank(_leading(spark, folder)[0]).withColumn("rank", F.col("rank").cast("bigint"))


@query
def candidate_evidence(spark, folder):
    best, w, s, q = _leading(spark, folder)
    return scoring.evidence(scoring.rank(best), s, q, w).withColumn("place", F.col("place").cast("bigint"))


@query
def matched_and_missing(spark, folder):
    best, w, s, q = _leading(spark, folder)
    rows = scoring.matched_and_missing(scoring.rank(best), s, q, w)
    return rows.select("query_id", "entity_id", F.array_join("matched_ids", ",").alias("matched"), F.array_join("missing_ids", ",").alias("missing"))


@query
def query_confidence(spark, folder):
    best, w, s, q = _leading(spark, folder)
    return confidence(best, s, q, w)


@query
def query_result(spark, folder):
    """The flagship: candidates with lists and evidence, and the confidence of each query."""
    w, s, q = _stored(spark, folder)
    names = s.select("entity_id").distinct().withColumn("entity_name", F.concat(F.lit("user "), "entity_id"))
    return service.result_rows(s, q, w, names).drop("evidence")


@query
def query_documents(spark, folder):
    """Each result as a nested JSON document."""
    w, s, q = _stored(spark, folder)
    return service.result_document(service.nested_results(s, q, w))


def _pairs(spark, folder, metric="cosine"):
    s = _written_space(spark, folder)
    rows = pairs.pair_similarity(s, metric)
    # The pairs come out of packed vectors, which are written by now.
    let_go(s)
    return rows


@query
def pairs_cosine(spark, folder):
    return _pairs(spark, folder)


@query
def pairs_jaccard(spark, folder):
    return _pairs(spark, folder, "jaccard")


@query
def pairs_weighted_jaccard(spark, folder):
    return _pairs(spark, folder, "weighted_jaccard")


@query
def similarity_stats(spark, folder):
    return pairs.similarity_stats(materialise(pairs.score_counts(_written_space(spark, folder)), "counts"), event_edges(spark, folder))


@query
def similarity_matrix(spark, folder):
    s = _space(spark, folder)
    return pairs.dense(pairs.pair_similarity(s), vectors.entity_totals(s))


@query
def nearest_entities(spark, folder):
    return pairs.nearest_in(_written_space(spark, folder)).withColumn("rank", F.col("rank").cast("bigint"))


def _two(spark, folder) -> tuple[str, str]:
    a, b = [r[0] for r in event_edges(spark, folder).select("entity_id").distinct().orderBy("entity_id").limit(2).collect()]
    return a, b


@query
def neighbour_table(spark, folder):
    return pairs.neighbour_table(_space(spark, folder), _two(spark, folder)[0]).withColumn("rank", F.col("rank").cast("bigint"))


@query
def neighbour_rank_shift(spark, folder):
    s, own = _space(spark, folder), _two(spark, folder)[0]
    rows = pairs.rank_shift(pairs.neighbour_table(s, own), pairs.neighbour_table(s, own, "jaccard"))
    return rows.select("entity_id", *[F.col(c).cast("bigint").alias(c) for c in ("rank_first", "rank_second", "shift")])


@query
def compare_entities(spark, folder):
    return pairs.compare(_space(spark, folder), *_two(spark, folder))


@query
def comparison_summary(spark, folder):
    return pairs.comparison_summary(_space(spark, folder), *_two(spark, folder))


@query
def entity_clusters(spark, folder):
    return clustering.clusters_in(_written_space(spark, folder), event_edges(spark, folder), replace(Config(), distance_threshold=0.93))


@query
def entity_map(spark, folder):
    return clustering.layout_in(_written_space(spark, folder), event_edges(spark, folder))


def _assigned(edges: DataFrame) -> DataFrame:
    """A fixed assignment for the profile: the id's remainder by eight, less one."""
    return edges.select("entity_id").distinct().withColumn("cluster_id", (F.col("entity_id").cast("bigint") % 8 - 1).cast("int"))


@query
def cluster_profile(spark, folder):
    e = event_edges(spark, folder)
    return clustering.cluster_profile(_assigned(e), e).withColumn("place", F.col("place").cast("bigint"))


@query
def cluster_signature(spark, folder):
    e = event_edges(spark, folder)
    return clustering.signature(clustering.cluster_profile(_assigned(e), e)).withColumn("place", F.col("place").cast("bigint"))


@query
def cluster_labels(spark, folder):
    e = event_edges(spark, folder)
    names = e.select("feature_id").distinct().withColumn("feature_name", F.upper("feature_id"))
    return clustering.cluster_labels(clustering.cluster_profile(_assigned(e), e), names)


@query
def sparse_filter(spark, folder):
    """Customers with enough kinds of parts, out of three joined tables."""
    return normalize.sparse_filter(order_edges(spark, folder), 20)


@query
def used_features(spark, folder):
    return normalize.used_features(technique_names(spark, folder), normalize.sparse_filter(actor_edges(spark, folder), 15))


@query
def rolled_up_ids(spark, folder):
    """Every sighting's id as typed and rolled up, with how often it comes."""
    t = table(spark, folder, "actor_technique")
    return t.groupBy("technique_id").agg(F.count(F.lit(1)).alias("sightings")).select("technique_id", ids.roll_up(F.col("technique_id")).alias("parent_id"), ids.is_feature_id(F.col("technique_id")).alias("is_id"), "sightings")


@query
def sighting_edges(spark, folder):
    """Distinct actors and techniques of all sightings, with first and last time seen."""
    t = table(spark, folder, "actor_technique").withColumn("feature_id", ids.roll_up(F.col("technique_id"))).where("actor_id is not null and feature_id <> ''")
    return t.groupBy(F.col("actor_id").alias("entity_id"), "feature_id").agg(F.count(F.lit(1)).alias("sightings"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


@query
def feature_categories(spark, folder):
    """Techniques of each tactic: footprints and the matrix view are this joined to an entity's features."""
    t = table(spark, folder, "techniques").select("technique_id", F.explode(ids.split_list(F.col("tactics"))).alias("tactic"))
    return t.groupBy("tactic").agg(F.countDistinct("technique_id").alias("techniques"))


@query
def footprint(spark, folder):
    """How many of each actor's techniques fall under each tactic."""
    t = table(spark, folder, "techniques").select(F.col("technique_id").alias("feature_id"), F.explode(ids.split_list(F.col("tactics"))).alias("tactic"))
    return actor_edges(spark, folder).join(t, "feature_id").groupBy("entity_id", "tactic").agg(F.count(F.lit(1)).alias("techniques"))


def _named(spark: SparkSession, folder: str) -> DataFrame:
    """(attack_id, text): every name and alias of the raw records."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return table(spark, folder, "raw_actors").select("attack_id", F.explode(names).alias("text"))


@query
def alias_keys(spark, folder):
    """Usable alias keys of every name and alias, in any script."""
    return _named(spark, folder).select("attack_id", text.alias_key(text.slug(F.col("text"))).alias("key")).where("key is not null").distinct()


def _normalized(spark: SparkSession, folder: str) -> normalize.Normalized:
    """The current actors as raw records, every id they were written with as a raw feature, and who uses which."""
    rows = materialise(current_rows(table(spark, folder, "actors"), "actor_id", "built_at", "name", "aliases", "technique_ids"), "raw")
    raw = rows.select(F.concat(F.lit("s-"), "actor_id").alias("stix_id"), F.col("actor_id").alias("attack_id"), F.trim("name").alias("name"), text.clean_aliases(F.trim("name"), F.col("aliases")).alias("aliases"))
    used = rows.select(F.concat(F.lit("s-"), "actor_id").alias("source_ref"), F.explode("technique_ids").alias("t")).select("source_ref", ids.clean_id(F.col("t")).alias("attack_id")).where("attack_id is not null").distinct()
    known = table(spark, folder, "techniques").select(F.col("technique_id").alias("parent"), F.col("technique_name").alias("name"), ids.split_list(F.col("tactics")).alias("categories"), F.col("axis_pos").cast("bigint").alias("pos"))
    seen = used.select("attack_id").distinct().withColumn("parent", ids.roll_up(F.col("attack_id")))
    features = seen.join(known, "parent", "left").select(F.concat(F.lit("f-"), "attack_id").alias("stix_id"), "attack_id", F.coalesce("name", "attack_id").alias("name"), F.col("attack_id").contains(".").alias("is_sub"), "categories", F.coalesce("pos", F.lit(1000)).alias("pos"))
    return normalize.normalize(raw, features, used.select("source_ref", F.concat(F.lit("f-"), "attack_id").alias("target_ref")), 15)


@query
def normalized_edges(spark, folder):
    """From raw records to edges: groups of shared aliases, ids rolled up, sparse entities left out."""
    return _normalized(spark, folder).edges


@query
def normalized_entities(spark, folder):
    e = _normalized(spark, folder).entities
    return e.select("entity_id", "entity_name", F.size("aliases").cast("bigint").alias("aliases"), F.size("feature_ids").cast("bigint").alias("features"))


@query
def normalized_merges(spark, folder):
    """Records of one group of shared aliases."""
    m = _normalized(spark, folder).merges
    return m.select("canonical_id", "canonical_name", F.array_join("merged_ids", ",").alias("merged"), F.array_join("shared_aliases", ",").alias("shared"))


@query
def normalized_counts(spark, folder):
    return _normalized(spark, folder).stats


@query
def normalized_catalogue(spark, folder):
    return _normalized(spark, folder).catalogue.select("feature_id", F.array_join(F.array_sort("categories"), "|").alias("categories"))


@query
def merged_components(spark, folder):
    """Actors joined by merge decisions, by label propagation."""
    m = table(spark, folder, "actor_merges")
    named = F.concat(F.array("canonical_id"), F.coalesce("merged_ids", F.array().cast("array<string>")))
    listed = F.array_distinct(F.filter(F.transform(named, lambda x: ids.clean_id(x)), lambda x: x.isNotNull()))
    rows = m.select(listed.alias("ids")).where(F.size("ids") > 0).select(F.get("ids", F.lit(0)).alias("u"), F.explode("ids").alias("v"))
    return components(rows, rows.select(F.col("v").alias("node")))


@query
def bundle_entities(spark, folder):
    """Kept records of a bundle made of the raw records; of equal STIX ids the last counts."""
    raw = table(spark, folder, "raw_actors").groupBy("stix_id").agg(F.max_by(F.struct("attack_id", "name", "revoked", "deprecated"), F.struct("modified", F.coalesce("revoked", F.lit(False)), F.coalesce("deprecated", F.lit(False)), F.coalesce("name", F.lit("")))).alias("r")).select("stix_id", "r.*")
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], bundle.SCHEMA).schema["objects"].dataType.elementType.fields}
    own = {"type": F.lit("intrusion-set"), "id": F.col("stix_id"), "name": F.col("name"), "revoked": F.col("revoked"), "x_mitre_deprecated": F.col("deprecated"), "external_references": F.array(F.struct(F.lit(bundle.SOURCE).alias("source_name"), F.col("attack_id").alias("external_id")))}
    objects = raw.select(F.lit(0).alias("pos"), F.struct(*[own.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()]).alias("o"))
    return bundle.parse(objects).entities.select("stix_id", "attack_id", "name")


@query
def bundle_features(spark, folder):
    """The catalogue as a bundle's attack patterns, parsed back."""
    t = table(spark, folder, "techniques")
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], bundle.SCHEMA).schema["objects"].dataType.elementType.fields}
    phases = F.transform(ids.split_list(F.col("tactics")), lambda x: F.struct(F.lit(bundle.KILL_CHAIN).alias("kill_chain_name"), x.alias("phase_name")))
    own = {"type": F.lit("attack-pattern"), "id": F.concat(F.lit("ap--"), "technique_id"), "name": F.col("technique_name"), "kill_chain_phases": phases, "external_references": F.array(F.struct(F.lit("other").alias("source_name"), F.lit("x").alias("external_id")), F.struct(F.lit(bundle.SOURCE).alias("source_name"), F.col("technique_id").alias("external_id")))}
    objects = t.select(F.col("axis_pos").alias("pos"), F.struct(*[own.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()]).alias("o"))
    return bundle.parse(objects).features.select("stix_id", "attack_id", "name", "is_sub", F.array_join("categories", "|").alias("categories"))


@query
def actor_overview(spark, folder):
    """Current actors with the number of their aliases and techniques."""
    n = actor_edges(spark, folder).groupBy("entity_id").agg(F.count(F.lit(1)).alias("features"))
    e = actor_entities(spark, folder).select("entity_id", "entity_name", F.size(text.clean_aliases(F.col("entity_name"), F.col("aliases"))).cast("bigint").alias("aliases"))
    return e.join(n, "entity_id", "left").withColumn("features", F.coalesce("features", F.lit(0)))


@query
def search_features(spark, folder):
    w = weighting.heat(weighting.feature_weights(actor_edges(spark, folder), names=technique_names(spark, folder)))
    return search.search_features(w, "cl", 8).select(F.col("place").cast("bigint").alias("place"), "feature_id", "feature_name", "score")


@query
def search_entities(spark, folder):
    return search.search_entities(actor_entities(spark, folder).where(F.col("entity_name").isNotNull()), "compass", 8).select(F.col("place").cast("bigint").alias("place"), "entity_id", "entity_name", "matched_alias", "score")


@query
def trial_plan(spark, folder):
    rows = sampling.hashed_plan(event_edges(spark, folder))
    return rows.select("trial_id", "entity_id", "feature_id", F.col("feature_count").cast("bigint").alias("feature_count"))


def _planned(spark, folder, **design) -> tuple[DataFrame, DataFrame]:
    """(edges, plan), both written once."""
    e = materialise(event_edges(spark, folder), "edges")
    return e, materialise(sampling.hashed_plan(e, **design), "plan")


@query
def retrieval_trials(spark, folder):
    """The trials of regime A, each scored against all users."""
    return _counted(run_trials(*_planned(spark, folder)))


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c, t in df.dtypes if t == "int"})


@query
def retrieval_report(spark, folder):
    return metrics.report(run_trials(*_planned(spark, folder)))


@query
def regime_b_report(spark, folder):
    """A quarter of the features: three runs over one plan."""
    return benchmark.run_regime(event_edges(spark, folder), "B")[0]


@query
def regime_c_report(spark, folder):
    """A quarter of the features and noise by prevalence: three runs over one plan."""
    return benchmark.run_regime(event_edges(spark, folder), "C")[0]


@query
def regime_c_test(spark, folder):
    """Smooth idf against binary weights in regime C, paired by entity."""
    return _r(benchmark.run_regime(event_edges(spark, folder), "C")[1], "p")


@query
def ablations(spark, folder):
    """Every ablation over the plan of regime B."""
    return benchmark.run_comparisons(*_planned(spark, folder, fraction=0.25))


@query
def noise_plan(spark, folder):
    """The trials of regime C with their noise."""
    return _counted(sampling.hashed_plan(event_edges(spark, folder), fraction=0.25, noise_ratio=0.3))


@query
def fixed_plan(spark, folder):
    return _counted(sampling.fixed_plan(event_edges(spark, folder), trials=2)).drop("is_noise")


@query
def plan_summary(spark, folder):
    return _counted(sampling.plan_summary(sampling.hashed_plan(event_edges(spark, folder)))).select("sample_size", "trials")


@query
def skipped_entities(spark, folder):
    return _counted(sampling.skipped(event_edges(spark, folder), 0.05))


def _first(spark, folder) -> str:
    return _two(spark, folder)[0]


@query
def case_features(spark, folder):
    return _counted(case_study.feature_table(_space(spark, folder), _weights(spark, folder), _first(spark, folder)))


@query
def case_candidates(spark, folder):
    """The rarest and the most common features of one user as queries, and who answers to them."""
    w, s, own = _weights(spark, folder), _space(spark, folder), _first(spark, folder)
    asked = scoring.query_frame(spark, case_study.contrast_queries(case_study.feature_table(s, w, own)))
    return _counted(case_study.candidates_frame(scoring.rank(scoring.score(s, asked, w)), own))


def _station(spark, folder) -> service.Station:
    e, w, s = event_edges(spark, folder), _weights(spark, folder), _space(spark, folder)
    names = e.select("entity_id").distinct().withColumn("entity_name", F.concat(F.lit("user "), "entity_id"))
    return service.Station(e, w, s, names, lambda: pairs.pair_similarity(s), _assigned(e))


@query
def dossier_features(spark, folder):
    return _r(_station(spark, folder).dossier(_first(spark, folder))["features"], "w", "u")


@query
def dossier_neighbours(spark, folder):
    return _counted(_station(spark, folder).dossier(_first(spark, folder))["neighbours"])


@query
def dossier_mates(spark, folder):
    return _station(spark, folder).dossier(_two(spark, folder)[1])["mates"]


@query
def request_noise(spark, folder):
    """Features of other users added to a request of five."""
    station = _station(spark, folder)
    five = [r[0] for r in event_edges(spark, folder).select("feature_id").distinct().orderBy("feature_id").limit(5).collect()]
    return station.noise(five, 1.0)


@query
def blind_case(spark, folder):
    entity, features = _station(spark, folder).blind_case()
    return spark.createDataFrame([(entity, f) for f in features], "entity_id string, feature_id string")


@query
def overview_clusters(spark, folder):
    return _station(spark, folder).groups()


@query
def overview_categories(spark, folder):
    """Tactics in their order with title and number of techniques."""
    return _counted(weighting.category_table(table(spark, folder, "techniques").select("technique_id", F.explode(ids.split_list(F.col("tactics"))).alias("category"))))


@query
def matrix_view(spark, folder):
    """Techniques of each tactic by heat, those with a text in id or name."""
    w = weighting.heat(weighting.feature_weights(actor_edges(spark, folder), names=technique_names(spark, folder)))
    t = table(spark, folder, "techniques").select(F.col("technique_id").alias("feature_id"), F.explode(ids.split_list(F.col("tactics"))).alias("category"))
    return _counted(_r(weighting.matrix_view(w, t, "10"), "heat"))


@query
def relative_gaps(spark, folder):
    """How far each candidate lies behind the one before it, as a share of that one's score."""
    return _counted(scoring.relative_gap(scoring.rank(_leading(spark, folder)[0]))).select("query_id", "entity_id", "rank", "gap")


@query
def comparison_heat(spark, folder):
    return pairs.shared_heat(_space(spark, folder), weighting.heat(_weights(spark, folder)), *_two(spark, folder))


@query
def loners(spark, folder):
    """Entities in no cluster."""
    return clustering.loners(_assigned(event_edges(spark, folder)))


@query
def distances(spark, folder):
    return _pairs(spark, folder).select("left_id", "right_id", F.round(clustering.distance(F.col("score")), 6).alias("distance"))


@query
def binary_space(spark, folder):
    return vectors.to_binary(_space(spark, folder)).groupBy("entity_id").agg(F.sum("present").alias("features"))


@query
def vocabulary(spark, folder):
    return vectors.vocabulary(actor_edges(spark, folder))


@query
def typed_lists(spark, folder):
    """Lists of ids as text, and read back as a person's input: distinct ids and whether the text looks like a list."""
    t = table(spark, folder, "candidates").where("candidate_id is not null").groupBy("candidate_id").agg(F.max(ids.join_list(F.col("missing_technique_ids"))).alias("typed"))
    return t.select("candidate_id", "typed", F.size(text.typed_ids(F.col("typed"))).cast("bigint").alias("ids"), text.looks_like_list(F.col("typed")).alias("is_list"))


@query
def rolled_up_sets(spark, folder):
    """Every actor's list of ids normalised."""
    return current_rows(table(spark, folder, "actors"), "actor_id", "built_at", "technique_ids").select("actor_id", F.array_join(ids.id_set(F.col("technique_ids")), ",").alias("ids"))


@query
def all_names(spark, folder):
    """Current actors with their name and aliases."""
    own = actor_entities(spark, folder)
    return own.select("entity_id", F.explode(F.concat(F.array("entity_name"), text.clean_aliases(F.col("entity_name"), F.col("aliases")))).alias("name")).where("name is not null")


def _trials(spark, folder) -> DataFrame:
    c = table(spark, folder, "candidates").dropDuplicates(["candidate_id"]).where("actor_id is not null")
    n = lambda c: F.greatest(F.size(F.coalesce(c, F.array().cast("array<string>"))), F.lit(0))
    level = F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.45, "medium").otherwise("low")
    rank = F.when(F.col("rank") <= 5, F.col("rank")).otherwise(-1)
    return c.select(F.col("actor_id").alias("entity_id"), rank.alias("rank"), (F.col("query_id") % 4).alias("sample_size"), (n("matched_technique_ids") + n("missing_technique_ids")).alias("feature_count"), level.alias("level"), "query_id")


@query
def metric_report(spark, folder):
    """Every breakdown of retrieval quality over the answers given so far, by grouping sets."""
    return metrics.report(_trials(spark, folder))


@query
def hardest_entities(spark, folder):
    return metrics.hardest(_trials(spark, folder))


@query
def paired_comparison(spark, folder):
    t = _trials(spark, folder)
    return _r(metrics.paired_test(t.where("query_id % 2 = 0"), t.where("query_id % 2 = 1")), "p")


@query
def answer_changes(spark, folder):
    """How an actor's rank changes from one query to the next that names it."""
    c = table(spark, folder, "candidates").groupBy("query_id", "actor_id").agg(F.min("rank").alias("rank"), F.min("asked_at").alias("asked_at")).where("actor_id is not null")
    rows = rank_changes(c.select(F.lit("all").alias("query_id"), F.col("query_id").alias("revision"), F.col("actor_id").alias("entity_id"), F.col("rank").cast("bigint").alias("rank")))
    return rows.drop("query_id")


@query
def noise_pool(spark, folder):
    return sampling.noise_pool(actor_edges(spark, folder))


@query
def stream_windows(spark, folder):
    """Daily counts of event kinds, run as a stream over the events table."""
    schema = table(spark, folder, "events").schema
    return run_once(windowed_counts(observation_stream(spark, f"{folder}/events.parquet", schema), "ts", "event_type"), "windows")
