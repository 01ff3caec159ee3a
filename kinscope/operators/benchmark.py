"""The retrieval benchmark: all trials of a run are scored as one batch of queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinscope.config import Config
from kinscope.operators.confidence import confidence
from kinscope.operators.metrics import paired_test, report
from kinscope.operators.normalize import sparse_filter
from kinscope.operators.sampling import hashed_plan
from kinscope.operators.scoring import leading, rank
from kinscope.operators.vectors import vector_space
from kinscope.operators.weighting import feature_weights
from kinscope.runtime import materialise

# Share of an entity's features in the query, and of noise added to it.
REGIMES = {"A": (0.50, 0.0), "B": (0.25, 0.0), "C": (0.25, 0.30)}
RUNS = {"smooth_idf": ("smooth_idf", "cosine"), "binary": ("binary", "cosine"), "jaccard": ("smooth_idf", "jaccard")}


def artefacts(edges: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, weights, space) of the entities with enough features."""
    config.validate()
    kept = sparse_filter(edges, config.min_features)
    weights = feature_weights(kept, config.scheme, config.smoothing)
    return kept, weights, vector_space(kept, weights)


def run_trials(edges: DataFrame, plan: DataFrame, config: Config = Config()) -> DataFrame:
    """(trial_id, entity_id, sample_size, feature_count, noise_count, rank, top_score, confidence, level): one row a trial; rank -1 is a miss.

    Trials are query ids of one scoring job: a join on the feature, an aggregation and a rank, whatever their number.
    """
    _, weights, space = artefacts(edges, config)
    weights, space = materialise(weights, "trial-weights"), materialise(space, "trial-space")
    queries = plan.select(F.col("trial_id").alias("query_id"), "feature_id")
    scores = materialise(leading(space, queries, weights, config), "trial-leaders")
    ranked = rank(scores, config)
    heads = plan.groupBy("trial_id", "entity_id").agg(F.count(F.lit(1)).cast("int").alias("sample_size"), F.max("feature_count").alias("feature_count"), F.count_if("is_noise").cast("int").alias("noise_count"))
    own = ranked.select(F.col("query_id").alias("trial_id"), "entity_id", "rank")
    best = ranked.where("rank = 1").select(F.col("query_id").alias("trial_id"), F.col("score").alias("top_score"))
    sure = confidence(scores, space, queries, weights, config).select(F.col("query_id").alias("trial_id"), F.col("score").alias("confidence"), "level")
    rows = heads.join(own, ["trial_id", "entity_id"], "left").join(best, "trial_id", "left").join(sure, "trial_id", "left")
    return rows.select("trial_id", "entity_id", "sample_size", "feature_count", "noise_count", F.coalesce("rank", F.lit(-1)).alias("rank"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("level", F.lit("low")).alias("level"))


def comparisons(config: Config = Config()) -> dict[str, Config]:
    """The ablations: three weightings, three sparse filters, the coverage correction on and off."""
    out = {f"scheme {s}": replace(config, scheme=s) for s in ("smooth_idf", "plain_idf", "binary")}
    out |= {f"min_features {n}": replace(config, min_features=n) for n in (5, 8, 10)}
    return out | {f"coverage {'on' if on else 'off'}": replace(config, coverage_correction=on) for on in (True, False)}


def run_comparisons(edges: DataFrame, plan: DataFrame, config: Config = Config()) -> DataFrame:
    """The report of every ablation over one plan, by `label`. Labels of equal settings share one run."""
    out, runs = None, []
    for label, own in comparisons(config).items():
        found = [r for c, r in runs if c == own]
        if not found:
            found = [materialise(report(run_trials(edges, plan, own)), "report")]
            runs.append((own, found[0]))
        rows = found[0].withColumn("label", F.lit(label))
        out = rows if out is None else out.unionByName(rows)
    return out


def run_regime(edges: DataFrame, regime: str, config: Config = Config(), repeats: int = 2) -> tuple[DataFrame, DataFrame]:
    """(reports, test) of one regime: the three runs over one plan, and smooth idf against binary, paired by entity."""
    fraction, noise = REGIMES[regime]
    edges = materialise(edges, "edges")
    plan = materialise(hashed_plan(sparse_filter(edges, config.min_features), fraction=fraction, repeats=repeats, seed=config.seed, noise_ratio=noise), "plan")
    trials = {label: materialise(run_trials(edges, plan, replace(config, scheme=s, metric=m)), "trials") for label, (s, m) in RUNS.items()}
    out = None
    for label, t in trials.items():
        rows = report(t).withColumn("regime", F.lit(regime)).withColumn("run", F.lit(label))
        out = rows if out is None else out.unionByName(rows)
    return out, paired_test(trials["smooth_idf"], trials["binary"])
