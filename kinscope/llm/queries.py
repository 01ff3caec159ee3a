"""Queries of the training-data operators over the test tables, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinscope.llm import abuse
from kinscope.llm.common import baskets, id_lists
from kinscope.llm.components import connected_components, merge_edges
from kinscope.llm.cooccurrence import co_occurrence
from kinscope.llm.families import families, typical_members
from kinscope.llm.frequency import term_frequency
from kinscope.llm.knn import nearest
from kinscope.llm.mixing import mix
from kinscope.llm.names import same_names
from kinscope.llm.setjoin import expand_pairs, similar_sets
from kinscope.llm.tokens import encode, token_counts
from kinscope.runtime import current_rows, table


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 most similar actors of every actor, with their cosine."""
    found = nearest(table(spark, folder, "vector_space"), "actor_id", "vec", "built_at")
    return found.select(F.col("key").alias("actor_id"), F.col("neighbour").alias("similar_id"), F.round("similarity", 6).alias("similarity"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = nearest(table(spark, folder, "vector_space"), "actor_id", "vec", "built_at", exact_at=(0.85,), at_least=0.85)
    return found.select(F.least("key", "neighbour").alias("actor_a"), F.greatest("key", "neighbour").alias("actor_b")).distinct()


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of techniques used together: users of both, and how much more often than chance."""
    rows = co_occurrence(baskets(spark, folder), F.col("ids"))
    return rows.select(F.col("item_a").alias("technique_a"), F.col("item_b").alias("technique_b"), F.col("both").alias("actors_both"), F.round("lift", 6).alias("lift"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = co_occurrence(baskets(spark, folder), F.col("ids"), min_share=0.02, min_lift=2.0)
    return rows.select(F.col("item_a").alias("technique_a"), F.col("item_b").alias("technique_b"))


def _families(spark: SparkSession, folder: str) -> DataFrame:
    return families(table(spark, folder, "vector_space"), "actor_id", "vec", "built_at")


def p3_families(spark: SparkSession, folder: str) -> DataFrame:
    """The size of every family and its five most typical actors."""
    rows = typical_members(_families(spark, folder))
    return rows.select(F.col("lead").alias("lead_id"), "size", "rank", F.col("key").alias("actor_id"), "typicality")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _families(spark, folder).where("key <> lead").select(F.col("lead").alias("lead_id"), F.col("key").alias("actor_id"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every id named in a merge decision with the least id of its group."""
    groups = connected_components(merge_edges(table(spark, folder, "actor_merges"), "canonical_id", "merged_ids"))
    return groups.select(F.col("node").alias("actor_id"), F.col("root").alias("canonical_id"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = p4_groups(spark, folder).where("actor_id <> canonical_id")
    return groups.select("canonical_id", F.col("actor_id").alias("merged_id"))


def _sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    candidates = id_lists(table(spark, folder, "candidates"), "candidate_id", "matched_technique_ids").withColumnRenamed("candidate_id", "id")
    return similar_sets(baskets(spark, folder).withColumnRenamed("actor_id", "id"), candidates, threshold=0.8, min_size=5)


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every actor and candidate with at least 5 techniques: its class of equal sets, and the number of other classes it is linked to."""
    links, members = _sets(spark, folder)
    ends = links.select(F.col("rep_a").alias("rep")).unionAll(links.select(F.col("rep_b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return members.join(ends, "rep", "left").select("part", "id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return expand_pairs(*_sets(spark, folder))


def _frequency(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_rows(table(spark, folder, "actors"), "actor_id", "built_at", "technique_ids")
    return term_frequency(id_lists(rows, "actor_id", "technique_ids", repeats=True), F.col("ids"))


def p6_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Actors, share of actors and mark of every technique id, with its name in the catalogue."""
    names = table(spark, folder, "techniques").groupBy("technique_id").agg(F.min("technique_name").alias("technique_name"))
    counts = _frequency(spark, folder).select(F.col("term").alias("technique_id"), "occurrences", F.col("records").alias("actor_count"), F.round("share", 9).alias("actor_ratio"), "mark")
    return counts.join(names, "technique_id", "left")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _frequency(spark, folder).where("mark is not null").select(F.col("term").alias("technique_id"), "mark")


def _names(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return same_names(table(spark, folder, "raw_actors"), "attack_id", "name", "aliases")


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every record that has a telling name: its group, and the spellings it shares with another record of the group."""
    members, forms = _names(spark, folder)
    used = forms.join(members, "key")
    shared = used.groupBy("group", "node").agg(F.countDistinct("key").alias("keys")).where("keys > 1").drop("keys")
    aliases = used.join(shared, ["group", "node"]).groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("form")), "; ").alias("shared_aliases"))
    return members.join(aliases, "key", "left").select(F.col("key").alias("attack_id"), F.col("group").alias("group_id"), "shared_aliases")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    members = _names(spark, folder)[0]
    a, b = members.toDF("attack_id_a", "g"), members.toDF("attack_id_b", "g")
    return a.join(b, "g").where("attack_id_a < attack_id_b").select("attack_id_a", "attack_id_b")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = token_counts(table(spark, folder, "documents"), ["doc_id", "source"], "text")
    return mix(sizes, table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Each use of a document in the mix, globally shuffled."""
    return _mix(spark, folder)[0].repartitionByRange("place").sortWithinPartitions("place").drop("place")


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Share of all tokens each source reaches, against its target."""
    return _mix(spark, folder)[1]


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return abuse.score(docs, abuse.fit(docs, table(spark, folder, "review_labels")), ["doc_id", "source"], "text")


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every document, and whether it is held to be abusive."""
    return _scored(spark, folder)


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, abusive documents and their rate for every source."""
    own = _scored(spark, folder).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("abusive").alias("abusive"))
    return own.withColumn("rate", F.col("abusive") / F.col("documents"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).where("abusive").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_neighbours, p1_found, p2_pairs, p2_found, p3_families, p3_found, p4_groups, p4_found, p5_classes, p5_found, p6_frequency, p6_found, p7_groups, p7_found, p8_ids, p9_mix, p9_report, p10_scores, p10_rates, p10_found)}

_CURRENT = """cur AS (
  SELECT actor_id, technique_ids FROM actors WHERE actor_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY actor_id ORDER BY built_at DESC NULLS LAST) = 1),
raw AS (SELECT actor_id, trim(split_part(upper(trim(t)), '.', 1)) AS tech FROM (SELECT actor_id, unnest(technique_ids) AS t FROM cur)),
basket AS (SELECT DISTINCT actor_id, tech FROM raw WHERE tech <> ''),
users AS (SELECT tech, count(*) AS n FROM basket GROUP BY tech),
total AS (SELECT count(DISTINCT actor_id) AS n FROM basket)"""

_PAIRS = f"""WITH {_CURRENT},
pairs AS (SELECT a.tech AS technique_a, b.tech AS technique_b, count(*) AS actors_both FROM basket a JOIN basket b ON a.actor_id = b.actor_id AND a.tech < b.tech GROUP BY 1, 2),
full_pairs AS (SELECT technique_a, technique_b, actors_both, CAST(total.n * actors_both AS DOUBLE) / (ua.n * ub.n) AS lift, total.n AS records
  FROM pairs JOIN users ua ON ua.tech = technique_a JOIN users ub ON ub.tech = technique_b CROSS JOIN total)"""

_COMPONENTS = """WITH RECURSIVE named AS (
  SELECT merge_id, upper(trim(canonical_id)) AS id FROM actor_merges UNION SELECT merge_id, upper(trim(id)) FROM (SELECT merge_id, unnest(merged_ids) AS id FROM actor_merges)),
ids AS (SELECT DISTINCT merge_id, id FROM named WHERE id <> ''),
edges AS (SELECT DISTINCT a.id AS u, b.id AS v FROM ids a JOIN ids b USING (merge_id)),
reach AS (SELECT u, v FROM edges UNION SELECT reach.u, edges.v FROM reach JOIN edges ON reach.v = edges.u),
groups AS (SELECT u AS actor_id, min(v) AS canonical_id FROM reach GROUP BY u)"""

_SET_PAIRS = f"""WITH {_CURRENT},
cand AS (SELECT DISTINCT candidate_id, trim(split_part(upper(trim(t)), '.', 1)) AS tech FROM (SELECT candidate_id, unnest(matched_technique_ids) AS t FROM candidates)),
items AS (SELECT 'l' AS part, actor_id AS id, tech FROM basket UNION ALL SELECT 'r', candidate_id, tech FROM cand WHERE tech <> ''),
sizes AS (SELECT part, id, count(*) AS n FROM items GROUP BY 1, 2 HAVING count(*) >= 5),
kept AS (SELECT items.*, n FROM items JOIN sizes USING (part, id)),
shared AS (SELECT a.part AS pa, a.id AS ia, a.n AS na, b.part AS pb, b.id AS ib, b.n AS nb, count(*) AS s
  FROM kept a JOIN kept b ON a.tech = b.tech AND a.part = 'l' AND (b.part = 'r' OR a.id < b.id) AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY ALL)"""

_NEAREST = """WITH cur AS (SELECT actor_id, CAST(vec AS DOUBLE[]) AS v FROM vector_space WHERE actor_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY actor_id ORDER BY built_at DESC NULLS LAST) = 1),
u AS (SELECT actor_id, v FROM cur WHERE v IS NOT NULL AND list_dot_product(v, v) > 0),
s AS (SELECT a.actor_id AS a, b.actor_id AS b, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.actor_id < b.actor_id),
near AS (SELECT a, b, c FROM s UNION ALL SELECT b, a, c FROM s),
best AS (SELECT a, b, c FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 10)"""

ORACLES: dict[str, str] = {
    # Brute force: the index is held against it, not computed by it.
    "p1_found": _NEAREST + " SELECT DISTINCT least(a, b) AS actor_a, greatest(a, b) AS actor_b FROM best WHERE c >= 0.85",
    "p2_pairs": _PAIRS + " SELECT technique_a, technique_b, actors_both, round(lift, 6) AS lift FROM full_pairs",
    "p2_found": _PAIRS + " SELECT technique_a, technique_b FROM full_pairs WHERE actors_both >= 0.02 * records AND lift >= 2",
    "p4_groups": _COMPONENTS + " SELECT actor_id, canonical_id FROM groups",
    "p4_found": _COMPONENTS + " SELECT canonical_id, actor_id AS merged_id FROM groups WHERE actor_id <> canonical_id",
    "p5_found": _SET_PAIRS + " SELECT DISTINCT least(ia, ib) AS left_id, greatest(ia, ib) AS right_id FROM shared WHERE 5 * s >= 4 * (na + nb - s)",
    # Classes of equal sets, linked unless both are of candidates only.
    "p5_classes": _SET_PAIRS + """, own AS (SELECT part, id, string_agg(tech, ',' ORDER BY tech) AS ids FROM kept GROUP BY 1, 2),
class AS (SELECT ids, min(part || id) AS rep FROM own GROUP BY ids),
named AS (SELECT part, id, rep FROM own JOIN class USING (ids)),
linked AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM shared JOIN named x ON x.part = pa AND x.id = ia JOIN named y ON y.part = pb AND y.id = ib WHERE 5 * s >= 4 * (na + nb - s) AND x.rep <> y.rep),
ends AS (SELECT rep, count(*) AS n FROM (SELECT a AS rep, b AS other FROM linked UNION SELECT b, a FROM linked) GROUP BY rep)
SELECT part, id, rep AS class_id, coalesce(n, 0) AS links FROM named LEFT JOIN ends USING (rep)""",
    "p6_frequency": f"""WITH {_CURRENT}, occ AS (SELECT tech, count(*) AS n FROM raw WHERE tech <> '' GROUP BY tech)
SELECT users.tech AS technique_id, occ.n AS occurrences, users.n AS actor_count, round(CAST(users.n AS DOUBLE) / total.n, 9) AS actor_ratio,
  CASE WHEN users.n <= 2 THEN 'rare' WHEN users.n > 0.5 * total.n THEN 'common' END AS mark, technique_name
FROM users JOIN occ USING (tech) CROSS JOIN total LEFT JOIN (SELECT technique_id, min(technique_name) AS technique_name FROM techniques GROUP BY 1) t ON t.technique_id = users.tech""",
    "p6_found": f"""WITH {_CURRENT} SELECT tech AS technique_id, CASE WHEN users.n <= 2 THEN 'rare' ELSE 'common' END AS mark
FROM users CROSS JOIN total WHERE users.n <= 2 OR users.n > 0.5 * total.n""",
}
