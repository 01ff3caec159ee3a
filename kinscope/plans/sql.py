"""SQL for DuckDB that gives the same rows as the core's queries."""

from __future__ import annotations

_E = """E AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS e, event_type || '|' || json_extract_string(props, '$.k') AS f FROM events
  WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL),
N AS (SELECT count(DISTINCT e) AS n FROM E),
W AS (SELECT f, df, n, ln((n + CAST(1 AS DOUBLE)) / (df + CAST(1 AS DOUBLE))) + 1 AS w FROM (SELECT f, count(*) AS df FROM E GROUP BY f) CROSS JOIN N),
LEN AS (SELECT e, sqrt(sum(w * w)) AS len, count(*) AS features, sum(w) AS total FROM E JOIN W USING (f) GROUP BY e),
S AS (SELECT e, f, w, w / len AS u FROM E JOIN W USING (f) JOIN LEN USING (e))"""

_A = """cur AS (SELECT actor_id AS e, technique_ids, name, aliases FROM actors WHERE actor_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY actor_id ORDER BY built_at DESC NULLS LAST) = 1),
A AS (SELECT DISTINCT e, f FROM (SELECT e, trim(split_part(upper(trim(t)), '.', 1)) AS f FROM (SELECT e, unnest(technique_ids) AS t FROM cur)) WHERE f <> ''),
AN AS (SELECT count(DISTINCT e) AS n FROM A),
AW AS (SELECT f, df, n, ln((n + CAST(1 AS DOUBLE)) / (df + CAST(1 AS DOUBLE))) + 1 AS w FROM (SELECT f, count(*) AS df FROM A GROUP BY f) CROSS JOIN AN),
names AS (SELECT technique_id AS f, min(technique_name) AS name FROM techniques GROUP BY 1)"""

_Q = _E + """,
Q AS (SELECT e AS q, f FROM E WHERE CAST(e AS BIGINT) % 20 = 0 UNION ALL SELECT DISTINCT e, 'unseen|0' FROM E WHERE CAST(e AS BIGINT) % 20 = 0),
QV AS (SELECT q, Q.f, W.f IS NOT NULL AS known, w, w / sqrt(sum(w * w) OVER (PARTITION BY q)) AS u FROM Q LEFT JOIN W ON W.f = Q.f),
QS AS (SELECT q, count(*) AS known, sum(w) AS q_total FROM QV WHERE known GROUP BY q),
H AS (SELECT q, S.e, sum(S.u * QV.u) AS dot, count(*) AS matched, sum(S.w) AS shared FROM S JOIN QV ON S.f = QV.f AND QV.known GROUP BY q, S.e)"""

_SCORES = {
    "cosine": "least(greatest(dot, 0), 1) * matched / known",
    "uncorrected": "least(greatest(dot, 0), 1)",
    "jaccard": "CAST(matched AS DOUBLE) / (features + known - matched) * matched / known",
    "weighted": "shared / (total + q_total - shared) * matched / known",
}


def _scored(kind: str) -> str:
    return f"""{_Q},
SC AS (SELECT q AS query_id, e AS entity_id, round({_SCORES[kind]}, 6) AS score, round(CAST(matched AS DOUBLE) / known, 6) AS coverage, matched, known
  FROM H JOIN QS USING (q) JOIN LEN USING (e))"""


_RANKED = _scored("cosine") + """,
R AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM SC WHERE score > 0 AND score >= 0.05 QUALIFY rank <= 10)"""

_LISTS = _RANKED + """,
L AS (SELECT query_id, entity_id, coalesce(string_agg(CASE WHEN S.f IS NOT NULL THEN QV.f END, ',' ORDER BY QV.f), '') AS matched, coalesce(string_agg(CASE WHEN S.f IS NULL THEN QV.f END, ',' ORDER BY QV.f), '') AS missing
  FROM R JOIN QV ON QV.q = query_id AND QV.known LEFT JOIN S ON S.e = entity_id AND S.f = QV.f GROUP BY 1, 2)"""

_CONF = _LISTS + """,
TOP2 AS (SELECT query_id, max(CASE WHEN p = 1 THEN score END) AS s1, coalesce(max(CASE WHEN p = 2 THEN score END), 0) AS s2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS p FROM SC) GROUP BY 1),
RAR AS (SELECT query_id, avg(W.w) / (SELECT max(w) FROM W) AS rarity FROM R JOIN QV ON QV.q = query_id AND QV.known JOIN S ON S.e = entity_id AND S.f = QV.f JOIN W ON W.f = QV.f WHERE rank = 1 GROUP BY 1),
C0 AS (SELECT q AS query_id, QS.known, coalesce(rarity, 0) AS rarity, CASE WHEN rarity IS NULL OR s1 <= 0 THEN 0 ELSE least(1, (s1 - s2) / s1 / CAST(0.15 AS DOUBLE)) END AS margin, CASE WHEN rarity IS NULL THEN 0 ELSE greatest(0, least(1, (QS.known - 3) / CAST(9 AS DOUBLE))) END AS sufficiency
  FROM QS LEFT JOIN TOP2 ON TOP2.query_id = q LEFT JOIN RAR ON RAR.query_id = q),
C1 AS (SELECT *, round(CAST(0.4 AS DOUBLE) * rarity + CAST(0.35 AS DOUBLE) * margin + CAST(0.25 AS DOUBLE) * sufficiency, 6) AS score FROM C0),
C AS (SELECT query_id, known, round(rarity, 6) AS rarity, round(margin, 6) AS margin, round(sufficiency, 6) AS sufficiency, score,
  CASE WHEN known < 3 THEN 'low' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN rarity = least(rarity, margin, sufficiency) THEN 'rarity' WHEN margin = least(rarity, margin, sufficiency) THEN 'margin' ELSE 'sufficiency' END AS weakest FROM C1)"""

_P = _E + """,
P0 AS (SELECT a.e AS left_id, b.e AS right_id, sum(a.u * b.u) AS dot, count(*) AS shared, sum(a.w) AS shared_w FROM S a JOIN S b ON a.f = b.f AND a.e < b.e GROUP BY 1, 2)"""
_PC = _P + ", P AS (SELECT left_id, right_id, round(least(greatest(dot, 0), 1), 6) AS score, shared FROM P0)"
_SYM = _PC + ", SYM AS (SELECT left_id AS a, right_id AS b, score, shared FROM P UNION ALL SELECT right_id, left_id, score, shared FROM P)"
_TWO = _E + ", ab AS (SELECT min(e) AS a, (SELECT e FROM (SELECT DISTINCT e FROM E ORDER BY e LIMIT 2) ORDER BY e DESC LIMIT 1) AS b FROM E)"


def _neighbours(name: str, value: str) -> str:
    return f"""{name} AS (SELECT row_number() OVER (ORDER BY score DESC, entity_id) AS rank, * FROM (
  SELECT x.e AS entity_id, round({value}, 6) AS score, any_value(lx.features) AS features, count(*) AS shared, round(avg(x.w), 6) AS mean_shared_w, round(max(x.w), 6) AS max_shared_w
  FROM S x JOIN S o ON x.f = o.f JOIN ab ON o.e = ab.a AND x.e <> ab.a JOIN LEN lx ON lx.e = x.e JOIN LEN lo ON lo.e = o.e GROUP BY x.e) QUALIFY rank <= 15)"""


_NC = _neighbours("NC", "least(1, sum(x.u * o.u))")
_NJ = _neighbours("NJ", "CAST(count(*) AS DOUBLE) / (any_value(lx.features) + any_value(lo.features) - count(*))")

_PROFILE = _E + """,
G AS (SELECT DISTINCT e, CAST(CAST(e AS BIGINT) % 8 - 1 AS INTEGER) AS c FROM E),
PR0 AS (SELECT c AS cluster_id, f AS feature_id, round(CAST(count(*) AS DOUBLE) / any_value(size), 6) AS share_in_cluster,
    round((CAST(count(*) AS DOUBLE) / any_value(size)) / (CAST(any_value(users) AS DOUBLE) / (SELECT count(*) FROM G)), 6) AS lift
  FROM E JOIN G USING (e) JOIN (SELECT c, count(*) AS size FROM G GROUP BY c) USING (c) JOIN (SELECT f, count(*) AS users FROM E GROUP BY f) USING (f) WHERE c >= 0 GROUP BY 1, 2),
PR AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY lift DESC, share_in_cluster DESC, feature_id) AS place FROM PR0 QUALIFY place <= 10),
SIG0 AS (SELECT *, max(CASE WHEN share_in_cluster >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY cluster_id) AS has FROM PR),
SIG AS (SELECT cluster_id, feature_id, row_number() OVER (PARTITION BY cluster_id ORDER BY CASE WHEN has = 1 THEN CAST(-place AS DOUBLE) ELSE share_in_cluster * lift END DESC, feature_id) AS nr
  FROM SIG0 WHERE has = 0 OR share_in_cluster >= 0.5 QUALIFY nr <= 3)"""

_TRIALS = """T AS (SELECT DISTINCT ON (candidate_id) actor_id AS entity_id, CASE WHEN rank <= 5 THEN rank ELSE -1 END AS rank, CAST(query_id % 4 AS VARCHAR) AS sample_size,
    len(coalesce(matched_technique_ids, [])) + len(coalesce(missing_technique_ids, [])) AS fc,
    CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS level, query_id FROM candidates WHERE actor_id IS NOT NULL),
T1 AS (SELECT *, CASE WHEN fc < 5 THEN '00-04' WHEN fc <= 10 THEN '05-10' WHEN fc <= 20 THEN '11-20' WHEN fc <= 35 THEN '21-35' WHEN fc <= 50 THEN '36-50' ELSE '51+' END AS bucket FROM T)"""

# The paired test of X (entity_id, a) and Y (entity_id, b). The normal tail by Simpson's rule over 4,000 steps from z to z + 12.
_PAIRED = """D AS (SELECT round(a - b, 9) AS d FROM X JOIN Y USING (entity_id)),
RK AS (SELECT d, (rank() OVER (ORDER BY abs(d))) + (count(*) OVER (PARTITION BY abs(d)) - 1) / CAST(2 AS DOUBLE) AS r FROM D WHERE d <> 0),
TIE AS (SELECT coalesce(sum(CAST(t AS DOUBLE) ** 3 - t), 0) AS ties FROM (SELECT count(*) AS t FROM D WHERE d <> 0 GROUP BY abs(d))),
ST AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w FROM RK),
Z AS (SELECT abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM ST CROSS JOIN TIE),
TAIL AS (SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z + i * CAST(0.003 AS DOUBLE), 2) / 2)) * CAST(0.001 AS DOUBLE) * 2 / sqrt(2 * pi()) AS p FROM Z CROSS JOIN range(4001) AS s(i))
SELECT count(*) AS entities, round(avg(d), 6) AS delta, count(CASE WHEN d > 0 THEN 1 END) AS better, count(CASE WHEN d < 0 THEN 1 END) AS worse, count(CASE WHEN d = 0 THEN 1 END) AS tied, (SELECT round(p, 6) FROM TAIL) AS p FROM D"""


def _drawn(fraction: float, noise: float = 0.0, least: int = 0) -> str:
    """PLAN (trial_id, entity_id, feature_id, is_noise, feature_count): two hashed draws a user."""
    plan = f"""E0 AS (SELECT * FROM E WHERE e IN (SELECT e FROM E GROUP BY e HAVING count(*) >= {least})),
O AS (SELECT e, f, count(*) OVER (PARTITION BY e) AS fc, CAST(floor(count(*) OVER (PARTITION BY e) * CAST({fraction} AS DOUBLE)) AS BIGINT) AS size FROM E0),
PICK AS (SELECT e, f, fc, size, r FROM O CROSS JOIN (VALUES (0), (1)) AS x(r) WHERE size >= 3 QUALIFY row_number() OVER (PARTITION BY e, r ORDER BY substr(md5('1337#' || r || '#' || e || '#' || f), 1, 13), f) <= size)"""
    if not noise:
        return plan + ", PLAN AS (SELECT e || '/' || r AS trial_id, e AS entity_id, f AS feature_id, false AS is_noise, fc AS feature_count FROM PICK)"
    return plan + f""",
POOL AS (SELECT f, n, sum(n) OVER (ORDER BY md5(f), f ROWS UNBOUNDED PRECEDING) AS upto FROM (SELECT f, count(*) AS n FROM E0 GROUP BY f)),
HEAD AS (SELECT DISTINCT e || '/' || r AS trial_id, e, fc, CAST(round_even(size * CAST({noise} AS DOUBLE), 0) AS BIGINT) AS want FROM PICK),
DRAW AS (SELECT HEAD.*, j, CAST(floor(CAST('0x' || substr(md5('1337n#' || trial_id || '#' || j), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) * (SELECT sum(n) FROM POOL)) AS BIGINT) AS pos FROM HEAD CROSS JOIN range(1344) AS s(j)),
HIT AS (SELECT trial_id, e, fc, want, f, min(j) AS j FROM DRAW JOIN POOL ON pos < upto AND pos >= upto - n WHERE NOT EXISTS (SELECT 1 FROM E0 WHERE E0.e = DRAW.e AND E0.f = POOL.f) GROUP BY ALL),
NOISE AS (SELECT * FROM HIT QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY j, f) <= want),
PLAN AS (SELECT e || '/' || r AS trial_id, e AS entity_id, f AS feature_id, false AS is_noise, fc AS feature_count FROM PICK UNION ALL SELECT trial_id, e, f, true, fc FROM NOISE)"""


def _run(plan: str, scheme: str = "smooth_idf", kind: str = "cosine", least: int = 5) -> str:
    """SELECT of the trials of a plan, scored against the users with at least `least` features."""
    weight = {"smooth_idf": "ln((n + CAST(1 AS DOUBLE)) / (df + CAST(1 AS DOUBLE))) + 1", "plain_idf": "ln(CAST(n AS DOUBLE) / df)", "binary": "CAST(1 AS DOUBLE)"}[scheme]
    world = f"""{_E.split("N AS (")[0]}{plan},
K AS (SELECT * FROM E WHERE e IN (SELECT e FROM E GROUP BY e HAVING count(*) >= {least})), N AS (SELECT count(DISTINCT e) AS n FROM K),
W AS (SELECT f, df, n, {weight} AS w, ln((n + CAST(1 AS DOUBLE)) / (df + CAST(1 AS DOUBLE))) + 1 AS rar FROM (SELECT f, count(*) AS df FROM K GROUP BY f) CROSS JOIN N),
LEN AS (SELECT e, sqrt(sum(w * w)) AS len, count(*) AS features, sum(w) AS total FROM K JOIN W USING (f) WHERE w > 0 GROUP BY e),
S AS (SELECT e, f, w, w / len AS u FROM K JOIN W USING (f) JOIN LEN USING (e) WHERE w > 0),
Q AS (SELECT trial_id AS q, feature_id AS f FROM PLAN),
"""
    rest = _CONF[_CONF.index("QV AS (SELECT q, Q.f") :].replace("avg(W.w) / (SELECT max(w) FROM W)", "avg(W.rar) / (SELECT max(rar) FROM W)").replace(_SCORES["cosine"], _SCORES[kind])
    return f"""WITH {world}{rest}
SELECT P.trial_id, P.entity_id, P.sample_size, P.feature_count, P.noise_count, coalesce(R.rank, -1) AS rank, coalesce(B.score, 0) AS top_score, C.score AS confidence, C.level
FROM (SELECT trial_id, entity_id, count(*) AS sample_size, max(feature_count) AS feature_count, count(CASE WHEN is_noise THEN 1 END) AS noise_count FROM PLAN GROUP BY 1, 2) P
LEFT JOIN R ON R.query_id = P.trial_id AND R.entity_id = P.entity_id LEFT JOIN R B ON B.query_id = P.trial_id AND B.rank = 1 LEFT JOIN C ON C.query_id = P.trial_id"""


def _report(trials: str, also: str = "") -> str:
    """SELECT of the report of a SELECT of trials."""
    return f"""SELECT *{also} FROM (WITH T AS ({trials}), T1 AS (SELECT *, CAST(sample_size AS VARCHAR) AS ss, CASE WHEN feature_count < 5 THEN '00-04' WHEN feature_count <= 10 THEN '05-10' WHEN feature_count <= 20 THEN '11-20' WHEN feature_count <= 35 THEN '21-35' WHEN feature_count <= 50 THEN '36-50' ELSE '51+' END AS bucket FROM T),
G AS (SELECT CASE WHEN grouping(ss) = 0 THEN 'sample_size' WHEN grouping(level) = 0 THEN 'level' WHEN grouping(bucket) = 0 THEN 'bucket' ELSE 'all' END AS dimension, coalesce(ss, level, bucket, 'all') AS value,
  count(*) AS trials, count(DISTINCT entity_id) AS entities, round(avg(CAST(rank BETWEEN 1 AND 1 AS INT)), 6) AS top1, round(avg(CAST(rank BETWEEN 1 AND 3 AS INT)), 6) AS top3, round(avg(CAST(rank BETWEEN 1 AND 5 AS INT)), 6) AS top5,
  round(avg(CASE WHEN rank >= 1 THEN CAST(1 AS DOUBLE) / rank ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN rank >= 1 THEN rank END), 6) AS mean_rank, count(CASE WHEN rank < 1 THEN 1 END) AS misses
  FROM T1 GROUP BY GROUPING SETS ((ss), (level), (bucket), ()))
SELECT *, round(CAST(trials AS DOUBLE) / (SELECT trials FROM G WHERE dimension = 'all'), 6) AS share FROM G)"""


def _regime(regime: str, fraction: float, noise: float) -> str:
    runs = {"smooth_idf": ("smooth_idf", "cosine"), "binary": ("binary", "cosine"), "jaccard": ("smooth_idf", "jaccard")}
    return " UNION ALL ".join(_report(_run(_drawn(fraction, noise, 5), *how), f", '{regime}' AS regime, '{label}' AS run") for label, how in runs.items())


_ABLATIONS = {"scheme smooth_idf": ("smooth_idf", "cosine", 5), "scheme plain_idf": ("plain_idf", "cosine", 5), "scheme binary": ("binary", "cosine", 5), "min_features 5": ("smooth_idf", "cosine", 5), "min_features 8": ("smooth_idf", "cosine", 8), "min_features 10": ("smooth_idf", "cosine", 10), "coverage on": ("smooth_idf", "cosine", 5), "coverage off": ("smooth_idf", "uncorrected", 5)}

_CASE = _TWO + """,
FT AS (SELECT S.f, S.w, df, n, row_number() OVER (ORDER BY S.w DESC, S.f) AS place, count(*) OVER () AS many FROM S JOIN ab ON S.e = ab.a JOIN W ON W.f = S.f)"""
_AHEAT = _A + """,
HT AS (SELECT AW.f, coalesce(names.name, AW.f) AS nm, CASE WHEN hi > lo THEN (w - lo) / (hi - lo) ELSE 1 END AS heat FROM AW LEFT JOIN names USING (f) CROSS JOIN (SELECT min(w) AS lo, max(w) AS hi FROM AW)),
TC AS (SELECT technique_id AS f, tactic FROM (SELECT technique_id, trim(unnest(string_split(tactics, '|'))) AS tactic FROM techniques) WHERE tactic <> '')"""
# Groups of actors by the keys of their names, edges moved to each group's lowest id.
_NORM = _A + r""",
NT AS (SELECT e, name AS n FROM cur UNION ALL SELECT e, unnest(aliases) FROM cur),
NK AS (SELECT DISTINCT e, key FROM (SELECT e, trim(regexp_replace(lower(regexp_replace(strip_accents(regexp_replace(n, '[\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]', ' ', 'g')), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS key FROM NT)
  WHERE length(key) >= 3 AND key NOT IN ('apt', 'ta', 'unc', 'group', 'team', 'crew', 'gang', 'actor', 'threat', 'cluster', 'operation', 'campaign', 'unknown', 'unattributed', 'g')),
NH AS (SELECT DISTINCT h.hub AS u, NK.e AS v FROM NK JOIN (SELECT key, min(e) AS hub FROM NK GROUP BY key) h USING (key)),
NB AS (SELECT u, v FROM NH UNION SELECT v, u FROM NH),
reach AS (SELECT e AS u, e AS v FROM cur UNION SELECT reach.u, NB.v FROM reach JOIN NB ON reach.v = NB.u),
g AS (SELECT u AS e, min(v) AS root FROM reach GROUP BY u),
NR AS (SELECT DISTINCT root, f FROM A JOIN g USING (e)),
NE AS (SELECT root AS entity_id, f AS feature_id FROM NR WHERE root IN (SELECT root FROM NR GROUP BY root HAVING count(*) >= 15))"""
_COLUMN = "coalesce(list_position(['reconnaissance', 'resource-development', 'initial-access', 'execution', 'persistence', 'privilege-escalation', 'defense-evasion', 'stealth', 'defense-impairment', 'credential-access', 'discovery', 'lateral-movement', 'collection', 'command-and-control', 'exfiltration', 'impact'], tactic) - 1, 16)"

ORACLES: dict[str, str] = {
    "feature_frequency": f"WITH {_A} SELECT AW.f AS feature_id, coalesce(names.name, AW.f) AS feature_name, df AS entity_count, round(CAST(df AS DOUBLE) / n, 6) AS entity_ratio FROM AW LEFT JOIN names USING (f)",
    "frequency_summary": f"WITH {_A} SELECT count(*) AS features, round(avg(CASE WHEN df = 1 THEN 1.0 ELSE 0 END), 6) AS singleton_share, round(avg(CASE WHEN CAST(df AS DOUBLE) / n > 0.5 THEN 1.0 ELSE 0 END), 6) AS commodity_share FROM AW",
    "feature_weights": f"WITH {_E} SELECT scheme, f AS feature_id, round(CASE scheme WHEN 'smooth_idf' THEN w WHEN 'plain_idf' THEN ln(CAST(n AS DOUBLE) / df) ELSE 1 END, 6) AS weight, round(w, 6) AS rarity FROM W CROSS JOIN (VALUES ('smooth_idf'), ('plain_idf'), ('binary')) AS s(scheme)",
    "feature_bands": f"""WITH {_E} SELECT f AS feature_id, df AS entity_count, CASE WHEN df <= 3 THEN 'distinctive' WHEN CAST(df AS DOUBLE) / n >= 0.4 THEN 'commodity' ELSE 'middle' END AS band,
  round(CASE WHEN hi > lo THEN (w - lo) / (hi - lo) ELSE 1 END, 6) AS heat, CASE WHEN CAST(df AS DOUBLE) / n <= 0.05 THEN 'distinctive' WHEN CAST(df AS DOUBLE) / n >= 0.35 THEN 'common' ELSE 'usual' END AS share_band
FROM W CROSS JOIN (SELECT min(w) AS lo, max(w) AS hi FROM W)""",
    "vector_space": f"WITH {_E} SELECT e AS entity_id, f AS feature_id, round(w, 6) AS w, round(u, 6) AS u FROM S",
    "query_vectors": f"WITH {_Q} SELECT q AS query_id, f AS feature_id, known, round(w, 6) AS w, round(u, 6) AS u FROM QV",
    "entity_totals": f"WITH {_A} SELECT e AS entity_id, count(*) AS features, round(sum(w), 6) AS total FROM A JOIN AW USING (f) GROUP BY e",
    "scores_cosine": f"WITH {_scored('cosine')} SELECT * FROM SC",
    "scores_cosine_uncorrected": f"WITH {_scored('uncorrected')} SELECT * FROM SC",
    "scores_jaccard": f"WITH {_scored('jaccard')} SELECT * FROM SC",
    "scores_weighted_jaccard": f"WITH {_scored('weighted')} SELECT * FROM SC",
    "candidates": f"WITH {_RANKED} SELECT * FROM R",
    "candidate_evidence": f"""WITH {_RANKED},
EV AS (SELECT query_id, entity_id, S.f AS feature_id, S.w, round(S.w * S.w / sum(S.w * S.w) OVER (PARTITION BY query_id, entity_id), 6) AS share FROM R JOIN QV ON QV.q = query_id AND QV.known JOIN S ON S.e = entity_id AND S.f = QV.f)
SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id, entity_id ORDER BY share DESC, feature_id) AS place, feature_id, feature_id AS feature_name, round(w, 6) AS w, share FROM EV QUALIFY place <= 8""",
    "matched_and_missing": f"WITH {_LISTS} SELECT * FROM L",
    "query_confidence": f"WITH {_CONF} SELECT * FROM C",
    "query_result": f"""WITH {_CONF} SELECT C.query_id, C.known AS known_features, C.score AS confidence, level, weakest, R.rank, R.entity_id, 'user ' || R.entity_id AS entity_name, R.score, R.coverage, L.matched, L.missing
FROM C LEFT JOIN R ON R.query_id = C.query_id LEFT JOIN L ON L.query_id = R.query_id AND L.entity_id = R.entity_id""",
    "pairs_cosine": f"WITH {_PC} SELECT * FROM P",
    "pairs_jaccard": f"WITH {_P} SELECT left_id, right_id, round(CAST(shared AS DOUBLE) / (a.features + b.features - shared), 6) AS score, shared FROM P0 JOIN LEN a ON a.e = left_id JOIN LEN b ON b.e = right_id",
    "pairs_weighted_jaccard": f"WITH {_P} SELECT left_id, right_id, round(shared_w / (a.total + b.total - shared_w), 6) AS score, shared FROM P0 JOIN LEN a ON a.e = left_id JOIN LEN b ON b.e = right_id",
    "similarity_stats": f"""WITH {_PC}, ALLP AS (SELECT coalesce(P.score, 0) AS score FROM LEN a JOIN LEN b ON a.e < b.e LEFT JOIN P ON left_id = a.e AND right_id = b.e)
SELECT count(*) AS pairs, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.9), 6) AS p90, max(score) AS max FROM ALLP""",
    "similarity_matrix": f"WITH {_SYM} SELECT x.e AS left_id, y.e AS right_id, CASE WHEN x.e = y.e THEN 1 ELSE coalesce(score, 0) END AS score FROM LEN x CROSS JOIN LEN y LEFT JOIN SYM ON a = x.e AND b = y.e",
    "nearest_entities": f"WITH {_SYM} SELECT a AS entity_id, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank, b AS neighbour_id, score, shared FROM SYM QUALIFY rank <= 8",
    "neighbour_table": f"WITH {_TWO}, {_NC} SELECT * FROM NC",
    "neighbour_rank_shift": f"WITH {_TWO}, {_NC}, {_NJ} SELECT coalesce(NC.entity_id, NJ.entity_id) AS entity_id, NC.rank AS rank_first, NJ.rank AS rank_second, NC.rank - NJ.rank AS shift FROM NC FULL JOIN NJ ON NC.entity_id = NJ.entity_id",
    "compare_entities": f"WITH {_TWO}, X AS (SELECT f, w FROM S JOIN ab ON e = a), Y AS (SELECT f, w FROM S JOIN ab ON e = b) SELECT coalesce(X.f, Y.f) AS feature_id, CASE WHEN X.f IS NULL THEN 'right' WHEN Y.f IS NULL THEN 'left' ELSE 'both' END AS side, round(coalesce(X.w, Y.w), 6) AS w FROM X FULL JOIN Y ON X.f = Y.f",
    "comparison_summary": f"""WITH {_TWO}, X AS (SELECT f, w, u FROM S JOIN ab ON e = a), Y AS (SELECT f, w, u FROM S JOIN ab ON e = b),
Z AS (SELECT X.f AS xf, Y.f AS yf, X.u AS xu, Y.u AS yu, X.w FROM X FULL JOIN Y ON X.f = Y.f)
SELECT count(CASE WHEN xf = yf THEN 1 END) AS shared, count(CASE WHEN yf IS NULL THEN 1 END) AS only_left, count(CASE WHEN xf IS NULL THEN 1 END) AS only_right,
  round(CAST(count(CASE WHEN xf = yf THEN 1 END) AS DOUBLE) / count(*), 6) AS jaccard, round(least(1, coalesce(sum(xu * yu), 0)), 6) AS cosine, round(coalesce(avg(CASE WHEN xf = yf THEN w END), 0), 6) AS mean_shared_w FROM Z""",
    "cluster_profile": f"WITH {_PROFILE} SELECT * FROM PR",
    "cluster_signature": f"WITH {_PROFILE} SELECT cluster_id, nr AS place, feature_id FROM SIG",
    "cluster_labels": f"WITH {_PROFILE} SELECT cluster_id, string_agg(upper(feature_id), ' · ' ORDER BY nr) AS label FROM SIG WHERE nr <= 2 GROUP BY 1",
    "sparse_filter": """WITH B AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS entity_id, p_brand || '|' || p_type AS feature_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)
SELECT * FROM B WHERE entity_id IN (SELECT entity_id FROM B GROUP BY 1 HAVING count(*) >= 20)""",
    "used_features": f"WITH {_A} SELECT f AS feature_id, name AS feature_name FROM names WHERE f IN (SELECT f FROM A WHERE e IN (SELECT e FROM A GROUP BY e HAVING count(*) >= 15))",
    "rolled_up_ids": "SELECT technique_id, trim(split_part(upper(trim(technique_id)), '.', 1)) AS parent_id, coalesce(regexp_matches(upper(trim(technique_id)), '^T[0-9]{4}([.][0-9]{3})?$'), false) AS is_id, count(*) AS sightings FROM actor_technique GROUP BY 1",
    "sighting_edges": "SELECT actor_id AS entity_id, trim(split_part(upper(trim(technique_id)), '.', 1)) AS feature_id, count(*) AS sightings, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM actor_technique WHERE actor_id IS NOT NULL AND trim(split_part(upper(trim(technique_id)), '.', 1)) <> '' GROUP BY 1, 2",
    "feature_categories": "SELECT tactic, count(DISTINCT technique_id) AS techniques FROM (SELECT technique_id, trim(unnest(string_split(tactics, '|'))) AS tactic FROM techniques) WHERE tactic <> '' GROUP BY 1",
    "footprint": f"WITH {_A}, TT AS (SELECT technique_id AS f, tactic FROM (SELECT technique_id, trim(unnest(string_split(tactics, '|'))) AS tactic FROM techniques) WHERE tactic <> '') SELECT e AS entity_id, tactic, count(*) AS techniques FROM A JOIN TT USING (f) GROUP BY 1, 2",
    # Wide spaces as spaces, marks off by decomposition, letters that have none left out: what an ASCII encoding keeps.
    "alias_keys": r"""WITH X AS (SELECT attack_id, name AS t FROM raw_actors UNION ALL SELECT attack_id, unnest(aliases) FROM raw_actors),
K AS (SELECT DISTINCT attack_id, trim(regexp_replace(lower(regexp_replace(strip_accents(regexp_replace(t, '[\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]', ' ', 'g')), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS key FROM X)
SELECT * FROM K WHERE length(key) >= 3 AND key NOT IN ('apt', 'ta', 'unc', 'group', 'team', 'crew', 'gang', 'actor', 'threat', 'cluster', 'operation', 'campaign', 'unknown', 'unattributed', 'g')""",
    "merged_components": """WITH RECURSIVE named AS (SELECT merge_id, upper(trim(canonical_id)) AS id FROM actor_merges UNION SELECT merge_id, upper(trim(id)) FROM (SELECT merge_id, unnest(merged_ids) AS id FROM actor_merges)),
i AS (SELECT DISTINCT merge_id, id FROM named WHERE id <> ''), edges AS (SELECT DISTINCT a.id AS u, b.id AS v FROM i a JOIN i b USING (merge_id)),
reach AS (SELECT u, v FROM edges UNION SELECT reach.u, edges.v FROM reach JOIN edges ON reach.v = edges.u) SELECT u AS node, min(v) AS root FROM reach GROUP BY u""",
    "bundle_entities": """SELECT stix_id, trim(attack_id) AS attack_id, trim(name) AS name FROM (SELECT * FROM raw_actors QUALIFY row_number() OVER (PARTITION BY stix_id ORDER BY modified DESC, coalesce(revoked, false) DESC, coalesce(deprecated, false) DESC, coalesce(name, '') DESC) = 1)
WHERE NOT coalesce(revoked, false) AND NOT coalesce(deprecated, false) AND trim(name) <> '' AND trim(attack_id) <> ''""",
    "actor_overview": f"""WITH {_A}, AL AS (SELECT e, count(DISTINCT lower(trim(a))) AS n FROM (SELECT e, name, unnest(aliases) AS a FROM cur) WHERE trim(a) <> '' AND lower(trim(a)) <> coalesce(lower(name), '') GROUP BY e)
SELECT e AS entity_id, name AS entity_name, coalesce(AL.n, 0) AS aliases, coalesce(F.n, 0) AS features FROM cur LEFT JOIN AL USING (e) LEFT JOIN (SELECT e, count(*) AS n FROM A GROUP BY e) F USING (e)""",
    "search_features": f"""WITH {_A}, X AS (SELECT AW.f, coalesce(names.name, AW.f) AS nm, w FROM AW LEFT JOIN names USING (f)),
Y AS (SELECT f AS feature_id, nm AS feature_name, w, CASE WHEN lower(f) = 'cl' THEN 1000 WHEN starts_with(lower(f), 'cl') THEN 800 - length(f) WHEN starts_with(lower(nm), 'cl') THEN 600 WHEN regexp_matches(lower(nm), '(^|[^a-z0-9])cl') THEN 500 WHEN contains(lower(nm), 'cl') THEN 400 ELSE 0 END AS score FROM X)
SELECT row_number() OVER (ORDER BY score DESC, w DESC, feature_id) AS place, feature_id, feature_name, score FROM Y WHERE score > 0 QUALIFY place <= 8""",
    "search_entities": f"""WITH {_A}, X AS (SELECT e, name, lower(name) AS n, aliases AS raw, list_transform(coalesce(aliases, []), lambda a: lower(coalesce(a, ''))) AS al FROM cur WHERE name IS NOT NULL),
Y AS (SELECT e AS entity_id, name AS entity_name, CASE WHEN lower(e) = 'compass' THEN 1000 WHEN starts_with(lower(e), 'compass') THEN 800 WHEN starts_with(n, 'compass') THEN 700 WHEN len(list_filter(al, lambda a: starts_with(a, 'compass'))) > 0 THEN 600 WHEN contains(n, 'compass') OR len(list_filter(al, lambda a: contains(a, 'compass'))) > 0 THEN 400 ELSE 0 END AS score,
  CASE WHEN contains(n, 'compass') THEN NULL ELSE raw[list_position(list_transform(al, lambda a: contains(a, 'compass')), true)] END AS matched_alias FROM X)
SELECT row_number() OVER (ORDER BY score DESC, entity_name, entity_id) AS place, entity_id, entity_name, matched_alias, score FROM Y WHERE score > 0 QUALIFY place <= 8""",
    "trial_plan": f"""WITH {_E}, O AS (SELECT e, f, count(*) OVER (PARTITION BY e) AS fc FROM E),
M AS (SELECT e, f, fc, r, row_number() OVER (PARTITION BY e, r ORDER BY substr(md5('1337#' || r || '#' || e || '#' || f), 1, 13), f) AS p FROM O CROSS JOIN (VALUES (0), (1)) AS x(r) WHERE floor(fc * CAST(0.5 AS DOUBLE)) >= 3)
SELECT e || '/' || r AS trial_id, e AS entity_id, f AS feature_id, fc AS feature_count FROM M WHERE p <= floor(fc * CAST(0.5 AS DOUBLE))""",
    "metric_report": f"""WITH {_TRIALS}, G AS (SELECT CASE WHEN grouping(sample_size) = 0 THEN 'sample_size' WHEN grouping(level) = 0 THEN 'level' WHEN grouping(bucket) = 0 THEN 'bucket' ELSE 'all' END AS dimension, coalesce(sample_size, level, bucket, 'all') AS value,
  count(*) AS trials, count(DISTINCT entity_id) AS entities, round(avg(CAST(rank BETWEEN 1 AND 1 AS INT)), 6) AS top1, round(avg(CAST(rank BETWEEN 1 AND 3 AS INT)), 6) AS top3, round(avg(CAST(rank BETWEEN 1 AND 5 AS INT)), 6) AS top5,
  round(avg(CASE WHEN rank >= 1 THEN CAST(1 AS DOUBLE) / rank ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN rank >= 1 THEN rank END), 6) AS mean_rank, count(CASE WHEN rank < 1 THEN 1 END) AS misses
  FROM T1 GROUP BY GROUPING SETS ((sample_size), (level), (bucket), ()))
SELECT *, round(CAST(trials AS DOUBLE) / (SELECT trials FROM G WHERE dimension = 'all'), 6) AS share FROM G""",
    "hardest_entities": f"WITH {_TRIALS} SELECT entity_id, count(*) AS trials, round(avg(CAST(rank = 1 AS INT)), 6) AS top1 FROM T GROUP BY 1 ORDER BY top1, trials DESC, entity_id LIMIT 10",
    "paired_comparison": f"WITH {_TRIALS}, X AS (SELECT entity_id, avg(CAST(rank = 1 AS INT)) AS a FROM T WHERE query_id % 2 = 0 GROUP BY 1), Y AS (SELECT entity_id, avg(CAST(rank = 1 AS INT)) AS b FROM T WHERE query_id % 2 = 1 GROUP BY 1), {_PAIRED}",
    "answer_changes": """WITH X AS (SELECT query_id AS revision, actor_id AS entity_id, CAST(min(rank) AS BIGINT) AS rank FROM candidates WHERE actor_id IS NOT NULL GROUP BY 1, 2), Y AS (SELECT *, lag(rank) OVER (PARTITION BY entity_id ORDER BY revision) AS before FROM X)
SELECT revision, entity_id, rank, before, CASE WHEN before IS NULL THEN 'new' WHEN rank < before THEN 'up' WHEN rank > before THEN 'down' ELSE 'same' END AS change FROM Y""",
    "noise_pool": f"WITH {_A} SELECT f AS feature_id, count(*) AS n FROM A GROUP BY f",
    "stream_windows": "SELECT date_trunc('day', ts) AS window_start, event_type AS kind, count(*) AS events FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "retrieval_trials": _run(_drawn(0.5)),
    "retrieval_report": _report(_run(_drawn(0.5))),
    "regime_b_report": _regime("B", 0.25, 0.0),
    "regime_c_report": _regime("C", 0.25, 0.3),
    "regime_c_test": f"WITH X AS (SELECT entity_id, avg(CAST(rank = 1 AS INT)) AS a FROM ({_run(_drawn(0.25, 0.3, 5))}) GROUP BY 1), Y AS (SELECT entity_id, avg(CAST(rank = 1 AS INT)) AS b FROM ({_run(_drawn(0.25, 0.3, 5), 'binary')}) GROUP BY 1), {_PAIRED}",
    "ablations": " UNION ALL ".join(_report(_run(_drawn(0.25), *how), f", '{label}' AS label") for label, how in _ABLATIONS.items()),
    "noise_plan": f"WITH {_E}, {_drawn(0.25, 0.3)} SELECT * FROM PLAN",
    "fixed_plan": f"""WITH {_E}, O AS (SELECT e, f, count(*) OVER (PARTITION BY e) AS fc FROM E)
SELECT e || '/' || size || '/' || r AS trial_id, e AS entity_id, f AS feature_id, fc AS feature_count FROM O CROSS JOIN (VALUES (3), (5), (8), (12)) AS z(size) CROSS JOIN (VALUES (0), (1)) AS x(r) WHERE size <= fc
QUALIFY row_number() OVER (PARTITION BY e, size, r ORDER BY substr(md5('1337#' || size || '/' || r || '#' || e || '#' || f), 1, 13), f) <= size""",
    "plan_summary": f"WITH {_E}, {_drawn(0.5)} SELECT sample_size, count(*) AS trials FROM (SELECT trial_id, count(*) AS sample_size FROM PLAN GROUP BY 1) GROUP BY 1",
    "skipped_entities": f"WITH {_E} SELECT e AS entity_id, count(*) AS feature_count FROM E GROUP BY 1 HAVING floor(count(*) * CAST(0.05 AS DOUBLE)) < 3",
    "case_features": f"WITH {_CASE} SELECT place, f AS feature_id, f AS feature_name, round(w, 6) AS weight, df AS entity_count, CASE WHEN df <= 3 THEN 'distinctive' WHEN CAST(df AS DOUBLE) / n >= 0.4 THEN 'commodity' ELSE 'middle' END AS band FROM FT",
    "case_candidates": f"""WITH {_CASE}, Q AS (SELECT 'rare' AS q, f FROM FT WHERE place <= least(8, many // 2) UNION ALL SELECT 'common', f FROM FT WHERE place > many - least(8, many // 2)),
{_RANKED[_RANKED.index("QV AS (SELECT q, Q.f"):]} SELECT query_id, rank, entity_id, score, coverage, matched, entity_id = (SELECT a FROM ab) AS is_target FROM R""",
    "dossier_features": f"WITH {_TWO} SELECT f AS feature_id, e AS entity_id, round(w, 6) AS w, round(u, 6) AS u, f AS feature_name FROM S JOIN ab ON e = a",
    "dossier_neighbours": f"WITH {_SYM}, ab AS (SELECT min(e) AS own FROM E) SELECT a AS entity_id, row_number() OVER (ORDER BY score DESC, b) AS rank, b AS neighbour_id, score, shared FROM SYM JOIN ab ON a = own QUALIFY rank <= 8",
    "dossier_mates": f"WITH {_TWO}, G AS (SELECT DISTINCT e, CAST(e AS BIGINT) % 8 - 1 AS c FROM E) SELECT e AS entity_id FROM G, ab WHERE e <> b AND c = (SELECT c FROM G WHERE e = b) AND c >= 0",
    "request_noise": f"""WITH {_E}, five AS (SELECT DISTINCT f FROM E ORDER BY f LIMIT 5), NP AS (SELECT f, count(*) AS n FROM E WHERE f NOT IN (SELECT f FROM five) GROUP BY f)
SELECT f AS feature_id FROM NP ORDER BY -ln(greatest(CAST('0x' || substr(md5('1337#' || f), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE), 1e-15)) / n, f LIMIT 5""",
    "blind_case": f"""WITH {_E}, CN AS (SELECT e, count(*) AS n FROM S GROUP BY e), CH AS (SELECT e, n FROM CN ORDER BY CASE WHEN n >= 10 THEN 0 ELSE 1 END, substr(md5('1337#' || e), 1, 13), e LIMIT 1)
SELECT S.e AS entity_id, f AS feature_id FROM S JOIN CH ON S.e = CH.e QUALIFY row_number() OVER (ORDER BY substr(md5('1337f#' || f), 1, 13), f) <= (SELECT least(n, greatest(3, n // 2)) FROM CH)""",
    "overview_clusters": f"WITH {_PROFILE} SELECT * FROM (SELECT c AS cluster_id, count(*) AS size FROM G WHERE c >= 0 GROUP BY c) LEFT JOIN (SELECT cluster_id, string_agg(feature_id, ' · ' ORDER BY nr) AS label FROM SIG WHERE nr <= 2 GROUP BY 1) USING (cluster_id)",
    "overview_categories": f"WITH {_AHEAT} SELECT {_COLUMN} AS place, tactic AS category, CASE WHEN {_COLUMN} < 16 THEN replace(title, ' And ', ' and ') ELSE title END AS title, features FROM (SELECT tactic, count(DISTINCT f) AS features, array_to_string(list_transform(string_split(tactic, '-'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM TC GROUP BY tactic)",
    "matrix_view": f"""WITH {_AHEAT} SELECT {_COLUMN} AS "column", row_number() OVER (PARTITION BY tactic ORDER BY round(heat, 6) DESC, HT.f) AS "row", tactic AS category, HT.f AS feature_id, nm AS feature_name, round(heat, 6) AS heat FROM HT JOIN TC ON TC.f = HT.f WHERE contains(lower(HT.f), '10') OR contains(lower(nm), '10')""",
    "relative_gaps": f"WITH {_RANKED} SELECT query_id, entity_id, rank, round((lag(score) OVER (PARTITION BY query_id ORDER BY rank) - score) / nullif(lag(score) OVER (PARTITION BY query_id ORDER BY rank), 0), 6) AS gap FROM R",
    "comparison_heat": f"WITH {_TWO}, HT AS (SELECT f, CASE WHEN hi > lo THEN (w - lo) / (hi - lo) ELSE 1 END AS heat FROM W CROSS JOIN (SELECT min(w) AS lo, max(w) AS hi FROM W)) SELECT count(*) AS shared, round(coalesce(avg(heat), 0), 6) AS mean_heat FROM HT WHERE f IN (SELECT f FROM S JOIN ab ON e = a) AND f IN (SELECT f FROM S JOIN ab ON e = b)",
    "loners": f"WITH {_E} SELECT count(CASE WHEN CAST(e AS BIGINT) % 8 = 0 THEN 1 END) AS loners, count(*) AS entities FROM (SELECT DISTINCT e FROM E)",
    "distances": f"WITH {_PC} SELECT left_id, right_id, round(1 - score, 6) AS distance FROM P",
    "binary_space": f"WITH {_E} SELECT e AS entity_id, count(*) AS features FROM S GROUP BY e",
    "vocabulary": f"WITH {_A} SELECT DISTINCT f AS feature_id FROM A",
    "typed_lists": r"""WITH T AS (SELECT candidate_id, max(coalesce(array_to_string(list_filter(coalesce(missing_technique_ids, []), lambda x: x <> ''), '|'), '')) AS typed FROM candidates WHERE candidate_id IS NOT NULL GROUP BY 1),
P AS (SELECT candidate_id, typed, list_filter(regexp_split_to_array(typed, '[\s,;|]+'), lambda x: x <> '') AS parts FROM T)
SELECT candidate_id, typed, len(list_distinct(list_transform(parts, lambda x: CASE WHEN regexp_matches(upper(x), '^T[0-9]{4}([.][0-9]{3})?$') THEN split_part(upper(x), '.', 1) ELSE upper(x) END))) AS ids,
  len(parts) > 1 AND len(list_filter(parts, lambda x: regexp_matches(upper(x), '^T[0-9]{4}([.][0-9]{3})?$'))) >= ceil(len(parts) / CAST(2 AS DOUBLE)) AS is_list FROM P""",
    "rolled_up_sets": f"WITH {_A} SELECT cur.e AS actor_id, coalesce(string_agg(f, ',' ORDER BY f), '') AS ids FROM cur LEFT JOIN A ON A.e = cur.e GROUP BY cur.e",
    "all_names": f"""WITH {_A}, AL AS (SELECT e, name, trim(a) AS a, p FROM (SELECT e, name, unnest(aliases) AS a, unnest(range(len(aliases))) AS p FROM cur) WHERE trim(a) <> '' AND lower(trim(a)) <> coalesce(lower(name), ''))
SELECT e AS entity_id, name FROM cur WHERE name IS NOT NULL UNION ALL SELECT e, a FROM AL QUALIFY row_number() OVER (PARTITION BY e, lower(a) ORDER BY p) = 1""",
    "normalized_edges": f"WITH RECURSIVE {_NORM} SELECT * FROM NE",
    "normalized_entities": f"""WITH RECURSIVE {_NORM}, NA AS (SELECT root, lower(a) AS k FROM (SELECT g.root, trim(n) AS a FROM NT JOIN g ON NT.e = g.e) x JOIN cur c ON c.e = x.root WHERE a <> '' AND lower(a) <> lower(trim(c.name)) GROUP BY ALL),
NF AS (SELECT root, count(*) AS n FROM NR GROUP BY root)
SELECT c.e AS entity_id, trim(c.name) AS entity_name, (SELECT count(*) FROM NA WHERE NA.root = c.e) AS aliases, NF.n AS features FROM cur c JOIN NF ON NF.root = c.e WHERE NF.n >= 15""",
    "normalized_merges": f"""WITH RECURSIVE {_NORM}, SK AS (SELECT root, key FROM NK JOIN g USING (e) GROUP BY 1, 2 HAVING count(DISTINCT e) > 1)
SELECT root AS canonical_id, (SELECT trim(name) FROM cur WHERE cur.e = root) AS canonical_name, string_agg(e, ',' ORDER BY e) AS merged, coalesce((SELECT string_agg(key, ',' ORDER BY key) FROM SK WHERE SK.root = g.root), '') AS shared FROM g GROUP BY root HAVING count(*) > 1""",
    "normalized_counts": f"""WITH RECURSIVE {_NORM}, U AS (SELECT DISTINCT e, upper(trim(t)) AS t FROM (SELECT e, unnest(technique_ids) AS t FROM cur) WHERE trim(t) <> ''), NF AS (SELECT root, count(*) AS n FROM NR GROUP BY root)
SELECT (SELECT count(*) FROM U) AS edges_before_rollup, (SELECT count(*) FROM A) AS edges_after_rollup, (SELECT count(DISTINCT t) FROM U) AS features_before_rollup, (SELECT count(DISTINCT f) FROM A) AS features_after_rollup,
  (SELECT count(*) FROM cur) AS entities_before_merge, (SELECT count(DISTINCT root) FROM g) AS entities_after_merge, (SELECT count(*) FROM (SELECT root FROM g GROUP BY root HAVING count(*) > 1)) AS merges,
  (SELECT count(*) FROM NF WHERE n >= 15) AS entities_final, (SELECT count(DISTINCT feature_id) FROM NE) AS features_final, (SELECT count(*) FROM NE) AS edges_final,
  (SELECT count(*) FROM U) - (SELECT count(*) FROM A) AS edges_merged_by_rollup, (SELECT count(DISTINCT root) FROM g) - (SELECT count(*) FROM NF WHERE n >= 15) AS entities_dropped_sparse""",
    "normalized_catalogue": f"""WITH RECURSIVE {_NORM}, TT AS (SELECT technique_id AS f, trim(unnest(string_split(tactics, '|'))) AS tactic FROM techniques)
SELECT f AS feature_id, coalesce((SELECT string_agg(DISTINCT tactic, '|' ORDER BY tactic) FROM TT WHERE TT.f = x.f AND tactic <> ''), '') AS categories FROM (SELECT DISTINCT feature_id AS f FROM NE) x""",
    "bundle_features": "SELECT 'ap--' || technique_id AS stix_id, technique_id AS attack_id, trim(technique_name) AS name, false AS is_sub, coalesce(array_to_string(list_filter(list_transform(string_split(tactics, '|'), lambda x: trim(x)), lambda x: x <> ''), '|'), '') AS categories FROM techniques",
}
