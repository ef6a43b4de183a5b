"""Queries of operators.coach and operators.ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions.judge import judge_compare_fallback
from quarrymill.operators import coach as c
from quarrymill.operators import legacy_report as legacy
from quarrymill.operators import ratings as r
from quarrymill.operators.relations import candidate_pool
from quarrymill.plans.registry import register, split_columns

M = f"""m AS (SELECT b.*, CAST(exact_dups AS BIGINT) AS exact_dups, coalesce(dominant, 0) AS dominant FROM
    (SELECT a.project_id, {", ".join(f"{x} AS {k}" for k, x in c.METRICS.items())} FROM assets a LEFT JOIN (SELECT asset_id, text FROM captions WHERE is_active) t ON a.asset_id = t.asset_id GROUP BY 1) b
    JOIN (SELECT project_id, sum(x) AS exact_dups FROM (SELECT project_id, sha256_hash, count(*) - 1 AS x FROM assets GROUP BY 1, 2) GROUP BY 1) e ON b.project_id = e.project_id
    LEFT JOIN (SELECT project_id, max(x) AS dominant FROM (SELECT project_id, coalesce(dominant_emotion, 'neutral') AS e, count(*) AS x FROM assets WHERE face_count > 0 GROUP BY 1, 2) GROUP BY 1) d ON b.project_id = d.project_id)"""
I = "i AS (" + " UNION ALL ".join(f"SELECT project_id, {k} AS place, '{g}' AS grp, '{s}' AS severity, '{t}' AS title, CAST({a} AS BIGINT) AS affected FROM m WHERE {x}" for k, (g, s, t, x, a) in enumerate(c.RULES)) + ")"  # noqa: E741
found = lambda t: c.issues(c.metrics(t.assets, t.captions))
for group in dict.fromkeys(g for g, *_ in c.RULES):
    register(f"issues_{group}", lambda t, group=group: found(t).filter(F.col("grp") == group), f"WITH {M}, {I} SELECT * FROM i WHERE grp = '{group}'")
LOSS = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in c.PENALTY.items()) + " END"
READY = f"SELECT m.project_id, greatest(0, 100 - coalesce(loss, 0))::BIGINT AS score FROM m LEFT JOIN (SELECT project_id, sum({LOSS}) AS loss FROM i GROUP BY 1) l ON m.project_id = l.project_id"
GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"

LABEL = "CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 80 THEN 'good' WHEN score >= 70 THEN 'adequate' WHEN score >= 60 THEN 'poor' ELSE 'insufficient' END"


def ready(t):
    m = c.metrics(t.assets, t.captions)
    return c.readiness(m, c.issues(m))


register("readiness", ready, f"WITH {M}, {I} SELECT project_id, score, {GRADE} AS grade, {LABEL} AS label FROM ({READY})")
ACTIONS = "SELECT project_id, '[' || upper(severity) || '] ' || title AS action, row_number() OVER (PARTITION BY project_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, place) AS rank FROM i"
register("improvement_actions", lambda t: c.improvement_actions(found(t)), f"WITH {M}, {I} {ACTIONS}")
TARGET = "CASE WHEN {n} < 20 THEN {n} WHEN {n} < 40 THEN least({n}, 30) ELSE least({n}, 50) END"
register("selection_target", lambda t: t.assets.filter("NOT is_rejected").groupBy("project_id").agg(F.count("*").alias("n")).select("project_id", "n", c.selection_target(F.col("n")).alias("target")), f"SELECT project_id, n, {TARGET.format(n='n')} AS target FROM (SELECT project_id, count(*) AS n FROM assets WHERE NOT is_rejected GROUP BY 1)")
register("training_selection", lambda t: c.training_selection(t.assets))
register(
    "coach_report", lambda t: c.coach_report(t.assets, t.captions),
    f"""WITH {M}, {I}, a AS ({ACTIONS}), r AS ({READY}) SELECT m.project_id, n, {TARGET.format(n="live")} AS target, score, {GRADE} AS grade, {LABEL} AS label, critical, high, medium, low, action AS first_action
        FROM m JOIN r ON m.project_id = r.project_id LEFT JOIN (SELECT project_id, {", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in c.PENALTY)} FROM i GROUP BY 1) s ON m.project_id = s.project_id LEFT JOIN a ON m.project_id = a.project_id AND rank = 1""",
)
register("coach_report_rows", lambda t: c.coach_report_rows(t.assets, t.captions))

start = lambda t: t.assets.select("asset_id", "mu", "sigma")
none = lambda t: start(t).limit(0)
#: A fold in SQL: each step of the recursion takes every scope's next comparison; an asset's values stand at its number in lists.
FOLD = """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY made_at, id) AS k FROM comparisons),
  s AS (SELECT project_id AS scope, CAST(0 AS BIGINT) AS n, list_transform(range(211), lambda i: {mu}::DOUBLE) AS m, list_transform(range(211), lambda i: {sigma}::DOUBLE) AS v, list_transform(range(211), lambda i: CAST(0 AS INT)) AS c FROM (SELECT DISTINCT project_id FROM comparisons)
    UNION ALL SELECT scope, n + 1, list_transform(m, lambda x, i: CASE WHEN i = w THEN {mw} WHEN i = l THEN {ml} ELSE x END), list_transform(v, lambda x, i: CASE WHEN i = w THEN {sw} WHEN i = l THEN {sl} ELSE x END), list_transform(c, lambda x, i: CASE WHEN i = w OR i = l THEN x + 1 ELSE x END) FROM ({step})),
  z AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY scope ORDER BY n DESC) = 1)
  SELECT scope, i AS asset_id, round(m[i + 1], 6) AS mu, round(v[i + 1], 6) AS sigma, c[i + 1] AS comparisons, {last} FROM z CROSS JOIN range(211) r(i) WHERE c[i + 1] > 0"""
NEXT = "SELECT s.*, winner + 1 AS w, loser + 1 AS l, is_draw AS d FROM s JOIN o ON o.project_id = s.scope AND o.k = s.n + 1"
ELO_STEP = f"SELECT *, 32 * (CASE WHEN d THEN 0.5::DOUBLE ELSE 1 END - 1 / (1 + pow(10::DOUBLE, (m[l] - m[w]) / 400))) AS g FROM ({NEXT})"
SKILL_C = f"SELECT *, sqrt(v[w] * v[w] + v[l] * v[l] + 2 * {r.BETA!r}::DOUBLE * {r.BETA!r}::DOUBLE) AS q FROM ({NEXT})"
SKILL_P = f"SELECT *, 1 / (1 + exp((m[l] - m[w]) / q)) AS p FROM ({SKILL_C})"
SKILL_STEP = f"SELECT *, (CASE WHEN d THEN 0.5::DOUBLE ELSE 1 END - p) / q AS g, p * (1 - p) / (q * q) AS e FROM ({SKILL_P})"
SHRUNK = f"v[{{0}}] * sqrt(greatest(1 - v[{{0}}] * v[{{0}}] * e * v[{{0}}] / q, {r.KAPPA!r}::DOUBLE))"
register(
    "elo_replay", lambda t: r.final_ratings(r.replay(t.comparisons, none(t), "project_id", split=True)).withColumn("skill", F.round(F.col("mu") / 60, 6)),
    FOLD.format(mu=r.ELO, sigma=0, mw="x + g", ml="x - g", sw="x", sl="x", step=ELO_STEP, last="round(round(m[i + 1], 6) / 60, 6) AS skill"),
)
register(
    "skill_replay", lambda t: r.final_ratings(r.replay(t.comparisons, none(t), "project_id", "plackett_luce", split=True)).withColumn("ordinal", F.round(F.col("mu") - 3 * F.col("sigma"), 6)),
    FOLD.format(mu=r.MU, sigma=repr(r.SIGMA), mw="x + v[w] * v[w] * g", ml="x - v[l] * v[l] * g", sw=SHRUNK.format("w"), sl=SHRUNK.format("l"), step=SKILL_STEP, last="round(round(m[i + 1], 6) - 3 * round(v[i + 1], 6), 6) AS ordinal"),
)
register("session_replay", lambda t: r.final_ratings(r.replay(t.comparisons, start(t), "session_id", "plackett_luce")))
register("comparison_log", lambda t: r.replay(t.comparisons.join(t.assets.selectExpr("asset_id AS winner"), "winner", "left_semi"), start(t), "session_id", "plackett_luce"))
BEFORE = "SELECT id, winner AS asset_id, CAST(id % 50 AS DOUBLE) AS mu, CAST(1000 + id % 900 AS DOUBLE) AS elo FROM comparisons UNION ALL SELECT id, loser, CAST(id % 40 AS DOUBLE), CAST(1100 + id % 800 AS DOUBLE) FROM comparisons"
before = lambda t: t.comparisons.selectExpr("id", "winner AS asset_id", "CAST(id % 50 AS DOUBLE) AS mu", "CAST(1000 + id % 900 AS DOUBLE) AS elo").union(t.comparisons.selectExpr("id", "loser", "CAST(id % 40 AS DOUBLE)", "CAST(1100 + id % 800 AS DOUBLE)"))
register(
    "undo_last", lambda t: r.undo_last(t.assets, t.comparisons, before(t)),
    f"""WITH l AS (SELECT id, made_at FROM comparisons QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY made_at DESC, id DESC) = 1), b AS (SELECT x.*, l.made_at FROM ({BEFORE}) x JOIN l ON x.id = l.id),
       u AS (SELECT asset_id, arg_min(mu, row(made_at, id)) AS mu, arg_min(elo, row(made_at, id)) AS elo, count(*) AS n FROM b GROUP BY 1)
       SELECT a.asset_id, coalesce(u.mu, a.mu) AS mu, coalesce(u.elo, a.elo) AS elo, CAST(greatest(0, comparisons - coalesce(n, 0)) AS INT) AS comparisons FROM assets a LEFT JOIN u ON a.asset_id = u.asset_id""",
)
register(
    "next_pair", lambda t: r.next_pair(t.assets.join(candidate_pool(t.assets, 24).select("asset_id"), "asset_id", "left_semi"), t.comparisons.selectExpr("winner AS a", "loser AS b"), 3),
    """WITH k AS (SELECT *, 0.45::DOUBLE * coalesce(training_usefulness, 0) + 0.30::DOUBLE * coalesce(composite_score, 0) + 0.15::DOUBLE * coalesce(technical_quality, 0) + 0.10::DOUBLE * coalesce(face_quality, 0) AS q FROM assets),
       n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY q DESC, asset_id) AS rq, row_number() OVER (PARTITION BY project_id ORDER BY comparisons, asset_id) AS rl, row_number() OVER (PARTITION BY project_id ORDER BY sigma DESC, asset_id) AS rs FROM k),
       p AS (SELECT * FROM n WHERE rq <= 24 OR rl <= 12 OR rs <= 8 QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY least(rq + CASE WHEN rq <= 12 THEN 0 ELSE 3000000 END, rl + CASE WHEN rl <= 12 THEN 1000000 ELSE 9000000 END, rs + CASE WHEN rs <= 8 THEN 2000000 ELSE 9000000 END)) <= 24),
       s AS (SELECT x.project_id, x.asset_id AS a, y.asset_id AS b, round(abs((x.mu - 3 * x.sigma) - (y.mu - 3 * y.sigma)) + 0.8::DOUBLE * (x.comparisons + y.comparisons) - 0.2::DOUBLE * (x.q + y.q), 6) AS score FROM p x JOIN p y ON x.project_id = y.project_id AND x.asset_id < y.asset_id)
       SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score, a, b) AS rank FROM s WHERE NOT EXISTS (SELECT 1 FROM comparisons c WHERE least(winner, loser) = a AND greatest(winner, loser) = b)) WHERE rank <= 3""",
)
register("sigma_pair", lambda t: r.sigma_pair(t.assets), "SELECT project_id, min(asset_id) AS a, max(asset_id) AS b, round(sum(sigma), 6) AS sigma_sum FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY sigma DESC, asset_id) AS n FROM assets) WHERE n <= 2 GROUP BY 1 HAVING min(asset_id) <> max(asset_id)")
register("closest_pair", lambda t: r.closest_pair(t.assets), "SELECT project_id, a, b, gap FROM (SELECT project_id, asset_id AS a, lead(asset_id) OVER w AS b, lead(elo) OVER w - elo AS gap FROM assets WINDOW w AS (PARTITION BY project_id ORDER BY elo, asset_id)) WHERE b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY gap, a, b) = 1")
register("apply_rankings", lambda t: t.assets.filter("comparisons > 0").groupBy("project_id").agg(F.count("*").alias("ranked")), "SELECT project_id, count(*) AS ranked FROM assets WHERE comparisons > 0 GROUP BY 1")
register(
    "judge_auto_compare",
    lambda t: t.comparisons.join(t.assets.selectExpr("asset_id AS winner", "composite_score AS sa"), "winner").join(t.assets.selectExpr("asset_id AS loser", "composite_score AS sb"), "loser").withColumn("v", judge_compare_fallback(F.col("sa"), F.col("sb"))).select("id", F.when(F.col("v") == "B", F.col("loser")).otherwise(F.col("winner")).alias("winner"), F.when(F.col("v") == "B", F.col("winner")).otherwise(F.col("loser")).alias("loser"), (F.col("v") == "draw").alias("is_draw"), F.lit("ai").alias("decided_by")),
    """WITH j AS (SELECT c.id, c.winner, c.loser, coalesce(nullif(x.composite_score, 0), 0.5::DOUBLE) AS a, coalesce(nullif(y.composite_score, 0), 0.5::DOUBLE) AS b FROM comparisons c JOIN assets x ON c.winner = x.asset_id JOIN assets y ON c.loser = y.asset_id)
       SELECT id, CASE WHEN abs(a - b) >= 0.05 AND b > a THEN loser ELSE winner END AS winner, CASE WHEN abs(a - b) >= 0.05 AND b > a THEN winner ELSE loser END AS loser, abs(a - b) < 0.05 AS is_draw, 'ai' AS decided_by FROM j""",
)

FEATURES = "project_id, 60 + technical_quality * 100 AS sharpness, 50 + aesthetic_score * 50 AS artifact, 100 + training_usefulness * 100 AS brightness, greatest(face_count, CASE WHEN asset_id % 12 > 0 THEN 1 ELSE 0 END) AS faces, face_quality AS face_x, CASE asset_id % 10 WHEN 0 THEN 'close_up' WHEN 1 THEN 'close_up' WHEN 2 THEN 'full_body' WHEN 3 THEN 'full_body' ELSE 'mid_shot' END AS shot, CASE asset_id % 3 WHEN 0 THEN 'frontal' WHEN 1 THEN 'profile' END AS pose"
TOTALS = ", ".join(f"{x} AS {k}" for k, x in legacy.TOTALS.items())
#: Tones of assets that differ by project: some agree, some don't.
TONES = "project_id, CAST(128 + asset_id % 5 + CASE WHEN project_id IN ('src1', 'src2') THEN asset_id * 7 % 40 ELSE 0 END AS DOUBLE) AS l, CAST(130 + asset_id % 3 AS DOUBLE) AS a, CAST(140 + asset_id % 9 + CASE WHEN project_id = 'src3' THEN asset_id % 20 ELSE 0 END AS DOUBLE) AS b"
owned = lambda t: t.vectors.select(F.col("vec_id").alias("position"), "embedding").join(t.assets.selectExpr("asset_id AS position", "project_id"), "position")
register(
    "legacy_dataset_report", lambda t: legacy.legacy_dataset_report(t.assets.selectExpr("*").selectExpr(*split_columns(FEATURES)), owned(t), t.assets.selectExpr(*split_columns(TONES))),
    f"""WITH f AS (SELECT a.project_id, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM vectors JOIN assets a ON vec_id = asset_id), r AS (SELECT project_id, min(vec_id) AS first, arg_min(e, vec_id) AS q FROM f GROUP BY 1),
       i AS (SELECT project_id, round(avg(s), 4) AS mean_similarity, round(min(s), 4) AS min_similarity, round(max(s), 4) AS max_similarity, count(*) FILTER (s < 0.3) AS outliers FROM (SELECT f.project_id, list_cosine_similarity(q, e) AS s FROM f JOIN r ON f.project_id = r.project_id WHERE vec_id <> first) GROUP BY 1),
       d AS (SELECT project_id, stddev_pop(l) AS l, stddev_pop(a) AS a, stddev_pop(b) AS b FROM (SELECT {TONES} FROM assets) GROUP BY 1 HAVING count(*) >= 2), c AS (SELECT project_id, round(l, 2) AS std_l, round(a, 2) AS std_a, round(b, 2) AS std_b, l < 8 AND a < 5 AND b < 5 AS consistent FROM d),
       t AS (SELECT project_id, {TOTALS} FROM (SELECT {FEATURES} FROM assets) GROUP BY 1), j AS (SELECT t.* REPLACE (CAST(image_penalty + CASE WHEN consistent = FALSE THEN 1 ELSE 0 END AS BIGINT) AS image_penalty), mean_similarity, min_similarity, max_similarity, outliers, std_l, std_a, std_b, consistent FROM t LEFT JOIN i ON t.project_id = i.project_id LEFT JOIN c ON t.project_id = c.project_id)
       SELECT *, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 30 THEN 'D' ELSE 'F' END AS grade FROM (SELECT *, CAST({legacy.SCORE} AS BIGINT) AS score FROM j)""",
)
