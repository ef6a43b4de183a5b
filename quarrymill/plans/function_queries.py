"""Queries of the scalar functions: captions, quality, judge."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import captions as c
from quarrymill.functions import judge as j
from quarrymill.functions import quality as q
from quarrymill.plans.registry import register

ACTIVE = "SELECT asset_id, text FROM captions WHERE is_active"
active = lambda t: t.captions.filter("is_active").select("asset_id", "text")

register(
    "caption_normalize", lambda t: active(t).select("asset_id", c.normalize(F.col("text")).alias("text"), (c.normalize(F.col("text")) != F.col("text")).alias("changed")),
    rf"""WITH n AS (SELECT asset_id, text AS old, rtrim(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '  +', ' ', 'g'), ',\s*,+', ',', 'g'), '\s+,', ',', 'g'), ',(\s)', chr(1) || '\1', 'g'), ',', ', '), chr(1), ','), ', ') AS text FROM ({ACTIVE})) SELECT asset_id, text, text <> old AS changed FROM n""",
)
register("caption_prepend", lambda t: active(t).select("asset_id", c.prepend(F.col("text"), "sks person,").alias("text")), rf"SELECT asset_id, regexp_replace('sks person, ' || text, '^\s+|\s+$', '', 'g') AS text FROM ({ACTIVE})")
register("caption_append", lambda t: active(t).select("asset_id", c.append(F.col("text"), "studio light").alias("text")), rf"SELECT asset_id, b || CASE WHEN ends_with(b, ',') THEN ' ' ELSE ', ' END || 'studio light' AS text FROM (SELECT asset_id, regexp_replace(text, '\s+$', '') AS b FROM ({ACTIVE}))")
register(
    "caption_find_replace", lambda t: active(t).select("asset_id", c.find_replace(c.find_replace(F.col("text"), "the ", "THE "), r"(\w+)ing\b", r"\1ed", regex=True).alias("text")),
    rf"SELECT asset_id, regexp_replace(replace(text, 'the ', 'THE '), '([0-9A-Za-z_]+)ing\b', '\1ed', 'g') AS text FROM ({ACTIVE})",
)
register(
    "caption_issues", lambda t: active(t).select("asset_id", *(v.alias(k) for k, v in c.issues(F.col("text")).items())),
    rf"SELECT asset_id, text <> regexp_replace(text, '^\s+|\s+$', '', 'g') AS edge_space, contains(text, '  ') AS double_space, regexp_matches(text, ',\s*,') AS double_comma, length(text) < 10 AS too_short, length(text) > 800 AS too_long FROM ({ACTIVE})",
)


def score_sql(style: str, length: str) -> str:
    has = lambda words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"
    missing = " + ".join(f"CASE WHEN {has(w)} THEN 0 ELSE 3 END" for w in c.ELEMENTS.values())
    stop = ", ".join(f"'{w}'" for w in c.STOP_WORDS)
    return rf"""WITH w AS (SELECT asset_id, t, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') AS words FROM (SELECT asset_id, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS t FROM ({ACTIVE}))),
      v AS (SELECT *, len(words) AS n, list_filter(list_transform(words, lambda x: regexp_replace(x, '^[.,!?;:]+|[.,!?;:]+$', '', 'g')), lambda x: x NOT IN ({stop})) AS content FROM w),
      u AS (SELECT *, len(list_distinct(content)) AS unique_words, coalesce(list_max(map_values(list_aggregate(content, 'histogram'))), 0) AS repeat FROM v),
      s AS (SELECT *, greatest(0, 100 - (coalesce({length}, 0) + CASE WHEN starts_with(t, 'the') THEN 0 ELSE 15 END + CASE WHEN unique_words / greatest(n, 1) < 0.3 THEN 5 ELSE 0 END + CASE WHEN n > 5 AND repeat > 3 AND repeat / n > 0.15 THEN 5 ELSE 0 END + {missing})) AS score FROM u)
      SELECT asset_id, CAST(score AS INT) AS score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 30 THEN 'D' ELSE 'F' END AS grade, CAST(n AS INT) AS words, CAST(unique_words AS INT) AS unique_words FROM s"""


register("caption_score", lambda t: active(t).select("asset_id", c.caption_score(F.col("text"), trigger="The").alias("x")).select("asset_id", "x.*"), score_sql("moderate", "CASE WHEN n < 8 THEN 10 WHEN n > 80 THEN 5 END"))
FACE_TEXT = "concat(text, ' ', CASE asset_id % 5 WHEN 0 THEN 'a woman with long brown hair , with blue eyes, smiling' WHEN 1 THEN 'Portrait, her face looks tired. Standing in a room' WHEN 2 THEN ', a man with a strong jaw, olive skin, red lips' WHEN 3 THEN 'facial features, a young face, dark  eyes' ELSE '' END)"
STRIPPED = FACE_TEXT
for _pattern in c.FACIAL:
    STRIPPED = f"regexp_replace({STRIPPED}, '{_pattern}', '', 'gi')"
register("strip_facial_terms", lambda t: active(t).select("asset_id", c.strip_facial_terms(F.expr(FACE_TEXT)).alias("text")), rf"SELECT asset_id, regexp_replace(trim(regexp_replace(regexp_replace({STRIPPED}, '\s*,\s*,', ',', 'g'), '\s+', ' ', 'g')), '^[,.\s]+', '') AS text FROM ({ACTIVE})")
register("caption_tokens_est", lambda t: active(t).select("asset_id", c.tokens_estimate(F.col("text")).alias("tokens")), f"SELECT asset_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM ({ACTIVE})")
register("trigger_match", lambda t: active(t).select("asset_id", F.exists(F.array(F.lit("ering"), F.lit("aux")), lambda w: F.contains(F.lower("text"), w)).alias("hit")), f"SELECT asset_id, contains(lower(text), 'ering') OR contains(lower(text), 'aux') AS hit FROM ({ACTIVE})")
register("export_caption", lambda t: active(t).select("asset_id", c.export_caption(F.col("text"), "sks", "trigger_prefix").alias("text")), f"SELECT asset_id, trim('sks, ' || text, ', ') AS text FROM ({ACTIVE})")
register("sanitize_filename", lambda t: active(t).select("asset_id", q.sanitize_filename(F.col("text")).alias("name")), f"""SELECT asset_id, regexp_replace(text, '[<>:"/\\\\|?*]', '_', 'g') AS name FROM ({ACTIVE})""")
PARTS = dict(zip(q.WEIGHTS, ("technical_quality", "face_quality", "aesthetic_score", "composite_score", "training_usefulness", "uniqueness_score", "redundancy_score", "technical_quality", "aesthetic_score"), strict=True))
SUM = "least(greatest(" + " + ".join(["0.0::DOUBLE", *(f"{w}::DOUBLE * {PARTS[k]}" for k, w in q.WEIGHTS.items())]) + ", 0), 1)"
register(
    "quality_composite", lambda t: t.assets.select("asset_id", F.round(q.composite({k: F.col(v) for k, v in PARTS.items()}), 6).alias("composite"), F.round(q.technical(F.col("technical_quality"), F.col("aesthetic_score"), F.col("uniqueness_score")), 6).alias("technical"), F.round(q.training_value(F.col("composite_score"), F.col("face_quality"), F.col("aesthetic_score")), 6).alias("training")),
    f"SELECT asset_id, round({SUM}, 6) AS composite, round(0.5::DOUBLE * technical_quality + 0.3::DOUBLE * aesthetic_score + 0.2::DOUBLE * (1 - uniqueness_score), 6) AS technical, round(0.7::DOUBLE * composite_score + 0.2::DOUBLE * face_quality + 0.1::DOUBLE * aesthetic_score, 6) AS training FROM assets",
)
# least() and greatest() skip NULL in both engines
register("quality_tiers", lambda t: t.assets.select("asset_id", q.tier(F.col("composite_score")).alias("tier"), q.overall(F.col("composite_score")).alias("overall")), "SELECT asset_id, CASE WHEN composite_score >= 0.8 THEN 'excellent' WHEN composite_score >= 0.6 THEN 'good' WHEN composite_score >= 0.4 THEN 'fair' ELSE 'poor' END AS tier, CASE WHEN composite_score >= 0.75 THEN 'high' WHEN composite_score >= 0.5 THEN 'medium' ELSE 'low' END AS overall FROM assets")
register("quality_priority", lambda t: t.assets.select("asset_id", F.round(q.priority(F.col("training_usefulness"), F.col("composite_score"), F.col("technical_quality"), F.col("face_quality")), 6).alias("priority")), "SELECT asset_id, round(0.45::DOUBLE * training_usefulness + 0.30::DOUBLE * composite_score + 0.15::DOUBLE * technical_quality + 0.10::DOUBLE * face_quality, 6) AS priority FROM assets")
register("face_quality", lambda t: t.assets.select("asset_id", F.round(q.face_quality(F.col("face_quality"), F.col("technical_quality")), 6).alias("quality")), "SELECT asset_id, round(CASE WHEN face_quality IS NULL THEN 0.5::DOUBLE ELSE 0.7::DOUBLE * face_quality + 0.3::DOUBLE * least(4 * technical_quality, 1.0::DOUBLE) END, 6) AS quality FROM assets")
register("face_centering", lambda t: t.assets.select("asset_id", F.round(q.face_centering(F.col("face_quality"), F.coalesce("technical_quality", F.lit(0.3))), 6).alias("centering")), "SELECT asset_id, round(CASE WHEN face_quality IS NULL THEN 0.5::DOUBLE ELSE (least(greatest(1 - 2 * abs(face_quality - 0.5::DOUBLE), 0), 1) + least(greatest(1 - 2.5::DOUBLE * abs(coalesce(technical_quality, 0.3::DOUBLE) - 0.4::DOUBLE), 0), 1)) / 2 END, 6) AS centering FROM assets")
register("shot_type_from_ratio", lambda t: t.assets.select("asset_id", q.shot_type_from_ratio(F.col("width") / 4, F.col("height")).alias("shot")), "SELECT asset_id, CASE WHEN width / 4 / height >= 0.35 THEN 'close_up' WHEN width / 4 / height >= 0.12 THEN 'mid_shot' ELSE 'full_body' END AS shot FROM assets")
#: Five points per face: eyes, nose, corners of the mouth; every 29th face has its eyes above one another.
POINTS = {"lx": "CAST(100 + asset_id % 7 AS DOUBLE)", "rx": "CAST(CASE WHEN asset_id % 29 = 0 THEN 100 + asset_id % 7 ELSE 150 + asset_id % 11 END AS DOUBLE)", "nx": "CAST(105 + asset_id % 53 AS DOUBLE)", "ly": "CAST(100 + asset_id % 3 AS DOUBLE)", "ry": "CAST(100 + asset_id % 5 AS DOUBLE)", "ny": "CAST(105 + asset_id % 47 AS DOUBLE)"}


def landmarks(t):
    p = t.assets.select("asset_id", *(F.expr(x).alias(k) for k, x in POINTS.items()))
    return p.selectExpr("asset_id", "array(array(lx, ly), array(rx, ry), array(nx, ny), array(lx, ny + 20), array(rx, ny + 20)) AS points")


register(
    "pose_from_landmarks", lambda t: landmarks(t).select("asset_id", q.pose_from_landmarks(F.col("points")).alias("p")).select("asset_id", "p.*"),
    f"""WITH p AS (SELECT asset_id, {", ".join(f"{x} AS {k}" for k, x in POINTS.items())} FROM assets), r AS (SELECT asset_id, abs((nx - (lx + rx) / 2) / nullif(abs(rx - lx), 0)) AS o, (ny - (ly + ry) / 2) / nullif(abs(rx - lx), 0) AS v FROM p)
       SELECT asset_id, CASE WHEN o IS NULL OR o < 0.12::DOUBLE THEN 'frontal' WHEN o < 0.30::DOUBLE THEN 'three_quarter' ELSE 'profile' END AS yaw, CASE WHEN v < 0.3::DOUBLE THEN 'looking_up' WHEN v > 0.7::DOUBLE THEN 'looking_down' ELSE 'level' END AS pitch,
         CAST(trunc(CASE WHEN o IS NULL THEN 85 WHEN o < 0.12::DOUBLE THEN 95 - o * 100 WHEN o < 0.30::DOUBLE THEN 80 - o * 80 ELSE 60 - o * 40 END) AS INT) AS angle_score FROM r""",
)
register(
    "training_bucket", lambda t: t.assets.select("asset_id", q.training_bucket(F.col("width"), F.col("height"), 768).alias("b")).select("asset_id", "b.*"),
    """WITH b AS (SELECT asset_id, width AS w, height AS h, greatest(64, CAST(round_even(sqrt(589824.0::DOUBLE * (width::DOUBLE / height)) / 64, 0) * 64 AS INT)) AS width, greatest(64, CAST(round_even(sqrt(589824.0::DOUBLE / (width::DOUBLE / height)) / 64, 0) * 64 AS INT)) AS height FROM assets),
       s AS (SELECT *, greatest(width::DOUBLE / w, height::DOUBLE / h) AS scale FROM b)
       SELECT asset_id, width, height, round(width::DOUBLE / height, 3) AS ar, round((width * height) / 1e6::DOUBLE, 2) AS megapixels, round(scale, 3) AS scale, greatest(0, CAST(floor(w * scale) AS INT) - width) AS crop_x, greatest(0, CAST(floor(h * scale) AS INT) - height) AS crop_y FROM s""",
)
register("aspect_class", lambda t: t.assets.select("asset_id", q.aspect_class(F.col("width"), F.col("height")).alias("aspect")), "SELECT asset_id, CASE WHEN round(width::DOUBLE / height, 2) > 1.2 THEN 'landscape' WHEN round(width::DOUBLE / height, 2) < 0.8 THEN 'portrait' ELSE 'square' END AS aspect FROM assets")
register("background_class", lambda t: t.assets.select("asset_id", q.background_class(F.col("technical_quality") * 100, F.col("aesthetic_score") * 100).alias("background")), "SELECT asset_id, CASE WHEN technical_quality * 100 < 15 AND aesthetic_score * 100 < 30 THEN 'neutral' WHEN technical_quality * 100 < 30 THEN 'simple' WHEN technical_quality * 100 < 60 THEN 'moderate' ELSE 'busy' END AS background FROM assets")
register("judge_fallback", lambda t: t.assets.select("asset_id", j.judge_fallback(F.col("technical_quality"), F.col("aesthetic_score"), F.col("training_usefulness"), F.col("composite_score")).alias("x")).select("asset_id", F.round("x.composite", 6).alias("composite"), "x.recommendation"), """WITH h AS (SELECT asset_id, coalesce(nullif(coalesce(composite_score, (coalesce(nullif(technical_quality, 0), 0.5::DOUBLE) + coalesce(nullif(aesthetic_score, 0), 0.5::DOUBLE) + coalesce(nullif(training_usefulness, 0), 0.5::DOUBLE)) / 3), 0), 0.5::DOUBLE) AS x FROM assets)
  SELECT asset_id, round(x, 6) AS composite, CASE WHEN x >= 0.7 THEN 'keep' WHEN x >= 0.4 THEN 'maybe' ELSE 'remove' END AS recommendation FROM h""")
register("judge_compare_fallback", lambda t: t.assets.select("asset_id", j.judge_compare_fallback(F.col("composite_score"), F.col("aesthetic_score")).alias("winner")), "SELECT asset_id, CASE WHEN abs(a - b) < 0.05 THEN 'draw' WHEN a > b THEN 'A' ELSE 'B' END AS winner FROM (SELECT asset_id, coalesce(nullif(composite_score, 0), 0.5::DOUBLE) AS a, coalesce(nullif(aesthetic_score, 0), 0.5::DOUBLE) AS b FROM assets)")
ANSWER = """CASE asset_id % 4 WHEN 0 THEN concat('```json\n{"technical_quality": {"score": ', CAST(asset_id % 10 AS STRING), '}, "composite": 0.8, "recommendation": "keep", "winner": "b"}\n```') WHEN 1 THEN concat('Here: {"composite": {"score": 0.', CAST(asset_id % 10 AS STRING), '}, "confidence": "high", "winner": "tie"} done') WHEN 2 THEN 'no json' ELSE '{broken' END"""
register("judge_parse", lambda t: t.assets.select("asset_id", j.judge_parse(F.expr(ANSWER.replace("\n", "\\n"))).alias("x")).select("asset_id", "x.*"))
register("judge_compare_parse", lambda t: t.assets.select("asset_id", j.judge_compare_parse(F.expr(ANSWER.replace("\n", "\\n"))).alias("winner")))
