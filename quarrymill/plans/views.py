"""The driver's tables seen as curation tables. Each view is one set of expressions that Spark and DuckDB both compute.

Spark gets them by selectExpr; the oracle's SQL begins with the same expressions as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def score(prime: int, none: int = 0) -> str:
    """A score of 0 to 0.999 from the document's number, NULL at multiples of none."""
    value = f"CAST(d.doc_id * {prime} % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)"
    return f"CASE WHEN d.doc_id % {none} = 0 THEN NULL ELSE {value} END" if none else value


def choice(key: str, *values: str | None) -> str:
    cases = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


FACES = "CAST(d.doc_id * 13 % 4 AS INT)"
ASSETS = {
    "asset_id": "d.doc_id",
    "project_id": "d.source",
    "filename": "concat(d.lang, '_', CAST(d.doc_id % 400 AS STRING), '.png')",
    "file_size": "d.n_chars",
    "mime_type": choice("d.doc_id", "image/png", "image/jpeg", "image/webp"),
    "width": "CAST(512 + d.doc_id * 37 % 1536 AS INT)",
    "height": "CAST(512 + d.doc_id * 53 % 1536 AS INT)",
    "sha256_hash": "{sha}",
    "phash": "CASE WHEN d.doc_id % 19 = 0 THEN NULL ELSE {phash} END",
    "position": "d.doc_id",
    "imported_at": "d.doc_id * 61 % 86400",
    "analyzed": "d.doc_id % 8 <> 0",
    "face_count": FACES,
    "dominant_emotion": choice("d.doc_id", "happy", "neutral", "sad", "angry", "surprised", None),
    "head_pose_yaw": "CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE CAST(d.doc_id * 29 % 181 - 90 AS DOUBLE) END",
    "shot_type": choice("d.doc_id", "closeup", "medium", "wide", "full", "unknown"),
    "is_indoor": "CASE d.doc_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "scene_class": choice("d.doc_id", "street", None, "studio", None),
    "active_caption_id": "CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE d.doc_id END",
    "composite_score": score(7919, 17),
    "technical_quality": score(6101, 13),
    "aesthetic_score": score(4787, 23),
    "face_quality": score(3571, 5),
    "training_usefulness": score(2713, 19),
    "uniqueness_score": score(1999, 29),
    "redundancy_score": score(1301, 31),
    "review_state": "CASE WHEN l.quality = 1 THEN 'approved' WHEN l.quality = 0 THEN 'rejected' WHEN d.doc_id % 3 = 0 THEN 'reviewed' ELSE 'pending' END",
    "is_flagged": "coalesce(l.toxic = 1, FALSE)",
    "is_rejected": "coalesce(l.quality = 0, FALSE)",
    "rejection_reason": "CASE WHEN l.quality = 0 THEN 'label' END",
    "is_augmented": "d.doc_id % 37 = 0",
    "augmentation_source_id": "CASE WHEN d.doc_id % 37 = 0 THEN d.doc_id + 1 END",
    "duplicate_cluster_id": "CASE WHEN d.doc_id % 3 = 0 THEN concat('c', CAST(d.doc_id % 20 AS STRING), '_', CAST(d.doc_id - d.doc_id % 180 AS STRING)) END",
    "duplicate_type": choice("d.doc_id % 20", "exact", "phash", "embedding", "face"),
    "identity_cluster_id": f"CASE WHEN {FACES} > 0 THEN concat('p', CAST(d.doc_id % 23 AS STRING)) END",
    "mu": "CAST(25 AS DOUBLE) + CAST(d.doc_id * 17 % 200 - 100 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "sigma": "CAST(8 AS DOUBLE) - CAST(d.doc_id * 23 % 60 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "elo": "CAST(1500 + d.doc_id * 31 % 400 - 200 AS DOUBLE)",
    "comparisons": "CAST(d.doc_id * 11 % 9 AS INT)",
}
SPARK = {"sha": "sha2(d.text, 256)", "phash": "lower(lpad(hex({bits}), 16, '0'))"}
DUCK = {"sha": "sha256(d.text)", "phash": "lpad(lower(to_hex({bits})), 16, '0')"}
#: Hashes in families of some bits' distance.
BITS = {"spark": "(d.doc_id % 40) * 151115727451 ^ shiftleft(1L, CAST(d.doc_id % 7 AS INT)) ^ shiftleft(1L, CAST(20 + d.doc_id % 3 AS INT))", "duck": "xor(xor((d.doc_id % 40) * 151115727451, CAST(1 AS BIGINT) << (d.doc_id % 7)), CAST(1 AS BIGINT) << (20 + d.doc_id % 3))"}

CAPTIONS = {
    "caption_id": "d.doc_id",
    "asset_id": "d.doc_id",
    "project_id": "d.source",
    "text": "CASE WHEN d.doc_id % 4 = 0 THEN concat('  ', replace(d.text, '. ', ' ,, ')) ELSE d.text END",
    "provider": choice("d.doc_id", "manual", "model_a", "model_b"),
    "is_active": "d.doc_id % 11 <> 0",
    "created_at": "d.doc_id * 43 % 86400",
}
COMPARISONS = {
    "id": "e.event_id",
    "made_at": "e.event_id * 7 % 86400",
    "session_id": "e.user_id",
    "project_id": "e.user_id % 7",
    "winner": "e.event_id * 13 % 211",
    "loser": "e.event_id * 29 % 211",
    "is_draw": "e.event_id % 10 = 0",
}
USAGE = {
    "provider": "e.event_type",
    "asset_id": "e.event_id % 1100",
    "latency_ms": "CAST(e.value AS DOUBLE)",
    "ok": "e.event_type <> 'error' AND e.event_id % 9 <> 0",
    "tokens_in": "e.event_id * 3 % 500",
    "tokens_out": "e.event_id * 5 % 300",
    "cost_micros": "e.event_id * 11 % 5000",
}
VECTORS = {"vec_id": "v.vec_id", "embedding": "v.embedding", "label": "v.label", "project_id": "v.vec_id % 4"}
#: Two faces of each asset; which of them has index 0 differs.
OWNER = "CAST((v.vec_id - v.vec_id % 2) / 2 AS BIGINT)"
FACE_VECTORS = {"vec_id": "v.vec_id", "asset_id": OWNER, "face_index": f"(v.vec_id + {OWNER}) % 2", "project_id": f"{OWNER} % 4", "embedding": "v.embedding"}

#: View: its expressions, what it reads in Spark, and its FROM clause in DuckDB.
SOURCES = {
    "assets": (ASSETS, "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "captions": (CAPTIONS, "documents d"),
    "comparisons": (COMPARISONS, "events e WHERE e.event_id * 13 % 211 <> e.event_id * 29 % 211"),
    "usage": (USAGE, "events e"),
    "vectors": (VECTORS, "embeddings v"),
    "faces": (FACE_VECTORS, "embeddings v"),
}


def expressions(view: str, engine: str) -> dict[str, str]:
    part = {"spark": SPARK, "duck": DUCK}[engine]
    fill = {"sha": part["sha"], "phash": part["phash"].format(bits=BITS[engine])}
    return {k: x.format(**fill) for k, x in SOURCES[view][0].items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from_ = SOURCES[name][1]
    base, alias = from_.split()[:2]
    df = table(spark, sf_dir, base).alias(alias)
    if " JOIN " in from_:
        df = df.join(table(spark, sf_dir, "labels").alias("l"), "doc_id", "left").selectExpr("struct(doc_id, text, lang, source, n_chars) AS d", "struct(quality, toxic) AS l")
    if " WHERE " in from_:
        df = df.where(from_.split(" WHERE ")[1])
    return df.selectExpr(*(f"{x} AS {k}" for k, x in expressions(name, "spark").items()))


def with_views(sql: str) -> str:
    """sql for DuckDB, with the views that it names before it."""
    import re

    used = [v for v in SOURCES if re.search(rf"\b{v}\b", sql)]
    parts = []
    for v in used:
        columns = ", ".join(f"{x} AS {k}" for k, x in expressions(v, "duck").items())
        parts.append(f"{v} AS (SELECT {columns} FROM {SOURCES[v][1]})")
    sql = sql.strip()
    recursive = sql.upper().startswith("WITH RECURSIVE")
    if sql.upper().startswith("WITH"):
        parts.append(sql[len("WITH RECURSIVE" if recursive else "WITH") :].strip())
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql
