"""Queries of actions, ingest, sinks, image features and streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import actions as a
from quarrymill.operators import dedup, image_qc
from quarrymill.operators.analysis import analyse, asset_stages
from quarrymill.operators.colour import skin_tones
from quarrymill.operators.filters import export_eligible
from quarrymill.operators.tables import new_folder
from quarrymill.plans.registry import Tables, register
from quarrymill.plans.views import expressions
from quarrymill.sources import ingest, sinks
from quarrymill.streaming import streams

STATE = "asset_id, review_state, is_flagged, is_rejected, rejection_reason"
shown = lambda df: df.select(*STATE.split(", "))
UPDATES = "SELECT asset_id, CASE asset_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'reviewed' END AS s, CASE WHEN asset_id % 5 = 0 THEN TRUE WHEN asset_id % 5 = 1 THEN FALSE END AS f, CASE WHEN asset_id % 8 = 3 THEN TRUE END AS r, CASE WHEN asset_id % 6 = 0 THEN 'bad crop' END AS why FROM assets WHERE asset_id % 3 = 0"
updates = lambda t: t.assets.filter("asset_id % 3 = 0").selectExpr("asset_id", "CASE asset_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'reviewed' END AS review_state", "CASE WHEN asset_id % 5 = 0 THEN TRUE WHEN asset_id % 5 = 1 THEN FALSE END AS is_flagged", "CASE WHEN asset_id % 8 = 3 THEN TRUE END AS is_rejected", "CASE WHEN asset_id % 6 = 0 THEN 'bad crop' END AS rejection_reason")
register(
    "review_transition", lambda t: shown(a.review_transition(t.assets, updates(t))),
    f"""SELECT x.asset_id, coalesce(s, CASE WHEN r THEN 'rejected' END, review_state) AS review_state, coalesce(f, is_flagged) AS is_flagged,
         CASE WHEN s = 'approved' THEN FALSE WHEN s = 'rejected' THEN TRUE ELSE coalesce(r, is_rejected) END AS is_rejected, CASE WHEN s = 'approved' THEN why ELSE coalesce(why, rejection_reason) END AS rejection_reason
       FROM assets x LEFT JOIN ({UPDATES}) u ON x.asset_id = u.asset_id""",
)
ids = lambda t, condition: t.assets.filter(condition).select("asset_id")
register("bulk_action", lambda t: shown(a.bulk_action(a.bulk_action(t.assets, ids(t, "asset_id % 10 = 1"), "approve"), ids(t, "asset_id % 7 = 2"), "flag")), "SELECT asset_id, CASE WHEN asset_id % 10 = 1 THEN 'approved' ELSE review_state END AS review_state, is_flagged OR asset_id % 7 = 2 AS is_flagged, is_rejected AND asset_id % 10 <> 1 AS is_rejected, CASE WHEN asset_id % 10 <> 1 THEN rejection_reason END AS rejection_reason FROM assets")
register("bulk_delete", lambda t: a.bulk_action(t.assets, ids(t, "asset_id % 6 = 5"), "delete").groupBy("project_id").agg(F.count("*").alias("n")), "SELECT project_id, count(*) AS n FROM assets WHERE asset_id % 6 <> 5 GROUP BY 1")
DUPS = "SELECT asset_id FROM (SELECT asset_id, row_number() OVER (PARTITION BY project_id, sha256_hash ORDER BY coalesce(composite_score, 0) DESC, asset_id) AS n FROM assets WHERE NOT is_rejected) WHERE n > 1"
register("coach_action", lambda t: shown(a.coach_action(a.coach_action(t.assets, "remove_exact_duplicates"), "flag_blurry", ids(t, "technical_quality < 0.3"))), f"SELECT asset_id, CASE WHEN d THEN 'rejected' ELSE review_state END AS review_state, is_flagged OR coalesce(technical_quality < 0.3, FALSE) AS is_flagged, is_rejected OR d AS is_rejected, CASE WHEN d THEN 'Rejected by dataset coach: exact duplicate' ELSE rejection_reason END AS rejection_reason FROM (SELECT *, asset_id IN ({DUPS}) AS d FROM assets)")
register(
    "apply_duplicate_decisions", lambda t: a.apply_duplicate_decisions(t.assets, ids(t, "asset_id % 15 = 0").withColumn("keep", F.lit(True))).select("asset_id"),
    """SELECT asset_id FROM (SELECT asset_id, duplicate_cluster_id, row_number() OVER (PARTITION BY project_id, duplicate_cluster_id ORDER BY coalesce(composite_score, 0) DESC, coalesce(training_usefulness, 0) DESC, coalesce(technical_quality, 0) DESC, coalesce(face_quality, 0) DESC, width * height DESC, imported_at DESC, asset_id DESC) AS n FROM assets)
       WHERE duplicate_cluster_id IS NULL OR n = 1 OR asset_id % 15 = 0""",
)
VERSIONS = "caption_id, asset_id, text, provider, is_active"
register(
    "caption_version_append", lambda t: a.caption_version_append(t.captions, F.replace(F.col("text"), F.lit("the "), F.lit("")), F.col("caption_id") + 10_000_000).select(*VERSIONS.split(", ")),
    "SELECT caption_id, asset_id, text, provider, is_active AND NOT contains(text, 'the ') AS is_active FROM captions UNION ALL SELECT caption_id + 10000000, asset_id, replace(text, 'the ', ''), 'bulk_edit', TRUE FROM captions WHERE is_active AND contains(text, 'the ')",
)
MANY = "SELECT caption_id, asset_id % 250 AS asset_id, created_at, is_active AND caption_id < 250 AS is_active FROM captions"
register("caption_version_prune", lambda t: a.caption_version_prune(t.captions.selectExpr("caption_id", "asset_id % 250 AS asset_id", "created_at", "is_active AND caption_id < 250 AS is_active"), 2), f"SELECT caption_id, asset_id, created_at, is_active FROM ({MANY}) QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY created_at DESC, caption_id DESC) <= 2 OR is_active")

TEXTS = "(SELECT asset_id, text FROM captions WHERE is_active AND trim(text) <> '')"
STEM, END = r"regexp_replace(filename, '\.[^.]*$', '')", r"regexp_extract(filename, '(\.[^.]*)$', 1)"
register("export_sidecars", lambda t: sinks.sidecar_results(export_eligible(t.assets), t.captions, new_folder(t.spark, "sidecars")), f"SELECT project_id, count(text) AS written, count(*) - count(text) AS errors FROM assets LEFT JOIN {TEXTS} c ON assets.asset_id = c.asset_id WHERE NOT is_rejected GROUP BY 1")
register("export_sidecar_files", lambda t: sinks.write_sidecars(export_eligible(t.assets), t.captions, new_folder(t.spark, "sidecars")).select("asset_id", "caption"), f"SELECT c.asset_id, text AS caption FROM assets a JOIN {TEXTS} c ON a.asset_id = c.asset_id WHERE NOT is_rejected")
register("export_lora_manifest", lambda t: sinks.lora_manifest(export_eligible(t.assets), t.captions, "sks", 10), f"SELECT project_id, a.asset_id, project_id || '/10_sks/' || {STEM} || '.png' AS path, CASE WHEN text IS NOT NULL THEN project_id || '/10_sks/' || {STEM} || '.txt' END AS caption_path, trim('sks, ' || text, ', ') AS caption FROM assets a LEFT JOIN {TEXTS} c ON a.asset_id = c.asset_id WHERE NOT is_rejected")
register("export_kohya_manifest", lambda t: sinks.kohya_manifest(export_eligible(t.assets), t.captions, "sks", 5), f"SELECT project_id, a.asset_id, project_id || '/img/5_sks/' || filename AS path, CASE WHEN text IS NOT NULL THEN project_id || '/img/5_sks/' || {STEM} || '.txt' END AS caption_path FROM assets a LEFT JOIN {TEXTS} c ON a.asset_id = c.asset_id WHERE NOT is_rejected")
register("export_zip_manifest", lambda t: sinks.zip_manifest(export_eligible(t.assets), t.captions), f"SELECT project_id, asset_id, filename AS entry FROM assets WHERE NOT is_rejected UNION ALL SELECT project_id, a.asset_id, {STEM} || '.txt' FROM assets a JOIN {TEXTS} c ON a.asset_id = c.asset_id WHERE NOT is_rejected")
register("export_split_layout", lambda t: sinks.split_layout(t.assets, "clustered"), "SELECT project_id, asset_id, coalesce(identity_cluster_id, 'unclustered') || '/' || filename AS name FROM assets")
register("reorder_names", lambda t: sinks.ranked_names(t.assets, F.col("composite_score")), "SELECT project_id, asset_id, CASE WHEN n < 10000 THEN lpad(CAST(n AS STRING), 4, '0') ELSE CAST(n AS STRING) END || '_' || filename AS name FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY composite_score DESC NULLS LAST, asset_id) AS n FROM assets)")
register("export_parquet_shards", lambda t: sinks.parquet_shards(t.assets.select("asset_id", "project_id", "filename"), new_folder(t.spark, "shards"), 5000).select("file", "rows"))
register("curated_table_write", lambda t: sinks.curated_table(t.assets, dedup.dup_exact(t.assets).withColumn("type", F.lit("exact"))).select("asset_id", "duplicate_cluster_id", "duplicate_type"), "SELECT asset_id, CASE WHEN n > 1 THEN CAST(c AS STRING) END AS duplicate_cluster_id, CASE WHEN n > 1 THEN 'exact' END AS duplicate_type FROM (SELECT asset_id, min(asset_id) OVER (PARTITION BY project_id, sha256_hash) AS c, count(*) OVER (PARTITION BY project_id, sha256_hash) AS n FROM assets)")

documents = lambda t: t.spark.read.parquet(f"{t.sf_dir}/documents.parquet")
register("content_hash", lambda t: ingest.content_hash(documents(t).select("doc_id", "text"), "text").select("doc_id", "sha256"), "SELECT doc_id, sha256(text) AS sha256 FROM documents")
BATCH = "SELECT source AS project_id, doc_id AS position, sha256(text) AS sha256 FROM documents"
batch = lambda t: ingest.content_hash(documents(t).selectExpr("source AS project_id", "doc_id AS position", "text"), "text").drop("text")
register("ingest_dedup", lambda t: ingest.ingest_dedup(batch(t).filter("position % 4 > 0"), batch(t).filter("position % 4 = 0")), f"WITH b AS ({BATCH}) SELECT * FROM b WHERE position % 4 > 0 AND NOT EXISTS (SELECT 1 FROM b k WHERE k.position % 4 = 0 AND k.project_id = b.project_id AND k.sha256 = b.sha256) QUALIFY row_number() OVER (PARTITION BY project_id, sha256 ORDER BY position) = 1")
OUTCOME = "CASE WHEN asset_id % 50 = 0 THEN 'error' WHEN asset_id % 9 = 0 THEN 'pending' WHEN asset_id % 5 = 0 THEN 'duplicate' ELSE 'created' END AS outcome"
register("ingest_summary", lambda t: ingest.ingest_summary(t.assets.selectExpr("project_id", OUTCOME)), f"SELECT *, round(100.0::DOUBLE * completed / total, 1) AS pct FROM (SELECT project_id, count(*) AS total, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'duplicate') AS duplicates, count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome <> 'pending') AS completed FROM (SELECT project_id, {OUTCOME} FROM assets) GROUP BY 1)")
register("collision_names", lambda t: ingest.collision_names(t.assets), f"SELECT project_id, asset_id, CASE WHEN n = 0 THEN filename ELSE {STEM} || '_' || CAST(n AS STRING) || {END} END AS stored FROM (SELECT *, row_number() OVER (PARTITION BY project_id, filename ORDER BY asset_id) - 1 AS n FROM assets)")
register("scan_image_dir", lambda t: ingest.scan_files(t.spark, t.sf_dir, ("parquet",)).select("name", "length"))
register("storage_bytes", lambda t: ingest.storage_bytes(ingest.scan_files(t.spark, t.sf_dir, ("parquet",))))
register(
    "sidecar_join", lambda t: ingest.sidecar_join(t.assets.select("asset_id", F.concat("project_id", F.lit("/"), F.col("asset_id").cast("string"), F.lit(".png")).alias("path")), t.captions.select(F.concat("project_id", F.lit("/"), F.col("asset_id").cast("string"), F.lit(".txt")).alias("path"), F.when(F.col("asset_id") % 13 > 0, F.col("text")).otherwise("  ").alias("value")).filter("hash(path) IS NOT NULL")).select("asset_id", "caption"),
    r"SELECT a.asset_id, nullif(regexp_replace(CASE WHEN a.asset_id % 13 > 0 THEN text ELSE '  ' END, '^\s+|\s+$', '', 'g'), '') AS caption FROM assets a LEFT JOIN captions c ON a.asset_id = c.asset_id",
)


def pictures(t: Tables) -> DataFrame:
    """Decoded images of all the documents' bytes: 16 coloured dots a row, 16 rows or more, each dot 3 x 3 pixels; every 50th is broken."""

    def draw(batches):
        for batch in batches:
            for rows in (batch[i : i + 64] for i in range(0, len(batch), 64)):
                data, height = [], []
                for text in rows["text"]:
                    raw = (text or " ").encode()
                    raw = np.frombuffer(raw.ljust(max(768, -(-len(raw) // 48) * 48), b" "), np.uint8).reshape(-1, 16, 3)
                    height.append(3 * len(raw))
                    data.append(np.kron(raw, np.ones((3, 3, 1), np.uint8)).tobytes())
                broken = rows["doc_id"] % 50 == 49
                yield pd.DataFrame({"doc_id": rows["doc_id"], "height": np.where(broken, -1, height), "width": np.where(broken, -1, 48), "channels": 3, "data": data})

    return documents(t).select("doc_id", "text").mapInPandas(draw, "doc_id long, height int, width int, channels int, data binary")


register("perceptual_hash", lambda t: ingest.perceptual_hash(pictures(t), "doc_id"))
#: Files drawn from documents: a header of PNG, GIF, BMP, JPEG (behind a segment of some length) or WebP, or the bare text, and then the text's bytes.
HEADED = """CASE doc_id % 6
  WHEN 0 THEN concat(unhex('89504E470D0A1A0A0000000D49484452'), unhex(lpad(hex(octet_length(text) % 65536), 8, '0')), unhex(lpad(hex(doc_id % 2000000), 8, '0')), unhex('0806000000'), CAST(text AS BINARY))
  WHEN 1 THEN concat(CAST('GIF89a' AS BINARY), unhex(concat(lpad(hex(doc_id % 256), 2, '0'), lpad(hex(doc_id % 7), 2, '0'))), unhex('4001'), CAST(text AS BINARY))
  WHEN 2 THEN concat(CAST('BM' AS BINARY), unhex('000000000000000036000000'), unhex('28000000'), unhex(concat(lpad(hex(doc_id % 256), 2, '0'), '020000')), unhex('80010000'), CAST(text AS BINARY))
  WHEN 3 THEN concat(unhex(concat('FFD8FFE1', lpad(hex(2 + doc_id % 5000), 4, '0'), repeat('C0', CAST(doc_id % 5000 AS INT)), 'FFC2001108', lpad(hex(1 + doc_id % 3000), 4, '0'), lpad(hex(1 + octet_length(text) % 60000), 4, '0'), '03')), CAST(text AS BINARY))
  WHEN 4 THEN concat(unhex('52494646000000005745425056503858'), unhex('0A00000000000000'), unhex(concat(lpad(hex(doc_id % 256), 2, '0'), '01007F0200')), CAST(text AS BINARY))
  ELSE CAST(text AS BINARY) END"""
register(
    "image_dims", lambda t: ingest.image_header(documents(t).selectExpr("doc_id", f"{HEADED} AS content")).drop("content"),
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/bmp' WHEN 3 THEN 'image/jpeg' WHEN 4 THEN 'image/webp' END AS mime,
         CAST(CASE doc_id % 6 WHEN 0 THEN octet_length(encode(text)) % 65536 WHEN 1 THEN doc_id % 256 + 256 * (doc_id % 7) WHEN 2 THEN doc_id % 256 + 512 WHEN 3 THEN 1 + octet_length(encode(text)) % 60000 WHEN 4 THEN 257 + doc_id % 256 END AS INT) AS width,
         CAST(CASE doc_id % 6 WHEN 0 THEN doc_id % 2000000 WHEN 1 THEN 320 WHEN 2 THEN 384 WHEN 3 THEN 1 + doc_id % 3000 WHEN 4 THEN 640 END AS INT) AS height FROM documents""",
)
FILES = "SELECT doc_id, concat('f', doc_id, CASE doc_id % 7 WHEN 0 THEN '.txt' ELSE '.PNG' END) AS path, CASE doc_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN NULL ELSE 'image/png' END AS mime FROM documents"


def validated(t: Tables) -> DataFrame:
    wanted = documents(t).selectExpr("doc_id", "concat('f', doc_id, CASE doc_id % 7 WHEN 0 THEN '.txt' ELSE '.PNG' END) AS path", "CASE doc_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN NULL ELSE 'image/png' END AS mime")
    files = wanted.filter("doc_id % 11 > 0").selectExpr("path", "IF(doc_id % 13 = 0, 0L, 100L) AS length")
    decoded = wanted.filter("doc_id % 11 > 0").selectExpr("path", "IF(doc_id % 50 = 49, -1, 48) AS width")
    return ingest.validate_files(wanted.select("path", "mime"), files, decoded)


register("validate_files", validated, f"SELECT path, mime, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'unsupported' WHEN doc_id % 13 = 0 THEN 'empty' WHEN doc_id % 50 = 49 THEN 'undecodable' WHEN mime = 'text/html' THEN 'mime' END AS error FROM ({FILES})")
QC = {"sharpness": "sharpness", "resolution": "resolution", "photometric": "brightness, contrast, saturation", "noise": "noise", "aesthetic_heuristic": "aesthetic", "background": "background", "exposure_clipping": "bright_share, dark_share, clipped_share", "posterization": "levels, empty_bins", "jpeg_blocks": "blockiness", "borders": "borders", "frequency_balance": "low_freq, mid_freq, high_freq"}
for kernel, columns in QC.items():
    register(f"qc_{kernel}", lambda t, columns=columns: image_qc.image_features(pictures(t), "doc_id").select("doc_id", *(F.round(c, 6).alias(c) for c in columns.split(", ")), "error"))


def analysed(t: Tables) -> DataFrame:
    labels = t.vectors.filter("vec_id < 24").selectExpr("CASE vec_id % 3 WHEN 0 THEN 'scene' WHEN 1 THEN 'background' ELSE 'light' END AS grp", "concat('tag', vec_id) AS tag", "embedding AS q")
    faces = t.assets.selectExpr("asset_id AS doc_id", "face_quality AS face")
    stages = asset_stages("doc_id", pictures(t), faces, t.vectors.selectExpr("vec_id AS doc_id", "embedding"), labels, t.assets)
    return analyse(t.assets.selectExpr("asset_id AS doc_id"), "doc_id", stages)


register("qc_pipeline", analysed)
#: Boxes of faces in pictures, in turns inside, over the rim, and outside.
BOXED = ("*", "CAST(doc_id % 30 AS DOUBLE) AS x1", "CAST(doc_id % 20 AS DOUBLE) AS y1", "CAST(doc_id % 30 + 8 + doc_id % 40 AS DOUBLE) AS x2", "CAST(doc_id % 20 + 8 + doc_id % 25 AS DOUBLE) AS y2")
register("skin_tones", lambda t: skin_tones(pictures(t).selectExpr(*BOXED), "doc_id"))

X = expressions("comparisons", "spark")
events = lambda t: streams.stream_of(t.spark, f"{t.sf_dir}/events.parquet").alias("e")
register("stream_ingest_dedup", lambda t: streams.ingest_dedup(streams.stream_of(t.spark, f"{t.sf_dir}/documents.parquet").select(F.col("source").alias("project_id"), F.sha2("text", 256).alias("sha256"))), "SELECT DISTINCT source AS project_id, sha256(text) AS sha256 FROM documents")
register("stream_counters", lambda t: streams.counters(streams.stream_of(t.spark, f"{t.sf_dir}/labels.parquet").selectExpr("concat('p', doc_id % 20) AS project_id", "IF(quality = 1, 'approved', 'rejected') AS review_state", "toxic = 1 AS is_flagged", "quality = 0 AS is_rejected")), "SELECT 'p' || CAST(doc_id % 20 AS STRING) AS project_id, count(*) AS asset_count, count(*) AS reviewed, count(*) FILTER (toxic = 1) AS flagged, count(*) FILTER (quality = 0) AS rejected FROM labels GROUP BY 1")
register("stream_provider_latency", lambda t: streams.provider_latency(events(t).selectExpr("e.event_type AS provider", "CAST(e.ts AS TIMESTAMP) AS ts", "e.event_type <> 'error' AND e.event_id % 9 <> 0 AS ok", "CAST(e.value AS DOUBLE) AS latency_ms")), "SELECT event_type AS provider, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, count(*) AS calls, count(*) FILTER (event_type = 'error' OR event_id % 9 = 0) AS failures, max(CAST(value AS DOUBLE)) AS most FROM events GROUP BY 1, 2")
register("stream_ratings", lambda t: streams.ratings(events(t).where("e.event_id * 13 % 211 <> e.event_id * 29 % 211").selectExpr(*(f"{x} AS {k}" for k, x in X.items()))))
