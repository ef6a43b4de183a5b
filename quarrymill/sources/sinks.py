"""Export manifests and sinks: where each file of an export goes, and the captions beside them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.captions import export_caption
from quarrymill.operators.relations import ranked
from quarrymill.operators.tables import written
from quarrymill.sources import folders


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(\.[^.]*)$", 1)


def with_caption(assets: DataFrame, captions: DataFrame, trigger: str = "", style: str = "active") -> DataFrame:
    texts = captions.filter("is_active AND trim(text) <> ''").select("asset_id", export_caption(F.col("text"), trigger, style).alias("caption"))
    return assets.join(texts, "asset_id", "left")


def lora_manifest(assets: DataFrame, captions: DataFrame, trigger: str, repeats: int, fmt: str = "png") -> DataFrame:
    """{project}/{repeats}_{trigger}/{stem}.{fmt}, and the caption's path where there is one."""
    base = F.concat(F.col("project_id"), F.lit(f"/{repeats}_{trigger}/"), stem(F.col("filename")))
    j = with_caption(assets, captions, trigger, "trigger_prefix")
    return j.select("project_id", "asset_id", F.concat(base, F.lit(f".{fmt}")).alias("path"), F.when(F.col("caption").isNotNull(), F.concat(base, F.lit(".txt"))).alias("caption_path"), "caption")


def kohya_manifest(assets: DataFrame, captions: DataFrame, trigger: str, repeats: int) -> DataFrame:
    """{project}/img/{repeats}_{trigger}/{filename}."""
    folder = F.concat(F.col("project_id"), F.lit(f"/img/{repeats}_{trigger}/"))
    return with_caption(assets, captions).select("project_id", "asset_id", F.concat(folder, "filename").alias("path"), F.when(F.col("caption").isNotNull(), F.concat(folder, stem(F.col("filename")), F.lit(".txt"))).alias("caption_path"))


def zip_manifest(assets: DataFrame, captions: DataFrame) -> DataFrame:
    """A flat list of entries: each file, and its caption file where there is one."""
    j = with_caption(assets, captions)
    entry = F.array_compact(F.array(F.col("filename"), F.when(F.col("caption").isNotNull(), F.concat(stem(F.col("filename")), F.lit(".txt")))))
    return j.select("project_id", "asset_id", F.explode(entry).alias("entry"))


def ranked_names(assets: DataFrame, key: Column, digits: int = 4) -> DataFrame:
    """project_id, asset_id, name: rank (from 1, by key, at least so many digits), stem and ending."""
    rank, digit = F.col("rank"), F.lpad(F.col("rank").cast("string"), digits, "0")
    place = F.when(rank < 10**digits, digit).otherwise(rank.cast("string"))
    return ranked(assets.select("project_id", "asset_id", "filename", key.alias("_by")), F.col("_by")).select("project_id", "asset_id", F.concat(place, F.lit("_"), "filename").alias("name"))


def split_layout(assets: DataFrame, mode: str) -> DataFrame:
    """flat: the name; clustered: {identity or unclustered}/name; ranked: as ranked_names by rating."""
    if mode == "ranked":
        return ranked_names(assets, F.col("elo"))
    folder = F.concat(F.coalesce("identity_cluster_id", F.lit("unclustered")), F.lit("/")) if mode == "clustered" else F.lit("")
    return assets.select("project_id", "asset_id", F.concat(folder, "filename").alias("name"))


def sidecar_counts(assets: DataFrame, captions: DataFrame) -> DataFrame:
    """Per project: captions to write, and assets without one."""
    return with_caption(assets, captions).groupBy("project_id").agg(F.count("caption").alias("written"), F.count_if(F.col("caption").isNull()).alias("errors"))


def write_sidecars(assets: DataFrame, captions: DataFrame, folder: str) -> DataFrame:
    """Writes {project}_{asset_id}.txt, in UTF-8, for each captioned asset, all or none; gives asset_id, name and the caption as it is in the file.

    Tasks write beside the folder's files, and the job's commit puts them in place (see sources.folders).
    """
    named = with_caption(assets, captions).filter("caption IS NOT NULL").select(F.concat("project_id", F.lit("_"), F.col("asset_id").cast("string"), F.lit(".txt")).alias("name"), F.col("caption").alias("text"))
    folders.register(assets.sparkSession)
    named.write.format("text_files").option("path", folder).mode("append").save()
    back = assets.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    name = F.regexp_extract("path", r"[^/]+$", 0)
    return back.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("asset_id"), name.alias("name"), F.decode("content", "UTF-8").alias("caption"))


def sidecar_results(assets: DataFrame, captions: DataFrame, folder: str) -> DataFrame:
    """Per project: sidecar files as they are in the folder after writing, and assets without one."""
    files = write_sidecars(assets, captions, folder).select("asset_id", "name")
    return assets.select("project_id", "asset_id").join(files, "asset_id", "left").groupBy("project_id").agg(F.count("name").alias("written"), F.count_if(F.col("name").isNull()).alias("errors"))


def parquet_shards(df: DataFrame, folder: str, rows_per_file: int) -> DataFrame:
    """Writes df in files of at most rows_per_file rows; gives file, rows and the schema as JSON."""
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(folder)
    back = df.sparkSession.read.schema(df.schema).parquet(folder)
    return back.groupBy(F.regexp_extract(F.input_file_name(), r"[^/]+$", 0).alias("file")).agg(F.count("*").alias("rows")).withColumn("schema", F.lit(json.dumps(df.schema.jsonValue())))


def curated_table(assets: DataFrame, labels: DataFrame) -> DataFrame:
    """A new version of the asset table, written, with duplicate labels (asset_id, cluster, type) in place of the old ones."""
    fresh = assets.drop("duplicate_cluster_id", "duplicate_type").join(labels.select("asset_id", F.col("cluster").cast("string").alias("duplicate_cluster_id"), F.col("type").alias("duplicate_type")), "asset_id", "left")
    return written(fresh, "curated")
