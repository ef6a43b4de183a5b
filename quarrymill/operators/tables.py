"""Tables in the folder that all executors share: they cut lineage, survive lost executors, and fix what was decided."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); one of our own only where it is unset and Spark is local."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: A side of a join is broadcast up to so many bytes; beyond, both sides are shuffled.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows have few bytes in all, by a count of them, else df: only the join's plan differs."""
    width = lambda f: F.octet_length(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType | T.BinaryType) else F.size(F.col(f"`{f.name}`")) * 8 if isinstance(f.dataType, T.ArrayType) else F.lit(8)
    size = df.select(F.sum(sum((F.coalesce(width(f), F.lit(0)) for f in df.schema.fields), F.lit(24))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= most else df


def beside(df: DataFrame) -> DataFrame:
    """df for a join: broadcast if it has few bytes by a count of its rows, else merged. Files and shuffled blocks that compress
    well look small to Spark, which would then hold all their rows in the driver."""
    hinted = small(df)
    return df.hint("merge") if hinted is df else hinted


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, in few bytes."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path := new_folder(spark, name))
    return spark.read.schema(df.schema).parquet(path)
