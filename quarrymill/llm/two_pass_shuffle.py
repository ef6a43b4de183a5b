"""Sharding with a two-pass external shuffle, in DataFrame functions only.

Pass one scatters whole records: a row's key fixes its shard (highest random weight), and a seeded hash deals the rows of
a shard uniformly over buckets that fit in memory; a shard has as many buckets as its own bytes ask for, so one that a hot
key fills has more of them. Pass two shuffles each bucket with Fisher-Yates (Spark's shuffle function), numbers the rows
of a shard through its buckets, from 0 without gaps, and writes each bucket as a file of its shard.

Defined cases: a null key counts as a key of its own, so all such rows share a shard; repeated rows keep one slot each;
an empty table gives no rows; n_shards of 1 puts all rows in shard 0. Columns of the input keep their names, but shard
and slot of the input give way to the new ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.shared import parts_for
from quarrymill.operators.tables import new_folder, written

#: Bytes of records in a bucket, on average, and of the buckets in a task. A bucket is one array of a task.
BUCKET_BYTES, TASK_BYTES = 8 << 20, 32 << 20


def weight(key: str, shard: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key), shard)


def shard_of(key: str, n_shards: int, seed: int = 0) -> Column:
    """The shard with the highest random weight for the key: with one more shard, rows move only into that one."""
    weights = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.struct(weight(key, s, seed).alias("w"), s.alias("s")))
    return F.array_max(weights)["s"]


def scatter(docs: DataFrame, key: str, size: Column, n_shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """Pass one: record (docs' columns), row, shard and bucket of every row, written to the shared folder; and all bytes."""
    shard = shard_of(key, n_shards, seed)
    filled = {r["shard"]: r["n"] or 0 for r in docs.groupBy(shard.alias("shard")).agg(F.sum(size).alias("n")).collect()}  # n_shards rows
    buckets = F.array(*(F.lit(max(1, math.ceil(filled.get(s, 0) / bucket_bytes))) for s in range(n_shards)))
    dealt = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"), shard.alias("shard"), F.monotonically_increasing_id().alias("row"))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), "row"), F.get(buckets, F.col("shard")))
    return written(dealt.withColumn("bucket", bucket.cast("int")), "scattered"), sum(filled.values())


def two_pass_shuffle(docs: DataFrame, key: str, size: Column, n_shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with shard (int) and slot (long): a seeded random order within each shard, each bucket's rows in order of slot."""
    scattered, total = scatter(docs, key, size, n_shards, seed, bucket_bytes)
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    begins = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", before.alias("begin"))
    # rows first, so that a repeated task collects and orders the same array whatever order its input comes in
    filled = scattered.repartition(parts_for(total, TASK_BYTES), "shard", "bucket").groupBy("shard", "bucket").agg(F.collect_list(F.struct("row", "record")).alias("records"))
    ordered = filled.withColumn("records", F.array_sort("records", lambda x, y: F.when(x["row"] < y["row"], -1).when(x["row"] > y["row"], 1).otherwise(0)))
    # shuffle() draws by partition and row: in this order a repeated task makes the same draws
    mixed = ordered.sortWithinPartitions("shard", "bucket").withColumn("records", F.shuffle("records", seed))
    placed = mixed.join(begins, ["shard", "bucket"]).select("shard", "begin", F.posexplode("records").alias("at", "found"))
    kept = (c for c in docs.columns if c not in ("shard", "slot"))
    return placed.select(*(F.col(f"found.record.`{c}`").alias(c) for c in kept), "shard", (F.col("begin") + F.col("at")).alias("slot"))


def write_shards(docs: DataFrame, key: str, size: Column, n_shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The shards as written: whole records in one folder per shard, each bucket a file in order of slot; read back with shard and slot."""
    mixed = two_pass_shuffle(docs, key, size, n_shards, seed, bucket_bytes)
    path = new_folder(docs.sparkSession, "shards")
    mixed.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(mixed.schema).parquet(path)
