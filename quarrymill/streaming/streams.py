"""Online loops as Structured Streaming queries. Each takes a streaming DataFrame, runs on what is there, and gives the
table that it keeps; state and results live in the folder that all executors share."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrymill.operators.ratings import ELO, elo_update
from quarrymill.operators.tables import new_folder


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files of a Parquet table, be it one file or a folder, with the table's schema."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def run(stream: DataFrame, mode: str, name: str, sink: Callable[[DataFrame, int], None] | None = None, base: str | None = None, watch: Callable[[dict], None] | None = None) -> str:
    """Runs a stream over what is there; gives the folder of its output.

    With a base (a shared folder) a later run goes on where one with the same base has ended. watch gets the progress of each batch.
    """
    base = base or new_folder(stream.sparkSession, name)
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True)
    query = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", f"{base}/rows").start()
    query.awaitTermination()
    for progress in query.recentProgress if watch else ():
        watch(json.loads(progress.json) if hasattr(progress, "json") else progress)
    return f"{base}/rows"


def has_files(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path))


def ingest_dedup(files: DataFrame, late: str = "10 minutes", base: str | None = None, watch: Callable[[dict], None] | None = None) -> DataFrame:
    """project_id and sha256 of the first arrival of each content; later copies are dropped.

    Time is when a batch is read, so no file is too late to be taken. Copies that are read within the watermark of each
    other are dropped by the stream's state, which forgets a content once the watermark has passed it. What has been
    let through is a table of known contents, by the first digit of the hash; later batches are held against it, so a
    copy is found however late it comes. A batch that is run again writes over its own part, and isn't held against it.
    """
    spark = files.sparkSession
    base = base or new_folder(spark, "ingest")
    known = f"{base}/known"
    fresh = files.select("project_id", "sha256", F.current_timestamp().alias("read_at")).withWatermark("read_at", late).dropDuplicatesWithinWatermark(["project_id", "sha256"])

    def keep(df: DataFrame, i: int) -> None:
        new = df.select("project_id", "sha256", F.substring("sha256", 1, 1).alias("prefix"))
        if has_files(spark, known):
            before = spark.read.schema("project_id string, sha256 string, batch long, prefix string").parquet(known).filter(F.col("batch") != i).drop("batch")
            new = new.join(before, ["project_id", "sha256", "prefix"], "left_anti")
        new.write.mode("overwrite").partitionBy("prefix").parquet(f"{known}/batch={i}")

    run(fresh, "append", "ingest", keep, base, watch)
    shape = f"project_id {files.schema['project_id'].dataType.simpleString()}, sha256 string, batch long, prefix string"
    return spark.read.schema(shape).parquet(known).select("project_id", "sha256")


def counters(assets: DataFrame) -> DataFrame:
    """Counters per project, updated batch by batch: each batch adds the rows of the projects that it touches."""
    spark = assets.sparkSession
    n = lambda c: F.count_if(c)
    counted = assets.groupBy("project_id").agg(F.count("*").alias("asset_count"), n(F.col("review_state").isin("approved", "rejected")).alias("reviewed"), n(F.col("is_flagged")).alias("flagged"), n(F.col("is_rejected")).alias("rejected"))
    out = new_folder(spark, "counters")
    run(counted, "update", "counters", lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batches/batch={i:08d}"))
    every = spark.read.parquet(f"{out}/batches/*")
    names = counted.columns[1:]
    return every.groupBy("project_id").agg(F.max_by(F.struct(*names), "batch").alias("x")).select("project_id", "x.*")


def provider_latency(usage: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per provider and window of event time (seconds since 1970 at its start): calls, failures, total and greatest latency."""
    spark = usage.sparkSession
    by = usage.withWatermark("ts", late).groupBy("provider", F.window("ts", window).alias("w")).agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.max("latency_ms").alias("most"))
    flat = by.select("provider", F.unix_seconds("w.start").alias("start"), "calls", "failures", "most")
    out = new_folder(spark, "latency")
    run(flat, "update", "latency", lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batches/batch={i:08d}"))
    every = spark.read.parquet(f"{out}/batches/*")
    return every.groupBy("provider", "start").agg(F.max_by(F.struct("calls", "failures", "most"), "batch").alias("x")).select("provider", "start", "x.*")


class SessionRatings(StatefulProcessor):
    """A session's ratings as a map from asset to rating and comparisons; a batch reads and writes only the assets it has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("ratings", "asset_id long", "elo double, comparisons int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        batch = pd.concat(list(rows)).sort_values(["made_at", "id"])
        touched = sorted({int(x) for x in (*batch["winner"], *batch["loser"])})
        now = {a: tuple(self.known.getValue((a,))) if self.known.containsKey((a,)) else (ELO, 0) for a in touched}
        for r in batch.itertuples():
            (w, wn), (l, ln) = now[r.winner], now[r.loser]  # noqa: E741
            w, l = elo_update(w, l, bool(r.is_draw))  # noqa: E741
            now[r.winner], now[r.loser] = (w, wn + 1), (l, ln + 1)
        for a in touched:
            self.known.updateValue((a,), (float(now[a][0]), int(now[a][1])))
        yield pd.DataFrame({"session_id": key[0], "asset_id": touched, "elo": [now[a][0] for a in touched], "comparisons": [now[a][1] for a in touched]})

    def close(self) -> None:
        pass


def ratings(comparisons: DataFrame, base: str | None = None, watch: Callable[[dict], None] | None = None) -> DataFrame:
    """session_id, asset_id, elo and comparisons: one update per comparison, in order (made_at, id) within a batch."""
    spark = comparisons.sparkSession
    base = base or new_folder(spark, "ratings")
    provider, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, rocks)  # map states need it
    try:
        stream = comparisons.groupBy("session_id").transformWithStateInPandas(SessionRatings(), "session_id long, asset_id long, elo double, comparisons int", "update", "none")
        run(stream, "update", "ratings", lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{base}/batches/batch={i:08d}"), base, watch)
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    every = spark.read.schema("session_id long, asset_id long, elo double, comparisons int, batch int").parquet(f"{base}/batches/*")
    last = every.groupBy("session_id", "asset_id").agg(F.max_by(F.struct("elo", "comparisons"), "batch").alias("x"))
    return last.select("session_id", "asset_id", F.round("x.elo", 6).alias("elo"), "x.comparisons")
