"""What several operators of this package need: batches and slices of bounded size, index arithmetic, checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that Python code holds at a time, and that a task gets where the operator deals the rows.
SLICE_BYTES = 2 << 20
TASK_BYTES = 16 << 20


def text_bytes(df: DataFrame, column: str) -> int:
    return df.select(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def parts_for(n_bytes: int, task_bytes: int = TASK_BYTES) -> int:
    return max(1, math.ceil(n_bytes / task_bytes))


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in a session that hands Python tasks a few MB at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * SLICE_BYTES))
    return df


@contextlib.contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs in this block leave no shuffle files behind once they end; what they give is to be a table or in the driver then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def hand_back() -> None:
    """Gives freed memory back to the system: Python workers live on from task to task and stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most limit bytes of the text column each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // limit
        starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
    hand_back()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i], ..., starts[i] + lengths[i] - 1, for one i after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


#: A side of a join is broadcast up to so many bytes; beyond, both sides are shuffled.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows have few bytes in all, else df: the join is the same, only its plan differs."""
    widths = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) if isinstance(f.dataType, T.StringType | T.BinaryType) else F.lit(8) for f in df.schema.fields]
    size = df.select(F.sum(sum(widths, F.lit(24))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= most else df


def map_rows(df: DataFrame, text: str, judge: Callable[[pa.Array], dict[str, pa.Array]], shape: str, limit: int = SLICE_BYTES, extra: list[str] | None = None) -> DataFrame:
    """df as column row, with the columns of shape that judge gives for the texts (null: empty).

    judge gets the texts of at most limit bytes, then the columns of extra, as Arrow arrays. The columns of df are kept
    in a struct, so their names can't clash with new ones.
    """
    kinds = T.StructType([T.StructField("row", df.schema, False), *T.StructType.fromDDL(shape).fields])
    names = [f.name for f in kinds.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", limit):
            made = judge(part.column("text"), *(part.column(f"x{k}") for k in range(len(extra or []))))
            yield pa.RecordBatch.from_arrays([part.column("row"), *(made[n] for n in names[1:])], names)

    given = bounded_batches(df).select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.coalesce(f"`{text}`", F.lit("")).alias("text"), *(F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(extra or [])))
    return given.mapInArrow(run, kinds)
