"""Files in: listing, validation, content and perceptual hashes, sidecar captions, content dedup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.sources import folders

#: Accepted endings and the largest size in bytes.
IMAGES = ("jpg", "jpeg", "png", "webp", "bmp", "gif", "tiff", "tif")
MOST_BYTES = 500 * 1024 * 1024
MIMES = ("image/jpeg", "image/png", "image/webp", "image/bmp", "image/gif", "image/tiff")


def scan_files(spark: SparkSession, folder: str, endings: tuple[str, ...] = IMAGES, most: int = MOST_BYTES, links: bool = False) -> DataFrame:
    """path, name and length of the files below folder: no hidden part, a known ending, not too large, and no links unless
    asked for. Empty files are listed. No content is read.

    The folder source lists folders in partitions. Where only Spark can open a path, its own file source lists instead,
    which has neither links nor, as it gives nothing to read, files of length 0.
    """
    scheme = folder.split(":", 1)[0] if "://" in folder or folder.startswith("file:") else "file"
    if scheme in ("file", "s3", "gs", "hdfs", "abfs", "abfss"):
        folders.register(spark)
        files = spark.read.format("folder").option("path", folder).option("endings", ",".join(endings)).load()
        files = files.filter(F.lit(links) | ~F.col("is_link")).filter(F.col("length") <= most)
        return files.select("path", F.regexp_extract("path", r"[^/]+$", 0).alias("name"), "length", *(["is_link"] if links else []))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    inside = F.substring_index(F.col("path"), folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return files.filter((F.col("length") <= most) & ending.isin(*endings) & ~inside.rlike(r"(^|/)\.")).select("path", F.regexp_extract("path", r"[^/]+$", 0).alias("name"), "length", *([F.lit(False).alias("is_link")] if links else []))


def storage_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def image_dims(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height, channels and decoded pixels (BGR); width -1 of a file that can't be decoded."""
    return spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder).select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


#: JPEG markers that hold the frame's size, and those without a segment behind them (fixed by the format).
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
BARE = {0x01, *range(0xD0, 0xD8)}
SCAN, END = 0xDA, 0xD9


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height by the first frame header, from marker to marker; None if it is cut off or comes after a scan."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF or marker in BARE:  # a filling byte, or nothing but a marker
            at += 1 if marker == 0xFF else 2
        elif marker in FRAMES:
            return (int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")) if at + 9 <= len(data) else None
        elif marker in (SCAN, END):
            return None
        else:
            at += 2 + max(2, int.from_bytes(data[at + 2 : at + 4], "big"))
    return None


def webp_size(data: bytes) -> tuple[int, int] | None:
    """Width and height by the first of the chunks VP8X, VP8L and VP8; None if it is cut off."""
    at, little = 12, lambda place, n: int.from_bytes(data[place : place + n], "little")
    while at + 8 <= len(data):
        kind, size, body = data[at : at + 4], little(at + 4, 4), at + 8
        if kind == b"VP8X" and body + 10 <= len(data):
            return little(body + 4, 3) + 1, little(body + 7, 3) + 1
        if kind == b"VP8L" and body + 5 <= len(data) and data[body] == 0x2F:
            bits = little(body + 1, 4)
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if kind == b"VP8 " and body + 10 <= len(data) and data[body + 3 : body + 6] == b"\x9d\x01\x2a":
            return little(body + 6, 2) & 0x3FFF, little(body + 8, 2) & 0x3FFF
        if kind in (b"VP8X", b"VP8L", b"VP8 "):
            return None
        at = body + size + size % 2
    return None


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def walked_size(data: pd.Series) -> pd.DataFrame:
    """Sizes of JPEG and WebP, whose place depends on what comes before; null for null."""
    found = [None if d is None else jpeg_size(d) if d[:2] == b"\xff\xd8" else webp_size(d) for d in data]
    return pd.DataFrame([f or (None, None) for f in found], columns=["width", "height"], dtype="Int32")


def image_header(files: DataFrame, content: str = "content") -> DataFrame:
    """files with mime, width and height as the headers state them, without decoding pixels.

    PNG, GIF and BMP state their size at a fixed place; for JPEG the markers and for WebP the chunks are walked, and only
    these contents go to Python. Other and cut-off content has no size; null content is empty.
    """
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    start = F.hex(F.substring(data, 1, 12))
    mime = F.when(start.startswith("89504E470D0A1A0A"), "image/png").when(start.startswith("47494638"), "image/gif").when(start.startswith("424D"), "image/bmp").when(start.startswith("FFD8FF"), "image/jpeg").when(start.rlike("^52494646.{8}57454250"), "image/webp")
    walked = walked_size(F.when(mime.isin("image/jpeg", "image/webp"), data))
    digits = lambda place, n: F.when(F.octet_length(data) >= place + n - 1, F.hex(F.substring(data, place, n)))
    little = lambda h: F.regexp_replace(h, "^(..)(..)(?:(..)(..))?$", "$4$3$2$1")
    number = lambda h: F.conv(h, 16, 10).cast("long").cast("int")
    side = lambda name, png, gif, bmp: F.when(mime == "image/png", number(digits(png, 4))).when(mime == "image/gif", number(little(digits(gif, 2)))).when(mime == "image/bmp", number(little(digits(bmp, 4)))).otherwise(F.col("_walked")[name])
    return files.withColumn("_walked", walked).withColumns({"mime": mime, "width": side("width", 17, 7, 19), "height": side("height", 21, 9, 23)}).drop("_walked")


def validate_files(wanted: DataFrame, files: DataFrame, decoded: DataFrame) -> DataFrame:
    """wanted (path, mime) with error: the first of missing, unsupported, empty, undecodable, mime; NULL if all is well."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    j = wanted.join(files.select("path", "length"), "path", "left").join(decoded.select("path", "width"), "path", "left")
    good = F.col("mime").isin(*MIMES) | F.col("mime").isNull() | F.col("mime").isin("", "application/octet-stream")
    error = F.when(F.col("length").isNull(), "missing").when(~ending.isin(*IMAGES), "unsupported").when(F.col("length") == 0, "empty").when(F.coalesce("width", F.lit(-1)) < 0, "undecodable").when(~good, "mime")
    return j.select("path", "mime", error.alias("error"))


def content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))


def ingest_dedup(batch: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of batch (project_id, position, sha256) whose content is neither known nor earlier in the batch."""
    fresh = batch.join(known.select("project_id", "sha256").distinct(), ["project_id", "sha256"], "left_anti")
    first = fresh.groupBy("project_id", "sha256").agg(F.min("position").alias("position"))
    return fresh.join(first, ["project_id", "sha256", "position"], "left_semi")


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    """Per project of rows with outcome (created, duplicate, error): counts, completed and percent."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    out = outcomes.groupBy("project_id").agg(F.count("*").alias("total"), n("created").alias("created"), n("duplicate").alias("duplicates"), n("error").alias("errors"))
    done = F.col("created") + F.col("duplicates") + F.col("errors")
    return out.withColumn("completed", done).withColumn("pct", F.round(100.0 * done / F.col("total"), 1))


def collision_names(assets: DataFrame) -> DataFrame:
    """project_id, asset_id, stored: repeated file names of a project become stem_1.ext, stem_2.ext and so on."""
    n = F.row_number().over(Window.partitionBy("project_id", "filename").orderBy("asset_id")) - 1
    name = F.col("filename")
    stored = F.when(n == 0, name).otherwise(F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), n.cast("string"), F.regexp_extract(name, r"(\.[^.]*)$", 1)))
    return assets.select("project_id", "asset_id", stored.alias("stored"))


def sidecar_join(images: DataFrame, texts: DataFrame) -> DataFrame:
    """images (path) with caption: the stripped text of <stem>.txt beside them (path, value); an empty one is none."""
    key = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    value = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    sides = texts.filter(F.col("path").endswith(".txt")).select(key(F.col("path")).alias("k"), F.nullif(value, F.lit("")).alias("caption"))
    return images.withColumn("k", key(F.col("path"))).join(sides, "k", "left").drop("k")


def shrink(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each cell of a grid laid over the image."""
    h, w = grey.shape
    rows, columns = np.arange(height) * h // height, np.arange(width) * w // width
    sums = np.add.reduceat(np.add.reduceat(grey, rows, 0), columns, 1)
    return sums / np.outer(np.maximum(np.diff(rows, append=h), 1), np.maximum(np.diff(columns, append=w), 1))


def bits_hex(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel()).tobytes().hex()


def perceptual_hash(images: DataFrame, key: str) -> DataFrame:
    """key, phash (DCT), dhash and ahash as 16 hex digits of decoded images; NULL where width is -1."""
    n = np.arange(32)
    dct = np.cos(np.pi * (2 * n[None, :] + 1) * n[:, None] / 64)
    kind = images.schema[key].dataType.simpleString()

    def one(height: int, width: int, channels: int, data: bytes) -> tuple[str | None, str | None, str | None]:
        if height <= 0 or width <= 0:
            return None, None, None
        px = np.frombuffer(data, np.uint8).reshape(height, width, channels)[:, :, :3].astype(float)
        grey = px[:, :, 0] if px.shape[2] == 1 else px @ np.array([0.114, 0.587, 0.299])
        low = (dct @ shrink(grey, 32, 32) @ dct.T)[:8, :8]
        d, a = shrink(grey, 8, 9), shrink(grey, 8, 8)
        return bits_hex(low > np.median(low)), bits_hex(d[:, :-1] < d[:, 1:]), bits_hex(a > a.mean())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [one(*r) for r in rows[["height", "width", "channels", "data"]].itertuples(index=False)]
            yield pd.DataFrame({"k": rows["k"], **{n: [m[i] for m in made] for i, n in enumerate(("phash", "dhash", "ahash"))}})

    return images.select(F.col(key).alias("k"), "height", "width", "channels", "data").mapInPandas(run, f"k {kind}, phash string, dhash string, ahash string").withColumnRenamed("k", key)
