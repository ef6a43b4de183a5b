"""Media columns as baseline JPEG, read by their DC coefficients only.

thumbnails() parses the markers of each image, Huffman-decodes its scans (AC coefficients are skipped over), and builds
the luminance thumbnail of one pixel per 8x8 block from the DC coefficients. All restart intervals of a batch are
decoded in step with one another, as numpy vectors.

store_texts() is the lossless way to keep any bytes so: each byte is the grey value of one flat 8x8 block, with a DC
quantiser of 8 and a restart marker after each row of 64 blocks. A JPEG holds 8191 rows; longer payloads are several
images, one after the other in the same value.

Defined cases: a null or empty text is 64 zero bytes; equal texts give equal media; null, broken, cut-off or progressive
media give null images.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.shared import bounded_batches, bounds, slices
from quarrymill.operators.tables import written

ROW, MOST_ROWS = 64, 8191
#: Bytes of text that are turned into media at a time.
STORE_BYTES = 1 << 20
#: Our Huffman tables. A DC category's code has such a length that with its value and the one bit of the AC end of block
#: it fills whole bytes: one up to category 6, two for 7, three for 8. So words that come again are bytes that come again,
#: and the column compresses as text does.
DC_LENGTHS = (7, 6, 5, 4, 3, 2, 1, 8, 15)
DC_TABLE = bytes([*(DC_LENGTHS.count(n) for n in range(1, 17)), *sorted(range(9), key=DC_LENGTHS.__getitem__)])
AC_TABLE = bytes([1, *[0] * 15, 0])
QUANTISER = bytes([8, *[1] * 63])


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int) -> bytes:
    """All that comes before the scan of an image of 64 x rows blocks."""
    return b"".join([
        b"\xff\xd8",
        segment(0xDB, b"\0" + QUANTISER),
        segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * ROW, 1) + bytes([1, 0x11, 0])),
        segment(0xC4, b"\0" + DC_TABLE),
        segment(0xC4, b"\x10" + AC_TABLE),
        segment(0xDD, struct.pack(">H", ROW)),
        segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


def code_table() -> tuple[np.ndarray, np.ndarray]:
    """For a difference of -255 to 255, at + 255: the bytes of its DC code, its value and the end of block; their number."""
    codes, code, last = {}, 0, 0
    for category in sorted(range(9), key=DC_LENGTHS.__getitem__):
        code <<= DC_LENGTHS[category] - last
        codes[category], last, code = code, DC_LENGTHS[category], code + 1
    out, used = np.zeros((511, 3), np.uint8), np.zeros(511, np.int64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        used[d + 255] = size = (DC_LENGTHS[n] + n + 1) // 8
        value = d if d >= 0 else d + (1 << n) - 1
        out[d + 255, :size] = list(((codes[n] << n | value) << 1).to_bytes(size, "big"))
    return out, used


CODES, CODE_BYTES = code_table()


def scans(payload: np.ndarray, last: np.ndarray, restart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coded rows of 64 blocks with the marker behind each: the end of the image where last, else that restart.

    Gives all bytes, and where each row begins (one more than rows).
    """
    rows = payload.reshape(-1, ROW).astype(np.int16)
    step = np.diff(rows, axis=1, prepend=np.int16(128)) + 255
    used = CODE_BYTES[step]
    coded = CODES[step.ravel()][np.arange(3) < used.reshape(-1, 1)]
    sizes = used.sum(axis=1)
    stuffed = coded == 0xFF
    place = np.arange(len(coded)) + np.cumsum(stuffed) - stuffed + 2 * np.repeat(np.arange(len(sizes)), sizes)
    starts = bounds(sizes + 2 + np.add.reduceat(stuffed, bounds(sizes)[:-1], dtype=np.int64))
    out = np.zeros(starts[-1], np.uint8)
    out[place] = coded
    out[starts[1:] - 2], out[starts[1:] - 1] = 0xFF, np.where(last, 0xD9, 0xD0 + restart % 8)
    return out, starts


def to_media(texts: list[bytes]) -> list[bytes]:
    padded = [t + bytes(-len(t) % 64 or (0 if t else 64)) for t in texts]
    rows = np.array([len(p) // ROW for p in padded])
    of = np.concatenate([np.arange(n) for n in rows])  # number of the row in its text
    total = np.repeat(rows, rows)
    last = (of == total - 1) | (of % MOST_ROWS == MOST_ROWS - 1)
    out, starts = scans(np.frombuffer(b"".join(padded), np.uint8), last, of % MOST_ROWS)
    media, first = [], bounds(rows)
    for k, n in enumerate(rows.tolist()):
        parts = []
        for a in range(0, n, MOST_ROWS):
            b = min(n, a + MOST_ROWS)
            parts += [header(b - a), out[starts[first[k] + a] : starts[first[k] + b]].tobytes()]
        media.append(b"".join(parts))
    return media


@dataclass
class Scan:
    """What decoding needs of one scan: its bytes, tables by component of an MCU's blocks, and its restart interval."""

    data: bytes
    blocks: list[tuple[int, int, int]]  # component's place, DC table, AC table
    mcus: int
    interval: int


@dataclass
class Image:
    width: int
    height: int
    quantiser: int = 1
    h: int = 1
    v: int = 1
    across: int = 0  # blocks of the luminance in a row of its scan
    single: bool = True
    scan: Scan | None = None
    thumbnail: np.ndarray | None = field(default=None, repr=False)


class Tables:
    """Huffman tables as look-up by the next 16 bits: length << 8 | symbol, length 0 where no code is."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.lookup: list[np.ndarray] = []

    def add(self, spec: bytes) -> int:
        if spec not in self.number:
            table, code, at = np.zeros(1 << 16, np.uint16), 0, 16
            for length in range(1, 17):
                for _ in range(spec[length - 1]):
                    width = 1 << (16 - length)
                    table[code * width : (code + 1) * width] = length << 8 | spec[at]
                    code, at = code + 1, at + 1
                code <<= 1
            self.number[spec] = len(self.lookup)
            self.lookup.append(table)
        return self.number[spec]


#: A marker that ends a scan: anything but a stuffed byte, a restart, or a fill byte.
SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def parse(media: bytes, tables: Tables) -> list[Image]:
    """The images of one value. Raises ValueError or struct.error or IndexError on what is no baseline JPEG."""
    images: list[Image] = []
    at, quantisers, huffman, interval, frame = 0, {}, {}, 0, None
    while at < len(media):
        if media[at] != 0xFF:
            raise ValueError("no marker")
        marker = media[at + 1]
        if marker in (0xD8, 0xD9, 0xFF):
            at += 1 if marker == 0xFF else 2
            if marker == 0xD8:
                quantisers, huffman, interval, frame = {}, {}, 0, None
            continue
        (length,) = struct.unpack_from(">H", media, at + 2)
        body, at = media[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                end = 17 + sum(body[1:17])
                huffman[body[0]] = tables.add(bytes(body[1:end]))
                body = body[end:]
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("not of 8 bits")
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            frame = Image(width, height, quantisers[parts[0][3]], parts[0][1], parts[0][2])
            images.append(frame)
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not baseline")
        elif marker == 0xDA:
            found = SCAN_END.search(media, at)
            end = found.start() if found else len(media)
            picked = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            if frame is None:
                raise ValueError("a scan without a frame")
            if parts[0][0] in picked:
                most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
                inside = [(i, p) for i, p in enumerate(parts) if p[0] in picked]
                frame.single = len(inside) == 1
                if frame.single:
                    frame.across = -(-(-(-frame.width * frame.h // most_h)) // 8)
                    mcus = frame.across * -(-(-(-frame.height * frame.v // most_v)) // 8)
                else:
                    frame.across = -(-frame.width // (8 * most_h))
                    mcus = frame.across * -(-frame.height // (8 * most_v))
                blocks = [(i, huffman[picked[p[0]] >> 4], huffman[16 | picked[p[0]] & 15]) for i, p in inside for _ in range(1 if frame.single else p[1] * p[2])]
                frame.scan = Scan(media[at:end], blocks, mcus, interval or mcus)
            at = end
    if not images or any(i.scan is None or not i.scan.mcus for i in images):
        raise ValueError("no image")
    return images


def decode_scans(scans: list[Scan], tables: Tables) -> list[np.ndarray | None]:
    """The luminance DC coefficients of each scan in coded order; None where a code is wrong or bytes are missing."""
    raw = np.frombuffer(b"".join(s.data for s in scans), np.uint8)
    ends = bounds(np.array([len(s.data) for s in scans]))
    after = np.append(raw[1:], 0)
    mark = (raw == 0xFF) & (after >= 0xD0) & (after <= 0xD7)
    drop = mark | np.concatenate([[False], (mark | ((raw == 0xFF) & (after == 0)))[:-1]]) if len(raw) else mark
    place = bounds(~drop)
    clean = np.concatenate([raw[~drop], np.zeros(8, np.uint8)])
    marks = np.flatnonzero(mark)
    wanted = np.array([-(-s.mcus // s.interval) for s in scans])
    have = np.searchsorted(marks, ends[1:]) - np.searchsorted(marks, ends[:-1]) + 1
    # a block has a bit of each table at least, so what names more blocks than its bytes can hold is cut off
    good = (have >= wanted) & (8 * np.diff(ends) >= np.array([2 * s.mcus * len(s.blocks) for s in scans]))
    starts, blocks, of = [], [], []
    for k, s in enumerate(scans):
        if good[k]:
            own = marks[np.searchsorted(marks, ends[k]) :][: wanted[k] - 1] + 2
            starts.append(place[np.concatenate([[ends[k]], own])])
            blocks.append(np.minimum(s.interval, s.mcus - s.interval * np.arange(wanted[k])))
            of.append(np.full(wanted[k], k))
    if not starts:
        return [None] * len(scans)
    bit, mcus, of = np.concatenate(starts) * 8, np.concatenate(blocks), np.concatenate(of)
    limit = place[ends[1:]][of] * 8
    shapes = {}
    for k in np.unique(of).tolist():
        shapes.setdefault(tuple(scans[k].blocks), len(shapes))
    shape = np.array([shapes.get(tuple(s.blocks), 0) for s in scans])[of]
    lookup = np.stack(tables.lookup)
    per_mcu = np.array([sum(b[0] == 0 for b in s) for s in shapes])[shape]
    out_start = bounds(mcus * per_mcu)
    out, bad = np.zeros(out_start[-1], np.int32), np.zeros(len(scans), bool)

    def peek(at: np.ndarray) -> np.ndarray:
        byte = at >> 3
        three = clean[byte].astype(np.int32) << 16 | clean[byte + 1].astype(np.int32) << 8 | clean[byte + 2]
        return three >> (8 - (at & 7)) & 0xFFFF

    for own, number in shapes.items():
        rows = np.flatnonzero(shape == number)
        rows = rows[np.argsort(-mcus[rows], kind="stable")]  # the active ones are always a front part
        at, to, size, cap = bit[rows], out_start[rows], mcus[rows], limit[rows]
        prediction = {c: np.zeros(len(rows), np.int32) for c, _, _ in own}
        for m in range(int(size[0])):
            n = int(np.searchsorted(-size, -m, side="left"))
            for c, dc, ac in own:
                p = at[:n]
                code = lookup[dc][peek(p)]
                p += code >> 8
                category = (code & 15).astype(np.int32)
                extra = peek(p) >> (16 - category)
                p += category
                prediction[c][:n] += extra - np.where((category > 0) & (extra >> np.maximum(category - 1, 0) == 0), (1 << category) - 1, 0)
                wrong = code == 0
                if c == 0:
                    out[to[:n]] = prediction[0][:n]
                    to[:n] += 1
                k, open_ = np.ones(n, np.int32), np.arange(n)
                while len(open_):
                    q = p[open_]
                    code = lookup[ac][peek(q)]
                    p[open_] = q + (code >> 8) + (code & 15)
                    symbol = code & 0xFF
                    wrong[open_] |= code == 0
                    k[open_] += (symbol >> 4).astype(np.int32) + 1
                    beyond = p[open_] > cap[open_]  # the image is cut off: zeros behind it may be codes, but not its own
                    wrong[open_] |= beyond
                    p[open_] = np.minimum(p[open_], cap[open_])
                    open_ = open_[(symbol != 0) & (code != 0) & (k[open_] < 64) & ~beyond]
                wrong |= p > cap[:n]
                if wrong.any():
                    bad[of[rows[:n][wrong]]] = True
                    p[:] = np.minimum(p, cap[:n])
    result, sizes = [], np.bincount(of, mcus * per_mcu, len(scans)).astype(np.int64)
    for k, a in enumerate(bounds(sizes)[:-1]):
        result.append(out[a : a + sizes[k]] if good[k] and not bad[k] else None)
    return result


def read_media(media: list[bytes | None]) -> list[list[Image] | None]:
    """The images of each value with their thumbnails; None for what can't be read."""
    tables, parsed = Tables(), []
    for value in media:
        try:
            parsed.append(parse(value or b"", tables))
        except (ValueError, IndexError, KeyError, struct.error):
            parsed.append(None)
    images = [i for own in parsed if own for i in own]
    if images:
        for image, dc in zip(images, decode_scans([i.scan for i in images], tables), strict=True):
            if dc is not None:
                grey = np.clip(np.rint(dc * image.quantiser / 8 + 128), 0, 255).astype(np.uint8)
                h, v = (1, 1) if image.single else (image.h, image.v)
                image.thumbnail = grey.reshape(-1, image.across, v, h).transpose(0, 2, 1, 3).reshape(-1, image.across * h)
    return [None if own is None or any(i.thumbnail is None for i in own) else own for own in parsed]


def thumbnail_hash(thumbnail: np.ndarray) -> str:
    """64 bits: of a grid of 8 x 9 mean values, whether each is less than its right neighbour."""
    h, w = thumbnail.shape
    rows, columns = np.arange(8) * h // 8, np.arange(9) * w // 9
    sums = np.add.reduceat(np.add.reduceat(thumbnail, rows, axis=0, dtype=np.int64), columns, axis=1)
    area = np.maximum(np.diff(rows, append=h), 1)[:, None] * np.maximum(np.diff(columns, append=w), 1)
    mean = sums / area
    return np.packbits(mean[:, :-1] < mean[:, 1:]).tobytes().hex()


def feature(images: list[Image]) -> str:
    return " ".join(f"{i.width}x{i.height}:{thumbnail_hash(i.thumbnail)}" for i in images)


def thumbnails(table: DataFrame, media: str, key: str) -> DataFrame:
    """Per row: key, images (width, height, thumbnail_width, thumbnail bytes, hash of each), null if it can't be read."""
    kind = table.schema[key].dataType.simpleString()
    shape = "array<struct<width int, height int, thumbnail_width int, thumbnail binary, hash string>>".replace(" int", ":int").replace(" binary", ":binary").replace(" string", ":string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "m"):
            found = [own and [{"width": i.width, "height": i.height, "thumbnail_width": i.thumbnail.shape[1], "thumbnail": i.thumbnail.tobytes(), "hash": thumbnail_hash(i.thumbnail)} for i in own] for own in read_media(batch.column("m").to_pylist())]
            kinds = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("thumbnail_width", pa.int32()), ("thumbnail", pa.binary()), ("hash", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(found, kinds)], ["k", "images"])

    return bounded_batches(table).select(F.col(key).alias("k"), F.col(media).alias("m")).mapInArrow(read, f"k {kind}, images {shape}").withColumnRenamed("k", key)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return bounded_batches(docs).select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and media: each text's bytes, padded, as JPEG."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", STORE_BYTES):
            texts = batch.column("t").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(map(len, texts), pa.int64()), pa.array(to_media(texts), pa.binary())], ["k", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return _texts(docs, key, text).mapInArrow(store, f"k {kind}, n_bytes long, media binary").withColumnRenamed("k", key)


def media_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores store_texts() in the shared folder and reads it back by its thumbnails: digests of both, and the images' feature."""
    names = ["k", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", STORE_BYTES):
            media, rows = batch.column("media").to_pylist(), []
            for m, images in zip(media, read_media(media), strict=True):
                payload = b"".join(i.thumbnail.tobytes() for i in images)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(images)))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("n_bytes"), *map(pa.array, zip(*rows, strict=True))], names)

    kind = docs.schema[key].dataType.simpleString()
    shape = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    stored = written(store_texts(docs, key, text).withColumnRenamed(key, "k"), "media")
    return bounded_batches(stored).select("k", "n_bytes", "media").mapInArrow(digest, f"k {kind}, {shape}").withColumnRenamed("k", key)
