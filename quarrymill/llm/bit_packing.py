"""Token ids as fixed-width bit-packed files.

A file is: the magic bytes, a header of six unsigned 64-bit numbers (bits per id, vocabulary size, documents, ids, ids
per block, blocks), the documents' keys and lengths, the byte offset of each block and of the end, then the blocks. An
id takes the fewest bits that hold the vocabulary. Blocks begin at whole bytes, so any block, and any document by way of
its blocks, can be read alone.

Defined cases: a null text counts as empty, and an empty text has only the end id; repeated keys keep one entry each, in
any order among themselves; null keys come first and read back as null; an empty table writes no file and reads back as
no rows.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.shared import SLICE_BYTES, TASK_BYTES, bounded_batches, bounds, parts_for, ranges, slices, text_bytes
from quarrymill.llm.word_codes import flat_ids, words_of
from quarrymill.operators.tables import new_folder

MAGIC = b"TIDPACK1"
BLOCK_IDS = 4096
#: Stands for a null key in a file.
NO_KEY = -(2**63)
#: A file is read as one value, so it ends with the batch of documents that brings it to this many ids.
FILE_IDS = 2 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in bits bits each, lowest bit first."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return octets[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(octets, axis=1, count=bits, bitorder="little"), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, count: int, bits: int) -> np.ndarray:
    octets, out = np.frombuffer(data, np.uint8), np.zeros((count, 4), np.uint8)
    if bits % 8 == 0:
        out[:, : bits // 8] = octets[: count * bits // 8].reshape(count, -1)
    else:
        packed = np.packbits(np.unpackbits(octets, count=count * bits, bitorder="little").reshape(count, bits), axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
    return out.view("<u4").ravel()


def file_bytes(keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    bits = bits_for(vocabulary)
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError(f"id {ids.max()} is outside a vocabulary of {vocabulary}")
    blocks = [pack(ids[i : i + BLOCK_IDS], bits) for i in range(0, len(ids), BLOCK_IDS)]
    header = struct.pack("<6Q", bits, vocabulary, len(keys), len(ids), BLOCK_IDS, len(blocks))
    first = len(MAGIC) + len(header) + 16 * len(keys) + 8 * (len(blocks) + 1)
    offsets = first + bounds(np.array([len(b) for b in blocks], np.int64))
    return b"".join([MAGIC, header, keys.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), *blocks])


class PackedFile:
    """Random access to one file's bytes."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of packed ids")
        self.data, at = memoryview(data), len(MAGIC) + 48
        self.bits, self.vocabulary, n, self.count, self.block, blocks = struct.unpack_from("<6Q", data, len(MAGIC))
        numbers = np.frombuffer(data, "<i8", 2 * n + blocks + 1, at)
        self.keys, self.lengths, self.offsets = numbers[:n], numbers[n : 2 * n], numbers[2 * n :]
        self.starts = bounds(self.lengths)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start up to stop, from the blocks that hold them."""
        a, b = start // self.block, -(-stop // self.block)
        parts = [unpack(self.data[self.offsets[k] : self.offsets[k + 1]], min(self.block, self.count - k * self.block), self.bits) for k in range(a, b)]
        return np.concatenate([np.zeros(0, "<u4"), *parts])[start - a * self.block : stop - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(self.starts[k], self.starts[k + 1])


class WordLevel:
    """Ids of texts under a lower-casing BPE that marks word ends and drops white space.

    The vocabulary's own pattern cuts a word of common letters into parts, each of which is merged alone; distinct
    parts are encoded together as one text, by the library's merges without its normalisation and pattern, and the ids
    that end a word show where each part's ids end. Other words are parts of their own, and encoded one by one.
    """

    #: Fixed with the vocabulary.
    PARTS = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
    #: Characters that normalisation leaves alone and that have one lower-case character each, also a common one.
    COMMON = r"^[\x21-\x7e\x{a1}-\x{12f}\x{131}-\x{17f}]*$"
    #: Of each character up to the last common one: 0 for a letter, 1 for a number, else -1.
    KINDS = np.array(["LN".find(unicodedata.category(chr(c))[0]) for c in range(0x180)], np.int8)
    #: Parts that are encoded as one text, and parts whose ids are kept from slice to slice.
    TOGETHER, KEPT = 4096, 400_000

    def __init__(self, file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(file)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.ends = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def common(self, words: pa.Array) -> pa.Array:
        known = pc.ascii_is_printable(words)
        known = pc.replace_with_mask(known, pc.invert(known), pc.match_substring_regex(words.filter(pc.invert(known)), self.COMMON))
        for token in self.special:
            known = pc.and_not(known, pc.match_substring(words, token))
        return known

    def cut(self, words: pa.Array) -> pa.Array:
        """Lower-case words of common characters, with a space between their parts: where kinds change, and at each number."""
        mark = pc.match_substring(words, "'")  # may begin a part that goes on with a letter
        plain = words.filter(pc.invert(mark))
        _, offsets, held = plain.buffers()
        starts = np.frombuffer(offsets, np.int32)[plain.offset : plain.offset + len(plain) + 1] if len(plain) else np.zeros(1, np.int32)
        data = np.frombuffer(held, np.uint8)[starts[0] : starts[-1]] if held else np.zeros(0, np.uint8)
        starts = starts - starts[0]
        at = np.flatnonzero((data & 0xC0) != 0x80)  # characters begin there, with one byte or two
        lead = data[at].astype(np.int32)
        second = data[np.minimum(at + 1, len(data) - 1)]
        kind = self.KINDS[np.where(lead < 0x80, lead, (lead & 0x1F) << 6 | (second & 0x3F))]
        parted = np.append(False, (kind[1:] != kind[:-1]) | (kind[1:] == 1))[: len(at)]
        parted[np.searchsorted(at, starts[:-1][np.diff(starts) > 0])] = False
        spaces = at[parted]
        ends = (starts + np.searchsorted(spaces, starts)).astype(np.int32)
        done = pa.StringArray.from_buffers(len(plain), pa.py_buffer(ends), pa.py_buffer(np.insert(data, spaces, 32)))
        by_pattern = pc.utf8_rtrim(pc.replace_substring_regex(words.filter(mark), self.PARTS, r"\1 "), " ")
        return pc.replace_with_mask(pc.replace_with_mask(words, pc.invert(mark), done), mark, by_pattern)

    def one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat_ids([x.ids for i in range(0, len(words), 8192) for x in self.tokenizer.encode_batch_fast(words[i : i + 8192], add_special_tokens=False)])

    def together(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        one = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts), " ")[0].as_py()
        ids = np.array(self.merges.encode_batch_fast([one], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends_word[ids])
        return (ids, np.diff(ends, prepend=-1)) if len(ends) == len(parts) else self.one_by_one(parts.to_pylist())

    def of_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts, one part after the other, and how many each part has."""
        plain = pc.ascii_is_alpha(parts)
        other = parts.filter(pc.invert(plain))
        plain = pc.replace_with_mask(plain, pc.invert(plain), pc.and_(self.common(other), pc.greater(pc.binary_length(other), 0)))
        own = parts.filter(plain)
        coded = [self.together(own[i : i + self.TOGETHER]) for i in range(0, len(own), self.TOGETHER)]
        coded.append(self.one_by_one(parts.filter(pc.invert(plain)).to_pylist()))
        flat, length = (np.concatenate(x) for x in zip(*coded, strict=True))
        mask = plain.to_numpy(zero_copy_only=False)
        place = np.empty(len(parts), np.int64)
        place[mask], place[~mask] = np.arange(len(own)), np.arange(len(own), len(parts))
        return flat[ranges((np.cumsum(length) - length)[place], length[place])], length[place]

    def places(self, parts: pa.Array) -> np.ndarray:
        """Where the ids of distinct parts are kept; those that are new to the task are encoded."""
        if len(self.known) > self.KEPT:
            self.forget()
        found = pc.index_in(parts, value_set=self.known)
        new = parts.filter(pc.is_null(found))
        flat, length = self.of_parts(new)
        place = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = np.arange(len(self.known), len(self.known) + len(new))
        self.known = pa.concat_arrays([self.known, new])
        self.ids, self.ends = np.concatenate([self.ids, flat]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(length)])
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and where each text's ids begin (one more than texts)."""
        words, numbers, starts = words_of(pc.replace_substring(texts, "\n", " "))
        words = words.cast(pa.string())  # a slice is far below 2 GB
        other = pc.invert(pc.ascii_is_alpha(words))  # the rest is one part in any case
        mixed = words.filter(other)
        common = self.common(mixed)
        mixed = pc.replace_with_mask(mixed, common, self.cut(pc.utf8_lower(mixed.filter(common))))
        parts, part, at = words_of(pc.replace_with_mask(pc.ascii_lower(words), other, mixed))
        place = self.places(parts.cast(pa.string()))
        first, length = self.ends[place], self.ends[place + 1] - self.ends[place]
        counts = length[part]
        ids, ends = self.ids[ranges(first[part], counts)], bounds(counts)[at]
        length = np.diff(ends)[numbers]
        return ids[ranges(ends[:-1][numbers], length)], bounds(length)[starts]


def save(folder: str, name: str, data: bytes) -> None:
    """Under its name at once: a repeated task writes the same file again."""
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    system, root = pyarrow.fs.FileSystem.from_uri(uri)
    system.create_dir(root)
    part = f"{root}/_{name}.{TaskContext.get().taskAttemptId()}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, f"{root}/{name}")


def write_packed(docs: DataFrame, folder: str, tokenizer_file: str, vocabulary: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files in ascending key order; gives one row per file: file, n_docs, n_ids.

    The tokenizer must drop white space between words, so that a text's ids are those of its words.
    """
    clean = bounded_batches(docs).select(F.col(key).cast("long").alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    dealt = clean.repartitionByRange(parts_for(text_bytes(docs, text), 2 * TASK_BYTES), "k").sortWithinPartitions("k", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordLevel(tokenizer_file), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        made: list[tuple[str, int, int]] = []

        def flush() -> None:
            keys, lengths, ids = map(np.concatenate, zip(*held, strict=True))
            name = f"ids-{part:08d}-{len(made):06d}.bin"
            save(folder, name, file_bytes(keys, lengths, ids, vocabulary))
            made.append((name, len(keys), len(ids)))
            held.clear()

        for batch in slices(batches, "t", 2 * SLICE_BYTES):
            ids, at = encoder.encode(batch.column("t"))
            held.append((pc.fill_null(batch.column("k"), NO_KEY).to_numpy(), np.diff(at) + 1, np.insert(ids, at[1:], end_id)))
            if sum(len(x[2]) for x in held) >= FILE_IDS:
                flush()
        if held:
            flush()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], ["file", "n_docs", "n_ids"])

    made = dealt.mapInArrow(write, "file string, n_docs long, n_ids long")
    made.write.parquet(manifest := f"{folder}-manifest")
    return docs.sparkSession.read.schema(made.schema).parquet(manifest)


#: Tasks whose files are summed up together; the spans themselves, a few thousand at most, are summed up in one task.
SPAN = 4096


def read_packed(folder: str, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: key, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = PackedFile(content.as_py())
                ids = np.ascontiguousarray(file.ids(0, file.count))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(file.starts, file.starts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(crc), pa.string()), pa.array(file.keys), pa.array(file.starts[:-1]), pa.array(file.lengths), pa.array(crc, pa.int64())], ["file", "k", "at", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.bin").load(folder)
    docs = files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), "content").mapInArrow(read, "file string, k long, at long, n_tokens long, ids_crc32 long")
    # ids before a file: those of earlier spans of tasks, then those of earlier files of its own span
    spans = manifest.withColumn("span", F.floor(F.substring("file", 5, 8).cast("long") / SPAN))
    earlier = spans.groupBy("span").agg(F.sum("n_ids").alias("n")).select("span", (F.sum("n").over(Window.orderBy("span")) - F.col("n")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("span").orderBy("file")) - F.col("n_ids")
    begins = spans.select("span", "file", within.alias("within")).join(earlier, "span").select("file", (F.col("before") + F.col("within")).alias("begin"))
    return docs.join(begins, "file").select(F.nullif("k", F.lit(NO_KEY)).alias(key), (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def packed_ids(docs: DataFrame, tokenizer_file: str, vocabulary: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs to a new shared folder and reads the files back."""
    spark = docs.sparkSession
    folder = new_folder(spark, "ids")
    manifest = write_packed(docs, folder, tokenizer_file, vocabulary, end_id, key, text)
    if manifest.isEmpty():
        return spark.createDataFrame([], f"{key} long, start long, n_tokens long, ids_crc32 long")
    return read_packed(folder, manifest, key)
