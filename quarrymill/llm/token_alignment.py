"""Alignment of two tokenizers' tokens: groups by pointer jumping, links of overlapping tokens, counts of linked id pairs.

Both tokenizers cut the same bytes. Every token points to its farthest-right overlapping token of the other side (of
equal ends, side B to side A, and side A to itself); doubling the successors of all tokens of a slice of texts at once
converges to the terminal token of each component, which labels the group. Two tokens overlap exactly where, between
neighbouring ends of either side, both have a byte, so the links of a text are its stretches between ends.

Some slices of texts are a block, written with its links and its distinct id pairs. Pairs are summed over blocks, the
highest count of each id of B is found (one row per id of the vocabulary), the counts go back to the blocks that have
the pair, and each block, bounded by its texts, gives its documents their sums. No link leaves its block.

Defined cases: a null or empty text, and one whose joined token bytes differ from a space and the text (as where the
text has U+2581, which side B reads as a space), has no tokens: zeros and an empty groups_sha256; repeated rows have
a row each, and their links count as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.bm25_packing import ByteLevel
from quarrymill.llm.piece_merge import LINE, SPACE, Pieces, chunks_of
from quarrymill.llm.shared import SLICE_BYTES, bounded_batches, bounds, hand_back, ranges, slices
from quarrymill.llm.word_codes import WordCodes, flat_ids
from quarrymill.operators.tables import written

#: Bits that hold an id of side B in a pair.
PAIR_BITS = 32
#: Bytes of text that a block is closed at.
BLOCK_BYTES = 2 * SLICE_BYTES


class Coder:
    """Ids of both sides for a slice of texts, with how many each text has, and the bytes of every id."""

    def __init__(self, byte_file: str, rank_file: str | None, piece_file: str):
        self.a, self.pieces = ByteLevel(byte_file, 0, rank_file), Pieces(piece_file)
        self.a.tokenizer.encode_special_tokens = True
        self.b = WordCodes(self.library_ids, 200_000)
        lib = self.pieces.library
        names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.of_b = [bytes([int(n[3:5], 16)]) if lib.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.a_bytes = self._byte_values(byte_file)
        self.a_length, self.b_length = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.of_b))
        self.a_flat, self.b_flat = (np.frombuffer(b"".join(own), np.uint8) for own in (self.a_bytes, self.of_b))
        self.a_at, self.b_at = bounds(self.a_length), bounds(self.b_length)

        self.most = max(len(self.a_bytes), len(self.of_b))

    def library_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of chunks that no piece crosses. It puts a space before what it gets, so chunks go without theirs."""
        lib = self.pieces.library
        coded = lib.encode([c.removeprefix(SPACE) for c in chunks], num_threads=1)
        return flat_ids([x[1:] if c[:1] == LINE else x or [lib.piece_to_id(SPACE)] for c, x in zip(chunks, coded, strict=True)])

    @staticmethod
    def _byte_values(file: str) -> list[bytes]:
        from tokenizers import Tokenizer

        value = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = Tokenizer.from_file(file).get_vocab(with_added_tokens=False)
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            if all(c in value for c in token):
                out[k] = bytes(value[c] for c in token)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts.cast(pa.string()), "")
        ids, counts, *_ = self.a.encode(spaced)
        last = np.cumsum(counts) - 1
        other, at = self.b.ids_of(*chunks_of(texts))
        return np.delete(ids, last).astype(np.int64), counts - 1, other.astype(np.int64), np.diff(at)

    def bytes_of(self, side: str, ids: np.ndarray) -> np.ndarray:
        flat, at, length = (self.a_flat, self.a_at, self.a_length) if side == "a" else (self.b_flat, self.b_at, self.b_length)
        return flat[ranges(at[ids], length[ids])]


@lru_cache(1)
def byte_characters() -> str:
    """The character that stands for each byte in byte-level vocabularies: itself if it is visible, else the next unused from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in set(visible)]
    place = {b: b for b in visible} | {b: 256 + k for k, b in enumerate(other)}
    return "".join(chr(place[b]) for b in range(256))


@dataclass
class Ends:
    """Where tokens of either side end in the bytes of a slice, which both cover: how many end up to each byte."""

    a: np.ndarray
    b: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> Ends:
        size = int(a[-1]) + 1 if len(a) else 1
        at_a, at_b = np.zeros(size, bool), np.zeros(size, bool)
        at_a[a] = at_b[b] = True
        return cls(a, b, at_a, at_b)

    def labels(self) -> tuple[np.ndarray, np.ndarray]:
        """The terminal token (a number of side A) of each token's component."""
        n, m = len(self.a), len(self.b)
        successor = np.arange(n + m)
        if m:
            over = np.cumsum(self.at_b)[self.a - 1]  # the token of B that has the last byte of each of A
            on = self.b[over] > self.a
            successor[:n][on] = n + over[on]
            successor[n:] = np.cumsum(self.at_a)[self.b - 1]
        while True:
            further = successor[successor]
            if np.array_equal(further, successor):
                return successor[:n], successor[n:]
            successor = further

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ends of the stretches that one token of each side covers, and the numbers of both tokens."""
        stop = np.flatnonzero(self.at_a | self.at_b)
        return stop, np.cumsum(self.at_a)[stop - 1], np.cumsum(self.at_b)[stop - 1]


@lru_cache(2)
def decimal_cells(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 0 to n - 1: the decimal digits from the left with one more byte, how many there are, and which bytes are used."""
    text = np.arange(n).astype("S")
    digits = text.view(np.uint8).reshape(n, -1)
    lengths = np.char.str_len(text)
    return np.concatenate([digits, np.zeros((n, 1), np.uint8)], axis=1), lengths, np.arange(digits.shape[1] + 1)[None] <= lengths[:, None]


def group_text(a_ids: np.ndarray, a_label: np.ndarray, b_ids: np.ndarray, b_label: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All groups as bytes, `a1,a2|b1;a3|b2,b3;`, and where each token's part ends, with tokens in the order of the bytes."""
    n, m = len(a_ids), len(b_ids)
    terminal = a_label == np.arange(n)
    a_group = np.cumsum(terminal) - terminal
    b_group = a_group[b_label]
    groups = int(terminal.sum())
    a_size, b_size = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    a_at, b_at = np.arange(n) + (np.cumsum(b_size) - b_size)[a_group], np.arange(m) + np.cumsum(a_size)[b_group]
    ids, mark = np.zeros(n + m, np.int64), np.full(n + m, ord(","), np.uint8)
    ids[a_at], ids[b_at] = a_ids, b_ids
    ends = np.cumsum(a_size + b_size)
    mark[ends - b_size - 1], mark[ends - 1] = ord("|"), ord(";")
    cells, lengths, used = decimal_cells(most)
    length = lengths[ids]
    out = cells[ids]
    out[np.arange(n + m), length] = mark
    return out[used[ids]], np.cumsum(length + 1)


def aligned_slice(coder: Coder, texts: pa.Array) -> dict[str, np.ndarray | list]:
    """For each text its counts and the hash of its groups, and its links: the number of each text's links, each link's id of A and of B."""
    a_ids, a_n, b_ids, b_n = coder.encode(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    bytes_in = lambda length, ids, n: np.diff(bounds(length[ids])[bounds(n)])
    ok = (size > 1) & (bytes_in(coder.a_length, a_ids, a_n) == size) & (bytes_in(coder.b_length, b_ids, b_n) == size)
    if not ok.all():
        a_ids, b_ids = a_ids[np.repeat(ok, a_n)], b_ids[np.repeat(ok, b_n)]
        a_n, b_n, size = a_n * ok, b_n * ok, size * ok
    # the bytes of those with the right length
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, int(ok.sum())], pa.int32()), pc.binary_join_element_wise(pa.scalar(" "), texts.filter(pa.array(ok)).cast(pa.string()), "")), "")
    want = np.frombuffer(joined[0].as_py().encode(), np.uint8)
    ends = bounds(size)
    differs = np.flatnonzero((coder.bytes_of("a", a_ids) != want) | (coder.bytes_of("b", b_ids) != want))
    if len(differs):
        wrong = np.zeros(len(texts), bool)
        wrong[np.searchsorted(ends, differs, side="right") - 1] = True
        a_ids, b_ids = a_ids[~np.repeat(wrong, a_n)], b_ids[~np.repeat(wrong, b_n)]
        a_n, b_n, size = a_n * ~wrong, b_n * ~wrong, size * ~wrong
        ends = bounds(size)
    both = Ends.of(np.cumsum(coder.a_length[a_ids]), np.cumsum(coder.b_length[b_ids]))
    a_label, b_label = both.labels()
    _, first, second = both.links()
    in_texts = lambda at: np.diff(np.cumsum(at)[ends])
    shown, part = group_text(a_ids, a_label, b_ids, b_label, coder.most)
    close, held = np.append(0, part)[bounds(a_n + b_n)], shown.tobytes()
    digest = [hashlib.sha256(held[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(close.tolist(), close[1:].tolist(), strict=False)]
    return {"n_a": a_n, "n_b": b_n, "n_groups": in_texts(both.at_a & both.at_b), "n_links": in_texts(both.at_a | both.at_b), "groups_sha256": digest, "first": a_ids[first], "second": b_ids[second]}


class Block:
    """What is known of one block after some of its slices: rows of documents, and pairs with their links."""

    def __init__(self):
        self.size, self.rows, self.pairs = 0, [], []

    def add(self, part: pa.RecordBatch, coder: Coder) -> None:
        n, made = part.num_rows, aligned_slice(coder, part.column("t"))
        pairs, number = np.unique(made["first"] << PAIR_BITS | made["second"], return_inverse=True)
        place, count = np.unique(np.repeat(np.arange(n), made["n_links"]) * max(len(pairs), 1) + number, return_counts=True)
        columns = [part.column("k"), *(pa.array(made[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(made["groups_sha256"], pa.string())]
        self.rows.append((columns, bounds(np.bincount(place // max(len(pairs), 1), minlength=n)).tolist(), (place % max(len(pairs), 1)).astype(np.int32), count.astype("<u4")))
        self.pairs.append((pairs, np.bincount(number, minlength=len(pairs))))
        self.size += part.column("t").nbytes

    def batches(self, block: int) -> Iterator[pa.RecordBatch]:
        every = np.concatenate([p for p, _ in self.pairs])
        pairs, number = np.unique(every, return_inverse=True)
        times = np.bincount(number, np.concatenate([t for _, t in self.pairs]), len(pairs)).astype("<i8")
        held, start = pairs.astype("<i8").tobytes() + times.tobytes(), 0
        for (columns, ends, place, count), (own, _) in zip(self.rows, self.pairs, strict=True):
            at = number[start : start + len(own)].astype("<u4")[place]
            start += len(own)
            links = [at[a:b].tobytes() + count[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            n = len(links)
            yield pa.RecordBatch.from_arrays([columns[0], pa.array(np.full(n, block)), *columns[1:], pa.array(links, pa.binary()), pa.array([held, *[None] * (n - 1)], pa.binary())], ["k", "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs"])
            held = None


def blocks(docs: DataFrame, key: str, text: str, byte_file: str, rank_file: str | None, piece_file: str) -> DataFrame:
    """A row per document with its counts, its block and place there, and its links as numbers of the block's pairs and
    their times; the block's first row has the pairs and how many links each has."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, block, n = Coder(byte_file, rank_file, piece_file), TaskContext.get().partitionId(), Block(), 0
        for part in slices(batches, "t", SLICE_BYTES // 2):
            block.add(part, coder)
            if block.size >= BLOCK_BYTES:
                yield from block.batches(task << 32 | n)
                block, n = Block(), n + 1
        if block.rows:
            yield from block.batches(task << 32 | n)
        hand_back()

    given = bounded_batches(docs).select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return written(given.mapInArrow(run, f"k {kind}, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs binary"), "alignment")


def pairs_of(table: DataFrame) -> DataFrame:
    """block, number (of the pair there), pair, n (links of the block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held in zip(batch.column("block").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                pairs, n = np.frombuffer(held, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(pairs), pa.array(n)], ["block", "number", "pair", "n"])

    return bounded_batches(table.filter("pairs is not null")).select("block", "pairs").mapInArrow(run, "block long, number int, pair long, n long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, count (its links in all documents), best (whether its id of B has no pair of more)."""
    counts = written(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "pair_counts")
    own = F.col("pair").bitwiseAND(F.lit((1 << PAIR_BITS) - 1))
    highest = counts.groupBy(own.alias("id")).agg(F.max("count").alias("highest"))  # a row per id of side B, tens of thousands
    return counts.join(F.broadcast(highest), own == F.col("id")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(docs: DataFrame, byte_file: str, piece_file: str, rank_file: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    table = blocks(docs, key, text, byte_file, rank_file, piece_file)
    pairs = pairs_of(table)
    told = pairs.join(pair_counts(pairs), "pair").select("block", "number", "count", "best")
    kind = docs.schema[key].dataType.simpleString()
    names = ["k", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def look_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        count, best = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        at = known.column("number").to_numpy()
        count[at], best[at] = known.column("count").to_numpy(), known.column("best").to_numpy(zero_copy_only=False)
        sums = np.zeros((2, len(rows)), np.int64)
        for i, held in enumerate(rows.column("links")):
            own, times = np.frombuffer(held.as_buffer(), "<u4").reshape(2, -1)
            sums[:, i] = times @ best[own], times @ count[own]
        columns = {c: rows.column(c) for c in names if c not in ("n_best", "count_sum")} | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
        return pa.table({c: columns[c] for c in names})

    rows = table.drop("pairs").groupBy("block").cogroup(told.groupBy("block"))
    found = rows.applyInArrow(look_up, f"k {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return found.withColumnRenamed("k", key)
