"""SentencePiece encoding of merge-type vocabularies, by an agenda of adjacent symbol pairs in score order.

A text is cut into chunks, each a run of spaces (as U+2581) or a line end with the word after it; no piece has a space
behind another character, or a line end, so no merge crosses chunks. From a chunk's characters, the adjacent pair whose union has the highest score is
merged, the leftmost among equals, until no union is a piece; what is then no piece becomes byte ids. Each chunk that is
new to a task is encoded once and held against the sentencepiece library, batch by batch.

Defined cases: a null text counts as empty; an empty text has only the begin and end ids; any length of text or chunk
is encoded whole; repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.shared import bounded_batches, bounds, ranges, slices
from quarrymill.llm.word_codes import WordCodes, words_of

SPACE, LINE = "▁", "\n"
#: Chunks of up to so many characters are merged in step with one another, longer ones each by a heap.
STEPPED = 48
NEVER = np.iinfo(np.int32).max


class Pieces:
    """A merge-type vocabulary without a normaliser, with byte pieces for what it lacks."""

    def __init__(self, file: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=file)
        special = (lib.is_control, lib.is_unknown, lib.is_byte, lib.is_unused)
        self.id_of = {lib.id_to_piece(i): i for i in range(lib.get_piece_size()) if not any(f(i) for f in special)}
        self.byte_id = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        if any(SPACE in p.lstrip(SPACE) or LINE in p for p in self.id_of):
            raise ValueError("a piece holds a line end, or a space behind another character: chunks can't be encoded alone")
        scores = np.array([lib.get_score(i) for i in range(lib.get_piece_size())])
        #: Lower goes first; equal scores share a rank.
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted left id << 32 | right id, and the id of the union."""
        found = {}
        for piece, union in self.id_of.items():
            for k in range(1, len(piece)):
                a, b = self.id_of.get(piece[:k]), self.id_of.get(piece[k:])
                if a is not None and b is not None:
                    found[a << 32 | b] = union
        keys = np.array(sorted(found), np.int64)
        return keys, np.array([found[k] for k in keys.tolist()], np.int64)

    def unions(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of the pair's union, or -1."""
        keys, union = self.pairs
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        return np.where((keys[at] == pair) & (left >= 0) & (right >= 0), union[at], -1)

    def symbols(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One symbol per character: a piece's id, or -1 - code point of a character that is none; and each chunk's length."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        seen, at = np.unique(points, return_inverse=True)
        ids = np.array([self.id_of.get(chr(p), -1 - p) for p in seen.tolist()], np.int64)
        return ids[at] if len(points) else points, np.fromiter(map(len, chunks), np.int64, len(chunks))

    def merge_stepped(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each round merges every chunk's best pair; chunks without one are done. Gives symbols and lengths in order."""
        chunk = np.repeat(np.arange(len(lengths)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def ranked(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            union = np.where(same, self.unions(a, b), -1)
            return union, np.where(union >= 0, self.rank[union], NEVER)

        union, rank = ranked(symbols[:-1], symbols[1:], chunk[:-1] == chunk[1:]) if len(symbols) else (symbols, symbols)
        union, rank = np.append(union, -1)[: len(symbols)], np.append(rank, NEVER)[: len(symbols)]
        while len(symbols):
            first = np.flatnonzero(np.diff(chunk, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(first, append=len(symbols))
            if (over := best == NEVER).any():
                gone = np.repeat(over, sizes)
                done.append((chunk[gone], symbols[gone]))
                symbols, chunk, union, rank, best, sizes = symbols[~gone], chunk[~gone], union[~gone], rank[~gone], best[~over], sizes[~over]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            hit = hit[np.diff(chunk[hit], prepend=-1) != 0]  # the leftmost of each chunk
            symbols[hit] = union[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged symbols stand once their right halves are gone
            symbols, chunk, union, rank = symbols[keep], chunk[keep], union[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                right = np.minimum(i + 1, len(symbols) - 1)
                union[i], rank[i] = ranked(symbols[i], symbols[right], (chunk[i] == chunk[right]) & (right > i))
        if not done:
            return symbols, lengths
        chunks, out = map(np.concatenate, zip(*done, strict=True))
        order = np.argsort(chunks, kind="stable")
        return out[order], np.bincount(chunks, minlength=len(lengths))

    @cached_property
    def union_of(self) -> dict[int, int]:
        return dict(zip(*(x.tolist() for x in self.pairs), strict=True))

    def merge_one(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one chunk, by a heap. An entry is a pair's rank and place in one number; it is stale if the pair at
        its place has another rank by now."""
        n, place = len(symbols), (1 << 32) - 1
        own, after, before, alive = array("q", symbols.tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1)), bytearray(b"\1") * n
        union = self.unions(symbols[:-1], symbols[1:])
        at = np.flatnonzero(union >= 0)
        agenda = (self.rank[union[at]].astype(np.int64) << 32 | at).tolist()
        heapq.heapify(agenda)
        union_of, rank = self.union_of, self.rank.tolist()

        def found(i: int) -> int | None:
            j = after[i]
            return union_of.get(own[i] << 32 | own[j]) if j < n and own[i] >= 0 and own[j] >= 0 else None

        while agenda:
            entry = heapq.heappop(agenda)
            i = entry & place
            if not alive[i] or (merged := found(i)) is None or rank[merged] != entry >> 32:
                continue
            j = after[i]
            own[i], alive[j], after[i] = merged, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (u := found(k)) is not None:
                    heapq.heappush(agenda, rank[u] << 32 | k)
        return np.frombuffer(own, np.int64)[np.frombuffer(alive, np.uint8) == 1]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks and the number of each one's, checked against the library."""
        symbols, lengths = self.symbols(chunks)
        long, starts = lengths > STEPPED, bounds(lengths)
        short = np.repeat(~long, lengths)
        flat, counts = self.merge_stepped(symbols[short].copy(), lengths[~long])
        if long.any():
            every = np.zeros(len(chunks), np.int64)
            every[~long] = counts
            merged = {k: self.merge_one(symbols[starts[k] : starts[k + 1]]) for k in np.flatnonzero(long).tolist()}
            for k, m in merged.items():
                every[k] = len(m)
            out = np.zeros(every.sum(), np.int64)
            out[np.repeat(~long, every)] = flat
            ends = np.cumsum(every)
            for k, m in merged.items():
                out[ends[k] - len(m) : ends[k]] = m
            flat, counts = out, every
        flat, counts = self.to_bytes(flat, counts)
        self.check(chunks, flat, counts)
        return flat.astype(np.uint32), counts

    def to_bytes(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not (lost := flat < 0).any():
            return flat, counts
        points, which = np.unique(-1 - flat[lost], return_inverse=True)
        coded = [self.byte_id[list(chr(p).encode("utf-8", "surrogatepass"))] for p in points.tolist()]
        length = np.array([len(c) for c in coded])
        sizes = np.ones(len(flat), np.int64)
        sizes[lost] = length[which]
        out = np.repeat(flat, sizes)
        out[np.repeat(lost, sizes)] = np.concatenate(coded)[ranges(bounds(length)[which], length[which])]
        return out, np.add.reduceat(np.append(sizes, 0), bounds(counts)[:-1]) * (counts > 0)

    def check(self, chunks: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        """The library puts a space before what it gets: it gets chunks without their first, but a lone space can't be so."""
        theirs = self.library.encode([c.removeprefix(SPACE) for c in chunks], num_threads=1)
        theirs = [x[c[:1] == LINE :] for c, x in zip(chunks, theirs, strict=True)]
        sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
        alone = np.fromiter((c == SPACE for c in chunks), bool, len(chunks))
        ours = flat[np.repeat(~alone, counts)]
        if not (np.array_equal(sizes[~alone], counts[~alone]) and np.array_equal(ours, np.fromiter((i for x in theirs for i in x), np.int64, sizes.sum()))):
            raise AssertionError(f"the library encodes differently one of {len(chunks)} chunks, such as {next(c for c, x, k in zip(chunks, theirs, ranges_of(flat, counts), strict=True) if c != SPACE and x != k)!r}")


def ranges_of(flat: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    ends = bounds(counts).tolist()
    values = flat.tolist()
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def chunks_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks, each chunk's number in order, and where each text's chunks begin."""
    spaced = pc.replace_substring(texts, SPACE, " ")
    empty = pc.equal(pc.binary_length(spaced), 0)
    odd = pc.or_(empty, pc.match_substring_regex(spaced, "^ |  | \n| $")).to_numpy(zero_copy_only=False)
    words, numbers, starts = words_of(pc.replace_substring(spaced, LINE, " " + LINE))
    distinct = [w if w[:1] == LINE else SPACE + w for w in words.to_pylist()]
    if not odd.any():
        return distinct, numbers, starts
    at = {c: k for k, c in enumerate(distinct)}
    counts, own = np.diff(starts), {}
    for k in np.flatnonzero(odd).tolist():
        text = spaced[k].as_py().replace(" ", SPACE)
        found = re.findall(f"{SPACE}*[^{SPACE}{LINE}]+|{SPACE}+|{LINE}[^{SPACE}{LINE}]*", SPACE + text) if text else []
        own[k] = np.array([at.setdefault(c, len(at)) for c in found], np.int64)
        counts[k] = len(own[k])
    ends = bounds(counts)
    out = np.zeros(ends[-1], np.int64)
    out[np.repeat(~odd, counts)] = numbers[np.repeat(~odd, np.diff(starts))]
    for k, x in own.items():
        out[ends[k] : ends[k + 1]] = x
    return list(at), out, ends


def encode_texts(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (begin, the text's, end) and the text that the library's decode gives of them."""
    return _coded(docs, model_file, key, text, False)


def encoding_digests(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of the same ids and decoded text, which stay in the task."""
    return _coded(docs, model_file, key, text, True)


def _coded(docs: DataFrame, model_file: str, key: str, text: str, digests: bool) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_file)
        codes, lib = WordCodes(pieces.encode), pieces.library
        for batch in slices(batches, "t"):
            chunks, numbers, starts = chunks_of(batch.column("t"))
            inner, at = codes.ids_of(chunks, numbers, starts)
            counts = np.diff(at)
            ends = bounds(counts + 2)
            ids = np.zeros(ends[-1], "<u4")
            ids[ranges(ends[:-1] + 1, counts)] = inner
            ids[ends[:-1]], ids[ends[1:] - 1] = lib.bos_id(), lib.eos_id()
            decoded = lib.decode(ranges_of(ids, counts + 2), num_threads=1)
            if not digests:
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(decoded, pa.string())], ["k", "ids", "decoded"])
                continue
            own = [hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
            back = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(counts + 2), pa.array(own, pa.string()), pa.array(back, pa.string())], ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    shape = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    rows = bounded_batches(docs).select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    return rows.mapInArrow(encode, f"k {kind}, {shape}").withColumnRenamed("k", key)
