"""Packing by lexical retrieval: windows filled with a seed document and its nearest unused neighbours by BM25.

Documents are dealt by range over shards of bounded size: first by the route columns, then by how their last sentence in
alphabetical order begins, so that near copies meet, then by key, so that a hot group is split. Document frequencies and the mean length are
counted over all documents, by hashed word in DF_BINS bins. Each shard has one inverted index with BM25 weights. A document
that is cut by a window's end, or else the next unused one, is the seed of the next window; all its words are looked up,
and its unused neighbours, best first, fill the window; the last one is cut at the window's end and goes on in the next.
A look-up gives the NEIGHBOURS best documents of the shard exactly; when they are used up, the seed is looked up again
among the unused ones. Only the last sequence of a shard is shorter than the window and padded.

Defined cases: a null text counts as empty, and an empty text has only the end id; a document without neighbours is
followed by the next unused one in key order; repeated rows are packed as often as they come; an empty table gives no
rows; a null key is kept as null.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.shared import SLICE_BYTES, TASK_BYTES, bounded_batches, bounds, parts_for, ranges, slices
from quarrymill.llm.word_codes import flat_ids

WINDOW = 2048
#: BM25's constants, and the neighbours that one look-up gives; more follow on demand.
K1, B, NEIGHBOURS = 1.2, 0.75, 64
DF_BINS = 1 << 20
#: Letters of the alphabetically last sentence that decide where a document goes.
SKETCH = 12
#: A word that more than one in FREQUENT documents of a shard has is a row of its matrix.
FREQUENT = 8
#: Bytes of text and documents in a shard, and a bound of memory: a range that can't be split further has several indexes
#: beyond it.
SHARD_BYTES, SHARD_DOCUMENTS, INDEX_BYTES = TASK_BYTES, 6000, 4 * TASK_BYTES
#: Texts in which words aren't parted by single spaces or line ends: they are encoded whole.
ODD = r"[ \n][ \n]|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


#: How this kind of vocabulary parts a text before any merge (fixed with the vocabulary); white space comes one by one here.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""


def marked_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words with the space or line end before them, the number of each word in order, and where each text's begin.

    A text's first word has nothing before it, and may be empty. The words lie end to end in the texts' own bytes.
    """
    texts = texts.cast(pa.string())  # a slice is far below 2 GB
    _, offsets, held = texts.buffers()
    starts = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(held, np.uint8)[starts[0] : starts[-1]] if held else np.zeros(0, np.uint8)
    at = (np.flatnonzero((data == 32) | (data == 10)) + starts[0]).astype(np.int32)
    before = np.searchsorted(at, starts)
    ends = np.append(np.insert(at, before[:-1], starts[:-1]), starts[-1])
    coded = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), held).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), before + np.arange(len(starts))


def word_counts(words: pa.Array, numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and times of each text's distinct words, in lower case and without marks at the ends."""
    plain = pc.utf8_trim(pc.utf8_lower(words), " \n.,;:!?")
    hashed = pd.util.hash_array(plain.to_numpy(zero_copy_only=False), categorize=False)
    same, value = pd.factorize(hashed)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    pair, times = np.unique(text * len(value) + same[numbers], return_counts=True)
    return pair // len(value), value[pair % len(value)], times


@dataclass
class Statistics:
    """Of all documents: their number and bytes, words in a mean one, and how many have a word of each bin."""

    n: int
    size: int
    mean: float
    df: np.ndarray

    def idf(self, word: np.ndarray) -> np.ndarray:
        df = np.minimum(self.df[(word >> np.uint64(44)).astype(np.int64)], self.n)
        return np.log1p((self.n - df + 0.5) / (df + 0.5))


def statistics(docs: DataFrame, text: str) -> Statistics:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, length, size = np.zeros(DF_BINS, np.int64), 0, 0, 0
        for part in slices(batches, "t", 2 * SLICE_BYTES):
            words, numbers, starts = marked_words(part.column("t"))
            _, word, times = word_counts(words, numbers, starts)
            total += np.bincount((word >> np.uint64(44)).astype(np.int64), minlength=DF_BINS)
            n, length, size = n + part.num_rows, length + int(times.sum()), size + (pc.sum(pc.binary_length(part.column("t"))).as_py() or 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2, -3])), pa.array(np.append(total[at], [n, length, size]))], ["bin", "n"])

    given = bounded_batches(docs).select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    got = given.mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # DF_BINS rows
    at, found = got["bin"].to_numpy(), got["n"].to_numpy()
    n, length, size = (int(found[at == x].sum()) for x in (-1, -2, -3))
    df = np.zeros(DF_BINS, np.float32)
    df[at[at >= 0]] = found[at >= 0]
    return Statistics(n, size, max(length / max(n, 1), 1.0), df)


class ByteLevel:
    """Ids of a byte-level BPE whose words begin with the white space before them.

    With a rank file of the same vocabulary, distinct words of common letters are encoded together, as one text.
    """

    def __init__(self, file: str, end_id: int, rank_file: str | None = None, special: str | None = None):
        self.file, self.end_id, self.ranks = file, end_id, None
        self.plain = "^[\\x00-\\x{24f}]*$", self.special() if special is None else special
        if rank_file:
            import tiktoken

            with open(rank_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.size = np.zeros(max(ranks.values()) + 1, np.int64)
            self.size[list(ranks.values())] = [len(r) for r in ranks]

    @cached_property
    def tokenizer(self):
        """The library's; it is loaded when there is a text or word for it."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.file)

    def special(self) -> str:
        """A pattern of the vocabulary's special tokens."""
        return "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())

    def of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat_ids([x.ids for i in range(0, len(texts), 8192) for x in self.tokenizer.encode_batch_fast(texts[i : i + 8192], add_special_tokens=False)])

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number, of words as marked_words() gives them."""
        if self.ranks is None:
            return self.of_texts(words.to_pylist())
        common, special = self.plain
        joined = pc.match_substring_regex(words, common)
        joined = pc.and_(joined, pc.invert(pc.match_substring_regex(words, special))) if special else joined
        fast, rest = words.filter(joined), words.filter(pc.invert(joined))
        bare = pc.invert(pc.match_substring_regex(fast, "^[ \\n]"))  # first words: with a line end before them, an id of its own
        fast, bare = pc.if_else(bare, pc.binary_join_element_wise("\n", fast, ""), fast), bare.to_numpy(zero_copy_only=False)
        one = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(fast)], pa.int32()), fast), "")[0].as_py()
        some = np.array(self.ranks.encode_ordinary(one), np.int64)  # encode_to_numpy looks for special tokens at every place
        ends = np.searchsorted(np.cumsum(self.size[some]), np.cumsum(pc.binary_length(fast).to_numpy(zero_copy_only=False)), side="right")
        some, own = np.delete(some, (ends - np.diff(ends, prepend=0))[bare]), np.diff(ends, prepend=0) - bare
        other, sizes = self.of_texts(rest.to_pylist())
        mask = joined.to_numpy(zero_copy_only=False)
        counts = np.zeros(len(mask), np.int64)
        counts[mask], counts[~mask] = own, sizes
        out = np.zeros(counts.sum(), np.uint32)
        out[np.repeat(mask, counts)], out[np.repeat(~mask, counts)] = some, other
        return out, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Ids with the end id, each text's number of ids; the distinct words, words in order, each text's begin."""
        words, numbers, starts = marked_words(texts)
        of_word, length = self.of_words(words)
        own = length[numbers]
        ids, at = of_word[ranges((np.cumsum(length) - length)[numbers], own)], bounds(own)[starts]
        counts = np.diff(at)
        odd = np.flatnonzero(pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False))
        if len(odd):
            whole, sizes = self.of_texts(texts.take(odd).to_pylist())
            regular = np.ones(len(counts), bool)
            regular[odd] = False
            old, counts = counts, counts.copy()
            counts[odd] = sizes
            out = np.zeros(counts.sum(), np.uint32)
            out[np.repeat(regular, counts)] = ids[np.repeat(regular, old)]
            out[np.repeat(~regular, counts)] = whole
            ids = out
        return np.insert(ids, np.cumsum(counts), self.end_id), counts + 1, words, numbers, starts


@dataclass
class Shard:
    """Documents of one index: keys, ids, and (document, word's hash, times)."""

    keys: list[pa.Array] = field(default_factory=list)
    ids: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    words: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    n: int = 0
    bytes: int = 0

    def add(self, keys: pa.Array, texts: pa.Array, encoder: ByteLevel) -> None:
        ids, counts, words, numbers, starts = encoder.encode(texts)
        text, word, times = word_counts(words, numbers, starts)
        self.words.append(((self.n + text).astype(np.int32), word, times.astype(np.float32)))
        self.keys.append(keys)
        self.ids.append(ids.astype(np.uint32))
        self.counts.append(counts)
        self.n += len(counts)
        self.bytes += texts.nbytes


class Index:
    """Postings by word with BM25 weights; the words that many documents have are rows of a matrix instead.

    A document's score for a seed is the sum of its weights over the seed's distinct words.
    """

    def __init__(self, shard: Shard, known: Statistics):
        document, word, times = map(np.concatenate, zip(*shard.words, strict=True))
        length = np.bincount(document, times, shard.n)
        word, distinct = pd.factorize(word)
        df = np.bincount(word, minlength=len(distinct))
        norm = (K1 * (1 - B + B * length / known.mean)).astype(np.float32)
        weight = (known.idf(distinct)[word] * (times * (K1 + 1) / (times + norm[document]))).astype(np.float32)
        common = FREQUENT * df > shard.n
        row = (np.cumsum(common) - 1)[word]
        at = np.flatnonzero(common[word])
        self.live, self.matrix = np.arange(shard.n), np.zeros((int(common.sum()), shard.n), np.float32)
        self.matrix[row[at], document[at]] = weight[at]
        self.rows, self.row_starts = row[at], bounds(np.bincount(document[at], minlength=shard.n))
        at = np.flatnonzero(~common[word] & (df[word] > 1))  # a word that no other document of the shard has finds nothing
        document, word, weight = document[at], word[at], weight[at]
        self.words, self.word_starts = word, bounds(np.bincount(document, minlength=shard.n))
        order = np.argsort(word, kind="stable")
        self.posted, self.documents, self.weights = word[order], document[order].astype(np.int64), weight[order].astype(np.float64)
        self.starts = bounds(np.bincount(word, minlength=len(distinct)))

    def forget(self, used: np.ndarray) -> None:
        """Takes the used documents out, as no look-up gives them any more."""
        keep = ~used[self.live]
        place = np.cumsum(keep) - 1
        left = keep[self.documents]
        self.live, self.matrix = self.live[keep], self.matrix[:, keep]
        self.posted, self.documents, self.weights = self.posted[left], place[self.documents[left]], self.weights[left]
        self.starts = bounds(np.bincount(self.posted, minlength=len(self.starts) - 1))

    def neighbours(self, seed: int, used: np.ndarray) -> list[int]:
        """The best NEIGHBOURS unused documents that share a word with the seed, by score and then by place."""
        own = np.zeros(len(self.matrix), np.float32)
        own[self.rows[self.row_starts[seed] : self.row_starts[seed + 1]]] = 1
        words = self.words[self.word_starts[seed] : self.word_starts[seed + 1]]
        at = ranges(self.starts[words], self.starts[words + 1] - self.starts[words])
        scores = own @ self.matrix + np.bincount(self.documents.take(at), self.weights.take(at), len(self.live))
        scores[used[self.live]] = 0
        found = np.flatnonzero(scores > 0)
        if len(found) > NEIGHBOURS:
            found = found[scores[found] >= np.partition(scores[found], -NEIGHBOURS)[-NEIGHBOURS]]
        return self.live[found[np.lexsort((found, -scores[found]))][:NEIGHBOURS]].tolist()


def packing_order(shard: Shard, index: Index, window: int, filled: int) -> list[int]:
    """The order in which the documents are laid end to end, from a window that holds filled ids."""
    counts = np.concatenate(shard.counts).tolist()
    used, order, unused, seed = np.zeros(shard.n, bool), [], 0, None
    queue: list[int] = []
    while len(order) < shard.n:
        if seed is not None and not queue:
            if 5 * (shard.n - len(order)) < 4 * len(index.live):
                index.forget(used)
            queue = index.neighbours(seed, used)[::-1]
            if len(queue) < NEIGHBOURS:  # there are no more
                seed = None
        if queue:
            k = queue.pop()
        else:
            while used[unused]:
                unused += 1
            k = seed = unused
        used[k] = True
        order.append(k)
        filled += counts[k]
        if filled >= window:  # the next window's seed: the document that goes on in it, if any does
            filled %= window
            queue, seed = [], k if filled else None
    return order


def pieces(shard: Shard, order: list[int], window: int, at: int) -> dict[str, np.ndarray]:
    """The pieces of documents laid end to end from position at, cut at each multiple of window."""
    counts, ids = np.concatenate(shard.counts), np.concatenate(shard.ids)
    begins = bounds(counts)[:-1][order]
    lengths = counts[order]
    first = at + bounds(lengths)[:-1]
    cuts = (first + lengths - 1) // window - first // window + 1
    document = np.repeat(np.arange(len(order)), cuts)
    number = np.arange(len(document)) - np.repeat(bounds(cuts)[:-1], cuts)
    left = np.maximum(first[document], (first[document] // window + number) * window)
    right = np.minimum((first + lengths)[document], (left // window + 1) * window)
    start = left - first[document]
    source = begins[document] + start
    crc = [zlib.crc32(ids[a:b]) for a, b in zip(source.tolist(), (source + right - left).tolist(), strict=True)]
    return {"document": np.array(order)[document], "start": start, "length": right - left, "ids_crc32": np.array(crc, np.int64), "doc_tokens": lengths[document], "sequence": left // window, "offset": left % window, "source": source}


def content_sketch(text: Column) -> Column:
    """How the last sentence in alphabetical order begins: an edit elsewhere leaves it as it is."""
    return F.substring(F.array_max(F.split(F.concat(F.lit(" "), text), r"\.")), 1, SKETCH)  # the first one, too, has a space before it


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, rank_file: str | None = None, key: str = "doc_id", text: str = "text", route: tuple[str, ...] = (), window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids where asked for."""
    kind, known, special = docs.schema[key].dataType.simpleString(), statistics(docs, text), ByteLevel(tokenizer_file, end_id).special()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = ByteLevel(tokenizer_file, end_id, rank_file, special), TaskContext.get().partitionId(), 0
        shard = Shard()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal at, shard
            order = packing_order(shard, Index(shard, known), window, at % window)
            made = pieces(shard, order, window, at)
            at += int(sum(c.sum() for c in shard.counts))
            keys = pa.concat_arrays(shard.keys)
            made["sequence_id"] = (part << 40) + made["sequence"]
            ids = np.concatenate(shard.ids) if with_ids else None
            for i in range(0, len(made["start"]), 4096):
                columns = [keys.take(pa.array(made["document"][i : i + 4096])), *(pa.array(made[n][i : i + 4096]) for n in names)]
                if with_ids:
                    length = made["length"][i : i + 4096]
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds(length), pa.int32()), pa.array(ids[ranges(made["source"][i : i + 4096], length)].astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["k", *names, *["ids"] * with_ids])
            shard = Shard()

        for batch in slices(batches, "t", 2 * SLICE_BYTES):
            shard.add(batch.column("k"), batch.column("t"), encoder)
            if shard.bytes >= INDEX_BYTES or shard.n >= 4 * SHARD_DOCUMENTS:
                yield from flush()
        if shard.n:
            yield from flush()

    clean = F.coalesce(F.col(text), F.lit(""))
    sketch = F.xxhash64(content_sketch(clean))
    # repeated keys are in order of their texts, so that a repeated task lays out the same
    given = bounded_batches(docs).select(*(F.col(c).alias(f"r{i}") for i, c in enumerate(route)), sketch.alias("s"), F.col(key).alias("k"), F.xxhash64(clean).alias("h"), clean.alias("t"))
    order = [*(f"r{i}" for i in range(len(route))), "s", "k", "h"]
    dealt = given.repartitionByRange(max(parts_for(known.size, SHARD_BYTES), parts_for(known.n, SHARD_DOCUMENTS)), *order).sortWithinPartitions(*order).select("k", "t")
    made = dealt.mapInArrow(run, f"k {kind}, " + ", ".join(f"{n} long" for n in names) + ", ids array<int>" * with_ids)
    return made.withColumnRenamed("k", key)
