"""Phrase collocations: n-grams counted by Rabin-Karp fingerprints, verified against the text, scored by their weakest cut.

Texts are lower-cased (A-Z), cut into pieces at marks and line ends, and pieces into words. Each word has a hash, and
prefix polynomials over the words of a slice of texts give the fingerprint of every n-gram in one subtraction. Lengths
are counted one after the other by a shuffle of fingerprints that are summed up slice by slice: an n-gram can reach the
least count only if both n-grams of one word less within it do, so each count is given a bitmap of BITMAP_BITS bits of
the frequent fingerprints so far. A bitmap only lets too many through; as it fills up, more n-grams are counted, and
the result stays the same. The last pass reads the texts again: the occurrences of a frequent fingerprint in a slice
are compared with the text that its pointer shows, and only such phrases become strings, counted exactly by their text.

Defined cases: a null text counts as empty and has no words; a null language is UNKNOWN; a piece of one word has no
phrases; words of any length are whole; repeated rows count as often as they come; equal scores and counts are ordered
by phrase in bytes; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.shared import SLICE_BYTES, bounded_batches, short_lived_shuffles, slices, small
from quarrymill.operators.tables import written

UNKNOWN = "und"
#: Size of the bitmap of frequent fingerprints that tasks get: 8 MB, however large the corpus.
BITMAP_BITS = 1 << 26
#: Bits of one row of Spark's bitmap functions (fixed by Spark).
ROW_BITS = 1 << 15
#: The base of the polynomials (any odd number whose powers are many) and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SCALE = 2_000_000

#: Kinds of bytes: of a word, blank, ending a piece (fixed values of the rule).
WORD, BLANK, BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = BLANK
KIND[list(b".,;:!?\n\x0b\x0c\r")] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """x with its bits spread (uint64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(values: pa.Array) -> np.ndarray:
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False), categorize=False)


@dataclass
class Slice:
    """The words of some texts in order: the distinct ones, each one's number, piece, text and first byte in its text."""

    distinct: pa.Array
    code: np.ndarray
    piece: np.ndarray
    text: np.ndarray
    start: np.ndarray
    lang: pa.Array
    of_lang: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, langs: pa.Array) -> Slice:
        texts = texts.cast(pa.large_string())
        _, offsets, held = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = LOWER[np.frombuffer(held, np.uint8)[ends[0] : ends[-1]]] if held else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        kind = KIND[data]
        inside = kind == WORD
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = ends[:-1][ends[:-1] < len(data)]
        first[begins] = inside[begins]  # a text's first word begins with the text
        start = np.flatnonzero(first)
        compact = data[inside]
        before = np.cumsum(inside) - inside
        bounds = np.append(before[start], len(compact)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(compact)).dictionary_encode()
        text = np.searchsorted(ends, start, side="right") - 1
        broken = np.cumsum(kind == BREAK)[start] if len(start) else start
        langs = pc.fill_null(langs, UNKNOWN).dictionary_encode()
        return cls(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), broken + text, text, start - ends[text], langs.dictionary, langs.indices.to_numpy(zero_copy_only=False)[text])


class Fingerprints:
    """The fingerprints of a slice's n-grams: of(n) gives them with the numbers of their first words."""

    def __init__(self, words: Slice):
        self.words, n, self.held = words, len(words.code), {}
        value = mixed(hashes(words.distinct))[words.code] if n else np.zeros(0, np.uint64)
        self.back = np.full(n, INVERSE, np.uint64)
        power = np.full(n, BASE, np.uint64)
        if n:
            self.back[0] = power[0] = 1
            np.multiply.accumulate(power, out=power)
            np.multiply.accumulate(self.back, out=self.back)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(value * power, out=self.prefix[1:])
        self.seed = mixed(hashes(words.lang)) if len(words.lang) else np.zeros(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(max(0, len(self.words.code) - n + 1))
        at = at[self.words.piece[at] == self.words.piece[at + n - 1]]
        polynomial = (self.prefix[at + n] - self.prefix[at]) * self.back[at]
        return at, mixed(polynomial + self.seed[self.words.of_lang[at]] + np.uint64(n))

    def known(self, n: int, bitmap: np.ndarray) -> np.ndarray:
        """Of each word, whether an n-gram begins with it that is in the bitmap."""
        if n not in self.held:
            at, value = self.of(n)
            self.held[n] = np.zeros(len(self.words.code), bool)
            self.held[n][at[contains(bitmap, value)]] = True
        return self.held[n]

    def allowed(self, n: int, bitmap: np.ndarray, counted: int) -> tuple[np.ndarray, np.ndarray]:
        """of(n) without those that hold an n-gram of fewer words, of at most as many as have been counted, that isn't in the bitmap."""
        at, value = self.of(n)
        if shorter := min(n - 1, counted):  # what that one holds has been looked at when it was counted
            ok = self.known(shorter, bitmap)
            for k in range(n - shorter + 1):
                keep = ok[at + k]
                at, value = at[keep], value[keep]
        return at, value


def places(value: np.ndarray) -> np.ndarray:
    return (value & np.uint64(BITMAP_BITS - 1)).astype(np.int64)


def contains(bitmap: np.ndarray, value: np.ndarray) -> np.ndarray:
    at = places(value)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap_of(frequent: DataFrame, known: np.ndarray | None) -> np.ndarray:
    """The bits of the column fp, beside those known: BITMAP_BITS / ROW_BITS rows of 4 KB reach the driver, at most."""
    at = F.col("fp").bitwiseAND(F.lit(BITMAP_BITS - 1))
    rows = frequent.select(F.floor(at / ROW_BITS).cast("long").alias("row"), (at % ROW_BITS).alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 8, np.uint8) if known is None else known.copy()
    for row, bits in zip(rows["row"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        out[row * ROW_BITS // 8 :][: len(bits)] |= np.frombuffer(bits, np.uint8)
    return out


def scanned(docs: DataFrame, key: str, text: str, lang: str, of: Callable[[pa.RecordBatch], pa.RecordBatch], shape: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", 2 * SLICE_BYTES):
            yield of(part)

    given = bounded_batches(docs).select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(lang).cast("string").alias("lang"))
    return given.mapInArrow(run, shape)


def frequent(docs: DataFrame, key: str, text: str, lang: str, lengths: tuple[int, ...], least: int, known: Broadcast | None) -> DataFrame:
    """fp of the n-grams of these lengths that occur often enough, by their fingerprints."""

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        prints = Fingerprints(Slice.of(part.column("t"), part.column("lang")))
        value = np.concatenate([(prints.allowed(n, known.value, lengths[0] - 1) if known else prints.of(n))[1] for n in lengths])
        value, times = np.unique(value, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times)], ["fp", "n"])

    counted = scanned(docs, key, text, lang, count, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least).select("fp")


def phrases(docs: DataFrame, key: str, text: str, lang: str, longest: int, known: Broadcast, least: int) -> DataFrame:
    """lang, phrase, n_words, a (all occurrences) and the place of one of them; a row without words (n_words 0) has a language's words."""
    kind = docs.schema[key].dataType.simpleString()

    def find(part: pa.RecordBatch) -> pa.RecordBatch:
        words = Slice.of(part.column("t"), part.column("lang"))
        prints, out = Fingerprints(words), []
        totals = np.bincount(words.of_lang, minlength=len(words.lang))
        for n in range(1, longest + 1):
            at, value = prints.allowed(n, known.value, longest)
            hit = contains(known.value, value)
            at, value = at[hit], value[hit]
            # an occurrence belongs to its fingerprint's pointer if its words are the same; of those that differ, one
            # is the next pointer, until none is left
            while len(at):
                _, first, which = np.unique(value, return_index=True, return_inverse=True)
                pointer = at[first]
                same = words.of_lang[at] == words.of_lang[pointer[which]]
                for k in range(n):
                    same &= words.code[at + k] == words.code[pointer[which] + k]
                times = np.bincount(which[same], minlength=len(first))
                out.append((n, pointer, times))
                at, value = at[~same], value[~same]
        parts = []
        for n, pointer, times in out:
            columns = [words.distinct.take(pa.array(words.code[pointer + k])) for k in range(n)]
            joined = pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())).cast(pa.string()) if n > 1 else columns[0].cast(pa.string())
            parts.append([words.lang.take(pa.array(words.of_lang[pointer])), joined, pa.array(np.full(len(pointer), n, np.int32)), pa.array(times.astype(np.int64)), part.column("k").take(pa.array(words.text[pointer])), pa.array(words.start[pointer])])
        held = np.flatnonzero(totals)
        none = len(held)
        parts.append([words.lang.take(pa.array(held)), pa.array([""] * none, pa.string()), pa.array(np.zeros(none, np.int32)), pa.array(totals[held].astype(np.int64)), pa.nulls(none, part.schema.field("k").type), pa.nulls(none, pa.int64())])
        names = ["lang", "phrase", "n_words", "a", "k", "start"]
        return pa.concat_batches([pa.RecordBatch.from_arrays(p, names) for p in parts])

    found = scanned(docs, key, text, lang, find, f"lang string, phrase string, n_words int, a long, k {kind}, start long")
    summed = found.groupBy("lang", "phrase", "n_words").agg(F.sum("a").alias("a"), F.first("k").alias("at_key"), F.first("start").alias("at_byte"))
    return summed.filter((F.col("a") >= least) | (F.col("n_words") == 0))


def counted_phrases(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30) -> DataFrame:
    """The words and phrases that occur least times or more, as phrases() gives them, as a table in the shared folder."""
    context = docs.sparkSession.sparkContext
    known, sent = None, None
    with short_lived_shuffles(docs.sparkSession):
        for lengths in ((n,) if n < 3 else tuple(range(n, longest + 1)) for n in range(1, min(longest, 3) + 1)):
            bitmap = bitmap_of(frequent(docs, key, text, lang, lengths, least, sent), known)
            known, sent = bitmap, context.broadcast(bitmap)
        return written(phrases(docs, key, text, lang, longest, sent, least), "phrases")


def cuts(table: DataFrame) -> DataFrame:
    """lang, phrase, a, and of the lowest-scoring cut: l, r, score."""
    word = F.split("phrase", " ")
    joined = lambda start, n: F.concat_ws(" ", F.slice(word, start, n))
    every = table.filter("n_words > 1").select("lang", "phrase", "a", F.col("n_words").alias("n"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    every = every.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("n") - F.col("k")).alias("right"))
    known = small(table.filter("n_words > 0").select("lang", F.col("phrase").alias("part"), F.col("a").alias("of_part")))
    for side, name in (("left", "l"), ("right", "r")):
        every = every.join(known.withColumnRenamed("part", side).withColumnRenamed("of_part", name), ["lang", side])
    score = F.expr(f"CAST({SCALE} AS DECIMAL(38, 0)) * a DIV (CAST(l AS DECIMAL(20, 0)) + r)")
    return every.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(table: DataFrame, cover: int) -> DataFrame:
    """lang and phrase of those that a longer phrase holds in at least cover of 100 of their occurrences."""
    word = F.split("phrase", " ")
    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("n_words") - n + 1), lambda s: F.concat_ws(" ", F.slice(word, s, n))))))
    inner = table.filter("n_words > 2").select("lang", F.col("a").alias("of_longer"), spans.alias("phrase")).groupBy("lang", "phrase").agg(F.max("of_longer").alias("of_longer"))
    a = F.col("a").cast("decimal(20,0)")
    return table.join(small(inner), ["lang", "phrase"]).filter(F.lit(100) * F.col("of_longer").cast("decimal(20,0)") >= F.lit(cover) * a).select("lang", "phrase")


def collocations(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30, cover: int = 80, most: int = 2000) -> DataFrame:
    """The most best-scored phrases of each language: lang, rank, phrase, a, l, r, n, score, and the place of an occurrence.

    a counts a phrase, l and r the two parts of its lowest-scoring cut, n all words of the language; the score is
    SCALE * a / (l + r). A phrase within a longer one of nearly as many occurrences is left out.
    """
    if not 2 <= longest:
        raise ValueError("a phrase has two words at least")
    table = counted_phrases(docs, key, text, lang, longest, least)
    size = table.filter("n_words = 0").select("lang", F.col("a").alias("n"))
    scored = cuts(table).join(small(covered(table, cover)), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    places_of = table.select("lang", "phrase", "at_key", "at_byte")
    return best.join(size, "lang").join(places_of, ["lang", "phrase"]).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "at_key", "at_byte")

