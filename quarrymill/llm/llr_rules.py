"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio of trusted against raw text.

Words are cut into runs of letters or digits and runs of other characters; n-grams are the runs and the pairs of
neighbouring runs, hashed into a fixed number of bins. Two multinomials are counted over whole texts: the target over
trusted documents (labelled good and not toxic), the raw one over all documents. A document's ratio is the mean over its
n-grams of log target share - log raw share; it is kept if its base counts pass and the ratio reaches the threshold.

Defined cases: a null text has no words and fails; a document without n-grams has ratio 0; without any trusted document
the target equals the raw corpus, so all ratios are 0; repeated rows are counted and judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.shared import bounded_batches, bounds, map_rows, slices, small
from quarrymill.llm.word_codes import words_of

BINS = 1 << 16
#: Nats per n-gram.
THRESHOLD = -0.7
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
RUNS = re.compile(r"[^\W_]+|[\W_]+")
PRIME, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)


class Words:
    """The words of a slice of texts: distinct ones, each occurrence's number, and where each text's begin."""

    def __init__(self, texts: pa.Array):
        spaced = pc.replace_substring_regex(texts, "[\\t-\\r]", " ")
        distinct, numbers, starts = words_of(spaced)
        self.words = distinct.to_pylist()
        real = pc.greater(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False)[numbers] if len(numbers) else np.zeros(0, bool)
        self.numbers, self.starts = numbers[real], bounds(real)[starts]
        self.counts = np.diff(self.starts)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of its words' values (one for each occurrence)."""
        return np.bincount(self.text, values, len(self.counts))


class Grams:
    """The bins of the n-grams of a slice."""

    def __init__(self, words: Words):
        runs = [RUNS.findall(w) for w in words.words]
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        flat = hashes([r for own in runs for r in own])
        ends = bounds(lengths)
        inner = np.ones(len(flat), bool)
        inner[ends[1:][lengths > 0] - 1] = False  # the last run of a word has its neighbour in the next word
        pair = flat[:-1] * PRIME ^ flat[1:] if len(flat) else flat
        self.own = np.concatenate([flat, pair[inner[:-1]]]) if len(flat) else flat
        self.of = np.repeat(np.arange(len(runs)), lengths)
        self.of = np.concatenate([self.of, self.of[:-1][inner[:-1]]]) if len(flat) else self.of
        first, last = np.zeros(len(runs), np.uint64), np.zeros(len(runs), np.uint64)
        some = lengths > 0
        first[some], last[some] = flat[ends[:-1][some]], flat[ends[1:][some] - 1]
        n = words.numbers
        joined = words.text[1:] == words.text[:-1]
        self.between = (last[n[:-1]] * PRIME ^ first[n[1:]])[joined]
        self.between_text = words.text[1:][joined]

    @staticmethod
    def bins(values: np.ndarray) -> np.ndarray:
        return ((values * OTHER) >> np.uint64(48)).astype(np.int64) % BINS

    def count(self, words: Words, weights: np.ndarray) -> np.ndarray:
        """How often each bin occurs, each text counted with its weight."""
        of_word = np.bincount(words.numbers, weights[words.text], len(words.words))
        return np.bincount(self.bins(self.own), of_word[self.of], BINS) + np.bincount(self.bins(self.between), weights[self.between_text], BINS)

    def means(self, words: Words, table: np.ndarray) -> np.ndarray:
        """Per text, the mean of the table's values at its n-grams."""
        n = len(words.words)
        of_word, count = np.bincount(self.of, table[self.bins(self.own)], n), np.bincount(self.of, minlength=n)
        total = words.sums(of_word[words.numbers]) + np.bincount(self.between_text, table[self.bins(self.between)], len(words.counts))
        grams = words.sums(count[words.numbers]) + np.bincount(self.between_text, minlength=len(words.counts))
        return total / np.maximum(grams, 1)


def repeated_words(words: Words) -> np.ndarray:
    """Per text, the words that lie in a window of 8 words found twice or more in that text."""
    n = len(words.numbers)
    starts = np.flatnonzero(np.arange(n) + WINDOW <= words.starts[1:][words.text]) if n >= WINDOW else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(len(words.counts), np.int64)
    value, step, factor = hashes(words.words)[words.numbers], 1, int(PRIME)
    for _ in range(3):  # windows of 2, 4, 8 words
        value, step, factor = value[:-step] * np.uint64(factor) ^ value[step:], 2 * step, factor * int(OTHER) % (1 << 64)
    key = value[starts] ^ (words.text[starts].astype(np.uint64) + np.uint64(1)) * OTHER
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = starts[times[which] > 1]
    edge = np.bincount(twice, minlength=n + 1) - np.bincount(twice + WINDOW, minlength=n + 1)
    return words.sums(np.cumsum(edge)[:-1] > 0).astype(np.int64)


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier one."""
    distinct, numbers, starts = words_of(texts, "\n")
    worded = pc.match_substring_regex(distinct, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    real = worded[numbers]
    key = text[real] * (len(distinct) + 1) + numbers[real]
    return np.bincount(text[real], minlength=len(texts)) - np.bincount(np.unique(key) // (len(distinct) + 1), minlength=len(texts))


def gram_counts(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """bin, raw and target: counts over all documents and over those whose key is in trusted."""
    flags = trusted.select(F.col(key).alias("k")).distinct().withColumn("good", F.lit(True))
    given = bounded_batches(docs).select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("text")).join(small(flags), "k", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BINS), np.zeros(BINS)
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            grams = Grams(words)
            raw += grams.count(words, np.ones(len(words.counts)))
            target += grams.count(words, part.column("good").to_numpy(zero_copy_only=False).astype(float))
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some].astype(np.int64)), pa.array(target[some].astype(np.int64))], ["bin", "raw", "target"])

    return given.mapInArrow(count, "bin long, raw long, target long").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratio_table(counts: DataFrame) -> np.ndarray:
    """log target share - log raw share of each bin, each with one count added. There are at most BINS rows."""
    got = counts.toPandas()
    raw, target = np.ones(BINS), np.ones(BINS)
    raw[got["bin"]] += got["raw"]
    target[got["bin"]] += got["target"]
    if target.sum() == BINS:
        return np.zeros(BINS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


SHAPE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, base_failed boolean, kept boolean"


def judge_documents(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """row (docs' columns), the base counts, the ratio and the verdict, of every document."""
    table = ratio_table(gram_counts(docs, trusted, key, text))

    def judge(texts: pa.Array) -> dict[str, pa.Array]:
        words = Words(texts)
        chars = pc.utf8_length(pa.array(words.words, pa.string())).to_numpy(zero_copy_only=False)
        symbols = pc.count_substring_regex(pa.array(words.words, pa.string()), SYMBOLS).to_numpy(zero_copy_only=False)
        n, repeats, ratio = words.counts, repeated_words(words), Grams(words).means(words, table)
        failed = (n < 20) | (100 * repeats > 30 * n)
        made = {"n_words": n, "word_chars": words.sums(chars[words.numbers]), "n_symbols": words.sums(symbols[words.numbers]), "n_dup_lines": duplicate_lines(texts), "n_repeat_words": repeats}
        return {k: pa.array(v.astype(np.int64)) for k, v in made.items()} | {"ratio": pa.array(ratio), "base_failed": pa.array(failed), "kept": pa.array(~failed & (ratio >= threshold))}

    return map_rows(docs, text, judge, SHAPE)


def trusted_keys(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select(key)


def filter_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are kept, with their columns."""
    return judge_documents(docs, trusted_keys(labels, key), key, text).filter("kept").select("row.*")
