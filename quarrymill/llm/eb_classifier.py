"""Quality classifier: a document's own evidence, combined with what its host and path have shown (empirical Bayes).

Evidence is a sparse logistic regression over the distinct features of the whole text: its runs of letters (lower-case)
and of symbols, and a few marks of its shape. It is fitted on a bounded sample of labelled documents, good (of quality
and not toxic) against the rest, over the features whose odds stand out from chance most. Sites are then two levels, host and path (here source
and language): a host's share of good documents is shrunk to the global one, and a path's to its host's, by as many
pseudo-documents as the spread between sites calls for (method of moments). A document is kept if its evidence and its
path's share together make good more likely than bad.

Defined cases: null and empty texts have only marks of shape; a null host or path is a site of its own; a site with few
documents has nearly its parent's share; without labels of both kinds there is no evidence and all is kept; repeated
rows are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.shared import bounded_batches, bounds, slices, small
from quarrymill.llm.word_codes import words_of
from quarrymill.operators.tables import written

#: Labelled documents that the odds are counted on, at most; the least by a hash of their keys.
SAMPLE = 20_000
#: A feature counts if so many labelled documents have it and the likelihood ratio statistic of its odds (chi squared
#: with one degree of freedom, if it were chance) reaches SURPRISE.
SUPPORT, SURPRISE, MOST_FEATURES = 5, 25.0, 4000
#: Of the regression: the L1 penalty per document, and gradient steps.
PENALTY, STEPS = 2e-4, 300
PRIOR = 0.5
RUNS = re.compile(r"[^\W_]+|[\W_]+")


class Features:
    """The distinct features of each text of a slice, as 64-bit hashes."""

    def __init__(self, texts: pa.Array):
        distinct, numbers, starts = words_of(pc.replace_substring_regex(texts, "[\\t-\\r]", " "))
        words = distinct.to_pylist()
        runs = [[r.lower() for r in RUNS.findall(w)] for w in words]
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        number: dict[str, int] = {}
        flat = np.fromiter((number.setdefault(r, len(number)) for own in runs for r in own), np.int64, lengths.sum())
        hashed = pd.util.hash_array(np.array(list(number), object), categorize=False) if number else np.zeros(0, np.uint64)
        real = lengths[numbers] > 0
        numbers, starts = numbers[real], bounds(real)[starts]
        text, size = np.repeat(np.arange(len(texts)), np.diff(starts)), np.diff(starts)
        n = np.maximum(size, 1)
        again = np.bincount(text[1:][(text[1:] == text[:-1]) & (numbers[1:] == numbers[:-1])], minlength=len(texts)) / n
        upper = np.fromiter((w.isupper() and len(w) > 1 for w in words), bool, len(words))
        letters = np.fromiter((any(c.isalnum() for c in w) for w in words), bool, len(words))
        share = lambda mark: np.bincount(text, mark[numbers], len(texts)) / n
        shape = np.stack([again >= 0.3, share(upper) >= 0.5, share(~letters) >= 0.2, size < 20], axis=1)
        own, kind = np.nonzero(shape)
        ends = bounds(lengths)
        count = lengths[numbers]
        at = np.repeat(ends[:-1][numbers], count) + np.arange(count.sum()) - np.repeat(bounds(count)[:-1], count)
        key = np.unique(np.repeat(text, count) * (len(number) + 1) + flat[at])
        order = np.concatenate([key // (len(number) + 1), own])
        value = np.concatenate([hashed[key % (len(number) + 1)], kind.astype(np.uint64)])
        self.text, self.value = order, value


def is_good() -> Column:
    return (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)


def fit_sparse(text: np.ndarray, feature: np.ndarray, good: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with an L1 penalty, by accelerated proximal gradient steps.

    The pairs (text, feature) are the ones of a binary matrix. The penalty leaves out what other features explain, such
    as the words of one often copied bad document beside those that all bad documents share.
    """
    n, y = len(good), good.astype(float)
    weights, bias = np.zeros(n_features), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    direction = np.ones(n_features)
    for _ in range(10):  # the greatest curvature, by power iteration
        direction = np.bincount(feature, np.bincount(text, direction[feature], n)[text], n_features)
        length = np.linalg.norm(direction)
        direction /= max(length, 1e-12)
    step = 1 / (0.25 * (length + n) / n)
    ahead, ahead_bias, t = weights, bias, 1.0
    for _ in range(STEPS):
        off = 1 / (1 + np.exp(-np.clip(ahead_bias + np.bincount(text, ahead[feature], n), -50, 50))) - y
        moved = ahead - step * np.bincount(feature, off[text], n_features) / n
        new, new_bias = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0), ahead_bias - step * off.mean()
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / following * (new - weights), new_bias + (t - 1) / following * (new_bias - bias)
        weights, bias, t = new, new_bias, following
    return weights, bias


@dataclass
class Evidence:
    """Feature hashes, sorted, their weights, and what a text without any of them gets."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def of(self, found: Features, n: int) -> np.ndarray:
        """Log odds of good against bad from a text's features alone, apart from how common good is."""
        if not len(self.features):
            return np.zeros(n)
        value = found.value.view(np.int64)
        at = np.minimum(np.searchsorted(self.features, value), len(self.features) - 1)
        hit = self.features[at] == value
        return self.bias + np.bincount(found.text[hit], self.weights[at[hit]], n)


def evidence_table(docs: DataFrame, labels: DataFrame, key: str, text: str) -> Evidence:
    none = Evidence(np.zeros(0, np.int64), np.zeros(0), 0.0)
    sample = labels.filter("quality is not null").groupBy(F.col(key).alias("k")).agg(F.bool_and(is_good()).alias("good")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    found = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")).join(F.broadcast(sample), "k")
    # of equal texts one counts, as good only if all their labels say so
    known = written(found.groupBy(F.md5("t").alias("h")).agg(F.min("k").alias("k"), F.first("t").alias("t"), F.bool_and("good").alias("good")).select("k", "t", "good"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", 4 << 20):
            found, good = Features(part.column("t")), part.column("good").to_numpy(zero_copy_only=False)
            value, which = np.unique(found.value, return_inverse=True)
            yes, every = np.bincount(which, good[found.text], len(value)).astype(np.int64), np.bincount(which, minlength=len(value))
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(yes), pa.array(every - yes)], ["feature", "good", "bad"])

    total = known.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).first()
    if not total["good"] or not total["bad"]:
        return none
    counted = bounded_batches(known).select("t", "good").mapInArrow(count, "feature long, good long, bad long").groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).filter(F.col("good") + F.col("bad") >= SUPPORT)
    g, b = F.col("good") + F.lit(PRIOR), F.col("bad") + F.lit(PRIOR)
    all_g, all_b = F.lit(total["good"] + 2 * PRIOR), F.lit(total["bad"] + 2 * PRIOR)
    both = (g + b) / (all_g + all_b)
    surprise = 2 * (g * F.log(g / (all_g * both)) + b * F.log(b / (all_b * both)))
    best = counted.select("feature", surprise.alias("surprise")).filter(F.col("surprise") >= SURPRISE).orderBy(F.desc("surprise"), "feature").limit(MOST_FEATURES)
    features = np.sort(best.toPandas()["feature"].to_numpy(np.int64))
    if not len(features):
        return none

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", 4 << 20):
            found = Features(part.column("t"))
            value = found.value.view(np.int64)
            at = np.minimum(np.searchsorted(features, value), len(features) - 1)
            hit = features[at] == value
            ends = bounds(np.bincount(found.text[hit], minlength=part.num_rows))
            order = np.argsort(found.text[hit], kind="stable")
            yield pa.RecordBatch.from_arrays([part.column("good"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[hit][order].astype(np.int32)))], ["good", "at"])

    picked = bounded_batches(known).orderBy("k").select("t", "good").mapInArrow(pick, "good boolean, at array<int>").toArrow()  # SAMPLE rows of some of MOST_FEATURES
    at = picked.column("at").combine_chunks()
    text_of = np.repeat(np.arange(len(at)), pc.list_value_length(at).to_numpy(zero_copy_only=False))
    good = picked.column("good").to_numpy()
    weights, bias = fit_sparse(text_of, at.flatten().to_numpy(), good, len(features))
    prior = float(np.log(good.mean() / (1 - good.mean())))
    return Evidence(features, weights, bias - prior)


def evidence(docs: DataFrame, labels: DataFrame, key: str, text: str, host: str, path: str) -> DataFrame:
    """k, host, path and evidence of every document."""
    table = evidence_table(docs, labels, key, text)
    kind = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            total = table.of(Features(part.column("t")), part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("k"), part.column("host"), part.column("path"), pa.array(total)], ["k", "host", "path", "evidence"])

    given = bounded_batches(docs).select(F.col(key).alias("k"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.coalesce(text, F.lit("")).alias("t"))
    return given.mapInArrow(score, f"k {kind}, host string, path string, evidence double")


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(sites: DataFrame) -> float:
    """Pseudo-documents of the parent's share, by moments: sites has n, good (soft count) and parent (share)."""
    within = F.col("parent") * (1 - F.col("parent"))
    off = F.pow(F.col("good") / F.col("n") - F.col("parent"), 2)
    row = sites.agg(F.sum(F.col("n") * off).alias("spread"), F.sum(within).alias("noise"), F.sum(F.col("n") * within).alias("base"), F.sum("n").alias("n")).first()
    if not row["n"] or not row["base"]:
        return 1.0
    between = max((row["spread"] - row["noise"]) / row["n"], 1e-6)
    return float(min(max(row["base"] / row["n"] / between - 1, 1.0), 1e6))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """key, host, path, evidence, the path's share of good documents, posterior and kept, of every document."""
    rates = labels.filter("quality is not null").agg(F.avg(is_good().cast("double"))).first()[0]
    start = min(max(0.5 if rates is None else rates, 0.01), 0.99)
    scored = written(evidence(docs, labels, key, text, host, path), "evidence")
    chance = 1 / (1 + F.exp(-(F.lit(float(np.log(start / (1 - start)))) + F.col("evidence"))))
    by_path = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(chance).alias("good")), "sites")
    overall = by_path.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    share = min(max(overall["good"] / overall["n"], 1e-3), 1 - 1e-3) if overall["n"] else start
    hosts = by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("parent", F.lit(share))
    k = strength(hosts)
    shrunk = (F.col("good") + k * F.col("parent")) / (F.col("n") + k)
    above = hosts.select(F.col("host").alias("h"), shrunk.alias("parent"))
    paths = by_path.join(above, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k = strength(paths)
    paths = paths.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("good").alias("site_good"), F.col("n").alias("site_n"), F.col("parent").alias("site_parent"))
    joined = scored.join(small(paths), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    # a document's own evidence is left out of its site's share, as it is added to it
    share_of_others = (F.greatest(F.lit(0.0), F.col("site_good") - chance) + k * F.col("site_parent")) / (F.col("site_n") - 1 + k)
    joined = joined.withColumn("site_share", share_of_others)
    posterior = 1 / (1 + F.exp(-(logit(F.col("site_share")) + F.col("evidence"))))
    out = joined.select(F.col("k").alias(key), "host", "path", "evidence", "site_share", posterior.alias("posterior"))
    return out.withColumn("kept", F.col("posterior") >= 0.5)


def filter_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """The documents that are kept, with their columns. Rows of one key stay if any of them is kept."""
    kept = classify(docs, labels, key, text, host, path).filter("kept").select(key).distinct()
    return docs.join(small(kept), key, "left_semi")
