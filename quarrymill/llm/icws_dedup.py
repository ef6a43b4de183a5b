"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A document's shingles are its runs of five words (all its words if it has fewer), each weighted by its times in the
document and its inverse document frequency. Consistent weighted samples of these weights agree with the probability of
the weighted Jaccard similarity; bands of samples put similar texts into common buckets. The texts of a small bucket are
compared with one another. A crowded bucket is split by further samples, and besides, all its texts are compared with a
pivot, the one that shares buckets with most. Links, pairs whose weighted Jaccard similarity reaches the threshold, make
classes by connected components. Then the texts of crowds that still hold several classes are joined across classes,
exactly: every pair of them whose similarity can reach the threshold, by its weights, rarest shingles (prefixes and
places) and bitmaps, is compared. No pair of such texts that reaches it is left in different classes, whatever the size of
the crowd or of the classes; so nothing is lost but what no band catches (1 pair of 1000 at the threshold).

Frequencies: a shingle of RARE of all documents or fewer counts as rare and has weight 1; the weight of others falls with
the logarithm of their frequency, which is counted exactly over all documents. A large group of copies counts as one
document there (as a few, where it is loose), since else the few words in which copies differ would outweigh all that they
have in common. Such groups are the buckets of a plain min-hash that hold an eighth of RARE of all documents or more.

Defined cases: null and empty texts are equal texts without shingles, so they form one class; equal texts are one class
whatever their number; a class is named by its least key; an empty table gives no rows; repeated keys give one row each,
also where one key has several texts; a class whose keys are all null has a null name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.shared import bounded_batches, bounds, slices, small
from quarrymill.llm.word_codes import words_of
from quarrymill.operators.dedup import connected_components
from quarrymill.operators.tables import written

SHINGLE, SIMILARITY = 5, 0.8
#: With 10 bands of 3 samples, a pair at the threshold shares a bucket with probability 0.999.
BANDS, ROWS = 10, 3
#: Share of all documents, and least number of them, up to which a shingle is rare. At most (shingles of a mean document)
#: / RARE others exist, so their table has a fixed bound.
RARE, RARE_DOCUMENTS = 0.002, 16
#: Bins that say which shingles are counted: those of bins that reach half of RARE. What they let through is counted exactly.
DF_BINS = 1 << 20
#: The min-hash that finds large groups of copies: with 16 bands of 4, a pair at the threshold meets with probability 0.9998.
DRAFT_BANDS, DRAFT_ROWS = 16, 4
#: Share of a table's rows in one group from which on the group's facts are broadcast; there are 100,000 such groups at most.
HOT_SHARE, HOT_ROWS = 1e-5, 256
#: Texts of a bucket that are all compared with one another at once, and splits of a crowd; what they leave is joined across classes.
CROWD, DEPTH = 12, 3
#: Bins that count the crowds' shingles; they only order them, so shared bins cost comparisons, not pairs.
ORDER_BINS = 1 << 20
#: Words of 64 bits that hold the parity of a text's elements: where two texts' bits differ, so do their elements.
PARITY = 16
LEVELS = 1 << 16
PRIME, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gamma_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at LEVELS even steps, by Newton's method on its distribution 1 - (1 + x) exp(-x)."""
    p = (np.arange(LEVELS) + 0.5) / LEVELS
    x = np.sqrt(2 * p) + 1e-9
    for _ in range(60):
        x = np.maximum(x - np.clip((1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), -1, 1), 1e-9)
    return x


def mixed(values: np.ndarray, seed: int) -> np.ndarray:
    x = (values ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * OTHER
    x ^= x >> np.uint64(29)
    x *= PRIME
    return x ^ x >> np.uint64(32)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle and times of each text's distinct shingles, in this order."""
    spaced = pc.replace_substring_regex(texts, "[\\t-\\r]", " ")
    distinct, numbers, starts = words_of(spaced)
    real = pc.greater(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False)[numbers]
    starts = bounds(real)[starts]
    value = pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)[numbers[real]]
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    size = np.diff(starts)
    width = np.minimum(size, SHINGLE)[text]
    place = np.arange(len(value)) - starts[:-1][text]
    whole = place + width <= size[text]
    run = value.copy()
    for k in range(1, SHINGLE):  # words behind the text's end are never part of a whole run
        more = np.zeros_like(run)
        more[: max(len(run) - k, 0)] = value[k:]
        run = np.where(k < width, (run * PRIME) ^ more, run)
    run, text = mixed(run[whole], 1), text[whole]
    order = np.lexsort((run, text))
    run, text = run[order], text[order]
    first = np.ones(len(run), bool)
    first[1:] = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    return text[at], run[at], np.diff(at, append=len(run))


def bins(run: np.ndarray) -> np.ndarray:
    return (run >> np.uint64(44)).astype(np.int64)


def drafts(n: int, text: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The bands of a one-permutation min-hash of each of n texts; empty bins take the next one's value. 0 where a text has no shingle."""
    k = DRAFT_BANDS * DRAFT_ROWS
    cell = text * k + (run >> np.uint64(58)).astype(np.int64)  # shingles are sorted, so a cell's first is its least
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    least = np.zeros(n * k, np.uint64)
    least[cell[first]] = run[first]
    least = least.reshape(n, k)
    twice = np.concatenate([least, least], axis=1)
    place = np.where(twice != 0, np.arange(2 * k), 2 * k)
    following = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :k]
    filled = np.take_along_axis(np.concatenate([twice, np.zeros((n, 1), np.uint64)], axis=1), following, axis=1)
    value = mixed(filled + (following - np.arange(k)).astype(np.uint64), 5).reshape(n, DRAFT_BANDS, DRAFT_ROWS)
    out = np.arange(DRAFT_BANDS, dtype=np.uint64) + np.zeros((n, 1), np.uint64)
    for r in range(DRAFT_ROWS):
        out = mixed(out * PRIME ^ value[:, :, r], 6)
    out[~least.any(axis=1)] = 0
    return out


def texts_and_hashes(docs: DataFrame, text: str) -> DataFrame:
    clean = F.coalesce(F.col(text), F.lit(""))
    return bounded_batches(docs).select(F.md5(clean).alias("same"), clean.alias("t"))


class Weights:
    """The factor of each shingle: 1 if it is rare, less the more documents have it."""

    def __init__(self, run: np.ndarray, df: np.ndarray, n: int, floor: float):
        order = np.argsort(run)
        self.run = run[order]
        self.value = np.log1p(n / np.maximum(df[order], floor)) / np.log1p(n / floor)

    def of(self, run: np.ndarray) -> np.ndarray:
        out = np.ones(len(run))
        if len(self.run):
            at = np.minimum(np.searchsorted(self.run, run), len(self.run) - 1)
            known = self.run[at] == run
            out[known] = self.value[at[known]]
        return out


def frequencies(docs: DataFrame, text: str = "text") -> Weights:
    """Document frequencies over all documents; members of a large group of copies count together."""

    def draft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DF_BINS, np.int64), 0
        for part in slices(batches, "t"):
            own, run, _ = shingles(part.column("t"))
            total += np.bincount(bins(run), minlength=DF_BINS)
            n += part.num_rows
            bands = drafts(part.num_rows, own, run).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * DRAFT_BANDS, pa.int32()), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("same"), lists, pa.nulls(part.num_rows, pa.int64()), pa.nulls(part.num_rows, pa.int64())], ["same", "bands", "bin", "n"])
        if n:  # bins left out hold less than half of RARE of all documents together
            at = np.flatnonzero(total >= max(RARE / 2 * n, 1))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.list_(pa.int64())), pa.array(at), pa.array(total[at])], ["same", "bands", "bin", "n"])

    drafted = written(texts_and_hashes(docs, text).mapInArrow(draft, "same string, bands array<long>, bin long, n long"), "drafts")
    n = drafted.filter("bin IS NULL").count()
    floor = max(RARE * n, RARE_DOCUMENTS)
    heavy = drafted.filter("bin IS NOT NULL").groupBy("bin").agg(F.sum("n").alias("n")).filter(F.col("n") >= floor / 2).select("bin").toArrow()["bin"].to_numpy()
    counted = np.zeros(DF_BINS, bool)
    counted[heavy] = True
    if not len(heavy):
        return Weights(np.zeros(0, np.uint64), np.zeros(0), max(n, 1), floor)
    banded = drafted.filter("bin IS NULL").select("same", F.explode("bands").alias("value")).filter("value <> 0")
    large = banded.groupBy("value").agg(F.count("*").alias("n"), F.min("same").alias("same")).filter(F.col("n") >= floor / 8)
    groups = written(large, "groups")  # DRAFT_BANDS * 8 / RARE rows at most
    times = drafted.filter("bin IS NULL").select("same").join(F.broadcast(groups.select("same").distinct()), "same").groupBy("same").agg(F.count("*").alias("times"))
    known = groups.join(F.broadcast(times), "same").select("value", "same", "times").toArrow()
    value = known["value"].to_numpy()
    order = np.argsort(value)
    value, first, share = value[order], np.array(known["same"].to_pylist(), dtype="U32")[order], 1 / known["times"].to_numpy()[order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", 8 << 20):
            own, run, _ = shingles(part.column("t"))
            counts = np.ones(part.num_rows)
            if len(value):
                bands = drafts(part.num_rows, own, run).view(np.int64)
                at = np.minimum(np.searchsorted(value, bands), len(value) - 1)
                hit = value[at] == bands
                grouped = np.flatnonzero(hit.any(axis=1))
                group = at[grouped, hit[grouped].argmax(axis=1)]
                # of a group's members only the copies of the text with the least hash count, as one together
                is_first = first[group] == np.array(part.column("same").take(pa.array(grouped)).to_pylist(), dtype="U32")
                counts[grouped] = np.where(is_first, share[group], 0)
            wanted = (counts[own] > 0) & counted[bins(run)]
            found, which = np.unique(run[wanted], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.bincount(which, counts[own][wanted], len(found)))], ["run", "df"])

    got = texts_and_hashes(docs, text).mapInArrow(count, "run long, df double").groupBy("run").agg(F.sum("df").alias("df")).filter(F.col("df") > floor + 1e-6).toArrow()
    return Weights(got["run"].to_numpy().view(np.uint64), got["df"].to_numpy(), n, floor)


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010); the random variates of a shingle come from its hash."""

    def __init__(self, weights: Weights):
        quantiles = gamma_table()
        self.r, self.ln_c, self.weights = quantiles.astype(np.float32), np.log(quantiles).astype(np.float32), weights

    def bands(self, n: int, text: np.ndarray, run: np.ndarray, times: np.ndarray) -> np.ndarray:
        """A hash per text and band; texts without shingles have zeros."""
        out = np.zeros((n, BANDS), np.uint64)
        if not len(run):
            return out.view(np.int64)
        ln_w = np.log(times * self.weights.of(run)).astype(np.float32)
        own, first = np.unique(text, return_index=True)
        sizes = np.diff(first, append=len(run))
        for k in range(BANDS * ROWS):
            x = mixed(run, k + 2)
            r = self.r[x >> np.uint64(48)]
            beta = ((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(LEVELS)
            t = np.floor(ln_w / r + beta)
            ln_a = self.ln_c[(x >> np.uint64(32)) & np.uint64(0xFFFF)] - r * (t - beta) - r
            hit = np.flatnonzero(ln_a == np.repeat(np.minimum.reduceat(ln_a, first), sizes))
            best = hit[np.searchsorted(hit, first)]  # of equal ones the least shingle
            sample = mixed(run[best] ^ (t[best].astype(np.int64).view(np.uint64) * PRIME), k + 101)
            out[own, k // ROWS] = out[own, k // ROWS] * PRIME ^ sample
        return out.view(np.int64)


def sketches(docs: DataFrame, weights: Weights, key: str, text: str) -> DataFrame:
    """k, same (equal for equal texts) and bands of every document."""
    sampler = Sampler(weights)
    kind = docs.schema[key].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", 1 << 20):
            values = sampler.bands(part.num_rows, *shingles(part.column("t")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * BANDS, pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("k"), part.column("same"), lists], ["k", "same", "bands"])

    clean = F.coalesce(F.col(text), F.lit(""))
    given = bounded_batches(docs).select(F.col(key).alias("k"), F.md5(clean).alias("same"), clean.alias("t"))
    return given.mapInArrow(sketch, f"k {kind}, same string, bands array<long>")


def hot_groups(rows: DataFrame, by: str) -> DataFrame:
    """The values of by that hold many of the rows; 1 / HOT_SHARE at most."""
    return written(rows.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > max(HOT_ROWS, HOT_SHARE * rows.count())).select(by), "hot")


def spread_join(rows: DataFrame, facts: DataFrame, by: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with facts, one per value of by: the rows of hot values stay where they are, and their facts are sent to them."""
    if hot.isEmpty():
        return rows.join(facts, by, how)
    known = F.broadcast(hot)
    here = rows.join(known, by, "left_semi").join(F.broadcast(facts.join(known, by, "left_semi")), by, how)
    there = rows.join(known, by, "left_anti").join(facts.join(known, by, "left_anti"), by, how)
    return here.unionByName(there)


def texts_of(nodes: DataFrame, texts: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """node and t, the text of each of the nodes."""
    clean = F.coalesce(F.col(text), F.lit(""))
    given = docs.select(F.col(key).alias("own"), F.md5(clean).alias("own_same"), clean.alias("t"))
    wanted = small(written(texts.select("node", "k", "same").join(nodes, "node", "left_semi"), "wanted"))
    return given.join(wanted, F.col("own").eqNullSafe(F.col("k")) & (F.col("own_same") == F.col("same"))).select("node", "t").dropDuplicates(["node"])


def similarities(pairs: DataFrame, texts: DataFrame, docs: DataFrame, weights: Weights, key: str, text: str) -> DataFrame:
    """a, b and the weighted Jaccard similarity of each pair of nodes. A node of many pairs has its text in several places."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    whole = written(texts_of(ends.distinct(), texts, docs, key, text), "pair_texts")
    copies = written(ends.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > max(HOT_ROWS, HOT_SHARE * 2 * pairs.count())).select("node", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("copies")), "copies")
    placed = whole.join(F.broadcast(copies), "node", "left").select("node", "t", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))

    def with_text(pairs: DataFrame, x: str, other: str) -> DataFrame:
        side = placed.select(F.col("node").alias(x), F.col("t").alias(f"t{x}"), "copy")
        many = F.broadcast(copies.select(F.col("node").alias(x), "copies"))
        return pairs.join(many, x, "left").withColumn("copy", F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies").join(side, [x, "copy"]).drop("copy")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ta"):
            n = part.num_rows
            (ta, ra, na), (tb, rb, nb) = shingles(part.column("ta")), shingles(part.column("tb"))
            text, run, times = np.concatenate([ta, tb]), np.concatenate([ra, rb]), np.concatenate([na, nb])
            order = np.lexsort((run, text))
            text, run, weight = text[order], run[order], (times * weights.of(run))[order]
            both = np.flatnonzero((text[1:] == text[:-1]) & (run[1:] == run[:-1]))
            common = np.bincount(text[both], np.minimum(weight[both], weight[both + 1]), n)
            total = np.bincount(text, weight, n)
            found = pa.array(np.where(total > common, common / np.maximum(total - common, 1e-12), 1.0))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), found], ["a", "b", "similarity"])

    return with_text(with_text(pairs, "a", "b"), "b", "a").select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long, similarity double")


def ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after links between nodes: labels of one component become its least."""
    a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    merged = connected_components(links.join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    moved = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
    named = spread_join(labels, moved, "label", hot_groups(labels, "label"), "left")
    return written(named.select("node", F.coalesce("to", "label").alias("label")), "labels")


def crowds(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bucket and node of small buckets (2 to CROWD texts); bucket, node and n, the bucket's texts, of larger ones.

    A larger bucket is also split by the samples of the next band, DEPTH - 1 times at most, so that texts which are
    alike meet in small buckets even where a crowd of loosely similar ones shares the first samples.
    """
    small_: list[DataFrame] = []
    large: list[DataFrame] = []
    rows = texts.select("node", F.posexplode("bands").alias("band", "value")).filter("value <> 0").select("node", "band", F.xxhash64("band", "value").alias("bucket"))
    for level in range(DEPTH):
        sizes = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
        hot = written(sizes.filter(F.col("n") > max(HOT_ROWS, HOT_SHARE * (sizes.agg(F.sum("n")).first()[0] or 0))).select("bucket"), "hot")
        found = written(spread_join(rows, sizes, "bucket", hot), "buckets")
        small_.append(found.filter(F.col("n") <= CROWD).select("bucket", "node"))
        more = found.filter(F.col("n") > CROWD)
        large.append(more.select("bucket", "node", "n"))
        if level + 1 < DEPTH:
            following = F.get("bands", F.pmod(F.col("band") + 1, F.lit(BANDS)))
            rows = more.select("bucket", "node", "band").join(texts, "node").select("node", F.pmod(F.col("band") + 1, F.lit(BANDS)).alias("band"), F.xxhash64("bucket", following).alias("bucket"))
    return reduce(DataFrame.union, small_), reduce(DataFrame.union, large)


def pivoted(large: DataFrame) -> DataFrame:
    """bucket, node and the bucket's pivot: the text that shares buckets with most others, as the one most are copies of."""
    degree = written(large.groupBy("node").agg(F.sum("n").alias("degree")), "degrees")
    pivot = written(large.join(degree, "node").groupBy("bucket").agg(F.max_by("node", F.struct("degree", "node")).alias("pivot")), "pivots")
    return spread_join(large.select("bucket", "node"), pivot, "bucket", hot_groups(large, "bucket"))


def elements(texts: pa.Array, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, element and weight: a shingle that comes m times is m elements, so common elements weigh the overlap."""
    text, run, times = shingles(texts)
    nth = np.arange(times.sum()) - np.repeat(bounds(times)[:-1], times)
    return np.repeat(text, times), mixed(np.repeat(run, times) ^ (nth.astype(np.uint64) * PRIME), 3), np.repeat(weights.of(run), times)


def order_bins(element: np.ndarray) -> np.ndarray:
    return (element >> np.uint64(44)).astype(np.int64)


def parities(n: int, text: np.ndarray, element: np.ndarray) -> np.ndarray:
    """PARITY words for each of n texts; each element flips one bit, so two texts differ in as many elements as bits at least."""
    out, bit = np.zeros(n * PARITY, np.uint64), element >> np.uint64(20) & np.uint64(64 * PARITY - 1)
    np.bitwise_xor.at(out, text * PARITY + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(n, PARITY).view(np.int64)


def rarity(texts: DataFrame, weights: Weights) -> np.ndarray:
    """How many of the texts (node, t) have an element of each bin."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_BINS, np.int64)
        for part in slices(batches, "t"):
            total += np.bincount(order_bins(elements(part.column("t"), weights)[1]), minlength=ORDER_BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bin", "n"])

    got = bounded_batches(texts).mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ORDER_BINS, np.int64)
    out[got["bin"].to_numpy()] = got["n"].to_numpy()
    return out


def prefixes(texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """node, total (weight), parity, before (weight of the elements before it) and element of each text's rarest elements.

    All texts have their elements in one order, by rarity and then by hash. A pair that reaches the similarity has that
    share of the heavier text's weight in common, so the first common element has as much from it on. Parities are of the
    rare shingles, whose weight is 1.
    """
    count = rarity(texts, weights)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            text, element, weight = elements(part.column("t"), weights)
            order = np.lexsort((element, count[order_bins(element)], text))
            text, element, weight = text[order], element[order], weight[order]
            total = np.bincount(text, weight, part.num_rows)
            sums = bounds(weight)
            before = sums[:-1] - sums[np.searchsorted(text, text)]
            rare = total[text] - before >= similarity * total[text] - 1e-6
            full = weight == 1
            parity = parities(part.num_rows, text[full], element[full])
            for at in np.array_split(np.flatnonzero(rare), rare.sum() // 16384 + 1):
                own, k = text[at], part.column("node").take(pa.array(text[at]))
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * PARITY, pa.int32()), pa.array(parity[own].ravel()))
                yield pa.RecordBatch.from_arrays([k, pa.array(total[own]), bits, pa.array(before[at]), pa.array(element[at].view(np.int64))], ["node", "total", "parity", "before", "element"])

    return bounded_batches(texts).mapInArrow(cut, "node long, total double, parity array<long>, before double, element long")


def across(many: DataFrame, labels: DataFrame, texts: DataFrame, docs: DataFrame, weights: Weights, key: str, text: str, similarity: float) -> DataFrame:
    """Distinct pairs a, b: of the texts in crowds of several classes, all of different classes that can reach the similarity.

    Of an element's texts, those of its largest class meet the others only, not one another.
    """
    spread = many.join(labels, "node").groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("bucket")
    crowd = written(spread_join(many.select("bucket", "node"), written(spread, "spread"), "bucket", hot_groups(many, "bucket")).select("node").distinct(), "crowd")
    rare = written(prefixes(written(texts_of(crowd, texts, docs, key, text), "crowd_texts"), weights, similarity).join(labels, "node"), "prefixes")
    classes = rare.groupBy("element", "label").agg(F.count("*").alias("c"))
    main = classes.groupBy("element").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("classes")).filter("classes > 1").select("element", "main")
    known = written(spread_join(rare, main, "element", hot_groups(rare, "element")), "shared_elements")
    side = lambda x: [F.col(c).alias(f"{c}{x}") for c in ("node", "total", "parity", "before", "label")]
    other = known.filter("label <> main").select("element", "main", *side("a"))
    met = other.join(known.select("element", *side("b")), "element").filter("labela <> labelb AND (labelb = main OR nodea < nodeb)")
    every = F.col("totala") + F.col("totalb")
    needed = similarity / (1 + similarity) * every - 1e-6  # weight in common
    behind = F.least(F.col("totala") - F.col("beforea"), F.col("totalb") - F.col("beforeb"))
    apart = reduce(Column.__add__, (F.bit_count(F.col("paritya")[i].bitwiseXOR(F.col("parityb")[i])) for i in range(PARITY)))
    return met.filter((behind >= needed) & (every - apart >= 2 * needed)).select(*ordered(F.col("nodea"), F.col("nodeb"))).distinct()


def classified(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """k and same of every document; and node, same, k (least key), times and label of every distinct text.

    Distinct texts are numbered in order of their least keys, so that the least node of a class has its least key.
    """
    weights = frequencies(docs, text)
    sketched = written(sketches(docs, weights, key, text), "sketches")
    distinct = sketched.groupBy("same").agg(F.min("k").alias("k"), F.first("bands").alias("bands"), F.count("*").alias("times"))
    order = [F.col("k").asc_nulls_last(), F.col("same")]
    texts = written(written(distinct, "distinct").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "texts")
    few, many = crowds(texts.select("node", "bands"))
    within = few.join(few.select("bucket", F.col("node").alias("o")), "bucket").filter("node < o").select(F.col("node").alias("a"), F.col("o").alias("b"))
    hubs = pivoted(many).filter("node <> pivot").select(*ordered(F.col("node"), F.col("pivot")))
    labels = texts.select("node", F.col("node").alias("label"))

    def linked(labels: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = written(similarities(written(pairs, "pairs"), texts, docs, weights, key, text), "similarities")
        return found.select("a", "b"), relabelled(labels, found.filter(F.col("similarity") >= similarity - 1e-9))

    tested, labels = linked(labels, within.union(hubs).distinct())  # all small buckets and the hubs
    _, labels = linked(labels, across(many, labels, texts, docs, weights, key, text, similarity).join(tested, ["a", "b"], "left_anti"))
    return sketched.select("k", "same"), written(texts.drop("bands").join(labels, "node"), "classified")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """key, class_id (the least key of the class) and text_id (the least key with an equal text) of every document."""
    every, texts = classified(docs, key, text, similarity)
    names = texts.filter("node = label").select("label", F.col("k").alias("class_id"))
    named = written(spread_join(texts, names, "label", hot_groups(texts, "label")).select("same", F.col("k").alias("text_id"), "class_id"), "named")
    return spread_join(every, named, "same", hot_groups(every, "same")).select(F.col("k").alias(key), "class_id", "text_id")


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the least key of each class, with its columns; one of them where a row is repeated."""
    _, texts = classified(docs, key, text)
    kept = small(texts.filter("node = label").select(F.col("k").alias("_own_k"), F.col("same").alias("_own_same"), (F.col("times") > 1).alias("_repeated")))
    found = docs.join(kept, F.col(key).eqNullSafe(F.col("_own_k")) & (F.md5(F.coalesce(F.col(text), F.lit(""))) == F.col("_own_same")))
    kept_columns = [F.col(f"`{c}`") for c in docs.columns]
    once = found.filter("NOT _repeated").select(*kept_columns)
    return once.union(found.filter("_repeated").dropDuplicates(["_own_same"]).select(*kept_columns))
