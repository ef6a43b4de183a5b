"""Vector search, similarity joins and clustering on cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators.dedup import connected_components, leaders
from quarrymill.operators.relations import quality_order, tiers
from quarrymill.operators.similarity import BLOCK, ROUNDING, grown, least_cosines, matrix, near_components, near_pairs, neighbours, spaced, top_k
from quarrymill.operators.tables import small, written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def face_pair_similarity(vectors: DataFrame, face: DataFrame) -> DataFrame:
    """vec_id, cosine similarity to one face (a row with q), and percent of the way from -1 to 1, whole and clamped."""
    s = F.round(cosine(F.col("q"), F.col("embedding")), 6)
    percent = F.least(F.greatest(F.floor((F.col("similarity") + 1) / 2 * 100), F.lit(0)), F.lit(100)).cast("int")
    return vectors.join(F.broadcast(face.select("q").limit(1))).select("vec_id", s.alias("similarity")).withColumn("percent", percent)


def unit(vectors: DataFrame) -> DataFrame:
    """vec_id, project_id and the normalised vector of those that aren't null or 0."""
    n = norm(F.col("embedding"))
    return vectors.filter("embedding IS NOT NULL").withColumn("_n", n).filter("_n > 0").select("vec_id", "project_id", F.transform("embedding", lambda x: x.cast("double") / F.col("_n")).alias("u"))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """query_id, vec_id, score, rank: the k most similar of the query's project (query_id, project_id, q) at threshold or more.

    Vectors lie in the leaves of a tree with radii; a query searches leaf after leaf, the most promising first, until
    its k-th score beats what the others can hold. Queries are dealt to leaves, not broadcast, and may be many.
    """
    asked = spaced(queries, "query_id", "q").withColumnRenamed("u", "q")
    return top_k(asked, grown(spaced(vectors), block), k, threshold, digits=6)[0]


def cosine_pairs(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """a < b and similarity of all pairs of a project at threshold or more: blocks of bounded size meet where they can hold one."""
    pairs = near_pairs(spaced(vectors), threshold - ROUNDING, block)
    return pairs.withColumn("similarity", F.round("similarity", 6)).filter(F.col("similarity") >= threshold)


def least_similarity(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """project_id and the least cosine of two of its vectors."""
    units = spaced(vectors)
    names = units.select("space", "project_id").distinct()
    return least_cosines(units, block).join(names, "space").groupBy("project_id").agg(F.round(F.min("low"), 6).alias("min_similarity"))


def uniqueness_redundancy(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per vector: neighbours, uniqueness 1 - greatest similarity (1 without any), redundancy n / (n + 1)."""
    both = pairs.select(F.col("a").alias("vec_id"), "similarity").union(pairs.select("b", "similarity"))
    per = both.groupBy("vec_id").agg(F.count("*").alias("neighbours"), F.max("similarity").alias("most"))
    n = F.coalesce("neighbours", F.lit(0))
    return vectors.select("vec_id").join(per, "vec_id", "left").select("vec_id", n.alias("neighbours"), F.round(1 - F.coalesce("most", F.lit(0.0)), 6).alias("uniqueness"), F.round(n / (n + 1), 6).alias("redundancy"))


def embedding_diversity(vectors: DataFrame) -> DataFrame:
    """Per project: mean and deviation of the pairwise cosines from sums alone, their least, the mean deviation of the
    dimensions, diversity (0 to 100) and its assessment.

    With S the sum of the n unit vectors, the cosines sum to (|S|^2 - n) / 2; their squares to (|X'X|^2 - n) / 2.
    """
    u = unit(vectors).select("project_id", "vec_id", F.posexplode("u").alias("i", "x"))
    n = vectors.groupBy("project_id").agg(F.count("*").alias("n"))
    s2 = u.groupBy("project_id", "i").agg(F.sum("x").alias("s")).groupBy("project_id").agg(F.sum(F.col("s") * F.col("s")).alias("s2"))

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for project, part in rows.groupby("project_id"):
                x = np.stack(part["u"])
                g = x.T @ x
                i, j = np.indices(g.shape)
                yield pd.DataFrame({"project_id": project, "i": i.ravel(), "j": j.ravel(), "g": g.ravel()})

    g2 = unit(vectors).select("project_id", "u").mapInPandas(gram, "project_id long, i int, j int, g double").groupBy("project_id", "i", "j").agg(F.sum("g").alias("g")).groupBy("project_id").agg(F.sum(F.col("g") * F.col("g")).alias("g2"))
    spread = u.groupBy("project_id", "i").agg(F.stddev_pop("x").alias("sd")).groupBy("project_id").agg(F.round(F.avg("sd"), 6).alias("spread"))
    j = n.join(s2, "project_id").join(g2, "project_id").join(spread, "project_id").join(least_similarity(vectors), "project_id").filter("n > 1")
    pairs = F.col("n") * (F.col("n") - 1)
    mean = (F.col("s2") - F.col("n")) / pairs
    deviation = F.sqrt(F.greatest(F.lit(0.0), (F.col("g2") - F.col("n")) / pairs - mean * mean))
    diversity = F.least(F.greatest(F.floor((1 - mean) * 200), F.lit(0)), F.lit(100)).cast("int")
    assessment = F.when(diversity >= 60, "excellent").when(diversity >= 40, "good").when(diversity >= 25, "moderate").otherwise("low")
    return j.select("project_id", "n", F.round(mean, 6).alias("mean_similarity"), F.round(deviation, 6).alias("sd_similarity"), "min_similarity", "spread", diversity.alias("diversity"), assessment.alias("assessment"))


def embedding_regions(vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """project_id and regions: leaders of a scan in vec_id order that takes what is above threshold; lone vectors lead."""
    pairs = written(cosine_pairs(vectors, threshold).filter(F.col("similarity") > threshold), "pairs")
    led = leaders(pairs).filter("node <> leader").select(F.col("node").alias("vec_id")).distinct()
    return unit(vectors).join(led, "vec_id", "left_anti").groupBy("project_id").agg(F.count("*").alias("regions"))


def identity_consistency(vectors: DataFrame, references: DataFrame, low: float = 0.3) -> DataFrame:
    """Per project, similarities to its reference vector (project_id, q): mean, least, greatest, and how many are low."""
    s = vectors.join(small(references), "project_id").select("project_id", F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("s"))
    return s.groupBy("project_id").agg(F.round(F.avg("s"), 5).alias("mean"), F.min("s").alias("least"), F.max("s").alias("greatest"), F.count_if(F.col("s") < low).alias("outliers"))


def cluster_centroids(vectors: DataFrame) -> DataFrame:
    """label, i, value: components of the mean of each label's unit vectors, at length 1 again."""
    u = vectors.select("label", F.posexplode(F.transform("embedding", lambda x: x.cast("double") / norm(F.col("embedding")))).alias("i", "x"))
    mean = u.groupBy("label", "i").agg(F.avg("x").alias("m"))
    length = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("l"))
    return mean.join(length, "label").filter("l > 0").select("label", "i", F.round(F.col("m") / F.col("l"), 6).alias("value"))


def merge_identities(assets: DataFrame, merges: DataFrame) -> DataFrame:
    """Identities after merges (source, target), chains included: each is named by the least name it is merged with."""
    labels = connected_components(merges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    moved = assets.filter("identity_cluster_id IS NOT NULL").join(small(labels), F.col("identity_cluster_id") == F.col("node"), "left")
    return moved.groupBy(F.coalesce("label", "identity_cluster_id").alias("identity")).agg(F.count("*").alias("n"), F.sum("face_count").alias("faces"))


#: A request's labels or prompts, at most: their vectors go to the tasks with the code.
MOST_LABELS = 10_000


def label_cosines(vectors: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """vec_id, name and s: the cosine of each vector with each of a request's labels (name, q), by products of Arrow
    batches with the matrix of labels. It is 0 where a norm is 0, and NULL for NULL vectors and those of another length."""
    rows = labels.select(name, F.col("q").cast("array<double>").alias("q")).orderBy(name).limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"a request has at most {MOST_LABELS} labels")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    sizes = {}
    for i, r in enumerate(rows):
        sizes.setdefault(len(r.q), []).append(i)
    unit_of = {n: np.array([rows[i].q for i in own], float) / np.maximum(np.linalg.norm(np.array([rows[i].q for i in own], float), axis=1, keepdims=True), 1e-300) for n, own in sizes.items() if n}

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("x").value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            out = np.full((batch.num_rows, len(rows)), np.nan)
            for n, own in unit_of.items():
                at = np.flatnonzero(lengths == n)
                if len(at):
                    x = batch.column("x").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                    out[np.ix_(at, sizes[n])] = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ own.T
            flat = pa.array(out.ravel(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(rows), pa.int32()), flat)], ["vec_id", "s"])

    scored = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).mapInArrow(multiply, f"vec_id {kind}, s array<double>")
    names = F.array(*(F.lit(r[0]) for r in rows)) if rows else F.array().cast(f"array<{labels.schema[name].dataType.simpleString()}>")
    return scored.select("vec_id", F.explode(F.arrays_zip(names.alias("label"), "s")).alias("x")).select("vec_id", F.col("x.label").alias(name), F.col("x.s").alias("s"))


def zero_shot_tags(vectors: DataFrame, labels: DataFrame, scale: float = 10.0, least: float = 0.05, most: int = 5) -> DataFrame:
    """vec_id, tag, p, rank: softmax of scaled cosines to the label vectors (tag, q), best first."""
    own = Window.partitionBy("vec_id")
    p = label_cosines(vectors, labels, "tag").withColumn("e", F.exp(scale * F.col("s"))).withColumn("p", F.round(F.col("e") / F.sum("e").over(own), 6))
    return p.withColumn("rank", F.row_number().over(own.orderBy(F.desc("p"), "tag"))).filter((F.col("rank") <= most) & (F.col("p") > least)).select("vec_id", "tag", "p", "rank")


def scene_tags(vectors: DataFrame, labels: DataFrame, scale: float = 1.0, most: int = 5) -> DataFrame:
    """vec_id with what each group of a request's labels (grp, tag, q) says, by a softmax of cosines within the group.

    Groups are scene (scene_class, scene_tags above .05), place (is_indoor), light (lighting_tags, three at most above
    .1), object (object_tags from .08) and background (clutter and plain). Ties go by tag; a group without labels gives
    null or no tags. The labels travel as one row beside each vector, so nothing is shuffled.
    """
    one = labels.agg(F.array_sort(F.collect_list(F.struct("grp", "tag", "q"))).alias("_labels"))
    nothing = F.array().cast("array<struct<e:double,tag:string>>")

    def ranked(group: str) -> Column:
        def add(so_far: Column, label: Column) -> Column:
            e = F.exp(scale * cosine(label["q"], F.col("embedding")))
            return F.struct((so_far["total"] + e).alias("total"), F.array_append(so_far["all"], F.struct(e.alias("e"), label["tag"].cast("string").alias("tag"))).alias("all"))

        start = F.struct(F.lit(0.0).alias("total"), nothing.alias("all"))
        share = lambda s: F.array_sort(F.transform(s["all"], lambda x: F.struct((-F.round(x["e"] / s["total"], 6)).alias("p"), x["tag"].alias("tag"))))
        return F.aggregate(F.filter("_labels", lambda x: x["grp"] == group), start, add, share)

    tags = lambda c, n, least: F.array_join(F.transform(F.filter(F.slice(c, 1, n), least), lambda x: x["tag"]), ",")
    top = lambda c: F.get(F.col(c), F.lit(0))["tag"]
    scored = vectors.join(F.broadcast(one)).select("vec_id", *(ranked(g).alias(g) for g in ("scene", "place", "light", "object", "background")))
    clutter = F.get(F.filter("background", lambda x: F.contains(x["tag"], F.lit("cluttered"))), F.lit(0))["p"]
    return scored.select(
        "vec_id", top("scene").alias("scene_class"), tags("scene", most, lambda x: x["p"] < -0.05).alias("scene_tags"), (top("place") == "indoor scene").alias("is_indoor"), tags("light", 3, lambda x: x["p"] < -0.1).alias("lighting_tags"),
        tags("object", most, lambda x: x["p"] <= -0.08).alias("object_tags"), F.round(F.coalesce(-clutter, F.lit(0.0)), 3).alias("clutter"), F.coalesce(top("background").rlike("plain|gradient"), F.lit(False)).alias("plain"),
    )


def prompt_contrast(vectors: DataFrame, prompts: DataFrame) -> DataFrame:
    """vec_id, contrast and score: mean cosine to positive prompts less that to negative ones (positive, q)."""
    s = label_cosines(vectors, prompts, "positive")
    d = s.groupBy("vec_id").agg(F.round(F.avg(F.when(F.col("positive"), F.col("s"))) - F.avg(F.when(~F.col("positive"), F.col("s"))), 6).alias("contrast"))
    return d.withColumn("score", F.least(F.greatest(F.floor((F.col("contrast") + 0.3) / 0.6 * 100), F.lit(0)), F.lit(100)).cast("int"))


#: Vectors of a space in the first step of a scan, about; each further step takes three times as many as all before it.
FIRST = 4 * BLOCK


def leader_clusters(vectors: DataFrame, threshold: float, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """node, leader and similarity to it, as a scan in vec_id order finds them; nodes without neighbours are left out.

    The scan goes by steps, each a range of ids: first its vectors are held against all leaders so far, then those that
    none of these leads are paired with each other. Pairs of two vectors that are led are never made.
    """
    units = written(spaced(vectors), "units")
    most = units.groupBy("space").count().agg(F.max("count")).first()[0] or 0
    cuts = [4.0**-k for k in range(max(1, int(np.ceil(np.log(max(most / first, 1)) / np.log(4) - 1e-9))), 0, -1)] if most > first else []
    step = F.size(F.filter("bounds", lambda x: x < F.col("vec_id"))) if cuts else F.lit(0)
    bounds = units.groupBy("space").agg(F.percentile_approx("vec_id", cuts or [0.5], 1000).alias("bounds"))
    placed = written(units.join(small(bounds), "space").select(*units.columns, step.alias("step")), "placed")
    near = lambda df, mark=None: near_pairs(df, threshold - ROUNDING, block, mark).withColumn("similarity", F.round("similarity", 6)).filter(F.col("similarity") >= threshold)
    found = leading = None
    for k in range(len(cuts) + 1):
        own = placed.filter(F.col("step") == k).drop("step")
        if leading is not None:
            pairs = near(own.withColumn("new", F.lit(True)).unionByName(leading.withColumn("new", F.lit(False))), "new")
            led = written(pairs.groupBy(F.col("b").alias("node")).agg(F.min_by(F.struct("a", "similarity"), "a").alias("l")).select("node", F.col("l.a").alias("leader"), "l.similarity"), "led")
            own = own.join(led.select(F.col("node").alias("vec_id")), "vec_id", "left_anti")
            found = found.unionByName(led)
        own = written(own, "open")
        pairs = written(near(own), "pairs")
        some = leaders(pairs).filter("member").select("node", "leader")
        led = written(some.join(pairs.select(F.col("a").alias("leader"), F.col("b").alias("node"), "similarity"), ["leader", "node"]).select("node", "leader", "similarity"), "led")
        found = led if found is None else found.unionByName(led)
        leads = own.join(led.select(F.col("node").alias("vec_id")), "vec_id", "left_anti")
        leading = written(leads if leading is None else leading.unionByName(leads), "leading")
    return found.unionByName(found.select(F.col("leader").alias("node"), "leader", F.lit(1.0).alias("similarity")).distinct())


def identity_dbscan(vectors: DataFrame, eps: float, min_samples: int = 2, block: int = BLOCK) -> DataFrame:
    """vec_id and cluster (least core of its component; NULL for noise): density clusters at cosine distance eps.

    Neighbours are counted and joined where blocks meet: of the pairs of cores, a task gives only links that join the same
    components. All pairs are made only of vectors that aren't cores, which have few.
    """
    units, least = written(spaced(vectors), "units"), 1 - eps
    marked = None
    if min_samples > 2:
        core = written(neighbours(units, least, block).filter(F.col("n") + 1 >= min_samples).select("vec_id"), "cores")
        marked = units.join(core.withColumn("core", F.lit(True)), "vec_id", "left").withColumn("core", F.coalesce("core", F.lit(False))).select(*units.columns, "core")
    links = written(near_components(units if marked is None else marked, least, block, marked and "core"), "links")
    if marked is None:
        return vectors.select("vec_id").join(connected_components(links).select(F.col("node").alias("vec_id"), F.col("label").alias("cluster")), "vec_id", "left")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    inner = links.join(core.withColumnRenamed("vec_id", "a"), "a").join(core.withColumnRenamed("vec_id", "b"), "b")
    named = core.join(connected_components(inner).withColumnRenamed("node", "vec_id"), "vec_id", "left").select("vec_id", F.coalesce("label", "vec_id").alias("cluster"))
    border = both.join(named.withColumnRenamed("vec_id", "b"), "b").join(core.withColumnRenamed("vec_id", "a"), "a", "left_anti").groupBy(F.col("a").alias("vec_id")).agg(F.min("cluster").alias("cluster"))
    return vectors.select("vec_id").join(named.unionByName(border), "vec_id", "left")


def merged(clusters: DataFrame, links: DataFrame) -> DataFrame:
    """clusters (space, project_id, node, n, total) after links (a, b: b goes into a; no cluster is in two of them)."""
    one, two = (clusters.select(F.col("node").alias(x), *(("space", "project_id") if x == "a" else ()), F.col("n").alias(f"n_{x}"), F.col("total").alias(f"total_{x}")) for x in "ab")
    both = links.join(one, "a").join(two, "b").select("space", "project_id", F.col("a").alias("node"), (F.col("n_a") + F.col("n_b")).alias("n"), F.zip_with("total_a", "total_b", lambda x, y: x + y).alias("total"))
    ends = links.select(F.explode(F.array("a", "b")).alias("node"))
    return clusters.join(ends, "node", "left_anti").select(*both.columns).unionByName(both)


def named(keep: DataFrame, links: DataFrame) -> DataFrame:
    """keep (vec_id, cluster) with the clusters (a) that links (a, b) give theirs (b)."""
    to = links.select(F.col("b").alias("cluster"), F.col("a").alias("to"))
    return keep.join(to, "cluster", "left").select("vec_id", F.coalesce("to", "cluster").alias("cluster"))


#: Clusters of a space that one task merges to the end, at most: it holds their sums, and products of a slice with them.
FEW, SLICE = 16384, 512


def nearest_of(rows: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of mean, the row of the greatest product with it, of equal ones the first, and the product; never the row itself."""
    best, value = np.zeros(len(rows), np.int64), np.full(len(rows), -np.inf)
    if len(mean) > 1:
        for i in range(0, len(rows), SLICE):
            part = rows[i : i + SLICE]
            s = np.round(mean[part] @ mean.T, 12)
            s[np.arange(len(part)), part] = -np.inf
            best[i : i + SLICE] = s.argmax(axis=1)
            value[i : i + SLICE] = s.max(axis=1)
    return best, value


def linked(total: np.ndarray, n: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For clusters, given by sums and numbers in order of their names, those that went into another one at last, and that one: in rounds
    all pairs merge that are each other's most similar, at least or more. A cluster without one so near is done."""
    at, up = np.arange(len(n)), np.arange(len(n))
    total, n = total.copy(), n.astype(np.float64)
    real = np.linalg.norm(total, axis=1) > 1e-12
    at, total, n = at[real], total[real], n[real]
    mean = total / n[:, None]
    best, value = nearest_of(np.arange(len(at)), mean)
    while True:
        rows = np.flatnonzero(value >= least)
        low = rows[(best[best[rows]] == rows) & (rows < best[rows])]
        if not len(low):
            break
        high = best[low]
        total[low] += total[high]
        n[low] += n[high]
        mean[low] = total[low] / n[low][:, None]
        up[at[high]] = at[low]
        on = value >= least
        on[high] = False
        on[low] = np.linalg.norm(total[low], axis=1) > 1e-12
        fresh = np.zeros(len(at), bool)
        fresh[low] = True
        stale = fresh | fresh[best] | ~on[best]
        place = np.cumsum(on) - 1
        at, total, n, mean, best, value, fresh, stale = at[on], total[on], n[on], mean[on], place[best[on]], value[on], np.flatnonzero(fresh[on]), stale[on]
        again = np.flatnonzero(stale)
        best[again], value[again] = nearest_of(again, mean)
        if len(fresh):  # equal similarities go to the least, also where a merge made them equal
            others = np.flatnonzero(~stale)
            for i in range(0, len(others), SLICE):
                part = others[i : i + SLICE]
                s = np.round(mean[part] @ mean[fresh].T, 12)
                first, most = fresh[s.argmax(axis=1)], s.max(axis=1)
                won = (most > value[part]) | ((most == value[part]) & (first < best[part]))
                best[part[won]], value[part[won]] = first[won], most[won]
    moved = np.flatnonzero(up != np.arange(len(up)))
    while (up[up] != up).any():
        up = up[up]
    return moved, up[moved]


def finished(clusters: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that bring each cluster into its last one, for spaces of few clusters, each in one task."""

    def finish(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        names = rows.column("node").to_numpy()
        b, a = linked(matrix(rows.column("total")), rows.column("n").to_numpy(), least)
        return pa.table({"a": names[a], "b": names[b]})

    return clusters.groupBy("space").applyInArrow(finish, "a long, b long")


def identity_clusters(vectors: DataFrame, distance: float = 0.6, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """vec_id and cluster (its least member): average linkage at cosine distance, at every size by the same merges.

    The mean cosine of two clusters is the product of their mean vectors, so a cluster is its number and sum. Each round
    finds every cluster's most similar other one, by an exact search; two that are each other's, nearer than distance,
    merge. With average linkage these are merges that the sequential order would make too, as no merge brings
    a third cluster nearer; so a cluster with none that near is done and searched no more. Equal similarities go to the
    least pair. Copies of a vector are one cluster from the start. Rounds are jobs over all clusters of the spaces that
    have more than few; what is left of a space then goes on in one task, by the same rounds.
    """
    least = 1 - distance + 1e-12
    units = written(spaced(vectors), "units")
    nodes = units.groupBy("space", "u").agg(F.first("project_id").alias("project_id"), F.min("vec_id").alias("node"), F.count("*").alias("n"))
    clusters = written(nodes.select("space", "project_id", "node", F.col("n"), F.transform("u", lambda x: x * F.col("n")).alias("total")), "clusters")
    keep = written(units.select("space", "u", "vec_id").join(nodes.select("space", "u", "node"), ["space", "u"]).select("vec_id", F.col("node").alias("cluster")), "named")
    while True:
        sizes = written(clusters.groupBy("space").agg(F.count("*").alias("n")).filter(F.col("n") > few).select("space"), "sizes")
        if sizes.isEmpty():
            return named(keep, written(finished(clusters, least), "links"))
        length = F.sqrt(dot(F.col("total"), F.col("total")))
        large = clusters.join(small(sizes), "space", "left_semi")
        means = large.withColumn("_l", length).filter("_l > 1e-12").select("space", "project_id", F.col("node").alias("vec_id"), F.transform("total", lambda x: x / F.col("_l")).alias("u"), (F.col("_l") / F.col("n")).alias("scale"))
        asked = means.select(F.col("vec_id").alias("query_id"), "space", F.col("u").alias("q"), "scale")
        nearest = written(top_k(asked, grown(means, block), 1, least, others_only=True, digits=12)[0].select(F.col("query_id").alias("x"), F.col("vec_id").alias("y")), "nearest")
        back = nearest.select(F.col("y").alias("x"), F.col("x").alias("y"))
        links = written(nearest.join(back, ["x", "y"]).filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")), "links")
        others = clusters.join(small(sizes), "space", "left_anti")
        if not links.isEmpty():
            others = others.unionByName(merged(large.join(nearest.select(F.col("x").alias("node")), "node", "left_semi"), links))
        clusters = written(others, "clusters")
        keep = written(named(keep, links), "named")


def primary_vectors(faces: DataFrame) -> DataFrame:
    """One vector of each asset, that of its least face_index (ties: least vec_id), as vec_id, with asset_id and face_index."""
    first = faces.filter("embedding IS NOT NULL").groupBy("project_id", "asset_id").agg(F.min_by(F.struct("vec_id", "embedding", "face_index"), F.struct("face_index", "vec_id")).alias("f"))
    return first.select("project_id", "asset_id", "f.vec_id", "f.face_index", "f.embedding")


def face_duplicates(faces: DataFrame, assets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """asset_id, cluster, representative and similarity to it (NULL for itself): assets whose primary faces are near a leader.

    A scan over primary vectors by face_index, then asset_id, where each free one leads its free neighbours at threshold
    or more. The representative is the best asset of the cluster, as in best_per_cluster.
    """
    primary = written(primary_vectors(faces), "primary")
    units = spaced(primary.select("project_id", F.col("asset_id").alias("vec_id"), "embedding"))
    near = written(near_pairs(units, threshold - ROUNDING, block).filter(F.round("similarity", 6) >= threshold), "pairs")
    place = primary.select(F.col("asset_id").alias("id"), F.struct("face_index", "asset_id").alias("node"))
    ordered = near.join(place.select(F.col("id").alias("a"), F.col("node").alias("x")), "a").join(place.select(F.col("id").alias("b"), F.col("node").alias("y")), "b")
    led = leaders(ordered.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).filter("member OR led")
    found = written(led.select(F.col("node.asset_id").alias("asset_id"), F.col("leader.asset_id").alias("cluster")), "led")
    best = found.join(assets, "asset_id").groupBy("cluster").agg(F.max_by("asset_id", quality_order()).alias("representative"))
    u = units.select(F.col("vec_id").alias("asset_id"), "u")
    own = found.join(best, "cluster").join(u, "asset_id").join(u.select(F.col("asset_id").alias("representative"), F.col("u").alias("q")), "representative")
    similarity = F.when(F.col("asset_id") != F.col("representative"), F.round(dot(F.col("u"), F.col("q")), 6))
    return own.select("asset_id", "cluster", "representative", similarity.alias("similarity"))


def asset_identities(faces: DataFrame, clusters: DataFrame, assets: DataFrame) -> DataFrame:
    """asset_id, cluster, label, asset_count, representative: each asset has the cluster of its first face; clusters are
    named Person 1, 2, ... in their project by falling number of assets (ties: least cluster)."""
    named = faces.join(clusters, "vec_id").groupBy("project_id", "asset_id").agg(F.min_by("cluster", F.struct("face_index", "vec_id")).alias("cluster"))
    sizes = named.join(assets.drop("project_id"), "asset_id").groupBy("project_id", "cluster").agg(F.count("*").alias("asset_count"), F.max_by("asset_id", quality_order()).alias("representative"))
    ranked = tiers(sizes.withColumn("asset_id", F.col("cluster")), F.col("asset_count")).select("project_id", "cluster", "asset_count", "representative", F.concat(F.lit("Person "), F.col("rank")).alias("label"))
    return named.join(ranked, ["project_id", "cluster"]).select("asset_id", "project_id", "cluster", "label", "asset_count", "representative")


def index_backfill(assets: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per project: assets, those with a vector, and those still to be indexed."""
    have = vectors.select(F.col("vec_id").alias("asset_id")).distinct()
    todo = assets.join(have, "asset_id", "left_anti").groupBy("project_id").agg(F.count("*").alias("todo"))
    return assets.groupBy("project_id").agg(F.count("*").alias("total")).join(todo, "project_id", "left").fillna(0, ["todo"]).withColumn("indexed", F.col("total") - F.col("todo"))
