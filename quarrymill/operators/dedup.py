"""Layered duplicate detection: equal content, perceptual hashes, vectors, faces; each stage sees what is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.tables import written


def connected_components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of the nodes in links (a, b). Copied or circular links do no harm.

    Each round points every node to its least neighbour, jumps once, and contracts the links; hubs are aggregated
    before they are shuffled, so a component may hold any share of the nodes.
    """
    edges, labels = links.select("a", "b").filter("a <> b"), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "parent")
        if parent.isEmpty():
            return links.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0) if labels is None else labels
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("label"))
        step = written(parent.join(up, "p").select(F.col("a").alias("node"), "label"), "step")
        if labels is None:
            labels = step
        else:
            move = step.select(F.col("node").alias("label"), F.col("label").alias("to"))
            labels = written(labels.join(move, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        a, b = (step.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        edges = written(edges.join(a, "a").join(b, "b").filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")


def dup_exact(assets: DataFrame) -> DataFrame:
    """Assets of content hashes that come twice or more in their project: cluster is the least asset. The hash of a hot
    group is aggregated before it is joined."""
    groups = assets.filter("sha256_hash IS NOT NULL").groupBy("project_id", "sha256_hash").agg(F.min("asset_id").alias("cluster"), F.count("*").alias("n")).filter("n > 1")
    return assets.join(groups, ["project_id", "sha256_hash"]).select("project_id", "asset_id", "cluster", "n")


def hash_value(hex_: Column) -> Column:
    """A hash of up to 16 hex digits as a number; NULL for anything else."""
    return F.when(F.regexp_like(hex_, F.lit("^[0-9a-fA-F]{1,16}$")), F.conv(hex_, 16, -10).cast("long"))


def phash_pairs(assets: DataFrame, distance: int = 8) -> DataFrame:
    """project_id, h1 < h2 and d: distinct hashes of a project at most distance bits apart, all of them.

    With distance // 2 + 1 bands of the 64 bits, one band of such a pair differs in one bit at most: hashes meet by
    equal bands, one side with its one-bit flips.
    """
    bands = distance // 2 + 1
    width = -(-64 // bands)
    hashes = assets.select("project_id", hash_value(F.col("phash")).alias("h")).filter("h IS NOT NULL").distinct()
    band = lambda i: F.shiftrightunsigned("h", i * width).bitwiseAND(F.lit((1 << min(width, 64 - i * width)) - 1))
    keyed = hashes.select("project_id", "h", F.posexplode(F.array(*(band(i) for i in range(bands)))).alias("band", "v"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k) for k in range(width)))
    probes = keyed.select("project_id", F.col("h").alias("h2"), "band", F.explode(F.transform(flips, lambda f: F.col("v").bitwiseXOR(f))).alias("v"))
    met = keyed.withColumnRenamed("h", "h1").join(probes, ["project_id", "band", "v"]).filter("h1 < h2")
    return met.withColumn("d", F.bit_count(F.col("h1").bitwiseXOR(F.col("h2")))).filter(F.col("d") <= distance).select("project_id", "h1", "h2", "d").distinct()


def dup_phash(assets: DataFrame, distance: int = 8) -> DataFrame:
    """project_id, asset_id and cluster (least asset): the transitive closure of near hashes. Copies of a hash are one node."""
    nodes = assets.withColumn("h", hash_value(F.col("phash"))).filter("h IS NOT NULL").groupBy("project_id", "h").agg(F.min("asset_id").alias("first"), F.count("*").alias("n"))
    pairs = phash_pairs(assets, distance)
    one, two = (nodes.select("project_id", F.col("h").alias(f"h{i}"), F.col("first").alias(x)) for i, x in ((1, "a"), (2, "b")))
    labels = connected_components(pairs.join(one, ["project_id", "h1"]).join(two, ["project_id", "h2"]).select("a", "b"))
    named = nodes.join(labels, F.col("first") == F.col("node"), "left").select("project_id", "h", F.coalesce("label", "first").alias("cluster"), (F.col("n") > 1).alias("copied"), F.col("label").isNotNull().alias("linked"))
    return assets.withColumn("h", hash_value(F.col("phash"))).join(named, ["project_id", "h"]).filter("copied OR linked").select("project_id", "asset_id", "cluster")


def dup_layered(assets: DataFrame, distance: int = 8, links: DataFrame | None = None, face_links: DataFrame | None = None, faces: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """asset_id, cluster and type: exact, then perceptual, then vector links and face links (a, b) by leaders, each on the
    rest. faces, instead of face_links, gives asset_id and cluster of the assets (asset_id) that are left to it."""
    live = assets.filter("NOT is_rejected")
    done = written(dup_exact(live).select("asset_id", "cluster").withColumn("type", F.lit("exact")), "exact")
    rest = live.join(done, "asset_id", "left_anti")
    done = done.union(written(dup_phash(rest, distance).select("asset_id", "cluster").withColumn("type", F.lit("phash")), "phash"))
    for kind, pairs in (("embedding", links), ("face", face_links)):
        if pairs is None:
            continue
        ids = live.select("asset_id").join(done, "asset_id", "left_anti")
        inside = pairs.join(ids.withColumnRenamed("asset_id", "a"), "a").join(ids.withColumnRenamed("asset_id", "b"), "b")
        led = leaders(inside).filter("member OR led")
        done = done.union(written(led.select(F.col("node").alias("asset_id"), F.col("leader").alias("cluster"), F.lit(kind).alias("type")), kind))
    if faces:
        rest = written(live.select("asset_id").join(done, "asset_id", "left_anti"), "rest")
        done = done.union(faces(rest).select("asset_id", "cluster", F.lit("face").alias("type")))
    return done


def leaders(links: DataFrame) -> DataFrame:
    """node, leader, member, led: what a scan in node order would find, where each free node leads its free neighbours.

    A node leads if no lesser neighbour leads; it joins its least leading neighbour otherwise. Each round settles every
    node whose lesser neighbours are all settled.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neighbours")
    open_ = both.select(F.col("a").alias("node")).distinct()
    settled = open_.select("node", F.col("node").alias("leader")).limit(0)
    while not open_.isEmpty():
        lesser = both.filter("b < a").join(open_.select(F.col("node").alias("a")), "a")
        state = settled.select(F.col("node").alias("b"), F.col("leader"))
        seen = lesser.join(state, "b", "left").groupBy("a").agg(F.min(F.when(F.col("leader") == F.col("b"), F.col("b"))).alias("by"), F.count_if(F.col("leader").isNull()).alias("waiting"), F.min(F.when(F.col("leader").isNull(), F.col("b"))).alias("first_open"))
        joined = open_.join(seen.withColumnRenamed("a", "node"), "node", "left")
        # a lesser open neighbour might still turn out to be the least leader
        now = joined.filter((F.coalesce("waiting", F.lit(0)) == 0) | (F.col("by") < F.col("first_open"))).select("node", F.coalesce("by", "node").alias("leader"))
        settled = written(settled.union(now), "settled")
        open_ = written(open_.join(settled, "node", "left_anti"), "open")
    led = settled.filter("node <> leader").select(F.col("leader").alias("node")).distinct().withColumn("led", F.lit(True))
    return settled.join(led, "node", "left").select("node", "leader", (F.col("node") != F.col("leader")).alias("member"), F.coalesce("led", F.lit(False)).alias("led"))
