"""Exact similarity joins and searches over unit vectors: a tree of cells with pivots, bounded by the triangle inequality.

Vectors of one project and length are a space. A space's cell with more than a block of vectors is dealt to pivots drawn
from it, by the nearest, and again, until a cell has a block at most; what pivots can't part (such as copies) is cut by
hash. Each leaf is one row: its ids and vectors as bytes, its centre and radius, as angles. Angles are a metric, so of
two cells with centres at angle d and radii r and s no pair is nearer than d - r - s or farther than d + r + s. Joins and
searches go down the tree in rounds of DataFrame joins over cells that can hold a result, and multiply matrices of
vectors only for leaves that are left, where each vector is first held against the other leaf's bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators.tables import small, written

#: Vectors in a leaf, pivots of a cell at most, rounds of parting at most, and queries that meet a leaf in one task.
BLOCK, FANOUT, DEPTH, AT_ONCE = 2048, 32, 5, 4096
#: Leaves that go to a task from one side, at most, and links that a task holds before it joins them.
GROUP, HELD = 16, 1 << 20
#: What an angle or cosine in double precision may be off by.
SLACK = 1e-6
#: Similarities are rounded to six digits before they are held against a threshold, so those up to half a digit below it count.
ROUNDING = 5.1e-7


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length."""
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def angle(a: Column, b: Column) -> Column:
    """NULL where either is (least and greatest pass over NULLs)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.acos(F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(1.0))))


def spaced(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """space, project_id, the key, u (the vector at length 1) and scale (1): vectors that are null or 0, or have no project, are left out."""
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("project_id", key)}

    def normalise(batches):
        for batch in batches:
            sizes = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                x = matrix(pa.chunked_array([part.column("x")]))
                norm = np.linalg.norm(x, axis=1) if size else np.zeros(part.num_rows)
                real = np.isfinite(norm) & (norm > 0)
                part, unit = part.filter(pa.array(real)), x[real] / norm[real][:, None] if size else x[:0]
                if part.num_rows:
                    space = pa.array([f"{p}:{size}" for p in part.column("project_id").to_pylist()])
                    yield pa.RecordBatch.from_arrays([space, part.column("project_id"), part.column(key), lists(unit), pa.array(np.ones(len(unit)))], ["space", "project_id", key, "u", "scale"])

    given = vectors.filter(F.col(vector).isNotNull() & F.col("project_id").isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull())).select("project_id", key, F.col(vector).cast("array<double>").alias("x"))
    return given.mapInArrow(normalise, f"space string, project_id {kinds['project_id']}, {key} {kinds[key]}, u array<double>, scale double")


@dataclass
class Tree:
    """nodes: space, level, parent, node, center, radius of the cells below each level; leaves: the same with the leaf's
    rows (n, ids, vecs, scales as bytes, low and high of the scales), whose parent is their cell."""

    nodes: list[DataFrame]
    leaves: DataFrame

    @property
    def outlines(self) -> DataFrame:
        return self.leaves.drop("ids", "vecs", "scales")


def part_once(placed: DataFrame, block: int, level: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The vectors that stay in their cells, those dealt to new cells, and the new cells; None if every cell is small."""
    sizes = placed.groupBy("space", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    sizes = written(sizes.select("space", "cell", "n", F.least(F.lit(FANOUT), F.ceil(2 * F.col("n") / block)).cast("int").alias("k"), F.ceil(F.col("n") / (8 * block)).cast("int").alias("subs")), "cells")
    if sizes.isEmpty():
        return None
    by = ["space", "cell"]
    order = Window.partitionBy(*by).orderBy(F.xxhash64("vec_id", F.lit(level)), "vec_id")
    drawn = placed.join(sizes, by).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= FANOUT).filter(F.col("at") <= F.col("k"))
    pivots = written(drawn.select(*by, "at", "u", "subs"), "pivots")
    dealt = placed.join(sizes, by).select("space", "cell", "project_id", "vec_id", "u", "scale", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int").alias("sub"))
    known = pivots.select(*by, "at", "u", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}

    def nearest(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table({c: pa.array([], t) for c, t in (("space", pa.string()), ("cell", pa.string()), ("project_id", rows.schema.field("project_id").type), ("vec_id", rows.schema.field("vec_id").type), ("u", pa.list_(pa.float64())), ("scale", pa.float64()), ("parent", pa.string()), ("off", pa.float64()))})
        pivots = pivots.sort_by("at")
        cosines = matrix(rows.column("u")) @ matrix(pivots.column("u")).T
        best = cosines.argmax(axis=1)
        parent, at = rows.column("cell")[0].as_py(), pivots.column("at").to_numpy()
        cell = pa.array([f"{parent}/{k}" for k in at[best].tolist()])
        return pa.table({"space": rows.column("space"), "cell": cell, "project_id": rows.column("project_id"), "vec_id": rows.column("vec_id"), "u": rows.column("u"), "scale": rows.column("scale"), "parent": rows.column("cell"), "off": pa.array(angles(cosines[np.arange(len(best)), best]))})

    shape = f"space string, cell string, project_id {kinds['project_id']}, vec_id {kinds['vec_id']}, u array<double>, scale double, parent string, off double"
    moved = written(dealt.groupBy("space", "cell", "sub").cogroup(known.groupBy("space", "cell", "sub")).applyInArrow(nearest, shape), "parted")
    named = pivots.select("space", F.concat_ws("/", "cell", F.col("at").cast("string")).alias("node"), F.col("u").alias("center"))
    cells = moved.groupBy("space", "parent", F.col("cell").alias("node")).agg(F.max("off").alias("radius")).join(named, ["space", "node"]).select("space", "parent", "node", "center", "radius")
    return placed.join(sizes.select(*by), by, "left_anti"), moved.drop("parent", "off"), written(cells, "nodes")


def grown(units: DataFrame, block: int = BLOCK) -> Tree:
    """The tree over space, project_id, vec_id (whole numbers), u and scale."""
    placed, done, nodes = units.withColumn("cell", F.lit("")), [], []
    for level in range(DEPTH):
        if (made := part_once(placed, block, level)) is None:
            break
        done.append(made[0])
        placed = made[1]
        nodes.append(made[2])
    every = placed
    for part in done:
        every = every.unionByName(part)
    sizes = every.groupBy("space", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    dealt = every.join(sizes, ["space", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(-1)), F.col("chunks")).cast("int")).drop("chunks")

    def gather(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        x, scale = matrix(rows.column("u")), rows.column("scale").to_numpy()
        center = x.mean(axis=0)
        length = np.linalg.norm(center)
        center = center / length if length > 1e-9 else x[0]
        space, cell, chunk = (rows.column(c)[0].as_py() for c in ("space", "cell", "chunk"))
        return pa.table({
            "space": [space], "project_id": rows.column("project_id").slice(0, 1), "parent": [cell], "node": [f"{cell}#{chunk}"], "center": lists(center[None]), "radius": [float(angles(x @ center).max())],
            "n": pa.array([len(x)], pa.int64()), "low": [float(scale.min())], "high": [float(scale.max())], "ids": [rows.column("vec_id").to_numpy().astype("<i8").tobytes()], "vecs": [x.astype("<f8").tobytes()], "scales": [scale.astype("<f8").tobytes()],
        })

    kind = units.schema["project_id"].dataType.simpleString()
    shape = f"space string, project_id {kind}, parent string, node string, center array<double>, radius double, n long, low double, high double, ids binary, vecs binary, scales binary"
    return Tree(nodes, written(dealt.groupBy("space", "cell", "chunk").applyInArrow(gather, shape), "leaves"))


def children(tree: Tree, level: int) -> DataFrame:
    """space, parent, node, center, radius: the cells below those of a level. A cell that was parted no more is its own child; at the end come the leaves."""
    if level == len(tree.nodes):
        return tree.outlines.select("space", "parent", "node", "center", "radius")
    cells = tree.nodes[level]
    if not level:
        whole = tree.outlines.select("space").distinct().join(cells.select("space").distinct(), "space", "left_anti")
        return cells.unionByName(whole.select("space", F.lit("").alias("parent"), F.lit("").alias("node"), F.lit(None).cast("array<double>").alias("center"), F.lit(np.pi).alias("radius")))
    above = children(tree, level - 1)
    ended = above.join(cells.select("space", F.col("parent").alias("node")).distinct(), ["space", "node"], "left_anti")
    return cells.unionByName(ended.select("space", F.col("node").alias("parent"), "node", "center", "radius"))


def unpack(block: bytes, dtype: str = "<f8") -> np.ndarray:
    return np.frombuffer(block, dtype)


def apart() -> Column:
    """The angle of the centres of two cells; a whole space has none, and is apart from nothing."""
    return F.coalesce(angle(F.col("center_a"), F.col("center_b")), F.lit(0.0))


def descended(tree: Tree, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """space, a, b (names of leaves, each pair once) that kept leaves at each level of the pairs of cells below those
    kept so far; it may use apart (of the centres; 0 where a cell is a whole space) and radii (their sum)."""
    pairs = tree.outlines.select("space", F.lit("").alias("a"), F.lit("").alias("b")).distinct()
    apart = F.coalesce(angle(F.col("center_a"), F.col("center_b")), F.lit(0.0))
    for level in range(len(tree.nodes) + 1):
        below = children(tree, level)
        one, two = (below.select("space", F.col("parent").alias(x), F.col("node").alias(f"node_{x}"), F.col("center").alias(f"center_{x}"), F.col("radius").alias(f"radius_{x}")) for x in "ab")
        met = pairs.join(one, ["space", "a"]).join(two, ["space", "b"]).filter((F.col("a") < F.col("b")) | (F.col("node_a") <= F.col("node_b")))
        named = met.select("space", F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), apart.alias("apart"), (F.col("radius_a") + F.col("radius_b")).alias("radii"))
        pairs = written(kept(named).select("space", "a", "b"), "leaf_pairs")
    return pairs


def within_reach(tree: Tree, reach: float) -> DataFrame:
    """Pairs of leaves that may have two vectors within reach (an angle)."""
    return descended(tree, lambda met: met.filter((F.col("a") == F.col("b")) | (F.col("apart") <= F.col("radii") + F.lit(reach + SLACK))))


def farthest_apart(tree: Tree) -> DataFrame:
    """Pairs of leaves that may have the farthest two vectors of their space: no other pair is sure to have farther ones."""

    def kept(met: DataFrame) -> DataFrame:
        met = written(met, "ranged")
        sure = F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("apart") - F.col("radii"))
        return met.join(met.groupBy("space").agg(F.max(sure).alias("sure")), "space").filter(F.col("apart") + F.col("radii") >= F.col("sure") - SLACK)

    return descended(tree, kept)


def groups_of(tree: Tree) -> DataFrame:
    """space, node and group of the leaves: neighbours by name, GROUP at most, and fewer where a space has few leaves."""
    place = F.row_number().over(Window.partitionBy("space").orderBy("node")) - 1
    size = F.least(F.lit(GROUP), F.ceil(F.count("*").over(Window.partitionBy("space")) / 8))
    return tree.outlines.select("space", "node", F.floor(place / size).cast("int").alias("group"))


def sides(tree: Tree, pairs: DataFrame, reach: float | None) -> DataFrame:
    """The leaves of each pair of groups that have pairs (a < b), once each, with their vectors that can be within reach (an
    angle) of a leaf they meet: space, ga, gb, node, lead (names of leaves that this one is multiplied with), ids, vecs, scales, n."""
    group = written(groups_of(tree), "groups")
    ga, gb = (group.select("space", F.col("node").alias(x), F.col("group").alias(f"g{x}")) for x in "ab")
    dealt = pairs.filter("a <> b").join(small(ga), ["space", "a"]).join(small(gb), ["space", "b"])
    ends = F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other"), F.lit(True).alias("leads")), F.struct(F.col("b").alias("own"), F.col("a").alias("other"), F.lit(False).alias("leads")))
    met = dealt.select("space", F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb"), F.explode(ends).alias("e")).select("space", "ga", "gb", "e.*")
    other = tree.outlines.select("space", F.col("node").alias("other"), "center", "radius")
    met = met.join(small(other), ["space", "other"]).groupBy("space", "ga", "gb", "own").agg(F.collect_list(F.struct("other", "leads", "center", "radius")).alias("met"))
    own = tree.leaves.select("space", F.col("node").alias("own"), "ids", "vecs", "scales")

    def near(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids = unpack(row["ids"], "<i8")
                x, scale = unpack(row["vecs"]).reshape(len(ids), -1), unpack(row["scales"])
                on = np.full(len(ids), reach is None)
                for m in row["met"] if reach is not None else ():
                    on |= angles(x @ np.array(m["center"])) <= m["radius"] + reach + SLACK
                if on.any():
                    lead = pa.array([[m["other"] for m in row["met"] if m["leads"]]], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_pydict({"space": [row["space"]], "ga": pa.array([row["ga"]], pa.int32()), "gb": pa.array([row["gb"]], pa.int32()), "node": [row["own"]], "lead": lead, "ids": [ids[on].tobytes()], "vecs": [x[on].tobytes()], "scales": [scale[on].tobytes()], "n": pa.array([int(on.sum())], pa.int64())})

    rows = own.join(written(met, "met"), ["space", "own"]).select("space", "ga", "gb", "own", "met", "ids", "vecs", "scales")
    return rows.mapInArrow(near, "space string, ga int, gb int, node string, lead array<string>, ids binary, vecs binary, scales binary, n long")


@dataclass
class Part:
    """Two sets of vectors that meet, as ids and vectors times their scales; same: the second is the first."""

    space: str
    left: np.ndarray
    x: np.ndarray
    right: np.ndarray
    y: np.ndarray
    same: bool

    def cosines(self) -> np.ndarray:
        """Times both scales; of a set with itself, the lower triangle and diagonal are -inf."""
        s = self.x @ self.y.T
        if self.same:
            s[np.tril_indices(len(s))] = -np.inf
        return s


def products(tree: Tree, pairs: DataFrame, reach: float | None, of: Callable[[Iterator[Part]], Iterator[dict]], shape: str) -> DataFrame:
    """What of gives for the parts of a task: each leaf with itself, and both leaves of each pair, in groups of leaves, so
    that a leaf is shuffled once for many others."""

    def block(row: dict) -> tuple[np.ndarray, np.ndarray]:
        ids = unpack(row["ids"], "<i8")
        return ids, unpack(row["vecs"]).reshape(len(ids), -1) * unpack(row["scales"])[:, None]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ((row["space"], *block(row)) for row in rows_of(batches))
        for made in of(Part(space, ids, x, ids, x, True) for space, ids, x in held):
            yield pa.RecordBatch.from_pydict(made)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {row["node"]: (row["space"], row["lead"], *block(row)) for row in rows_of(batches)}
        met = (Part(space, ids, x, *rows[other][2:], False) for space, lead, ids, x in rows.values() for other in lead if other in rows)
        for made in of(met):
            yield pa.RecordBatch.from_pydict(made)

    alone = tree.leaves.join(pairs.filter("a = b").select("space", F.col("a").alias("node")), ["space", "node"], "left_semi").select("space", "ids", "vecs", "scales")
    return alone.mapInArrow(within, shape).unionByName(sides(tree, pairs, reach).drop("n").groupBy("space", "ga", "gb").applyInArrow(across, shape))


def near_pairs(units: DataFrame, threshold: float, block: int = BLOCK, mark: str | None = None) -> DataFrame:
    """a < b and similarity (cosine times both scales) of all pairs of a space at threshold or more, where scales are 1 at most.
    With the name of a boolean column, only pairs of one that has the mark and one that doesn't."""
    if mark:
        units = units.withColumn("vec_id", 2 * F.col("vec_id") + F.col(mark).cast("long")).drop(mark)
    tree, reach = grown(units, block), float(np.arccos(np.clip(threshold, -1, 1)))

    def found(parts: Iterator[Part]) -> Iterator[dict]:
        for p in parts:
            s = p.cosines()
            if mark:
                s[(p.left[:, None] & 1) == (p.right[None] & 1)] = -np.inf
            x, y = np.nonzero(s >= threshold)
            a, b = (p.left[x] >> 1, p.right[y] >> 1) if mark else (p.left[x], p.right[y])
            yield {"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "similarity": pa.array(s[x, y])}

    return products(tree, within_reach(tree, reach), reach, found, "a long, b long, similarity double")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of links as links from each node to the least one of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]
        x, y = up[x], up[y]
        x, y = x[x != y], y[x != y]
    moved = np.flatnonzero(up != np.arange(len(up)))
    return nodes[up[moved]], nodes[moved]


def rounded_pairs(s: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns where s, rounded to six digits, is threshold or more."""
    x, y = np.nonzero(s >= threshold - ROUNDING)
    on = np.floor(s[x, y] * 1e6 + 0.5) / 1e6 >= threshold
    return x[on], y[on]


def near_components(units: DataFrame, threshold: float, block: int = BLOCK, mark: str | None = None) -> DataFrame:
    """a < b: links that join the same vectors to components as all pairs of a space at threshold or more (rounded), as few as
    a task can do with. With the name of a boolean column, only those that have the mark are joined so; of others, every pair is kept."""
    if mark:
        units = units.withColumn("vec_id", 2 * F.col("vec_id") + F.col(mark).cast("long")).drop(mark)
    tree, reach = grown(units, block), float(np.arccos(np.clip(threshold - ROUNDING, -1, 1)))

    def joined(parts: Iterator[Part]) -> Iterator[dict]:
        a, b, held = [], [], 0
        for p in parts:
            x, y = rounded_pairs(p.cosines(), threshold)
            one, two = p.left[x], p.right[y]
            if mark:
                inner = (one & two & 1).astype(bool)
                out_a, out_b = one[~inner] >> 1, two[~inner] >> 1
                yield {"a": pa.array(np.minimum(out_a, out_b)), "b": pa.array(np.maximum(out_a, out_b))}
                one, two = one[inner] >> 1, two[inner] >> 1
            one, two = stars(one, two)
            a.append(one)
            b.append(two)
            held += len(one)
            if held > HELD:
                one, two = stars(np.concatenate(a), np.concatenate(b))
                a, b, held = [one], [two], 0
        if a:
            one, two = stars(np.concatenate(a), np.concatenate(b))
            yield {"a": pa.array(one), "b": pa.array(two)}

    return products(tree, within_reach(tree, reach), reach, joined, "a long, b long")


def neighbours(units: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """vec_id and n: how many others of its space are at threshold or more (rounded), where there are any."""
    tree, reach = grown(units, block), float(np.arccos(np.clip(threshold - ROUNDING, -1, 1)))

    def counted(parts: Iterator[Part]) -> Iterator[dict]:
        for p in parts:
            x, y = rounded_pairs(p.cosines(), threshold)
            ids, n = np.concatenate([p.left, p.right]), np.concatenate([np.bincount(x, minlength=len(p.left)), np.bincount(y, minlength=len(p.right))])
            yield {"vec_id": pa.array(ids[n > 0]), "n": pa.array(n[n > 0].astype(np.int64))}

    return products(tree, within_reach(tree, reach), reach, counted, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))


def least_cosines(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """space and low, the least cosine of two of its vectors: only leaves whose farthest possible pair beats the farthest certain one meet."""
    tree = grown(units, block)

    def least(parts: Iterator[Part]) -> Iterator[dict]:
        for p in parts:
            s = p.cosines()
            real = s[np.isfinite(s)]
            if real.size:
                yield {"space": pa.array([p.space]), "low": pa.array([float(real.min())])}

    return products(tree, farthest_apart(tree), None, least, "space string, low double").groupBy("space").agg(F.min("low").alias("low"))


def top_k(queries: DataFrame, tree: Tree, k: int, threshold: float, others_only: bool = False, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """query_id, vec_id, score, rank of the k best of each query's space at threshold or more, and query_id, leaf of what was searched.

    queries have query_id, space, q (of length 1) and scale; the score is the cosine times both scales, rounded to
    digits; ties go to the least vec_id. Each query has its leaves in order of the best score they can hold, and takes
    the next ones, 1, then 4, 16 and so on, until its k-th score beats the rest.
    """
    front = written(queries.select("query_id", "space", "q", F.col("scale").alias("q_scale")), "queries")
    at = front.withColumn("parent", F.lit(""))
    for level in range(len(tree.nodes) + 1):
        below = children(tree, level)
        off = F.greatest(F.lit(0.0), F.coalesce(angle(F.col("q"), F.col("center")), F.lit(0.0)) - F.col("radius") - SLACK)
        at = at.join(below, ["space", "parent"]).withColumn("bound", F.cos(off)).filter((F.col("bound") * F.col("q_scale") >= threshold - SLACK) | (F.lit(threshold) <= 0)).select("query_id", "space", "q", "q_scale", F.col("node").alias("parent"), "bound")
    ends = tree.outlines.select("space", F.col("node").alias("parent"), "low", "high")
    cap = F.col("q_scale") * F.greatest(F.col("bound") * F.col("high"), F.col("bound") * F.col("low"))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "leaf")
    reached = at.join(ends, ["space", "parent"]).select("query_id", "space", F.col("parent").alias("leaf"), cap.alias("bound")).filter(F.col("bound") >= threshold - SLACK)
    ahead = written(reached.withColumn("at", F.row_number().over(order)), "cells_of_queries")
    best, read, low, width = None, None, 0, 1
    while True:
        todo = ahead.filter((F.col("at") > low) & (F.col("at") <= low + width))
        if best is not None:
            kth = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
            todo = todo.join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - SLACK)).drop("kth")
        todo = written(todo.select("query_id", "space", "leaf"), "visits")
        if todo.isEmpty():
            return best if best is not None else searched(front, tree, todo, k, threshold, others_only, digits).withColumn("rank", F.lit(1)), todo if read is None else read
        hits = searched(front, tree, todo, k, threshold, others_only, digits)
        hits = hits if best is None else hits.unionByName(best.drop("rank"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = written(hits.withColumn("rank", place).filter(F.col("rank") <= k), "best")
        read = todo.select("query_id", "leaf") if read is None else read.unionByName(todo.select("query_id", "leaf"))
        low, width = low + width, width * 4


def searched(front: DataFrame, tree: Tree, todo: DataFrame, k: int, threshold: float, others_only: bool, digits: int | None) -> DataFrame:
    """query_id, vec_id, score: each query's k best of one leaf, for (query_id, space, leaf). The queries of a leaf go to it in groups of bounded size."""
    groups = todo.groupBy("space", "leaf").agg(F.ceil(F.count("*") / AT_ONCE).cast("int").alias("subs"))
    asked = todo.join(groups, ["space", "leaf"]).withColumn("sub", F.pmod(F.xxhash64("query_id"), F.col("subs")).cast("int")).join(front.drop("space"), "query_id")
    rows = tree.leaves.select("space", F.col("node").alias("leaf"), "ids", "vecs", "scales").join(groups, ["space", "leaf"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    kind = todo.schema["query_id"].dataType.simpleString()

    def search(queries: pa.Table, block: pa.Table) -> pa.Table:
        if not len(queries) or not len(block):
            return pa.table({"query_id": pa.array([], queries.schema.field("query_id").type), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = unpack(block.column("ids")[0].as_py(), "<i8")
        x = unpack(block.column("vecs")[0].as_py()).reshape(len(ids), -1) * unpack(block.column("scales")[0].as_py())[:, None]
        s = (matrix(queries.column("q")) * queries.column("q_scale").to_numpy()[:, None]) @ x.T
        s = np.round(s, digits) if digits is not None else s
        if others_only:
            s[queries.column("query_id").to_numpy()[:, None] == ids[None]] = -np.inf
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]  # ids are in order, so ties go to the least
        value = np.take_along_axis(s, order, axis=1)
        row, place = np.nonzero(value >= threshold)
        return pa.table({"query_id": queries.column("query_id").take(pa.array(row)), "vec_id": pa.array(ids[order[row, place]]), "score": pa.array(value[row, place])})

    by = ["space", "leaf", "sub"]
    return asked.select(*by, "query_id", "q", "q_scale").groupBy(*by).cogroup(rows.select(*by, "ids", "vecs", "scales").groupBy(*by)).applyInArrow(search, f"query_id {kind}, vec_id long, score double")
