"""Joins, searches and clusters over vectors against brute force, with blocks small enough for trees of several levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import vectors
from quarrymill.operators.similarity import grown, near_pairs, sides, spaced, top_k, within_reach


def clustered(n, centres, spread, seed, d=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, d))
    return (base[rng.integers(0, centres, n)] + rng.normal(scale=spread, size=(n, d))).astype(np.float64)


def frame(spark, x, project=lambda i: i % 2):
    rows = [(i, project(i), None if r is None else [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, project_id long, embedding array<double>")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("spread", "threshold"), [(0.1, 0.9), (1.0, 0.5), (0.3, -0.2)])
def test_pairs_equal_brute_force(spark, spread, threshold):
    x = clustered(300, 9, spread, 1)
    x[40:80] = x[40]  # copies that no pivot parts
    s = unit(x) @ unit(x).T
    got = {(r.a, r.b): r.similarity for r in vectors.cosine_pairs(frame(spark, x), threshold, 16).collect()}
    want = {(i, j): s[i, j] for i in range(300) for j in range(i + 1, 300) if i % 2 == j % 2 and round(s[i, j], 6) >= threshold}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def at_cosines(*cosines):
    """A vector and others at these cosines to it."""
    return np.array([[1.0, 0.0], *([c, np.sqrt(1 - c * c)] for c in cosines)])


def test_pairs_that_only_rounding_lifts_to_the_threshold(spark):
    """Half a digit below the threshold is at it, as in the SQL, which rounds first."""
    got = vectors.cosine_pairs(frame(spark, at_cosines(0.2999996, 0.2999994, 0.3), lambda i: 0), 0.3).filter("a = 0").collect()
    assert sorted((r.b, r.similarity) for r in got) == [(1, 0.3), (3, 0.3)]


def test_neighbours_that_only_rounding_lifts_count_for_uniqueness(spark):
    df = frame(spark, at_cosines(0.2999996), lambda i: 0)
    got = vectors.uniqueness_redundancy(df, vectors.cosine_pairs(df, 0.3)).collect()
    assert [(r.neighbours, r.uniqueness, r.redundancy) for r in got] == [(1, 0.7, 0.5)] * 2


def test_few_vectors_meet_where_they_lie_in_clusters(spark):
    n, block = 4000, 100
    x = clustered(n, 60, 0.05, 2)
    units = spaced(frame(spark, x, lambda i: 0))
    tree = grown(units, block)
    moved = sides(tree, within_reach(tree, float(np.arccos(0.95))), float(np.arccos(0.95))).agg(F.sum("n")).first()[0]
    assert len(tree.nodes) >= 2 and moved < 0.5 * n * n / block
    s = unit(x) @ unit(x).T
    assert near_pairs(units, 0.95, block).count() == int((np.triu(s, 1) >= 0.95).sum())


def test_search_is_exact_and_reads_few_cells(spark):
    n, block, k = 3000, 64, 7
    x = clustered(n, 50, 0.1, 3)
    df = frame(spark, x, lambda i: 0)
    s = np.round(unit(x) @ unit(x).T, 6)
    tree = grown(spaced(df), block)
    asked = spaced(df.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), "query_id").withColumnRenamed("u", "q")
    best, read = top_k(asked, tree, k, 0.8, digits=6)
    got = {}
    for r in best.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for q in range(0, n, 20):
        order = sorted((-s[q, i], i) for i in range(n) if s[q, i] >= 0.8)[:k]
        assert [got[q][i] for i in sorted(got[q])] == [i for _, i in order]
    cells = read.groupBy("query_id").count().agg(F.avg("count")).first()[0]
    assert cells < 0.25 * tree.leaves.count()


def test_search_of_odd_vectors(spark):
    x = [[1.0, 0.0], None, [0.0, 0.0], [2.0, 0.0], [1.0, 0.0, 0.0], [float("nan"), 1.0], [-1.0, 0.0]]
    df = frame(spark, x, lambda i: None if i == 6 else 0)
    queries = df.select(F.col("vec_id").alias("query_id"), "project_id", F.col("embedding").alias("q"))
    got = {(r.query_id, r.vec_id, r["rank"]) for r in vectors.vector_topk(queries, df, 3, 0.5).collect()}
    assert got == {(0, 0, 1), (0, 3, 2), (3, 0, 1), (3, 3, 2), (4, 4, 1)}
    assert vectors.vector_topk(queries, df.limit(0), 3, 0.5).count() == vectors.vector_topk(queries.limit(0), df, 3, 0.5).count() == 0
    assert vectors.cosine_pairs(df.limit(0), 0.5).count() == 0
    assert {(r.a, r.b) for r in vectors.cosine_pairs(df, 0.5).collect()} == {(0, 3)}


def linkage(x, distance):
    """Clusters of unit vectors by average linkage, one merge of the closest two after the other."""
    n = len(x)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    size, members, live = np.ones(n), [[i] for i in range(n)], np.ones(n, bool)
    while live.sum() > 1:
        best = s.max(axis=1)
        i = int(np.argmax(np.where(live, best, -np.inf)))
        j = int(np.argmax(s[i]))
        if s[i, j] <= 1 - distance:
            break
        row = (size[i] * s[i] + size[j] * s[j]) / (size[i] + size[j])
        row[[i, j]] = -np.inf
        s[i], s[:, i] = row, row
        s[j], s[:, j] = -np.inf, -np.inf
        size[i] += size[j]
        members[i] += members[j]
        live[j] = False
    return sorted(sorted(m) for i, m in enumerate(members) if live[i])


def groups(df):
    return sorted(sorted(g) for g in df.toPandas().groupby("cluster")["vec_id"].apply(list))


@pytest.mark.parametrize(("n", "block"), [(90, 2048), (300, 110)])
def test_identities_equal_average_linkage(spark, n, block):
    x = clustered(n, 12, 0.8, 5)
    got = vectors.identity_clusters(frame(spark, x, lambda i: 0), 0.45, block)
    assert groups(got) == linkage(unit(x), 0.45)
    assert all(r.cluster <= r.vec_id for r in got.collect())


@pytest.mark.parametrize("few", [100, 16384])
def test_identities_take_few_rounds_of_searches(spark, monkeypatch, few):
    """The long tail of rounds with a merge or two runs in one task, over the clusters that are left of a space."""
    searches = []
    search = vectors.top_k
    monkeypatch.setattr(vectors, "top_k", lambda *a, **k: searches.append(1) or search(*a, **k))
    x = np.random.default_rng(11).normal(size=(240, 8))
    got = groups(vectors.identity_clusters(frame(spark, x, lambda i: 0 if i < 40 else 1), 0.5, 64, **({"few": few} if few < 16384 else {})))
    assert got == sorted(linkage(unit(x[:40]), 0.5) + [[i + 40 for i in g] for g in linkage(unit(x[40:]), 0.5)])
    assert (1 if few < 200 else 0) <= len(searches) <= 4


def test_identities_of_one_large_component(spark):
    """2,300 vectors that hang together in one component: no other method above a size."""
    rng = np.random.default_rng(6)
    x = np.repeat(clustered(5, 5, 0.1, 7, 6), 460, axis=0) + rng.normal(scale=0.55, size=(2300, 6))
    s = unit(x) @ unit(x).T >= 0.6
    reached, ahead = np.zeros(2300, bool), np.arange(2300) == 0
    while ahead.any():
        reached |= ahead
        ahead = s[ahead].any(axis=0) & ~reached
    assert reached.sum() > 2000
    assert groups(vectors.identity_clusters(frame(spark, x, lambda i: 0), 0.4, 1200)) == linkage(unit(x), 0.4)


def test_copies_and_projects_of_identities(spark):
    x = np.repeat(np.eye(4), 25, axis=0)
    got = vectors.identity_clusters(frame(spark, x), 0.6, 8)
    assert groups(got) == sorted([i for i in range(100) if i // 25 == k and i % 2 == p] for k in range(4) for p in (0, 1))
    assert vectors.identity_clusters(frame(spark, x).limit(0), 0.6).count() == 0


ASSETS = "asset_id long, project_id long, composite_score double, training_usefulness double, technical_quality double, face_quality double, aesthetic_score double, uniqueness_score double, redundancy_score double, width int, height int"


def test_face_duplicates_by_primary_vectors(spark):
    """A scan over primary vectors by face_index, then asset, as on paper."""
    x = clustered(120, 8, 0.35, 8)
    rng = np.random.default_rng(9)
    faces = [(i, int(a), int(f), 0, [float(v) for v in x[i]]) for i, (a, f) in enumerate(zip(rng.integers(0, 60, 120), rng.integers(0, 4, 120), strict=True))]
    assets = spark.createDataFrame([(a, 0, (a * 7 % 10) / 10, None, None, None, None, None, None, 10, 10) for a in range(60)], ASSETS)
    df = spark.createDataFrame(faces, "vec_id long, asset_id long, face_index int, project_id long, embedding array<double>")
    first = {}
    for vec, asset, index, _, _ in sorted(faces, key=lambda f: (f[2], f[0])):
        first.setdefault(asset, (index, vec))
    order = sorted(first, key=lambda a: (first[a][0], a))
    u = unit(x)
    cos = lambda a, b: round(float(u[first[a][1]] @ u[first[b][1]]), 6)
    label = {}
    for i, a in enumerate(order):
        if a not in label:
            label[a] = a
            for b in order[i + 1 :]:
                if b not in label and cos(a, b) >= 0.8:
                    label[b] = a
    clusters = {k: [a for a in label if label[a] == k] for k in set(label.values())}
    want = {}
    for k, own in clusters.items():
        if len(own) > 1:
            best = max(own, key=lambda a: ((a * 7 % 10) / 10, a))
            want |= {a: (k, best, None if a == best else cos(best, a)) for a in own}
    got = {r.asset_id: (r.cluster, r.representative, r.similarity) for r in vectors.face_duplicates(df, assets, 0.8, 16).collect()}
    assert got.keys() == want.keys() and all(got[a][:2] == want[a][:2] and got[a][2] == pytest.approx(want[a][2], abs=2e-6) for a in want)


def test_assets_have_the_identity_of_their_first_face(spark):
    faces = spark.createDataFrame([(0, 10, 1, 0), (1, 10, 0, 0), (2, 11, 0, 0), (3, 12, 2, 0), (4, 13, 0, 0)], "vec_id long, asset_id long, face_index int, project_id long")
    clusters = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 0), (4, 4)], "vec_id long, cluster long")
    assets = spark.createDataFrame([(a, 0, s, None, None, None, None, None, None, 10, 10) for a, s in ((10, 0.2), (11, 0.9), (12, 0.5), (13, 0.1))], ASSETS)
    got = {r.asset_id: (r.cluster, r.label, r.asset_count, r.representative) for r in vectors.asset_identities(faces, clusters, assets).collect()}
    assert got == {10: (1, "Person 1", 2, 11), 11: (1, "Person 1", 2, 11), 12: (0, "Person 2", 1, 12), 13: (4, "Person 3", 1, 13)}


def test_results_of_a_search(spark):
    from quarrymill.operators.relations import search_results

    hits = spark.createDataFrame([(1, 5, 0.9, 1), (1, 6, 0.8, 2), (2, 99, 0.7, 1)], "query_id long, vec_id long, score double, rank int")
    assets = spark.createDataFrame([(5, "a.png", 0.5), (6, "b.png", None)], "asset_id long, filename string, composite_score double")
    assert sorted(tuple(r) for r in search_results(hits, assets).collect()) == [(1, 1, 5, "a.png", 0.5, 0.9), (1, 2, 6, "b.png", None, 0.8)]


def test_cosines_to_labels(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, 1.0, 1.0]), (4, [3.0, 4.0])], "vec_id long, embedding array<double>")
    labels = spark.createDataFrame([("a", [0.0, 2.0]), ("b", [0.0, 0.0]), ("c", [1.0, 1.0, 1.0])], "tag string, q array<double>")
    got = {(r.vec_id, r.tag): r.s and round(r.s, 6) for r in vectors.label_cosines(df, labels, "tag").collect()}
    nothing = dict.fromkeys([(0, "c"), (1, "c"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (3, "b"), (4, "c")])
    assert got == {(0, "a"): 0.0, (0, "b"): 0.0, (1, "a"): 0.0, (1, "b"): 0.0, (3, "c"): 1.0, (4, "a"): 0.8, (4, "b"): 0.0} | nothing
    assert vectors.label_cosines(df, labels.limit(0), "tag").count() == vectors.label_cosines(df.limit(0), labels, "tag").count() == 0


def scanned(s, threshold):
    """node: (leader, similarity) by a scan in order over a matrix of similarities; those without neighbours are left out."""
    leads, got = [], {}
    for i in range(len(s)):
        near = [j for j in leads if s[i, j] >= threshold]
        if near:
            got[i] = (near[0], s[i, near[0]])
            got.setdefault(near[0], (near[0], 1.0))
        else:
            leads.append(i)
    return got


def tables_written(monkeypatch):
    """Rows of the tables that operators write, by name."""
    rows = {}

    def written(df, name, keep=vectors.written):
        out = keep(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(vectors, "written", written)
    return rows


def test_leaders_by_steps_equal_a_scan_and_make_few_pairs(spark, monkeypatch):
    """Vectors that an earlier step's leaders lead are paired with nothing else."""
    n = 700
    x = np.random.default_rng(12).normal(size=(n, 6))
    x[300:303] = x[0]
    s = np.round(unit(x) @ unit(x).T, 6)
    want = scanned(s, 0.3)
    rows = tables_written(monkeypatch)
    got = {r.node: (r.leader, r.similarity) for r in vectors.leader_clusters(frame(spark, x, lambda i: 0), 0.3, 64, 60).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in got)
    assert rows["pairs"] < 0.1 * (np.triu(s, 1) >= 0.3).sum()


@pytest.mark.parametrize(("least", "threshold"), [(2, 0.9), (12, 0.9)])
def test_density_clusters_equal_brute_force_and_write_few_links(spark, monkeypatch, least, threshold):
    x = clustered(500, 14, 0.45, 13, 6)
    s = np.round(unit(x) @ unit(x).T, 6) >= threshold
    s &= np.arange(500)[:, None] % 2 == np.arange(500)[None] % 2
    np.fill_diagonal(s, False)
    core = (s.sum(axis=1) >= 1) & (s.sum(axis=1) + 1 >= least)
    label = np.arange(500)
    while True:
        lower = np.array([min([label[i], *label[s[i] & core]]) if core[i] else i for i in range(500)])
        if (lower == label).all():
            break
        label = lower
    want = {i: int(label[i]) if core[i] else min((int(label[j]) for j in np.flatnonzero(s[i] & core)), default=None) for i in range(500)}
    rows = tables_written(monkeypatch)
    got = {r.vec_id: r.cluster for r in vectors.identity_dbscan(frame(spark, x), 1 - threshold, least, 64).collect()}
    assert got == want and len(set(want.values())) > 3
    assert rows["links"] < (0.25 if least == 2 else 0.5) * s.sum()


def test_leaves_are_shuffled_once_for_many_others(spark):
    """Without anything to prune, each vector goes to a task for a group of leaves, not for each leaf."""
    x = np.random.default_rng(14).normal(size=(2000, 16))
    tree = grown(spaced(frame(spark, x, lambda i: 0)), 50)
    leaves = tree.leaves.count()
    moved = sides(tree, within_reach(tree, 2.0), 2.0).agg(F.sum("n")).first()[0]
    assert leaves > 30 and moved < 0.4 * 2000 * leaves


def test_leaders_by_similarities_that_only_rounding_lifts(spark):
    got = vectors.leader_clusters(frame(spark, at_cosines(0.2999996, 0.2999994), lambda i: 0), 0.3).collect()
    assert (1, 0, 0.3) in [(r.node, r.leader, r.similarity) for r in got]
