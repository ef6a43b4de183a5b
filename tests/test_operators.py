"""Literal fixtures, and brute force for what SQL can't express."""

import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrymill.functions import captions as captions_
from quarrymill.functions import quality
from quarrymill.functions.judge import judge_parse
from quarrymill.operators import actions, coach, dedup, image_qc, ratings, relations, stats, vectors
from quarrymill.operators.filters import rule_column
from quarrymill.plans.views import view
from quarrymill.sources import ingest, sinks
from quarrymill.streaming import streams

SF = "/root/testdata/sf0.001"
ASSET = dict(
    asset_id=0, project_id="p", filename="a.png", width=1024, height=1024, sha256_hash="h", phash=None, position=0, imported_at=0, analyzed=True, face_count=1, dominant_emotion="neutral", head_pose_yaw=0.0, shot_type="closeup", is_indoor=None, scene_class=None,
    active_caption_id=None, composite_score=0.5, technical_quality=0.5, aesthetic_score=None, face_quality=0.5, training_usefulness=0.5, uniqueness_score=None, redundancy_score=None, review_state="approved", is_flagged=False, is_rejected=False, rejection_reason=None,
    duplicate_cluster_id=None, duplicate_type=None, identity_cluster_id=None, mu=25.0, sigma=8.333, elo=1500.0, comparisons=0,
)


@pytest.fixture(scope="module")
def assets(spark):
    schema = view(spark, SF, "assets").select(*ASSET).schema
    return lambda rows: spark.createDataFrame([tuple((ASSET | {"asset_id": i, "position": i} | r).values()) for i, r in enumerate(rows)], schema)


def by_rank(df):
    return [r.asset_id for r in df.orderBy("rank").collect()]


def test_selection_prefers_coverage(assets):
    a = dict(composite_score=0.95, training_usefulness=0.95, technical_quality=0.92, face_quality=0.95)
    b = dict(composite_score=0.90, training_usefulness=0.90, technical_quality=0.89, face_quality=0.91)
    c = dict(composite_score=0.74, training_usefulness=0.82, technical_quality=0.78, face_quality=0.76, shot_type="wide", dominant_emotion="happy", head_pose_yaw=32.0, is_indoor=False, height=1400)
    assert by_rank(coach.training_selection(assets([a, b, c]))) == [0, 2, 1]


def test_selection_target_and_next(assets):
    rows = [dict(height=1024 + i, shot_type="closeup" if i % 3 else "medium", dominant_emotion="neutral" if i % 4 else "happy", is_indoor=i % 2 == 0, composite_score=0.99 - 0.01 * i, training_usefulness=0.98 - 0.01 * i, technical_quality=0.97 - 0.01 * i, face_quality=0.96 - 0.01 * i) for i in range(35)]
    got = coach.training_selection(assets(rows)).toPandas()
    assert got["part"].value_counts().to_dict() == {"recommended": 30, "next": 5}


def brute_selection(rows):
    left, seen, out = rows.to_dict("records"), [set() for _ in coach.DIMENSIONS], []
    while left:
        worth = lambda r: (r["score"] + sum(b * (r[d] not in s and r[d] != no) for d, b, no, s in zip(coach.DIMENSIONS, coach.BONUS, coach.NO_BONUS, seen, strict=True)), r["asset_id"])  # noqa: B023, E731
        best = max(left, key=worth)
        left.remove(best)
        out.append(best["asset_id"])
        for d, s in zip(coach.DIMENSIONS, seen, strict=True):
            s.add(best[d])
    return out


def test_selection_equals_sequential_pick(spark):
    table = view(spark, SF, "assets")
    scored = coach.with_selection_score(table).toPandas()
    got = coach.training_selection(table).toPandas().sort_values("rank")
    for project, own in scored.groupby("project_id"):
        assert got[got["project_id"] == project]["asset_id"].tolist() == brute_selection(own)


def test_best_of_exact_duplicates(assets):
    df = assets([dict(composite_score=0.4), dict(composite_score=0.9), dict(sha256_hash="other")])
    assert [r.asset_id for r in relations.keep_best_sha(df).collect()] == [0]
    assert sorted((r.asset_id, r.cluster) for r in dedup.dup_exact(df).collect()) == [(0, 0), (1, 0)]


def test_hamming_pairs_and_closure(spark, assets):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    flip = lambda n, k: f"{n ^ sum(1 << b for b in k):016x}"
    hashes = [f"{base:016x}", flip(base, range(8)), flip(base, range(9)), flip(base, range(14)), None, "", "xyz", f"{base:016x}", *(f"{rng.getrandbits(64):016x}" for _ in range(60))]
    df = assets([dict(phash=h) for h in hashes])
    values = sorted({int(h, 16) for h in hashes if h and h != "xyz"})
    want = {tuple(sorted((a - (a >> 63 << 64), b - (b >> 63 << 64)))) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 8}
    assert {(r.h1, r.h2) for r in dedup.phash_pairs(df).collect()} == want
    assert {r.asset_id: r.cluster for r in dedup.dup_phash(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 7: 0}


def random_vectors(spark, n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, 8)) * 0.6
    rows = [(i, "p", [float(v) for v in x[i].astype(np.float32)]) for i in range(n)]
    return x / np.linalg.norm(x, axis=1, keepdims=True), spark.createDataFrame(rows, "vec_id long, project_id string, embedding array<float>")


def test_leaders_dbscan_and_linkage(spark):
    unit, df = random_vectors(spark, 60, 3)
    s = unit @ unit.T
    lead = {}
    for i in range(60):
        first = [j for j in range(i) if lead[j] == j and s[i, j] >= 0.8]
        lead[i] = min(first, default=i)
    got = {r.node: r.leader for r in vectors.leader_clusters(df, 0.8).collect()}
    assert got == {i: x for i, x in lead.items() if x != i or i in {y for k, y in lead.items() if k != y}}

    near = s >= 0.85
    core = near.sum(1) >= 4
    label = {i: i for i in range(60) if core[i]}
    for _ in range(60):
        label = {i: min(label[j] for j in label if near[i, j]) for i in label}
    want = {i: label.get(i, min((label[j] for j in label if near[i, j]), default=None)) for i in range(60)}
    assert {r.vec_id: r.cluster for r in vectors.identity_dbscan(df, 0.15, 4).collect()} == want

    clusters = [[i] for i in range(60)]
    while True:
        d, a, b = min((np.mean([1 - s[i, j] for i in x for j in y]), m, n) for m, x in enumerate(clusters) for n, y in enumerate(clusters[:m]))
        if d >= 0.3:
            break
        clusters[b] += clusters.pop(a)
    got = vectors.identity_clusters(df, 0.3).toPandas()
    assert sorted(map(sorted, clusters)) == sorted(sorted(g) for g in got.groupby("cluster")["vec_id"].apply(list))


def test_elo_is_conserved_and_streams_agree(spark):
    table = view(spark, SF, "comparisons")
    none = spark.createDataFrame([], "asset_id long, mu double, sigma double")
    batch = ratings.final_ratings(ratings.replay(table, none, "session_id")).toPandas()
    sums = batch.groupby("scope")["mu"].agg(["sum", "size"])
    assert np.allclose(sums["sum"], 1500 * sums["size"])
    path = f"file:///tmp/{np.random.default_rng().integers(2**60):x}-stream"
    table.write.parquet(path.removeprefix("file://"))
    online = streams.ratings(spark.readStream.schema(table.schema).parquet(path)).toPandas()
    both = batch.merge(online, left_on=["scope", "asset_id"], right_on=["session_id", "asset_id"])
    assert len(both) == len(batch) == len(online) and np.allclose(both["mu"], both["elo"]) and (both["comparisons_x"] == both["comparisons_y"]).all()


def test_skill_update_moves_and_shrinks():
    (mw, sw), (ml, sl) = ratings.skill_update((25.0, 25 / 3), (25.0, 25 / 3), False)
    assert mw > 25 > ml and mw - 25 == pytest.approx(25 - ml) and sw < 25 / 3 and sl < 25 / 3
    assert ratings.skill_update((25.0, 25 / 3), (25.0, 25 / 3), True)[0][0] == 25


def test_replay_folds_scopes_batch_by_batch(spark):
    """Equal to a plain fold where batches end within scopes; no task is handed a whole scope."""
    rows = [(i, i * 37 % 50, None if i % 9 == 8 else i % 3, i * 7 % 11, (i * 7 + 1 + i % 4) % 11, i % 5 == 0) for i in range(400)]
    table = spark.createDataFrame(rows, "id long, made_at long, scope long, winner long, loser long, is_draw boolean")
    begin = spark.createDataFrame([(3, 1600.0, 0.0)], "asset_id long, mu double, sigma double")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        made = ratings.replay(table, begin, "scope")
        got = {r.id: (r.scope, r.winner_mu_after, r.loser_mu_after, r.winner_count, r.loser_count) for r in made.collect()}
    finally:
        spark.conf.set(size, old)
    state, want = {}, {}
    for i, _, scope, w, l, draw in sorted(rows, key=lambda r: (r[1], r[0])):  # noqa: E741
        (mw, nw), (ml, nl) = (state.get((scope, x), (1600.0 if x == 3 else 1500.0, 0)) for x in (w, l))
        mw, ml = ratings.elo_update(mw, ml, draw)
        state[scope, w], state[scope, l] = (mw, nw + 1), (ml, nl + 1)
        want[i] = (scope, mw, ml, nw + 1, nl + 1)
    assert got == want
    assert "InPandas" not in made._jdf.queryExecution().executedPlan().toString()


def test_next_pair_takes_the_closest(spark, assets):
    df = assets([dict(mu=float(m), sigma=float(s)) for m, s in ((26, 5), (25.7, 5), (12, 2), (40, 2))])
    none = spark.createDataFrame([], "a long, b long")
    first = ratings.next_pair(df, none).first()
    assert (first.a, first.b) == (0, 1)
    again = ratings.next_pair(df, spark.createDataFrame([(1, 0)], "a long, b long")).first()
    assert (again.a, again.b) != (0, 1)


def test_review_and_rules(spark, assets):
    df = assets([dict(review_state="pending")] * 3)
    asked = spark.createDataFrame([(0, "approved", True, None, None), (1, "rejected", None, None, "bad crop")], "asset_id long, review_state string, is_flagged boolean, is_rejected boolean, rejection_reason string")
    got = {r.asset_id: (r.review_state, r.is_flagged, r.is_rejected, r.rejection_reason) for r in actions.review_transition(df, asked).collect()}
    assert got == {0: ("approved", True, False, None), 1: ("rejected", False, True, "bad crop"), 2: ("pending", False, False, None)}
    with pytest.raises(Exception, match="unknown review state"):
        actions.review_transition(df, asked.withColumn("review_state", F.lit("odd"))).collect()
    assert df.filter(rule_column([{"field": "odd", "op": "eq"}, {"field": "composite_score", "op": "gte", "value": 0.6}])).count() == 0


def test_captions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(captions_.normalize(F.lit("  trigger,,portrait  "))) == "trigger, portrait"
    assert one(captions_.normalize(F.lit(" a  ,\t, b ,c,, "))) == "a, b, c"
    assert one(captions_.find_replace(F.lit("red cat"), r"(\w+) cat", r"\1 dog", regex=True)) == "red dog"
    assert one(captions_.find_replace(F.lit("x" * 600), "x{0}" + "x" * 500, "", regex=True)) == "x" * 600  # too long a pattern changes nothing
    got = one(judge_parse(F.lit('```json\n{"face_clarity": {"score": 0.9}, "composite": {"score": 0.7}}\n```')))
    assert (got.face_clarity, got.pose_usefulness, got.composite, got.recommendation, got.failed) == (0.9, 0.5, 0.7, "maybe", False)


def png(pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_from_files(spark, tmp_path):
    flat, ramp = np.full((64, 64, 3), 128, np.uint8), np.repeat(np.tile(np.arange(0, 256, 4, dtype=np.uint8), (64, 1))[:, :, None], 3, 2)
    for name, data in {"flat.png": png(flat), "ramp.png": png(ramp), "copy.PNG": png(ramp), "broken.png": png(flat)[:40], "empty.png": b"", "note.md": b"x", ".hidden.png": png(flat), "flat.txt": "subject token, studio portrait\n".encode(), "ramp.txt": b"  "}.items():
        (tmp_path / name).write_bytes(data)
    listed = ingest.scan_files(spark, str(tmp_path))
    assert sorted(r.name for r in listed.collect()) == ["broken.png", "copy.PNG", "empty.png", "flat.png", "ramp.png"]
    decoded = ingest.image_dims(spark, str(tmp_path))
    name = F.regexp_extract("path", "[^/]+$", 0)
    dims = {r.name: (r.width, r.height) for r in decoded.select(name.alias("name"), "width", "height").collect()}
    assert dims["flat.png"] == (64, 64) and dims["broken.png"] == (-1, -1)
    wanted = listed.select("path").union(spark.createDataFrame([("gone.png",), ("zero.png",)], "path string")).withColumn("mime", F.lit(None).cast("string"))
    key = F.regexp_replace("path", "^file:/+", "/")
    same = lambda df: df.withColumn("path", key)
    errors = {r.name: r.error for r in ingest.validate_files(same(wanted), same(listed).select("path", "length").union(spark.createDataFrame([("zero.png", 0)], "path string, length long")), same(decoded)).select(name.alias("name"), "error").collect()}
    assert errors == {"flat.png": None, "ramp.png": None, "copy.PNG": None, "broken.png": "undecodable", "empty.png": "empty", "zero.png": "empty", "gone.png": "missing"}
    hashes = {r.name: r for r in ingest.perceptual_hash(decoded.filter("path NOT LIKE '%.md' AND path NOT LIKE '%.txt'"), "path").select(name.alias("name"), "phash", "dhash", "ahash").collect()}
    assert hashes["ramp.png"].dhash == "f" * 16 == hashes["copy.PNG"].dhash and hashes["ramp.png"].phash == hashes["copy.PNG"].phash and hashes["broken.png"].phash is None
    found = {r.name: r for r in image_qc.image_features(decoded, "path").select(name.alias("name"), *image_qc.NAMES, "error").collect()}
    assert found["flat.png"].sharpness == 0 and found["flat.png"].levels == 1 and found["flat.png"].borders == 4 and found["broken.png"].error == "undecodable"
    texts = spark.read.text(str(tmp_path), wholetext=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), "value")
    joined = {r.name: r.caption for r in ingest.sidecar_join(same(listed.select("path")), same(texts)).select(name.alias("name"), "caption").collect()}
    assert joined == {"flat.png": "subject token, studio portrait", "ramp.png": None, "copy.PNG": None, "broken.png": None, "empty.png": None}


def test_sidecar_files(spark, assets, tmp_path):
    df = assets([{}, {}])
    texts = spark.createDataFrame([(0, "a caption", True), (1, " ", True)], "asset_id long, text string, is_active boolean")
    assert sinks.write_sidecars(df, texts, str(tmp_path / "out")).count() == 1
    assert (tmp_path / "out" / "p_0.txt").read_text() == "a caption"


def test_components_ignore_order_and_copies(spark):
    rng = random.Random(2)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    parent = list(range(80))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {k: find(k) for a, b in links if a != b for k in (a, b)}
    for some in (links, [(b, a) for a, b in links * 2]):
        rng.shuffle(some)
        got = dict(map(tuple, dedup.connected_components(spark.createDataFrame(some, "a long, b long")).collect()))
        assert got == want


def test_pandas_rows_are_whole():
    heads = coach.greedy_heads(pd.DataFrame({"project_id": ["p"] * 3, "asset_id": [1, 2, 3], "score": [1.0, 1.0, 5.0], "shot": ["a", "a", "b"], "angle": ["x"] * 3, "expression": ["unknown"] * 3, "background": ["unknown"] * 3}))
    assert heads["asset_id"].tolist() == [3, 2, 1]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 200), (7, 3)]
    got = dict(map(tuple, dedup.connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}


def test_find_and_replace_takes_what_is_written(spark):
    from quarrymill.functions.captions import find_replace

    df = spark.createDataFrame([("a cat (big) costs 5",)], "t string")
    got = df.select(find_replace(F.col("t"), r"(\d)", r"$\1 or \\x", regex=True), find_replace(F.col("t"), "(", "x", regex=True), find_replace(F.col("t"), "cat", r"\2", regex=True), find_replace(F.col("t"), "(", "[")).first()
    assert tuple(got) == ("a cat (big) costs $5 or \\\\x", "a cat (big) costs 5", "a cat (big) costs 5", "a cat [big) costs 5")


def test_patterns_of_python_in_java(spark):
    """As Python's own substitution, where both know the pattern; unchanged where one of them doesn't."""
    import re

    texts = ["cat cat dog", "a-b-c 12 34", "x_y", "end\n"]
    cases = [(r"(?P<one>\w+) (?P=one)", r"<\g<one>>"), (r"(?P<a_b>\d)(?P<c>\d)", r"\g<c>\g<a_b>5"), (r"(\d)(\d)", r"\g<2>0\1"), (r"\\P", "x"), (r"d\Z", "!"), (r"(c)", r"\g<0>$1\1"), (r"[a-c]-", "")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for find, new in cases:
        got = [r[0] for r in df.select(captions_.find_replace(F.col("t"), find, new, regex=True)).collect()]
        assert got == [re.sub(find, new, t) for t in texts], (find, new)
    for find, new in ((r"(?P<n>x", "y"), (r"(?<=a+)b", "y"), (r"(x)", r"\g<none>"), (r"x", r"\g<1>"), (r"(?(1)a|b)", "y"), (r"(?P<n>x)(?P<n>y)", "z")):
        assert [r[0] for r in df.select(captions_.find_replace(F.col("t"), find, new, regex=True)).collect()] == texts


def test_layers_see_what_is_left(spark):
    """Exact, then hashes, then vectors, then faces: each against a plain scan of what the layers before have left."""
    from quarrymill.operators.dedup import dup_layered

    rows = [(1, "s", "x", "00000000000000ff", False), (2, "s", "x", None, False), (3, "s", "c", "00000000000000ff", False), (4, "s", "d", "00000000000000fe", False), *((i, "s", f"z{i}", None, i == 9) for i in range(5, 12))]
    assets = spark.createDataFrame(rows, "asset_id long, project_id string, sha256_hash string, phash string, is_rejected boolean")
    pairs = lambda *p: spark.createDataFrame(p, "a long, b long")
    got = {r.asset_id: (r.cluster, r.type) for r in dup_layered(assets, links=pairs((2, 5), (5, 6), (6, 9), (4, 7)), face_links=pairs((6, 7), (7, 8), (9, 10), (10, 11))).collect()}
    assert got == {1: (1, "exact"), 2: (1, "exact"), 3: (3, "phash"), 4: (3, "phash"), 5: (5, "embedding"), 6: (5, "embedding"), 7: (7, "face"), 8: (7, "face"), 10: (10, "face"), 11: (10, "face")}


def test_tiers_of_every_asset(spark):
    from quarrymill.operators.relations import tiers

    rows = [(i, i % 3 // 2, float(i * 7 % 50) if i % 11 else None) for i in range(400)]
    got = tiers(spark.createDataFrame(rows, "asset_id long, project_id long, elo double"), F.col("elo")).collect()
    assert len(got) == 400
    for p in (0, 1):
        own = sorted((r for r in rows if r[1] == p), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        want = {r[0]: (i, "top" if i <= len(own) // 4 else "bottom" if i > int(len(own) * 0.75) else "middle") for i, r in enumerate(own, 1)}
        assert {r.asset_id: (r["rank"], r.tier) for r in got if r.project_id == p} == want


def test_regions_and_least_similarity(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(12, 8)), 5, axis=0) + rng.normal(scale=0.15, size=(60, 8))
    df = spark.createDataFrame([(i, i % 2, [float(a) for a in row]) for i, row in enumerate(x)], "vec_id long, project_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    regions, least = {}, {}
    for project in (0, 1):
        own = [i for i in range(60) if i % 2 == project]
        seen, n = set(), 0
        for i in own:
            if i not in seen:
                n += 1
                seen |= {j for j in own if j >= i and u[i] @ u[j] > 0.85}
        regions[project] = n
        least[project] = min(u[i] @ u[j] for i in own for j in own if i < j)
    assert {r.project_id: r.regions for r in vectors.embedding_regions(df).collect()} == regions
    got = {r.project_id: r.min_similarity for r in vectors.least_similarity(df, 7).collect()}
    assert got == pytest.approx(least, abs=1e-6)


def test_headers_state_sizes(spark):
    jpeg, gif = b"\xff\xd8\xff\xe0rest of it", b"GIF89a\x03\x01\x02\x00"
    files = [("png", png(np.zeros((64, 48, 3), np.uint8))), ("gif", gif), ("bmp", b"BM" + bytes(16) + struct.pack("<ii", 700, 5)), ("jpeg", jpeg), ("cut", png(np.zeros((8, 8, 3), np.uint8))[:20]), ("text", b"plain"), ("none", None)]
    df = ingest.image_header(spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in files], "name string, content binary"))
    got = {r.name: (r.mime, r.width, r.height) for r in df.collect()}
    assert got == {"png": ("image/png", 48, 64), "gif": ("image/gif", 259, 2), "bmp": ("image/bmp", 700, 5), "jpeg": ("image/jpeg", None, None), "cut": ("image/png", 8, None), "text": (None, None, None), "none": (None, None, None)}


def test_poses_and_buckets(spark):
    faces = [([[0.0, 0.0], [10.0, 0.0], [5.0, 5.0], [2.0, 9.0], [8.0, 9.0]],), ([[0.0, 0.0], [10.0, 0.0], [7.0, 8.0], [2.0, 9.0], [8.0, 9.0]],), ([[0.0, 0.0], [10.0, 0.0], [10.0, 1.0], [2.0, 9.0], [8.0, 9.0]],), ([[3.0, 0.0], [3.0, 0.0], [10.0, 1.0], [2.0, 9.0], [8.0, 9.0]],), ([[3.0, 0.0]],), (None,)]
    got = [tuple(r.p) for r in spark.createDataFrame(faces, "points array<array<double>>").select(quality.pose_from_landmarks(F.col("points")).alias("p")).collect()]
    assert got == [("frontal", "level", 95), ("three_quarter", "looking_down", 64), ("profile", "looking_up", 40), *[("frontal", "level", 85)] * 3]
    sizes = spark.createDataFrame([(1024, 1024), (1920, 1080), (100, 0)], "w int, h int")
    buckets = [tuple(r.b) for r in sizes.select(quality.training_bucket(F.col("w"), F.col("h")).alias("b")).collect()]
    assert buckets == [(1024, 1024, 1.0, 1.05, 1.0, 0, 0), (1344, 768, 1.75, 1.03, 0.711, 21, 0), (1024, 1024, 1.0, 1.05, 10.24, 0, 0)]


def test_off_formats_and_advice(spark, assets):
    df = assets([{"active_caption_id": i} for i in range(5)] + [{}, {"project_id": "q"}])
    texts = ["a fine caption of Elle in the sun", " leading blank in this caption", "twice  blank in this caption", "comma, , comma in this caption", "short"]
    own = spark.createDataFrame([(i, "p", t, True) for i, t in enumerate(texts)], "asset_id long, project_id string, text string, is_active boolean")
    assert sorted(r.asset_id for r in stats.inconsistent_captions(own).collect()) == [1, 2, 3, 4]
    got = {r.project_id: (r.captioned, r.inconsistent, r.recommendations) for r in stats.caption_consistency(df, own, ["elle"]).collect()}
    assert got == {"p": (5, 4, "missing,format,trigger:elle,short"), "q": (0, 0, "none")}


def test_p95_of_good_calls(spark, assets):
    values = [float(v) for v in (3, 3, 3, 500, 0.5, 70, 71, 72, 72, 73, 1000, 4, 9, 2, 8, 6, 6, 6, 15, 16, 17)]
    rows = [("a", 0, v, True) for v in values] + [("a", 0, 9999.0, False), ("b", 99, 5.0, True)]
    got = {r.provider: r for r in stats.provider_benchmark(spark.createDataFrame(rows, "provider string, asset_id long, latency_ms double, ok boolean"), assets([{}])).collect()}
    assert got["a"].p95_latency == sorted(values)[max(0, int(0.95 * len(values)) - 1)] and got["a"].errors == 1 and got["a"].samples == "0,0,0"
    assert got["b"].p95_latency == 0.0 and got["b"].errors == 1 and got["b"].samples == "" and got["b"].success_rate == 0


def test_closest_pair_with_ties_and_nulls(spark):
    rng = random.Random(2)
    rows = [(f"p{i % 3}", i, None if i % 9 == 0 else float(rng.choice([1500, 1500.25, 1501.5, 1490, 1400.125]) if i % 3 else rng.uniform(1000, 2000))) for i in range(120)] + [("lone", 500, 1500.0)]
    got = {r.project_id: (r.gap, r.a, r.b) for r in ratings.closest_pair(spark.createDataFrame(rows, "project_id string, asset_id long, elo double")).collect()}
    want = {}
    for p in ("p0", "p1", "p2"):
        own = sorted((e, i) for q, i, e in rows if q == p and e is not None)
        want[p] = min((y[0] - x[0], x[1], y[1]) for x, y in zip(own, own[1:], strict=False))
    assert got == want
