"""Queries of operators.dedup and operators.vectors. The test vectors are far apart, so thresholds are low."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.operators import dedup as d
from quarrymill.operators import vectors as v
from quarrymill.plans.registry import register

COS = "round(list_cosine_similarity(CAST({a}.embedding AS DOUBLE[]), CAST({b}.embedding AS DOUBLE[])), 6)"
PAIR = COS.format(a="x", b="y")
PAIRS = f"SELECT x.vec_id AS a, y.vec_id AS b, {PAIR} AS similarity FROM vectors x JOIN vectors y ON x.project_id = y.project_id AND x.vec_id < y.vec_id WHERE {PAIR} >= 0.3"
ONE = "SELECT embedding FROM vectors WHERE vec_id = {i}"

queries = lambda t: t.vectors.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "project_id", "embedding AS q")
register(
    "vector_topk", lambda t: v.vector_topk(queries(t), t.vectors, 5, 0.1),
    f"SELECT query_id, vec_id, score, rank FROM (SELECT x.vec_id AS query_id, y.vec_id, {PAIR} AS score, row_number() OVER (PARTITION BY x.vec_id ORDER BY {PAIR} DESC, y.vec_id) AS rank FROM vectors x JOIN vectors y ON x.project_id = y.project_id WHERE x.vec_id % 20 = 0 AND {PAIR} >= 0.1) WHERE rank <= 5",
)
register("cosine_pairs", lambda t: v.cosine_pairs(t.vectors, 0.3), PAIRS)
register(
    "uniqueness_redundancy", lambda t: v.uniqueness_redundancy(t.vectors, v.cosine_pairs(t.vectors, 0.3)),
    f"""WITH p AS ({PAIRS}), b AS (SELECT a AS vec_id, similarity FROM p UNION ALL SELECT b, similarity FROM p), g AS (SELECT vec_id, count(*) AS n, max(similarity) AS most FROM b GROUP BY 1)
       SELECT vectors.vec_id, coalesce(n, 0) AS neighbours, round(1 - coalesce(most, 0), 6) AS uniqueness, round(coalesce(n, 0) / (coalesce(n, 0) + 1), 6) AS redundancy FROM vectors LEFT JOIN g ON vectors.vec_id = g.vec_id""",
)
register(
    "embedding_diversity", lambda t: v.embedding_diversity(t.vectors),
    """WITH p AS (SELECT x.project_id, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS s FROM vectors x JOIN vectors y ON x.project_id = y.project_id AND x.vec_id <> y.vec_id),
       u AS (SELECT project_id, i, CAST(embedding[i + 1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS x FROM vectors CROSS JOIN range(64) r(i)), w AS (SELECT project_id, round(avg(sd), 6) AS spread FROM (SELECT project_id, i, stddev_pop(x) AS sd FROM u GROUP BY 1, 2) GROUP BY 1),
       d AS (SELECT p.project_id, any_value(n) AS n, round(avg(s), 6) AS mean_similarity, round(stddev_pop(s), 6) AS sd_similarity, round(min(s), 6) AS min_similarity, CAST(least(greatest(floor((1 - avg(s)) * 200), 0), 100) AS INT) AS diversity FROM p JOIN (SELECT project_id, count(*) AS n FROM vectors GROUP BY 1) c ON p.project_id = c.project_id GROUP BY 1)
       SELECT d.*, spread, CASE WHEN diversity >= 60 THEN 'excellent' WHEN diversity >= 40 THEN 'good' WHEN diversity >= 25 THEN 'moderate' ELSE 'low' END AS assessment FROM d JOIN w ON d.project_id = w.project_id""",
)
register(
    "identity_consistency", lambda t: v.identity_consistency(t.vectors, t.vectors.filter("vec_id < 4").selectExpr("project_id", "embedding AS q"), 0.05),
    f"SELECT project_id, round(avg(s), 5) AS mean, min(s) AS least, max(s) AS greatest, count(*) FILTER (s < 0.05) AS outliers FROM (SELECT y.project_id, {PAIR} AS s FROM vectors x JOIN vectors y ON x.project_id = y.project_id WHERE x.vec_id < 4) GROUP BY 1",
)
register(
    "cluster_centroids", lambda t: v.cluster_centroids(t.vectors),
    """WITH u AS (SELECT label, CAST(i AS INT) AS i, CAST(embedding[i + 1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS x FROM vectors CROSS JOIN range(64) r(i)), m AS (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2)
       SELECT label, i, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM m""",
)
register(
    "merge_identities", lambda t: v.merge_identities(t.assets, t.spark.range(1, 6).selectExpr("concat('p', id) AS source", "concat('p', id + 1) AS target")),
    "SELECT CASE WHEN identity_cluster_id IN ('p1', 'p2', 'p3', 'p4', 'p5', 'p6') THEN 'p1' ELSE identity_cluster_id END AS identity, count(*) AS n, CAST(sum(face_count) AS BIGINT) AS faces FROM assets WHERE identity_cluster_id IS NOT NULL GROUP BY 1",
)
register("face_pair_similarity", lambda t: v.face_pair_similarity(t.vectors, t.vectors.filter("vec_id = 7").select(F.col("embedding").alias("q"))), f"SELECT vec_id, similarity, CAST(least(greatest(floor((similarity + 1) / 2 * 100), 0), 100) AS INT) AS percent FROM (SELECT y.vec_id, {PAIR} AS similarity FROM vectors x CROSS JOIN vectors y WHERE x.vec_id = 7)")
tags = lambda t: t.vectors.filter("vec_id < 8").selectExpr("concat('tag', vec_id) AS tag", "embedding AS q")
register(
    "zero_shot_tags", lambda t: v.zero_shot_tags(t.vectors, tags(t)),
    f"""WITH e AS (SELECT y.vec_id, 'tag' || x.vec_id AS tag, exp(10.0::DOUBLE * list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))) AS e FROM vectors x CROSS JOIN vectors y WHERE x.vec_id < 8), p AS (SELECT vec_id, tag, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM e)
       SELECT * FROM (SELECT vec_id, tag, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, tag) AS rank FROM p) WHERE rank <= 5 AND p > 0.05""",
)
GROUPS = {"scene": ["street", "studio", "office", "forest", "beach", "kitchen", "stage"], "place": ["indoor scene", "outdoor scene"], "light": ["soft light", "hard light", "backlight", "neon"], "object": ["chair", "car", "lamp", "dog", "book", "tree"], "background": ["plain wall", "cluttered room", "gradient", "busy street"]}
LABELS = " UNION ALL ".join(f"SELECT {i} AS vec_id, '{g}' AS grp, '{tag}' AS tag" for i, (g, tag) in enumerate((g, tag) for g, tags in GROUPS.items() for tag in tags))
words = lambda c, n, least: f"coalesce(string_agg(tag, ',' ORDER BY rank) FILTER (grp = '{c}' AND rank <= {n} AND p {least}::DOUBLE), '')"
register(
    "scene_tags", lambda t: v.scene_tags(t.vectors, t.spark.sql(LABELS).join(t.vectors.selectExpr("vec_id", "embedding AS q"), "vec_id"), 4.0),
    f"""WITH k AS ({LABELS}), e AS (SELECT y.vec_id, grp, tag, exp(4.0::DOUBLE * list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))) AS e FROM k JOIN vectors x ON k.vec_id = x.vec_id CROSS JOIN vectors y),
       p AS (SELECT *, row_number() OVER (PARTITION BY vec_id, grp ORDER BY p DESC, tag) AS rank FROM (SELECT vec_id, grp, tag, round(e / sum(e) OVER (PARTITION BY vec_id, grp), 6) AS p FROM e))
       SELECT vec_id, min(tag) FILTER (grp = 'scene' AND rank = 1) AS scene_class, {words("scene", 5, "> 0.05")} AS scene_tags, min(tag) FILTER (grp = 'place' AND rank = 1) = 'indoor scene' AS is_indoor, {words("light", 3, "> 0.1")} AS lighting_tags, {words("object", 5, ">= 0.08")} AS object_tags,
         round(coalesce(min(p) FILTER (grp = 'background' AND tag = 'cluttered room'), 0), 3) AS clutter, min(tag) FILTER (grp = 'background' AND rank = 1) IN ('plain wall', 'gradient') AS plain FROM p GROUP BY 1""",
)
register(
    "prompt_contrast_score", lambda t: v.prompt_contrast(t.vectors, t.vectors.filter("vec_id < 6").selectExpr("vec_id % 2 = 0 AS positive", "embedding AS q")),
    """SELECT vec_id, contrast, CAST(least(greatest(floor((contrast + 0.3) / 0.6 * 100), 0), 100) AS INT) AS score FROM (SELECT y.vec_id, round(avg(s) FILTER (x % 2 = 0) - avg(s) FILTER (x % 2 = 1), 6) AS contrast FROM (SELECT x.vec_id AS x, y.vec_id, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS s FROM vectors x CROSS JOIN vectors y WHERE x.vec_id < 6) y GROUP BY 1)""",
)
register("index_backfill", lambda t: v.index_backfill(t.assets, t.vectors), "SELECT project_id, count(*) AS total, count(*) - count(vec_id) AS todo, count(vec_id) AS indexed FROM assets LEFT JOIN vectors ON asset_id = vec_id GROUP BY 1".replace("SELECT project_id", "SELECT assets.project_id"))
#: A scan in SQL: each step of the recursion takes the next node (nb: k, i, lesser neighbours) and adds it to the leaders if no neighbour of it is one.
SCAN = """s AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS led UNION ALL SELECT nb.k, CASE WHEN len(list_intersect(led, lesser)) = 0 THEN list_append(led, i) ELSE led END FROM s JOIN nb ON nb.k = s.k + 1),
  z AS (SELECT led FROM s ORDER BY k DESC LIMIT 1)"""
NEAR = "nb AS (SELECT vec_id AS i, row_number() OVER (ORDER BY vec_id) AS k, coalesce(list(a) FILTER (a IS NOT NULL), CAST([] AS BIGINT[])) AS lesser FROM vectors LEFT JOIN p ON b = vec_id GROUP BY vec_id)"
register(
    "dup_embedding", lambda t: v.leader_clusters(t.vectors, 0.3),
    f"""WITH RECURSIVE p AS ({PAIRS}), {NEAR}, {SCAN}, f AS (SELECT i AS node, coalesce(list_min(list_intersect(led, lesser)), i) AS leader FROM nb CROSS JOIN z)
       SELECT node, leader, coalesce(similarity, 1.0::DOUBLE) AS similarity FROM f LEFT JOIN p ON a = leader AND b = node WHERE node <> leader OR node IN (SELECT leader FROM f WHERE node <> leader)""",
)
register("embedding_regions", lambda t: v.embedding_regions(t.vectors, 0.3), f"WITH RECURSIVE p AS ({PAIRS.replace('>= 0.3', '> 0.3')}), {NEAR}, {SCAN} SELECT project_id, count(*) AS regions FROM vectors JOIN (SELECT unnest(led) AS vec_id FROM z) USING (vec_id) GROUP BY 1")
#: Places in the scan over primary vectors stand for assets: by face_index, then asset.
FACE_COS = COS.format(a="x", b="y")
QUALITY = "row(coalesce(composite_score, 0), coalesce(training_usefulness, 0), coalesce(technical_quality, 0), coalesce(face_quality, 0), coalesce(aesthetic_score, 0), coalesce(uniqueness_score, 0), -coalesce(redundancy_score, 0), width * height, asset_id)"
register(
    "dup_face", lambda t: v.face_duplicates(t.faces, t.assets, 0.25),
    f"""WITH RECURSIVE w AS (SELECT * FROM faces QUALIFY row_number() OVER (PARTITION BY project_id, asset_id ORDER BY face_index, vec_id) = 1), m AS (SELECT *, row_number() OVER (ORDER BY face_index, asset_id) AS k FROM w),
       p AS (SELECT x.k AS a, y.k AS b FROM m x JOIN m y ON x.project_id = y.project_id AND x.k < y.k WHERE {FACE_COS} >= 0.25), nb AS (SELECT k, k AS i, coalesce(list(a) FILTER (a IS NOT NULL), CAST([] AS BIGINT[])) AS lesser FROM m LEFT JOIN p ON b = k GROUP BY k), {SCAN},
       f AS (SELECT i AS node, coalesce(list_min(list_intersect(led, lesser)), i) AS leader FROM nb CROSS JOIN z), c AS (SELECT node, leader FROM f WHERE node <> leader OR node IN (SELECT leader FROM f WHERE node <> leader)),
       n AS (SELECT x.asset_id, y.asset_id AS cluster, x.embedding FROM c JOIN m x ON x.k = node JOIN m y ON y.k = leader), r AS (SELECT cluster, arg_max(a.asset_id, {QUALITY.replace("asset_id)", "a.asset_id)")}) AS representative FROM n JOIN assets a ON a.asset_id = n.asset_id GROUP BY 1)
       SELECT x.asset_id, x.cluster, representative, CASE WHEN x.asset_id <> representative THEN {FACE_COS} END AS similarity FROM n x JOIN r ON r.cluster = x.cluster JOIN n y ON y.asset_id = representative""",
)
register(
    "identity_dbscan", lambda t: v.identity_dbscan(t.vectors, 0.68),
    f"""WITH RECURSIVE p AS ({PAIRS.replace("0.3", "0.32")}), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
       SELECT vec_id, cluster FROM vectors LEFT JOIN (SELECT a, least(a, min(b)) AS cluster FROM r GROUP BY a) ON a = vec_id""",
)
register("identity_clusters", lambda t: v.identity_clusters(t.faces, 0.7))
register("identity_assets", lambda t: v.asset_identities(t.faces, v.identity_clusters(t.faces, 0.7), t.assets))

register("dup_exact", lambda t: d.dup_exact(t.assets), "SELECT * FROM (SELECT project_id, asset_id, min(asset_id) OVER (PARTITION BY project_id, sha256_hash) AS cluster, count(*) OVER (PARTITION BY project_id, sha256_hash) AS n FROM assets) WHERE n > 1")
H = "(SELECT DISTINCT project_id, CAST(('0x' || phash) AS BIGINT) AS h FROM assets WHERE phash IS NOT NULL)"
register("phash_pairs", lambda t: d.phash_pairs(t.assets), f"SELECT x.project_id, x.h AS h1, y.h AS h2, CAST(bit_count(xor(x.h, y.h)) AS INT) AS d FROM {H} x JOIN {H} y ON x.project_id = y.project_id AND x.h < y.h WHERE bit_count(xor(x.h, y.h)) <= 8")
CLOSURE = f"""WITH RECURSIVE a AS (SELECT project_id, asset_id, CAST(('0x' || phash) AS BIGINT) AS h FROM {{src}} WHERE phash IS NOT NULL),
  e AS (SELECT x.asset_id AS a, y.asset_id AS b FROM a x JOIN a y ON x.project_id = y.project_id AND x.asset_id <> y.asset_id AND bit_count(xor(x.h, y.h)) <= 8),
  r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"""
register("dup_phash", lambda t: d.dup_phash(t.assets), CLOSURE.format(src="assets") + " SELECT project_id, asset_id, cluster FROM (SELECT a AS asset_id, least(a, min(b)) AS cluster FROM r GROUP BY a) c JOIN a USING (asset_id)")
ALONE = "SELECT * FROM assets WHERE NOT is_rejected QUALIFY count(*) OVER (PARTITION BY project_id, sha256_hash) = 1"
register(
    "dup_layered_content", lambda t: d.dup_layered(t.assets),
    CLOSURE.format(src=f"({ALONE})") + """ SELECT a AS asset_id, least(a, min(b)) AS cluster, 'phash' AS type FROM r GROUP BY a
       UNION ALL SELECT asset_id, min(asset_id) OVER (PARTITION BY project_id, sha256_hash), 'exact' FROM assets WHERE NOT is_rejected QUALIFY count(*) OVER (PARTITION BY project_id, sha256_hash) > 1""",
)
register("dup_layered", lambda t: d.dup_layered(t.assets, links=v.cosine_pairs(t.vectors, 0.3).select("a", "b"), faces=lambda rest: v.face_duplicates(t.faces.join(rest, "asset_id"), t.assets, 0.3)))
