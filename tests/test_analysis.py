"""Stages that fail apart, colours that are known, and agreement within projects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import legacy_report
from quarrymill.operators.analysis import Stage, analyse, asset_stages, ordered
from quarrymill.operators.colour import lab, skin_tones, tone_consistency


@pytest.fixture(scope="module")
def inputs(spark):
    rng = np.random.default_rng(1)
    image = lambda: bytearray(rng.integers(0, 256, 24 * 24 * 3, dtype=np.uint8).tobytes())
    images = spark.createDataFrame([(i, 24 if i != 2 else -1, 24 if i != 2 else -1, 3, image()) for i in range(5)], "doc_id long, height int, width int, channels int, data binary")
    faces = spark.createDataFrame([(0, 0.9), (1, None), (2, 0.5), (3, 0.4)], "doc_id long, face double")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "doc_id long, embedding array<double>")
    labels = spark.createDataFrame([("scene", "street", [1.0, 0.0]), ("scene", "studio", [0.0, 1.0])], "grp string, tag string, q array<double>")
    assets = spark.createDataFrame([(i, "p", "00000000000000ff" if i < 2 else None) for i in range(5)], "asset_id long, project_id string, phash string")
    return images, faces, vectors, labels, assets


def result(spark, stages):
    made = analyse(spark.range(5).withColumnRenamed("id", "doc_id").withColumn("other", F.lit("x")), "doc_id", stages)
    return {r.doc_id: r for r in made.collect()}


def test_stages_of_an_asset(spark, inputs):
    got = result(spark, asset_stages("doc_id", *inputs))
    assert len(got) == 5 and got[0].other == "x"
    assert [got[i].face_error for i in range(5)] == [None, "no face", None, None, "no result"]
    assert [got[i].vector_error for i in range(5)] == [None, None, None, None, "no result"]
    assert [got[i].scene_class for i in range(5)] == ["studio", "street", "street", "street", None]
    assert [got[i].quality_error for i in range(5)] == [None, None, "undecodable", None, None]
    assert [got[i].duplicate_of for i in range(5)] == [0, 0, None, None, None] and got[2].duplicate_error == "no hash" and got[0].duplicate_error is None
    assert got[0].composite > 0 and got[2].composite is None and got[4].composite > 0


@pytest.mark.parametrize("name", ["face", "vector", "scene", "quality", "duplicate"])
def test_a_broken_stage_leaves_the_others(spark, inputs, name):
    whole = result(spark, asset_stages("doc_id", *inputs))
    stages = asset_stages("doc_id", *inputs)
    broken = next(s for s in stages if s.name == name)
    columns = [part.split()[0] for part in broken.columns.split(", ")]
    # fails in a task, or, for one of the stages, before there is a plan
    broken.run = (lambda made: spark.table("not_there")) if name == "vector" else (lambda made: spark.range(5).select(F.col("id").alias("doc_id"), *(F.raise_error(F.lit("model is gone")).alias(c) for c in columns)))
    got = result(spark, stages)
    for i in range(5):
        assert got[i][f"{name}_error"] and all(got[i][c] is None for c in columns)
        for s in stages:
            if s.name not in (name, "quality"):
                assert got[i][f"{s.name}_error"] == whole[i][f"{s.name}_error"]
                assert all(got[i][c.split()[0]] == whole[i][c.split()[0]] for c in s.columns.split(", "))
    if name == "face":  # the quality has nothing from it, and goes on
        assert got[0].composite is not None and got[0].quality_error is None


def test_order_of_stages():
    one = lambda name, *needs: Stage(name, "x int", lambda made: None, needs)
    assert [s.name for s in ordered([one("c", "b"), one("a"), one("b", "a")])] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="need each other"):
        ordered([one("a", "b"), one("b", "a")])


def test_known_colours():
    """By the published values of the sRGB primaries, white, black and middle grey, scaled to 8 bits."""
    rgb = np.array([[255, 255, 255], [0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255], [119, 119, 119]], float)
    known = np.array([[100, 0, 0], [0, 0, 0], [53.24, 80.09, 67.2], [87.73, -86.18, 83.18], [32.3, 79.19, -107.86], [50.03, 0, 0]])
    assert np.abs(lab(rgb) - (known * [2.55, 1, 1] + [0, 128, 128])).max() <= 1


def test_skin_tones_of_the_inner_face(spark):
    red, wide = np.zeros((40, 60, 3), np.uint8), np.full((40, 60, 1), 119, np.uint8)
    red[:, :, 1] = 255  # green around
    red[15:25, 25:35] = (0, 0, 255)  # red within, as BGR
    rows = [(0, 40, 60, 3, bytearray(red.tobytes()), 20.0, 10.0, 40.0, 30.0), (1, 40, 60, 1, bytearray(wide.tobytes()), -5.0, -5.0, 80.0, 60.0), (2, 40, 60, 3, bytearray(red.tobytes()), 90.0, 90.0, 99.0, 99.0), (3, -1, -1, 3, None, 0.0, 0.0, 9.0, 9.0), (4, 40, 60, 3, bytearray(red.tobytes()), None, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "k long, height int, width int, channels int, data binary, x1 double, y1 double, x2 double, y2 double")
    got = {r.k: (r.l, r.a, r.b) for r in skin_tones(df, "k").collect()}
    assert got == {0: (136.0, 208.0, 195.0), 1: (128.0, 128.0, 128.0), 2: (50.0, 0.0, 0.0), 3: (None, None, None), 4: (None, None, None)}


def test_agreement_within_projects(spark):
    tones = spark.createDataFrame([("p", 100.0, 128.0, 128.0), ("p", 120.0, 129.0, 128.0), ("q", 100.0, 128.0, 128.0), ("q", 104.0, 130.0, 128.0), ("r", 1.0, 1.0, 1.0), ("r", None, None, None)], "project_id string, l double, a double, b double")
    assert {r.project_id: (r.std_l, r.consistent) for r in tone_consistency(tones).collect()} == {"p": (10.0, False), "q": (2.0, True)}
    faces = spark.createDataFrame([("p", 2, [1.0, 0.0]), ("p", 5, [0.0, 1.0]), ("p", 6, [1.0, 1.0]), ("q", 1, [1.0, 0.0])], "project_id string, position long, embedding array<double>")
    got = [tuple(r) for r in legacy_report.identity_agreement(faces).collect()]
    assert got == [("p", 0.3536, 0.0, 0.7071, 1)]


def test_stages_that_compress_well_are_not_broadcast(spark):
    """A stage's table is small as a file; its rows would all go through the driver."""
    n = 800_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0.5).alias("s"))
    made = analyse(spark.range(n).withColumnRenamed("id", "doc_id"), "doc_id", [Stage("t", "s double", lambda _: rows)])
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.filter("s = 0.5 AND t_error IS NULL").count() == n
