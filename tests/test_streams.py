"""Streams over several batches and restarts, and folds by groups of linked assets."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import ratings
from quarrymill.streaming import streams


def batches(spark, folder, frames, at=0):
    for i, df in enumerate(frames, at):
        df.coalesce(1).write.parquet(f"{folder}/part{i:03d}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def test_ratings_go_on_after_a_restart(spark, folder):
    rng = random.Random(2)
    rows = [(i, i, i % 4, *rng.sample(range(12), 2), i % 5 == 0) for i in range(240)]
    schema = "id long, made_at long, session_id long, winner long, loser long, is_draw boolean"
    frames = [spark.createDataFrame(rows[i : i + 60], schema) for i in range(0, 240, 60)]
    base = "file://" + tempfile.mkdtemp(prefix="spark-")
    batches(spark, folder, frames[:2])
    first = streams.ratings(stream(spark, folder, schema), base).count()
    batches(spark, folder, frames[2:], 2)
    seen = []
    got = {(r.session_id, r.asset_id): (r.elo, r.comparisons) for r in streams.ratings(stream(spark, folder, schema), base, seen.append).collect()}
    none = spark.createDataFrame([], "asset_id long, mu double, sigma double")
    want = {(r.scope, r.asset_id): (r.mu, r.comparisons) for r in ratings.final_ratings(ratings.replay(spark.createDataFrame(rows, schema), none, "session_id")).collect()}
    assert got.keys() == want.keys() and 0 < first <= len(got) and seen
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-5) and got[k][1] == want[k][1] for k in want)


def test_late_copies_are_found_and_the_state_stays_small(spark, folder):
    schema = "project_id string, sha256 string, arrived timestamp"
    made = lambda rows: spark.createDataFrame(rows, "project_id string, sha256 string, t long").select("project_id", "sha256", F.timestamp_seconds("t").alias("arrived"))
    days = [[("p", f"{k:02x}{day:02d}", day * 86400 + k) for k in range(50)] for day in range(5)]
    days[3].append(("p", "0000", 3 * 86400))  # a copy that comes three days late
    days[3].append(("q", "0000", 3 * 86400))  # the same content elsewhere is new
    days[2].append(("p", "0502", 2 * 86400 + 5))
    days[3].append(("r", "ffff", 0))  # new, but with a time before all others: still taken
    base = "file://" + tempfile.mkdtemp(prefix="spark-")
    seen = []
    batches(spark, folder, [made(d) for d in days[:4]])
    streams.ingest_dedup(stream(spark, folder, schema), "0 seconds", base, seen.append)
    batches(spark, folder, [made([*days[4], ("p", "0101", 4 * 86400)])], 4)  # after a restart, a copy of day 1
    got = [tuple(r) for r in streams.ingest_dedup(stream(spark, folder, schema), "0 seconds", base, seen.append).collect()]
    assert sorted(got) == sorted([("p", f"{k:02x}{day:02d}") for day in range(5) for k in range(50)] + [("q", "0000"), ("r", "ffff")])
    state = [p["stateOperators"][0]["numRowsTotal"] for p in seen if p["stateOperators"]]
    assert len(state) >= 4 and max(state) <= 110  # of two days at most, not of all


def test_groups_of_linked_assets_fold_apart(spark):
    rng = random.Random(3)
    rows = [(i, i * 37 % 200, i % 2, *(10 * (i % 7) + x for x in rng.sample(range(5), 2)), i % 6 == 0) for i in range(400)]
    rows += [(400, 500, 0, None, 3, False), (401, 501, 0, 3, None, True), (402, 502, 1, None, None, False), (403, 503, None, 1, 2, False)]
    table = spark.createDataFrame(rows, "id long, made_at long, project_id long, winner long, loser long, is_draw boolean")
    start = spark.createDataFrame([(3, 1600.0, 2.0)], "asset_id long, mu double, sigma double")
    groups = ratings.independent(table.filter("id < 400"), "project_id").groupBy("grp").count().collect()
    assert len(groups) == 14 and max(r["count"] for r in groups) <= 30  # a task's chain is one group's
    for engine in ("elo", "plackett_luce"):
        one, other = ({r.id: tuple(r) for r in ratings.replay(table, start, "project_id", engine, split).collect()} for split in (False, True))
        assert one == other and len(one) == 404
    assert ratings.replay(table.limit(0), start, "project_id", split=True).count() == 0
