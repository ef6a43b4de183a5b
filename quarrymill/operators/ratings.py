"""Ratings from pairwise comparisons: ordered folds, undo, and the next pairs to compare."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.quality import priority
from quarrymill.operators.dedup import connected_components
from quarrymill.operators.relations import canonical, last_comparison, zero
from quarrymill.operators.tables import written

MU, SIGMA, ELO, K = 25.0, 25.0 / 3.0, 1500.0, 32.0
BETA, KAPPA = 25.0 / 6.0, 1e-4
LOG = "id long, made_at long, scope long, winner long, loser long, winner_mu_before double, winner_mu_after double, winner_sigma_before double, winner_sigma_after double, loser_mu_before double, loser_mu_after double, loser_sigma_before double, loser_sigma_after double, winner_count int, loser_count int"


def elo_update(w: float, l: float, draw: bool) -> tuple[float, float]:  # noqa: E741
    expected = 1 / (1 + 10 ** ((l - w) / 400))
    gain = K * ((0.5 if draw else 1.0) - expected)
    return w + gain, l - gain


def skill_update(w: tuple[float, float], l: tuple[float, float], draw: bool) -> tuple[tuple[float, float], tuple[float, float]]:  # noqa: E741
    """Plackett-Luce for two (Weng and Lin 2011, algorithm 4)."""
    (mw, sw), (ml, sl) = w, l
    c = math.sqrt(sw * sw + sl * sl + 2 * BETA * BETA)
    pw = 1 / (1 + math.exp((ml - mw) / c))
    # ranked pairs: the winner stands alone in the denominator of place 1; a draw averages both orders
    if draw:
        ow, ol = (0.5 - pw) / c, (pw - 0.5) / c
    else:
        ow, ol = (1 - pw) / c, -(1 - pw) / c
    eta = pw * (1 - pw) / (c * c)
    shrink = lambda s: s * math.sqrt(max(1 - s * s * eta * s / c, KAPPA))
    return (mw + sw * sw * ow, shrink(sw)), (ml + sl * sl * ol, shrink(sl))


def independent(comparisons: DataFrame, scope: str) -> DataFrame:
    """comparisons with grp: those of a scope that share assets, directly or by others between them, have one; comparisons
    of different groups can't change each other's ratings. Missing assets have nothing in common: such a comparison goes with
    its other asset."""
    node = lambda c: F.struct(F.col(scope).alias("scope"), F.col(c).alias("asset"))
    sides = comparisons.select(node("winner").alias("a"), node("loser").alias("b")).filter("a.asset IS NOT NULL AND b.asset IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    labels = connected_components(written(sides, "met")).select("node", "label")
    own = comparisons.withColumn("_own", F.when(F.col("winner").isNotNull(), node("winner")).otherwise(node("loser")))
    return own.join(labels, F.col("_own").eqNullSafe(F.col("node")), "left").withColumn("grp", F.coalesce("label", "_own")).drop("_own", "node", "label")


def replay(comparisons: DataFrame, start: DataFrame, scope: str, engine: str = "elo", split: bool = False) -> DataFrame:
    """The log of all comparisons: values before and after, and counts, in each scope's order (made_at, id).

    start has asset_id, mu and sigma (for elo: mu is the rating); missing assets get the defaults. An order-dependent
    fold is one task per scope, or, if split, per group of assets of a scope that comparisons link. Spark sorts the
    comparisons, and the task folds them batch by batch: it holds the state of a scope's or group's assets and one
    batch, not its comparisons.
    """
    comparisons = independent(comparisons, scope) if split else comparisons.withColumn("grp", F.struct(F.col(scope).alias("scope"), F.lit(None).cast("long").alias("asset")))
    both = comparisons.join(start.select(F.col("asset_id").alias("winner"), F.col("mu").alias("wm"), F.col("sigma").alias("ws")), "winner", "left").join(start.select(F.col("asset_id").alias("loser"), F.col("mu").alias("lm"), F.col("sigma").alias("ls")), "loser", "left")
    mu0, sigma0 = (ELO, 0.0) if engine == "elo" else (MU, SIGMA)

    kinds = [(f.name, pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64()) for f in T.StructType.fromDDL(LOG)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int | None, tuple[float, float, int]] = {}
        of = ()  # the scope and group of the state; none yet
        for batch in batches:
            out = []
            for id_, made_at, own, group, winner, loser, is_draw, wm0, ws0, lm0, ls0 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != (own, group):
                    state, of = {}, (own, group)
                state.pop(None, None)  # missing assets have nothing in common
                for asset, m, s in ((winner, wm0, ws0), (loser, lm0, ls0)):
                    state.setdefault(asset, (mu0 if pd.isna(m) else m, sigma0 if pd.isna(s) else s, 0))
                (wm, ws, wc), (lm, ls, lc) = state[winner], state[loser]
                if engine == "elo":
                    (nw, nl), nws, nls = elo_update(wm, lm, is_draw), ws, ls
                else:
                    (nw, nws), (nl, nls) = skill_update((wm, ws), (lm, ls), is_draw)
                state[winner], state[loser] = (nw, nws, wc + 1), (nl, nls, lc + 1)
                out.append((id_, made_at, own, winner, loser, wm, nw, ws, nws, lm, nl, ls, nls, wc + 1, lc + 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    given = both.select("id", "made_at", F.col(scope).alias("scope"), F.col("grp.asset").alias("grp"), "winner", "loser", "is_draw", "wm", "ws", "lm", "ls")
    in_order = given.repartition("scope", "grp").sortWithinPartitions("scope", "grp", F.asc_nulls_last("made_at"), F.asc_nulls_last("id"))
    return in_order.mapInArrow(fold, LOG)


def final_ratings(log: DataFrame) -> DataFrame:
    """scope, asset_id, mu, sigma and comparisons after the last comparison of each asset."""
    one = lambda s: log.select("scope", F.col(s).alias("asset_id"), F.struct("made_at", "id").alias("o"), F.col(f"{s}_mu_after").alias("mu"), F.col(f"{s}_sigma_after").alias("sigma"), F.col(f"{s}_count").alias("comparisons"))
    every = one("winner").union(one("loser"))
    last = every.groupBy("scope", "asset_id").agg(F.max_by(F.struct("mu", "sigma", "comparisons"), "o").alias("x"))
    return last.select("scope", "asset_id", F.round("x.mu", 6).alias("mu"), F.round("x.sigma", 6).alias("sigma"), "x.comparisons")


def undo_last(assets: DataFrame, comparisons: DataFrame, before: DataFrame) -> DataFrame:
    """Assets after taking back each session's last comparison: the values before it (id, asset_id, mu, elo), counts less one.

    An asset in several last comparisons goes back to before the earliest of them.
    """
    last = last_comparison(comparisons).select("id", "made_at")
    back = before.join(last, "id").groupBy("asset_id").agg(F.min_by(F.struct("mu", "elo"), F.struct("made_at", "id")).alias("b"), F.count("*").alias("undone"))
    n = F.greatest(F.lit(0), F.col("comparisons") - F.coalesce("undone", F.lit(0))).cast("int")
    return assets.join(back, "asset_id", "left").select("asset_id", F.coalesce("b.mu", "mu").alias("mu"), F.coalesce("b.elo", "elo").alias("elo"), n.alias("comparisons"))


def next_pair(pool: DataFrame, seen: DataFrame, k: int = 1, uncertain: bool = False) -> DataFrame:
    """project_id, a, b, score, rank: the k best pairs of each project's bounded pool that were not seen (a, b)."""
    value = priority(*(zero(c) for c in ("training_usefulness", "composite_score", "technical_quality", "face_quality")))
    item = pool.select("project_id", "asset_id", (F.col("mu") - 3 * F.col("sigma")).alias("o"), "comparisons", value.alias("q"), "sigma")
    left, right = (item.select("project_id", *(F.col(c).alias(f"{x}_{c}") for c in item.columns[1:])) for x in "ab")
    pairs = left.join(right, "project_id").filter("a_asset_id < b_asset_id")
    score = F.abs(F.col("a_o") - F.col("b_o")) + 0.8 * (F.col("a_comparisons") + F.col("b_comparisons")) - 0.2 * (F.col("a_q") + F.col("b_q"))
    score = score - 0.6 * (F.col("a_sigma") + F.col("b_sigma")) if uncertain else score
    fresh = pairs.select("project_id", F.col("a_asset_id").alias("a"), F.col("b_asset_id").alias("b"), F.round(score, 6).alias("score")).join(seen.select(*canonical(F.col("a"), F.col("b"))).distinct(), ["a", "b"], "left_anti")
    return fresh.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy("score", "a", "b"))).filter(F.col("rank") <= k)


def sigma_pair(assets: DataFrame, top: int = 5) -> DataFrame:
    """Per project the two most uncertain assets of the top by sigma, which is the pair of the greatest sigma sum."""
    from quarrymill.operators.filters import top_per_project

    first = top_per_project(assets, F.col("sigma"), top).filter("rank <= 2")
    return first.groupBy("project_id").agg(F.min("asset_id").alias("a"), F.max("asset_id").alias("b"), F.round(F.sum("sigma"), 6).alias("sigma_sum")).filter("a <> b")


def closest_pair(assets: DataFrame) -> DataFrame:
    """Per project the neighbours in rating that are closest; the least ids among equals. Null ratings have no neighbour.

    Equal ratings are one value with its least two and greatest ids; values meet within whole points, and the ends of
    these points meet across them, so no task sorts a project's assets.
    """
    rated = assets.filter("elo IS NOT NULL").select("project_id", "elo", "asset_id")
    first = rated.withColumn("n", F.row_number().over(Window.partitionBy("project_id", "elo").orderBy("asset_id"))).filter("n <= 2")
    equal = first.groupBy("project_id", "elo").agg(F.max("n").alias("n"), F.min("asset_id").alias("a"), F.max("asset_id").alias("b")).filter("n = 2").select("project_id", F.lit(0.0).alias("gap"), "a", "b")
    values = rated.groupBy("project_id", "elo").agg(F.min("asset_id").alias("low"), F.max("asset_id").alias("high")).withColumn("point", F.floor("elo"))
    ends = values.groupBy("project_id", "point").agg(F.min(F.struct("elo", "low")).alias("bottom"), F.max(F.struct("elo", "high")).alias("top"))

    def steps(df: DataFrame, own: Window, top: F.Column, bottom: F.Column) -> DataFrame:
        met = df.select("project_id", top.alias("x"), F.lead(bottom).over(own).alias("y")).filter("y IS NOT NULL")
        return met.select("project_id", (F.col("y.elo") - F.col("x.elo")).alias("gap"), F.col("x.high").alias("a"), F.col("y.low").alias("b"))

    within = steps(values, Window.partitionBy("project_id", "point").orderBy("elo"), F.struct("elo", "high"), F.struct("elo", "low"))
    across = steps(ends, Window.partitionBy("project_id").orderBy("point"), F.col("top"), F.col("bottom"))
    return equal.union(within).union(across).groupBy("project_id").agg(F.min(F.struct("gap", "a", "b")).alias("x")).select("project_id", "x.*")
