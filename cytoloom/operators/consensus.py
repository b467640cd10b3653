"""Filters that keep displacements which agree with each other."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoloom.functions.stats import MAD, medians, on
from cytoloom.runtime import column, cut, map_groups


def norm(x: Column | str, y: Column | str) -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.sqrt(x * x + y * y)


def parallel_displacements(matches: DataFrame, reference: DataFrame, by: Sequence[str], max_deg: float = 2.0, pass_short: bool = False) -> DataFrame:
    """Matches whose displacement (dx, dy) is at least 1 long and within ``max_deg`` of the group's reference (dx0, dy0). A
    group whose reference is shorter than 1 has no direction: it keeps nothing, or with ``pass_short`` all."""
    j = on(by, matches, reference.select(*by, F.col("dx0").alias("_dx0"), F.col("dy0").alias("_dy0")))
    n, r = norm("dx", "dy"), norm("_dx0", "_dy0")
    cos = (F.col("dx") * F.col("_dx0") + F.col("dy") * F.col("_dy0")) / F.nullif(n * r, F.lit(0.0))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
    return j.where(F.when(r < 1, F.lit(pass_short)).otherwise((n >= 1) & F.coalesce(angle <= max_deg, F.lit(False)))).select(*matches.columns)


def short_lines(matches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Matches whose line is no longer than the greater of the mean and median + 3 max(1.4826 MAD, 1)."""
    m = matches.withColumn("match_line_length_px", norm("dx", "dy"))
    med = medians(m, by, ["match_line_length_px"])
    dev = on(by, m, med).select(*by, F.abs(F.col("match_line_length_px") - F.col("median_match_line_length_px")).alias("dev"))
    mean = m.groupBy(*by).agg(F.avg("match_line_length_px").alias("_mean"))
    st = on(by, on(by, med, medians(dev, by, ["dev"], "mad_")), mean)
    limit = F.greatest(F.col("_mean"), F.col("median_match_line_length_px") + 3 * F.greatest(MAD * F.col("mad_dev"), F.lit(1.0)))
    return on(by, m, st).where(F.col("match_line_length_px") <= limit).select(*m.columns)


def residual_filter(matches: DataFrame, by: Sequence[str], residual: str, threshold: float, floor: float = 0.5, least: int = 3) -> DataFrame:
    """Matches with a residual of at most max(2 x threshold, median + 3 max(1.4826 MAD, floor)); a group of which fewer than
    ``least`` would stay is left as it is."""
    med = medians(matches, by, [residual])
    dev = on(by, matches, med).select(*by, F.abs(F.col(residual) - F.col(f"median_{residual}")).alias("dev"))
    st = on(by, med, medians(dev, by, ["dev"], "mad_"))
    j = on(by, matches, st).withColumn("_in", F.col(residual) <= F.greatest(F.lit(2 * threshold), F.col(f"median_{residual}") + 3 * F.greatest(MAD * F.col("mad_dev"), F.lit(floor))))
    n = j.groupBy(*by).agg(F.count_if("_in").alias("_n"))
    return on(by, j, n).where(F.col("_in") | (F.col("_n") < least)).select(*matches.columns)


def quantile_prune(matches: DataFrame, by: Sequence[str], residual: str, q: float) -> DataFrame:
    """Matches with a residual of at most the group's q-quantile (linear interpolation)."""
    st = matches.groupBy(*by).agg(F.percentile(residual, q).alias("_q"))
    return on(by, matches, st).where(F.col(residual) <= F.col("_q")).select(*matches.columns)


def _votes(angles: DataFrame, by: Sequence[str], reach: float) -> DataFrame:
    """``angles`` (by, _a, _c: distinct degrees in [0, 360) and how many have them) with _v: how many lie within ``reach``.

    Angles and both limits of each are range-sorted together; how many come before a limit is what came before its range
    plus a running sum within it. So a patch of any size is many tasks, and nothing is paired."""
    at = angles.withColumn("_t", F.explode(F.array(F.col("_a") - 360, F.col("_a"), F.col("_a") + 360))).where((F.col("_t") >= -reach) & (F.col("_t") <= 360 + reach))
    point = at.select(*by, "_t", F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_a"), "_c")
    limit = lambda sign, kind: angles.select(*by, (F.col("_a") + sign * reach).alias("_t"), F.lit(kind).alias("_kind"), "_a", F.lit(0).cast("long").alias("_c"))
    events = point.unionByName(limit(-1, 0)).unionByName(limit(1, 2))
    events = cut(events.repartitionByRange(*by, "_t", "_kind").withColumn("_range", F.spark_partition_id()))
    earlier = events.groupBy(*by, "_range").agg(F.sum("_c").alias("_s"))
    earlier = earlier.withColumn("_before", F.coalesce(F.sum("_s").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    running = F.sum("_c").over(W.partitionBy(*by, "_range").orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow))
    seen = events.withColumn("_run", running).where("_kind <> 1").join(earlier, [*by, "_range"])
    part = F.when(F.col("_kind") == 2, F.col("_run") + F.col("_before")).otherwise(-F.col("_run") - F.col("_before"))
    return seen.groupBy(*by, "_a").agg(F.sum(part).alias("_v"))


def direction_consensus(matches: DataFrame, by: Sequence[str], id_col: str, max_deg: float = 5.0, length_px: float = 5.0) -> DataFrame:
    """Matches that go the way most of their patch goes. ``by`` names the patch.

    In a patch of three or more, every match at least 1 long counts the others within ``max_deg`` (under 180) of its
    direction; the one with most (ties: least id) leads; those within ``max_deg`` of it stay, and of three or more such
    those whose length is within ``length_px`` of their mean. A patch in which the leader has under two votes, or fewer
    than three would stay or all would, is left as it is."""
    m = matches.withColumns({"_n": norm("dx", "dy"), "_a": F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(360.0))})
    size = m.groupBy(*by).agg(F.count("*").alias("_size"))
    v = m.where("_n >= 1").withColumn("_a", F.when(F.col("_a") >= 360, 0.0).otherwise(F.col("_a")))
    votes = _votes(cut(v.groupBy(*by, "_a").agg(F.count("*").alias("_c"))), by, max_deg)
    led = v.groupBy(*by, "_a").agg(F.min(F.struct(F.col(id_col).alias("i"), "dx", "dy", "_n")).alias("_first")).join(votes, [*by, "_a"])
    lead = led.groupBy(*by).agg(F.min(F.struct((-F.col("_v")).alias("v"), "_first")).alias("s"))
    lead = lead.select(*by, (-F.col("s.v")).alias("_lv"), F.col("s._first.dx").alias("_lx"), F.col("s._first.dy").alias("_ly"), F.col("s._first._n").alias("_ln"))
    j = m.join(size, list(by)).join(lead, list(by), "left")
    cos = (F.col("dx") * F.col("_lx") + F.col("dy") * F.col("_ly")) / (F.col("_n") * F.col("_ln") + 1e-8)
    j = j.withColumn("_along", (F.col("_n") >= 1) & (cos >= math.cos(math.radians(max_deg))))
    mean = j.where("_along").groupBy(*by).agg(F.avg("_n").alias("_mean"), F.count("*").alias("_m"))
    j = j.join(mean, list(by), "left").withColumn("_stay", F.col("_along") & ((F.col("_m") < 3) | (F.abs(F.col("_n") - F.col("_mean")) <= length_px)))
    kept = j.groupBy(*by).agg(F.count_if("_stay").alias("_k"))
    j = j.join(kept, list(by))
    applies = (F.col("_size") >= 3) & (F.coalesce("_lv", F.lit(0)) >= 2) & (F.col("_k") >= 3) & (F.col("_k") < F.col("_size"))
    return j.where(~applies | F.coalesce("_stay", F.lit(False))).select(*matches.columns)


def dominant_direction(matches: DataFrame, by: Sequence[str], id_col: str, max_deg: float = 5.0, length_px: float = 5.0) -> DataFrame:
    """The most matches (dx, dy) of each group within ``max_deg`` and ``length_px`` of one of them (ties: least id). All
    pairs of a group are compared, so the caller bounds it."""

    def best(t: pa.Table) -> pa.Table:
        dx, dy = column(t, "dx"), column(t, "dy")
        n, a = np.hypot(dx, dy), np.arctan2(dy, dx)
        turn = np.abs(a[:, None] - a[None, :])
        near = (np.minimum(turn, 2 * np.pi - turn) <= np.radians(max_deg)) & (np.abs(n[:, None] - n[None, :]) <= length_px)
        return t.filter(pa.array(near[near.sum(1).argmax()]))

    return map_groups(matches, list(by), best, ", ".join(f"`{c}` {t}" for c, t in matches.dtypes), sort=[id_col])


def accept_coarse(marked: DataFrame, by: Sequence[str], least: int = 6, ratio: float = 0.35, max_residual: float = 5.0) -> DataFrame:
    """(by, accepted, inliers, inlier_ratio, median_residual) of matches with ransac_inlier and residual_px."""
    g = marked.groupBy(*by).agg(F.count_if("ransac_inlier").alias("inliers"), F.avg(F.col("ransac_inlier").cast("double")).alias("inlier_ratio"), F.median(F.when(F.col("ransac_inlier"), F.col("residual_px"))).alias("median_residual"))
    return g.withColumn("accepted", (F.col("inliers") >= least) & (F.col("inlier_ratio") >= ratio) & F.coalesce(F.col("median_residual") <= max_residual, F.lit(False)))
