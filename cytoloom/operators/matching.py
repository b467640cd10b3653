"""One-to-one assignment of fixed and moving cells, and what checks it."""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoloom.functions.scalar import axis_difference_deg, clean
from cytoloom.functions.stats import on
from cytoloom.runtime import cut, free, map_groups

log = logging.getLogger(__name__)


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def match_report(matches: DataFrame, fixed: DataFrame, moving: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """``matches`` (id1, id2, ...) with ``<col>_1`` and ``<col>_2`` of both cells; missing cells leave nulls."""
    a = fixed.select(F.col(id_col).alias("id1"), *[F.col(c).alias(f"{c}_1") for c in cols])
    b = moving.select(F.col(id_col).alias("id2"), *[F.col(c).alias(f"{c}_2") for c in cols])
    return matches.join(a, "id1", "left").join(b, "id2", "left")


def hard_constraints(matches: DataFrame, max_area_ratio: float = 2.5, max_aspect_ratio: float = 2.0, max_orientation_deg: float = 45.0, min_eccentricity: float = 0.35) -> DataFrame:
    """Keeps matches whose areas, aspect ratios and orientations agree. A test whose columns aren't there is skipped;
    orientation is tested only where both cells are elongated enough to have one."""
    have = set(matches.columns)
    tests: list[Column] = []
    for c, most in (("area", max_area_ratio), ("aspect_ratio", max_aspect_ratio)):
        if {f"{c}_1", f"{c}_2"} <= have:
            a, b = F.greatest(F.col(f"{c}_1"), F.lit(1e-6)), F.greatest(F.col(f"{c}_2"), F.lit(1e-6))
            tests.append(F.greatest(a, b) / F.least(a, b) <= most)
    if {"orientation_1", "orientation_2", "eccentricity_1", "eccentricity_2"} <= have:
        round_ = (F.col("eccentricity_1") < min_eccentricity) | (F.col("eccentricity_2") < min_eccentricity)
        tests.append(round_ | (axis_difference_deg("orientation_1", "orientation_2") <= max_orientation_deg))
    return matches.where(reduce(lambda a, b: a & b, tests)) if tests else matches


#: Open pairs of a group that one task scans in their order.
SCANNED = 250_000


def _scanned(edges: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The greedy pairs of groups small enough for a task: their edges in order, each taken if both its ends are free."""
    types = ", ".join(f"`{c}` {t}" for c, t in edges.dtypes)

    def scan(t: pa.Table) -> pa.Table:
        a, b = (pc.index_in(t.column(c), pc.unique(t.column(c))).to_numpy() for c in ("id1", "id2"))
        partner, taken = [-1] * (int(a.max()) + 1), [False] * (int(b.max()) + 1)
        for i, j in zip(a.tolist(), b.tolist()):
            if partner[i] < 0 and not taken[j]:
                partner[i], taken[j] = j, True
        return t.filter(pa.array(np.array(partner)[a] == b))  # all rows of a pair, as in a round

    edges = edges.where(" and ".join(f"`{c}` is not null" for c in (*group, "id1", "id2")))
    return map_groups(edges, list(group), scan, types, sort=list(order))


def _greedy(edges: DataFrame, group: Sequence[str], order: Sequence[str], patch: str | None = None, left: DataFrame | None = None, most: int = 0, max_rounds: int = 1000) -> DataFrame:
    """Rounds of pairs that are first at both ends, logged; more than ``max_rounds`` raise. Without ``patch``, groups of at most
    ``SCANNED`` open pairs are scanned in a task each instead, larger ones once rounds have left so few. ``most``: what no patch may take
    more than, so that ranks beyond it are cut off before the shuffle. With ``patch``, ``left`` says how many each patch may still take: a
    pair is safe to take if no more than that many open pairs of its patch come up to it in the order."""
    key = F.struct(*order)
    done: list[DataFrame] = []
    edges = cut(edges)
    for round_ in range(max_rounds):
        if not patch:
            hot = edges.groupBy(*group).count().where(F.col("count") > SCANNED).select(*group)
            if not hot.limit(1).count():
                done.append(cut(_scanned(edges, group, order)))
                break
            done.append(cut(_scanned(edges.join(hot, list(group), "left_anti"), group, order)))
            was, edges = edges, cut(edges.join(hot, list(group), "left_semi"))
            free(was)
        open_ = edges
        if patch:
            open_ = edges.join(left.where("_left > 0"), [*group, patch])
        a = open_.groupBy(*group, "id1").agg(F.min(key).alias("_m")).select(*group, "id1", F.col("_m.id2").alias("id2"))
        b = open_.groupBy(*group, "id2").agg(F.min(key).alias("_m")).select(*group, F.col("_m.id1").alias("id1"), "id2")
        first = open_.join(a, [*group, "id1", "id2"], "left_semi").join(b, [*group, "id1", "id2"], "left_semi")
        if patch:
            ranked = open_.withColumn("_rank", F.row_number().over(W.partitionBy(*group, patch).orderBy(*order)))
            safe = ranked.where((F.col("_rank") <= most) & (F.col("_rank") <= F.col("_left"))).select(*group, "id1", "id2")
            first = first.join(safe, [*group, "id1", "id2"], "left_semi").drop("_left")
        picked = cut(first.select(*edges.columns))
        n_picked = picked.count()
        log.info("greedy matching, round %d: %d pairs", round_ + 1, n_picked)
        if not n_picked:
            break
        done.append(picked)
        was = edges
        edges = edges.join(picked.select(*group, "id1"), [*group, "id1"], "left_anti").join(picked.select(*group, "id2"), [*group, "id2"], "left_anti")
        edges = cut(edges)
        free(was)
        if patch:
            n = picked.groupBy(*group, patch).agg(F.count("*").alias("_n"))
            left = cut(left.join(n, [*group, patch], "left").select(*group, patch, (F.col("_left") - F.coalesce("_n", F.lit(0))).alias("_left")))
    else:
        raise RuntimeError(f"pairs are left to match after {max_rounds} rounds")
    return reduce(DataFrame.unionByName, done) if done else edges.limit(0)


def greedy_match(candidates: DataFrame, group: Sequence[str] = (), order: Sequence[str] = ("distance", "id1", "id2"), top_k: int | None = None, threshold: float | None = None) -> DataFrame:
    """One-to-one pairs, best first: what scanning the candidates in order and taking every pair whose ends are free
    gives. Run as rounds of mutually best pairs, which is the same under a total order; ``order`` must end in id1, id2
    or hold both. ``top_k`` keeps the first of each group. Candidates without a finite ``order[0]`` are left out."""
    c = candidates.where(clean(F.col(order[0]).cast("double")).isNotNull())
    if threshold is not None:
        c = c.where(F.col(order[0]) <= threshold)
    got = _greedy(c, group, order) if group else _greedy(c.withColumn("_all", F.lit(0)), ["_all"], order).drop("_all")
    if top_k is None:
        return got
    r = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return got.withColumn("_r", r).where(F.col("_r") <= top_k).drop("_r")


def greedy_per_patch(candidates: DataFrame, group: Sequence[str], per_patch: int, order: Sequence[str] = ("distance", "id1", "id2")) -> DataFrame:
    """Greedy pairs within each group (slide and patch, or slide and cluster), at most ``per_patch`` of each."""
    return greedy_match(candidates, group, order, per_patch)


def patch_balanced_match(candidates: DataFrame, group: Sequence[str], patch: str, top_k: int, threshold: float | None = None, min_per_patch: int = 1, order: Sequence[str] = ("distance", "id1", "id2")) -> DataFrame:
    """Greedy pairs with every patch served: first ``min_per_patch`` of each patch, whatever they cost; then up to an
    equal quota of each; then the best of the rest, up to ``top_k`` in all. ``phase`` says how a pair came in."""
    c = cut(candidates.where(clean(F.col(order[0]).cast("double")).isNotNull()))
    patches = cut(c.select(*group, patch).distinct())
    n = patches.groupBy(*group).agg(F.greatest(F.lit(min_per_patch), F.floor(F.lit(top_k) / F.count("*"))).cast("int").alias("_quota"))
    one = _greedy(c, group, order, patch, patches.withColumn("_left", F.lit(min_per_patch)), min_per_patch).withColumn("phase", F.lit(1))
    rest = c if threshold is None else c.where(F.col(order[0]) <= threshold)

    def unmatched(of: DataFrame, used: DataFrame) -> DataFrame:
        return of.join(used.select(*group, "id1"), [*group, "id1"], "left_anti").join(used.select(*group, "id2"), [*group, "id2"], "left_anti")

    one = cut(one)
    had = one.groupBy(*group, patch).agg(F.count("*").alias("_n"))
    left = on(group, patches, n).join(had, [*group, patch], "left").select(*group, patch, (F.col("_quota") - F.coalesce("_n", F.lit(0))).alias("_left"))
    two = cut(_greedy(unmatched(rest, one), group, order, patch, cut(left), max(min_per_patch, top_k)).withColumn("phase", F.lit(2)))
    both = one.unionByName(two)
    three = _greedy(unmatched(rest, both), group, order).withColumn("phase", F.lit(3))
    out = both.unionByName(three)
    r = F.row_number().over(W.partitionBy(*group).orderBy("phase", *order))
    return out.withColumn("_r", r).where((F.col("phase") == 1) | (F.col("_r") <= top_k)).drop("_r")


def grid_covered(matches: DataFrame, group: Sequence[str], gx: str, gy: str, grid: int, top_k: int, order: Sequence[str]) -> DataFrame:
    """The best of every grid cell, ceil(k / cells) of each, then the best of the rest up to k. The quota is rounded up
    and not cut afterwards, so more than k may come out. ``pick`` is the place: cells first, then what filled up."""
    quota = -(-top_k // (grid * grid))
    m = matches.withColumn("_in", F.row_number().over(W.partitionBy(*group, gx, gy).orderBy(*order)) <= quota)
    n = m.groupBy(*group).agg(F.count_if("_in").alias("_taken"))
    m = on(group, m, n).withColumn("_r", F.row_number().over(W.partitionBy(*group, "_in").orderBy(*order)))
    m = m.where(F.col("_in") | (F.col("_r") <= top_k - F.col("_taken")))
    pick = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("_in"), F.when(F.col("_in"), F.col(gy)), F.when(F.col("_in"), F.col(gx)), *order))
    return m.withColumn("pick", pick).drop("_in", "_r", "_taken")


def match_quality(matches: DataFrame, group: Sequence[str], distance: str = "distance") -> DataFrame:
    """Count, least, greatest, mean, sample deviation and mean confidence of each group's distances."""
    d = clean(F.col(distance))
    c = confidence(matches, group, distance)
    return c.groupBy(*group).agg(F.count(d).alias("n_matches"), F.min(d).alias("min_distance"), F.max(d).alias("max_distance"), F.avg(d).alias("mean_distance"), F.stddev_samp(d).alias("std_distance"), F.avg("confidence").alias("mean_confidence"))


def confidence(matches: DataFrame, group: Sequence[str], distance: str = "distance") -> DataFrame:
    """``confidence`` = 1 - d / (greatest d + 1) in the group; 1 where the greatest isn't above 0."""
    top = matches.groupBy(*group).agg(F.max(clean(F.col(distance))).alias("_top"))
    return on(group, matches, top).withColumn("confidence", F.when(F.col("_top") > 0, 1 - F.col(distance) / (F.col("_top") + 1)).otherwise(F.lit(1.0))).drop("_top")


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-6))


def ambiguity(matches: DataFrame, candidates: DataFrame, group: Sequence[str], distance: str = "distance") -> DataFrame:
    """``ambiguity_ratio`` = d / second best and ``ambiguity_gap`` = second best - d, the second best being the least other
    candidate of either cell. Without one, or with a distance that isn't finite: 0 and infinity.

    The two best of every cell are kept by a grouped top-2, so no cell's candidates are paired with each other."""
    c = candidates.where(clean(F.col(distance)).isNotNull()).select(*group, "id1", "id2", F.col(distance).alias("_d"))

    def best_two(me: str, other: str) -> DataFrame:
        r = F.row_number().over(W.partitionBy(*group, me).orderBy("_d", other))
        return c.withColumn("_r", r).where("_r <= 2").groupBy(*group, me).agg(F.collect_list(F.struct("_d", F.col(other).alias("o"))).alias(f"_b_{me}"))

    j = matches.join(best_two("id1", "id2"), [*group, "id1"], "left").join(best_two("id2", "id1"), [*group, "id2"], "left")
    others = F.concat(F.coalesce(F.filter("_b_id1", lambda s: s.o != F.col("id2")), F.array().cast("array<struct<_d:double,o:bigint>>")), F.coalesce(F.filter("_b_id2", lambda s: s.o != F.col("id1")), F.array().cast("array<struct<_d:double,o:bigint>>")))
    second = F.array_min(F.transform(others, lambda s: s._d))
    d = clean(F.col(distance))
    ok = second.isNotNull() & d.isNotNull()
    j = j.withColumns({"ambiguity_ratio": F.when(ok, d / F.greatest(second, F.lit(1e-9))).otherwise(F.lit(0.0)), "ambiguity_gap": F.when(ok, second - d).otherwise(F.lit(float("inf")))})
    return j.drop("_b_id1", "_b_id2")


def profile_difference(matches: DataFrame, near1: DataFrame, near2: DataFrame) -> DataFrame:
    """``profile_diff``: the median over ordinals of |d1 - d2| / max(d1, d2, 1), of the distances from each matched cell to
    its nearest matched cells on its own side; null where a side has none. ``near1``/``near2`` are knn tables."""
    a = near1.select(F.col("id").alias("id1"), "ordinal", F.col("distance").alias("_d1"))
    b = near2.select(F.col("id").alias("id2"), "ordinal", F.col("distance").alias("_d2"))
    j = matches.select("id1", "id2").join(a, "id1").join(b, ["id2", "ordinal"])
    diff = F.median(F.abs(F.col("_d1") - F.col("_d2")) / F.greatest("_d1", "_d2", F.lit(1.0)))
    return matches.join(j.groupBy("id1", "id2").agg(diff.alias("profile_diff")), ["id1", "id2"], "left")


def validate_matches(matches: DataFrame, group: Sequence[str], cols: Sequence[str], min_confidence: float = 0.0, max_feature_diff: float = 0.5, max_profile_diff: float = 0.35, max_ratio: float = 0.0, min_gap: float = 0.0) -> DataFrame:
    """Keeps matches that are confident (against the greatest distance before any filter), alike in every column (strictly
    under ``max_feature_diff``, tested only between 0 and 1), of a like neighbour profile where ``profile_diff`` is there
    and known, and unambiguous where those columns are there and the limits above 0."""
    m = confidence(matches, group).where(F.col("confidence") >= min_confidence)
    have = set(m.columns)
    if 0 < max_feature_diff < 1:
        for c in cols:
            if {f"{c}_1", f"{c}_2"} <= have:
                m = m.where(relative_difference(F.col(f"{c}_1"), F.col(f"{c}_2")) < max_feature_diff)
    if "profile_diff" in have:
        m = m.where(F.col("profile_diff").isNull() | F.isnan("profile_diff") | (F.col("profile_diff") <= max_profile_diff))
    if max_ratio > 0 and "ambiguity_ratio" in have:
        m = m.where(F.col("ambiguity_ratio") <= max_ratio)
    if min_gap > 0 and "ambiguity_gap" in have:
        m = m.where(F.col("ambiguity_gap") >= min_gap)
    return m


def neighbour_profile(near1: DataFrame, near2: DataFrame, points1: DataFrame, points2: DataFrame, pairs: DataFrame, id_col: str, k: int) -> DataFrame:
    """``pairs`` (id1, id2, ...) with neighbor_distance_diff, neighbor_vector_diff and neighbor_profile_diff.

    Each cell's profile is its k nearest distances (ordinals up to k), padded by the last, and the vectors to those neighbours over their
    median length (at least 1). The distance difference is the median of |d1-d2| / max(d1, d2, 1); the vector difference
    the mean of both sides' median distance to the other's nearest vector; the profile difference the larger."""

    def profile(near: DataFrame, pts: DataFrame, me: str) -> DataFrame:
        p = pts.select(F.col(id_col).alias("_p"), F.col("centroid_x").alias("_x"), F.col("centroid_y").alias("_y"))
        j = near.where(F.col("ordinal") <= k).join(p.select(F.col("_p").alias("id"), F.col("_x").alias("_x0"), F.col("_y").alias("_y0")), "id").join(p.withColumnRenamed("_p", "neighbour"), "neighbour")
        one = F.struct("ordinal", F.col("distance").alias("d"), (F.col("_x") - F.col("_x0")).alias("x"), (F.col("_y") - F.col("_y0")).alias("y"))
        return j.groupBy(F.col("id").alias(me)).agg(F.array_sort(F.collect_list(one)).alias(f"_n_{me}"))  # at most k of each

    j = pairs.join(profile(near1, points1, "id1"), "id1").join(profile(near2, points2, "id2"), "id2")
    kept = [c for c in j.columns if c not in ("_n_id1", "_n_id2")]
    types = ", ".join(f"`{c}` {t}" for c, t in j.dtypes if c in kept) + ", neighbor_distance_diff double, neighbor_vector_diff double, neighbor_profile_diff double"

    def padded(c: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances and scaled vectors of each row, k of each."""
        at = c.offsets.to_numpy()
        at = at[:-1, None] + np.minimum(np.arange(k)[None, :], np.diff(at)[:, None] - 1)
        d, x, y = (c.values.field(n).to_numpy(zero_copy_only=False)[at] for n in "dxy")
        scale = np.maximum(np.median(np.sqrt(x * x + y * y), axis=1), 1.0)[:, None]
        return d, x / scale, y / scale

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            (d1, x1, y1), (d2, x2, y2) = (padded(t.column(c)) for c in ("_n_id1", "_n_id2"))
            dist = np.median(np.abs(d1 - d2) / np.maximum(np.maximum(d1, d2), 1.0), axis=1)
            apart = np.sqrt((x1[:, :, None] - x2[:, None, :]) ** 2 + (y1[:, :, None] - y2[:, None, :]) ** 2)
            vec = (np.median(apart.min(2), axis=1) + np.median(apart.min(1), axis=1)) / 2
            out = t.select(kept)
            for name, v in (("neighbor_distance_diff", dist), ("neighbor_vector_diff", vec), ("neighbor_profile_diff", np.maximum(dist, vec))):
                out = out.append_column(name, pa.array(v))
            yield out

    return j.mapInArrow(compare, types)
