"""Neighbour joins of fixed and moving points, per group."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoloom.functions.stats import on, z_scores
from cytoloom.operators.spatial import distances, voronoi_blocks, vp_pairs
from cytoloom.runtime import column, cut, free, map_groups


def _points(df: DataFrame, group: Sequence[str], coords: Sequence[str], id_col: str, side: int, more: Sequence[Column] = ()) -> DataFrame:
    p = df.select(*group, F.col(id_col).cast("long").alias("_id"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(coords)], F.lit(side).alias("_side"), *more)
    return p.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*group, "_id")] + [F.col(f"_x{i}").isNotNull() & ~F.isnan(f"_x{i}") & (F.abs(f"_x{i}") < float("inf")) for i in range(len(coords))]))


def _key_columns(df: DataFrame, group: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{g}` {types[g]}, " for g in group)


def radius_pairs(fixed: DataFrame, moving: DataFrame, group: Sequence[str], coords: Sequence[str], id_col: str, radius: float, moving_coords: Sequence[str] | None = None, cap: int = 2048) -> DataFrame:
    """(group, id1, id2, spatial): every moving point within ``radius`` (inclusive) of a fixed one of its group.

    Rows with an unusable coordinate, a null id or group have no partner; empty sides give no pairs."""
    both = cut(_points(fixed, group, coords, id_col, 1).unionByName(_points(moving, group, moving_coords or coords, id_col, 2)))
    xs = [f"_x{i}" for i in range(len(coords))]
    blocks = voronoi_blocks(both, list(group), xs, "_id", radius, cap=cap)

    def pairs(t: pa.Table) -> pa.Table | None:
        side = column(t, "_side")
        q = np.flatnonzero(column(t, "core").astype(bool) & (side == 1))
        other = np.flatnonzero(side == 2)
        if not len(q) or not len(other):
            return None
        x = np.column_stack([column(t, c) for c in xs])
        rows = np.concatenate([other, q])
        i, j, d = vp_pairs(x[rows], np.arange(len(other), len(rows)), radius)
        keep = j < len(other)
        i, j, d = rows[i[keep]], rows[j[keep]], d[keep]
        ids = column(t, "_id")
        return pa.table({**{g: t.column(g).take(i) for g in group}, "id1": ids[i], "id2": ids[j], "spatial": d})

    return map_groups(blocks, [*group, "block"], pairs, _key_columns(both, group) + "id1 long, id2 long, spatial double")


def like_pairs(fixed: DataFrame, moving: DataFrame, group: Sequence[str], coords: Sequence[str], id_col: str, radius: float, cols: Sequence[str], scales: DataFrame, k: int | str, threshold: float | None = None, cap: int = 2048) -> DataFrame:
    """(group, id1, id2, spatial, score): of each fixed point's pairs within ``radius`` the ``k`` of least shape score, ties
    by nearness, then id2. The same as ``top_candidates`` of ``shape_score`` of ``radius_pairs``, but a block ranks its own
    pairs, so a wide radius writes k rows a point. ``k`` may name a column of ``scales``."""
    if not cols:
        raise ValueError("a shape score needs at least one column")
    fs = [f"_f{i}" for i in range(len(cols))]
    more = [*[(F.col(c).cast("double") / F.col(f"scale_{c}")).alias(f) for c, f in zip(cols, fs)], (F.col(k) if isinstance(k, str) else F.lit(k)).cast("int").alias("_k")]
    st = scales.select(*group, *[f"scale_{c}" for c in cols], *([k] if isinstance(k, str) else []))
    both = cut(reduce(DataFrame.unionByName, [_points(on(group, t, st), group, coords, id_col, i, more) for i, t in ((1, fixed), (2, moving))]))
    xs = [f"_x{i}" for i in range(len(coords))]
    blocks = voronoi_blocks(both, list(group), xs, "_id", radius, cap=cap)

    def pairs(t: pa.Table) -> pa.Table | None:
        side, ids, most = column(t, "_side"), column(t, "_id"), column(t, "_k")
        every = np.flatnonzero(column(t, "core").astype(bool) & (side == 1))
        other = np.flatnonzero(side == 2)
        if not len(every) or not len(other):
            return None
        x, f = (np.column_stack([column(t, c) for c in cs]).astype(float) for cs in (xs, fs))
        step = max(1, 1_000_000 // len(other))
        parts = []
        for a in range(0, len(every), step):
            rows = np.concatenate([other, every[a : a + step]])
            i, j, d = vp_pairs(x[rows], np.arange(len(other), len(rows)), radius)
            keep = j < len(other)
            i, j, d = rows[i[keep]], rows[j[keep]], d[keep]
            score = np.sqrt(((f[i] - f[j]) ** 2).mean(1))
            ok = np.isfinite(score) if threshold is None else score <= threshold
            i, j, d, score = i[ok], j[ok], d[ok], score[ok]
            o = np.lexsort((ids[j], d, score, i))
            i, j, d, score = i[o], j[o], d[o], score[o]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            best = rank < most[i]
            parts.append((i[best], j[best], d[best], score[best]))
        i, j, d, score = (np.concatenate(c) for c in zip(*parts))
        return pa.table({**{g: t.column(g).take(i) for g in group}, "id1": ids[i], "id2": ids[j], "spatial": d, "score": score})

    return map_groups(blocks, [*group, "block"], pairs, _key_columns(both, group) + "id1 long, id2 long, spatial double, score double")


WIDE = 8  # dimensions above which balls fill so little of a box that blocks would hold everything
WHOLE = 500_000  # candidates of a group that one task holds


def knn(queries: DataFrame, data: DataFrame | None, group: Sequence[str], coords: Sequence[str], id_col: str, k: int, data_coords: Sequence[str] | None = None, cap: int = 2048) -> DataFrame:
    """(group, id, neighbour, ordinal, distance): the k nearest ``data`` points of each query in its group, ordinal 1 the
    nearest, ties by smaller id. Without ``data`` the queries search each other, never themselves (by id).

    Groups of at most ``WHOLE`` candidates are searched in chunks of queries beside all candidates, which lie in boxes; only
    boxes that may hold a nearer one are looked into. In larger ones a block sees its surroundings up to a radius that suits the
    group's own density and number of dimensions; a query whose k-th neighbour lies beyond it is asked again with a radius
    four times as large, until all are settled, so the result is exact. Above ``WIDE`` dimensions blocks of queries meet
    chunks of the data instead."""
    alone = data is None
    both = _points(queries, group, coords, id_col, 3 if alone else 1)
    if not alone:
        both = both.unionByName(_points(data, group, data_coords or coords, id_col, 2))
    both = cut(both.withColumn("_asks", F.col("_side") != 2))
    xs = [f"_x{i}" for i in range(len(coords))]
    if len(xs) > WIDE:
        return _knn_in_chunks(both, group, xs, k, alone, cap)
    few = k + 1 if alone else k
    asked, found = F.count_if("_asks"), F.count_if(F.col("_side") >= 2)
    chunks = F.greatest(F.least(F.lit(6), F.ceil(asked / 8192)), F.ceil(asked / 131_072), F.lit(1)).cast("int")
    sizes = cut(both.groupBy(*group).agg((found <= max(few, WHOLE)).alias("_whole"), chunks.alias("_chunks")))
    small = _knn_whole(on(group, both, sizes).where("_whole"), group, xs, k, alone)
    if not sizes.where("not _whole").limit(1).count():
        return small
    both = on(group, both, sizes).where("not _whole").drop("_whole", "_chunks")
    ranges = [F.max(c) - F.min(c) for c in xs]
    some = both.where("_side >= 2").groupBy(*group).agg(F.count("*").alias("_n"), *[r.alias(f"_w{i}") for i, r in enumerate(ranges)])
    widest = F.greatest(*[F.col(f"_w{i}") for i in range(len(xs))], F.lit(1e-300)) if len(xs) > 1 else F.greatest("_w0", F.lit(1e-300))
    volume = reduce(lambda a, b: a * b, [F.greatest(F.col(f"_w{i}") / widest, F.lit(1e-3)) for i in range(len(xs))])
    ball = math.pi ** (len(xs) / 2) / math.gamma(len(xs) / 2 + 1)
    some = cut(some.withColumn("_r", 2 * widest * F.pow(k * volume / (ball * F.col("_n")), F.lit(1 / len(xs)))).select(*group, "_r"))
    # places in units of the group's radius
    us = [f"_u{i}" for i in range(len(xs))]
    points = cut(on(group, both, some).withColumns({u: F.col(x) / F.col("_r") for u, x in zip(us, xs)}))
    keys = _key_columns(both, group)

    def search(t: pa.Table, radius: float) -> pa.Table | None:
        side, ids = column(t, "_side"), column(t, "_id")
        q = np.flatnonzero(column(t, "core").astype(bool) & column(t, "_asks").astype(bool))
        at = np.flatnonzero(side >= 2)
        at = at[np.argsort(ids[at], kind="stable")]
        whole = t.column("block")[0].as_py() == ""
        if not len(q):
            return None
        radius = radius * float(column(t, "_r")[0]) * (1 - 1e-9)
        x = np.column_stack([column(t, c) for c in xs])
        parts = []
        step = max(1, 1_000_000 // max(len(at), 1))
        for s in range(0, len(q), step):
            rows = q[s : s + step]
            dd, o = _least(x[rows], x[at], ids[rows] if alone else None, ids[at], k)
            settled = np.full(len(rows), True) if whole else (dd.shape[1] == k) & (dd[:, -1] <= radius if dd.shape[1] else False)
            i, j = np.nonzero(np.isfinite(dd) & settled[:, None])
            parts.append((rows[i], ids[at[o[i, j]]], j + 1, dd[i, j], np.ones(len(i), bool)))
            miss = rows[~settled]
            parts.append((miss, np.zeros(len(miss), np.int64), np.zeros(len(miss), np.int64), np.zeros(len(miss)), np.zeros(len(miss), bool)))
        i, n, o, d, ok = (np.concatenate(c) for c in zip(*parts))
        return pa.table({**{g: t.column(g).take(i) for g in group}, "id": ids[i], "neighbour": n, "ordinal": o.astype(np.int32), "distance": d, "settled": ok})

    done: list[DataFrame] = []
    radius = 1.0
    for _ in range(40):
        blocks = voronoi_blocks(points, list(group), us, "_id", radius, cap=cap)
        r = radius
        got = cut(map_groups(blocks, [*group, "block"], lambda t, r=r: search(t, r), keys + "id long, neighbour long, ordinal int, distance double, settled boolean"))
        done.append(got.where("settled"))
        left = got.where("not settled").select(*group, F.col("id").alias("_again")).distinct()
        if not left.limit(1).count():
            break
        radius *= 4
        again = points.join(left.select(*group).distinct(), list(group), "left_semi") if group else points
        was = points
        points = cut(again.join(left, [again[g] == left[g] for g in group] + [again["_id"] == left["_again"]], "left").select(*[again[c] for c in again.columns if c != "_asks"], (F.col("_again").isNotNull() & (F.col("_side") != 2)).alias("_asks")))
        free(was)
    else:
        raise RuntimeError("some queries are not settled at a radius of 4**40 times the usual")
    return reduce(DataFrame.unionByName, done).drop("settled").unionByName(small)


def _boxes(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of ``x`` in boxes of at most ``most``, halved along the widest side."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= most:
            out.append(at)
            continue
        side = x[at].max(0) - x[at].min(0)
        order = np.argpartition(x[at, side.argmax()], len(at) // 2)
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def _nearest(x: np.ndarray, q: np.ndarray, at: np.ndarray, ids: np.ndarray, k: int, alone: bool):  # noqa: ANN202
    """(rows, positions in ``at``, distances), k a row at most: the nearest of the points ``at``, whose ids ascend, of some of
    the points ``q`` at a time. A k-th distance among the nearest boxes bounds how far others need to be looked into."""
    boxes = [np.sort(b) for b in _boxes(x[at], max(256, 4 * k))]
    low, high = (np.array([f(x[at[b]], 0) for b in boxes]) for f in (np.min, np.max))

    def off(p: np.ndarray) -> np.ndarray:
        s = np.zeros((len(p), len(boxes)))
        for i in range(x.shape[1]):
            s += np.maximum(np.maximum(low[:, i][None] - p[:, i][:, None], p[:, i][:, None] - high[:, i][None]), 0) ** 2
        return np.sqrt(s)

    for part in _boxes(x[q], 64) if len(boxes) > 1 else np.array_split(np.arange(len(q)), max(1, len(q) * len(at) // 1_000_000)):
        rows, see = q[part], np.arange(len(at))
        if not len(rows):
            continue
        if len(boxes) > 1:
            far = off(x[rows])
            first = np.concatenate([boxes[b] for b in np.argsort(far.mean(0), kind="stable")[:4]])
            d = distances(x[rows], x[at[first]], "euclidean")
            if alone:
                d[ids[rows][:, None] == ids[at[first]][None, :]] = np.inf
            bound = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(rows), np.inf)
            near = (far <= (bound * (1 + 1e-12))[:, None]).any(0)
            see = np.sort(np.concatenate([b for b, n in zip(boxes, near) if n]))
        step = max(1, 4_000_000 // len(see))
        for s in range(0, len(rows), step):
            r = rows[s : s + step]
            d, o = _least(x[r], x[at[see]], ids[r] if alone else None, ids[at[see]], k)
            yield r, see[o], d


def _knn_whole(both: DataFrame, group: Sequence[str], xs: list[str], k: int, alone: bool) -> DataFrame:
    """knn of groups whose candidates fit a task: ``_chunks`` parts of the queries, each beside all candidates."""
    own = F.pmod(F.xxhash64("_id"), F.col("_chunks")).cast("int")
    t = both.withColumn("_c", F.explode(F.when(F.col("_side") >= 2, F.sequence(F.lit(0), F.col("_chunks") - 1)).otherwise(F.array(own))))
    t = t.select(*group, "_c", "_id", "_side", (F.col("_asks") & (own == F.col("_c"))).alias("_asks"), *xs)

    def search(t: pa.Table) -> pa.Table | None:
        ids, q = column(t, "_id"), np.flatnonzero(column(t, "_asks").astype(bool))
        at = np.flatnonzero(column(t, "_side") >= 2)
        at = at[np.argsort(ids[at], kind="stable")]
        if not len(q) or not len(at):
            return None
        x = np.column_stack([column(t, c) for c in xs])
        parts = []
        for rows, o, d in _nearest(x, q, at, ids, k, alone):
            i, j = np.nonzero(np.isfinite(d))
            parts.append((rows[i], ids[at[o[i, j]]], j + 1, d[i, j]))
        i, n, o, d = (np.concatenate(c) for c in zip(*parts))
        return pa.table({**{g: t.column(g).take(i) for g in group}, "id": ids[i], "neighbour": n, "ordinal": o.astype(np.int32), "distance": d})

    return map_groups(t, [*group, "_c"], search, _key_columns(both, group) + "id long, neighbour long, ordinal int, distance double")


def _least(q: np.ndarray, x: np.ndarray, me: np.ndarray | None, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least distances of each row of ``q`` to those of ``x``, whose ids ascend, and where they are; an id's own is
    infinite."""
    d = distances(q, x, "euclidean")
    if me is not None:
        d[me[:, None] == ids[None, :]] = np.inf
    if d.shape[1] > 2 * k:  # only what comes up to the k-th is sorted
        i, j = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
        order = np.lexsort((j, d[i, j], i))
        o = j[order[np.arange(len(i)) - np.searchsorted(i, i) < k]].reshape(len(d), k)
    else:
        o = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(d, o, 1), o


def _knn_in_chunks(both: DataFrame, group: Sequence[str], xs: list[str], k: int, alone: bool, cap: int) -> DataFrame:
    """knn by the distances of every query to every candidate of its group: blocks of queries beside chunks of candidates,
    the best k of each chunk ranked together."""
    n = both.groupBy(*group).agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(c) / cap)).cast("int").alias(a) for a, c in (("_nq", F.col("_asks")), ("_nd", F.col("_side") >= 2))])
    h = lambda c: F.pmod(F.xxhash64("_id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    t = on(group, both, n)
    q = t.where("_asks").withColumns({"_b": h("_nq")}).withColumn("_c", every("_nd")).withColumn("_is_query", F.lit(True))
    d = t.where("_side >= 2").withColumns({"_c": h("_nd")}).withColumn("_b", every("_nq")).withColumn("_is_query", F.lit(False))

    def search(t: pa.Table) -> pa.Table | None:
        ask, ids = column(t, "_is_query").astype(bool), column(t, "_id")
        rows, at = np.flatnonzero(ask), np.flatnonzero(~ask)
        if not len(rows) or not len(at):
            return None
        at = at[np.argsort(ids[at], kind="stable")]
        x = np.column_stack([column(t, c) for c in xs])
        parts = []
        step = max(1, 1_000_000 // len(at))
        for s in range(0, len(rows), step):
            r = rows[s : s + step]
            dd, o = _least(x[r], x[at], ids[r] if alone else None, ids[at], k)
            i, j = np.nonzero(np.isfinite(dd))
            parts.append((r[i], ids[at[o[i, j]]], dd[i, j]))
        i, m, dist = (np.concatenate(c) for c in zip(*parts))
        return pa.table({**{g: t.column(g).take(i) for g in group}, "id": ids[i], "neighbour": m, "distance": dist})

    cols = [*group, "_b", "_c", "_is_query", "_id", *xs]
    got = map_groups(q.select(*cols).unionByName(d.select(*cols)), [*group, "_b", "_c"], search, _key_columns(both, group) + "id long, neighbour long, distance double")
    place = F.row_number().over(W.partitionBy(*group, "id").orderBy("distance", "neighbour"))
    return got.withColumn("ordinal", place).where(F.col("ordinal") <= k).select(*group, "id", "neighbour", "ordinal", "distance")


def shape_score(pairs: DataFrame, features: DataFrame, moving: DataFrame, scales: DataFrame, group: Sequence[str], id_col: str, cols: Sequence[str]) -> DataFrame:
    """``pairs`` with ``score``: the root mean square over columns of the scaled feature difference. Missing features make
    the score null. At least one column is needed."""
    if not cols:
        raise ValueError("a shape score needs at least one column")
    a = features.select(F.col(id_col).cast("long").alias("id1"), *[F.col(c).cast("double").alias(f"_a_{c}") for c in cols])
    b = moving.select(F.col(id_col).cast("long").alias("id2"), *[F.col(c).cast("double").alias(f"_b_{c}") for c in cols])
    j = pairs.join(a, "id1").join(b, "id2")
    j = j.join(scales.select(*group, *[f"scale_{c}" for c in cols]), list(group)) if group else j.join(F.broadcast(scales.limit(1)), F.lit(True))
    total: Column = reduce(lambda p, q: p + q, [F.pow((F.col(f"_a_{c}") - F.col(f"_b_{c}")) / F.col(f"scale_{c}"), 2) for c in cols])
    return j.withColumn("score", F.sqrt(total / len(cols))).select(*pairs.columns, "score")


def weighted_pairs(fixed: DataFrame, moving: DataFrame, group: Sequence[str], id_col: str, features: Sequence[str], topology: Sequence[str] = (), weights: tuple[float, float, float] = (1.0, 0.0, 0.0), window: float = 100.0, threshold: float | None = None, cap: int = 2048) -> DataFrame:
    """(group, id1, id2, spatial, distance): every pair within ``window`` pixels, its distance the weighted sum of the distances
    of shape features, of topology features and of normalised places (pos_x_norm, pos_y_norm). Features are standardised
    over both sides of a group. A weight of 0, or no columns, leaves a part out; a cell that misses a value that counts
    has no pairs. A window is needed, as pairs are all compared within it. ``threshold`` leaves out costlier pairs; a block
    weighs its own pairs, so these are never written."""
    parts = [(w, list(c)) for w, c in zip(weights, (features, topology, ("pos_x_norm", "pos_y_norm"))) if w > 0 and len(c)]
    both = fixed.withColumn("_s", F.lit(1)).unionByName(moving.withColumn("_s", F.lit(2)), allowMissingColumns=True)
    names = ordered_union(*[c for _, c in parts])
    z = z_scores(both.select(*group, id_col, "_s", "centroid_x", "centroid_y", *[F.col(c).cast("double").alias(c) for c in names]), group, [c for c in names if not c.startswith("pos_")])
    fs = [f"_f{i}" for i in range(sum(len(c) for _, c in parts))]
    flat = [c for _, cs in parts for c in cs]
    more = [F.col(c).alias(f) for c, f in zip(flat, fs)]
    both = cut(reduce(DataFrame.unionByName, [_points(z.where(F.col("_s") == i), group, ["centroid_x", "centroid_y"], id_col, i, more) for i in (1, 2)]))
    blocks = voronoi_blocks(both, list(group), ["_x0", "_x1"], "_id", window, cap=cap)
    spans = np.cumsum([0, *[len(c) for _, c in parts]]).tolist()

    def pairs(t: pa.Table) -> pa.Table | None:
        side, ids = column(t, "_side"), column(t, "_id")
        every = np.flatnonzero(column(t, "core").astype(bool) & (side == 1))
        other = np.flatnonzero(side == 2)
        if not len(every) or not len(other):
            return None
        x = np.column_stack([column(t, c) for c in ("_x0", "_x1")])
        f = np.column_stack([column(t, c) for c in fs]).astype(float) if fs else np.zeros((len(ids), 0))
        out = []
        step = max(1, 1_000_000 // len(other))
        for a in range(0, len(every), step):
            rows = np.concatenate([other, every[a : a + step]])
            i, j, d = vp_pairs(x[rows], np.arange(len(other), len(rows)), window)
            keep = j < len(other)
            i, j, d = rows[i[keep]], rows[j[keep]], d[keep]
            cost = np.zeros(len(i))
            for (w, _), lo, hi in zip(parts, spans[:-1], spans[1:]):
                cost += w * np.sqrt(((f[i, lo:hi] - f[j, lo:hi]) ** 2).sum(1))
            ok = np.isfinite(cost) if threshold is None else cost <= threshold
            out.append((i[ok], j[ok], d[ok], cost[ok]))
        i, j, d, cost = (np.concatenate(c) for c in zip(*out))
        return pa.table({**{g: t.column(g).take(i) for g in group}, "id1": ids[i], "id2": ids[j], "spatial": d, "distance": cost})

    return map_groups(blocks, [*group, "block"], pairs, _key_columns(both, group) + "id1 long, id2 long, spatial double, distance double")


def ordered_union(*lists: Sequence[str]) -> list[str]:
    """The names of all lists, each once, in the order in which they first come."""
    return list(dict.fromkeys(c for names in lists for c in names))


def top_candidates(pairs: DataFrame, group: Sequence[str], k: int, order: Sequence[str] = ("score", "spatial", "id2"), threshold: float | None = None) -> DataFrame:
    """The k best moving candidates of each fixed cell; those over the threshold, or without a score, don't count."""
    ok = pairs.where("score is not null and not isnan(score)")
    if threshold is not None:
        ok = ok.where(F.col("score") <= threshold)
    r = F.row_number().over(W.partitionBy(*group, "id1").orderBy(*order))
    return ok.withColumn("rank", r).where(F.col("rank") <= k)


def mutual_nearest(fixed: DataFrame, moving: DataFrame, group: Sequence[str], coords: Sequence[str], id_col: str, radius: float, moving_coords: Sequence[str] | None = None) -> DataFrame:
    """Pairs within the radius that are each other's nearest; ties by smaller id. Both nearest are found by a grouped
    least, so neither side is sorted."""
    p = cut(radius_pairs(fixed, moving, group, coords, id_col, radius, moving_coords))
    return mutual_least(p, group, "spatial")


def mutual_least(pairs: DataFrame, group: Sequence[str], cost: str) -> DataFrame:
    """Pairs that cost both of their ends least; ties by (id1, id2)."""
    key = F.struct(F.col(cost), F.col("id1"), F.col("id2"))
    a = pairs.groupBy(*group, "id1").agg(F.min(key).alias("m")).select(*group, "id1", F.col("m.id2").alias("id2"))
    b = pairs.groupBy(*group, "id2").agg(F.min(key).alias("m")).select(*group, F.col("m.id1").alias("id1"), "id2")
    return pairs.join(a, [*group, "id1", "id2"], "left_semi").join(b, [*group, "id1", "id2"], "left_semi")


def displaced_neighbours(pairs: DataFrame, neighbours: DataFrame, fixed: DataFrame, moving: DataFrame, group: Sequence[str], id_col: str, diagonal: Column, tau: float = 0.3) -> DataFrame:
    """Each trusted pair's fixed neighbours, carried over to the moving side by the pair's displacement, and the moving cell
    nearest to where each should be. ``group`` should hold the patch. ``neighbours`` is a knn of the fixed cells.
    Neighbours without any moving cell stay, with ``mapped`` false."""
    f = fixed.select(*group, F.col(id_col).alias("_f"), F.col("centroid_x").alias("_fx"), F.col("centroid_y").alias("_fy"))
    m = moving.select(F.col(id_col).alias("_m"), F.col("centroid_x").alias("_mx"), F.col("centroid_y").alias("_my"))
    p = pairs.select(*group, F.col("id1").alias("anchor_id1"), F.col("id2").alias("anchor_id2"))
    p = p.join(f.select("_f", F.col("_fx").alias("_ax"), F.col("_fy").alias("_ay")), F.col("anchor_id1") == F.col("_f")).drop("_f").join(m, F.col("anchor_id2") == F.col("_m")).drop("_m")
    n = neighbours.select(F.col("id").alias("anchor_id1"), F.col("neighbour").alias("neighbour_id1"), "ordinal")
    q = p.join(n, "anchor_id1").join(f.select(F.col("_f").alias("neighbour_id1"), "_fx", "_fy"), "neighbour_id1")
    q = q.withColumns({"predicted_x": F.col("_mx") + F.col("_fx") - F.col("_ax"), "predicted_y": F.col("_my") + F.col("_fy") - F.col("_ay")})
    q = cut(q.select(*group, "anchor_id1", "anchor_id2", "neighbour_id1", "ordinal", "predicted_x", "predicted_y", F.xxhash64("anchor_id1", "anchor_id2", "neighbour_id1").alias("qid")))
    near = knn(q, moving.withColumn("qid", F.col(id_col)), group, ["predicted_x", "predicted_y"], "qid", 1, ["centroid_x", "centroid_y"])
    out = q.join(near.select(F.col("id").alias("qid"), F.col("neighbour").alias("neighbour_id2"), "distance"), "qid", "left")
    return out.withColumn("dist_norm", F.col("distance") / diagonal).withColumn("mapped", F.coalesce(F.col("dist_norm") <= tau, F.lit(False))).drop("qid")
