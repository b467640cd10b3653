"""Voronoi blocks and radius joins.

Points are split per group around pivots; a point is copied to every block in which a partner within the
radius may live. Blocks are bounded, so each fits a task, and every pair within the radius meets in the
block that holds its first point.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.runtime import column, cut, map_groups, take_bounded, usable

EARTH_M = 6_371_008.8


def _unit(lonlat: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(lonlat[:, 0]), np.radians(lonlat[:, 1])
    return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances between the rows of ``a`` and of ``b``: Euclidean, or great-circle metres over (longitude, latitude) in
    degrees, from the chords to the point and to its antipode, which keeps them exact to nanometres everywhere."""
    if metric == "haversine":
        a, b = _unit(a), _unit(b)
        apart = sum((a[:, i][:, None] - b[:, i][None, :]) ** 2 for i in range(3))
        across = sum((a[:, i][:, None] + b[:, i][None, :]) ** 2 for i in range(3))
        return 2 * EARTH_M * np.arctan2(np.sqrt(apart), np.sqrt(across))
    s = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        s += (a[:, i][:, None] - b[:, i][None, :]) ** 2
    return np.sqrt(s)


def _rounding(metric: str, far: np.ndarray | float) -> np.ndarray | float:
    """More than the error of a sum of distances of up to ``far`` each."""
    return 1e-6 if metric == "haversine" else 1e-14 * far


def vp_pairs(x: np.ndarray, queries: np.ndarray, radius: float, metric: str = "euclidean", leaf: int = 48) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (query, point) and distance of all pairs within ``radius``, by a vantage-point tree over ``x``
    that is descended by all queries at once. A point is a partner of itself."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def brute(idx: np.ndarray, q: np.ndarray) -> None:
        step = max(1, 1_000_000 // max(len(idx), 1))
        for s in range(0, len(q), step):
            part = q[s : s + step]
            d = distances(x[part], x[idx], metric)
            i, j = np.nonzero(d <= radius)
            found.append((part[i], idx[j], d[i, j]))

    stack = [(np.arange(len(x)), np.asarray(queries))]
    while stack:
        idx, q = stack.pop()
        if not len(q) or not len(idx):
            continue
        if len(idx) <= leaf:
            brute(idx, q)
            continue
        vantage = x[idx[len(idx) // 2]][None, :]
        d = distances(x[idx], vantage, metric)[:, 0]
        mu = np.median(d)
        near = d <= mu
        if near.all():  # at least half the points are equally far
            near = d < mu
            if not near.any():
                brute(idx, q)
                continue
            mu = d[near].max()
        dq = distances(x[q], vantage, metric)[:, 0]
        slack = _rounding(metric, max(d.max(), dq.max()) + radius)  # rounding must not lose a pair
        stack.append((idx[near], q[dq - radius - slack <= mu]))
        stack.append((idx[~near], q[dq + radius + slack >= d[~near].min()]))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*found))


def _assign(x: np.ndarray, core: np.ndarray, pivots: np.ndarray, radius: float, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, pivot and core flag: a core point's own cell, and every cell that may hold a core point within the
    radius (by the triangle inequality: its pivot is at most two radii farther than the nearest)."""
    d = distances(x, pivots, metric)
    own = d.argmin(axis=1)
    least = d[np.arange(len(x)), own]
    near = d <= (least + 2 * radius + _rounding(metric, d.max(axis=1) + radius))[:, None]
    near[np.arange(len(x)), own] = True
    rows, piv = np.nonzero(near)
    return rows, piv, core[rows] & (piv == own[rows])


def voronoi_blocks(points: DataFrame, group: Sequence[str], coords: Sequence[str], id_col: str, radius: float, cap: int = 2048, fanout: int = 64, metric: str = "euclidean", max_levels: int = 8, driver_blocks: int = 2000) -> DataFrame:
    """``points`` with a ``block`` and a ``core`` flag; the key of a block is (group columns, block).

    Groups of at most ``cap`` points are one block. Larger ones, however hot, are parted around up to
    ``fanout`` pivots drawn from them by a hash of the id, level by level until no block has more than
    ``cap`` core points. Copies of one place can't be parted so: what they leave too large becomes several blocks of
    the same points, each with its share of the core.
    At most ``driver_blocks`` x ``fanout`` pivots pass through the driver; beyond that they are joined.
    ``points`` must be materialised (see ``cut``), as it is read once per level; coordinates must be usable.
    """
    spark = points.sparkSession
    keys = [*group, "block"]
    cols = points.columns
    todo = points.withColumns({"block": F.lit(""), "core": F.lit(True)})
    done: list[DataFrame] = []
    before = None
    for level in range(max_levels + 1):
        heavy = todo.where("core").groupBy(*keys).count().where(F.col("count") > cap)
        total = heavy.agg(F.count("*").alias("n"), F.sum("count").alias("s")).first() if level else None
        rows = take_bounded(heavy, driver_blocks)
        if rows == [] or level == max_levels or (level and before == (total.n, total.s)):
            done.append(todo if rows == [] else _shared_core(todo, keys, id_col, cap))
            break
        before = (total.n, total.s) if level else None
        small = rows is not None
        listed = spark.createDataFrame(rows, heavy.schema) if small else cut(heavy)
        hint = F.broadcast(listed) if small else listed  # at most driver_blocks rows
        done.append(todo.join(hint.select(*keys), keys, "left_anti"))
        hot = todo.join(hint, keys)
        wanted = F.least(F.lit(fanout), F.ceil(2 * F.col("count") / cap))
        drawn = hot.where("core").where(F.pmod(F.xxhash64(F.lit(level), F.col(id_col)), F.col("count")) < 2 * wanted)
        pivots = drawn.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(level), F.col(id_col)).alias("h"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(coords)]))), 1, fanout).alias("pivots"))
        pivots = pivots.withColumn("bid", F.xxhash64(*keys))
        hot = hot.select(*cols, "block", "core", F.xxhash64(*keys).alias("bid"))
        table = {}
        if small:
            table = {p.bid: np.array([[p2[i + 1] for i in range(len(coords))] for p2 in p.pivots]) for p in pivots.select("bid", "pivots").collect()}
        else:
            hot = hot.join(pivots.select("bid", "pivots"), "bid", "left")
        todo = cut(_replicate(hot, cols, coords, radius, metric, table, small))
    return reduce(DataFrame.unionByName, done)


def _shared_core(blocks: DataFrame, keys: Sequence[str], id_col: str, cap: int) -> DataFrame:
    """Blocks of over ``cap`` core points as several of the same points, each with a part of the core by a hash of the id."""
    n = blocks.where("core").groupBy(*keys).agg(F.ceil(F.count("*") / cap).cast("int").alias("_parts"))
    b = blocks.join(n, list(keys)).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    named = F.when(F.col("_parts") > 1, F.concat_ws("~", "block", F.col("_part").cast("string"))).otherwise(F.col("block"))
    core = F.col("core") & (F.pmod(F.xxhash64(id_col), F.col("_parts")) == F.col("_part"))
    return b.withColumns({"block": named, "core": core}).select(*blocks.columns)


def _replicate(hot: DataFrame, cols: list[str], coords: Sequence[str], radius: float, metric: str, table: dict, small: bool) -> DataFrame:
    names, coords = list(cols), list(coords)
    schema = hot.select(*cols, "block", "core").schema

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            bid = column(t, "bid")
            x = np.column_stack([column(t, c) for c in coords]).astype(float)
            core = column(t, "core").astype(bool)
            picked, pivot, flag = [], [], []
            for key in np.unique(bid):
                at = np.flatnonzero(bid == key)
                if small:
                    p = table.get(key)
                else:
                    raw = t.column("pivots")[int(at[0])].as_py()
                    p = np.array([[r[f"c{i}"] for i in range(len(coords))] for r in raw]) if raw else None
                if p is None or not len(p):
                    p = np.zeros((1, len(coords)))
                r, v, f = _assign(x[at], core[at], p, radius, metric)
                picked.append(at[r])
                pivot.append(v)
                flag.append(f)
            if not picked:
                continue
            i, v, f = np.concatenate(picked), np.concatenate(pivot), np.concatenate(flag)
            out = t.select(names).take(i)
            block = np.char.add(np.char.add(column(t, "block").astype(str)[i], "/"), v.astype(str))
            out = out.append_column("block", pa.array(block.tolist(), pa.string())).append_column("core", pa.array(f))
            yield from out.combine_chunks().to_batches()

    return hot.mapInArrow(run, schema)


def radius_join(points: DataFrame, group: Sequence[str], coords: Sequence[str], id_col: str, radius: float, metric: str = "euclidean", cap: int = 2048) -> DataFrame:
    """All pairs of one group within ``radius`` (inclusive), smaller id first: (id_1, id_2, distance).

    Rows with an unusable coordinate, a null id or a null group column have no partner. An id that comes
    twice is two points; it never pairs with itself. Points at one place pair with each other. An empty
    table gives no pairs. Other columns of ``points`` are ignored.
    """
    gs, xs = [f"g{i}" for i in range(len(group))], [f"x{i}" for i in range(len(coords))]
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*group, id_col)] + [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in coords])
    p = cut(points.where(ok).select(*[F.col(c).alias(a) for c, a in zip(group, gs)], F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("double").alias(a) for c, a in zip(coords, xs)]))
    blocks = voronoi_blocks(p, gs, xs, "id", radius, cap=cap, metric=metric)

    def pairs(t: pa.Table) -> pa.Table | None:
        core = np.flatnonzero(column(t, "core"))
        if len(t) < 2 or not len(core):
            return None
        ids = column(t, "id")
        x = np.column_stack([column(t, c) for c in xs])
        i, j, d = vp_pairs(x, core, radius, metric)
        keep = ids[i] < ids[j]
        return pa.table({"id_1": ids[i[keep]], "id_2": ids[j[keep]], "distance": d[keep]})

    return map_groups(blocks, [*gs, "block"], pairs, "id_1 long, id_2 long, distance double")


def region_of(points: DataFrame, regions: DataFrame, x: str, y: str, cell: float = 1.0, group: Sequence[str] = ()) -> DataFrame:
    """``points`` with the region_id of the box of their group that contains them: ``regions`` has region_id, x0, y0, x1, y1
    (ends not included).

    A box is laid on the grid whose cells, ``cell`` times a power of two, are the smallest not smaller than it, so that it
    covers four cells at most however large it is; a point asks once for each such grid there is. The two meet by an
    equi-join. Points in no region, or without usable coordinates, are kept with a null region_id; one in several gets a
    row for each; boxes without extent or with a null, NaN or infinite bound hold nothing."""
    ends = ("x0", "y0", "x1", "y1")
    r = regions.where("x1 > x0 and y1 > y0 and " + " and ".join(f"abs(double({c})) < double('Infinity')" for c in ends)).select(*group, "region_id", *[F.col(c).cast("double").alias(f"_{c}") for c in ends])
    extent = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")) / cell
    r = cut(r.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(extent))).cast("int")))
    levels = [row._level for row in r.select("_level").distinct().collect()]  # a double has some two thousand at most
    size = lambda: cell * F.pow(F.lit(2.0), F.col("_level"))
    for n, low, high in (("_gx", "_x0", "_x1"), ("_gy", "_y0", "_y1")):
        r = r.withColumn(n, F.explode(F.sequence(F.floor(F.col(low) / size()), F.floor(F.col(high) / size()))))
    p = cut(points.withColumn("_pid", F.monotonically_increasing_id()))
    asks = p.where(usable(F.col(x).cast("double")) & usable(F.col(y).cast("double"))).select(*group, "_pid", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    asks = asks.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumns({"_gx": F.floor(F.col("_x") / size()), "_gy": F.floor(F.col("_y") / size())})
    inside = "_x >= _x0 and _x < _x1 and _y >= _y0 and _y < _y1"
    met = asks.join(r, [*group, "_level", "_gx", "_gy"]).where(inside).select("_pid", "region_id")
    return p.join(met, "_pid", "left").select(*points.columns, "region_id")
