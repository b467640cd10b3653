"""Rasters as pixel tables (by, y, x, value) without zeros, and their maps."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoloom.functions.stats import on
from cytoloom.operators.models import MODEL, apply_xy, invert, local_affine, spline_points
from cytoloom.operators.neighbors import _key_columns
from cytoloom.runtime import column, cut, map_groups


def _in_frame(df: DataFrame) -> DataFrame:
    return df.where("y >= 0 and x >= 0 and y < height and x < width")


def _sampled(cells: DataFrame, params: Sequence[str], place: Callable[[dict, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], source: DataFrame, by: Sequence[str], order: int, value: str, tile: int) -> DataFrame:
    """(by, y, x, value): output pixels, cell by cell. ``cells``: by, _y0, _x0 (a cell's first pixel), _h, _w (its size), _sy0,
    _sy1, _sx0, _sx1 (where in the source it may look) and ``params``, from which ``place`` tells each pixel's place there.

    The source goes as tiles; each cell gets those it may look at, by an equi-join, so rows are tiles until the result.
    Order 0 takes the nearest pixel (half to even), order 1 weighs the four around; what lies outside the source is 0.
    Zeros are left out."""
    kind = dict(source.dtypes)[value] if order == 0 else "double"
    s = source.select(*by, F.col("y").cast("long").alias("_y"), F.col("x").cast("long").alias("_x"), F.col(value).cast(kind).alias("_v"))
    s = s.where("_v is not null").withColumns({"_ty": F.floor(F.col("_y") / tile), "_tx": F.floor(F.col("_x") / tile)})
    s = s.withColumn("_k", ((F.col("_y") - F.col("_ty") * tile) * tile + F.col("_x") - F.col("_tx") * tile).cast("int"))
    # a tile bounds the lists; two of numbers take a fifth of one of structs
    tiles = cut(s.groupBy(*by, "_ty", "_tx").agg(F.collect_list(F.struct("_k", "_v")).alias("_p")).select(*by, "_ty", "_tx", F.col("_p._k").alias("_k"), F.col("_p._v").alias("_v")))
    ends = tiles.groupBy(*by).agg(*[f(c).alias(f"_{n}{c}") for c in ("_ty", "_tx") for n, f in (("lo", F.min), ("hi", F.max))])
    need = on(by, cells, ends)
    span = lambda a, b, c: F.sequence(F.greatest(F.floor(F.col(a) / tile), F.col(f"_lo{c}")), F.least(F.floor(F.col(b) / tile), F.col(f"_hi{c}")))
    some = lambda a, b, c: (F.floor(F.col(b) / tile) >= F.col(f"_lo{c}")) & (F.floor(F.col(a) / tile) <= F.col(f"_hi{c}"))
    need = need.where(some("_sy0", "_sy1", "_ty") & some("_sx0", "_sx1", "_tx")).withColumn("_ty", F.explode(span("_sy0", "_sy1", "_ty"))).withColumn("_tx", F.explode(span("_sx0", "_sx1", "_tx")))
    # the cells are exploded from small tables, by whose size they would be broadcast; what a cell's place is told from goes once
    here = need.select(*by, "_y0", "_x0", "_ty", "_tx").hint("merge").join(tiles, [*by, "_ty", "_tx"])
    both = here.unionByName(cells.select(*by, "_y0", "_x0", "_h", "_w", *params), allowMissingColumns=True)

    def look(t: pa.Table) -> pa.Table | None:
        own = _whole(pc.is_null(t.column("_ty"))).to_numpy(zero_copy_only=False)
        if own.all() or not own.any():
            return None
        first = {c: t.column(c)[int(own.argmax())].as_py() for c in ("_y0", "_x0", "_h", "_w", *params)}
        t = t.filter(pa.array(~own))
        k, pv = (_flat(t.column(c)).to_numpy(zero_copy_only=False) for c in ("_k", "_v"))
        many = pc.list_value_length(_whole(t.column("_k"))).to_numpy(zero_copy_only=False)
        ty, tx = (np.repeat(column(t, c), many) for c in ("_ty", "_tx"))
        py, px = ty * tile + k // tile, tx * tile + k % tile
        key = (py << 32) + px
        o = np.argsort(key, kind="stable")
        key, pv = key[o], pv[o]
        y, x = (g.ravel() for g in np.mgrid[first["_y0"] : first["_y0"] + first["_h"], first["_x0"] : first["_x0"] + first["_w"]])
        sx, sy = place(first, x.astype(float), y.astype(float))

        def at(iy: np.ndarray, ix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            k = (iy.astype(np.int64) << 32) + ix.astype(np.int64)
            i = np.minimum(np.searchsorted(key, k), len(key) - 1)
            return key[i] == k, i

        ok = np.isfinite(sx) & np.isfinite(sy) & (np.abs(sx) < 2**31) & (np.abs(sy) < 2**31)
        y, x, sx, sy = y[ok], x[ok], sx[ok], sy[ok]
        if order == 0:
            hit, i = at(np.rint(sy), np.rint(sx))
            got = pv[i[hit]]
            y, x = y[hit], x[hit]
        else:
            got = np.zeros(len(y))
            fy, fx = np.floor(sy), np.floor(sx)
            for dy in (0, 1):
                for dx in (0, 1):
                    hit, i = at(fy + dy, fx + dx)
                    got += np.where(hit, (1 - np.abs(sy - fy - dy)) * (1 - np.abs(sx - fx - dx)) * pv[i], 0)
        keep = got != 0
        n = int(keep.sum())
        return pa.table({**{g: _whole(t.column(g)).take(pa.array(np.zeros(n, np.int64))) for g in by}, "y": y[keep].astype(np.int64), "x": x[keep].astype(np.int64), value: got[keep]}) if n else None

    return map_groups(both, [*by, "_y0", "_x0"], look, _key_columns(source, by) + f"y long, x long, `{value}` {kind}")


def _whole(c: pa.ChunkedArray | pa.Array) -> pa.Array:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c


def _flat(c: pa.ChunkedArray | pa.Array) -> pa.Array:
    return _whole(c).flatten()


def _cells(sizes: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """Every cell of ``size`` of each frame, in itself cut to the frame: by, gy, gx, _y0, _x0, _h, _w."""
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / size)))
    c = sizes.where("width > 0 and height > 0").select(*by, "width", "height", axis("height").alias("gy")).withColumn("gx", axis("width"))
    c = c.withColumns({"_y0": F.col("gy") * size, "_x0": F.col("gx") * size})
    return c.withColumns({"_h": F.least(F.lit(size), F.col("height") - F.col("_y0")), "_w": F.least(F.lit(size), F.col("width") - F.col("_x0"))})


def _looking(cells: DataFrame, xs: Sequence[Column], ys: Sequence[Column], margin: float = 1.0) -> DataFrame:
    """``cells`` with where they look: the box around the given places."""
    return cells.withColumns({"_sx0": F.least(*xs) - margin, "_sx1": F.greatest(*xs) + margin, "_sy0": F.least(*ys) - margin, "_sy1": F.greatest(*ys) + margin})


def affine_warp(source: DataFrame, models: DataFrame, sizes: DataFrame, by: Sequence[str], order: int = 0, value: str = "value", tile: int = 128, part: tuple[int, int] | None = None) -> DataFrame:
    """The source moved by its group's model into a frame of width x height: every output pixel looks back. A rigid warp of
    a mask is one of order 0. Groups without a model or without an inverse give nothing. ``part`` (i, n) gives the i-th of n
    parts of the output's tiles."""
    c = _cells(sizes.select(*by, "width", "height"), by, tile)
    if part is not None:
        c = c.where(F.pmod(F.xxhash64(*by, "gy", "gx"), F.lit(part[1])) == part[0])
    c = on(by, c, invert(models.select(*by, *MODEL)))
    at = [apply_xy(F.col("_x0") + dx * (F.col("_w") - 1), F.col("_y0") + dy * (F.col("_h") - 1)) for dx in (0, 1) for dy in (0, 1)]
    c = _looking(c, [x for x, _ in at], [y for _, y in at])

    def place(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return p["a"] * x + p["b"] * y + p["tx"], p["c"] * x + p["d"] * y + p["ty"]

    return _sampled(c, MODEL, place, source, by, order, value, tile)


def field_warp(source: DataFrame, field: DataFrame, sizes: DataFrame, by: Sequence[str], step: int, order: int = 0, value: str = "value") -> DataFrame:
    """The source moved by a coarse field: (by, gy, gx, sx, sy) tells where the output pixel (gy x step, gx x step) comes from;
    between nodes the place is interpolated linearly. Any map that can be evaluated at the nodes, a local affine or a
    spline, warps this way. Cells with a missing node are left empty."""
    m = max(1, 128 // step)  # cells along a side of a block
    f = field.where("sx is not null and sy is not null and not isnan(sx) and not isnan(sy)").select(*by, F.struct(F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"), "sx", "sy").alias("_n"))
    # the nodes on a block's first row or column are the last of the block before
    of = lambda c: F.explode(F.sequence(F.ceil(F.col(c) / m) - 1, F.floor(F.col(c) / m)))
    f = f.withColumn("gy", of("_n.gy")).withColumn("gx", of("_n.gx")).where("gy >= 0 and gx >= 0")
    c = f.groupBy(*by, "gy", "gx").agg(F.collect_list("_n").alias("_n"))  # at most (m + 1) x (m + 1)
    c = on(by, c, sizes.select(*by, "width", "height")).withColumns({"_y0": F.col("gy") * (m * step), "_x0": F.col("gx") * (m * step)}).where("_y0 < height and _x0 < width")
    c = c.withColumns({"_h": F.least(F.lit(m * step), F.col("height") - F.col("_y0")), "_w": F.least(F.lit(m * step), F.col("width") - F.col("_x0"))})
    c = c.withColumns({"_gy": F.col("_n.gy"), "_gx": F.col("_n.gx"), "_nx": F.col("_n.sx"), "_ny": F.col("_n.sy")})
    c = cut(_looking(c, [F.array_min("_nx"), F.array_max("_nx")], [F.array_min("_ny"), F.array_max("_ny")]).select(*by, "_y0", "_x0", "_h", "_w", "_gy", "_gx", "_nx", "_ny", "_sx0", "_sx1", "_sy0", "_sy1"))

    def place(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        j, i = np.array(p["_gy"]) - p["_y0"] // step, np.array(p["_gx"]) - p["_x0"] // step
        a, b = ((y - p["_y0"]) // step).astype(int), ((x - p["_x0"]) // step).astype(int)
        u, v = (x - p["_x0"] - b * step) / step, (y - p["_y0"] - a * step) / step
        got = []
        for n in ("_nx", "_ny"):
            g = np.full((m + 1, m + 1), np.nan)
            g[j, i] = p[n]
            got.append((1 - v) * ((1 - u) * g[a, b] + u * g[a, b + 1]) + v * ((1 - u) * g[a + 1, b] + u * g[a + 1, b + 1]))
        return got[0], got[1]

    return _sampled(c, ["_gy", "_gx", "_nx", "_ny"], place, source, by, order, value, 32)


def field_nodes(sizes: DataFrame, by: Sequence[str], step: int) -> DataFrame:
    """(by, id, gy, gx, x, y): the nodes of a field over each frame, the last ones on or beyond its edge. To be evaluated."""
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / step).cast("int")))
    g = sizes.where("width > 0 and height > 0").select(*by, "width", axis("height").alias("gy")).withColumn("gx", axis("width")).drop("width")
    return g.withColumns({"id": F.col("gy").cast("long") * (1 << 31) + F.col("gx"), "x": F.col("gx") * F.lit(float(step)), "y": F.col("gy") * F.lit(float(step))})


def local_affine_warp(source: DataFrame, landmarks: DataFrame, models: DataFrame, sizes: DataFrame, by: Sequence[str], step: int = 128, order: int = 0, value: str = "value", k: int = 8, power: float = 2.0) -> DataFrame:
    """The source moved by the local affine of landmarks (by, id, x1, y1 in the output, x2, y2 in the source), evaluated at a
    field's nodes; ``models`` (source to output) serve where there are too few."""
    back = landmarks.select(*by, "id", F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    # ids of nodes repeat from group to group
    nodes = cut(field_nodes(sizes, by, step).withColumn("id", F.xxhash64(*by, "id")))
    moved = local_affine(nodes, back, invert(models.select(*by, *MODEL)), by, k, power)
    return field_warp(source, moved.select(*by, "gy", "gx", F.col("x_local").alias("sx"), F.col("y_local").alias("sy")), sizes, by, step, order, value)


def spline_warp(source: DataFrame, splines: DataFrame, sizes: DataFrame, by: Sequence[str], step: int = 16, order: int = 0, value: str = "value") -> DataFrame:
    """The source moved by splines from output to source places, evaluated at a field's nodes; ``step`` 1 evaluates every
    pixel."""
    nodes = cut(field_nodes(sizes, by, step).withColumn("id", F.xxhash64(*by, "id")))
    moved = nodes.join(spline_points(nodes.select(*by, "id", "x", "y"), splines, by, "id", ("sx", "sy")).select("id", "sx", "sy"), "id")
    return field_warp(source, moved.select(*by, "gy", "gx", "sx", "sy"), sizes, by, step, order, value)


def grid_warp(source: DataFrame, shifts: DataFrame, sizes: DataFrame, by: Sequence[str], grid: int = 4, order: int = 0, value: str = "value", tile: int = 128) -> DataFrame:
    """The source moved by a grid of shifts (by, gy, gx, dx, dy: what is added to a source place), one at the centre of each of
    grid x grid cells of the output frame; between centres they are interpolated linearly, beyond them continued. Groups
    with a missing shift give nothing."""
    every = F.array_sort(F.collect_list(F.struct("gy", "gx", "dx", "dy")))  # grid x grid rows
    g = shifts.where("dx is not null and dy is not null").groupBy(*by).agg(every.alias("_g")).where(F.size("_g") == grid * grid)
    g = g.select(*by, F.transform("_g", lambda s: s.dx).alias("_dx"), F.transform("_g", lambda s: s.dy).alias("_dy"))
    c = on(by, _cells(sizes.select(*by, "width", "height"), by, tile), g).where("_dx is not null")
    # continued beyond the centres a shift may be twice as far from the rest again
    wide = lambda n: 2 * (F.array_max(n) - F.array_min(n)) + F.greatest(F.abs(F.array_max(n)), F.abs(F.array_min(n)))
    c = c.withColumns({"_sx0": F.col("_x0") - wide("_dx") - 1, "_sx1": F.col("_x0") + F.col("_w") + wide("_dx"), "_sy0": F.col("_y0") - wide("_dy") - 1, "_sy1": F.col("_y0") + F.col("_h") + wide("_dy")})

    def place(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, v = ((c + 0.5) * grid / p[n] - 0.5 for c, n in ((x, "width"), (y, "height")))
        i, j = (np.clip(np.floor(w).astype(int), 0, max(0, grid - 2)) for w in (u, v))
        u, v = u - i, v - j
        i1, j1 = np.minimum(i + 1, grid - 1), np.minimum(j + 1, grid - 1)
        at = lambda d: (1 - v) * ((1 - u) * d[j, i] + u * d[j, i1]) + v * ((1 - u) * d[j1, i] + u * d[j1, i1])
        return x - at(np.reshape(p["_dx"], (grid, grid))), y - at(np.reshape(p["_dy"], (grid, grid)))

    return _sampled(c, ["width", "height", "_dx", "_dy"], place, source, by, order, value, tile)


def shift(source: DataFrame, by: Sequence[str], dy: Column | int, dx: Column | int, sizes: DataFrame) -> DataFrame:
    s = on(by, source, sizes.select(*by, "width", "height"))
    dy, dx = (F.lit(v) if isinstance(v, int) else v for v in (dy, dx))
    return _in_frame(s.withColumns({"y": F.col("y") + dy, "x": F.col("x") + dx})).select(*source.columns)


def downsample(source: DataFrame, factor: int) -> DataFrame:
    """Every factor-th pixel of every factor-th row."""
    return source.where((F.col("y") % factor == 0) & (F.col("x") % factor == 0)).withColumns({"y": (F.col("y") / factor).cast("int"), "x": (F.col("x") / factor).cast("int")})


def project_nearest(source: DataFrame, by: Sequence[str], sizes: DataFrame, value: str = "label") -> DataFrame:
    """A mask at another shape: each target pixel takes the source pixel under its centre. ``sizes``: by, width, height and
    target_width, target_height."""
    s = on(by, source, sizes)
    # the target pixels whose centre falls into a source pixel
    lo = lambda c, t, n: F.ceil(F.col(c) * F.col(t) / F.col(n) - 0.5)
    hi = lambda c, t, n: F.ceil((F.col(c) + 1) * F.col(t) / F.col(n) - 0.5) - 1
    s = s.withColumns({"_y0": lo("y", "target_height", "height"), "_y1": hi("y", "target_height", "height"), "_x0": lo("x", "target_width", "width"), "_x1": hi("x", "target_width", "width")})
    s = s.where("_y1 >= _y0 and _x1 >= _x0").select(*by, value, F.explode(F.sequence("_y0", "_y1")).alias("y"), "_x0", "_x1")
    return s.select(*by, "y", F.explode(F.sequence("_x0", "_x1")).alias("x"), value)


def max_projection(volume: DataFrame, by: Sequence[str], value: str = "label") -> DataFrame:
    return volume.groupBy(*by, "y", "x").agg(F.max(value).alias(value))


def merge_overlay(top: DataFrame, under: DataFrame, by: Sequence[str], value: str = "label") -> DataFrame:
    """(by, y, x, value, source): the upper mask where it has a label, the lower one elsewhere. ``source`` says which, as
    their labels are not one numbering."""
    a = top.where(F.col(value) != 0).select(*by, "y", "x", F.col(value).alias("_a"))
    b = under.where(F.col(value) != 0).select(*by, "y", "x", F.col(value).alias("_b"))
    j = a.join(b, [*by, "y", "x"], "full")
    return j.select(*by, "y", "x", F.coalesce("_a", "_b").alias(value), F.when(F.col("_a").isNotNull(), "moving").otherwise("fixed").alias("source"))


def max_fusion(a: DataFrame, b: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    j = a.select(*by, "y", "x", F.col(value).alias("_a")).join(b.select(*by, "y", "x", F.col(value).alias("_b")), [*by, "y", "x"], "full")
    return j.select(*by, "y", "x", F.greatest("_a", "_b").alias(value))


def valid_overlap(models: DataFrame, source_sizes: DataFrame, sizes: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, pixels): how many output pixels come from inside the source frame. A row of pixels looks back along a line, so
    those inside are an interval of it; rows are counted, not pixels."""
    inv = invert(models.select(*by, *MODEL))
    g = on(by, on(by, sizes.select(*by, "width", "height"), source_sizes.select(*by, F.col("width").alias("_sw"), F.col("height").alias("_sh"))), inv)
    g = g.where("width > 0 and height > 0").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    # bilinear weight of an all-ones source above one half: half a pixel of room at the frame
    low, high = [F.lit(-1.0)], [F.col("width").cast("double")]
    outside = F.lit(False)
    for slope, offset, end in (("a", F.col("b") * F.col("y") + F.col("tx"), "_sw"), ("c", F.col("d") * F.col("y") + F.col("ty"), "_sh")):
        k = F.col(slope)
        one, two = (-0.5 - offset) / F.nullif(k, F.lit(0.0)), (F.col(end) - 0.5 - offset) / F.nullif(k, F.lit(0.0))
        low.append(F.when(k != 0, F.least(one, two)).otherwise(F.lit(-1.0)))
        high.append(F.when(k != 0, F.greatest(one, two)).otherwise(F.col("width").cast("double")))
        outside = outside | ((k == 0) & ~((offset > -0.5) & (offset < F.col(end) - 0.5)))
    # whole numbers strictly between the limits
    n = F.ceil(F.least(*high)) - F.floor(F.greatest(*low)) - 1
    return g.groupBy(*by).agg(F.sum(F.when(outside, F.lit(0)).otherwise(F.greatest(n, F.lit(0)))).cast("long").alias("pixels"))


def dice(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, dice): twice the common pixels over all pixels of two masks."""
    p = a.select(*by, "y", "x").distinct().withColumn("_a", F.lit(1)).join(b.select(*by, "y", "x").distinct().withColumn("_b", F.lit(1)), [*by, "y", "x"], "full")
    return p.groupBy(*by).agg((2 * F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()) / (F.count("_a") + F.count("_b"))).alias("dice"))


def centre_of_mass(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    return pixels.groupBy(*by).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def density(points: DataFrame, by: Sequence[str], x: str, y: str, pixel: float = 1.0) -> DataFrame:
    """(by, y, x, value): points per pixel of ``pixel`` units, rounded half to even."""
    return points.groupBy(*by, F.rint(F.col(y) / pixel).cast("int").alias("y"), F.rint(F.col(x) / pixel).cast("int").alias("x")).agg(F.count("*").cast("double").alias("value"))


def gaussian_blur(raster: DataFrame, by: Sequence[str], sigma: float, truncate: float = 4.0) -> DataFrame:
    """A separable blur: each pixel gives its weight to its row, then to its column. Nothing is reflected at the frame."""
    r = int(truncate * sigma + 0.5)
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    k = [v / sum(k) for v in k]
    taps = F.explode(F.array(*[F.struct(F.lit(i - r).alias("o"), F.lit(v).alias("w")) for i, v in enumerate(k)])).alias("t")
    for axis, other in (("x", "y"), ("y", "x")):
        raster = raster.select(*by, other, axis, "value", taps).groupBy(*by, other, (F.col(axis) + F.col("t.o")).alias(axis)).agg(F.sum(F.col("value") * F.col("t.w")).alias("value"))
    return raster


def to_uint8(raster: DataFrame, by: Sequence[str], q: float = 0.99) -> DataFrame:
    """Values as 0..255, the q-quantile of the nonzero ones (linear interpolation) being 255."""
    top = raster.where("value > 0").groupBy(*by).agg(F.percentile("value", q).alias("_top"))
    v = F.least(F.lit(255.0), F.greatest(F.lit(0.0), 255 * F.col("value") / F.nullif("_top", F.lit(0.0))))
    return on(by, raster, top).withColumn("value", F.floor(F.coalesce(v, F.lit(0.0))).cast("int")).drop("_top")


def stretch(raster: DataFrame, by: Sequence[str], low: float = 0.01, high: float = 0.998) -> DataFrame:
    """Values between two quantiles of the nonzero ones as 0..1; a flat raster becomes 0."""
    q = raster.where("value > 0").groupBy(*by).agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("_q"))
    span = F.nullif(F.col("_q")[1] - F.col("_q")[0], F.lit(0.0))
    v = (F.col("value") - F.col("_q")[0]) / span
    return on(by, raster, q).withColumn("value", F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)), F.lit(0.0))).drop("_q")


def grey(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / 3


# -- coarse registration of whole slides by their density --------------------------------------------------------


def _canvas(t: pa.Table, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    y, x = column(t, "y").astype(int), column(t, "x").astype(int)
    ok = (y >= 0) & (x >= 0) & (y < shape[0]) & (x < shape[1])
    np.add.at(out, (y[ok], x[ok]), column(t, "value")[ok])
    return out


def _rotate(img: np.ndarray, deg: float) -> np.ndarray:
    h, w = img.shape
    c, s = math.cos(math.radians(deg)), math.sin(math.radians(deg))
    cy, cx = (h - 1) / 2, (w - 1) / 2
    full = [np.flatnonzero(img.any(axis)) for axis in (0, 1)]
    if not len(full[0]):
        return np.zeros_like(img)
    # only the box in which what isn't zero comes to lie
    ends = np.array([(x, y) for x in (full[0][0] - cx, full[0][-1] - cx) for y in (full[1][0] - cy, full[1][-1] - cy)])
    ox, oy = c * ends[:, 0] - s * ends[:, 1] + cx, s * ends[:, 0] + c * ends[:, 1] + cy
    ya, yb, xa, xb = (int(np.clip(v, 0, n)) for v, n in ((math.floor(oy.min()) - 2, h), (math.ceil(oy.max()) + 3, h), (math.floor(ox.min()) - 2, w), (math.ceil(ox.max()) + 3, w)))
    yy, xx = np.mgrid[ya:yb, xa:xb]
    sx, sy = c * (xx - cx) + s * (yy - cy) + cx, -s * (xx - cx) + c * (yy - cy) + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros_like(img)
    rim = np.zeros((h + 2, w + 2))  # places off the image are 0
    rim[1:-1, 1:-1] = img
    fx, fy = sx - x0, sy - y0
    at = np.clip(y0 + 1, 0, h) * (w + 2) + np.clip(x0 + 1, 0, w)
    inside = (y0 >= -1) & (x0 >= -1) & (y0 < h) & (x0 < w)
    flat, got = rim.ravel(), np.zeros(sx.shape)
    for dy in (0, 1):
        for dx in (0, 1):
            got += ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)) * flat[at + dy * (w + 2) + dx]
    out[ya:yb, xa:xb] = np.where(inside, got, 0)
    return out


def _blurred(t: pa.Table, shape: tuple[int, int], sigma: float, truncate: float = 4.0) -> np.ndarray:
    """What ``gaussian_blur`` gives, on a canvas: of all pixels, also those around it."""
    r = int(truncate * sigma + 0.5)
    k = np.array([math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)])
    k /= k.sum()
    h, w = shape
    wide = np.zeros((h + 2 * r, w + 2 * r))
    y, x = column(t, "y").astype(int) + r, column(t, "x").astype(int) + r
    ok = (y >= 0) & (x >= 0) & (y < h + 2 * r) & (x < w + 2 * r)
    np.add.at(wide, (y[ok], x[ok]), column(t, "value")[ok])
    rows = sum(k[i] * wide[:, i : i + w] for i in range(2 * r + 1))
    return sum(k[i] * rows[i : i + h] for i in range(2 * r + 1))


def coarse_rotation(fixed: DataFrame, moving: DataFrame, by: Sequence[str], size: int = 256, max_deg: float = 2.0, step_deg: float = 0.1, blur: tuple[float, float] | None = None) -> DataFrame:
    """(by, angle_deg, dx, dy, ncc) of each group: the rotation about the canvas' centre and shift that lay the moving density
    on the fixed one. Both are given as rasters of at most size x size (by, y, x, value), blurred already, or with ``blur``
    (sigma, truncate) still to be blurred, so that only pixels with points are moved.

    Each group is one piece of work, as its rasters are bounded: the shift of each angle comes from the phase of the windowed
    spectra, the angle from the greatest correlation (the first among equals)."""
    n = int(round(max_deg / step_deg))
    angles = [round(i * step_deg, 6) for i in range(-n, n + 1)]
    both = fixed.select(*by, "y", "x", "value", F.lit(1).alias("side")).unionByName(moving.select(*by, "y", "x", "value", F.lit(2).alias("side")))
    r = int(blur[0] * blur[1] + 0.5) if blur else 0
    both = both.where(f"y >= {-r} and x >= {-r} and y < {size + r} and x < {size + r}")
    window = np.outer(np.hanning(size), np.hanning(size))

    def fit(t: pa.Table) -> pa.Table | None:
        side = column(t, "side")
        if not ((side == 1).any() and (side == 2).any()):
            return None
        f, still = (_blurred(s, (size, size), *blur) if blur else _canvas(s, (size, size)) for s in (t.filter(pa.array(side == i)) for i in (1, 2)))
        spectrum, a = np.fft.rfft2(f * window), f - f.mean()
        aa, best = (a * a).sum(), None  # the mean of ``a`` is 0, so ``moved`` need not be centred beside it
        for deg in angles:
            m = _rotate(still, deg)
            full = np.flatnonzero(m.any(1))  # other rows have no spectrum
            waves = np.zeros(spectrum.shape, complex)
            waves[full] = np.fft.rfft(m[full] * window[full], axis=1)
            cross = spectrum * np.conj(np.fft.fft(waves, axis=0))
            peak = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-12), s=f.shape)
            dy, dx = np.unravel_index(int(peak.argmax()), peak.shape)
            dy, dx = (int(d) - size if d > size // 2 else int(d) for d in (dy, dx))
            ys, xs = slice(max(dy, 0), size + min(dy, 0)), slice(max(dx, 0), size + min(dx, 0))
            yt, xt = slice(max(-dy, 0), size + min(-dy, 0)), slice(max(-dx, 0), size + min(-dx, 0))
            moved = m[yt, xt]
            bb = (moved * moved).sum() - moved.sum() ** 2 / m.size
            ncc = float((a[ys, xs] * moved).sum() / max(1e-12, math.sqrt(aa * max(bb, 0.0))))
            if best is None or ncc > best[3]:
                best = (deg, float(dx), float(dy), ncc)
        return pa.table({**{g: t.column(g).slice(0, 1) for g in by}, **{c: [v] for c, v in zip(("angle_deg", "dx", "dy", "ncc"), best)}})

    return map_groups(both, list(by), fit, _key_columns(both, by) + "angle_deg double, dx double, dy double, ncc double", parts=int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def tissue_similarity(fixed: DataFrame, moving: DataFrame, by: Sequence[str], size: int = 256, population: int = 24, rounds: int = 40, seed: int = 2) -> DataFrame:
    """(by, a..ty, dice): the similarity transform that lays the moving tissue mask best on the fixed one, searched by
    differential evolution over angle, scale and shift. Masks are rasters of at most size x size, so a group is bounded;
    groups are searched in parallel."""
    both = fixed.select(*by, "y", "x", F.lit(1).alias("side")).unionByName(moving.select(*by, "y", "x", F.lit(2).alias("side"))).where(f"y >= 0 and x >= 0 and y < {size} and x < {size}")

    def search(t: pa.Table) -> pa.Table | None:
        side = column(t, "side")
        y, x = column(t, "y").astype(float), column(t, "x").astype(float)
        f, m = side == 1, side == 2
        if not f.any() or not m.any():
            return None
        mask = np.zeros((size, size), bool)
        mask[y[f].astype(int), x[f].astype(int)] = True
        fc, mc = np.array([x[f].mean(), y[f].mean()]), np.array([x[m].mean(), y[m].mean()])
        mx, my = x[m] - mc[0], y[m] - mc[1]
        rng = np.random.default_rng(seed)
        low, high = np.array([-0.6, 0.7, -size / 8, -size / 8]), np.array([0.6, 1.4, size / 8, size / 8])
        if f.sum() and m.sum():
            high[1] = max(high[1], 1.2 * math.sqrt(f.sum() / m.sum()))

        def score(p: np.ndarray) -> float:
            c, s = p[1] * math.cos(p[0]), p[1] * math.sin(p[0])
            u, v = np.rint(c * mx - s * my + fc[0] + p[2]).astype(int), np.rint(s * mx + c * my + fc[1] + p[3]).astype(int)
            ok = (u >= 0) & (v >= 0) & (u < size) & (v < size)
            return 2 * p[1] ** 2 * mask[v[ok], u[ok]].sum() / (f.sum() + p[1] ** 2 * m.sum())

        pop = low + (high - low) * rng.random((population, 4))
        pop[0] = [0, 1, 0, 0]
        val = np.array([score(p) for p in pop])
        for _ in range(rounds):
            for i in range(population):
                a, b = pop[rng.integers(0, population, 2)]
                trial = np.clip(np.where(rng.random(4) < 0.7, pop[val.argmax()] + 0.7 * (a - b), pop[i]), low, high)
                got = score(trial)
                if got >= val[i]:
                    pop[i], val[i] = trial, got
        p = pop[val.argmax()]
        c, s = p[1] * math.cos(p[0]), p[1] * math.sin(p[0])
        row = {"a": c, "b": -s, "tx": fc[0] + p[2] - c * mc[0] + s * mc[1], "c": s, "d": c, "ty": fc[1] + p[3] - s * mc[0] - c * mc[1], "dice": float(val.max())}
        return pa.table({**{g: t.column(g).slice(0, 1) for g in by}, **{k: [float(v)] for k, v in row.items()}})

    return map_groups(both, list(by), search, _key_columns(both, by) + ", ".join(f"{c} double" for c in [*MODEL, "dice"]), sort=["side", "y", "x"])
