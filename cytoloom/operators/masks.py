"""Label masks as pixel tables (by, y, x, label) without background, and what is measured on them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoloom.functions import scalar as S
from cytoloom.functions.stats import on
from cytoloom.operators.graph import components
from cytoloom.operators.neighbors import _key_columns, knn
from cytoloom.runtime import column, cut, map_groups


def label_moments(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Raw sums of x^i y^j, i + j <= 3, of each label: one aggregation, combined before the shuffle."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    terms = [(i, j) for i in range(4) for j in range(4 - i)]
    one = lambda v, n: F.lit(1.0) if n == 0 else v if n == 1 else v * v if n == 2 else v * v * v
    return pixels.where("label > 0").groupBy(*by, "label").agg(*[F.sum(one(x, i) * one(y, j)).alias(f"m{i}{j}") for i, j in terms], F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def region_properties(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """area, centroid, bounding box, axis lengths, eccentricity, orientation, and the logs of the seven Hu moments.

    Pixels are unit squares: each adds 1/12 to the second moments. Orientation is the angle between the row axis and the
    major axis, counter-clockwise, within half a turn. Labels of 0 or less are background."""
    m = label_moments(pixels, by)
    c = F.col
    m = m.withColumns({"area": c("m00"), "centroid_x": c("m10") / c("m00"), "centroid_y": c("m01") / c("m00")})
    cx, cy, a = c("centroid_x"), c("centroid_y"), c("m00")
    mu = {
        "mu20": c("m20") - cx * c("m10"), "mu02": c("m02") - cy * c("m01"), "mu11": c("m11") - cx * c("m01"),
        "mu30": c("m30") - 3 * cx * c("m20") + 2 * cx * cx * c("m10"), "mu03": c("m03") - 3 * cy * c("m02") + 2 * cy * cy * c("m01"),
        "mu21": c("m21") - 2 * cx * c("m11") - cy * c("m20") + 2 * cx * cx * c("m01"), "mu12": c("m12") - 2 * cy * c("m11") - cx * c("m02") + 2 * cy * cy * c("m10"),
    }
    m = m.withColumns(mu)
    sxx, syy, sxy = c("mu20") / a + 1 / 12, c("mu02") / a + 1 / 12, c("mu11") / a
    major, minor, _ = S.axes_of(sxx, syy, sxy)
    # angle from the row (y) axis
    orientation = F.when((sxy == 0) & (syy == sxx), F.lit(math.pi / 4)).otherwise(0.5 * F.atan2(2 * sxy, syy - sxx))
    m = m.withColumns({"major_axis_length": major, "minor_axis_length": minor, "orientation": orientation})
    m = m.withColumn("eccentricity", F.when(c("major_axis_length") > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - F.pow(c("minor_axis_length") / c("major_axis_length"), 2)))).otherwise(0.0))
    n = {k: c(k) / F.pow(a, 1 + int(k[2]) / 2 + int(k[3]) / 2) for k in mu}
    p, q = n["mu30"] + n["mu12"], n["mu21"] + n["mu03"]
    d, e = n["mu30"] - 3 * n["mu12"], 3 * n["mu21"] - n["mu03"]
    s, t = n["mu20"] - n["mu02"], n["mu11"]
    hu = [n["mu20"] + n["mu02"], s * s + 4 * t * t, d * d + e * e, p * p + q * q, d * p * (p * p - 3 * q * q) + e * q * (3 * p * p - q * q), s * (p * p - q * q) + 4 * t * p * q, e * p * (p * p - 3 * q * q) - d * q * (3 * p * p - q * q)]
    m = m.withColumns({f"hu_{i}": S.hu_log(h) for i, h in enumerate(hu)})
    keep = ["area", "centroid_x", "centroid_y", "y0", "y1", "x0", "x1", "major_axis_length", "minor_axis_length", "eccentricity", "orientation", *[f"hu_{i}" for i in range(7)]]
    return m.select(*by, "label", *keep)


def with_halo(pixels: DataFrame, by: Sequence[str], size: int, halo: int) -> DataFrame:
    """Every pixel in its tile (_ty, _tx of ``size``) and in each neighbouring tile it lies within ``halo`` of."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size)))
    p = pixels.select(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("label").cast("long").alias("label"))
    return p.withColumn("_ty", span("y")).withColumn("_tx", span("x"))


def perimeters(pixels: DataFrame, by: Sequence[str], size: int = 512) -> DataFrame:
    """(by, label, perimeter): the length of the line through the centres of each label's border pixels (those with a
    pixel of another label, or none, at a side). A border pixel counts by its neighbours on the border, 2 for each at a
    side and 10 for each at a corner: 1 for sums 5, 7, 15, 17, 25, 27 plus itself; sqrt 2 for 21 and 33; half of 1 + sqrt 2
    for 13 and 23. This is the usual estimator for pixel borders.

    Tiles are measured by themselves, with two pixels of what is around them, and their parts of a label added up."""
    weight = np.zeros(60)
    weight[[5, 7, 15, 17, 25, 27]], weight[[21, 33]], weight[[13, 23]] = 1.0, math.sqrt(2), (1 + math.sqrt(2)) / 2
    label_type = dict(pixels.dtypes)["label"]

    def measure(t: pa.Table) -> pa.Table:
        y0, x0 = t.column("_ty")[0].as_py() * size - 2, t.column("_tx")[0].as_py() * size - 2
        n = size + 4
        lab = np.zeros((n + 2, n + 2), np.int64)  # a rim, so that shifts stay inside
        lab[column(t, "y") - y0 + 1, column(t, "x") - x0 + 1] = column(t, "label")

        def beside(img: np.ndarray, dy: int, dx: int) -> np.ndarray:
            return img[1 + dy : n + 1 + dy, 1 + dx : n + 1 + dx]

        own = beside(lab, 0, 0)
        edge = np.zeros_like(lab)
        on = (own > 0) & ~np.logical_and.reduce([beside(lab, *s) == own for s in SIDES])
        edge[1:-1, 1:-1] = np.where(on, own, 0)
        code = on + sum(2 * (beside(edge, *s) == own) for s in SIDES) + sum(10 * (beside(edge, *c) == own) for c in CORNERS)
        core = on[2:-2, 2:-2]
        labels, at = np.unique(own[2:-2, 2:-2][core], return_inverse=True)
        total = np.bincount(at, weight[code[2:-2, 2:-2][core]], len(labels))
        return pa.table({**{g: t.column(g).take(np.zeros(len(labels), np.int64)) for g in by}, "label": labels, "perimeter": total})

    p = with_halo(pixels.where("label > 0"), by, size, 2)
    parts = map_groups(p, [*by, "_ty", "_tx"], measure, _key_columns(p, by) + "label long, perimeter double")
    return parts.groupBy(*by, F.col("label").cast(label_type).alias("label")).agg(F.sum("perimeter").alias("perimeter"))


SIDES = [(-1, 0), (1, 0), (0, -1), (0, 1)]
CORNERS = [(-1, -1), (-1, 1), (1, -1), (1, 1)]


def _hull_area(y: np.ndarray, x: np.ndarray) -> float:
    """Pixels whose centre lies in the convex hull of the label's pixel edges' midpoints."""
    pts = np.unique(np.concatenate([np.column_stack([y + dy, x + dx]) for dy, dx in ((-0.5, 0), (0.5, 0), (0, -0.5), (0, 0.5))]), axis=0)
    half = []
    for order in (pts, pts[::-1]):
        line: list[np.ndarray] = []
        for p in order:
            while len(line) >= 2 and (line[-1][0] - line[-2][0]) * (p[1] - line[-2][1]) - (line[-1][1] - line[-2][1]) * (p[0] - line[-2][0]) <= 0:
                line.pop()
            line.append(p)
        half.extend(line[:-1])
    h = np.array(half)
    gy, gx = np.mgrid[int(y.min()) : int(y.max()) + 1, int(x.min()) : int(x.max()) + 1]
    inside = np.ones(gy.shape, bool)
    for a, b in zip(h, np.roll(h, -1, axis=0)):
        inside &= (b[0] - a[0]) * (gx - a[1]) - (b[1] - a[1]) * (gy - a[0]) >= -1e-9
    return float(inside.sum())


def solidities(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, label, solidity): area over convex area. Rows are reduced to their ends first, so a label of any area sends
    only two pixels per row to the one task that draws its hull."""
    p = pixels.where("label > 0")
    rows = p.groupBy(*by, "label", "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n"))

    def hull(t: pa.Table) -> pa.Table:
        y, x0, x1 = (column(t, c).astype(float) for c in ("y", "x0", "x1"))
        area = float(column(t, "n").sum())
        full = _hull_area(np.concatenate([y, y]), np.concatenate([x0, x1]))
        return pa.table({**{g: t.column(g).slice(0, 1) for g in by}, "label": t.column("label").slice(0, 1), "solidity": [area / full if full else 1.0]})

    return map_groups(rows, [*by, "label"], hull, _key_columns(rows, by) + f"label {dict(rows.dtypes)['label']}, solidity double")


def cell_features(pixels: DataFrame, by: Sequence[str], sizes: DataFrame | None = None, min_area: float | None = None, max_area: float | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Shape features of every label: region properties, perimeter, solidity and what follows from them. ``sizes``: by,
    width, height of the mask; without it the least box that holds the labels. The area limits are inclusive and come
    before any neighbourhood is measured. ``extra``: further columns, as expressions over these."""
    f = region_properties(pixels, by).join(perimeters(pixels, by), [*by, "label"], "left").join(solidities(pixels, by), [*by, "label"], "left").fillna(0.0, ["perimeter"])
    if sizes is None:
        sizes = f.groupBy(*by).agg((F.max("x1") + 1).alias("width"), (F.max("y1") + 1).alias("height"))
    f = on(by, f, sizes)
    f = derived_shape(f)
    f = f.withColumns({"pos_x_norm": F.col("centroid_x") / F.greatest(F.col("width") - 1, F.lit(1)), "pos_y_norm": F.col("centroid_y") / F.greatest(F.col("height") - 1, F.lit(1))}).drop("width", "height")
    f = f.withColumns(extra or {})
    return area_between(f, min_area, max_area)


def derived_shape(f: DataFrame) -> DataFrame:
    """roundness, aspect_ratio, elongation, equivalent_diameter and the axis vector of region properties."""
    vx, vy = S.axis_vector("orientation")
    return f.withColumns({"roundness": S.roundness("area", "perimeter"), "aspect_ratio": S.aspect_ratio("major_axis_length", "minor_axis_length"), "elongation": S.elongation("major_axis_length", "minor_axis_length"), "equivalent_diameter": S.equivalent_diameter("area"), "axis_vec_x": vx, "axis_vec_y": vy})


def area_between(f: DataFrame, least: float | None, most: float | None) -> DataFrame:
    if least is not None:
        f = f.where(F.col("area") >= least)
    return f if most is None else f.where(F.col("area") <= most)


def topology_features(cells: DataFrame, by: Sequence[str], id_col: str, k: int = 5) -> DataFrame:
    """(by, id, nn_dist_1..3, local_density, neighbor_area_ratio_mean, neighbor_roundness_mean) of cells with centroid_x,
    centroid_y, area and roundness. Distances are over the group's median nearest distance (at least 1); what has no
    neighbour gets 1, and its own roundness."""
    c = cut(cells.select(*by, F.col(id_col).alias("id"), "centroid_x", "centroid_y", "area", "roundness"))
    n = cut(knn(c, None, by, ["centroid_x", "centroid_y"], "id", k))
    scale = n.where("ordinal = 1").groupBy(*by).agg(F.greatest(F.median("distance"), F.lit(1.0)).alias("g"))
    other = c.select(F.col("id").alias("neighbour"), F.col("area").alias("_na"), F.col("roundness").alias("_nr"))
    a = n.join(other, "neighbour").groupBy("id").agg(*[F.max(F.when(F.col("ordinal") == j, F.col("distance"))).alias(f"d{j}") for j in (1, 2, 3)], F.avg("distance").alias("mean_d"), F.avg("_na").alias("na"), F.avg("_nr").alias("nr"))
    j = on(by, c.join(a, "id", "left"), scale, "left")
    g = F.coalesce("g", F.lit(1.0))
    out = {f"nn_dist_{i}": F.coalesce(F.col(f"d{i}") / g, F.lit(1.0)) for i in (1, 2, 3)}
    out |= {"local_density": F.when(F.col("mean_d").isNull(), 1.0).otherwise(S.safe_ratio(g, F.col("mean_d"))), "neighbor_area_ratio_mean": F.when(F.col("na").isNull(), 1.0).otherwise(S.safe_ratio("na", "area")), "neighbor_roundness_mean": F.coalesce("nr", "roundness")}
    return j.select(*by, "id", *[v.alias(k2) for k2, v in out.items()])


# -- labels ------------------------------------------------------------------------------------------------------


def _raster_id(y: Column, x: Column, width: int = 1 << 31) -> Column:
    return y.cast("long") * width + x.cast("long")


def relabel_components(pixels: DataFrame, by: Sequence[str], connectivity: int = 1, same_label: bool = False) -> DataFrame:
    """(by, y, x, label): connected foreground as labels 1..N in raster order of their first pixel. Connectivity 1 joins
    sides, 2 corners too; with ``same_label`` only pixels of one label join.

    Each tile of pixels is searched by itself, as runs of its rows; only the runs at tile borders meet in a join, and only
    components that touch a border take part in the global search."""
    lab = ["label"] if same_label else []
    size = 512
    p = pixels.where("label > 0").select(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("label").cast("long").alias("label") if same_label else F.lit(1).cast("long").alias("label"))
    p = p.withColumns({"_ty": F.floor(F.col("y") / size), "_tx": F.floor(F.col("x") / size)})
    reach = connectivity - 1

    def local(t: pa.Table) -> pa.Table:
        y, x, v = (column(t, c) for c in ("y", "x", "label"))
        o = np.lexsort((x, y))
        y, x, v = y[o], x[o], v[o]
        first = np.r_[True, (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1) | (v[1:] != v[:-1])]
        last = np.r_[first[1:], True]
        ry, r0, r1, rv = y[first], x[first], x[last], v[first]
        root = list(range(len(ry)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        rows = np.searchsorted(ry, np.arange(ry.min(), ry.max() + 2))
        for a, b, c in zip(rows[:-2], rows[1:-1], rows[2:]):
            i, j = int(a), int(b)
            while i < b and j < c:  # both rows' runs from left to right
                if r0[i] <= r1[j] + reach and r0[j] <= r1[i] + reach and rv[i] == rv[j]:
                    p, q = top(i), top(j)
                    root[max(p, q)] = min(p, q)
                if r1[i] < r1[j]:
                    i += 1
                else:
                    j += 1
        lead = np.array([top(i) for i in range(len(root))], dtype=np.int64)
        n = len(ry)
        return pa.table({**{g: t.column(g).take(np.zeros(n, np.int64)) for g in by}, "y": ry, "x0": r0, "x1": r1, "label": rv, "ly": ry[lead], "lx": r0[lead]})

    runs = map_groups(p, [*by, "_ty", "_tx"], local, _key_columns(p, by) + "y long, x0 long, x1 long, label long, ly long, lx long")
    runs = cut(runs.withColumn("node", F.xxhash64(*by, "ly", "lx")))
    # at the borders: the row below another tile's last, and the column right of its last
    down = runs.where(F.pmod("y", F.lit(size)) == size - 1).select(*by, (F.col("y") + 1).alias("y"), *lab, F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("node").alias("a"))
    under = runs.where(F.pmod("y", F.lit(size)) == 0).select(*by, "y", *lab, "x0", "x1", F.col("node").alias("b"))
    span = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - reach) / 64), F.floor((F.col(b) + reach) / 64))).alias("_b")
    edges = under.select("*", span("x0", "x1")).join(down.select("*", span("u0", "u1")), [*by, "y", *lab, "_b"]).where((F.col("x0") <= F.col("u1") + reach) & (F.col("u0") <= F.col("x1") + reach)).select("a", "b")
    step = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_s")
    right = runs.where(F.pmod("x1", F.lit(size)) == size - 1).select(*by, (F.col("x1") + 1).alias("x0"), *lab, F.col("node").alias("a"), "y", step).withColumn("y", F.col("y") + F.col("_s"))
    edges = edges.unionByName(runs.where(F.pmod("x0", F.lit(size)) == 0).select(*by, "x0", "y", *lab, F.col("node").alias("b")).join(right, [*by, "x0", "y", *lab]).select("a", "b")).distinct()
    lbl = components(runs.select("node").distinct(), edges)
    runs = cut(runs.join(lbl.withColumnRenamed("label", "part"), "node"))
    first = runs.groupBy(*by, "part").agg(F.min(_raster_id(F.col("y"), F.col("x0"))).alias("_f"))
    # 1..N per group, by a rank over components, not pixels
    num = first.withColumn("new", F.row_number().over(W.partitionBy(*by).orderBy("_f"))).select(*by, "part", "new")
    out = runs.join(num, [*by, "part"]).select(*by, F.col("y").cast("int").alias("y"), F.explode(F.sequence("x0", "x1")).alias("x"), F.col("new").alias("label"))
    return out.withColumn("x", F.col("x").cast("int"))


def is_binary(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, binary): whether a mask has exactly one label."""
    return pixels.where("label > 0").groupBy(*by).agg((F.count_distinct("label") == 1).alias("binary"))


def tile_plan(sizes: DataFrame, by: Sequence[str], chunk: int, overlap: int) -> DataFrame:
    """(by, tile, window y0..x1, core_y0..core_x1): core tiles step by ``chunk``; windows add ``overlap`` within the image.
    ``sizes``: by, width, height."""
    steps = lambda e: F.explode(F.sequence(F.lit(0), F.floor((F.col(e) - 1) / chunk).cast("int")))
    t = sizes.where("width > 0 and height > 0").withColumn("_ty", steps("height")).withColumn("_tx", steps("width"))
    t = t.withColumns({"core_y0": F.col("_ty") * chunk, "core_x0": F.col("_tx") * chunk})
    t = t.withColumns({"core_y1": F.least(F.col("core_y0") + chunk, "height"), "core_x1": F.least(F.col("core_x0") + chunk, "width"), "tile": F.col("_ty") * F.ceil(F.col("width") / chunk).cast("int") + F.col("_tx")})
    return t.select(*by, F.col("tile").cast("int").alias("tile"), F.greatest(F.col("core_y0") - overlap, F.lit(0)).cast("int").alias("y0"), F.least(F.col("core_y1") + overlap, "height").cast("int").alias("y1"), F.greatest(F.col("core_x0") - overlap, F.lit(0)).cast("int").alias("x0"), F.least(F.col("core_x1") + overlap, "width").cast("int").alias("x1"), *[F.col(c).cast("int").alias(c) for c in ("core_y0", "core_y1", "core_x0", "core_x1")])


def in_tiles(pixels: DataFrame, sizes: DataFrame, by: Sequence[str], chunk: int, overlap: int) -> DataFrame:
    """``pixels`` with the tile of ``tile_plan`` and whether they are in its core: a row for each of the at most four tiles whose
    window holds the pixel, by arithmetic."""
    near = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - overlap) / chunk)), F.least(F.floor((F.col(n) - 1) / chunk), F.floor((F.col(c) + overlap) / chunk))))
    p = on(by, pixels, sizes.select(*by, "width", "height")).where("y >= 0 and x >= 0 and y < height and x < width")
    p = p.withColumn("_ty", near("y", "height")).withColumn("_tx", near("x", "width"))
    window = lambda c, t: F.col(c) - F.col(t) * chunk
    p = p.where((window("y", "_ty") < chunk + overlap) & (window("x", "_tx") < chunk + overlap))
    core = (F.floor(F.col("y") / chunk) == F.col("_ty")) & (F.floor(F.col("x") / chunk) == F.col("_tx"))
    return p.withColumns({"tile": (F.col("_ty") * F.ceil(F.col("width") / chunk) + F.col("_tx")).cast("int"), "in_core": core}).drop("_ty", "_tx", "width", "height")


def blank_tiles(pixels: DataFrame, by: Sequence[str], area: Column, value: str = "value", min_share: float = 0.001, min_p99: float = 5.0) -> DataFrame:
    """(by, blank): tiles with under ``min_share`` of nonzero pixels, or whose 99th percentile is at most ``min_p99``. Zero
    pixels need not be listed: ``area`` says how many there are in all."""
    v = pixels.where(F.col(value) > 0).groupBy(*by, value).agg(F.count("*").alias("c"))
    n = pixels.where(F.col(value) > 0).groupBy(*by).agg(F.count("*").alias("n"), F.first(area).alias("area"))
    above = on(by, v, n).where(F.col(value) > min_p99).groupBy(*by).agg(F.sum("c").alias("above"))
    # the 99th percentile is above the limit if more than 1 % of all pixels are
    return on(by, n, above, "left").select(*by, ((F.col("n") / F.col("area") < min_share) | (F.coalesce("above", F.lit(0)) <= 0.01 * F.col("area"))).alias("blank"))


def stitch_tiles(tiles: DataFrame, by: Sequence[str], union: bool = True) -> DataFrame:
    """(by, y, x, label): one mask from the labels of overlapping tiles. ``tiles``: by, tile, y, x, label, in_core.

    A core pixel takes the label of the first tile that has one there. Labels of different tiles are one cell if a later
    tile's window meets an earlier tile's core label on a pixel; without ``union`` they stay apart. Labels are numbered 1..N
    in the order of their least (tile, label)."""
    t = tiles.where("label > 0").withColumn("node", F.col("tile").cast("long") * (1 << 32) + F.col("label").cast("long"))
    key = lambda c: F.xxhash64(*by, c)
    if union:
        # a pixel lies in few tiles, so its labels are a short list; a join of pixels with pixels would be planned by the size of
        # what they are exploded from
        core = t.groupBy(*by, "y", "x").agg(F.min(F.when(F.col("in_core"), F.col("node"))).alias("node"), F.collect_set("node").alias("_late")).where("node is not null")
        core = cut(core.withColumn("_late", F.filter("_late", lambda n: F.shiftright(n, 32) > F.shiftright("node", 32))))
    else:
        core = cut(t.where("in_core").groupBy(*by, "y", "x").agg(F.min("node").alias("node")))
    names = cut(core.select(*by, "node").distinct().withColumn("k", key("node")))
    part = names.withColumn("label", F.col("k"))
    if union:
        edges = core.where("size(_late) > 0").select(*by, "node", F.explode("_late").alias("_l")).distinct().select(key("node").alias("a"), key("_l").alias("b"))
        part = names.join(components(names.select(F.col("k").alias("node")), edges).withColumnRenamed("node", "k"), "k")
    least = part.groupBy(*by, "label").agg(F.min("node").alias("_f"))
    num = least.withColumn("new", F.row_number().over(W.partitionBy(*by).orderBy("_f"))).select(*by, "label", "new")
    num = part.join(num, [*by, "label"]).select(*by, "node", F.col("new").alias("label"))
    return core.join(num, [*by, "node"]).select(*by, "y", "x", "label")


def rasterise_polygons(polygons: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, y, x, label): pixels whose centre lies inside a polygon (even-odd), the greatest label winning where several do.
    ``polygons``: by, label, contour (array of struct x, y). Edges meet scanlines, crossings pair up along each line."""
    c = F.col("contour")
    turned = F.concat(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 1, 1))
    e = polygons.where("size(contour) >= 3").select(*by, "label", F.explode(F.arrays_zip(c.alias("p"), turned.alias("q"))).alias("e"))
    e = e.select(*by, "label", F.col("e.p.x").cast("double").alias("ax"), F.col("e.p.y").cast("double").alias("ay"), F.col("e.q.x").cast("double").alias("bx"), F.col("e.q.y").cast("double").alias("by_")).where("ay <> by_")
    lo, hi = F.ceil(F.least("ay", "by_")), F.ceil(F.greatest("ay", "by_")) - 1
    s = e.where(hi >= lo).withColumn("y", F.explode(F.sequence(lo, hi)))
    s = s.select(*by, "label", "y", (F.col("ax") + (F.col("y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by_") - F.col("ay"))).alias("cx"))
    w = W.partitionBy(*by, "label", "y").orderBy("cx")
    s = s.withColumns({"n": F.row_number().over(w), "to": F.lead("cx").over(w)}).where("n % 2 = 1 and to is not null")
    s = s.withColumns({"x0": F.ceil("cx"), "x1": F.ceil("to") - 1}).where("x1 >= x0")
    return s.select(*by, "label", "y", F.explode(F.sequence("x0", "x1")).alias("x")).groupBy(*by, "y", "x").agg(F.max("label").alias("label"))


def rasterise_discs(points: DataFrame, by: Sequence[str], radius: int, width: Column, height: Column) -> DataFrame:
    """(by, y, x, label): pixels within ``radius`` of each point (by, label, x, y), inside the image; the greatest label wins."""
    off = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    at = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in off])).alias("o")
    p = points.select(*by, "label", F.rint("y").cast("long").alias("cy"), F.rint("x").cast("long").alias("cx"), width.alias("_w"), height.alias("_h"), at)
    p = p.select(*by, "label", (F.col("cy") + F.col("o.dy")).alias("y"), (F.col("cx") + F.col("o.dx")).alias("x"), "_w", "_h")
    return p.where("y >= 0 and x >= 0 and y < _h and x < _w").groupBy(*by, "y", "x").agg(F.max("label").alias("label"))
