import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import masks, models, raster


def pixels(spark, img, g="i"):
    y, x = np.nonzero(img)
    return spark.createDataFrame([(g, int(a), int(b), int(img[a, b])) for a, b in zip(y, x)], "g string, y int, x int, label int")


def image(df, shape, value="label"):
    out = np.zeros(shape, df.schema[value].dataType.typeName() in ("double",) and float or int)
    for r in df.collect():
        out[r.y, r.x] = r[value]
    return out


def flood(img, connectivity):
    out, n = np.zeros_like(img), 0
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 2 else [])
    for y, x in zip(*np.nonzero(img)):
        if not out[y, x]:
            n += 1
            todo = [(y, x)]
            out[y, x] = n
            while todo:
                a, b = todo.pop()
                for dy, dx in steps:
                    p, q = a + dy, b + dx
                    if 0 <= p < img.shape[0] and 0 <= q < img.shape[1] and img[p, q] and not out[p, q]:
                        out[p, q] = n
                        todo.append((p, q))
    return out


@pytest.mark.parametrize("connectivity", [1, 2])
def test_components_equal_flood_fill(spark, connectivity):
    img = (np.random.default_rng(0).random((40, 150)) < 0.55).astype(int)
    img[5, :] = 1  # a run longer than a bucket
    got = image(masks.relabel_components(pixels(spark, img), ["g"], connectivity), img.shape)
    assert (got == flood(img, connectivity)).all()


def test_properties_of_an_ellipse(spark):
    yy, xx = np.mgrid[0:80, 0:80]
    t = 0.5
    u, v = (xx - 40) * np.cos(t) + (yy - 38) * np.sin(t), -(xx - 40) * np.sin(t) + (yy - 38) * np.cos(t)
    img = ((u / 24) ** 2 + (v / 11) ** 2 <= 1).astype(int)
    f = masks.cell_features(pixels(spark, img), ["g"]).first()
    assert f.centroid_x == pytest.approx(40, abs=0.05) and f.major_axis_length == pytest.approx(48, rel=0.01) and f.minor_axis_length == pytest.approx(22, rel=0.01)
    assert f.eccentricity == pytest.approx(np.sqrt(1 - (11 / 24) ** 2), abs=0.01) and f.solidity > 0.95
    assert f.orientation == pytest.approx(np.pi / 2 - t, abs=0.02)
    assert f.perimeter == pytest.approx(np.pi * (3 * 35 - np.sqrt((72 + 11) * (24 + 33))), rel=0.03)


def test_hu_does_not_change_with_place_or_quarter_turns(spark):
    img = np.zeros((30, 30), int)
    img[3:9, 4:20] = 1
    img[9:20, 4:8] = 1
    a = masks.region_properties(pixels(spark, img), ["g"]).first()
    b = masks.region_properties(pixels(spark, np.roll(np.rot90(img), (2, 3), (0, 1))), ["g"]).first()
    for i in range(6):
        assert a[f"hu_{i}"] == pytest.approx(b[f"hu_{i}"], abs=1e-6)


def test_solidity_of_an_l(spark):
    img = np.zeros((12, 12), int)
    img[1:11, 1:4] = 1
    img[8:11, 1:11] = 1
    s = masks.solidities(pixels(spark, img), ["g"]).first().solidity
    assert 0.5 < s < 0.8
    assert masks.solidities(pixels(spark, img), ["g"]).count() == 1


def test_stitching_gives_back_the_cells(spark):
    img = np.zeros((60, 60), int)
    for n, (y, x, h, w) in enumerate([(3, 3, 8, 9), (16, 15, 10, 10), (25, 40, 12, 6), (50, 2, 6, 30), (38, 18, 4, 4)], 1):
        img[y : y + h, x : x + w] = n
    plan = masks.tile_plan(spark.createDataFrame([("i", 60, 60)], "g string, width int, height int"), ["g"], 20, 6)
    t = pixels(spark, img).join(plan, "g").where("y >= y0 and y < y1 and x >= x0 and x < x1")
    core = (F.col("y") >= F.col("core_y0")) & (F.col("y") < F.col("core_y1")) & (F.col("x") >= F.col("core_x0")) & (F.col("x") < F.col("core_x1"))
    t = t.select("g", "tile", "y", "x", (F.col("label") + F.col("tile") * 0).alias("label"), core.alias("in_core"))
    got = image(masks.stitch_tiles(t, ["g"]), img.shape)
    assert ((got > 0) == (img > 0)).all() and got.max() == 5
    for n in range(1, 6):
        assert len(set(got[img == n])) == 1
    assert image(masks.stitch_tiles(t, ["g"], union=False), img.shape).max() > 5


def test_polygon_fill_is_even_odd(spark):
    c = [(1.5, 1.5), (9.5, 1.5), (9.5, 7.5), (1.5, 7.5)]
    df = spark.createDataFrame([("i", 3, [{"x": a, "y": b} for a, b in c]), ("i", 9, [{"x": 0.0, "y": 0.0}])], "g string, label int, contour array<struct<x:double,y:double>>")
    p = masks.rasterise_polygons(df, ["g"]).collect()
    assert {(r.y, r.x) for r in p} == {(y, x) for y in range(2, 8) for x in range(2, 10)} and {r.label for r in p} == {3}


def test_bilinear_warp_equals_numpy(spark):
    rng = np.random.default_rng(1)
    img = np.zeros((20, 24))
    img[4:14, 5:18] = rng.integers(1, 9, (10, 13))
    y, x = np.nonzero(img)
    src = spark.createDataFrame([("i", int(a), int(b), float(img[a, b])) for a, b in zip(y, x)], "g string, y int, x int, value double")
    m = spark.createDataFrame([("i", 1.1, 0.05, 0.7, -0.04, 0.95, 1.3)], "g string, a double, b double, tx double, c double, d double, ty double")
    size = spark.createDataFrame([("i", 24, 20)], "g string, width int, height int")
    got = image(raster.affine_warp(src, m, size, ["g"], order=1), img.shape, "value")
    inv = np.linalg.inv(np.array([[1.1, 0.05, 0.7], [-0.04, 0.95, 1.3], [0, 0, 1]]))
    want = np.zeros_like(img)
    for yy in range(20):
        for xx in range(24):
            sx, sy, _ = inv @ [xx, yy, 1]
            for a in (int(np.floor(sy)), int(np.floor(sy)) + 1):
                for b in (int(np.floor(sx)), int(np.floor(sx)) + 1):
                    if 0 <= a < 20 and 0 <= b < 24:
                        want[yy, xx] += (1 - abs(sy - a)) * (1 - abs(sx - b)) * img[a, b]
    assert got == pytest.approx(want, abs=1e-9)


def test_coarse_rotation_finds_a_shift(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(20, 100, (120, 2))
    pt = lambda q: spark.createDataFrame([("i", float(a), float(b)) for a, b in q], "g string, x double, y double")
    d = lambda q: raster.gaussian_blur(raster.density(pt(q), ["g"], "x", "y"), ["g"], 1.5)
    r = raster.coarse_rotation(d(p), d(p - [6, -4]), ["g"], 128, 1.0, 0.5).first()
    assert (r.angle_deg, r.dx, r.dy) == (0.0, 6.0, -4.0) and r.ncc > 0.95
    q = raster.tissue_similarity(d(p), d(p - [6, -4]), ["g"], 128).first()
    assert q.dice > 0.8 and q.tx == pytest.approx(6, abs=2)


def test_empty_masks(spark):
    e = pixels(spark, np.zeros((3, 3), int))
    assert masks.cell_features(e, ["g"]).count() == 0
    assert masks.relabel_components(e, ["g"]).count() == 0
    assert raster.dice(e, e, ["g"]).count() == 0


def border_length(img):
    """By definition, on one label."""
    p = np.pad(img, 2).astype(int)
    inner = p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    e = np.pad(p[1:-1, 1:-1] - inner, 1)
    code = 1 * e[1:-1, 1:-1] + 2 * (e[:-2, 1:-1] + e[2:, 1:-1] + e[1:-1, :-2] + e[1:-1, 2:]) + 10 * (e[:-2, :-2] + e[:-2, 2:] + e[2:, :-2] + e[2:, 2:])
    w = {**dict.fromkeys((5, 7, 15, 17, 25, 27), 1.0), **dict.fromkeys((21, 33), 2**0.5), **dict.fromkeys((13, 23), (1 + 2**0.5) / 2)}
    return sum(w.get(int(c), 0.0) for c, on in zip(code.ravel(), e[1:-1, 1:-1].ravel()) if on)


@pytest.mark.parametrize("size", [7, 512])
def test_perimeters_across_tiles(spark, size):
    rng = np.random.default_rng(3)
    img = np.zeros((40, 40), int)
    img[3:25, 4:20] = 1
    img[rng.random(img.shape) < 0.1] = 0
    img[10:34, 20:37] = 2
    got = {r.label: r.perimeter for r in masks.perimeters(pixels(spark, img), ["g"], size).collect()}
    for n in (1, 2):
        assert got[n] == pytest.approx(border_length(img == n))


def _source(spark, rng, h=60, w=70):
    img = np.zeros((h, w))
    for _ in range(12):  # blobs that touch and cross tiles
        y, x, r = rng.integers(0, h), rng.integers(0, w), rng.integers(3, 12)
        yy, xx = np.mgrid[:h, :w]
        img[(yy - y) ** 2 + (xx - x) ** 2 <= r * r] = rng.integers(1, 9)
    y, x = np.nonzero(img)
    return img, spark.createDataFrame([("i", int(a), int(b), float(img[a, b])) for a, b in zip(y, x)], "g string, y int, x int, value double")


def _looked_up(img, sx, sy):
    iy, ix = np.rint(sy).astype(int), np.rint(sx).astype(int)
    ok = (iy >= 0) & (ix >= 0) & (iy < img.shape[0]) & (ix < img.shape[1])
    return np.where(ok, img[np.clip(iy, 0, img.shape[0] - 1), np.clip(ix, 0, img.shape[1] - 1)], 0)


def test_a_turned_mask_and_its_overlap_equal_numpy(spark):
    img, src = _source(spark, np.random.default_rng(4))
    t = np.radians(33)
    m = np.array([[np.cos(t), -np.sin(t), 31.3], [np.sin(t), np.cos(t), -12.1], [0, 0, 1]])
    model = spark.createDataFrame([("i", *map(float, m[:2].ravel()))], "g string, a double, b double, tx double, c double, d double, ty double")
    size = spark.createDataFrame([("i", 90, 80)], "g string, width int, height int")
    y, x = np.mgrid[:80, :90]
    sx, sy, _ = np.einsum("ij,jyx->iyx", np.linalg.inv(m), np.stack([x, y, np.ones_like(x)]))
    got = image(raster.affine_warp(src, model, size, ["g"], tile=16), (80, 90), "value")
    assert (got == _looked_up(img, sx, sy)).all()
    both = sum(image(raster.affine_warp(src, model, size, ["g"], tile=16, part=(i, 3)), (80, 90), "value") for i in range(3))
    assert (both == got).all()
    inside = (sx > -0.5) & (sy > -0.5) & (sx < 69.5) & (sy < 59.5)
    src_size = spark.createDataFrame([("i", 70, 60)], "g string, width int, height int")
    assert raster.valid_overlap(model, src_size, size, ["g"]).first().pixels == inside.sum()
    assert raster.affine_warp(src.limit(0), model, size, ["g"]).count() == 0 == raster.affine_warp(src, model.limit(0), size, ["g"]).count()


def test_grid_and_spline_warps_equal_numpy(spark):
    rng = np.random.default_rng(5)
    img, src = _source(spark, rng)
    size = spark.createDataFrame([("i", 70, 60)], "g string, width int, height int")
    d = rng.uniform(-5, 5, (4, 4, 2))
    shifts = spark.createDataFrame([("i", j, i, *map(float, d[j, i])) for j in range(4) for i in range(4)], "g string, gy int, gx int, dx double, dy double")
    y, x = np.mgrid[:60, :70].astype(float)
    u, v = (x + 0.5) * 4 / 70 - 0.5, (y + 0.5) * 4 / 60 - 0.5
    i, j = np.clip(np.floor(u), 0, 2).astype(int), np.clip(np.floor(v), 0, 2).astype(int)
    at = ((1 - (v - j)) * (1 - (u - i)))[..., None] * d[j, i] + ((1 - (v - j)) * (u - i))[..., None] * d[j, i + 1] + ((v - j) * (1 - (u - i)))[..., None] * d[j + 1, i] + ((v - j) * (u - i))[..., None] * d[j + 1, i + 1]
    got = image(raster.grid_warp(src, shifts, size, ["g"], tile=16), img.shape, "value")
    assert (got == _looked_up(img, x - at[..., 0], y - at[..., 1])).all()
    marks = rng.uniform(0, 60, (12, 2))
    to = marks + rng.normal(0, 2, (12, 2))
    lm = spark.createDataFrame([("i", *map(float, (*a, *b))) for a, b in zip(marks, to)], "g string, fx double, fy double, tx double, ty double")
    sp = models.fit_spline(lm, ["g"])
    pts = spark.createDataFrame([("i", int(r * 70 + c), float(c), float(r)) for r in range(60) for c in range(70)], "g string, id long, x double, y double")
    place = {r.id: (r.x_spline, r.y_spline) for r in models.spline_points(pts, sp, ["g"]).collect()}
    s = np.array([place[k] for k in range(4200)]).reshape(60, 70, 2)
    one = image(raster.spline_warp(src, sp, size, ["g"], step=1), img.shape, "value")
    assert (one == _looked_up(img, s[..., 0], s[..., 1])).all()
    assert (image(raster.spline_warp(src, sp, size, ["g"], step=4), img.shape, "value") == one).mean() > 0.97


def test_registered_raster_is_written_part_by_part(spark, tmp_path):
    from cytoloom.sources import tiles as dense

    img, src = _source(spark, np.random.default_rng(6))
    both = src.withColumn("channel", F.lit(0)).unionByName(src.withColumn("channel", F.lit(1)).withColumn("value", F.col("value") * 2))
    model = spark.createDataFrame([("i", 1.0, 0.0, 3.0, 0.0, 1.0, 2.0)], "g string, a double, b double, tx double, c double, d double, ty double")
    size = spark.createDataFrame([("i", 80, 70)], "g string, width int, height int")
    p = dense.write_registered(both, model, size, ["g"], f"{tmp_path}/r", tile=32, parts=3).orderBy("part").collect()
    assert [r.part for r in p] == [0, 1, 2] and p[-1].tiles_done == sum(r.tiles for r in p)
    assert dense.write_registered(both, model, size, ["g"], f"{tmp_path}/r", tile=32, parts=3).count() == 3  # nothing is left to do
    for channel in (0, 1):
        out = np.zeros((96, 96))
        for r in dense.read_region(spark, f"{tmp_path}/r/tiles", 0, 0, 96, 0, 96, [channel]).collect():
            out[r.y0 : r.y0 + 32, r.x0 : r.x0 + 32] = np.frombuffer(r.data, "<f4").reshape(32, 32)
        assert (out[2:62, 3:73] == img * (channel + 1)).all() and out.sum() == img.sum() * (channel + 1)


def test_tiles_of_pixels_are_those_whose_window_holds_them(spark):
    size = spark.createDataFrame([("i", 70, 50)], "g string, width int, height int")
    px = spark.createDataFrame([("i", y, x) for y in range(50) for x in range(70)], "g string, y int, x int")
    plan = masks.tile_plan(size, ["g"], 20, 6).collect()
    got = {(r.y, r.x, r.tile, r.in_core) for r in masks.in_tiles(px, size, ["g"], 20, 6).collect()}
    want = {(y, x, t.tile, t.core_y0 <= y < t.core_y1 and t.core_x0 <= x < t.core_x1) for t in plan for y in range(t.y0, t.y1) for x in range(t.x0, t.x1)}
    assert got == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stitching_joins_no_pixels(spark, monkeypatch):
    """Exploded pixels pass for a small table: a join with them was planned as a broadcast of them all (F2)."""
    seen = []
    components = masks.components
    monkeypatch.setattr(masks, "components", lambda n, e: seen.append(_plan(e)) or components(n, e))
    img = np.zeros((40, 40), int)
    img[15:25, 15:25] = 1
    t = masks.in_tiles(pixels(spark, img), spark.createDataFrame([("i", 40, 40)], "g string, width int, height int"), ["g"], 20, 6)
    got = image(masks.stitch_tiles(t.select("g", "tile", "y", "x", (F.col("label") + F.col("tile")).alias("label"), "in_core"), ["g"]), img.shape)
    assert (got == img).all()  # the four parts meet
    assert len(seen) == 1 and "Join" not in seen[0]


def test_field_warp_broadcasts_no_cells(spark, monkeypatch):
    """Cells and nodes pass for small tables: joins with them were planned as broadcasts (F6). Blocks of cells are sampled like
    their cells, also beside a missing node and at a ragged edge."""
    plans = []
    whole = raster.map_groups
    monkeypatch.setattr(raster, "map_groups", lambda df, *a, **k: plans.append(_plan(df)) or whole(df, *a, **k))
    rng = np.random.default_rng(7)
    h, w, step = 150, 205, 20
    img = rng.integers(1, 99, (h, w))
    sx, sy = (np.tile(np.arange(12) * 20.0, (9, 1)) + rng.uniform(-4, 4, (9, 12)), np.tile(np.arange(9)[:, None] * 20.0, (1, 12)) + rng.uniform(-4, 4, (9, 12)))
    nodes = [("i", j, i, float(sx[j, i]), float(sy[j, i])) for j in range(9) for i in range(12) if (j, i) != (6, 6)]
    size = spark.createDataFrame([("i", w, h)], "g string, width int, height int")
    field = spark.createDataFrame(nodes, "g string, gy int, gx int, sx double, sy double")
    got = image(raster.field_warp(pixels(spark, img).withColumnRenamed("label", "value"), field, size, ["g"], step), img.shape, "value")
    want = np.zeros_like(img)
    sx[6, 6] = np.nan
    for y in range(h):
        for x in range(w):
            j, i, v, u = y // step, x // step, y % step / step, x % step / step
            a, b = ((1 - v) * ((1 - u) * s[j, i] + u * s[j, i + 1]) + v * ((1 - u) * s[j + 1, i] + u * s[j + 1, i + 1]) for s in (sx, sy))
            if np.isfinite(a) and 0 <= round(b) < h and 0 <= round(a) < w:
                want[y, x] = img[round(b), round(a)]
    assert (got == want).all() and len(plans) == 1
    assert plans[0].count("BroadcastHashJoin") <= 2  # frames and tiles' ends, a row a group each
