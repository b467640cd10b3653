"""Masks and rasters: of the part table's rectangles, and of the cells' places."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.operators import masks, models, raster, segment
from cytoloom.operators.models import MODEL
from cytoloom.queries.base import BY, CELLS, MASK, cells, mask, r, table
from cytoloom.runtime import cut
from cytoloom.sources import sinks, tables

IMG = ["image"]


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return mask(spark, sf).select("image").distinct().withColumns({"width": F.lit(1000), "height": F.lit(800)})


def _shifted_model(spark: SparkSession, sf: str) -> DataFrame:
    """A turn by three right angles' worth of swaps would lose pixels; a shift by half pixels and a slight stretch doesn't."""
    return _frames(spark, sf).select("image", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(12.0).alias("tx"), F.lit(0.0).alias("c"), F.lit(1.0).alias("d"), F.lit(-7.0).alias("ty"))


def mask_moments(spark: SparkSession, sf: str) -> DataFrame:
    p = masks.region_properties(mask(spark, sf), IMG)
    return p.select("image", "label", r("area"), r("centroid_x"), r("centroid_y"), r("major_axis_length"), r("minor_axis_length"), r("eccentricity"), r("hu_0"))


def mask_perimeters(spark: SparkSession, sf: str) -> DataFrame:
    return masks.perimeters(mask(spark, sf), IMG).select("image", "label", r("perimeter"))


def mask_solidity(spark: SparkSession, sf: str) -> DataFrame:
    return masks.solidities(mask(spark, sf), IMG).select("image", "label", r("solidity"))


def mask_features(spark: SparkSession, sf: str) -> DataFrame:
    f = masks.cell_features(mask(spark, sf), IMG, _frames(spark, sf), min_area=30, extra={"fill": F.col("area") / ((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1))})
    return f.select("image", "label", r("roundness"), r("aspect_ratio"), r("elongation"), r("equivalent_diameter"), r("pos_x_norm"), r("pos_y_norm"), r("fill"))


def mask_translation(spark: SparkSession, sf: str) -> DataFrame:
    """The shift that takes a mask, moved by 7 rows and 11 columns, back; found from its labels' centroids."""
    f = masks.region_properties(mask(spark, sf), IMG).select("image", "label", F.col("centroid_x").alias("x1"), F.col("centroid_y").alias("y1"))
    moved = mask(spark, sf).withColumns({"y": F.col("y") + 7, "x": F.col("x") + 11})
    m = masks.region_properties(moved, IMG).select("image", "label", F.col("centroid_x").alias("x2"), F.col("centroid_y").alias("y2"))
    return models.fit_translation(f.join(m, ["image", "label"]), IMG).select("image", r("tx"), r("ty"), "n")


def relabelled(spark: SparkSession, sf: str) -> DataFrame:
    """The rectangles found again as connected components: a box and an area each, in raster order."""
    p = masks.relabel_components(mask(spark, sf).withColumn("label", F.lit(1)), IMG)
    return p.groupBy("image", "label").agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"))


def binary_masks(spark: SparkSession, sf: str) -> DataFrame:
    return masks.is_binary(mask(spark, sf), IMG)


def tile_plan(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "slides").where("slide_id is not null").groupBy("slide_id").agg(F.max("image_width").alias("width"), F.max("image_height").alias("height"))
    return masks.tile_plan(s, BY, 256, 32)


def stitched(spark: SparkSession, sf: str) -> DataFrame:
    """The masks cut into overlapping tiles whose labels start anew, and stitched again."""
    t = masks.in_tiles(mask(spark, sf), _frames(spark, sf), IMG, 200, 20)
    s = masks.stitch_tiles(t.select("image", "tile", "y", "x", "label", "in_core"), IMG)
    return s.groupBy("image", "label").agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0")).select("image", "area", "x0", "y0")


def blank_tiles(spark: SparkSession, sf: str) -> DataFrame:
    p = mask(spark, sf).withColumns({"ty": F.floor(F.col("y") / 100).cast("int"), "tx": F.floor(F.col("x") / 100).cast("int"), "value": F.pmod("label", F.lit(40))})
    return masks.blank_tiles(p, ["image", "ty", "tx"], F.lit(10_000), min_share=0.03).select("image", "ty", "tx", "blank")


def polygons(spark: SparkSession, sf: str) -> DataFrame:
    """A diamond around each rectangle, drawn."""
    b = mask(spark, sf).groupBy("image", "label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    at = lambda dx, dy: F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"))
    p = masks.rasterise_polygons(b.select("image", "label", F.array(at(-6.25, 0.0), at(0.0, -6.25), at(6.25, 0.0), at(0.0, 6.25)).alias("contour")), IMG)
    return p.groupBy("image", "label").agg(F.count("*").alias("pixels"))


def discs(spark: SparkSession, sf: str) -> DataFrame:
    b = mask(spark, sf).groupBy("image", "label").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return masks.rasterise_discs(b, IMG, 7, F.lit(1000), F.lit(800)).groupBy("image", "label").agg(F.count("*").alias("pixels"))


def warped_mask(spark: SparkSession, sf: str) -> DataFrame:
    w = raster.affine_warp(mask(spark, sf).withColumnRenamed("label", "value"), _shifted_model(spark, sf), _frames(spark, sf), IMG)
    return w.groupBy("image", F.col("value").alias("label")).agg(F.count("*").alias("pixels"), F.min("x").cast("int").alias("x0"), F.min("y").cast("int").alias("y0"))


def warped_smoothly(spark: SparkSession, sf: str) -> DataFrame:
    """Moved by half a pixel each way: every pixel is a mean of four."""
    m = _shifted_model(spark, sf).withColumns({"tx": F.lit(0.5), "ty": F.lit(0.5)})
    w = raster.affine_warp(mask(spark, sf).select("image", "y", "x", F.lit(1.0).alias("value")), m, _frames(spark, sf), IMG, order=1)
    return w.groupBy("image").agg(F.count("*").alias("pixels"), F.round(F.sum("value"), 4).alias("total"))


def field_warped(spark: SparkSession, sf: str) -> DataFrame:
    """The same shift given as a coarse field."""
    n = F.explode(F.sequence(F.lit(0), F.lit(8)))
    f = _frames(spark, sf).select("image", n.alias("gy")).select("image", "gy", n.alias("gx")).withColumns({"sx": F.col("gx") * 125.0 - 12, "sy": F.col("gy") * 125.0 + 7})
    w = raster.field_warp(mask(spark, sf).withColumnRenamed("label", "value"), f, _frames(spark, sf), IMG, 125)
    return w.groupBy("image", F.col("value").alias("label")).agg(F.count("*").alias("pixels"), F.min("x").cast("int").alias("x0"), F.min("y").cast("int").alias("y0"))


def _boxes(w: DataFrame) -> DataFrame:
    return w.groupBy("image", F.col("value").alias("label")).agg(F.count("*").alias("pixels"), F.min("x").cast("int").alias("x0"), F.min("y").cast("int").alias("y0"))


def turned_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Turned by 27 degrees about a point, into a larger frame: where each label's pixels come to lie."""
    s, c = math.sin(math.radians(27)), math.cos(math.radians(27))
    m = _frames(spark, sf).select("image", *[F.lit(float(v)).alias(n) for n, v in zip(MODEL, (c, -s, 400.0, s, c, 0.0))])
    frame = _frames(spark, sf).withColumns({"width": F.lit(1300), "height": F.lit(1200)})
    w = raster.affine_warp(mask(spark, sf).withColumnRenamed("label", "value"), m, frame, IMG)
    return w.groupBy("image", F.col("value").alias("label")).agg(F.count("*").alias("pixels"), F.sum("x").alias("xs"), F.sum("y").alias("ys"))


def _shifted_landmarks(spark: SparkSession, sf: str) -> DataFrame:
    """A landmark for each label: its centre, and where the shift takes it."""
    b = mask(spark, sf).groupBy("image", "label").agg(F.avg("x").alias("x2"), F.avg("y").alias("y2"))
    return cut(b.select("image", F.col("label").cast("long").alias("id"), (F.col("x2") + 12).alias("x1"), (F.col("y2") - 7).alias("y1"), "x2", "y2"))


def locally_warped(spark: SparkSession, sf: str) -> DataFrame:
    """The shift told by landmarks, by local affines."""
    marks = _shifted_landmarks(spark, sf).withColumn("id", F.col("image") * 100_000 + F.col("id"))
    return _boxes(raster.local_affine_warp(mask(spark, sf).withColumnRenamed("label", "value"), marks, _shifted_model(spark, sf), _frames(spark, sf), IMG))


def spline_warped(spark: SparkSession, sf: str) -> DataFrame:
    """The shift told by landmarks, by a spline from the shifted places back."""
    marks = _shifted_landmarks(spark, sf).select("image", F.col("x1").alias("fx"), F.col("y1").alias("fy"), F.col("x2").alias("tx"), F.col("y2").alias("ty"))
    return _boxes(raster.spline_warp(mask(spark, sf).withColumnRenamed("label", "value"), cut(models.fit_spline(marks, IMG)), _frames(spark, sf), IMG))


def grid_warped(spark: SparkSession, sf: str) -> DataFrame:
    """Moved by a grid of shifts that grow to the right and downwards."""
    n = F.explode(F.sequence(F.lit(0), F.lit(3)))
    g = _frames(spark, sf).select("image", n.alias("gy")).select("image", "gy", n.alias("gx")).withColumns({"dx": F.col("gx") * 6.25 + 1.3, "dy": F.col("gy") * 3.125 - 2.2})
    w = raster.grid_warp(mask(spark, sf).withColumnRenamed("label", "value"), g, _frames(spark, sf), IMG)
    return w.groupBy("image", F.col("value").alias("label")).agg(F.count("*").alias("pixels"), F.sum("x").alias("xs"), F.sum("y").alias("ys"))


def valid_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return raster.valid_overlap(_shifted_model(spark, sf), _frames(spark, sf), _frames(spark, sf), IMG)


def _moved(spark: SparkSession, sf: str) -> DataFrame:
    return raster.shift(mask(spark, sf), IMG, 3, 4, _frames(spark, sf))


def merged_masks(spark: SparkSession, sf: str) -> DataFrame:
    o = raster.merge_overlay(_moved(spark, sf), mask(spark, sf), IMG)
    return o.groupBy("image", "source").agg(F.count("*").alias("pixels"), F.sum("label").alias("labels"))


def fused_images(spark: SparkSession, sf: str) -> DataFrame:
    o = raster.max_fusion(_moved(spark, sf).withColumnRenamed("label", "value"), mask(spark, sf).withColumnRenamed("label", "value"), IMG)
    return o.groupBy("image").agg(F.count("*").alias("pixels"), F.sum("value").alias("total"))


def dice_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return raster.dice(_moved(spark, sf), mask(spark, sf), IMG).select("image", r("dice"))


def mass_centres(spark: SparkSession, sf: str) -> DataFrame:
    return raster.centre_of_mass(mask(spark, sf), IMG).select("image", r("x"), r("y"))


def downsampled(spark: SparkSession, sf: str) -> DataFrame:
    return raster.downsample(mask(spark, sf), 4).groupBy("image", "label").agg(F.count("*").alias("pixels"), F.min("x").cast("int").alias("x0"), F.min("y").cast("int").alias("y0"))


def projected(spark: SparkSession, sf: str) -> DataFrame:
    s = _frames(spark, sf).withColumns({"target_width": F.lit(1600), "target_height": F.lit(600)})
    return raster.project_nearest(mask(spark, sf), IMG, s).groupBy("image", "label").agg(F.count("*").alias("pixels"))


def max_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Images as planes of one stack."""
    p = raster.max_projection(mask(spark, sf).withColumn("stack", F.floor(F.col("image") / 4).cast("int")), ["stack"])
    return p.groupBy("stack").agg(F.count("*").alias("pixels"), F.sum("label").alias("labels"))


def cell_density(spark: SparkSession, sf: str) -> DataFrame:
    d = raster.density(cells(spark, sf), ["slide_id", "round_no"], "centroid_x", "centroid_y", 16.0)
    return d.select("slide_id", "round_no", "y", "x", "value")


def blurred_density(spark: SparkSession, sf: str) -> DataFrame:
    d = raster.gaussian_blur(raster.density(cells(spark, sf), ["slide_id", "round_no"], "centroid_x", "centroid_y", 16.0), ["slide_id", "round_no"], 1.2)
    return d.groupBy("slide_id", "round_no").agg(F.count("*").alias("pixels"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 6).alias("top"))


def density_preview(spark: SparkSession, sf: str) -> DataFrame:
    d = raster.to_uint8(raster.density(cells(spark, sf), ["slide_id", "round_no"], "centroid_x", "centroid_y", 64.0), ["slide_id", "round_no"])
    return d.select("slide_id", "round_no", "y", "x", "value")


def stretched_density(spark: SparkSession, sf: str) -> DataFrame:
    d = raster.stretch(raster.density(cells(spark, sf), ["slide_id", "round_no"], "centroid_x", "centroid_y", 64.0), ["slide_id", "round_no"])
    return d.select("slide_id", "round_no", "y", "x", r("value"))


def _canvases(spark: SparkSession, sf: str) -> DataFrame:
    c = cut(cells(spark, sf).select("slide_id", "round_no", "centroid_x", "centroid_y"))
    s = c.groupBy("slide_id").agg((F.greatest(F.max("centroid_x"), F.max("centroid_y")) / 100).alias("px"))
    c = c.join(s, "slide_id").withColumns({"cx": F.col("centroid_x") / F.col("px") + 10, "cy": F.col("centroid_y") / F.col("px") + 10})
    return raster.density(c, ["slide_id", "round_no"], "cx", "cy")


def _rounds(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    d = cut(d)
    return d.where("round_no = 1").drop("round_no"), d.where("round_no = 2").drop("round_no")


def coarse_rotations(spark: SparkSession, sf: str) -> DataFrame:
    f, m = _rounds(_canvases(spark, sf))
    return raster.coarse_rotation(f, m, BY, blur=(1.5, 2.0)).select("slide_id", "angle_deg", "dx", "dy", r("ncc", 4))


def tissue_similarity(spark: SparkSession, sf: str) -> DataFrame:
    f, m = _rounds(raster.gaussian_blur(_canvases(spark, sf), ["slide_id", "round_no"], 1.5, 2.0))
    return raster.tissue_similarity(f.where("value > 0.05"), m.where("value > 0.05"), BY).select("slide_id", *[r(c, 3) for c in [*MODEL, "dice"]])


def mask_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Masks as tile rows and back."""
    t = sinks.to_tiles(mask(spark, sf), IMG, "label", 128)
    p = sinks.from_tiles(t, IMG, "label")
    return p.groupBy("image", "label").agg(F.count("*").alias("pixels"), F.sum("x").alias("xs"), F.sum("y").alias("ys"))


def contour_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells read from a JSON text per image, made of the rectangles' corners."""
    b = mask(spark, sf).groupBy("image", "label").agg(*[f(c).cast("double").alias(n) for n, f, c in (("x0", F.min, "x"), ("x1", F.max, "x"), ("y0", F.min, "y"), ("y1", F.max, "y"))])
    pt = lambda x, y: F.array(F.col(x), F.col(y))
    cell = F.struct("label", F.struct(F.array((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2).alias("centroid"), F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x1", "y1"), pt("x0", "y1")).alias("contour"), F.array(pt("x0", "y0"), pt("x1", "y1")).alias("bbox")).alias("c"))
    docs = b.groupBy("image").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(cell)), lambda s: s.c).alias("cells"))).alias("text"))
    c = tables.contour_features(docs, "text", IMG)
    return c.select("image", "cell_id", r("centroid_x"), r("centroid_y"), r("area"), r("perimeter"))


def segmented(spark: SparkSession, sf: str) -> DataFrame:
    """The rectangles as images in dense tiles, segmented tile by tile, and stitched: their boxes."""
    p = segment.segment_pixels(mask(spark, sf), segment.threshold_segmenter(), IMG, "label", 250)
    p = p.withColumns({"tile": (F.col("y0") / 250 * 4 + F.col("x0") / 250).cast("int"), "in_core": F.lit(True)}).drop("y0", "x0")
    s = masks.stitch_tiles(p, IMG, union=False)
    return s.groupBy("image", "label").agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0")).select("image", "area", "x0", "y0")


QUERIES = {f.__name__: f for f in (mask_moments, mask_perimeters, mask_solidity, mask_features, mask_translation, relabelled, binary_masks, tile_plan, stitched, segmented, blank_tiles, polygons, discs, warped_mask, warped_smoothly, field_warped, turned_mask, locally_warped, spline_warped, grid_warped, valid_overlap, merged_masks, fused_images, dice_overlap, mass_centres, downsampled, projected, max_projection, cell_density, blurred_density, density_preview, stretched_density, coarse_rotations, tissue_similarity, mask_tiles, contour_cells)}

_MOVED = f"{MASK}, moved AS (SELECT image, label, y + 3 AS y, x + 4 AS x FROM mask WHERE y + 3 < 800 AND x + 4 < 1000)"
_DENS = lambda p: f"{CELLS}, d AS (SELECT slide_id, round_no, CAST(round_even(centroid_y / {p}, 0) AS INTEGER) AS y, CAST(round_even(centroid_x / {p}, 0) AS INTEGER) AS x, CAST(count(*) AS DOUBLE) AS value FROM placed GROUP BY ALL)"
_WARP = f"WITH {MASK}, w AS (SELECT image, label, y - 7 AS y, x + 12 AS x FROM mask WHERE y - 7 >= 0 AND x + 12 < 1000) SELECT image, label, count(*) AS pixels, min(x) AS x0, min(y) AS y0 FROM w GROUP BY ALL"
_P = "2 * (w + h) - 4"

SQL = {
    "mask_moments": f"""WITH {MASK}, a AS (SELECT image, label, count(*) AS n, avg(x) AS cx, avg(y) AS cy, var_pop(x) + 1.0 / 12 AS sxx, var_pop(y) + 1.0 / 12 AS syy, covar_pop(x, y) AS sxy, var_pop(x) AS vx, var_pop(y) AS vy FROM mask GROUP BY ALL),
b AS (SELECT *, 4 * sqrt((sxx + syy) / 2 + sqrt(((sxx - syy) / 2) ** 2 + sxy ** 2)) AS major, 4 * sqrt(greatest(0, (sxx + syy) / 2 - sqrt(((sxx - syy) / 2) ** 2 + sxy ** 2))) AS minor FROM a)
SELECT image, label, round(CAST(n AS DOUBLE), 6) AS area, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y, round(major, 6) AS major_axis_length, round(minor, 6) AS minor_axis_length, round(sqrt(greatest(0, 1 - (minor / major) ** 2)), 6) AS eccentricity,
  round(-log10((vx + vy) / n + 1e-30), 6) AS hu_0 FROM b""",
    # a rectangle's border is a ring of side and corner pixels; its corner pixels count as the sides do
    "mask_perimeters": f"WITH {MASK} SELECT image, label, round(CAST({_P} AS DOUBLE), 6) AS perimeter FROM parts",
    "mask_features": f"""WITH {MASK}, a AS (SELECT *, 4 * sqrt((w * w - 1) / 12.0 + 1.0 / 12) AS aw, 4 * sqrt((h * h - 1) / 12.0 + 1.0 / 12) AS ah FROM parts WHERE w * h >= 30)
SELECT image, label, round(4 * pi() * w * h / ({_P}) ** 2, 6) AS roundness, round(greatest(aw, ah) / least(aw, ah), 6) AS aspect_ratio, round(1 - least(aw, ah) / greatest(aw, ah), 6) AS elongation, round(sqrt(4 * w * h / pi()), 6) AS equivalent_diameter,
  round((x0 + (w - 1) / 2) / 999, 6) AS pos_x_norm, round((y0 + (h - 1) / 2) / 799, 6) AS pos_y_norm, CAST(1 AS DOUBLE) AS fill FROM a""",
    "mask_solidity": f"WITH {MASK} SELECT image, label, CAST(1 AS DOUBLE) AS solidity FROM parts",
    "mask_translation": f"WITH {MASK} SELECT image, CAST(-11 AS DOUBLE) AS tx, CAST(-7 AS DOUBLE) AS ty, count(*) AS n FROM parts GROUP BY image",
    "relabelled": f"WITH {MASK} SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY y0, x0) AS INTEGER) AS label, CAST(w * h AS BIGINT) AS area, x0, y0 FROM parts",
    "binary_masks": f"WITH {MASK} SELECT image, count(DISTINCT label) = 1 AS binary FROM parts GROUP BY image",
    "tile_plan": """WITH s AS (SELECT slide_id, max(image_width) AS w, max(image_height) AS h FROM slides WHERE slide_id IS NOT NULL GROUP BY slide_id),
t AS (SELECT *, unnest(range(0, h, 256)) AS cy FROM s), u AS (SELECT *, unnest(range(0, w, 256)) AS cx FROM t)
SELECT slide_id, CAST(cy // 256 * ceil(w / 256.0) + cx // 256 AS INTEGER) AS tile, CAST(greatest(cy - 32, 0) AS INTEGER) AS y0, CAST(least(least(cy + 256, h) + 32, h) AS INTEGER) AS y1, CAST(greatest(cx - 32, 0) AS INTEGER) AS x0, CAST(least(least(cx + 256, w) + 32, w) AS INTEGER) AS x1,
  CAST(cy AS INTEGER) AS core_y0, CAST(least(cy + 256, h) AS INTEGER) AS core_y1, CAST(cx AS INTEGER) AS core_x0, CAST(least(cx + 256, w) AS INTEGER) AS core_x1 FROM u""",
    "stitched": f"WITH {MASK} SELECT image, CAST(w * h AS BIGINT) AS area, x0, y0 FROM parts",
    "segmented": f"""WITH {MASK} SELECT image, count(*) AS area, min(x) AS x0, min(y) AS y0 FROM mask GROUP BY image, label, x // 250, y // 250""",
    "blank_tiles": f"""WITH {MASK}, v AS (SELECT image, CAST(y // 100 AS INTEGER) AS ty, CAST(x // 100 AS INTEGER) AS tx, label % 40 AS value FROM mask)
SELECT image, ty, tx, count(*) / 10000.0 < 0.03 OR count(*) FILTER (WHERE value > 5) <= 100 AS blank FROM v WHERE value > 0 GROUP BY ALL""",
    "polygons": f"""WITH {MASK}, b AS (SELECT image, label, avg(x) AS cx, avg(y) AS cy FROM mask GROUP BY ALL), g AS (SELECT image, label, cx, cy, unnest(range(CAST(floor(cy) AS INTEGER) - 8, CAST(floor(cy) AS INTEGER) + 9)) AS y FROM b),
h AS (SELECT *, unnest(range(CAST(floor(cx) AS INTEGER) - 8, CAST(floor(cx) AS INTEGER) + 9)) AS x FROM g) SELECT image, label, count(*) AS pixels FROM h WHERE abs(x - cx) + abs(y - cy) < 6.25 GROUP BY ALL""",
    "discs": f"""WITH {MASK}, o AS (SELECT dy, dx FROM (SELECT unnest(range(-7, 8)) AS dy), (SELECT unnest(range(-7, 8)) AS dx) WHERE dy * dy + dx * dx <= 49),
p AS (SELECT image, y0 + dy AS y, x0 + dx AS x, max(label) AS label FROM parts, o WHERE y0 + dy >= 0 AND x0 + dx >= 0 AND y0 + dy < 800 AND x0 + dx < 1000 GROUP BY ALL) SELECT image, label, count(*) AS pixels FROM p GROUP BY ALL""",
    "warped_mask": _WARP,
    "field_warped": _WARP,
    "locally_warped": _WARP,
    "spline_warped": _WARP,
    "turned_mask": f"""WITH {MASK}, k AS (SELECT cos(radians(27)) AS c, sin(radians(27)) AS s), g AS (SELECT image, unnest(range(1200)) AS y FROM (SELECT DISTINCT image FROM parts)), o AS (SELECT image, y, unnest(range(1300)) AS x FROM g),
q AS (SELECT image, y, x, CAST(round_even(c * (x - 400) + s * y, 0) AS BIGINT) AS sx, CAST(round_even(-s * (x - 400) + c * y, 0) AS BIGINT) AS sy FROM o, k)
SELECT q.image, label, count(*) AS pixels, CAST(sum(q.x) AS BIGINT) AS xs, CAST(sum(q.y) AS BIGINT) AS ys FROM q JOIN mask m ON m.image = q.image AND m.x = q.sx AND m.y = q.sy GROUP BY ALL""",
    # both axes of the grid are linear, so interpolated and continued alike: dx = 6.25 u + 1.3 with u = (x + 0.5) 4 / 1000 - 0.5
    "grid_warped": f"""WITH {MASK}, g AS (SELECT image, unnest(range(800)) AS y FROM (SELECT DISTINCT image FROM parts)), o AS (SELECT image, y, unnest(range(1000)) AS x FROM g),
q AS (SELECT image, y, x, CAST(round_even(x - (6.25 * ((x + 0.5) * 4 / 1000 - 0.5) + 1.3), 0) AS BIGINT) AS sx, CAST(round_even(y - (3.125 * ((y + 0.5) * 4 / 800 - 0.5) - 2.2), 0) AS BIGINT) AS sy FROM o)
SELECT q.image, label, count(*) AS pixels, CAST(sum(q.x) AS BIGINT) AS xs, CAST(sum(q.y) AS BIGINT) AS ys FROM q JOIN mask m ON m.image = q.image AND m.x = q.sx AND m.y = q.sy GROUP BY ALL""",
    "warped_smoothly": f"""WITH {MASK}, o AS (SELECT unnest([0, 1]) AS d), p AS (SELECT image, y + a.d AS y, x + b.d AS x, 0.25 * count(*) AS value FROM mask, o a, o b GROUP BY ALL) SELECT image, count(*) AS pixels, round(CAST(sum(value) AS DOUBLE), 4) AS total FROM p WHERE y < 800 AND x < 1000 GROUP BY image""",
    "valid_overlap": f"WITH {MASK} SELECT DISTINCT image, CAST((1000 - 12) * (800 - 7) AS BIGINT) AS pixels FROM parts",
    "merged_masks": f"""WITH {_MOVED}, j AS (SELECT coalesce(a.image, b.image) AS image, coalesce(a.label, b.label) AS label, CASE WHEN a.label IS NOT NULL THEN 'moving' ELSE 'fixed' END AS source FROM moved a FULL JOIN mask b ON a.image = b.image AND a.y = b.y AND a.x = b.x)
SELECT image, source, count(*) AS pixels, CAST(sum(label) AS BIGINT) AS labels FROM j GROUP BY ALL""",
    "fused_images": f"""WITH {_MOVED}, j AS (SELECT coalesce(a.image, b.image) AS image, greatest(coalesce(a.label, 0), coalesce(b.label, 0)) AS v FROM moved a FULL JOIN mask b ON a.image = b.image AND a.y = b.y AND a.x = b.x) SELECT image, count(*) AS pixels, CAST(sum(v) AS BIGINT) AS total FROM j GROUP BY image""",
    "dice_overlap": f"""WITH {_MOVED}, c AS (SELECT b.image, count(*) AS n FROM moved a JOIN mask b ON a.image = b.image AND a.y = b.y AND a.x = b.x GROUP BY ALL), a1 AS (SELECT image, count(*) AS n FROM moved GROUP BY image), b1 AS (SELECT image, count(*) AS n FROM mask GROUP BY image)
SELECT b1.image, round(2 * coalesce(c.n, 0) / (a1.n + b1.n), 6) AS dice FROM b1 JOIN a1 USING (image) LEFT JOIN c USING (image)""",
    "mass_centres": f"WITH {MASK} SELECT image, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM mask GROUP BY image",
    "downsampled": f"WITH {MASK} SELECT image, label, count(*) AS pixels, CAST(min(x) // 4 AS INTEGER) AS x0, CAST(min(y) // 4 AS INTEGER) AS y0 FROM mask WHERE x % 4 = 0 AND y % 4 = 0 GROUP BY ALL",
    "projected": f"""WITH {MASK}, t AS (SELECT image, label, sum(CASE WHEN floor((ty + 0.5) * 800 / 600) BETWEEN y0 AND y0 + h - 1 THEN 1 ELSE 0 END) AS ny FROM parts, (SELECT unnest(range(600)) AS ty) GROUP BY ALL),
u AS (SELECT image, label, sum(CASE WHEN floor((tx + 0.5) * 1000 / 1600) BETWEEN x0 AND x0 + w - 1 THEN 1 ELSE 0 END) AS nx FROM parts, (SELECT unnest(range(1600)) AS tx) GROUP BY ALL) SELECT image, label, CAST(nx * ny AS BIGINT) AS pixels FROM t JOIN u USING (image, label) WHERE nx * ny > 0""",
    "max_projection": f"WITH {MASK}, p AS (SELECT CAST(image // 4 AS INTEGER) AS stack, y, x, max(label) AS label FROM mask GROUP BY ALL) SELECT stack, count(*) AS pixels, CAST(sum(label) AS BIGINT) AS labels FROM p GROUP BY stack",
    "cell_density": f"WITH {_DENS(16)} SELECT slide_id, round_no, y, x, value FROM d",
    "blurred_density": f"""WITH {_DENS(16)}, k0 AS (SELECT unnest(range(-5, 6)) AS o), k AS (SELECT o, exp(-0.5 * (o / 1.2) ** 2) / sum(exp(-0.5 * (o / 1.2) ** 2)) OVER () AS w FROM k0),
a AS (SELECT slide_id, round_no, y, x + o AS x, sum(value * w) AS value FROM d, k GROUP BY ALL), b AS (SELECT slide_id, round_no, y + o AS y, x, sum(value * w) AS value FROM a, k GROUP BY ALL)
SELECT slide_id, round_no, count(*) AS pixels, round(sum(value), 4) AS total, round(max(value), 6) AS top FROM b GROUP BY ALL""",
    "density_preview": f"WITH {_DENS(64)}, q AS (SELECT slide_id, round_no, quantile_cont(value, 0.99) AS top FROM d GROUP BY ALL) SELECT slide_id, round_no, y, x, CAST(floor(least(255, 255 * value / top)) AS INTEGER) AS value FROM d JOIN q USING (slide_id, round_no)",
    "stretched_density": f"""WITH {_DENS(64)}, q AS (SELECT slide_id, round_no, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.998) AS hi FROM d GROUP BY ALL)
SELECT slide_id, round_no, y, x, round(CASE WHEN hi > lo THEN least(1, greatest(0, (value - lo) / (hi - lo))) ELSE 0 END, 6) AS value FROM d JOIN q USING (slide_id, round_no)""",
    "mask_tiles": f"WITH {MASK} SELECT image, label, count(*) AS pixels, CAST(sum(x) AS BIGINT) AS xs, CAST(sum(y) AS BIGINT) AS ys FROM mask GROUP BY ALL",
    "contour_cells": f"""WITH {MASK} SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY label) AS INTEGER) AS cell_id, round(x0 + (w - 1) / 2, 6) AS centroid_x, round(y0 + (h - 1) / 2, 6) AS centroid_y, round(CAST((w - 1) * (h - 1) AS DOUBLE), 6) AS area,
  round(CAST(2 * (w + h - 2) AS DOUBLE), 6) AS perimeter FROM parts""",
}
