"""Readers of cell tables, metadata, contours and images, and what brings them to one schema."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoloom.functions import scalar as S
from cytoloom.runtime import cut

#: The image formats that are listed.
IMAGE_SUFFIXES = (".tif", ".tiff", ".png", ".jpg", ".jpeg")
#: Other names of columns and fields.
FEATURE_ALIASES = {"label": "cell_id", "id": "cell_id", "x": "centroid_x", "y": "centroid_y", "centroid-1": "centroid_x", "centroid-0": "centroid_y"}
FIELD_ALIASES = {
    "source_wsi_path": ["input", "wsi_path", "source_path"],
    "source_mask_path": ["mask_path", "source_mask"],
    "origin_x": ["x", "region_x"],
    "origin_y": ["y", "region_y"],
    "image_width": ["width", "wsi_width", "image_w"],
    "image_height": ["height", "wsi_height", "image_h"],
    "channel": ["source_channel", "cellpose.source_channel", "channel_name"],
}
METADATA_FIELDS = ["source_wsi_path", "source_mask_path", "coordinate_space", "origin_x", "origin_y", "downsample", "image_width", "image_height", "mpp_x", "mpp_y", "mpp_reliable", "channel", "segmentation_method"]
LEVEL0_SPACES = ["level0_pixel", "level0", "wsi_level0_pixel"]
SCALED_SPACES = ["roi_pixel", "mask_pixel", "downsampled_pixel", "preview_pixel"]


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime) of every image below a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return f.select("path", "length", "modificationTime").where(F.lower("path").rlike("(" + "|".join(s.replace(".", "\\.") for s in IMAGE_SUFFIXES) + ")$"))


def image_mode(shape: Column | str) -> Column:
    """'2d' or '3d_zstack' of an array of axis lengths: three axes are a stack unless the first or last is a channel axis
    of at most four; four axes are a stack."""
    s = S.col(shape)
    colour = (F.element_at(s, 1) <= 4) | (F.element_at(s, 3) <= 4)
    return F.when(F.size(s) == 2, "2d").when((F.size(s) == 3) & colour, "2d").when(F.size(s).isin(3, 4), "3d_zstack")


def read_centroids(spark: SparkSession, csv: str, metadata: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A centroid CSV, every column as text until it is normalised, and its JSON metadata (beside it by default)."""
    meta = spark.read.option("multiLine", "true").json(metadata or csv.rsplit(".", 1)[0] + ".json")
    return spark.read.option("header", "true").csv(csv), normalise_metadata(meta)


def normalise_metadata(meta: DataFrame) -> DataFrame:
    """The thirteen metadata fields from whatever names they came under; other columns are kept behind them. Pixel sizes are
    reliable only if both are known and, where the record tells, it says so. Without a method the segmenter is told by its
    own field, or its name anywhere in the record."""
    have = set(meta.columns) | {f"{c.name}.{f.name}" for c in meta.schema if hasattr(c.dataType, "fields") for f in c.dataType.fields}
    first = lambda names: F.coalesce(*[F.col(n) for n in names if n in have]) if any(n in have for n in names) else F.lit(None)
    text = lambda c: F.when(F.trim(c.cast("string")) != "", c.cast("string"))
    number = lambda c: S.clean(c.try_cast("double"))
    level = F.col("level").try_cast("int") if "level" in have else F.lit(None).cast("int")
    field = {f: first([f, *FIELD_ALIASES.get(f, [])]) for f in METADATA_FIELDS}
    payload = F.lower(F.to_json(F.struct(*[F.col(c) for c in meta.columns])))
    is_cellpose = F.col("cellpose").isNotNull() if "cellpose" in have else F.lit(False)
    method = F.when(is_cellpose, "Cellpose").when(payload.contains("cellvit"), "CellViT").otherwise(F.coalesce(text(first(["method"])), F.lit("unknown")))
    mpp_known = number(field["mpp_x"]).isNotNull() & number(field["mpp_y"]).isNotNull()
    scale = number(F.col("level_downsample")) if "level_downsample" in have else F.lit(None).cast("double")
    out = {
        "source_wsi_path": text(field["source_wsi_path"]),
        "source_mask_path": text(field["source_mask_path"]),
        "coordinate_space": F.coalesce(F.lower(F.trim(text(field["coordinate_space"]))), F.when(level == 0, "level0_pixel").otherwise("mask_pixel")),
        "origin_x": F.coalesce(number(field["origin_x"]), F.lit(0.0)),
        "origin_y": F.coalesce(number(field["origin_y"]), F.lit(0.0)),
        "downsample": F.coalesce(number(field["downsample"]), F.when(level.isNull() | (level == 0), 1.0).otherwise(F.coalesce(scale, F.lit(1.0)))),
        "image_width": number(field["image_width"]).try_cast("int"),
        "image_height": number(field["image_height"]).try_cast("int"),
        "mpp_x": number(field["mpp_x"]),
        "mpp_y": number(field["mpp_y"]),
        "mpp_reliable": mpp_known & (S.truthy(field["mpp_reliable"].cast("string")) if "mpp_reliable" in have else F.lit(True)),
        "channel": F.coalesce(text(field["channel"]), F.lit("")),
        "segmentation_method": F.coalesce(text(field["segmentation_method"]), method),
    }
    rest = [c for c in meta.columns if c not in METADATA_FIELDS]
    return meta.select(*[v.alias(k) for k, v in out.items()], *rest)


def layer_metadata(meta: DataFrame, height: Column | str, width: Column | str, channel: str = "", method: str = "unknown") -> DataFrame:
    """``meta`` of a mask layer of ``height`` x ``width`` pixels, normalised: a missing image size is where the mask ends in
    level-0 pixels, pixel sizes are unreliable unless said otherwise, and the space, channel and method have defaults."""
    have = set(meta.columns)
    known = normalise_metadata(meta)
    ends = lambda origin, n: F.ceil(F.col(origin) + S.col(n) * F.col("downsample")).cast("int")
    return known.withColumns({
        "coordinate_space": F.col("coordinate_space") if "coordinate_space" in have else F.lit("mask_pixel"),
        "image_width": F.coalesce("image_width", ends("origin_x", width)), "image_height": F.coalesce("image_height", ends("origin_y", height)),
        "mpp_reliable": F.col("mpp_reliable") if "mpp_reliable" in have else F.lit(False),
        "channel": F.coalesce(F.nullif("channel", F.lit("")), F.lit(channel)), "segmentation_method": F.when(F.col("segmentation_method") == "unknown", F.lit(method)).otherwise(F.col("segmentation_method")),
    })


def check_metadata(meta: DataFrame) -> DataFrame:
    """``meta``, where a space that can't be read, an image size that is missing or not above 0 or such a downsample raises
    when it is used."""
    ok = F.col("coordinate_space").isin(*LEVEL0_SPACES, *SCALED_SPACES)
    why = F.concat(F.lit("Unsupported coordinate_space: "), F.col("coordinate_space"))
    meta = meta.withColumn("coordinate_space", F.when(ok, F.col("coordinate_space")).otherwise(F.raise_error(why)))
    above = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} must be above 0")))
    return meta.withColumns({c: above(c) for c in ("downsample", "image_width", "image_height") if c in meta.columns})


def with_row_numbers(df: DataFrame, name: str) -> DataFrame:
    """``df`` with 1..n in the order in which it is read: the rows before its partition plus its place there."""
    t = cut(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    n = t.groupBy(part).agg(F.count("*").alias("_n"))  # one row per partition
    before = n.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return t.withColumn("_part", part).join(before, "_part").withColumn(name, F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1).drop("_part", "_before", "_at")


def centroids_to_level0(points: DataFrame, meta: DataFrame, by: Sequence[str], x: str = "centroid_x", y: str = "centroid_y") -> DataFrame:
    """``points`` with level0_x, level0_y: as they are in level-0 spaces, origin + place x downsample in the scaled ones,
    null in a space that isn't known. ``meta`` has one row per group."""
    m = meta.select(*by, F.lower(F.trim("coordinate_space")).alias("_space"), F.col("origin_x").alias("_ox"), F.col("origin_y").alias("_oy"), F.col("downsample").alias("_ds"))
    j = points.join(m, list(by), "left") if by else points.join(F.broadcast(m.limit(1)), F.lit(True), "left")
    to = lambda c, o: F.when(F.col("_space").isin(*LEVEL0_SPACES), F.col(c)).when(F.col("_space").isin(*SCALED_SPACES), S.to_level0(c, o, "_ds"))
    return j.withColumns({"level0_x": to(x, "_ox"), "level0_y": to(y, "_oy")}).drop("_space", "_ox", "_oy", "_ds")


def normalise_features(table: DataFrame, width: Column | float, height: Column | float, min_area: float = 0, max_area: float = 0, order: Sequence[str] = ()) -> DataFrame:
    """A cell table under the usual names, with numbers read as numbers and defaults where there are none: rows without a
    finite place are dropped, areas are at least 1, shapes are those of a disc of that area. Without an id column, ids are
    1..n in the order of ``order``, or else of the source."""
    for old, new in FEATURE_ALIASES.items():
        if old in table.columns and new not in table.columns:
            table = table.withColumnRenamed(old, new)
    missing = [c for c in ("centroid_x", "centroid_y") if c not in table.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if "cell_id" not in table.columns:
        table = with_row_numbers(table.orderBy(*order) if order else table, "cell_id")
    if "area" not in table.columns:
        table = table.withColumn("area", F.lit(1.0))
    num = lambda c: S.clean(F.col(c).cast("string").try_cast("double"))
    t = table.withColumns({"cell_id": num("cell_id").try_cast("long"), **{c: num(c) for c in ("centroid_x", "centroid_y", "area")}})
    t = t.where("centroid_x is not null and centroid_y is not null and area is not null").withColumn("area", F.greatest("area", F.lit(1.0)))
    if min_area > 0:
        t = t.where(F.col("area") >= min_area)
    if max_area > 0:
        t = t.where(F.col("area") <= max_area)
    d = S.equivalent_diameter("area")
    # fixed values: what a cell of unknown shape counts as
    zero, one = F.lit(0.0), F.lit(1.0)
    defaults = {"equivalent_diameter": d, "perimeter": math.pi * d, "roundness": one, "eccentricity": zero, "solidity": one, "major_axis_length": d, "minor_axis_length": d, "aspect_ratio": one, "elongation": zero, "orientation": zero, "axis_vec_x": one, "axis_vec_y": zero, **{f"hu_{i}": zero for i in range(7)}}
    t = t.withColumns({c: F.coalesce(num(c), v) if c in t.columns else v for c, v in defaults.items()})
    w, h = (v if isinstance(v, Column) else F.lit(float(v)) for v in (width, height))
    return t.withColumns({"pos_x_norm": F.col("centroid_x") / F.greatest(w, one), "pos_y_norm": F.col("centroid_y") / F.greatest(h, one)})


CELL = "struct<centroid:array<double>,contour:array<array<double>>,bbox:array<array<double>>>"


def contour_features(docs: DataFrame, text: str, by: Sequence[str]) -> DataFrame:
    """(by, cell_id, centroid_x, centroid_y, area, perimeter, axis lengths, eccentricity, orientation, ...) of the cells in a
    JSON text: an object with ``cells``, or a bare list of {centroid, contour, bbox}.

    Cell ids count from 1 through the list, cells without a centroid of two numbers included, which give no row. Shapes come
    from the contour's polygon and its points' spread; without a contour the area is the box's, and at least 1."""
    cells = F.coalesce(F.from_json(F.col(text), f"struct<cells:array<{CELL}>>").cells, F.from_json(F.col(text), f"array<{CELL}>"))
    c = docs.select(*by, F.posexplode(cells).alias("pos", "cell")).where("size(cell.centroid) >= 2 and get(cell.centroid, 0) is not null and get(cell.centroid, 1) is not null")
    pts = F.transform(F.filter(F.coalesce(F.col("cell.contour"), F.array().cast("array<array<double>>")), lambda p: F.size(p) >= 2), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    box = F.col("cell.bbox")
    box_area = F.when(F.size(box) >= 2, F.abs((F.get(F.get(box, F.lit(1)), F.lit(0)) - F.get(F.get(box, F.lit(0)), F.lit(0))) * (F.get(F.get(box, F.lit(1)), F.lit(1)) - F.get(F.get(box, F.lit(0)), F.lit(1)))))
    c = c.select(*by, (F.col("pos") + 1).alias("cell_id"), F.get("cell.centroid", F.lit(0)).alias("centroid_x"), F.get("cell.centroid", F.lit(1)).alias("centroid_y"), pts.alias("contour"), box_area.alias("_box"))
    has = F.size("contour") >= 3
    area = F.when(has, S.shoelace_area("contour"))
    xs, ys = F.transform("contour", lambda p: p.x), F.transform("contour", lambda p: p.y)
    c = c.withColumns({"_a": area, "perimeter": F.when(has, S.contour_length("contour")), "_mx": S.mean_of(xs), "_my": S.mean_of(ys)})
    cov = lambda f: F.aggregate("contour", F.lit(0.0), lambda acc, p: acc + f(p)) / F.greatest(F.size("contour") - 1, F.lit(1))
    sxx, syy = cov(lambda p: (p.x - F.col("_mx")) * (p.x - F.col("_mx"))), cov(lambda p: (p.y - F.col("_my")) * (p.y - F.col("_my")))
    sxy = cov(lambda p: (p.x - F.col("_mx")) * (p.y - F.col("_my")))
    major, minor, angle = S.axes_of(sxx, syy, sxy)
    c = c.withColumns({"area": F.greatest(F.coalesce(F.when(F.col("_a") > 0, F.col("_a")), "_box", F.lit(0.0)), F.lit(1.0)), "major_axis_length": F.when(has, major), "minor_axis_length": F.when(has, minor), "orientation": F.when(has, angle)})
    c = c.withColumn("eccentricity", F.when(F.col("major_axis_length") > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - F.pow(F.col("minor_axis_length") / F.col("major_axis_length"), 2)))))
    return c.select(*by, "cell_id", "centroid_x", "centroid_y", "area", "perimeter", "major_axis_length", "minor_axis_length", "eccentricity", "orientation")


def read_match_tables(spark: SparkSession, fixed: str, moving: str, matches: str, x: str = "x", y: str = "y") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three CSVs; the matches' ids may be called cell_id_r1/cell_id_r2 or cell_id_1/cell_id_2."""
    a, b, m = (spark.read.option("header", "true").option("inferSchema", "true").csv(p) for p in (fixed, moving, matches))
    for c in ("cell_id", x, y):
        if c not in a.columns or c not in b.columns:
            raise ValueError(f"missing columns: {c}")
    for one, two in (("cell_id_r1", "cell_id_r2"), ("cell_id_1", "cell_id_2")):
        if {one, two} <= set(m.columns):
            return a, b, m.withColumnsRenamed({one: "id1", two: "id2"})
    raise ValueError("missing columns: cell_id_r1, cell_id_r2")


def landmarks_of(matches: DataFrame, fixed: DataFrame, moving: DataFrame, id_col: str = "cell_id", x: str = "x", y: str = "y", top: int | None = None, score: str = "distance") -> DataFrame:
    """(id1, id2, x1, y1, x2, y2) of matches whose cells both exist, the first row of an id counting; with ``top`` the best
    by ``score`` where there is one, but at least three."""
    if top is not None and score in matches.columns:
        matches = matches.orderBy(score, "id1", "id2").limit(max(3, top))
    one = lambda df, n: df.groupBy(F.col(id_col).alias(f"id{n}")).agg(F.min(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).alias("p")).select(f"id{n}", F.col("p.x").alias(f"x{n}"), F.col("p.y").alias(f"y{n}"))
    return matches.join(one(fixed, 1), "id1").join(one(moving, 2), "id2")


def match_channel(channels: DataFrame, requested: str) -> DataFrame:
    """The one channel (index, name) that a request means, the first of these that there is: of '3: x' the index 3; the exact
    name; a part of a name; of a bare number the index. What stands before a colon and is no number is dropped; 'auto',
    'auto dapi' and nothing mean dapi. Case and outer blanks don't count; among equals the least index comes out."""
    text = re.sub(r"^(auto( dapi)?)?$", "dapi", requested.strip().lower())
    numbered = re.match(r"([+-]?\d+)\s*:", text)
    wanted = text if numbered or ":" not in text else text.split(":", 1)[1].strip()
    is_number = re.fullmatch(r"[+-]?\d+", wanted)
    name, index = F.lower(F.trim("name")), F.col("index")
    ways = [index == int(numbered[1]) if numbered else F.lit(False), name == wanted, name.contains(wanted), index == int(wanted) if is_number else F.lit(False)]
    return channels.withColumn("_way", F.array_position(F.array(*[F.coalesce(w, F.lit(False)) for w in ways]), F.lit(True))).where("_way > 0").orderBy("_way", "index").limit(1).drop("_way")


def parse_channels(pages: DataFrame, text: str = "description") -> DataFrame:
    """``pages`` (index, description) with name ('Channel n' by default) and colour (three numbers 0..255, or null) from the
    description's XML."""
    x = F.when(F.col(text).rlike(r"^\s*<"), F.col(text))
    name = F.nullif(F.xpath_string(x, F.lit("/*/Name")), F.lit(""))
    rgb = F.transform(F.split(F.xpath_string(x, F.lit("/*/Color")), ","), lambda p: S.clip(F.trim(p).try_cast("double"), 0.0, 255.0).cast("int"))
    good = (F.size(rgb) == 3) & F.forall(rgb, lambda v: v.isNotNull())
    return pages.withColumns({"name": F.coalesce(name, F.concat(F.lit("Channel "), F.col("index").cast("string"))), "color": F.when(good, rgb)})


def level_groups(levels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pyramid levels (by, level, width, height) with ``level_group``: neighbouring levels of one size share a group, from 0."""
    w = W.partitionBy(*by).orderBy("level")
    new = (F.col("width") != F.lag("width").over(w)) | (F.col("height") != F.lag("height").over(w))
    return levels.withColumn("_new", F.coalesce(new.cast("int"), F.lit(0))).withColumn("level_group", F.sum("_new").over(w).cast("int")).drop("_new")


def find_segmenter_outputs(spark: SparkSession, folder: str, wanted: Sequence[str] = ("cells.json", "cell_detection.json")) -> DataFrame:
    """Paths below a folder that end in a wanted name, the first wanted name and the shortest path first."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder).select("path")
    rank = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(wanted))):
        rank = F.when(F.lower("path").endswith(name), F.lit(i)).otherwise(rank)
    return f.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.length("path"), "path")


def checked_mask(pixels: DataFrame) -> DataFrame:
    """A label layer as whole labels: rounded half to even; a negative label raises when it is used; 0 is left out."""
    v = F.rint("label").cast("int")
    return pixels.withColumn("label", F.when(v >= 0, v).otherwise(F.raise_error(F.lit("labels must not be negative")))).where("label > 0")


def extract_channel(pixels: DataFrame, channel: int, axis: str = "channel") -> DataFrame:
    return pixels.where(F.col(axis) == channel).drop(axis)
