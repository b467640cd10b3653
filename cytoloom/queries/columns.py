"""Derived columns, filters, statistics and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.functions import scalar as S
from cytoloom.functions import stats
from cytoloom.operators import masks, matching
from cytoloom.queries.base import BY, CELLS, LINKED, SHAPE, cells, linked, r, sides, table
from cytoloom.sources import tables


def shape_features(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    vx, vy = S.axis_vector("orientation")
    return c.select("cell_key", F.round(S.roundness("area", "perimeter"), 6).alias("round_calc"), F.round(S.aspect_ratio("major_axis_length", "minor_axis_length"), 6).alias("aspect_calc"), F.round(S.elongation("major_axis_length", "minor_axis_length"), 6).alias("elongation_calc"), F.round(S.equivalent_diameter("area"), 6).alias("diameter_calc"), F.round(vx, 6).alias("axis_x"), F.round(vy, 6).alias("axis_y"))


def hu_log(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).select("cell_key", F.round(S.hu_log("hu_0"), 6).alias("hu_log"))


def patch_assign(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).where("pos_x_norm is not null and pos_y_norm is not null")
    return c.select("cell_key", S.patch_of("pos_y_norm").alias("patch_y"), S.patch_of("pos_x_norm").alias("patch_x"))


def patch_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).where("pos_x_norm is not null and pos_y_norm is not null")
    return c.groupBy("slide_id", "round_no", (S.patch_of("pos_y_norm", 4) * 4 + S.patch_of("pos_x_norm", 4)).alias("patch")).agg(F.count("*").alias("cells"))


def area_filter(spark: SparkSession, sf: str) -> DataFrame:
    return masks.area_between(cells(spark, sf), 150.0, 600.0).groupBy("slide_id", "round_no").agg(F.count("*").alias("cells"), F.round(F.sum("area"), 4).alias("total_area"))


def orientation_difference(spark: SparkSession, sf: str) -> DataFrame:
    f, m = sides(spark, sf)
    j = matching.match_report(linked(spark, sf).select("match_id", "id1", "id2"), f, m, "cell_key", ["orientation", "eccentricity"])
    return j.select("match_id", F.round(S.axis_difference_deg("orientation_1", "orientation_2"), 6).alias("orientation_diff_deg"), "eccentricity_1", "eccentricity_2")


def hard_constraints(spark: SparkSession, sf: str) -> DataFrame:
    f, m = sides(spark, sf)
    j = matching.match_report(linked(spark, sf).select("match_id", "id1", "id2"), f, m, "cell_key", ["area", "aspect_ratio", "orientation", "eccentricity"])
    return matching.hard_constraints(j).select("match_id")


def level0_centroids(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "slides")
    meta = s.select("slide_id", F.lit("mask_pixel").alias("coordinate_space"), (F.pmod(F.col("level0_width"), F.lit(97)) * 1.0).alias("origin_x"), (F.pmod(F.col("level0_height"), F.lit(89)) * 1.0).alias("origin_y"), (F.col("level0_width") / F.col("image_width")).alias("downsample"))
    c = tables.centroids_to_level0(cells(spark, sf).select("cell_key", "slide_id", "centroid_x", "centroid_y"), meta, BY)
    even = lambda n: (F.floor(F.col(n) * 10_000 + 0.5) / 10_000).alias(n)
    return c.select("cell_key", even("level0_x"), even("level0_y"))


def metadata_fields(spark: SparkSession, sf: str) -> DataFrame:
    m = tables.normalise_metadata(table(spark, sf, "wsi_metadata").where("record_id is not null"))
    m = m.groupBy("record_id").agg(*[F.max(c).alias(c) for c in ("coordinate_space", "origin_x", "downsample", "mpp_x", "mpp_reliable", "channel", "segmentation_method", "image_width")])
    return m.select("record_id", "coordinate_space", F.round("origin_x", 4).alias("origin_x"), F.round("downsample", 6).alias("downsample"), F.round("mpp_x", 6).alias("mpp_x"), "mpp_reliable", "channel", "segmentation_method", "image_width")


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table under other names and as text, brought to the usual schema."""
    raw = table(spark, sf, "cell_features").where("cell_key is not null").groupBy(F.col("cell_key").alias("label")).agg(F.max(F.col("centroid_x").cast("string")).alias("x"), F.max(F.col("centroid_y").cast("string")).alias("y"), F.max(F.col("area").cast("string")).alias("area"))
    t = tables.normalise_features(raw, 1000.0, 800.0, min_area=50)
    return t.select("cell_id", r("centroid_x"), r("centroid_y"), r("area"), r("perimeter"), r("pos_x_norm"), r("hu_3"))


def robust_scale(spark: SparkSession, sf: str) -> DataFrame:
    s = stats.robust_scales(cells(spark, sf), BY, SHAPE)
    return s.select("slide_id", *[r(f"scale_{c}") for c in SHAPE])


def robust_standardise(spark: SparkSession, sf: str) -> DataFrame:
    z = stats.robust_standardise(cells(spark, sf).select("cell_key", "slide_id", "area", "eccentricity"), BY, ["area", "eccentricity"])
    return z.select("cell_key", r("area"), r("eccentricity"))


def z_scores(spark: SparkSession, sf: str) -> DataFrame:
    z = stats.z_scores(cells(spark, sf).select("cell_key", "slide_id", "area", "solidity"), BY, ["area", "solidity"])
    return z.select("cell_key", r("area"), r("solidity"))


def robust_extent(spark: SparkSession, sf: str) -> DataFrame:
    e = stats.robust_extents(cells(spark, sf), ["slide_id", "round_no"], ["centroid_x", "centroid_y"])
    return e.select("slide_id", "round_no", r("centre_centroid_x"), r("extent_centroid_x"), r("centre_centroid_y"), r("extent_centroid_y"))


def match_quality(spark: SparkSession, sf: str) -> DataFrame:
    q = matching.match_quality(linked(spark, sf), BY)
    return q.select("slide_id", "n_matches", r("min_distance"), r("max_distance"), r("mean_distance"), r("std_distance"), r("mean_confidence"))


def keep_robust(spark: SparkSession, sf: str) -> DataFrame:
    return stats.keep_robust(linked(spark, sf), BY, "distance", ["match_id"], floor=0.05).select("match_id")


def distinct_labels(spark: SparkSession, sf: str) -> DataFrame:
    g = cells(spark, sf, placed=False).groupBy("slide_id", "round_no").agg(F.count_distinct("cell_id").alias("labels"), F.max("cell_id").alias("largest"))
    return g.select("slide_id", "round_no", "labels", S.label_dtype("largest").alias("dtype"))


def channel_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The channel that 'auto' means among all names in the metadata, numbered by first record."""
    c = table(spark, sf, "wsi_metadata").where("channel is not null").groupBy(F.col("channel").alias("name")).agg(F.min("record_id").alias("index"), F.count("*").alias("records"))
    return tables.match_channel(c, "auto").select("index", "name", "records")


def channel_xml(spark: SparkSession, sf: str) -> DataFrame:
    """Names and colours read back from XML descriptions made of each record."""
    m = table(spark, sf, "wsi_metadata").where("record_id is not null").groupBy(F.col("record_id").alias("index")).agg(F.max("channel").alias("channel"), F.max("round_no").alias("k"))
    xml = F.concat(F.lit("<Image><Name>"), F.coalesce("channel", F.lit("")), F.lit("</Name><Color>"), (F.col("k") * 100).cast("string"), F.lit(", 300, "), F.pmod("index", F.lit(256)).cast("string"), F.lit("</Color></Image>"))
    p = tables.parse_channels(m.withColumn("description", xml))
    return p.select("index", "name", F.col("color")[0].alias("red"), F.col("color")[1].alias("green"), F.col("color")[2].alias("blue"))


def level_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of equal size in a pyramid made of each slide: every second level repeats the one before."""
    s = table(spark, sf, "slides").where("slide_id is not null").select("slide_id", "level0_width", "level0_height", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("level"))
    half = F.pow(F.lit(2.0), F.floor(F.col("level") / 2))
    lv = s.select("slide_id", "level", F.floor(F.col("level0_width") / half).alias("width"), F.floor(F.col("level0_height") / half).alias("height"))
    return tables.level_groups(lv, BY)


QUERIES = {f.__name__: f for f in (shape_features, hu_log, patch_assign, patch_counts, area_filter, orientation_difference, hard_constraints, level0_centroids, metadata_fields, feature_table, robust_scale, robust_standardise, z_scores, robust_extent, match_quality, keep_robust, distinct_labels, channel_choice, channel_xml, level_groups)}

_RATIO = "coalesce(CASE WHEN abs({d}) > 1e-6 THEN {n} / {d} END, 1)"
_DIFF = "degrees(least(((a.orientation - b.orientation) % pi() + pi()) % pi(), pi() - ((a.orientation - b.orientation) % pi() + pi()) % pi()))"
_SCALE = lambda c: f"greatest(1.4826 * coalesce(median(abs({c} - med_{c})), 0), 0.001)"

SQL = {
    "shape_features": f"""WITH {CELLS} SELECT cell_key, round(CASE WHEN perimeter = 0 THEN 0 ELSE 4 * pi() * area / perimeter ** 2 END, 6) AS round_calc,
  round({_RATIO.format(n='major_axis_length', d='minor_axis_length')}, 6) AS aspect_calc,
  round(greatest(0, least(1, 1 - {_RATIO.format(n='minor_axis_length', d='major_axis_length')})), 6) AS elongation_calc,
  round(sqrt(4 * area / pi()), 6) AS diameter_calc, round(cos(orientation), 6) AS axis_x, round(sin(orientation), 6) AS axis_y FROM placed""",
    "hu_log": f"WITH {CELLS} SELECT cell_key, round(-sign(hu_0) * log10(abs(hu_0) + 1e-30), 6) AS hu_log FROM placed",
    "patch_assign": f"""WITH {CELLS} SELECT cell_key, CAST(least(2, floor(least(1, greatest(0, pos_y_norm)) * 3)) AS INTEGER) AS patch_y,
  CAST(least(2, floor(least(1, greatest(0, pos_x_norm)) * 3)) AS INTEGER) AS patch_x FROM placed WHERE pos_x_norm IS NOT NULL AND pos_y_norm IS NOT NULL""",
    "patch_counts": f"""WITH {CELLS} SELECT slide_id, round_no, CAST(least(3, floor(least(1, greatest(0, pos_y_norm)) * 4)) * 4 + least(3, floor(least(1, greatest(0, pos_x_norm)) * 4)) AS INTEGER) AS patch,
  count(*) AS cells FROM placed WHERE pos_x_norm IS NOT NULL AND pos_y_norm IS NOT NULL GROUP BY ALL""",
    "area_filter": f"WITH {CELLS} SELECT slide_id, round_no, count(*) AS cells, round(sum(area), 4) AS total_area FROM placed WHERE area BETWEEN 150 AND 600 GROUP BY ALL",
    "orientation_difference": f"""WITH {LINKED} SELECT match_id, round({_DIFF}, 6) AS orientation_diff_deg, a.eccentricity AS eccentricity_1, b.eccentricity AS eccentricity_2
  FROM linked JOIN f a ON a.cell_key = id1 JOIN m b ON b.cell_key = id2""",
    "hard_constraints": f"""WITH {LINKED} SELECT match_id FROM linked JOIN f a ON a.cell_key = id1 JOIN m b ON b.cell_key = id2
  WHERE greatest(a.area, b.area, 1e-6) / greatest(least(a.area, b.area), 1e-6) <= 2.5 AND a.area IS NOT NULL AND b.area IS NOT NULL
    AND greatest(a.aspect_ratio, b.aspect_ratio, 1e-6) / greatest(least(a.aspect_ratio, b.aspect_ratio), 1e-6) <= 2
    AND (a.eccentricity < 0.35 OR b.eccentricity < 0.35 OR {_DIFF} <= 45)""",
    "level0_centroids": f"""WITH {CELLS} SELECT cell_key, floor((level0_width % 97 + centroid_x * (level0_width / image_width)) * 10000 + 0.5) / 10000 AS level0_x,
  floor((level0_height % 89 + centroid_y * (level0_width / image_width)) * 10000 + 0.5) / 10000 AS level0_y FROM placed LEFT JOIN slides USING (slide_id)""",
    "metadata_fields": """WITH n AS (SELECT record_id, lower(trim(coordinate_space)) AS coordinate_space, coalesce(try_cast(trim(origin_x) AS DOUBLE), 0) AS o, coalesce(try_cast(trim(downsample) AS DOUBLE), 1) AS d,
    try_cast(trim(mpp_x) AS DOUBLE) AS p, coalesce(lower(trim(mpp_reliable)) IN ('1', 'true', 'yes', 'y', 'reliable'), false) AND coalesce(isfinite(try_cast(trim(mpp_x) AS DOUBLE)) AND isfinite(try_cast(trim(mpp_y) AS DOUBLE)), false) AS mpp_reliable, coalesce(channel, '') AS channel,
    coalesce(segmentation_method, 'unknown') AS segmentation_method, image_width FROM wsi_metadata WHERE record_id IS NOT NULL)
SELECT record_id, max(coordinate_space) AS coordinate_space, round(max(CASE WHEN isfinite(o) THEN o ELSE 0 END), 4) AS origin_x, round(max(CASE WHEN isfinite(d) THEN d ELSE 1 END), 6) AS downsample,
  round(max(CASE WHEN isfinite(p) THEN p END), 6) AS mpp_x, bool_or(mpp_reliable) AS mpp_reliable, max(channel) AS channel, max(segmentation_method) AS segmentation_method, max(image_width) AS image_width FROM n GROUP BY record_id""",
    "feature_table": """WITH c AS (SELECT cell_key AS cell_id, any_value(centroid_x) AS centroid_x, any_value(centroid_y) AS centroid_y, greatest(any_value(area), 1) AS area FROM cell_features WHERE cell_key IS NOT NULL GROUP BY cell_key)
SELECT cell_id, round(centroid_x, 6) AS centroid_x, round(centroid_y, 6) AS centroid_y, round(area, 6) AS area, round(pi() * sqrt(4 * area / pi()), 6) AS perimeter, round(centroid_x / 1000, 6) AS pos_x_norm, CAST(0 AS DOUBLE) AS hu_3
FROM c WHERE isfinite(centroid_x) AND isfinite(centroid_y) AND isfinite(area) AND area >= 50""",
    "robust_scale": f"""WITH {CELLS}, med AS (SELECT slide_id, {', '.join(f'median({c}) AS med_{c}' for c in SHAPE)} FROM placed GROUP BY slide_id)
SELECT slide_id, {', '.join(f'round({_SCALE(c)}, 6) AS scale_{c}' for c in SHAPE)} FROM placed JOIN med USING (slide_id) GROUP BY slide_id""",
    "robust_standardise": f"""WITH {CELLS}, med AS (SELECT slide_id, median(area) AS ma, median(eccentricity) AS me FROM placed GROUP BY slide_id),
s AS (SELECT slide_id, any_value(ma) AS ma, any_value(me) AS me, greatest(1.4826 * median(abs(area - ma)), 1e-6) AS sa, greatest(1.4826 * median(abs(eccentricity - me)), 1e-6) AS se FROM placed JOIN med USING (slide_id) GROUP BY slide_id)
SELECT cell_key, round(coalesce((area - ma) / sa, 0), 6) AS area, round(coalesce((eccentricity - me) / se, 0), 6) AS eccentricity FROM placed JOIN s USING (slide_id)""",
    "z_scores": f"""WITH {CELLS}, s AS (SELECT slide_id, avg(area) AS aa, avg(solidity) AS sa, coalesce(nullif(stddev_pop(area), 0), 1) AS ad, coalesce(nullif(stddev_pop(solidity), 0), 1) AS sd FROM placed GROUP BY slide_id)
SELECT cell_key, round((area - aa) / ad, 6) AS area, round((solidity - sa) / sd, 6) AS solidity FROM placed JOIN s USING (slide_id)""",
    "robust_extent": f"""WITH {CELLS} SELECT slide_id, round_no, round(median(centroid_x), 6) AS centre_centroid_x, round(greatest(quantile_cont(centroid_x, 0.99) - quantile_cont(centroid_x, 0.01), 1), 6) AS extent_centroid_x,
  round(median(centroid_y), 6) AS centre_centroid_y, round(greatest(quantile_cont(centroid_y, 0.99) - quantile_cont(centroid_y, 0.01), 1), 6) AS extent_centroid_y FROM placed GROUP BY ALL""",
    "match_quality": f"""WITH {LINKED}, t AS (SELECT slide_id, max(distance) AS top FROM linked GROUP BY slide_id)
SELECT slide_id, count(*) AS n_matches, round(min(distance), 6) AS min_distance, round(max(distance), 6) AS max_distance, round(avg(distance), 6) AS mean_distance, round(stddev_samp(distance), 6) AS std_distance,
  round(avg(CASE WHEN top > 0 THEN 1 - distance / (top + 1) ELSE 1 END), 6) AS mean_confidence FROM linked JOIN t USING (slide_id) GROUP BY slide_id""",
    "keep_robust": f"""WITH {LINKED}, a AS (SELECT slide_id, median(distance) AS med FROM linked GROUP BY slide_id), b AS (SELECT slide_id, greatest(1.4826 * median(abs(distance - med)), 0.05) AS s FROM linked JOIN a USING (slide_id) GROUP BY slide_id),
k AS (SELECT *, distance <= greatest(med + 3 * s, 0) AS ok, row_number() OVER (PARTITION BY slide_id ORDER BY distance, match_id) AS rn FROM linked JOIN a USING (slide_id) JOIN b USING (slide_id)),
n AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY slide_id) AS kept FROM k) SELECT match_id FROM n WHERE CASE WHEN kept >= 3 THEN ok ELSE rn <= 3 END""",
    "distinct_labels": f"WITH {CELLS} SELECT slide_id, round_no, count(DISTINCT cell_id) AS labels, CASE WHEN max(cell_id) <= 65535 THEN 'uint16' ELSE 'uint32' END AS dtype FROM cells GROUP BY ALL",
    "channel_choice": """WITH c AS (SELECT channel AS name, min(record_id) AS index, count(*) AS records FROM wsi_metadata WHERE channel IS NOT NULL GROUP BY channel)
SELECT index, name, records FROM c WHERE contains(lower(trim(name)), 'dapi') ORDER BY lower(trim(name)) <> 'dapi', index LIMIT 1""",
    "channel_xml": """SELECT record_id AS index, coalesce(nullif(max(channel), ''), 'Channel ' || record_id) AS name, CAST(least(255, max(round_no) * 100) AS INTEGER) AS red, CAST(255 AS INTEGER) AS green, CAST(record_id % 256 AS INTEGER) AS blue
FROM wsi_metadata WHERE record_id IS NOT NULL GROUP BY record_id""",
    "level_groups": """SELECT slide_id, CAST(level AS INTEGER) AS level, CAST(floor(level0_width / 2.0 ** (level // 2)) AS BIGINT) AS width, CAST(floor(level0_height / 2.0 ** (level // 2)) AS BIGINT) AS height, CAST(level // 2 AS INTEGER) AS level_group
FROM slides, (SELECT unnest(range(8)) AS level) WHERE slide_id IS NOT NULL""",
}
