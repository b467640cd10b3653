"""Queries of the problems 'points near other points' and 'quantities in different units'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.operators.spatial import EARTH_M, radius_join, region_of
from cytoloom.operators.units import read_metadata_quantities
from cytoloom.runtime import latest

SAME_CELL_PX = 7.125


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of one slide and round that lie so near that they may be one."""
    cells = latest(table(spark, sf, "cell_features"), ["cell_key"], ["ingested_at"], ["slide_id", "round_no", "centroid_x", "centroid_y"])
    near = radius_join(cells, ["slide_id", "round_no"], ["centroid_x", "centroid_y"], "cell_key", SAME_CELL_PX)
    return near.select(F.col("id_1").alias("cell_key_1"), F.col("id_2").alias("cell_key_2"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """mpp_x, downsample and origin_x of each record in one unit each."""
    q = read_metadata_quantities(table(spark, sf, "wsi_metadata"), table(spark, sf, "scanner_sources"))
    scale = F.when(F.col("field_name") == "mpp_x", 10_000.0).otherwise(1.0)
    return q.select("record_id", "field_name", F.round(F.col("value") * scale).try_cast("long").alias("amount")).where("amount is not null")


def cells_on_sphere(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of cells of one slide and round at most 4 km apart, were a pixel a hundredth of a degree and every other slide
    laid across the far meridian."""
    cells = latest(table(spark, sf, "cell_features"), ["cell_key"], ["ingested_at"], ["slide_id", "round_no", "centroid_x", "centroid_y"])
    lon = F.col("centroid_x") / 100 + F.when(F.col("round_no") == 1, F.lit(0)).otherwise(F.lit(170))
    lon = F.when(lon > 180, lon - 360).otherwise(lon)
    cells = cells.select("cell_key", "slide_id", "round_no", lon.alias("lon"), (F.col("centroid_y") / 100).alias("lat")).where("abs(lat) <= 90 and abs(lon) <= 180")
    near = radius_join(cells, ["slide_id", "round_no"], ["lon", "lat"], "cell_key", 4000.0, metric="haversine")
    return near.select(F.col("id_1").alias("cell_key_1"), F.col("id_2").alias("cell_key_2"), F.round("distance", 3).alias("metres"))


def cells_in_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """The tile or tiles of its slide and round whose core holds each cell."""
    cells = latest(table(spark, sf, "cell_features"), ["cell_key"], ["ingested_at"], ["slide_id", "round_no", "centroid_x", "centroid_y"])
    s = table(spark, sf, "slides").select("slide_id", "image_width", "image_height", "level0_width", "level0_height")
    at = cells.join(s, "slide_id").select("cell_key", "slide_id", "round_no", (F.col("centroid_x") * F.col("level0_width") / F.col("image_width")).alias("x"), (F.col("centroid_y") * F.col("level0_height") / F.col("image_height")).alias("y"))
    cores = ["core_y0", "core_y1", "core_x0", "core_x1"]
    t = latest(table(spark, sf, "tiles"), ["tile_id"], ["ingested_at"], ["slide_id", "round_no", *cores])
    t = t.select("slide_id", "round_no", F.col("tile_id").alias("region_id"), *[F.col(c).alias(c.split("_")[1][0] + c[-1]) for c in cores])
    return region_of(at, t, "x", "y", 256.0, ["slide_id", "round_no"]).select("cell_key", F.col("region_id").alias("tile_id"))


QUERIES = {"p4_found": p4_found, "p5_found": p5_found, "cells_on_sphere": cells_on_sphere, "cells_in_tiles": cells_in_tiles}

CELLS = """(SELECT cell_key, max_by(slide_id, ingested_at) AS slide_id, max_by(round_no, ingested_at) AS round_no,
  max_by(centroid_x, ingested_at) AS centroid_x, max_by(centroid_y, ingested_at) AS centroid_y
  FROM cell_features GROUP BY cell_key)"""

SQL = {
    "p4_found": f"""
WITH c AS (SELECT *, floor(centroid_x / 7.125) AS gx, floor(centroid_y / 7.125) AS gy FROM {CELLS}
           WHERE NOT isnan(centroid_x) AND NOT isnan(centroid_y)),
     o AS (SELECT unnest([-1, 0, 1]) AS d), w AS (SELECT c.*, gx + a.d AS nx, gy + b.d AS ny FROM c, o a, o b)
SELECT a.cell_key AS cell_key_1, b.cell_key AS cell_key_2
FROM w a JOIN c b ON a.slide_id = b.slide_id AND a.round_no = b.round_no AND a.nx = b.gx AND a.ny = b.gy
WHERE a.cell_key < b.cell_key
  AND sqrt((a.centroid_x - b.centroid_x) ** 2 + (a.centroid_y - b.centroid_y) ** 2) <= 7.125""",
    "p5_found": r"""
WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) AS rn FROM wsi_metadata) WHERE rn = 1),
t AS (SELECT record_id, replace(replace(lower(trim(mpp_x)), 'µ', 'u'), 'μ', 'u') AS m, replace(replace(lower(trim(origin_x)), 'µ', 'u'), 'μ', 'u') AS o,
        lower(trim(downsample)) AS d, coalesce(lower(notes), '') AS n, lower(trim(coordinate_space)) AS sp, s.mpp_unit, s.downsample_style, s.origin_unit
      FROM r LEFT JOIN scanner_sources s USING (scanner_source)),
x AS (SELECT *, regexp_extract(m, '^([-+]?[0-9][0-9.,]*(e[-+]?[0-9]+)?)', 1) AS mn, regexp_extract(o, '^([-+]?[0-9][0-9.,]*(e[-+]?[0-9]+)?)', 1) AS onum,
        regexp_extract(d, '([-+]?[0-9][0-9.,]*)[^0-9]*$', 1) AS dn,
        coalesce(list_filter(string_split(n, ';'), lambda s: s LIKE '%origin%')[1], '') AS onote,
        coalesce(list_filter(string_split(n, ';'), lambda s: regexp_matches(s, 'mpp|pixel size|pixelgr|taille de pixel|resolution'))[1], '') AS mnote FROM t),
y AS (SELECT *, trim(substr(m, length(mn) + 1)) AS mu, trim(substr(o, length(onum) + 1)) AS ou,
        try_cast(CASE WHEN mn LIKE '%.%' THEN replace(mn, ',', '') ELSE replace(mn, ',', '.') END AS DOUBLE) AS mv,
        try_cast(CASE WHEN onum LIKE '%.%' THEN replace(onum, ',', '') ELSE replace(onum, ',', '.') END AS DOUBLE) AS ov,
        try_cast(CASE WHEN dn LIKE '%.%' THEN replace(dn, ',', '') ELSE replace(dn, ',', '.') END AS DOUBLE) AS dv FROM x),
z AS (SELECT *,
  CASE WHEN mu <> '' THEN CASE WHEN mu IN ('um','micron','microns','um/px','um/pixel','mpp','micrometre','micrometres') THEN 'um'
      WHEN mu IN ('nm','nanometres','nanometre','nm/px','nm/pixel') THEN 'nm' WHEN mu IN ('mm','millimetre','millimetres','mm/px','mm/pixel') THEN 'mm'
      WHEN mu IN ('dpi','ppi','dots per inch') THEN 'dpi' WHEN mu IN ('px/mm','pix/mm','pixels per mm') THEN 'px/mm' END
    WHEN regexp_matches(mnote, 'dots per inch|dpi') THEN 'dpi' WHEN regexp_matches(mnote, 'px/mm|pixels per mm') THEN 'px/mm'
    WHEN regexp_matches(mnote, 'nanomet|[ei]n nm') THEN 'nm' WHEN regexp_matches(mnote, 'mi[ck]romet|in um') THEN 'um' WHEN regexp_matches(mnote, 'millimet|in mm') THEN 'mm'
    ELSE mpp_unit END AS munit,
  CASE WHEN ou <> '' THEN CASE WHEN ou IN ('px','pixel','pixels') THEN 'px' WHEN ou IN ('downsampled px','mask px','preview px') THEN 'dpx'
      WHEN ou IN ('um','micron','microns') THEN 'um' WHEN ou IN ('mm','millimetre') THEN 'mm' END
    WHEN onote LIKE '%level-0%' THEN 'px' WHEN regexp_matches(onote, 'downsampled|preview') THEN 'dpx'
    WHEN regexp_matches(onote, 'micromet|in um') THEN 'um' WHEN regexp_matches(onote, 'millimet|in mm') THEN 'mm'
    WHEN sp IN ('physical_um','stage_um') THEN 'um' WHEN sp IN ('physical_mm','stage_mm') THEN 'mm' ELSE origin_unit END AS ounit,
  CASE WHEN regexp_matches(d, '^1 ?[:/]') OR d LIKE '%x%' THEN 'factor' WHEN d LIKE '%\%' ESCAPE '\' THEN 'percent' WHEN d LIKE 'l%' THEN 'level' ELSE downsample_style END AS dunit,
  CASE WHEN d LIKE 'level-%' THEN abs(dv) ELSE dv END AS dval FROM y),
c AS (SELECT *,
  CASE WHEN mv > 0 THEN CASE munit WHEN 'um' THEN mv WHEN 'nm' THEN mv / 1000 WHEN 'mm' THEN mv * 1000 WHEN 'dpi' THEN 25400 / mv WHEN 'px/mm' THEN 1000 / mv END END AS mpp,
  CASE WHEN dunit = 'level' THEN CASE WHEN dval >= 0 THEN 2 ** dval END WHEN dval > 0 THEN CASE dunit WHEN 'factor' THEN dval WHEN 'fraction' THEN 1 / dval WHEN 'percent' THEN 100 / dval END END AS ds FROM z),
f AS (SELECT *, CASE ounit WHEN 'px' THEN ov WHEN 'dpx' THEN ov * ds WHEN 'um' THEN ov / mpp WHEN 'mm' THEN ov * 1000 / mpp END AS org FROM c)
SELECT record_id, 'mpp_x' AS field_name, CAST(round(mpp * 10000) AS BIGINT) AS amount FROM f WHERE mpp IS NOT NULL
UNION ALL SELECT record_id, 'downsample', CAST(round(ds) AS BIGINT) FROM f WHERE ds IS NOT NULL
UNION ALL SELECT record_id, 'origin_x', CAST(round(org) AS BIGINT) FROM f WHERE org IS NOT NULL""",
    "cells_on_sphere": f"""
WITH a AS (SELECT cell_key, slide_id, round_no, centroid_x / 100 + CASE WHEN round_no = 1 THEN 0 ELSE 170 END AS lon, centroid_y / 100 AS lat FROM {CELLS} WHERE NOT isnan(centroid_x) AND NOT isnan(centroid_y)),
c AS (SELECT cell_key, slide_id, round_no, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon, lat, floor(lat / 0.04) AS g FROM a WHERE abs(lat) <= 90 AND lon <= 540),
u AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS ux, cos(radians(lat)) * sin(radians(lon)) AS uy, sin(radians(lat)) AS uz FROM c WHERE abs(lon) <= 180),
w AS (SELECT u.*, g + d AS n FROM u, (SELECT unnest([-1, 0, 1]) AS d)),
p AS (SELECT a.cell_key AS cell_key_1, b.cell_key AS cell_key_2, 2 * {EARTH_M} * atan2(sqrt((a.ux - b.ux) ** 2 + (a.uy - b.uy) ** 2 + (a.uz - b.uz) ** 2), sqrt((a.ux + b.ux) ** 2 + (a.uy + b.uy) ** 2 + (a.uz + b.uz) ** 2)) AS m
  FROM w a JOIN u b ON a.slide_id = b.slide_id AND a.round_no = b.round_no AND a.n = b.g WHERE a.cell_key < b.cell_key)
SELECT cell_key_1, cell_key_2, round(m, 3) AS metres FROM p WHERE m <= 4000""",
    "cells_in_tiles": f"""
WITH c AS (SELECT cell_key, slide_id, round_no, centroid_x * level0_width / image_width AS x, centroid_y * level0_height / image_height AS y FROM {CELLS} JOIN slides USING (slide_id)),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY ingested_at DESC) AS rn FROM tiles) WHERE rn = 1 AND core_x1 > core_x0 AND core_y1 > core_y0)
SELECT cell_key, tile_id FROM c LEFT JOIN t ON t.slide_id = c.slide_id AND t.round_no = c.round_no AND x >= core_x0 AND x < core_x1 AND y >= core_y0 AND y < core_y1 AND NOT isnan(x) AND NOT isnan(y)""",
}
