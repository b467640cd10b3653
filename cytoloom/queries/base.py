"""What the queries read: cells, matches with their cells' places, and masks derived from the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.functions.scalar import clean
from cytoloom.runtime import latest

BY = ["slide_id"]
FEATURES = ["area", "perimeter", "eccentricity", "solidity", "major_axis_length", "minor_axis_length", "orientation", "centroid_x", "centroid_y", "pos_x_norm", "pos_y_norm", "hu_0", "roundness", "aspect_ratio"]
SHAPE = ["area", "eccentricity", "solidity", "hu_0"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cells(spark: SparkSession, sf: str, placed: bool = True) -> DataFrame:
    """Every cell once, its features as doubles with NaN as null; with ``placed`` only those with a centroid."""
    c = latest(table(spark, sf, "cell_features"), ["cell_key"], ["ingested_at"], ["slide_id", "round_no", "cell_id", *FEATURES])
    c = c.select("cell_key", "slide_id", "round_no", "cell_id", *[clean(F.col(f).cast("double")).alias(f) for f in FEATURES])
    return c.where("centroid_x is not null and centroid_y is not null") if placed else c


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = cells(spark, sf)
    return c.where("round_no = 1"), c.where("round_no = 2")


def linked(spark: SparkSession, sf: str) -> DataFrame:
    """The standing candidate matches with a usable distance, and the places of their cells: slide_id, match_id, id1, id2,
    distance, x1, y1, x2, y2, dx, dy."""
    m = latest(table(spark, sf, "cell_matches"), ["slide_id", "idx1", "idx2"], ["ingested_at", "match_id"], ["match_id", "cell_id_1", "cell_id_2", "distance"])
    m = m.where("distance >= 0 and not isnan(distance) and distance < double('Infinity')")
    c = cells(spark, sf).select("slide_id", "round_no", "cell_id", "cell_key", "centroid_x", "centroid_y")
    side = lambda n: c.where(F.col("round_no") == n).select("slide_id", F.col("cell_id").alias(f"cell_id_{n}"), F.col("cell_key").alias(f"id{n}"), F.col("centroid_x").alias(f"x{n}"), F.col("centroid_y").alias(f"y{n}"))
    j = m.join(side(1), ["slide_id", "cell_id_1"]).join(side(2), ["slide_id", "cell_id_2"])
    return j.select("slide_id", "match_id", "id1", "id2", "distance", "x1", "y1", "x2", "y2", (F.col("x1") - F.col("x2")).alias("dx"), (F.col("y1") - F.col("y2")).alias("dy"))


def mask(spark: SparkSession, sf: str) -> DataFrame:
    """(image, y, x, label): a rectangle per part, 500 to an image of 1,000 x 800, far enough apart not to touch."""
    k, w, h = F.pmod("p_partkey", F.lit(500)), 4 + F.pmod("p_size", F.lit(12)), 4 + F.pmod("p_partkey", F.lit(9))
    x0, y0 = F.pmod(k, F.lit(25)) * 40 + 5, F.floor(k / 25) * 40 + 5
    p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 500).cast("int").alias("image"), (k + 1).cast("int").alias("label"), x0.alias("x0"), y0.alias("y0"), w.alias("w"), h.alias("h"))
    # pixels are made in as many tasks as shuffles have, not in the few that read so small a file
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image")
    p = p.select("image", "label", "x0", "w", F.explode(F.sequence(F.col("y0"), F.col("y0") + F.col("h") - 1)).alias("y"))
    p = p.select("image", F.col("y").cast("int").alias("y"), F.explode(F.sequence(F.col("x0"), F.col("x0") + F.col("w") - 1)).alias("x"), "label")
    return p.withColumn("x", F.col("x").cast("int"))


def r(c: str, n: int = 6):
    return F.round(F.col(c), n).alias(c)


#: The same tables in SQL.
_COLS = ", ".join(f"CASE WHEN isfinite({f}) THEN CAST({f} AS DOUBLE) END AS {f}" for f in FEATURES)
CELLS = f"""cells AS (SELECT cell_key, slide_id, round_no, cell_id, {_COLS}
  FROM (SELECT *, row_number() OVER (PARTITION BY cell_key ORDER BY ingested_at DESC) AS rn FROM cell_features) WHERE rn = 1),
placed AS (SELECT * FROM cells WHERE centroid_x IS NOT NULL AND centroid_y IS NOT NULL),
f AS (SELECT * FROM placed WHERE round_no = 1), m AS (SELECT * FROM placed WHERE round_no = 2)"""
LINKED = f"""{CELLS},
linked AS (SELECT k.slide_id, k.match_id, f.cell_key AS id1, m.cell_key AS id2, k.distance, f.centroid_x AS x1, f.centroid_y AS y1, m.centroid_x AS x2, m.centroid_y AS y2,
    f.centroid_x - m.centroid_x AS dx, f.centroid_y - m.centroid_y AS dy
  FROM (SELECT *, row_number() OVER (PARTITION BY slide_id, idx1, idx2 ORDER BY ingested_at DESC, match_id DESC) AS rn FROM cell_matches) k
  JOIN f ON f.slide_id = k.slide_id AND f.cell_id = k.cell_id_1 JOIN m ON m.slide_id = k.slide_id AND m.cell_id = k.cell_id_2
  WHERE k.rn = 1 AND k.distance >= 0 AND isfinite(k.distance))"""
MASK = """parts AS (SELECT CAST(p_partkey // 500 AS INTEGER) AS image, CAST(p_partkey % 500 + 1 AS INTEGER) AS label, CAST((p_partkey % 500) % 25 * 40 + 5 AS INTEGER) AS x0,
    CAST((p_partkey % 500) // 25 * 40 + 5 AS INTEGER) AS y0, CAST(4 + p_size % 12 AS INTEGER) AS w, CAST(4 + p_partkey % 9 AS INTEGER) AS h FROM part),
mask AS (SELECT image, label, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM (SELECT image, label, y, unnest(range(x0, x0 + w)) AS x FROM (SELECT *, unnest(range(y0, y0 + h)) AS y FROM parts)))"""
