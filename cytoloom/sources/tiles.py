"""Dense image tiles (by, level, channel, y0, x0, h, w, data): written partitioned by level and channel, read by region."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.operators.neighbors import _key_columns
from cytoloom.operators.raster import affine_warp
from cytoloom.runtime import column, cut, free, map_groups

DTYPE = "float32"


def dense_tiles(pixels: DataFrame, by: Sequence[str], value: str, tile: int = 256) -> DataFrame:
    """(by, y0, x0, h, w, data): every tile that holds a pixel, as little-endian float32 in row order."""
    p = pixels.select(*by, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(value).cast("double").alias("v"))
    p = p.withColumns({"y0": F.floor(F.col("y") / tile).cast("int") * tile, "x0": F.floor(F.col("x") / tile).cast("int") * tile})

    def pack(t: pa.Table) -> pa.Table:
        y0, x0 = t.column("y0")[0].as_py(), t.column("x0")[0].as_py()
        img = np.zeros((tile, tile), DTYPE)
        img[column(t, "y") - y0, column(t, "x") - x0] = column(t, "v")
        return pa.table({**{g: t.column(g).slice(0, 1) for g in by}, "y0": t.column("y0").slice(0, 1), "x0": t.column("x0").slice(0, 1), "h": pa.array([tile], pa.int32()), "w": pa.array([tile], pa.int32()), "data": [img.tobytes()]})

    return map_groups(p, [*by, "y0", "x0"], pack, _key_columns(p, by) + "y0 int, x0 int, h int, w int, data binary")


def write_tiles(tiles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Partitioned by level and channel, which must be columns; clustered by place, so regions prune row groups. Tiles are
    range-sorted, so that a channel of any size is many files."""
    tiles.repartitionByRange("level", "channel", "y0", "x0").sortWithinPartitions("level", "channel", "y0", "x0").write.mode(mode).partitionBy("level", "channel").parquet(path)


def write_registered(source: DataFrame, models: DataFrame, sizes: DataFrame, by: Sequence[str], path: str, order: int = 1, value: str = "value", tile: int = 1024, parts: int = 10) -> DataFrame:
    """The channels of a source (by, channel, y, x, value), moved by their group's model into its frame, as dense tiles of
    level 0 under ``path``/tiles. Tiles are written part by part; after each a row (part, parts, tiles, tiles_done) goes to
    ``path``/progress, which is returned. A call that finds such rows goes on behind them. Blank tiles are not written."""
    spark = source.sparkSession
    channels = source.select(*by, "channel").distinct()
    per_channel = [*by, "channel"]
    models, sizes = (t.join(channels, list(by)) if by else t.crossJoin(channels) for t in (models, sizes))  # one row per channel
    try:
        rows = spark.read.json(f"{path}/progress").orderBy("part").collect()  # at most ``parts``
    except AnalysisException:
        rows = []
    done = rows[-1].tiles_done if rows else 0
    for i in range(len(rows), parts):
        warped = affine_warp(source, models, sizes, per_channel, order, value, tile, (i, parts))
        tiles = cut(dense_tiles(warped, per_channel, value, tile).withColumn("level", F.lit(0)))
        n = tiles.count()
        write_tiles(tiles, f"{path}/tiles", "append")
        free(tiles)
        done += n
        spark.createDataFrame([(i, parts, n, done)], "part int, parts int, tiles long, tiles_done long").coalesce(1).write.mode("append").json(f"{path}/progress")
    return spark.read.json(f"{path}/progress")


def read_region(spark: SparkSession, path: str, level: int, y0: int, y1: int, x0: int, x1: int, channels: Sequence[int] | None = None) -> DataFrame:
    """The tiles that meet a region of one level; partitions and row groups outside it are not read."""
    t = spark.read.parquet(path).where((F.col("level") == level) & (F.col("y0") < y1) & (F.col("x0") < x1) & (F.col("y0") > y0 - 65_536) & (F.col("x0") > x0 - 65_536))
    t = t.where((F.col("y0") + F.col("h") > y0) & (F.col("x0") + F.col("w") > x0))
    return t if channels is None else t.where(F.col("channel").isin(*channels))
