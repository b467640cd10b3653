"""Writers. Tables go out as Parquet or CSV, models and diagnostics as JSON lines, rasters as tile tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import chain, count, groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.functions.scalar import label_dtype


#: What file systems refuse in names, beside control characters.
REFUSED = frozenset('<>:"/\\|?*')


def safe_stem(name: str) -> str:
    """A file name in which every run of refused characters is one underscore; 'mask' if nothing is left of it."""
    runs = groupby(str(name), key=lambda c: c in REFUSED or ord(c) < 32)
    return "".join("_" if refused else "".join(run) for refused, run in runs).strip(" ._") or "mask"


def unique_stems(names: Iterable[str]) -> list[str]:
    """Safe names, told apart without regard to case: the first of a name keeps it, others take the least free number from 2
    on, as name_2."""
    taken: dict[str, str] = {}
    for base in map(safe_stem, names):
        options = chain([base], (f"{base}_{k}" for k in count(2)))
        free = next(o for o in options if o.lower() not in taken)
        taken[free.lower()] = free
    return list(taken.values())


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", "true")
    w.format(fmt).save(path)


def write_models(models: DataFrame, path: str) -> None:
    """One JSON object per group."""
    models.write.json(path)


def to_tiles(pixels: DataFrame, by: Sequence[str], value: str, tile: int = 256) -> DataFrame:
    """(by, ty, tx, y0, x0, dtype, pixels): one row per tile that holds anything, its pixels as a sorted array of
    (y, x, value) within the tile. The dtype is the smallest unsigned one for the group's labels."""
    p = pixels.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})
    one = F.struct(F.pmod("y", F.lit(tile)).cast("int").alias("y"), F.pmod("x", F.lit(tile)).cast("int").alias("x"), F.col(value).alias("value"))
    t = p.groupBy(*by, "ty", "tx").agg(F.array_sort(F.collect_list(one)).alias("pixels"), F.max(value).alias("_top"))  # a tile bounds the list
    return t.select(*by, "ty", "tx", (F.col("ty") * tile).alias("y0"), (F.col("tx") * tile).alias("x0"), label_dtype("_top").alias("dtype"), "pixels")


def from_tiles(tiles: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    t = tiles.select(*by, "y0", "x0", F.explode("pixels").alias("p"))
    return t.select(*by, (F.col("y0") + F.col("p.y")).cast("int").alias("y"), (F.col("x0") + F.col("p.x")).cast("int").alias("x"), F.col("p.value").alias(value))


def write_mask(pixels: DataFrame, by: Sequence[str], path: str, tile: int = 256) -> None:
    to_tiles(pixels, by, "label", tile).write.parquet(path)


def read_mask(spark, path: str, by: Sequence[str]) -> DataFrame:
    return from_tiles(spark.read.parquet(path), by, "label")


def write_registration(folder: str, tables: dict[str, DataFrame], models: DataFrame, diagnostics: DataFrame) -> None:
    """A registration's bundle: every table as CSV under its name, the models and diagnostics as JSON."""
    for name, df in tables.items():
        write_table(df, f"{folder}/{safe_stem(name)}", "csv")
    write_models(models, f"{folder}/models")
    diagnostics.write.json(f"{folder}/diagnostics")
