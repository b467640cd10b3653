"""Robust statistics per group: exact medians in two passes, as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.functions.scalar import clean

MAD = 1.4826


def on(by: Sequence[str], a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the group columns, or on nothing where there are none: ``b`` then has one row; more raise when used."""
    if by:
        return a.join(b, list(by), how)
    rows = F.collect_list(F.struct(*b.columns))
    one = b.limit(2).agg(F.when(F.count("*") < 2, rows).otherwise(F.raise_error(F.lit("a table without groups has several rows"))).alias("_rows"))
    return a.join(F.broadcast(one.select(F.explode("_rows").alias("_row")).select("_row.*")), F.lit(True), "left")


def medians(df: DataFrame, by: Sequence[str], cols: Sequence[str], prefix: str = "median_") -> DataFrame:
    """Exact median of each column; nulls, NaN and infinities don't count."""
    return df.groupBy(*by).agg(*[F.median(clean(F.col(c).cast("double"))).alias(f"{prefix}{c}") for c in cols])


def robust_scales(df: DataFrame, by: Sequence[str], cols: Sequence[str], floor: float = 1e-3) -> DataFrame:
    """median_<c> and scale_<c> = max(1.4826 MAD, floor) of each column in each group; the scale is the floor
    where a group has no value."""
    med = medians(df, by, cols)
    dev = on(by, df.select(*by, *cols), med).select(*by, *[F.abs(clean(F.col(c).cast("double")) - F.col(f"median_{c}")).alias(c) for c in cols])
    mad = medians(dev, by, cols, "mad_")
    out = on(by, med, mad)
    return out.select(*by, *[F.col(f"median_{c}") for c in cols], *[F.greatest(MAD * F.coalesce(f"mad_{c}", F.lit(0.0)), F.lit(floor)).alias(f"scale_{c}") for c in cols])


def robust_standardise(df: DataFrame, by: Sequence[str], cols: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """Columns minus their group median over their robust scale; missing values become 0, the median."""
    st = robust_scales(df, by, cols, floor)
    z = {c: F.coalesce((clean(F.col(c).cast("double")) - F.col(f"median_{c}")) / F.col(f"scale_{c}"), F.lit(0.0)) for c in cols}
    return on(by, df, st).withColumns(z).drop(*[c for c in st.columns if c not in by])


def z_scores(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Columns minus their group mean over their population deviation; a deviation of 0 divides by 1."""
    v = {c: clean(F.col(c).cast("double")) for c in cols}
    st = df.groupBy(*by).agg(*[F.avg(v[c]).alias(f"mean_{c}") for c in cols], *[F.stddev_pop(v[c]).alias(f"dev_{c}") for c in cols])
    z = {c: (v[c] - F.col(f"mean_{c}")) / F.coalesce(F.nullif(F.col(f"dev_{c}"), F.lit(0.0)), F.lit(1.0)) for c in cols}
    return on(by, df, st).withColumns(z).drop(*[c for c in st.columns if c not in by])


def robust_extents(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """centre_<c> (median) and extent_<c> (99th less 1st percentile, at least 1)."""
    v = {c: clean(F.col(c).cast("double")) for c in cols}
    out = df.groupBy(*by).agg(*[F.median(v[c]).alias(f"centre_{c}") for c in cols], *[F.percentile(v[c], F.array(F.lit(0.01), F.lit(0.99))).alias(f"_p_{c}") for c in cols])
    return out.select(*by, *[f"centre_{c}" for c in cols], *[F.greatest(F.col(f"_p_{c}")[1] - F.col(f"_p_{c}")[0], F.lit(1.0)).alias(f"extent_{c}") for c in cols])


def keep_robust(df: DataFrame, by: Sequence[str], residual: str, ids: Sequence[str], floor: float = 1.0, least: float = 0.0, min_keep: int = 3, factor: float = 3.0) -> DataFrame:
    """Rows whose residual is at most max(median + factor x max(1.4826 MAD, floor), least) in their group. Groups of
    which fewer than ``min_keep`` would stay keep their ``min_keep`` smallest, ties by ``ids``."""
    from pyspark.sql import Window as W

    st = robust_scales(df, by, [residual], floor)
    j = on(by, df, st).withColumn("_in", F.col(residual) <= F.greatest(F.col(f"median_{residual}") + factor * F.col(f"scale_{residual}"), F.lit(least)))
    n = j.groupBy(*by).agg(F.count_if("_in").alias("_n"))
    few = on(by, df, n.where(F.col("_n") < min_keep)) if by else df.join(n.where(F.col("_n") < min_keep))
    few = few.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(residual, *ids))).where(F.col("_r") <= min_keep).select(*df.columns)
    many = on(by, j.where("_in"), n.where(F.col("_n") >= min_keep)) if by else j.where("_in").join(n.where(F.col("_n") >= min_keep))
    return many.select(*df.columns).unionByName(few)
