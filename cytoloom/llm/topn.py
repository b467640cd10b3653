"""Top N items within every group, by a split into hot and cold groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoloom.runtime import cut, latest, take_bounded


def hot_size(rows: int, partitions: int, least: int = 1_000) -> int:
    """From how many rows on a group is heavy: a sixteenth of a task's share of the table, but at least ``least``."""
    return max(least, rows // (16 * max(1, partitions)))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int, hot: int | None = None, listed: int = 10_000) -> DataFrame:
    """The first ``n`` rows of every group by ``order``; a row's place is in ``place``.

    Groups are counted exactly. Those of more than ``hot`` rows (by default ``hot_size`` of the table) are range-sorted
    on (group, order) over all partitions, the salt being the range a row falls in; each range keeps its first n of a
    group, and only those meet in the final window. Other groups go through an ordinary window. ``order`` should end in
    a unique column, else ties are broken by nothing. Groups may have null columns: nulls are one group. Fewer than n
    rows are all kept; an empty table gives none. A column of ``df`` called ``place`` is replaced.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    cols = [c for c in df.columns if c != "place"]
    df = cut(df.select(*cols))
    spark = df.sparkSession
    counts = cut(df.groupBy(*group).count())
    if hot is None:
        hot = hot_size(counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0], int(spark.conf.get("spark.sql.shuffle.partitions")))
    heavy = counts.where(F.col("count") > hot).select(*[F.col(g).alias(f"_h{i}") for i, g in enumerate(group)])
    rows = take_bounded(heavy, listed)
    ranked = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    if rows == []:
        return df.withColumn("place", ranked).where(F.col("place") <= n)
    if rows is not None:
        heavy = F.broadcast(spark.createDataFrame(rows, heavy.schema))  # at most `listed` groups
    same = [df[g].eqNullSafe(heavy[f"_h{i}"]) for i, g in enumerate(group)]
    cold = df.join(heavy, same, "left_anti").withColumn("place", ranked).where(F.col("place") <= n)
    ranged = df.join(heavy, same, "left_semi").repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    first = ranged.withColumn("place", F.row_number().over(W.partitionBy("_range", *group).orderBy(*order))).where(F.col("place") <= n).drop("place", "_range")
    return cold.unionByName(first.withColumn("place", ranked).where(F.col("place") <= n))


def standing_matches(matches: DataFrame) -> DataFrame:
    """The latest delivery of each candidate, with its patch as two numbers. Patches come as '(0, 1)', '(0,1)',
    '0/1' or '[0 1]'; any other text, or none, is no patch."""
    m = latest(matches, ["slide_id", "idx1", "idx2"], ["ingested_at", "match_id"], ["patch_id", "distance"])
    digits = r"^\D*(\d+)\D+(\d+)\D*$"
    part = lambda i: F.nullif(F.regexp_extract("patch_id", digits, i), F.lit("")).try_cast("int")
    return m.withColumns({"patch_y": part(1), "patch_x": part(2)})


TOP = 5


def p2_found(spark: SparkSession, sf: str, hot: int | None = None) -> DataFrame:
    """The five candidates of least distance of every slide and patch."""
    m = standing_matches(spark.read.parquet(f"{sf}/cell_matches.parquet"))
    ok = m.where("patch_y is not null and patch_x is not null and distance >= 0 and not isnan(distance) and distance < double('Infinity')")
    best = top_per_group(ok.select("slide_id", "patch_y", "patch_x", "distance", "idx1", "idx2"), ["slide_id", "patch_y", "patch_x"], ["distance", "idx1", "idx2"], TOP, hot)
    return best.select("slide_id", "patch_y", "patch_x", "idx1", "idx2")


def p2_by_specimen(spark: SparkSession, sf: str, hot: int | None = None) -> DataFrame:
    """The fifty candidates of least distance of every specimen, one of which holds a tenth of all; candidates of no
    specimen are one group."""
    m = latest(spark.read.parquet(f"{sf}/cell_matches.parquet"), ["slide_id", "idx1", "idx2"], ["ingested_at", "match_id"], ["specimen_id", "distance"])
    ok = m.where("distance >= 0 and not isnan(distance) and distance < double('Infinity')")
    best = top_per_group(ok.select("specimen_id", "distance", "slide_id", "idx1", "idx2"), ["specimen_id"], ["distance", "slide_id", "idx1", "idx2"], 10 * TOP, hot)
    return best.select("specimen_id", "place", "slide_id", "idx1", "idx2", "distance")


QUERIES = {"p2_found": p2_found, "p2_by_specimen": p2_by_specimen}

SQL = {
    "p2_found": r"""
WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slide_id, idx1, idx2 ORDER BY ingested_at DESC, match_id DESC) AS rn FROM cell_matches) WHERE rn = 1),
p AS (SELECT slide_id, CAST(regexp_extract(patch_id, '([0-9]+)[^0-9]+([0-9]+)', 1) AS INTEGER) AS patch_y,
        CAST(regexp_extract(patch_id, '([0-9]+)[^0-9]+([0-9]+)', 2) AS INTEGER) AS patch_x, idx1, idx2, distance
      FROM m WHERE patch_id IS NOT NULL AND distance >= 0 AND isfinite(distance))
SELECT slide_id, patch_y, patch_x, idx1, idx2
FROM (SELECT *, row_number() OVER (PARTITION BY slide_id, patch_y, patch_x ORDER BY distance, idx1, idx2) AS place FROM p) WHERE place <= 5""",
    "p2_by_specimen": """
WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slide_id, idx1, idx2 ORDER BY ingested_at DESC, match_id DESC) AS rn FROM cell_matches) WHERE rn = 1)
SELECT specimen_id, CAST(place AS INTEGER) AS place, slide_id, idx1, idx2, distance
FROM (SELECT *, row_number() OVER (PARTITION BY specimen_id ORDER BY distance, slide_id, idx1, idx2) AS place FROM m WHERE distance >= 0 AND isfinite(distance)) WHERE place <= 50""",
}
