"""Splitting oversized items at natural boundaries, by dynamic programming over boundary positions."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.runtime import latest


def best_cuts(start: int, end: int, gaps: list[int], longest: int, shortest: int, hard: float = 1.0, balance: float | None = None) -> list[int]:
    """The cut positions of least cost within (start, end).

    States are boundary positions, taken from right to left. While more than ``longest`` remains, a piece that
    starts at s may end at any gap in [s + shortest, s + longest]; where there is none, at s + longest, a hard
    cut. What remains otherwise is the last piece.
    With ``balance`` the cost is the sum over pieces of ``hard`` per hard cut plus ``balance`` x (1 - length/longest)**2,
    and among equals the earlier piece is the longer. Without it costs are ordered lists, a piece's being what it lacks
    to ``longest`` and whether its cut is hard: the first piece's weighs more than all that follow, and so on.
    """
    inside = sorted({g for g in gaps if start < g < end})
    known = set(inside)
    if balance is None:
        piece = lambda s, t: (longest - (t - s), t not in known and t != end)
        join = lambda first, rest: (first, *rest)
        last = lambda s: (piece(s, end),)
    else:
        piece = lambda s, t: balance * (1 - (t - s) / longest) ** 2 + hard * (t not in known and t != end)
        join = lambda first, rest: rest + first
        last = lambda s: piece(s, end)
    # positions that cuts can reach: gaps and what hard cuts from a reached position give
    reach, seen = [start], {start}
    for s in reach:
        if end - s > longest:
            for t in _ends(s, inside, longest, shortest):
                if t not in seen:
                    seen.add(t)
                    reach.append(t)
    best: dict[int, tuple] = {}  # cost from here on, next cut
    for s in sorted(seen, reverse=True):
        if end - s <= longest:
            best[s] = (last(s), None)
        else:
            cost, t = min((join(piece(s, t), best[t][0]), -t) for t in _ends(s, inside, longest, shortest))
            best[s] = (cost, -t)
    cuts, s = [], start
    while best[s][1] is not None:
        s = best[s][1]
        cuts.append(s)
    return cuts


def _ends(s: int, inside: list[int], longest: int, shortest: int) -> list[int]:
    a, b = bisect_left(inside, s + shortest), bisect_right(inside, s + longest)
    return inside[a:b] or [s + longest]


PIECES = "array<struct<a:int,b:int>>"


def cut_pieces(axes: dict[str, tuple[Column, Column, Column]], longest: int, shortest: int, balance: float | None = None) -> Column:
    """A struct with the pieces [a, b) of each axis (start, end, gaps), as arrays; null where the interval is missing, empty
    or turned round. Gaps may be null, unsorted, repeated or outside the interval. All axes go through one call."""

    names = list(axes)

    @F.pandas_udf(", ".join(f"{a} {PIECES}" for a in names))
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            yield pd.DataFrame({a: pd.Series(pieces(*cols[3 * i : 3 * i + 3]), dtype=object) for i, a in enumerate(names)})

    def pieces(starts: pd.Series, ends: pd.Series, gaps: pd.Series) -> list:
        out = []
        for a, b, g in zip(starts, ends, gaps):
            if pd.isna(a) or pd.isna(b) or b <= a:
                out.append(None)
                continue
            a, b = int(a), int(b)
            known = [int(x) for x in g if x is not None and not pd.isna(x)] if g is not None else []
            at = [a, *best_cuts(a, b, known, longest, shortest, balance=balance), b]
            out.append([{"a": p, "b": q} for p, q in zip(at[:-1], at[1:])])
        return out

    # said to be indeterminate, else what explodes its result would run it a second time to look for empty ones
    return cut.asNondeterministic()(*[c for axis in axes.values() for c in axis])


def split_tiles(tiles: DataFrame, longest: int = 1024, shortest: int = 128, overlap: int = 64, balance: float | None = None) -> DataFrame:
    """Tiles whose core is over ``longest`` on an axis, as tiles that fit: both axes are cut by themselves and every
    row piece meets every column piece. A piece's window is its core widened by ``overlap``, within the tile's
    window; a missing window bound doesn't limit it. A tile delivered again counts once, by its latest
    ingested_at; tiles with null, empty or turned bounds, or a null id, give no row, nor do those that fit.
    """
    cols = ["y0", "y1", "x0", "x1", "core_y0", "core_y1", "core_x0", "core_x1", "row_gaps", "col_gaps"]
    t = latest(tiles, ["tile_id"], ["ingested_at"], cols)
    wide = lambda a, b: F.col(b).cast("long") - F.col(a) > longest
    t = t.where("core_y1 > core_y0 and core_x1 > core_x0").where(wide("core_y0", "core_y1") | wide("core_x0", "core_x1"))
    axes = {"rows": ("core_y0", "core_y1", "row_gaps"), "columns": ("core_x0", "core_x1", "col_gaps")}
    t = t.withColumn("p", cut_pieces({a: tuple(map(F.col, c)) for a, c in axes.items()}, longest, shortest, balance))
    t = t.select("tile_id", "y0", "y1", "x0", "x1", F.explode("p.rows").alias("r"), "p.columns").select("*", F.explode("columns").alias("c"))
    return t.select("tile_id", F.col("r.a").alias("core_y0"), F.col("r.b").alias("core_y1"), F.col("c.a").alias("core_x0"), F.col("c.b").alias("core_x1"), F.greatest(F.col("r.a") - overlap, "y0").alias("y0"), F.least(F.col("r.b") + overlap, "y1").alias("y1"), F.greatest(F.col("c.a") - overlap, "x0").alias("x0"), F.least(F.col("c.b") + overlap, "x1").alias("x1"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Oversized tiles in pieces of at most 1,024 px, cut at the last gap that serves."""
    return split_tiles(spark.read.parquet(f"{sf}/tiles.parquet"))


def p3_balanced(spark: SparkSession, sf: str) -> DataFrame:
    """The same tiles, cut for the fewest hard cuts and the most even pieces."""
    return split_tiles(spark.read.parquet(f"{sf}/tiles.parquet"), balance=0.25)


QUERIES = {"p3_found": p3_found, "p3_balanced": p3_balanced}


def _axis(a: str) -> str:
    g = {"y": "row_gaps", "x": "col_gaps"}[a]
    return f"""
{a}p AS (SELECT tile_id, core_{a}0 AS a, CASE WHEN core_{a}1 - core_{a}0 <= 1024 THEN core_{a}1 ELSE coalesce(list_max(list_filter({g}, lambda g: g >= core_{a}0 + 128 AND g <= core_{a}0 + 1024)), core_{a}0 + 1024) END AS b, core_{a}1 AS e, {g} AS gaps FROM t
  UNION ALL SELECT tile_id, b, CASE WHEN e - b <= 1024 THEN e ELSE coalesce(list_max(list_filter(gaps, lambda g: g >= b + 128 AND g <= b + 1024)), b + 1024) END, e, gaps FROM {a}p WHERE b < e)"""


SQL = {
    "p3_found": f"""
WITH RECURSIVE t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY ingested_at DESC) AS rn FROM tiles)
  WHERE rn = 1 AND core_y1 > core_y0 AND core_x1 > core_x0 AND (core_y1 - core_y0 > 1024 OR core_x1 - core_x0 > 1024)), {_axis("y")}, {_axis("x")}
SELECT t.tile_id, CAST(r.a AS INTEGER) AS core_y0, CAST(r.b AS INTEGER) AS core_y1, CAST(c.a AS INTEGER) AS core_x0, CAST(c.b AS INTEGER) AS core_x1,
  CAST(greatest(r.a - 64, t.y0) AS INTEGER) AS y0, CAST(least(r.b + 64, t.y1) AS INTEGER) AS y1,
  CAST(greatest(c.a - 64, t.x0) AS INTEGER) AS x0, CAST(least(c.b + 64, t.x1) AS INTEGER) AS x1
FROM t JOIN yp r USING (tile_id) JOIN xp c USING (tile_id)""",
}
