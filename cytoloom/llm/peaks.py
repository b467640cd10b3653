"""Grouping records into clusters by density peaks.

Each record's density is its number of neighbours within a radius; it points to its nearest denser neighbour, at the
distance delta. One that has none within the radius is a peak. Neighbours are joined block by block. Inside a block
pointers are followed at once, up to a peak or to a record beyond the block's border; the records at which they leave
are followed on by pointer jumping over all blocks, so that every record comes to its peak. Peaks are then merged: two
whose members touch are one cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoloom.operators.graph import components
from cytoloom.operators.spatial import voronoi_blocks, vp_pairs
from cytoloom.runtime import column, cut, free, latest, map_groups


def _resolve(pointer: np.ndarray) -> np.ndarray:
    while True:
        onward = pointer[pointer]
        if (onward == pointer).all():
            return pointer
        pointer = onward


def _peaks(inner: DataFrame) -> DataFrame:
    """``inner`` (id, ..., exit, open) with ``peak`` for exit: where pointers lead beyond a block's border."""
    rest = [c for c in inner.columns if c not in ("exit", "open")]
    left = inner.where("open").select(F.col("exit").alias("id")).distinct()
    step = cut(inner.join(left, "id", "left_semi").select(F.col("id").alias("node"), F.col("exit").alias("to"), "open"))
    while step.where("open").limit(1).count():
        onward = step.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("open").alias("more"))
        was, step = step, cut(step.join(onward, "to", "left").select("node", F.coalesce("far", "to").alias("to"), (F.col("open") & F.coalesce("more", F.lit(False))).alias("open")))
        free(was)
    return inner.join(step.select(F.col("node").alias("exit"), "to"), "exit", "left").select(*rest, F.coalesce("to", "exit").alias("peak"))


def density_peaks(points: DataFrame, group: Sequence[str], coords: Sequence[str], id_col: str, radius: float, cap: int = 1024) -> DataFrame:
    """(id, density, denser, delta, peak, label) of every point with usable coordinates and a non-null id and group.

    density: points of its group within ``radius``, itself included. denser: id of its nearest denser neighbour
    within the radius, and delta the distance to it, null for a peak; of equally dense points the one of smaller id is
    the denser, of equally near ones the densest. peak: where its pointers lead, its own id for a peak. label: the least
    id of its cluster, all points whose peaks are linked by touching members. Points at one place are one point of that
    weight: they share density, peak and label, and point to the least id among them. Nothing depends on ``cap``. Ids must
    be unique; an empty table gives no rows; other columns are ignored.
    """
    gs, xs = [f"g{i}" for i in range(len(group))], [f"x{i}" for i in range(len(coords))]
    p = points.select(*[F.col(c).alias(a) for c, a in zip(group, gs)], F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("double").alias(a) for c, a in zip(coords, xs)])
    for c in [*gs, "id", *xs]:
        p = p.where(F.col(c).isNotNull())
    for c in xs:
        p = p.where(~F.isnan(c) & (F.abs(c) < float("inf")))
    p = cut(p)
    places = cut(p.groupBy(*gs, *xs).agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    # twice the radius, so that the density of every neighbour of a core point is exact in its block
    blocks = voronoi_blocks(places, gs, xs, "id", 2 * radius, cap=cap)

    def local(t: pa.Table) -> pa.Table | None:
        core = column(t, "core").astype(bool)
        if not core.any():
            return None
        ids, weight = column(t, "id"), column(t, "weight")
        x = np.column_stack([column(t, c) for c in xs])
        i, j, d = vp_pairs(x, np.arange(len(x)), radius)
        density = np.bincount(i, weight[j], len(x)).astype(np.int64)
        rank = np.empty(len(x), np.int64)
        rank[np.lexsort((ids, -density))] = np.arange(len(x))  # 0 is the densest
        up = (rank[j] < rank[i]) & core[i]
        i2, j2, d2 = i[up], j[up], d[up]
        o = np.lexsort((rank[j2], d2, i2))
        first = np.flatnonzero(np.diff(i2[o], prepend=-1))
        denser, delta = np.full(len(x), -1), np.full(len(x), np.nan)
        denser[i2[o][first]], delta[i2[o][first]] = j2[o][first], d2[o][first]
        last = _resolve(np.where(denser >= 0, denser, np.arange(len(x))))
        rows = np.flatnonzero(core)
        # ends of pointers whose members touch inside the block are linked to one of them, and that one to what it touches outside
        lead = np.where(core, last, np.arange(len(x)))
        inside = core[i] & core[j]
        root = _linked(lead[i[inside]], lead[j[inside]], len(x))
        ends = np.unique(last[rows])
        ends = ends[root[ends] != ends]
        cross = core[i] & ~core[j]
        beyond = np.unique(np.column_stack([root[lead[i[cross]]], j[cross]]), axis=0) if cross.any() else np.empty((0, 2), np.int64)
        n, m = len(rows), len(ends) + len(beyond)
        none = lambda k, kind: pa.nulls(k, kind)
        return pa.table({
            "id": pa.concat_arrays([pa.array(ids[rows]), pa.array(ids[ends]), pa.array(ids[beyond[:, 1]])]),
            "density": pa.concat_arrays([pa.array(density[rows]), none(m, pa.int64())]),
            "denser": pa.concat_arrays([pa.array(ids[denser[rows]], mask=denser[rows] < 0), none(m, pa.int64())]),
            "delta": pa.concat_arrays([pa.array(delta[rows], mask=denser[rows] < 0), none(m, pa.float64())]),
            "exit": pa.concat_arrays([pa.array(ids[last[rows]]), pa.array(ids[root[ends]]), pa.array(ids[beyond[:, 0]])]),
            "open": pa.concat_arrays([pa.array(~core[last[rows]]), none(m, pa.bool_())]),
            "edge": np.concatenate([np.zeros(n, np.int8), np.ones(m, np.int8)]).astype(bool),
        })

    out = cut(map_groups(blocks, [*gs, "block"], local, "id long, density long, denser long, delta double, exit long, open boolean, edge boolean"))
    inner = cut(_peaks(out.where("not edge").drop("edge")))
    peak_of = inner.select("id", "peak")
    edges = out.where("edge").select("id", F.col("exit").alias("_e")).join(peak_of.withColumnRenamed("peak", "a"), "id")
    edges = edges.join(peak_of.select(F.col("id").alias("_e"), F.col("peak").alias("b")), "_e").where("a <> b").select("a", "b").distinct()
    least = cut(inner.groupBy("peak").agg(F.min("id").alias("least")))
    whole = cut(components(least.select(F.col("peak").alias("node")), cut(edges)).join(least.withColumnRenamed("peak", "node"), "node"))
    labels = whole.groupBy("label").agg(F.min("least").alias("least")).join(whole.select("label", "node"), "label")
    place = inner.join(labels.select(F.col("node").alias("peak"), F.col("least").alias("label")), "peak").withColumnRenamed("id", "first")
    cols = ["density", "denser", "delta", "peak", "label"]
    if places.where("weight > 1").limit(1).count() == 0:
        return place.select(F.col("first").alias("id"), *cols)
    other = F.col("id") != F.col("first")
    onto = p.join(places.select(F.col("id").alias("first"), *gs, *xs), [*gs, *xs]).select("id", "first").join(place, "first")
    return onto.withColumns({"denser": F.when(other, F.col("first")).otherwise(F.col("denser")), "delta": F.when(other, 0.0).otherwise(F.col("delta"))}).select("id", *cols)


def _linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Each number's least one among those that links (a, b) lead to."""
    root = np.arange(n)
    differ = a != b
    a, b = a[differ], b[differ]
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = _resolve(root)
        if (root == before).all():
            break
    return root


STEP_PX, LEAST = 22.125, 12


def _round_one(spark: SparkSession, sf: str) -> DataFrame:
    c = latest(spark.read.parquet(f"{sf}/cell_features.parquet"), ["cell_key"], ["ingested_at"], ["slide_id", "round_no", "centroid_x", "centroid_y"])
    return c.where("round_no = 1")


def _clustered(spark: SparkSession, sf: str) -> DataFrame:
    d = cut(density_peaks(_round_one(spark, sf), ["slide_id"], ["centroid_x", "centroid_y"], "cell_key", STEP_PX))
    large = d.groupBy("label").count().where(F.col("count") >= LEAST)
    return d.join(large, "label")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Members of every nest of at least twelve cells, under the least cell_key in it."""
    return _clustered(spark, sf).select(F.col("label").alias("cluster_key"), F.col("id").alias("cell_key"))


def p6_described(spark: SparkSession, sf: str) -> DataFrame:
    """Each nest's size and its three most typical members: the densest, smaller cell_key first."""
    c = _clustered(spark, sf)
    best = c.withColumn("place", F.row_number().over(W.partitionBy("label").orderBy(F.desc("density"), "id"))).where("place <= 3")
    return best.select(F.col("label").alias("cluster_key"), F.col("count").alias("cells"), "place", F.col("id").alias("typical_key"), "density")


def p6_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Each cell of round 1 with its density, nearest denser cell and the peak its pointers lead to."""
    d = density_peaks(_round_one(spark, sf), ["slide_id"], ["centroid_x", "centroid_y"], "cell_key", STEP_PX)
    return d.select(F.col("id").alias("cell_key"), "density", F.col("denser").alias("denser_key"), F.round("delta", 6).alias("delta"), F.col("peak").alias("peak_key"))


QUERIES = {"p6_found": p6_found, "p6_described": p6_described, "p6_peaks": p6_peaks}

_P6 = """
WITH RECURSIVE r AS (SELECT cell_key, max_by(slide_id, ingested_at) AS s, max_by(round_no, ingested_at) AS rn, max_by(centroid_x, ingested_at) AS x, max_by(centroid_y, ingested_at) AS y FROM cell_features GROUP BY cell_key),
u AS (SELECT *, floor(x / 22.125) AS gx, floor(y / 22.125) AS gy FROM r WHERE rn = 1 AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)),
o AS (SELECT unnest([-1, 0, 1]) AS d), w AS (SELECT u.*, gx + a.d AS nx, gy + b.d AS ny FROM u, o a, o b),
e AS MATERIALIZED (SELECT a.cell_key AS a, b.cell_key AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM w a JOIN u b ON a.s = b.s AND a.nx = b.gx AND a.ny = b.gy WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 22.125),
d AS (SELECT a AS node, count(*) AS density FROM e GROUP BY a),
l AS (SELECT cell_key AS node, cell_key AS label FROM u UNION SELECT e.b, l.label FROM l JOIN e ON e.a = l.node WHERE l.label < e.b),
m AS (SELECT node, min(label) AS label FROM l GROUP BY node),
n AS (SELECT label, count(*) AS cells FROM m GROUP BY label HAVING count(*) >= 12)"""

SQL = {
    "p6_found": f"{_P6} SELECT label AS cluster_key, node AS cell_key FROM m JOIN n USING (label)",
    "p6_described": f"""{_P6}
SELECT label AS cluster_key, cells, CAST(place AS INTEGER) AS place, node AS typical_key, density FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY density DESC, node) AS place FROM m JOIN n USING (label) JOIN d USING (node)) WHERE place <= 3""",
    "p6_peaks": f"""{_P6},
up AS (SELECT e.a AS node, e.b AS denser, e.dist AS delta, row_number() OVER (PARTITION BY e.a ORDER BY e.dist, q.density DESC, e.b) AS place
  FROM e JOIN d p ON p.node = e.a JOIN d q ON q.node = e.b WHERE q.density > p.density OR (q.density = p.density AND e.b < e.a)),
t AS (SELECT d.node, d.density, up.denser, up.delta FROM d LEFT JOIN up ON up.node = d.node AND up.place = 1),
walk AS (SELECT node, node AS at FROM t UNION ALL SELECT walk.node, t.denser FROM walk JOIN t ON t.node = walk.at WHERE t.denser IS NOT NULL)
SELECT t.node AS cell_key, t.density, t.denser AS denser_key, round(t.delta, 6) AS delta, walk.at AS peak_key
FROM t JOIN walk ON walk.node = t.node JOIN t z ON z.node = walk.at WHERE z.denser IS NULL""",
}
