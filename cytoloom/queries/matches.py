"""Neighbour joins, assignment, consensus filters and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoloom.functions import scalar as S
from cytoloom.functions import stats
from cytoloom.operators import consensus, masks, matching, neighbors, topology
from cytoloom.plans.matching import fine_candidates, match_weighted
from cytoloom.queries.base import BY, CELLS, LINKED, SHAPE, cells, linked, r, sides, table
from cytoloom.runtime import cut

WINDOW = 30.0


def _pairs(spark: SparkSession, sf: str, window: float = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    f, m = sides(spark, sf)
    return f, m, neighbors.radius_pairs(f, m, BY, ["centroid_x", "centroid_y"], "cell_key", window)


def _scored(spark: SparkSession, sf: str, window: float = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    f, m, p = _pairs(spark, sf, window)
    return f, m, neighbors.shape_score(p, f, m, stats.robust_scales(cells(spark, sf), BY, SHAPE), BY, "cell_key", SHAPE)


def radius_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf)[2].select("id1", "id2", r("spatial"))


def scored_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf)[2].where("score is not null").select("id1", "id2", r("score"))


def topk_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.top_candidates(_scored(spark, sf)[2], BY, 3, threshold=2.0).select("id1", "id2", "rank")


def fine_scores(spark: SparkSession, sf: str) -> DataFrame:
    return fine_candidates(_scored(spark, sf)[2], WINDOW, per_cell=4).select("id1", "id2", r("distance"))


def mutual_nearest(spark: SparkSession, sf: str) -> DataFrame:
    f, m = sides(spark, sf)
    return neighbors.mutual_nearest(f, m, BY, ["centroid_x", "centroid_y"], "cell_key", WINDOW).select("id1", "id2", r("spatial"))


def mutual_minima(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.mutual_least(cut(_scored(spark, sf)[2].where("score is not null")), BY, "score").select("id1", "id2")


def nearest_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return neighbors.knn(c, None, ["slide_id", "round_no"], ["centroid_x", "centroid_y"], "cell_key", 3).select(F.col("id").alias("cell_key"), "neighbour", "ordinal", r("distance"))


def feature_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five round-2 cells most like each round-1 cell of the slide, in standardised features."""
    z = stats.z_scores(cells(spark, sf).select("slide_id", "round_no", "cell_key", *SHAPE), BY, SHAPE)
    near = neighbors.knn(z.where("round_no = 1"), z.where("round_no = 2"), BY, SHAPE, "cell_key", 5)
    return near.select(F.col("id").alias("id1"), F.col("neighbour").alias("id2"), "ordinal")


def embedding_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The four nearest odd vectors of every even one."""
    e = table(spark, sf, "embeddings").where("vec_id is not null and embedding is not null")
    e = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    near = neighbors.knn(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), [], [f"e{i}" for i in range(64)], "vec_id", 4)
    return near.select(F.col("id").alias("vec_id"), "neighbour", "ordinal")


def embedding_similar(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest other vectors of every fiftieth one, among all."""
    e = table(spark, sf, "embeddings").where("vec_id is not null and embedding is not null")
    cols = [f"e{i}" for i in range(64)]
    e = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    near = neighbors.knn(e.where("vec_id % 50 = 0"), e, [], cols, "vec_id", 6).where("id <> neighbour")
    place = F.row_number().over(W.partitionBy("id").orderBy("ordinal"))
    return near.withColumn("ordinal", place).where("ordinal <= 5").select(F.col("id").alias("vec_id"), "neighbour", "ordinal")


def topology_features(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).where("area is not null and roundness is not null")
    t = masks.topology_features(c, ["slide_id", "round_no"], "cell_key", 5)
    return t.select(F.col("id").alias("cell_key"), *[r(x) for x in ("nn_dist_1", "nn_dist_2", "nn_dist_3", "local_density", "neighbor_area_ratio_mean", "neighbor_roundness_mean")])


def greedy_match(spark: SparkSession, sf: str) -> DataFrame:
    m = matching.greedy_match(linked(spark, sf), BY, ("distance", "id1", "id2"), 320, 2.0)
    return m.select("slide_id", "id1", "id2", r("distance"))


def _patched(spark: SparkSession, sf: str) -> DataFrame:
    size = table(spark, sf, "slides").where("slide_id is not null").groupBy("slide_id").agg(F.max("image_width").alias("w"), F.max("image_height").alias("h"))
    j = linked(spark, sf).join(size, "slide_id")
    return j.withColumns({"patch_y": S.patch_of(F.col("y1") / F.col("h"), 4), "patch_x": S.patch_of(F.col("x1") / F.col("w"), 4)}).withColumn("patch", F.col("patch_y") * 4 + F.col("patch_x")).drop("w", "h")


def greedy_per_patch(spark: SparkSession, sf: str) -> DataFrame:
    m = matching.greedy_per_patch(_patched(spark, sf), ["slide_id", "patch_y", "patch_x"], 10)
    return m.select("slide_id", "patch_y", "patch_x", "id1", "id2")


def patch_balanced(spark: SparkSession, sf: str) -> DataFrame:
    m = matching.patch_balanced_match(_patched(spark, sf).drop("patch_y", "patch_x"), BY, "patch", 64, threshold=1.0)
    return m.select("slide_id", "patch", "id1", "id2", "phase")


WEIGHTS = (1.0, 0.5, 2.0)


def _weighable(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    used = [*SHAPE, "roundness", "aspect_ratio", "pos_x_norm", "pos_y_norm"]
    return tuple(t.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in used])) for t in sides(spark, sf))


def weighted_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs within 25 px by shape, roundness and place together."""
    f, m = _weighable(spark, sf)
    p = neighbors.weighted_pairs(f, m, BY, "cell_key", SHAPE, ["roundness", "aspect_ratio"], WEIGHTS, 25.0)
    return p.select("id1", "id2", r("distance"))


def weighted_match(spark: SparkSession, sf: str) -> DataFrame:
    """One to one by that distance, up to 3, the best 320 of a slide."""
    f, m = _weighable(spark, sf)
    w = match_weighted(f, m, BY, "cell_key", SHAPE, ["roundness", "aspect_ratio"], WEIGHTS, 25.0, 320, 3.0)
    return w.select("slide_id", "id1", "id2", r("distance"))


def grid_coverage(spark: SparkSession, sf: str) -> DataFrame:
    g = matching.grid_covered(_patched(spark, sf), BY, "patch_x", "patch_y", 4, 40, ("distance", "match_id"))
    return g.select("slide_id", "match_id", "pick")


def short_lines(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.short_lines(linked(spark, sf), BY).select("match_id", r("match_line_length_px"))


def parallel_displacements(spark: SparkSession, sf: str) -> DataFrame:
    m = cut(linked(spark, sf))
    ref = m.groupBy("slide_id").agg(F.median("dx").alias("dx0"), F.median("dy").alias("dy0"))
    return consensus.parallel_displacements(m, ref, BY, 10.0, pass_short=True).select("match_id")


def residual_filter(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.residual_filter(linked(spark, sf).withColumn("res", F.abs("dx")), BY, "res", 2.0).select("match_id")


def quantile_prune(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.quantile_prune(linked(spark, sf), BY, "distance", 0.8).select("match_id")


def direction_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.direction_consensus(_patched(spark, sf), ["slide_id", "patch_y", "patch_x"], "match_id").select("match_id")


def validated(spark: SparkSession, sf: str) -> DataFrame:
    f, m = sides(spark, sf)
    j = matching.match_report(linked(spark, sf), f, m, "cell_key", ["area", "eccentricity", "solidity"])
    return matching.validate_matches(j, BY, ["area", "eccentricity", "solidity"], min_confidence=0.3, max_feature_diff=0.4).select("match_id", r("confidence"))


def ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    c = cut(linked(spark, sf))
    a = matching.ambiguity(c, c, BY)
    return a.select("match_id", r("ambiguity_ratio"), F.when(F.col("ambiguity_gap") < float("inf"), F.round("ambiguity_gap", 6)).alias("ambiguity_gap"))


def match_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """How alike the distances to the nearest matched cells are on both sides."""
    m = cut(linked(spark, sf).where("distance < 0.5").groupBy("slide_id", "id1").agg(F.min_by(F.struct("id2", "match_id", "x1", "y1", "x2", "y2"), F.struct("distance", "id2")).alias("s")).select("slide_id", "id1", "s.*"))
    m = cut(m.groupBy("slide_id", "id2").agg(F.min(F.struct("id1", "match_id", "x1", "y1", "x2", "y2")).alias("s")).select("slide_id", "id2", "s.*"))
    n1 = neighbors.knn(m, None, BY, ["x1", "y1"], "id1", 4)
    n2 = neighbors.knn(m, None, BY, ["x2", "y2"], "id2", 4)
    return matching.profile_difference(m, n1, n2).select("match_id", r("profile_diff"))


def neighbour_profiles(spark: SparkSession, sf: str) -> DataFrame:
    f, m, p = _pairs(spark, sf, 12.0)
    n1, n2 = (cut(neighbors.knn(t, None, BY, ["centroid_x", "centroid_y"], "cell_key", 4)) for t in (f, m))
    q = matching.neighbour_profile(n1, n2, f, m, p, "cell_key", 4)
    return q.select("id1", "id2", r("neighbor_distance_diff"), r("neighbor_vector_diff"), r("neighbor_profile_diff"))


def _in_patches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf, "slides").where("slide_id is not null").groupBy("slide_id").agg(F.max("image_width").cast("double").alias("width"), F.max("image_height").cast("double").alias("height"))
    c = cells(spark, sf).select("slide_id", "round_no", "cell_key", "centroid_x", "centroid_y").join(s, "slide_id")
    c = cut(c.withColumns({"patch_y": S.patch_of(F.col("centroid_y") / F.col("height")), "patch_x": S.patch_of(F.col("centroid_x") / F.col("width"))}))
    return c.where("round_no = 1"), c.where("round_no = 2")


def topology_losses(spark: SparkSession, sf: str) -> DataFrame:
    f, m = _in_patches(spark, sf)
    p, _ = topology.topology_pairs(linked(spark, sf).select("id1", "id2").distinct(), f, m, BY, "cell_key", k=4)
    return p.select("id1", "id2", r("l_pos"), r("l_nei"))


def mapped_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    f, m = _in_patches(spark, sf)
    d = topology.topology_matching(linked(spark, sf).where("distance < 0.3").select("id1", "id2").distinct(), f, m, BY, "cell_key", k=3)
    return d.select("anchor_id1", "anchor_id2", "neighbour_id1", "neighbour_id2", r("dist_norm"), "mapped")


QUERIES = {f.__name__: f for f in (radius_candidates, scored_candidates, topk_candidates, fine_scores, mutual_nearest, mutual_minima, nearest_cells, feature_neighbours, embedding_neighbours, embedding_similar, topology_features, greedy_match, weighted_distances, weighted_match, greedy_per_patch, patch_balanced, grid_coverage, short_lines, parallel_displacements, residual_filter, quantile_prune, direction_consensus, validated, ambiguity, match_profiles, neighbour_profiles, topology_losses, mapped_neighbours)}

_PAIRS = f"""{CELLS}, pairs AS (SELECT f.slide_id, f.cell_key AS id1, m.cell_key AS id2, sqrt((f.centroid_x - m.centroid_x) ** 2 + (f.centroid_y - m.centroid_y) ** 2) AS spatial
  FROM f JOIN m USING (slide_id) WHERE abs(f.centroid_x - m.centroid_x) <= 30 AND sqrt((f.centroid_x - m.centroid_x) ** 2 + (f.centroid_y - m.centroid_y) ** 2) <= 30)"""
_SCORED = f"""{_PAIRS}, med AS (SELECT slide_id, {', '.join(f'median({c}) AS m_{c}' for c in SHAPE)} FROM placed GROUP BY slide_id),
scale AS (SELECT slide_id, {', '.join(f'greatest(1.4826 * coalesce(median(abs({c} - m_{c})), 0), 0.001) AS s_{c}' for c in SHAPE)} FROM placed JOIN med USING (slide_id) GROUP BY slide_id),
scored AS (SELECT p.*, sqrt(({' + '.join(f'((a.{c} - b.{c}) / s_{c}) ** 2' for c in SHAPE)}) / {len(SHAPE)}) AS score
  FROM pairs p JOIN f a ON a.cell_key = id1 JOIN m b ON b.cell_key = id2 JOIN scale s ON s.slide_id = p.slide_id)"""
_Z = [*SHAPE, "roundness", "aspect_ratio"]
_WEIGHTED = f"""{CELLS}, whole AS (SELECT * FROM placed WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*_Z, 'pos_x_norm', 'pos_y_norm'])} AND round_no IN (1, 2)),
z AS (SELECT *, {', '.join(f'({c} - avg({c}) OVER w) / coalesce(nullif(stddev_pop({c}) OVER w, 0), 1) AS z_{c}' for c in _Z)} FROM whole WINDOW w AS (PARTITION BY slide_id)),
weighted AS (SELECT a.slide_id, a.cell_key AS id1, b.cell_key AS id2, sqrt({' + '.join(f'(a.z_{c} - b.z_{c}) ** 2' for c in SHAPE)}) + 0.5 * sqrt((a.z_roundness - b.z_roundness) ** 2 + (a.z_aspect_ratio - b.z_aspect_ratio) ** 2)
    + 2.0 * sqrt((a.pos_x_norm - b.pos_x_norm) ** 2 + (a.pos_y_norm - b.pos_y_norm) ** 2) AS distance
  FROM z a JOIN z b USING (slide_id) WHERE a.round_no = 1 AND b.round_no = 2 AND sqrt((a.centroid_x - b.centroid_x) ** 2 + (a.centroid_y - b.centroid_y) ** 2) <= 25)"""
_NEAR = "row_number() OVER (PARTITION BY a.cell_key ORDER BY sqrt((a.centroid_x - b.centroid_x) ** 2 + (a.centroid_y - b.centroid_y) ** 2), b.cell_key)"
_PATCHED = f"""{LINKED}, patched AS (SELECT l.*, CAST(least(3, floor(least(1, greatest(0, y1 / image_height)) * 4)) AS INTEGER) AS patch_y,
    CAST(least(3, floor(least(1, greatest(0, x1 / image_width)) * 4)) AS INTEGER) AS patch_x FROM linked l JOIN (SELECT slide_id, max(image_width) AS image_width, max(image_height) AS image_height FROM slides GROUP BY slide_id) USING (slide_id))"""
_INP = """s AS (SELECT slide_id, max(image_width) AS w, max(image_height) AS h FROM slides GROUP BY slide_id),
c3 AS MATERIALIZED (SELECT placed.slide_id, round_no, cell_key, centroid_x AS x, centroid_y AS y, w, h, CAST(least(2, floor(least(1, greatest(0, centroid_y / h)) * 3)) AS INTEGER) AS py,
  CAST(least(2, floor(least(1, greatest(0, centroid_x / w)) * 3)) AS INTEGER) AS px FROM placed JOIN s USING (slide_id)),
nn AS MATERIALIZED (SELECT * FROM (SELECT a.cell_key AS id, b.cell_key AS nb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, row_number() OVER (PARTITION BY a.cell_key ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.cell_key) AS o
  FROM c3 a JOIN c3 b USING (slide_id, round_no, py, px) WHERE a.cell_key <> b.cell_key) WHERE o <= 4),
cnt AS (SELECT slide_id, round_no, py, px, count(*) AS n FROM c3 GROUP BY ALL),
tp AS MATERIALIZED (SELECT DISTINCT id1, id2, a.slide_id, a.py, a.px, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, a.w, a.h FROM linked l JOIN c3 a ON a.cell_key = id1 JOIN c3 b ON b.cell_key = id2 WHERE a.py = b.py AND a.px = b.px {extra}),
nei AS MATERIALIZED (SELECT tp.*, least(4, c1.n - 1, c2.n - 1) AS k FROM tp JOIN cnt c1 ON c1.slide_id = tp.slide_id AND c1.round_no = 1 AND c1.py = tp.py AND c1.px = tp.px JOIN cnt c2 ON c2.slide_id = tp.slide_id AND c2.round_no = 2 AND c2.py = tp.py AND c2.px = tp.px),
nl AS MATERIALIZED (SELECT id, list(d ORDER BY o) AS ds FROM nn GROUP BY id),
rms AS (SELECT id1, id2, sqrt(list_avg(list_transform(range(1, CAST(k AS INTEGER) + 1), lambda i: (p.ds[i] - q.ds[i]) ** 2))) AS rms FROM nei JOIN nl p ON p.id = id1 JOIN nl q ON q.id = id2 WHERE k > 0),
loss AS MATERIALIZED (SELECT nei.*, sqrt((((ax - bx) / (w / 6)) ** 2 + ((ay - by_) / (h / 6)) ** 2) / 2) AS l_pos, rms / sqrt((w / 3) ** 2 + (h / 3) ** 2) AS l_nei FROM nei JOIN rms USING (id1, id2)),
top AS (SELECT * FROM loss WHERE l_pos <= 0.5 AND l_nei <= 0.3)"""

_FOLD = "list_reduce(list([{'d': distance, 'a': id1, 'b': id2}] ORDER BY distance, id1, id2), lambda got, e: CASE WHEN len(list_filter(got, lambda g: g.a = e[1].a OR g.b = e[1].b)) > 0 THEN got ELSE got || e END)"

SQL = {
    "greedy_match": f"""WITH {LINKED}, g AS (SELECT slide_id, unnest(list_slice({_FOLD}, 1, 320)) AS p FROM linked WHERE distance <= 2 GROUP BY slide_id) SELECT slide_id, p.a AS id1, p.b AS id2, round(p.d, 6) AS distance FROM g""",
    "weighted_distances": f"WITH {_WEIGHTED} SELECT id1, id2, round(distance, 6) AS distance FROM weighted",
    "weighted_match": f"""WITH {_WEIGHTED}, g AS (SELECT slide_id, unnest(list_slice({_FOLD}, 1, 320)) AS p FROM weighted WHERE distance <= 3 GROUP BY slide_id) SELECT slide_id, p.a AS id1, p.b AS id2, round(p.d, 6) AS distance FROM g""",
    "greedy_per_patch": f"""WITH {_PATCHED}, g AS (SELECT slide_id, patch_y, patch_x, unnest(list_slice({_FOLD}, 1, 10)) AS p FROM patched GROUP BY slide_id, patch_y, patch_x) SELECT slide_id, patch_y, patch_x, p.a AS id1, p.b AS id2 FROM g""",
    "radius_candidates": f"WITH {_PAIRS} SELECT id1, id2, round(spatial, 6) AS spatial FROM pairs",
    "scored_candidates": f"WITH {_SCORED} SELECT id1, id2, round(score, 6) AS score FROM scored WHERE score IS NOT NULL",
    "topk_candidates": f"WITH {_SCORED} SELECT id1, id2, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY score, spatial, id2) AS rn FROM scored WHERE score <= 2) WHERE rn <= 3",
    "fine_scores": f"WITH {_SCORED} SELECT id1, id2, round(score + spatial / 30, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY score, spatial, id2) AS rn FROM scored WHERE score IS NOT NULL) WHERE rn <= 4",
    "mutual_nearest": f"WITH {_PAIRS} SELECT id1, id2, round(spatial, 6) AS spatial FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY spatial, id1, id2) AS a, row_number() OVER (PARTITION BY id2 ORDER BY spatial, id1, id2) AS b FROM pairs) WHERE a = 1 AND b = 1",
    "mutual_minima": f"WITH {_SCORED} SELECT id1, id2 FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY score, id1, id2) AS a, row_number() OVER (PARTITION BY id2 ORDER BY score, id1, id2) AS b FROM scored WHERE score IS NOT NULL) WHERE a = 1 AND b = 1",
    "nearest_cells": f"""WITH {CELLS} SELECT cell_key, neighbour, CAST(o AS INTEGER) AS ordinal, round(d, 6) AS distance FROM (SELECT a.cell_key, b.cell_key AS neighbour, sqrt((a.centroid_x - b.centroid_x) ** 2 + (a.centroid_y - b.centroid_y) ** 2) AS d, {_NEAR} AS o
  FROM placed a JOIN placed b USING (slide_id, round_no) WHERE a.cell_key <> b.cell_key) WHERE o <= 3""",
    "feature_neighbours": f"""WITH {CELLS}, st AS (SELECT slide_id, {', '.join(f'avg({c}) AS a_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS d_{c}' for c in SHAPE)} FROM placed GROUP BY slide_id),
z AS (SELECT slide_id, round_no, cell_key, {', '.join(f'({c} - a_{c}) / d_{c} AS {c}' for c in SHAPE)} FROM placed JOIN st USING (slide_id) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SHAPE)})
SELECT id1, id2, CAST(o AS INTEGER) AS ordinal FROM (SELECT a.cell_key AS id1, b.cell_key AS id2, row_number() OVER (PARTITION BY a.cell_key ORDER BY sqrt({' + '.join(f'(a.{c} - b.{c}) ** 2' for c in SHAPE)}), b.cell_key) AS o
  FROM z a JOIN z b USING (slide_id) WHERE a.round_no = 1 AND b.round_no = 2) WHERE o <= 5""",
    "embedding_neighbours": """SELECT vec_id, neighbour, CAST(o AS INTEGER) AS ordinal FROM (SELECT a.vec_id, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS o
  FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) WHERE o <= 4""",
    "embedding_similar": """SELECT vec_id, neighbour, CAST(o AS INTEGER) AS ordinal FROM (SELECT a.vec_id, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS o
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE o <= 5""",
    "topology_features": f"""WITH {CELLS}, u AS (SELECT * FROM placed WHERE area IS NOT NULL AND roundness IS NOT NULL),
nn AS (SELECT * FROM (SELECT a.slide_id, a.round_no, a.cell_key, b.area, b.roundness, sqrt((a.centroid_x - b.centroid_x) ** 2 + (a.centroid_y - b.centroid_y) ** 2) AS d, {_NEAR} AS o FROM u a JOIN u b USING (slide_id, round_no) WHERE a.cell_key <> b.cell_key) WHERE o <= 5),
g AS (SELECT slide_id, round_no, greatest(median(d), 1) AS g FROM nn WHERE o = 1 GROUP BY ALL),
s AS (SELECT cell_key, max(d) FILTER (WHERE o = 1) AS d1, max(d) FILTER (WHERE o = 2) AS d2, max(d) FILTER (WHERE o = 3) AS d3, avg(d) AS md, avg(area) AS na, avg(roundness) AS nr FROM nn GROUP BY cell_key)
SELECT u.cell_key, round(coalesce(d1 / g, 1), 6) AS nn_dist_1, round(coalesce(d2 / g, 1), 6) AS nn_dist_2, round(coalesce(d3 / g, 1), 6) AS nn_dist_3,
  round(coalesce(CASE WHEN abs(md) > 1e-6 THEN g / md END, 1), 6) AS local_density, round(coalesce(CASE WHEN abs(u.area) > 1e-6 THEN na / u.area END, 1), 6) AS neighbor_area_ratio_mean, round(coalesce(nr, u.roundness), 6) AS neighbor_roundness_mean
FROM u LEFT JOIN s USING (cell_key) LEFT JOIN g USING (slide_id, round_no)""",
    "grid_coverage": f"""WITH {_PATCHED}, q AS (SELECT *, row_number() OVER (PARTITION BY slide_id, patch_x, patch_y ORDER BY distance, match_id) <= 3 AS inn FROM patched),
t AS (SELECT *, count(*) FILTER (WHERE inn) OVER (PARTITION BY slide_id) AS taken, row_number() OVER (PARTITION BY slide_id, inn ORDER BY distance, match_id) AS rr FROM q)
SELECT slide_id, match_id, CAST(row_number() OVER (PARTITION BY slide_id ORDER BY NOT inn, CASE WHEN inn THEN patch_y ELSE -1 END, CASE WHEN inn THEN patch_x ELSE -1 END, distance, match_id) AS INTEGER) AS pick FROM t WHERE inn OR rr <= 40 - taken""",
    "short_lines": f"""WITH {LINKED}, l AS (SELECT *, sqrt(dx * dx + dy * dy) AS len FROM linked), a AS (SELECT slide_id, median(len) AS med, avg(len) AS mean FROM l GROUP BY slide_id),
b AS (SELECT slide_id, median(abs(len - med)) AS mad FROM l JOIN a USING (slide_id) GROUP BY slide_id)
SELECT match_id, round(len, 6) AS match_line_length_px FROM l JOIN a USING (slide_id) JOIN b USING (slide_id) WHERE len <= greatest(mean, med + 3 * greatest(1.4826 * mad, 1))""",
    "parallel_displacements": f"""WITH {LINKED}, a AS (SELECT slide_id, median(dx) AS x0, median(dy) AS y0 FROM linked GROUP BY slide_id)
SELECT match_id FROM linked JOIN a USING (slide_id) WHERE CASE WHEN sqrt(x0 * x0 + y0 * y0) < 1 THEN true ELSE sqrt(dx * dx + dy * dy) >= 1
  AND degrees(acos(greatest(-1, least(1, (dx * x0 + dy * y0) / nullif(sqrt(dx * dx + dy * dy) * sqrt(x0 * x0 + y0 * y0), 0))))) <= 10 END""",
    "residual_filter": f"""WITH {LINKED}, l AS (SELECT *, abs(dx) AS res FROM linked), a AS (SELECT slide_id, median(res) AS med FROM l GROUP BY slide_id), b AS (SELECT slide_id, median(abs(res - med)) AS mad FROM l JOIN a USING (slide_id) GROUP BY slide_id),
k AS (SELECT *, res <= greatest(4, med + 3 * greatest(1.4826 * mad, 0.5)) AS ok FROM l JOIN a USING (slide_id) JOIN b USING (slide_id)), n AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY slide_id) AS kept FROM k) SELECT match_id FROM n WHERE ok OR kept < 3""",
    "quantile_prune": f"WITH {LINKED}, a AS (SELECT slide_id, quantile_cont(distance, 0.8) AS q FROM linked GROUP BY slide_id) SELECT match_id FROM linked JOIN a USING (slide_id) WHERE distance <= q",
    "direction_consensus": f"""WITH {_PATCHED}, p AS (SELECT *, sqrt(dx * dx + dy * dy) AS n, degrees(atan2(dy, dx)) AS ang, count(*) OVER (PARTITION BY slide_id, patch_y, patch_x) AS size FROM patched),
v AS (SELECT a.slide_id, a.patch_y, a.patch_x, a.match_id, any_value(a.dx) AS dx, any_value(a.dy) AS dy, any_value(a.n) AS n, count(*) AS votes FROM p a JOIN p b USING (slide_id, patch_y, patch_x)
  WHERE a.n >= 1 AND b.n >= 1 AND abs((((a.ang - b.ang + 540) % 360) + 360) % 360 - 180) <= 5 GROUP BY ALL),
l AS (SELECT slide_id, patch_y, patch_x, votes AS lv, dx AS lx, dy AS ly, n AS ln FROM (SELECT *, row_number() OVER (PARTITION BY slide_id, patch_y, patch_x ORDER BY votes DESC, match_id) AS rn FROM v) WHERE rn = 1),
j AS (SELECT p.*, lv, n >= 1 AND (dx * lx + dy * ly) / (n * ln + 1e-8) >= cos(radians(5)) AS along FROM p LEFT JOIN l USING (slide_id, patch_y, patch_x)),
k AS (SELECT *, avg(n) FILTER (WHERE along) OVER w AS mean, count(*) FILTER (WHERE along) OVER w AS members FROM j WINDOW w AS (PARTITION BY slide_id, patch_y, patch_x)),
s AS (SELECT *, along AND (members < 3 OR abs(n - mean) <= 5) AS stay FROM k), t AS (SELECT *, count(*) FILTER (WHERE stay) OVER (PARTITION BY slide_id, patch_y, patch_x) AS kept FROM s)
SELECT match_id FROM t WHERE coalesce(stay, false) OR NOT (size >= 3 AND coalesce(lv, 0) >= 2 AND kept >= 3 AND kept < size)""",
    "validated": f"""WITH {LINKED}, t AS (SELECT slide_id, max(distance) AS top FROM linked GROUP BY slide_id), c AS (SELECT *, CASE WHEN top > 0 THEN 1 - distance / (top + 1) ELSE 1 END AS confidence FROM linked JOIN t USING (slide_id))
SELECT match_id, round(confidence, 6) AS confidence FROM c JOIN f a ON a.cell_key = id1 JOIN m b ON b.cell_key = id2 WHERE confidence >= 0.3
  AND {' AND '.join(f'abs(a.{c} - b.{c}) / greatest(abs(a.{c}), abs(b.{c}), 1e-6) < 0.4' for c in ('area', 'eccentricity', 'solidity'))}""",
    "ambiguity": f"""WITH {LINKED}, o AS (SELECT a.match_id, min(b.distance) AS second FROM linked a JOIN linked b ON a.slide_id = b.slide_id AND ((a.id1 = b.id1 AND a.id2 <> b.id2) OR (a.id2 = b.id2 AND a.id1 <> b.id1)) GROUP BY a.match_id)
SELECT match_id, round(CASE WHEN second IS NULL THEN 0 ELSE distance / greatest(second, 1e-9) END, 6) AS ambiguity_ratio, round(second - distance, 6) AS ambiguity_gap FROM linked LEFT JOIN o USING (match_id)""",
    "match_profiles": f"""WITH {LINKED}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slide_id, id1 ORDER BY distance, id2) AS rn FROM linked WHERE distance < 0.5) WHERE rn = 1),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slide_id, id2 ORDER BY id1) AS r2 FROM a) WHERE r2 = 1),
n1 AS (SELECT a.id1, sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2) AS d, row_number() OVER (PARTITION BY a.id1 ORDER BY sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2), b.id1) AS o FROM k a JOIN k b USING (slide_id) WHERE a.id1 <> b.id1),
n2 AS (SELECT a.id2, sqrt((a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2) AS d, row_number() OVER (PARTITION BY a.id2 ORDER BY sqrt((a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2), b.id2) AS o FROM k a JOIN k b USING (slide_id) WHERE a.id2 <> b.id2),
q AS (SELECT match_id, median(abs(n1.d - n2.d) / greatest(n1.d, n2.d, 1)) AS pd FROM k JOIN n1 USING (id1) JOIN n2 ON n2.id2 = k.id2 AND n2.o = n1.o WHERE n1.o <= 4 GROUP BY match_id)
SELECT match_id, round(pd, 6) AS profile_diff FROM k LEFT JOIN q USING (match_id)""",
    "neighbour_profiles": f"""WITH {CELLS}, pairs AS (SELECT f.cell_key AS id1, m.cell_key AS id2 FROM f JOIN m USING (slide_id) WHERE sqrt((f.centroid_x - m.centroid_x) ** 2 + (f.centroid_y - m.centroid_y) ** 2) <= 12),
nn AS (SELECT * FROM (SELECT a.cell_key, b.centroid_x - a.centroid_x AS x, b.centroid_y - a.centroid_y AS y, sqrt((a.centroid_x - b.centroid_x) ** 2 + (a.centroid_y - b.centroid_y) ** 2) AS d, {_NEAR} AS o FROM placed a JOIN placed b USING (slide_id, round_no) WHERE a.cell_key <> b.cell_key) WHERE o <= 4),
s AS (SELECT cell_key, greatest(median(d), 1) AS s, count(*) AS n FROM nn GROUP BY cell_key),
v AS (SELECT nn.cell_key, o, d, x / s AS x, y / s AS y FROM nn JOIN s USING (cell_key) WHERE n = 4),
e AS (SELECT id1, id2, p.o AS po, q.o AS qo, p.d AS pd, q.d AS qd, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS e FROM pairs JOIN v p ON p.cell_key = id1 JOIN v q ON q.cell_key = id2),
d AS (SELECT id1, id2, median(abs(pd - qd) / greatest(pd, qd, 1)) AS dd FROM e WHERE po = qo GROUP BY ALL),
a AS (SELECT id1, id2, median(m) AS a FROM (SELECT id1, id2, po, min(e) AS m FROM e GROUP BY ALL) GROUP BY id1, id2), b AS (SELECT id1, id2, median(m) AS b FROM (SELECT id1, id2, qo, min(e) AS m FROM e GROUP BY ALL) GROUP BY id1, id2)
SELECT id1, id2, round(dd, 6) AS neighbor_distance_diff, round((a + b) / 2, 6) AS neighbor_vector_diff, round(greatest(dd, (a + b) / 2), 6) AS neighbor_profile_diff FROM d JOIN a USING (id1, id2) JOIN b USING (id1, id2)""",
    "topology_losses": f"WITH {LINKED}, {_INP.format(extra='')} SELECT id1, id2, round(l_pos, 6) AS l_pos, round(l_nei, 6) AS l_nei FROM top",
    "mapped_neighbours": f"""WITH {LINKED}, {_INP.replace('o <= 4', 'o <= 3').replace('least(4,', 'least(3,').format(extra='AND l.distance < 0.3')},
q AS (SELECT id1, id2, top.slide_id, top.py, top.px, top.w, top.h, nb, bx + c.x - ax AS qx, by_ + c.y - ay AS qy FROM top JOIN nn ON nn.id = id1 JOIN c3 c ON c.cell_key = nb),
g AS (SELECT id1, id2, nb, q.w, q.h, b.cell_key AS to_, sqrt((b.x - qx) ** 2 + (b.y - qy) ** 2) AS d, row_number() OVER (PARTITION BY id1, id2, nb ORDER BY sqrt((b.x - qx) ** 2 + (b.y - qy) ** 2), b.cell_key) AS rn
  FROM q JOIN c3 b ON b.slide_id = q.slide_id AND b.round_no = 2 AND b.py = q.py AND b.px = q.px)
SELECT id1 AS anchor_id1, id2 AS anchor_id2, nb AS neighbour_id1, to_ AS neighbour_id2, round(d / sqrt((w / 3) ** 2 + (h / 3) ** 2), 6) AS dist_norm, d / sqrt((w / 3) ** 2 + (h / 3) ** 2) <= 0.3 AS mapped FROM g WHERE rn = 1""",
}
