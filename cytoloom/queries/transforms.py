"""Transforms between the rounds of each slide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.operators import consensus, models
from cytoloom.operators.models import MODEL
from cytoloom.plans import matching as plans
from cytoloom.queries.base import BY, CELLS, LINKED, linked, r, sides, table
from cytoloom.runtime import cut


def _close(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates that may be true: a small distance and displacement."""
    return linked(spark, sf).where("distance < 0.6 and abs(dx) < 60 and abs(dy) < 60")


def _points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    f, m = sides(spark, sf)
    return tuple(t.select("slide_id", F.col("cell_key").alias("id"), F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y")) for t in (f, m))


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "slides").where("slide_id is not null").groupBy("slide_id").agg(F.max("image_width").alias("width"), F.max("image_height").alias("height"))


def _shown(m: DataFrame, n: int = 4) -> DataFrame:
    return m.select("slide_id", *[r(c, n) for c in MODEL])


def translation_mean(spark: SparkSession, sf: str) -> DataFrame:
    return models.fit_translation(_close(spark, sf), BY).select("slide_id", r("tx"), r("ty"), "n")


def translation_median(spark: SparkSession, sf: str) -> DataFrame:
    return models.fit_translation(_close(spark, sf), BY, "median").select("slide_id", r("tx"), r("ty"), "n")


def median_offset(spark: SparkSession, sf: str) -> DataFrame:
    return models.median_offset(linked(spark, sf), BY, ["match_id"]).select("slide_id", r("tx"), r("ty"), "n")


def main_displacement(spark: SparkSession, sf: str) -> DataFrame:
    st, _ = models.main_displacement(linked(spark, sf), BY, bin_px=64.0, broad_px=96.0, floor_px=5.0)
    return st.select("slide_id", r("dx0"), r("dy0"), r("limit_px"))


def in_main_displacement(spark: SparkSession, sf: str) -> DataFrame:
    _, m = models.main_displacement(linked(spark, sf), BY, bin_px=64.0, broad_px=96.0, floor_px=5.0)
    return m.where("in_main").select("match_id", r("displacement_residual_px"))


def translation_grid(spark: SparkSession, sf: str) -> DataFrame:
    m = _close(spark, sf).join(_sizes(spark, sf), "slide_id")
    return models.translation_grid(m, BY, F.col("width"), F.col("height")).select("slide_id", "gy", "gx", r("dx"), r("dy"), "known")


def similarity_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(models.fit_similarity(_close(spark, sf), BY))


def euclidean_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(models.fit_similarity(_close(spark, sf), BY, scale=False))


def affine_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(models.fit_affine(_close(spark, sf), BY))


def clipped_inliers(spark: SparkSession, sf: str) -> DataFrame:
    """Matches within 20 px of their slide's mean shift, without those that lie far off for them where that mends the shift."""
    m = cut(_close(spark, sf))
    model = cut(models.fit_translation(m, BY))
    marked = models.residuals(m, model, BY).withColumn("ransac_inlier", F.col("residual_px") <= 20)
    _, got, diag = models.clip_inliers(marked, model, BY, "translation", 20.0, 2.0)
    n = got.groupBy("slide_id").agg(F.count_if("ransac_inlier").alias("inliers"), F.round(F.avg("residual_px"), 5).alias("mean_residual"))
    return n.join(diag.select("slide_id", "used", r("clip_limit")), "slide_id")


def feature_registration(spark: SparkSession, sf: str) -> DataFrame:
    """The shift of each slide by what its cells look like alone."""
    f, m = (t.where("area is not null and perimeter is not null and roundness is not null and eccentricity is not null and solidity is not null and major_axis_length is not null and minor_axis_length is not null") for t in sides(spark, sf))
    got = plans.register_by_features(f, m, BY, "cell_key")
    return got.models.join(got.diagnostics, BY).select("slide_id", r("tx", 3), r("ty", 3), "candidates", "inliers")


def affine_residuals(spark: SparkSession, sf: str) -> DataFrame:
    m = cut(_close(spark, sf))
    return models.residuals(m, models.fit_affine(m, BY), BY).select("match_id", r("residual_px", 4))


def affine_inverse(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(models.invert(models.fit_similarity(_close(spark, sf), BY)))


def affine_compose(spark: SparkSession, sf: str) -> DataFrame:
    """A model and then another's inverse."""
    m = cut(_close(spark, sf))
    return _shown(models.compose(models.fit_similarity(m, BY), models.invert(models.fit_translation(m, BY)), BY))


def moved_cells(spark: SparkSession, sf: str) -> DataFrame:
    _, m = sides(spark, sf)
    p = models.transform_points(m.select("slide_id", "cell_key", "centroid_x", "centroid_y"), models.fit_similarity(_close(spark, sf), BY), BY, "centroid_x", "centroid_y")
    return p.where("x_reg is not null").select("cell_key", r("x_reg", 4), r("y_reg", 4))


def initial_affine(spark: SparkSession, sf: str) -> DataFrame:
    f, m = _points(spark, sf)
    return _shown(models.initial_affine(f, m, BY))


def match_radius(spark: SparkSession, sf: str) -> DataFrame:
    f, _ = _points(spark, sf)
    return models.match_radius(f, BY).select("slide_id", r("radius"))


def ransac_translation(spark: SparkSession, sf: str) -> DataFrame:
    m, _ = models.ransac(linked(spark, sf), BY, "match_id", "translation", 3.0, 1000)
    return m.select("slide_id", r("tx"), r("ty"), "n")


def ransac_inliers(spark: SparkSession, sf: str) -> DataFrame:
    _, m = models.ransac(linked(spark, sf), BY, "match_id", "euclidean", 3.0, 1000)
    return m.where("ransac_inlier").select("match_id", r("residual_px", 4))


def coarse_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    _, m = models.ransac(linked(spark, sf), BY, "match_id", "translation", 3.0, 300)
    a = consensus.accept_coarse(m, BY, ratio=0.1)
    return a.select("slide_id", "accepted", "inliers", r("inlier_ratio"), r("median_residual", 4))


def refined_affine(spark: SparkSession, sf: str) -> DataFrame:
    f, m = _points(spark, sf)
    a, _ = models.refine_affine(f, m, models.initial_affine(f, m, BY), BY)
    return a.select("slide_id", *[r(c, 4) for c in MODEL], "status")


def _landmarks(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest of each round-2 cell's candidates that were recorded as inliers."""
    told = table(spark, sf, "cell_matches").where("ransac_inlier").select("match_id")
    best = linked(spark, sf).join(told, "match_id", "left_semi").groupBy("slide_id", "id2").agg(F.min(F.struct("distance", "id1", "x1", "y1", "x2", "y2")).alias("s"))
    return cut(best.select("slide_id", F.col("id2").alias("id"), "s.x1", "s.y1", "s.x2", "s.y2"))


def local_affine(spark: SparkSession, sf: str) -> DataFrame:
    _, m = _points(spark, sf)
    lm = _landmarks(spark, sf)
    return models.local_affine(m, lm, models.fit_affine(lm, BY), BY).where("x_local is not null").select(F.col("id").alias("cell_key"), r("x_local", 4), r("y_local", 4))


def leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    """How far the local affine without a landmark lands from it."""
    lm = _landmarks(spark, sf)
    p = lm.select("slide_id", "id", F.col("x2").alias("x"), F.col("y2").alias("y"))
    got = models.local_affine(p, lm, models.fit_affine(lm, BY), BY, leave_out=True).join(lm.select("id", "x1", "y1"), "id")
    return got.select(F.col("id").alias("cell_key"), F.round(F.sqrt(F.pow(F.col("x_local") - F.col("x1"), 2) + F.pow(F.col("y_local") - F.col("y1"), 2)), 4).alias("residual_px"))


def deformation_grid(spark: SparkSession, sf: str) -> DataFrame:
    g = models.deformation_grid(models.fit_similarity(_close(spark, sf), BY), _sizes(spark, sf), BY)
    return g.where("moving_x_global is not null").select("slide_id", "gy", "gx", r("fixed_x", 4), r("fixed_y", 4), r("moving_x_global", 4), r("moving_y_global", 4))


def deformation_grid_local(spark: SparkSession, sf: str) -> DataFrame:
    lm = _landmarks(spark, sf)
    g = models.deformation_grid(models.fit_affine(lm, BY), _sizes(spark, sf), BY, 8, lm)
    return g.where("moving_x_global is not null").select("slide_id", "gy", "gx", r("moving_x_local", 4), r("moving_y_local", 4), r("delta_x", 4), r("delta_y", 4))


def spline_points(spark: SparkSession, sf: str) -> DataFrame:
    """Round-2 cells moved by a spline through the landmarks and anchors on the frame."""
    lm = _landmarks(spark, sf)
    model = cut(models.fit_affine(lm, BY))
    ends = models.boundary_anchors(model, _sizes(spark, sf), BY)
    pts = lm.drop("id").unionByName(ends).select("slide_id", F.col("x2").alias("fx"), F.col("y2").alias("fy"), F.col("x1").alias("tx"), F.col("y1").alias("ty"))
    _, m = _points(spark, sf)
    got = models.spline_points(m, models.fit_spline(pts, BY), BY)
    return got.select(F.col("id").alias("cell_key"), r("x_spline", 3), r("y_spline", 3))


def neighbour_refinement(spark: SparkSession, sf: str) -> DataFrame:
    lm = _landmarks(spark, sf)
    a = models.refine_with_neighbours(lm, models.fit_similarity(lm, BY), BY, "id", scale=True)
    return a.select("slide_id", *[r(c, 3) for c in MODEL], "accepted")


# -- whole registrations -----------------------------------------------------------------------------------------


def two_stage_matches(spark: SparkSession, sf: str) -> DataFrame:
    f, m = sides(spark, sf)
    return plans.two_stage_match(f, m, BY, "cell_key").matches.select("slide_id", "id1", "id2", r("distance"))


def registered_slides(spark: SparkSession, sf: str) -> DataFrame:
    f, m = sides(spark, sf)
    return plans.register_cells(f, m, BY, "cell_key").diagnostics.select("slide_id", r("tx", 3), r("ty", 3), "matches", r("median_residual", 3), "stage", r("spline_residual", 3))


def registered_centroids(spark: SparkSession, sf: str) -> DataFrame:
    f, m = _points(spark, sf)
    got = plans.register_centroids(f, m, BY).matches
    return got.select(F.col("id").alias("cell_key"), r("x_global", 3), r("y_global", 3), r("x_local", 3), r("y_local", 3))


def landmark_search(spark: SparkSession, sf: str) -> DataFrame:
    f, m = sides(spark, sf)
    return plans.find_landmarks(f, m, BY, "cell_key", max_deg=20.0, orientation_deg=20.0, max_profile=0.6).select("slide_id", "id1", "id2", "wsi_grid_y", "wsi_grid_x", r("displacement_residual_px", 3))


def sparse_registration(spark: SparkSession, sf: str) -> DataFrame:
    f, m = sides(spark, sf)
    coarse = cut(models.fit_translation(_close(spark, sf), BY, "median"))
    return plans.register_sparse(f, m, coarse, BY, "cell_key").models.select("slide_id", *[r(c, 3) for c in MODEL])


def landmark_registration(spark: SparkSession, sf: str) -> DataFrame:
    return plans.register_landmarks(_close(spark, sf), BY, "match_id", "similarity", 5.0, 200).models.select("slide_id", *[r(c, 3) for c in MODEL])


QUERIES = {f.__name__: f for f in (translation_mean, translation_median, median_offset, main_displacement, in_main_displacement, translation_grid, similarity_fit, euclidean_fit, affine_fit, clipped_inliers, feature_registration, affine_residuals, affine_inverse, affine_compose, moved_cells, initial_affine, match_radius, ransac_translation, ransac_inliers, coarse_acceptance, refined_affine, local_affine, leave_one_out, deformation_grid, deformation_grid_local, spline_points, neighbour_refinement, two_stage_matches, registered_slides, registered_centroids, landmark_search, sparse_registration, landmark_registration)}

_CLOSE = f"{LINKED}, k AS (SELECT * FROM linked WHERE distance < 0.6 AND abs(dx) < 60 AND abs(dy) < 60)"
_SIM = _CLOSE + """, g AS (SELECT slide_id, count(*) AS n, avg(x1) AS u, avg(y1) AS v, avg(x2) AS x, avg(y2) AS y, covar_pop(x2, x1) + covar_pop(y2, y1) AS re, covar_pop(x2, y1) - covar_pop(y2, x1) AS im, var_pop(x2) + var_pop(y2) AS den FROM k GROUP BY slide_id),
h AS (SELECT *, CASE WHEN {den} * n > 1e-12 THEN re / {den} ELSE 1 END AS co, CASE WHEN {den} * n > 1e-12 THEN im / {den} ELSE 0 END AS si FROM g),
sim AS (SELECT slide_id, co AS a, -si AS b, u - co * x + si * y AS tx, si AS c, co AS d, v - si * x - co * y AS ty FROM h)"""
_SIMS, _EUC = _SIM.format(den="den"), _SIM.format(den="sqrt(re * re + im * im)")
_AFF = _CLOSE + """, g AS (SELECT slide_id, count(*) AS n, avg(x1) AS u, avg(y1) AS v, avg(x2) AS x, avg(y2) AS y, n * var_pop(x2) AS xx, n * var_pop(y2) AS yy, n * covar_pop(x2, y2) AS xy, n * covar_pop(x2, x1) AS xu, n * covar_pop(y2, x1) AS yu, n * covar_pop(x2, y1) AS xv, n * covar_pop(y2, y1) AS yv FROM k GROUP BY slide_id),
h AS (SELECT *, xx * yy - xy * xy AS det, n >= 3 AND xx * yy - xy * xy > 1e-9 * xx * yy AS ok FROM g),
l AS (SELECT *, CASE WHEN ok THEN (xu * yy - yu * xy) / det ELSE 1 END AS a, CASE WHEN ok THEN (yu * xx - xu * xy) / det ELSE 0 END AS b, CASE WHEN ok THEN (xv * yy - yv * xy) / det ELSE 0 END AS c, CASE WHEN ok THEN (yv * xx - xv * xy) / det ELSE 1 END AS d FROM h),
aff AS (SELECT slide_id, a, b, u - a * x - b * y AS tx, c, d, v - c * x - d * y AS ty FROM l)"""
_GLOB = f"""{LINKED}, lm AS MATERIALIZED (SELECT slide_id, id2 AS id, x1, y1, x2, y2 FROM (SELECT l.*, row_number() OVER (PARTITION BY l.slide_id, id2 ORDER BY l.distance, id1) AS rn
  FROM linked l JOIN cell_matches m USING (match_id) WHERE m.ransac_inlier) WHERE rn = 1), """ + _AFF[len(_CLOSE) + 2 :].replace("FROM k GROUP", "FROM lm GROUP")


def _local(fixed: str, moving: str, leave_out: bool = False) -> str:
    """CTE ``loc`` (slide_id, id, u, v): points ``pts`` (slide_id, id, x, y, gu, gv) by the affine of their eight nearest landmarks from
    ``moving`` to ``fixed``, or as gu, gv say."""
    cov = lambda p, q: f"s{p}{q} - s{p} * s{q} / sw"
    sums = ", ".join(f"sum(w * {p} * {q}) AS s{p}{q}" for p, q in ("aa", "ab", "bb", "au", "bu", "av", "bv"))
    return f"""nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slide_id, id ORDER BY d, lid) AS o FROM (SELECT p.slide_id, p.id, l.id AS lid, l.x{moving} - p.x AS a, l.y{moving} - p.y AS b, l.x{fixed} AS u, l.y{fixed} AS v,
    sqrt((p.x - l.x{moving}) ** 2 + (p.y - l.y{moving}) ** 2) AS d FROM pts p JOIN lm l USING (slide_id){' WHERE p.id <> l.id' if leave_out else ''})) WHERE o <= 8),
sums AS (SELECT slide_id, id, count(*) AS n, sum(w) AS sw, sum(w * a) AS sa, sum(w * b) AS sb, sum(w * u) AS su, sum(w * v) AS sv, {sums}, max(u) FILTER (WHERE o = 1 AND d <= 1e-6) AS hu, max(v) FILTER (WHERE o = 1 AND d <= 1e-6) AS hv
  FROM (SELECT *, 1 / greatest(d, 1e-6) ** 2 AS w FROM nn) GROUP BY ALL),
covs AS (SELECT *, {', '.join(f'{cov(p, q)} AS c{p}{q}' for p, q in ('aa', 'ab', 'bb', 'au', 'bu', 'av', 'bv'))} FROM sums), dets AS (SELECT *, caa * cbb - cab * cab AS det, caa * cbb - cab * cab > 1e-9 * caa * cbb AND caa * cbb - cab * cab > 0 AS ok FROM covs),
coef AS (SELECT *, CASE WHEN ok THEN (cau * cbb - cbu * cab) / det ELSE 1 END AS ca, CASE WHEN ok THEN (cbu * caa - cau * cab) / det ELSE 0 END AS cb, CASE WHEN ok THEN (cav * cbb - cbv * cab) / det ELSE 0 END AS cc, CASE WHEN ok THEN (cbv * caa - cav * cab) / det ELSE 1 END AS cd FROM dets),
loc AS (SELECT p.*, coalesce(hu, CASE WHEN n >= 3 THEN (su - ca * sa - cb * sb) / sw END, gu) AS u, coalesce(hv, CASE WHEN n >= 3 THEN (sv - cc * sa - cd * sb) / sw END, gv) AS v FROM pts p LEFT JOIN coef USING (slide_id, id))"""


_SIX = ", ".join(f"round({c}, 4) AS {c}" for c in MODEL)
_MAIN = f"""{LINKED}, bins AS (SELECT slide_id, floor(dx / 64) AS bx, floor(dy / 64) AS by_, count(*) AS n FROM linked GROUP BY ALL), mode AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY n DESC, bx, by_) AS rn FROM bins) WHERE rn = 1),
m1 AS (SELECT l.slide_id, median(dx) AS x1m, median(dy) AS y1m FROM linked l JOIN mode ON mode.slide_id = l.slide_id AND floor(dx / 64) = bx AND floor(dy / 64) = by_ GROUP BY l.slide_id),
broad AS (SELECT l.* FROM linked l JOIN m1 USING (slide_id) WHERE sqrt((dx - x1m) ** 2 + (dy - y1m) ** 2) <= 96), m2 AS (SELECT slide_id, median(dx) AS dx0, median(dy) AS dy0 FROM broad GROUP BY slide_id),
res AS (SELECT slide_id, dx0, dy0, sqrt((dx - dx0) ** 2 + (dy - dy0) ** 2) AS rr FROM broad JOIN m2 USING (slide_id)), md AS (SELECT slide_id, median(rr) AS med FROM res GROUP BY slide_id),
st AS (SELECT slide_id, any_value(dx0) AS dx0, any_value(dy0) AS dy0, greatest(5, any_value(med) + 3 * greatest(1.4826 * median(abs(rr - med)), 1)) AS limit_px FROM res JOIN md USING (slide_id) GROUP BY slide_id)"""

SQL = {
    "translation_mean": f"WITH {_CLOSE} SELECT slide_id, round(avg(dx), 6) AS tx, round(avg(dy), 6) AS ty, count(*) AS n FROM k GROUP BY slide_id",
    "translation_median": f"WITH {_CLOSE} SELECT slide_id, round(median(dx), 6) AS tx, round(median(dy), 6) AS ty, count(*) AS n FROM k GROUP BY slide_id",
    "median_offset": f"""WITH {LINKED}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY distance, match_id) AS rn FROM linked) WHERE rn <= 20), a AS (SELECT slide_id, median(dx) AS mx, median(dy) AS my FROM t GROUP BY slide_id),
b AS (SELECT slide_id, median(abs(dx - mx)) AS ax, median(abs(dy - my)) AS ay FROM t JOIN a USING (slide_id) GROUP BY slide_id)
SELECT slide_id, round(median(dx), 6) AS tx, round(median(dy), 6) AS ty, count(*) AS n FROM t JOIN a USING (slide_id) JOIN b USING (slide_id) WHERE abs(dx - mx) <= 3 * greatest(1.4826 * ax, 1) AND abs(dy - my) <= 3 * greatest(1.4826 * ay, 1) GROUP BY slide_id HAVING count(*) >= 3""",
    "main_displacement": f"WITH {_MAIN} SELECT slide_id, round(dx0, 6) AS dx0, round(dy0, 6) AS dy0, round(limit_px, 6) AS limit_px FROM st",
    "in_main_displacement": f"WITH {_MAIN} SELECT match_id, round(sqrt((dx - dx0) ** 2 + (dy - dy0) ** 2), 6) AS displacement_residual_px FROM linked JOIN st USING (slide_id) WHERE sqrt((dx - dx0) ** 2 + (dy - dy0) ** 2) <= limit_px",
    "translation_grid": f"""WITH {_CLOSE}, z AS (SELECT slide_id, max(image_width) AS w, max(image_height) AS h FROM slides GROUP BY slide_id),
kn AS (SELECT slide_id, CAST(least(3, greatest(0, floor(y1 * 4 / h))) AS INTEGER) AS ky, CAST(least(3, greatest(0, floor(x1 * 4 / w))) AS INTEGER) AS kx, median(dx) AS dx, median(dy) AS dy FROM k JOIN z USING (slide_id) GROUP BY ALL),
c AS (SELECT DISTINCT slide_id, gy, gx FROM kn, (SELECT unnest(range(4)) AS gy), (SELECT unnest(range(4)) AS gx)),
j AS (SELECT c.*, dx, dy, (gy - ky) ** 2 + (gx - kx) ** 2 AS f, row_number() OVER (PARTITION BY c.slide_id, gy, gx ORDER BY (gy - ky) ** 2 + (gx - kx) ** 2, ky, kx) AS rn FROM c JOIN kn USING (slide_id))
SELECT slide_id, CAST(gy AS INTEGER) AS gy, CAST(gx AS INTEGER) AS gx, round(dx, 6) AS dx, round(dy, 6) AS dy, f = 0 AS known FROM j WHERE rn = 1""",
    "similarity_fit": f"WITH {_SIMS} SELECT slide_id, {_SIX} FROM sim",
    "euclidean_fit": f"WITH {_EUC} SELECT slide_id, {_SIX} FROM sim",
    "local_affine": f"""WITH {_GLOB}, pts AS (SELECT m.slide_id, cell_key AS id, centroid_x AS x, centroid_y AS y, a * centroid_x + b * centroid_y + tx AS gu, c * centroid_x + d * centroid_y + ty AS gv FROM m JOIN aff USING (slide_id)), {_local('1', '2')}
SELECT id AS cell_key, round(u, 4) AS x_local, round(v, 4) AS y_local FROM loc""",
    "leave_one_out": f"""WITH {_GLOB}, pts AS (SELECT lm.slide_id, id, x2 AS x, y2 AS y, a * x2 + b * y2 + tx AS gu, c * x2 + d * y2 + ty AS gv, x1, y1 FROM lm JOIN aff USING (slide_id)), {_local('1', '2', True)}
SELECT id AS cell_key, round(sqrt((u - x1) ** 2 + (v - y1) ** 2), 4) AS residual_px FROM loc""",
    "deformation_grid_local": f"""WITH {_GLOB}, z AS (SELECT slide_id, max(image_width) AS w, max(image_height) AS h FROM slides GROUP BY slide_id),
g2 AS (SELECT slide_id, gy, gx, gx * (w - 1) / 7 AS x, gy * (h - 1) / 7 AS y, a, b, c, d, tx, ty, a * d - b * c AS det FROM z JOIN aff USING (slide_id), (SELECT unnest(range(8)) AS gy), (SELECT unnest(range(8)) AS gx)),
pts AS (SELECT slide_id, gy * 8 + gx AS id, gy, gx, x, y, (d * (x - tx) - b * (y - ty)) / det AS gu, (a * (y - ty) - c * (x - tx)) / det AS gv FROM g2 WHERE abs(det) > 1e-12), {_local('2', '1')}
SELECT slide_id, CAST(gy AS INTEGER) AS gy, CAST(gx AS INTEGER) AS gx, round(u, 4) AS moving_x_local, round(v, 4) AS moving_y_local, round(u - gu, 4) AS delta_x, round(v - gv, 4) AS delta_y FROM loc""",
    "affine_fit": f"WITH {_AFF} SELECT slide_id, {_SIX} FROM aff",
    "clipped_inliers": f"""WITH {_CLOSE}, t AS (SELECT slide_id, avg(dx) AS tx, avg(dy) AS ty FROM k GROUP BY slide_id),
p AS (SELECT k.*, sqrt((dx - tx) ** 2 + (dy - ty) ** 2) AS res, sqrt((dx - tx) ** 2 + (dy - ty) ** 2) <= 20 AS inn FROM k JOIN t USING (slide_id)),
a AS (SELECT slide_id, median(res) FILTER (WHERE inn) AS med, count(*) FILTER (WHERE inn) AS n FROM p GROUP BY slide_id),
b AS (SELECT slide_id, any_value(med) AS med, any_value(n) AS n, any_value(med) + 2 * greatest(1.4826 * median(abs(res - med)) FILTER (WHERE inn), 1e-6) AS lim FROM p JOIN a USING (slide_id) GROUP BY slide_id),
c AS (SELECT slide_id, avg(dx) AS tx, avg(dy) AS ty, count(*) AS kept FROM p JOIN b USING (slide_id) WHERE inn AND res <= lim GROUP BY slide_id),
d AS (SELECT p.*, c.kept, sqrt((dx - c.tx) ** 2 + (dy - c.ty) ** 2) AS res2, coalesce(sqrt((dx - c.tx) ** 2 + (dy - c.ty) ** 2) <= 20, false) AS inn2 FROM p LEFT JOIN c USING (slide_id)),
e AS (SELECT slide_id, any_value(kept) AS kept, median(res2) FILTER (WHERE inn2) AS med2, count(*) FILTER (WHERE inn2) AS m FROM d GROUP BY slide_id),
u AS (SELECT slide_id, lim, coalesce(n >= 12 AND kept >= 12 AND kept >= n - greatest(1, floor(0.2 * n)) AND m >= 12 AND n - m <= greatest(1, floor(0.2 * n)) AND med - med2 >= 0.1, false) AS used FROM b JOIN e USING (slide_id))
SELECT slide_id, count(*) FILTER (WHERE CASE WHEN used THEN inn2 ELSE inn END) AS inliers, round(avg(CASE WHEN used THEN res2 ELSE res END), 5) AS mean_residual, any_value(used) AS used, round(any_value(lim), 6) AS clip_limit FROM d JOIN u USING (slide_id) GROUP BY slide_id""",
    "affine_residuals": f"WITH {_AFF} SELECT match_id, round(sqrt((a * x2 + b * y2 + tx - x1) ** 2 + (c * x2 + d * y2 + ty - y1) ** 2), 4) AS residual_px FROM k JOIN aff USING (slide_id)",
    "affine_inverse": f"""WITH {_SIMS}, i AS (SELECT slide_id, d / (a * d - b * c) AS a, -b / (a * d - b * c) AS b, -c / (a * d - b * c) AS c, a / (a * d - b * c) AS d, tx AS ox, ty AS oy FROM sim),
f2 AS (SELECT *, -(a * ox + b * oy) AS tx, -(c * ox + d * oy) AS ty FROM i) SELECT slide_id, {_SIX} FROM f2""",
    "affine_compose": f"""WITH {_SIMS}, t AS (SELECT slide_id, avg(dx) AS ox, avg(dy) AS oy FROM k GROUP BY slide_id), f2 AS (SELECT slide_id, a, b, tx - ox AS tx, c, d, ty - oy AS ty FROM sim JOIN t USING (slide_id)) SELECT slide_id, {_SIX} FROM f2""",
    "moved_cells": f"WITH {_SIMS} SELECT cell_key, round(a * centroid_x + b * centroid_y + tx, 4) AS x_reg, round(c * centroid_x + d * centroid_y + ty, 4) AS y_reg FROM m JOIN sim USING (slide_id)",
    "initial_affine": f"""WITH {CELLS}, e AS (SELECT slide_id, round_no, median(centroid_x) AS cx, median(centroid_y) AS cy, greatest(quantile_cont(centroid_x, 0.99) - quantile_cont(centroid_x, 0.01), 1) AS ex, greatest(quantile_cont(centroid_y, 0.99) - quantile_cont(centroid_y, 0.01), 1) AS ey FROM placed GROUP BY ALL),
j AS (SELECT p.slide_id, least(20, greatest(0.05, p.ex / q.ex)) AS a, least(20, greatest(0.05, p.ey / q.ey)) AS d, p.cx, p.cy, q.cx AS qx, q.cy AS qy FROM e p JOIN e q USING (slide_id) WHERE p.round_no = 1 AND q.round_no = 2),
f2 AS (SELECT slide_id, a, CAST(0 AS DOUBLE) AS b, cx - a * qx AS tx, CAST(0 AS DOUBLE) AS c, d, cy - d * qy AS ty FROM j) SELECT slide_id, {_SIX} FROM f2""",
    "match_radius": f"""WITH {CELLS}, nn AS (SELECT a.slide_id, a.cell_key, min(sqrt((a.centroid_x - b.centroid_x) ** 2 + (a.centroid_y - b.centroid_y) ** 2)) AS d FROM f a JOIN f b USING (slide_id) WHERE a.cell_key <> b.cell_key GROUP BY ALL)
SELECT slide_id, round(coalesce(least(2048, greatest(64, 8 * median(d))), 256), 6) AS radius FROM (SELECT DISTINCT slide_id FROM f) LEFT JOIN nn USING (slide_id) GROUP BY slide_id""",
    "deformation_grid": f"""WITH {_SIMS}, z AS (SELECT slide_id, max(image_width) AS w, max(image_height) AS h FROM slides GROUP BY slide_id),
g2 AS (SELECT slide_id, gy, gx, gx * (w - 1) / 15 AS fx, gy * (h - 1) / 15 AS fy, a, b, c, d, tx, ty, a * d - b * c AS det FROM z JOIN sim USING (slide_id), (SELECT unnest(range(16)) AS gy), (SELECT unnest(range(16)) AS gx))
SELECT slide_id, CAST(gy AS INTEGER) AS gy, CAST(gx AS INTEGER) AS gx, round(fx, 4) AS fixed_x, round(fy, 4) AS fixed_y, round((d * (fx - tx) - b * (fy - ty)) / det, 4) AS moving_x_global, round((a * (fy - ty) - c * (fx - tx)) / det, 4) AS moving_y_global FROM g2""",
}
