"""Two-stage matching and the registrations built on it, for all groups (slides) at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoloom.functions.scalar import axis_difference_deg
from cytoloom.functions.stats import on, robust_scales, robust_standardise, z_scores
from cytoloom.operators import consensus, matching, models
from cytoloom.operators.neighbors import knn, like_pairs, mutual_least, radius_pairs, top_candidates, weighted_pairs
from cytoloom.runtime import cut

SHAPE = ["area", "eccentricity", "solidity", "hu_0"]


@dataclass
class Matching:
    """Matches (id1, id2, distance, ...), the models of each group, a row of diagnostics of each, and its spline where one
    is fitted."""

    matches: DataFrame
    models: DataFrame
    diagnostics: DataFrame
    splines: DataFrame | None = None


def with_xy(pairs: DataFrame, fixed: DataFrame, moving: DataFrame, id_col: str, x: str = "centroid_x", y: str = "centroid_y") -> DataFrame:
    """``pairs`` with x1, y1, x2, y2."""
    a = fixed.select(F.col(id_col).alias("id1"), F.col(x).alias("x1"), F.col(y).alias("y1"))
    b = moving.select(F.col(id_col).alias("id2"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    return pairs.join(a, "id1").join(b, "id2")


def fine_candidates(pairs: DataFrame, window: float, weight: float = 1.0, threshold: float | None = None, per_cell: int = 8) -> DataFrame:
    """Scored pairs with ``distance`` = score + weight x spatial / window, at most ``per_cell`` of each fixed cell."""
    c = top_candidates(pairs, [], per_cell, threshold=threshold).withColumn("distance", F.col("score") + weight * F.col("spatial") / max(window, 1e-6))
    return c if threshold is None else c.where(F.col("distance") <= threshold)


def _fine(fixed: DataFrame, moved: DataFrame, by: Sequence[str], id_col: str, cols: Sequence[str], scales: DataFrame, window: float, top_k: int, strict: bool = False) -> DataFrame:
    """One-to-one matches within the window, best first by score + spatial / window; if ``strict`` of candidates that pass
    the hard constraints."""
    fine = like_pairs(fixed, moved, by, ["centroid_x", "centroid_y"], id_col, window, cols, scales, "per_cell")
    fine = fine.withColumn("distance", F.col("score") + F.col("spatial") / max(window, 1e-6))
    if strict:
        fine = _constrained(fine, fixed, moved, id_col).select(*fine.columns)
    return cut(matching.greedy_match(fine, by, ("distance", "spatial", "id1", "id2"), top_k))


def _constrained(pairs: DataFrame, fixed: DataFrame, moving: DataFrame, id_col: str) -> DataFrame:
    return matching.hard_constraints(matching.match_report(pairs, fixed, moving, id_col, [c for c in ("area", "aspect_ratio", "orientation", "eccentricity") if c in fixed.columns]))


def _scales(fixed: DataFrame, moving: DataFrame, by: Sequence[str], cols: Sequence[str], top_k: int) -> DataFrame:
    """Robust scales, and per_cell: how many candidates of a fixed cell the fine stage compares, more in groups of so few
    fixed cells that ``top_k`` matches need more."""
    n = fixed.groupBy(*by).agg(F.count("*").alias("_n1"))
    per = F.least(F.lit(32), F.greatest(F.lit(8), F.ceil(F.lit(8 * top_k) / F.col("_n1")))).cast("int")
    return cut(on(by, robust_scales(fixed.unionByName(moving), by, list(cols)), n).withColumn("per_cell", per).drop("_n1"))


def _moved(moving: DataFrame, model: DataFrame, by: Sequence[str]) -> DataFrame:
    m = models.transform_points(moving, model, by, "centroid_x", "centroid_y")
    return cut(m.withColumns({"centroid_x": F.coalesce("x_reg", "centroid_x"), "centroid_y": F.coalesce("y_reg", "centroid_y")}).drop("x_reg", "y_reg"))


def two_stage_match(fixed: DataFrame, moving: DataFrame, by: Sequence[str], id_col: str, cols: Sequence[str] = SHAPE, coarse_window: float = 200.0, window: float = 100.0, top_k: int = 320, coarse_top_k: int = 50, coarse_threshold: float = 2.0, residual: float = 5.0, trials: int = 200, min_cells: int = 20, scales: DataFrame | None = None) -> Matching:
    """Coarse: like cells within a wide window give a translation by consensus, from the ``coarse_top_k`` likest of each
    group. Fine: in groups whose translation is accepted, moving cells are shifted and matched one to one within a narrow
    window; in the others as they lie. ``scales``: those of ``_scales``, where they are known."""
    scales = _scales(fixed, moving, by, cols, top_k) if scales is None else scales
    sizes = fixed.groupBy(*by).agg(F.count("*").alias("_n1")).join(moving.groupBy(*by).agg(F.count("*").alias("_n2")), list(by)).where((F.col("_n1") >= min_cells) & (F.col("_n2") >= min_cells))
    coarse = cut(like_pairs(fixed, moving, by, ["centroid_x", "centroid_y"], id_col, coarse_window, cols, scales, 5, coarse_threshold))
    coarse = _constrained(coarse, fixed, moving, id_col)
    place = F.row_number().over(W.partitionBy(*by).orderBy("score", "spatial", "id1", "id2"))
    coarse = on(by, coarse, sizes).withColumn("_r", place).where(F.col("_r") <= F.least(F.lit(coarse_top_k), "_n1", "_n2"))
    xy = with_xy(coarse.select(*by, "id1", "id2", "spatial", "score", F.xxhash64("id1", "id2").alias("mid")), fixed, moving, id_col)
    model, marked = models.ransac(xy, by, "mid", "translation", residual, trials)
    verdict = cut(consensus.accept_coarse(marked, by, max_residual=residual))
    good = model.join(verdict.where("accepted").select(*by), list(by), "left_semi")
    got = _fine(fixed, _moved(moving, good, by), by, id_col, cols, scales, window, top_k, strict=True)
    n = got.groupBy(*by).agg(F.count("*").alias("matches"), F.avg("distance").alias("mean_distance"))
    diagnostics = on(by, verdict, n, "full")
    return Matching(got, models.fit_translation(with_xy(got, fixed, moving, id_col), by, "median"), diagnostics)


def _upright(got: DataFrame, fixed: DataFrame, moving: DataFrame, id_col: str) -> DataFrame:
    """Matches whose orientations agree to 5 degrees where both cells have one."""
    if not {"orientation", "eccentricity"} <= set(fixed.columns):
        return got
    rep = matching.match_report(got, fixed, moving, id_col, ["orientation", "eccentricity"])
    return rep.where((F.col("eccentricity_1") < 0.15) | (F.col("eccentricity_2") < 0.15) | (axis_difference_deg("orientation_1", "orientation_2") <= 5) | F.col("orientation_1").isNull() | F.col("orientation_2").isNull()).select(*got.columns)


def _placed(got: DataFrame, fixed: DataFrame, moving: DataFrame, id_col: str) -> DataFrame:
    return cut(with_xy(got, fixed, moving, id_col).withColumns({"dx": F.col("x1") - F.col("x2"), "dy": F.col("y1") - F.col("y2"), "mid": F.xxhash64("id1", "id2")}))


def register_cells(fixed: DataFrame, moving: DataFrame, by: Sequence[str], id_col: str, cols: Sequence[str] = SHAPE, window: float = 100.0, top_k: int = 320, trials: int = 1000, threshold: float = 2.0, patches: int = 4, enough: int = 50, narrow: float = 25.0) -> Matching:
    """The whole mask registration: two-stage matches, a translation by consensus, residual filters, a second matching
    within a smaller window after it, orientation and direction checks. Groups short of ``enough`` agreeing matches are
    done again: within ``window``, then twice that, then by the main direction alone. Of these stages (0 the ``narrow``
    one, 1 to 3) each group takes the one of which most matches agree, as chance pairs grow with the window; ties go to
    the earlier. Then the final translation and, from ``enough`` matches on, a spline from moving to fixed places with
    anchors on the frame."""
    fixed, moving = cut(fixed), cut(moving)  # each is read at every step
    box = cut(fixed.groupBy(*by).agg(F.max("centroid_x").alias("_w"), F.max("centroid_y").alias("_h")))
    scales = _scales(fixed, moving, by, cols, top_k)  # a group's are the same at every stage
    cell = lambda c, e: F.least(F.lit(patches - 1), F.floor(F.col(c) * patches / F.greatest(F.col(e), F.lit(1.0)))).cast("int")

    def again(f: DataFrame, m: DataFrame, model: DataFrame, near: float) -> DataFrame:
        got = _fine(f, _moved(m, model, by), by, id_col, cols, scales, near, top_k)
        return _placed(_upright(got, f, m, id_col), f, m, id_col)

    def attempt(f: DataFrame, m: DataFrame, window: float, near: float) -> tuple[DataFrame, DataFrame]:
        first = two_stage_match(f, m, by, id_col, cols, 2 * window, window, top_k, max(24, top_k), residual=max(5.0, 2 * threshold), trials=min(max(trials, 200), 2000), min_cells=10, scales=scales).matches
        _, marked = models.ransac(with_xy(first.withColumn("mid", F.xxhash64("id1", "id2")), f, m, id_col), by, "mid", "translation", threshold, trials)
        kept = consensus.residual_filter(marked.where("ransac_inlier"), by, "residual_px", threshold)
        xy = again(f, m, cut(models.fit_translation(kept, by)), near)
        xy = on(by, xy, box).withColumns({"patch_y": cell("y1", "_h"), "patch_x": cell("x1", "_w")}).drop("_w", "_h")
        return first, cut(consensus.direction_consensus(xy, [*by, "patch_y", "patch_x"], "mid").drop("patch_y", "patch_x"))

    def support(found: DataFrame) -> DataFrame:
        """How many matches of a stage lie within two thresholds of its median displacement, and which stage has most."""
        near = models.residuals(found, models.fit_translation(found, [*by, "stage"], "median"), [*by, "stage"], "_off")
        n = near.groupBy(*by, "stage").agg(F.count_if(F.col("_off") <= 2 * threshold).alias("_n"))
        return cut(n.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), "stage")).alias("s")).select(*by, F.col("s.stage").alias("stage"), (-F.col("s.n")).alias("_n")))

    def short(found: DataFrame) -> DataFrame:
        full = support(found).where(F.col("_n") >= enough)
        return cut(fixed.select(*by).distinct().join(moving.select(*by).distinct(), list(by), "left_semi").join(full, list(by), "left_anti"))

    of = lambda t, groups: cut(t.join(groups, list(by), "left_semi"))
    at = lambda t, n: t.withColumn("stage", F.lit(n))
    found = at(attempt(fixed, moving, narrow, max(10.0, 0.6 * narrow))[1], 0)
    firsts: DataFrame | None = None
    for stage, wide, near in ((1, window, max(10.0, 0.6 * window)), (2, 2 * window, max(150.0, 1.2 * window))):
        few = short(found)
        if not few.limit(1).count():
            break
        f, m = of(fixed, few), of(moving, few)
        first, got = attempt(f, m, wide, near)
        firsts = first if firsts is None else firsts
        found = found.unionByName(at(got, stage))
    few = short(found)
    if firsts is not None and few.limit(1).count():
        f, m = of(fixed, few), of(moving, few)
        model, _ = models.ransac(with_xy(of(firsts, few).withColumn("mid", F.xxhash64("id1", "id2")), f, m, id_col), by, "mid", "translation", threshold, trials)
        main = cut(consensus.dominant_direction(again(f, m, model, max(10.0, 0.6 * window)), by, "mid"))
        three = main.groupBy(*by).count().where("count >= 3").select(*by)
        found = found.unionByName(at(main.join(three, list(by), "left_semi"), 3))
    steady = cut(found.join(support(found).drop("_n"), [*by, "stage"], "left_semi"))
    final = cut(models.fit_translation(steady, by))
    res = cut(models.residuals(steady, final, by))
    diag = on(by, final.select(*by, "tx", "ty"), res.groupBy(*by).agg(F.count("*").alias("matches"), F.median("residual_px").alias("median_residual"), F.max("stage").alias("stage")))
    many = res.join(diag.where(F.col("matches") >= enough).select(*by), list(by), "left_semi")
    ends = models.boundary_anchors(final.join(many.select(*by).distinct(), list(by), "left_semi"), box.withColumnsRenamed({"_w": "width", "_h": "height"}), by)
    pts = many.select(*by, "x1", "y1", "x2", "y2").unionByName(ends).select(*by, F.col("x2").alias("fx"), F.col("y2").alias("fy"), F.col("x1").alias("tx"), F.col("y1").alias("ty"))
    splines = cut(models.fit_spline(pts, by))  # at most top_k matches and the anchors
    there = models.spline_points(many.select(*by, F.col("mid").alias("id"), F.col("x2").alias("x"), F.col("y2").alias("y")), splines, by)
    off = there.join(many.select(*by, F.col("mid").alias("id"), "x1", "y1"), [*by, "id"]).groupBy(*by).agg(F.avg(F.sqrt(F.pow(F.col("x_spline") - F.col("x1"), 2) + F.pow(F.col("y_spline") - F.col("y1"), 2))).alias("spline_residual"))
    return Matching(res, final, on(by, diag, off, "left"), splines)


def register_centroids(fixed: DataFrame, moving: DataFrame, by: Sequence[str], rounds: int = 3, k: int = 8, power: float = 2.0, scale: DataFrame | None = None, start: DataFrame | None = None) -> Matching:
    """Whole-slide registration by centroids (by, id, x, y in level-0 pixels): a start from medians and extents, or a given
    one, refined by mutually nearest points; the moving points after the model and after the local affine are in
    ``matches``, the paired points' residuals in ``diagnostics``. Groups with fewer than three points on a side are left
    out."""
    n = fixed.groupBy(*by).agg(F.count("*").alias("n1")).join(moving.groupBy(*by).agg(F.count("*").alias("n2")), list(by)).where("n1 >= 3 and n2 >= 3").select(*by)
    fixed, moving = cut(fixed.join(n, list(by), "left_semi")), cut(moving.join(n, list(by), "left_semi"))
    start = models.initial_affine(fixed, moving, by, scale) if start is None else start
    model, pairs = models.refine_affine(fixed, moving, start, by, rounds)
    pairs = cut(pairs)
    landmarks = pairs.select(*by, F.col("id2").alias("id"), "x1", "y1", "x2", "y2")
    moved = models.local_affine(moving, landmarks, model, by, k, power)
    moved = models.transform_points(moved, model, by, "x", "y", ("x_global", "y_global"))
    diag = pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.median("residual_px").alias("median_residual"))
    return Matching(moved, model, on(by, model.select(*by, "status"), diag, "left"))


def window_sizes(height: float, width: float, window: float | None = None, coarse: float | None = None, guided: float | None = None, residual: float = 5.0) -> tuple[float, float]:
    """(guided, candidate) windows in pixels. A given size above 0 holds. Guided: else the spatial window, else four residual
    thresholds but 20 at least. Candidates: else twice the spatial window or one and a half guided ones, whichever is more;
    with no spatial window two and a half guided ones or 0.15 of the frame's longer side."""
    given = lambda v: v is not None and v > 0
    guided = guided if given(guided) else window if given(window) else max(20.0, 4 * residual)
    if given(coarse):
        return float(guided), float(coarse)
    return float(guided), max(2.0 * window, 1.5 * guided) if given(window) else max(2.5 * guided, 0.15 * max(height, width))


def match_weighted(fixed: DataFrame, moving: DataFrame, by: Sequence[str], id_col: str, features: Sequence[str], topology: Sequence[str] = (), weights: tuple[float, float, float] = (1.0, 0.0, 0.0), window: float = 100.0, top_k: int | None = 320, threshold: float | None = None) -> DataFrame:
    """One-to-one matches, least weighted distance first, of all pairs within the window."""
    c = weighted_pairs(fixed, moving, by, id_col, features, topology, weights, window, threshold)
    return matching.greedy_match(c, by, ("distance", "id1", "id2"), top_k)


#: The shape features by which slides are registered as a whole.
GLOBAL_FEATURES = ("area", "perimeter", "roundness", "eccentricity", "solidity", "major_axis_length", "minor_axis_length")


def register_by_features(fixed: DataFrame, moving: DataFrame, by: Sequence[str], id_col: str, cols: Sequence[str] = GLOBAL_FEATURES, k: int = 5, threshold: float = 2.0, trials: int = 2000, samples: int = 3) -> Matching:
    """A translation of whole slides: every moving cell votes with its ``k`` fixed cells nearest in standardised feature space,
    and consensus over them settles the shift. Groups with fewer than ``samples`` candidates, or none of whose trials has
    three that agree, have no model; cells that miss a feature don't vote."""
    both = fixed.select(*by, id_col, *cols, F.lit(1).alias("_s")).unionByName(moving.select(*by, id_col, *cols, F.lit(2).alias("_s")))
    z = cut(z_scores(both, by, list(cols)))
    near = knn(z.where("_s = 2"), z.where("_s = 1"), by, list(cols), id_col, k)
    pairs = near.select(*by, F.col("neighbour").alias("id1"), F.col("id").alias("id2"), "distance")
    xy = cut(with_xy(pairs, fixed, moving, id_col).withColumn("mid", F.xxhash64("id1", "id2")))
    model, marked = models.ransac(xy, by, "mid", "translation", threshold, trials, samples)
    n = marked.groupBy(*by).agg(F.count("*").alias("candidates"), F.count_if("ransac_inlier").alias("inliers"), F.max("residual_px").alias("_far"))
    # a group without consensus keeps all
    enough = cut(n.where((F.col("candidates") >= samples) & ((F.col("inliers") < F.col("candidates")) | (F.col("_far") <= 2 * threshold))).drop("_far"))
    return Matching(marked, model.join(enough.select(*by), list(by), "left_semi"), enough)


def find_landmarks(fixed: DataFrame, moving: DataFrame, by: Sequence[str], id_col: str, cols: Sequence[str] = SHAPE, top_k: int = 320, k: int = 20, profile_k: int = 8, max_profile: float = 0.35, max_deg: float = 2.0, orientation_deg: float = 10.0, min_eccentricity: float = 0.15, grid: int = 4) -> DataFrame:
    """Landmarks between slides whose shift is not known: nearest in robust feature space, then those whose displacement
    goes with the fullest bin, on lines not too long, one to one, of like orientation and like surroundings, spread over a
    grid. Groups of which fewer than three are left at any step come out empty-handed."""
    fixed, moving = cut(fixed), cut(moving)  # each is read at every step
    both = fixed.withColumn("_s", F.lit(1)).unionByName(moving.withColumn("_s", F.lit(2)))
    z = cut(robust_standardise(both.select(*by, id_col, "_s", *cols), by, list(cols)))
    near = knn(z.where("_s = 1"), z.where("_s = 2"), by, list(cols), id_col, k)
    xy = cut(with_xy(near.select(*by, F.col("id").alias("id1"), F.col("neighbour").alias("id2"), "distance"), fixed, moving, id_col).withColumns({"dx": F.col("x1") - F.col("x2"), "dy": F.col("y1") - F.col("y2")}))
    main, marked = models.main_displacement(xy, by)
    kept = cut(consensus.parallel_displacements(marked, main, by, max_deg, pass_short=True))
    kept = consensus.short_lines(kept, by)
    got = matching.greedy_match(kept, by, ("displacement_residual_px", "distance", "id1", "id2"))
    if {"orientation", "eccentricity"} <= set(fixed.columns):
        rep = matching.match_report(got, fixed, moving, id_col, ["orientation", "eccentricity"])
        got = rep.withColumn("orientation_diff_deg", axis_difference_deg("orientation_1", "orientation_2")).where((F.col("eccentricity_1") < min_eccentricity) | (F.col("eccentricity_2") < min_eccentricity) | (F.col("orientation_diff_deg") <= orientation_deg))
    got = cut(got)
    near = cut(knn(both, None, [*by, "_s"], ["centroid_x", "centroid_y"], id_col, profile_k))
    near1, near2 = (near.where(F.col("_s") == s).drop("_s") for s in (1, 2))
    got = matching.neighbour_profile(near1, near2, fixed, moving, got, id_col, profile_k).where(F.col("neighbor_profile_diff") <= max_profile)
    enough = got.groupBy(*by).agg(F.count("*").alias("_n")).where("_n >= 3")
    got = cut(on(by, got, enough).drop("_n"))
    size = fixed.groupBy(*by).agg(F.greatest(F.max("centroid_x"), F.lit(1.0)).alias("_w"), F.greatest(F.max("centroid_y"), F.lit(1.0)).alias("_h"))
    cell = lambda c, e: F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor(F.col(c) * grid / F.col(e)))).cast("int")
    got = on(by, got, size).withColumns({"wsi_grid_x": cell("x1", "_w"), "wsi_grid_y": cell("y1", "_h")}).drop("_w", "_h")
    return matching.grid_covered(got, by, "wsi_grid_x", "wsi_grid_y", grid, top_k, ("displacement_residual_px", "distance", "id1", "id2"))


def match_locally(fixed: DataFrame, moving: DataFrame, coarse: DataFrame, by: Sequence[str], id_col: str, radius: float = 45.0, k: int = 8, max_profile: float = 0.42, max_area_ratio: float = 2.5, top_k: int = 320) -> DataFrame:
    """Pairs after a coarse model that cost both their cells least: profile difference + 0.2 ln(area ratio) + 0.002 x the
    distance left."""
    moved = cut(models.transform_points(moving, coarse, by, "centroid_x", "centroid_y").where("x_reg is not null"))
    pairs = radius_pairs(fixed, moved, by, ["centroid_x", "centroid_y"], id_col, radius, ["x_reg", "y_reg"])
    near1, near2 = (cut(knn(t, None, by, ["centroid_x", "centroid_y"], id_col, k)) for t in (fixed, moving))
    p = matching.neighbour_profile(near1, near2, fixed, moving, pairs, id_col, k)
    p = matching.match_report(p, fixed, moving, id_col, ["area"])
    ratio = F.greatest("area_1", "area_2") / F.greatest(F.least("area_1", "area_2"), F.lit(1.0))
    p = p.withColumn("area_ratio", ratio).where((F.col("neighbor_profile_diff") <= max_profile) & (F.col("area_ratio") <= max_area_ratio))
    p = cut(p.withColumn("distance", F.col("neighbor_profile_diff") + 0.20 * F.ln("area_ratio") + 0.002 * F.col("spatial")))
    best = mutual_least(p, by, "distance")
    return best.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("distance", "id1", "id2"))).where(F.col("_r") <= max(3, top_k)).drop("_r")


def register_sparse(fixed: DataFrame, moving: DataFrame, coarse: DataFrame, by: Sequence[str], id_col: str, threshold: float = 3.0, trials: int = 5000) -> Matching:
    """Registration of sparsely stained slides: local matches after the coarse model, then a rotation and shift by consensus
    over three samples."""
    m = match_locally(fixed, moving, coarse, by, id_col)
    xy = cut(with_xy(m.withColumn("mid", F.xxhash64("id1", "id2")), fixed, moving, id_col))
    model, marked = models.ransac(xy, by, "mid", "euclidean", threshold, trials, samples=3)
    diag = marked.groupBy(*by).agg(F.count("*").alias("matches"), F.count_if("ransac_inlier").alias("inliers"))
    return Matching(marked, model, diag)


def register_landmarks(landmarks: DataFrame, by: Sequence[str], id_col: str, model: str = "similarity", threshold: float = 5.0, trials: int = 100, refine: bool = True, allow_scale: bool = False) -> Matching:
    """Registration from given pairs (by, id, x1, y1, x2, y2): consensus, then the refinement that keeps neighbour distances."""
    m, marked = models.ransac(landmarks, by, id_col, model, threshold, trials)
    marked = cut(marked)
    if refine and model in ("euclidean", "similarity"):
        m = models.refine_with_neighbours(marked.where("ransac_inlier"), m, by, id_col, scale=allow_scale)
        marked = models.residuals(marked, m, by)
    diag = marked.groupBy(*by).agg(F.count_if("ransac_inlier").alias("inliers"), F.median("residual_px").alias("median_residual"))
    return Matching(marked, m, diag)
