"""Transforms between slides, one per group, as a table of six numbers: x' = a x + b y + tx, y' = c x + d y + ty.

Fits are grouped sums with closed forms on top; only what can't be summed (trials, splines) runs in Python, and then
chunk by chunk, so that no group has to fit a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoloom.functions.scalar import clip
from cytoloom.functions.stats import MAD, keep_robust, medians, on, robust_extents
from cytoloom.operators.neighbors import _key_columns, knn, mutual_nearest
from cytoloom.runtime import column, cut, map_groups, usable

MODEL = ["a", "b", "tx", "c", "d", "ty"]


def require_matches(matches: DataFrame, least: int = 1) -> DataFrame:
    """Raises where there are too few matches to fit anything."""
    n = matches.limit(least).count()
    if n == 0:
        raise ValueError("No matches to fit a transform to")
    if n < least:
        raise ValueError(f"{n} matches, but a transform needs at least {least}")
    return matches


# -- apply, invert, compose --------------------------------------------------------------------------------------


def apply_xy(x: Column | str, y: Column | str, prefix: str = "") -> tuple[Column, Column]:
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    m = {c: F.col(prefix + c) for c in MODEL}
    return m["a"] * x + m["b"] * y + m["tx"], m["c"] * x + m["d"] * y + m["ty"]


def inverse_columns(prefix: str = "") -> dict[str, Column]:
    """The inverse's six numbers; null where there is none."""
    m = {c: F.col(prefix + c) for c in MODEL}
    det = m["a"] * m["d"] - m["b"] * m["c"]
    det = F.when(F.abs(det) > 1e-12, det)
    a, b, c, d = m["d"] / det, -m["b"] / det, -m["c"] / det, m["a"] / det
    return {"a": a, "b": b, "tx": -(a * m["tx"] + b * m["ty"]), "c": c, "d": d, "ty": -(c * m["tx"] + d * m["ty"])}


def invert(models: DataFrame) -> DataFrame:
    inv = inverse_columns()
    return models.select(*[c for c in models.columns if c not in MODEL], *[inv[c].alias(c) for c in MODEL])


def compose(first: DataFrame, then: DataFrame, by: Sequence[str]) -> DataFrame:
    """The model that applies ``first`` and then ``then``."""
    p = first.select(*by, *[F.col(c).alias(f"p_{c}") for c in MODEL])
    j = on(by, p, then.select(*by, *[F.col(c).alias(f"q_{c}") for c in MODEL]))
    f = lambda q, c: F.col(f"{q}_{c}")
    out = {
        "a": f("q", "a") * f("p", "a") + f("q", "b") * f("p", "c"), "b": f("q", "a") * f("p", "b") + f("q", "b") * f("p", "d"), "tx": f("q", "a") * f("p", "tx") + f("q", "b") * f("p", "ty") + f("q", "tx"),
        "c": f("q", "c") * f("p", "a") + f("q", "d") * f("p", "c"), "d": f("q", "c") * f("p", "b") + f("q", "d") * f("p", "d"), "ty": f("q", "c") * f("p", "tx") + f("q", "d") * f("p", "ty") + f("q", "ty"),
    }
    return j.select(*by, *[out[c].alias(c) for c in MODEL])


def transform_points(points: DataFrame, models: DataFrame, by: Sequence[str], x: str, y: str, out: tuple[str, str] = ("x_reg", "y_reg")) -> DataFrame:
    """``points`` with their place after their group's transform; null where a group has none."""
    j = on(by, points, models.select(*by, *[F.col(c).alias(f"_m_{c}") for c in MODEL]), "left")
    px, py = apply_xy(x, y, "_m_")
    return j.withColumn("_px", px).withColumn("_py", py).drop(*[f"_m_{c}" for c in MODEL], *out).withColumnsRenamed({"_px": out[0], "_py": out[1]})


def translation_model(tx: Column, ty: Column) -> list[Column]:
    one, zero = F.lit(1.0), F.lit(0.0)
    return [c.alias(n) for n, c in zip(MODEL, (one, zero, tx, zero, one, ty))]


# -- fits from moving (x2, y2) to fixed (x1, y1) -----------------------------------------------------------------


def fit_translation(matches: DataFrame, by: Sequence[str], how: str = "mean") -> DataFrame:
    """Mean or median displacement of each group."""
    f = F.avg if how == "mean" else F.median
    g = matches.groupBy(*by).agg(f(F.col("x1") - F.col("x2")).alias("_tx"), f(F.col("y1") - F.col("y2")).alias("_ty"), F.count("*").alias("n"))
    return g.select(*by, *translation_model(F.col("_tx"), F.col("_ty")), "n")


def _sums(matches: DataFrame, by: Sequence[str], weight: Column | None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    t = {"w": w, "x": w * F.col("x2"), "y": w * F.col("y2"), "u": w * F.col("x1"), "v": w * F.col("y1")}
    for p, q in ("xx", "xy", "yy", "xu", "xv", "yu", "yv"):
        t[p + q] = w * F.col({"x": "x2", "y": "y2", "u": "x1", "v": "y1"}[p]) * F.col({"x": "x2", "y": "y2", "u": "x1", "v": "y1"}[q])
    return matches.groupBy(*by).agg(*[F.sum(v).alias(f"s_{k}") for k, v in t.items()], F.count("*").alias("n"))


def fit_similarity(matches: DataFrame, by: Sequence[str], scale: bool = True, weight: Column | None = None) -> DataFrame:
    """Least-squares rotation, shift and, with ``scale``, one factor. Groups whose points all coincide get a shift."""
    g = _sums(matches, by, weight)
    s = lambda c: F.col(f"s_{c}")
    cov = lambda p, q: s(p + q) - s(p) * s(q) / s("w")
    re, im = cov("x", "u") + cov("y", "v"), cov("x", "v") - cov("y", "u")
    den = cov("x", "x") + cov("y", "y") if scale else F.sqrt(re * re + im * im)
    ok = den > 1e-12
    co, si = F.when(ok, re / den).otherwise(1.0), F.when(ok, im / den).otherwise(0.0)
    g = g.withColumns({"_co": co, "_si": si})
    tx = (s("u") - F.col("_co") * s("x") + F.col("_si") * s("y")) / s("w")
    ty = (s("v") - F.col("_si") * s("x") - F.col("_co") * s("y")) / s("w")
    return g.select(*by, F.col("_co").alias("a"), (-F.col("_si")).alias("b"), tx.alias("tx"), F.col("_si").alias("c"), F.col("_co").alias("d"), ty.alias("ty"), "n")


def fit_affine(matches: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Weighted least-squares affine from centred normal equations, solved in closed form. Groups of fewer than three
    matches, or on one line, get the (weighted mean) shift."""
    g = _sums(matches, by, weight)
    s = lambda c: F.col(f"s_{c}")
    cov = lambda p, q: s(p + q) - s(p) * s(q) / s("w")
    g = g.withColumns({f"_{p}{q}": cov(p, q) for p, q in ("xx", "xy", "yy", "xu", "xv", "yu", "yv")})
    c = lambda n: F.col(f"_{n}")
    det = c("xx") * c("yy") - c("xy") * c("xy")
    g = g.withColumn("_ok", (F.col("n") >= 3) & (det > 1e-9 * c("xx") * c("yy")) & (det > 0)).withColumn("_det", det)
    pick = lambda v, other: F.when(F.col("_ok"), v / F.col("_det")).otherwise(F.lit(other))
    g = g.withColumns({
        "a": pick(c("xu") * c("yy") - c("yu") * c("xy"), 1.0), "b": pick(c("yu") * c("xx") - c("xu") * c("xy"), 0.0),
        "c": pick(c("xv") * c("yy") - c("yv") * c("xy"), 0.0), "d": pick(c("yv") * c("xx") - c("xv") * c("xy"), 1.0),
    })
    tx = (s("u") - F.col("a") * s("x") - F.col("b") * s("y")) / s("w")
    ty = (s("v") - F.col("c") * s("x") - F.col("d") * s("y")) / s("w")
    return g.select(*by, "a", "b", tx.alias("tx"), "c", "d", ty.alias("ty"), "n")


FITS: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]] = {
    "translation": fit_translation,
    "euclidean": lambda m, by: fit_similarity(m, by, scale=False),
    "similarity": fit_similarity,
    "affine": fit_affine,
}


def residuals(matches: DataFrame, models: DataFrame, by: Sequence[str], out: str = "residual_px") -> DataFrame:
    """``matches`` with the distance of each moved point from its fixed one."""
    j = on(by, matches.drop(out), models.select(*by, *[F.col(c).alias(f"_m_{c}") for c in MODEL]), "left")
    px, py = apply_xy("x2", "y2", "_m_")
    return j.withColumn(out, F.sqrt(F.pow(px - F.col("x1"), 2) + F.pow(py - F.col("y1"), 2))).drop(*[f"_m_{c}" for c in MODEL])


# -- chunks of a group beside its side table ---------------------------------------------------------------------


def map_chunks(rows: DataFrame, side: DataFrame, by: Sequence[str], id_col: str, fn: Callable[[pa.Table, pa.Table], pa.Table | None], schema: str, per_chunk: int = 20_000, counted: bool = False) -> DataFrame:
    """Call ``fn(rows, side)`` on chunks of at most about ``per_chunk`` rows of each group, beside all of the group's rows
    of ``side``, which must be bounded. The two may not share columns other than ``by``. A side table goes to each
    chunk of its group and no further; groups without one are left out. If ``counted`` it has ``_chunks``, how many its group has."""
    n = rows.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / per_chunk)).cast("int").alias("_n"))
    chunked = on(by, rows, n).withColumn("_chunk", F.pmod(F.xxhash64(id_col), F.col("_n")).cast("int")).drop("_n").withColumn("_is_side", F.lit(False))
    spread = on(by, side, n).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_is_side", F.lit(True))
    spread = spread.withColumnRenamed("_n", "_chunks") if counted else spread.drop("_n")
    both = chunked.unionByName(spread, allowMissingColumns=True)
    row_cols, side_cols = list(rows.columns), [*side.columns, *["_chunks"] * counted]

    def run(t: pa.Table) -> pa.Table | None:
        at = column(t, "_is_side").astype(bool)
        if at.all() or not at.any():
            return None
        return fn(t.filter(pa.array(~at)).select(row_cols).combine_chunks(), t.filter(pa.array(at)).select(side_cols).combine_chunks())

    return map_groups(both, [*by, "_chunk"], run, schema)


# -- random sample consensus -------------------------------------------------------------------------------------

SAMPLES = {"translation": 2, "euclidean": 2, "similarity": 2, "affine": 3}


def _solve(model: str, m: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Models of many small samples at once: ``m``, ``f`` are (trials, points, 2); gives (trials, 6), NaN if degenerate."""
    mc, fc = m.mean(1), f.mean(1)
    dm, df = m - mc[:, None], f - fc[:, None]
    out = np.full((len(m), 6), np.nan)
    if model == "translation":
        a, b, c, d = np.ones(len(m)), np.zeros(len(m)), np.zeros(len(m)), np.ones(len(m))
    elif model in ("euclidean", "similarity"):
        re, im = (dm * df).sum((1, 2)), (dm[..., 0] * df[..., 1] - dm[..., 1] * df[..., 0]).sum(1)
        den = (dm**2).sum((1, 2)) if model == "similarity" else np.hypot(re, im)
        with np.errstate(all="ignore"):
            a, c = re / den, im / den
        b, d = -c, a
    else:
        xx, xy, yy = (dm[..., 0] ** 2).sum(1), (dm[..., 0] * dm[..., 1]).sum(1), (dm[..., 1] ** 2).sum(1)
        det = np.where(np.abs(xx * yy - xy * xy) > 1e-9, xx * yy - xy * xy, np.nan)
        xu, yu = (dm[..., 0] * df[..., 0]).sum(1), (dm[..., 1] * df[..., 0]).sum(1)
        xv, yv = (dm[..., 0] * df[..., 1]).sum(1), (dm[..., 1] * df[..., 1]).sum(1)
        a, b, c, d = (xu * yy - yu * xy) / det, (yu * xx - xu * xy) / det, (xv * yy - yv * xy) / det, (yv * xx - xv * xy) / det
    out[:, 0], out[:, 1], out[:, 3], out[:, 4] = a, b, c, d
    out[:, 2] = fc[:, 0] - a * mc[:, 0] - b * mc[:, 1]
    out[:, 5] = fc[:, 1] - c * mc[:, 0] - d * mc[:, 1]
    return out


def ransac(matches: DataFrame, by: Sequence[str], id_col: str, model: str = "translation", threshold: float = 2.0, trials: int = 1000, samples: int | None = None, min_inliers: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(models, matches with ransac_inlier and residual_px).

    Trials are samples of the whole group: of as many matches as all trials need, those of least id hash, each trial takes
    its own; in smaller groups trials share them. Every match votes on every trial, chunk by chunk. The trial with most matches within ``threshold`` wins, then the one of smaller residual
    sum, then the earlier. The model is fitted again to its inliers; a group with too few keeps all its matches. The
    same seed gives the same models. Groups with fewer matches than a sample needs are fitted to all they have."""
    need = samples or SAMPLES[model]
    m = matches.where(" and ".join(f"{c} is not null and not isnan({c})" for c in ("x1", "y1", "x2", "y2")))
    m = cut(m)
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.xxhash64(id_col), id_col))
    drawn = m.select(*by, id_col, "x1", "y1", "x2", "y2").withColumn("_p", place).where(F.col("_p") <= trials * need).drop("_p")
    keys = _key_columns(m, by) if by else "_all int, "
    group = list(by) or ["_all"]
    if not by:
        m, drawn = m.withColumn("_all", F.lit(0)), drawn.withColumn("_all", F.lit(0))

    def propose(t: pa.Table) -> pa.Table | None:
        if len(t) < need:
            return None
        rng = np.random.default_rng(seed)
        if len(t) >= trials * need:
            i = rng.permutation(trials * need).reshape(trials, need)
        else:
            i = np.argsort(rng.random((trials, len(t))), axis=1)[:, :need] if len(t) <= 64 else rng.integers(0, len(t), (trials, need))
        f, mv = (np.column_stack([column(t, c) for c in cs])[i] for cs in (("x1", "y1"), ("x2", "y2")))
        got = _solve(model, mv, f)
        return pa.table({**{g: t.column(g).slice(0, 1) for g in group}, "trials": pa.ListArray.from_arrays(pa.array([0, got.size], pa.int32()), pa.array(got.ravel()))})

    hyp = map_groups(drawn, group, propose, keys + "trials array<double>", sort=[id_col])

    def vote(rows: pa.Table, side: pa.Table) -> pa.Table:
        p = side.column("trials").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 6)
        x, y, u, v = (column(rows, c)[None, :] for c in ("x2", "y2", "x1", "y1"))
        n, s = np.zeros(len(p), np.int64), np.zeros(len(p))
        for a in range(0, len(p), 64):
            q = p[a : a + 64, :, None]
            r = np.hypot(x + q[:, 2] - u, y + q[:, 5] - v) if model == "translation" else np.hypot(q[:, 0] * x + q[:, 1] * y + q[:, 2] - u, q[:, 3] * x + q[:, 4] * y + q[:, 5] - v)
            ok = r <= threshold
            n[a : a + 64], s[a : a + 64] = ok.sum(1), np.where(ok, r, 0).sum(1)
        trial = np.arange(len(p), dtype=np.int32)
        if side.column("_chunks")[0].as_py() == 1:  # no other chunk votes: only the best is sent
            trial = np.lexsort((trial, s, -n))[:1].astype(np.int32)
            p, n, s = p[trial], n[trial], s[trial]
        return pa.table({**{g: rows.column(g).take(pa.array(np.zeros(len(p), np.int64))) for g in group}, "trial": trial, "votes": n, "total": s, **{c: p[:, i] for i, c in enumerate(MODEL)}})

    votes = map_chunks(m.select(*group, id_col, "x1", "y1", "x2", "y2"), hyp, group, id_col, vote, keys + "trial int, votes long, total double, " + ", ".join(f"{c} double" for c in MODEL), counted=True)
    best = votes.groupBy(*group, "trial").agg(F.sum("votes").alias("votes"), F.sum("total").alias("total"), *[F.first(c).alias(c) for c in MODEL])
    best = best.groupBy(*group).agg(F.min(F.struct((-F.col("votes")).alias("v"), "total", "trial", *MODEL)).alias("s")).select(*group, F.col("s.v").alias("_v"), *[F.col(f"s.{c}").alias(c) for c in MODEL])
    marked = on(group, residuals(m, best, group), best.select(*group, (-F.col("_v") >= min_inliers).alias("_enough")), "left")
    marked = cut(marked.withColumn("ransac_inlier", ~F.coalesce("_enough", F.lit(False)) | (F.col("residual_px") <= threshold)).drop("_enough"))
    final = cut(FITS[model](marked.where("ransac_inlier"), group))
    marked = residuals(marked, final, group)
    return (final, marked) if by else (final.drop("_all"), marked.drop("_all"))


def clip_inliers(marked: DataFrame, models: DataFrame, by: Sequence[str], model: str = "translation", threshold: float = 2.0, mad_factor: float = 3.0, min_inliers: int = 12, max_drop: float = 0.2, min_gain: float = 0.1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, matches, diagnostics): inliers (x1, y1, x2, y2, ransac_inlier, residual_px) farther off than median + mad_factor x
    max(1.4826 MAD, 1e-6) are left out, the model is fitted again to the others, and matches within ``threshold`` of it are
    the inliers.

    A group takes the new model only if it had at least ``min_inliers``, keeps and comes out with as many, loses no more than
    the share ``max_drop`` of them (or one) at either step, and the median residual of inliers falls by ``min_gain``; else it
    stays as it is. ``diagnostics``: by, used, clip_limit, kept, median_before, median_after (null where not refitted)."""
    marked = cut(marked)
    inl = marked.where("ransac_inlier")
    st = on(by, inl.groupBy(*by).agg(F.median("residual_px").alias("median_before"), F.count("*").alias("_n")), marked.groupBy(*by).agg(F.lit(1).alias("_")), "right" if by else "left")
    dev = on(by, inl, st).groupBy(*by).agg(F.median(F.abs(F.col("residual_px") - F.col("median_before"))).alias("_mad"))
    st = on(by, st, dev, "left").withColumn("clip_limit", F.col("median_before") + mad_factor * F.greatest(MAD * F.col("_mad"), F.lit(1e-6)))
    st = st.withColumn("_drop", F.greatest(F.lit(1), F.floor(F.col("_n") * max_drop)))
    seed = on(by, inl, st.select(*by, "clip_limit")).where(F.col("residual_px") <= F.col("clip_limit")).drop("clip_limit")
    st = on(by, st, seed.groupBy(*by).agg(F.count("*").alias("kept")), "left")
    fitted = cut(FITS[model](seed, by))
    again = cut(residuals(marked, fitted, by, "_res").withColumn("_in", F.coalesce(F.col("_res") <= threshold, F.lit(False))))
    after = again.where("_in").groupBy(*by).agg(F.median("_res").alias("median_after"), F.count("*").alias("_m"))
    st = on(by, st, after, "left")
    least = max(3, min_inliers)
    used = (F.lit(mad_factor > 0) & (F.col("_n") >= least) & (F.col("kept") >= least) & (F.col("kept") >= F.col("_n") - F.col("_drop")) & (F.col("_m") >= least)
            & (F.col("_n") - F.col("_m") <= F.col("_drop")) & (F.col("median_before") - F.col("median_after") >= min_gain))
    st = cut(st.withColumn("used", F.coalesce(used, F.lit(False))))
    flag = st.select(*by, "used")
    matches = on(by, again, flag).withColumns({"ransac_inlier": F.when(F.col("used"), F.col("_in")).otherwise(F.col("ransac_inlier")), "residual_px": F.when(F.col("used"), F.col("_res")).otherwise(F.col("residual_px"))}).select(*marked.columns)
    cols = [*by, *MODEL]
    final = on(by, models, flag).where("not used").select(*cols).unionByName(on(by, fitted, flag).where("used").select(*cols))
    return final, matches, st.select(*by, "used", "clip_limit", "kept", "median_before", "median_after")


# -- offsets, displacement modes, grids --------------------------------------------------------------------------


def median_offset(matches: DataFrame, by: Sequence[str], id_cols: Sequence[str], best: int = 20, least: int = 3, floor: float = 1.0) -> DataFrame:
    """Median displacement of the ``best`` matches of least distance of each group, after those off the median by more
    than three robust deviations on either axis are left out. Groups of fewer than ``least`` matches give none."""
    r = F.row_number().over(W.partitionBy(*by).orderBy("distance", *id_cols))
    top = matches.withColumn("_r", r).where(F.col("_r") <= best).withColumns({"_dx": F.col("x1") - F.col("x2"), "_dy": F.col("y1") - F.col("y2")})
    med = medians(top, by, ["_dx", "_dy"])
    dev = on(by, top, med).withColumns({"_ax": F.abs(F.col("_dx") - F.col("median__dx")), "_ay": F.abs(F.col("_dy") - F.col("median__dy"))})
    mad = medians(dev, by, ["_ax", "_ay"], "mad_")
    ok = on(by, dev, mad).where((F.col("_ax") <= 3 * F.greatest(MAD * F.col("mad__ax"), F.lit(floor))) & (F.col("_ay") <= 3 * F.greatest(MAD * F.col("mad__ay"), F.lit(floor))))
    return ok.groupBy(*by).agg(F.median("_dx").alias("tx"), F.median("_dy").alias("ty"), F.count("*").alias("n")).where(F.col("n") >= least)


def main_displacement(matches: DataFrame, by: Sequence[str], bin_px: float = 512.0, broad_px: float = 768.0, floor_px: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """(one row per group with dx0, dy0 and the limit; matches with displacement_residual_px and in_main).

    ``matches`` has dx, dy. The fullest bin (ties: least bin_x, bin_y) gives a first median; those within ``broad_px`` of it
    a second; the limit is the greater of ``floor_px`` and median + 3 robust deviations of their residuals."""
    off = lambda x, y: F.sqrt(F.pow(F.col("dx") - F.col(x), 2) + F.pow(F.col("dy") - F.col(y), 2))
    spread: list[DataFrame] = []
    m = matches.select(*by, "dx", "dy")
    if by:
        far = F.count_if(~(usable("dx") & usable("dy") & (F.abs("dx") < 1e15) & (F.abs("dy") < 1e15)))
        whole = cut(m.groupBy(*by).agg(((F.count("*") <= MODES_WHOLE) & (far == 0)).alias("_whole")))
        spread.append(_whole_modes(m.join(whole.where("_whole"), list(by), "left_semi"), by, bin_px, broad_px, floor_px))
        rest = whole.where("not _whole").select(*by)
        m = m.join(rest, list(by), "left_semi")
    if not by or rest.limit(1).count():
        spread.append(_spread_modes(m, by, bin_px, broad_px, floor_px))
    st = cut(reduce(DataFrame.unionByName, spread))  # a row a group, read by both results
    marked = on(by, matches, st).withColumn("displacement_residual_px", off("dx0", "dy0")).withColumn("in_main", F.col("displacement_residual_px") <= F.col("limit_px")).drop("dx0", "dy0", "limit_px")
    return st, marked


#: Matches of a group whose main displacement one task finds.
MODES_WHOLE = 2_000_000


def _whole_modes(m: DataFrame, by: Sequence[str], bin_px: float, broad_px: float, floor_px: float) -> DataFrame:
    """The main displacements of groups that fit a task (by, dx, dy, all finite)."""

    def mode(t: pa.Table) -> pa.Table | None:
        dx, dy = column(t, "dx"), column(t, "dy")
        _, bx = np.unique(np.floor(dx / bin_px), return_inverse=True)
        _, by_ = np.unique(np.floor(dy / bin_px), return_inverse=True)
        bins, n = np.unique(bx * (by_.max() + 1) + by_, return_counts=True)
        full = bx * (by_.max() + 1) + by_ == bins[n.argmax()]
        away = lambda x, y: np.sqrt((dx - x) ** 2 + (dy - y) ** 2)
        broad = away(np.median(dx[full]), np.median(dy[full])) <= broad_px
        if not broad.any():
            return None
        x, y = np.median(dx[broad]), np.median(dy[broad])
        r = away(x, y)[broad]
        limit = max(floor_px, np.median(r) + 3 * max(MAD * np.median(np.abs(r - np.median(r))), 1.0))
        return pa.table({**{g: t.column(g).slice(0, 1) for g in by}, "dx0": [x], "dy0": [y], "limit_px": [limit]})

    m = m.select(*by, F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy"))
    return map_groups(m, list(by), mode, _key_columns(m, by) + "dx0 double, dy0 double, limit_px double")


def _spread_modes(m: DataFrame, by: Sequence[str], bin_px: float, broad_px: float, floor_px: float) -> DataFrame:
    """The same of groups of any size."""
    m = m.withColumns({"_bx": F.floor(F.col("dx") / bin_px), "_by": F.floor(F.col("dy") / bin_px)})
    counts = m.groupBy(*by, "_bx", "_by").agg(F.count("*").alias("n"))
    mode = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "_bx", "_by")).alias("s")).select(*by, F.col("s._bx").alias("_bx"), F.col("s._by").alias("_by"))
    m1 = m.join(mode, [*by, "_bx", "_by"], "left_semi").groupBy(*by).agg(F.median("dx").alias("_x1"), F.median("dy").alias("_y1"))
    off = lambda x, y: F.sqrt(F.pow(F.col("dx") - F.col(x), 2) + F.pow(F.col("dy") - F.col(y), 2))
    broad = on(by, m, m1).where(off("_x1", "_y1") <= broad_px)
    m2 = broad.groupBy(*by).agg(F.median("dx").alias("dx0"), F.median("dy").alias("dy0"))
    r = on(by, broad, m2).withColumn("_r", off("dx0", "dy0")).select(*by, "_r")
    med = medians(r, by, ["_r"])
    mad = medians(on(by, r, med).select(*by, F.abs(F.col("_r") - F.col("median__r")).alias("_r")), by, ["_r"], "mad_")
    st = on(by, on(by, m2, med), mad)
    return st.select(*by, "dx0", "dy0", F.greatest(F.lit(floor_px), F.col("median__r") + 3 * F.greatest(MAD * F.col("mad__r"), F.lit(1.0))).alias("limit_px"))


def translation_grid(matches: DataFrame, by: Sequence[str], width: Column, height: Column, grid: int = 4) -> DataFrame:
    """(by, gy, gx, dx, dy, known): the median displacement of each of grid x grid cells by fixed position; an empty cell
    takes that of the nearest known one (squared grid distance, then row, then column)."""
    cell = lambda c, e: F.least(F.lit(grid - 1), F.greatest(F.lit(0), F.floor(F.col(c) * grid / e))).cast("int")
    known = matches.groupBy(*by, cell("y1", height).alias("gy"), cell("x1", width).alias("gx")).agg(F.median("dx").alias("dx"), F.median("dy").alias("dy"))
    axis = F.sequence(F.lit(0), F.lit(grid - 1))
    cells = known.select(*by).distinct().withColumn("gy", F.explode(axis)).withColumn("gx", F.explode(axis))
    far = F.pow(F.col("gy") - F.col("_ky"), 2) + F.pow(F.col("gx") - F.col("_kx"), 2)
    k = known.withColumnsRenamed({"gy": "_ky", "gx": "_kx"})
    j = cells.join(k, list(by)) if by else cells.join(F.broadcast(k), F.lit(True))  # grid x grid rows
    best = j.groupBy(*by, "gy", "gx").agg(F.min(F.struct(far.alias("f"), "_ky", "_kx", "dx", "dy")).alias("s"))
    return best.select(*by, "gy", "gx", "s.dx", "s.dy", (F.col("s.f") == 0).alias("known"))


# -- starts and refinement ---------------------------------------------------------------------------------------


def initial_affine(fixed: DataFrame, moving: DataFrame, by: Sequence[str], scale: DataFrame | None = None) -> DataFrame:
    """Axis-wise scale and shift that lay the moving points' median on the fixed ones'. The scale is the ratio of the
    robust extents, within 0.05 and 20, or ``scale`` (by, sx, sy) where that has one."""
    f = robust_extents(fixed, by, ["x", "y"]).select(*by, *[F.col(f"{p}_{c}").alias(f"f{p[0]}{c}") for p in ("centre", "extent") for c in "xy"])
    m = robust_extents(moving, by, ["x", "y"]).select(*by, *[F.col(f"{p}_{c}").alias(f"m{p[0]}{c}") for p in ("centre", "extent") for c in "xy"])
    j = on(by, f, m)
    if scale is not None:
        j = on(by, j, scale.select(*by, F.col("sx").alias("_sx"), F.col("sy").alias("_sy")), "left")
    else:
        j = j.withColumns({"_sx": F.lit(None).cast("double"), "_sy": F.lit(None).cast("double")})
    j = j.withColumns({"a": F.coalesce("_sx", clip(F.col("fex") / F.col("mex"), 0.05, 20.0)), "d": F.coalesce("_sy", clip(F.col("fey") / F.col("mey"), 0.05, 20.0))})
    return j.select(*by, "a", F.lit(0.0).alias("b"), (F.col("fcx") - F.col("a") * F.col("mcx")).alias("tx"), F.lit(0.0).alias("c"), "d", (F.col("fcy") - F.col("d") * F.col("mcy")).alias("ty"))


def match_radius(fixed: DataFrame, by: Sequence[str], id_col: str = "id", near: DataFrame | None = None) -> DataFrame:
    """(by, radius): eight times the median distance to the nearest other point, at least 64 and at most 2,048; 256 for
    groups of one point."""
    near = knn(fixed, None, by, ["x", "y"], id_col, 1) if near is None else near
    m = near.where("ordinal = 1").groupBy(*by).agg(F.median("distance").alias("_m"))
    return on(by, fixed.select(*by).distinct(), m, "left").select(*by, F.coalesce(clip(8 * F.col("_m"), 64.0, 2048.0), F.lit(256.0)).alias("radius"))


def refine_affine(fixed: DataFrame, moving: DataFrame, start: DataFrame, by: Sequence[str], rounds: int = 3, max_radius: float = 2048.0) -> tuple[DataFrame, DataFrame]:
    """(models, matches of the last round) after ``rounds`` of: move, pair mutually nearest points within the group's
    radius, fit, leave out what lies off, fit again. Points are (by, id, x, y). Groups that find fewer than three
    pairs in a round keep the model they have; ``status`` says 'refined' or 'kept'."""
    radius = cut(match_radius(fixed, by))
    most = min(max_radius, radius.agg(F.max("radius")).first()[0] or 256.0)
    models, found = cut(start.select(*by, *MODEL).withColumn("status", F.lit("kept"))), None
    for _ in range(rounds):
        moved = cut(transform_points(moving, models, by, "x", "y", ("x_reg", "y_reg")))
        pairs = mutual_nearest(fixed, moved, by, ["x", "y"], "id", most, ["x_reg", "y_reg"])
        pairs = on(by, pairs, radius).where(F.col("spatial") <= F.col("radius")).drop("radius")
        xy = pairs.join(fixed.select(F.col("id").alias("id1"), F.col("x").alias("x1"), F.col("y").alias("y1")), "id1").join(moving.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2")), "id2")
        n = xy.groupBy(*by).agg(F.count("*").alias("_n")).where("_n >= 3")
        xy = cut(on(by, xy, n).drop("_n"))
        kept = keep_robust(residuals(xy, fit_affine(xy, by), by), by, "residual_px", ["id1", "id2"], floor=1.0, least=2.0, min_keep=3)
        found = cut(kept)
        new = fit_affine(found, by).drop("n")
        old = models.select(*by, *[F.col(c).alias(f"_o_{c}") for c in MODEL], F.col("status").alias("_s"))
        j = on(by, old, new, "left")
        models = cut(j.select(*by, *[F.coalesce(c, f"_o_{c}").alias(c) for c in MODEL], F.when(F.col("a").isNotNull(), "refined").otherwise(F.col("_s")).alias("status")))
    return models, residuals(found, models, by)


# -- local models ------------------------------------------------------------------------------------------------


def local_affine(points: DataFrame, landmarks: DataFrame, models: DataFrame, by: Sequence[str], k: int = 8, power: float = 2.0, exact: float = 1e-6, leave_out: bool = False) -> DataFrame:
    """``points`` (by, id, x, y) with x_local, y_local: each is moved by the affine fitted to its ``k`` nearest landmarks
    (by, lid, x2, y2 -> x1, y1), weighted by 1/distance**power. On a landmark it takes that landmark's target; with fewer
    than three landmarks, or all on a line, its group's model. ``leave_out`` leaves out the landmark of the point's own
    id."""
    near = knn(points, landmarks, by, ["x", "y"], "id", k + 1 if leave_out else k, ["x2", "y2"]) if by else knn(points, landmarks, [], ["x", "y"], "id", k, ["x2", "y2"])
    if leave_out:
        near = near.where("id <> neighbour").withColumn("ordinal", F.row_number().over(W.partitionBy(*by, "id").orderBy("ordinal"))).where(F.col("ordinal") <= k)
    near = near.join(landmarks.select(F.col("id").alias("neighbour"), "x1", "y1", "x2", "y2"), "neighbour")
    # seen from the point, so that sums of squares don't cancel; its own place is then the shift
    near = near.join(points.select(*by, "id", "x", "y"), [*by, "id"]).withColumns({"x2": F.col("x2") - F.col("x"), "y2": F.col("y2") - F.col("y")}).drop("x", "y")
    w = 1 / F.pow(F.greatest("distance", F.lit(exact)), F.lit(power))
    fit = fit_affine(near, [*by, "id"], w).withColumnsRenamed({c: f"_l_{c}" for c in MODEL})
    hit = near.where((F.col("ordinal") == 1) & (F.col("distance") <= exact)).select(*by, "id", F.col("x1").alias("_hx"), F.col("y1").alias("_hy"))
    j = points.join(fit, [*by, "id"], "left").join(hit, [*by, "id"], "left")
    j = on(by, j, models.select(*by, *MODEL), "left")
    gx, gy = apply_xy("x", "y")
    use = F.col("n") >= 3
    return j.select(*points.columns, F.coalesce("_hx", F.when(use, F.col("_l_tx")), gx).alias("x_local"), F.coalesce("_hy", F.when(use, F.col("_l_ty")), gy).alias("y_local"))


def deformation_grid(models: DataFrame, sizes: DataFrame, by: Sequence[str], grid: int = 16, landmarks: DataFrame | None = None, k: int = 8, power: float = 2.0) -> DataFrame:
    """The moving position of grid x grid fixed positions (level-0 pixels): by the inverse of the group's model and, where
    landmarks are given, by the inverse local one; and how far apart the two are. ``sizes``: by, width, height."""
    axis = F.sequence(F.lit(0), F.lit(grid - 1))
    g = on(by, sizes, invert(models.select(*by, *MODEL))).withColumn("gy", F.explode(axis)).withColumn("gx", F.explode(axis))
    step = lambda c, e: F.col(c) * (F.col(e) - 1) / (grid - 1)
    g = g.withColumns({"fixed_x": step("gx", "width"), "fixed_y": step("gy", "height")})
    mx, my = apply_xy("fixed_x", "fixed_y")
    g = g.withColumns({"moving_x_global": mx, "moving_y_global": my}).select(*by, "gy", "gx", "fixed_x", "fixed_y", "moving_x_global", "moving_y_global")
    if landmarks is None:
        return g.withColumns({"moving_x_local": F.col("moving_x_global"), "moving_y_local": F.col("moving_y_global"), "delta_x": F.lit(0.0), "delta_y": F.lit(0.0)})
    g = cut(g.withColumn("id", F.xxhash64(*by, "gy", "gx")))
    turned = landmarks.select(*by, "id", F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x2").alias("x1"), F.col("y2").alias("y1"))
    loc = local_affine(g.select(*by, "id", F.col("fixed_x").alias("x"), F.col("fixed_y").alias("y")), turned, invert(models.select(*by, *MODEL)), by, k, power)
    j = g.join(loc.select("id", F.col("x_local").alias("moving_x_local"), F.col("y_local").alias("moving_y_local")), "id").drop("id")
    return j.withColumns({"delta_x": F.col("moving_x_local") - F.col("moving_x_global"), "delta_y": F.col("moving_y_local") - F.col("moving_y_global")})


# -- thin-plate splines ------------------------------------------------------------------------------------------


def _kernel(d2: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(d2 > 0, 0.5 * d2 * np.log(d2), 0.0)


def boundary_anchors(models: DataFrame, sizes: DataFrame, by: Sequence[str], per_side: int = 4) -> DataFrame:
    """Points on the fixed frame's edge, 2n on top and bottom and 2(n-2) on the sides, with their moving place by the
    group's inverse model: (by, x1, y1, x2, y2). ``sizes``: by, width, height."""
    place = [(i / (per_side - 1), s) for i in range(per_side) for s in (0.0, 1.0)] + [(s, i / (per_side - 1)) for i in range(1, per_side - 1) for s in (0.0, 1.0)]
    at = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("fx"), F.lit(float(b)).alias("fy")) for a, b in place])).alias("p")
    g = on(by, sizes, invert(models.select(*by, *MODEL)))
    g = g.select(*by, *MODEL, "width", "height", at).withColumns({"x1": F.col("p.fx") * (F.col("width") - 1), "y1": F.col("p.fy") * (F.col("height") - 1)})
    x, y = apply_xy("x1", "y1")
    return g.select(*by, "x1", "y1", x.alias("x2"), y.alias("y2"))


def _thin_plate(s: np.ndarray, v: np.ndarray, regular: float) -> list[float]:
    """Rows fx, fy, wx, wy of the spline through ``v`` at ``s``, the three affine rows last."""
    n = len(s)
    p = np.column_stack([np.ones(n), s])
    k = np.block([[_kernel(((s[:, None] - s[None]) ** 2).sum(2)) + regular * np.eye(n), p], [p.T, np.zeros((3, 3))]])
    rhs = np.vstack([v, np.zeros((3, 2))])
    try:
        w = np.linalg.solve(k, rhs)
        if not np.allclose(k @ w, rhs, atol=1e-6 * max(1.0, np.abs(v).max(initial=0))):
            raise np.linalg.LinAlgError
    except np.linalg.LinAlgError:  # too few points, or all on a line
        w = np.linalg.lstsq(k, rhs, rcond=None)[0]
    return np.column_stack([np.vstack([s, np.zeros((3, 2))]), w]).ravel().tolist()


SQUARES = 256  # along a side, at most


def fit_spline(landmarks: DataFrame, by: Sequence[str], regular: float = 1e-3, most: int = 2000) -> DataFrame:
    """(by, qy, qx, x0, y0, side, spline): the thin-plate spline from (fx, fy) to (tx, ty) of each group, as an array of rows
    fx, fy, wx, wy with the three affine rows last. A place that comes twice counts once; missing values don't.

    A dense system grows with the cube of its landmarks. A group of over ``most`` has a base spline through ``most`` of them,
    of least hash, and squares, each with a spline of what the base leaves over at all landmarks of the square and the
    eight around it; a point blends those of the four squares whose centres surround it. So every landmark counts. Squares
    are as large as ``most`` allows; a group whose landmarks crowd beyond ``SQUARES`` along a side raises."""
    marks = landmarks.where(" and ".join(f"{c} is not null and not isnan({c})" for c in ("fx", "fy", "tx", "ty"))).select(*by, "fx", "fy", "tx", "ty")
    marks = cut(marks.groupBy(*by, "fx", "fy").agg(F.min(F.struct("tx", "ty")).alias("t")).select(*by, "fx", "fy", "t.tx", "t.ty"))
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.xxhash64("fx", "fy"), "fx", "fy"))
    top = marks.withColumn("_r", place).where(F.col("_r") <= most)
    keys = _key_columns(marks, by)
    squares = "qy int, qx int, x0 double, y0 double, side double"

    def solve(t: pa.Table) -> pa.Table:
        rows = _thin_plate(np.column_stack([column(t, c) for c in ("fx", "fy")]), np.column_stack([column(t, c) for c in ("tx", "ty")]), regular)
        return pa.table({**{c: t.column(c).slice(0, 1) for c in t.column_names if c not in ("fx", "fy", "tx", "ty", "_r")}, "spline": pa.array([rows], pa.list_(pa.float64()))})

    base = map_groups(top, list(by), solve, keys + "spline array<double>", sort=["_r"])
    base = base.select(*by, *[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in squares.split(", "))], "spline")
    large = marks.groupBy(*by).agg(F.count("*").alias("_n"), F.min("fx").alias("x0"), F.min("fy").alias("y0"), F.greatest(F.max("fx") - F.min("fx"), F.max("fy") - F.min("fy")).alias("_w")).where(F.col("_n") > most)
    large = cut(large)
    base = cut(base)
    if not large.limit(1).count():
        return base
    m = on(by, marks, large.drop("_n")).withColumn("id", F.xxhash64("fx", "fy"))
    got = spline_points(m.select(*by, "id", F.col("fx").alias("x"), F.col("fy").alias("y")), base, by, "id", ("_bx", "_by"))
    m = cut(m.join(got, [*by, "id"]).withColumns({"tx": F.col("tx") - F.col("_bx"), "ty": F.col("ty") - F.col("_by")}).drop("_bx", "_by", "id"))
    fine = lambda c, o: F.least(F.lit(SQUARES - 1), F.floor((F.col(c) - F.col(o)) / F.col("_w") * SQUARES)).cast("int")
    crowd = m.groupBy(*by, fine("fy", "y0").alias("_y"), fine("fx", "x0").alias("_x")).agg(F.count("*").alias("_c"))
    sides = [2**i for i in range(1, SQUARES.bit_length())]
    at = lambda c: F.floor(F.col(c) * F.col("_m") / SQUARES)
    around = F.explode(F.array(*[F.struct(F.lit(dy).alias("y"), F.lit(dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    crowd = crowd.withColumn("_m", F.explode(F.array(*map(F.lit, sides)))).withColumns({"_y": at("_y"), "_x": at("_x")}).withColumn("_o", around)
    crowd = crowd.groupBy(*by, "_m", (F.col("_y") + F.col("_o.y")).alias("_y"), (F.col("_x") + F.col("_o.x")).alias("_x")).agg(F.sum("_c").alias("_c"))
    fits = crowd.groupBy(*by, "_m").agg(F.max("_c").alias("_c")).groupBy(*by).agg(F.min(F.when(F.col("_c") <= most, F.col("_m"))).alias("_m"))
    fits = cut(fits)
    if fits.where("_m is null").limit(1).count():
        raise ValueError(f"over {most} landmarks of a group crowd within {SQUARES} squares along a side")
    m = on(by, m, fits).withColumn("side", F.col("_w") / F.col("_m"))
    own = lambda c, o: F.least(F.col("_m") - 1, F.floor((F.col(c) - F.col(o)) / F.col("side"))).cast("int")
    m = m.withColumns({"_y": own("fy", "y0"), "_x": own("fx", "x0"), "_o": around})
    m = m.select(*by, (F.col("_y") + F.col("_o.y")).cast("int").alias("qy"), (F.col("_x") + F.col("_o.x")).cast("int").alias("qx"), "x0", "y0", "side", "fx", "fy", "tx", "ty")
    local = map_groups(m, [*by, "qy", "qx"], solve, keys + squares + ", spline array<double>", sort=["fx", "fy"])
    return base.unionByName(cut(local))


def spline_points(points: DataFrame, splines: DataFrame, by: Sequence[str], id_col: str = "id", out: tuple[str, str] = ("x_spline", "y_spline")) -> DataFrame:
    """(by, id, out): each point (by, id, x, y) moved by its group's spline, chunk by chunk. Ids must be unique in a group."""

    def move(rows: pa.Table, side: pa.Table) -> pa.Table:
        w = np.array(side.column("spline")[0].as_py()).reshape(-1, 4)
        s, a = w[:-3], w[-3:, 2:]
        x = np.column_stack([column(rows, c) for c in ("x", "y")])
        got = a[0] + x @ a[1:]
        step = max(1, 2_000_000 // max(1, len(s)))
        for i in range(0, len(x), step):
            d2 = ((x[i : i + step, None] - s[None, :, :2]) ** 2).sum(2)
            got[i : i + step] += _kernel(d2) @ s[:, 2:]
        return pa.table({**{c: rows.column(c) for c in rows.column_names if c not in ("x", "y")}, out[0]: got[:, 0], out[1]: got[:, 1]})

    p = points.select(*by, id_col, "x", "y")
    keys = _key_columns(p, by) + f"{id_col} {dict(p.dtypes)[id_col]}, "
    moved = map_chunks(p, splines.where("qx is null").select(*by, "spline"), by, id_col, move, keys + f"{out[0]} double, {out[1]} double")
    local = splines.where("qx is not null")
    if not local.limit(1).count():
        return moved
    grid = local.groupBy(*by).agg(*[F.first(c).alias(f"_{c}") for c in ("x0", "y0", "side")])
    # the squares whose centres surround a point, and their shares of it
    q = on(by, p, grid).withColumns({"_u": (F.col("x") - F.col("_x0")) / F.col("_side") - 0.5, "_v": (F.col("y") - F.col("_y0")) / F.col("_side") - 0.5})
    share = lambda c, d: (1 - (F.col(c) - F.floor(c))) if d == 0 else F.col(c) - F.floor(c)
    corner = F.explode(F.array(*[F.struct((F.floor("_v") + dy).cast("int").alias("qy"), (F.floor("_u") + dx).cast("int").alias("qx"), (share("_v", dy) * share("_u", dx)).alias("w")) for dy in (0, 1) for dx in (0, 1)])).alias("_c")
    q = q.select(*by, id_col, "x", "y", corner).select(*by, "_c.qy", "_c.qx", "_c.w", id_col, "x", "y").where("w > 0")
    kinds = keys.replace(f"{id_col} ", f"qy int, qx int, w double, {id_col} ", 1) if not by else _key_columns(p, by) + f"qy int, qx int, w double, {id_col} {dict(p.dtypes)[id_col]}, "
    rest = map_chunks(q, local.select(*by, "qy", "qx", "spline"), [*by, "qy", "qx"], id_col, move, kinds + f"{out[0]} double, {out[1]} double")
    rest = rest.groupBy(*by, id_col).agg(*[F.sum(F.col("w") * F.col(o)).alias(f"_{o}") for o in out])
    return moved.join(rest, [*by, id_col], "left").select(*by, id_col, *[(F.col(o) + F.coalesce(f"_{o}", F.lit(0.0))).alias(o) for o in out])


# -- refinement that keeps neighbour distances -------------------------------------------------------------------


def refine_with_neighbours(matches: DataFrame, models: DataFrame, by: Sequence[str], id_col: str, k: int = 5, scale: bool = False, landmark_weight: float = 10.0, neighbour_weight: float = 1.0, max_deg: float = 10.0, max_shift: float = 30.0, max_scale: float = 0.05, accept_worse: float = 1.05) -> DataFrame:
    """(by, a..ty, accepted): each group's similarity moved a little, so that both the landmarks and the distances among
    them agree best.

    The loss is landmark_weight x mean squared landmark error + neighbour_weight x mean squared difference of the k nearest
    distances on both sides. Neighbour distances change with the scale only, so the least loss has a closed form in grouped
    sums. Angle, scale and shift stay within their limits around the start, and a result whose mean or median squared error
    is over ``accept_worse`` times the start's is dropped for it, as are groups of fewer than three matches."""
    m = cut(residuals(matches, models, by, "_r0"))
    near = lambda x, y: knn(m.select(*by, F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(y).alias("y")), None, by, ["x", "y"], "id", k).select("id", "ordinal", "distance")
    d = near("x1", "y1").withColumnRenamed("distance", "d1").join(near("x2", "y2").withColumnRenamed("distance", "d2"), ["id", "ordinal"])
    d = d.join(m.select(F.col(id_col).alias("id"), *by), "id").groupBy(*by).agg(F.avg(F.col("d1") * F.col("d2")).alias("_B"), F.avg(F.col("d2") * F.col("d2")).alias("_C"))
    s = _sums(m, by, None)
    c = lambda p, q: F.col(f"s_{p}{q}") - F.col(f"s_{p}") * F.col(f"s_{q}") / F.col("n")
    g = on(by, on(by, s, d, "left"), models.select(*by, *[F.col(x).alias(f"_o_{x}") for x in MODEL]))
    re, im, v2 = (c("x", "u") + c("y", "v")) / F.col("n"), (c("x", "v") - c("y", "u")) / F.col("n"), (c("x", "x") + c("y", "y")) / F.col("n")
    g = g.withColumns({"_s0": F.sqrt(F.abs(F.col("_o_a") * F.col("_o_d") - F.col("_o_b") * F.col("_o_c"))), "_t0": F.atan2("_o_c", "_o_a"), "_t": F.atan2(im, re)})
    best = (landmark_weight * F.sqrt(re * re + im * im) + neighbour_weight * F.coalesce("_B", F.lit(0.0))) / F.nullif(landmark_weight * v2 + neighbour_weight * F.coalesce("_C", F.lit(0.0)), F.lit(0.0))
    turn = F.pmod(F.col("_t") - F.col("_t0") + math.pi, F.lit(2 * math.pi)) - math.pi
    lim = math.radians(max_deg)
    g = g.withColumns({"_s": clip(F.coalesce(best, "_s0"), F.col("_s0") * (1 - max_scale), F.col("_s0") * (1 + max_scale)) if scale else F.col("_s0"), "_t": F.col("_t0") + clip(turn, -lim, lim)})
    g = g.withColumns({"a": F.col("_s") * F.cos("_t"), "c": F.col("_s") * F.sin("_t")})
    tx = (F.col("s_u") - F.col("a") * F.col("s_x") + F.col("c") * F.col("s_y")) / F.col("n")
    ty = (F.col("s_v") - F.col("c") * F.col("s_x") - F.col("a") * F.col("s_y")) / F.col("n")
    g = g.select(*by, "n", "a", (-F.col("c")).alias("b"), clip(tx, F.col("_o_tx") - max_shift, F.col("_o_tx") + max_shift).alias("tx"), "c", F.col("a").alias("d"), clip(ty, F.col("_o_ty") - max_shift, F.col("_o_ty") + max_shift).alias("ty"))
    g = cut(g)
    r = residuals(m, g, by, "_r1")
    st = r.groupBy(*by).agg(*[f(F.pow(f"_r{i}", 2)).alias(f"{n}{i}") for i in (0, 1) for n, f in (("mean", F.avg), ("med", F.median))])
    ok = (F.col("n") >= 3) & (F.col("mean1") <= accept_worse * F.col("mean0")) & (F.col("med1") <= accept_worse * F.col("med0"))
    j = on(by, on(by, g, st, "left"), models.select(*by, *[F.col(x).alias(f"_o_{x}") for x in MODEL])).withColumn("accepted", F.coalesce(ok, F.lit(False)))
    return j.select(*by, *[F.when(F.col("accepted"), F.col(x)).otherwise(F.col(f"_o_{x}")).alias(x) for x in MODEL], "accepted")
