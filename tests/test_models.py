import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import models
from cytoloom.operators.models import MODEL
from cytoloom.runtime import cut


def pairs(spark, m, f, g="s", ids=None):
    rows = [(g, int(i), float(a[0]), float(a[1]), float(b[0]), float(b[1])) for i, a, b in zip(range(len(m)) if ids is None else ids, f, m)]
    return spark.createDataFrame(rows, "g string, id long, x1 double, y1 double, x2 double, y2 double")


def numbers(df, g="s"):
    r = df.where(F.col("g") == g).first()
    return np.array([r[c] for c in MODEL])


def apply(p, x):
    return np.column_stack([p[0] * x[:, 0] + p[1] * x[:, 1] + p[2], p[3] * x[:, 0] + p[4] * x[:, 1] + p[5]])


SIM = np.array([1.2 * math.cos(0.3), -1.2 * math.sin(0.3), 5.0, 1.2 * math.sin(0.3), 1.2 * math.cos(0.3), -7.0])
AFF = np.array([1.1, 0.2, 3.0, -0.1, 0.9, 4.0])


def test_known_shift_of_a_mask(spark):
    from cytoloom.operators.masks import region_properties

    tops = [(12, 18), (30, 48), (57, 24), (65, 62)]
    px = lambda dy, dx: spark.createDataFrame([("s", y + r + dy, x + c + dx, n) for n, (y, x) in enumerate(tops, 1) for r in range(5) for c in range(6)], "g string, y int, x int, label int")
    f, m = region_properties(px(0, 0), ["g"]), region_properties(px(7, 11), ["g"])
    j = f.select("g", "label", F.col("centroid_x").alias("x1"), F.col("centroid_y").alias("y1")).join(m.select("label", F.col("centroid_x").alias("x2"), F.col("centroid_y").alias("y2")), "label")
    assert numbers(models.fit_translation(j, ["g"])) == pytest.approx([1, 0, -11, 0, 1, -7])
    assert f.count() == 4 and f.select("area").distinct().first()[0] == 30


def test_no_matches_raise(spark):
    with pytest.raises(ValueError, match="No matches"):
        models.require_matches(pairs(spark, np.zeros((0, 2)), np.zeros((0, 2))))
    with pytest.raises(ValueError, match="2 matches"):
        models.require_matches(pairs(spark, np.zeros((2, 2)), np.zeros((2, 2))), 3)


def test_closed_form_fits(spark):
    x = np.random.default_rng(0).normal(0, 40, (30, 2))
    assert numbers(models.fit_similarity(pairs(spark, x, apply(SIM, x)), ["g"])) == pytest.approx(SIM)
    assert numbers(models.fit_affine(pairs(spark, x, apply(AFF, x)), ["g"])) == pytest.approx(AFF)
    e = numbers(models.fit_similarity(pairs(spark, x, apply(SIM, x)), ["g"], scale=False))
    assert math.hypot(e[0], e[3]) == pytest.approx(1) and math.atan2(e[3], e[0]) == pytest.approx(0.3)


def test_degenerate_fits_fall_back_to_a_shift(spark):
    line = np.column_stack([np.arange(5.0), np.arange(5.0)])
    assert numbers(models.fit_affine(pairs(spark, line, line + [2, 3]), ["g"])) == pytest.approx([1, 0, 2, 0, 1, 3])
    one = np.array([[4.0, 4.0]] * 3)
    assert numbers(models.fit_similarity(pairs(spark, one, one + 1), ["g"])) == pytest.approx([1, 0, 1, 0, 1, 1])


def test_inverse_and_composition_are_identity(spark):
    m = spark.createDataFrame([("s", *AFF.tolist()), ("flat", 1.0, 2.0, 0.0, 2.0, 4.0, 0.0)], "g string, " + ", ".join(f"{c} double" for c in MODEL))
    assert numbers(models.compose(m, models.invert(m), ["g"])) == pytest.approx([1, 0, 0, 0, 1, 0], abs=1e-12)
    assert models.invert(m).where("g = 'flat' and a is null").count() == 1


@pytest.mark.parametrize("kind,true,chunk", [("translation", [1, 0, -110, 0, 1, 70], 40), ("euclidean", None, 20_000), ("similarity", SIM, 20_000), ("affine", AFF, 20_000)])
def test_consensus_finds_the_model_among_outliers(spark, kind, true, chunk, monkeypatch):
    rng = np.random.default_rng(1)
    true = np.array([math.cos(0.2), -math.sin(0.2), 9, math.sin(0.2), math.cos(0.2), 3.0]) if true is None else np.array(true, float)
    x = rng.uniform(0, 500, (200, 2))
    y = apply(true, x) + rng.uniform(-0.4, 0.4, (200, 2))
    y[::4] = rng.uniform(0, 500, (50, 2))
    base = models.map_chunks
    monkeypatch.setattr(models, "map_chunks", lambda *a, **k: base(*a, **(k | {"per_chunk": chunk})))
    m, marked = models.ransac(pairs(spark, x, y), ["g"], "id", kind, 2.0, 400)
    assert numbers(m) == pytest.approx(true, abs=0.6)
    inl = {r.id for r in marked.where("ransac_inlier").collect()}
    assert len(inl & set(range(0, 200, 4))) <= 3 and len(inl) >= 145


def test_consensus_of_tiny_groups(spark):
    m, marked = models.ransac(pairs(spark, np.array([[0.0, 0.0]]), np.array([[3.0, 4.0]])), ["g"], "id")
    assert numbers(m) == pytest.approx([1, 0, 3, 0, 1, 4]) and marked.where("ransac_inlier").count() == 1
    m, marked = models.ransac(pairs(spark, np.zeros((0, 2)), np.zeros((0, 2))), ["g"], "id")
    assert m.count() == 0 == marked.count()


def test_spline_meets_its_landmarks_and_affine_maps(spark):
    rng = np.random.default_rng(2)
    s = rng.uniform(0, 100, (40, 2))
    t = apply(AFF, s) + rng.normal(0, 2, (40, 2))
    lm = spark.createDataFrame([("s", *map(float, (*a, *b))) for a, b in zip(s, t)], "g string, fx double, fy double, tx double, ty double")
    p = spark.createDataFrame([("s", i, float(a[0]), float(a[1])) for i, a in enumerate(s)], "g string, id int, x double, y double")
    got = models.spline_points(p, models.fit_spline(lm, ["g"], regular=0.0), ["g"]).orderBy("id").collect()
    assert np.array([(r.x_spline, r.y_spline) for r in got]) == pytest.approx(t, abs=1e-5)
    flat = spark.createDataFrame([("s", *map(float, (*a, *b))) for a, b in zip(s, apply(AFF, s))], lm.schema)
    q = rng.uniform(-20, 120, (10, 2))
    p = spark.createDataFrame([("s", i, float(a[0]), float(a[1])) for i, a in enumerate(q)], "g string, id int, x double, y double")
    got = models.spline_points(p, models.fit_spline(flat, ["g"]), ["g"]).orderBy("id").collect()
    assert np.array([(r.x_spline, r.y_spline) for r in got]) == pytest.approx(apply(AFF, q), abs=1e-3)


def test_local_affine(spark):
    rng = np.random.default_rng(3)
    s = rng.uniform(0, 100, (50, 2))
    lm = pairs(spark, s, apply(AFF, s))
    base = spark.createDataFrame([("s", 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), ("t", 1.0, 0.0, 5.0, 0.0, 1.0, 5.0)], "g string, " + ", ".join(f"{c} double" for c in MODEL))
    q = np.vstack([s[:3], rng.uniform(0, 100, (5, 2))])
    p = spark.createDataFrame([("s", i, float(a[0]), float(a[1])) for i, a in enumerate(q)] + [("t", 99, 1.0, 1.0)], "g string, id long, x double, y double")
    got = {r.id: (r.x_local, r.y_local) for r in models.local_affine(p, lm, base, ["g"]).collect()}
    assert np.array([got[i] for i in range(8)]) == pytest.approx(apply(AFF, q), abs=1e-6)
    assert got[99] == (6.0, 6.0)  # no landmarks: the group's model


def test_refinement_reaches_the_true_affine(spark):
    rng = np.random.default_rng(4)
    m = rng.uniform(0, 2000, (300, 2))
    f = apply(np.array([1.0, 0.01, 20, -0.01, 1.0, -15]), m) + rng.normal(0, 0.3, (300, 2))
    t = lambda x: spark.createDataFrame([("s", i, float(a[0]), float(a[1])) for i, a in enumerate(x)], "g string, id long, x double, y double")
    a, _ = models.refine_affine(t(f), t(m), models.initial_affine(t(f), t(m), ["g"]), ["g"], 3)
    assert a.first().status == "refined"
    assert np.abs(apply(numbers(a), m) - f).mean() < 1.0


def test_neighbour_refinement_keeps_within_its_limits(spark):
    x = np.random.default_rng(5).uniform(0, 200, (60, 2))
    start = spark.createDataFrame([("s", 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "g string, " + ", ".join(f"{c} double" for c in MODEL))
    y = apply(np.array([1.02, 0, 4, 0, 1.02, -3]), x)
    got = models.refine_with_neighbours(pairs(spark, x, y), start, ["g"], "id", scale=True)
    assert got.first().accepted and numbers(got) == pytest.approx([1.02, 0, 4, 0, 1.02, -3], abs=1e-6)
    far = models.refine_with_neighbours(pairs(spark, x, y * 1.5), start, ["g"], "id", scale=True).first()
    assert math.hypot(far.a, far.c) <= 1.05 + 1e-9


def test_grid_and_offsets(spark):
    rows = [("s", i, 5.0 + (i % 2), 1.0, 10.0 * i, 10.0, 0.1) for i in range(10)] + [("s", 99, 500.0, 1.0, 95.0, 95.0, 9.0)]
    m = spark.createDataFrame(rows, "g string, id int, dx double, dy double, x1 double, y1 double, distance double").withColumns({"x2": F.col("x1") - F.col("dx"), "y2": F.col("y1") - F.col("dy")})
    g = models.translation_grid(m, ["g"], F.lit(100.0), F.lit(100.0))
    assert g.count() == 16 and g.where("known").count() == 5
    assert models.median_offset(m, ["g"], ["id"]).first().tx == pytest.approx(5.5)
    st, marked = models.main_displacement(m, ["g"])
    assert st.first().dx0 in (5.0, 5.5, 6.0) and marked.where("not in_main").count() == 1


def test_clipping_equals_numpy_and_keeps_what_it_cannot_mend(spark):
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for g in range(6):
        n = (40, 40, 8, 40, 30, 60)[g]
        d = rng.normal(0, 0.3, (n, 2)) + [5, -3]
        if g in (0, 4, 5):
            d[: n // 8] += [4.0, 3.0]
        if g == 3:
            d[: n // 2] += [6.0, 0.0]
        rows += [(g, 100 * g + i, float(x + a), float(y + b), float(x), float(y)) for i, ((x, y), (a, b)) in enumerate(zip(rng.uniform(0, 500, (n, 2)), d))]
        t = d.mean(0)
        res = np.hypot(*(d - t).T)
        inn = res <= 6
        med = np.median(res[inn])
        lim = med + 3 * max(1.4826 * np.median(np.abs(res[inn] - med)), 1e-6)
        seed = inn & (res <= lim)
        res2 = np.hypot(*(d - d[seed].mean(0)).T)
        inn2, drop = res2 <= 6, max(1, int(0.2 * inn.sum()))
        used = inn.sum() >= 12 and seed.sum() >= max(12, inn.sum() - drop) and inn2.sum() >= 12 and inn.sum() - inn2.sum() <= drop and med - np.median(res2[inn2]) >= 0.1
        want[g] = (bool(used), int((inn2 if used else inn).sum()), round(float(lim), 6))
    df = spark.createDataFrame(rows, "g int, id int, x1 double, y1 double, x2 double, y2 double")
    model = models.fit_translation(df, ["g"])
    marked = models.residuals(df, model, ["g"]).withColumn("ransac_inlier", F.col("residual_px") <= 6)
    final, got, diag = models.clip_inliers(marked, model, ["g"], "translation", 6.0)
    n = {r.g: r.n for r in got.groupBy("g").agg(F.count_if("ransac_inlier").alias("n")).collect()}
    assert {r.g: (r.used, n[r.g], round(r.clip_limit, 6)) for r in diag.collect()} == want
    assert {True, False} == {u for u, _, _ in want.values()} and final.count() == 6 and got.count() == len(rows)
    none = models.clip_inliers(marked.limit(0), model.limit(0), ["g"])
    assert [t.count() for t in none] == [0, 0, 0]


def test_trials_are_drawn_from_the_whole_group(spark):
    """One match in a hundred is true, in a group of many times as many as a small pool would hold."""
    rng = np.random.default_rng(13)
    n = 6000
    d = rng.uniform(-400, 400, (n, 2))
    d[: n // 50] = [31.0, -17.0] + rng.normal(0, 0.2, (n // 50, 2))
    rows = [(i, float(x + a), float(y + b), float(x), float(y)) for i, ((x, y), (a, b)) in enumerate(zip(rng.uniform(0, 500, (n, 2)), d))]
    df = spark.createDataFrame(rows, "id int, x1 double, y1 double, x2 double, y2 double")
    model, marked = models.ransac(df, [], "id", "translation", 2.0, 3000, samples=1)
    m = model.first()
    assert abs(m.tx - 31) < 0.2 and abs(m.ty + 17) < 0.2 and marked.where("ransac_inlier").count() >= n // 50


def test_a_large_spline_uses_every_landmark(spark):
    rng = np.random.default_rng(16)
    x = np.vstack([rng.uniform(0, 4000, (500, 2)), rng.normal(900, 150, (400, 2))])
    move = lambda q: q + np.column_stack([20 * np.sin(q[:, 1] / 500) + 5, 15 * np.cos(q[:, 0] / 400)])
    y = move(x)
    rows = [("big", *map(float, (*a, *b))) for a, b in zip(x, y)] + [("small", *map(float, (*a, *b))) for a, b in zip(x[:60], y[:60])] + [("big", float(x[0, 0]), float(x[0, 1]), float(y[0, 0]), float(y[0, 1])), ("big", None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, fx double, fy double, tx double, ty double")
    sp = models.fit_spline(df, ["g"], most=200)
    assert sp.where("g = 'small'").count() == 1 and sp.where("g = 'big'").count() > 10
    other = rng.uniform(100, 3900, (200, 2))
    pts = spark.createDataFrame([(g, i, *map(float, p)) for g in ("big", "small") for i, p in enumerate(np.vstack([x, other]))], "g string, id int, x double, y double")
    got = {(r.g, r.id): (r.x_spline, r.y_spline) for r in models.spline_points(pts, cut(sp), ["g"]).collect()}
    assert len(got) == 2 * 1100
    off = np.hypot(*(np.array([got["big", i] for i in range(900)]) - y).T)
    assert off.max() < 0.5  # at the landmarks, most of which the base spline doesn't hold
    away = np.hypot(*(np.array([got["big", 900 + i] for i in range(200)]) - move(other)).T)
    whole = models.spline_points(pts.where("g = 'big'"), models.fit_spline(df, ["g"]), ["g"])
    dense = {r.id: (r.x_spline, r.y_spline) for r in whole.collect()}
    assert np.median(away) < 2 and np.median(np.hypot(*(np.array([got["big", 900 + i] for i in range(200)]) - np.array([dense[900 + i] for i in range(200)])).T)) < 2
    with pytest.raises(ValueError, match="crowd"):
        models.fit_spline(df, ["g"], most=2)
