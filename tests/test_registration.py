import numpy as np
from pyspark.sql import functions as F

from cytoloom.functions.stats import robust_scales
from cytoloom.operators import raster
from cytoloom.operators.neighbors import like_pairs, radius_pairs, shape_score, top_candidates
from cytoloom.plans.matching import SHAPE, _scales, register_cells

SCHEMA = "g string, cell_key long, centroid_x double, centroid_y double, " + ", ".join(f"{c} double" for c in SHAPE)


def slides(spark, sizes, side=900.0):
    """Groups of so many cells, each with a moving side shifted by (70, -40)."""
    rng, f, m = np.random.default_rng(3), [], []
    for s, (g, n) in enumerate(sizes.items()):
        xy, z = rng.uniform(100, side, (n, 2)), rng.normal(0, 1, (n, len(SHAPE)))
        for i in range(n):
            shape = [200 * 2 ** (0.3 * z[i, 0]), 0.1, 0.9 + 0.02 * z[i, 2], 3 + z[i, 3]]
            f.append((g, 10_000 * s + i, float(xy[i, 0]), float(xy[i, 1]), *map(float, shape)))
            m.append((g, 100_000 + 10_000 * s + i, float(xy[i, 0] - 70), float(xy[i, 1] + 40), *map(float, shape)))
    return spark.createDataFrame(f, SCHEMA), spark.createDataFrame(m, SCHEMA)


def test_wide_shifts_short_groups_and_splines(spark):
    f, m = slides(spark, {"many": 80, "few": 15})
    got = register_cells(f, m, ["g"], "cell_key", trials=100)
    d = {r.g: r for r in got.diagnostics.collect()}
    for r in d.values():  # 80 px off: no true pair lies within 50 px
        assert abs(r.tx - 70) < 1 and abs(r.ty + 40) < 1
    assert d["many"].matches >= 50 and d["many"].stage == 1 and d["many"].spline_residual < 0.5
    assert d["few"].stage > 0 and d["few"].spline_residual is None
    assert [r.g for r in got.splines.collect()] == ["many"]


def test_candidates_a_cell_grow_in_small_groups(spark):
    f, m = slides(spark, {"a": 400, "b": 100, "c": 20})
    assert {r.g: r.per_cell for r in _scales(f, m, ["g"], SHAPE, 320).collect()} == {"a": 8, "b": 26, "c": 32}


def test_like_pairs_equal_ranked_scores_in_split_groups(spark):
    f, m = slides(spark, {"a": 300, "b": 12})
    scales = robust_scales(f.unionByName(m), ["g"], SHAPE).withColumn("k", F.when(F.col("g") == "a", 3).otherwise(6))
    at = ["centroid_x", "centroid_y"]
    got = like_pairs(f, m, ["g"], at, "cell_key", 150.0, SHAPE, scales, "k", 2.0, cap=60)
    want = top_candidates(shape_score(radius_pairs(f, m, ["g"], at, "cell_key", 150.0), f, m, scales, ["g"], "cell_key", SHAPE), ["g"], 6, threshold=2.0).where("g = 'b' or rank <= 3")
    rows = lambda t: sorted((r.id1, r.id2, round(r.score, 9)) for r in t.collect())
    assert rows(got) == rows(want) and len(rows(got)) > 300


def test_window_rules():
    from cytoloom.plans.matching import window_sizes

    assert window_sizes(1000, 2000) == (20.0, 300.0) and window_sizes(100, 100, residual=10) == (40.0, 100.0)
    assert window_sizes(9, 9, window=50) == (50.0, 100.0) and window_sizes(9, 9, window=50, guided=80) == (80.0, 120.0)
    assert window_sizes(9, 9, coarse=7, guided=-1) == (20.0, 7.0)


def test_weighted_pairs_equal_brute_force(spark):
    from cytoloom.operators.neighbors import ordered_union, weighted_pairs

    rng = np.random.default_rng(14)
    cols = ["a", "b", "t"]
    rows = [(g, 1000 * s + i, s, *map(float, rng.uniform(0, 60, 2)), *map(float, rng.normal(0, 3, 3)), *map(float, rng.uniform(0, 1, 2))) for g in "pq" for s in (1, 2) for i in range(120)]
    schema = "g string, id long, s int, centroid_x double, centroid_y double, a double, b double, t double, pos_x_norm double, pos_y_norm double"
    df = spark.createDataFrame(rows, schema)
    got = weighted_pairs(df.where("s = 1"), df.where("s = 2"), ["g"], "id", ["a", "b"], ["t"], (1.0, 0.5, 2.0), 8.0, threshold=2.5, cap=40)
    got = {(r.g, r.id1, r.id2): r.distance for r in got.collect()}
    p = df.toPandas()
    want = {}
    for g in "pq":
        q = p[p.g == g].reset_index(drop=True)
        z = (q[cols] - q[cols].mean()) / q[cols].std(ddof=0)
        f, m = (q.index[q.s == k] for k in (1, 2))
        for i in f:
            for j in m:
                if np.hypot(q.centroid_x[i] - q.centroid_x[j], q.centroid_y[i] - q.centroid_y[j]) <= 8:
                    d = np.hypot(z.a[i] - z.a[j], z.b[i] - z.b[j]) + 0.5 * abs(z.t[i] - z.t[j]) + 2 * np.hypot(q.pos_x_norm[i] - q.pos_x_norm[j], q.pos_y_norm[i] - q.pos_y_norm[j])
                    if d <= 2.5:
                        want[g, q.id[i], q.id[j]] = d
    assert got.keys() == want.keys() and len(want) > 50 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert weighted_pairs(df.where("s = 1"), df.limit(0), ["g"], "id", ["a"]).count() == 0
    assert ordered_union(["b", "a"], [], ["a", "c", "b"]) == ["b", "a", "c"]


def test_slides_are_registered_by_what_cells_look_like(spark):
    from cytoloom.plans.matching import register_by_features

    rng = np.random.default_rng(15)
    f = rng.normal(0, 1, (80, 3))
    xy = rng.uniform(0, 900, (80, 2))
    rows = [("g", s * 1000 + i, s, float(xy[i, 0] - 40 * (s == 2)), float(xy[i, 1] + 25 * (s == 2)), *map(float, f[i] + rng.normal(0, 0.01, 3))) for s in (1, 2) for i in range(80)]
    df = spark.createDataFrame(rows, "g string, id long, s int, centroid_x double, centroid_y double, u double, v double, w double")
    got = register_by_features(df.where("s = 1"), df.where("s = 2"), ["g"], "id", ["u", "v", "w"], trials=2000)
    m = got.models.first()
    assert abs(m.tx - 40) < 1e-6 and abs(m.ty + 25) < 1e-6
    assert register_by_features(df.limit(0), df.where("s = 2"), ["g"], "id", ["u", "v", "w"]).models.count() == 0


def test_coarse_rotation_moves_each_pixel_once(spark, monkeypatch):
    """Each pixel was copied for each angle before the shuffle (F3)."""
    sent = []
    whole = raster.map_groups
    monkeypatch.setattr(raster, "map_groups", lambda df, *a, **k: sent.append(df.count()) or whole(df, *a, **k))
    rng = np.random.default_rng(4)
    p = [(g, *map(float, q)) for g in (1, 2) for q in rng.uniform(10, 50, (80, 2))]
    f, m = (raster.density(spark.createDataFrame([(g, x + dx, y + dy) for g, x, y in p], "g int, x double, y double"), ["g"], "x", "y") for dx, dy in ((0, 0), (3, -2)))
    got = sorted(map(tuple, raster.coarse_rotation(f, m, ["g"], 64, 1.0, 0.5, blur=(1.5, 2.0)).collect()))
    assert sent == [f.count() + m.count()]
    want = sorted(map(tuple, raster.coarse_rotation(*(raster.gaussian_blur(d, ["g"], 1.5, 2.0) for d in (f, m)), ["g"], 64, 1.0, 0.5).collect()))
    assert [g[:4] for g in got] == [g[:4] for g in want] == [(1, 0.0, -3.0, 2.0), (2, 0.0, -3.0, 2.0)]
    assert np.allclose([g[4] for g in got], [g[4] for g in want])


def test_small_groups_send_only_the_best_trial(spark, monkeypatch):
    """Every group sent a row a trial (F4); a group of several chunks still does, with the same model."""
    from cytoloom.operators import models

    rng = np.random.default_rng(9)
    rows = [("g", i, float(x), float(y), float(x - 7 + 40 * (i % 3 == 0)), float(y + 4)) for i, (x, y) in enumerate(rng.uniform(0, 99, (60, 2)))]
    df = spark.createDataFrame(rows, "g string, id long, x1 double, y1 double, x2 double, y2 double")
    sent, got = [], []
    whole = models.map_chunks
    for per in (20_000, 10):
        monkeypatch.setattr(models, "map_chunks", lambda *a, per=per, **k: sent.append(whole(*a, per_chunk=per, **k)) or sent[-1])
        got.append([round(v, 9) for v in models.ransac(df, ["g"], "id", "translation", 2.0, 30)[0].select(*models.MODEL).first()])
    assert got[0] == got[1] == [1, 0, 7, 0, 1, -4]
    assert sent[0].count() == 1 and sent[1].count() > 30
