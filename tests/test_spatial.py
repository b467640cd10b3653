import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import neighbors
from cytoloom.operators.neighbors import knn, mutual_nearest, radius_pairs
from cytoloom.operators.spatial import distances, radius_join, region_of, voronoi_blocks, vp_pairs
from cytoloom.queries import points


def brute(x, ids, r, metric="euclidean"):
    d = distances(x, x, metric)
    i, j = np.nonzero(d <= r)
    return {(int(ids[a]), int(ids[b])) for a, b in zip(i, j) if ids[a] < ids[b]}


def frame(spark, x, ids, groups):
    rows = [(g, int(i), float(p[0]), float(p[1])) for g, i, p in zip(groups, ids, x)]
    return spark.createDataFrame(rows, "g string, id long, x double, y double")


@pytest.mark.parametrize("metric,r", [("euclidean", 0.7), ("haversine", 90_000.0)])
def test_vp_tree_equals_brute_force(metric, r):
    x = np.random.default_rng(1).uniform(-8, 8, (700, 2))
    i, j, d = vp_pairs(x, np.arange(len(x)), r, metric, leaf=16)
    want = distances(x, x, metric)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(want <= r))))
    assert np.allclose(d, want[i, j])


def test_vp_tree_with_many_equal_points():
    x = np.zeros((200, 2))
    i, _, _ = vp_pairs(x, np.arange(200), 0.5, leaf=8)
    assert len(i) == 200 * 200


@pytest.mark.parametrize("metric,r", [("euclidean", 1.5), ("haversine", 150_000.0)])
def test_hot_group_is_split_and_complete(spark, metric, r):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 8, (900, 2)), rng.normal(40, 0.8, (300, 2)), rng.uniform(0, 60, (60, 2))])
    ids, groups = np.arange(len(x)), ["hot"] * 1200 + ["a"] * 30 + ["b"] * 30
    df = frame(spark, x, ids, groups)
    got = {(r_.id_1, r_.id_2) for r_ in radius_join(df, ["g"], ["x", "y"], "id", r, metric, cap=100).collect()}
    want = set()
    for g in ("hot", "a", "b"):
        at = np.array([k == g for k in groups])
        want |= brute(x[at], ids[at], r, metric)
    assert got == want and len(want) > 500


def test_blocks_stay_under_the_cap_and_keep_every_core_point_once(spark):
    x = np.random.default_rng(3).normal(0, 5, (3000, 2))
    df = frame(spark, x, np.arange(3000), ["h"] * 3000)
    b = voronoi_blocks(df, ["g"], ["x", "y"], "id", 0.1, cap=200).where("core")
    assert b.count() == 3000 == b.select("id").distinct().count()
    assert b.groupBy("block").count().agg(F.max("count")).first()[0] <= 200


def test_more_heavy_blocks_than_pass_through_the_driver(spark):
    x = np.random.default_rng(4).normal(0, 5, (1200, 2))
    groups = [f"g{i % 3}" for i in range(1200)]
    df = frame(spark, x, np.arange(1200), groups)
    a = voronoi_blocks(df, ["g"], ["x", "y"], "id", 0.2, cap=100, driver_blocks=1).where("core")
    assert a.select("id").distinct().count() == 1200 == a.count()


def test_radius_join_edge_cases(spark):
    nan = float("nan")
    rows = [("a", 1, 0.0, 0.0, "k"), ("a", 2, 0.0, 0.0, "k"), ("a", 3, nan, 0.0, "k"), ("a", 4, None, 0.0, "k"), (None, 5, 0.0, 0.0, "k"), ("a", None, 0.0, 0.0, "k"), ("b", 6, 0.0, 0.0, "k"), ("a", 7, 1.0, 0.0, "k"), ("a", 8, float("inf"), 0.0, "k"), ("a", 2, 0.0, 0.0, "k")]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double, block string")
    got = sorted((r.id_1, r.id_2) for r in radius_join(df, ["g"], ["x", "y"], "id", 1.0).collect())
    assert sorted(set(got)) == [(1, 2), (1, 7), (2, 7)]  # inclusive; the column called block is ignored
    assert radius_join(df.limit(0), ["g"], ["x", "y"], "id", 1.0).count() == 0


def test_p4_on_a_fixture_with_repeated_rows(spark, tmp_path):
    t = "timestamp'2025-01-01 00:00:00'"
    q = f"""SELECT * FROM VALUES (1L, 's', 1, 0D, 0D, {t}), (2L, 's', 1, 5D, 5D, {t}), (2L, 's', 1, 5D, 5D, {t} + interval 1 day), (3L, 's', 2, 0D, 0D, {t}), (4L, 's', 1, 100D, 0D, {t})
      AS v(cell_key, slide_id, round_no, centroid_x, centroid_y, ingested_at)"""
    spark.sql(q).write.parquet(f"{tmp_path}/cell_features.parquet")
    assert [tuple(r) for r in points.p4_found(spark, str(tmp_path)).collect()] == [(1, 2)]


def test_knn_equals_brute_force_in_a_split_group(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (500, 2)), rng.normal(30, 10, (200, 2))])
    df = frame(spark, x, np.arange(700), ["h"] * 700)
    got = {(r.id, r.ordinal): r.neighbour for r in knn(df, None, ["g"], ["x", "y"], "id", 4, cap=80).collect()}
    d = distances(x, x, "euclidean")
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert len(got) == 2800 and all(got[i, k + 1] == want[i, k] for i in range(700) for k in range(4))


def test_knn_of_small_groups_gives_what_there_is(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 1.0, 0.0), ("b", 3, 0.0, 0.0)], "g string, id long, x double, y double")
    assert sorted((r.id, r.neighbour) for r in knn(df, None, ["g"], ["x", "y"], "id", 3).collect()) == [(1, 2), (2, 1)]
    assert knn(df.limit(0), None, ["g"], ["x", "y"], "id", 3).count() == 0


def test_knn_of_large_groups_with_few_candidates(spark):
    x = np.random.default_rng(6).normal(0, 10, (200, 2))
    q = frame(spark, x, np.arange(200), ["a"] * 100 + ["b"] * 100)
    data = spark.createDataFrame([("a", 900, 0.0, 0.0), ("a", 901, 50.0, 0.0), ("b", 902, 1.0, 1.0), *[("c", 903 + i, float(i), 0.0) for i in range(9)]], "g string, id long, x double, y double")
    at = {900: (0.0, 0.0), 901: (50.0, 0.0), 902: (1.0, 1.0)}
    got = {(r.id, r.ordinal): (r.neighbour, r.distance) for r in knn(q, data, ["g"], ["x", "y"], "id", 5, cap=40).collect()}
    assert len(got) == 300 and {i for i, o in got if o == 2} == set(range(100))
    for i in range(200):
        want = sorted((float(np.hypot(*(x[i] - at[n]))), n) for n in ((900, 901) if i < 100 else (902,)))
        assert [got[i, o + 1][0] for o in range(len(want))] == [n for _, n in want] and abs(got[i, 1][1] - want[0][0]) < 1e-6
    one = knn(q.drop("g"), data.where("g = 'a'").drop("g"), [], ["x", "y"], "id", 5, cap=40)
    assert one.count() == 400


def test_radius_pairs_and_mutual_nearest(spark):
    f = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 3.0, 0.0)], "g string, id long, x double, y double")
    m = spark.createDataFrame([("a", 10, 0.5, 0.0), ("a", 11, 1.6, 0.0), ("b", 12, 0.0, 0.0)], "g string, id long, x double, y double")
    assert sorted((r.id1, r.id2) for r in radius_pairs(f, m, ["g"], ["x", "y"], "id", 1.6).collect()) == [(1, 10), (1, 11), (2, 11)]
    assert sorted((r.id1, r.id2) for r in mutual_nearest(f, m, ["g"], ["x", "y"], "id", 5.0).collect()) == [(1, 10), (2, 11)]


def test_region_of(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0), (3, 25.0, 5.0)], "id long, x double, y double")
    r = spark.createDataFrame([("r", 0.0, 0.0, 10.0, 10.0), ("s", 20.0, 0.0, 30.0, 10.0), ("t", 5.0, 0.0, 5.0, 9.0)], "region_id string, x0 double, y0 double, x1 double, y1 double")
    assert {(a.id, a.region_id) for a in region_of(p, r, "x", "y", 8.0).collect()} == {(1, "r"), (2, None), (3, "s")}


@pytest.mark.parametrize("at", [(0.0, 0.0), (180.0, 0.0), (-180.0, 90.0), (10.0, -90.0), (0.0, 60.0)])
def test_great_circles_are_exact_anywhere(at):
    """Points within a metre of a place, also opposite to a vantage point, at a radius of two centimetres."""
    rng = np.random.default_rng(7)
    x = np.array(at)[None, :] + rng.uniform(-1, 1, (400, 2)) * 1e-5 * np.array([1 / max(np.cos(np.radians(at[1])), 1e-3), 1])
    x[:, 1] = np.clip(x[:, 1], -90, 90)
    far = np.vstack([x, [[at[0] + 180, -at[1]]]])[np.r_[0:200, 400, 200:400]]  # the vantage point is the middle one
    i, j, _ = vp_pairs(far, np.arange(401), 0.02, "haversine")
    d = distances(far, far, "haversine")
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(d <= 0.02)))) and len(i) > 401
    u = np.radians(far)
    h = np.sin((u[:, None, 1] - u[None, :, 1]) / 2) ** 2 + np.cos(u[:, None, 1]) * np.cos(u[None, :, 1]) * np.sin((u[:, None, 0] - u[None, :, 0]) / 2) ** 2
    near = h < 0.5
    assert np.allclose(d[near], 2 * 6_371_008.8 * np.arcsin(np.sqrt(h[near])), atol=1e-6)


def test_a_crowd_at_one_place_is_several_tasks(spark):
    x = np.zeros((300, 2))
    df = frame(spark, x, np.arange(300), ["h"] * 300)
    b = voronoi_blocks(df, ["g"], ["x", "y"], "id", 0.5, cap=60)
    cores = b.where("core").groupBy("g", "block").count()
    assert cores.agg(F.max("count")).first()[0] < 150 and cores.count() >= 4 and b.where("core").count() == 300
    assert radius_join(df, ["g"], ["x", "y"], "id", 0.5, cap=60).count() == 300 * 299 // 2


@pytest.mark.parametrize("d", [1, 3, 64])
def test_knn_in_other_dimensions_and_densities(spark, d):
    rng = np.random.default_rng(d)
    x = np.vstack([rng.normal(0, 1, (300, d)), rng.normal(0, 500, (300, d))])
    cols = [f"v{i}" for i in range(d)]
    rows = [("dense" if i < 300 else "wide", i, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, id long, " + ", ".join(f"{c} double" for c in cols))
    got = {(r.id, r.ordinal): r.neighbour for r in knn(df, None, ["g"], cols, "id", 3, cap=64).collect()}
    for s in (0, 300):
        dist = distances(x[s : s + 300], x[s : s + 300], "euclidean")
        np.fill_diagonal(dist, np.inf)
        want = np.argsort(dist, axis=1, kind="stable")[:, :3] + s
        assert all(got[i + s, k + 1] == want[i, k] for i in range(300) for k in range(3))
    assert len(got) == 1800
    assert knn(df.limit(0), None, ["g"], cols, "id", 3).count() == 0
    assert knn(df.where("id < 2"), df.where("id >= 2"), [], cols, "id", 3).count() == 6


def test_regions_of_all_sizes_in_groups(spark):
    rng = np.random.default_rng(11)
    boxes = [(g, f"{g}{i}", *map(float, (x, y, x + w, y + h))) for g in "ab" for i in range(40) for x, y, w, h in [(*rng.uniform(-500, 500, 2), *np.exp(rng.uniform(-3, 8, 2)))]]
    boxes += [("a", "none", 5.0, 5.0, None, 9.0), ("a", "nan", 0.0, 0.0, float("nan"), 9.0), ("a", "flat", 0.0, 0.0, 0.0, 9.0)]
    pts = [(i, "abc"[i % 3], *map(float, rng.uniform(-600, 600, 2))) for i in range(300)] + [(1000, "a", None, 1.0), (1001, "a", float("nan"), 1.0), (1002, None, 0.0, 0.0)]
    p = spark.createDataFrame(pts, "id long, g string, x double, y double").withColumn("x0", F.lit("clash"))
    r = spark.createDataFrame(boxes, "g string, region_id string, x0 double, y0 double, x1 double, y1 double")
    got = {(a.id, a.region_id) for a in region_of(p, r, "x", "y", 4.0, ["g"]).collect()}
    want = set()
    for i, g, x, y in pts:
        hit = {b[1] for b in boxes[:-3] if x is not None and b[0] == g and b[2] <= x < b[4] and b[3] <= y < b[5]}
        want |= {(i, h) for h in hit} or {(i, None)}
    assert got == want
    assert {a.region_id for a in region_of(p, r.limit(0), "x", "y").collect()} == {None}


@pytest.mark.parametrize("whole", [0, 10_000])
def test_knn_searches_whole_groups_and_blocks_alike(spark, monkeypatch, whole):
    """Groups over the cap were copied to blocks at a radius for even density, which heavy tails make far too wide (F1)."""
    monkeypatch.setattr(neighbors, "WHOLE", whole)
    levels = []
    blocks = neighbors.voronoi_blocks
    monkeypatch.setattr(neighbors, "voronoi_blocks", lambda *a, **k: levels.append(1) or blocks(*a, **k))
    rng = np.random.default_rng(6)
    x = np.round(rng.standard_t(1.5, (1500, 3)), 1)  # ties and tails
    rows = [("g", i, *map(float, x[i])) for i in range(1500)] + [("h", i, *map(float, x[i])) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double, z double")
    got = {(r.g, r.id, r.ordinal): (r.neighbour, r.distance) for r in knn(df, None, ["g"], ["x", "y", "z"], "id", 5, cap=300).collect()}
    d = np.sqrt(sum((x[:, i][:, None] - x[:, i][None]) ** 2 for i in range(3)))
    np.fill_diagonal(d, np.inf)
    o = np.argsort(d, axis=1, kind="stable")[:, :5]
    want = {("g", i, j + 1): (o[i, j], d[i, o[i, j]]) for i in range(1500) for j in range(5)}
    assert {k: v for k, v in got.items() if k[0] == "g"} == want and len(got) == len(want) + 6
    assert bool(levels) == (whole == 0)
