import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import consensus, matching
from cytoloom.operators.graph import components


def scan(rows, top_k=None):
    used1, used2, out = set(), set(), []
    for d, a, b in sorted(rows):
        if a not in used1 and b not in used2:
            used1.add(a)
            used2.add(b)
            out.append((a, b))
            if len(out) == top_k:
                break
    return sorted(out)


@pytest.mark.parametrize("seed,top_k", [(1, None), (2, 25)])
def test_greedy_equals_a_sequential_scan(spark, seed, top_k):
    rng = random.Random(seed)
    rows = {(g, rng.randrange(60), rng.randrange(60)): rng.randrange(12) / 4 for g in "ab" for _ in range(500)}
    df = spark.createDataFrame([(*k, v) for k, v in rows.items()], "g string, id1 int, id2 int, distance double")
    got = matching.greedy_match(df, ["g"], top_k=top_k).collect()
    for g in "ab":
        assert sorted((r.id1, r.id2) for r in got if r.g == g) == scan([(v, k[1], k[2]) for k, v in rows.items() if k[0] == g], top_k)


def test_greedy_edges(spark):
    df = spark.createDataFrame([(1, 1, float("nan")), (1, 2, None), (2, 2, float("inf")), (3, 3, 0.5)], "id1 int, id2 int, distance double")
    assert [(r.id1, r.id2) for r in matching.greedy_match(df).collect()] == [(3, 3)]
    assert matching.greedy_match(df.limit(0)).count() == 0
    assert matching.greedy_match(df, threshold=0.1).count() == 0


def balanced(rows, top_k, threshold, least=1):
    """Sequential: forced per patch, quota, fill."""
    order = sorted(rows)
    u1, u2, out, n = set(), set(), [], {p: 0 for _, _, _, p in rows}
    quota = max(least, top_k // len(n))

    def run(phase, limit, cut, thr):
        for d, a, b, p in order:
            if cut and len(out) >= top_k:
                return
            if (thr is None or d <= thr) and a not in u1 and b not in u2 and (limit is None or n[p] < limit):
                u1.add(a), u2.add(b)
                n[p] += 1
                out.append((a, b, phase))

    run(1, least, False, None)
    run(2, quota, True, threshold)
    run(3, None, True, threshold)
    return sorted(out)


def test_patch_balanced_equals_a_sequential_scan(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        patch = [rng.randrange(5) for _ in range(40)]
        rows = [(d, a, b, patch[a]) for (a, b), d in {(rng.randrange(40), rng.randrange(40)): rng.randrange(16) / 4 for _ in range(250)}.items()]
        df = spark.createDataFrame([("g", a, b, d, p) for d, a, b, p in rows], "g string, id1 int, id2 int, distance double, patch int")
        got = matching.patch_balanced_match(df, ["g"], "patch", 22, threshold=3.0)
        assert sorted((r.id1, r.id2, r.phase) for r in got.collect()) == balanced(rows, 22, 3.0)


def test_components(spark):
    e = [(i, i + 1) for i in range(60) if i != 30] + [(100, 101), (7, 7), (101, 100)]
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 500]], "node long")
    got = {r.node: r.label for r in components(nodes, spark.createDataFrame(e, "a long, b long")).collect()}
    assert got[30] == 0 and got[31] == 31 and got[60] == 31 and got[101] == 100 and got[500] == 500
    assert components(nodes, spark.createDataFrame([], "a long, b long")).where("node = label").count() == 64


def test_required_columns_and_quality(spark):
    df = spark.createDataFrame([("g", 1, 1, 0.0), ("g", 2, 2, 0.0)], "g string, id1 int, id2 int, distance double")
    with pytest.raises(ValueError, match="area"):
        matching.require_columns(df, ["distance", "area"])
    q = matching.match_quality(df, ["g"]).first()
    assert q.n_matches == 2 and q.mean_confidence == 1.0 and q.std_distance == 0


def test_direction_consensus_at_its_limits(spark):
    rows = [("p", i, 10.0, 0.1 * i) for i in range(5)] + [("p", 9, -10.0, 0.0), ("p", 10, 20.0, 0.0), ("q", 20, 1.0, 0.0), ("q", 21, -1.0, 0.0), ("p", 11, 0.1, 0.0)]
    df = spark.createDataFrame(rows, "patch string, id int, dx double, dy double")
    got = {r.id for r in consensus.direction_consensus(df, ["patch"], "id").collect()}
    n = np.mean([np.hypot(10, 0.1 * i) for i in range(5)] + [20.0])
    assert {20, 21} <= got and 9 not in got and 11 not in got and (10 in got) == (abs(20 - n) <= 5)


@pytest.mark.parametrize("deg", [0.4, 5.0, 5.5, 60.0])
def test_direction_consensus_equals_brute_force(spark, deg):
    rng = np.random.default_rng(3)
    rows = []
    for p in range(12):
        a = np.r_[rng.normal(p * 33, 4, 40), rng.uniform(0, 360, 40), [p * 33.0] * 5]
        n = np.r_[rng.normal(20, 3, 60), rng.uniform(0.2, 40, 25)]
        rows += [(p, 1000 * p + i, float(r * np.cos(np.radians(t))), float(r * np.sin(np.radians(t)))) for i, (t, r) in enumerate(zip(a, n))]
    df = spark.createDataFrame(rows, "patch int, id int, dx double, dy double")
    got = {r.id for r in consensus.direction_consensus(df, ["patch"], "id", deg).collect()}
    want = set()
    for p in range(12):
        ids, v = [r[1] for r in rows if r[0] == p], np.array([r[2:] for r in rows if r[0] == p])
        n, a = np.hypot(*v.T), np.degrees(np.arctan2(v[:, 1], v[:, 0]))
        turn = np.abs((a[:, None] - a[None] + 540) % 360 - 180)
        votes = ((turn <= deg) & (n >= 1)[None, :]).sum(1) * (n >= 1)
        lead = int(np.argmax(votes))
        along = (n >= 1) & ((v @ v[lead]) / (n * n[lead] + 1e-8) >= np.cos(np.radians(deg)))
        stay = along & (np.abs(n - n[along].mean()) <= 5) if along.sum() >= 3 else along
        applies = votes[lead] >= 2 and 3 <= stay.sum() < len(ids)
        want |= {i for i, s in zip(ids, stay) if s or not applies}
    assert got == want


def test_parallel_and_pass_through(spark):
    m = spark.createDataFrame([("a", 1, 10.0, 0.0), ("a", 2, 0.0, 10.0), ("b", 3, 0.1, 0.0)], "g string, id int, dx double, dy double")
    ref = spark.createDataFrame([("a", 5.0, 0.0), ("b", 0.0, 0.0)], "g string, dx0 double, dy0 double")
    assert {r.id for r in consensus.parallel_displacements(m, ref, ["g"]).collect()} == {1}
    assert {r.id for r in consensus.parallel_displacements(m, ref, ["g"], pass_short=True).collect()} == {1, 3}


def test_hard_constraints_skip_missing_columns(spark):
    m = spark.createDataFrame([(1, 100.0, 240.0), (2, 100.0, 260.0)], "id int, area_1 double, area_2 double")
    assert [r.id for r in matching.hard_constraints(m).collect()] == [1]
    assert matching.hard_constraints(m.select("id")).count() == 2
    assert matching.validate_matches(m.withColumn("distance", F.lit(0.1)).withColumn("g", F.lit(1)), ["g"], ["area"], max_feature_diff=0.7).count() == 2


@pytest.mark.parametrize("scanned,most", [(250_000, 6), (45, 40)])
def test_greedy_chains_take_few_rounds(spark, monkeypatch, scanned, most):
    """A chain, of which a round takes one pair, took as many rounds as it has pairs (F1)."""
    monkeypatch.setattr(matching, "SCANNED", scanned)
    tables = []
    cut = matching.cut
    monkeypatch.setattr(matching, "cut", lambda df: tables.append(1) or cut(df))
    rows = [(g, i, j, float(i + j)) for g in "ab" for i in range(25) for j in (i, i + 1)]
    df = spark.createDataFrame(rows, "g string, id1 int, id2 int, distance double")
    got = matching.greedy_match(df, ["g"]).collect()
    assert sorted((r.g, r.id1, r.id2) for r in got) == [(g, i, i) for g in "ab" for i in range(25)]
    assert len(tables) <= most


def test_neighbour_profiles_equal_their_definition(spark):
    from cytoloom.operators.neighbors import knn

    rng = np.random.default_rng(8)
    df = spark.createDataFrame([("p", i, *map(float, rng.uniform(0, 99, 2))) for i in range(9)] + [("q", 20 + i, *map(float, rng.uniform(0, 99, 2))) for i in range(3)], "g string, id long, centroid_x double, centroid_y double")
    near = knn(df, None, ["g"], ["centroid_x", "centroid_y"], "id", 6)
    pairs = spark.createDataFrame([(i, 20 + i % 3) for i in range(9)], "id1 long, id2 long")
    at = {r.id: np.array([r.centroid_x, r.centroid_y]) for r in df.collect()}
    of = {}
    for r in sorted(near.collect(), key=lambda r: r.ordinal):
        of.setdefault(r.id, []).append(r.neighbour)

    def profile(i):
        v = np.array([at[j] - at[i] for j in (of[i] + [of[i][-1]] * 4)[:4]])
        return np.hypot(*v.T), v / max(np.median(np.hypot(*v.T)), 1.0)

    got = {(r.id1, r.id2): r for r in matching.neighbour_profile(near, near, df, df, pairs, "id", 4).collect()}
    assert len(got) == 9
    for (i, j), r in got.items():
        (d1, v1), (d2, v2) = profile(i), profile(j)
        dist = np.median(np.abs(d1 - d2) / np.maximum(np.maximum(d1, d2), 1))
        apart = np.hypot(*(v1[:, None] - v2[None]).transpose(2, 0, 1))
        vec = (np.median(apart.min(1)) + np.median(apart.min(0))) / 2
        assert np.allclose([r.neighbor_distance_diff, r.neighbor_vector_diff, r.neighbor_profile_diff], [dist, vec, max(dist, vec)])
