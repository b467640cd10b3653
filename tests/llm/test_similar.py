import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.llm.similar import Quantiser, Tree, _scan, nearest_by_scan, p1_recall, similar_vectors


def cols(d):
    return [F.col(f"v{i}") for i in range(d)]


def table(spark, x, ids=None):
    d = x.shape[1]
    rows = [(int(i), *map(float, v)) for i, v in zip(np.arange(len(x)) if ids is None else ids, x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"v{i} double" for i in range(d)))


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], d


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (1500, 4)), rng.normal(5, 0.1, (500, 4))])
    want, _ = brute(x, 5)
    got = similar_vectors(table(spark, x), "id", cols(4), 5).toPandas()
    by = got.groupby("id").neighbour.apply(set)
    hit = sum(len(by[i] & set(want[i])) for i in range(len(x)))
    assert len(got) == 10_000 and hit >= 0.9 * 10_000


def test_within_a_distance_nothing_is_missed(spark):
    x = np.random.default_rng(1).uniform(0, 1, (1500, 4))
    want, d = brute(x, 3)
    pairs = {(i, int(j)) for i in range(len(x)) for j in want[i] if d[i, j] <= 0.08}
    got = {(r.id, r.neighbour) for r in similar_vectors(table(spark, x), "id", cols(4), 3, max_distance=0.08).collect()}
    assert got == pairs and len(pairs) > 100


@pytest.mark.parametrize("fanout,levels", [(8, 4), (3, 6)])
def test_a_deeper_tree_finds_the_same(spark, fanout, levels):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.uniform(0, 1, (1500, 4)), rng.normal(0.5, 0.02, (500, 4))])
    want, d = brute(x, 3)
    pairs = {(i, int(j)) for i in range(len(x)) for j in want[i] if d[i, j] <= 0.05}
    got = similar_vectors(table(spark, x), "id", cols(4), 3, max_distance=0.05, leaf=16, fanout=fanout, levels=levels)
    assert {(r.id, r.neighbour) for r in got.collect()} == pairs
    by = similar_vectors(table(spark, x), "id", cols(4), 3, leaf=64, fanout=fanout, levels=levels).toPandas().groupby("id").neighbour.apply(set)
    assert sum(len(by[i] & set(want[i])) for i in range(len(x))) >= 0.9 * 3 * len(x)


def test_recall_is_measured_against_every_row(spark, sf):
    x = np.random.default_rng(9).normal(0, 1, (700, 4))
    want, _ = brute(x, 4)
    got = nearest_by_scan(table(spark, x), "id", cols(4), 4, F.col("id") % 7 == 0, block=30).toPandas()
    assert {i: set(g) for i, g in got.groupby("id").neighbour} == {i: set(want[i].tolist()) for i in range(0, 700, 7)}
    assert p1_recall(spark, sf).first().enough


def test_scan_reaches_every_vector_within(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 4))
    pq = Quantiser(x)
    i, j, _ = _scan(x, np.arange(400), x, np.arange(400), np.zeros(4), pq, 400, 8, 0.6)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(d <= 0.6))))


def test_anisotropic_loss_lowers_parallel_error():
    r = np.random.default_rng(3).normal(0, 1, (4000, 4))
    u = r / np.linalg.norm(r, axis=1, keepdims=True)
    along = lambda q: np.mean((((r - q.decode(q.encode(r))) * u).sum(1)) ** 2)
    assert along(Quantiser(r, threshold=0.8)) < along(Quantiser(r, threshold=0.0))


def test_crowds_of_equal_vectors_and_ties(spark):
    x = np.vstack([np.zeros((300, 4)), np.ones((3, 4)), np.full((1, 4), 9.0)])
    got = similar_vectors(table(spark, x), "id", cols(4), 2).toPandas()
    by = got.sort_values(["id", "distance", "neighbour"]).groupby("id").neighbour.apply(list)
    assert by[0] == [1, 2] and by[1] == [0, 2] and by[200] == [0, 1]
    assert by[300] == [301, 302] and len(by) == 304 and (got.groupby("id").size() == 2).all()


def test_queries_search_all_rows_and_bad_rows_take_no_part(spark):
    rows = [(0, 0.0, 0.0), (1, 0.1, 0.0), (2, None, 0.0), (3, float("nan"), 0.0), (None, 0.0, 0.0), (4, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "id long, v0 double, v1 double").withColumn("leaf", F.lit("x"))
    got = {(r.id, r.neighbour) for r in similar_vectors(df, "id", cols(2), 5, query=F.col("id") == 4).collect()}
    assert got == {(4, 0), (4, 1)}
    assert similar_vectors(df.limit(0), "id", cols(2), 5).count() == 0
    assert similar_vectors(df.where("id = 0"), "id", cols(2), 5).count() == 0


def test_tree_finds_the_nearest_leaves():
    x = np.random.default_rng(4).normal(0, 1, (3000, 3))
    t = Tree(x, 40)
    d = ((x[:, None] - t.leaf[None]) ** 2).sum(2)
    assert (t.probe(x, 1)[:, 0] == d.argmin(1)).mean() > 0.97
    assert (np.diff(np.take_along_axis(d, t.probe(x, 4), 1), axis=1) >= 0).all()


@pytest.mark.parametrize("d", [1, 2, 5])
def test_other_dimensions(spark, d):
    x = np.random.default_rng(d).normal(0, 1, (200, d))
    want, _ = brute(x, 2)
    got = similar_vectors(table(spark, x), "id", cols(d), 2).toPandas().groupby("id").neighbour.apply(set)
    assert sum(len(got[i] & set(want[i])) for i in range(200)) >= 360
