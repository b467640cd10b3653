import numpy as np
import pytest

from cytoloom.llm.peaks import density_peaks


def truth(x, ids, groups, r):
    label, dens = {}, {}
    for g in set(groups):
        at = np.flatnonzero([k == g for k in groups])
        d = np.sqrt(((x[at][:, None] - x[at][None]) ** 2).sum(2)) <= r
        for i, a in enumerate(at):
            dens[int(ids[a])] = int(d[i].sum())
        left = set(range(len(at)))
        while left:
            todo, comp = [left.pop()], set()
            while todo:
                p = todo.pop()
                comp.add(p)
                for q in np.flatnonzero(d[p]):
                    if int(q) in left:
                        left.discard(int(q))
                        todo.append(int(q))
            low = int(min(ids[at[p]] for p in comp))
            label |= {int(ids[at[p]]): low for p in comp}
    return label, dens


@pytest.mark.parametrize("cap", [40, 2000])
def test_labels_and_densities_equal_brute_force(spark, cap):
    rng = np.random.default_rng(0)
    chain = np.column_stack([np.arange(120) * 0.9 - 40, np.sin(np.arange(120) / 9) * 3 + 20])
    x = np.vstack([rng.normal(0, 6, (400, 2)), chain, np.repeat(rng.normal(20, 3, (10, 2)), 6, axis=0), rng.normal(0, 3, (50, 2))])
    ids = rng.permutation(len(x)) + 5
    groups = ["hot"] * 580 + ["small"] * 50
    df = spark.createDataFrame([(g, int(i), float(p[0]), float(p[1]), "z") for g, i, p in zip(groups, ids, x)], "g string, id long, x double, y double, label string")
    got = {r.id: r for r in density_peaks(df, ["g"], ["x", "y"], "id", 1.0, cap=cap).collect()}
    label, dens = truth(x, ids, groups, 1.0)
    assert {i: r.label for i, r in got.items()} == label
    assert {i: r.density for i, r in got.items()} == dens
    best = {}
    for g in set(groups):
        at = [i for i in range(len(x)) if groups[i] == g]
        for i in at:
            d = np.sqrt(((x[at] - x[i]) ** 2).sum(1))
            up = [(float(d[k]), -dens[int(ids[j])], int(ids[j])) for k, j in enumerate(at) if d[k] <= 1.0 and (-dens[int(ids[j])], ids[j]) < (-dens[int(ids[i])], ids[i])]
            best[int(ids[i])] = min(up) if up else None
    assert {i: r.denser for i, r in got.items()} == {i: b and b[2] for i, b in best.items()}
    assert all(r.delta == pytest.approx(best[i][0]) if best[i] else r.delta is None for i, r in got.items())
    for i, r in got.items():
        at = i
        while best[at]:
            at = best[at][2]
        assert r.peak == at and got[at].label == r.label


def test_edges(spark):
    rows = [("a", 1, 0.0, 0.0), ("a", 2, None, 0.0), ("a", 3, float("nan"), 1.0), (None, 4, 0.0, 0.0), ("a", None, 0.0, 0.0), ("b", 5, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double")
    assert sorted((r.id, r.density, r.label, r.denser) for r in density_peaks(df, ["g"], ["x", "y"], "id", 1.0).collect()) == [(1, 1, 1, None), (5, 1, 5, None)]
    assert density_peaks(df.limit(0), ["g"], ["x", "y"], "id", 1.0).count() == 0
