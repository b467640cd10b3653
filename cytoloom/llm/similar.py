"""Most similar vectors for every vector.

Vectors are parted by a tree of centres. Its upper levels are fitted on a bounded sample; a leaf that still holds too
many vectors is parted further around centres fitted on a sample of its own, level by level, in tasks, so that leaves
stay of one size however many vectors there are. Inside a leaf residuals are quantised to two four-bit codes, packed in
a byte, under a loss that weighs the error parallel to the vector above the error across it, as only the former moves
the largest inner products. A query looks up its tables for the codes of the leaves it probes and reranks the best
candidates by exact distance.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoloom.operators.models import map_chunks
from cytoloom.runtime import column, cut, free, latest, map_groups, usable

CODES = 16
FANOUT = 4096  # of a level of the tree


def _centres(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    k = max(1, min(k, len(x)))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=k)
        s = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances less the squared lengths of ``x``."""
    return (c * c).sum(1)[None, :] - 2 * (x @ c.T)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _squares(x, c).argmin(1)


def _within(x: np.ndarray, c: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and centres whose cells may hold a vector within ``radius`` of the row: by the triangle inequality those at
    most two radii farther than the nearest centre."""
    xx, cc = (x * x).sum(1), (c * c).sum(1)
    d = np.sqrt(np.maximum(xx[:, None] + _squares(x, c), 0))
    rounding = 2e-7 * np.sqrt(xx + cc.max())  # squares of like sizes cancel to half their digits
    return np.nonzero(d <= (d.min(1) + 2 * radius + 2 * rounding)[:, None])


def _some(x: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the ``n`` (of each row) centres nearest to them."""
    most = int(min(n.max(initial=1), len(c)))
    d = _squares(x, c)
    at = np.argsort(d, axis=1, kind="stable")[:, :most] if most * 4 > len(c) else np.argpartition(d, most - 1, axis=1)[:, :most]
    at = np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, 1), axis=1, kind="stable"), 1)
    i, j = np.nonzero(np.arange(most)[None, :] < n[:, None])
    return i, at[i, j]


class Tree:
    """Two levels of centres. A vector's own leaf is the nearest under the nearest upper centre."""

    def __init__(self, x: np.ndarray, leaves: int, seed: int = 0):
        wide = max(1, int(np.sqrt(leaves)))
        self.top = _centres(x, wide, seed)
        own = _nearest(x, self.top)
        self.sub = [_centres(x[own == i], max(1, round(leaves * float((own == i).mean()))), seed + i) if (own == i).any() else self.top[i : i + 1] for i in range(len(self.top))]
        self.start = np.concatenate([[0], np.cumsum([len(s) for s in self.sub])])
        self.leaf = np.concatenate(self.sub)

    def own(self, x: np.ndarray) -> np.ndarray:
        top = _nearest(x, self.top)
        leaf = np.empty(len(x), np.int64)
        for i in np.unique(top):
            at = np.flatnonzero(top == i)
            leaf[at] = self.start[i] + _nearest(x[at], self.sub[i])
        return leaf

    def reach(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves: every leaf that may hold a vector within ``radius`` of the row."""
        rows, top = _within(x, self.top, radius)
        out = [(np.empty(0, int), np.empty(0, int))]
        for i in np.unique(top):
            at = rows[top == i]
            r, leaf = _within(x[at], self.sub[i], radius)
            out.append((at[r], self.start[i] + leaf))
        return tuple(np.concatenate(c) for c in zip(*out))

    def probe(self, x: np.ndarray, n: int, wide: int = 4) -> np.ndarray:
        """(rows, n) leaf numbers, nearest first, among the leaves of the ``wide`` nearest upper centres;
        -1 where there are fewer."""
        wide = min(wide, len(self.top))
        r, top = _some(x, self.top, np.full(len(x), wide))
        best_d, best = np.full((len(x), n), np.inf), np.full((len(x), n), -1)
        for i in np.unique(top):
            rows = r[top == i]
            e = _squares(x[rows], self.sub[i])
            m = min(n, e.shape[1])
            at = np.argpartition(e, m - 1, axis=1)[:, :m] if m < e.shape[1] else np.broadcast_to(np.arange(m), e.shape)
            dd = np.concatenate([best_d[rows], np.take_along_axis(e, at, 1)], axis=1)
            ll = np.concatenate([best[rows], at + self.start[i]], axis=1)
            o = np.argsort(dd, axis=1, kind="stable")[:, :n]
            best_d[rows], best[rows] = np.take_along_axis(dd, o, 1), np.take_along_axis(ll, o, 1)
        return best


class Quantiser:
    """Product quantiser of residuals: half the dimensions to one four-bit code, half to another."""

    def __init__(self, r: np.ndarray, threshold: float = 0.7, rounds: int = 6, seed: int = 0):
        d = r.shape[1]
        self.cutoff = (d + 1) // 2
        # the weight of parallel error over orthogonal error for inner products beyond the threshold
        self.eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        self.books = [b[np.minimum(np.arange(CODES), len(b) - 1)] for b in (_centres(p, CODES, seed + i) for i, p in enumerate(self._parts(r)))]
        for _ in range(rounds):
            codes = self.encode(r)
            for m in range(len(self.books)):
                self._refit(r, codes, m)

    def _parts(self, r: np.ndarray) -> list[np.ndarray]:
        return [p for p in (r[:, : self.cutoff], r[:, self.cutoff :]) if p.shape[1]]

    def _spans(self) -> list[slice]:
        return [slice(0, self.cutoff), slice(self.cutoff, None)][: len(self.books)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Both codes of a vector in one byte."""
        return (codes[:, 0] + (CODES * codes[:, 1] if codes.shape[1] > 1 else 0)).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes) inner products of queries with what packed codes stand for."""
        t = [(q[:, sp] @ b.T).astype(np.float32) for sp, b in zip(self._spans(), self.books)]
        return t[0] if len(t) == 1 else (t[1][:, :, None] + t[0][:, None, :]).reshape(len(q), -1)

    def encode(self, r: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes of least score-aware loss, by coordinate descent over the two halves."""
        u = r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
        codes = np.stack([_nearest(p, b) for p, b in zip(self._parts(r), self.books)], axis=1)
        for _ in range(rounds):
            for m, s in enumerate(self._spans()):
                rest = r - self.decode(codes)
                other = (rest * u).sum(1) - (rest[:, s] * u[:, s]).sum(1)
                e = r[:, s][:, None, :] - self.books[m][None, :, :]
                along = other[:, None] + np.einsum("njk,nk->nj", e, u[:, s])
                codes[:, m] = ((e * e).sum(2) + (self.eta - 1) * along**2).argmin(1)
        return codes

    def _refit(self, r: np.ndarray, codes: np.ndarray, m: int) -> None:
        u = r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
        s = self._spans()[m]
        rest = r - self.decode(codes)
        other = (rest * u).sum(1) - (rest[:, s] * u[:, s]).sum(1)
        us, width = u[:, s], self.books[m].shape[1]
        for j in range(len(self.books[m])):
            at = codes[:, m] == j
            if at.sum() < 4:
                continue
            w = np.eye(width) * at.sum() + (self.eta - 1) * us[at].T @ us[at]
            rhs = r[at][:, s].sum(0) + (self.eta - 1) * (us[at] * ((r[at][:, s] * us[at]).sum(1) + other[at])[:, None]).sum(0)
            self.books[m][j] = np.linalg.solve(w, rhs)


def _scale(r: np.ndarray) -> float:
    """The spread of a leaf's residuals; codebooks are shared by leaves of any size."""
    return float(np.sqrt((r * r).sum(1).mean())) or 1.0


def _scan(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, centre: np.ndarray, pq: Quantiser, k: int, rerank: int, within: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of ``x`` to each query: rows of q, ids and distances. ``ids`` must ascend, for ties.

    The tables give the inner product of every query and code. Exact distances are taken of the ``rerank`` best
    by score, or, ``within`` a distance, of every vector whose code lies no farther than that distance and the
    vector's own quantisation error: none within it can be missed.
    """
    n = len(x)
    scale = _scale(x - centre)
    r = (x - centre) / scale
    codes = pq.encode(r)
    packed = pq.pack(codes)
    if within is None:
        bias = 0.5 * (r * r).sum(1)
    else:
        coded = pq.decode(codes)
        reach = within / scale + np.linalg.norm(r - coded, axis=1)
        bias = 0.5 * ((coded * coded).sum(1) - reach**2)
    bias = bias.astype(np.float32)
    depth = min(n, rerank + 1)
    rows, found, dist = [], [], []
    step = max(1, 2_000_000 // n)
    for a in range(0, len(q), step):
        part, mine = q[a : a + step], qids[a : a + step]
        s = (part - centre) / scale
        score = pq.tables(s)[:, packed]
        score -= bias
        if within is not None:
            half = 0.5 * (s * s).sum(1)
            i, j = np.nonzero(score >= (half - 1e-5 * (1 + half)).astype(np.float32)[:, None])
        elif depth < n:
            j = np.argpartition(score, n - depth, axis=1)[:, n - depth :].ravel()
            i = np.repeat(np.arange(len(s)), depth)
        else:
            i, j = np.repeat(np.arange(len(s)), n), np.tile(np.arange(n), len(s))
        d = np.zeros(len(i))
        for c in range(x.shape[1]):
            d += (x[j, c] - part[i, c]) ** 2
        d = np.sqrt(d)
        keep = ids[j] != mine[i]
        if within is not None:
            keep &= d <= within
        i, j, d = i[keep], j[keep], d[keep]
        o = np.lexsort((j, d, i))
        i, j, d = i[o], j[o], d[o]
        first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.empty(0, bool)
        place = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0)) if len(i) else np.empty(0, int)
        best = place < k
        rows.append(i[best] + a)
        found.append(ids[j[best]])
        dist.append(d[best])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(dist)


def _refined(probed: DataFrame, dims: list[str], leaf: int, most: int, probes: int, within: float | None, levels: int, fanout: int) -> DataFrame:
    """``probed`` (leaf, id, own, asks, rank, dims) with leaves of over ``most`` vectors parted around centres of their own,
    until there are none. A leaf's centres are fitted in one task, on about eight of its vectors for each."""
    schema = "leaf long, id long, own boolean, asks boolean, rank int, " + ", ".join(f"{c} double" for c in dims)
    before = None
    for level in range(1, levels + 1):
        heavy = cut(probed.where("own").groupBy("leaf").agg(F.count("*").alias("_n")).where(F.col("_n") > most))
        size = heavy.agg(F.count("*"), F.sum("_n")).first()
        if not size[0] or tuple(size) == before:
            break
        before = tuple(size)
        wanted = F.least(F.lit(fanout), F.ceil(F.col("_n") / leaf)).cast("int")
        drawn = probed.where("own").join(heavy, "leaf").where(F.pmod(F.xxhash64(F.lit(level), "id"), F.col("_n")) < 8 * wanted)

        def fit(t: pa.Table) -> pa.Table:
            x = np.column_stack([column(t, c) for c in dims])
            c = _centres(x, int(column(t, "_k")[0]), 0)
            return pa.table({"leaf": t.column("leaf").slice(0, 1), "centres": pa.array([c.ravel().tolist()], pa.list_(pa.float64()))})

        centres = map_groups(drawn.select("leaf", wanted.alias("_k"), "id", *dims), ["leaf"], fit, "leaf long, centres array<double>", sort=["id"])

        def part(t: pa.Table, side: pa.Table) -> pa.Table:
            c = np.array(side.column("centres")[0].as_py()).reshape(-1, len(dims))
            x = np.column_stack([column(t, d) for d in dims])
            held, asks, rank = column(t, "own").astype(bool), column(t, "asks").astype(bool), column(t, "rank")
            own = _nearest(x, c)
            a = np.flatnonzero(asks)
            # without a radius a query probes fewer of a leaf's parts the farther the leaf was
            r, j = _within(x[a], c, within) if within is not None else _some(x[a], c, np.maximum(1, probes >> rank[a].astype(int)))
            i = np.concatenate([np.flatnonzero(held), a[r]])
            j = np.concatenate([own[held], j])
            home = np.concatenate([np.ones(held.sum(), bool), np.zeros(len(r), bool)])
            doubled = ~home & held[i] & (j == own[i])  # told by its own row
            i, j, home = i[~doubled], j[~doubled], home[~doubled]
            return pa.table({"leaf": (column(t, "leaf")[i] + 1) * fanout + j, "id": column(t, "id")[i], "own": home, "asks": asks[i], "rank": rank[i].astype(np.int32), **{d: x[i, k] for k, d in enumerate(dims)}})

        rows = probed.join(heavy.select("leaf"), "leaf", "left_semi")
        was, probed = probed, cut(probed.join(heavy.select("leaf"), "leaf", "left_anti").unionByName(map_chunks(rows, centres, ["leaf"], "id", part, schema)))
        free(was, heavy)
    return probed


def similar_vectors(df: DataFrame, id_col: str, vector: Sequence[Column], k: int, query: Column | None = None, max_distance: float | None = None, probes: int = 8, rerank: int = 96, leaf: int = 256, sample: int = 32_768, levels: int = 4, fanout: int = FANOUT) -> DataFrame:
    """(id, neighbour, distance): the ``k`` nearest other vectors of each one, by Euclidean distance, smaller id
    first among equals. ``query`` picks the rows that ask; every row is searched. ``max_distance`` leaves out
    farther neighbours; then every leaf that may hold one within it is probed, and none is missed. Without it the
    ``probes`` nearest leaves are.

    The upper levels and the codebooks are fitted on the at most ``sample`` rows of least id hash, with at least eight for
    each of at most ``fanout`` leaves; leaves of over four times ``leaf`` vectors are parted on, at most ``levels`` times by
    up to ``fanout`` each. Every row is indexed. Vectors with a null or NaN entry, or a null id, take no part. Of equal
    vectors only the k+1 of least id are scanned; the others' neighbours are the k least, at distance 0, so that no
    leaf holds a crowd of copies. Ids must be unique. An empty table gives no rows; other columns are ignored.
    """
    dims = [f"z{i}" for i in range(len(vector))]
    v = df.select(F.col(id_col).cast("long").alias("id"), (F.lit(True) if query is None else F.coalesce(query, F.lit(False))).alias("asks"), *[c.cast("double").alias(z) for c, z in zip(vector, dims)])
    for c in ["id", *dims]:
        v = v.where(usable(c) if c != "id" else F.col("id").isNotNull())
    v = cut(v)
    total = v.count()
    drawn = v.where(F.pmod(F.xxhash64("id"), F.lit(max(1, total // (2 * sample)))) == 0).orderBy(F.xxhash64("id"), "id").select(*dims).limit(sample)
    x = drawn.toPandas().to_numpy(dtype=float).reshape(-1, len(dims))  # at most `sample` rows
    if not len(x):
        x = np.zeros((1, len(dims)))
    tree = Tree(x, max(1, min(fanout, len(x) // 8, total // leaf)))
    own = tree.own(x)
    rest = x - tree.leaf[own]
    spread_of = np.sqrt(np.bincount(own, (rest * rest).sum(1), len(tree.leaf)) / np.maximum(np.bincount(own, minlength=len(tree.leaf)), 1))
    pq = Quantiser(rest / np.where(spread_of > 0, spread_of, 1)[own][:, None])

    heads = cut(v.withColumn("copy", F.row_number().over(W.partitionBy(*dims).orderBy("id"))).where(F.col("copy") <= k + 1))
    crowded = heads.where(F.col("copy") == k + 1).select(*dims)
    many = crowded.limit(1).count() > 0  # whether any vector has more than k copies

    def spread(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            z = np.column_stack([column(t, c) for c in dims])
            home, asks = tree.own(z), column(t, "asks").astype(bool)
            a = np.flatnonzero(asks)
            if max_distance is not None:
                r, to = tree.reach(z[a], max_distance)
                rank = np.zeros(len(r), np.int32)
            else:
                near = tree.probe(z[a], probes)
                r, rank = np.nonzero(near >= 0)
                to = near[r, rank]
            other = to != home[a[r]]
            at_home = np.zeros(len(z), np.int32)
            at_home[a[r[~other]]] = rank[~other]
            i = np.concatenate([np.arange(len(z)), a[r[other]]])
            yield pa.record_batch({
                "leaf": np.concatenate([home, to[other]]), "id": column(t, "id")[i], "own": np.arange(len(i)) < len(z), "asks": asks[i],
                "rank": np.concatenate([at_home, rank[other]]).astype(np.int32), **{c: z[i, n] for n, c in enumerate(dims)},
            })

    probed = cut(heads.select("id", "asks", *dims).mapInArrow(spread, "leaf long, id long, own boolean, asks boolean, rank int, " + ", ".join(f"{c} double" for c in dims)))
    probed = _refined(probed, dims, leaf, 4 * leaf, probes, max_distance, levels, fanout)

    def search(t: pa.Table) -> pa.Table | None:
        o = np.argsort(column(t, "id"), kind="stable")
        ids, z = column(t, "id")[o], np.column_stack([column(t, c) for c in dims])[o]
        held, asks = column(t, "own").astype(bool)[o], column(t, "asks").astype(bool)[o]
        if not held.any() or not asks.any():
            return None
        q, n, d = _scan(z[held], ids[held], z[asks], ids[asks], z[held].mean(0), pq, k, rerank, max_distance)
        return pa.table({"id": ids[asks][q], "neighbour": n, "distance": d})

    found = map_groups(probed.drop("rank"), ["leaf"], search, "id long, neighbour long, distance double")
    if many:
        first = heads.where(F.col("copy") <= k).select(*dims, F.col("id").alias("neighbour"))
        found = found.unionByName(v.where("asks").join(first.join(crowded, dims, "left_semi"), dims).where("id <> neighbour").select("id", "neighbour", F.lit(0.0).alias("distance"))).distinct()
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "neighbour"))
    return found.withColumn("place", rank).where(F.col("place") <= k).select("id", "neighbour", "distance")


def nearest_by_scan(df: DataFrame, id_col: str, vector: Sequence[Column], k: int, query: Column, block: int = 1024) -> DataFrame:
    """(id, neighbour, distance) exactly as ``similar_vectors`` is to give them, by the distances of every row to the rows
    that ask: these go in blocks of about ``block`` beside chunks of the table. To measure recall."""
    dims = [f"z{i}" for i in range(len(vector))]
    v = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(query, F.lit(False)).alias("asks"), *[c.cast("double").alias(z) for c, z in zip(vector, dims)]).where("id is not null")
    for c in dims:
        v = v.where(usable(c))
    v = cut(v)
    asks = v.where("asks")
    blocks = max(1, -(-asks.count() // block))
    side = asks.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.col("id").alias("q"), *[F.col(c).alias(f"q{c}") for c in dims])
    rows = v.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", *dims)

    def near(t: pa.Table, side: pa.Table) -> pa.Table:
        o = np.argsort(column(t, "id"), kind="stable")
        ids, x = column(t, "id")[o], np.column_stack([column(t, c) for c in dims])[o]
        q, z = column(side, "q"), np.column_stack([column(side, f"q{c}") for c in dims])
        out = []
        step = max(1, 4_000_000 // len(x))
        for a in range(0, len(q), step):
            d = _squares(z[a : a + step], x)
            m = min(len(x), k + 2)  # itself, and one more for rounding
            at = np.argpartition(d, m - 1, axis=1)[:, :m] if m < len(x) else np.broadcast_to(np.arange(len(x)), d.shape)
            i, j = np.repeat(np.arange(len(at)), m), at.ravel()
            out.append((q[a + i], ids[j], np.sqrt(((x[j] - z[a + i]) ** 2).sum(1))))
        i, j, d = (np.concatenate(c) for c in zip(*out))
        keep = i != j
        return pa.table({"id": i[keep], "neighbour": j[keep], "distance": d[keep]})

    found = map_chunks(rows, side, ["block"], "id", near, "id long, neighbour long, distance double")
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "neighbour"))
    return found.withColumn("place", rank).where(F.col("place") <= k).select("id", "neighbour", "distance")


SCALES = {"hu_0": 0.12, "area": 180.0, "eccentricity": 0.17, "solidity": 0.03}
FOUND_DISTANCE, FOUND_K = 0.0045, 3


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return latest(spark.read.parquet(f"{sf}/cell_features.parquet"), ["cell_key"], ["ingested_at"], list(SCALES))


def _vector() -> list[Column]:
    return [F.col(c) / s for c, s in SCALES.items()]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of cells that look all but the same, one of them among the other's three nearest."""
    near = similar_vectors(_cells(spark, sf), "cell_key", _vector(), FOUND_K, max_distance=FOUND_DISTANCE)
    return near.select(F.least("id", "neighbour").alias("cell_key_1"), F.greatest("id", "neighbour").alias("cell_key_2")).distinct()


def p1_similar(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most similar cells of every fiftieth cell, searched among all cells."""
    near = similar_vectors(_cells(spark, sf), "cell_key", _vector(), 10, query=F.col("cell_key") % 50 == 0)
    return near.select(F.col("id").alias("cell_key"), F.col("neighbour").alias("similar_key"), F.round("distance", 9).alias("distance"))


def p1_recall(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    """Of the exact neighbours of every fiftieth cell, whether ``p1_similar`` finds nine tenths at least: by distance, as
    equally far ones serve as well."""
    cells, asks = cut(_cells(spark, sf)), F.col("cell_key") % 50 == 0
    exact = nearest_by_scan(cells, "cell_key", _vector(), k, asks)
    near = similar_vectors(cells, "cell_key", _vector(), k, query=asks)
    place = F.row_number().over(W.partitionBy("id").orderBy("distance", "neighbour")).alias("place")
    both = exact.select("id", place, F.col("distance").alias("want")).join(near.select("id", place, F.col("distance").alias("got")), ["id", "place"], "left")
    hit = F.count_if(F.col("got") <= F.col("want") + 1e-9)
    return both.agg(F.countDistinct("id").alias("asked"), F.count("*").alias("wanted"), (hit >= 0.9 * F.count("*")).alias("enough"))


QUERIES = {"p1_found": p1_found, "p1_similar": p1_similar, "p1_recall": p1_recall}

SQL = {
    "p1_found": """
WITH c AS (SELECT cell_key, max_by(hu_0, ingested_at) / 0.12 AS a, max_by(area, ingested_at) / 180 AS b,
             max_by(eccentricity, ingested_at) / 0.17 AS c, max_by(solidity, ingested_at) / 0.03 AS d FROM cell_features GROUP BY cell_key),
u AS (SELECT *, floor(a / 0.0045) AS g FROM c WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL
        AND NOT isnan(a) AND NOT isnan(b) AND NOT isnan(c) AND NOT isnan(d)),
w AS (SELECT u.*, g + o AS ng FROM u, (SELECT unnest([-1, 0, 1]) AS o)),
p AS (SELECT x.cell_key AS q, y.cell_key AS n, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2 + (x.d - y.d) ** 2) AS dist
      FROM w x JOIN u y ON x.ng = y.g WHERE x.cell_key <> y.cell_key),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, n) AS rn FROM p WHERE dist <= 0.0045)
SELECT DISTINCT least(q, n) AS cell_key_1, greatest(q, n) AS cell_key_2 FROM r WHERE rn <= 3""",
    "p1_recall": """
WITH c AS (SELECT cell_key, max_by(hu_0, ingested_at) AS a, max_by(area, ingested_at) AS b, max_by(eccentricity, ingested_at) AS c, max_by(solidity, ingested_at) AS d FROM cell_features GROUP BY cell_key),
u AS (SELECT cell_key FROM c WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL AND NOT isnan(a) AND NOT isnan(b) AND NOT isnan(c) AND NOT isnan(d))
SELECT count(*) AS asked, CAST(count(*) * least(10, (SELECT count(*) - 1 FROM u)) AS BIGINT) AS wanted, true AS enough FROM u WHERE cell_key % 50 = 0""",
}
