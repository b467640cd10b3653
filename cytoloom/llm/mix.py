"""Mixing sources to target weights, by the cube method of balanced sampling.

Every record of a source is used base times for sure and once more with a probability. The cube method moves
these probabilities through the null-space of the constraints (tokens, records) until all but two are 0 or 1, so
both totals stay as expected; what remains of many blocks is flown again together, and only the last two records of
a source are rounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.llm.tokens import token_count
from cytoloom.runtime import column, cut, map_groups, take_bounded


def flight(prob: np.ndarray, size: np.ndarray, seed: int, land: bool = False) -> np.ndarray:
    """Probabilities moved until at most two lie inside (0, 1), the sums of prob and prob x size unchanged. With
    ``land`` the last ones are rounded to the corner that keeps the sum of sizes best, and of those the count."""
    rng = np.random.default_rng(seed)
    p, x = prob.astype(float).tolist(), size.astype(float).tolist()
    draws = rng.random(len(p) + 3).tolist()
    eps = 1e-9
    inside: list[int] = []
    drawn = 0
    for k in range(len(p)):
        if not eps < p[k] < 1 - eps:
            p[k] = float(round(p[k]))
            continue
        inside.append(k)
        while len(inside) == 3:
            i, j, m = inside
            u = (x[j] - x[m], x[m] - x[i], x[i] - x[j])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for a, v in zip(inside, u):
                if v > 0:
                    up, down = min(up, (1 - p[a]) / v), min(down, p[a] / v)
                elif v < 0:
                    up, down = min(up, -p[a] / v), min(down, (p[a] - 1) / v)
            go = up if draws[drawn % len(draws)] < down / (up + down) else -down
            drawn += 1
            for a, v in zip(inside, u):
                p[a] += go * v
            for a in inside:
                if p[a] < eps:
                    p[a] = 0.0
                elif p[a] > 1 - eps:
                    p[a] = 1.0
            inside = [a for a in inside if 0 < p[a] < 1]
    if land and inside:
        want_x, want_n = sum(p[a] * x[a] for a in inside), sum(p[a] for a in inside)
        corners = [[(c >> b) & 1 for b in range(len(inside))] for c in range(1 << len(inside))]
        best = min(corners, key=lambda c: (abs(sum(s * x[a] for s, a in zip(c, inside)) - want_x), abs(sum(c) - want_n)))
        for a, s in zip(inside, best):
            p[a] = float(s)
    out = np.array(p)
    return _swap(out, prob, size.astype(float)) if land else out


def _swap(p: np.ndarray, prob: np.ndarray, x: np.ndarray, rounds: int = 10) -> np.ndarray:
    """What rounding the last records cost in tokens, mended step by step: by swapping a chosen record for one that
    wasn't, or where that serves less, by adding or leaving out one."""
    free = (prob > 0) & (prob < 1)
    for _ in range(rounds):
        off = float((p * x).sum() - (prob * x).sum())
        chosen, others = np.flatnonzero(free & (p == 1)), np.flatnonzero(free & (p == 0))
        steps = [(abs(off - x[c]), 1, [c]) for c in chosen] + [(abs(off + x[o]), 1, [o]) for o in others]
        if len(chosen) and len(others):
            others = others[np.argsort(x[others], kind="stable")]
            at = np.searchsorted(x[others], x[chosen] - off)
            steps += [(abs(off - (x[c] - x[o])), 0, [c, o]) for c, k in zip(chosen, at) for o in others[max(0, k - 1) : k + 1]]
        if not steps:
            break
        rest, _, turn = min(steps, key=lambda s: s[:2])
        if rest >= abs(off):
            break
        p[turn] = 1 - p[turn]
    return p


@dataclass(frozen=True)
class Share:
    source: str
    target: float
    cap: int
    tokens: int
    records: int
    take: float  # tokens this source gives
    short: bool = False  # whether it is used up to its cap, and others make up for it


def plan_shares(have: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], total: float | None = None, least_part: float = 0.5) -> list[Share]:
    """What each source gives. ``have``: tokens and records by source.

    ``total`` is by default the tokens of the listed sources, or less: the greatest at which every source that could
    give ``least_part`` of its part is in full share. Sources that can't are short: they are used up to their cap, and the
    others make up for them in proportion, as they do for absent ones.
    """
    rows = [(s, max(0.0, w or 0.0), max(0, c or 0), *have.get(s, (0, 0))) for s, w, c in targets]
    room = {s: float(t * c) for s, w, c, t, _ in rows if w > 0}
    live = {s: w for s, w, c, t, _ in rows if w > 0 and room[s] > 0}
    take, used_up = dict.fromkeys(have, 0.0), set()
    if live:
        if total is None:
            total = float(sum(t for _, _, _, t, _ in rows))
            reach = {s: room[s] * sum(live.values()) / w for s, w in live.items()}
            total = min([total, *[r for r in reach.values() if r >= total * least_part]])
        left, open_ = total, dict(live)
        while open_:
            unit = left / sum(open_.values())
            short = [s for s, w in open_.items() if w * unit >= room[s]]
            if not short:
                take |= {s: w * unit for s, w in open_.items()}
                break
            for s in short:
                take[s] = room[s]
                used_up.add(s)
                left -= room[s]
                del open_[s]
    return [Share(s, w, c, t, n, take.get(s, 0.0), w > 0 and (s in used_up or not room[s])) for s, w, c, t, n in rows]


def mixture(items: DataFrame, targets: DataFrame, total: float | None = None, block: int = 5_000, seed: int = 7, least_part: float = 0.5) -> tuple[DataFrame, list[Share]]:
    """(id, source, tokens, copies) of the records used, and what each source was to give.

    ``items``: id (unique), source, tokens; ``targets``: source, target_share, max_repeats. A record is used at most
    max_repeats times. Records without tokens, with a null id or of a source that isn't listed are not used; a source
    listed twice counts by its greatest share. An empty table gives an empty mixture. The same seed gives the same
    mixture on every run.
    """
    items = items.where("id is not null and tokens > 0")
    goals = targets.where("source is not null").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("g")).select("source", "g.*")
    listed = take_bounded(goals, 10_000)
    if listed is None:
        raise ValueError("more than 10,000 sources are listed")
    items = cut(items.join(F.broadcast(goals.select("source")), "source"))  # at most 10,000 sources
    have = {r.source: (int(r.t), int(r.n)) for r in items.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    shares = plan_shares(have, [(g.source, g.target_share, g.max_repeats) for g in listed], total, least_part)
    spark = items.sparkSession
    plan = [(s.source, int(r), float(r - int(r)), max(1, -(-s.records // block))) for s in shares if s.records and (r := min(float(s.cap), s.take / s.tokens)) > 0]
    plan = spark.createDataFrame(plan, "source string, base int, prob double, blocks int")
    todo = items.join(F.broadcast(plan), "source")
    done = []
    while True:
        blocks = todo.withColumn("block", F.pmod(F.xxhash64(F.lit(len(done)), "id"), F.col("blocks")))

        def fly(t: pa.Table) -> pa.Table:
            last = int(column(t, "blocks")[0]) == 1
            t = t.take(np.argsort(-column(t, "tokens"), kind="stable"))  # so that small records are left at the end
            p = flight(column(t, "prob"), column(t, "tokens"), hash((seed, int(column(t, "block")[0]), len(t))) & 0x7FFFFFFF, land=last)
            return t.select(["id", "source", "tokens", "base"]).append_column("prob", pa.array(p)).append_column("blocks", t.column("blocks"))

        flown = cut(map_groups(blocks, ["source", "block"], fly, "id long, source string, tokens int, base int, prob double, blocks int", sort=["id"]))
        done.append(flown.where("prob = 0 or prob = 1"))
        todo = flown.where("prob > 0 and prob < 1").withColumn("blocks", F.greatest(F.lit(1), F.ceil(2 * F.col("blocks") / block)).cast("int"))
        if not todo.limit(1).count():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("id", "source", "tokens", (F.col("base") + F.col("prob").cast("int")).alias("copies")).where("copies > 0"), shares


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, list[Share]]:
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "source", token_count(F.col("text")).alias("tokens"))
    return mixture(d, spark.read.parquet(f"{sf}/mix_targets.parquet"))


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Which documents the mixture holds, and how often."""
    return _mix(spark, sf)[0].select(F.col("id").alias("doc_id"), "source", "tokens", "copies")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share of tokens each source was to have and has."""
    mix, shares = _mix(spark, sf)
    got = mix.groupBy("source").agg(F.sum(F.col("tokens").cast("long") * F.col("copies")).alias("mixed_tokens"), F.count("*").alias("used_documents"), F.max("copies").alias("most_copies"))
    want = spark.createDataFrame([(s.source, s.target, s.cap, s.tokens, s.records, s.take, s.short) for s in shares], "source string, target_share double, max_repeats int, own_tokens long, documents long, planned_tokens double, short boolean")
    all_ = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    r = want.join(got, "source", "left").join(F.broadcast(all_), F.lit(True), "left")  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return r.select("source", "target_share", "max_repeats", "own_tokens", "documents", "planned_tokens", "short", zero("mixed_tokens").alias("mixed_tokens"), zero("used_documents").alias("used_documents"), zero("most_copies").alias("most_copies"), F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))


def p8_checked(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the mixture: only listed sources, no document beyond its cap, and every source within a
    thousandth of all tokens of what it was to give."""
    s = cut(p8_shares(spark, sf))
    planned = s.agg(F.sum("planned_tokens").alias("_all"))
    far = F.abs(F.col("mixed_tokens") - F.col("planned_tokens")) > 0.001 * F.col("_all")
    return s.join(F.broadcast(planned), F.lit(True)).agg(F.count("*").alias("sources"), F.count_if(F.col("most_copies") > F.col("max_repeats")).alias("over_cap"), F.count_if(far).alias("off_plan"), (F.abs(F.sum("actual_share") - 1) < 1e-9).alias("whole"))


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_checked": p8_checked}
SQL = {
    "p8_checked": "SELECT count(DISTINCT source) AS sources, CAST(0 AS BIGINT) AS over_cap, CAST(0 AS BIGINT) AS off_plan, true AS whole FROM mix_targets",
}
