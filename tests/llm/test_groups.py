import random

import pytest

from cytoloom.llm.split import best_cuts, split_tiles
from cytoloom.llm.topn import hot_size, p2_found, standing_matches, top_per_group


@pytest.mark.parametrize("hot,listed", [(10_000, 100), (50, 100), (50, 1)])
def test_top_n_is_the_same_whichever_way_a_group_goes(spark, hot, listed):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 40}" if i % 5 else None, rng.randrange(30), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s int, id int").repartition(7)
    got = sorted((str(r.g), r.place, r.id) for r in top_per_group(df, ["g"], ["s", "id"], 4, hot, listed).collect())
    want = []
    for g in {r[0] for r in rows}:
        want += [(str(g), p + 1, r[2]) for p, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])[:4])]
    assert got == sorted(want)


def test_top_n_edges(spark):
    df = spark.createDataFrame([("a", 1, 9)], "g string, s int, place int")
    assert [(r.g, r.s, r.place) for r in top_per_group(df, ["g"], ["s"], 3).collect()] == [("a", 1, 1)]
    assert top_per_group(df.limit(0), ["g"], ["s"], 3).count() == 0


def test_heavy_groups_follow_the_size_of_the_table(spark):
    assert [hot_size(n, 8) for n in (0, 100, 10**6, 10**9)] == [1000, 1000, 7812, 7812500]
    df = spark.range(40_000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 400)) AS g", "hash(id) % 1000 AS s", "id")
    best = top_per_group(df, ["g"], ["s", "id"], 3)
    plan = best._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "rangepartitioning" in plan and "Union" in plan
    want = {(r.g, r.id) for r in df.selectExpr("*", "row_number() over (partition by g order by s, id) as p").where("p <= 3").collect()}
    assert {(r.g, r.id) for r in best.collect()} == want


def test_patches_and_standing_rows(spark):
    q = """SELECT * FROM VALUES (1L,'s',0L,0L,0.5D,'(0, 1)',timestamp'2025-01-01'), (2L,'s',0L,0L,0.1D,'[2 1]',timestamp'2025-01-02'), (3L,'s',0L,1L,0.2D,'1/2',timestamp'2025-01-01'),
      (4L,'s',1L,1L,0.2D,'(1,0)',timestamp'2025-01-01'), (5L,'s',2L,2L,0.2D,'none',timestamp'2025-01-01'), (6L,'s',3L,2L,0.2D,NULL,timestamp'2025-01-01') AS v(match_id,slide_id,idx1,idx2,distance,patch_id,ingested_at)"""
    m = standing_matches(spark.sql(q))
    assert {(r.idx1, r.idx2): (r.distance, r.patch_y, r.patch_x) for r in m.collect()} == {(0, 0): (0.1, 2, 1), (0, 1): (0.2, 1, 2), (1, 1): (0.2, 1, 0), (2, 2): (0.2, None, None), (3, 2): (0.2, None, None)}


def test_p2_hot_path_on_whole_tables(spark, sf):
    assert sorted(map(tuple, p2_found(spark, sf, hot=20).collect())) == sorted(map(tuple, p2_found(spark, sf).collect()))


def greedy(a, b, gaps, longest=1024, shortest=128):
    out, s = [], a
    while b - s > longest:
        fit = [g for g in gaps if s + shortest <= g <= s + longest]
        s = max(fit) if fit else s + longest
        out.append(s)
    return out


def test_leftmost_longest_cuts():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.randrange(50)
        b = a + rng.randrange(1, 6000)
        gaps = [rng.randrange(-100, 7000) for _ in range(rng.randrange(40))]
        assert best_cuts(a, b, gaps, 1024, 128) == greedy(a, b, gaps)


def test_costs_decide_the_cuts():
    """Of all ways to cut, the one whose pieces lack least, the first compared first."""
    rng = random.Random(7)
    for _ in range(60):
        b = rng.randrange(50, 330)
        gaps = [rng.randrange(330) for _ in range(rng.randrange(12))]
        ways = every_way(0, b, gaps, 100, 20)
        assert best_cuts(0, b, gaps, 100, 20) == min(ways, key=lambda w: [100 - (q - p) for p, q in zip([0, *w], [*w, b])])


def cost(a, b, cuts, gaps, longest, balance):
    at = [a, *cuts, b]
    return sum(balance * (1 - (q - p) / longest) ** 2 for p, q in zip(at[:-1], at[1:])) + sum(c not in gaps for c in cuts)


def every_way(a, b, gaps, longest, shortest):
    if b - a <= longest:
        return [[]]
    ends = [g for g in sorted(set(gaps)) if a + shortest <= g <= a + longest and a < g < b] or [a + longest]
    return [[e, *rest] for e in ends for rest in every_way(e, b, gaps, longest, shortest)]


def test_balanced_cuts_cost_least():
    rng = random.Random(3)
    for _ in range(60):
        b = rng.randrange(50, 330)
        gaps = [rng.randrange(330) for _ in range(rng.randrange(12))]
        got = best_cuts(0, b, gaps, 100, 20, balance=0.5)
        least = min(cost(0, b, w, gaps, 100, 0.5) for w in every_way(0, b, gaps, 100, 20))
        assert cost(0, b, got, gaps, 100, 0.5) == pytest.approx(least)


def test_split_tiles_edges(spark):
    cols = "tile_id long, y0 int, y1 int, x0 int, x1 int, core_y0 int, core_y1 int, core_x0 int, core_x1 int, row_gaps array<int>, col_gaps array<int>, ingested_at timestamp, rows string"
    rows = [
        (1, 0, 2100, 0, 500, 10, 2090, 0, 500, [1500, 700, 700, None, 9000, -5], None, None, "x"),
        (1, 0, 2100, 0, 500, 10, 2090, 0, 500, [1500, 700, 700, None, 9000, -5], None, None, "x"),
        (2, 0, 1024, 0, 1024, 0, 1024, 0, 1024, [], [], None, "x"), (3, 0, 9000, 0, 10, None, 9000, 0, 10, [], [], None, "x"), (4, 0, 9000, 0, 10, 9000, 0, 0, 10, [], [], None, "x"), (5, 0, 9000, 0, 10, 0, 9000, 5, 5, [], [], None, "x"), (None, 0, 9000, 0, 10, 0, 9000, 0, 5, [], [], None, "x"),
    ]
    df = spark.createDataFrame(rows, cols)
    got = sorted((r.tile_id, r.core_y0, r.core_y1, r.y0, r.y1, r.x0, r.x1) for r in split_tiles(df).collect())
    assert got == [(1, 10, 700, 0, 764, 0, 500), (1, 700, 1500, 636, 1564, 0, 500), (1, 1500, 2090, 1436, 2100, 0, 500)]
    assert split_tiles(df.limit(0)).count() == 0


def test_pieces_fit_and_cover(spark, sf):
    from pyspark.sql import functions as F

    t = split_tiles(spark.read.parquet(f"{sf}/tiles.parquet"), balance=0.25)
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # one call for both axes
    t = t.withColumn("n", (F.col("core_y1") - F.col("core_y0")) * (F.col("core_x1") - F.col("core_x0")))
    assert t.where("core_y1 - core_y0 > 1024 or core_x1 - core_x0 > 1024").count() == 0
    whole = spark.read.parquet(f"{sf}/tiles.parquet").groupBy("tile_id").agg(F.max((F.col("core_y1") - F.col("core_y0")) * (F.col("core_x1") - F.col("core_x0"))).alias("all"))
    assert t.groupBy("tile_id").agg(F.sum("n").alias("s")).join(whole, "tile_id").where("s <> all").count() == 0
