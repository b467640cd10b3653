import random

import pytest
from pyspark.sql import functions as F

from cytoloom.llm.truncated import body_value, key_of, text_core, truncated_texts

SCHEMA = "doc_id long, source string, text string, raw_bytes binary, headers string"
WORDS = "the harbour keeps every stone that winter carries under quiet common valley and bright village orchard lantern cellar notice".split()


def prose(n, seed=0):
    return " ".join(WORDS[(i * 7 + seed * i * i + seed) % len(WORDS)] + ("." if i % 9 == 8 else "") for i in range(n)).capitalize()


def random_prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


def page(*paragraphs, end="</body></html>"):
    return ("<html><head><title>t</title></head><body>" + "".join(f"<p>{p}</p>\n" for p in paragraphs) + "<footer>(c) 2020 A &amp; B</footer>" + end).encode()


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.doc_id: r.by for r in truncated_texts(df, **kw).collect()}


def test_a_text_that_its_own_page_continues(spark):
    p, q = prose(60) + ".", prose(50, 3) + "."
    rows = [
        (1, "s", (p + "\n" + q)[:300], page(p, q), None),
        (2, "s", p + "\n" + q + "\n(c) 2020 A & B", page(p, q), None),  # all of it
        (3, "s", p + "\n" + q, page(p, q), None),  # only the footer is missing
        (4, "s", (p + "\n" + q)[:301].rstrip() + "...", page(p, q), None),
        (5, "s", None, page(p, q), None), (6, "s", "  ", page(p, q), None),
    ]
    assert found(spark, rows) == {1: "copy", 4: "copy"}


def test_a_copy_elsewhere_is_enough(spark):
    p = prose(80) + "."
    rows = [(1, "s", p[:200], None, None), (2, "t", p, None, None), (3, "t", prose(80, 5) + ".", None, None), (4, "s", p[:12], None, None)]
    assert found(spark, rows) == {1: "copy"}


def test_broken_transfers(spark):
    p = prose(70)
    cut = page(p)[:260]
    said = body_value(cut.decode())[0]
    text = p[: len(p)]
    shown = cut.decode().split("<p>")[1]
    assert key_of(shown) == said and text.startswith(shown)
    rows = [(1, "s", shown, cut, "HTTP/1.1 200 OK\r\nContent-Length: 900"), (2, "s", shown, cut, None), (3, "s", prose(20, 4) + ".", page(prose(20, 4) + "."), "Content-Encoding: gzip\r\nContent-Length: 30")]
    assert found(spark, rows) == {1: "transfer", 2: "transfer"}


def test_limits_are_learned_from_copies(spark):
    rows = [(i, "s", prose(90, i)[:250], page(prose(90, i) + "."), None) for i in range(8)]
    rows += [(100, "s", prose(90, 31)[:250], None, None), (101, "t", prose(90, 32)[:250], None, None), (102, "s", prose(90, 33)[:240], None, None)]
    got = found(spark, rows)
    assert got == {**{i: "copy" for i in range(8)}, 100: "limit"}


@pytest.mark.parametrize("n", [150, 900])
def test_random_breaks_are_no_limit(spark, n):
    rng = random.Random(n)
    rows = []
    for i in range(n):  # the sizes of 150 within 40, of 900 within 240: chance repeats of five and more at both
        body = page(random_prose(rng, 200))[: 400 + rng.randrange(n * 4 // 15)]
        rows.append((i, "s", body.decode().split("<p>")[1], body, "Content-Length: 9000"))
    rows += [(10_000 + i, "s", random_prose(rng, 200)[: 340 + 5 * i].strip(), None, None) for i in range(20)]
    got = found(spark, rows)
    assert {i for i in got if i >= 10_000} == set() and "limit" not in got.values()


def test_each_body_limit_has_its_own_range(spark):
    rng = random.Random(1)
    bodies = [page(random_prose(rng, 400))[: (500, 1500)[i % 2]] for i in range(40)]
    rows = [(i, "s", b.decode().split("<p>")[1], b, "Content-Length: 9000") for i, b in enumerate(bodies)]
    whole = lambda n: random_prose(rng, 400)[: n - 1].rstrip().ljust(n, "z")
    short, long = len(rows[0][2]), len(rows[1][2])
    rows += [(100, "s", whole(short), None, None), (101, "s", whole(long), None, None), (102, "s", whole(1000), None, None), (103, "t", whole(short), None, None)]
    got = found(spark, rows)
    assert {i: by for i, by in got.items() if i >= 100} == {100: "limit", 101: "limit"}


def test_crowds_of_copies_and_partition_borders(spark):
    rows = [(i, "s", prose(100, i % 40)[: 150 + i % 7], None, None) for i in range(400)] + [(1000 + i, "s", prose(100, i) + ".", None, None) for i in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = found(spark, rows, limit_cases=10**6)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {i for i in got if i < 1000} == {r[0] for r in rows[:400] if not r[2].rstrip().endswith(".")}
    assert all(i < 1000 for i in got)


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_the_result_does_not_depend_on_partitions(spark, parts):
    p = prose(120) + "."
    ends = [p[:150], p[:150] + "\n" + "Other words stand here, then more of them.", p]  # the next longer value only ends a line there
    rows = [(i, "s", t, None, None) for i, t in enumerate(ends)] + [(10 + i, "s", prose(90, i) + ".", None, None) for i in range(60)] + [(100 + i, "s", prose(90, i)[: 100 + 3 * i], None, None) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.doc_id: r.by for r in truncated_texts(df, limit_cases=10**6).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    whole = {t[2] for t in rows}
    assert got == {i: "copy" for i, _, t, _, _ in rows if i in (0,) or (i >= 100 and t.rstrip()[-1] != "." and t in {w[: len(t)] for w in whole if len(w) > len(t)})}


def test_prefixes_of_every_length_meet(spark):
    rng = random.Random(5)
    letters = "".join(rng.choice("abcdefghij") for _ in range(700))
    rows = [(n, "s", letters[:n] + " ", None, None) for n in range(20, 700, 7)] + [(1000, "s", letters + ".", None, None)]
    assert set(found(spark, rows, limit_cases=10**6)) == {n for n in range(20, 700, 7) if n >= 24}


def test_edges(spark):
    df = spark.createDataFrame([(1, "s", "x" * 300_000, None, None), (None, "s", "abc", None, None), (2, None, "", b"", ""), (3, "s", "a � b", b"\xff\xfe<p>\xe9", "charset=nonsense")], SCHEMA).withColumn("key", F.lit(1))
    assert truncated_texts(df).where("doc_id = 1").count() == 0
    assert truncated_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,core", [("abc…", ("abc", True)), ("abc... \n", ("abc", True)), ("abc�", ("abc", False)), ("a &am", ("a ", False)), ("a. ", ("a.", False))])
def test_what_a_cut_leaves(text, core):
    assert text_core(text) == core
