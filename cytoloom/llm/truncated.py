"""Texts that were cut off, found by a self-join on prefixes.

The values are the texts themselves and what the kept bodies say, both reduced to letters and digits, so that white
space, mark-up and punctuation don't matter. Prefixes are hashed at fixed lengths, the rungs: a value that ends between
two rungs can only be continued by values that share its prefix at the lower one. So every value tells its length
under that prefix, longer values learn by an equi-join the lengths that end within them, hash their own prefixes of
those lengths, and a value is cut off if such a hash equals its own and the longer copy goes on in the same paragraph.
Only hashes, lengths and each long value once are shuffled; nothing depends on partitions or their order.

Lengths at which a source's texts are found cut again and again are its limits, and texts of that source that stop
inside a sentence at a limit are cut too, copy or none. A body that stops before its stated length, or inside its
text, cuts the text made from it.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.runtime import cut, take_bounded, to_arrow

_BLOCK = re.compile(r"(?i)</?(?:p|div|h[1-6]|nav|footer|header|section|article|aside|main|ul|ol|li|table|tr|td|th|br|pre|blockquote|body|a)\b[^>]*>")
_TAG = re.compile(r"<[^>]*>")
_TAG_CUT = re.compile(r"<[^>]*$")
_SKIP = re.compile(r"(?is)<head\b.*?(?:</head>|$)|<(script|style)\b.*?(?:</\1>|$)|<!--.*?(?:-->|$)")
_NOT_WORD = re.compile(r"[\W_]+")
_CONTENT_ENDS = ("</p>", "</h1>", "</h2>", "</h3>", "</li>", "</td>", "</pre>", "</blockquote>")
_SENTENCE_END = re.compile(r"[.!?…。]['\"»”’)\]]*$")
_ELLIPSIS = re.compile(r"(?:…|\.\.\.)$")
_LENGTH = re.compile(r"(?im)^content-length:\s*(\d+)")
_CHARSET = re.compile(rb"(?i)charset=[\"']?([\w-]+)")


def key_of(text: str) -> str:
    """Letters and digits alone."""
    return _NOT_WORD.sub("", text)


def text_core(text: str) -> tuple[str, bool]:
    """The text without what a cut may leave behind it: white space, half a character, half an entity, an ellipsis;
    and whether there was an ellipsis."""
    t = re.sub(r"&[#\w]{0,8}$", "", text.rstrip().rstrip("�"))
    e = _ELLIPSIS.search(t)
    return (t[: e.start()] if e else t), bool(e)


def _in_prose(core: str) -> tuple[bool, bool]:
    """Whether the end of a text's last line may be running text, not a menu or a copyright line; and whether the line
    surely is: a long one without a number of four digits that ends in a word."""
    line = core[core.rfind("\n") + 1 :]
    furniture = r"©|\(c\)|[|>·»]|  "
    return not re.search(furniture, line[-60:]), not re.search(furniture, line) and len(line) >= 40 and bool(re.search(r"\w$", line)) and not re.search(r"\d{4}", line)


def _decodings(raw: bytes, headers: str | None) -> Iterator[str]:
    if raw.isascii():  # every charset here says the same
        yield raw.decode("ascii")
        return
    stated = [m.decode("ascii", "replace") for m in _CHARSET.findall((headers or "").encode("utf-8", "replace")) + _CHARSET.findall(raw[:2048])]
    for c in dict.fromkeys(["utf-8", *[s.lower() for s in stated], "cp1252", "latin-1", "iso-8859-2", "cp1251", "cp1250"]):
        try:
            yield raw.decode(c, "replace")
        except LookupError:
            continue


def _lines(text: str) -> tuple[str, list[int]]:
    """The key of a text and its lengths at the ends of lines."""
    keys = [k for k in map(key_of, text.split("\n")) if k]
    return "".join(keys), list(accumulate(map(len, keys)))


def body_value(page: str) -> tuple[str, list[int], int, bool]:
    """Of a page: its key, the lengths of the key at which paragraphs end, the length at which the last paragraph of
    content ends (menus and footers may follow), and whether the page stops inside text."""
    page = _SKIP.sub("", page)
    is_open = bool(page.strip()) and not page.rstrip().endswith(">")
    at = max(page.lower().rfind(e) for e in _CONTENT_ENDS)
    head, tail = (page, "") if is_open or at < 0 else (page[:at], page[at:])
    said = [_lines(html.unescape(html.unescape(_TAG.sub(" ", _BLOCK.sub("\n", _TAG_CUT.sub("", part)))))) for part in (head, tail)]
    content = len(said[0][0])
    return said[0][0] + said[1][0], said[0][1] + [content + n for n in said[1][1]], content, is_open


def rungs(n: int, least: int) -> list[int]:
    """The lengths up to ``n`` at which prefixes are hashed: ``least``, then each half as long again."""
    out, at = [], least
    while at <= n:
        out.append(at)
        at += max(1, at // 2)
    return out


def prefix_hashes(key: str, lengths: list[int]) -> list[bytes]:
    """A 16-byte hash of each prefix, for ascending lengths; the key is read once."""
    import hashlib

    h, done, out = hashlib.blake2b(digest_size=16), 0, []
    for n in lengths:
        h.update(key[done:n].encode("utf-8", "replace"))
        out.append(h.copy().digest())
        done = n
    return out


VALUES = (
    "doc_id long, source string, is_text boolean, h1 long, h2 long, n int, key string, breaks array<int>, content int, anchors array<long>, "
    "chars int, bytes int, ellipsis boolean, stops boolean, broken boolean, own string, own_longer boolean, body int, in_text boolean, prose boolean"
)


def _values(batches: Iterator[pa.RecordBatch], least: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in (big.slice(i, 500) for big in batches for i in range(0, big.num_rows, 500)):  # few texts at a time
        rows: list[tuple] = []

        def add(doc, source, is_text, key, breaks, content, *more):
            steps = rungs(len(key), least)
            hashes = prefix_hashes(key, [*steps, len(key)])
            h1, h2 = np.frombuffer(hashes[-1], dtype="<i8").tolist()
            anchors = [int.from_bytes(h[:8], "little", signed=True) for h in hashes[:-1]]
            rows.append((doc, source, is_text, h1, h2, len(key), key, breaks, content, anchors, *(more or [None] * 10)))

        for doc, source, text, raw, headers in zip(*(b.column(c).to_pylist() for c in ("doc_id", "source", "text", "raw_bytes", "headers"))):
            key, lines, core, ellipsis, stops = "", [], "", False, False
            if text and text.strip():
                core, ellipsis = text_core(text)
                key, lines = _lines(html.unescape(core))
                stops = not _SENTENCE_END.search(text.rstrip()) or "\ufffd" in text.rstrip()[-1:]
            broken, page = False, None
            if raw:
                for decoded in _decodings(raw, headers):
                    value = body_value(decoded)
                    if page is None or (key and value[0].startswith(key)):
                        page = value
                    if not key or value[0].startswith(key):
                        break
                stated = _LENGTH.search(headers or "")
                broken = page[3] or bool(stated and int(stated.group(1)) > len(raw))
            if key:
                own = "none" if page is None or not page[0] else "equal" if page[0] == key else "longer" if page[0].startswith(key) else "other"
                add(doc, source, True, key, lines, None, len(core), len(core.encode("utf-8", "replace")), ellipsis, stops, broken, own, own == "longer" and _goes_on(len(key), page[1], page[2]), len(raw) if raw else None, *_in_prose(core))
            if page is not None and page[0] and page[0] != key:
                add(doc, source, False, page[0], page[1], page[2])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _goes_on(n: int, breaks: list[int] | None, content: int | None) -> bool:
    """Whether a value that says more than ``n`` letters goes on within a paragraph of its content there."""
    return n not in (breaks or ()) and (content is None or n < content)


def _prefixes(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Hashes of the prefixes of each value that it goes on from, at the lengths it was told."""
    for b in (big.slice(i, 500) for big in batches for i in range(0, big.num_rows, 500)):
        out: list[bytes] = []
        for key, breaks, content, told in zip(*(b.column(c).to_pylist() for c in ("key", "breaks", "content", "told"))):
            ends = set(breaks or ())
            out += prefix_hashes(key, [n for n in sorted(set(told)) if n < len(key) and _goes_on(n, ends, content)])
        if out:
            h = np.frombuffer(b"".join(out), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1])], schema=schema)


def continued(v: DataFrame) -> DataFrame:
    """(h1, h2) of the values that a longer one goes on from. ``v`` has VALUES."""
    long_ = v.where("size(anchors) > 0")
    # what ends above a rung, told to all that share the prefix up to it and are longer
    ends = long_.groupBy(F.element_at("anchors", -1).alias("anchor")).agg(F.collect_set("n").alias("told"), F.min("n").alias("_least"))
    has = long_.select("doc_id", "is_text", "n", F.explode("anchors").alias("anchor"))
    told = has.join(ends, "anchor").where(F.col("n") > F.col("_least"))
    told = told.select("doc_id", "is_text", F.filter("told", lambda e: e < F.col("n")).alias("told")).groupBy("doc_id", "is_text").agg(F.array_distinct(F.flatten(F.collect_list("told"))).alias("told"))
    texts = v.select("doc_id", "is_text", "key", "breaks", "content").join(told, ["doc_id", "is_text"]).select("key", "breaks", "content", "told")
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64())])
    return texts.mapInArrow(lambda it: _prefixes(it, schema), "h1 long, h2 long").distinct()


def _common_sizes(at: DataFrame, keys: list[str], size: str, least: int, near: int = 256) -> DataFrame:
    """Rows of ``at`` (keys, size, cases) whose size is a limit of its keys.

    Transfers break anywhere, so with enough rows several break at one size by chance. A size is a limit if at least
    ``least`` different texts end there, eight times as many as on average at the sizes around it (its block of
    ``near`` and the two beside it), and if that many at any of the keys' sizes would come by chance once in a
    thousand times at most (Chernoff's bound for Poisson counts)."""
    at = cut(at.withColumn("_b", F.floor(F.col(size) / near)))
    blocks = at.groupBy(*keys, "_b").agg(F.sum("cases").alias("_n"), F.min(size).alias("_lo"), F.max(size).alias("_hi"))
    around = blocks.withColumn("_b", F.explode(F.array(*[F.col("_b") + i for i in (-1, 0, 1)]))).groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"), (F.max("_hi") - F.min("_lo") + 1).alias("_span"))
    sizes = blocks.groupBy(*keys).agg((F.max("_hi") - F.min("_lo") + 1).alias("_sizes"))
    some = at.where(F.col("cases") >= least).join(around, [*keys, "_b"]).join(sizes, keys)
    usual = (F.col("_n") - F.col("cases") + 1) / F.greatest("_span", F.lit(near // 4))
    rare = F.col("cases") * F.ln(F.col("cases") / usual) - F.col("cases") + usual
    return some.where((F.col("cases") >= 8 * usual) & (rare >= F.ln("_sizes") + math.log(1000))).select(*[c for c in at.columns if c != "_b"])


def _bounded(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """``df`` as a table to broadcast if it has at most ``limit`` rows."""
    rows = take_bounded(df, limit)
    return df if rows is None else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def truncated_texts(docs: DataFrame, least: int = 24, limit_cases: int = 5) -> DataFrame:
    """(doc_id, source, by) of every text that was cut: ``by`` is 'copy' (a longer copy goes on), 'transfer' (its body
    is broken) or 'limit' (it stops at a length at which its source's texts are cut, or where texts stop whose bodies that
    source cut, each far commoner than the lengths near it). A text that says all that its own kept page says is whole,
    unless that page is broken.

    ``docs`` has doc_id, source, text, raw_bytes and headers. Values under ``least`` letters and digits are no evidence
    of each other, unless one is the body of the other's own record. A length is a limit of a source if at least
    ``limit_cases`` different texts were found cut there by longer copies, and ``_common_sizes`` holds. Null and blank
    texts are never cut; a null source is a source like others; a repeated doc_id is found once; null bodies and headers
    mean nothing; an empty table gives no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", "raw_bytes", "headers").where("doc_id is not null")
    values = to_arrow(spark, VALUES)
    v = cut(d.mapInArrow(lambda it: _values(it, least, values), VALUES))
    cuts = continued(v).withColumn("longer", F.lit(True))
    src = F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")).alias("src")  # joins skip nulls
    t = v.where("is_text").select("doc_id", "source", src, "h1", "h2", "n", "chars", "bytes", "ellipsis", "stops", "broken", "own", "own_longer", "body", "in_text", "prose").join(cuts, ["h1", "h2"], "left")
    # a text that says all its own page says is whole, whatever other copies add; without a page it must stop short
    elsewhere = F.col("own").isin("none", "other") & F.col("longer") & (F.col("stops") | F.col("ellipsis"))
    copied = F.col("own_longer") | ((F.col("own") == "longer") & F.col("longer")) | elsewhere
    t = cut(t.withColumn("by", F.when(copied, "copy").when(F.col("broken") & F.col("stops"), "transfer")).withColumn("value", F.xxhash64("h1", "h2")).drop("h1", "h2", "longer", "own_longer"))
    cut_at = t.where("by = 'copy'").select("src", "ellipsis", "value", "chars", F.ceil(F.col("bytes") / 4).cast("int").alias("quads"))

    def learn(of: DataFrame, length: str) -> DataFrame:
        n = of.groupBy("src", "ellipsis", length).agg(F.countDistinct("value").alias("cases"))
        return _bounded(_common_sizes(n, ["src", "ellipsis"], length, limit_cases).select("src", "ellipsis", length))

    in_chars = learn(cut_at, "chars")
    # texts of so many characters have about as many bytes each: limits in bytes are learned from the others
    in_quads = learn(cut_at.join(in_chars, ["src", "ellipsis", "chars"], "left_anti"), "quads")
    ends = t.where("by = 'transfer' and body is not null").groupBy("src", "body").agg(F.countDistinct("value").alias("cases"), F.percentile_approx("bytes", [0.01, 0.99], 10_000).alias("ends"))
    bodies = _bounded(_common_sizes(ends, ["src"], "body", limit_cases).select("src", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high")))
    at_body = t.where("by is null and own = 'none' and prose and stops").join(bodies, "src").where("bytes between low and high").select("doc_id", "source")
    open_ = t.where("by is null and own in ('none', 'other') and in_text and (stops or ellipsis)").withColumn("quads", F.ceil(F.col("bytes") / 4).cast("int"))
    at_limit = reduce(DataFrame.unionByName, [open_.join(lim, ["src", "ellipsis", c], "left_semi").select("doc_id", "source") for lim, c in ((in_chars, "chars"), (in_quads, "quads"))])
    return t.where("by is not null").select("doc_id", "source", "by").unionByName(at_limit.unionByName(at_body).withColumn("by", F.lit("limit"))).dropDuplicates(["doc_id"])


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text", "raw_bytes", "headers")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncated_texts(_docs(spark, sf)).select("doc_id")


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source cuts, and by what it shows."""
    found = truncated_texts(_docs(spark, sf))
    all_ = spark.read.parquet(f"{sf}/documents.parquet").groupBy("source").agg(F.countDistinct("doc_id").alias("documents"))
    n = lambda by: F.count(F.when(F.col("by") == by, 1)).alias(f"by_{by}")
    cuts = found.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("cut"), n("copy"), n("transfer"), n("limit"))
    r = all_.join(cuts, all_["source"].eqNullSafe(cuts["_s"]), "left").drop("_s").na.fill(0)
    return r.withColumn("rate", F.col("cut") / F.col("documents"))


QUERIES = {"p9_found": p9_found, "p9_rates": p9_rates}
SQL: dict[str, str] = {}
