"""Filling fixed-capacity containers with items, by bounded-space online best fit.

Items arrive in hash order, bucket by bucket. Each bucket has a fixed number of open bins, kept in a bitset keyed
by free space: the lowest set bit at or above an item's size is the tightest bin that takes it. When none does and
all bins are in use, the fullest closes. Bins still open at a bucket's end travel on as items of the next level,
so that little space is lost where buckets meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.llm.tokens import token_count
from cytoloom.runtime import column, cut, map_groups


class OpenBins:
    """Best fit over at most ``limit`` open bins."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.at, self.used, self.count = 0, {}, 0, 0

    def put(self, size: int) -> int:
        """The number of the bin that takes an item of ``size`` <= capacity."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.count == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, b = self.capacity, self.used
            self.used += 1
        free -= size
        if free:  # a full bin closes at once
            self.at.setdefault(free, []).append(b)
            self.bits |= 1 << free
            self.count += 1
        return b

    def _take(self, free: int) -> int:
        held = self.at[free]
        b = held.pop()
        if not held:
            del self.at[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return b

    def open(self) -> set[int]:
        return {b for held in self.at.values() for b in held}


def _pack_level(units: DataFrame, level: int, buckets: int, capacity: int, open_bins: int) -> DataFrame:
    """(unit, size, bin, open) of units (unit, size), none larger than the capacity."""

    def pack(t: pa.Table) -> pa.Table:
        unit, size = column(t, "unit"), column(t, "size")
        bins = OpenBins(capacity, open_bins)
        got = np.fromiter((bins.put(s) for s in size.tolist()), np.int64, len(size))
        left = np.isin(got, np.fromiter(bins.open(), np.int64, -1))
        base = (level << 56) | (int(column(t, "bucket")[0]) << 24)
        return pa.table({"unit": unit, "size": size, "bin": base + got, "open": left})

    h = F.xxhash64(F.lit(level), F.col("unit"))
    u = units.withColumns({"h": h, "bucket": F.pmod(h, F.lit(buckets))})
    return cut(map_groups(u, ["bucket"], pack, "unit long, size int, bin long, open boolean", sort=["h", "unit"]))


def pack_items(items: DataFrame, id_col: str, size_col: str, capacity: int, open_bins: int = 64, per_bucket: int = 20_000) -> DataFrame:
    """(id, piece, start, size, bin): every item's place. An item above the capacity is divided into full pieces, each
    a bin of its own, and a rest; no other item is divided.

    Rows that repeat an id are one item, of the greatest size. Items of size null or 0 need no room and are left out,
    as are null ids; a negative size is an error of the caller and is left out too. An empty table gives no bins.
    Bins never hold more than ``capacity``; their numbers mean nothing. The result is the same on every run.
    """
    it = cut(items.select(F.col(id_col).cast("long").alias("id"), F.col(size_col).cast("int").alias("size")).where("id is not null and size > 0").groupBy("id").agg(F.max("size").alias("size")))
    whole = it.withColumn("full", F.floor(F.col("size") / capacity).cast("int"))
    full = whole.where("full > 0").select("id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
    full = full.select("id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).alias("size"), F.concat(F.lit("whole-"), F.col("id"), F.lit("-"), F.col("piece")).alias("bin"))
    rest = whole.select(F.col("id").alias("unit"), (F.col("size") - F.col("full") * capacity).alias("size"), "full").where("size > 0")
    n = it.count()
    level, buckets = 0, max(1, -(-n // per_bucket))
    placed = _pack_level(rest.select("unit", "size"), 0, buckets, capacity, open_bins)
    where = placed.select("unit", "bin", "open")
    while buckets > 1:
        level += 1
        units = placed.where("open").groupBy(F.col("bin").alias("unit")).agg(F.sum("size").cast("int").alias("size"))
        buckets = max(1, -(-buckets * open_bins // per_bucket))
        placed = _pack_level(units, level, buckets, capacity, open_bins)
        onward = placed.select(F.col("unit").alias("bin"), F.col("bin").alias("onto"), F.col("open").alias("still"))
        moved = where.where("open").join(onward, "bin").select("unit", F.col("onto").alias("bin"), F.col("still").alias("open"))
        where = cut(where.where("not open").unionByName(moved))
    rest = rest.join(where.select("unit", "bin"), "unit").select(F.col("unit").alias("id"), F.col("full").alias("piece"), (F.col("full") * capacity).alias("start"), "size", F.col("bin").cast("string").alias("bin"))
    return full.unionByName(rest)


SEQUENCE = 2048


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return d.select("doc_id", token_count(F.col("text")).alias("tokens"))


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in sequences of 2,048 tokens."""
    p = pack_items(_sized(spark, sf), "doc_id", "tokens", SEQUENCE)
    return p.select(F.col("id").alias("doc_id"), "piece", F.col("start").alias("first_token"), F.col("size").alias("tokens"), F.col("bin").alias("sequence_id"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How many sequences there are, by how full they are in steps of a tenth, and their tokens."""
    b = p7_packed(spark, sf).groupBy("sequence_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts"))
    return b.groupBy(F.floor(F.col("tokens") * 10 / SEQUENCE).alias("tenth")).agg(F.count("*").alias("sequences"), F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts"))


def p7_checked(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the packing of all documents: each with tokens is placed, token by token once; no sequence is
    overfull, no text divided that fits one, and at least nine tenths of all room is used but for one sequence."""
    sizes = cut(_sized(spark, sf).where("tokens > 0"))
    p = cut(pack_items(sizes, "doc_id", "tokens", SEQUENCE))
    placed = p.groupBy("id").agg(F.sum("size").alias("n"), F.count("*").alias("pieces"), F.max(F.col("start") + F.col("size")).alias("end"))
    docs = sizes.join(placed, sizes.doc_id == placed.id, "left")
    wrong = F.count_if(F.coalesce((F.col("n") != F.col("tokens")) | (F.col("end") != F.col("tokens")), F.lit(True)))
    d = docs.agg(F.count("*").alias("documents"), wrong.alias("misplaced"), F.count_if((F.col("tokens") <= SEQUENCE) & (F.col("pieces") > 1)).alias("divided"))
    b = p.groupBy("bin").agg(F.sum("size").alias("n"))
    b = b.agg(F.count_if(F.col("n") > SEQUENCE).alias("overfull"), (F.sum("n") >= 0.9 * SEQUENCE * (F.count("*") - 1)).alias("full"))
    return d.join(F.broadcast(b), F.lit(True))  # one row each


QUERIES = {"p7_packed": p7_packed, "p7_fill": p7_fill, "p7_checked": p7_checked}
SQL = {
    "p7_checked": "SELECT count(DISTINCT doc_id) AS documents, CAST(0 AS BIGINT) AS misplaced, CAST(0 AS BIGINT) AS divided, CAST(0 AS BIGINT) AS overfull, true AS \"full\" FROM documents WHERE text <> ''",
}
