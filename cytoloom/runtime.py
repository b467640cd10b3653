"""Session helpers shared by the operators: lineage cuts, grouped Arrow maps, checked broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def session(app: str = "cytoloom", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster, pass your own session to the operators."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a new one of our own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # each executor would write to its own disk
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone
            pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: later steps neither recompute it nor lose it
    with an executor. The table is removed when it is freed or the driver ends."""
    spark = df.sparkSession
    if not _written:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/cytoloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def free(*tables: DataFrame | None) -> None:
    """Remove tables that ``cut`` wrote, and that nothing still to be run reads. Others are left alone."""
    for t in tables:
        path = getattr(t, "_cut_path", None)
        if path is not None and (t.sparkSession, path) in _written:
            _written.remove((t.sparkSession, path))
            _remove(t.sparkSession, path)


def take_bounded(df: DataFrame, limit: int) -> list | None:
    """The rows of a small table, or None if it has more than ``limit`` of them."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def usable(c: Column | str) -> Column:
    """Neither null nor NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` columns (nulls last), further ties by the greatest
    ``cols``. Copies collapse map-side before the shuffle, so a key delivered many times stays cheap.
    Rows with a null key are dropped: they name no record."""
    df = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    picked = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c) for c in cols]))
    return df.groupBy(*keys).agg(picked.alias("_latest")).select(*keys, *[F.col(f"_latest.`{c}`") for c in cols])


def _changes(batch: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Positions at which a new key starts, the first row left out."""
    n = batch.num_rows
    differs = np.zeros(max(n - 1, 0), dtype=bool)
    for k in keys:
        col = batch.column(k)
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        a, b = col.slice(1), col.slice(0, n - 1)
        ne = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = pc.not_equal(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        differs |= ne | nulls
    return np.flatnonzero(differs) + 1


def group_slices(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Cut a stream sorted by ``keys`` into one table per key; holds one key's rows at a time."""
    carry: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        first = tuple(t.column(k)[0].as_py() for k in keys)
        if carry and first != last:
            yield pa.concat_tables(carry).combine_chunks()
            carry = []
        starts = [0, *_changes(t, keys).tolist(), t.num_rows]
        for s, e in zip(starts[:-1], starts[1:]):
            part = t.slice(s, e - s)
            if e < t.num_rows:
                yield pa.concat_tables([*carry, part]).combine_chunks() if carry else part
                carry = []
            else:
                carry.append(part)
        last = tuple(t.column(k)[t.num_rows - 1].as_py() for k in keys)
    if carry:
        yield pa.concat_tables(carry).combine_chunks()


def batched(parts: Iterator[pa.Table | None], schema: pa.Schema, rows: int = 65_536, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Join many small results into batches of a useful size: of about ``rows`` rows or ``size`` bytes, as rows may be images."""
    held: list[pa.Table] = []
    n = b = 0
    for t in parts:
        if t is None or not t.num_rows:
            continue
        held.append(t.cast(schema))
        n += t.num_rows
        b += held[-1].nbytes
        if n >= rows or b >= size:
            yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=rows)
            held, n, b = [], 0, 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=rows)


def map_groups(df: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table], pa.Table | None], schema: str, sort: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Call ``fn`` on the rows of each key, as one Arrow table. Far cheaper for many small groups than a
    grouped pandas function, as groups share the batches of their partition. Groups must be bounded by
    the caller. ``fn`` must return the columns of ``schema`` in its order. ``parts`` fixes the number of
    tasks, where groups cost far more than their rows' size tells."""
    out = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((fn(t) for t in group_slices(batches, keys)), out)

    return (df.repartition(parts, *keys) if parts else df.repartition(*keys)).sortWithinPartitions(*keys, *sort).mapInArrow(run, schema)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy() if isinstance(t.column(name), pa.ChunkedArray) else t.column(name).to_numpy(zero_copy_only=False)
