import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cytoloom.operators.masks import relabel_components
from cytoloom.operators.segment import segment_pixels, segment_tiles, threshold_segmenter
from cytoloom.runtime import batched
from cytoloom.sources.tiles import dense_tiles, read_region, write_tiles
from cytoloom.streaming.tiles import candidates_per_window, segment_stream

from test_masks import flood, image, pixels


def test_threshold_segmenter_equals_flood_fill():
    img = (np.random.default_rng(0).random((50, 60)) < 0.58).astype(float)
    got, want = threshold_segmenter()(img), flood(img.astype(int), 1)
    pairs = set(zip(got[got > 0].tolist(), want[want > 0].tolist()))
    assert ((got > 0) == (want > 0)).all() and len(pairs) == want.max() == len(set(got[got > 0].tolist()))


def test_components_across_tile_borders(spark):
    img = np.zeros((530, 1100), int)
    img[500:525, 505:520] = 1
    img[511, 400:1090] = 1
    img[512:520, 1024] = 1
    img[513, 1025:1030] = 1
    img[511 - 3, 511] = 0
    img[300:302, 1023] = 1
    img[302, 1024] = 1  # touches at a corner, across a border
    for c in (1, 2):
        assert (image(relabel_components(pixels(spark, img), ["g"], c), img.shape) == flood(img, c)).all()


def test_components_of_one_label_only(spark):
    img = np.array([[1, 1, 2, 2], [3, 0, 2, 0]])
    got = image(relabel_components(pixels(spark, img), ["g"], 1, same_label=True), img.shape)
    assert (got == np.array([[1, 1, 2, 2], [3, 0, 2, 0]])).all()


def test_tiles_segment_as_table_and_as_stream(spark, tmp_path):
    img = np.zeros((100, 100), int)
    img[5:20, 5:30] = 7
    img[70:90, 60:80] = 9
    t = dense_tiles(pixels(spark, img), ["g"], "label", 50).withColumns({"tile": F.xxhash64("y0", "x0"), "level": F.lit(0), "channel": F.lit(1)})
    write_tiles(t, f"{tmp_path}/t")
    r = read_region(spark, f"{tmp_path}/t", 0, 60, 100, 0, 100, [1])
    assert {(a.y0, a.x0) for a in r.collect()} == {(50, 50)}
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan
    want = sorted(map(tuple, segment_tiles(spark.read.parquet(f"{tmp_path}/t"), threshold_segmenter(), ["g"]).collect()))
    q = segment_stream(spark, f"{tmp_path}/t", f"{tmp_path}/out", f"{tmp_path}/ck", threshold_segmenter(), ["g"])
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("g", "tile", "y", "x", "label").collect())) == want and len(want) == (img > 0).sum()


def test_deliveries_as_a_stream_equal_the_batch(spark, sf):
    schema = spark.read.parquet(f"{sf}/cell_matches.parquet").schema
    import shutil
    import tempfile

    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    shutil.copy(f"{sf}/cell_matches.parquet", f"{at}/cell_matches.parquet")
    s = candidates_per_window(spark.readStream.schema(schema).parquet(at), late="3650 days")
    q = s.writeStream.format("memory").queryName("per_window").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("per_window").agg(F.sum("deliveries")).first()[0] == spark.read.parquet(f"{sf}/cell_matches.parquet").select("match_id").distinct().count()


def test_large_rows_come_in_small_batches():
    """Images are large rows; batches by rows alone held all of a task's tiles at once (F5)."""
    schema = pa.schema([("data", pa.binary())])
    got = list(batched((pa.table({"data": [bytes([i]) * (1 << 20)]}) for i in range(100)), schema))
    assert max(b.nbytes for b in got) < 20 << 20 and [b.column(0)[i].as_py()[0] for b in got for i in range(b.num_rows)] == list(range(100))


def test_pixels_are_segmented_like_their_dense_tiles(spark):
    """Without the tiles, which filled an executor (F5)."""
    img = (np.random.default_rng(2).random((70, 90)) < 0.5).astype(int)
    img[:20, :20] = 0
    p = pixels(spark, img)
    t = dense_tiles(p, ["g"], "label", 20).withColumn("tile", (F.col("y0") / 20 * 5 + F.col("x0") / 20).cast("long"))
    want = segment_tiles(t, threshold_segmenter(), ["g"], 0.45).select("g", "tile", "y", "x", "label")
    got = segment_pixels(p, threshold_segmenter(), ["g"], "label", 20, 0.45).select("g", (F.col("y0") / 20 * 5 + F.col("x0") / 20).cast("long").alias("tile"), "y", "x", "label")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
