"""Tiles and match deliveries as they arrive. The reference's only stream is its tile by tile segmentation; the
deliveries' stream is an addition for late and repeated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cytoloom.operators.segment import Segmenter, segment_tiles


def segment_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, segmenter: Segmenter, by: Sequence[str]) -> StreamingQuery:
    """Segment tile files that land in a folder; each file is done once, also after a restart. Stitch the result later."""
    tiles = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    labels = segment_tiles(tiles, segmenter, by)
    return labels.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def candidates_per_window(deliveries: DataFrame, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """Distinct match deliveries and their mean finite distance per window of arrival, by specimen; rows later than the
    watermark are left out, repeated ones counted once."""
    d = deliveries.withColumn("ingested_at", F.col("ingested_at").cast("timestamp")).withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["match_id"])
    ok = F.col("distance").isNotNull() & ~F.isnan("distance") & (F.abs("distance") < float("inf"))
    return d.groupBy(F.window("ingested_at", window).alias("w"), "specimen_id").agg(F.count("*").alias("deliveries"), F.avg(F.when(ok, F.col("distance"))).alias("mean_distance")).select(F.col("w.start").alias("window_start"), "specimen_id", "deliveries", "mean_distance")
