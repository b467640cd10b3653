"""Segmentation of tiles by a user's own function. The model is not part of this library: any callable from an image to
labels serves, and is shipped to the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.runtime import column, map_groups, to_arrow

Segmenter = Callable[[np.ndarray], np.ndarray]


def threshold_segmenter(level: float = 0.0) -> Segmenter:
    """Labels of pixels above a level that touch at a side."""

    def segment(img: np.ndarray) -> np.ndarray:
        on = img > level
        label = np.where(on, np.arange(1, img.size + 1).reshape(img.shape), 0)
        while True:
            low = np.where(on, label, img.size + 1)
            for a, b in (((slice(1, None), slice(None)), (slice(None, -1), slice(None))), ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))):
                both = on[a] & on[b]
                m = np.minimum(low[a], low[b])
                low[a] = np.where(both, np.minimum(low[a], m), low[a])
                low[b] = np.where(both, np.minimum(low[b], m), low[b])
            low = np.where(on, low, 0)
            low[on] = low.ravel()[low[on] - 1]  # a label's own label
            if (low == label).all():
                return label
            label = low

    return segment


def segment_tiles(tiles: DataFrame, segmenter: Segmenter, by: Sequence[str], min_share: float = 0.001, dtype: str = "float32") -> DataFrame:
    """(by, tile, y, x, label) of dense tiles (by, tile, y0, x0, h, w, data), in the image's pixels; labels start anew in
    every tile. Tiles with hardly anything in them are skipped. Works on a stream of tiles as on a table: each tile is a
    piece of work by itself."""
    types = dict(tiles.dtypes)
    schema = "".join(f"`{g}` {types[g]}, " for g in by) + "tile long, y int, x int, label int"
    out = to_arrow(tiles.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in (*by, "tile", "y0", "x0", "h", "w", "data")}
                img = np.frombuffer(row["data"], dtype).reshape(row["h"], row["w"])
                if np.count_nonzero(img) < min_share * img.size:
                    continue
                label = segmenter(img)
                y, x = np.nonzero(label)
                n = len(y)
                cols = {g: pa.array([row[g]] * n, out.field(g).type) for g in by}
                cols |= {"tile": pa.array(np.full(n, row["tile"], np.int64)), "y": pa.array((y + row["y0"]).astype(np.int32)), "x": pa.array((x + row["x0"]).astype(np.int32)), "label": pa.array(label[y, x].astype(np.int32))}
                yield pa.RecordBatch.from_arrays([cols[f.name] for f in out], schema=out)

    return tiles.mapInArrow(run, schema)


def segment_pixels(pixels: DataFrame, segmenter: Segmenter, by: Sequence[str], value: str, tile: int = 256, min_share: float = 0.001, dtype: str = "float32") -> DataFrame:
    """(by, y0, x0, y, x, label): what ``segment_tiles`` gives for the dense tiles of a pixel table (by, y, x, value). An image
    lives only while it is segmented, so that a task holds one, not the tiles of a batch on both sides of Python."""
    p = pixels.select(*by, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(value).cast("float" if dtype == "float32" else "double").alias("v"))
    p = p.withColumns({"y0": F.floor(F.col("y") / tile).cast("int") * tile, "x0": F.floor(F.col("x") / tile).cast("int") * tile})
    types = dict(p.dtypes)

    def run(t: pa.Table) -> pa.Table | None:
        y0, x0 = t.column("y0")[0].as_py(), t.column("x0")[0].as_py()
        img = np.zeros((tile, tile), dtype)
        img[column(t, "y") - y0, column(t, "x") - x0] = column(t, "v")
        if np.count_nonzero(img) < min_share * img.size:
            return None
        label = segmenter(img)
        y, x = np.nonzero(label)
        if not len(y):
            return None
        same = t.slice(0, 1).take(pa.array(np.zeros(len(y), np.int64)))
        return pa.table({**{g: same.column(g) for g in (*by, "y0", "x0")}, "y": (y + y0).astype(np.int32), "x": (x + x0).astype(np.int32), "label": label[y, x].astype(np.int32)})

    return map_groups(p, [*by, "y0", "x0"], run, "".join(f"`{g}` {types[g]}, " for g in by) + "y0 int, x0 int, y int, x int, label int")
