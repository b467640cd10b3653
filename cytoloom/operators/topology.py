"""How alike two cells' surroundings are, within a patch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoloom.functions.scalar import patch_centre
from cytoloom.operators.neighbors import displaced_neighbours, knn
from cytoloom.runtime import cut


def position_loss(x1: Column, y1: Column, x2: Column, y2: Column, py: Column, px: Column, width: Column, height: Column, patches: int = 3) -> Column:
    """Distance between two cells' offsets from their patch's centre, in half patches, over sqrt 2."""
    cx, cy = patch_centre(px, width, patches), patch_centre(py, height, patches)
    hx, hy = width / patches / 2, height / patches / 2
    return F.sqrt((F.pow((x1 - cx) / hx - (x2 - cx) / hx, 2) + F.pow((y1 - cy) / hy - (y2 - cy) / hy, 2)) / 2)


def neighbour_loss(pairs: DataFrame, near1: DataFrame, near2: DataFrame, diagonal: Column, counts: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """``pairs`` with ``l_nei``: the root mean square difference of both cells' k nearest distances, over the patch diagonal;
    infinity where a side has no other cell. k is at most the others on either side. ``counts``: by, n1, n2."""
    j = pairs.join(counts, list(by)).withColumn("_k", F.least(F.lit(k), F.col("n1") - 1, F.col("n2") - 1))
    a = near1.select(F.col("id").alias("id1"), "ordinal", F.col("distance").alias("_d1"))
    b = near2.select(F.col("id").alias("id2"), "ordinal", F.col("distance").alias("_d2"))
    d = j.where("_k > 0").select("id1", "id2", "_k").join(a, "id1").join(b, ["id2", "ordinal"]).where("ordinal <= _k")
    rms = d.groupBy("id1", "id2").agg(F.sqrt(F.avg(F.pow(F.col("_d1") - F.col("_d2"), 2))).alias("_rms"))
    return j.join(rms, ["id1", "id2"], "left").withColumn("l_nei", F.coalesce(F.col("_rms") / diagonal, F.lit(float("inf")))).drop("_rms", "_k", "n1", "n2")


def topology_pairs(pairs: DataFrame, fixed: DataFrame, moving: DataFrame, by: Sequence[str], id_col: str, k: int = 5, tau_pos: float = 0.5, tau_nei: float = 0.3, patches: int = 3) -> tuple[DataFrame, DataFrame]:
    """(pairs in one patch whose position and neighbour losses are small, the fixed cells' knn within the patch).

    ``fixed`` and ``moving`` have by, id, centroid_x/y, patch_y, patch_x, width, height; pairs has by, id1, id2. Pairs of
    cells of different patches are dropped, as are ids that a side doesn't have."""
    patch = [*by, "patch_y", "patch_x"]
    a = fixed.dropDuplicates([id_col]).select(*by, F.col(id_col).alias("id1"), F.col("centroid_x").alias("x1"), F.col("centroid_y").alias("y1"), "patch_y", "patch_x", "width", "height")
    b = moving.dropDuplicates([id_col]).select(F.col(id_col).alias("id2"), F.col("centroid_x").alias("x2"), F.col("centroid_y").alias("y2"), F.col("patch_y").alias("_py"), F.col("patch_x").alias("_px"))
    j = pairs.select("id1", "id2").join(a, "id1").join(b, "id2").where("patch_y = _py and patch_x = _px").drop("_py", "_px")
    j = j.withColumn("l_pos", position_loss(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("patch_y"), F.col("patch_x"), F.col("width"), F.col("height"), patches))
    near1 = cut(knn(fixed, None, patch, ["centroid_x", "centroid_y"], id_col, k))
    near2 = knn(moving, None, patch, ["centroid_x", "centroid_y"], id_col, k)
    n = fixed.groupBy(*patch).agg(F.count("*").alias("n1")).join(moving.groupBy(*patch).agg(F.count("*").alias("n2")), patch)
    diagonal = F.sqrt(F.pow(F.col("width") / patches, 2) + F.pow(F.col("height") / patches, 2))
    j = neighbour_loss(j, near1, near2, diagonal, n, patch, k)
    return j.where((F.col("l_pos") <= tau_pos) & (F.col("l_nei") <= tau_nei)), near1


def topology_matching(pairs: DataFrame, fixed: DataFrame, moving: DataFrame, by: Sequence[str], id_col: str, k: int = 5, tau_pos: float = 0.5, tau_nei: float = 0.3, tau_map: float = 0.3, patches: int = 3) -> DataFrame:
    """Trusted pairs, each with its neighbours mapped to the moving side."""
    top, near1 = topology_pairs(pairs, fixed, moving, by, id_col, k, tau_pos, tau_nei, patches)
    patch = [*by, "patch_y", "patch_x"]
    size = fixed.groupBy(*patch).agg(F.first("width").alias("width"), F.first("height").alias("height"))
    d = displaced_neighbours(top, near1, fixed, moving, patch, id_col, F.lit(1.0), float("inf"))
    d = d.join(size, patch).withColumn("dist_norm", F.col("distance") / F.sqrt(F.pow(F.col("width") / patches, 2) + F.pow(F.col("height") / patches, 2)))
    return d.withColumn("mapped", F.coalesce(F.col("dist_norm") <= tau_map, F.lit(False))).drop("width", "height")
