import json

import pytest
from pyspark.sql import functions as F

from cytoloom.functions import scalar as S
from cytoloom.sources import sinks, tables


def test_names_are_told_apart():
    assert sinks.unique_stems(["a", "A", "a_2", "x/y", " . ", "a"]) == ["a", "A_2", "a_2_2", "x_y", "mask", "a_3"]


def test_metadata_aliases(spark):
    m = spark.createDataFrame([("slide.svs", "m.tif", 1, 4.0, "10", "20", 100, 50, "0.25", None)], "input string, mask_path string, level int, level_downsample double, x string, region_y string, width int, wsi_height int, mpp_x string, mpp_y string")
    r = tables.normalise_metadata(m).first()
    assert (r.source_wsi_path, r.source_mask_path, r.coordinate_space, r.origin_x, r.origin_y, r.downsample) == ("slide.svs", "m.tif", "mask_pixel", 10.0, 20.0, 4.0)
    assert (r.image_width, r.image_height, r.mpp_x, r.mpp_y, r.mpp_reliable, r.segmentation_method) == (100, 50, 0.25, None, False, "unknown")
    with pytest.raises(Exception, match="Unsupported coordinate_space"):
        tables.check_metadata(spark.createDataFrame([("stage", 1.0)], "coordinate_space string, downsample double")).collect()


def test_metadata_rules(spark):
    rows = ["{}", '{"mpp_x": 0.5, "mpp_y": "0.5"}', '{"mpp_x": 0.5, "mpp_reliable": true}', '{"mpp_x": 1, "mpp_y": 1, "mpp_reliable": "no"}', '{"cellpose": {"source_channel": "DAPI"}, "method": "m"}', '{"method": "m", "source_path": "CellViT/x"}', '{"method": "about cellpose"}', '{"channel_name": "c", "level": 0}']
    m = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k int, j string")
    schema = "mpp_x string, mpp_y string, mpp_reliable string, cellpose struct<source_channel:string>, method string, source_path string, channel_name string, level int"
    m = m.select("k", F.from_json("j", schema).alias("s")).select("k", "s.*")
    got = {r.k: r for r in tables.normalise_metadata(m).collect()}
    assert [got[i].mpp_reliable for i in range(4)] == [False, False, False, False]
    assert [got[i].segmentation_method for i in (4, 5, 6, 7)] == ["Cellpose", "CellViT", "about cellpose", "unknown"]
    assert (got[4].channel, got[7].channel, got[7].coordinate_space, got[0].coordinate_space) == ("DAPI", "c", "level0_pixel", "mask_pixel")
    known = m.where("k = 1").drop("mpp_reliable")
    assert tables.normalise_metadata(known).first().mpp_reliable
    layer = tables.layer_metadata(m.where("k = 1").drop("mpp_reliable").withColumns({"origin_x": F.lit(10.5), "downsample": F.lit(4.0)}), F.lit(7), F.lit(5), "CD3", "mine").first()
    assert (layer.image_width, layer.image_height, layer.mpp_reliable, layer.channel, layer.segmentation_method) == (31, 28, False, "CD3", "mine")
    for bad in ("level0 s, 0 d, 5 w, 5 h", "level0 s, 2 d, null w, 5 h", "level0 s, 2 d, 5 w, -1 h"):
        cols = [c.split() for c in bad.split(", ")]
        t = spark.range(1).select(*[(F.lit(v) if i == 0 else F.lit(None if v == "null" else float(v)).cast("double")).alias(n) for i, ((v, _), n) in enumerate(zip(cols, ("coordinate_space", "downsample", "image_width", "image_height")))])
        with pytest.raises(Exception, match="must be above 0"):
            tables.check_metadata(t).collect()


def test_default_ids_follow_the_source(spark):
    rows = [(float(100 - i), float(i % 7)) for i in range(100)]
    t = tables.normalise_features(spark.createDataFrame(rows, "x double, y double").repartition(1).repartitionByRange(5, F.desc("x")), 1.0, 1.0)
    assert {r.centroid_x: r.cell_id for r in t.collect()} == {x: i + 1 for i, (x, _) in enumerate(rows)}
    t = tables.normalise_features(spark.createDataFrame(rows, "x double, y double"), 1.0, 1.0, order=["x"])
    assert {r.centroid_x: r.cell_id for r in t.collect()} == {x: int(x) for x, _ in rows}


def test_features_by_other_names(spark):
    t = spark.createDataFrame([("5", "1.5", "2", "0"), ("x", "nan", "1", "1"), ("7", "", "1", "1")], "label string, x string, y string, area string")
    r = tables.normalise_features(t, 10.0, 10.0).collect()
    assert [(a.cell_id, a.centroid_x, a.area, a.roundness, a.pos_y_norm) for a in r] == [(5, 1.5, 1.0, 1.0, 0.2)]
    with pytest.raises(ValueError, match="centroid_y"):
        tables.normalise_features(t.select("x"), 1.0, 1.0)


def test_contours(spark):
    sq = [[0, 0], [4, 0], [4, 2], [0, 2]]
    doc = {"cells": [{"centroid": [2, 1], "contour": sq}, {"contour": sq}, {"centroid": [5, 5], "bbox": [[0, 0], [3, 3]]}, {"centroid": [1]}, {"centroid": [7, 7]}]}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps(doc["cells"][:1])), (3, "nonsense"), (4, None)], "k int, text string")
    got = {(r.k, r.cell_id): (r.area, r.perimeter) for r in tables.contour_features(df, "text", ["k"]).collect()}
    assert got == {(1, 1): (8.0, 12.0), (1, 3): (9.0, None), (1, 5): (1.0, None), (2, 1): (8.0, 12.0)}


def test_channels_and_levels(spark):
    c = spark.createDataFrame([(0, "CD3"), (1, "DAPI 2"), (2, "dapi")], "index int, name string")
    assert [tables.match_channel(c, q).first()[0] for q in ("auto", "1: x", "API 2", "0", "q: cd3")] == [2, 1, 1, 0, 0]
    assert tables.match_channel(c, "none").count() == 0
    p = tables.parse_channels(spark.createDataFrame([(0, "<I><Name>A</Name><Color>1, 300,x</Color></I>"), (1, None), (2, "<I><Color>1,300,-2</Color></I>")], "index int, description string")).orderBy("index").collect()
    assert [(r.name, r.color) for r in p] == [("A", None), ("Channel 1", None), ("Channel 2", [1, 255, 0])]
    lv = spark.createDataFrame([("s", 0, 8, 8), ("s", 1, 8, 8), ("s", 2, 4, 4)], "g string, level int, width int, height int")
    assert [r.level_group for r in tables.level_groups(lv, ["g"]).orderBy("level").collect()] == [0, 0, 1]


def test_csv_and_tile_round_trips(spark, tmp_path):
    px = spark.createDataFrame([("i", y, x, 70_000 if y == 3 else 2) for y in range(9) for x in range(300)], "g string, y int, x int, label int")
    sinks.write_mask(px, ["g"], f"{tmp_path}/px", 64)
    assert sorted(map(tuple, sinks.read_mask(spark, f"{tmp_path}/px", ["g"]).collect())) == sorted(map(tuple, px.collect()))
    assert {r.dtype for r in spark.read.parquet(f"{tmp_path}/px").collect()} == {"uint32"}
    a = spark.createDataFrame([(1, 0.0, 0.0), (1, 5.0, 5.0), (2, 1.0, 1.0)], "cell_id int, x double, y double")
    m = spark.createDataFrame([(1, 2, 0.5), (1, 9, 0.1)], "cell_id_1 int, cell_id_2 int, distance double")
    for n, t in (("a", a), ("b", a), ("m", m)):
        sinks.write_table(t, f"{tmp_path}/{n}", "csv")
    f, g, k = tables.read_match_tables(spark, *[f"{tmp_path}/{n}" for n in "abm"])
    assert [(r.id1, r.id2, r.x1, r.x2) for r in tables.landmarks_of(k, f, g).collect()] == [(1, 2, 0.0, 1.0)]
    (tmp_path / "c.csv").write_text("cell_id,x,y\n1,2,3\n")
    (tmp_path / "c.json").write_text(json.dumps({"downsample": 2, "x": 1, "y": 1}))
    pts, meta = tables.read_centroids(spark, f"{tmp_path}/c.csv")
    pts = tables.normalise_features(pts, 10.0, 10.0)
    assert [(r.level0_x, r.level0_y) for r in tables.centroids_to_level0(pts, meta, []).collect()] == [(5.0, 7.0)]


def test_image_listing_and_modes(spark, tmp_path):
    for n in ("a.TIF", "b.txt", "sub/c.jpeg"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    assert tables.list_images(spark, str(tmp_path)).count() == 2
    s = spark.createDataFrame([([5, 5],), ([3, 9, 9],), ([20, 9, 9],), ([20, 9, 9, 3],)], "shape array<int>")
    assert [r[0] for r in s.select(tables.image_mode("shape")).collect()] == ["2d", "2d", "3d_zstack", "3d_zstack"]


def test_scalars(spark):
    r = spark.range(1).select(
        S.safe_ratio(F.lit(1.0), F.lit(0.0)).alias("a"), S.patch_of(F.lit(1.0)).alias("b"), S.patch_of(F.lit(-3.0)).alias("c"), S.axis_difference_deg(F.lit(0.1), F.lit(3.1)).alias("d"),
        S.truthy(F.lit(" YES ")).alias("e"), S.truthy(F.lit(None).cast("string")).alias("f"), S.median_of(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0), F.lit(9.0))).alias("g"), S.hu_log(F.lit(0.0)).alias("h"), S.clean(F.lit(float("nan"))).alias("i"), S.to_integer_range(F.lit(2.5), 0, 9).alias("j"),
    ).first()
    assert (r.a, r.b, r.c, r.e, r.f, r.g, r.h, r.i, r.j) == (1.0, 2, 0, True, False, 2.5, 0.0, None, 2)
    assert r.d == pytest.approx(8.11268, abs=1e-4)
