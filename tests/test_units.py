import pytest

from cytoloom.operators.units import Conversion, read_metadata_quantities, shortest_conversions

SCANNERS = [("s", "um", "factor", "px"), ("q", "mm", "level", "dpx"), ("p", "dpi", "percent", "um"), ("f", "nm", "fraction", "mm")]


def test_conversions_compose_and_agree():
    c = shortest_conversions()
    assert c["mpp_x", "dpi"](50_800) == pytest.approx(0.5)
    assert c["mpp_x", "px/mm"](4000) == pytest.approx(0.25)
    assert c["mpp_x", "nm"](250) == pytest.approx(0.25)
    assert c["downsample", "percent"](12.5) == pytest.approx(8)
    assert c["downsample", "level"](3) == pytest.approx(8)
    assert c["origin_x", "mm"](1.0, 0.5) == pytest.approx(2000)
    for f in c.values():
        assert f.inverse()(f(2.5, 3.0), 3.0) == pytest.approx(2.5)


def test_a_wrong_edge_is_noticed():
    with pytest.raises(ValueError, match="disagree"):
        shortest_conversions([("q", "a", "b", Conversion(a=2.0)), ("q", "a", "c", Conversion(a=3.0)), ("q", "c", "b", Conversion(a=5.0))], {"q": "b"})


def read(spark, rows, extra=""):
    schema = "record_id long, scanner_source string, coordinate_space string, origin_x string, downsample string, mpp_x string, notes string, ingested_at timestamp"
    df = spark.createDataFrame([(*r, None) if len(r) == 7 else r for r in rows], schema)
    s = spark.createDataFrame(SCANNERS, "scanner_source string, mpp_unit string, downsample_style string, origin_unit string")
    return {(r.record_id, r.field_name): round(r.value, 6) for r in read_metadata_quantities(df, s).collect()}


def test_written_units_hold_first_then_notes_then_space_then_scanner(spark):
    got = read(spark, [
        (1, "s", "mask_pixel", "100", "4", "0.25", None),
        (2, "Q ", "LEVEL0", "100 px", "L3", "0.0005 mm/px", None),
        (3, "p", "stage_mm", "2", "25%", "50,800 dpi".replace(",", ""), None),
        (4, "s", "physical_um", "50", "1:16", "250", "filter 450 nm; Pixelgröße in Nanometern"),
        (5, "s", "level0", "7,5 mask px", "x8", "100,118.250 DPI", "label printed at 300 dpi"),
        (6, "s", "stage_um", "3", "8", "4000", "origin in level-0 pixels; resolution given as pixels per mm"),
    ])
    assert got[1, "mpp_x"] == 0.25 and got[1, "downsample"] == 4 and got[1, "origin_x"] == 100
    assert got[2, "mpp_x"] == 0.5 and got[2, "downsample"] == 8 and got[2, "origin_x"] == 100
    assert got[3, "mpp_x"] == 0.5 and got[3, "downsample"] == 4 and got[3, "origin_x"] == 4000
    assert got[4, "mpp_x"] == 0.25 and got[4, "downsample"] == 16 and got[4, "origin_x"] == 200
    assert got[5, "mpp_x"] == round(25_400 / 100_118.25, 6) and got[5, "downsample"] == 8 and got[5, "origin_x"] == 60
    assert got[6, "mpp_x"] == 0.25 and got[6, "origin_x"] == 3


def test_what_is_not_readable(spark):
    got = read(spark, [
        (1, "s", None, None, "", "n/a", None), (2, "s", None, "10 um", "-1", "-0.25", None), (3, "q", None, "5", "-2", "0", None),
        (4, "nobody", "x", "5 px", "8", "0.25", None), (5, "s", None, "3 ells", "0", "0.25 ells", None), (None, "s", None, "1", "1", "1", None), (6, None, None, "1", "2x", "1 um", None),
    ])
    assert got == {(4, "origin_x"): 5.0, (6, "mpp_x"): 1.0, (6, "downsample"): 2.0}


def test_latest_delivery_and_empty_table(spark):
    import datetime as dt

    a, b = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)
    got = read(spark, [(1, "s", None, "1", "2", "0.5", None, b), (1, "s", None, "9", "9", "9", None, a), (1, "s", None, "1", "2", "0.5", None, b)])
    assert got == {(1, "mpp_x"): 0.5, (1, "downsample"): 2.0, (1, "origin_x"): 1.0}
    assert read(spark, []) == {}


def test_callers_add_spellings_and_patterns(spark):
    from cytoloom.operators.units import NOTES, read_metadata_quantities

    cols = "record_id long, scanner_source string, coordinate_space string, origin_x string, downsample string, mpp_x string, notes string, ingested_at timestamp"
    r = spark.createDataFrame([(1, "s", None, None, None, "0.5 mikron", None, None), (2, "s", None, None, None, "500", "Aufloesung in nm", None), (3, " S", None, None, None, "2", None, None)], cols)
    s = spark.createDataFrame([("s", "um", "factor", "px"), ("S ", "mm", None, None), (None, "nm", None, None)], "scanner_source string, mpp_unit string, downsample_style string, origin_unit string")
    plain = {a.record_id: a.value for a in read_metadata_quantities(r, s).collect()}
    assert plain == {2: 500.0, 3: 2.0}
    about, units = NOTES["mpp_x"]
    more = read_metadata_quantities(r, s, {"mpp_x": {"um": ["mikron"]}}, {"mpp_x": (about + "|aufloesung", units)})
    assert {a.record_id: round(a.value, 6) for a in more.collect()} == {1: 0.5, 2: 0.5, 3: 2.0}
