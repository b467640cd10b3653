"""Quantities in common units.

Units are nodes of a graph, conversions its edges. An edge is an affine or reciprocal function, kept as the
matrix of (a v + b) / (c v + d), so that a path of edges is one product of matrices; a step that scales by
another field of the record, or that takes 2**v, is carried beside it. The shortest path from each unit to its
target is found once, on this fixed table of units; records meet it by an equi-join on (quantity, unit).
"""

from __future__ import annotations


from collections import deque
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.runtime import latest, take_bounded


@dataclass(frozen=True)
class Conversion:
    """v -> (a v' + b) / (c v' + d), v' being v, 2**v or log2(v); ``times`` and ``over`` name a field of the
    record whose converted value multiplies or divides the result."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 1.0
    pre: str = "id"
    post: str = "id"
    times: str = ""
    over: str = ""

    def then(self, o: "Conversion") -> "Conversion":
        if self.post != "id" and o.pre != "id":
            if {self.post, o.pre} != {"log2", "exp2"}:
                raise ValueError("such a path has no closed form")
        elif self.post != "id" or (o.pre != "id" and (self.a, self.b, self.c, self.d, self.pre) != (1, 0, 0, 1, "id")):
            raise ValueError("such a path has no closed form")
        m = np.array([[o.a, o.b], [o.c, o.d]]) @ np.array([[self.a, self.b], [self.c, self.d]])
        pre = o.pre if self.pre == "id" and self.post == "id" else self.pre
        times, over = {self.times, o.times} - {""}, {self.over, o.over} - {""}
        times, over = times - over, over - times
        return Conversion(*map(float, m.ravel()), pre, o.post, *["".join(x) for x in (times, over)])

    def inverse(self) -> "Conversion":
        turn = {"id": "id", "exp2": "log2", "log2": "exp2"}
        return Conversion(self.d, -self.b, -self.c, self.a, turn[self.post], turn[self.pre], self.over, self.times)

    def __call__(self, v: float, field: float = 1.0) -> float:
        v = 2.0**v if self.pre == "exp2" else v
        v = (self.a * v + self.b) / (self.c * v + self.d)
        v = v * field if self.times else v / field if self.over else v
        return float(np.log2(v)) if self.post == "log2" else v


#: Known conversions, (quantity, from, to, function).
EDGES: list[tuple[str, str, str, Conversion]] = [
    ("mpp_x", "nm", "um", Conversion(a=0.001)),
    ("mpp_x", "mm", "um", Conversion(a=1000.0)),
    ("mpp_x", "nm", "mm", Conversion(a=0.000001)),
    ("mpp_x", "px/mm", "mm", Conversion(0.0, 1.0, 1.0, 0.0)),
    ("mpp_x", "dpi", "um", Conversion(0.0, 25_400.0, 1.0, 0.0)),
    ("mpp_x", "dpi", "px/mm", Conversion(a=1 / 25.4)),
    ("downsample", "fraction", "factor", Conversion(0.0, 1.0, 1.0, 0.0)),
    ("downsample", "percent", "fraction", Conversion(a=0.01)),
    ("downsample", "percent", "factor", Conversion(0.0, 100.0, 1.0, 0.0)),
    ("downsample", "level", "factor", Conversion(pre="exp2")),
    ("origin_x", "mm", "um", Conversion(a=1000.0)),
    ("origin_x", "um", "px", Conversion(over="mpp_x")),
    ("origin_x", "dpx", "px", Conversion(times="downsample")),
]
#: The common unit of each quantity.
TARGETS = {"mpp_x": "um", "downsample": "factor", "origin_x": "px"}


def shortest_conversions(edges: list[tuple[str, str, str, Conversion]] = EDGES, targets: dict[str, str] = TARGETS) -> dict[tuple[str, str], Conversion]:
    """(quantity, unit) -> its conversion to the target, over the fewest edges. Raises ValueError if two ways
    between units disagree."""
    out: dict[tuple[str, str], Conversion] = {}
    for quantity, target in targets.items():
        ways: dict[str, list[tuple[str, Conversion]]] = {}
        for q, u, v, f in edges:
            if q == quantity:
                ways.setdefault(v, []).append((u, f))
                ways.setdefault(u, []).append((v, f.inverse()))
        found, queue = {target: Conversion()}, deque([target])
        while queue:
            at = queue.popleft()
            for unit, step in ways.get(at, []):
                whole = step.then(found[at]) if at != target else step
                if unit not in found:
                    found[unit] = whole
                    queue.append(unit)
                elif any(not np.isclose(whole(x, 3.0), found[unit](x, 3.0), rtol=1e-9) for x in (1.0, 2.5, 7.0)):
                    raise ValueError(f"conversions of {quantity} disagree between {unit} and {target}")
        out |= {(quantity, u): f for u, f in found.items()}
    return out


def conversion_table(spark: SparkSession) -> DataFrame:
    """The fixed table of conversions; a row per (quantity, unit), about twenty in all."""
    rows = [(q, u, f.pre, f.a, f.b, f.c, f.d, f.times or f.over, bool(f.over)) for (q, u), f in shortest_conversions().items()]
    return spark.createDataFrame(rows, "quantity string, unit string, pre string, a double, b double, c double, d double, field string, divides boolean")


def to_common_unit(df: DataFrame, quantity: str, unit: str, value: str, fields: dict[str, str] | None = None, out: str = "common") -> DataFrame:
    """``df`` with ``out``: the value in the quantity's common unit, null where the unit is unknown, the value null,
    or the field it hangs on null. ``fields``: field name -> column that has it already converted."""
    t = F.broadcast(conversion_table(df.sparkSession).select(*[F.col(c).alias(f"_u_{c}") for c in ("quantity", "unit", "pre", "a", "b", "c", "d", "field", "divides")]))  # a fixed table
    j = df.join(t, (df[quantity] == t["_u_quantity"]) & (df[unit] == t["_u_unit"]), "left")
    v = F.when(F.col("_u_pre") == "exp2", F.pow(F.lit(2.0), F.col(value))).otherwise(F.col(value))
    v = (F.col("_u_a") * v + F.col("_u_b")) / F.expr("nullif(_u_c * " + f"(CASE WHEN _u_pre = 'exp2' THEN pow(2.0D, `{value}`) ELSE `{value}` END)" + " + _u_d, 0D)")
    field = F.lit(None).cast("double")
    for name, col in (fields or {}).items():
        field = F.when(F.col("_u_field") == name, F.col(col)).otherwise(field)
    v = F.when(F.col("_u_field") == "", v).when(F.col("_u_divides"), v / field).otherwise(v * field)
    return j.withColumn(out, F.when(F.col("_u_a").isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)).drop(*[c for c in j.columns if c.startswith("_u_")])


NUMBER = r"[+-]?(?:\d[\d,]*(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?"
_PER_PIXEL = ["", "/px", "/pix", "/pixel", " per px", " per pixel"]
#: How units are written.
ALIASES: dict[str, dict[str, list[str]]] = {
    "mpp_x": {
        "um": ["mpp", *[u + s for u in ("um", "micron", "microns", "micrometre", "micrometres", "micrometer", "micrometers") for s in _PER_PIXEL]],
        "nm": [u + s for u in ("nm", "nanometre", "nanometres", "nanometer", "nanometers") for s in _PER_PIXEL],
        "mm": [u + s for u in ("mm", "millimetre", "millimetres", "millimeter", "millimeters") for s in _PER_PIXEL],
        "dpi": ["dpi", "ppi", "dots per inch", "pixels per inch"],
        "px/mm": [f"{p}{s}mm" for p in ("px", "pix", "pixel", "pixels") for s in ("/", " per ")],
    },
    "origin_x": {
        "px": [f"{z}{p}" for z in ("", "level-0 ", "level 0 ", "level0 ") for p in ("px", "pix", "pixel", "pixels")],
        "dpx": ["dpx", *[f"{z} {p}" for z in ("downsampled", "mask", "preview", "roi") for p in ("px", "pix", "pixel", "pixels")]],
        "um": ["um", "micron", "microns", "micrometre", "micrometres", "micrometer", "micrometers"],
        "mm": ["mm", "millimetre", "millimetres", "millimeter", "millimeters"],
    },
}
#: Which notes speak of a quantity, and the units they state, first hit first.
NOTES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "origin_x": (r"\borigin", [(r"level[- ]?0", "px"), (r"downsampl|preview|mask|\broi\b|\bdpx\b", "dpx"), (r"micromet|micron|\bum\b", "um"), (r"millimet|\bmm\b", "mm"), (r"pixel|\bpx\b", "px")]),
    "downsample": (r"\bdownsampl", [(r"factor", "factor"), (r"fraction", "fraction"), (r"percent|%", "percent"), (r"level", "level")]),
    "mpp_x": (r"\bmpp\b|pixel size|pixelgr|taille de pixel|\bresolution", [(r"dots per inch|\bdpi\b|\bppi\b", "dpi"), (r"(?:px|pix|pixels?)(?:/| per )(?:mm|millimet)", "px/mm"), (r"nanomet|\bnm\b", "nm"), (r"mi[ck]romet|micron|\bum\b", "um"), (r"millimet|\bmm\b", "mm")]),
}


def number(text: Column) -> Column:
    """A number as written: a lone comma is the decimal mark; commas beside a point, and repeated commas,
    group thousands. Null if it can't be read."""
    commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    plain = F.when(text.contains(".") | (commas > 1), F.replace(text, F.lit(","), F.lit(""))).otherwise(F.replace(text, F.lit(","), F.lit(".")))
    v = plain.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[µμ]", "u"), r"\s+", " "))


def _lookup(text: Column, table: dict[str, list[str]]) -> Column:
    pairs = [F.lit(x) for unit, names in table.items() for name in dict.fromkeys(names) for x in (name, unit)]
    return F.try_element_at(F.create_map(*pairs), text)


def noted_unit(notes: Column, quantity: str, patterns: dict[str, tuple[str, list[tuple[str, str]]]] = NOTES) -> Column:
    """The unit that the notes state for this quantity; other remarks in them don't count."""
    about, units = patterns[quantity]
    rest = [patterns[q][0] for q in list(patterns)[: list(patterns).index(quantity)]]

    def unit(seg: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, name in reversed(units):
            out = F.when(seg.rlike(pattern), F.lit(name)).otherwise(out)
        return out

    def ours(seg: Column) -> Column:
        hit = seg.rlike(about)
        for other in rest:
            hit = hit & ~seg.rlike(other)
        return hit & unit(seg).isNotNull()

    return F.try_element_at(F.transform(F.filter(F.split(_tidy(notes), ";"), ours), unit), F.lit(1))


def read_metadata_quantities(records: DataFrame, scanners: DataFrame, aliases: dict[str, dict[str, list[str]]] | None = None, notes: dict[str, tuple[str, list[tuple[str, str]]]] | None = None) -> DataFrame:
    """(record_id, field_name, value) of every readable mpp_x, downsample and origin_x, in micrometres per pixel,
    level-0 pixels per pixel and level-0 pixels.

    A unit in the value holds first, then one in the notes, then (origins) a physical coordinate_space, then the
    scanner's own. A record delivered again counts once, by its latest ingested_at. Null, empty or unreadable
    texts, unknown units and unknown scanners give no row; null record ids are no records; an empty table gives
    no rows. A scanner listed several times counts by its greatest row. Columns other than those named are ignored.
    ``aliases`` adds spellings of units to ALIASES, ``notes`` puts other patterns in place of those of NOTES.
    """
    aliases = {q: {u: [*names, *(aliases or {}).get(q, {}).get(u, [])] for u, names in units.items()} for q, units in ALIASES.items()}
    notes = NOTES | (notes or {})
    cols = ["scanner_source", "coordinate_space", "origin_x", "downsample", "mpp_x", "notes"]
    r = latest(records, ["record_id"], ["ingested_at"], cols)
    s = scanners.select(F.lower(F.trim("scanner_source")).alias("_s"), F.col("mpp_unit").alias("_mpp"), F.col("downsample_style").alias("_ds"), F.col("origin_unit").alias("_or"))
    s = s.where("_s is not null").groupBy("_s").agg(F.max(F.struct("_mpp", "_ds", "_or")).alias("m")).select("_s", "m.*")
    if take_bounded(s, 10_000) is not None:
        s = F.broadcast(s)  # at most 10,000 scanners; beyond that the join shuffles
    r = r.join(s, F.lower(F.trim("scanner_source")) == F.col("_s"), "left")

    def split(c: str) -> tuple[Column, Column]:
        t = _tidy(F.col(c))
        return number(F.regexp_extract(t, rf"^({NUMBER})", 1)), F.trim(F.regexp_extract(t, rf"^{NUMBER}(.*)$", 1))

    mv, mt = split("mpp_x")
    ov, ot = split("origin_x")
    space = F.regexp_extract(F.lower(F.trim("coordinate_space")), r"^(?:physical|stage)_(um|mm)$", 1)
    d = _tidy(F.col("downsample"))
    part = lambda p, i=1: F.regexp_extract(d, p.replace("NUM", NUMBER), i)
    ratio, percent, level, factor = r"^(NUM) ?[/:] ?(NUM)$", r"^(NUM) ?%$", r"^(?:level|lvl|l)(?:-| ?)(NUM)$", r"^[x×] ?(NUM)$|^(NUM) ?[x×]$"
    bare = r"^(NUM)$"
    dv = F.when(part(ratio) != "", number(part(ratio, 2)) / F.nullif(number(part(ratio)), F.lit(0.0))).when(part(percent) != "", number(part(percent))).when(part(level) != "", number(part(level))).when(part(factor, 0) != "", number(F.concat(part(factor), part(factor, 2)))).otherwise(number(part(bare)))
    du = F.when((part(ratio) != "") | (part(factor, 0) != ""), "factor").when(part(percent) != "", "percent").when(part(level) != "", "level").when(part(bare) != "", F.coalesce(noted_unit(F.col("notes"), "downsample", notes), F.col("_ds")))
    r = r.select(
        "record_id",
        F.lit("mpp_x").alias("q1"), mv.alias("v1"), F.when(mt != "", _lookup(mt, aliases["mpp_x"])).otherwise(F.coalesce(noted_unit(F.col("notes"), "mpp_x", notes), F.col("_mpp"))).alias("u1"),
        F.lit("downsample").alias("q2"), dv.alias("v2"), du.alias("u2"),
        F.lit("origin_x").alias("q3"), ov.alias("v3"), F.when(ot != "", _lookup(ot, aliases["origin_x"])).otherwise(F.coalesce(noted_unit(F.col("notes"), "origin_x", notes), F.nullif(space, F.lit("")), F.col("_or"))).alias("u3"),
    )
    r = r.withColumn("v1", F.when(F.col("v1") > 0, F.col("v1")))
    r = r.withColumn("v2", F.when(F.when(F.col("u2") == "level", F.col("v2") >= 0).otherwise(F.col("v2") > 0), F.col("v2")))
    r = to_common_unit(r, "q1", "u1", "v1", out="mpp_x")
    r = to_common_unit(r, "q2", "u2", "v2", out="downsample")
    r = to_common_unit(r, "q3", "u3", "v3", {"mpp_x": "mpp_x", "downsample": "downsample"}, out="origin_x")
    return r.select("record_id", F.explode(F.array(*[F.struct(F.lit(q).alias("field_name"), F.col(q).alias("value")) for q in TARGETS])).alias("x")).select("record_id", "x.*").where("value is not null")
