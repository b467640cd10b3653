"""Column expressions on cells, points and angles. All are built from Spark's own functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """NaN and infinities as null, so that medians and orders treat them as missing."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clip(c: Column | str, low: float | Column, high: float | Column) -> Column:
    """Between low and high; null stays null."""
    c = col(c)
    low = F.lit(low) if not isinstance(low, Column) else low
    high = F.lit(high) if not isinstance(high, Column) else high
    return F.when(c.isNotNull(), F.greatest(low, F.least(high, c)))


def roundness(area: Column | str, perimeter: Column | str) -> Column:
    """4 pi A / P^2; 0 for a perimeter of 0."""
    a, p = col(area), col(perimeter)
    return F.when(p == 0, 0.0).otherwise(4 * math.pi * a / (p * p))


def safe_ratio(num: Column | str, den: Column | str, fill: float = 1.0, least: float = 1e-6) -> Column:
    """num / den, or ``fill`` where the denominator is all but 0 or the ratio isn't finite."""
    n, d = col(num), col(den)
    r = n / F.when(F.abs(d) > least, d)
    return F.coalesce(clean(r), F.lit(fill))


def aspect_ratio(major: Column | str, minor: Column | str) -> Column:
    return safe_ratio(major, minor)


def elongation(major: Column | str, minor: Column | str) -> Column:
    """1 - minor/major, within 0 and 1."""
    return clip(1 - safe_ratio(minor, major), 0.0, 1.0)


def equivalent_diameter(area: Column | str) -> Column:
    return F.sqrt(4 * col(area) / math.pi)


def axis_vector(angle: Column | str) -> tuple[Column, Column]:
    """(cos, sin) of an axis angle."""
    return F.cos(col(angle)), F.sin(col(angle))


def hu_log(h: Column | str) -> Column:
    """-sign(h) log10(|h|), readable across magnitudes; 0 stays finite."""
    h = col(h)
    return -F.signum(h) * F.log10(F.abs(h) + 1e-30)


def axis_difference_deg(a: Column | str, b: Column | str) -> Column:
    """Angle between two undirected axes given in radians: 0 to 90 degrees."""
    d = F.pmod(col(a) - col(b), F.lit(math.pi))
    return F.degrees(F.least(d, math.pi - d))


def patch_of(c: Column | str, n: int = 3) -> Column:
    """Number of the patch, of n over [0, 1], in which a normalised position lies."""
    return F.least(F.lit(n - 1), F.floor(clip(c, 0.0, 1.0) * n)).cast("int")


def patch_centre(patch: Column | str, extent: Column | float, n: int = 3) -> Column:
    return (col(patch) + 0.5) * (extent / n)


def patch_diagonal(width: Column | float, height: Column | float, n: int = 3) -> Column:
    return F.sqrt(F.pow(F.lit(width) / n if not isinstance(width, Column) else width / n, 2) + F.pow(F.lit(height) / n if not isinstance(height, Column) else height / n, 2))


def to_level0(v: Column | str, origin: Column | str, downsample: Column | str) -> Column:
    return col(origin) + col(v) * col(downsample)


def from_level0(v: Column | str, origin: Column | str, downsample: Column | str) -> Column:
    return (col(v) - col(origin)) / col(downsample)


def to_integer_range(c: Column | str, low: int, high: int) -> Column:
    """Rounded half to even and clipped to an integer type's range."""
    return clip(F.rint(col(c)), float(low), float(high)).cast("long")


def truthy(c: Column | str) -> Column:
    """1, true, yes, y and reliable are true, in any case; all else, null too, is false."""
    return F.coalesce(F.lower(F.trim(col(c))).isin("1", "true", "yes", "y", "reliable"), F.lit(False))


def label_dtype(largest: Column | str) -> Column:
    return F.when(col(largest) <= 65_535, "uint16").otherwise("uint32")


def shoelace_area(contour: Column | str) -> Column:
    """Area of a closed contour, an array of struct (x, y)."""
    c = col(contour)
    turned = F.concat(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 1, 1))
    cross = F.zip_with(c, turned, lambda p, q: p.x * q.y - q.x * p.y)
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2


def contour_length(contour: Column | str) -> Column:
    c = col(contour)
    turned = F.concat(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 1, 1))
    step = F.zip_with(c, turned, lambda p, q: F.sqrt(F.pow(q.x - p.x, 2) + F.pow(q.y - p.y, 2)))
    return F.aggregate(step, F.lit(0.0), lambda a, v: a + v)


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(values), F.lit(0))


def axes_of(sxx: Column, syy: Column, sxy: Column) -> tuple[Column, Column, Column]:
    """Major and minor axis (four standard deviations) and the major axis' angle to the x axis, of second central
    moments; the eigenvalues of a symmetric 2 x 2 matrix in closed form."""
    half = (sxx + syy) / 2
    root = F.sqrt(F.pow((sxx - syy) / 2, 2) + sxy * sxy)
    return 4 * F.sqrt(F.greatest(half + root, F.lit(0.0))), 4 * F.sqrt(F.greatest(half - root, F.lit(0.0))), 0.5 * F.atan2(2 * sxy, sxx - syy)


def median_of(values: Column) -> Column:
    """Median of an array; null for an empty one."""
    s = F.array_sort(values)
    n = F.size(s)
    return F.when(n > 0, (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2)
