"""Array kernels as Column expressions (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def scaled(v: Column, length: Column) -> Column:
    """v / length, a zero length counting as 1. Pass a materialized length column: lambdas are evaluated per element."""
    safe = F.when(length == 0, F.lit(1.0)).otherwise(length)
    return F.transform(v, lambda x: x / safe)


def products(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda a, b: a * b)


def dot(u: Column, v: Column) -> Column:
    return total(products(u, v))


def positive_part(m: Column) -> Column:
    return total(F.transform(m, lambda x: F.greatest(x, F.lit(0.0))))


def negative_part(m: Column) -> Column:
    return total(F.transform(m, lambda x: F.greatest(-x, F.lit(0.0))))


def contrast(m: Column) -> Column:
    """Product of what agrees and what opposes in the elementwise products m of two unit vectors."""
    return positive_part(m) * negative_part(m)


def quantize_scale(v: Column) -> Column:
    top = F.array_max(F.transform(v, F.abs))
    return F.when(top == 0, F.lit(1.0)).otherwise(top)


def quantize(v: Column, scale: Column) -> Column:
    """Signed bytes, half to even; ``scale`` is the row's largest magnitude."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x / scale * 127.0))).cast("tinyint"))


def dequantize(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") * (scale / 127.0))


def project(v: Column, mean: Column, components: Column) -> Column:
    """(v - mean) times each component row."""
    centred = F.zip_with(v, mean, lambda a, b: a - b)
    return F.transform(components, lambda row: dot(centred, row))


def concentration(u: Column, v: Column) -> Column:
    """Share of the five largest gaps in the sum of all gaps."""
    gaps = F.zip_with(u, v, lambda a, b: F.abs(a - b))
    return total(F.slice(F.sort_array(gaps, asc=False), 1, 5)) / (total(gaps) + 1e-9)


def gate(a: Column, b: Column, sigma: float = K.XH_SIGMA) -> Column:
    """exp(-|a - b| / sigma), 0 where either is missing."""
    return F.coalesce(F.exp(-F.abs(a - b) / sigma), F.lit(0.0))


def match(a: Column, b: Column, span: float, missing: float = 0.0) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), 1.0 - F.least(F.lit(1.0), F.abs(a - b) / span)).otherwise(F.lit(missing))


def lightness(weight: Column) -> Column:
    return -F.abs(F.log2(weight / 400.0))


def js_round(x: Column, digits: int) -> Column:
    """Half towards plus infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def percentile_form(p: Column, n: Column, form: str) -> Column:
    """Scores from the two parts of the products: 'product', 'min' or 'balanced'."""
    if form == "product":
        return p * n
    return F.least(p, n) * (2.0 if form == "balanced" else 1.0)


def axis_metric(skeleton: Column, d_width: Column, contrasts: dict[str, tuple[Column, float]]) -> Column:
    """Shared skeleton, damped by the width gap, times a weighted sum of contrasts."""
    weighted = sum((c * w for c, w in contrasts.values()), F.lit(0.0))
    return skeleton * (1.0 - 0.3 * F.least(F.lit(1.0), d_width / 0.3)) * weighted
