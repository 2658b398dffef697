"""Vector, span and score functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine_of_common(a: Column, b: Column) -> Column:
    """The cosine over the places that both have; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is empty, of zero length, or the sizes differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def similarity(distance: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance)), F.lit(1.0))


def clamped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    both = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    union = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when((both > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def clipped(start: Column, end: Column, n: Column) -> tuple[Column, Column]:
    """A span inside [0, n], its ends swapped if they stand the wrong way round."""
    a, b = (F.greatest(F.lit(0), F.least(x, n)) for x in (start, end))
    return F.least(a, b), F.greatest(a, b)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def greedy_spans(spans: Column) -> Column:
    """Of array<struct<start, end, ...>>: sorted, each kept that starts at or after the end of the last one kept."""
    ordered = F.array_sort(spans)
    empty = F.slice(ordered, 1, 0)
    start = F.struct(F.lit(-1).alias("at"), empty.alias("kept"))
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].cast("int").alias("at"), F.concat(a["kept"], F.array(s)).alias("kept"))).otherwise(F.struct(a["at"].alias("at"), a["kept"].alias("kept")))
    return F.aggregate(ordered, start, step, lambda a: a["kept"])
