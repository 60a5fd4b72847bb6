"""3-vectors as tuples of Columns, and array vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Vec = tuple[Column, Column, Column]


def vec(*names: str) -> Vec:
    return tuple(F.col(n).cast("double") for n in names)


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def angle_degrees(a: Vec, b: Vec) -> Column:
    """The angle between two vectors of any length; NULL if one is zero."""
    return F.degrees(F.acos(clip(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), -1.0, 1.0)))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def squared_distance(a: str | Column, b: str | Column) -> Column:
    """Squared L2 distance of two arrays, summed left to right in double precision."""
    terms = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def rotate(w: Vec, p: Vec) -> Vec:
    """Rodrigues' formula: p turned about w by |w| radians; p itself where w is zero."""
    theta = norm(w)
    unit = tuple(x / F.nullif(theta, F.lit(0.0)) for x in w)
    c, s = F.cos(theta), F.sin(theta)
    k, d = cross(unit, p), dot(unit, p)
    return tuple(F.when(theta < 1e-12, p[i]).otherwise(p[i] * c + k[i] * s + unit[i] * d * (1 - c)) for i in range(3))
