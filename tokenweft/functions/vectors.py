"""Column expressions on vectors (arrays). Products and sums are in double precision whatever the stored type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v: Column | str, by: Column | float) -> Column:
    return F.transform(col(v), lambda x: x.cast("double") * by)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once for a row, however often body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(v: Column | str, eps: float = 1e-9) -> Column:
    """v / (|v| + eps)."""
    return let(col(v), lambda w: let(norm(w) + F.lit(eps), lambda n: F.transform(w, lambda x: x.cast("double") / n)))


def unit_centroid(v: Column | str, eps: float = 1e-9) -> Column:
    """v / max(|v|, eps)."""
    return let(col(v), lambda w: let(F.greatest(norm(w), F.lit(eps)), lambda n: F.transform(w, lambda x: x.cast("double") / n)))


def plus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x.cast("double") + y.cast("double"))


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y.cast("double"))


def project(v: Column | str, matrix: list[list[float]]) -> Column:
    """v times a (dim_in x dim_out) matrix."""
    columns = zip(*matrix, strict=True)
    return F.array(*(dot(v, F.array(*map(F.lit, map(float, c)))) for c in columns))


def text(v: Column | str, digits: int = 6) -> Column:
    """The vector as comma-joined rounded numbers, for comparison by value."""
    return F.array_join(F.transform(col(v), lambda x: F.format_number(F.when(F.round(x, digits) == 0, 0.0).otherwise(F.round(x, digits)), digits)), ",")


def rounded(x: Column | str, digits: int) -> Column:
    """x * 10**digits rounded half away from zero, over 10**digits, as std::round does: F.round decides halves by the decimal text and drops the sign of zero."""
    x = F.col(x) if isinstance(x, str) else x
    scaled_up = F.abs(x) * F.lit(float(10**digits))
    whole = F.floor(scaled_up).cast("double")
    up = (whole + F.when(scaled_up - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(float(10**digits))
    return F.when(x == 0, x).when(x < 0, -up).otherwise(up)
