"""Arithmetic on ``array<float>`` / ``array<double>`` columns, JVM-side.

Scalars meet vectors as repeated arrays and never inside a lambda: there the
optimiser may put the scalar's whole expression, to be worked out again for
every element.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def widen(v: Column) -> Column:
    """The vector in double precision."""
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def divided(v: Column, by: Column) -> Column:
    return F.zip_with(v, F.array_repeat(by, F.size(v)), lambda x, s: x.cast("double") / s)


def scaled(v: Column, by: Column) -> Column:
    return F.zip_with(v, F.array_repeat(by, F.size(v)), lambda x, s: x.cast("double") * s)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def l2_normalise(v: Column) -> Column:
    """Unit-length vector; the zero vector stays zero."""
    return F.when(norm(v) > 0, divided(v, norm(v))).otherwise(widen(v))


def truncate_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """Both vectors cut to the shorter dimension."""
    d = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), d), F.slice(b, F.lit(1), d)


def zeros_like(v: Column) -> Column:
    return F.transform(v, lambda x: F.lit(0.0))


def average(a: Column, b: Column) -> Column:
    return F.zip_with(
        widen(a), widen(b), lambda x, y: (x + y) / 2.0
    )


def interaction(t: Column, i: Column) -> Column:
    """``[t, i, t*i, |t-i|]`` as one vector; product and distance over shared dimensions."""
    t, i = widen(t), widen(i)
    a, b = truncate_pair(t, i)
    return F.concat(
        t,
        i,
        F.zip_with(a, b, lambda x, y: x * y),
        F.zip_with(a, b, lambda x, y: F.abs(x - y)),
    )
