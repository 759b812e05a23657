"""Reproducible draws: md5 of seed and id, equal on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digest(*parts: Column | str | int) -> Column:
    """md5 hex of the parts joined by ``:``."""
    cols = [(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def draw_below(bound: int, *parts: Column | str | int) -> Column:
    """Integer in ``0..bound-1``."""
    return (F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint") % bound).cast("int")


def uniform(*parts: Column | str | int) -> Column:
    """Number in ``[0, 1)``, a multiple of 2**-32."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("double") / float(2**32)
