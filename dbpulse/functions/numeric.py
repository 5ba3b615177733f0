"""Exact decimal helpers (JVM-side expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dec(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def idiv(num: Column, den: Column) -> Column:
    """Integer division truncating toward zero (SQL ``a div b``)."""
    return F.call_function("div", num, den)


def round_div(num: Column, den: Column, scale: int, precision: int = 16) -> Column:
    """``num / den`` rounded half away from zero to ``scale`` decimals.

    Works in integers, so the result is exact (no double rounding through
    an intermediate decimal scale). ``den`` must be positive; a zero or NULL
    ``den`` gives NULL.
    """
    n = _dec(num) * F.lit(10 ** scale).cast("decimal(38,0)")
    d = _dec(den)
    q = idiv(F.abs(n) * 2 + d, d * 2)
    signed = F.when(n < 0, -q).otherwise(q)
    out = (signed.cast("decimal(38,0)") / F.lit(10 ** scale)).cast(f"decimal({precision},{scale})")
    return F.when(d > 0, out)


def int_avg(total: Column, count: Column) -> Column:
    """Truncating integer average (``sum div count``), NULL on zero count."""
    return F.when(count != 0, idiv(total, count))
