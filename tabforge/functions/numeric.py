"""Numeric column expressions.

Learned parameters enter as literals, so Catalyst folds them and the
expressions compile into the surrounding stage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi
ZERO_DIVISOR_REPLACEMENT = 1e-6


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cyclical(c: Column | str, period: float) -> tuple[Column, Column]:
    """``(sin(2*pi*x/p), cos(2*pi*x/p))``."""
    angle = F.lit(TWO_PI) * _c(c).cast("double") / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """X4 divide: a zero divisor is replaced by 1e-6 (no ANSI error)."""
    bb = _c(b).cast("double")
    return _c(a).cast("double") / F.when(bb == 0, F.lit(ZERO_DIVISOR_REPLACEMENT)).otherwise(bb)


NUMERIC_OPS = {
    "add": lambda a, b: _c(a).cast("double") + _c(b).cast("double"),
    "subtract": lambda a, b: _c(a).cast("double") - _c(b).cast("double"),
    "multiply": lambda a, b: _c(a).cast("double") * _c(b).cast("double"),
    "divide": safe_divide,
}


def boxcox(c: Column | str, lam: float) -> Column:
    """Box-Cox at a fixed lambda."""
    x = _c(c).cast("double")
    if abs(lam) < 1e-12:
        return F.log(x)
    return (F.pow(x, F.lit(lam)) - 1.0) / F.lit(lam)


def inv_boxcox(c: Column | str, lam: float) -> Column:
    y = _c(c).cast("double")
    if abs(lam) < 1e-12:
        return F.exp(y)
    return F.pow(F.lit(lam) * y + 1.0, F.lit(1.0 / lam))


def yeojohnson(c: Column | str, lam: float) -> Column:
    """Yeo-Johnson at a fixed lambda (branch on lambda at plan time)."""
    x = _c(c).cast("double")
    if abs(lam) < 1e-12:
        pos = F.log1p(x)
    else:
        pos = (F.pow(x + 1.0, F.lit(lam)) - 1.0) / F.lit(lam)
    if abs(lam - 2.0) < 1e-12:
        neg = -F.log1p(-x)
    else:
        neg = -(F.pow(-x + 1.0, F.lit(2.0 - lam)) - 1.0) / F.lit(2.0 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def inv_yeojohnson(c: Column | str, lam: float) -> Column:
    y = _c(c).cast("double")
    if abs(lam) < 1e-12:
        pos = F.expm1(y)
    else:
        pos = F.pow(F.lit(lam) * y + 1.0, F.lit(1.0 / lam)) - 1.0
    if abs(lam - 2.0) < 1e-12:
        neg = -F.expm1(-y)
    else:
        neg = 1.0 - F.pow(F.lit(-(2.0 - lam)) * y + 1.0, F.lit(1.0 / (2.0 - lam)))
    return F.when(y >= 0, pos).otherwise(neg)


def clip(c: Column | str, lo: float | None, hi: float | None) -> Column:
    """Clip to ``[lo, hi]``; NULL stays NULL (``greatest``/``least`` alone
    would turn a NULL into a bound)."""
    x = _c(c)
    out = x
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    return F.when(x.isNull(), F.lit(None)).otherwise(out)
