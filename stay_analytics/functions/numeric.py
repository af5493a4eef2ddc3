"""Numeric column helpers shared by every operator.

``pround`` reproduces the rounding of the reference (numpy: scale, round half
to even on the binary product, unscale). Spark's ``round`` rounds half-up on
the decimal text instead, so ``round(1.005, 2)`` differs between engines; the
formula here is plain IEEE arithmetic and gives the same bits everywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pround(c, digits: int = 0) -> Column:
    """Round half to even after scaling by 10**digits (numpy semantics)."""
    scale = float(10 ** digits)
    # rint is IEEE round-half-even on the scaled double, exactly numpy's rule.
    return F.rint(col_of(c).cast("double") * F.lit(scale)) / F.lit(scale)


def pround_sql(expr: str, digits: int = 0) -> str:
    """The same rounding as SQL text (DuckDB and Spark SQL)."""
    scale = f"{float(10 ** digits)!r}"
    y = f"(CAST(({expr}) AS DOUBLE) * {scale})"
    r = f"CAST(floor({y}) AS DOUBLE)"
    return (f"((CASE WHEN {y} - {r} > 0.5 THEN {r} + 1.0 "
            f"WHEN {y} - {r} < 0.5 THEN {r} "
            f"ELSE {r} + abs(fmod({r}, 2.0)) END) / {scale})")


#: Terms of the series and of the continued fraction of ``erfc``, and where the one gives way to the other.
ERFC_TERMS, ERFC_TAIL = 60, 2.5


def erfc(x) -> Column:
    """Complementary error function, null for null: a series near 0, a continued fraction in the tail; both are rational but for exp(-x^2)."""
    x = col_of(x).cast("double")
    a, t = F.abs(x), x * x
    steps = F.sequence(F.lit(ERFC_TERMS), F.lit(1), F.lit(-1))
    near = 1.0 - 2.0 / math.sqrt(math.pi) * a * F.exp(-t) * F.aggregate(steps, F.lit(1.0), lambda s, n: 1.0 + 2.0 * t / (2.0 * n + 1.0) * s)
    fraction = F.aggregate(steps, F.lit(1.0), lambda s, n: 1.0 + n / (2.0 * F.greatest(t, F.lit(1.0))) / s)
    tail = F.exp(-t) / (F.greatest(a, F.lit(1.0)) * math.sqrt(math.pi)) / fraction
    positive = F.when(a < ERFC_TAIL, near).when(a >= ERFC_TAIL, tail)
    return F.when(x < 0, 2.0 - positive).otherwise(positive)


def erfc_sql(x: str) -> str:
    """``erfc`` of a column name as DuckDB SQL."""
    steps = f"[1.0::DOUBLE] || list_transform(range({ERFC_TERMS}, 0, -1), lambda n: CAST(n AS DOUBLE))"
    near = f"(1.0 - 2.0 / sqrt(pi()) * abs({x}) * exp(-{x} * {x}) * list_reduce({steps}, lambda s, n: 1.0 + 2.0 * {x} * {x} / (2.0 * n + 1.0) * s))"
    tail = f"(exp(-{x} * {x}) / (abs({x}) * sqrt(pi())) / list_reduce({steps}, lambda s, n: 1.0 + n / (2.0 * {x} * {x}) / s))"
    positive = f"(CASE WHEN abs({x}) < {ERFC_TAIL} THEN {near} ELSE {tail} END)"
    return f"(CASE WHEN {x} < 0 THEN 2.0 - {positive} ELSE {positive} END)"


def safe_ratio(num, den) -> Column:
    """num / den with 0 denominators and non-finite results mapped to null."""
    n, d = col_of(num).cast("double"), col_of(den).cast("double")
    q = F.when(d != 0, n / d)
    return F.when(~F.isnan(q) & (F.abs(q) != F.lit(float("inf"))), q)


def clip_upper(c, cap) -> Column:
    """Upper clip that keeps nulls null (``least(null, cap)`` would return cap)."""
    c = col_of(c)
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    return F.when(c > cap, cap).otherwise(c)


def log_target(c) -> Column:
    return F.log1p(col_of(c))


def from_log_target(c) -> Column:
    return F.greatest(F.expm1(col_of(c)), F.lit(0.0))
