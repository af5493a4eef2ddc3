"""Helpers that write oracle SQL text (DuckDB dialect).

Oracles are written independently of the Spark code: windows and
``quantile_cont`` where the Spark side uses distinct-count tricks, joins and
aggregates. Only these small text builders are shared between oracles.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.numeric import pround_sql
from ..sources.fixtures import with_views

__all__ = ["with_views", "pround_sql", "avg_rank_sql", "dbl", "filled_sql"]


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _part(by: Sequence[str]) -> str:
    return f"PARTITION BY {', '.join(by)}" if by else ""


def filled_sql(value: str, by: Sequence[str], alias: str) -> str:
    """``value`` with nulls replaced by the pool median, plus its non-null count."""
    p = _part(by)
    return (f"coalesce(CAST({value} AS DOUBLE), median(CAST({value} AS DOUBLE)) OVER ({p})) AS {alias}, "
            f"count({value}) OVER ({p}) AS {alias}_n")


def avg_rank_sql(filled: str, by: Sequence[str], higher_is_better: bool = True) -> str:
    """Average percentile rank of an already-filled column (0.5 for an all-null pool)."""
    p = _part(by)
    pv = _part([*by, filled])
    pct = (f"((CAST(rank() OVER ({p} ORDER BY {filled}) AS DOUBLE) + "
           f"CAST(count(*) OVER ({pv}) - 1 AS DOUBLE) / 2.0) / CAST(count(*) OVER ({p}) AS DOUBLE))")
    expr = pct if higher_is_better else f"(1.0 - {pct})"
    return f"(CASE WHEN {filled}_n = 0 THEN 0.5 ELSE {expr} END)"
