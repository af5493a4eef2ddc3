"""Date and calendar column functions (PR14-PR17, PR16, SV5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col_of

# Month number -> season (northern hemisphere).
SEASON_BY_MONTH = {12: "winter", 1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring",
                   6: "summer", 7: "summer", 8: "summer", 9: "autumn", 10: "autumn", 11: "autumn"}
SEASONS = ["winter", "spring", "summer", "autumn"]


def season_of_month(month, title: bool = False) -> Column:
    """PR16: season label of a month number (null month -> null)."""
    m = col_of(month)
    out = None
    for months, label in (((12, 1, 2), "winter"), ((3, 4, 5), "spring"), ((6, 7, 8), "summer"),
                          ((9, 10, 11), "autumn")):
        lab = label.title() if title else label
        out = F.when(m.isin(*months), lab) if out is None else out.when(m.isin(*months), lab)
    return out


def weekday_mon0(d) -> Column:
    """PR15: day of week with Monday = 0 (``dayofweek`` is Sunday = 1)."""
    return F.weekday(col_of(d))


def is_weekend(d, null_as_weekday: bool = True) -> Column:
    w = weekday_mon0(d) >= 5
    return (F.coalesce(w, F.lit(False)) if null_as_weekday else w).cast("int")


def available_flag(c, strict: bool = True) -> Column:
    """PR17: 't' -> 1. Strict: anything else (incl. null) -> 0. Lenient: 'f' -> 0, else null."""
    s = col_of(c)
    if strict:
        return F.coalesce(s == "t", F.lit(False)).cast("int")
    return F.when(s == "t", 1).when(s == "f", 0)


def months_touched(check_in, check_out) -> Column:
    """SV5: month starts from the check-in month to the month of the last night."""
    cin, cout = col_of(check_in).cast("date"), col_of(check_out).cast("date")
    last = F.date_sub(cout, 1)
    return F.when(last >= cin, F.sequence(F.trunc(cin, "MM"), F.trunc(last, "MM"), F.expr("INTERVAL 1 MONTH")))


def day_diff(end, start) -> Column:
    """PR14: whole days between two dates (nulls propagate)."""
    return F.datediff(col_of(end).cast("date"), col_of(start).cast("date"))
