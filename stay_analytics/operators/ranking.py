"""Ranking and windows (WN1-WN10).

``rank_scores`` is the average percentile rank the reference uses for every
score: missing values take the pool median, ties share the average rank,
``rank / n`` lands in (0, 1], a pool with no values scores 0.5, and
"lower is better" scores are ``1 - rank``.

Scale design. A pool (a city, a request, a feature) may hold a third of all
rows, so no step puts a whole pool into one task:

1. Rows are reduced to distinct ``(pool, feature, value) -> count`` with a
   map-side partial aggregate. A hot *value* becomes one row.
2. Running counts go through fine buckets of the value (an order-preserving
   whole number, about 0.3 % wide): a window over the bucket totals of a pool
   gives each bucket its offset, and a window inside each bucket adds the
   local running count. Buckets are a function of the value alone, so every
   branch and every retried task sees the same ones, nothing is sampled and
   nothing runs before the plan does. This is the only path, at every size.
3. The pool median (for null fill) is read off those running counts exactly,
   with no per-pool value map.
4. Rows and rank table are written once. Ranks of features with few distinct
   values are copied to the rows; only those of the others are met by a
   shuffle on (pool, value), whose skewed partitions AQE splits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col_of, pround
from ..session import written_once

_F, _V, _CNT = "_rk_feature", "_rk_value", "_rk_cnt"

#: Ranks of a feature with up to so many distinct (pool, value) are copied to all tasks, about 10 MB.
COPIED_RANKS = 1 << 17


#: Buckets per unit of the natural logarithm: about 256 for each doubling of the value.
BUCKETS_PER_LOG = 369


def value_bucket(value: str) -> Column:
    """Whole number that never decreases as the (double) value grows; NaN comes last."""
    v = F.col(value).cast("double")
    # The logarithm of any positive double lies in (-746, 710); the offset keeps both signs apart.
    size = F.floor((F.log(F.abs(v)) + 750) * BUCKETS_PER_LOG)
    return (F.when(F.isnan(v), F.lit(1 << 40)).when(v == 0, F.lit(0)).when(v == float("inf"), F.lit(1 << 30))
            .when(v == -float("inf"), F.lit(-(1 << 30))).when(v > 0, size).otherwise(-size).cast("bigint"))


def running_below(counts: DataFrame, keys: Sequence[str], value: str, cnt: str, out: str = "_below") -> DataFrame:
    """Add ``out`` = total ``cnt`` of rows with a smaller ``value`` in the same ``keys`` group.

    ``counts`` has one row per distinct (keys, value), keys and values not
    null. A group is spread over its buckets; one task holds the bucket totals
    of a group (a few thousand numbers) or the distinct values of one bucket.
    """
    keys = list(keys)
    rows = counts.withColumn("_bkt", value_bucket(value))
    before = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*keys, "_bkt").agg(F.sum(cnt).alias("_tot"))
               .select(*keys, "_bkt", F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_off")))
    local = Window.partitionBy(*keys, "_bkt").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_loc", F.coalesce(F.sum(cnt).over(local), F.lit(0)))
            .join(offsets, [*keys, "_bkt"])
            .withColumn(out, F.col("_off") + F.col("_loc")).drop("_bkt", "_off", "_loc"))


def rank_table(df: DataFrame, features: Mapping[str, Column | str], by: Sequence[str] = ()) -> DataFrame:
    """Long table ``(by..., _rk_feature, _rk_value, pct)`` of average percentile ranks.

    ``_rk_value`` is the raw value (null for missing rows, which rank at the
    pool median); join it back null-safely. The counts are written once; what
    is known of a pool's buckets is a small table that meets them where they are.
    """
    by = list(by)
    keys = by + [_F]
    cells = F.array(*[F.struct(F.lit(name).alias(_F), col_of(c).cast("double").alias(_V))
                      for name, c in features.items()])
    long = df.select(*by, F.inline(cells))
    counts = written_once(long.groupBy(*keys, _V).agg(F.count(F.lit(1)).alias(_CNT)).withColumn("_bkt", value_bucket(_V)))

    # Per bucket of a pool the rows below it; missing rows are the bucket without a number.
    pool, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    known_total = F.when(F.col("_bkt").isNotNull(), F.col("_tot")).otherwise(0)
    buckets = written_once(counts.groupBy(*keys, "_bkt").agg(F.sum(_CNT).alias("_tot")).select(
        *keys, "_bkt", "_tot", F.coalesce(F.sum(known_total).over(before), F.lit(0)).alias("_off"),
        F.sum(known_total).over(pool).alias("_nknown"), F.sum(F.col("_tot") - known_total).over(pool).alias("_nnull")))
    # Median = linear interpolation between order statistics lo and hi (0-based);
    # the two rows covering them also give how many known values sit below / at it.
    pos = (F.col("_nknown") - 1) / 2.0
    lo, hi = F.floor(pos), F.ceil(pos)
    covers = lambda k: (F.col("_below") <= k) & (k < F.col("_below") + F.col(_CNT))
    at = lambda k, c: F.max(F.when(covers(k), F.col(c)))
    known = counts.filter(F.col(_V).isNotNull())
    local = Window.partitionBy(*keys, "_bkt").orderBy(_V).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_off") + F.coalesce(F.sum(_CNT).over(local), F.lit(0))
    middle = buckets.filter(F.col("_bkt").isNotNull() & (F.col("_off") <= hi) & (lo < F.col("_off") + F.col("_tot")))
    med = (known.join(middle, [*keys, "_bkt"]).withColumn("_below", below)
           .groupBy(*keys).agg(at(lo, _V).alias("_vlo"), at(hi, _V).alias("_vhi"),
                               at(lo, "_below").alias("_blo"), at(lo, _CNT).alias("_clo"),
                               at(hi, _CNT).alias("_chi")))
    m = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * 0.5
    med = med.select(
        *keys, m.alias("_med"),
        (F.col("_blo") + F.when(m > F.col("_vlo"), F.col("_clo")).otherwise(0)).alias("_nlt"),
        (F.when(m == F.col("_vlo"), F.col("_clo")).otherwise(0)
         + F.when((m == F.col("_vhi")) & (F.col("_vhi") != F.col("_vlo")), F.col("_chi")).otherwise(0)
         ).alias("_neq"))
    stats = written_once(buckets.join(med, keys, "left"))

    known_rows = known.join(stats.filter(F.col("_bkt").isNotNull()), [*keys, "_bkt"]).withColumn("_below", below).select(
        *keys, _V,
        (F.col("_below") + F.when(F.col(_V) > F.col("_med"), F.col("_nnull")).otherwise(0)).alias("_b"),
        (F.col(_CNT) + F.when(F.col(_V) == F.col("_med"), F.col("_nnull")).otherwise(0)).alias("_c"),
        (F.col("_nknown") + F.col("_nnull")).alias("_n"))
    null_rows = stats.filter(F.col("_bkt").isNull()).select(
        *keys, F.lit(None).cast("double").alias(_V),
        F.coalesce("_nlt", F.lit(0)).alias("_b"),
        (F.coalesce("_neq", F.lit(0)) + F.col("_nnull")).alias("_c"),
        (F.col("_nknown") + F.col("_nnull")).alias("_n"),
        F.col("_nknown"))
    pct = (F.col("_b") + (F.col("_c") + 1) / 2.0) / F.col("_n")
    known_out = known_rows.select(*keys, _V, pct.alias("pct"))
    null_out = null_rows.select(*keys, _V, F.when(F.col("_nknown") == 0, F.lit(0.5)).otherwise(pct).alias("pct"))
    return known_out.unionByName(null_out)


def rank_scores(df: DataFrame, specs: Mapping[str, tuple[Column | str, bool]],
                by: Sequence[str] = ()) -> DataFrame:
    """Add one score column per spec: ``{out: (value, higher_is_better)}``.

    The rows are written once and all features are ranked in one pass. Ranks
    of a feature with up to COPIED_RANKS distinct (pool, value) are copied to
    the rows; the others are joined on (pool, value), the only shuffles of rows.
    """
    by = list(by)
    tmp = {name: f"_rkv_{i}" for i, name in enumerate(specs)}
    work = written_once(df.select("*", *[col_of(c).cast("double").alias(tmp[name]) for name, (c, _) in specs.items()]))
    order = [*by, *[c for c in df.columns if c not in by], *specs]
    table = written_once(rank_table(work, {str(i): F.col(tmp[name]) for i, name in enumerate(specs)}, by), _F)
    sizes = dict(table.groupBy(_F).count().collect())
    for i, (name, (_, higher)) in sorted(enumerate(specs.items()), key=lambda x: sizes.get(str(x[0]), 0)):
        vkey, nkey = f"_rkj_{i}", f"_rkn_{i}"
        part = table.filter(F.col(_F) == str(i)).select(
            *by, F.coalesce(F.col(_V), F.lit(0.0)).alias(vkey), F.col(_V).isNull().alias(nkey),
            (F.col("pct") if higher else F.lit(1.0) - F.col("pct")).alias(name))
        if sizes.get(str(i), 0) <= COPIED_RANKS:
            part = F.broadcast(part)
        work = (work.withColumn(vkey, F.coalesce(F.col(tmp[name]), F.lit(0.0)))
                .withColumn(nkey, F.col(tmp[name]).isNull())
                .join(part, [*by, vkey, nkey], "left").drop(vkey, nkey))
    return work.select(*order)


@dataclass(frozen=True)
class Quantile:
    """An exact interpolated quantile for ``grouped``: of ``value``, rounded to ``digits`` if given."""

    value: Column | str
    q: float = 0.5
    digits: int | None = None
    name: str = ""

    def alias(self, name: str) -> "Quantile":
        return replace(self, name=name)


def median_of(value: Column | str, digits: int | None = None) -> Quantile:
    return Quantile(value, 0.5, digits)


def _quantiles(df: DataFrame, quantiles: Sequence[Quantile], key: Column) -> DataFrame:
    """One row per ``_g`` (``key``) with the quantile columns, without holding a group in one task.

    Distinct values are counted (a hot value is one row), buckets of them
    carry running counts, and the rows that cover the wanted order statistics
    are read off.
    """
    cells = F.array(*[F.struct(F.lit(i).alias(_F), col_of(x.value).cast("double").alias(_V)) for i, x in enumerate(quantiles)])
    counts = (df.select(key.alias("_g"), F.inline(cells)).filter(F.col(_V).isNotNull())
              .groupBy("_g", _F, _V).agg(F.count(F.lit(1)).alias(_CNT)))
    total = counts.groupBy("_g", _F).agg(F.sum(_CNT).alias("_n"))
    share = F.element_at(F.array(*[F.lit(float(x.q)) for x in quantiles]), F.col(_F) + 1)
    covers = lambda k: (F.col("_below") <= k) & (k < F.col("_below") + F.col(_CNT))
    at = lambda k: F.max(F.when(covers(k), F.col(_V)))
    found = (running_below(counts, ["_g", _F], _V, _CNT).join(total, ["_g", _F])
             .withColumn("_pos", (F.col("_n") - 1) * share).groupBy("_g", _F)
             .agg(at(F.floor("_pos")).alias("_lo"), at(F.ceil("_pos")).alias("_hi"), F.max(F.col("_pos") - F.floor("_pos")).alias("_w")))
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")
    columns = []
    for i, x in enumerate(quantiles):
        got = F.max(F.when(F.col(_F) == i, value))
        columns.append((got if x.digits is None else pround(got, x.digits)).alias(x.name))
    return found.groupBy("_g").agg(*columns)


def grouped(df: DataFrame, by: Sequence[str], *aggs: Column | Quantile) -> DataFrame:
    """``df.groupBy(by).agg(aggs)`` where some of ``aggs`` are exact quantiles.

    Columns come in the order given. A group without values has a null
    quantile; null keys are groups; without ``by`` there is one row.
    """
    by = list(by)
    quantiles = [x for x in aggs if isinstance(x, Quantile)]
    plain = [x for x in aggs if not isinstance(x, Quantile)]
    base = df.groupBy(*by).agg(*(plain or [F.count(F.lit(1)).alias("_rows")]))
    names = iter([c for c in base.columns if c not in by and c != "_rows"])
    order = [x.name if isinstance(x, Quantile) else next(names) for x in aggs]
    key = F.struct(*by) if by else F.lit("")  # structs are equal where their nulls are
    return base.withColumn("_g", key).join(_quantiles(df, quantiles, key), "_g", "left").select(*by, *order)


def top_n_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int,
                    out: str | None = "rank") -> DataFrame:
    """WN5/WN6: first ``n`` rows per group by ``order`` (add a key tiebreak in ``order``).

    ``row_number`` over a window whose rank limit Spark pushes below the
    shuffle (``WindowGroupLimit``), so each task keeps only ``n`` rows per group.
    """
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    res = df.withColumn("_rn", rn).filter(F.col("_rn") <= n)
    return res.withColumnRenamed("_rn", out) if out else res.drop("_rn")
