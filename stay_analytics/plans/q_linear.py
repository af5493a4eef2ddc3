"""Registered per-city and per-segment linear price models (ML1, ML4-ML6, ML12, ML14, WN5, JN12).

The oracle sets up the normal equations from unpivoted rows and solves them by
elimination in a recursive query.
"""

from __future__ import annotations

from ..operators import linear, ml
from ..sources import fixtures as fx
from .registry import register
from .sqlkit import dbl, pround_sql, with_views

FOLDS = 3
_NUM, _CAT = ml.NUMERIC_FEATURES, ml.CATEGORICAL_FEATURES
_TEST = f"substr(md5('42:' || CAST(listing_id AS VARCHAR)), 1, 8) < '{ml.hash_fraction_threshold(0.2)}'"
_FOLD = f"CAST(('0x' || substr(md5('fold42:' || CAST(listing_id AS VARCHAR)), 1, 8))::BIGINT % {FOLDS} AS INT)"


def _fits_sql(segments: list[str], folds: bool, penalties=linear.PENALTIES) -> str:
    """CTEs up to ``pred`` (city, segment_type, segment, left_out, penalty, listing_id, actual, predicted)."""
    modes = ", ".join(f"mo_{c} AS (SELECT city, arg_min({c}, (-n, {c})) AS m FROM (SELECT city, {c}, count(*) AS n FROM r0 WHERE fold <> -1 AND {c} IS NOT NULL "
                      f"GROUP BY ALL) GROUP BY city)" for c in _CAT)
    filled = ", ".join([f"coalesce(CAST(r0.{c} AS DOUBLE), md.{c}, 0.0::DOUBLE) AS {c}" for c in _NUM] + [f"coalesce(r0.{c}, mo_{c}.m, 'Unknown') AS {c}" for c in _CAT])
    entries = "UNION ALL ".join(
        ["SELECT listing_id, '00' AS f, 1.0::DOUBLE AS v FROM r "] +
        [f"SELECT listing_id, '{k + 1:02d} {c}', {c} FROM r " for k, c in enumerate(_NUM)] +
        [f"SELECT listing_id, '{k + 80} {c}=' || {c}, 1.0::DOUBLE FROM r " for k, c in enumerate(_CAT)])
    kinds = "UNION ALL ".join(["SELECT listing_id, city, 'city' AS segment_type, 'city' AS segment, fold, label, price_eur FROM r "] +
                              [f"SELECT listing_id, city, '{c}', {c}, fold, label, price_eur FROM r " for c in segments])
    key = "city, segment_type, segment"
    left_out = f"SELECT unnest(range(-1, {FOLDS if folds else 0}))::INT AS left_out"
    used = f"fold BETWEEN 0 AND {FOLDS - 1}" if folds else "fold = -1"
    values = ", ".join(f"({dbl(p)})" for p in penalties)
    return with_views("listings").replace("WITH ", "WITH RECURSIVE ", 1)[:-1] + f""",
r0 AS (SELECT *, CASE WHEN {_TEST} THEN -1 ELSE {_FOLD} END AS fold, ln(1 + price_eur) AS label FROM listings WHERE price_eur > 0),
md AS (SELECT city, {', '.join(f'median(CAST({c} AS DOUBLE)) AS {c}' for c in _NUM)} FROM r0 WHERE fold <> -1 GROUP BY city), {modes},
r AS MATERIALIZED (SELECT r0.listing_id, r0.city, r0.fold, r0.label, r0.price_eur, {filled} FROM r0 LEFT JOIN md ON md.city = r0.city
  {' '.join(f'LEFT JOIN mo_{c} ON mo_{c}.city = r0.city' for c in _CAT)}),
e AS MATERIALIZED ({entries}), s AS MATERIALIZED ({kinds}),
pairs AS MATERIALIZED (SELECT {key}, fold, a.f AS f, b.f AS g, sum(a.v * b.v) AS v FROM s JOIN e a USING (listing_id) JOIN e b USING (listing_id)
  WHERE fold <> -1 GROUP BY ALL),
ys AS MATERIALIZED (SELECT {key}, fold, f, sum(v * label) AS v FROM s JOIN e USING (listing_id) WHERE fold <> -1 GROUP BY ALL),
names AS MATERIALIZED (SELECT DISTINCT {key}, f FROM pairs), lo AS ({left_out}),
cells AS (SELECT n.city, n.segment_type, n.segment, left_out, n.f AS f, o.f AS g, coalesce(sum(p.v) FILTER (WHERE p.fold <> left_out), 0) AS v
  FROM names n JOIN names o ON n.city = o.city AND n.segment_type = o.segment_type AND n.segment = o.segment CROSS JOIN lo
  LEFT JOIN pairs p ON p.city = n.city AND p.segment_type = n.segment_type AND p.segment = n.segment AND p.f = n.f AND p.g = o.f GROUP BY ALL),
sides AS (SELECT {key}, left_out, f, coalesce(sum(v) FILTER (WHERE fold <> left_out), 0) AS v FROM ys CROSS JOIN lo GROUP BY ALL),
lines AS (SELECT {key}, left_out, f, list(v ORDER BY g) AS w FROM cells GROUP BY ALL),
grams AS (SELECT {key}, left_out, list(f ORDER BY f) AS fs, list(list_append(w, v) ORDER BY f) AS m FROM lines JOIN sides USING ({key}, left_out, f) GROUP BY ALL),
gj AS (
  SELECT {key}, left_out, penalty, fs, list_transform(m, lambda w, i: list_transform(w, lambda x, j: CASE WHEN i = j
      THEN x + penalty * greatest(x / m[1][1] - (m[1][i] / m[1][1]) * (m[1][i] / m[1][1]), 0) ELSE x END)) AS m,
    list_transform(m, lambda w, i: w[i] + penalty * greatest(w[i] / m[1][1] - (m[1][i] / m[1][1]) * (m[1][i] / m[1][1]), 0)) AS d, 1 AS k,
    []::BOOLEAN[] AS used
  FROM grams CROSS JOIN (VALUES {values}) p(penalty) WHERE m[1][1] > 0
  UNION ALL
  SELECT {key}, left_out, penalty, fs, CASE WHEN m[k][k] > {dbl(linear.DEPENDENT)} * d[k] THEN list_transform(m, lambda w, i: CASE WHEN i = k THEN w
      ELSE list_transform(w, lambda x, j: x - w[k] / m[k][k] * m[k][j]) END) ELSE m END, d, k + 1,
    list_append(used, m[k][k] > {dbl(linear.DEPENDENT)} * d[k])
  FROM gj WHERE k <= len(m)),
coefs AS MATERIALIZED (SELECT {key}, left_out, penalty, unnest(fs) AS f,
  unnest(list_transform(m, lambda w, i: CASE WHEN used[i] THEN w[len(w)] / w[i] ELSE 0 END)) AS c FROM gj WHERE k = len(m) + 1),
pred AS MATERIALIZED (SELECT {', '.join('s.' + c for c in key.split(', '))}, s.fold AS left_out, penalty, listing_id, any_value(price_eur) AS actual,
    greatest(exp(sum(v * c)) - 1, 0) AS predicted
  FROM s JOIN e USING (listing_id) JOIN coefs ON coefs.city = s.city AND coefs.segment_type = s.segment_type AND coefs.segment = s.segment
    AND coefs.left_out = s.fold AND coefs.f = e.f WHERE {used} GROUP BY ALL)"""


def _scores(by: str, digits: int | None, source: str = "pred") -> str:
    r = (lambda x: pround_sql(x, digits)) if digits is not None else (lambda x: x)
    return f"""SELECT {by}, count(*) AS test_rows, {r('sqrt(avg((actual - predicted) * (actual - predicted)))')} AS rmse_eur,
  {r('avg(abs(actual - predicted))')} AS mae_eur,
  {r('1.0 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(actual))')} AS r2 FROM {source} GROUP BY {by}"""


_MODEL = "CASE WHEN penalty = 0 THEN 'linear' ELSE 'ridge ' || regexp_replace(CAST(penalty AS VARCHAR), '\\.0$', '') END AS model"
_CV_SQL = _fits_sql([], True) + f""", pf AS ({_scores('city, segment_type, segment, penalty, left_out', None)}),
cv AS (SELECT city, segment_type, segment, penalty, {_MODEL}, count(*) AS folds, CAST(sum(test_rows) AS BIGINT) AS rows,
  {', '.join(f"{pround_sql(f'avg({c})', 4)} AS cv_{n}_mean, {pround_sql(f'stddev_samp({c})', 4)} AS cv_{n}_std"
             for c, n in (('rmse_eur', 'rmse'), ('mae_eur', 'mae'), ('r2', 'r2')))} FROM pf GROUP BY ALL)
"""


def _table(spark, sf_dir):
    return linear.model_table(fx.listings(spark, sf_dir), folds=FOLDS)


@register("ml4_linear_models_by_city", _fits_sql([], False) + f""", sc AS ({_scores('city, segment_type, segment, penalty', 4)})
SELECT *, {_MODEL} FROM sc""")
def linear_by_city(spark, sf_dir):
    """ML1+ML3+ML4+ML7: least squares and ridge per city on log price, one pass over the rows; EUR metrics on the test split."""
    return linear.test_scores(_table(spark, sf_dir))


@register("ml5_linear_cross_validation_by_city", _CV_SQL + "SELECT * FROM cv")
def cross_validation_by_city(spark, sf_dir):
    """ML5: 3-fold cross-validation of every penalty per city; each fold's matrix is the whole less its part."""
    return linear.cross_validated(_table(spark, sf_dir))


@register("ml6_ridge_search_by_city", _CV_SQL + """SELECT *, row_number() OVER o AS rank, row_number() OVER o = 1 AS is_best FROM cv
WINDOW o AS (PARTITION BY city, segment_type, segment ORDER BY cv_rmse_mean, penalty)""")
def ridge_search_by_city(spark, sf_dir):
    """ML6: penalties of each city ranked by cross-validated RMSE."""
    return linear.penalty_search(linear.cross_validated(_table(spark, sf_dir)))


def _report_sql(segment: str, min_rows: int, min_test: int) -> str:
    return _fits_sql([segment], False) + f""",
z AS (SELECT city, {segment} AS segment, count(*) AS rows, count(*) FILTER (WHERE fold = -1) AS n_test FROM r GROUP BY ALL),
own AS ({_scores('city, segment, penalty', 4, f"(SELECT * FROM pred WHERE segment_type = '{segment}')")}),
whole AS ({_scores('city, segment, penalty', 4, f"(SELECT p.city, r.{segment} AS segment, penalty, actual, predicted FROM pred p JOIN r USING (listing_id) WHERE segment_type = 'city')")}),
b1 AS (SELECT *, {_MODEL} FROM own QUALIFY row_number() OVER (PARTITION BY city, segment ORDER BY rmse_eur, mae_eur, penalty) = 1),
b2 AS (SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY city, segment ORDER BY rmse_eur, mae_eur, penalty) = 1),
j AS (SELECT z.city, z.segment, z.rows, z.n_test, z.rows >= {min_rows} AND z.n_test >= {min_test} AS ok, b1.model, b1.rmse_eur, b1.mae_eur, b1.r2,
    b2.rmse_eur AS city_rmse_eur, b2.mae_eur AS city_mae_eur
  FROM z LEFT JOIN b1 ON z.city = b1.city AND z.segment = b1.segment LEFT JOIN b2 ON z.city = b2.city AND z.segment = b2.segment)
SELECT city, segment AS {segment}, rows, n_test, CASE WHEN ok THEN 'Modelled' ELSE 'Skipped' END AS status,
  {', '.join(f'CASE WHEN ok THEN {c} END AS {c}' for c in ('model', 'rmse_eur', 'mae_eur', 'r2', 'city_rmse_eur', 'city_mae_eur'))},
  CASE WHEN ok THEN rmse_eur < city_rmse_eur END AS helped FROM j"""


@register("ml12_room_type_models", _report_sql("room_type", 600, 1))
def room_type_models(spark, sf_dir):
    """ML12: a model per city and room type with at least 600 rows, else "Skipped"; best penalty beside the city's own model."""
    return linear.segment_model_report(_table(spark, sf_dir), "room_type", 600)


@register("ml14_property_group_models", _report_sql("property_group", 300, 60))
def property_group_models(spark, sf_dir):
    """ML14+WN5+JN12: a model per city and property group with at least 300 rows and 60 test rows; did it help over the city's model."""
    return linear.segment_model_report(_table(spark, sf_dir), "property_group", 300, 60)
