"""Queries ED1-ED4 over ``survey_raw``."""

from __future__ import annotations

from .. import constants as K
from ..operators import profile as ED
from ..sources.fixtures import oracle_views, view
from .registry import register, rounded

WS = oracle_views("survey_raw")
COLS = [K.BASIC_TARGET_RAW] + K.BASIC_FEATURES
ALL = ["row_id"] + COLS


def _survey(spark, sf):
    return view(spark, sf, "survey_raw")


@register("head", WS + "SELECT * FROM survey_raw ORDER BY row_id LIMIT 5")
def head(spark, sf):
    return ED.head(_survey(spark, sf), 5, "row_id")


@register("info", WS + "\nUNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{'bigint' if c == 'row_id' else 'double'}' AS dtype, "
    f"count({c})::BIGINT AS non_null FROM survey_raw" for i, c in enumerate(ALL)))
def info(spark, sf):
    return ED.info(_survey(spark, sf))


def _r(x):
    return f"(round({x}, 6) + 0.0)"


@register("describe", WS + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c})::BIGINT AS count, {_r(f'avg({c})')} AS mean, "
    f"{_r(f'stddev_samp({c})')} AS std, {_r(f'min({c})')} AS min, "
    f"{_r(f'quantile_cont({c}, 0.25)')} AS q25, {_r(f'quantile_cont({c}, 0.5)')} AS q50, "
    f"{_r(f'quantile_cont({c}, 0.75)')} AS q75, {_r(f'max({c})')} AS max FROM survey_raw" for c in COLS))
def describe(spark, sf):
    return rounded(ED.describe(_survey(spark, sf), COLS))


def _corr_sql():
    parts = []
    for i, a in enumerate(COLS):
        for b in COLS[i + 1:]:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_r(f'corr({a}, {b})')} AS corr FROM survey_raw")
            parts.append(f"SELECT '{b}', '{a}', {_r(f'corr({a}, {b})')} FROM survey_raw")
        parts.append(f"SELECT '{a}', '{a}', CASE WHEN stddev_pop({a}) > 0 THEN 1.0 ELSE 'NaN'::DOUBLE END "
                     f"FROM survey_raw")
    return "\nUNION ALL ".join(parts)


@register("corr_matrix", WS + _corr_sql())
def corr_matrix(spark, sf):
    return rounded(ED.corr_matrix(_survey(spark, sf), COLS))
