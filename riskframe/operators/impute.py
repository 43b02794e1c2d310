"""Missing-value profile and imputation (MV1-MV8).

Fitting reads back one value per column, like any fitted scaler: null counts
from one aggregation, exact medians (linear interpolation: the mean of the
two middle values for an even count, as pandas) by narrowing and modes from
value counts (``orderstats``; no buffer of values at any cardinality).
Transforming is then a pure projection, map-only. Modes break ties towards
the smallest value.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType

from .. import constants as K
from ..functions.exprs import col
from . import orderstats as OS


def _is_float(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (DoubleType, FloatType))


def _missing(df: DataFrame, c: str):
    """pandas ``isnull``: NULL, and NaN for floating columns."""
    x = col(c)
    return (x.isNull() | F.isnan(x)) if _is_float(df, c) else x.isNull()


def null_profile(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """MV1 + MV2: ``(column_name, null_count, null_pct)`` for every column,
    from one aggregation, unpivoted with a single explode. The percentage of
    an empty table is NULL."""
    cols = list(cols) if cols is not None else df.columns
    n = F.count(F.lit(1))
    aggs = [F.struct(F.lit(c).alias("column_name"),
                     F.count_if(_missing(df, c)).alias("null_count"),
                     F.try_divide(F.count_if(_missing(df, c)) * 100.0, n).alias("null_pct"))
            for c in cols]
    return (df.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("r"))
            .select("r.column_name", "r.null_count",
                    F.col("r.null_pct").cast("double").alias("null_pct")))


def fit_policy(df: DataFrame, policy: Mapping[str, object], check_cols: Iterable[str] = (),
               nulls: Mapping[str, int] | None = None) -> dict:
    """Fit an imputation policy.

    ``policy`` maps column -> ``"median"`` | ``"mode"`` | ``("const", value)``.
    Columns absent from ``df`` are skipped (the "existing columns only"
    rule). Returns ``{"fill": {col: value}, "nulls": {col: count}}`` where
    ``nulls`` covers the policy columns and ``check_cols``; pass known counts
    to save their aggregation. Statistics are fitted for every policy column,
    with or without nulls.
    """
    present = [c for c in policy if c in df.columns]
    checks = list(dict.fromkeys(present + [c for c in check_cols if c in df.columns]))
    if not checks:
        return {"fill": {}, "nulls": {}}
    if nulls is None:
        nulls = df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in checks]).first().asDict()
    fill: dict[str, object] = {c: how[1] for c, how in policy.items() if c in present and isinstance(how, tuple)}
    fill.update(OS.medians(df, [c for c in present if policy[c] == "median"]))
    fill.update(OS.modes(df, [c for c in present if policy[c] == "mode"]))
    return {"fill": {c: fill[c] for c in present}, "nulls": {c: int(nulls[c]) for c in checks}}


def apply_fill(df: DataFrame, fill: Mapping[str, object]) -> DataFrame:
    """Replace NULL (and NaN in floating columns) by the fitted literal; one
    projection, column order and types kept."""
    out = []
    for f in df.schema.fields:
        c = f.name
        if c in fill and fill[c] is not None:
            v = fill[c]
            lit = F.lit(v)
            if isinstance(f.dataType, NumericType) and not isinstance(v, str):
                lit = lit.cast(f.dataType)
            elif isinstance(f.dataType, StringType):
                lit = F.lit(str(v))
            out.append(F.when(_missing(df, c), lit).otherwise(col(c)).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def impute(df: DataFrame, policy: Mapping[str, object], nulls: Mapping[str, int] | None = None) -> DataFrame:
    """Fit + apply in one call (MV3-MV6, MV8)."""
    return apply_fill(df, fit_policy(df, policy, nulls=nulls)["fill"])


def type_policy(df: DataFrame, cols: Iterable[str] | None = None) -> dict:
    """MV7 dispatch on the schema: numeric -> median, anything else -> mode."""
    cols = list(cols) if cols is not None else df.columns
    return {c: ("median" if isinstance(df.schema[c].dataType, NumericType) else "mode")
            for c in cols}


ADVANCED_POLICY: dict[str, object] = {
    **{c: "median" for c in K.ADVANCED_MEDIAN_COLS},
    **{c: "mode" for c in K.ADVANCED_MODE_COLS},
    **{c: ("const", K.UNKNOWN_TEXT) for c in K.ADVANCED_UNKNOWN_COLS},
    **{c: ("const", K.MISSING_NUMBER) for c in K.ADVANCED_MINUS_ONE_COLS},
}


def impute_by_type(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """MV7: impute every column that has nulls (numeric median, else mode).

    Null counts for all columns first, then statistics only for the columns
    that need them (none -> the input is returned unchanged)."""
    cols = [c for c in df.columns if c not in set(exclude)]
    counts = df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in cols]).first().asDict()
    need = [c for c in cols if counts[c] > 0]
    if not need:
        return df
    return impute(df, type_policy(df, need), nulls=counts)
