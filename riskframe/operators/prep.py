"""Projection, casting and cleaning operators (PR1-PR9) and the two
preprocessing presets (survey / clinical).

All of these are projections (map-only, one whole-stage-codegen span). The
only actions are the fitted statistics of the imputation step, which also
decide the "no nulls left" assertion without another scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from .. import constants as K
from ..functions.exprs import col, nan_to_null
from . import impute as MV


class NullsRemainError(AssertionError):
    """Raised when a cleaned table still holds nulls (PR9)."""


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """PR1 / PR6 / PR7: drop the listed columns that exist."""
    return df.drop(*[c for c in cols if c in df.columns])


def convert_target(df: DataFrame, raw: str = K.BASIC_TARGET_RAW, target: str = K.TARGET) -> DataFrame:
    """PR2: ``target = int(raw)`` appended last, raw column dropped."""
    return df.withColumn(target, col(raw).cast("int")).drop(raw)


def binarize_target(df: DataFrame, raw: str = K.ADVANCED_TARGET_RAW, target: str = K.TARGET) -> DataFrame:
    """PR3: ``target = raw > 0`` as 0/1, NULL/NaN -> 0; appended last."""
    x = nan_to_null(col(raw).cast("double"))
    return df.withColumn(target, F.coalesce(x > 0, F.lit(False)).cast("int")).drop(raw)


def cast_types(df: DataFrame, int_cols: Sequence[str], double_cols: Sequence[str]) -> DataFrame:
    """PR4: integer columns truncate toward zero, others become double."""
    ints, dbls = set(int_cols), set(double_cols)
    return df.select(*[
        (col(c).cast("int").alias(c) if c in ints else
         col(c).cast("double").alias(c) if c in dbls else col(c))
        for c in df.columns])


def bool_text_map(df: DataFrame, cols: Sequence[str] = K.ADVANCED_BOOLEAN_COLS) -> DataFrame:
    """PR5: {True, 'TRUE'} -> 1, {False, 'FALSE'} -> 0, anything else NULL.

    Text is matched exactly ('true' -> NULL); boolean input is cast; numeric
    1/0 match as in a Python dict lookup."""
    out = []
    for f in df.schema.fields:
        c = f.name
        if c not in cols:
            out.append(col(c))
            continue
        x = col(c)
        if isinstance(f.dataType, BooleanType):
            e = x.cast("int")
        elif isinstance(f.dataType, StringType):
            e = F.when(x == "TRUE", 1).when(x == "FALSE", 0)
        elif isinstance(f.dataType, NumericType):
            e = F.when(x == 1, 1).when(x == 0, 0)
        else:
            e = F.lit(None)
        out.append(e.cast("int").alias(c))
    return df.select(*out)


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """PR8: reorder to the stored feature list, drop extras, missing -> 0.
    ``keep`` columns (keys, label) are carried in front."""
    present = set(df.columns)
    return df.select(*[col(k) for k in keep if k in present],
                     *[col(c) if c in present else F.lit(0).alias(c) for c in features])


def assert_no_nulls(null_counts: dict, fill: dict | None = None) -> None:
    """PR9 decided from fitted counts: a column keeps nulls when it had some
    and no (non-null) fill value covers it."""
    fill = fill or {}
    left = {c: n for c, n in null_counts.items() if n > 0 and fill.get(c) is None}
    if left:
        raise NullsRemainError(f"null values remain after cleaning: {left}")


def count_nulls(df: DataFrame, cols: Iterable[str] | None = None) -> dict:
    """Null count per column in one aggregation (PR9 as a standalone check)."""
    cols = list(cols) if cols is not None else df.columns
    row = df.agg(*[F.count_if(MV._missing(df, c)).alias(c) for c in cols]).first()
    return row.asDict()


# --------------------------------------------------------------------------
# presets
# --------------------------------------------------------------------------

def clean_survey(raw: DataFrame, key: str = "row_id", strict: bool = False) -> DataFrame:
    """Basic preprocessing: target -> int, binaries/ordinals -> int, numerics
    -> double, impute any nulls by type, then assert none remain.

    ``strict=True`` keeps the original order (cast first) and therefore
    refuses nulls in the target, binary and ordinal columns; the default
    imputes them first (see README, semantic notes)."""
    int_cols = [c for c in K.BASIC_BINARY_COLS + K.BASIC_ORDINAL_COLS if c in raw.columns]
    dbl_cols = [c for c in K.BASIC_NUMERIC_COLS if c in raw.columns]
    value_cols = [c for c in raw.columns if c not in (key, K.BASIC_TARGET_RAW)]
    # pass 1: null counts only (cheap); pass 2: statistics only for columns
    # that need them - usually none, so no median is computed at all
    counts = count_nulls(raw, [K.BASIC_TARGET_RAW] + value_cols)
    need = [c for c in value_cols if counts[c] > 0]
    policy = MV.type_policy(raw, need)
    if strict:
        policy = {c: p for c, p in policy.items() if c not in int_cols}
    fill = MV.fit_policy(raw, policy)["fill"] if policy else {}
    assert_no_nulls(counts, fill)
    df = MV.apply_fill(raw, fill)
    df = convert_target(df, K.BASIC_TARGET_RAW, K.TARGET)
    return cast_types(df, int_cols, dbl_cols)


def clean_clinical(raw: DataFrame, key: str | None = "id") -> DataFrame:
    """Advanced preprocessing: drop id/dataset (the key is kept when given),
    binarise ``num`` -> target, map TRUE/FALSE text, impute by the fixed
    policy (median / mode / 'unknown' / -1), assert no nulls remain."""
    drops = [c for c in K.ADVANCED_DROP_COLS if c != key]
    df = drop_columns(raw, drops)
    df = binarize_target(df, K.ADVANCED_TARGET_RAW, K.TARGET)
    df = bool_text_map(df, K.ADVANCED_BOOLEAN_COLS)
    checks = [c for c in df.columns if c != key]
    fitted = MV.fit_policy(df, MV.ADVANCED_POLICY, check_cols=checks)
    fill = {c: v for c, v in fitted["fill"].items() if fitted["nulls"].get(c, 0) > 0}
    assert_no_nulls(fitted["nulls"], fill)
    return MV.apply_fill(df, fill)
