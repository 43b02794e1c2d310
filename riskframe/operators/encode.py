"""Encoding and scaling (EN1-EN5).

* One-hot with drop-first: the vocabulary of each column is a distributed
  ``distinct`` read back with a limit (capped by ``MAX_ONEHOT_WIDTH``), and
  the transform is one ``(c == v)`` comparison per kept value - a plain
  projection, no join. Unlike ML ``OneHotEncoder`` this keeps named 0/1
  columns, sorts categories, drops the FIRST one and maps NULL to all zeros.
* Standardisation uses the population standard deviation with a zero
  deviation replaced by 1 (ML ``StandardScaler`` uses the sample deviation
  and outputs 0 for constant columns). Stats are fitted in one aggregation
  and applied as literals; the stats table can be stored and re-applied
  without refitting (serving).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import col
from . import orderstats as OS


class VocabularyTooWide(ValueError):
    """A categorical column has more distinct values than allowed."""


def fit_vocabulary(df: DataFrame, cols: Sequence[str],
                   max_width: int = K.MAX_ONEHOT_WIDTH) -> dict[str, list]:
    """Sorted distinct non-null values per column.

    A distributed ``distinct`` (partial aggregation) read back with a
    bounded ``limit``: an unexpectedly wide column fails fast instead of
    building huge sets in a task or on the driver. String columns share ONE
    job (``fit_vocabularies_one_pass``); other types keep their own typed job."""
    from pyspark.sql.types import StringType

    cols = [c for c in cols if c in df.columns]
    text = [c for c in cols if isinstance(df.schema[c].dataType, StringType)]
    vocab = fit_vocabularies_one_pass(df, text, max_width) if text else {}
    for c in [c for c in cols if c not in vocab]:
        rows = df.select(col(c)).where(col(c).isNotNull()).distinct().limit(max_width + 1).collect()
        if len(rows) > max_width:
            raise VocabularyTooWide(f"{c}: more than {max_width} categories")
        vocab[c] = sorted(r[0] for r in rows)
    return {c: vocab[c] for c in cols}


def dummy_names(vocab: Mapping[str, Sequence], drop_first: bool = True) -> list[str]:
    names = []
    for c, values in vocab.items():
        kept = list(values)[1:] if drop_first else list(values)
        names.extend(f"{c}_{v}" for v in kept)
    return names


def onehot(df: DataFrame, vocab: Mapping[str, Sequence], drop_first: bool = True) -> DataFrame:
    """EN1 transform: drop the encoded columns, append ``col_value`` 0/1
    columns after the others, in vocabulary column order. NULL or unseen
    values give all zeros."""
    keep = [col(c) for c in df.columns if c not in vocab]
    dummies = []
    for c, values in vocab.items():
        kept = list(values)[1:] if drop_first else list(values)
        for v in kept:
            dummies.append(F.coalesce(col(c) == F.lit(v), F.lit(False)).cast("int")
                           .alias(f"{c}_{v}"))
    return df.select(*keep, *dummies)


def vocabulary_table(spark: SparkSession, vocab: Mapping[str, Sequence]) -> DataFrame:
    """The fitted vocabulary as a stored table ``(column_name, position, value)``."""
    rows = [(c, i, str(v)) for c, values in vocab.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "column_name string, position int, value string")


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """EN2: ``{col: (mean, std_pop or 1.0)}`` from one aggregation."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return {}
    aggs = []
    for c in cols:
        x = col(c).cast("double")
        aggs += [F.avg(x).alias(f"m::{c}"), F.stddev_pop(x).alias(f"s::{c}")]
    row = df.agg(*aggs).first().asDict()
    out = {}
    for c in cols:
        s = row[f"s::{c}"]
        out[c] = (row[f"m::{c}"], 1.0 if (s is None or s == 0.0) else s)
    return out


def scaler_table(spark: SparkSession, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    """The fitted scaler as a stats table ``(column_name, mean, std)``."""
    return spark.createDataFrame([(c, float(m), float(s)) for c, (m, s) in stats.items()],
                                 "column_name string, mean double, std double")


def scaler_from_table(table: DataFrame) -> dict[str, tuple[float, float]]:
    """Read a stored scaler back (one row per column)."""
    return {r["column_name"]: (r["mean"], r["std"]) for r in table.collect()}


def scale(df: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    """EN3: ``(x - mean) / std`` with stored stats, in place, one projection."""
    return df.select(*[
        ((col(c).cast("double") - F.lit(stats[c][0])) / F.lit(stats[c][1])).alias(c)
        if c in stats else col(c) for c in df.columns])


def fit_scaler_stats_df(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """EN2 as a lazy stats DataFrame ``(column_name, mean, std)`` (one
    aggregation, unpivoted by one explode) for storage or inspection."""
    cols = [c for c in cols if c in df.columns]
    parts = []
    for c in cols:
        x = col(c).cast("double")
        s = F.stddev_pop(x)
        parts.append(F.struct(F.lit(c).alias("column_name"), F.avg(x).alias("mean"),
                              F.when(s == 0, F.lit(1.0)).otherwise(s).alias("std")))
    return (df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("r"))
            .select("r.column_name", "r.mean", "r.std"))


# --------------------------------------------------------------------------
# feature builds (EN4, EN5)
# --------------------------------------------------------------------------

def build_basic(clean: DataFrame, key: str = "row_id", fit_on: DataFrame | None = None):
    """EN4 (basic): scale the numeric/ordinal columns; binaries untouched.

    Returns ``(features_df, scaler_stats, feature_list)``. ``fit_on``
    defaults to the whole table (the reference fits before the split);
    pass the training part to avoid leakage."""
    stats = fit_scaler(fit_on if fit_on is not None else clean, K.BASIC_SCALE_COLS)
    out = scale(clean, stats)
    features = [c for c in out.columns if c not in (key, K.TARGET)]
    return out, stats, features


def build_advanced(clean: DataFrame, key: str = "id", fit_on: DataFrame | None = None,
                   vocab: Mapping[str, Sequence] | None = None):
    """EN4 (advanced): drop low-importance columns, one-hot sex/cp/thal
    (drop first), scale the numeric columns.

    Returns ``(features_df, scaler_stats, vocab, feature_list)``."""
    from .prep import drop_columns

    df = drop_columns(clean, K.ADVANCED_LOW_IMPORTANCE_COLS)
    src = drop_columns(fit_on, K.ADVANCED_LOW_IMPORTANCE_COLS) if fit_on is not None else df
    vocab = dict(vocab) if vocab is not None else fit_vocabulary(src, K.ADVANCED_CATEGORICAL_COLS)
    df = onehot(df, vocab)
    stats = fit_scaler(onehot(src, vocab) if fit_on is not None else df, K.ADVANCED_NUMERIC_COLS)
    df = scale(df, stats)
    features = [c for c in df.columns if c not in (key, K.TARGET)]
    return df, stats, vocab, features


def build_variant(clean: DataFrame, drop_cols: Sequence[str] = (), key: str = "id"):
    """EN5: experiment build with optional raw-column drops; encodes the
    experiment's 5 categorical columns and scales its 6 numeric ones."""
    from .prep import drop_columns

    df = drop_columns(clean, drop_cols)
    vocab = fit_vocabulary(df, K.EXPERIMENT_CATEGORICAL_COLS)
    df = onehot(df, vocab)
    stats = fit_scaler(df, K.EXPERIMENT_NUMERIC_COLS)
    df = scale(df, stats)
    features = [c for c in df.columns if c not in (key, K.TARGET)]
    return df, features


def prepare_basic(raw: DataFrame, key: str = "row_id"):
    """Clean + EN4 (basic) with the fits fused into ONE aggregation.

    Null counts of every column and mean / population std of the scaled
    columns (over the int-cast values the cleaner produces) come from the
    same pass. The cleaned table differs from the raw one only where values
    were imputed, so these statistics are final unless a scaled column had
    nulls - only then is that column refitted after imputation. Common case:
    two scans of the input (fit, transform) instead of three. NaN counts as
    missing, also in coded columns.

    Returns ``(features_df, scaler_stats, feature_list)``."""
    out, stats, _, features = fit_basic(raw, key)
    return out, stats, features


def fit_basic(raw: DataFrame, key: str = "row_id", complete: bool = False):
    """``prepare_basic`` with the fitted fills: ``(features_df, scaler_stats,
    fill, feature_list)``; ``apply_basic`` needs the middle two. ``complete``
    fits fills for columns without nulls too."""
    from . import impute as MV
    from .prep import assert_no_nulls

    ints = set(K.BASIC_BINARY_COLS + K.BASIC_ORDINAL_COLS)
    value_cols = [c for c in raw.columns if c not in (key, K.BASIC_TARGET_RAW)]
    scale_cols = [c for c in K.BASIC_SCALE_COLS if c in raw.columns]
    aggs = [F.count_if(MV._missing(raw, c)).alias(f"n::{c}") for c in [K.BASIC_TARGET_RAW] + value_cols]
    for c in scale_cols:
        x = OS.present(raw, c)
        x = (x.cast("int") if c in ints else x).cast("double")
        aggs += [F.avg(x).alias(f"m::{c}"), F.stddev_pop(x).alias(f"s::{c}")]
    row = raw.agg(*aggs).first().asDict()
    counts = {c: row[f"n::{c}"] for c in [K.BASIC_TARGET_RAW] + value_cols}
    need = [c for c in value_cols if complete or counts[c] > 0]
    fill = MV.fit_policy(raw, MV.type_policy(raw, need), nulls=counts)["fill"] if need else {}
    assert_no_nulls(counts, fill)
    stats = {}
    for c in scale_cols:
        s = row[f"s::{c}"]
        stats[c] = (row[f"m::{c}"], 1.0 if (s is None or s == 0.0) else s)
    refit = [c for c in scale_cols if counts[c] > 0]
    if refit:
        stats.update(fit_scaler(clean_basic(raw, fill), refit))
    out = scale(clean_basic(raw, fill), stats)
    features = [c for c in out.columns if c not in (key, K.TARGET)]
    return out, stats, fill, features


def clean_basic(raw: DataFrame, fill: Mapping[str, object]) -> DataFrame:
    """Fills, target and types of the survey table, as fitted."""
    from . import impute as MV
    from .prep import cast_types, convert_target

    filled = MV.apply_fill(raw, fill)
    if K.BASIC_TARGET_RAW in raw.columns:
        filled = convert_target(filled, K.BASIC_TARGET_RAW, K.TARGET)
    return cast_types(filled, [c for c in K.BASIC_BINARY_COLS + K.BASIC_ORDINAL_COLS if c in raw.columns],
                      [c for c in K.BASIC_NUMERIC_COLS if c in raw.columns])


def apply_basic(raw: DataFrame, stats: Mapping, fill: Mapping[str, object]) -> DataFrame:
    """EN4 (basic) with stored artefacts: one projection, nothing is fitted.
    The target may be absent."""
    return scale(clean_basic(raw, fill), stats)


def fit_vocabularies_one_pass(df: DataFrame, cols: Sequence[str],
                              max_width: int = K.MAX_ONEHOT_WIDTH) -> dict[str, list]:
    """Vocabularies of several string columns from ONE distributed
    ``distinct`` over (column, value) pairs, read back with a bounded limit."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return {}
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), col(c).cast("string").alias("v")) for i, c in enumerate(cols)])).alias("p"))
    rows = (pairs.where(F.col("p.v").isNotNull()).select("p.i", "p.v").distinct()
            .limit(len(cols) * (max_width + 1)).collect())
    vocab: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        vocab[cols[r["i"]]].append(r["v"])
    for c, values in vocab.items():
        if len(values) > max_width:
            raise VocabularyTooWide(f"{c}: more than {max_width} categories")
        vocab[c] = sorted(values)
    return vocab


def _combine_fill(n1: int, mean1, var1, k: int, value) -> tuple[float, float]:
    """Mean and population std after adding ``k`` copies of ``value`` to a
    sample (n1, mean1, var_pop1) - the pairwise (Chan) combination, exact in
    real arithmetic and numerically stable."""
    if n1 == 0:
        return float(value), 0.0
    if k == 0 or value is None:
        return float(mean1), float(var1) ** 0.5
    n = n1 + k
    delta = float(value) - float(mean1)
    mean = float(mean1) + delta * k / n
    m2 = float(var1) * n1 + delta * delta * n1 * k / n
    return mean, (m2 / n) ** 0.5


def prepare_advanced(raw: DataFrame, key: str = "id"):
    """Clean + EN4 (advanced); every fit reads back one value per column.

    One aggregation gives null counts and count / mean / population variance of
    the non-null numeric columns; the scaler statistics after imputation
    follow exactly from those moments and the fill values (no pass over imputed
    data). Medians and modes are fitted for the columns that have nulls
    (``orderstats``), the vocabularies of the categorical columns (constant
    fills applied) come from one ``distinct``. The transform is one
    projection. Returns ``(features_df, scaler_stats, vocab, feature_list)``."""
    out, stats, vocab, _, features = fit_advanced(raw, key)
    return out, stats, vocab, features


def _mapped_advanced(raw: DataFrame, key: str) -> DataFrame:
    from .prep import binarize_target, bool_text_map, drop_columns

    df = drop_columns(raw, [c for c in K.ADVANCED_DROP_COLS if c != key])
    if K.ADVANCED_TARGET_RAW in df.columns:
        df = binarize_target(df, K.ADVANCED_TARGET_RAW, K.TARGET)
    return bool_text_map(df, K.ADVANCED_BOOLEAN_COLS)


def fit_advanced(raw: DataFrame, key: str = "id", complete: bool = False):
    """``prepare_advanced`` with the fitted fills: ``(features_df,
    scaler_stats, vocab, fill, feature_list)``. ``complete`` fits fills for
    columns without nulls too."""
    from . import impute as MV
    from .prep import assert_no_nulls

    df = _mapped_advanced(raw, key)
    checks = [c for c in df.columns if c != key]
    policy = {c: p for c, p in MV.ADVANCED_POLICY.items() if c in df.columns}
    numeric = [c for c in K.ADVANCED_NUMERIC_COLS if c in df.columns]
    aggs = [F.count_if(MV._missing(df, c)).alias(f"n::{c}") for c in checks]
    for c in numeric:
        x = OS.present(df, c).cast("double")
        aggs += [F.count(x).alias(f"c::{c}"), F.avg(x).alias(f"m::{c}"), F.var_pop(x).alias(f"v::{c}")]
    row = df.agg(*aggs).first().asDict()
    nulls = {c: row[f"n::{c}"] for c in checks}
    need = {c: how for c, how in policy.items() if complete or nulls.get(c, 0) > 0}
    fill = MV.fit_policy(df, need, nulls=nulls)["fill"]
    assert_no_nulls(nulls, fill)
    stats = {}
    for c in numeric:
        mean, std = _combine_fill(row[f"c::{c}"], row[f"m::{c}"], row[f"v::{c}"], nulls.get(c, 0), fill.get(c))
        stats[c] = (mean, 1.0 if std == 0.0 else std)
    from .prep import drop_columns

    reduced = drop_columns(MV.apply_fill(df, fill), K.ADVANCED_LOW_IMPORTANCE_COLS)
    vocab = fit_vocabularies_one_pass(reduced, K.ADVANCED_CATEGORICAL_COLS)
    out = scale(onehot(reduced, vocab), stats)
    features = [c for c in out.columns if c not in (key, K.TARGET)]
    return out, stats, vocab, fill, features


def apply_advanced(raw: DataFrame, stats: Mapping, vocab: Mapping[str, Sequence], fill: Mapping[str, object],
                   key: str = "id") -> DataFrame:
    """EN4 (advanced) with stored artefacts: one projection, nothing is
    fitted. The target may be absent; a null in a column without a stored
    fill stays null."""
    from . import impute as MV
    from .prep import drop_columns

    reduced = drop_columns(MV.apply_fill(_mapped_advanced(raw, key), fill), K.ADVANCED_LOW_IMPORTANCE_COLS)
    return scale(onehot(reduced, vocab), stats)
