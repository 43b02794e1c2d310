"""Exploratory profile (ED1-ED4): first rows, schema with non-null counts,
describe, and the Pearson correlation matrix.

Each profile is ONE aggregation over the table whose single wide result row
is unpivoted with one ``explode`` (no per-column jobs, no driver loop); the
quartiles of ``describe`` take a few narrowing scans for all columns together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.exprs import col
from . import orderstats as OS


def head(df: DataFrame, n: int = 5, key: str = "row_id") -> DataFrame:
    """ED1: the first ``n`` rows by key (a top-n, planned as TakeOrdered)."""
    return df.orderBy(col(key)).limit(n)


def info(df: DataFrame) -> DataFrame:
    """ED2: ``(position, column_name, dtype, non_null)`` for every column."""
    items = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                      F.lit(f.dataType.simpleString()).alias("dtype"),
                      F.count(col(f.name)).alias("non_null"))
             for i, f in enumerate(df.schema.fields)]
    return df.agg(F.array(*items).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in set(exclude)]


QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """ED3: count, mean, sample std, min, quartiles (exact, linear
    interpolation) and max per numeric column. NaN counts as missing. The
    quartiles are found by narrowing (``orderstats``): one value per column and
    quartile reaches the driver, and no task holds a column's values."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    known = OS.extents(df, cols)
    found = OS.quantiles(df, {c: QUARTILES for c in cols}, known)
    items = []
    for c in cols:
        x = OS.present(df, c).cast("double")
        items.append(F.struct(
            F.lit(c).alias("column_name"), F.count(x).alias("count"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
            *[F.lit(v).cast("double").alias(q) for q, v in zip(("q25", "q50", "q75"), found[c])],
            F.max(x).alias("max")))
    return df.agg(F.array(*items).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """ED4: Pearson correlation for every ordered pair ``(col_a, col_b)``.

    Without nulls in the columns (checked first, one small aggregation) the
    whole matrix comes from one ``treeAggregate`` of the Gramian
    (``pyspark.ml.stat.Correlation``). With nulls, pairs are computed
    pairwise-complete (``corr`` per pair, each unordered pair once). The
    diagonal is 1 (NaN for a constant column)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    # one pass: null counts and population std (for the diagonal)
    first = df.agg(*[F.count_if(col(c).isNull() | F.isnan(col(c).cast("double"))).alias(f"n::{c}")
                     for c in cols],
                   *[F.stddev_pop(col(c).cast("double")).alias(f"s::{c}") for c in cols]).first()
    if all(first[f"n::{c}"] == 0 for c in cols):
        return _corr_dense(df, cols, {c: first[f"s::{c}"] for c in cols})
    return _corr_pairwise(df, cols)


def _corr_dense(df: DataFrame, cols: Sequence[str], sd: dict) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    vec = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(
        df.select(*[col(c).cast("double").alias(c) for c in cols]))
    m = Correlation.corr(vec, "_v", "pearson").first()[0].toArray()
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                v = 1.0 if (sd[a] or 0.0) > 0 else float("nan")
            else:
                v = float(m[i, j])
            rows.append((a, b, v))
    # p x p statistics (model-sized, not data-sized)
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


def _corr_pairwise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    items = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            r = F.corr(col(a).cast("double"), col(b).cast("double"))
            items.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r.alias("corr")))
            items.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), r.alias("corr")))
        sd = F.stddev_pop(col(a).cast("double"))
        items.append(F.struct(F.lit(a).alias("col_a"), F.lit(a).alias("col_b"),
                              F.when(sd > 0, F.lit(1.0)).otherwise(F.lit(float("nan"))).alias("corr")))
    return df.agg(F.array(*items).alias("a")).select(F.explode("a").alias("r")).select("r.*")
