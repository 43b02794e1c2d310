"""Exact order statistics and modes without value buffers.

``percentile``, ``median`` and ``mode`` keep all distinct values of a column
in one aggregation buffer. Here a wanted rank is found by narrowing: a pass
counts the values of ``BUCKETS`` ranges (a partial aggregation that sends at
most that many rows a task and window), prefix sums over the counts name the range
that holds the rank, and the next pass looks into that range only. The first pass
cuts on a logarithmic scale, so one far outlier does not put all others into
one range. Windows of few rows end with the counts of their values. So three
or four narrow scans settle a column of any size, exactly, for all columns and
ranks together.

Modes come from (column, value) counts with map-side combining, so a value that fills
a third of the rows is one row a task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.exprs import col

BUCKETS = 4096          # ranges of a window
FEW = 10_000            # rows of a window whose values are counted directly


@dataclass(frozen=True)
class Window:
    """Values of a column in which a wanted rank lies."""

    column: str
    lo: float
    hi: float
    before: int         # values below the window
    rows: int
    first: bool = True  # the whole column: infinite values included, logarithmic ranges


def present(df: DataFrame, c: str) -> Column:
    """The column without missing values (NULL, and NaN of floating columns)."""
    x = col(c)
    return F.when(~F.isnan(x), x) if isinstance(df.schema[c].dataType, (DoubleType, FloatType)) else x


def _inside(w: Window, x: Column) -> Column:
    return x.isNotNull() if w.first else (x >= F.lit(w.lo)) & (x <= F.lit(w.hi))


def _log(v: float) -> float:
    return math.copysign(math.log1p(abs(v)), v)


def _range_of(w: Window, x: Column) -> Column:
    """Number of the range of ``w`` that holds ``x``; grows with ``x``."""
    logarithmic = w.first and _log(w.lo) < _log(w.hi)
    to = (lambda v: F.signum(v) * F.log1p(F.abs(v))) if logarithmic else (lambda v: v)
    lo, hi = (_log(w.lo), _log(w.hi)) if logarithmic else (w.lo, w.hi)
    width = (hi - lo) / BUCKETS
    at = F.least(F.floor((to(x) - F.lit(lo)) / F.lit(width)).cast("double"), F.lit(BUCKETS - 1.0)) if width > 0 else F.lit(BUCKETS - 1.0)
    inner = F.when(x <= F.lit(w.lo), 0.0).when(x >= F.lit(w.hi), BUCKETS - 1.0).otherwise(F.greatest(at, F.lit(0.0)))
    return F.when(x == F.lit(-math.inf), -1).when(x == F.lit(math.inf), BUCKETS).otherwise(inner).cast("int")


def _counted(df: DataFrame, windows: Sequence[Window], key) -> DataFrame:
    """``(w, key, n, lo, hi)`` of every window's values, grouped by ``key``."""
    x = [present(df, w.column).cast("double") for w in windows]
    cells = F.array(*[F.struct(F.lit(i).alias("w"), F.when(_inside(w, v), key(w, v)).alias("key"), v.alias("x"))
                      for i, (w, v) in enumerate(zip(windows, x))])
    return df.select(F.explode(cells).alias("c")).select("c.*").filter("key is not null").groupBy("w", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def _holding(counted: DataFrame, wanted: Sequence[tuple[int, int]]) -> list:
    """For every wanted (window number, rank inside it) the row that holds the
    rank, with the number of values ``before`` it. Prefix sums run over the
    ranges of one window: at most ``BUCKETS`` + 2 or ``FEW`` rows each."""
    order = W.partitionBy("w").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = counted.withColumn("upto", F.sum("n").over(order)).withColumn("before", F.col("upto") - F.col("n"))
    # one row per column and wanted rank: a bound that does not depend on the data
    targets = df_of(counted, wanted)
    hit = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto"))
    return sums.join(F.broadcast(targets), "w").filter(hit).select("w", "rank", "before", "n", "lo", "hi").collect()


def df_of(like: DataFrame, rows: Sequence[tuple[int, int]]) -> DataFrame:
    return like.sparkSession.createDataFrame(list(rows), "w int, rank bigint")


def extents(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[int, float, float]]:
    """Count of present values and least and greatest finite value per column:
    one aggregation."""
    aggs = []
    for c in cols:
        x = present(df, c).cast("double")
        finite = F.when(F.abs(x) < F.lit(math.inf), x)
        aggs += [F.count(x).alias(f"n::{c}"), F.min(finite).alias(f"lo::{c}"), F.max(finite).alias(f"hi::{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"n::{c}"], row[f"lo::{c}"] or 0.0, row[f"hi::{c}"] or 0.0) for c in cols}


def values_at(df: DataFrame, ranks: Mapping[str, Sequence[int]],
              known: Mapping[str, tuple[int, float, float]] | None = None) -> dict[tuple[str, int], float]:
    """The values at the wanted ranks (from 0, ascending) of every column."""
    known = known or extents(df, list(ranks))
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], Window] = {}
    for c, wanted in ranks.items():
        n, lo, hi = known[c]
        open_.update({(c, r): Window(c, lo, hi, 0, n) for r in wanted})
    while open_:
        large = {t: w for t, w in open_.items() if w.rows > FEW}
        now = large or open_
        windows = list(dict.fromkeys(now.values()))
        number = {w: i for i, w in enumerate(windows)}
        targets = {(number[w], r - w.before): (c, r) for (c, r), w in now.items()}
        counted = _counted(df, windows, _range_of if large else lambda w, x: x)
        for row in _holding(counted, list(targets)):
            target = targets[row["w"], row["rank"]]
            w = open_.pop(target)
            if row["lo"] == row["hi"]:
                found[target] = row["lo"]
            else:
                open_[target] = Window(w.column, row["lo"], row["hi"], w.before + row["before"], row["n"], False)
    return found


def quantiles(df: DataFrame, probs: Mapping[str, Sequence[float]],
              known: Mapping[str, tuple[int, float, float]] | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation per column (None for a column
    without values)."""
    if not probs:
        return {}
    known = known or extents(df, list(probs))
    places = {c: [(known[c][0] - 1) * p for p in ps] for c, ps in probs.items() if known[c][0]}
    ranks = {c: sorted({r for h in hs for r in (math.floor(h), math.ceil(h))}) for c, hs in places.items()}
    at = values_at(df, ranks, known) if ranks else {}

    def between(c: str, h: float) -> float:
        lo, hi = math.floor(h), math.ceil(h)
        a, b = at[c, lo], at[c, hi]
        return a if lo == hi or a == b else (hi - h) * a + (h - lo) * b

    return {c: [between(c, h) for h in places[c]] if c in places else [None] * len(ps) for c, ps in probs.items()}


def medians(df: DataFrame, cols: Sequence[str], known=None) -> dict[str, float | None]:
    return {c: v[0] for c, v in quantiles(df, {c: [0.5] for c in cols}, known).items()}


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """The most frequent present value per column, ties to the smallest one
    (None for a column without values). One job for columns of all types: a
    value travels in the field of its type."""
    cols = list(cols)
    if not cols:
        return {}
    types = list(dict.fromkeys(df.schema[c].dataType.simpleString() for c in cols))

    def cell(i: int, c: str) -> Column:
        kind = df.schema[c].dataType.simpleString()
        return F.struct(F.lit(i).alias("i"), *[
            (present(df, c) if t == kind else F.lit(None).cast(t)).alias(f"v{j}") for j, t in enumerate(types)])

    fields = [f"v{j}" for j in range(len(types))]
    cells = df.select(F.explode(F.array(*[cell(i, c) for i, c in enumerate(cols)])).alias("c")).select("c.*")
    counts = cells.filter(" or ".join(f"{f} is not null" for f in fields)).groupBy("i", *fields).agg(
        F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("i").agg(F.min_by(F.struct(*fields), F.struct(-F.col("n"), *fields)).alias("b")).collect()
    out: dict[str, object] = {c: None for c in cols}
    for r in best:                                   # one row per column
        c = cols[r["i"]]
        out[c] = r["b"][types.index(df.schema[c].dataType.simpleString())]
    return out
