"""Evaluation metrics (ME1-ME5), exact and distributed.

* ROC-AUC is exact (ties count half) and needs a running count of negatives
  below every score. The input is pre-aggregated per distinct score (map-side)
  into a table that is written once. Groups of a bounded number of distinct
  scores take one window each. Larger ones are cut into ranges of their own
  scores (from the least to the greatest), ranges that still hold too many
  once more, by their own extents; running sums are taken inside the ranges and
  offsets from the range totals. Everything is keyed by optional ``group_cols``
  (fold, feature, repeat) so many AUCs of very unequal size come out of one job.
* The classification report is built from the confusion cells (at most
  classes^2 rows) - no second pass over the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.sizing import broadcast_if_small


def accuracy(df: DataFrame, label: str = K.TARGET, prediction: str = "prediction",
             group_cols: Sequence[str] = ()) -> DataFrame:
    """ME1: share of rows with ``label == prediction``."""
    return df.groupBy(*group_cols).agg(
        F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


RANGES = 1024              # ranges of a group, and of a range that is cut again
DIRECT_ROWS = 1_000_000    # distinct scores of a group (or range) that one task sorts


def _cut(rows: DataFrame, keys: list[str], name: str, ranges: int, most: int) -> DataFrame:
    """``rows`` with a range number ``name`` per key: 0 where a key has at most
    ``most`` rows, else one of ``ranges`` equal steps between its extents."""
    ext = rows.groupBy(*keys).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"), F.count(F.lit(1)).alias("_c"))
    at = F.floor((F.col("_s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(ranges)).cast("int")
    cut = (F.col("_c") > most) & (F.col("_hi") > F.col("_lo"))
    return rows.join(broadcast_if_small(ext), on=keys).withColumn(
        name, F.when(cut, F.least(at, F.lit(ranges - 1))).otherwise(F.lit(0))).drop("_lo", "_hi", "_c")


def roc_auc(df: DataFrame, label: str = K.TARGET, score: str = "probability",
            group_cols: Sequence[str] = (), buckets: int | None = None, weight: str | None = None) -> DataFrame:
    """ME2: exact ROC-AUC per group (NULL when a group lacks a class).
    ``weight`` names a count of equal rows per row; ``buckets`` forces that many
    ranges per group (by default groups are cut only beyond ``DIRECT_ROWS``)."""
    from ..session import materialize

    g = list(group_cols)
    w = F.lit(1) if weight is None else F.col(weight)
    pos, neg = F.when(F.col(label) == 1, w).otherwise(0), F.when(F.col(label) == 1, 0).otherwise(w)
    per_score = (df.select(*g, F.col(score).cast("double").alias("_s"), pos.alias("_pos"), neg.alias("_neg"))
                 .groupBy(*g, "_s").agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n")))
    # read more than once below: computed once and read back from the shared folder
    per_score = materialize(per_score)
    largest = per_score.groupBy(*g).count().agg(F.max("count")).first()[0] or 0
    if buckets is None and largest <= DIRECT_ROWS:
        upto = F.sum("_n").over(W.partitionBy(*g).orderBy("_s").rowsBetween(W.unboundedPreceding, 0))
        return _area(per_score.withColumn("_below", upto - F.col("_n")), g)
    k = [*g, "_g"]
    most, ranges = (DIRECT_ROWS, RANGES) if buckets is None else (0, buckets)
    rows = _cut(per_score.withColumn("_g", F.lit(0)), k, "_b", ranges, most)
    rows = _cut(rows, [*k, "_b"], "_b2", ranges, most)
    parts = [*k, "_b", "_b2"]
    win = rows.withColumn("_upto", F.sum("_n").over(W.partitionBy(*parts).orderBy("_s").rowsBetween(W.unboundedPreceding, 0)))
    totals = win.groupBy(*parts).agg(F.max("_upto").alias("_all"))
    # over the range totals: at most RANGES squared rows per group
    outer = W.partitionBy(*k).orderBy("_b", "_b2").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_all").over(outer), F.lit(0))).drop("_all")
    joined = win.join(offsets, on=parts)
    return _area(joined.withColumn("_below", F.col("_off") + F.col("_upto") - F.col("_n")), g)


def _area(rows: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """AUC from per-score counts and the negatives ``_below`` each score."""
    return rows.groupBy(*group_cols).agg(
        F.try_divide(F.sum(F.col("_p") * (F.col("_below") + F.col("_n") * 0.5)),
                     F.sum("_p").cast("double") * F.sum("_n")).alias("roc_auc"))


def confusion(df: DataFrame, label: str = K.TARGET, prediction: str = "prediction",
              group_cols: Sequence[str] = ()) -> DataFrame:
    """ME4: one row per (label, prediction) cell present."""
    return df.groupBy(*group_cols, label, prediction).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str = K.TARGET,
                          prediction: str = "prediction") -> DataFrame:
    """ME3: precision, recall, F1 and support per class, then ``accuracy``
    (in the f1 column, support = n), ``macro avg`` and ``weighted avg``;
    zero division -> 0. Classes = union of labels and predictions."""
    cells = confusion(df, label, prediction)
    per = (cells.select(F.explode(F.array(
        F.struct(F.col(label).cast("string").alias("c"), F.col("n").alias("sup"),
                 F.lit(0).cast("long").alias("pred"),
                 F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col(prediction).cast("string").alias("c"), F.lit(0).cast("long").alias("sup"),
                 F.col("n").alias("pred"), F.lit(0).cast("long").alias("tp")))).alias("e"))
        .groupBy(F.col("e.c").alias("label"))
        .agg(F.sum("e.sup").alias("support"), F.sum("e.pred").alias("pred"), F.sum("e.tp").alias("tp")))
    prec = F.when(F.col("pred") > 0, F.col("tp") / F.col("pred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.withColumn("precision", prec).withColumn("recall", rec)
    per = per.withColumn("f1_score", F.when(F.col("precision") + F.col("recall") > 0,
                                            2 * F.col("precision") * F.col("recall")
                                            / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    row = F.struct("label", "precision", "recall", "f1_score", "support")
    # per-class rows and the three summary rows from ONE aggregation over the
    # (tiny) per-class table: one branch, one scan of the input
    tot = F.sum("support")
    nod = F.lit(None).cast("double")
    summary = F.array(
        F.struct(F.lit("accuracy").alias("label"), nod.alias("precision"), nod.alias("recall"),
                 (F.sum(F.col("support") * F.col("recall")) / tot).alias("f1_score"), tot.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                 F.avg("recall").alias("recall"), F.avg("f1_score").alias("f1_score"), tot.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"),
                 (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                 (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                 (F.sum(F.col("f1_score") * F.col("support")) / tot).alias("f1_score"), tot.alias("support")))
    return (per.agg(F.concat(F.collect_list(row), summary).alias("a"))
            .select(F.explode("a").alias("r")).select("r.*"))


def class_distribution(df: DataFrame, label: str = K.TARGET) -> DataFrame:
    """ME5: ``value_counts(normalize=True)``: share per class, descending;
    NULL labels excluded."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # a window over the per-class counts (one row per class), not over data
    everything = W.partitionBy()
    return (counts.withColumn("share", F.col("n") / F.sum("n").over(everything))
            .orderBy(F.desc("n"), label))
