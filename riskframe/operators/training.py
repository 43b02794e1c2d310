"""Training, cross-validation, importance and the feature-selection
experiment (ML1-ML4, ML6, ME6-ME12, SP4).

Models are Spark ML estimators (distributed fits). Driver loops run over
folds / variants (a handful of distributed fits), never over rows. Scores
of all folds, repeats and features are evaluated by ONE grouped AUC job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import col
from ..functions.sizing import broadcast_if_small, dealt, spread
from . import forest as FR
from . import metrics as ME
from .models import assemble, build_model
from .split import HASH_PRIME, dense_rank, fold_exact, split_flag_exact, with_class_weight


def fit(df: DataFrame, features: Sequence[str], model_type: str = "random_forest",
        params: Mapping[str, object] | None = None, label: str = K.TARGET, seed: int = K.RANDOM_STATE):
    """ML1/ML2: fit a registered model; ``class_weight='balanced'`` adds the
    per-class weight column (SP3) first."""
    params = dict(params or {})
    balanced = params.get("class_weight") == "balanced"
    if model_type == "random_forest":
        est = build_model(model_type, params, label_col=label, weight_col="weight" if balanced else None, seed=seed)
        if {p.name for p in est._paramMap} <= FR.PARAMS | {"featuresCol", "labelCol", "weightCol"} and (
                est.getFeatureSubsetStrategy() == "sqrt") and df.count() > FR.LARGE_ROWS:
            return FR.fit_forest(est, df, features, label, balanced)
    data = with_class_weight(df, label, "weight") if balanced else df
    if model_type == "logistic_regression" and not params.get("n_rows"):
        # scikit-learn's C scales a SUM of losses, Spark's regParam a MEAN:
        # regParam = 1 / (C * n) needs the training row count
        params["n_rows"] = data.count()
    est = build_model(model_type, params, label_col=label, weight_col="weight" if balanced else None,
                      seed=seed)
    if model_type != "random_forest":
        return est.fit(spread(assemble(data, features)))
    slim = data.select(*[col(c) for c in dict.fromkeys([*features, label, *(["weight"] if balanced else [])])])
    return est.fit(assemble(dealt(slim, df.count()), features))


FIT_ROWS = 1_000_000       # rows of all fits that run at once


def fits_at_once(rows: int, most: int) -> int:
    """Small fits wait for their passes and run side by side; a large one fills
    the cluster alone, and only its own rows are cached."""
    return max(1, min(most, FIT_ROWS // max(rows, 1)))


def predict(model, df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """ML5: keep columns + ``prediction`` (argmax) + ``probability``."""
    from .models import score
    return score(model, df, features, keep)


def cv_scores(df: DataFrame, features: Sequence[str], model_type: str = "random_forest",
              params: Mapping[str, object] | None = None, k: int = K.CV_FOLDS, key: str = "row_id",
              label: str = K.TARGET, seed: int = K.RANDOM_STATE, parallelism: int = 4) -> DataFrame:
    """ML4: stratified k-fold ROC-AUC ``(fold, roc_auc)``.
    k distributed fits; all held-out predictions are scored in one grouped
    AUC job. The folded table is written once, not recomputed by every fit."""
    from concurrent.futures import ThreadPoolExecutor

    data = reliable(fold_exact(df, key, label, k, seed, "_fold"))

    def one(f):
        model = fit(data.filter(F.col("_fold") != f), features, model_type, params, label, seed)
        held = predict(model, data.filter(F.col("_fold") == f), features, keep=[label])
        return held.withColumn("fold", F.lit(f))
    # folds are independent distributed fits: submit them as concurrent jobs
    with ThreadPoolExecutor(max_workers=fits_at_once(data.count(), min(k, parallelism))) as pool:
        parts = list(pool.map(one, range(k)))
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    return ME.roc_auc(allp, label, "probability", group_cols=["fold"])


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population std of fold scores."""
    return scores.agg(F.avg("roc_auc").alias("cv_auc_mean"), F.stddev_pop("roc_auc").alias("cv_auc_std"))


def feature_importances(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """ME6: impurity importance ``(feature, importance)``, descending. The
    vector has one entry per feature (model metadata, not data)."""
    imp = model.featureImportances.toArray().tolist()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def top_n(importances: DataFrame, n: int = 10, value: str = "importance") -> DataFrame:
    """ME8: the n largest entries (TakeOrdered)."""
    return importances.orderBy(F.desc(value), "feature").limit(n)


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two single-row results side by side (constant key; both sides
    are one row by construction)."""
    return a.withColumn("_k", F.lit(1)).join(F.broadcast(b.withColumn("_k", F.lit(1))), "_k").drop("_k")


def importance_maps(gini: DataFrame, perm: DataFrame) -> DataFrame:
    """ME9: one row with two ``map<feature, value>`` columns."""
    g = gini.agg(F.map_from_entries(F.collect_list(F.struct("feature", "importance"))).alias("gini_importance"))
    p = perm.agg(F.map_from_entries(F.collect_list(F.struct("feature", "importance_mean")))
                 .alias("permutation_importance"))
    return _one_row_join(g, p)


# --------------------------------------------------------------------------
# dense index and permutations (SP4)
# --------------------------------------------------------------------------

def reliable(df: DataFrame) -> DataFrame:
    """Materialise to the shared checkpoint folder so ids assigned below stay
    stable even when executors are lost and tasks re-run."""
    from ..session import materialize
    return materialize(df)


ROUNDS = 24        # of the swap-or-not shuffle


def _constants(seed: int, step: int) -> tuple[int, int]:
    return (seed * 31337 + step * 7919 + 1) % HASH_PRIME, (seed * 69621 + step * 104729 + 13) % HASH_PRIME


def _residue(x, a, b):
    """Integer mixing modulo a prime, of whole numbers or columns."""
    y = (x % HASH_PRIME * 48271 + a) % HASH_PRIME
    return (y * y % HASH_PRIME + x % HASH_PRIME * 16807 + b) % HASH_PRIME


def _residue_sql(x: str, a: int, b: int) -> str:
    y = f"(({x}) % {HASH_PRIME} * 48271 + {a}) % {HASH_PRIME}"
    return f"((({y}) * ({y}) % {HASH_PRIME} + ({x}) % {HASH_PRIME} * 16807 + {b}) % {HASH_PRIME})"


def permuted(df: DataFrame, n: int, repeats: int, seed: int = K.RANDOM_STATE, idx: str = "_i",
             repeat: str = "repeat", name: str = "donor") -> DataFrame:
    """SP4: a seeded bijection of [0, n) for every repeat, as a column.

    Swap-or-not: in each round x is paired with (k - x) mod n, and one bit
    that both of a pair share decides whether they change places. Every round
    is its own inverse, so the result is a permutation for any n, without a sort,
    a shuffle or cycle walking; whole numbers only, so any SQL engine repeats it.
    The rounds run over Arrow batches (as one expression each row would walk
    an interpreted loop, some hundred times slower)."""
    keys = np.array([[_residue(i, *_constants(seed, 2 * r)) % n for r in range(ROUNDS)] for i in range(repeats)], np.int64)
    constants = [_constants(seed, 2 * r + 1) for r in range(ROUNDS)]

    def swap(index, times):
        x, times = index.to_numpy(np.int64), times.to_numpy(np.int64)
        for r, (a, b) in enumerate(constants):
            y = (keys[times, r] + n - x) % n
            bit = (_residue(np.maximum(x, y) + times * 1_000_003, a, b) >> 15) & 1
            x = np.where(bit == 1, y, x)
        return pd.Series(x)

    return df.withColumn(name, F.pandas_udf(swap, "long", F.PandasUDFType.SCALAR)(col(idx), col(repeat)))


def permuted_sql(source: str, n: str, seed: int = K.RANDOM_STATE, prefix: str = "pm") -> str:
    """``permuted`` as a chain of common table expressions over ``source``
    (columns i and repeat); the last one is ``{prefix}{ROUNDS}`` with x as donor."""
    parts = [f"{prefix}0 AS (SELECT *, i AS x FROM {source})"]
    for r in range(ROUNDS):
        y = f"({_residue_sql('repeat', *_constants(seed, 2 * r))} % {n} + {n} - x) % {n}"
        bit = f"(({_residue_sql('greatest(x, y) + repeat * 1000003', *_constants(seed, 2 * r + 1))}) >> 15) & 1"
        parts.append(f"{prefix}{r + 1} AS (SELECT * EXCLUDE (x, y), CASE WHEN {bit} = 1 THEN y ELSE x END AS x "
                     f"FROM (SELECT *, {y} AS y FROM {prefix}{r}))")
    return ",\n".join(parts)


def permutation_donors(indexed: DataFrame, repeats: int, seed: int = K.RANDOM_STATE,
                       idx: str = "_i", n: int | None = None) -> DataFrame:
    """Rows ``(repeat, _tgt, donor)``: one permutation of [0, n) per repeat."""
    n = indexed.count() if n is None else n
    each = indexed.select(col(idx).alias("_tgt")).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return permuted(each, n, repeats, seed, "_tgt").select("repeat", "_tgt", "donor")


def permutation_importance(model, test: DataFrame, features: Sequence[str], label: str = K.TARGET,
                           repeats: int = K.PERMUTATION_REPEATS, seed: int = K.RANDOM_STATE,
                           key: str = "row_id", known_n: int | None = None) -> DataFrame:
    """ME7: ROC-AUC drop when one feature is replaced by its values under a
    random permutation; ``(feature, importance_mean, importance_std)``
    (population std), descending. ``model`` is a fitted Spark ML classifier or a
    ``LinearScorer``.

    Rows get dense numbers from their keys, a repeat's donors follow from the
    numbers alone, and one equi-join brings the donors' values. The variants of
    a row are scored where they are made (a linear scorer without unpacking
    the row, a forest over Arrow batches and only where the donor's value lies
    beyond one of its thresholds), and ONE grouped AUC job evaluates all."""
    from .models import LinearScorer

    idx = spread(reliable(dense_rank(test.select(*dict.fromkeys([key, *features, label])), key, seed)))
    if not isinstance(model, LinearScorer):
        # dealt before it is scored: a forest costs much a row
        idx = reliable(predict(model, idx, features, keep=["_i", label]).select(
            "_i", col(label), *[col(f) for f in features], F.col("probability").alias("_score")))
    n = idx.count() if known_n is None else known_n
    if n == 0:
        return test.sparkSession.createDataFrame([], "feature string, importance_mean double, importance_std double")
    each = idx.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    donors = idx.select(col("_i").alias("donor"), *[col(f).alias(f"_d_{j}") for j, f in enumerate(features)])
    perm = permuted(each, n, repeats, seed).join(broadcast_if_small(donors), "donor")
    if isinstance(model, LinearScorer):
        used = [(j, f) for j, f in enumerate(features) if f in model.features]
        scores = F.explode(F.array(*[F.struct(F.lit(j).alias("_j"), model.logit({f: F.col(f"_d_{j}")}).alias("_score"))
                                     for j, f in used]))
        scored = perm.select("repeat", col(label), scores.alias("_v")).select("repeat", label, "_v.*")
        base = idx.select(col(label), model.logit().alias("_score"))
    elif FR.is_forest(model):
        used = list(enumerate(features))
        scored = FR.variant_scores(model, perm, features, label)
        base = idx.select(col(label), "_score")
    else:
        used = list(enumerate(features))
        variants = F.explode(F.array(*[
            F.struct(F.lit(j).alias("_j"), *[(F.col(f"_d_{j}") if g == f else col(g)).alias(g) for g in features])
            for j, f in used]))
        rows = perm.select("repeat", col(label), variants.alias("_v")).select("repeat", label, "_v.*")
        scored = predict(model, rows, features, keep=["repeat", "_j", label]).withColumnRenamed("probability", "_score")
        base = idx.select(col(label), "_score")
    aucs = ME.roc_auc(scored, label, "_score", group_cols=["repeat", "_j"])
    drops = _one_row_join(aucs, ME.roc_auc(base, label, "_score").withColumnRenamed("roc_auc", "_base"))
    names = F.create_map(*[x for j, f in enumerate(features) for x in (F.lit(j), F.lit(f))])
    drop = F.col("_base") - F.col("roc_auc")
    found = drops.groupBy("_j").agg(F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_std")).select(
        names[F.col("_j")].alias("feature"), "importance_mean", "importance_std")
    unused = [f for j, f in enumerate(features) if (j, f) not in used]
    if unused:       # a feature that the scorer does not read changes nothing
        found = found.unionByName(test.sparkSession.createDataFrame(
            [(f, 0.0, 0.0) for f in unused], "feature string, importance_mean double, importance_std double"))
    return found.orderBy(F.desc("importance_mean"), "feature")


# --------------------------------------------------------------------------
# experiment (ME10, ME11, ME12)
# --------------------------------------------------------------------------

def evaluate_variant(df: DataFrame, features: Sequence[str], label_name: str,
                     model_type: str = "random_forest", params: Mapping[str, object] | None = None,
                     key: str = "id", test_size: float = K.TEST_SIZE, k: int = K.CV_FOLDS,
                     seed: int = K.RANDOM_STATE) -> DataFrame:
    """ME10: split, k-fold CV on the train part, fit, test accuracy and AUC
    -> one row ``(variant, n_features, cv_auc_mean, cv_auc_std,
    test_accuracy, test_auc)``."""
    flagged = reliable(split_flag_exact(df, key, K.TARGET, test_size, seed))
    train = flagged.filter(~F.col("is_test"))
    test = flagged.filter(F.col("is_test"))
    cv = cv_summary(cv_scores(train, features, model_type, params, k, key, K.TARGET, seed)).first()
    model = fit(train, features, model_type, params, K.TARGET, seed)
    row = test_metrics(predict(model, test, features, keep=[K.TARGET])).first()
    spark = df.sparkSession
    return spark.createDataFrame(
        [(label_name, len(features), cv["cv_auc_mean"], cv["cv_auc_std"], row["accuracy"], row["roc_auc"])],
        "variant string, n_features int, cv_auc_mean double, cv_auc_std double, "
        "test_accuracy double, test_auc double")


def train_and_evaluate(df: DataFrame, features: Sequence[str], model_type: str = "random_forest",
                       params: Mapping[str, object] | None = None, key: str = "row_id",
                       seed: int = K.RANDOM_STATE):
    """ML8 core / ME12: split -> fit on train -> {accuracy, roc_auc} on test.
    Returns ``(model, metrics_df)``."""
    flagged = reliable(split_flag_exact(df, key, K.TARGET, K.TEST_SIZE, seed))
    model = fit(flagged.filter(~F.col("is_test")), features, model_type, params, K.TARGET, seed)
    return model, test_metrics(predict(model, flagged.filter(F.col("is_test")), features, keep=[K.TARGET]))


def test_metrics(scored: DataFrame, label: str = K.TARGET) -> DataFrame:
    """One row ``(accuracy, roc_auc)``: the test part is scored once, both
    figures come from its counts per (score, prediction, label)."""
    cells = reliable(scored.groupBy("probability", "prediction", label).agg(F.count(F.lit(1)).alias("_w")))
    right = F.sum(F.when(F.col(label) == F.col("prediction"), F.col("_w")).otherwise(0))
    acc = cells.agg(F.try_divide(right.cast("double"), F.sum("_w")).alias("accuracy"))
    return _one_row_join(acc, ME.roc_auc(cells, label, weight="_w"))


test_metrics.__test__ = False     # not a test case
