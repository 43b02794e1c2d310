"""Scorers and estimators (ML1-ML5, ML7 scoring part).

* ``LinearScorer`` - a fixed logistic scorer expressed as ONE column
  expression (no UDF, inside whole-stage codegen). It is the exact,
  oracle-checkable scorer used by tests and by the explanation closed form.
* ``build_model`` - registry name -> Spark ML estimator with the reference's
  parameter names mapped (``n_estimators`` -> ``numTrees`` ...).
* ``score`` - batch scoring of any fitted Spark ML model: appends
  ``prediction`` (argmax, so p = 0.5 -> 0) and ``probability`` of class 1.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import argmax_decision, col, sigmoid


@dataclass(frozen=True)
class LinearScorer:
    """``p = 1 / (1 + exp(-(b + sum_i w_i * (x_i - c_i))))``.

    Terms are added left to right in the given order (floating-point sums
    are order dependent; keeping the order keeps results bit-stable)."""

    intercept: float
    terms: tuple[tuple[str, float, float | None], ...] = field(default_factory=tuple)

    @property
    def features(self) -> list[str]:
        return [t[0] for t in self.terms]

    def term(self, name: str, weight: float, center: float | None,
             value: Column | None = None) -> Column:
        x = (value if value is not None else col(name)).cast("double")
        if center is not None:
            x = x - F.lit(center)
        return F.lit(weight) * x

    def logit(self, values: Mapping[str, Column] | None = None) -> Column:
        values = values or {}
        z = F.lit(self.intercept)
        for name, w, c in self.terms:
            t = self.term(name, abs(w), c, values.get(name))
            z = z - t if w < 0 else z + t
        return z

    def probability(self, values: Mapping[str, Column] | None = None) -> Column:
        return sigmoid(self.logit(values))

    def transform(self, df: DataFrame, output: str = "probability") -> DataFrame:
        return df.withColumn(output, self.probability())


# Test scorer over the survey columns (our own constants; see FIXTURES.md).
SURVEY_TEST_SCORER = LinearScorer(-4.0, (
    ("HighBP", 1.0, None), ("HighChol", 0.7, None), ("Stroke", 1.8, None),
    ("Smoker", 0.4, None), ("DiffWalk", 0.7, None), ("Sex", 0.3, None),
    ("PhysActivity", -0.2, None), ("Age", 0.12, 7.0), ("GenHlth", 0.35, 3.0),
    ("Diabetes", 0.25, None),
))

# Serving test scorers over model rows (scaled features); our own constants.
BASIC_SERVE_SCORER = LinearScorer(-3.0, (
    ("HighBP", 0.9, None), ("HighChol", 0.6, None), ("Stroke", 1.5, None),
    ("Smoker", 0.35, None), ("DiffWalk", 0.6, None), ("Sex", 0.3, None),
    ("PhysActivity", -0.25, None), ("BMI", 0.15, None), ("GenHlth", 0.45, None),
    ("Age", 0.5, None), ("Diabetes", 0.2, None), ("Income", -0.1, None),
))
ADVANCED_SERVE_SCORER = LinearScorer(0.2, (
    ("age", 0.3, None), ("chol", 0.25, None), ("fbs", 0.3, None), ("thalch", -0.4, None),
    ("exang", 0.9, None), ("oldpeak", 0.6, None), ("ca", 0.5, None), ("sex_Male", 0.8, None),
    ("cp_atypical angina", -0.9, None), ("cp_non-anginal", -0.7, None),
    ("cp_typical angina", -0.5, None), ("thal_normal", -0.6, None),
    ("thal_reversable defect", 0.4, None), ("thal_unknown", 0.1, None),
))


# --------------------------------------------------------------------------
# Spark ML estimators
# --------------------------------------------------------------------------

_PARAM_NAMES = {
    "n_estimators": "numTrees", "max_depth": "maxDepth", "random_state": "seed",
    "max_iter": "maxIter",
}


def build_model(model_type: str, params: Mapping[str, object] | None = None,
                features_col: str = "features", label_col: str = K.TARGET,
                weight_col: str | None = None, seed: int = K.RANDOM_STATE):
    """ML3: registry lookup; an unknown type raises ``ValueError``.

    ``class_weight='balanced'`` turns into ``weightCol`` (see
    ``split.with_class_weight``); ``n_jobs`` is meaningless on Spark."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    params = dict(params or {})
    params.pop("n_jobs", None)
    balanced = params.pop("class_weight", None) == "balanced"
    mapped = {_PARAM_NAMES.get(k, k): v for k, v in params.items()}
    common = {"featuresCol": features_col, "labelCol": label_col}
    if balanced or weight_col:
        common["weightCol"] = weight_col or "weight"
    if model_type == "random_forest":
        mapped.setdefault("seed", seed)
        mapped.setdefault("featureSubsetStrategy", "sqrt")
        # more tree nodes per pass over the data: fewer passes (jobs)
        mapped.setdefault("maxMemoryInMB", 1024)
        # a row's node of every tree is kept from pass to pass, not found again from the root
        mapped.setdefault("cacheNodeIds", True)
        return RandomForestClassifier(**common, **mapped)
    if model_type == "logistic_regression":
        c = mapped.pop("C", 1.0)
        n = mapped.pop("n_rows", None)
        # scikit-learn's C is an inverse L2 strength on the summed loss;
        # Spark's regParam is on the mean loss: regParam = 1 / (C * n).
        reg = 1.0 / (float(c) * float(n)) if n else 1.0 / float(c)
        mapped.setdefault("maxIter", 100)
        return LogisticRegression(**common, regParam=reg, elasticNetParam=0.0,
                                  standardization=False, **mapped)
    raise ValueError(f"model type '{model_type}' is not supported")


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    """Pack the ordered feature columns into an ML vector (order = contract)."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol=output,
                           handleInvalid="error").transform(df)


def score(model, df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """ML5: batch score with a fitted Spark ML model or a ``LinearScorer``; returns ``keep`` +
    feature columns + ``prediction`` (argmax) + ``probability`` (class 1)."""
    from pyspark.ml.functions import vector_to_array

    if isinstance(model, LinearScorer):
        scored, p = df, model.probability()
        return scored.select(*[col(c) for c in list(keep) + list(features)],
                             argmax_decision(p).alias("prediction"), p.alias("probability"))
    scored = model.transform(assemble(df, features, model.getFeaturesCol()))
    p = vector_to_array(F.col(model.getProbabilityCol()))[1]
    return scored.select(*[col(c) for c in list(keep) + list(features)],
                         argmax_decision(p).alias("prediction"), p.alias("probability"))
