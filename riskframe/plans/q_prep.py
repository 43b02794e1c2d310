"""Queries PR1-PR9 and MV1-MV8 over ``clinical_raw`` / ``survey_raw``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import impute as MV
from ..operators import prep as PR
from ..sources.fixtures import oracle_views, view
from .registry import register, rounded

WC = oracle_views("clinical_raw")
WS = oracle_views("survey_raw")

# clinical_raw with the TRUE/FALSE text mapped (oracle side)
CB = """, cb AS (SELECT id, age, sex, dataset, cp, trestbps, chol,
  CASE fbs WHEN 'TRUE' THEN 1 WHEN 'FALSE' THEN 0 END AS fbs, restecg, thalch,
  CASE exang WHEN 'TRUE' THEN 1 WHEN 'FALSE' THEN 0 END AS exang, oldpeak, slope, ca, thal, num
  FROM clinical_raw)
"""


def _mode(c: str, src: str = "cb") -> str:
    return (f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


def _med(c: str, src: str = "cb") -> str:
    return f"(SELECT median({c}) FROM {src})"


CLINICAL_COLS = ["id", "age", "sex", "dataset", "cp", "trestbps", "chol", "fbs", "restecg",
                 "thalch", "exang", "oldpeak", "slope", "ca", "thal", "num"]


def _policy_select(cols, key_drop=()):
    fills = {c: f"coalesce({c}, {_med(c)})" for c in K.ADVANCED_MEDIAN_COLS}
    fills.update({c: f"coalesce({c}, {_mode(c)})" for c in K.ADVANCED_MODE_COLS})
    fills.update({c: f"coalesce({c}, 'unknown')" for c in K.ADVANCED_UNKNOWN_COLS})
    fills.update({c: f"coalesce({c}, -1)" for c in K.ADVANCED_MINUS_ONE_COLS})
    return ", ".join(f"{fills[c]} AS {c}" if c in fills else c for c in cols if c not in key_drop)


def _clinical(spark, sf):
    return view(spark, sf, "clinical_raw")


def _survey(spark, sf):
    return view(spark, sf, "survey_raw")


@register("null_profile", WC + "\n".join(
    ("SELECT" if i == 0 else "UNION ALL SELECT")
    + f" '{c}' AS column_name, count_if({c} IS NULL)::BIGINT AS null_count,"
      f" round(count_if({c} IS NULL) * 100.0 / count(*), 6) AS null_pct FROM clinical_raw"
    for i, c in enumerate(CLINICAL_COLS)))
def null_profile(spark, sf):
    return rounded(MV.null_profile(_clinical(spark, sf)))


@register("impute_median", WC + CB + "SELECT id, " + ", ".join(
    f"coalesce({c}, {_med(c)}) AS {c}" for c in K.ADVANCED_MEDIAN_COLS) + " FROM cb")
def impute_median(spark, sf):
    df = _clinical(spark, sf).select("id", *K.ADVANCED_MEDIAN_COLS)
    return MV.impute(df, {c: "median" for c in K.ADVANCED_MEDIAN_COLS})


@register("impute_mode", WC + CB + "SELECT id, " + ", ".join(
    f"coalesce({c}, {_mode(c)}) AS {c}" for c in K.ADVANCED_MODE_COLS) + " FROM cb")
def impute_mode(spark, sf):
    df = PR.bool_text_map(_clinical(spark, sf)).select("id", *K.ADVANCED_MODE_COLS)
    return MV.impute(df, {c: "mode" for c in K.ADVANCED_MODE_COLS})


@register("impute_constant", WC + """
SELECT id, coalesce(slope, 'unknown') AS slope, coalesce(thal, 'unknown') AS thal,
 coalesce(ca, -1) AS ca FROM clinical_raw""")
def impute_constant(spark, sf):
    df = _clinical(spark, sf).select("id", "slope", "thal", "ca")
    return MV.impute(df, {"slope": ("const", K.UNKNOWN_TEXT), "thal": ("const", K.UNKNOWN_TEXT),
                          "ca": ("const", K.MISSING_NUMBER)})


@register("impute_policy", WC + CB + "SELECT " + _policy_select(CLINICAL_COLS) + " FROM cb")
def impute_policy(spark, sf):
    return MV.impute(PR.bool_text_map(_clinical(spark, sf)), MV.ADVANCED_POLICY)


SURVEY_COLS = ["row_id", "HeartDiseaseorAttack"] + K.BASIC_FEATURES


@register("impute_by_type", WS + """, s2 AS (SELECT * REPLACE (CASE WHEN row_id % 17 = 0 THEN NULL ELSE BMI END AS BMI)
 FROM survey_raw)
SELECT """ + ", ".join(f"coalesce(BMI, (SELECT median(BMI) FROM s2)) AS BMI" if c == "BMI" else c
                       for c in SURVEY_COLS) + " FROM s2")
def impute_by_type(spark, sf):
    df = _survey(spark, sf)
    df = df.withColumn("BMI", F.when(F.col("row_id") % 17 == 0, F.lit(None)).otherwise(F.col("BMI")))
    return MV.impute_by_type(df, exclude=["row_id"]).select(*SURVEY_COLS)


def _survey_clean_sql():
    ints = set(K.BASIC_BINARY_COLS + K.BASIC_ORDINAL_COLS)
    cols = ["row_id"] + [f"CAST({c} AS INTEGER) AS {c}" if c in ints else c for c in K.BASIC_FEATURES]
    return "SELECT " + ", ".join(cols) + ", CAST(HeartDiseaseorAttack AS INTEGER) AS target FROM survey_raw"


@register("clean_survey", WS + _survey_clean_sql())
def clean_survey(spark, sf):
    return PR.clean_survey(_survey(spark, sf))


CLEAN_CLINICAL_COLS = [c for c in CLINICAL_COLS if c not in ("dataset", "num")]


@register("clean_clinical", WC + CB + "SELECT " + _policy_select(CLEAN_CLINICAL_COLS)
          + ", CASE WHEN num > 0 THEN 1 ELSE 0 END AS target FROM cb")
def clean_clinical(spark, sf):
    return PR.clean_clinical(_clinical(spark, sf))


@register("binarize_target", WC + """
SELECT id, CASE WHEN num > 0 THEN 1 ELSE 0 END AS target FROM clinical_raw""")
def binarize_target(spark, sf):
    return PR.binarize_target(_clinical(spark, sf).select("id", "num"))


@register("bool_text_map", WC + """
SELECT id, CASE fbs WHEN 'TRUE' THEN 1 WHEN 'FALSE' THEN 0 END AS fbs,
 CASE exang WHEN 'TRUE' THEN 1 WHEN 'FALSE' THEN 0 END AS exang FROM clinical_raw""")
def bool_text_map(spark, sf):
    return PR.bool_text_map(_clinical(spark, sf).select("id", "fbs", "exang"))


@register("drop_columns", WC + "SELECT " + ", ".join(
    c for c in CLINICAL_COLS if c not in K.ADVANCED_DROP_COLS + K.ADVANCED_LOW_IMPORTANCE_COLS)
    + " FROM clinical_raw")
def drop_columns(spark, sf):
    df = PR.drop_columns(_clinical(spark, sf), K.ADVANCED_DROP_COLS)
    return PR.drop_columns(df, K.ADVANCED_LOW_IMPORTANCE_COLS)


_ALIGN_MISSING = ["CholCheck", "Income"]


@register("align_features", WS + "SELECT row_id, CAST(HeartDiseaseorAttack AS INTEGER) AS target, " + ", ".join(
    (f"0 AS {c}" if c in _ALIGN_MISSING else
     f"CAST({c} AS INTEGER) AS {c}" if c in K.BASIC_BINARY_COLS + K.BASIC_ORDINAL_COLS else c)
    for c in K.BASIC_FEATURES) + " FROM survey_raw")
def align_features(spark, sf):
    df = PR.clean_survey(_survey(spark, sf)).drop(*_ALIGN_MISSING).withColumn("extra", F.lit(1))
    return PR.align_features(df, K.BASIC_FEATURES, keep=["row_id", K.TARGET])
