"""Queries EN1-EN5 and SP1-SP3."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import encode as EN
from ..operators import prep as PR
from ..operators import split as SP
from ..sources.fixtures import oracle_views, view
from .q_prep import CB, CLEAN_CLINICAL_COLS, _policy_select
from .registry import register, rounded

WC = oracle_views("clinical_raw")
WS = oracle_views("survey_raw")
# clean clinical table (oracle side)
CC = WC + CB + ", cc AS (SELECT " + _policy_select(CLEAN_CLINICAL_COLS) + \
    ", CASE WHEN num > 0 THEN 1 ELSE 0 END AS target FROM cb)\n"

_INTS = set(K.BASIC_BINARY_COLS + K.BASIC_ORDINAL_COLS)
# clean survey table (oracle side)
CS = WS + ", cs AS (SELECT row_id, " + ", ".join(
    f"CAST({c} AS INTEGER) AS {c}" if c in _INTS else c for c in K.BASIC_FEATURES) + \
    ", CAST(HeartDiseaseorAttack AS INTEGER) AS target FROM survey_raw)\n"


def _z(c: str, src: str) -> str:
    """Oracle standardisation with population std, zero -> 1."""
    return (f"round(({c} - (SELECT avg({c}) FROM {src})) / (SELECT CASE WHEN stddev_pop({c}) = 0 "
            f"THEN 1 ELSE stddev_pop({c}) END FROM {src}), 6)")


def _dummy(c: str, v: str) -> str:
    return f'CASE WHEN {c} = \'{v}\' THEN 1 ELSE 0 END AS "{c}_{v}"'


VOCAB = {
    "sex": ["Female", "Male"],
    "cp": ["asymptomatic", "atypical angina", "non-anginal", "typical angina"],
    "restecg": ["lv hypertrophy", "normal", "st-t abnormality"],
    "slope": ["downsloping", "flat", "unknown", "upsloping"],
    "thal": ["fixed defect", "normal", "reversable defect", "unknown"],
}


def _dummies(cols):
    return ", ".join(_dummy(c, v) for c in cols for v in VOCAB[c][1:])


def _clean_clinical(spark, sf):
    return PR.clean_clinical(view(spark, sf, "clinical_raw"))


def _clean_survey(spark, sf):
    return PR.clean_survey(view(spark, sf, "survey_raw"))


@register("onehot_drop_first", CC + "SELECT id, " + _dummies(K.ADVANCED_CATEGORICAL_COLS) + " FROM cc")
def onehot_drop_first(spark, sf):
    df = _clean_clinical(spark, sf).select("id", *K.ADVANCED_CATEGORICAL_COLS)
    return EN.onehot(df, EN.fit_vocabulary(df, K.ADVANCED_CATEGORICAL_COLS))


@register("scale_fit", CC + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, "
    f"round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) AS std FROM cc"
    for c in K.ADVANCED_NUMERIC_COLS))
def scale_fit(spark, sf):
    return rounded(EN.fit_scaler_stats_df(_clean_clinical(spark, sf), K.ADVANCED_NUMERIC_COLS))


@register("scale_transform", CC + "SELECT id, " + ", ".join(
    f"{_z(c, 'cc')} AS {c}" for c in K.ADVANCED_NUMERIC_COLS) + " FROM cc")
def scale_transform(spark, sf):
    df = _clean_clinical(spark, sf)
    stats = EN.fit_scaler(df, K.ADVANCED_NUMERIC_COLS)
    return rounded(EN.scale(df.select("id", *K.ADVANCED_NUMERIC_COLS), stats))


@register("features_basic", CS + "SELECT row_id, " + ", ".join(
    f"{_z(c, 'cs')} AS {c}" if c in K.BASIC_SCALE_COLS else c for c in K.BASIC_FEATURES)
    + ", target FROM cs")
def features_basic(spark, sf):
    out, _, feats = EN.prepare_basic(view(spark, sf, "survey_raw"))
    assert feats == K.BASIC_FEATURES, feats
    return rounded(out)


_ADV_PLAIN = [c for c in CLEAN_CLINICAL_COLS if c not in
              ["id"] + K.ADVANCED_LOW_IMPORTANCE_COLS + K.ADVANCED_CATEGORICAL_COLS]


@register("features_advanced", CC + "SELECT id, " + ", ".join(
    f"{_z(c, 'cc')} AS {c}" if c in K.ADVANCED_NUMERIC_COLS else c for c in _ADV_PLAIN)
    + ", target, " + _dummies(K.ADVANCED_CATEGORICAL_COLS) + " FROM cc")
def features_advanced(spark, sf):
    out, _, _, feats = EN.prepare_advanced(view(spark, sf, "clinical_raw"))
    assert feats == K.ADVANCED_FEATURES, feats
    return rounded(out)


def _variant_sql(drop):
    plain = [c for c in CLEAN_CLINICAL_COLS if c != "id" and c not in drop
             and c not in K.EXPERIMENT_CATEGORICAL_COLS]
    cats = [c for c in K.EXPERIMENT_CATEGORICAL_COLS if c not in drop]
    return CC + "SELECT id, " + ", ".join(
        f"{_z(c, 'cc')} AS {c}" if c in K.EXPERIMENT_NUMERIC_COLS else c for c in plain) + \
        ", target, " + _dummies(cats) + " FROM cc"


@register("features_full", _variant_sql([]))
def features_full(spark, sf):
    out, feats = EN.build_variant(_clean_clinical(spark, sf))
    assert len(feats) == 20, feats
    return rounded(out)


@register("features_reduced", _variant_sql(K.ADVANCED_LOW_IMPORTANCE_COLS))
def features_reduced(spark, sf):
    out, feats = EN.build_variant(_clean_clinical(spark, sf), K.ADVANCED_LOW_IMPORTANCE_COLS)
    assert len(feats) == 14, feats
    return rounded(out)


_RANKED = WS + """, s AS (SELECT row_id, CAST(HeartDiseaseorAttack AS INTEGER) AS target, {h} AS h FROM survey_raw),
r AS (SELECT row_id, target, row_number() OVER (PARTITION BY target ORDER BY h, row_id) - 1 AS rk,
 count(*) OVER (PARTITION BY target) AS n FROM s)
"""


def _labelled(spark, sf):
    return view(spark, sf, "survey_raw").select(
        "row_id", F.col(K.BASIC_TARGET_RAW).cast("int").alias(K.TARGET))


@register("split_stratified", _RANKED.format(h=SP.key_hash_sql("row_id")) + f"""
SELECT row_id, target, rk < round(n * {K.TEST_SIZE}) AS is_test FROM r""")
def split_stratified(spark, sf):
    return SP.split_flag_exact(_labelled(spark, sf), "row_id")


@register("folds_stratified", _RANKED.format(h=SP.key_hash_sql("row_id", K.RANDOM_STATE + 1)) + "SELECT row_id, target, CAST("
          + " + ".join(f"CASE WHEN rk >= ({2 * j} * n + {K.CV_FOLDS}) // {2 * K.CV_FOLDS} THEN 1 ELSE 0 END"
                       for j in range(1, K.CV_FOLDS)) + " AS INTEGER) AS fold FROM r")
def folds_stratified(spark, sf):
    return SP.fold_exact(_labelled(spark, sf), "row_id")


@register("class_weights", WS + """, c AS (SELECT CAST(HeartDiseaseorAttack AS INTEGER) AS target,
 count(*)::BIGINT AS n_class FROM survey_raw GROUP BY 1)
SELECT target, n_class, round((SELECT sum(n_class) FROM c) / ((SELECT count(*) FROM c) * n_class), 6) AS weight
FROM c""")
def class_weights(spark, sf):
    df = view(spark, sf, "survey_raw").select(F.col(K.BASIC_TARGET_RAW).cast("int").alias(K.TARGET))
    return rounded(SP.class_weights(df))
