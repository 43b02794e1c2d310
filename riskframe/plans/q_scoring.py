"""Queries ML5 (linear), PR15-PR17 and ME1-ME5 over the scored survey."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import argmax_decision, py_round, risk_level, serve_decision
from ..operators import metrics as ME
from ..operators import prep as PR
from ..operators.models import SURVEY_TEST_SCORER
from ..session import shared_folder
from ..sources import io as IO
from ..sources.fixtures import oracle_views, view
from .registry import register, rounded

WSS = oracle_views("scored_survey")
PRED = "CASE WHEN probability > 0.5 THEN 1 ELSE 0 END"


def scored_survey(spark, sf):
    """survey_raw -> clean -> fixed linear scorer: (row_id, target, probability)."""
    clean = PR.clean_survey(view(spark, sf, "survey_raw"))
    return clean.select("row_id", K.TARGET, SURVEY_TEST_SCORER.probability().alias("probability"))


def _with_pred(spark, sf):
    return scored_survey(spark, sf).withColumn("prediction", argmax_decision("probability"))


@register("score_linear", WSS + "SELECT row_id, target, round(probability, 6) AS probability FROM scored_survey")
def score_linear(spark, sf):
    return rounded(scored_survey(spark, sf))


@register("risk_bucket", WSS + """
SELECT row_id, round(probability, 6) AS probability,
 CASE WHEN probability < 0.3 THEN 'Low' WHEN probability < 0.6 THEN 'Medium' ELSE 'High' END AS risk_level
FROM scored_survey""")
def risk_bucket(spark, sf):
    s = scored_survey(spark, sf)
    return rounded(s.select("row_id", "probability", risk_level("probability").alias("risk_level")))


@register("decision_rules", WSS + """
SELECT row_id, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS serve_prediction,
 CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS batch_prediction,
 round(printf('%.4f', probability)::DOUBLE, 6) AS display_probability FROM scored_survey""")
def decision_rules(spark, sf):
    s = scored_survey(spark, sf)
    return rounded(s.select(
        "row_id", serve_decision("probability").alias("serve_prediction"),
        argmax_decision("probability").alias("batch_prediction"),
        py_round("probability", K.PROBABILITY_DECIMALS).alias("display_probability")))


@register("accuracy", WSS + f"""
SELECT round(avg(CASE WHEN target = {PRED} THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*)::BIGINT AS n
FROM scored_survey""")
def accuracy(spark, sf):
    return rounded(ME.accuracy(_with_pred(spark, sf)))


# AUC is rank-based; the logit ranks rows exactly like the probability but
# is a plain sum of products (bit-identical in every IEEE engine), whereas
# exp() may differ by one ulp between engines and merge or split ties.
LOGIT_SQL = ("-4.0e0 + 1.0e0*HighBP + 0.7e0*HighChol + 1.8e0*Stroke + 0.4e0*Smoker + 0.7e0*DiffWalk"
             " + 0.3e0*Sex - 0.2e0*PhysActivity + 0.12e0*(Age - 7.0e0) + 0.35e0*(GenHlth - 3.0e0)"
             " + 0.25e0*Diabetes")


@register("roc_auc", WSS + f""",
z AS (SELECT CAST(HeartDiseaseorAttack AS INTEGER) AS target, {LOGIT_SQL} AS logit FROM survey_raw),
s AS (SELECT logit AS p, sum(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS pos,
      sum(CASE WHEN target = 1 THEN 0 ELSE 1 END) AS neg FROM z GROUP BY 1),
c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS below FROM s)
SELECT round(sum(pos * (below + 0.5 * neg)) / ((SELECT sum(pos) FROM s) * (SELECT sum(neg) FROM s)), 6)
 AS roc_auc FROM c""")
def roc_auc(spark, sf):
    clean = PR.clean_survey(view(spark, sf, "survey_raw"))
    z = clean.select(K.TARGET, SURVEY_TEST_SCORER.logit().alias("logit"))
    return rounded(ME.roc_auc(z, score="logit"))


@register("classification_report", WSS + f""",
p AS (SELECT target, {PRED} AS prediction FROM scored_survey),
k AS (SELECT DISTINCT target AS c FROM p UNION SELECT DISTINCT prediction FROM p),
m AS (SELECT CAST(c AS VARCHAR) AS label,
        (SELECT count(*) FROM p WHERE target = c) AS support,
        (SELECT count(*) FROM p WHERE prediction = c) AS pred,
        (SELECT count(*) FROM p WHERE target = c AND prediction = c) AS tp FROM k),
r AS (SELECT label, CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END AS precision,
        CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support FROM m),
f AS (SELECT label, precision, recall, CASE WHEN precision + recall > 0
        THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score, support FROM r)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
 support::BIGINT AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(support * recall) / sum(support), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6),
 sum(support)::BIGINT FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
 round(sum(recall * support) / sum(support), 6), round(sum(f1_score * support) / sum(support), 6),
 sum(support)::BIGINT FROM f""")
def classification_report(spark, sf):
    return rounded(ME.classification_report(_with_pred(spark, sf)))


@register("confusion", WSS + f"""
SELECT target, {PRED} AS prediction, count(*)::BIGINT AS n FROM scored_survey GROUP BY 1, 2""")
def confusion(spark, sf):
    return ME.confusion(_with_pred(spark, sf))


@register("class_distribution", WSS + """
SELECT target, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM scored_survey GROUP BY target ORDER BY n DESC""")
def class_distribution(spark, sf):
    return rounded(ME.class_distribution(scored_survey(spark, sf)))


@register("log_round_trip", WSS + """
SELECT 'basic' AS mode, prediction, risk_level, count(*)::BIGINT AS n, round(avg(probability), 6) AS avg_probability FROM (
 SELECT probability, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS prediction,
 CASE WHEN probability < 0.3 THEN 'Low' WHEN probability < 0.6 THEN 'Medium' ELSE 'High' END AS risk_level FROM scored_survey)
GROUP BY ALL""")
def log_round_trip(spark, sf):
    """IO9 + IO10: responses are appended to a prediction log as one batch,
    appended again (a replay replaces its own rows) and counted from the log."""
    s = scored_survey(spark, sf)
    responses = s.select(serve_decision("probability").alias("prediction"), "probability", risk_level("probability").alias("risk_level"))
    path = shared_folder(spark, "prediction-log")
    for _ in range(2):
        if not IO.append_prediction_log(responses, path, "basic", "batch-1"):
            raise RuntimeError("the prediction log could not be written")
    return rounded(IO.read_prediction_log(spark, path).groupBy("mode", "prediction", "risk_level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("probability").alias("avg_probability")))
