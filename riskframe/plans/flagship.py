"""Flagship query: survey rows -> clean -> scale -> linear score -> risk
bucket -> count and mean probability by (risk level, age band).

One scan of ``orders`` (through the survey view), two small fitted-stats
jobs (imputation check, scaler), then a single map stage with a partial
aggregation and one shuffle of at most 3 x 13 groups per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import literal_map, risk_level
from ..operators import encode as EN
from ..operators.models import BASIC_SERVE_SCORER
from ..sources.fixtures import oracle_views, view
from .q_explain import logit_sql
from .registry import register, rounded


def risk_by_age_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "survey_raw")
    # keep the unscaled age code next to the scaled model row; cleaning and
    # scaler fit share one aggregation (prepare_basic)
    feats, _, _ = EN.prepare_basic(raw.withColumn("age_code", F.col("Age").cast("int")))
    bands = literal_map([(code, key) for key, code in K.AGE_GROUP_CODES])
    p = BASIC_SERVE_SCORER.probability()
    rows = feats.select(risk_level(p).alias("risk_level"), bands[F.col("age_code")].alias("age_band"),
                        p.alias("p"))
    return (rows.groupBy("risk_level", "age_band")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_probability")))


def _scaled(c: str) -> str:
    if c not in K.BASIC_SCALE_COLS:
        return c
    return (f"(({c} - (SELECT avg({c}) FROM survey_raw)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 "
            f"ELSE stddev_pop({c}) END FROM survey_raw))")


_P = "(1.0e0 / (1.0e0 + exp(-(" + logit_sql(BASIC_SERVE_SCORER, {c: _scaled(c) for c in K.BASIC_FEATURES}) + "))))"
_BAND = "CASE CAST(Age AS INTEGER) " + " ".join(f"WHEN {code} THEN '{key}'" for key, code in K.AGE_GROUP_CODES) + " END"
FLAGSHIP_SQL = oracle_views("survey_raw") + f""", s AS (SELECT {_P} AS p, {_BAND} AS age_band FROM survey_raw)
SELECT CASE WHEN p < 0.3 THEN 'Low' WHEN p < 0.6 THEN 'Medium' ELSE 'High' END AS risk_level, age_band,
 count(*)::BIGINT AS n, (round(avg(p), 6) + 0.0) AS mean_probability FROM s GROUP BY 1, 2"""


@register("flagship_risk_by_age", FLAGSHIP_SQL)
def flagship_risk_by_age(spark, sf):
    return rounded(risk_by_age_band(spark, sf))
