"""Derived input views (FIXTURES.md section 3) as portable SQL.

Each view is one SELECT whose values come from integer arithmetic on a key,
so Spark and DuckDB produce identical rows. The same text serves both
engines: Spark receives the base DataFrames as ``spark.sql`` arguments
(``{orders}`` placeholders), the DuckDB oracle gets plain table names and
inlines the views as CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table

_H = "(((o_orderkey + 1) * {m}) % 1000003 % {k})"
_C = "(((c_custkey + 1) * {m}) % 1000003 % {k})"


def _o(m: int, k: int) -> str:
    return _H.format(m=m, k=k)


def _c(m: int, k: int) -> str:
    return _C.format(m=m, k=k)


def _bin(h: str, cut: int) -> str:
    return f"CASE WHEN {h} < {cut} THEN 1.0e0 ELSE 0.0e0 END"


SURVEY_RAW = f"""
SELECT row_id, CASE WHEN 3*HighBP + 2*HighChol + 5*Stroke + Smoker + 2*DiffWalk
   + CASE WHEN Age >= 9 THEN 3 ELSE 0 END + CASE WHEN GenHlth >= 4 THEN 3 ELSE 0 END
   + CASE WHEN Diabetes >= 2 THEN 2 ELSE 0 END + noise >= 14 THEN 1.0e0 ELSE 0.0e0 END AS HeartDiseaseorAttack,
 HighBP, HighChol, CholCheck, BMI, Smoker, Stroke, Diabetes, PhysActivity, Fruits, Veggies,
 HvyAlcoholConsump, AnyHealthcare, NoDocbcCost, GenHlth, MentHlth, PhysHlth, DiffWalk, Sex, Age, Education, Income
FROM (SELECT o_orderkey AS row_id,
 {_bin(_o(48271, 1000), 430)} AS HighBP, {_bin(_o(69621, 1000), 420)} AS HighChol, {_bin(_o(40692, 1000), 960)} AS CholCheck,
 15.0e0 + {_o(271829, 350)} / 10.0e0 AS BMI,
 {_bin(_o(314161, 1000), 440)} AS Smoker, {_bin(_o(577217, 1000), 40)} AS Stroke,
 CASE WHEN {_o(662607, 1000)} < 840 THEN 0.0e0 WHEN {_o(662607, 1000)} < 860 THEN 1.0e0 ELSE 2.0e0 END AS Diabetes,
 {_bin(_o(602213, 1000), 760)} AS PhysActivity, {_bin(_o(137035, 1000), 630)} AS Fruits, {_bin(_o(161803, 1000), 810)} AS Veggies,
 {_bin(_o(299791, 1000), 60)} AS HvyAlcoholConsump, {_bin(_o(667429, 1000), 950)} AS AnyHealthcare, {_bin(_o(729735, 1000), 80)} AS NoDocbcCost,
 1.0e0 + {_o(910937, 5)} AS GenHlth,
 CASE WHEN {_o(836101, 1000)} < 700 THEN 0.0e0 ELSE 1.0e0 + {_o(836101, 30)} END AS MentHlth,
 CASE WHEN {_o(445567, 1000)} < 630 THEN 0.0e0 ELSE 1.0e0 + {_o(445567, 30)} END AS PhysHlth,
 {_bin(_o(517639, 1000), 170)} AS DiffWalk, {_bin(_o(392699, 1000), 440)} AS Sex,
 1.0e0 + {_o(785391, 13)} AS Age, 1.0e0 + {_o(235711, 6)} AS Education, 1.0e0 + {_o(112583, 8)} AS Income,
 {_o(948701, 6)} AS noise
FROM {{orders}}) s
"""

CLINICAL_RAW = f"""
SELECT c_custkey AS id, 28 + {_c(48271, 50)} AS age,
 CASE WHEN {_c(69621, 1000)} < 790 THEN 'Male' ELSE 'Female' END AS sex,
 CASE {_c(40692, 4)} WHEN 0 THEN 'Cleveland' WHEN 1 THEN 'Hungary' WHEN 2 THEN 'Switzerland' ELSE 'VA Long Beach' END AS dataset,
 CASE WHEN {_c(271829, 1000)} < 540 THEN 'asymptomatic' WHEN {_c(271829, 1000)} < 760 THEN 'non-anginal'
      WHEN {_c(271829, 1000)} < 950 THEN 'atypical angina' ELSE 'typical angina' END AS cp,
 CASE WHEN {_c(314161, 1000)} < 60 THEN NULL ELSE 90.0e0 + {_c(577217, 110)} END AS trestbps,
 CASE WHEN {_c(662607, 1000)} < 30 THEN NULL ELSE 120.0e0 + {_c(602213, 300)} END AS chol,
 CASE WHEN {_c(137035, 1000)} < 100 THEN NULL ELSE CASE WHEN {_c(161803, 1000)} < 170 THEN 'TRUE' ELSE 'FALSE' END END AS fbs,
 CASE WHEN {_c(299791, 1000)} < 5 THEN NULL ELSE CASE {_c(667429, 3)} WHEN 0 THEN 'normal' WHEN 1 THEN 'lv hypertrophy' ELSE 'st-t abnormality' END END AS restecg,
 CASE WHEN {_c(729735, 1000)} < 60 THEN NULL ELSE 70.0e0 + {_c(910937, 130)} END AS thalch,
 CASE WHEN {_c(836101, 1000)} < 60 THEN NULL ELSE CASE WHEN {_c(445567, 1000)} < 390 THEN 'TRUE' ELSE 'FALSE' END END AS exang,
 CASE WHEN {_c(517639, 1000)} < 70 THEN NULL ELSE {_c(392699, 50)} / 10.0e0 END AS oldpeak,
 CASE WHEN {_c(785391, 1000)} < 340 THEN NULL ELSE CASE {_c(235711, 3)} WHEN 0 THEN 'flat' WHEN 1 THEN 'upsloping' ELSE 'downsloping' END END AS slope,
 CASE WHEN {_c(112583, 1000)} < 660 THEN NULL ELSE 0.0e0 + {_c(948701, 4)} END AS ca,
 CASE WHEN {_c(358979, 1000)} < 530 THEN NULL ELSE CASE WHEN {_c(846263, 1000)} < 450 THEN 'normal' WHEN {_c(846263, 1000)} < 890 THEN 'reversable defect' ELSE 'fixed defect' END END AS thal,
 CASE WHEN {_c(271829, 1000)} < 540 AND {_c(793233, 10)} < 8 THEN 1 + {_c(846433, 4)}
      WHEN {_c(793233, 10)} < 3 THEN 1 ELSE 0 END AS num
FROM {{customer}}
"""

PREDICTION_LOG = """
SELECT event_id AS id, ts, CASE WHEN event_id % 3 = 0 THEN 'advanced' ELSE 'basic' END AS mode,
 value / (value + 60.0e0) AS probability,
 CASE WHEN value / (value + 60.0e0) >= 0.5e0 THEN 1 ELSE 0 END AS prediction,
 CASE WHEN value / (value + 60.0e0) < 0.3e0 THEN 'Low' WHEN value / (value + 60.0e0) < 0.6e0 THEN 'Medium' ELSE 'High' END AS risk_level
FROM {events}
"""

_AGE_CASE = " ".join(
    f"WHEN {i} THEN '{k}'" for i, k in enumerate(
        ["18-24", "25-29", "30-34", "35-39", "40-44", "45-49", "50-54",
         "55-59", "60-64", "65-69", "70-74", "75-79"])
)

REQUESTS_BASIC = f"""
SELECT o_orderkey AS row_id,
 CASE WHEN o_orderkey % 97 = 0 THEN '999' ELSE CASE {_o(785391, 13)} {_AGE_CASE} ELSE '80+' END END AS age_group,
 CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN {_o(392699, 1000)} < 440 THEN 'Male' ELSE 'Female' END AS sex,
 CASE WHEN o_orderkey % 83 = 0 THEN 90.0e0 ELSE 145.0e0 + {_o(271829, 50)} END AS height_cm,
 40.0e0 + {_o(836101, 90)} AS weight_kg,
 {_o(48271, 1000)} < 430 AS high_bp, {_o(69621, 1000)} < 420 AS high_chol,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {_o(40692, 1000)} < 960 END AS chol_check,
 CASE {_o(662607, 4)} WHEN 0 THEN 'pre' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' ELSE NULL END AS diabetes,
 {_o(577217, 1000)} < 40 AS stroke, {_o(314161, 1000)} < 440 AS smoker, {_o(602213, 1000)} < 760 AS phys_activity, {_o(137035, 1000)} < 630 AS fruits, {_o(161803, 1000)} < 810 AS veggies,
 {_o(299791, 1000)} < 60 AS heavy_alcohol,
 CASE {_o(910937, 5)} WHEN 0 THEN 'very good' WHEN 1 THEN 'good' WHEN 2 THEN 'fair' WHEN 3 THEN 'average' ELSE 'poor' END AS gen_health,
 {_o(445567, 31)} AS mental_health_days, CASE WHEN o_orderkey % 79 = 0 THEN 31 ELSE {_o(517639, 31)} END AS phys_health_days,
 {_o(517639, 1000)} < 170 AS diff_walk, {_o(667429, 1000)} < 950 AS any_healthcare, {_o(729735, 1000)} < 80 AS no_doc_because_cost,
 CASE {_o(235711, 6)} WHEN 0 THEN 'none' WHEN 1 THEN 'lower secondary' WHEN 2 THEN 'some upper secondary' WHEN 3 THEN 'upper secondary' WHEN 4 THEN 'some college' ELSE 'degree' END AS education_level,
 CASE {_o(112583, 8)} WHEN 0 THEN '<10k' WHEN 1 THEN '10-15k' WHEN 2 THEN '15-20k' WHEN 3 THEN '20-25k' WHEN 4 THEN '25-35k' WHEN 5 THEN '35-50k' WHEN 6 THEN '50-75k' ELSE '>75k' END AS income_level
FROM {{orders}}
"""

REQUESTS_ADVANCED = f"""
SELECT c_custkey AS row_id, CASE WHEN c_custkey % 97 = 0 THEN 130 ELSE 28 + {_c(48271, 50)} END AS age,
 CASE WHEN {_c(69621, 1000)} < 790 THEN 'Male' ELSE 'Female' END AS sex,
 CASE WHEN c_custkey % 89 = 0 THEN 'unlisted' WHEN {_c(271829, 1000)} < 540 THEN 'asymptomatic' WHEN {_c(271829, 1000)} < 760 THEN 'non-anginal'
   WHEN {_c(271829, 1000)} < 950 THEN 'atypical angina' ELSE 'typical angina' END AS cp,
 CASE WHEN c_custkey % 83 = 0 THEN -1.0e0 ELSE 120.0e0 + {_c(602213, 300)} END AS chol,
 {_c(161803, 1000)} < 170 AS fbs, 70.0e0 + {_c(910937, 130)} AS thalch, {_c(445567, 1000)} < 390 AS exang, {_c(392699, 50)} / 10.0e0 AS oldpeak,
 CASE WHEN {_c(112583, 1000)} < 660 THEN NULL WHEN c_custkey % 79 = 0 THEN 4 ELSE {_c(948701, 4)} END AS ca,
 CASE WHEN {_c(358979, 1000)} < 530 THEN NULL WHEN {_c(846263, 1000)} < 450 THEN 'normal' WHEN {_c(846263, 1000)} < 890 THEN 'reversable defect' ELSE 'fixed defect' END AS thal
FROM {{customer}}
"""

SCORED_SURVEY = """
SELECT row_id, CAST(HeartDiseaseorAttack AS INT) AS target,
 1.0e0 / (1.0e0 + exp(-(-4.0e0 + 1.0e0*HighBP + 0.7e0*HighChol + 1.8e0*Stroke + 0.4e0*Smoker + 0.7e0*DiffWalk + 0.3e0*Sex
   - 0.2e0*PhysActivity + 0.12e0*(Age - 7.0e0) + 0.35e0*(GenHlth - 3.0e0) + 0.25e0*Diabetes))) AS probability
FROM {survey_raw}
"""

KB_DOCS = """
SELECT doc_id, concat('doc', doc_id, '.md') AS source,
 concat('# doc ', doc_id, chr(10), '## ', replace(text, chr(10), concat(chr(10), '## '))) AS kb_text
FROM {documents}
"""

# name -> (sql template, sources); a source is a base table or another view.
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "survey_raw": (SURVEY_RAW, ("orders",)),
    "clinical_raw": (CLINICAL_RAW, ("customer",)),
    "prediction_log": (PREDICTION_LOG, ("events",)),
    "requests_basic": (REQUESTS_BASIC, ("orders",)),
    "requests_advanced": (REQUESTS_ADVANCED, ("customer",)),
    "scored_survey": (SCORED_SURVEY, ("survey_raw",)),
    "kb_docs": (KB_DOCS, ("documents",)),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a derived view as a lazy Spark DataFrame."""
    sql, sources = VIEWS[name]
    args = {}
    for src in sources:
        args[src] = view(spark, sf_dir, src) if src in VIEWS else read_table(spark, sf_dir, src)
    return spark.sql(sql, **args)


def oracle_views(*names: str) -> str:
    """A ``WITH`` clause defining the named views (and their dependencies)
    for DuckDB over the pre-registered base tables."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered or n not in VIEWS:
            return
        for dep in VIEWS[n][1]:
            visit(dep)
        ordered.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in ordered:
        sql, sources = VIEWS[n]
        body = sql.format(**{s: s for s in sources}).strip()
        parts.append(f"{n} AS (\n{body}\n)")
    return "WITH " + ",\n".join(parts) + "\n"
