"""Queries PR10-PR21 (serving side), EN6-EN7 and ML7 over request tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import rules as R
from ..operators import encode as EN
from ..operators import serve as SV
from ..operators.models import ADVANCED_SERVE_SCORER, BASIC_SERVE_SCORER
from ..sources.fixtures import oracle_views, view
from .q_explain import logit_sql
from .q_features import CC
from .registry import register, rounded

# ------------------------------------------------------------ oracle helpers


def _lit(v) -> str:
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def _defaults_sql(schema, cols) -> str:
    d = {f.name: f.default for f in schema if f.default is not None}
    return ", ".join(f"coalesce({c}, {_lit(d[c])}) AS {c}" if c in d else c for c in cols)


def _errors_sql(schema) -> str:
    parts = []
    for f in schema:
        n = f.name
        if f.required and f.default is None:
            parts.append(f"CASE WHEN {n} IS NULL THEN '{n}:missing' END")
        if f.enum is not None:
            vals = ", ".join(_lit(v) for v in f.enum)
            parts.append(f"CASE WHEN {n} IS NOT NULL AND {n} NOT IN ({vals}) THEN '{n}:enum' END")
        if f.ge is not None or f.le is not None:
            conds = []
            if f.ge is not None:
                conds.append(f"{n} < {f.ge!r}")
            if f.le is not None:
                conds.append(f"{n} > {f.le!r}")
            parts.append(f"CASE WHEN {n} IS NOT NULL AND ({' OR '.join(conds)}) THEN '{n}:range' END")
    return "concat_ws('|', " + ", ".join(parts) + ")"


BASIC_REQ_COLS = ["row_id", "age_group", "sex", "height_cm", "weight_kg", "high_bp", "high_chol",
                  "chol_check", "diabetes", "stroke", "smoker", "phys_activity", "fruits", "veggies",
                  "heavy_alcohol", "gen_health", "mental_health_days", "phys_health_days", "diff_walk",
                  "any_healthcare", "no_doc_because_cost", "education_level", "income_level"]
ADV_REQ_COLS = ["row_id", "age", "sex", "cp", "chol", "fbs", "thalch", "exang", "oldpeak", "ca", "thal"]

WB = oracle_views("requests_basic", "survey_raw")
WA = oracle_views("requests_advanced")
# scaler statistics computed ONCE (materialised): every expression then sees
# bit-identical values, so ablated logits equal the base logit exactly when
# a feature already sits at its baseline
_SB = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}"
                for c in K.BASIC_SCALE_COLS)
RB = WB + f""", rd AS (SELECT {_defaults_sql(R.BASIC_SCHEMA, BASIC_REQ_COLS)} FROM requests_basic),
rv AS (SELECT *, {_errors_sql(R.BASIC_SCHEMA)} AS errs FROM rd),
sb AS MATERIALIZED (SELECT {_SB} FROM survey_raw),
ok AS (SELECT rv.*, sb.* FROM rv CROSS JOIN sb WHERE errs = '')
"""


def _code_case(expr, *tables):
    pairs = [p for t in tables for p in t]
    return "CASE " + expr + " " + " ".join(f"WHEN {_lit(k)} THEN {v}" for k, v in pairs) + " END"


BMI_SQL = "printf('%.1f', weight_kg / ((height_cm / 100.0) * (height_cm / 100.0)))::DOUBLE"
_ORD = {
    "Age": _code_case("age_group", K.AGE_GROUP_CODES),
    "Diabetes": _code_case("diabetes", K.DIABETES_CODES, K.DIABETES_ALIASES),
    "GenHlth": _code_case("gen_health", K.GEN_HEALTH_CODES, K.GEN_HEALTH_ALIASES),
    "Education": _code_case("education_level", K.EDUCATION_CODES, K.EDUCATION_ALIASES),
    "Income": _code_case("income_level", K.INCOME_CODES),
}
_BASIC_RAW = {
    "HighBP": "CAST(high_bp AS INTEGER)", "HighChol": "CAST(high_chol AS INTEGER)",
    "CholCheck": "CAST(chol_check AS INTEGER)", "BMI": BMI_SQL, "Smoker": "CAST(smoker AS INTEGER)",
    "Stroke": "CAST(stroke AS INTEGER)", "Diabetes": _ORD["Diabetes"],
    "PhysActivity": "CAST(phys_activity AS INTEGER)", "Fruits": "CAST(fruits AS INTEGER)",
    "Veggies": "CAST(veggies AS INTEGER)", "HvyAlcoholConsump": "CAST(heavy_alcohol AS INTEGER)",
    "AnyHealthcare": "CAST(any_healthcare AS INTEGER)", "NoDocbcCost": "CAST(no_doc_because_cost AS INTEGER)",
    "GenHlth": _ORD["GenHlth"], "MentHlth": "CAST(mental_health_days AS INTEGER)",
    "PhysHlth": "CAST(phys_health_days AS INTEGER)", "DiffWalk": "CAST(diff_walk AS INTEGER)",
    "Sex": "CASE WHEN sex = 'Male' THEN 1 ELSE 0 END", "Age": _ORD["Age"],
    "Education": _ORD["Education"], "Income": _ORD["Income"],
}


def _zsql(c, src_col, src):
    return (f"(({c} - (SELECT avg({src_col}) FROM {src})) / (SELECT CASE WHEN stddev_pop({src_col}) = 0 "
            f"THEN 1 ELSE stddev_pop({src_col}) END FROM {src}))")


def _respond_sql(z: str) -> str:
    p = f"(1.0e0 / (1.0e0 + exp(-({z}))))"
    return (f"CASE WHEN {p} >= 0.5 THEN 1 ELSE 0 END AS prediction, "
            f"round(printf('%.4f', {p})::DOUBLE, 6) AS probability, "
            f"CASE WHEN {p} < 0.3 THEN 'Low' WHEN {p} < 0.6 THEN 'Medium' ELSE 'High' END AS risk_level")


# ------------------------------------------------------------ spark helpers

def _req_basic(spark, sf):
    return view(spark, sf, "requests_basic")


def _req_advanced(spark, sf):
    return view(spark, sf, "requests_advanced")


def _flat_errors(v):
    return v.select("row_id", (F.size(R.ERRORS) == 0).alias("is_valid"),
                    F.concat_ws("|", R.ERRORS).alias("errors"))


@register("validate_basic", RB + "SELECT row_id, errs = '' AS is_valid, errs AS errors FROM rv")
def validate_basic(spark, sf):
    return _flat_errors(R.validate(_req_basic(spark, sf), R.BASIC_SCHEMA))


@register("validate_advanced", WA + f"""
SELECT row_id, {_errors_sql(R.ADVANCED_SCHEMA)} = '' AS is_valid, {_errors_sql(R.ADVANCED_SCHEMA)} AS errors
FROM requests_advanced""")
def validate_advanced(spark, sf):
    return _flat_errors(R.validate(_req_advanced(spark, sf), R.ADVANCED_SCHEMA))


@register("validate_chat", f"""
SELECT conv_id, turn, concat_ws('|', CASE WHEN role IS NULL THEN 'role:missing' END,
  CASE WHEN role IS NOT NULL AND role NOT IN ('user', 'assistant') THEN 'role:enum' END,
  CASE WHEN text IS NULL THEN 'text:missing' END,
  CASE WHEN text IS NOT NULL AND length(text) < 1 THEN 'text:min_length' END) = '' AS is_valid,
 concat_ws('|', CASE WHEN role IS NULL THEN 'role:missing' END,
  CASE WHEN role IS NOT NULL AND role NOT IN ('user', 'assistant') THEN 'role:enum' END,
  CASE WHEN text IS NULL THEN 'text:missing' END,
  CASE WHEN text IS NOT NULL AND length(text) < 1 THEN 'text:min_length' END) AS errors
FROM conversations""")
def validate_chat(spark, sf):
    """PR21: chat turns against the message rules (role enumeration,
    non-empty text); system turns are not valid chat history."""
    from ..sources.tables import read_table
    v = R.validate(read_table(spark, sf, "conversations"), R.CHAT_TURN_SCHEMA)
    return v.select("conv_id", "turn", (F.size(R.ERRORS) == 0).alias("is_valid"),
                    F.concat_ws("|", R.ERRORS).alias("errors"))


CHAT_REQUESTS = """SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'basic' WHEN 1 THEN 'advanced' WHEN 2 THEN 'expert' END AS mode,
 CASE WHEN conv_id % 5 = 0 THEN '' ELSE max_by(text, turn) END AS message FROM {table} WHERE role = 'user' GROUP BY conv_id"""


@register("validate_chat_requests", f"""WITH req AS ({CHAT_REQUESTS.format(table='conversations')})
SELECT conv_id, concat_ws('|', CASE WHEN mode IS NULL THEN 'mode:missing' END,
  CASE WHEN mode NOT IN ('basic', 'advanced') THEN 'mode:enum' END, CASE WHEN message IS NULL THEN 'message:missing' END,
  CASE WHEN length(message) < 1 THEN 'message:min_length' END) AS errors FROM req""")
def validate_chat_requests(spark, sf):
    """PR21: chat requests (each conversation's last user turn under a made-up
    mode) against the request rules."""
    from ..sources.tables import read_table
    requests = spark.sql(CHAT_REQUESTS, table=read_table(spark, sf, "conversations"))
    return R.validate(requests, R.CHAT_SCHEMA).select("conv_id", F.concat_ws("|", R.ERRORS).alias("errors"))


@register("encode_ordinals", WB + "SELECT row_id, " + ", ".join(
    f"{(_ORD[c] if c != 'Diabetes' else _code_case('coalesce(diabetes, ' + _lit(K.DIABETES_CODES[0][0]) + ')', K.DIABETES_CODES, K.DIABETES_ALIASES))} AS {c}"
    for c in ["Age", "Diabetes", "GenHlth", "Education", "Income"]) + " FROM requests_basic")
def encode_ordinals(spark, sf):
    return SV.encode_ordinals(_req_basic(spark, sf))


@register("bmi", WB + f"SELECT row_id, round({BMI_SQL}, 6) AS BMI FROM requests_basic")
def bmi(spark, sf):
    from ..functions.exprs import py_round
    return rounded(_req_basic(spark, sf).select("row_id", py_round(SV.bmi(), 1).alias("BMI")))


_BASIC_SCALED = {c: (f"((({_BASIC_RAW[c]}) - m_{c}) / s_{c})" if c in K.BASIC_SCALE_COLS
                     else f"({_BASIC_RAW[c]})") for c in K.BASIC_FEATURES}


@register("serve_basic", RB + "SELECT row_id, " + _respond_sql(logit_sql(BASIC_SERVE_SCORER, _BASIC_SCALED))
          + " FROM ok")
def serve_basic(spark, sf):
    _, stats, _ = EN.prepare_basic(view(spark, sf, "survey_raw"))
    ok, _ = R.split_valid(_req_basic(spark, sf), R.BASIC_SCHEMA)
    return rounded(SV.respond(SV.to_model_space_basic(ok, stats), BASIC_SERVE_SCORER))


_ADV_RAW = {
    "age": "age", "chol": "chol", "fbs": "CAST(fbs AS INTEGER)", "thalch": "thalch",
    "exang": "CAST(exang AS INTEGER)", "oldpeak": "oldpeak", "ca": "coalesce(CAST(ca AS DOUBLE), -1.0)",
    "sex_Male": "CASE WHEN sex = 'Male' THEN 1 ELSE 0 END",
    "cp_atypical angina": "CASE WHEN cp = 'atypical angina' THEN 1 ELSE 0 END",
    "cp_non-anginal": "CASE WHEN cp = 'non-anginal' THEN 1 ELSE 0 END",
    "cp_typical angina": "CASE WHEN cp = 'typical angina' THEN 1 ELSE 0 END",
    "thal_normal": "CASE WHEN thal = 'normal' THEN 1 ELSE 0 END",
    "thal_reversable defect": "CASE WHEN thal = 'reversable defect' THEN 1 ELSE 0 END",
    "thal_unknown": "CASE WHEN thal IS NULL THEN 1 ELSE 0 END",
}
_ADV_SCALED = {c: (_zsql(f"({_ADV_RAW[c]})", c, "cc") if c in K.ADVANCED_NUMERIC_COLS else f"({_ADV_RAW[c]})")
               for c in K.ADVANCED_FEATURES}
_ADV_SCORER_SQL = logit_sql(ADVANCED_SERVE_SCORER, {f: _ADV_SCALED[f] for f in K.ADVANCED_FEATURES})
RA = CC + ", " + WA[len("WITH "):] + f""", av AS (SELECT *, {_errors_sql(R.ADVANCED_SCHEMA)} AS errs
 FROM requests_advanced), aok AS (SELECT * FROM av WHERE errs = '')
"""


@register("serve_advanced", RA + "SELECT row_id, " + _respond_sql(_ADV_SCORER_SQL) + " FROM aok")
def serve_advanced(spark, sf):
    _, stats, vocab, feats = EN.prepare_advanced(view(spark, sf, "clinical_raw"))
    ok, _ = R.split_valid(_req_advanced(spark, sf), R.ADVANCED_SCHEMA)
    rows = SV.to_model_space_advanced(ok, stats, vocab, feats)
    return rounded(SV.respond(rows, ADVANCED_SERVE_SCORER))


def _yn(c):
    return f"CASE WHEN {c} THEN '{K.YES_TEXT}' ELSE '{K.NO_TEXT}' END"


_BASIC_DISPLAY = {
    "HighBP": _yn("high_bp"), "HighChol": _yn("high_chol"), "CholCheck": _yn("chol_check"),
    "BMI": "printf('%.1f', weight_kg / ((height_cm / 100.0) * (height_cm / 100.0)))",
    "Smoker": _yn("smoker"), "Stroke": _yn("stroke"), "Diabetes": "diabetes",
    "PhysActivity": _yn("phys_activity"), "Fruits": _yn("fruits"), "Veggies": _yn("veggies"),
    "HvyAlcoholConsump": _yn("heavy_alcohol"), "AnyHealthcare": _yn("any_healthcare"),
    "NoDocbcCost": _yn("no_doc_because_cost"), "GenHlth": "gen_health",
    "MentHlth": "CAST(mental_health_days AS VARCHAR)", "PhysHlth": "CAST(phys_health_days AS VARCHAR)",
    "DiffWalk": _yn("diff_walk"), "Sex": f"CASE WHEN sex = 'Male' THEN '{K.MALE_TEXT}' ELSE '{K.FEMALE_TEXT}' END",
    "Age": "age_group", "Education": "education_level", "Income": "income_level",
}


@register("display_values", RB + "\nUNION ALL ".join(
    f"SELECT row_id, '{f}' AS feature, {e} AS value FROM ok" for f, e in _BASIC_DISPLAY.items()))
def display_values(spark, sf):
    ok, _ = R.split_valid(_req_basic(spark, sf), R.BASIC_SCHEMA)
    return SV.display_long(ok, SV.basic_display())


# ------------------------------------------------------------ full responses

def _contrib_sql(scorer, scaled: dict, features) -> str:
    """Oracle long table (row_id, idx, feature, contribution) in model space."""
    from .q_explain import left_out_sql
    return "\nUNION ALL ".join(
        f"SELECT row_id, {i} AS idx, '{f}' AS feature, "
        + (left_out_sql(scorer, scaled, f, "0.0e0") if f in scorer.features else "0.0e0") + " AS contribution FROM ok"
        for i, f in enumerate(features))


def _label_case(expr, labels):
    return "CASE " + expr + " " + " ".join(f"WHEN '{f}' THEN '{v}'" for f, v in labels) + f" ELSE {expr} END"


_EXPLAINED_SQL = RB + ", lg AS (" + _contrib_sql(BASIC_SERVE_SCORER, _BASIC_SCALED, K.BASIC_FEATURES) + """),
tk AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY floor(abs(contribution) * 1e12 + 0.5) DESC, idx) AS INTEGER) AS rank FROM lg)
SELECT tk.row_id, tk.rank, """ + _label_case("tk.feature", K.BASIC_FEATURE_LABELS) + """ AS feature,
 CASE tk.feature """ + " ".join(f"WHEN '{f}' THEN {e}" for f, e in _BASIC_DISPLAY.items()) + """ END AS value,
 (round(printf('%.4f', tk.contribution)::DOUBLE, 6) + 0.0) AS contribution
FROM tk JOIN ok ON ok.row_id = tk.row_id WHERE tk.rank <= 8"""


@register("serve_explained_basic", _EXPLAINED_SQL)
def serve_explained_basic(spark, sf):
    """ML7 + EX1-EX3 for requests: the top-8 contributions of every valid
    request in model space (baseline 0), with display labels and values."""
    from ..operators import explain as EX
    _, stats, _ = EN.prepare_basic(view(spark, sf, "survey_raw"))
    ok, _ = R.split_valid(_req_basic(spark, sf), R.BASIC_SCHEMA)
    # display texts travel as one struct (request and feature names collide
    # case-insensitively: sex / Sex)
    disp = SV.basic_display()
    ok = ok.withColumn("_disp", F.struct(*[e.alias(f) for f, e in disp.items()]))
    rows = SV.to_model_space_basic(ok, stats, keep=("row_id", "_disp"))
    t = EX.topk_array(rows, BASIC_SERVE_SCORER, K.BASIC_FEATURES, {}, ["row_id", "_disp"])
    out = EX.response_rows(t, "row_id", "t", K.BASIC_FEATURE_LABELS,
                           {f: F.col("_disp")[f] for f in disp})
    return rounded(out.drop("n_items"))


def _adv_display_sql() -> dict:
    def yn(cond):
        return f"CASE WHEN {cond} THEN '{K.YES_TEXT}' ELSE '{K.NO_TEXT}' END"
    return {
        "age": "CAST(age AS VARCHAR)", "chol": "CAST(chol AS VARCHAR) || ' mg/dl'",
        "thalch": "CAST(thalch AS VARCHAR)", "oldpeak": "CAST(oldpeak AS VARCHAR)",
        "ca": f"coalesce(CAST(ca AS VARCHAR), '{K.NO_RESULT_TEXT}')",
        "fbs": yn("fbs"), "exang": yn("exang"), "sex_Male": yn("sex = 'Male'"),
        "cp_atypical angina": yn("cp = 'atypical angina'"), "cp_non-anginal": yn("cp = 'non-anginal'"),
        "cp_typical angina": yn("cp = 'typical angina'"), "thal_normal": yn("thal = 'normal'"),
        "thal_reversable defect": yn("thal = 'reversable defect'"), "thal_unknown": yn("thal IS NULL"),
    }


_SA = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}"
                for c in K.ADVANCED_NUMERIC_COLS)
_ADV_SCALED_M = {c: (f"((({_ADV_RAW[c]}) - m_{c}) / s_{c})" if c in K.ADVANCED_NUMERIC_COLS else f"({_ADV_RAW[c]})")
                 for c in K.ADVANCED_FEATURES}
_EXPLAINED_ADV_SQL = (RA.rstrip() + f""",
sa AS MATERIALIZED (SELECT {_SA} FROM cc),
ok AS (SELECT aok.*, sa.* FROM aok CROSS JOIN sa),
lg AS ({_contrib_sql(ADVANCED_SERVE_SCORER, _ADV_SCALED_M, K.ADVANCED_FEATURES)}),
tk AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY floor(abs(contribution) * 1e12 + 0.5) DESC, idx) AS INTEGER)
   AS rank FROM lg)
SELECT tk.row_id, tk.rank, {_label_case("tk.feature", K.ADVANCED_FEATURE_LABELS)} AS feature,
 CASE tk.feature {" ".join(f"WHEN '{f}' THEN {e}" for f, e in _adv_display_sql().items())} END AS value,
 (round(printf('%.4f', tk.contribution)::DOUBLE, 6) + 0.0) AS contribution
FROM tk JOIN ok ON ok.row_id = tk.row_id WHERE tk.rank <= 8""")


@register("serve_explained_advanced", _EXPLAINED_ADV_SQL)
def serve_explained_advanced(spark, sf):
    """ML7 + EX1-EX3 (advanced): top-8 contributions of every valid request
    in model space with the advanced labels and display values (PR18, PR19)."""
    from ..operators import explain as EX
    _, stats, vocab, feats = EN.prepare_advanced(view(spark, sf, "clinical_raw"))
    ok, _ = R.split_valid(_req_advanced(spark, sf), R.ADVANCED_SCHEMA)
    disp = SV.advanced_display()
    ok = ok.withColumn("_disp", F.struct(*[e.alias(f) for f, e in disp.items()]))
    rows = SV.to_model_space_advanced(ok, stats, vocab, feats, keep=("row_id", "_disp"))
    t = EX.topk_array(rows, ADVANCED_SERVE_SCORER, feats, {}, ["row_id", "_disp"])
    out = EX.response_rows(t, "row_id", "t", K.ADVANCED_FEATURE_LABELS, {f: F.col("_disp")[f] for f in disp})
    return rounded(out.drop("n_items"))
