"""Queries EX1-EX4: ablation explanations of the fixed survey scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import col, literal_map, py_fixed, yes_no
from ..operators import encode as EN
from ..operators import explain as EX
from ..operators import prep as PR
from ..operators.models import SURVEY_TEST_SCORER, LinearScorer
from ..sources.fixtures import oracle_views, view
from .registry import register, rounded

SCORER = SURVEY_TEST_SCORER
FEATURES = K.BASIC_FEATURES


def _clean(spark, sf):
    return PR.clean_survey(view(spark, sf, "survey_raw"))


def survey_baseline(clean) -> dict[str, float]:
    """0 after scaling: the column mean for scaled columns, 0 for binaries."""
    stats = EN.fit_scaler(clean, K.BASIC_SCALE_COLS)
    return {f: (stats[f][0] if f in stats else 0.0) for f in FEATURES}


_REVERSE = {
    "Age": K.AGE_GROUP_CODES, "Diabetes": K.DIABETES_CODES, "GenHlth": K.GEN_HEALTH_CODES,
    "Education": K.EDUCATION_CODES, "Income": K.INCOME_CODES,
}


def survey_display() -> dict:
    """Display text per feature for a survey model row (codes shown with the
    request vocabulary, binaries as yes/no)."""
    out = {}
    for f in FEATURES:
        if f == "Sex":
            out[f] = F.when(col(f) == 1, F.lit(K.MALE_TEXT)).otherwise(F.lit(K.FEMALE_TEXT))
        elif f in K.BASIC_BINARY_COLS:
            out[f] = yes_no(col(f) == 1)
        elif f == "BMI":
            out[f] = py_fixed(col(f), 1)
        elif f in _REVERSE:
            out[f] = literal_map([(code, key) for key, code in _REVERSE[f]])[col(f).cast("int")]
        else:
            out[f] = col(f).cast("int").cast("string")
    return out


def _topk_array(spark, sf):
    clean = _clean(spark, sf)
    return EX.topk_array(clean, SCORER, FEATURES, survey_baseline(clean), ["row_id"] + FEATURES)


def _responses(spark, sf):
    t = _topk_array(spark, sf)
    return EX.response_rows(t, "row_id", "t", K.BASIC_FEATURE_LABELS, survey_display())


# ---------------------------------------------------------------- oracle SQL

def _num(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def logit_sql(scorer: LinearScorer, replace: dict | None = None) -> str:
    replace = replace or {}
    s = _num(scorer.intercept)
    for name, w, c in scorer.terms:
        x = replace.get(name, name)
        t = f"({x} - {_num(c)})" if c is not None else x
        s += f" {'-' if w < 0 else '+'} {_num(abs(w))}*{t}"
    return s


def _prob(z: str) -> str:
    return f"1.0e0 / (1.0e0 + exp(-({z})))"


def left_out_sql(scorer: LinearScorer, values: dict, feature: str, base: str) -> str:
    """Contribution of one feature: the sums left of its term and right of it,
    with the baseline in between; 0 where the value is the baseline."""
    def term(j: int, x: str | None = None) -> str:
        name, w, c = scorer.terms[j]
        x = x or values.get(name, name)
        t = f"{_num(abs(w))}*" + (f"(({x}) - {_num(c)})" if c is not None else f"({x})")
        return f"(-({t}))" if w < 0 else f"({t})"

    at = scorer.features.index(feature)
    left, right = _num(scorer.intercept), "0.0e0"
    for j in range(at):
        left = f"({left} + {term(j)})"
    for j in range(len(scorer.terms) - 1, at, -1):
        right = f"({right} + {term(j)})"
    whole = left
    for j in range(at, len(scorer.terms)):
        whole = f"({whole} + {term(j)})"
    return (f"CASE WHEN {term(at)} = {term(at, base)} THEN 0.0e0 ELSE {_prob(whole)} - "
            f"{_prob(f'(({left} + {term(at, base)}) + {right})')} END")


WS = oracle_views("survey_raw")
_BASE = {f: (f"(SELECT avg({f}) FROM survey_raw)" if f in K.BASIC_SCALE_COLS else "0.0e0")
         for f in FEATURES}
_LONG = WS + ", lg AS (" + "\nUNION ALL ".join(
    f"SELECT row_id, {i} AS idx, '{f}' AS feature, "
    + (left_out_sql(SCORER, {}, f, _BASE[f]) if f in SCORER.features else "0.0e0") + " AS contribution FROM survey_raw"
    for i, f in enumerate(FEATURES)) + ")\n"
_TOPK = _LONG + """, tk AS (SELECT row_id, idx, feature, contribution,
 CAST(row_number() OVER (PARTITION BY row_id ORDER BY floor(abs(contribution) * 1e12 + 0.5) DESC, idx) AS INTEGER) AS rank FROM lg)
"""


def _case(expr: str, pairs, default: str = "NULL") -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {a} THEN '{b}'" for a, b in pairs) + f" ELSE {default} END"


def _display_sql() -> str:
    parts = []
    for f in FEATURES:
        if f == "Sex":
            e = f"CASE WHEN s.Sex = 1 THEN '{K.MALE_TEXT}' ELSE '{K.FEMALE_TEXT}' END"
        elif f in K.BASIC_BINARY_COLS:
            e = f"CASE WHEN s.{f} = 1 THEN '{K.YES_TEXT}' ELSE '{K.NO_TEXT}' END"
        elif f == "BMI":
            e = "printf('%.1f', s.BMI)"
        elif f in _REVERSE:
            e = _case(f"CAST(s.{f} AS INTEGER)", [(code, key) for key, code in _REVERSE[f]])
        else:
            e = f"CAST(CAST(s.{f} AS INTEGER) AS VARCHAR)"
        parts.append(f"WHEN '{f}' THEN {e}")
    return "CASE tk.feature " + " ".join(parts) + " END"


_LABEL = _case("tk.feature", [(f"'{f}'", lbl) for f, lbl in K.BASIC_FEATURE_LABELS], "tk.feature")
_RESP = _TOPK + f""", rs AS (SELECT tk.row_id, tk.rank, {_LABEL} AS feature, {_display_sql()} AS value,
 printf('%.4f', tk.contribution)::DOUBLE AS contribution
 FROM tk JOIN survey_raw s ON s.row_id = tk.row_id WHERE tk.rank <= 8)
"""


@register("explain_ablation", _LONG + "SELECT row_id, feature, (round(contribution, 6) + 0.0) AS contribution FROM lg")
def explain_ablation(spark, sf):
    clean = _clean(spark, sf)
    return rounded(EX.ablation_linear(clean, SCORER, FEATURES, survey_baseline(clean)))


@register("explain_topk", _TOPK + """SELECT row_id, rank, feature, (round(contribution, 6) + 0.0) AS contribution
FROM tk WHERE rank <= 8""")
def explain_topk(spark, sf):
    t = _topk_array(spark, sf)
    return rounded(EX.explode_ranked(t, "row_id", "t").drop("idx", "neg_abs"))


@register("explain_response", _RESP + """SELECT row_id, rank, feature, value,
 (round(contribution, 6) + 0.0) AS contribution FROM rs""")
def explain_response(spark, sf):
    return rounded(_responses(spark, sf).drop("n_items"))


@register("explain_chart", _RESP + """, ct AS (SELECT row_id, CAST(9 - rank - (8 - (SELECT count(*) FROM rs r2
   WHERE r2.row_id = rs.row_id)) AS INTEGER) AS position, feature || ' (' || value || ')' AS text, contribution,
 CASE WHEN starts_with(printf('%.1f', contribution * 100.0), '-') THEN '' ELSE '+' END
   || printf('%.1f', contribution * 100.0) || '%' AS percent_text,
 CASE WHEN contribution > 0 THEN 'increase' ELSE 'decrease' END AS direction FROM rs)
SELECT row_id, position, text, (round(contribution, 6) + 0.0) AS contribution, percent_text, direction FROM ct""")
def explain_chart(spark, sf):
    return rounded(EX.chart_rows(_responses(spark, sf)))
