"""Request tables -> model rows -> scored responses (PR10-PR19, EN6-EN7, ML7).

A "request" is one row of a table or stream (typed by the request schema).
Everything here is a projection over requests plus literals fitted
elsewhere (scaler stats, vocabularies): map-only, so scoring a stream or a
billion-row table is one narrow stage.

Deliberate difference to the reference's online path: the advanced encoder
uses the STORED vocabulary. Encoding one request on its own with drop-first
removes every dummy (one category per column, and it is the first), so sex,
cp and thal could never reach the model; here they do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import col, literal_map, py_fixed, py_round, risk_level, serve_decision, yes_no
from .encode import onehot, scale
from .models import LinearScorer
from .prep import align_features


def _codes(*tables) -> Column:
    pairs = []
    for t in tables:
        pairs.extend(t)
    return literal_map(pairs)


def age_map() -> Column:
    return _codes(K.AGE_GROUP_CODES)


def diabetes_map() -> Column:
    return _codes(K.DIABETES_CODES, K.DIABETES_ALIASES)


def gen_health_map() -> Column:
    return _codes(K.GEN_HEALTH_CODES, K.GEN_HEALTH_ALIASES)


def education_map() -> Column:
    return _codes(K.EDUCATION_CODES, K.EDUCATION_ALIASES)


def income_map() -> Column:
    return _codes(K.INCOME_CODES)


def bmi(weight: str | Column = "weight_kg", height: str | Column = "height_cm") -> Column:
    """PR13: kg / (cm/100)^2, unrounded."""
    h = col(height) / F.lit(100.0)
    return col(weight) / (h * h)


def encode_ordinals(df: DataFrame) -> DataFrame:
    """PR10: dictionary codes (NULL for an unknown key, which validation
    rejects) for age group, diabetes, general health, education, income."""
    return df.select(
        col("row_id"),
        age_map()[col("age_group")].alias("Age"),
        diabetes_map()[F.coalesce(col("diabetes"), F.lit(K.DIABETES_CODES[0][0]))].alias("Diabetes"),
        gen_health_map()[col("gen_health")].alias("GenHlth"),
        education_map()[col("education_level")].alias("Education"),
        income_map()[col("income_level")].alias("Income"))


def basic_model_row(req: DataFrame, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """EN6 before scaling: request (defaults applied) -> 21 raw features."""
    b = lambda c: col(c).cast("int")
    return req.select(
        *[col(k) for k in keep],
        b("high_bp").alias("HighBP"), b("high_chol").alias("HighChol"),
        b("chol_check").alias("CholCheck"),
        py_round(bmi(), 1).alias("BMI"),
        b("smoker").alias("Smoker"), b("stroke").alias("Stroke"),
        diabetes_map()[col("diabetes")].alias("Diabetes"),
        b("phys_activity").alias("PhysActivity"), b("fruits").alias("Fruits"),
        b("veggies").alias("Veggies"), b("heavy_alcohol").alias("HvyAlcoholConsump"),
        b("any_healthcare").alias("AnyHealthcare"), b("no_doc_because_cost").alias("NoDocbcCost"),
        gen_health_map()[col("gen_health")].alias("GenHlth"),
        col("mental_health_days").cast("int").alias("MentHlth"),
        col("phys_health_days").cast("int").alias("PhysHlth"),
        b("diff_walk").alias("DiffWalk"),
        (col("sex") == F.lit("Male")).cast("int").alias("Sex"),
        age_map()[col("age_group")].alias("Age"),
        education_map()[col("education_level")].alias("Education"),
        income_map()[col("income_level")].alias("Income"))


def advanced_model_row(req: DataFrame, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """EN7 before encoding: serving defaults ca -> -1, thal -> 'unknown'
    (the same constants the training fill uses), booleans -> int."""
    return req.select(
        *[col(k) for k in keep],
        col("age"), col("sex"), col("cp"), col("chol").cast("double").alias("chol"),
        col("fbs").cast("int").alias("fbs"), col("thalch").cast("double").alias("thalch"),
        col("exang").cast("int").alias("exang"), col("oldpeak").cast("double").alias("oldpeak"),
        F.coalesce(col("ca").cast("double"), F.lit(float(K.MISSING_NUMBER))).alias("ca"),
        F.coalesce(col("thal"), F.lit(K.UNKNOWN_TEXT)).alias("thal"))


def to_model_space_basic(req: DataFrame, stats: Mapping[str, tuple[float, float]],
                         keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """EN6: raw features -> stored scaling -> stored column order (PR8)."""
    row = scale(basic_model_row(req, keep), stats)
    return align_features(row, K.BASIC_FEATURES, keep=list(keep))


def to_model_space_advanced(req: DataFrame, stats: Mapping[str, tuple[float, float]],
                            vocab: Mapping[str, Sequence], features: Sequence[str] = K.ADVANCED_FEATURES,
                            keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """EN7: defaults -> one-hot with the stored vocabulary -> stored scaling
    -> stored column order (absent dummies become 0)."""
    row = onehot(advanced_model_row(req, keep), vocab)
    row = scale(row, stats)
    return align_features(row, features, keep=list(keep))


def respond(model_rows: DataFrame, scorer: LinearScorer, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """ML7 (linear): prediction (p >= 0.5), probability rounded to 4 and the
    risk level of the UNROUNDED probability."""
    p = scorer.probability()
    return model_rows.select(
        *[col(k) for k in keep], serve_decision(p).alias("prediction"),
        py_round(p, K.PROBABILITY_DECIMALS).alias("probability"), risk_level(p).alias("risk_level"))


def basic_display(req: DataFrame | None = None) -> dict[str, Column]:
    """PR19 (basic): display text per model feature, from the request."""
    return {
        "HighBP": yes_no("high_bp"), "HighChol": yes_no("high_chol"),
        "CholCheck": yes_no("chol_check"), "BMI": py_fixed(bmi(), 1),
        "Smoker": yes_no("smoker"), "Stroke": yes_no("stroke"), "Diabetes": col("diabetes"),
        "PhysActivity": yes_no("phys_activity"), "Fruits": yes_no("fruits"),
        "Veggies": yes_no("veggies"), "HvyAlcoholConsump": yes_no("heavy_alcohol"),
        "AnyHealthcare": yes_no("any_healthcare"), "NoDocbcCost": yes_no("no_doc_because_cost"),
        "GenHlth": col("gen_health"), "MentHlth": col("mental_health_days").cast("string"),
        "PhysHlth": col("phys_health_days").cast("string"), "DiffWalk": yes_no("diff_walk"),
        "Sex": F.when(col("sex") == "Male", F.lit(K.MALE_TEXT)).otherwise(F.lit(K.FEMALE_TEXT)),
        "Age": col("age_group"), "Education": col("education_level"), "Income": col("income_level"),
    }


def advanced_display() -> dict[str, Column]:
    """PR19 (advanced): display text per model feature, from the request."""
    def flag(cond):
        return F.when(cond, F.lit(K.YES_TEXT)).otherwise(F.lit(K.NO_TEXT))
    return {
        "age": col("age").cast("string"),
        "chol": F.concat(col("chol").cast("string"), F.lit(K.CHOL_UNIT_SUFFIX)),
        "thalch": col("thalch").cast("string"), "oldpeak": col("oldpeak").cast("string"),
        "ca": F.coalesce(col("ca").cast("string"), F.lit(K.NO_RESULT_TEXT)),
        "fbs": yes_no("fbs"), "exang": yes_no("exang"),
        "sex_Male": flag(col("sex") == "Male"),
        "cp_atypical angina": flag(col("cp") == "atypical angina"),
        "cp_non-anginal": flag(col("cp") == "non-anginal"),
        "cp_typical angina": flag(col("cp") == "typical angina"),
        "thal_normal": flag(col("thal") == "normal"),
        "thal_reversable defect": flag(col("thal") == "reversable defect"),
        "thal_unknown": flag(col("thal").isNull()),
    }


def display_long(req: DataFrame, display: Mapping[str, Column], key: str = "row_id") -> DataFrame:
    """Display values as rows ``(key, feature, value)`` (one explode)."""
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), v.cast("string").alias("value"))
                    for f, v in display.items()])
    return req.select(col(key), F.explode(arr).alias("e")).select(col(key), "e.feature", "e.value")


def respond_model(model, model_rows: DataFrame, features: Sequence[str],
                  keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """ML7 with any fitted Spark ML classifier: one ``transform``; serving
    rule p >= 0.5 (unlike batch argmax), probability rounded to 4, risk
    level from the unrounded probability."""
    from pyspark.ml.functions import vector_to_array

    from ..functions.sizing import dealt
    from .models import assemble

    if not model_rows.isStreaming:      # a forest costs much a row: equal parts, whatever the files
        model_rows = dealt(model_rows, model_rows.count())
    scored = model.transform(assemble(model_rows, features, model.getFeaturesCol()))
    p = vector_to_array(F.col(model.getProbabilityCol()))[1]
    return scored.select(*[col(k) for k in keep], serve_decision(p).alias("prediction"),
                         py_round(p, K.PROBABILITY_DECIMALS).alias("probability"),
                         risk_level(p).alias("risk_level"))


def explain_requests_model(model, requests: DataFrame, model_rows: DataFrame, features: Sequence[str],
                           labels, display: Mapping[str, Column], key: str = "row_id",
                           k: int = K.TOP_CONTRIBUTORS) -> DataFrame:
    """ML7 + EX1-EX3 with a fitted Spark ML model: top-k contributions of
    every request as ``(key, rank, feature (label), value, contribution)``.

    Ablation runs through ONE model transform over the expanded rows; the
    display texts are packed into one struct per request and joined back
    on the key after the top-k (k rows per request)."""
    from .explain import ablation_model, topk_from_long

    long = ablation_model(model, model_rows, features, {f: 0.0 for f in features}, key=key)
    top = topk_from_long(long, key=key, k=k)
    disp = requests.select(col(key), F.struct(*[e.cast("string").alias(f) for f, e in display.items()])
                           .alias("_disp"))
    label_map = literal_map(list(labels.items()) if isinstance(labels, Mapping) else labels)
    value = None
    for f in display:
        value = (F.when(F.col("feature") == f, F.col("_disp")[f]) if value is None
                 else value.when(F.col("feature") == f, F.col("_disp")[f]))
    return (top.join(disp, on=key, how="left")
            .select(col(key), "rank", F.coalesce(label_map[F.col("feature")], F.col("feature")).alias("feature"),
                    F.coalesce(value, F.lit("")).alias("value"),
                    py_round(F.col("contribution"), K.PROBABILITY_DECIMALS).alias("contribution")))
