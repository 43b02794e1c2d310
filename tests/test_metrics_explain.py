"""Metrics, explanations and serving rules."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from riskframe import constants as K
from riskframe.functions import rules as R
from riskframe.functions.exprs import argmax_decision, py_round, py_signed_percent, risk_level, serve_decision
from riskframe.operators import explain as EX
from riskframe.operators import metrics as ME
from riskframe.operators import serve as SV
from riskframe.operators.models import LinearScorer, build_model


def _auc_bruteforce(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_perfect_constant_and_bruteforce(spark):
    perfect = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)], "probability double, target int")
    assert ME.roc_auc(perfect).first()["roc_auc"] == 1.0
    const = spark.createDataFrame([(0.5, 0), (0.5, 1), (0.5, 0), (0.5, 1)], "probability double, target int")
    assert ME.roc_auc(const).first()["roc_auc"] == 0.5
    rnd = random.Random(7)
    rows = [(round(rnd.random(), 2), int(rnd.random() < 0.3)) for _ in range(600)]   # many ties
    df = spark.createDataFrame(rows, "probability double, target int").repartition(5)
    assert ME.roc_auc(df, buckets=8).first()["roc_auc"] == pytest.approx(_auc_bruteforce(rows), abs=1e-12)


def test_grouped_auc(spark):
    rows = [(g, float(i), int(i % 3 == 0)) for g in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, probability double, target int")
    got = {r.g: r.roc_auc for r in ME.roc_auc(df, group_cols=["g"]).collect()}
    for g in range(3):
        assert got[g] == pytest.approx(_auc_bruteforce([(s, y) for gg, s, y in rows if gg == g]))


def test_classification_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 0)], "target int, prediction int")
    rep = {r.label: r for r in ME.classification_report(df).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0 and rep["1"].f1_score == 0.0
    assert rep["accuracy"].f1_score == pytest.approx(2 / 3) and rep["accuracy"].support == 3
    assert rep["weighted avg"].recall == pytest.approx(2 / 3)


def test_decision_rules_at_half(spark):
    df = spark.createDataFrame([(0.5,), (0.29996,), (0.3,), (0.6,)], "p double")
    r = df.select(serve_decision("p").alias("s"), argmax_decision("p").alias("b"),
                  risk_level("p").alias("risk"), py_round("p", 4).alias("shown")).collect()
    assert (r[0].s, r[0].b) == (1, 0)                        # p = 0.5: serving 1, batch 0
    assert (r[1].risk, r[1].shown) == ("Low", 0.3)           # bucket before rounding
    assert [x.risk for x in r[2:]] == ["Medium", "High"]


def test_python_rounding_and_percent(spark):
    df = spark.createDataFrame([(24.25,), (2.675,), (0.12345,), (-0.0004,)], "x double")
    r = df.select(py_round("x", 1).alias("a"), py_round("x", 2).alias("b"), py_round("x", 4).alias("c"),
                  py_signed_percent("x").alias("p")).collect()
    assert r[0].a == round(24.25, 1) and r[1].b == round(2.675, 2) and r[2].c == round(0.12345, 4)
    assert [x.p for x in r] == [f"{v:+.1%}" for v in (24.25, 2.675, 0.12345, -0.0004)]


def test_top_contributors_reference_case(spark):
    df = spark.createDataFrame([(1,)], "row_id int")
    arr = F.array(*[F.struct((-F.abs(F.lit(v))).alias("neg_abs"), F.lit(i).alias("idx"),
                             F.lit(f).alias("feature"), F.lit(v).alias("contribution"))
                    for i, (f, v) in enumerate([("a", 0.1), ("b", -0.5), ("c", 0.05), ("d", -0.02)])])
    top = df.select(EX.top_k(arr, 2).alias("t")).first()["t"]
    assert [e.feature for e in top] == ["b", "a"]


def test_ablation_zero_weight_and_ties(spark):
    scorer = LinearScorer(-1.0, (("x", 0.5, None), ("y", 0.5, None)))
    df = spark.createDataFrame([(1, 1.0, 1.0, 9.0), (2, 0.0, 2.0, 3.0)], "row_id int, x double, y double, z double")
    long = {(r.row_id, r.feature): r.contribution
            for r in EX.ablation_linear(df, scorer, ["x", "y", "z"], {"x": 0.0, "y": 0.0}).collect()}
    assert long[(1, "z")] == 0.0 and long[(2, "z")] == 0.0   # unused feature
    assert long[(2, "x")] == 0.0                              # value already at baseline
    assert long[(1, "x")] == long[(1, "y")] > 0               # exact tie
    top = EX.topk_linear(df, scorer, ["x", "y", "z"], {"x": 0.0, "y": 0.0}, k=2).filter("row_id = 1")
    assert [r.feature for r in top.orderBy("rank").collect()] == ["x", "y"]   # tie keeps feature order


def test_ablation_model_path_matches_manual(spark):
    from riskframe.operators.models import assemble
    rows = [(i, float(i % 7), float((i * 3) % 5), int(i % 7 > 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id int, a double, b double, target int")
    model = build_model("logistic_regression", {"C": 1.0}).fit(assemble(df, ["a", "b"]))
    got = {(r.row_id, r.feature): r.contribution
           for r in EX.ablation_model(model, df, ["a", "b"], {"a": 0.0, "b": 0.0}).collect()}
    import math
    w, b0 = model.coefficients.toArray(), model.intercept

    def p(a, b):
        return 1 / (1 + math.exp(-(b0 + w[0] * a + w[1] * b)))
    for rid, a, b, _ in rows[:20]:
        assert got[(rid, "a")] == pytest.approx(p(a, b) - p(0.0, b), abs=1e-9)
        assert got[(rid, "b")] == pytest.approx(p(a, b) - p(a, 0.0), abs=1e-9)


def _basic_example(spark, **over):
    rec = dict(row_id=1, age_group="50-54", sex="Male", height_cm=170.0, weight_kg=85.0, high_bp=True,
               high_chol=True, chol_check=True, diabetes="Không", stroke=False, smoker=True,
               phys_activity=False, fruits=False, veggies=True, heavy_alcohol=False, gen_health="Trung bình",
               mental_health_days=5, phys_health_days=10, diff_walk=True, any_healthcare=True,
               no_doc_because_cost=False, education_level="Tốt nghiệp THPT", income_level="25-35k")
    rec.update(over)
    from riskframe.sources.io import BASIC_REQUEST_SCHEMA
    return spark.createDataFrame([tuple(rec.get(f.name) for f in BASIC_REQUEST_SCHEMA)], BASIC_REQUEST_SCHEMA)


def test_validation_rules(spark):
    ok = R.validate(_basic_example(spark), R.BASIC_SCHEMA).first()
    assert ok.errors == []
    bad = R.validate(_basic_example(spark, age_group="999", sex=None, phys_health_days=31), R.BASIC_SCHEMA).first()
    assert sorted(bad.errors) == ["age_group:enum", "phys_health_days:range", "sex:missing"]
    # defaults only when absent
    d = R.validate(_basic_example(spark, chol_check=None, diabetes=None), R.BASIC_SCHEMA).first()
    assert d.chol_check is True and d.diabetes == "Không" and d.errors == []


def test_advanced_optional_fields_accepted(spark):
    from riskframe.sources.io import ADVANCED_REQUEST_SCHEMA
    df = spark.createDataFrame([(1, 58, "Male", "asymptomatic", 245.0, False, 140.0, True, 2.1, None, None)],
                               ADVANCED_REQUEST_SCHEMA)
    ok, bad = R.split_valid(df, R.ADVANCED_SCHEMA)
    assert ok.count() == 1 and bad.count() == 0
    row = SV.advanced_model_row(ok).first()
    assert row.ca == -1.0 and row.thal == "unknown"


def test_basic_model_row_example(spark):
    row = SV.basic_model_row(R.validate(_basic_example(spark), R.BASIC_SCHEMA)).first()
    assert row.BMI == 29.4 and row.Age == 7 and row.Income == 5 and row.GenHlth == 4 and row.Sex == 1
    disp = {r.feature: r.value for r in SV.display_long(_basic_example(spark), SV.basic_display()).collect()}
    assert disp["BMI"] == "29.4" and disp["HighBP"] == K.YES_TEXT and disp["Sex"] == K.MALE_TEXT


def test_stored_vocabulary_keeps_dummies_for_one_record(spark):
    from riskframe.sources.io import ADVANCED_REQUEST_SCHEMA
    vocab = {"sex": ["Female", "Male"], "cp": ["asymptomatic", "atypical angina", "non-anginal", "typical angina"],
             "thal": ["fixed defect", "normal", "reversable defect", "unknown"]}
    stats = {c: (0.0, 1.0) for c in K.ADVANCED_NUMERIC_COLS}
    df = spark.createDataFrame([(1, 58, "Male", "typical angina", 245.0, False, 140.0, True, 2.1, 1, "normal")],
                               ADVANCED_REQUEST_SCHEMA)
    row = SV.to_model_space_advanced(df, stats, vocab).first()
    assert row["sex_Male"] == 1 and row["cp_typical angina"] == 1 and row["thal_normal"] == 1
