"""The reference's own test cases, re-expressed on tables."""

import os

from pyspark.sql import functions as F

from riskframe import constants as K
from riskframe.functions import rules as R
from riskframe.operators import encode as EN
from riskframe.operators import explain as EX
from riskframe.operators import serve as SV
from riskframe.operators import training as TR
from riskframe.operators import usage as US
from riskframe.operators.models import BASIC_SERVE_SCORER
from riskframe.sources import io as IO
from riskframe.sources.fixtures import view

from .conftest import SF_SMALL

ADVANCED_EXAMPLE = (1, 58, "Male", "asymptomatic", 245.0, False, 140.0, True, 2.1, 1, "reversable defect")


def test_forest_ablation_on_the_clinical_example(spark):
    feats_df, stats, vocab, feats = EN.prepare_advanced(view(spark, SF_SMALL, "clinical_raw"))
    model = TR.fit(feats_df, feats, "random_forest", {"n_estimators": 30, "max_depth": 5})
    req = spark.createDataFrame([ADVANCED_EXAMPLE], IO.ADVANCED_REQUEST_SCHEMA)
    row = SV.to_model_space_advanced(req, stats, vocab, feats)
    long = EX.ablation_model(model, row, feats, {f: 0.0 for f in feats}, key="row_id")
    contrib = {r.feature: r.contribution for r in long.collect()}
    assert "exang" in contrib and len(contrib) == 14
    top = [r.contribution for r in EX.topk_from_long(long.withColumn("idx", F.lit(0)), "row_id", 3)
           .orderBy("rank").collect()]
    assert len(top) == 3 and [abs(v) for v in top] == sorted((abs(v) for v in top), reverse=True)


def test_predict_then_usage_summary(spark, tmp_dir):
    from .test_metrics_explain import _basic_example
    stats = {c: (0.0, 1.0) for c in K.BASIC_SCALE_COLS}
    ok, _ = R.split_valid(_basic_example(spark), R.BASIC_SCHEMA)
    resp = SV.respond(SV.to_model_space_basic(ok, stats), BASIC_SERVE_SCORER).first()
    assert resp.prediction in (0, 1) and 0.0 <= resp.probability <= 1.0 and resp.risk_level in K.RISK_LEVELS
    log_path = os.path.join(tmp_dir, "log")
    scored = SV.respond(SV.to_model_space_basic(ok, stats), BASIC_SERVE_SCORER)
    assert IO.append_prediction_log(scored, log_path, mode="basic")
    s = US.summary(IO.read_prediction_log(spark, log_path)).first()
    assert s.total_predictions >= 1 and s.by_mode == {"basic": 1}
    assert sum(s.by_risk_level.values()) == 1 and len(s.by_day) == 1


def test_patient_summaries_and_system_prompt(spark):
    from riskframe.operators import prompts as PM

    from .test_metrics_explain import _basic_example
    basic = _basic_example(spark).select(PM.summary(R.BASIC_SCHEMA).alias("s")).first().s.split("\n")
    assert [x.split(": ")[0] for x in basic] == [f.name for f in R.BASIC_SCHEMA]
    assert "height_cm: 170.0" in basic and "high_bp: yes" in basic
    words = PM.Wording(captions={"chol": "cholesterol"}, values={"true": "ja", "false": "nein"}, absent="-",
                       modes={"advanced": "long form"}, decisions={1: "flagged"}, risks={"High": "red"})
    adv = spark.createDataFrame([(*ADVANCED_EXAMPLE[:-1], None)], IO.ADVANCED_REQUEST_SCHEMA)
    text = PM.summary(R.ADVANCED_SCHEMA, words)
    summary = adv.select(text.alias("s")).first().s
    assert len(summary.split("\n")) == len(R.ADVANCED_SCHEMA) and "cholesterol: 245.0" in summary and "thal: -" in summary
    assert "fbs: ja" in summary or "fbs: nein" in summary
    prompt = adv.select(PM.system_prompt(F.lit("advanced"), text, F.lit(1), F.lit(0.7733),
                                         F.lit("High"), F.lit(""), words).alias("p")).first().p
    assert all(x in prompt for x in ("77.3%", summary, "long form", "flagged", "level red"))


def test_forest_serving_on_a_request_stream(spark, tmp_dir):
    import json

    from riskframe.streaming import score_stream as SS
    feats_df, stats, vocab, feats = EN.prepare_advanced(view(spark, SF_SMALL, "clinical_raw"))
    model = TR.fit(feats_df, feats, "random_forest", {"n_estimators": 20, "max_depth": 4})
    src = os.path.join(tmp_dir, "req")
    os.makedirs(src)
    keys = [f.name for f in IO.ADVANCED_REQUEST_SCHEMA]
    good = dict(zip(keys, ADVANCED_EXAMPLE))
    bad = dict(good, row_id=2, age=130)
    missing = {k: v for k, v in dict(good, row_id=3).items() if k not in ("ca", "thal")}
    with open(os.path.join(src, "r.json"), "w") as f:
        f.write("\n".join(json.dumps(x) for x in (good, bad, missing)) + "\n")
    out = SS.run_available_now(spark, src, "advanced", SS.advanced_model_scorer(model, stats, vocab, feats))
    resp = {r.row_id: r for r in spark.read.parquet(os.path.join(out, "responses")).collect()}
    assert set(resp) == {1, 3}                                  # optional ca/thal accepted
    assert all(r.prediction == int(r.probability >= 0.5) or abs(r.probability - 0.5) < 1e-4 for r in resp.values())
    quar = spark.read.parquet(os.path.join(out, "quarantine")).collect()
    assert [(q.row_id, q.errors) for q in quar] == [(2, ["age:range"])]


def test_forest_explained_response_labels_and_values(spark):
    feats_df, stats, vocab, feats = EN.prepare_advanced(view(spark, SF_SMALL, "clinical_raw"))
    model = TR.fit(feats_df, feats, "random_forest", {"n_estimators": 20, "max_depth": 4})
    req = spark.createDataFrame([ADVANCED_EXAMPLE], IO.ADVANCED_REQUEST_SCHEMA)
    rows = SV.to_model_space_advanced(req, stats, vocab, feats)
    out = SV.explain_requests_model(model, req, rows, feats, K.ADVANCED_FEATURE_LABELS,
                                    SV.advanced_display()).orderBy("rank").collect()
    assert [r.rank for r in out] == list(range(1, 9))
    labels = dict(K.ADVANCED_FEATURE_LABELS)
    assert all(r.feature in labels.values() for r in out)
    by_label = {r.feature: r.value for r in out}
    if labels["chol"] in by_label:
        assert by_label[labels["chol"]] == "245.0 mg/dl"
    mags = [abs(r.contribution) for r in out]
    assert mags == sorted(mags, reverse=True)
