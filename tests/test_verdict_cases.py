"""Edge results: typed JSON, unreadable inputs, one-class groups, empty
tables, scripts, turns after the newest user turn, folders as tables."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from riskframe.functions import rules as R
from riskframe.operators import impute, metrics, prompts, retrieval
from riskframe.sources import io as IO
from riskframe.streaming import usage_stream as US

from .conftest import SF_SMALL

GOOD = {"row_id": 1, "age": 50, "sex": "Male", "cp": "asymptomatic", "chol": 200.0, "fbs": False, "thalch": 150.0,
        "exang": False, "oldpeak": 1.0}


def test_badly_typed_optional_fields_are_rejected(spark):
    rows = [GOOD, GOOD | {"ca": "x"}, GOOD | {"ca": None}, GOOD | {"thal": 3}, GOOD | {"age": "old"}]
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    parsed = IO.parse_requests(lines, IO.ADVANCED_REQUEST_SCHEMA)
    errors = [r[0] for r in R.validate(parsed, R.ADVANCED_SCHEMA).select(R.ERRORS).collect()]
    assert not any("type" in e for e in errors[0] + errors[2])
    assert "ca:type" in errors[1] and "age:type" in errors[4]
    assert errors[3]


def test_nan_is_out_of_range(spark):
    df = spark.createDataFrame([(float("nan"),), (5.0,)], "chol double")
    got = [r[0] for r in df.select(R.error_codes([R.Field("chol", ge=0)])).collect()]
    assert got == [["chol:range"], []]


def test_absent_reads_empty_but_damage_raises(spark, tmp_dir):
    assert IO.read_prediction_log(spark, os.path.join(tmp_dir, "none")).count() == 0
    assert retrieval.read_index(spark, os.path.join(tmp_dir, "none")).count() == 0
    os.makedirs(bad := os.path.join(tmp_dir, "bad"))
    with open(os.path.join(bad, "part-0.parquet"), "wb") as f:
        f.write(b"no parquet")
    with pytest.raises(Exception):
        IO.read_prediction_log(spark, bad).count()
    with pytest.raises(Exception):
        retrieval.read_index(spark, bad).count()


def test_one_class_auc_is_null(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.4), ("b", 0, 0.1), ("b", 1, 0.9)], "g string, y int, p double")
    out = {r["g"]: r["roc_auc"] for r in metrics.roc_auc(df, "y", "p", ["g"]).collect()}
    assert out == {"a": None, "b": 1.0}


def test_null_profile_of_an_empty_table(spark):
    rows = impute.null_profile(spark.createDataFrame([], "a int, b string")).collect()
    assert [(r["null_count"], r["null_pct"]) for r in rows] == [(0, None), (0, None)]


@pytest.mark.parametrize("text", ["сердце и давление", "心臓 血圧", "huyết áp cao", "قلب"])
def test_every_script_embeds(spark, text):
    vec = retrieval.hashing_embed(spark.createDataFrame([(text,)], "text string")).first()["embedding"]
    assert sum(v * v for v in vec) == pytest.approx(1.0, rel=1e-5)
    assert sum(v != 0 for v in vec) <= len(text.split())


def test_turns_after_the_new_message(spark):
    conv = spark.createDataFrame([(1, t, r, f"m{t}") for t, r in enumerate(["user", "assistant", "user", "assistant"])],
                                 "conv_id int, turn int, role string, text string")
    cut = prompts.recent_turns(conv, 5)
    assert sorted(r["turn"] for r in cut.collect()) == [0, 1, 2]
    kept = prompts.recent_turns(conv, 5, upto_new=False).collect()
    assert sorted(r["turn"] for r in kept) == [0, 1, 2, 3] and [r["turn"] for r in kept if r["is_new"]] == [2]
    assert "WindowGroupLimit" in cut._jdf.queryExecution().executedPlan().toString()


def test_usage_stream_reads_a_folder(spark, tmp_dir):
    os.makedirs(folder := os.path.join(tmp_dir, "events.parquet"))
    shutil.copy(os.path.join(SF_SMALL, "events.parquet"), os.path.join(folder, "part-0.parquet"))
    schema = spark.read.parquet(folder).schema
    out = US.run_available_now(spark, os.path.join(tmp_dir, "[e]vents.parquet"), schema)
    n = US.read_latest(spark, out).agg(F.sum("n")).first()[0]
    assert n == spark.read.parquet(folder).count()


def test_usage_stream_accounts_for_late_rows(spark, tmp_dir):
    """Days closed by an earlier file, rows without a time, and a restart."""
    src, out, state = (os.path.join(tmp_dir, x) for x in ("events", "out", "state"))
    schema = "event_id long, ts timestamp, value double"

    def add(n, rows):
        part = spark.createDataFrame([(i, None, 10.0) for i, _ in rows], schema).drop("ts")
        when = spark.createDataFrame([(i, t) for i, t in rows], "event_id long, t string")
        part.join(when, "event_id").select("event_id", F.to_timestamp("t").alias("ts"), "value").coalesce(1).write.mode("append").parquet(src)
        run()

    def run():
        US.run_accounted(spark, src, schema, out, state)

    add(0, [(1, "2024-03-10 08:00:00"), (2, "2024-03-10 23:59:59"), (3, None)])
    add(1, [(4, "2024-03-12 00:00:01"), (5, "2024-03-09 10:00:00"), (6, "2024-03-08 23:00:00")])  # closed until 03-09 23:59:59
    add(2, [(7, "2024-03-10 12:00:00"), (8, "2024-03-11 01:00:00")])                             # closed until 03-11 00:00:01
    run()                                                                                        # nothing new
    assert US.audit(spark, out).first().asDict() == {"rows_in": 8, "counted": 5, "late": 2, "undated": 1}
    aside = {r["id"]: r["reason"] for r in spark.read.parquet(os.path.join(out, US.ASIDE)).collect()}
    assert aside == {3: "undated", 6: "late", 7: "late"}
    days = dict(US.read_accounted(spark, out).groupBy("day").agg(F.sum("n")).collect())
    assert days == {"2024-03-09": 1, "2024-03-10": 2, "2024-03-11": 1, "2024-03-12": 1}
    log = spark.read.parquet(src)
    write = US._accounting_writer(out, "1 day")                                                  # a replayed batch decides alike
    write(US.log_from_events(spark, log.filter("event_id in (7, 8)")), 2)
    assert US.audit(spark, out).first().asDict() == {"rows_in": 8, "counted": 5, "late": 2, "undated": 1}
