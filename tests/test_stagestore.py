"""Stage store, declared raw types, quarantine and content keys."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from riskframe import cli
from riskframe import constants as K
from riskframe.operators.models import ADVANCED_SERVE_SCORER
from riskframe.plans import stagestore as SS
from riskframe.sources import io as IO
from riskframe.sources.fixtures import view
from tests.conftest import SF_SMALL


def test_store_scores_what_it_was_fitted_on(spark, tmp_dir):
    raw = view(spark, SF_SMALL, "clinical_raw")
    features = SS.fit_stage(spark, "advanced", raw, tmp_dir)
    assert features == K.ADVANCED_FEATURES
    SS.save_model(spark, ADVANCED_SERVE_SCORER, tmp_dir)
    assert SS.load_model(spark, tmp_dir, "linear") == ADVANCED_SERVE_SCORER
    again, _ = SS.features_of(spark, "advanced", raw, tmp_dir)
    stored = {r["id"]: r for r in IO.read_stage(spark, os.path.join(tmp_dir, "features")).collect()}
    for r in again.collect():
        assert all(r[c] == pytest.approx(stored[r["id"]][c], rel=1e-12) for c in features)
    # without the target, with nulls where training had none, and a column more
    odd = raw.drop("num").withColumn("age", F.when(F.col("id") % 2 == 0, F.col("age")).cast("int")).withColumn("note", F.lit("x"))
    got = SS.infer(spark, "advanced", odd.filter("id % 2 = 0"), tmp_dir, "linear")
    assert got.count() == raw.filter("id % 2 = 0").count() and got.filter("probability is null").count() == 0


def test_store_refuses_what_does_not_belong(spark, tmp_dir):
    raw = view(spark, SF_SMALL, "clinical_raw")
    SS.fit_stage(spark, "advanced", raw, tmp_dir)
    with pytest.raises(SS.StageMismatch, match="mode"):
        SS.open_stage(spark, "basic", tmp_dir)
    with pytest.raises(SS.StageMismatch, match="chol number .absent."):
        SS.features_of(spark, "advanced", raw.drop("chol"), tmp_dir)
    with pytest.raises(SS.StageMismatch, match="chol number .is string."):
        SS.features_of(spark, "advanced", raw.withColumn("chol", F.col("chol").cast("string")), tmp_dir)
    IO.save_scaler(spark, {"age": (0.0, 1.0)}, os.path.join(tmp_dir, "scaler"))
    with pytest.raises(SS.StageMismatch, match="scaler"):
        SS.open_stage(spark, "advanced", tmp_dir)


def survey_csv(tmp_dir, name, n=600, with_target=True, seed=1):
    """The real survey layout: no key, all numbers, repeated rows."""
    rng = random.Random(seed)
    cols = [*([K.BASIC_TARGET_RAW] if with_target else []), *K.BASIC_FEATURES]
    lines = [",".join(cols)]
    for _ in range(n):
        row = {c: float(rng.randrange(2)) for c in cols}
        row.update(BMI=float(rng.randrange(18, 45)), GenHlth=float(rng.randrange(1, 6)), Age=float(rng.randrange(1, 14)))
        row.update(MentHlth=float(rng.randrange(30)), PhysHlth=float(rng.randrange(30)))
        if with_target:
            row[K.BASIC_TARGET_RAW] = float(row["Age"] + rng.randrange(6) > 11)
        lines += [",".join(str(row[c]) for c in cols)] * rng.choice([1, 1, 1, 2])
    path = os.path.join(tmp_dir, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return path, len(lines) - 1


def test_cli_from_raw_csv_without_key(spark, tmp_dir, capsys):
    path, _ = survey_csv(tmp_dir, "survey.csv")
    model = os.path.join(tmp_dir, "model")
    assert cli.main(["train", "--mode", "basic", "--raw", path, "--out", model]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["roc_auc"] > 0.7
    new, n = survey_csv(tmp_dir, "new.csv", 50, False, 2)
    out = os.path.join(tmp_dir, "pred")
    assert cli.main(["infer", "--mode", "basic", "--raw", new, "--model", model, "--out", out]) == 0
    pred = spark.read.parquet(out)
    assert pred.count() == n == pred.select("row_id").distinct().count()


def test_quarantine(spark, tmp_dir):
    path = os.path.join(tmp_dir, "bad.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("BMI,Age,note\n20.5,3,a\nheavy,3,b\n21,,c\n22,4,d,5\n")
    rows, bad = IO.read_raw_csv(spark, path, IO.SURVEY_TYPES)
    assert [(f.name, f.dataType.simpleString()) for f in rows.schema.fields] == [("BMI", "double"), ("Age", "double"), ("note", "string")]
    assert sorted(r["note"] for r in rows.collect()) == ["a", "c"]
    assert sorted(r[IO.CORRUPT] for r in bad.select("BMI", "Age", "note", IO.CORRUPT).collect()) == ["22,4,d,5", "heavy,3,b"]


def test_content_keys_are_stable(spark, monkeypatch):
    monkeypatch.setattr(IO, "KEY_CHUNK", 7)
    rows = [(1.0, "a")] * 40 + [(None, "a"), (1.0, None), (1.0, ""), (2.0, "b")] + [(float(i), "c") for i in range(50)]
    df = spark.createDataFrame(rows, "x double, t string")
    one, two = IO.with_content_key(df.repartition(1), "k").collect(), IO.with_content_key(df.repartition(9), "k").collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and len({r["k"] for r in one}) == len(rows)
    assert sorted(map(str, [(r["x"], r["t"]) for r in one])) == sorted(map(str, rows))
    hot = sorted(int(r["k"].split("-")[1]) for r in one if r["x"] == 1.0 and r["t"] == "a")
    assert hot == list(range(40))
    assert IO.with_content_key(df.limit(0), "k").count() == 0


def test_log_replay_keeps_its_day(spark, tmp_dir):
    """A batch of yesterday that is written again today is read once, on its day."""
    path = os.path.join(tmp_dir, "log")
    rows = spark.createDataFrame([(1, 0.7, "High"), (0, 0.1, "Low")], "prediction int, probability double, risk_level string")
    old = rows.withColumn("mode", F.lit("basic")).withColumn("ts", F.lit("2024-01-01 23:59:00").cast("timestamp")).withColumn(
        "day", F.lit("2024-01-01")).withColumn("batch", F.lit("b7"))
    old.write.partitionBy("day", "batch").parquet(path)
    assert IO.append_prediction_log(rows, path, "basic", "b7") and IO.append_prediction_log(rows, path, "basic", "b8")
    got = sorted((r["batch"], str(r["day"]), r["risk_level"]) for r in IO.read_prediction_log(spark, path).collect())
    assert [g[0] for g in got] == ["b7", "b7", "b8", "b8"] and {g[1] for g in got if g[0] == "b7"} == {"2024-01-01"}
    assert {g[1] for g in got if g[0] == "b8"} != {"2024-01-01"}
