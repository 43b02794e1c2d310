"""Model registry, dense index / permutations, importance, jobs and I/O."""

import json
import os

import pytest
from pyspark.sql import functions as F

from riskframe import constants as K
from riskframe.operators import split as SP
from riskframe.operators import training as TR
from riskframe.operators.models import build_model
from riskframe.plans import presets as P
from riskframe.sources import io as IO


def test_registry(spark):
    m = build_model("random_forest", {"n_estimators": 10, "max_depth": 3})
    assert m.getNumTrees() == 10 and m.getMaxDepth() == 3
    with pytest.raises(ValueError):
        build_model("unknown_model", {})
    with pytest.raises(ValueError):
        P.preset("nope")


def test_dense_index_and_permutations(spark):
    df = spark.range(0, 500, 1, 7).withColumnRenamed("id", "k")
    idx = SP.dense_rank(df, "k")
    ids = sorted(r._i for r in idx.collect())
    assert ids == list(range(500))
    donors = TR.permutation_donors(idx, repeats=3, seed=1)
    for rep in range(3):
        rows = donors.filter(F.col("repeat") == rep).collect()
        assert sorted(r._tgt for r in rows) == list(range(500))
        assert sorted(r.donor for r in rows) == list(range(500))
    # different repeats are different permutations
    p0 = {r._tgt: r.donor for r in donors.filter("repeat = 0").collect()}
    p1 = {r._tgt: r.donor for r in donors.filter("repeat = 1").collect()}
    assert p0 != p1


def test_permutation_importance_unused_feature_is_zero(spark):
    rows = [(i, float(i % 10), 1.0, int(i % 10 >= 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, a double, const double, target int")
    model = TR.fit(df, ["a", "const"], "random_forest", {"n_estimators": 5, "max_depth": 3})
    imp = {r.feature: r for r in TR.permutation_importance(model, df, ["a", "const"], repeats=3).collect()}
    assert imp["const"].importance_mean == 0.0 and imp["const"].importance_std == 0.0
    assert imp["a"].importance_mean > 0.1
    gini = {r.feature: r.importance for r in TR.feature_importances(spark, model, ["a", "const"]).collect()}
    assert gini["const"] == 0.0


def test_cv_scores_and_train_job(spark, tmp_dir):
    from riskframe.sources.fixtures import view
    raw = view(spark, "/root/testdata/sf0.001", "clinical_raw")
    metrics = P.train_job(spark, "advanced", raw, tmp_dir).first()
    assert 0.0 <= metrics.accuracy <= 1.0 and 0.0 <= metrics.roc_auc <= 1.0
    assert IO.read_feature_spec(spark, os.path.join(tmp_dir, "feature_columns")) == K.ADVANCED_FEATURES
    model = IO.load_model(os.path.join(tmp_dir, "model"))
    assert model.getNumTrees == 300
    stats = IO.load_scaler(spark, os.path.join(tmp_dir, "scaler"))
    assert set(stats) == set(K.ADVANCED_NUMERIC_COLS)
    vocab = IO.load_vocabulary(spark, os.path.join(tmp_dir, "vocabulary"))
    assert vocab["thal"] == ["fixed defect", "normal", "reversable defect", "unknown"]


def test_request_json_and_log(spark, tmp_dir):
    lines = spark.createDataFrame([('{"row_id": 1, "age": 58, "sex": "Male", "cp": "asymptomatic", "chol": 245, '
                                    '"fbs": false, "thalch": 140, "exang": true, "oldpeak": 2.1}',),
                                   ("not json",)], "value string")
    req = IO.parse_requests(lines, IO.ADVANCED_REQUEST_SCHEMA)
    from riskframe.functions import rules as R
    ok, bad = R.split_valid(req, R.ADVANCED_SCHEMA)
    assert ok.count() == 1 and bad.count() == 1
    resp = spark.createDataFrame([(1, 0.77, "High")], "prediction int, probability double, risk_level string")
    path = os.path.join(tmp_dir, "log")
    assert IO.append_prediction_log(resp, path, mode="basic")
    assert IO.append_prediction_log(resp, path, mode="advanced")
    log = IO.read_prediction_log(spark, path)
    assert log.count() == 2 and set(log.columns) >= {"mode", "prediction", "probability", "risk_level", "ts", "day"}
    # a failing append is reported, not raised
    assert IO.append_prediction_log(resp.drop("risk_level"), path) is False
    assert IO.read_prediction_log(spark, os.path.join(tmp_dir, "absent")).count() == 0


def test_markdown_corpus_and_index_job(spark, tmp_dir):
    corpus = os.path.join(tmp_dir, "kb")
    os.makedirs(corpus)
    with open(os.path.join(corpus, "one.md"), "w", encoding="utf-8") as f:
        f.write("# One\n## A\ntext a\n## B\ntext b\n")
    with open(os.path.join(corpus, "skip.txt"), "w", encoding="utf-8") as f:
        f.write("## not markdown\n")
    n = P.index_job(spark, corpus, os.path.join(tmp_dir, "index"), num_features=32)
    assert n == 2
    idx = spark.read.parquet(os.path.join(tmp_dir, "index"))
    assert {r.heading for r in idx.collect()} == {"A", "B"}


def test_metrics_and_spec_sinks(spark, tmp_dir):
    IO.write_metrics(spark, {"accuracy": 0.5}, os.path.join(tmp_dir, "m"))
    txt = spark.read.text(os.path.join(tmp_dir, "m")).first()[0]
    assert json.loads(txt) == {"accuracy": 0.5}
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    IO.write_stage(df, os.path.join(tmp_dir, "s.csv"), fmt="csv")
    assert IO.read_stage(spark, os.path.join(tmp_dir, "s.csv"), fmt="csv").first().b == "x"


def test_cli_train_and_infer(spark, tmp_dir, capsys):
    from riskframe import cli
    from riskframe.sources.fixtures import view
    raw_path = os.path.join(tmp_dir, "raw")
    view(spark, "/root/testdata/sf0.001", "clinical_raw").write.parquet(raw_path)
    assert cli.main(["train", "--mode", "advanced", "--raw", raw_path, "--out", os.path.join(tmp_dir, "m")]) == 0
    metrics = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert set(metrics) == {"accuracy", "roc_auc"}
    # features stage for inference
    from riskframe.operators import encode as EN
    from riskframe.operators import prep as PR
    feats, _, _, _ = EN.build_advanced(PR.clean_clinical(spark.read.parquet(raw_path)))
    fpath = os.path.join(tmp_dir, "features")
    IO.write_stage(feats, fpath)
    out = os.path.join(tmp_dir, "pred")
    assert cli.main(["infer", "--mode", "advanced", "--features", fpath, "--model",
                     os.path.join(tmp_dir, "m"), "--out", out]) == 0
    pred = spark.read.parquet(out)
    assert pred.count() == feats.count() and {"id", "prediction", "probability"} <= set(pred.columns)


def test_top_n_and_importance_maps(spark):
    imp = spark.createDataFrame([("a", 0.1), ("b", 0.5), ("c", 0.3)], "feature string, importance double")
    assert [r.feature for r in TR.top_n(imp, 2).collect()] == ["b", "c"]
    perm = spark.createDataFrame([("a", 0.01, 0.0)], "feature string, importance_mean double, importance_std double")
    m = TR.importance_maps(imp, perm).first()
    assert m.gini_importance == {"a": 0.1, "b": 0.5, "c": 0.3} and m.permutation_importance == {"a": 0.01}


def test_logistic_regularisation_matches_c(spark):
    rows = [(i, float(i % 10), int(i % 10 >= 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, a double, target int")
    model = TR.fit(df, ["a"], "logistic_regression", {"C": 1.0})
    # regParam = 1 / (C * n): weak regularisation, a clearly positive slope
    assert model.getRegParam() == 1.0 / 400 and model.coefficients[0] > 1.0


def test_log_append_is_idempotent_per_batch(spark, tmp_dir):
    resp = spark.createDataFrame([(1, 0.7, "High"), (0, 0.1, "Low")], "prediction int, probability double, risk_level string")
    path = os.path.join(tmp_dir, "log")
    assert IO.append_prediction_log(resp, path, mode="basic", batch_key="s-1")
    assert IO.append_prediction_log(resp, path, mode="basic", batch_key="s-1")   # replay
    assert IO.append_prediction_log(resp, path, mode="basic", batch_key="s-2")
    assert IO.read_prediction_log(spark, path).count() == 4


def test_forest_rows_are_dealt_evenly(spark):
    """A table of one filled file among empty ones has enough partitions and no balance."""
    from riskframe.functions.sizing import dealt
    par = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 4000, 1, 1)
    lopsided = rows.union(spark.range(0, 4000, 1, 2 * par).filter("id * 2 < 0"))
    assert lopsided.rdd.getNumPartitions() > par
    sizes = dealt(lopsided, 4000).rdd.glom().map(len).collect()
    assert len(sizes) == par and max(sizes) - min(sizes) <= par and sum(sizes) == 4000
    assert dealt(lopsided, 4000, part_rows=1000).rdd.getNumPartitions() % par == 0
    model = TR.fit(lopsided.selectExpr("id", "double(id % 7) AS a", "int(id % 7 > 3) AS target"), ["a"], "random_forest",
                   {"n_estimators": 3, "max_depth": 2, "class_weight": "balanced"})
    assert model.getNumTrees == 3 and model.getCacheNodeIds()


def test_large_fits_run_one_at_a_time():
    assert [TR.fits_at_once(n, 4) for n in (0, 15_000, 250_000, 400_000, 5_400_000)] == [4, 4, 4, 2, 1]


def test_forest_responses_are_made_in_equal_parts(spark):
    from riskframe.operators import serve as SV
    rows = spark.range(0, 800, 1, 1).selectExpr("id AS row_id", "double(id % 7) AS a", "int(id % 7 > 3) AS target")
    model = TR.fit(rows, ["a"], "random_forest", {"n_estimators": 3, "max_depth": 2})
    out = SV.respond_model(model, rows, ["a"])
    sizes = out.rdd.glom().map(len).collect()
    par = spark.sparkContext.defaultParallelism
    assert len(sizes) == par and max(sizes) - min(sizes) <= par
    assert {(r.row_id, r.prediction) for r in out.collect()} == {(i, int(i % 7 > 3)) for i in range(800)}


def test_forest_learner_counts_every_row(spark):
    """Nodes of the level-wise learner: bagged counts add up, class weights are in the
    statistics, and a value of a few rows among many is a candidate split."""
    rows = spark.range(0, 60_000, 1, 5).selectExpr("id", "double(id % 97) AS a", "double(id % 20000 = 7) AS b", "double(id % 1009) / 3 AS c",
                                                   "int(id % 20000 = 7 OR id % 97 > 60) AS target")
    model = TR.fit(rows, ["a", "b", "c"], "random_forest", {"n_estimators": 12, "max_depth": 4, "class_weight": "balanced"})
    same = TR.fit(rows, ["a", "b", "c"], "random_forest", {"n_estimators": 12, "max_depth": 4, "class_weight": "balanced"})
    assert model.toDebugString.split("\n")[1:] == same.toDebugString.split("\n")[1:] and model.getNumTrees == 12
    path = TR.FR.shared_folder(spark, "model")
    IO.save_model(model, path)
    nodes = {}
    for r in spark.read.parquet(path + "/data").collect():
        nodes[r.treeID, r.nodeData.id] = r.nodeData
    bags = [n.rawCount for (_, i), n in nodes.items() if i == 0]
    assert len(bags) == 12 and len(set(bags)) > 1 and all(abs(n - 60_000) < 6 * 245 for n in bags)
    ones = rows.filter("target = 1").count()
    weight = [60_000 / (2 * (60_000 - ones)), 60_000 / (2 * ones)]
    for (tree, i), n in nodes.items():
        assert abs(sum(s / w for s, w in zip(n.impurityStats, weight)) - n.rawCount) < 1e-3
        if n.leftChild >= 0:
            sides = [nodes[tree, n.leftChild], nodes[tree, n.rightChild]]
            assert sum(s.rawCount for s in sides) == n.rawCount and min(s.rawCount for s in sides) > 0 and n.gain > 0
    assert {n.split.leftCategoriesOrThreshold[0] for n in nodes.values() if n.split.featureIndex == 1} == {0.5}
    scored = TR.predict(model, rows, ["a", "b", "c"], keep=["target"])
    assert scored.filter("prediction = target").count() > 59_900
    one_class = TR.fit(rows.withColumn("target", F.lit(0)), ["a", "b"], "random_forest", {"n_estimators": 2, "max_depth": 3})
    assert TR.predict(one_class, rows, ["a", "b"]).filter("probability <> 0").count() == 0


def test_permuted_forest_is_scored_like_its_model(spark, monkeypatch):
    """Importances by the forest's own arrays against those by its ``transform``, and which rows go through it."""
    rows = spark.range(400).selectExpr("id", "double(id % 2) AS a", "double((id * 7919) % 101) AS b", "1.0D AS const",
                                       "int((id % 2) + ((id * 7919) % 101) / 50 >= 1.5) AS target")
    model = TR.fit(rows, ["a", "b", "const"], "random_forest", {"n_estimators": 25, "max_depth": 4})
    scored, keep = [], TR.predict

    def predict(model, df, features, **k):
        scored.append(df.count())
        return keep(model, df, features, **k)

    monkeypatch.setattr(TR, "predict", predict)
    own = TR.permutation_importance(model, rows, ["a", "b", "const"], repeats=4, key="id").collect()
    assert scored == [400]                         # no variant is made for ``transform``
    monkeypatch.setattr(TR.FR, "is_forest", lambda model: False)
    wanted = {r.feature: (r.importance_mean, r.importance_std) for r in
              TR.permutation_importance(model, rows, ["a", "b", "const"], repeats=4, key="id").collect()}
    assert scored == [400, 400, 4 * 400 * 3]
    assert {r.feature: (r.importance_mean, r.importance_std) for r in own} == wanted
    assert wanted["a"][0] > 0.01 and wanted["const"][0] == 0
