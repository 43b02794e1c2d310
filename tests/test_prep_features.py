"""Property tests: cleaning, imputation, encoding, scaling, split, weights."""

import math

import pytest
from pyspark.sql import functions as F

from riskframe import constants as K
from riskframe.operators import encode as EN
from riskframe.operators import impute as MV
from riskframe.operators import prep as PR
from riskframe.operators import split as SP
from riskframe.sources.fixtures import view

from .conftest import SF_SMALL


def test_impute_fills_only_nulls(spark):
    raw = PR.bool_text_map(view(spark, SF_SMALL, "clinical_raw"))
    out = MV.impute(raw, MV.ADVANCED_POLICY)
    j = raw.alias("a").join(out.alias("b"), "id")
    for c in MV.ADVANCED_POLICY:
        # no nulls left, and non-null inputs are untouched
        assert out.filter(F.col(c).isNull()).count() == 0
        changed = j.filter(F.col(f"a.{c}").isNotNull() & (F.col(f"a.{c}") != F.col(f"b.{c}"))).count()
        assert changed == 0


def test_median_even_count_and_mode_ties(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "b"), (4.0, "a"), (None, None)], "x double, s string")
    fit = MV.fit_policy(df, {"x": "median", "s": "mode"})
    assert fit["fill"]["x"] == 2.5           # mean of the two middle values
    assert fit["fill"]["s"] == "a"           # tie -> smallest value
    assert fit["nulls"] == {"x": 1, "s": 1}


def test_nan_is_missing_and_binarize_nan_to_zero(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0), (3, None), (4, 0.0)], "id long, num double")
    out = {r.id: r.target for r in PR.binarize_target(df).collect()}
    assert out == {1: 0, 2: 1, 3: 0, 4: 0}   # NaN > 0 must not be true
    prof = {r.column_name: r.null_count for r in MV.null_profile(df).collect()}
    assert prof["num"] == 2


def test_bool_text_map_exact_match(spark):
    df = spark.createDataFrame([("TRUE",), ("FALSE",), ("true",), (None,), ("1",)], "fbs string")
    assert [r.fbs for r in PR.bool_text_map(df, ["fbs"]).collect()] == [1, 0, None, None, None]


def test_cast_truncates_and_clean_survey_strict(spark):
    df = spark.createDataFrame([(1, 2.9, -1.7)], "row_id long, a double, b double")
    r = PR.cast_types(df, ["a", "b"], []).first()
    assert (r.a, r.b) == (2, -1)
    raw = view(spark, SF_SMALL, "survey_raw").withColumn("HighBP", F.lit(None).cast("double"))
    with pytest.raises(PR.NullsRemainError):
        PR.clean_survey(raw, strict=True)


def test_align_fills_missing_with_zero(spark):
    df = spark.createDataFrame([(1, 5, 7)], "row_id long, b int, extra int")
    out = PR.align_features(df, ["a", "b"], keep=["row_id"])
    assert out.columns == ["row_id", "a", "b"] and tuple(out.first()) == (1, 0, 5)


def test_scaler_population_std_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (3.0, 3.0), (6.0, 3.0)], "x double, c double")
    stats = EN.fit_scaler(df, ["x", "c"])
    assert stats["c"] == (3.0, 1.0)          # zero std -> 1
    out = EN.scale(df, stats)
    agg = out.agg(F.avg("x"), F.stddev_pop("x"), F.max("c")).first()
    assert abs(agg[0]) < 1e-12 and abs(agg[1] - 1.0) < 1e-12 and agg[2] == 0.0


def test_onehot_drop_first_and_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "id int, k string")
    vocab = EN.fit_vocabulary(df, ["k"])
    assert vocab == {"k": ["a", "b", "c"]}
    out = EN.onehot(df, vocab)
    assert out.columns == ["id", "k_b", "k_c"]
    rows = {r.id: (r.k_b, r.k_c) for r in out.collect()}
    assert rows == {1: (1, 0), 2: (0, 0), 3: (0, 0), 4: (0, 1)}
    with pytest.raises(EN.VocabularyTooWide):
        EN.fit_vocabulary(df, ["k"], max_width=2)


def test_feature_widths(spark):
    clean_s = PR.clean_survey(view(spark, SF_SMALL, "survey_raw"))
    _, _, fb = EN.build_basic(clean_s)
    assert fb == K.BASIC_FEATURES and len(fb) == 21
    clean_c = PR.clean_clinical(view(spark, SF_SMALL, "clinical_raw"))
    _, _, _, fa = EN.build_advanced(clean_c)
    assert fa == K.ADVANCED_FEATURES and len(fa) == 14
    assert len(EN.build_variant(clean_c)[1]) == 20
    assert len(EN.build_variant(clean_c, K.ADVANCED_LOW_IMPORTANCE_COLS)[1]) == 14


def test_split_hash_disjoint_complete_and_shares(spark):
    df = spark.range(0, 20000).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("target"))
    s = SP.split_flag(df, "row_id", 0.2)
    counts = {(r.target, r.is_test): r["count"] for r in s.groupBy("target", "is_test").count().collect()}
    assert sum(counts.values()) == 20000
    for t in (0, 1):
        share = counts[(t, True)] / (counts[(t, True)] + counts[(t, False)])
        assert abs(share - 0.2) < 0.03


def test_split_exact_matches_reference_fixture(spark):
    # 100 rows, features 0..99 / 100..199, alternating target: 80 / 20 rows
    df = spark.createDataFrame([(i, i, 100 + i, i % 2) for i in range(100)],
                               "row_id long, feature1 long, feature2 long, target int")
    s = SP.split_flag_exact(df, "row_id", "target", 0.2)
    assert s.count() == 100
    by = {(r.target, r.is_test): r["count"] for r in s.groupBy("target", "is_test").count().collect()}
    assert by[(0, True)] == 10 and by[(1, True)] == 10
    assert by[(0, False)] + by[(1, False)] == 80
    assert s.select("row_id").distinct().count() == 100


def test_class_weights_sum_to_n(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(10)], "row_id int, target int")
    w = SP.with_class_weight(df)
    assert math.isclose(w.agg(F.sum("weight")).first()[0], 10.0)
    assert {r.target: r.weight for r in w.select("target", "weight").distinct().collect()} == \
        pytest.approx({1: 10 / (2 * 3), 0: 10 / (2 * 7)})


def test_folds_cover_k(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "row_id")
    folds = df.select(SP.fold_column("row_id", 5).alias("f")).distinct().count()
    assert folds == 5


@pytest.mark.parametrize("null_bmi", [False, True])
def test_prepare_basic_equals_clean_then_build(spark, null_bmi):
    raw = view(spark, SF_SMALL, "survey_raw")
    if null_bmi:   # a scaled column with nulls takes the refit path
        raw = raw.withColumn("BMI", F.when(F.col("row_id") % 7 == 0, F.lit(None)).otherwise(F.col("BMI")))
    a, sa, fa = EN.prepare_basic(raw)
    b, sb, fb = EN.build_basic(PR.clean_survey(raw))
    assert fa == fb and a.columns == b.columns
    for c in sa:
        assert sa[c][0] == pytest.approx(sb[c][0], rel=1e-12) and sa[c][1] == pytest.approx(sb[c][1], rel=1e-12)
    ra = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in a.collect())
    rb = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in b.collect())
    assert ra == rb


def test_prepare_advanced_equals_clean_then_build(spark):
    raw = view(spark, SF_SMALL, "clinical_raw")
    a, sa, va, fa = EN.prepare_advanced(raw)
    b, sb, vb, fb = EN.build_advanced(PR.clean_clinical(raw))
    assert fa == fb == K.ADVANCED_FEATURES and va == vb
    for c in sa:
        assert sa[c][0] == pytest.approx(sb[c][0], rel=1e-12) and sa[c][1] == pytest.approx(sb[c][1], rel=1e-12)
    ra = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in a.collect())
    rb = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in b.collect())
    assert ra == rb


def test_combine_fill_matches_direct():
    import statistics
    xs = [1.0, 4.0, 4.5, 10.0]
    m, s = EN._combine_fill(len(xs), statistics.fmean(xs), statistics.pvariance(xs), 3, 2.5)
    full = xs + [2.5] * 3
    assert m == pytest.approx(statistics.fmean(full)) and s == pytest.approx(statistics.pstdev(full))


def test_clinical_nulls_outside_the_policy_fail(spark):
    raw = view(spark, SF_SMALL, "clinical_raw").withColumn(
        "age", F.when(F.col("id") == 5, F.lit(None)).otherwise(F.col("age")))
    with pytest.raises(PR.NullsRemainError):
        PR.clean_clinical(raw)
    with pytest.raises(PR.NullsRemainError):
        EN.prepare_advanced(raw)


def test_python_strip_whitespace_set(spark):
    from riskframe.functions.exprs import py_strip
    text = "　\x1c\t ## Head  \x85\n"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(py_strip("t").alias("s")).first().s == text.strip()


def test_scaler_fit_on_train_only(spark):
    df = spark.createDataFrame([(i, float(i), int(i % 2)) for i in range(10)], "row_id long, BMI double, target int")
    train = df.filter("row_id < 5")
    _, stats, _ = EN.build_basic(df, fit_on=train)
    assert stats["BMI"][0] == 2.0
