"""Exact order statistics by narrowing, against sorting."""

import math
import random
import statistics
from collections import Counter

import numpy as np
import pytest

from riskframe.operators import encode as EN
from riskframe.operators import impute as MV
from riskframe.operators import orderstats as OS
from riskframe.operators import profile as PF
from riskframe import constants as K


@pytest.fixture(params=[(4096, 10_000), (7, 3)])
def sizes(request, monkeypatch):
    """Production sizes, and tiny ones that force many rounds."""
    monkeypatch.setattr(OS, "BUCKETS", request.param[0])
    monkeypatch.setattr(OS, "FEW", request.param[1])


def columns():
    rng = random.Random(3)
    return {
        "coded": [float(rng.randrange(5)) for _ in range(400)],
        "normal": [rng.gauss(0, 1) for _ in range(400)],
        "outliers": [rng.random() for _ in range(395)] + [1e300, -1e300, 1e-300, 5e-324, 0.0],
        "hot": [7.0] * 300 + [rng.uniform(6.999999, 7.000001) for _ in range(100)],
        "infinite": [math.inf] * 3 + [-math.inf] * 2 + [float(i) for i in range(395)],
        "holes": [None if i % 3 else float(i) for i in range(400)],
        "nan": [float("nan") if i % 2 else -float(i) for i in range(400)],
        "ints": [rng.randrange(10 ** 6) for _ in range(400)],
    }


def plain(values, p):
    v = sorted(x for x in values if x is not None and x == x)
    h = (len(v) - 1) * p
    a, b = v[math.floor(h)], v[math.ceil(h)]
    return a if a == b else (math.ceil(h) - h) * a + (h - math.floor(h)) * b


def table(spark, cols):
    names = list(cols)
    schema = ", ".join(f"{n} {'bigint' if isinstance(cols[n][0], int) else 'double'}" for n in names)
    return spark.createDataFrame(list(zip(*cols.values())), schema).repartition(5)


def test_quantiles(spark, sizes):
    cols = columns()
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = OS.quantiles(table(spark, cols), {c: probs for c in cols})
    for c, values in cols.items():
        for p, g in zip(probs, got[c]):
            assert g == pytest.approx(plain(values, p), rel=1e-12, abs=0), (c, p)


def test_quantiles_edges(spark, sizes):
    df = spark.createDataFrame([(None, 1.0, 2.0), (None, None, 2.0)], "a double, b double, c double")
    assert OS.medians(df, ["a", "b", "c"]) == {"a": None, "b": 1.0, "c": 2.0}
    assert OS.medians(df.limit(0), ["a", "b"]) == {"a": None, "b": None}
    assert OS.quantiles(df, {}) == {} and OS.modes(df, []) == {}


def test_modes(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "y", "z", None]), rng.randrange(4), rng.choice([0.5, -1.5, float("nan"), None]),
             2 ** 60 + rng.randrange(2), rng.random() < 0.5) for _ in range(300)] + [(None, 9, None, 2 ** 60, None)] * 3
    df = spark.createDataFrame(rows, "s string, i int, d double, big bigint, b boolean").repartition(4)
    got = OS.modes(df, df.columns)
    for k, c in enumerate(df.columns):
        counts = Counter(r[k] for r in rows if r[k] is not None and r[k] == r[k])
        assert got[c] == min(counts, key=lambda v: (-counts[v], v)), c
    tie = spark.createDataFrame([("b", 2), ("a", 1), (None, None)], "s string, i int")
    assert OS.modes(tie, ["s", "i"]) == {"s": "a", "i": 1}
    assert OS.modes(tie.limit(0), ["s"]) == {"s": None}


def test_no_buffers_in_the_plans(spark):
    """No value buffer: only counts, extents and prefix sums."""
    df = table(spark, columns())
    seen = []
    original = OS._holding
    OS._holding = lambda counted, wanted: seen.append(counted._jdf.queryExecution().toString()) or original(counted, wanted)
    try:
        OS.quantiles(df, {"normal": [0.5], "coded": [0.5]})
    finally:
        OS._holding = original
    assert seen and not any(word in plan for plan in seen for word in ("percentile", "median(", "collect_list", "mode("))


def test_describe_and_impute_use_them(spark, sizes):
    cols = {c: v for c, v in columns().items() if c in ("coded", "normal", "holes", "nan")}
    df = table(spark, cols)
    for r in PF.describe(df).collect():
        v = [x for x in cols[r["column_name"]] if x is not None and x == x]
        assert (r["q25"], r["q50"], r["q75"]) == pytest.approx([plain(v, p) for p in (0.25, 0.5, 0.75)])
        assert (r["count"], r["min"], r["max"]) == (len(v), min(v), max(v)) and r["std"] == pytest.approx(statistics.stdev(v))
    filled = MV.impute(df, {"holes": "median", "nan": "mode", "coded": ("const", 3)}).toPandas()
    assert not filled[["holes", "nan"]].isna().any().any()
    assert np.median(filled["holes"]) == pytest.approx(plain(cols["holes"], 0.5))


def test_nan_in_coded_survey_column(spark):
    """NaN counts as missing before the integer cast."""
    names = [K.BASIC_TARGET_RAW, "GenHlth", "BMI", "Smoker"]
    rows = [(0.0, 1.0, 20.0, 1.0), (1.0, float("nan"), 30.0, 0.0), (0.0, 3.0, float("nan"), 1.0), (1.0, 3.0, 25.0, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id bigint, " + ", ".join(f"{n} double" for n in names))
    out, stats, features = EN.prepare_basic(df)
    got = out.orderBy("row_id").collect()
    assert all(v is not None and v == v for r in got for v in r) and len(got) == 4
    assert stats["GenHlth"][0] == pytest.approx((1 + 3 + 3 + 3) / 4) and stats["BMI"][0] == pytest.approx(25.0)
    again = EN.apply_basic(df, stats, EN.fit_basic(df)[2]).orderBy("row_id").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in got]
