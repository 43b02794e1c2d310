"""Randomised properties (hypothesis): exact AUC and exact split counts."""

import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from riskframe.operators import metrics as ME
from riskframe.operators import split as SP

SCORES = st.lists(st.tuples(st.integers(0, 6).map(lambda v: v / 6.0), st.integers(0, 1)),
                  min_size=2, max_size=60).filter(lambda r: 0 < sum(y for _, y in r) < len(r))


@settings(max_examples=6, deadline=None)
@given(rows=SCORES, buckets=st.sampled_from([1, 2, 4, 64]))
def test_auc_equals_pairwise_definition(spark, rows, buckets):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0
               for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "probability double, target int").repartition(3)
    got = ME.roc_auc(df, buckets=buckets).first()["roc_auc"]
    assert abs(got - want) < 1e-12


@settings(max_examples=5, deadline=None)
@given(n0=st.integers(1, 80), n1=st.integers(1, 80), t=st.sampled_from([0.1, 0.2, 0.5]))
def test_exact_split_counts(spark, n0, n1, t):
    rows = [(i, 0) for i in range(n0)] + [(n0 + i, 1) for i in range(n1)]
    df = spark.createDataFrame(rows, "row_id long, target int")
    s = SP.split_flag_exact(df, "row_id", "target", t)
    got = {r.target: r["count"] for r in s.filter("is_test").groupBy("target").count().collect()}
    for cls, n in ((0, n0), (1, n1)):
        assert got.get(cls, 0) == int(n * t + 0.5)   # per-class cut-off rounds half up
    assert s.count() == n0 + n1
