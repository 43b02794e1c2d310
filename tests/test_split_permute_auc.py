"""Stratified parts, seeded permutations and grouped AUC against plain Python."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import metrics as ME
from riskframe.operators import split as SP
from riskframe.operators import training as TR
from riskframe.operators.models import LinearScorer


def labelled(spark, n=1203, seed=1):
    rng = random.Random(seed)
    rows = [(i * 7 - 300, rng.choice([0, 0, 0, 1, None]), f"r{i}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "row_id long, target int, payload string")


def plain_hash(key, seed):
    p = SP.HASH_PRIME
    c, d = SP._terms(seed)
    x = key % p
    y = (x * 48271 + c) % p
    return ((y * y) % p * 16807 + x * 69621 + d) % p


def plain_ranks(rows, seed):
    by = defaultdict(list)
    for key, label, _ in rows:
        by[label].append((plain_hash(key, seed), key))
    return {key: (r, len(v)) for v in by.values() for r, (_, key) in enumerate(sorted(v))}


@pytest.mark.parametrize("shift", [SP.BUCKET_SHIFT, 29, 31])     # few and single buckets: many rows are ranked
def test_split_and_folds_follow_the_ranks(spark, monkeypatch, shift):
    monkeypatch.setattr(SP, "BUCKET_SHIFT", shift)
    rows, df = labelled(spark)
    ranks = plain_ranks(rows, 42)
    got = SP.split_flag_exact(df.repartition(5), "row_id")
    assert got.columns == ["row_id", "target", "payload", "is_test"]
    want = {k: r < int(n * 0.2 + 0.5) for k, (r, n) in ranks.items()}
    assert {r["row_id"]: r["is_test"] for r in got.collect()} == want and got.count() == len(rows)
    ranks = plain_ranks(rows, 43)
    folds = SP.fold_exact(df.repartition(3), "row_id", k=5)
    want = {k: sum((2 * n * j + 5) // 10 <= r for j in range(1, 5)) for k, (r, n) in ranks.items()}
    assert {r["row_id"]: r["fold"] for r in folds.collect()} == want
    sizes = Counter((r["target"], r["fold"]) for r in folds.collect())
    for label in (0, 1, None):
        per = [sizes[label, f] for f in range(5)]
        assert max(per) - min(per) <= 1


def test_split_edges(spark):
    _, df = labelled(spark, 12)
    assert SP.split_flag_exact(df.limit(0), "row_id").count() == 0
    assert SP.split_flag_exact(df, "row_id", test_size=1.0).filter("is_test").count() == 12
    assert SP.split_flag_exact(df, "row_id", test_size=0.0).filter("is_test").count() == 0
    one = spark.createDataFrame([(5, 1)], "row_id long, target int")
    assert SP.fold_exact(one, "row_id").first()["fold"] in range(5)
    text = spark.createDataFrame([(f"k{i}", i % 2) for i in range(100)], "id string, target int")
    assert SP.split_flag_exact(text, "id").filter("is_test").groupBy("target").count().collect()[0]["count"] == 10


def test_dense_rank_is_the_hash_order(spark):
    rows, df = labelled(spark, 700)
    order = sorted((plain_hash(k, 42), k) for k, _, _ in rows)
    for parts in (1, 6):
        got = {r["row_id"]: r["_i"] for r in SP.dense_rank(df.repartition(parts), "row_id").collect()}
        assert got == {k: i for i, (_, k) in enumerate(order)}
    assert SP.dense_rank(df.limit(0), "row_id").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997, 1024])
def test_permutations_are_bijections(spark, n):
    each = spark.range(n).select(F.col("id").alias("_i"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("repeat"))
    rows = TR.permuted(each, n, 5, seed=3).collect()
    by = defaultdict(dict)
    for r in rows:
        by[r["repeat"]][r["_i"]] = r["donor"]
    assert all(sorted(p.values()) == list(range(n)) for p in by.values())
    if n > 100:
        assert len({tuple(sorted(p.items())) for p in by.values()}) == 5
        fixed = sum(i == d for p in by.values() for i, d in p.items())
        assert fixed < 40                                    # one a permutation on average
        steps = [abs(p[i + 1] - p[i]) for p in by.values() for i in range(n - 1)]
        assert abs(np.mean(steps) / n - 1 / 3) < 0.05        # neighbours end far apart


def test_linear_permutation_importance(spark):
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random(), 1.0) for i in range(400)]
    rows = [(i, a, b, c, int(a + 0.2 * b + 0.3 * rng.random() > 0.75)) for i, a, b, c in rows]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, target int").repartition(4)
    scorer = LinearScorer(0.1, (("a", 2.0, None), ("b", 0.4, 0.5)))
    got = {r["feature"]: r for r in TR.permutation_importance(scorer, df, ["a", "b", "c"], repeats=6).collect()}
    assert got["c"]["importance_mean"] == 0.0 == got["c"]["importance_std"]
    idx = {r["_i"]: r for r in SP.dense_rank(df, "row_id").collect()}
    donors = defaultdict(dict)
    for r in TR.permutation_donors(SP.dense_rank(df, "row_id"), 6).collect():
        donors[r["repeat"]][r["_tgt"]] = r["donor"]

    def auc(pairs):
        pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
        return np.mean([[(p > q) + 0.5 * (p == q) for q in neg] for p in pos])

    logit = lambda a, b: 0.1 + 2.0 * a + 0.4 * (b - 0.5)
    base = auc([(logit(r["a"], r["b"]), r["target"]) for r in idx.values()])
    for f in "ab":
        drops = []
        for p in donors.values():
            pairs = [(logit(*(idx[p[i]][g] if g == f else r[g] for g in "ab")), r["target"]) for i, r in idx.items()]
            drops.append(base - auc(pairs))
        assert got[f]["importance_mean"] == pytest.approx(np.mean(drops)) and got[f]["importance_std"] == pytest.approx(np.std(drops))
    assert TR.permutation_importance(scorer, df.limit(0), ["a"], repeats=2).count() == 0


@pytest.mark.parametrize("direct", [1_000_000, 5])
def test_auc_of_unequal_groups(spark, monkeypatch, direct):
    """A thousand groups from one row to a few thousand, also cut into ranges."""
    monkeypatch.setattr(ME, "DIRECT_ROWS", direct)
    monkeypatch.setattr(ME, "RANGES", 8)
    rng = random.Random(6)
    rows = [(g, round(rng.lognormvariate(0, 2), rng.choice([0, 6])), rng.randrange(2), rng.randrange(1, 4))
            for g in range(1000) for _ in range(1 if g % 3 else 1 + g % 7)]
    rows += [(5000, rng.gauss(0, 1), rng.randrange(2), 1) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g int, probability double, target int, w int").repartition(6)
    got = {r["g"]: r["roc_auc"] for r in ME.roc_auc(df, group_cols=["g"], weight="w").collect()}
    by = defaultdict(list)
    for g, s, y, w in rows:
        by[g].append((s, y, w))
    assert set(got) == set(by)
    for g, v in by.items():
        s, y, w = (np.array(x, float) for x in zip(*v))
        pos, neg = w * (y == 1), w * (y == 0)
        if not pos.sum() or not neg.sum():
            assert got[g] is None
            continue
        area = ((s[:, None] > s[None]) + 0.5 * (s[:, None] == s[None])) * pos[:, None] * neg[None]
        assert got[g] == pytest.approx(area.sum() / (pos.sum() * neg.sum()), abs=1e-9)


def test_test_metrics_score_once(spark):
    rows = [(0.9, 1, 1), (0.2, 0, 1), (0.4, 0, 0), (0.7, 1, 0), (0.7, 1, 1)]
    df = spark.createDataFrame(rows, "probability double, prediction int, target int")
    r = TR.test_metrics(df).first()
    assert r["accuracy"] == pytest.approx(3 / 5) and r["roc_auc"] == pytest.approx((2 + 0 + 1.5) / 6)
