"""Ranked search, SimHash and whitening against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from riskframe.llm import queries, search, simhash, whitening
from riskframe.llm.common import text_pieces
from riskframe.sources.tables import read_table
from tests.conftest import SF_SMALL

from .conftest import EDGES, LONG

ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rank", T.StringType())])
VECTOR = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("whitened", T.StringType()), T.StructField("0", T.StringType())])


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_text_pieces():
    rng = random.Random(1)
    text = "".join(rng.choice("ab é\t\n\x1c ") for _ in range(5000))
    for size in (1, 7, 100, 10_000):
        pieces = list(text_pieces(text, size))
        assert b"".join(pieces) == text.encode()
        assert [w for p in pieces for w in p.split()] == text.encode().split()
    assert list(text_pieces(None)) == list(text_pieces("")) == []


# 13 ----------------------------------------------------------------------------

def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    u = np.array(prints, np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None]) <= 3
    label = list(range(len(u)))
    while True:
        new = [min(label[j] for j in np.flatnonzero(row)) for row in near]
        if new == label:
            break
        label = new
    groups = {}
    for i, k in zip(ids, label):
        groups.setdefault(k, []).append(i)
    return [min((i for i in groups[k] if i is not None), default=None) for k in label]


def check_simhash(df):
    rows = df.collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    want = Counter(zip([r["doc_id"] for r in rows], [f"{p:016x}" for p in prints], plain_components([r["doc_id"] for r in rows], prints)))
    found = simhash.link(df)
    got = Counter((r["doc_id"], f"{r['fingerprint'] % (1 << 64):016x}", r["component_id"]) for r in found.collect())
    assert got == want


def test_simhash_documents_and_edges(spark, make):
    check_simhash(read_table(spark, SF_SMALL, "documents"))
    check_simhash(make(EDGES, extra=True))
    assert simhash.link(make([])).count() == 0
    first = queries.op13_simhash(spark, SF_SMALL).first()
    assert re.fullmatch("[0-9a-f]{16}", first["fingerprint"])


def test_simhash_tie_is_zero_and_case():
    one = lambda text: int(simhash.fingerprints([text])[0]) % (1 << 64)
    assert one("P Q r") == xxhash.xxh64_intdigest(b"p q r", 42)
    # two shingles: a bit in one of them only is a tie
    assert one("a b c d") == xxhash.xxh64_intdigest(b"a b c", 42) & xxhash.xxh64_intdigest(b"b c d", 42)


def test_simhash_pieces(monkeypatch):
    want = simhash.fingerprints([LONG, "x y", "x y z", "  "])
    monkeypatch.setattr(simhash, "text_pieces", lambda t: text_pieces(t, 5))
    monkeypatch.setattr(simhash, "BUFFER", 50)
    assert (simhash.fingerprints([LONG, "x y", "x y z", "  "]) == want).all()


def near_prints(n, spread, seed):
    """Fingerprints with many links: chains and clusters of flipped bits."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)}
    for base in [rng.getrandbits(64) for _ in range(spread)]:
        x = base
        for _ in range(30):
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out | {0, (1 << 64) - 1, 7, 1 << 63})


@pytest.mark.parametrize("tile", [16, 1 << 14])
def test_simhash_links(spark, tile):
    """Also where tiles are small and a group is dense."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    dense = {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    prints = sorted(dense | set(near_prints(300, 20, 3)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long").repartition(3)
    edges = [(r["a"], r["b"]) for r in simhash.links(df, tile=tile).collect()]
    assert len(edges) <= 25 * len(prints)
    parent = {p: p for p in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = plain_components(signed, prints)
    groups = {}
    for p, w in zip(signed, want):
        groups.setdefault(find(p), set()).add(w)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_simhash_forest_is_small():
    near = np.array([x ^ (1 << b) for x in (0,) for b in range(60)] + [0], np.int64)
    a, _ = simhash.forest(near)
    assert len(a) == len(near) - 1
    a, _ = simhash.forest(near[:30], near[30:])
    assert len(a) == len(near) - 1


# 12 ----------------------------------------------------------------------------

def plain_search(rows, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(r["doc_id"], Counter(pattern.findall(lower(r["text"] or "")))) for r in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    big_n, big_l = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = Counter()
    for item, text in {(r["item_id"], r["text"]) for r in items}:
        terms = set(pattern.findall(lower(text or "")))
        scored = []
        for doc_id, c, n in docs:
            m = 100 - 90 + (90 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0))
        for rank, (s, none, doc_id) in enumerate(sorted(scored)[:10], 1):
            out[item, rank, None if none else doc_id, -s] += 1
    return out


def found_rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_search_edges(spark, make):
    items = spark.createDataFrame([
        (1, "one two three", "x"), (2, None, "x"), (3, "", "x"), (4, "zzz nowhere", "x"), (5, "w1x1 w2x2 W3X3 tail", "x"), (5, "w1x1 w2x2 W3X3 tail", "y"),
        (6, "Ünïcödé 東京 straße", "x"), (None, "null id text", "x"), (7, "a b c d e", "x"), (8, LONG, "x")], ITEM)
    df = make(EDGES, extra=True)
    assert found_rows(search.search(df, items)) == plain_search(df.collect(), items.collect())
    assert search.search(make([]), items).count() == 0
    assert search.search(df, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_ties_and_copies(spark, make, monkeypatch):
    """More copies than places, near copies, and items in several blocks."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randrange(5, 80))) for _ in range(80)]
    texts = base + [base[0]] * 70 + [base[1] + f" extra{i}" for i in range(60)] + [base[2]] * 15
    rng.shuffle(texts)
    df = make(list(enumerate(texts))).repartition(5)
    items = spark.createDataFrame([(i, t, "") for i, t in enumerate([base[0], base[1], base[2], "w1 w2 w3", "extra7 w5"])], ITEM)
    monkeypatch.setattr(search, "QUERY_TERMS", 40)
    assert found_rows(search.search(df, items)) == plain_search(df.collect(), items.collect())


def test_search_bounds(make):
    """No bound is below the exact score, and most documents are excluded."""
    rng = random.Random(5)
    vocabulary = [f"t{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 20, 100, 400]))) for _ in range(300)]
    q = search.Queries([(i, " ".join(rng.sample(vocabulary, 8))) for i in range(20)], T.LongType())
    counts = [search.term_counts(t) for t in texts]
    df = Counter(t for c in counts for t in c)
    known = search.TermHashes()
    q.weigh({int(np.uint64(known[t]).view(np.int64)): v for t, v in df.items()}, len(texts), sum(sum(c.values()) for c in counts))
    index = search.build(make(list(enumerate(texts)))).collect()
    exact = np.array([[sum(int(q.weights[r]) * int(search.share(np.int64(c[q.words[r]]), q.spread(np.int64(sum(c.values()))))) for r in rows)
                       for c in counts] for rows in q.rows])
    above = np.zeros(exact.shape, np.int64)
    for b in index:
        got = search.bounds(q, b["bits"], np.array(b["lengths"]), bytes(b["slices"]))
        assert (got >= exact[:, b["ids"]]).all()
        above[:, b["ids"]] = got
    tenth = np.sort(exact, axis=1)[:, -10]
    assert (above >= tenth[:, None]).sum() < 2 * (exact >= tenth[:, None]).sum()
    assert sorted(i for b in index for i in b["ids"]) == list(range(300))


# 11 ----------------------------------------------------------------------------

def plain_whitening(vectors):
    x = np.array([[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    c = n * x - s
    v = np.array(c.T.dot(c) / (n ** 3), float)
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:32]
    return (c * c).sum(axis=1), np.array(c / n, float) @ u[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def test_whitening(spark):
    rows = read_table(spark, SF_SMALL, "embeddings").collect()
    away, white, share = plain_whitening([r["embedding"] for r in rows])
    got = queries.op11_whitening(spark, SF_SMALL).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 32 * len(rows) and set(got["n"]) == {len(rows)}
    ids = [r["vec_id"] for r in rows]
    assert list(got.groupby("vec_id")["deviation"].first().loc[ids]) == list(away)
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    sign = np.sign((table * white).sum(axis=0))
    assert np.abs(table * sign - white).max() < 1e-8
    assert np.abs(got.groupby("component")["explained"].first().to_numpy() / share - 1).max() < 1e-9
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_polarisation_is_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (500, 6)) + 1_000_000
    x[:, 5] = x[:, 0] * 7                       # dependent dimension
    n, sums = len(x), [int(v) for v in x.sum(axis=0)]
    squares = {}
    for part in np.array_split(x, 7):
        for k, v in whitening.squared_sums(part, np.array([s // n for s in sums])).items():
            squares[k] = squares.get(k, 0) + v
    c = n * x.astype(object) - np.array(sums, object)
    assert (whitening.covariance(n, sums, squares) == np.array([[v / n ** 3 for v in row] for row in c.T.dot(c)])).all()
    wide = np.array([[10 ** 18, -10 ** 18], [3, 4]])
    assert whitening.squared_sums(wide, np.zeros(2, np.int64))[0, 0] == 10 ** 36 + 9


def test_whitening_edges(spark):
    make = lambda rows: spark.createDataFrame([(i, v, "w", "z") for i, v in rows], VECTOR)
    assert whitening.components_of(make([])).count() == 0
    assert whitening.components_of(make([(1, [1.0, 2.0])] * 3)).count() == 0            # no spread
    bad = [(2, None), (3, []), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (7, [1.0, 2.0, 3.0])]
    good = [(1, [1.0, 2.0]), (None, [1.5, -3.0]), (1, [1.0, 2.0]), (9, [0.25, 0.5]), (9, [-8.0, 4.0])]
    got = whitening.components_of(make(bad + good)).collect()
    away, white, _ = plain_whitening([v for _, v in good])
    assert Counter((r["vec_id"], r["deviation"]) for r in got) == Counter((i, int(a)) for (i, _), a in zip(good, away) for _ in range(2))
    assert sorted(abs(r["whitened"]) for r in got) == pytest.approx(sorted(np.abs(white).ravel()), abs=1e-9)
    rows = whitening.fit_and_whiten(make(good))[0]
    assert rows.columns == ["vec_id", "embedding", "whitened", "0", "whitened_", "deviation"] and rows.count() == len(good)
    one = whitening.components_of(make([(1, [1.0, 5.0]), (2, [2.0, 5.0])])).collect()    # a constant dimension
    assert sorted(r["whitened"] for r in one) == pytest.approx([-1, 1]) and {r["explained"] for r in one} == {1.0}
