"""Embedding whitening with a covariance found by polarisation.

Entries become integers, x = floor(64 c) + 1000000, so that every sum below is
exact, in any order and on any number of executors.

1. One pass finds the number of vectors n and the sum S of every dimension.
2. A second pass aggregates the squared centred values of every dimension and
   of every sum of two dimensions. Values are centred before they are squared:
   by the whole part of S / n in the task, by its remainder afterwards, in
   whole numbers. Tasks send one row per dimension or pair.
3. 2 cov(a, b) = var(a + b) - var(a) - var(b): the differences recover all
   cross-covariances; ``eigh`` of the assembled matrix gives the components
   (by falling eigenvalue; the largest entry of each is positive). Only sums,
   one per dimension or pair, reach the driver: their number grows with the
   dimensions, not with the data.
4. A map-only pass whitens; a last one measures the covariance of what it gave.

Defined results: vectors that are null, empty or hold null or non-finite
entries are dropped; if lengths differ, the most frequent one is kept (of
equally frequent ones the longest). Repeated rows count as often as they
occur, ids may be null. Entries beyond +-2**54 count as that. Components whose
eigenvalue is not above 1e-12 of the trace (constant or dependent dimensions)
are left out, so a table of equal rows has none; equal eigenvalues keep the
order of ``eigh``. A deviation beyond 2**63 - 1 is null. An empty table gives
no rows. Other columns are passed on by ``whiten``; where one is named like an
added column, the added one gets underscores at its end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

SCALE, SHIFT = 64, 1_000_000
MOST = float(1 << 54)             # entries beyond it would leave 64 bits
COMPONENTS = 32
RANK = 1e-12                      # least eigenvalue, as a share of the trace
SAFE = float(1 << 62)             # below it sums stay in 64 bits
LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Whitener:
    """Exact sums of the fit list and the components found from them."""

    n: int
    sums: list[int]               # per dimension
    eigenvalues: np.ndarray
    vectors: np.ndarray           # dimension x component, unit columns
    trace: float

    @property
    def components(self) -> int:
        return len(self.eigenvalues)


def usable(vectors: Column) -> Column:
    """True for vectors with entries, all of them finite."""
    entry = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    return F.coalesce((F.size(vectors) > 0) & F.forall(vectors, lambda e: F.coalesce(entry(e.cast("double")), F.lit(False))), F.lit(False))


def remaining(table: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector takes part."""
    rows = table.filter(usable(F.col(f"`{column}`")))
    lengths = rows.groupBy(F.size(f"`{column}`").alias("d")).agg(F.count("*").alias("c"))
    most = lengths.orderBy(F.desc("c"), F.desc("d")).first()
    return rows.filter(F.size(f"`{column}`") == (most["d"] if most else -1))


def as_integers(column: pa.Array) -> np.ndarray:
    """x of a batch of clean vectors: one row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(np.clip(flat, -MOST, MOST) * SCALE).astype(np.int64) + SHIFT
    return x.reshape(len(column), -1)


def _exact(values: np.ndarray, largest: float) -> np.ndarray:
    """The array, as Python integers where 64 bits might not do."""
    return values if largest < SAFE else values.astype(object)


def _peak(y: np.ndarray) -> float:
    return float(np.abs(y.astype(np.float64)).max(initial=0.0))


def _added(rows: DataFrame, column: str, totals) -> dict[tuple[int, int], int]:
    """Sum over all rows of ``totals(x)``, a dict (i, j) -> integer of a batch."""
    def run(batches):
        found: dict[tuple[int, int], int] = {}
        for batch in batches:
            if batch.num_rows:
                for key, v in totals(as_integers(batch.column(0))).items():
                    found[key] = found.get(key, 0) + v
        if found:
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()),
                pa.array([str(v) for v in found.values()], pa.string())], ["i", "j", "v"])

    sums = rows.select(F.col(f"`{column}`")).mapInArrow(run, "i int, j int, v string")
    # one row per dimension or pair
    return {(r["i"], r["j"]): int(r["v"]) for r in sums.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}


def first_sums(x: np.ndarray) -> dict[tuple[int, int], int]:
    """Rows under (-1, -1), the sum of dimension a under (a, a)."""
    total = _exact(x, len(x) * _peak(x)).sum(axis=0)
    return {(-1, -1): len(x)} | {(a, a): int(v) for a, v in enumerate(total)}


def squared_sums(x: np.ndarray, centre: np.ndarray) -> dict[tuple[int, int], int]:
    """Squared centred values, added up: of dimension a under (a, a), of the
    sum of dimensions a < b under (a, b)."""
    y = x - centre
    y = _exact(y, 4 * len(y) * _peak(y) ** 2)
    found = {(a, a): int(v) for a, v in enumerate((y * y).sum(axis=0))}
    for a in range(y.shape[1] - 1):
        both = y[:, a:a + 1] + y[:, a + 1:]
        found |= {(a, a + 1 + k): int(v) for k, v in enumerate((both * both).sum(axis=0))}
    return found


def covariance(n: int, sums: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix (divisor n) by polarisation, each entry rounded
    once from whole numbers. With the whole part of S / n as centre, a centred
    sum is the remainder of S / n times one, so n**2 var = n * squares - remainder**2."""
    d = len(sums)
    rest = [s % n for s in sums]
    spread = lambda square, left: n * square - left * left
    own = [spread(squares[a, a], rest[a]) for a in range(d)]
    v = np.empty((d, d))
    for a in range(d):
        v[a, a] = own[a] / (n * n)
        for b in range(a + 1, d):
            v[a, b] = v[b, a] = (spread(squares[a, b], rest[a] + rest[b]) - own[a] - own[b]) / (2 * n * n)
    return v


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitener:
    """The whitening of the (clean) rows."""
    first = _added(rows, column, first_sums)
    n = first.pop((-1, -1), 0)
    sums = [first[a, a] for a in range(len(first))]
    if not n:
        return Whitener(0, [], np.empty(0), np.empty((0, 0)), 0.0)
    centre = np.array([s // n for s in sums], np.int64)
    v = covariance(n, sums, _added(rows, column, lambda x: squared_sums(x, centre)))
    values, vectors = np.linalg.eigh(v)
    order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > RANK * np.trace(v)]
    vectors = vectors[:, order]
    if order:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return Whitener(n, sums, values[order], vectors, float(np.trace(v)))


def _whitener(model: Whitener):
    """x of a batch -> whitened values."""
    centre = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([s % model.n / model.n for s in model.sums])
    scaled = model.vectors / np.sqrt(model.eigenvalues)
    return lambda x: ((x - centre).astype(np.float64) - rest) @ scaled


def whiten(rows: DataFrame, model: Whitener, column: str = "embedding") -> DataFrame:
    """The (clean) rows with two more columns at the end: ``whitened``
    (array<double>) and ``deviation``, the squared distance of n x from S."""
    n, width = model.n, max(1, len(model.sums))
    centre = np.array([s // n for s in model.sums], np.int64) if n else np.empty(0, np.int64)
    rest = np.array([s % n for s in model.sums], np.int64) if n else centre
    names = rows.columns
    at = names.index(column)

    def run(batches):
        project = _whitener(model) if model.n else None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_integers(batch.column(at))
            y = x - centre
            y = _exact(y, width * (n * (_peak(y) + 1.0)) ** 2)
            away = ((n * y - rest) ** 2).sum(axis=1)
            w = project(x)
            offsets = np.arange(0, w.size + 1, w.shape[1]) if w.shape[1] else np.zeros(len(w) + 1, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(w.ravel())),
                 pa.array([int(v) if v <= LONGEST else None for v in away], pa.int64())], list(map(str, range(len(names) + 2))))

    # positional names in the worker, so that no column of the table can clash
    plain = rows.toDF(*map(str, range(len(names))))
    schema = T.StructType([*plain.schema.fields, T.StructField(str(len(names)), T.ArrayType(T.DoubleType())),
                           T.StructField(str(len(names) + 1), T.LongType())])
    return plain.mapInArrow(run, schema).toDF(*names, free_name(names, "whitened"), free_name(names, "deviation"))


def identity_error(rows: DataFrame, model: Whitener, column: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the
    identity, measured on all rows (null without components)."""
    k = model.components
    if not k:
        return float("nan")

    def run(batches):
        project, total, products = _whitener(model), np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = project(as_integers(batch.column(0)))     # centred by the exact mean
                total += w.sum(axis=0)
                products += w.T @ w
        flat = np.concatenate([total, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "v"])

    sums = rows.select(F.col(f"`{column}`")).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.zeros(k + k * k)
    for r in sums.collect():                                  # k + k * k rows
        flat[r["i"]] = r["v"]
    mean = flat[:k] / model.n
    return float(np.abs(flat[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def fit_and_whiten(table: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitener, float]:
    """Whitened rows, the model and its measured identity error."""
    rows = remaining(table, column)
    model = fit(rows, column, components)
    return whiten(rows, model, column), model, identity_error(rows, model, column)


def components_of(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error:
    a row per remaining vector and component."""
    rows, model, error = fit_and_whiten(table.select("vec_id", "embedding"), "embedding", components)
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]) if model.components else F.array().cast("array<double>")
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                       F.col("value").alias("whitened"), F.get(share, F.col("at")).alias("explained"),
                       F.lit(error).alias("identity_error"))
