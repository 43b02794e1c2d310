"""Train/test split, folds and class weights (SP1-SP3).

Every row has a rank within its class: its place in the order of (key hash,
key). Parts are cut at ranks, so a stratified split holds exactly
round(n_c * test_size) rows of every class and folds differ by one row a
class at most. No window runs over a class: a histogram of the hash per class
(a small table) names the hash buckets in which the cuts lie, all rows of other
buckets decide alone, and only the rows of the cut buckets are ranked.

The hash is integer arithmetic that any SQL engine repeats, so the same rows
get the same parts whatever the partitioning, the cluster or the engine.
``split_flag`` is the map-only variant without stratification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import col
from ..functions.sizing import broadcast_if_small

# Parameters of the older integer hash (exact in every SQL
# engine): fraction = ((key + 1) * mult) % 1000003 % 100 / 100.
ARITH_MODULUS = 1000003
SPLIT_MULT = 610639
FOLD_MULT = 324517

# The key hash: a quadratic residue step between two linear ones, modulo a
# prime, so that products stay below 2**62.
HASH_PRIME = (1 << 31) - 1
BUCKET_SHIFT = 15                    # 65536 hash buckets


def _terms(seed: int) -> tuple[int, int]:
    return (seed * 7919 + 12345) % HASH_PRIME, (seed * 104729 + 777) % HASH_PRIME


def key_hash(df: DataFrame, key: str, seed: int = K.RANDOM_STATE) -> Column:
    """Hash in [0, ``HASH_PRIME``) of a key column; keys that are not integers
    go through ``xxhash64`` first."""
    from pyspark.sql.types import IntegralType

    c, d = _terms(seed)
    p = F.lit(HASH_PRIME)
    x = col(key) if isinstance(df.schema[key].dataType, IntegralType) else F.xxhash64(col(key))
    x = F.coalesce(F.pmod(x.cast("long"), p), F.lit(0).cast("long"))
    y = (x * F.lit(48271) + F.lit(c)) % p
    return (((y * y) % p) * F.lit(16807) + x * F.lit(69621) + F.lit(d)) % p


def key_hash_sql(key: str, seed: int = K.RANDOM_STATE) -> str:
    """``key_hash`` of an integer key as SQL text."""
    c, d = _terms(seed)
    p = HASH_PRIME
    x = f"((({key}) % {p} + {p}) % {p})::BIGINT"
    y = f"(({x} * 48271 + {c}) % {p})"
    return f"(((({y} * {y}) % {p}) * 16807 + {x} * 69621 + {d}) % {p})"


def arith_hash(key: str | Column, mult: int) -> Column:
    return ((col(key).cast("long") + 1) * F.lit(mult)) % F.lit(ARITH_MODULUS)


def unit_hash(key: str | Column, seed: int = K.RANDOM_STATE, method: str = "xxhash64") -> Column:
    """A repeatable value in [0, 1) per key."""
    if method == "arith":
        return (arith_hash(key, SPLIT_MULT) % 100) / F.lit(100.0)
    return F.pmod(F.xxhash64(col(key), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def split_flag(df: DataFrame, key: str, test_size: float = K.TEST_SIZE, seed: int = K.RANDOM_STATE,
               method: str = "xxhash64", flag: str = "is_test") -> DataFrame:
    """SP1 (default): mark test rows with a keyed hash threshold."""
    return df.withColumn(flag, unit_hash(key, seed, method) < F.lit(test_size))


def class_parts(df: DataFrame, key: str, label: str, cuts, seed: int, part: str) -> DataFrame:
    """Number the rows of every class by the cuts below their rank.

    ``cuts(n)`` gives an ascending array of ranks for a class of ``n`` rows
    (a column): a row's part is how many of them its rank reaches. A null label
    is a class of its own; keys are unique."""
    from pyspark.sql import Window as W

    h = key_hash(df, key, seed)
    x = df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", BUCKET_SHIFT).cast("int"))
    # at most 65536 rows per class
    hist = x.groupBy(col(label).alias("_c"), "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy("_c").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    hist = hist.withColumn("_upto", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(W.partitionBy("_c")))
    hist = hist.withColumn("_r", F.explode(cuts(F.col("_all")))).withColumn("_before", F.col("_upto") - F.col("_n"))
    found = hist.filter((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_upto")))
    # one row per class, as many cuts as there are parts; a cut past the last row is in no bucket
    table = found.groupBy("_c").agg(F.collect_list(F.struct(
        F.col("_b").alias("b"), F.col("_r").alias("r"), F.col("_before").alias("before"))).alias("_cuts"))
    x = x.join(broadcast_if_small(table), col(label).eqNullSafe(F.col("_c")), "left")
    none = F.array().cast(table.schema["_cuts"].dataType)
    x = x.withColumn("_cuts", F.coalesce("_cuts", none))
    # rows outside the cut buckets decide alone; only those inside are ranked
    # (no join back: the two halves are a union)
    here = F.filter("_cuts", lambda c: c["b"] == F.col("_b"))
    alone = x.filter(F.size(here) == 0).withColumn(part, F.size(F.filter("_cuts", lambda c: c["b"] < F.col("_b"))))
    place = F.row_number().over(W.partitionBy(col(label), "_b").orderBy("_h", col(key))) - 1
    inside = x.filter(F.size(here) > 0).withColumn("_rank", F.get(here, F.lit(0))["before"] + place).withColumn(
        part, F.size(F.filter("_cuts", lambda c: c["r"] <= F.col("_rank"))))
    cols = [col(c) for c in df.columns] + [F.col(part)]
    return alone.select(*cols).unionByName(inside.select(*cols))


def split_flag_exact(df: DataFrame, key: str, label: str = K.TARGET, test_size: float = K.TEST_SIZE,
                     seed: int = K.RANDOM_STATE, flag: str = "is_test") -> DataFrame:
    """SP1: exactly round(n_c * test_size) test rows per class (halves round
    up): those of the lowest ranks."""
    cuts = lambda n: F.array(F.round(n * F.lit(test_size)).cast("long"))
    parts = class_parts(df, key, label, cuts, seed, flag)
    return parts.withColumn(flag, F.col(flag) == 0)


def fold_exact(df: DataFrame, key: str, label: str = K.TARGET, k: int = K.CV_FOLDS,
               seed: int = K.RANDOM_STATE, fold: str = "fold") -> DataFrame:
    """SP2: stratified folds 0..k-1, sizes within one row of each other in
    every class: fold j ends at rank round(n_c (j + 1) / k)."""
    cuts = lambda n: F.array(*[F.floor((F.lit(2 * j) * n + k) / F.lit(2 * k)).cast("long") for j in range(1, k)])
    return class_parts(df, key, label, cuts, seed + 1, fold)


def dense_rank(df: DataFrame, key: str, seed: int = K.RANDOM_STATE, name: str = "_i") -> DataFrame:
    """Consecutive numbers 0..n-1 in the order of (key hash, key): the same
    for any partitioning, so nothing has to be checkpointed. Rows are ranked
    inside hash buckets, which start where the counts of lower buckets end."""
    from pyspark.sql import Window as W

    x = df.withColumn("_h", key_hash(df, key, seed)).withColumn("_b", F.shiftright("_h", BUCKET_SHIFT).cast("int"))
    hist = x.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # a window over at most 65536 counts
    starts = hist.select("_b", (F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))
    place = F.row_number().over(W.partitionBy("_b").orderBy("_h", col(key))) - 1
    ranked = x.withColumn("_place", place).join(broadcast_if_small(starts, known_bound=1 << 16), "_b")
    return ranked.select(*[col(c) for c in df.columns], (F.col("_start") + F.col("_place")).alias(name))


def fold_column(key: str, k: int = K.CV_FOLDS, seed: int = K.RANDOM_STATE,
                method: str = "xxhash64") -> Column:
    """SP2: fold id in [0, k) from a keyed hash (feeds ``CrossValidator(foldCol)``)."""
    if method == "arith":
        return (arith_hash(key, FOLD_MULT) % k).cast("int")
    return F.pmod(F.xxhash64(col(key), F.lit(seed + 1)), F.lit(k)).cast("int")


def class_weights(df: DataFrame, label: str = K.TARGET) -> DataFrame:
    """SP3: ``balanced`` weights ``n / (n_classes * n_c)`` per class (one
    aggregation; the result has one row per class)."""
    from pyspark.sql import Window as W

    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    # a window over the per-class counts (one row per class), not over data
    everything = W.partitionBy()
    return (counts.withColumn("weight", F.sum("n_class").over(everything)
                              / (F.count(F.lit(1)).over(everything) * F.col("n_class"))))


def with_class_weight(df: DataFrame, label: str = K.TARGET, weight: str = "weight") -> DataFrame:
    """Attach the balanced weight to every row. The weight table has one row
    per class; it is broadcast only after its size is checked."""
    w = class_weights(df, label).select(label, F.col("weight").alias(weight))
    return df.join(broadcast_if_small(w), on=label, how="left")
