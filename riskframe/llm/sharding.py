"""Uniform shuffle into exact shards by a communication matrix (native).

Rows are dealt to virtual partitions by a hash; partition i has n_i rows.
The matrix a[i][s] (rows that partition i sends to shard s) is drawn from the
multivariate hypergeometric distribution with the exact shard sizes as
column sums, which is the law of the matrix of a uniform permutation. Then
every partition permutes its rows locally and cuts them by its line of the
matrix, the rows are exchanged, and every shard is permuted again: a second
random key orders the shard in buckets, whose counted sizes give the offset
of each bucket, so no shard is ordered in one task.

Law ``rows``: shard sizes differ by one row at most. Defined results: null
text has size 1 and crc32 0; repeated rows are rows like others; an empty table
gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS = 8
ROWS_PER_PARTITION = 4_000
MAX_PARTITIONS = 1 << 16


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Exact draw: good items among ``draws`` from good + bad. Inversion from
    the mode outwards; O(standard deviation) steps."""
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    at_mode = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(total, draws))
    u = rng.random() - at_mode
    up = down = mode
    p_up = p_down = at_mode
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """a[i][s] with row sums ``counts`` and column sums ``sizes``."""
    rng, left, out = random.Random(seed), list(sizes), []
    for n in counts:
        line, rest, open_ = [], n, sum(left)
        for s, free in enumerate(left):
            take = hypergeometric(rng, free, open_ - free, rest) if s < len(left) - 1 else rest
            line.append(take)
            rest -= take
            open_ -= free
        left = [a - b for a, b in zip(left, line)]
        out.append(line)
    return out


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 5, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in a shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                              F.crc32(text.cast("binary")).cast("long").alias("text_crc32")), "shard-rows")
    n = rows.count()
    parts = max(1, min(MAX_PARTITIONS, math.ceil(n / rows_per_partition)))
    key = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), F.col("doc_id"), F.col("size"), F.col("text_crc32"))
    rows = rows.select("*", F.pmod(key(1), F.lit(parts)).cast("int").alias("part"), key(2).alias("r1"), key(3).alias("r2"))
    counted = dict(rows.groupBy("part").agg(F.count("*").alias("n")).collect())  # one number per virtual partition
    a = matrix([counted.get(i, 0) for i in range(parts)], [n // shards + (s < n % shards) for s in range(shards)], seed)
    upto = []  # running sums of each line: rank k goes to the first shard whose sum exceeds it
    for line in a:
        upto.append([sum(line[: s + 1]) for s in range(shards)])
    table = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(upto)), "array<array<bigint>>"))
                                  .alias("_part", "_upto"))
    local = Window.partitionBy("part").orderBy("r1", "doc_id")
    rows = rows.withColumn("_k", F.row_number().over(local) - 1)
    rows = rows.join(F.broadcast(table), F.col("part") == F.col("_part"))
    rows = rows.withColumn("shard", F.size(F.filter("_upto", lambda x: x <= F.col("_k"))).cast("int"))
    # permute again within the shard, in buckets of the second random key
    buckets = max(1, math.ceil(n / shards / rows_per_partition))
    rows = stored(rows.select("doc_id", "size", "text_crc32", "shard", "r2",
                              F.pmod(F.shiftrightunsigned("r2", 20), F.lit(buckets)).cast("int").alias("bucket")), "shard-dealt")
    per = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(F.col("shard").alias("_s"), F.col("bucket").alias("_b"),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "bucket").orderBy("r2", "doc_id")
    rows = rows.withColumn("_i", F.row_number().over(inside) - 1)
    return rows.join(offsets, (F.col("shard") == F.col("_s")) & (F.col("bucket") == F.col("_b"))).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_i")).cast("long").alias("slot"))
