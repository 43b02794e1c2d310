"""Mixing sources to target weights by Pareto order sampling (native).

Targets: sources in code-point order (null last) get the weights 3, 1, 2,
repeating, and share ``volume`` times all words; a target stops at ``cap``
times its source's words and the excess is shared again by weight. The level
at which that ends has a closed form: with sources ordered by cap / weight
the first k are full and the others get level * weight.

Sampling: a source whose target is r times its size takes every document
floor(r) times whole. The remainder is sampled without replacement: document
i has the inclusion probability p_i (``measure`` scaled so that the expected
words meet the remainder), a random number u_i from a hash of its id and
text, and the rank q_i = [u_i / (1 - u_i)] / [p_i / (1 - p_i)]; documents
are taken in order of q until the words meet the remainder. No source is
sorted in one task: a histogram of q per source finds the bin in which the
remainder is met, a second one refines that bin, and only the few rows of
the last bin are ordered by a window.

Defined results: null text has size 0; documents of size 0 take 0 words; null
source is a source of its own; repeated rows (same id and text) have equal
ranks and are ordered by nothing but their number, so reruns agree; an empty
table gives no rows. Only doc_id, source and text are read by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NON_SPACE, broadcast_checked, packed, stored, unit_hash, unpacked

WEIGHTS = (3, 1, 2)
VOLUME = 1.5
CAP = 2.0
BINS = 4096
MAX_BROADCAST_SOURCES = 100_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, number of words and a hash of the text (ids may repeat)."""
    return docs.select("doc_id", "source",
                       F.coalesce(F.regexp_count("text", F.lit(NON_SPACE + "+")), F.lit(0)).cast("long").alias("size"),
                       F.xxhash64("text").alias("text_hash"))


def targets(sizes: DataFrame, weights=WEIGHTS, volume: float = VOLUME, cap: float = CAP) -> DataFrame:
    """source, source_size, target. The windows run over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by_level = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    full, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.select(
        "source", "source_size", "weight", (cap * F.col("source_size")).alias("_most"),
        F.row_number().over(by_level).alias("_place"),
        F.coalesce(F.sum(cap * F.col("source_size")).over(full), F.lit(0.0)).alias("_spent"),
        F.coalesce(F.sum("weight").over(full), F.lit(0.0)).alias("_gone"),
        F.sum("weight").over(everything).alias("_weights"), F.sum("source_size").over(everything).alias("_all"))
    # level if this source and all after it in the order stay below their
    # caps; it holds for the first source of which that is true
    level = (volume * F.col("_all") - F.col("_spent")) / (F.col("_weights") - F.col("_gone"))
    per = per.withColumn("_open", F.col("_most") > level * F.col("weight")).withColumn("_level", level)
    per = per.withColumn("_final", F.min(F.when(F.col("_open"), F.struct("_place", "_level"))).over(everything)["_level"])
    return per.select("source", "source_size",
                      F.coalesce(F.least(F.col("_most"), F.col("_final") * F.col("weight")), F.col("_most")).alias("target"))


def _rank(seed: int, p: Column) -> Column:
    """Pareto rank mapped to (0, 1): q / (1 + q) has the order of q."""
    u = unit_hash(F.lit(seed), F.col("doc_id"), F.col("text_hash"))
    q = (u / (1 - u)) * ((1 - p) / p)
    return F.when(p > 0, q / (1 + q)).otherwise(F.lit(1.0))


def _cut(rows: DataFrame, key: list[str], bin_: Column, before: str) -> DataFrame:
    """Per key, the bin in which the running words meet ``need`` and the words
    before it. A window partition holds at most ``BINS`` + 1 summed rows."""
    sums = rows.groupBy(*key, bin_.alias("bin")).agg(F.sum("size").alias("words"), F.max("need").alias("need"),
                                                     F.max(before).alias("_b"))
    w = Window.partitionBy(*key).orderBy("bin")
    sums = sums.withColumn("upto", F.col("_b") + F.sum("words").over(w))
    return (sums.filter(F.col("upto") >= F.col("need"))
            .groupBy(*key).agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("c"))
            .select(*[F.col(k).alias("_" + k) for k in key], F.col("c.bin").alias("cut"), F.col("c.before").alias("cut_before")))


def _with_cut(rows: DataFrame, cut: DataFrame) -> DataFrame:
    cut = broadcast_checked(stored(cut, "mix-cut"), MAX_BROADCAST_SOURCES)
    return rows.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def mix(docs: DataFrame, seed: int = 11, measure: Column | None = None, **shares) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, copies and taken
    (= copies * size) of every document row. ``measure``: a positive column
    of size, source, doc_id; inclusion odds grow with it. By default the
    square root of the size, so that long texts are drawn rather by more
    than by fewer, and no single one decides a small source alone."""
    measure = F.sqrt(F.col("size")) if measure is None else measure
    sizes = stored(sized(docs), "mix-sizes")
    weighed = sizes.withColumn("_m", F.when(F.col("size") > 0, measure).otherwise(F.lit(0.0)))
    scale = weighed.groupBy("source").agg(F.sum(F.col("_m") * F.col("size")).alias("_ms"))
    goals = targets(sizes, **shares)
    goals = goals.join(scale.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_source"), "source_size", "target", "_ms")
    goals = broadcast_checked(stored(goals, "mix-goals"), MAX_BROADCAST_SOURCES)
    rows = weighed.join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0))
    rows = rows.withColumn("whole", whole.cast("long")).withColumn(
        "need", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    # 0.999999: even a large document is drawn, not certain, so ranks stay finite
    p = F.when(F.col("_ms") > 0, F.least(F.lit(0.999999), F.col("need") * F.col("_m") / F.col("_ms"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("rank", _rank(seed, p)).drop("_m", "_ms")
    first = F.floor(F.col("rank") * BINS).cast("int")
    drawn = rows.filter((F.col("need") > 0) & (F.col("size") > 0))
    rows = _with_cut(rows, _cut(drawn.withColumn("_zero", F.lit(0.0)), ["source"], first, "_zero"))
    rows = rows.withColumnsRenamed({"cut": "cut1", "cut_before": "before1"})
    second = F.floor((F.col("rank") * BINS - first) * BINS).cast("int")
    inside = rows.filter((F.col("need") > 0) & (F.col("size") > 0) & (first == F.col("cut1")))
    rows = _with_cut(rows, _cut(inside, ["source"], second, "before1"))
    rows = rows.withColumn("state", F.when((F.col("need") <= 0) | (F.col("size") == 0) | F.col("cut1").isNull(), F.lit("out"))
                           .when(first < F.col("cut1"), F.lit("in")).when(first > F.col("cut1"), F.lit("out"))
                           .when(second < F.col("cut"), F.lit("in")).when(second > F.col("cut"), F.lit("out"))
                           .otherwise(F.lit("edge")))
    # the last bin: 1 / BINS**2 of a source; a document is taken if that
    # brings the words nearer to the remainder than leaving it
    w = Window.partitionBy("source").orderBy("rank", "doc_id", "text_hash")
    edge = rows.filter(F.col("state") == "edge").withColumn(
        "_upto", F.col("cut_before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("more", (F.col("_upto") - F.col("size") / 2.0 < F.col("need")).cast("long")).drop("_upto")
    rest = rows.filter(F.col("state") != "edge").withColumn("more", (F.col("state") == "in").cast("long"))
    copies = F.col("whole") + F.col("more")
    return rest.unionByName(edge).select(
        "doc_id", "source", "text_hash", "size", "source_size", "target",
        F.when(F.col("size") > 0, copies).otherwise(F.col("whole")).alias("copies"), (copies * F.col("size")).alias("taken"))


def expand(docs: DataFrame, **options) -> DataFrame:
    """The document rows, each repeated as often as the mix takes it (all
    columns; rows of size 0 follow their source's whole copies)."""
    taken = mix(docs, **options).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.sum("copies").alias("_all"), F.count("*").alias("_rows"))
    taken = stored(taken, "mix-copies")
    keyed = packed(docs).join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")))
    # rows that repeat an id and text: one of them stands for the copies of all
    alone = keyed.filter("_rows = 1")
    if taken.filter("_rows > 1").head(1):
        alone = alone.unionByName(keyed.filter("_rows > 1").dropDuplicates(["doc_id", "_text_hash"]))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_all")))
    return unpacked(alone.filter("_all > 0").select("_row", copies.alias("_copy")), docs)
