"""Quality rules with adaptive thresholds (native).

Per document, base counts (words, symbols, repeated lines, repeated 8-word
windows) and a few shape features are computed in one projection. For every
(language, source) group a mergeable quantile sketch per feature is kept: a
histogram over logarithmic bins (relative error at most ``GAMMA - 1``), which
merges by adding counts, so a hot group is combined on the map side and the
result does not depend on the order of merging. A group's quartiles are drawn
towards those of its language, and these towards those of all documents, the
more the fewer documents it has (one formula at every size). The
fences (quartiles widened by ``spread`` inter-quartile ranges, with a least
spread per feature) replace fixed cutoffs and are joined back to the rows.

Defined results: null text counts as empty (all counts 0, base_failed true,
as fewer than ``MIN_WORDS`` words); null language and source are groups of
their own; repeated rows are judged alike; an empty table gives no rows;
only doc_id, text, lang and source are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NON_SPACE, broadcast_checked, let, space_words, stored, window_hashes

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
GAMMA = 1.02
LEAST_VALUE = 1e-4          # smaller values share the zero bin
ZERO_BIN = -100_000
PRIOR = 20.0                # weight of the parent's quartiles, in documents
SPREAD = 4.0
MAX_BROADCAST_GROUPS = 200_000
#: feature -> (least inter-quartile range used for the fence, lower fence too)
FEATURES = {
    "symbols_per_word": (0.05, False),
    "mean_word_chars": (0.5, True),
    "dup_line_share": (0.10, False),
    "repeat_share": (0.05, False),
    "upper_share": (0.05, False),
    "punct_share": (0.04, False),
}


def repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text."""

    def covered(positions: Column) -> Column:
        steps = F.transform(positions, lambda p, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get(positions, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    def repeated(ordered: Column) -> Column:
        marked = F.transform(ordered, lambda s, k: F.struct(
            s["i"].alias("i"),
            (F.coalesce(F.get(ordered, k - 1)["h"] == s["h"], F.lit(False))
             | F.coalesce(F.get(ordered, k + 1)["h"] == s["h"], F.lit(False))).alias("d")))
        kept = F.transform(F.filter(marked, lambda s: s["d"]), lambda s: s["i"])
        return let(F.sort_array(kept), covered)

    def of_windows(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(ordered, repeated)).otherwise(
            F.lit(0).cast("long"))

    def of_words(ws: Column) -> Column:
        windows = window_hashes(F.transform(ws, lambda w: F.xxhash64(w)), WINDOW)
        return F.when(F.size(ws) > WINDOW, let(windows, of_windows)).otherwise(F.lit(0).cast("long"))

    return let(words, of_words)


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and the features of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", "lang", "source", text.alias("text"), space_words(F.col("text")).alias("words"))
    lines = F.transform(F.filter(F.split(F.col("text"), "\n"), lambda s: s.rlike(NON_SPACE)), lambda s: F.xxhash64(s))
    df = df.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("_upper"),
        F.regexp_count("text", F.lit(r"[!-/:-@\[-`{-~]")).cast("long").alias("_punct"),
        let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n"),
                                      (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup"))).alias("_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return df.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        F.col("_lines.dup").alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS)
         | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        per(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        per(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        per(F.col("_lines.dup"), F.col("_lines.n")).alias("dup_line_share"),
        per(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_share"),
        per(F.col("_upper"), F.col("word_chars")).alias("upper_share"),
        per(F.col("_punct"), F.col("word_chars")).alias("punct_share"))


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, feature, bin) -> n: the mergeable sketch of each group,
    over the documents that pass the base rules."""
    bin_of = lambda v: F.when(v < LEAST_VALUE, F.lit(ZERO_BIN)).otherwise(
        F.floor(F.log(v) / F.lit(math.log(GAMMA)))).cast("int")
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), bin_of(F.col(f)).alias("bin")) for f in FEATURES])
    return (counts.filter(~F.col("base_failed"))
            .select("lang", "source", F.explode(entries).alias("e"))
            .groupBy("lang", "source", F.col("e.feature").alias("feature"), F.col("e.bin").alias("bin"))
            .agg(F.count("*").alias("n")))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """First and third quartile of each feature after merging the sketches to
    ``keys``. A window partition holds the bins of one sketch, a bounded number."""
    merged = sketch.groupBy(*keys, "feature", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "feature")
    value = F.when(F.col("bin") == ZERO_BIN, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bin") + 0.5))
    ranked = merged.select(*keys, "feature", "n", value.alias("value"),
                           F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("value")))
    return ranked.groupBy(*keys, "feature").agg(at(0.25).alias("q1"), at(0.75).alias("q3"),
                                                F.max("total").alias("total"))


def thresholds(sketch: DataFrame, spread: float = SPREAD, prior: float = PRIOR) -> DataFrame:
    """lang, source and the fences ``lo_<f>`` / ``hi_<f>`` of every feature.

    One rule at every size: a group of n documents takes its own quartiles
    with weight n and those of its language with weight ``prior``, a language
    likewise against all documents; so no verdict jumps when a row is added."""
    groups = quartiles(sketch, ["lang", "source"])
    langs = quartiles(sketch, ["lang"]).select(
        F.col("lang").alias("_l"), F.col("feature").alias("_lf"), F.col("q1").alias("l1"), F.col("q3").alias("l3"),
        F.col("total").alias("lt"))
    everything = quartiles(sketch, []).select(
        F.col("feature").alias("_af"), F.col("q1").alias("a1"), F.col("q3").alias("a3"))
    df = (groups.join(langs, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("feature") == F.col("_lf")))
          .join(everything, F.col("feature") == F.col("_af")))
    mean = lambda own, n, parent: (own * n + parent * F.lit(prior)) / (n + F.lit(prior))
    own = lambda g, la, a: mean(F.col(g), F.col("total"), mean(F.col(la), F.col("lt"), F.col(a)))
    df = df.select("lang", "source", "feature", own("q1", "l1", "a1").alias("q1"), own("q3", "l3", "a3").alias("q3"))
    out = []
    for f, (least, _) in FEATURES.items():
        reach = spread * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        out += [F.max(F.when(F.col("feature") == f, F.col("q1") - reach)).alias(f"lo_{f}"),
                F.max(F.when(F.col("feature") == f, F.col("q3") + reach)).alias(f"hi_{f}")]
    return df.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame, spread: float = SPREAD, prior: float = PRIOR) -> DataFrame:
    """Counts, features, fences' verdict ``kept`` and the failed features
    (``failed``: array of names) of every document row."""
    counts = stored(base_counts(docs), "quality-counts")
    fences = broadcast_checked(stored(
        thresholds(sketches(counts), spread, prior).withColumnsRenamed({"lang": "_lang", "source": "_source"}),
        "quality-fences"), MAX_BROADCAST_GROUPS)
    df = counts.join(fences, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")),
                     "left")
    bad = []
    for f, (_, low) in FEATURES.items():
        out = F.col(f) > F.col(f"hi_{f}")
        if low:
            out = out | (F.col(f) < F.col(f"lo_{f}"))
        bad.append(F.when(out, F.lit(f)))
    df = df.withColumn("failed", F.filter(F.array(*bad), lambda x: x.isNotNull()))
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
