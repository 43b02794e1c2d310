"""Benchmark decontamination (native).

The word windows of the benchmark items (10 words; shorter items are one
window) form a hash set that is broadcast after its rows were counted; beyond
the bound the same join shuffles. Every document's window hashes are generated
and probed in one stage, and only hits are shuffled. A second scan counts the
words and verifies each hit by comparing the words themselves.

``scan`` reports per document; ``clean`` removes hit spans or whole documents.

Defined results: words are runs of a-z, 0-9 and non-ASCII characters after
lower-casing A-Z; null or empty text has no words and no hits; items without
words match nothing; repeated rows (same id and text) are judged alike and
all kept; null ids are ids like others; empty tables give no rows / no hits.
Only doc_id, text, item_id (and, in ``clean``, the columns passed through) are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_checked, let, packed, stored, unpacked, window_hashes

WINDOW = 10
MAX_BROADCAST_WINDOWS = 200_000
MAX_BROADCAST_HITS = 20_000    # documents with candidates
#: Separators of lower-cased and of raw text (raw text still has A-Z).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
RAW_WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP + "+"), "")


HIT = "array<struct<pos:int,len:int,gram:string,items:array<string>>>"


def _windows(ws: Column, lengths: list[int]) -> Column:
    """Array of (pos, len, h) of all windows of the given lengths."""

    def of_length(hashes: Column, n: int) -> Column:
        return F.transform(window_hashes(hashes, n), lambda h, i: F.struct(i.alias("pos"), F.lit(n).alias("len"), h.alias("h")))

    return F.when(F.size(ws) >= min(lengths), let(
        F.transform(ws, lambda w: F.xxhash64(w)), lambda hashes: F.concat(*[of_length(hashes, n) for n in lengths]))).otherwise(
        F.array().cast("array<struct<pos:int,len:int,h:bigint>>"))


def _gram(ws: Column, pos: Column, length: Column) -> Column:
    return F.array_join(F.slice(ws, pos + 1, length), " ")


def item_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """_len, _h, gram (the words) and items (ids as text) of every distinct benchmark window."""
    items = bench.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    n = F.size("w")
    windows = _windows(F.col("w"), [window])
    for short in range(1, window):
        windows = F.when(n == short, _windows(F.col("w"), [short])).otherwise(windows)
    rows = items.filter(n > 0).select("item", "w", F.explode(windows).alias("x"))
    return rows.groupBy(F.col("x.len").alias("_len"), F.col("x.h").alias("_h"),
                        _gram(F.col("w"), F.col("x.pos"), F.col("x.len")).alias("gram")).agg(F.collect_set("item").alias("items"))


def candidates(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stored _found_id, _found_hash and _found (array of pos, len, gram,
    items) of the documents in which a window's hash occurs."""
    table = stored(item_windows(bench, window), "bench-windows")
    lengths = sorted(r[0] for r in table.select("_len").distinct().collect())  # at most ``window`` numbers
    scanned = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), let(
        words(F.col("text")), lambda ws: _windows(ws, lengths or [window])).alias("x"))
    probes = scanned.select("doc_id", "text_hash", F.explode("x").alias("x"))
    found = probes.join(broadcast_checked(table, MAX_BROADCAST_WINDOWS),
                        (F.col("x.h") == F.col("_h")) & (F.col("x.len") == F.col("_len")))
    return stored(found.groupBy(F.col("doc_id").alias("_found_id"), F.col("text_hash").alias("_found_hash")).agg(
        F.sort_array(F.collect_set(F.struct("x.pos", "x.len", "gram", "items"))).alias("_found")), "bench-hits")


def _verified(docs: DataFrame, bench: DataFrame, window: int, whole: bool = False) -> DataFrame:
    """doc_id (with ``whole`` the packed row too) of every row, its ``_words``, and
    ``_hits``: the candidates whose words are those of the benchmark."""
    found = broadcast_checked(candidates(docs, bench, window), MAX_BROADCAST_HITS)
    if whole:
        rows = packed(docs).withColumn("_words", words(F.col("_row.text")))
    else:
        rows = docs.select("doc_id", F.xxhash64("text").alias("_text_hash"), words(F.col("text")).alias("_words"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_found_id")) & (F.col("_text_hash") == F.col("_found_hash")), "left")
    hits = F.when(F.col("_found").isNull(), F.array().cast(HIT)).otherwise(
        F.filter("_found", lambda s: _gram(F.col("_words"), s["pos"], s["len"]) == s["gram"]))
    return rows.withColumn("_hits", hits).drop("_found", "_found_id", "_found_hash", "_text_hash")


def covered(spans: Column) -> Column:
    """Words inside the union of the spans (sorted by position)."""
    end = lambda s: s["pos"] + s["len"]
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), end(s) - F.greatest(acc["to"], s["pos"]))).cast("long").alias("n"),
        F.greatest(acc["to"], end(s)).cast("int").alias("to"))
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("to")), step,
                       lambda acc: acc["n"])


def scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (array), spans of every document row."""
    rows = _verified(docs, bench, window)
    return rows.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), covered(F.col("_hits")).alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.col("_hits.items")))).alias("items"),
        F.transform("_hits", lambda s: F.struct(s["pos"].alias("pos"), s["len"].alias("len"))).alias("spans"))


def clean(docs: DataFrame, bench: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """``documents``: drop documents with a hit. ``spans``: cut the hit words,
    with the separators before them, out of the text and keep the rest."""
    rows = _verified(docs, bench, window, whole=True)
    if remove == "documents":
        return unpacked(rows.filter(F.size("_hits") == 0), docs)
    # pieces: each word with the separators before it, and the last separators
    pieces = F.regexp_extract_all(F.col("_row.text"), F.lit(f"{RAW_GAP}*{RAW_WORD}+|{RAW_GAP}+$"), F.lit(0))
    hit = lambda i: F.exists("_hits", lambda s: (s["pos"] <= i) & (i < s["pos"] + s["len"]))
    cut = let(pieces, lambda ps: F.concat_ws("", F.filter(ps, lambda p, i: ~hit(i))))
    return unpacked(rows, docs, F.when(F.size("_hits") == 0, F.col("_row.text")).otherwise(cut))
