"""SimHash near-dedup by tiled exact comparison.

1. Every text becomes a 64-bit fingerprint: its 3-word shingles (repeats
   included) are hashed by XXH64 with seed 42, and a bit is 1 if more than half
   of the hashes have it. Texts are read in pieces, so a long one needs no
   more memory than a short one.
2. Equal fingerprints are one row from here on (a map-side aggregation), so
   copies cost nothing in the comparison.
3. Distinct fingerprints are cut into tiles of about ``TILE`` with the same
   population counts of both halves. Two fingerprints within the radius differ
   by no more than it in the sum of both counts, so only tiles that near meet;
   the others (three quarters of all pairs) are skipped.
4. A pair of tiles is compared completely, by numpy exclusive-or and bit
   counts. It gives a spanning forest of its links (fewer rows than the tiles
   have members), never all pairs of a group of near copies.
5. The forests become components by distributed contraction.

The work grows with the square of the number of distinct fingerprints (a 400
million-th of a second a pair and core), as the method has it; rows and bytes
moved grow with the tiles.

Defined results: null, empty and wordless texts have fingerprint zero and link
like any other; one or two words are one shingle; repeated rows and equal
texts share a fingerprint; ties (a bit set in exactly half of the hashes) give 0;
a row without an id gets the smallest id of its component (null if there is
none); an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_pieces
from .components import components

K, SEED, RADIUS = 3, 42, 3
TILE = 16384
BUFFER = 1 << 16              # shingles whose bits are counted at once: 4 MB
STEP = 1 << 20                # pairs compared at once: 8 MB


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of every run of ``K`` words (of all words, if fewer)."""
    import xxhash

    runs = zip(*(words[i:] for i in range(K))) if len(words) >= K else [words]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64)


def hash_pieces(text: str | None):
    """Shingle hashes of a text, piece by piece."""
    kept, short = [], True
    for piece in text_pieces(text):
        words = kept + piece.lower().split()
        if len(words) >= K:
            short = False
            yield shingle_hashes(words)
            words = words[1 - K:]
        kept = words
    if short and kept:
        yield shingle_hashes(kept)


def fingerprints(texts) -> np.ndarray:
    """The fingerprints (int64) of a list of texts."""
    texts = list(texts)
    ones, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held, owners, size = [], [], 0

    def flush():
        starts = np.cumsum([0, *map(len, held[:-1])])
        bits = np.unpackbits(np.concatenate(held).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add.at(ones, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
        np.add.at(totals, owners, [len(h) for h in held])

    for i, text in enumerate(texts):
        for hashes in hash_pieces(text):
            held.append(hashes)
            owners.append(i)
            size += len(hashes)
            if size >= BUFFER:
                flush()
                held, owners, size = [], [], 0
    if held:
        flush()
    return np.packbits(2 * ones > totals[:, None], axis=1, bitorder="little").view("<i8").ravel()


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = fingerprints(v.as_py() for v in part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint bigint")


def _join_roots(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite i[k] with j[k]; ``parent`` holds roots before and after."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def forest(left: np.ndarray, right: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) of a spanning forest of all links between two arrays of
    fingerprints, or within one."""
    values = left if right is None else np.concatenate([left, right])
    u = values.view(np.uint64)
    parent = np.arange(len(values))
    first = 0 if right is None else len(left)
    rows = max(1, STEP // max(1, len(values) - first))
    for s in range(0, len(left), rows):
        low = s if right is None else first
        near = np.bitwise_count(u[s:min(s + rows, len(left)), None] ^ u[None, low:]) <= radius
        i, j = np.nonzero(near)
        _join_roots(parent, i + s, j + low)
    moved = np.flatnonzero(parent != np.arange(len(values)))
    return values[moved], values[parent[moved]]


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Stored edges (a, b) of fingerprints that join exactly the components of
    all pairs within ``radius``. ``prints`` has distinct fingerprints."""
    half = lambda v: F.bit_count(v).cast("int")
    hi, lo = half(F.shiftrightunsigned("fingerprint", 32)), half(F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF)))
    rows = prints.select("fingerprint", (hi * 33 + lo).alias("cell"))
    # at most 33 x 33 rows, so the broadcast is bounded
    cells = stored(rows.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("long").alias("tiles")), "simhash-cells")
    named = lambda cell, i: F.shiftleft(cell.cast("long"), 40) + i
    tiles = rows.join(F.broadcast(cells), "cell").groupBy(
        "cell", F.pmod(F.xxhash64("fingerprint"), F.col("tiles")).alias("i")).agg(F.collect_list("fingerprint").alias("members"))
    near = [(h, k) for h in range(-radius, radius + 1) for k in range(-radius, radius + 1) if abs(h) + abs(k) <= radius]
    step = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(k).alias("k")) for h, k in near]))
    met = tiles.withColumn("d", step).filter(F.col("cell") % 33 + F.col("d.k") == F.pmod(F.col("cell") + F.col("d.k"), F.lit(33)))
    met = met.withColumn("other", F.col("cell") + 33 * F.col("d.h") + F.col("d.k")).join(
        F.broadcast(cells.withColumnsRenamed({"cell": "other", "tiles": "others"})), "other")
    met = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    own, other = named(F.col("cell"), F.col("i")), named(F.col("other"), F.col("j"))
    met = met.select(F.least(own, other).alias("one"), F.greatest(own, other).alias("two"), "members")

    def compare(key, group):
        sides = [v.values.to_numpy() for v in group.column("members").combine_chunks()] if group.num_rows else []
        a = b = np.empty(0, np.int64)
        if key[0].as_py() == key[1].as_py():
            a, b = forest(sides[0], None, radius)
        elif len(sides) == 2:
            a, b = forest(*sides, radius)
        return pa.table({"a": a, "b": b})

    return stored(met.groupBy("one", "two").applyInArrow(compare, "a bigint, b bigint"), "simhash-links")


def link(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint and component_id (smallest doc_id reachable) of
    every row."""
    rows = stored(fingerprinted(docs), "simhash")
    prints = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    labels = components(links(prints, radius, tile)).withColumnsRenamed({"node": "_n", "component": "_c"})
    marked = stored(prints.join(labels, F.col("fingerprint") == F.col("_n"), "left").select(
        "fingerprint", "first", F.coalesce("_c", "fingerprint").alias("class")), "simhash-classes")
    smallest = marked.groupBy("class").agg(F.min("first").alias("component_id"))
    classes = stored(marked.join(smallest, "class").select(F.col("fingerprint").alias("_f"), "component_id"), "simhash-components")
    # a plain join of two scans: a frequent fingerprint's rows are split by the skew join
    return rows.join(classes, F.col("fingerprint") == F.col("_f")).select("doc_id", "fingerprint", "component_id")
