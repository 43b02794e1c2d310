"""Ranked lexical search by bit-sliced Bloom signatures.

``build`` makes the index, which knows nothing of any query. Documents are
grouped into blocks of similar size. A document's Bloom signature holds its
terms, each once for every level of ``LEVELS`` that its frequency reaches, so
absent bits also bound frequencies from above. A block stores its signatures
transposed: slice b holds bit b of all documents of the block. Blocks also
hold the exact document lengths and, for their distinct terms, the number of
documents.

``search`` ranks all documents for a query set, in blocks of bounded size:

1. N, L and the document frequencies of the query's terms are added up from
   the index: exact.
2. For a term, the slices of its bits are joined by *and*: one bitmap per level
   that never misses a document. The highest level that holds bounds the
   frequency, with the exact length that bounds the term's share of the score;
   the weighted sum over the terms bounds the document's score from above.
3. The documents with the ``FIRST`` highest bounds of each item are scored
   exactly from their whole texts; the tenth best score is the item's
   threshold. Items with fewer than ten scores above 0 so far (of rare terms,
   where false presences come first) go on with eight times as many.
4. All documents whose bound reaches the threshold are scored exactly. The
   others are provably below the ten best, so the ranking is exact.

Equal texts score alike and ties go by doc_id, so of the copies of a text in
one task only the ten smallest ids go on to step 3 or 4.

Terms travel as 64-bit hashes in signatures and document frequencies (two of a
corpus of N distinct terms share one with probability N**2 / 2**65); final
scores use the terms themselves.

Defined results: null, empty and term-free texts are no documents (N, L and
ranking leave them out); items without terms get no rows; repeated rows rank
each for itself, ids may repeat or be null (null ids come last among equal
scores); equal scores with equal ids go by the text's hash. Items with equal id and text
count once. Texts are read in pieces, but a text's distinct terms are held. An empty table on either side gives no rows.
Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, text_pieces

TOP = 10
FIRST, MORE, TRIES = 20, 8, 3  # documents scored for the threshold, and how often with more
LEVELS = np.array([1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024, 4096, 16384])
BITS_A_KEY = 16               # bits of a signature per (term, level)
HASHES = 4
LEAST_BITS, MOST_BITS = 256, 1 << 20   # beyond: fuller signatures, looser bounds, same results
BLOCK_FLAGS = 1 << 24         # documents x bits of a block
BLOCK_DOCS = 4096
KNOWN_TERMS = 150_000         # hashes a worker remembers
QUERY_TERMS = 20_000          # terms of items that are searched together
BOUND_CELLS = 1 << 22         # terms x documents bounded at once: 32 MB
CANDIDATES = 200_000          # documents of a broadcast: 16 bytes and their items' numbers each

#: The bytes of a term: letters a-z, digits, all beyond ASCII; others separate.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_counts(text: str | None) -> Counter:
    """How often each term occurs in the whole text. (Pieces end at white
    space, so they cut no term.)"""
    found: Counter = Counter()
    for piece in text_pieces(text):
        found.update(piece.translate(_TABLE).split())
    return found


class TermHashes(dict):
    """term -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, term: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(term)
        if len(self) < KNOWN_TERMS:
            self[term] = value
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def positions(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Signature bits of (term, level): one row per hash function."""
    key = _mix(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    step = (key >> np.uint64(32)) | np.uint64(1)
    return np.stack([(key + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(HASHES)]).astype(np.int64)


def signature_bits(tf: np.ndarray) -> int:
    keys = int(np.searchsorted(LEVELS, tf, "right").sum())
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * keys - 1).bit_length()))


def transposed(documents: list[tuple[np.ndarray, np.ndarray]], bits: int) -> bytes:
    """The transposed signatures: for every bit, a bitmap of the documents."""
    flags = np.zeros((bits, len(documents)), np.uint8)
    for level, least in enumerate(LEVELS):
        held = [(i, h[tf >= least]) for i, (h, tf) in enumerate(documents)]
        held = [(i, h) for i, h in held if len(h)]
        if not held:
            break
        at = np.repeat([i for i, _ in held], [len(h) for _, h in held])
        for row in positions(np.concatenate([h for _, h in held]), level, bits):
            flags[row, at] = 1
    return np.packbits(flags, axis=1).tobytes()


def build(docs: DataFrame) -> DataFrame:
    """The index, stored: one row per block."""
    names = ["bits", "ids", "hashes", "lengths", "slices", "terms", "counts"]

    def run(batches):
        known, open_blocks, id_type = TermHashes(), {}, None

        def block(bits):
            rows = open_blocks.pop(bits)
            terms, counts = np.unique(np.concatenate([r[3] for r in rows]), return_counts=True)
            lists = lambda values, kind: pa.array([values], pa.list_(kind))
            return pa.RecordBatch.from_arrays([
                pa.array([bits], pa.int32()), lists([r[0] for r in rows], id_type), lists([r[1] for r in rows], pa.int64()),
                lists([r[2] for r in rows], pa.int64()), pa.array([transposed([(r[3], r[4]) for r in rows], bits)], pa.binary()),
                lists(terms.view(np.int64), pa.int64()), lists(counts.astype(np.int64), pa.int64())], names)

        for batch in batches:
            id_type = batch.column(0).type
            for i in range(batch.num_rows):
                counts = term_counts(batch.column(2)[i].as_py())
                if not counts:
                    continue
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                h = np.fromiter(map(known.__getitem__, counts), np.uint64, len(counts))
                bits = signature_bits(tf)
                rows = open_blocks.setdefault(bits, [])
                rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), int(tf.sum()), h, tf))
                if len(rows) >= min(BLOCK_DOCS, BLOCK_FLAGS // bits):
                    yield block(bits)
        for bits in list(open_blocks):
            yield block(bits)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(
        run, f"bits int, ids array<{kind}>, hashes array<bigint>, lengths array<bigint>, slices binary, "
             "terms array<bigint>, counts array<bigint>"), "search-index")


class Queries:
    """Items of a query set: their terms, and once ``weigh`` was called the weights."""

    def __init__(self, items: list[tuple], kind: str):
        self.ids, self.kind = [i for i, _ in items], kind
        self.terms = [sorted(term_counts(t)) for _, t in items]
        self.words = sorted({w for ts in self.terms for w in ts})
        number = {w: i for i, w in enumerate(self.words)}
        self.rows = [np.array([number[w] for w in ts], np.int64) for ts in self.terms]
        known = TermHashes()
        self.hashes = np.fromiter(map(known.__getitem__, self.words), np.uint64, len(self.words))
        self.weights, self.n, self.total = np.zeros(len(self.words), np.int64), 0, 0

    def weigh(self, df: dict[int, int], n: int, total: int) -> "Queries":
        self.n, self.total = n, total
        self.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(int(h), 0) + 1)))
                                 for h in self.hashes.view(np.int64)], np.int64)
        return self

    def spread(self, lengths: np.ndarray) -> np.ndarray:
        """m of documents of these lengths."""
        return 100 - 90 + 90 * lengths * self.n // self.total


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of the score, before its weight; grows with tf."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def bounds(q: Queries, bits: int, lengths: np.ndarray, packed: bytes) -> np.ndarray:
    """Upper bounds of the score of every item (rows) and document of a block."""
    bitmaps = np.frombuffer(packed, np.uint8).reshape(bits, -1)
    out = np.empty((len(q.rows), len(lengths)), np.int64)
    step = max(1, BOUND_CELLS // max(1, len(q.words)) // 8)       # bytes of a slice, 8 documents each
    for s in range(0, bitmaps.shape[1], step):
        docs = slice(8 * s, 8 * (s + step))
        top = _term_bounds(q, bits, lengths[docs], bitmaps[:, s:s + step])
        for i, r in enumerate(q.rows):
            out[i, docs] = top[r].sum(axis=0)
    return out


def _term_bounds(q: Queries, bits: int, lengths: np.ndarray, bitmaps: np.ndarray) -> np.ndarray:
    """Upper bounds of every term's weighted share in every document."""
    n, m = len(lengths), q.spread(lengths)
    top, present, rows = np.zeros((len(q.words), n), np.int64), None, np.arange(len(q.words))
    for level, least in enumerate(LEVELS):
        found = np.bitwise_and.reduce(bitmaps[positions(q.hashes[rows], level, bits)], axis=0)
        present = found if present is None else present & found
        some = present.any(axis=1)
        if not some.any():
            break
        rows, present = rows[some], present[some]
        # a document that has this level and not the next one has fewer than the next
        most = np.minimum(LEVELS[level + 1] - 1, lengths) if level + 1 < len(LEVELS) else lengths
        value = share(np.maximum(most, least), m)
        here = np.unpackbits(present, axis=1, count=n).view(bool)
        top[rows] = np.where(here, q.weights[rows, None] * value, top[rows])
    return top


def _blocks(batches):
    for batch in batches:
        for r in range(batch.num_rows):
            bits, ids, hashes, lengths, packed = (batch.column(c)[r] for c in range(5))
            yield bits.as_py(), ids.values, hashes.values.to_numpy(), lengths.values.to_numpy(), packed.as_buffer()


def _order(ids: pa.Array) -> np.ndarray:
    """Rank of every id: ascending, null last."""
    order = pc.sort_indices(pa.chunked_array([ids]), null_placement="at_end").to_numpy()
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    return rank


def _of_each_text(hashes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Marks the ``TOP`` smallest ids of every text."""
    order = np.lexsort((rank, hashes))
    same = hashes[order]
    first = np.searchsorted(same, same, "left")
    keep = np.zeros(len(order), bool)
    keep[order[np.arange(len(order)) - first < TOP]] = True
    return keep


def candidates(index: DataFrame, q: Queries, thresholds: dict[int, int] | None = None, most: int = FIRST,
               only: list[int] | None = None) -> DataFrame:
    """item (number), doc_id, text_hash, bound: without thresholds the ``most``
    highest bounds of every item (of ``only`` these items) in each task, with
    them all documents that reach the item's."""
    least = None if thresholds is None else np.array([max(1, thresholds.get(i, 1)) for i in range(len(q.ids))], np.int64)
    others = [] if only is None else sorted(set(range(len(q.ids))) - set(only))
    names, kind = ["item", "doc_id", "text_hash", "bound"], index.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        def made(items, ids, hashes, values):
            return pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), ids, pa.array(hashes), pa.array(values)], names)

        def best(table):
            """The ``most`` highest bounds of every item."""
            at = np.lexsort((-table["bound"].to_numpy(), table["item"].to_numpy()))
            items = table["item"].to_numpy()[at]
            return table.take(pa.array(at[np.arange(len(at)) - np.searchsorted(items, items, "left") < most]))

        held = None
        for bits, ids, hashes, lengths, packed in _blocks(batches):
            keep = np.flatnonzero(_of_each_text(hashes, _order(ids)))
            bound = bounds(q, bits, lengths, packed)[:, keep]
            if least is not None:
                item, at = np.nonzero(bound >= least[:, None])
                for s in range(0, len(item), 100_000):
                    i, a = item[s:s + 100_000], at[s:s + 100_000]
                    yield made(i.astype(np.int32), ids.take(pa.array(keep[a])), hashes[keep[a]], bound[i, a])
                continue
            bound[others] = 0
            few = np.argpartition(-bound, most - 1, axis=1)[:, :most] if bound.shape[1] > most else np.tile(
                np.arange(bound.shape[1]), (len(bound), 1))
            item, at = np.repeat(np.arange(len(bound)), few.shape[1]), few.ravel()
            some = bound[item, at] > 0
            item, at = item[some], at[some]
            new = pa.Table.from_batches([made(item.astype(np.int32), ids.take(pa.array(keep[at])), hashes[keep[at]], bound[item, at])])
            held = best(new if held is None else pa.concat_tables([held, new]).combine_chunks())
        if held is not None:
            yield from held.to_batches()

    return index.select("bits", "ids", "hashes", "lengths", "slices").mapInArrow(
        run, f"item int, doc_id {kind}, text_hash bigint, bound bigint")


def _ranked(rows: DataFrame, value: str, most: int = TOP) -> DataFrame:
    """The ``most`` rows of every item by falling ``value``, with their rank."""
    order = Window.partitionBy("item").orderBy(F.desc(value), F.asc_nulls_last("doc_id"), "text_hash")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def rescored(docs: DataFrame, chosen: DataFrame, q: Queries) -> DataFrame:
    """Exact scores of the chosen (item, doc_id, text_hash): a row for every
    row of ``docs`` with that id and text."""
    wanted = stored(chosen.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.collect_set("item").alias("items")), "search-wanted")
    size = wanted.agg(F.sum(F.lit(24) + 4 * F.size("items"))).first()[0] or 0
    if size <= 24 * CANDIDATES:                 # bytes, so that long lists count
        wanted = F.broadcast(wanted)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(
        wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select(
        "doc_id", "text_hash", "text", "items")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, items, scores = [], [], []
            for r in range(batch.num_rows):
                counts = term_counts(batch.column(2)[r].as_py())
                m = q.spread(np.int64(sum(counts.values())))
                for item in batch.column(3)[r].as_py():
                    tf = np.array([counts.get(w, 0) for w in q.terms[item]], np.int64)
                    at.append(r)
                    items.append(item)
                    scores.append(int((q.weights[q.rows[item]] * share(tf, m)).sum()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int32()), batch.column(0).take(pa.array(at, pa.int64())),
                 batch.column(1).take(pa.array(at, pa.int64())), pa.array(scores, pa.int64())], ["item", "doc_id", "text_hash", "score"])

    return rows.mapInArrow(run, f"item int, doc_id {kind}, text_hash bigint, score bigint").filter("score > 0")


def _search_block(docs: DataFrame, index: DataFrame, q: Queries) -> DataFrame:
    def frequencies(batches):
        wanted, order = np.sort(q.hashes.view(np.int64)), None
        found = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                terms, counts = (batch.column(c)[r].values.to_numpy() for c in (0, 1))
                order = np.argsort(terms)
                at = order[np.minimum(np.searchsorted(terms, wanted, sorter=order), len(terms) - 1)]
                found += np.where(terms[at] == wanted, counts[at], 0)
        some = found > 0
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some]), pa.array(found[some])], ["term", "df"])

    df = index.select("terms", "counts").mapInArrow(frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    total = index.agg(F.sum(F.size("ids").cast("long")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, v: a + v))).first()
    # at most one row per term of the query block
    q.weigh({r["term"]: r["df"] for r in df.collect()}, total[0] or 0, total[1] or 1)
    reached, most, missing = {}, FIRST, list(range(len(q.ids)))
    for _ in range(TRIES):
        first = _ranked(candidates(index, q, None, most, missing), "bound", most)
        scored = _ranked(rescored(docs, first.select("item", "doc_id", "text_hash"), q), "score")
        # one row per item; without TOP documents so far, any score counts
        reached |= {r["item"]: r["least"] for r in scored.groupBy("item").agg(
            F.count("*").alias("c"), F.min("score").alias("least")).filter(F.col("c") == TOP).collect()}
        most, missing = most * MORE, [i for i in missing if i not in reached]
        if not missing:
            break
    left = candidates(index, q, reached)
    found = _ranked(rescored(docs, left.select("item", "doc_id", "text_hash"), q), "score")
    names = q.ids

    def named(batches):
        for batch in batches:
            ids = pa.array(names, kind).take(batch.column(0))
            yield pa.RecordBatch.from_arrays([ids, *batch.columns[1:]], ["item_id", "rank", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(q.kind)
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return found.select("item", "rank", "doc_id", "score").mapInArrow(
        named, f"item_id {q.kind.simpleString()}, rank int, doc_id {id_kind}, score bigint")


def query_blocks(items: DataFrame, most: int = QUERY_TERMS):
    """The items (item_id, text), each once, in lists of bounded size."""
    held, terms = [], 0
    rows = items.select("item_id", "text").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        n = len(term_counts(r["text"]))
        if held and terms + n > most:
            yield held
            held, terms = [], 0
        if n:
            held.append((r["item_id"], r["text"]))
            terms += n
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the ``TOP`` best documents of every item."""
    index = build(docs) if index is None else index
    kind = items.schema["item_id"].dataType
    found = None
    for block in query_blocks(items):
        part = stored(_search_block(docs, index, Queries(block, kind)), "search-found")
        found = part if found is None else found.unionByName(part)
    if found is None:
        id_kind = docs.schema["doc_id"].dataType.simpleString()
        found = docs.sparkSession.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id {id_kind}, score bigint")
    return found
