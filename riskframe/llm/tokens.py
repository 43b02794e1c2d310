"""Token-id output: documents -> ids -> range-coded block files -> ids.

``write`` puts the documents in ascending doc_id order (a range shuffle and
a sort within partitions), encodes them with a tokenizer of the ``tokenizers`` library,
ends each with ``END`` and stores segments of whole documents. A segment is one row of a Parquet folder
in the shared directory, so that Spark commits files atomically: its frame
holds blocks of ``BLOCK`` ids, each coded independently by the adaptive
context-mixing range coder and carrying its number of ids, payload size and the
crc32 of payload and ids. ``read`` checks every checksum and returns the documents' ids.

Frame (little-endian): magic ``CMR1``, uint32 block size, uint64 ids, uint32
blocks; per block uint32 ids, uint32 payload bytes, uint32 crc32 of the
payload, uint32 crc32 of the ids as uint32; then the payloads.

Defined results: null and empty texts have the end id only; null ids come
first; rows with equal ids are ordered by text; an empty table gives an empty
folder and no rows; only doc_id and text are read. A damaged block raises ``ValueError``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rangecoder
from .common import broadcast_checked, shared_path, stored

END = 0
BLOCK = 4096
SEGMENT = 1 << 22          # ids after which a segment ends (with its document)
MAX_BROADCAST_SEGMENTS = 1_000_000
MAGIC = b"CMR1"


class Encoder:
    """Ids of whole texts. A space that a non-space follows always starts a
    new piece in byte-level BPE, so texts are cut there and each distinct piece is
    encoded once by the library; texts with a white-space run around a space, where that
    does not hold, go to the library whole."""

    RUNS = re.compile(r"\s \s|\s $")
    SPACE = re.compile(r"\s")

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        """Encode the new ``pieces``, each standing for itself after a space."""
        space = self.SPACE.search
        plain = [p for p in pieces if p and not space(p)]
        odd = [p for p in pieces if not p or space(p)]
        parts, lengths = [], []
        if plain:
            # one call for all: a piece starts at each id that begins with a space
            ids = self.whole(["".join(" " + p for p in plain)])[0]
            at = np.flatnonzero(self.spaced[ids])
            if len(at) == len(plain) and at[0] == 0:
                parts.append(ids)
                lengths.append(np.diff(np.append(at, len(ids))))
            else:
                odd = plain + odd
                plain = []
        rows = self.whole([" " + p for p in odd]) if odd else []
        parts += rows
        lengths.append(np.array([len(r) for r in rows], np.int64))
        for p in plain + odd:
            self.known[p] = len(self.known)
        self.ids = np.concatenate([self.ids, *parts])
        self.lengths = np.concatenate([self.lengths, *lengths])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        if len(self.known) > self.most:
            self.forget()
        cut = [None if self.RUNS.search(t) else t.split(" ") for t in texts]
        new = {p for parts in cut if parts for p in parts[1:]} - self.known.keys()
        if new:
            self.learn(sorted(new))
        firsts = self.whole([parts[0] if parts else t for parts, t in zip(cut, texts)])
        out, known = [], self.known
        for first, parts in zip(firsts, cut):
            if parts is None or len(parts) == 1:
                out.append(np.append(first, np.uint32(END)))
                continue
            which = np.fromiter(map(known.__getitem__, parts[1:]), np.int64, len(parts) - 1)
            lengths = self.lengths[which]
            ends = np.cumsum(lengths)
            take = np.arange(ends[-1]) + np.repeat(self.starts[which] - ends + lengths, lengths)
            out.append(np.concatenate([first, self.ids[take], [END]]).astype(np.uint32))
        return out


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The frame of a segment."""
    n = len(ids)
    if n and ids.max() >= rangecoder.IDS:
        raise ValueError("ids must be below 65536")
    blocks = -(-n // block)
    width = min(block, n)
    rows = np.zeros(blocks * width, np.uint32)
    rows[:n] = ids
    rows = rows.reshape(blocks, width) if blocks else rows.reshape(0, 1)
    payloads: list[bytes] = rangecoder.encode(rows) if blocks else []
    heads = []
    for i, p in enumerate(payloads):
        own = ids[i * width:(i + 1) * width]
        heads.append(struct.pack("<IIII", len(own), len(p), zlib.crc32(p), zlib.crc32(own.astype("<u4").tobytes())))
    return b"".join([MAGIC, struct.pack("<IQI", block, n, blocks), *heads, *payloads])


def unpack(frame: bytes) -> np.ndarray:
    """The ids of a frame; every checksum is verified."""
    if frame[:4] != MAGIC:
        raise ValueError("not a token segment")
    _, n, blocks = struct.unpack_from("<IQI", frame, 4)
    heads = [struct.unpack_from("<IIII", frame, 20 + 16 * i) for i in range(blocks)]
    at, payloads = 20 + 16 * blocks, []
    for i, (_, size, crc, _) in enumerate(heads):
        payloads.append(frame[at:at + size])
        at += size
        if zlib.crc32(payloads[-1]) != crc:
            raise ValueError(f"block {i}: payload checksum differs")
    if not blocks:
        return np.empty(0, np.uint32)
    rows = rangecoder.decode(payloads, max(h[0] for h in heads))
    for i, (count, _, _, crc) in enumerate(heads):
        if zlib.crc32(rows[i, :count].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i}: id checksum differs")
    return np.concatenate([rows[i, :h[0]] for i, h in enumerate(heads)]).astype(np.uint32)


def write(docs: DataFrame, tokenizer: str, path: str, segment: int = SEGMENT) -> None:
    """Write the segments (part, segment, doc_ids, lengths, n_ids, frame) of
    all documents under ``path``, in ascending doc_id order."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, number = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        held, owners, size, id_type = [], [], 0, None

        def flush():
            lengths = [len(x) for x in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([owners], pa.list_(id_type)),
                 pa.array([lengths], pa.list_(pa.int32())), pa.array([sum(lengths)], pa.int64()),
                 pa.array([pack(np.concatenate(held))], pa.binary())],
                ["part", "segment", "doc_ids", "lengths", "n_ids", "frame"])

        for batch in batches:
            id_type = batch.column(0).type
            owner, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for i in range(0, len(texts), 256):
                for o, ids in zip(owner[i:i + 256], encoder(texts[i:i + 256])):
                    held.append(ids)
                    owners.append(o)
                    size += len(ids)
                    if size >= segment:
                        yield flush()
                        held, owners, size, number = [], [], 0, number + 1
        if held:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, f"part int, segment int, doc_ids array<{kind}>, lengths array<int>, n_ids bigint, frame binary"
                       ).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    and, if asked for, the ids, of every stored document."""
    table = spark.read.parquet(path)
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()
    # offsets: segments within a part, parts before it (a window over one row per part)
    index = stored(table.select("part", "segment", "n_ids"), "token-index")
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = index.groupBy(F.col("part").alias("_p")).agg(F.sum("n_ids").alias("n")).select(
        "_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    offsets = index.join(totals, F.col("part") == F.col("_p")).select(
        F.col("part").alias("_part"), F.col("segment").alias("_segment"),
        (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("base"))
    offsets = broadcast_checked(stored(offsets, "token-offsets"), MAX_BROADCAST_SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                owners = batch.column(1).slice(i, 1).flatten()
                lengths = np.array(batch.column(2)[i].as_py(), np.int64)
                ids = unpack(batch.column(3)[i].as_py()).astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                columns = [owners, pa.array(starts + batch.column(0)[i].as_py()), pa.array(lengths), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = table.join(offsets, (F.col("part") == F.col("_part")) & (F.col("segment") == F.col("_segment")))
    schema = f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return rows.select("base", "doc_ids", "lengths", "frame").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the documents' ids and return what the files hold."""
    path = shared_path(docs.sparkSession, "tokens")
    write(docs, tokenizer, path)
    return read(docs.sparkSession, path)
