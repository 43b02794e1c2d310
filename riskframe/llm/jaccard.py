"""N-gram Jaccard join on 5-word shingles, exact.

1. Every text becomes a sorted array of 64-bit shingle hashes; its 64-bit
   digest (``node``) stands for all documents with the same set (two sets of N
   share a digest by chance with probability N**2 / 2**65: 1e-5 at 15 million).
2. Candidates by prefix filter: two sets with Jaccard >= t share one of the
   first n - ceil(t n) + 1 shingles in any common order. The order puts
   shingles that many documents share last (a bounded list of heavy shingles,
   counted over all documents), so shared passages do not fill the prefixes.
   Keys held by one node only end there.
3. Within a key a leader is compared with all members first; members of its
   component need no further pair. What stays unresolved is cut into
   size-banded tiles: sets whose sizes differ by more than t cannot link, so
   only tiles of equal or neighbouring bands meet, and a tile holds a bounded number of members.
   Members of the key's largest component meet only tiles of other members,
   so rows grow with the members outside it, not with the square of the group.
   Keys of the same smallest member meet as one.
4. Each set carries a hashed bitmap of two to four bits per shingle (a longer
   one is folded to compare it with a shorter one). |A n B| <= |A| - popcount(a & ~b), since
   each bit set in a alone stands for a shingle of A that B lacks; with the
   same for B, bit counts drop most pairs before the exact intersection of
   the sorted arrays decides.
5. Links -> distributed connected components.

A pair is skipped only if it shares no prefix key, the bounds exclude it, or
both are already in one component; so components are exact. Large groups of
near copies cost one comparison per member and leader.

Defined results: null, empty or wordless text has 0 shingles and is alone;
repeated rows have equal sets and link; texts with fewer than 5 words have one shingle; an
empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_checked, packed, stored, unpacked
from .components import components

K = 5
NUMERATOR, DENOMINATOR = 75, 100
HEAVY_LOCAL = 3            # distinct texts of one chunk that share a shingle
HEAVY_MAX = 200_000        # heavy shingles kept (broadcast: 1.6 MB); order only, never drops
KNOWN_WORDS = 150_000      # hashes a worker remembers (about 20 MB); others are computed again
CHUNK = 2_000_000          # shingles gathered before a flush
KEYS = 250_000             # prefix keys gathered before a flush: some 20 MB while they are sorted and packed
STAR_ROUNDS = 6
TILE, TILE_SHINGLES = 256, 1 << 20   # texts of a tile, and the shingles they have together
LEAST_BITS, MOST_BITS = 256, 1 << 16
MAX_BROADCAST_NODES = 1_000_000   # ids of documents whose sets are needed: 16 MB


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = value
        return value


def _values(column: pa.Array):
    """Values one by one, so that a batch of texts is not held twice."""
    return (v.as_py() for v in column)


def _mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, cache: dict, k: int = K) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    width = min(k, n)
    acc = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j:n - width + 1 + j]
    return np.unique(_mix64(acc))


def digest(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63) if len(shingles) else 0


def bitmap(shingles: np.ndarray) -> bytes:
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(shingles)).bit_length()))
    flags = np.zeros(bits, np.uint8)
    flags[(shingles >> np.uint64(20)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(flags).tobytes()


def _folded(bitmaps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of ``size`` bytes or a multiple, as rows of ``size`` bytes."""
    out = np.empty((len(bitmaps), size // 8), np.uint64)
    for i, x in enumerate(bitmaps):
        words = np.frombuffer(x, np.uint64)
        out[i] = words if len(x) == size else np.bitwise_or.reduce(words.reshape(-1, size // 8), axis=0)
    return out


def described(docs: DataFrame) -> DataFrame:
    """Stored rows (doc_id, text_hash, n, node, bits) of every document, and
    rows without n that carry the heavy shingles of a chunk (keys, counts)."""
    numbers = pa.list_(pa.int64())
    names = ["doc_id", "text_hash", "n", "node", "bits", "keys", "counts"]

    def run(batches):
        cache, seen, held, size, id_type = WordHashes(), set(), [], 0, None

        def heavy():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts >= HEAVY_LOCAL
            return pa.RecordBatch.from_arrays(
                [pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                 pa.nulls(1, pa.binary()), pa.array([keys[many].view(np.int64)], numbers), pa.array([counts[many]], numbers)], names)

        for batch in batches:
            id_type, ns, nodes, bits = batch.column(0).type, [], [], []
            for text in _values(batch.column(2)):
                s = shingle_set(text, cache)
                node = digest(s)
                ns.append(len(s))
                nodes.append(node)
                bits.append(bitmap(s))
                if len(s) and node not in seen:
                    seen.add(node)
                    held.append(s)
                    size += len(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(bits, pa.binary()),
                 pa.nulls(len(ns), numbers), pa.nulls(len(ns), numbers)], names)
            if size >= CHUNK:
                yield heavy()
                held, size = [], 0
        if held:
            yield heavy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(
        run, f"doc_id {kind}, text_hash bigint, n bigint, node bigint, bits binary, keys array<bigint>, counts array<bigint>"),
        "jaccard-described")


def heavy_shingles(table: DataFrame, most: int = HEAVY_MAX) -> np.ndarray:
    """The (at most ``most``) shingles shared by many texts, sorted."""
    pairs = table.filter("n is null").select(F.explode(F.arrays_zip("keys", "counts")).alias("x"))
    top = pairs.groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.counts").alias("c")).orderBy(F.desc("c"), "key").limit(most)
    return np.sort(np.array([r[0] for r in top.select("key").toLocalIterator()], np.int64).view(np.uint64))


def prefix(shingles: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    n = len(shingles)
    need = n - -(-NUMERATOR * n // DENOMINATOR) + 1
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, shingles), len(heavy) - 1)
        common = heavy[at] == shingles
        if common.any():
            shingles = np.concatenate([shingles[~common], shingles[common]])
    return shingles[:need]


def shared_keys(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """Stored rows (key, node) of every prefix key that two nodes hold.

    A task packs its keys by target bucket; of a key that several of its own
    texts hold, only the smallest node travels by key, and the others are
    passed on by a bucket of their own, so that a hot key sends one row per chunk.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * 8
    entry = np.dtype([("key", "<u8"), ("node", "<i8")])

    def pack(batches):
        cache, seen, keys, nodes, size = WordHashes(), set(), [], [], 0

        def flush():
            rows = np.empty(sum(map(len, keys)), entry)
            rows["key"] = np.concatenate(keys)
            rows["node"] = np.repeat(np.array(nodes, np.int64), [len(x) for x in keys])
            rows = rows[np.lexsort((rows["node"], rows["key"]))]
            first = np.ones(len(rows), bool)
            first[1:] = rows["key"][1:] != rows["key"][:-1]
            alone = first & np.append(first[1:], True)
            for kind, chosen, spread in ((0, rows[first], "key"), (1, rows[~alone], "node")):
                bucket = (_mix64(chosen[spread].astype(np.uint64) + np.uint64(kind)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                chosen, bucket = chosen[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                starts = np.concatenate([[0], cuts]) if len(bucket) else np.empty(0, int)
                ends = np.append(cuts, len(bucket)) if len(bucket) else starts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[starts].astype(np.int32)), pa.array(np.full(len(starts), kind, np.int32)),
                     pa.array([chosen[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())], ["bucket", "kind", "packed"])

        for text in (t for batch in batches for t in _values(batch.column(0))):
            s = shingle_set(text, cache)
            node = digest(s)
            if not len(s) or node in seen:
                continue
            seen.add(node)
            p = prefix(s, heavy)
            keys.append(p)
            nodes.append(node)
            size += len(p)
            if size >= KEYS:
                yield from flush()
                keys, nodes, size = [], [], 0
        if keys:
            yield from flush()

    def meet(batches):
        lone, passed = [], []

        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(rows["key"].copy().view(np.int64)), pa.array(rows["node"].copy())], ["key", "node"])

        for batch in batches:
            for kind, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                (passed if kind else lone).append(np.frombuffer(packed, entry))
        if passed:
            rows = np.concatenate(passed)
            for i in range(0, len(rows), 100_000):
                yield out(rows[i:i + 100_000])
        if lone:
            rows = np.concatenate(lone)
            rows = rows[np.lexsort((rows["node"], rows["key"]))]
            new = np.ones(len(rows), bool)
            new[1:] = rows[1:] != rows[:-1]
            rows = rows[new]
            same = rows["key"][1:] == rows["key"][:-1]
            held = np.append(same, False) | np.append(False, same)
            rows = rows[held]
            for i in range(0, len(rows), 100_000):
                yield out(rows[i:i + 100_000])

    packed = docs.select("text").mapInArrow(pack, "bucket int, kind int, packed binary")
    met = packed.repartition(parts, "bucket").mapInArrow(meet, "key bigint, node bigint")
    return stored(met, "jaccard-keys")


def sketches(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored (node, n, bits, doc_id, text_hash, rows) of every node that
    shares a key; the last three name one document of the node."""
    own = table.filter("n > 0").join(keys.select("node").distinct(), "node", "left_semi")
    per_row = own.groupBy("node", "doc_id", "text_hash").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("rows"))
    return stored(per_row.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min(
        F.struct("doc_id", "text_hash", "rows")).alias("x")).select("node", "n", "bits", "x.*"), "jaccard-sketches")


def shingle_sets(docs: DataFrame, light: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored (node, shingles) of the given nodes, from one document each."""
    first = stored(light.join(nodes, "node", "left_semi").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "rows"), "jaccard-first")

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                sets = [shingle_set(t, cache) for t in _values(batch.column(0).slice(i, 256))]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()),
                                                  pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    found = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(
        broadcast_checked(first, MAX_BROADCAST_NODES),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_hash")), "left_semi").select("text").mapInArrow(
        run, "node bigint, shingles binary")
    if first.filter("rows > 1").head(1):     # rows that repeat an id and text
        found = found.dropDuplicates(["node"])
    return stored(found, "jaccard-sets")


def _bound(na, nb, a, b):
    """Upper bound of the intersection from the bit counts (arrays of rows)."""
    only_a = np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(-1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


def _may_link(na, nb, common):
    return DENOMINATOR * common >= NUMERATOR * (na + nb - common)


def verified(docs: DataFrame, pairs: DataFrame, light: DataFrame) -> DataFrame:
    """Stored pairs (a, b) of nodes that link: size band, bit-count bound,
    then exact intersection of the arrays of those that are left."""

    def bounded(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
            xs, ys = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            sizes = np.array([min(len(x), len(y)) for x, y in zip(xs, ys)])
            keep = np.zeros(len(na), bool)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                bound = _bound(na[at], nb[at], _folded([xs[i] for i in at], size), _folded([ys[i] for i in at], size))
                keep[at] = _may_link(na[at], nb[at], bound)
            yield batch.select([0, 1]).filter(pa.array(keep))

    def exact(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                u, v = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                at = np.searchsorted(v, u)
                common = int((v[np.minimum(at, len(v) - 1)] == u).sum())
                keep.append(DENOMINATOR * common >= NUMERATOR * (len(u) + len(v) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda s, x, cols: s.select(*[F.col(c).alias(c + x) for c in ("node", *cols)])
    sizes = side(light, "a", ("n",)), side(light, "b", ("n",))
    rows = pairs.join(sizes[0], F.col("a") == F.col("nodea")).join(sizes[1], F.col("b") == F.col("nodeb")).filter(
        DENOMINATOR * F.least("na", "nb") >= NUMERATOR * F.greatest("na", "nb")).select("a", "b")
    rows = rows.join(side(light, "a", ("n", "bits")), F.col("a") == F.col("nodea")).join(
        side(light, "b", ("n", "bits")), F.col("b") == F.col("nodeb"))
    rows = stored(rows.select("a", "b", "na", "bitsa", "nb", "bitsb").mapInArrow(bounded, "a bigint, b bigint"), "jaccard-bounded")
    sets = shingle_sets(docs, light, rows.select(F.col("a").alias("node")).union(rows.select("b")).distinct())
    rows = rows.join(side(sets, "a", ("shingles",)), F.col("a") == F.col("nodea")).join(
        side(sets, "b", ("shingles",)), F.col("b") == F.col("nodeb"))
    return stored(rows.select("a", "b", "shinglesa", "shinglesb").mapInArrow(exact, "a bigint, b bigint"), "jaccard-links")


def _open(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, node, component) of keys whose members are in two components."""
    labels = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    rows = keys.join(labels, F.col("node") == F.col("_n"), "left").select("key", "node", F.coalesce("_c", "node").alias("component"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    return stored(rows.join(mixed, "key", "left_semi"), "jaccard-open")


def united(open_rows: DataFrame) -> DataFrame:
    """Rows (key, node, component) in which keys of the same smallest member are
    one: near copies share many keys of nearly the same members, and would meet under each."""
    least = open_rows.groupBy(F.col("key").alias("_k")).agg(F.min("node").alias("least"))
    return stored(open_rows.join(least, F.col("key") == F.col("_k")).select(
        F.col("least").alias("key"), "node", "component").distinct(), "jaccard-united")


MEETING = ["key", "band", "i", "up", "j"]


def _by_meeting(batches, each):
    """What ``each`` makes of the whole table of every meeting, of sorted batches."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
        if held is None or not held.num_rows:
            continue
        new = np.zeros(held.num_rows - 1, bool)
        for c in MEETING:
            v = held.column(c).to_numpy()
            new |= v[1:] != v[:-1]
        starts = np.append(0, np.flatnonzero(new) + 1)
        ends = np.append(starts[1:], held.num_rows)
        whole = len(starts) if batch is None else len(starts) - 1      # the last meeting may go on
        for s, e in zip(starts[:whole], ends):
            if e - s > 1:
                yield from each(held.slice(s, e - s)).to_batches()
        held = held.slice(starts[-1]) if batch is not None else None


def _candidates(group: pa.Table):
    """(x, rows y) of a meeting: pairs of different components that pass the bounds."""
    up, i, j = (group.column(c)[0].as_py() for c in ("up", "i", "j"))
    comp, n = (group.column(c).to_numpy() for c in ("component", "n"))
    band, tile = group.column("own").to_numpy() - group.column("band")[0].as_py(), group.column("own_tile").to_numpy()
    left, right = np.flatnonzero((band == 0) & (tile == i)), np.flatnonzero((band == up) & (tile == j))
    if not len(left) or not len(right) or comp.min() == comp.max():
        return
    raw = group.column("bits").to_pylist()
    bits = _folded(raw, min(map(len, raw)))
    for x in left:
        y = right[right > x] if not up and i == j else right
        y = y[comp[y] != comp[x]]
        y = y[DENOMINATOR * np.minimum(n[y], n[x]) >= NUMERATOR * np.maximum(n[y], n[x])]
        y = y[_may_link(n[x], n[y], _bound(n[x], n[y], bits[x], bits[y]))] if len(y) else y
        if len(y):
            yield x, y


def _promising(group: pa.Table) -> pa.Table:
    """The members that some other may link with."""
    held = np.zeros(group.num_rows, bool)
    for x, y in _candidates(group):
        held[x] = True
        held[y] = True
    return group.filter(pa.array(held))


def _joined(group: pa.Table) -> pa.Table:
    """Links (a, b) of a meeting by exact intersection; of members that its links
    already join, no further one."""
    names, comp = (group.column(c).to_numpy() for c in ("node", "component"))
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in group.column("shingles")]
    parent = np.unique(comp, return_inverse=True)[1]      # of each row, the number of its class
    found = []
    for x, near in _candidates(group):
        for y in near:
            if parent[x] == parent[y]:
                continue
            u, v = sets[x], sets[y]
            common = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
            if _may_link(len(u), len(v), common):
                parent[parent == parent[y]] = parent[x]
                found.append(sorted((int(names[x]), int(names[y]))))
    return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})


def tiled_links(docs: DataFrame, open_rows: DataFrame, light: DataFrame) -> DataFrame:
    """Stored links (a, b) between the components of open members, found in size-banded
    tiles: bit counts first name the members that may link, then their sets
    meet. Rows grow with the members of meetings, not with pairs."""
    open_rows = united(open_rows)
    # sizes in ratio t or more are in equal or neighbouring bands
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(DENOMINATOR / NUMERATOR))) + 1e-9).cast("int")
    rows = open_rows.join(light.select(F.col("node").alias("_n"), "n", "bits"), F.col("node") == F.col("_n")).drop("_n")
    # members of a key's largest component need not meet each other: tiles
    # 0 .. others-1 hold the other members, the rest hold those of the largest
    main = open_rows.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy(F.col("key").alias("_m")).agg(
        F.max_by("component", F.struct("c", "component")).alias("main"))
    rows = rows.join(main, F.col("key") == F.col("_m")).withColumn("is_main", F.col("component") == F.col("main")).drop("_m", "main")
    rows = stored(rows.withColumn("band", band), "jaccard-tiles")
    members = F.greatest(F.lit(4), F.least(F.lit(TILE), F.floor(TILE_SHINGLES / F.pow(F.lit(DENOMINATOR / NUMERATOR), F.col("band") + 1))))
    count = rows.groupBy("key", "band").agg(F.count_if(~F.col("is_main")).alias("others"), F.count_if("is_main").alias("mains")).select(
        "key", "band", *[F.ceil(F.col(c) / members).cast("int").alias(c) for c in ("others", "mains")])
    count = count.select("key", "band", "others", (F.col("others") + F.col("mains")).alias("tiles"))
    upper = count.select(F.col("key").alias("_k"), (F.col("band") - 1).alias("_b"),
                         F.col("tiles").alias("tiles_up"), F.col("others").alias("others_up"))
    lower = count.select(F.col("key").alias("_k2"), (F.col("band") + 1).alias("_b2"),
                         F.col("tiles").alias("tiles_down"), F.col("others").alias("others_down"))
    count = count.join(upper, (F.col("key") == F.col("_k")) & (F.col("band") == F.col("_b")), "left").join(
        lower, (F.col("key") == F.col("_k2")) & (F.col("band") == F.col("_b2")), "left").select(
        F.col("key").alias("_key"), F.col("band").alias("_band"), "tiles", "tiles_up", "tiles_down", "others", "others_up", "others_down")
    rows = rows.join(count, (F.col("key") == F.col("_key")) & (F.col("band") == F.col("_band")))
    spread = F.xxhash64("node")
    rows = rows.withColumn("tile", F.when(F.col("is_main"), F.col("others") + F.try_mod(F.pmod(spread, F.lit(1 << 30)), F.col("tiles") - F.col("others")))
                           .otherwise(F.try_mod(F.pmod(spread, F.lit(1 << 30)), F.col("others"))).cast("int"))
    # a meeting is (band of the left tile, left tile, right band - left band, right tile)
    empty = F.array().cast("array<struct<band:int,i:int,up:int,j:int>>")

    def meetings(side: str, make):
        """With every tile of a band, or for the largest component with the others' tiles."""
        reach = F.when(F.col("is_main"), F.col("others" + side)).otherwise(F.col("tiles" + side))
        return F.when(reach > 0, F.transform(F.sequence(F.lit(0), F.greatest(reach, F.lit(1)) - 1), make)).otherwise(empty)

    own = meetings("", lambda j: F.struct(
        F.col("band").alias("band"), F.least(j, F.col("tile")).alias("i"), F.lit(0).alias("up"), F.greatest(j, F.col("tile")).alias("j")))
    above = meetings("_up", lambda j: F.struct(
        F.col("band").alias("band"), F.col("tile").alias("i"), F.lit(1).alias("up"), j.alias("j")))
    below = meetings("_down", lambda i: F.struct(
        (F.col("band") - 1).alias("band"), i.alias("i"), F.lit(1).alias("up"), F.col("tile").alias("j")))
    rows = rows.select("key", "node", "component", "n", "bits", F.col("band").alias("own"), F.col("tile").alias("own_tile"),
                       F.explode(F.concat(own, above, below)).alias("m"))

    met = rows.select("key", "node", "component", "n", "bits", "own", "own_tile", "m.band", "m.i", "m.up", "m.j")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(parts, *MEETING).sortWithinPartitions(*MEETING)
    met = stored(dealt(met).mapInArrow(lambda batches: _by_meeting(batches, _promising), met.schema), "jaccard-promising")
    sets = shingle_sets(docs, light, met.select("node").distinct())
    whole = dealt(met.join(sets.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("_n"))
    return stored(whole.mapInArrow(lambda batches: _by_meeting(batches, _joined), "a bigint, b bigint").distinct(), "jaccard-tile-links")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id of every document row."""
    table = described(docs)
    keys = shared_keys(docs, heavy_shingles(table))
    light = sketches(table, keys)
    links, open_rows = None, keys.select("key", "node", F.col("node").alias("component"))
    for round_ in range(STAR_ROUNDS + 1):
        if round_ < STAR_ROUNDS:
            lead = open_rows.groupBy(F.col("key").alias("_k")).agg(F.min("node").alias("lead"), F.min_by("component", "node").alias("lead_c"))
            members = open_rows.join(lead, F.col("key") == F.col("_k")).filter("component <> lead_c")
            found = verified(docs, members.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), light)
        else:
            found = tiled_links(docs, open_rows, light)
        links = found if links is None else links.union(found)
        labels = components(links)
        if round_ < STAR_ROUNDS:
            # the leader has met all members of its key
            rest = open_rows.select("key", "node").join(
                lead, (F.col("key") == F.col("_k")) & (F.col("node") == F.col("lead")), "left_anti")
            open_rows = _open(rest, labels)
            if not open_rows.head(1):
                break
    rows = table.filter("n is not null")
    marked = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    labels = labels.withColumnsRenamed({"node": "_n", "component": "_c"})
    marked = stored(marked.join(labels, F.col("node") == F.col("_n"), "left").select(
        "node", "first", F.coalesce("_c", "node").alias("component")), "jaccard-classes")
    smallest = marked.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = marked.join(smallest, "component").select(F.col("node").alias("_n"), "component_id")
    return rows.join(classes, (F.col("node") == F.col("_n")) & (F.col("n") > 0), "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents with one row left of each component: its smallest id, and
    of rows that repeat that id and text, one."""
    linked = stored(link(docs).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.min("component_id").alias("component_id"), F.count("*").alias("_rows")), "jaccard-linked")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    first = linked.filter("_id <=> component_id")
    rows = packed(docs)
    kept = rows.join(first.filter("_rows = 1"), same, "left_semi")
    if first.filter("_rows > 1").head(1):
        repeated = rows.join(first.filter("_rows > 1"), same, "left_semi")
        kept = kept.unionByName(repeated.dropDuplicates(["doc_id", "_text_hash"]))
    return unpacked(kept, docs)
