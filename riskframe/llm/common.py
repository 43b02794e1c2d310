"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table

#: ASCII white space as the contracts list it (code points 9-13 and 32).
SPACE = r"[\x20\x09-\x0D]"
NON_SPACE = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also when the
    body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def space_words(text: Column) -> Column:
    """Array of the words (runs of non-white-space); null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in; in other
    texts ``lower`` would also change letters outside ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def window_hashes(hashes: Column, length: int) -> Column:
    """Hash of every run of ``length`` elements of an array of word hashes, by
    doubling: the hash of 2k elements joins those of its halves. (``slice``
    inside a lambda would copy the whole array for every window.)"""

    def join(left: Column, right: Column, shift: int) -> Column:
        return F.zip_with(left, F.slice(right, shift + 1, F.greatest(F.size(right), F.lit(1))), lambda a, b: F.xxhash64(a, b))

    def grow(power: Column, k: int, done: Column | None, covered: int) -> Column:
        if length & k:
            done, covered = (power, k) if done is None else (join(done, power, covered), covered + k)
        if covered == length:
            return F.slice(done, 1, F.greatest(F.size(done) - (length - 1), F.lit(0)))
        if done is None or done is power:
            return let(join(power, power, k), lambda p: grow(p, 2 * k, done, covered))
        return let(F.struct(join(power, power, k).alias("p"), done.alias("d")), lambda x: grow(x["p"], 2 * k, x["d"], covered))

    return let(hashes, lambda h: grow(h, 1, None, 0))


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores at its end until no column has it."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def unit_hash(*cols: Column) -> Column:
    """A uniform double in (0, 1) from a 64-bit hash: 52 bits, centred."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the
    lineage is cut, a reuse costs a scan, and lost executors lose nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hash ``_text_hash`` and the whole row as one struct
    ``_row``, so that no column of ``docs`` can clash with a helper's."""
    return docs.select("doc_id", F.xxhash64("text").alias("_text_hash"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def unpacked(rows: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` again, ``text`` replaced if one is given."""
    return rows.select(*[(text if text is not None and c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns])


def broadcast_checked(small: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a *stored* table if its counted rows stay within
    ``max_rows``; else return it plain and let Spark shuffle."""
    return F.broadcast(small) if small.count() <= max_rows else small


def text_pieces(text: str | None, size: int = 1 << 20):
    """UTF-8 pieces of about ``size`` bytes of a text, each ending at white
    space (or at the end), so that no word is cut."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    at = 0
    while at < len(raw):
        end = at + size
        if end < len(raw):
            space = re.compile(rb"[ \t-\r]").search(raw, end)
            end = space.end() if space else len(raw)
        yield raw[at:end]
        at = end


def tile_meetings(rows: DataFrame, key: str, members: Column) -> DataFrame:
    """Rows (``key``, node, n, ...) once for every pair of tiles they take part
    in, with ``own``, ``own_tile`` and the pair: band, i, up, j. Sizes ``n`` in
    ratio 3/4 or more are in equal or neighbouring bands, and a tile holds about
    ``members`` rows (a column of ``band``); tile i of ``band`` meets tile j of
    ``band + up``."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int")
    rows = stored(rows.withColumn("band", band), "tiles")
    tiles = rows.groupBy(key, "band").count().select(key, "band", F.ceil(F.col("count") / members).cast("int").alias("tiles"))
    up = tiles.select(key, (F.col("band") - 1).alias("band"), F.col("tiles").alias("tiles_up"))
    down = tiles.select(key, (F.col("band") + 1).alias("band"), F.col("tiles").alias("tiles_down"))
    tiles = tiles.join(up, [key, "band"], "left").join(down, [key, "band"], "left")
    rows = rows.join(tiles, [key, "band"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    empty = F.array().cast("array<struct<band:int,i:int,up:int,j:int>>")
    tile = F.col("tile")

    def each(count: str, band: Column, up: int, make) -> Column:
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), lambda t: F.struct(
            band.alias("band"), make(t)[0].alias("i"), F.lit(up).alias("up"), make(t)[1].alias("j")))).otherwise(empty)

    meet = F.concat(each("tiles", F.col("band"), 0, lambda t: (F.least(t, tile), F.greatest(t, tile))),
                    each("tiles_up", F.col("band"), 1, lambda t: (tile, t)),
                    each("tiles_down", F.col("band") - 1, 1, lambda t: (t, tile)))
    return rows.withColumn("m", F.explode(meet)).withColumnsRenamed({"band": "own", "tile": "own_tile"}).select(
        "*", "m.*").drop("m", "tiles", "tiles_up", "tiles_down")
