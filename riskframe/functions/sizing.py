"""Size checks in front of every broadcast.

A side is broadcast only when its row count is proven small: either bounded
by construction (a stats table with one row per column, a vocabulary capped
by ``MAX_ONEHOT_WIDTH``) or counted here. Beyond the bound the caller gets the
plain DataFrame back and Spark plans a shuffle join instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def broadcast_if_small(df: DataFrame, max_rows: int = K.MAX_BROADCAST_ROWS,
                       known_bound: int | None = None) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows.

    ``known_bound`` skips the count when the caller can prove the bound
    (for instance two classes, 21 features, 13 age bands).
    """
    if known_bound is not None and known_bound <= max_rows:
        return F.broadcast(df)
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where each row costs much (tree learners, row
    explanations) and a small table is stored as a few files. Repartitions only
    when there are fewer partitions than the cluster can run at once; large
    inputs keep their partitioning and pay no shuffle."""
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(par) if df.rdd.getNumPartitions() < par else df


PART_ROWS = 200_000        # rows of one task's part for a tree learner


def dealt(df: DataFrame, rows: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Equal parts for a tree learner, whatever files or joins the rows come
    from: every part sends the statistics of all open nodes in every pass, and
    the fullest one decides how long a pass takes. One part a core, and a
    multiple of that where parts would be larger than ``part_rows``."""
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(par * max(1, -(-rows // (part_rows * par))))
