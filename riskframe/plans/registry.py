"""Registry of named queries: a Spark builder plus (optionally) the DuckDB
oracle SQL for the same result.

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame that
reads the whole base tables (directly or through the derived views).
Computed doubles are rounded to 6 places on both sides, every column is
aliased, and counts are bigint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that all registrations run."""
    from . import (  # noqa: F401
        q_usage, q_prep, q_features, q_scoring, q_explain, q_serve,
        q_retrieval, q_profile, q_ml, q_stream, flagship,
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column to ``digits`` places (oracle hygiene);
    ``+ 0.0`` turns a negative zero into 0.0."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import DoubleType, FloatType

    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name)
        out.append(c)
    return df.select(*out)
