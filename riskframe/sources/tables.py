"""Readers for the base tables.

All reads go through ``spark.read.parquet`` so Catalyst prunes columns and
pushes filters into the scan; nothing here materialises data.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one base table (a parquet file or directory) from ``sf_dir``."""
    return spark.read.parquet(table_path(sf_dir, name))
