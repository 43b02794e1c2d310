import pytest
from pyspark.sql import types as T

from tests.conftest import spark, tmp_dir  # noqa: F401

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):  # noqa: F811
    """Documents from (doc_id, text[, lang, source]) tuples."""

    def build(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            # names that operators use for their own columns
            for name in ("node", "component", "key", "size", "rank", "words", "score", "spans", "n", "shard", "kept", "bin"):
                df = df.withColumn(name, df["lang"])
        return df

    return build


LONG = " ".join(f"w{i % 977}x{i % 53}" for i in range(40_000))
EDGES = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "one two"), (6, "\n\n\n"), (7, LONG), (8, LONG + " tail"),
    (9, "Ünïcödé straße 東京 𝒳   nbsp"), (9, "Ünïcödé straße 東京 𝒳   nbsp"), (None, "null id text here to see it"),
    (11, "x"), (12, "null lang", None, None), (13, "a\x00b \x0b c\x0cd \x1f e"),
]
