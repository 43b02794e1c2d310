"""The thin queries of the corpus operators and their DuckDB SQL.

Each query applies its operator with production parameters to the whole
table and derives the digest columns from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import (
    decontaminate, jaccard, licenses, lines, mixing, quality, search, secrets, sharding, simhash, tokens, toxicity, whitening)
from .common import documents


def _digest(spans: Column, name: str, kinds: tuple[str, ...]) -> Column:
    chosen = F.filter(spans, lambda s: s[name].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s[name], s["start"], s["end"])), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias("n_" + kind)
    base = _digest(F.col("spans"), "kind", secrets.KINDS[:3])
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(base, 256).alias("base_sha256"),
                        _digest(F.col("spans"), "kind", secrets.KINDS).alias("spans"), n("literal"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """The model of the labelled rows that are not held out."""
    return toxicity.fit(docs, labels.filter(~held_out(F.col("doc_id"))))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity_model(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clean(documents(spark, sf_dir)).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(documents(spark, sf_dir), tokenizer_path())


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.col("licenses.license"))), ",").alias("names"),
        F.coalesce(F.array_max(F.col("licenses.coverage")), F.lit(0.0)).alias("best_coverage"),
        F.array_join(F.transform("licenses", lambda s: F.concat_ws(":", s["license"], s["start"], s["end"])), ",").alias("spans"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(read_table(spark, sf_dir, "embeddings"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_secrets, op2_jaccard_join, op3_decontamination, op4_toxicity, op5_mixing, op6_line_dedup, op7_token_output,
    op8_licenses, op9_quality, op10_sharding, op11_whitening, op12_search, op13_simhash, pipeline)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

ORACLES = {
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                  regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, len(g) AS n, array_to_string(g, ' ') AS g FROM (
  SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [w]
                         ELSE [w[i:i + 9] FOR i IN range(1, len(w) - 8)] END) AS g FROM b)),
spans AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)),
hits AS (SELECT r, i, spans.n, item FROM spans JOIN items ON spans.g = items.g AND spans.n = items.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)""",
    "op12_search": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                  regexp_extract_all({_LOWER}, '{_TERM}') AS t FROM documents),
stats AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM items) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, stats GROUP BY term, n),
m AS (SELECT doc_id, r, 100 - 90 + (90 * CAST(len(t) AS BIGINT) * n) // l AS m FROM d, stats WHERE len(t) > 0),
scored AS (SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
           FROM items JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, doc_id, r),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score
           FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
