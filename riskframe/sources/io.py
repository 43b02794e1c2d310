"""Sources and sinks (IO1-IO11, IO14).

Stage hand-off is Parquet with explicit schemas (types survive, columns are
pruned at the scan); CSV stays available as an outer format. Every writer
is a distributed Spark write - nothing passes through the driver except the
one-row spec/metrics records.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, StringType, StructField,
                               StructType)

from .. import constants as K

log = logging.getLogger(__name__)


# ---------------------------------------------------------------- IO1-IO4

def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """IO1: header CSV; an explicit schema avoids a type-inference pass."""
    r = spark.read.option("header", True)
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)


CORRUPT = "_corrupt_record"


def raw_schema(names: Sequence[str], types: Mapping[str, str]) -> StructType:
    """Schema of a CSV with these columns; unlisted ones are text."""
    from pyspark.sql.types import _parse_datatype_string

    return StructType([StructField(n, _parse_datatype_string(types.get(n, "string"))) for n in names])


def read_raw_csv(spark: SparkSession, path: str, types: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """IO1 with declared types: (rows, quarantined lines). The header gives the
    order of the columns (one line is read for it, no inference pass); a line
    with a value that is not of its column's type, or with too many fields, goes to the
    quarantine as text."""
    names = spark.read.option("header", True).csv(path).columns
    schema = raw_schema(names, types)
    rows = spark.read.option("header", True).option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE").schema(
        StructType([*schema.fields, StructField(CORRUPT, StringType())])).csv(path)
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.filter(F.col(CORRUPT).isNotNull())


KEY_CHUNK = 10_000      # equal rows that one task numbers


def with_content_key(df: DataFrame, key: str = "row_id") -> DataFrame:
    """A key for a table that has none: a 128-bit hash of the row's values and
    the number of its occurrence among equal rows. The same table gives the
    same keys whatever its files and partitions.

    Equal rows are counted (map-side) and dealt out again from their count, in
    chunks that are spread over tasks: no window, and a row that fills a
    third of the table is no hot key."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    text = F.to_json(F.struct(*[F.coalesce(c.cast("string"), F.lit("\u0000")).alias(f"c{i}") for i, c in enumerate(cols)]))
    chunks = counted.withColumn("_h", F.md5(text)).withColumn(
        "_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.lit(KEY_CHUNK)))))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.col("_k") * F.lit(KEY_CHUNK)
    dealt = chunks.repartition(parts, "_h", "_k").withColumn(
        "_i", F.explode(F.sequence(first, F.least(first + F.lit(KEY_CHUNK), F.col("_n")) - 1)))
    return dealt.select(F.concat_ws("-", "_h", F.col("_i").cast("string")).alias(key), *cols)


# declared types of the raw tables (the rest is text)
SURVEY_TYPES = {c: "double" for c in [K.BASIC_TARGET_RAW, *K.BASIC_FEATURES]} | {"row_id": "bigint"}
CLINICAL_TYPES = {"id": "bigint", "age": "int", "trestbps": "double", "chol": "double", "thalch": "double",
                  "oldpeak": "double", "ca": "double", K.ADVANCED_TARGET_RAW: "int"}


def read_raw(spark: SparkSession, path: str, mode: str, key: str) -> tuple[DataFrame, DataFrame | None]:
    """A raw survey or clinical table (CSV with header, or Parquet) and its
    quarantined lines; a table without a key column gets a content key."""
    if path.rstrip("/").endswith(".csv"):
        rows, bad = read_raw_csv(spark, path, SURVEY_TYPES if mode == "basic" else CLINICAL_TYPES)
    else:
        rows, bad = spark.read.parquet(path), None
    return (rows if key in rows.columns else with_content_key(rows, key)), bad


def write_stage(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """IO3/IO4: overwrite a stage (Parquet by default, CSV with header)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def read_stage(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """IO2: read a stage back."""
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- IO5-IO7

def write_feature_spec(spark: SparkSession, features: Sequence[str], path: str) -> None:
    """IO5: the ordered feature list as a one-row table ``array<string>``."""
    spark.createDataFrame([(list(features),)], "features array<string>").coalesce(1) \
        .write.mode("overwrite").json(path)


def read_feature_spec(spark: SparkSession, path: str) -> list[str]:
    return list(spark.read.schema("features array<string>").json(path).first()["features"])


def write_metrics(spark: SparkSession, metrics: Mapping[str, object], path: str) -> None:
    """IO6: a metrics record (one JSON row)."""
    spark.createDataFrame([(json.dumps(metrics, ensure_ascii=False),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str) -> dict:
    """A record written by ``write_metrics``."""
    return json.loads(spark.read.text(path).first()["value"])


def write_table_csv(df: DataFrame, path: str) -> None:
    """IO7: a small result table as header CSV."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


# ---------------------------------------------------------------- IO8

BASIC_REQUEST_SCHEMA = StructType([
    StructField("row_id", LongType()), StructField("age_group", StringType()), StructField("sex", StringType()),
    StructField("height_cm", DoubleType()), StructField("weight_kg", DoubleType()),
    StructField("high_bp", BooleanType()), StructField("high_chol", BooleanType()),
    StructField("chol_check", BooleanType()), StructField("diabetes", StringType()),
    StructField("stroke", BooleanType()), StructField("smoker", BooleanType()),
    StructField("phys_activity", BooleanType()), StructField("fruits", BooleanType()),
    StructField("veggies", BooleanType()), StructField("heavy_alcohol", BooleanType()),
    StructField("gen_health", StringType()), StructField("mental_health_days", LongType()),
    StructField("phys_health_days", LongType()), StructField("diff_walk", BooleanType()),
    StructField("any_healthcare", BooleanType()), StructField("no_doc_because_cost", BooleanType()),
    StructField("education_level", StringType()), StructField("income_level", StringType()),
])

ADVANCED_REQUEST_SCHEMA = StructType([
    StructField("row_id", LongType()), StructField("age", LongType()), StructField("sex", StringType()),
    StructField("cp", StringType()), StructField("chol", DoubleType()), StructField("fbs", BooleanType()),
    StructField("thalch", DoubleType()), StructField("exang", BooleanType()),
    StructField("oldpeak", DoubleType()), StructField("ca", LongType()), StructField("thal", StringType()),
])

CHAT_MESSAGE_SCHEMA = ArrayType(StructType([StructField("role", StringType()),
                                            StructField("content", StringType())]))


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet table at ``path``, or an empty one if the path does not
    exist. Every other failure (access, damage, schema) is raised."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def parse_requests(lines: DataFrame, schema: StructType, column: str = "value") -> DataFrame:
    """IO8: JSON text (one object per line, batch or stream) -> typed rows.
    PERMISSIVE: a malformed record becomes all-NULL fields, which validation
    then rejects (``field:missing``); the raw text is kept for quarantine. A
    value that is there but not of its field's type is listed in
    ``type_errors`` (``field:type``) and so never replaced by a default."""
    as_text = StructType([StructField(f.name, StringType()) for f in schema])
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    texts = F.from_json(F.col(column), as_text, {"mode": "PERMISSIVE"})
    wrong = [F.when(F.col(f"t.`{f.name}`").isNotNull() & F.col(f"r.`{f.name}`").isNull(), F.lit(f"{f.name}:type")) for f in schema]
    return lines.select(parsed.alias("r"), texts.alias("t"), F.col(column).alias("raw")).select(
        "r.*", "raw", F.array_compact(F.array(*wrong)).alias("type_errors"))


def read_requests(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return parse_requests(spark.read.text(path), schema)


# ---------------------------------------------------------------- IO9, IO10

LOG_COLUMNS = ["mode", "prediction", "probability", "risk_level"]


def append_prediction_log(responses: DataFrame, path: str, mode: str | None = None,
                          batch_key: str | None = None) -> bool:
    """IO9: add the five aggregate fields (never the request payload) with
    the UTC time, partitioned by (day, batch) for pruning.

    Every write carries a batch key and uses dynamic partition overwrite, so
    re-running the same batch (a task, job or stream micro-batch replayed
    after a failure) replaces its own rows instead of duplicating them. A batch
    keeps the time and day of its first write, so a replay after midnight meets
    the same partition. A failure is logged and reported, never raised: logging
    must not fail scoring."""
    import uuid
    try:
        df = responses if mode is None else responses.withColumn("mode", F.lit(mode))
        spark, ts = responses.sparkSession, F.current_timestamp()
        if batch_key is not None:
            # only the batch's own folders are read (partition pruning)
            earlier = read_prediction_log(spark, path).filter(F.col("batch") == batch_key).agg(
                F.min("ts").alias("ts"), F.min(F.col("day").cast("string")).alias("day")).first()
            if earlier["ts"] is not None:
                ts = F.lit(earlier["ts"])
        day = F.date_from_unix_date(F.floor(F.unix_seconds(ts) / F.lit(86400)).cast("int")).cast("string")
        if batch_key is not None and earlier["day"] is not None:
            day = F.lit(earlier["day"])
        (df.select(*LOG_COLUMNS, ts.alias("ts"), day.alias("day"),
                   F.lit(batch_key or uuid.uuid4().hex).alias("batch"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day", "batch").parquet(path))
        return True
    except Exception as e:  # noqa: BLE001 - by contract
        log.warning("prediction log append failed: %s", e)
        return False


def read_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    """IO10: the log (an absent log reads as empty; a damaged one raises)."""
    return read_or_empty(spark, path, "mode string, prediction int, probability double, "
                                      "risk_level string, ts timestamp, day string, batch string")


# ---------------------------------------------------------------- IO11

def read_markdown_corpus(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """IO11: one row per file ``(source, kb_text)``; an empty folder gives
    no rows."""
    df = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    return df.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("kb_text"))


# ---------------------------------------------------------------- IO14

def save_model(model, path: str) -> None:
    """IO14: Spark ML persistence (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str, kind: str = "random_forest"):
    from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel

    cls = {"random_forest": RandomForestClassificationModel,
           "logistic_regression": LogisticRegressionModel}[kind]
    return cls.load(path)


def save_scaler(spark: SparkSession, stats: Mapping[str, tuple[float, float]], path: str) -> None:
    from ..operators.encode import scaler_table
    scaler_table(spark, stats).coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> dict[str, tuple[float, float]]:
    from ..operators.encode import scaler_from_table
    return scaler_from_table(spark.read.parquet(path))


def save_vocabulary(spark: SparkSession, vocab: Mapping[str, Sequence], path: str) -> None:
    from ..operators.encode import vocabulary_table
    vocabulary_table(spark, vocab).coalesce(1).write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> dict[str, list]:
    rows = spark.read.parquet(path).orderBy("column_name", "position").collect()
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["column_name"], []).append(r["value"])
    return out

