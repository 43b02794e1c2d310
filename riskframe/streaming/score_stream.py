"""Request scoring as a stream (IO8, PR20, ML7, IO9 on ``readStream``).

JSON lines arrive in a folder; each micro-batch is parsed with the request
schema, validated, scored with stored artefacts (scaler stats, vocabulary,
a linear scorer or any fitted Spark ML model) and written by
``foreachBatch``:

* ``responses/batch_id=<id>`` - accepted requests with their response;
* ``quarantine/batch_id=<id>`` - rejected requests with error codes;
* the prediction log - appended in its own ``try`` under a per-batch key
  (dynamic partition overwrite), so a replay never duplicates log rows; a
  failing log write is reported and never fails the scoring batch.

Per-batch folders are overwritten on replay, so a restarted query rewrites
the same files instead of duplicating them.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import serve as SV
from ..operators.models import LinearScorer
from ..sources import io as IO
from .usage_stream import scratch_dir


def basic_scorer(stats: Mapping[str, tuple[float, float]], scorer: LinearScorer) -> Callable[[DataFrame], DataFrame]:
    """Accepted basic requests -> (row_id, prediction, probability, risk_level)."""
    def run(ok: DataFrame) -> DataFrame:
        return SV.respond(SV.to_model_space_basic(ok, stats), scorer)
    return run


def advanced_scorer(stats: Mapping[str, tuple[float, float]], vocab: Mapping[str, Sequence],
                    scorer: LinearScorer) -> Callable[[DataFrame], DataFrame]:
    def run(ok: DataFrame) -> DataFrame:
        return SV.respond(SV.to_model_space_advanced(ok, stats, vocab), scorer)
    return run


def _batch_writer(out: str, schema_rules, score: Callable[[DataFrame], DataFrame], mode: str, log_path: str | None,
                  stream_key: str = "stream"):
    def write(batch: DataFrame, batch_id: int) -> None:
        v = R.validate(batch, schema_rules)
        ok = v.filter(F.size(R.ERRORS) == 0).drop(R.ERRORS)
        bad = v.filter(F.size(R.ERRORS) > 0)
        responses = score(ok)
        responses.write.mode("overwrite").parquet(os.path.join(out, "responses", f"batch_id={batch_id}"))
        bad.select("row_id", "raw", R.ERRORS).write.mode("overwrite").parquet(
            os.path.join(out, "quarantine", f"batch_id={batch_id}"))
        if log_path:
            IO.append_prediction_log(
                batch.sparkSession.read.parquet(os.path.join(out, "responses", f"batch_id={batch_id}")),
                log_path, mode=mode, batch_key=f"{stream_key}-{batch_id}")
    return write


def run_available_now(spark: SparkSession, source: str, mode: str, score: Callable[[DataFrame], DataFrame],
                      out: str | None = None, checkpoint: str | None = None,
                      log_path: str | None = None) -> str:
    """Score every JSON-lines file available under ``source`` and stop."""
    root = scratch_dir(spark, "score_stream")
    out = out or os.path.join(root, "out")
    checkpoint = checkpoint or os.path.join(root, "checkpoint")
    schema = IO.BASIC_REQUEST_SCHEMA if mode == "basic" else IO.ADVANCED_REQUEST_SCHEMA
    rules = R.BASIC_SCHEMA if mode == "basic" else R.ADVANCED_SCHEMA
    lines = spark.readStream.text(source)
    requests = IO.parse_requests(lines, schema)
    # the key is stable across restarts of the same checkpoint: a replayed
    # batch overwrites its own log partition
    import hashlib
    stream_key = f"{mode}-{hashlib.sha1(checkpoint.encode()).hexdigest()[:12]}"
    q = (requests.writeStream.foreachBatch(_batch_writer(out, rules, score, mode, log_path, stream_key))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def advanced_model_scorer(model, stats: Mapping[str, tuple[float, float]], vocab: Mapping[str, Sequence],
                          features: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Accepted advanced requests -> responses from a fitted Spark ML model."""
    def run(ok: DataFrame) -> DataFrame:
        return SV.respond_model(model, SV.to_model_space_advanced(ok, stats, vocab, features), features)
    return run
