"""Chunking, retrieval, gate, prompts, usage aggregates and streaming."""

import os

from pyspark.sql import functions as F

from riskframe.operators import prompts as PM
from riskframe.operators import retrieval as RT
from riskframe.operators import usage as US
from riskframe.streaming import usage_stream as ST


def _docs(spark, text, source="a.md"):
    return spark.createDataFrame([(1, source, text)], "doc_id long, source string, kb_text string")


def test_chunk_rules(spark):
    md = ("# Title\nintro under title\n## First \nbody 1\n### sub stays\nmore\n\n## \n"
          "## Second \nbody 2\n\n")
    rows = RT.chunk_markdown(_docs(spark, md)).orderBy("chunk_index").collect()
    # title section dropped; '### ' does not split; '## ' with nothing after
    # has no heading match -> file name; unicode whitespace stripped
    assert [r.heading for r in rows] == ["First", "a.md", "Second"]
    assert rows[0].text == "## First \nbody 1\n### sub stays\nmore"
    assert rows[2].text == "## Second \nbody 2"
    pre = RT.chunk_markdown(_docs(spark, "preamble line\n## H\nx")).orderBy("chunk_index").collect()
    assert [(r.heading, r.text) for r in pre] == [("a.md", "preamble line"), ("H", "## H\nx")]
    assert RT.chunk_markdown(spark.createDataFrame([], "doc_id long, source string, kb_text string")).count() == 0


def _index(spark):
    return spark.createDataFrame(
        [(0, [1.0, 0.0], "a.md", "Topic A", "Text A"), (1, [0.0, 1.0], "b.md", "Topic B", "Text B")],
        "vec_id long, embedding array<float>, source string, heading string, text string")


def test_retrieval_reference_cases(spark):
    q = spark.createDataFrame([(10, [1.0, 0.05]), (11, [0.6, 0.6]), (12, [0.0, 0.0])],
                              "query_id long, embedding array<float>")
    hits = RT.gate(RT.top_k(_index(spark), q, k=0), 0.5)        # k=0 -> default 3
    by = {}
    for r in hits.orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append(r)
    assert by[10][0].heading == "Topic A"
    assert isinstance(by.get(11, []), list) and len(by[11]) == 2  # both ~0.707, gate open
    assert 12 not in by                                         # zero norm -> score 0 -> gated out
    scores = {(r.query_id, r.vec_id): r.score for r in RT.cosine_scores(_index(spark), q).collect()}
    assert scores[(12, 0)] == 0.0
    per_q = {r.query_id: r.hits for r in RT.hits_per_query(q, hits).collect()}
    assert per_q[12] == [] and len(per_q[10]) == 2


def test_gate_closed_returns_nothing(spark):
    q = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, embedding array<float>")
    assert RT.gate(RT.top_k(_index(spark), q), 0.99).count() == 0


def test_absent_index_is_empty(spark, tmp_dir):
    idx = RT.read_index(spark, os.path.join(tmp_dir, "nope"))
    assert not RT.is_ready(idx)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert RT.top_k(idx, q).count() == 0


def test_query_blocks(spark):
    q = spark.range(0, 50).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("float")).alias("embedding"))
    hits = RT.top_k(_index(spark), q, k=1, max_block=16)        # forces several broadcast blocks
    assert hits.count() == 50 and hits.select("query_id").distinct().count() == 50


def test_context_and_history(spark):
    hits = spark.createDataFrame([(1, [(1, "H1", "T1"), (2, "H2", "T2")]), (2, [])],
                                 "query_id int, hits array<struct<rank:int,heading:string,text:string>>")
    ctx = {r.query_id: r.c for r in hits.select("query_id", PM.context_block(F.col("hits")).alias("c")).collect()}
    assert ctx[2] == ""
    assert ctx[1] == "Notes:\n(H1) T1\n(H2) T2"
    own = PM.Wording(context_title="", context_entry="{text} <{heading}>")
    assert hits.select(PM.context_block(F.col("hits"), own).alias("c")).first().c == "\nT1 <H1>\nT2 <H2>"
    files = spark.createDataFrame([("a.md", "## x\none\n## y\ntwo"), ("b.md", ""), ("c.md", "# only a title")], "source string, kb_text string")
    files = files.withColumn("doc_id", F.monotonically_increasing_id())
    totals = {(r.source, r.is_total): r.n_chunks for r in RT.chunk_totals(RT.chunk_markdown(files), files).collect()}
    assert totals == {("a.md", False): 2, ("b.md", False): 0, ("c.md", False): 0, (None, True): 2}
    conv = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(8)]
                                 + [(1, 0, "system", "s")], "conv_id long, turn long, role string, text string")
    new, hist = PM.split_turns(conv, 4)
    assert [r.turn for r in new.collect()] == [6]
    kept = hist.orderBy("turn").collect()
    assert [r.turn for r in kept] == [2, 3, 4, 5]


def test_empty_log_summary(spark):
    empty = spark.createDataFrame([], "id long, ts timestamp, mode string, probability double, "
                                      "prediction int, risk_level string")
    s = US.summary(empty).first()
    assert (s.total_predictions, s.by_mode, s.by_risk_level, s.avg_probability, s.by_day) == (0, {}, {}, 0.0, [])
    figs = US.dashboard(US.summary(empty)).collect()
    assert [(f.figure, f.n) for f in figs] == [("total", 0)]


def _write_events(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                "value double, props string").coalesce(1).write.mode("overwrite").parquet(path)


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_dir):
    import datetime as dt
    src = os.path.join(tmp_dir, "events")
    d = dt.datetime
    first = [(i, d(2024, 1, 1 + i % 3, 10), 1, "x", 10.0 * i, "") for i in range(1, 30)]
    _write_events(spark, os.path.join(src, "part1"), first)
    schema = spark.read.parquet(os.path.join(src, "part1")).schema
    out = os.path.join(tmp_dir, "out")
    ck = os.path.join(tmp_dir, "ck")
    ST.run_available_now(spark, src + "/part*", schema, out=out, checkpoint=ck)
    batch = ST.log_from_events(spark, spark.read.parquet(os.path.join(src, "part1")))
    want = {(r.day, r.mode, r.risk_level): r.n for r in batch.groupBy(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), "mode", "risk_level").count()
        .withColumnRenamed("count", "n").collect()}
    got = {(r.day, r.mode, r.risk_level): r.n for r in ST.read_latest(spark, out).collect()}
    assert got == want
    # a second batch: one row in an open window, one row more than a day late
    second = [(100, d(2024, 1, 3, 12), 1, "x", 10.0, ""), (101, d(2023, 12, 25, 0), 1, "x", 10.0, "")]
    _write_events(spark, os.path.join(src, "part2"), second)
    ST.run_available_now(spark, src + "/part*", schema, out=out, checkpoint=ck)
    got2 = {(r.day, r.mode, r.risk_level): r.n for r in ST.read_latest(spark, out).collect()}
    assert not any(k[0] == "2023-12-25" for k in got2)          # late row dropped by the watermark
    key = ("2024-01-03", "basic", "Low")
    assert got2[key] == want.get(key, 0) + 1                    # on-time row counted


def test_score_stream_writes_responses_quarantine_and_log(spark, tmp_dir):
    import json

    from riskframe import constants as K
    from riskframe.operators.models import BASIC_SERVE_SCORER
    from riskframe.streaming import score_stream as SS

    src = os.path.join(tmp_dir, "requests")
    os.makedirs(src)
    good = dict(row_id=1, age_group="50-54", sex="Male", height_cm=170, weight_kg=85, high_bp=True,
                high_chol=True, smoker=True, phys_activity=False, fruits=False, veggies=True,
                gen_health="average", diff_walk=True, education_level="upper secondary", income_level="25-35k")
    bad = dict(good, row_id=2, age_group="999")
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write(json.dumps(good) + "\n" + json.dumps(bad) + "\n")
    stats = {c: (0.0, 1.0) for c in K.BASIC_SCALE_COLS}
    log = os.path.join(tmp_dir, "log")
    out = SS.run_available_now(spark, src, "basic", SS.basic_scorer(stats, BASIC_SERVE_SCORER), log_path=log)
    resp = spark.read.parquet(os.path.join(out, "responses")).collect()
    quar = spark.read.parquet(os.path.join(out, "quarantine")).collect()
    assert [r.row_id for r in resp] == [1] and resp[0].risk_level in K.RISK_LEVELS
    assert [r.row_id for r in quar] == [2] and quar[0].errors == ["age_group:enum"]
    assert spark.read.parquet(log).filter("mode = 'basic'").count() == 1


def test_usage_days_do_not_depend_on_session_zone(spark):
    from riskframe.sources.fixtures import view
    from riskframe.streaming import usage_stream as ST2
    log = view(spark, "/root/testdata/sf0.001", "prediction_log")
    utc = sorted(tuple(r) for r in US.count_by_day(log).collect())
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        la = sorted(tuple(r) for r in US.count_by_day(log).collect())
        inst = log.select(ST2.utc_instant(log).alias("t"))
        la_ts = sorted(tuple(r) for r in inst.groupBy(US.utc_day(F.col("t"), is_ntz=False).alias("day")).count().collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert utc == la == la_ts


def test_partition_topk_exact_with_ties():
    import numpy as np
    rng = np.random.default_rng(3)
    s = rng.integers(0, 4, size=(200, 5)).astype(float)       # heavy ties
    ids = rng.permutation(1000)[:200]
    r, q = RT._top_rows(s, ids, 3)
    for j in range(5):
        want = sorted(range(200), key=lambda i: (-s[i, j], ids[i]))[:3]
        assert list(r[q == j]) == want


def test_usage_counts_are_not_merged_in_one_task(spark, tmp_dir):
    """The file of a batch is written by one task, the aggregation before it is not."""
    from riskframe.streaming import usage_stream as US
    counts = spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count()
    plan = US._one_file(counts)._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "SinglePartition" in plan
    seen = []

    class Batch:
        sparkSession = spark

        def select(self, *cols):
            rows = spark.range(0, 60, 1, 6).select(F.current_timestamp().alias("window_start"), F.lit("m").alias("mode"),
                                                    F.lit("r").alias("risk_level"), F.col("id").alias("n"))
            seen.append(rows.rdd.getNumPartitions())
            tasks = spark.sparkContext.accumulator(0)
            seen.append(tasks)
            return rows.mapInArrow(lambda it: (tasks.add(1), *it)[1:], rows.schema)

    US._writer(tmp_dir)(Batch(), 0)
    assert seen[1].value == seen[0] == 6
    assert spark.read.parquet(f"{tmp_dir}/batch_id=0").rdd.getNumPartitions() == 1
