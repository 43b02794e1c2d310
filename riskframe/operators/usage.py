"""Usage aggregates over the prediction log (US1-US7).

The log is append-only and can be large; every figure comes from ONE scan
that is pre-aggregated map-side by (mode, risk_level, day). Everything after
that works on at most |modes| x |risk levels| x |days| rows, so the nested
summary and the dashboard figures never pull log rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import literal_map, py_round


def utc_day(col, is_ntz: bool = True):
    """UTC calendar day as ISO text (``YYYY-MM-DD``), independent of the
    session time zone: a naive ``timestamp_ntz`` is UTC wall-clock time, a
    ``timestamp`` is labelled by its UTC day (from epoch seconds)."""
    if is_ntz:
        return F.date_format(col, "yyyy-MM-dd")
    days = F.floor(F.unix_seconds(col) / F.lit(86400)).cast("int")
    return F.date_from_unix_date(days).cast("string")


def log_day(log: DataFrame, ts: str = "ts"):
    """UTC day of the log's timestamp column."""
    from pyspark.sql.types import TimestampNTZType
    return utc_day(F.col(ts), isinstance(log.schema[ts].dataType, TimestampNTZType))


def usage_cube(log: DataFrame, ts: str = "ts") -> DataFrame:
    """Pre-aggregate: one row per (mode, risk_level, day) with count and the
    sum of probabilities. Partial aggregation happens before the shuffle."""
    return (log.groupBy("mode", "risk_level", log_day(log, ts).alias("day"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("probability").alias("p_sum")))


def total_count(log: DataFrame) -> DataFrame:
    """US1: ``COUNT(*)``."""
    return log.agg(F.count(F.lit(1)).alias("total_predictions"))


def count_by(log: DataFrame, key: str) -> DataFrame:
    """US2/US3: ``GROUP BY key`` counts."""
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def avg_probability(log: DataFrame, decimals: int = K.PROBABILITY_DECIMALS) -> DataFrame:
    """US4: mean probability rounded to 4 places (Python ``round``); empty
    log -> 0.0."""
    return log.agg(F.coalesce(py_round(F.avg("probability"), decimals),
                              F.lit(0.0)).alias("avg_probability"))


def count_by_day(log: DataFrame, ts: str = "ts") -> DataFrame:
    """US5: counts per UTC day, ascending."""
    return (log.groupBy(log_day(log, ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy("day"))


def summary(log: DataFrame, ts: str = "ts",
            decimals: int = K.PROBABILITY_DECIMALS) -> DataFrame:
    """US6: the nested one-row summary.

    ``total_predictions long, by_mode map<string,long>, by_risk_level
    map<string,long>, avg_probability double, by_day array<struct<date,count>>``.
    An empty log gives 0, empty maps, 0.0 and an empty array.
    """
    cube = usage_cube(log, ts)
    # each (tiny) cube row feeds three sections: one explode, one aggregation
    nod = F.lit(None).cast("double")
    sections = (cube.select(F.explode(F.array(
        F.struct(F.lit("mode").alias("section"), F.col("mode").alias("key"), "n", "p_sum"),
        F.struct(F.lit("risk").alias("section"), F.col("risk_level").alias("key"), "n", nod.alias("p_sum")),
        F.struct(F.lit("day").alias("section"), F.col("day").alias("key"), "n", nod.alias("p_sum")),
    )).alias("e")).groupBy("e.section", "e.key")
        .agg(F.sum("e.n").alias("n"), F.sum("e.p_sum").alias("p_sum")))
    is_mode = F.col("section") == "mode"
    total = F.coalesce(F.sum(F.when(is_mode, F.col("n"))), F.lit(0)).cast("long")
    p_total = F.sum(F.when(is_mode, F.col("p_sum")))
    return sections.agg(
        total.alias("total_predictions"),
        F.map_from_entries(F.collect_list(F.when(is_mode, F.struct("key", "n")))).alias("by_mode"),
        F.map_from_entries(F.collect_list(
            F.when(F.col("section") == "risk", F.struct("key", "n")))).alias("by_risk_level"),
        F.coalesce(py_round(p_total / F.sum(F.when(is_mode, F.col("n"))), decimals),
                   F.lit(0.0)).alias("avg_probability"),
        F.array_sort(F.collect_list(F.when(
            F.col("section") == "day",
            F.struct(F.col("key").alias("date"), F.col("n").alias("count"))))).alias("by_day"),
    )


def _entry(a: str, b, n, v) -> "F.Column":
    return F.struct(F.lit(a).alias("k1"), b.cast("string").alias("k2"),
                    n.cast("long").alias("n"), v.cast("double").alias("value"))


def _entries(section: str, arr, key_fn, n_field: str):
    return F.transform(arr, lambda e: _entry(section, key_fn(e), e[n_field], F.lit(None)))


def flatten_summary(summary_df: DataFrame) -> DataFrame:
    """The nested summary as rows ``(section, item, n, value)`` for checks.
    One projection + one explode: the summary is evaluated once."""
    none = F.lit(None)
    rows = F.concat(
        F.array(_entry("total", F.lit(""), F.col("total_predictions"), none),
                _entry("avg_probability", F.lit(""), none, F.col("avg_probability"))),
        _entries("by_mode", F.map_entries("by_mode"), lambda e: e["key"], "value"),
        _entries("by_risk_level", F.map_entries("by_risk_level"), lambda e: e["key"], "value"),
        _entries("by_day", F.col("by_day"), lambda e: e["date"], "count"),
    )
    return (summary_df.select(F.explode(rows).alias("r"))
            .select(F.col("r.k1").alias("section"), F.col("r.k2").alias("item"),
                    F.col("r.n").alias("n"), F.col("r.value").alias("value")))


def dashboard(summary_df: DataFrame) -> DataFrame:
    """US7: dashboard figures from the summary row, as
    ``(figure, label, n, value)`` rows (one pass over the summary).

    * ``total`` - always; when it is 0 nothing else is shown;
    * ``avg_probability_pct`` - mean probability in percent;
    * ``high_risk`` - count of High (0 when absent);
    * ``risk_share`` / ``mode_count`` - counts under display labels, falling
      back to the raw key;
    * ``trend`` - per-day counts, only when more than one day exists.
    """
    risk_names = literal_map(K.RISK_LABELS)
    mode_names = literal_map(K.MODE_LABELS)
    none = F.lit(None)
    empty = F.array().cast("array<struct<k1:string,k2:string,n:bigint,value:double>>")
    shown = F.col("total_predictions") > 0
    details = F.concat(
        F.array(
            _entry("avg_probability_pct", F.lit(""), none, F.col("avg_probability") * 100),
            _entry("high_risk", F.lit(""),
                   F.coalesce(F.col("by_risk_level")["High"], F.lit(0)), none)),
        _entries("risk_share", F.map_entries("by_risk_level"),
                 lambda e: F.coalesce(risk_names[e["key"]], e["key"]), "value"),
        _entries("mode_count", F.map_entries("by_mode"),
                 lambda e: F.coalesce(mode_names[e["key"]], e["key"]), "value"),
        F.when(F.size("by_day") > 1,
               _entries("trend", F.col("by_day"), lambda e: e["date"], "count")).otherwise(empty),
    )
    rows = F.concat(F.array(_entry("total", F.lit(""), F.col("total_predictions"), none)),
                    F.when(shown, details).otherwise(empty))
    return (summary_df.select(F.explode(rows).alias("r"))
            .select(F.col("r.k1").alias("figure"), F.col("r.k2").alias("label"),
                    F.col("r.n").alias("n"), F.col("r.value").alias("value")))
