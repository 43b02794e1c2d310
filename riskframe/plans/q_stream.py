"""Queries US8: streaming daily usage counts (equal to the batch answer) and their accounting."""

from __future__ import annotations

from ..sources.fixtures import oracle_views
from ..sources.tables import read_table, table_path
from ..streaming import usage_stream as US
from .registry import register


@register("usage_stream", oracle_views("prediction_log") + """
SELECT strftime(ts, '%Y-%m-%d') AS day, mode, risk_level, count(*)::BIGINT AS n
FROM prediction_log GROUP BY 1, 2, 3""")
def usage_stream(spark, sf):
    schema = read_table(spark, sf, "events").schema
    # a pattern, so that the table may be one file or a folder of part files
    out = US.run_available_now(spark, table_path(sf, "[e]vents"), schema)
    return US.read_latest(spark, out)


def _accounted(spark, sf):
    return US.run_accounted(spark, table_path(sf, "[e]vents"), read_table(spark, sf, "events").schema)


@register("usage_stream_accounted", oracle_views("prediction_log") + """
SELECT strftime(ts, '%Y-%m-%d') AS day, mode, risk_level, count(*)::BIGINT AS n
FROM prediction_log WHERE ts IS NOT NULL GROUP BY 1, 2, 3""")
def usage_stream_accounted(spark, sf):
    return US.read_accounted(spark, _accounted(spark, sf))


@register("usage_stream_audit", oracle_views("prediction_log") + """
SELECT count(*)::BIGINT AS rows_in, count(ts)::BIGINT AS counted, 0::BIGINT AS late,
 (count(*) - count(ts))::BIGINT AS undated FROM prediction_log""")
def usage_stream_audit(spark, sf):
    """The table is read in one trigger, so nothing is late; tests read late files."""
    return US.audit(spark, _accounted(spark, sf))
