"""Queries US1-US7 over ``prediction_log`` (derived from ``events``)."""

from __future__ import annotations

from ..operators import usage
from ..sources.fixtures import oracle_views, view
from .registry import register, rounded

W = oracle_views("prediction_log")
DAY = "strftime(ts, '%Y-%m-%d')"


def _log(spark, sf):
    return view(spark, sf, "prediction_log")


@register("usage_total", W + "SELECT count(*)::BIGINT AS total_predictions FROM prediction_log")
def usage_total(spark, sf):
    return usage.total_count(_log(spark, sf))


@register("usage_by_mode", W + "SELECT mode, count(*)::BIGINT AS n FROM prediction_log GROUP BY mode")
def usage_by_mode(spark, sf):
    return usage.count_by(_log(spark, sf), "mode")


@register("usage_by_risk",
          W + "SELECT risk_level, count(*)::BIGINT AS n FROM prediction_log GROUP BY risk_level")
def usage_by_risk(spark, sf):
    return usage.count_by(_log(spark, sf), "risk_level")


@register("usage_avg_probability", W + """
SELECT round(coalesce(printf('%.4f', avg(probability))::DOUBLE, 0.0), 6) AS avg_probability FROM prediction_log""")
def usage_avg_probability(spark, sf):
    return rounded(usage.avg_probability(_log(spark, sf)))


@register("usage_by_day", W + f"""
SELECT {DAY} AS day, count(*)::BIGINT AS n FROM prediction_log GROUP BY 1 ORDER BY 1""")
def usage_by_day(spark, sf):
    return usage.count_by_day(_log(spark, sf))


@register("usage_summary", W + f"""
SELECT 'total' AS section, '' AS item, count(*)::BIGINT AS n, NULL::DOUBLE AS value FROM prediction_log
UNION ALL SELECT 'avg_probability', '', NULL, round(coalesce(printf('%.4f', avg(probability))::DOUBLE, 0.0), 6) FROM prediction_log
UNION ALL SELECT 'by_mode', mode, count(*), NULL FROM prediction_log GROUP BY mode
UNION ALL SELECT 'by_risk_level', risk_level, count(*), NULL FROM prediction_log GROUP BY risk_level
UNION ALL SELECT 'by_day', {DAY}, count(*), NULL FROM prediction_log GROUP BY 2""")
def usage_summary(spark, sf):
    return rounded(usage.flatten_summary(usage.summary(_log(spark, sf))))


@register("usage_dashboard", W + f""",
s AS (SELECT count(*)::BIGINT AS total, coalesce(printf('%.4f', avg(probability))::DOUBLE, 0.0) AS avgp FROM prediction_log),
r AS (SELECT risk_level, count(*)::BIGINT AS n FROM prediction_log GROUP BY 1),
m AS (SELECT mode, count(*)::BIGINT AS n FROM prediction_log GROUP BY 1),
d AS (SELECT {DAY} AS day, count(*)::BIGINT AS n FROM prediction_log GROUP BY 1)
SELECT 'total' AS figure, '' AS label, total AS n, NULL::DOUBLE AS value FROM s
UNION ALL SELECT 'avg_probability_pct', '', NULL, round(avgp * 100, 6) FROM s WHERE total > 0
UNION ALL SELECT 'high_risk', '', coalesce((SELECT n FROM r WHERE risk_level = 'High'), 0), NULL FROM s WHERE total > 0
UNION ALL SELECT 'risk_share', CASE risk_level WHEN 'Low' THEN 'Thấp' WHEN 'Medium' THEN 'Trung bình'
  WHEN 'High' THEN 'Cao' ELSE risk_level END, n, NULL FROM r
UNION ALL SELECT 'mode_count', CASE mode WHEN 'basic' THEN 'Sàng lọc nhanh' WHEN 'advanced' THEN 'Nâng cao'
  ELSE mode END, n, NULL FROM m
UNION ALL SELECT 'trend', day, n, NULL FROM d WHERE (SELECT count(*) FROM d) > 1""")
def usage_dashboard(spark, sf):
    return rounded(usage.dashboard(usage.summary(_log(spark, sf))))
