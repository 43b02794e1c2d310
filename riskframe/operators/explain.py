"""Local explanation by ablation (EX1-EX4).

Contribution of feature j for a row x: ``p(x) - p(x with x_j = baseline_j)``
(baseline = 0 in the scaled model space, i.e. the column mean for scaled
columns and 0 for binaries and dummies).

* Linear scorers: closed form. The terms of a row are one array of (value,
  baseline) pairs; running sums from the left and from the right give every
  logit with one term replaced, so a row costs as many steps as it has terms
  and the generated code does not grow with them. A feature whose value already
  equals its baseline gets exactly 0. Scores, top-k sort and response array are
  built inside the row: map-only, no explode before the top-k, no shuffle.
* Any Spark ML model: rows are expanded to p+1 variants by one narrow
  ``explode`` after a hash repartition on the key, scored by ONE
  ``model.transform``, and re-assembled with a window on the key that
  reuses that partitioning (no second shuffle).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import col, literal_map, py_round, py_signed_percent
from ..functions.sizing import spread
from .models import LinearScorer

MAGNITUDE = 1e12     # contributions that agree to twelve decimals rank as equal, in feature order


def linear_terms(df: DataFrame, scorer: LinearScorer, keep: Sequence[str],
                 baseline: Mapping[str, float]) -> DataFrame:
    """``keep`` and the row's leave-one-out state: ``_terms`` (signed value and
    baseline of every term), ``_left`` (sums up to each term) and ``_right``
    (sums from each term on)."""
    def signed(name: str, w: float, c: float | None, value: Column | None = None) -> Column:
        t = scorer.term(name, abs(w), c, value)
        return (-t if w < 0 else t).cast("double")

    def running(values: Column, start: float) -> Column:
        return F.aggregate(values, F.array(F.lit(start)), lambda acc, v: F.concat(
            acc, F.array(F.element_at(acc, -1) + v)))

    terms = F.array(*[F.struct(signed(n, w, c).alias("v"),
                               signed(n, w, c, F.lit(float(baseline.get(n, 0.0)))).alias("b")) for n, w, c in scorer.terms])
    kept = [col(c) for c in keep]
    # one projection per step: each array is computed once per row
    rows = spread(df).select(*kept, terms.alias("_terms"))
    rows = rows.select(*kept, "_terms", F.col("_terms.v").alias("_v"))
    return rows.select(*kept, "_terms", running(F.col("_v"), scorer.intercept).alias("_left"),
                       F.reverse(running(F.reverse("_v"), 0.0)).alias("_right"))


def contributions_linear(scorer: LinearScorer, features: Sequence[str]) -> Column:
    """EX1 (closed form) as ``array<struct<neg_abs, idx, feature,
    contribution>>`` in feature order, from the columns of ``linear_terms``.
    Features the scorer ignores contribute exactly 0; rounding differences
    between sums of another grouping do not order features."""
    from ..functions.exprs import sigmoid

    at = {n: j for j, (n, _, _) in enumerate(scorer.terms)}
    named = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(f).alias("feature"), F.lit(at.get(f)).cast("int").alias("j"))
                      for i, f in enumerate(features)])

    def item(m: Column) -> Column:
        t, j = F.get("_terms", m["j"]), m["j"]
        without = (F.get("_left", j) + t["b"]) + F.get("_right", j + 1)
        change = sigmoid(F.element_at("_left", -1)) - sigmoid(without)
        return F.struct(m["idx"].alias("idx"), m["feature"].alias("feature"),
                        F.when(j.isNull() | (t["v"] == t["b"]), F.lit(0.0)).otherwise(change).alias("contribution"))

    # led by (-|c|, idx) so the native array sort ranks by magnitude
    return F.transform(F.transform(named, item), lambda e: F.struct(
        (-F.floor(F.abs(e["contribution"]) * F.lit(MAGNITUDE) + F.lit(0.5))).alias("neg_abs"), e["idx"].alias("idx"), e["feature"].alias("feature"),
        e["contribution"].alias("contribution")))


def top_k(contribs: Column, k: int = K.TOP_CONTRIBUTORS) -> Column:
    """EX2 inside the row: |contribution| descending, ties in feature order
    (a stable sort), keep k. The structs lead with (-|c|, idx), so the
    native array sort does it (no comparator lambda, no shuffle)."""
    return F.slice(F.sort_array(contribs, asc=True), 1, k)


def explode_ranked(df: DataFrame, key: str, arr: str, rank: str = "rank") -> DataFrame:
    """Array of structs -> rows ``(key, rank (1-based), struct fields...)``."""
    return (df.select(col(key), F.posexplode_outer(arr).alias("_pos", "_e"))
            .select(col(key), (F.col("_pos") + 1).alias(rank), "_e.*"))


def ablation_linear(df: DataFrame, scorer: LinearScorer, features: Sequence[str],
                    baseline: Mapping[str, float], key: str = "row_id") -> DataFrame:
    """EX1 long form ``(key, feature, contribution)``."""
    wide = linear_terms(df, scorer, [key], baseline).select(
        col(key), contributions_linear(scorer, features).alias("c"))
    return (wide.select(col(key), F.explode_outer("c").alias("e"))
            .select(col(key), "e.feature", "e.contribution"))


def topk_array(df: DataFrame, scorer: LinearScorer, features: Sequence[str], baseline: Mapping[str, float],
               keep: Sequence[str], k: int = K.TOP_CONTRIBUTORS) -> DataFrame:
    """``keep`` and the row's top-k array ``t``."""
    return linear_terms(df, scorer, keep, baseline).select(
        *[col(c) for c in keep], top_k(contributions_linear(scorer, features), k).alias("t"))


def topk_linear(df: DataFrame, scorer: LinearScorer, features: Sequence[str],
                baseline: Mapping[str, float], key: str = "row_id",
                k: int = K.TOP_CONTRIBUTORS) -> DataFrame:
    """EX2 ``(key, rank, feature, contribution)``; map-only."""
    wide = topk_array(df, scorer, features, baseline, [key], k)
    return explode_ranked(wide, key, "t").drop("idx", "neg_abs")


def response_items(contribs_topk: Column, labels: Mapping[str, str] | Sequence[tuple],
                   display: Mapping[str, Column]) -> Column:
    """EX3: ``array<struct<feature (display label), value (display text),
    contribution (rounded to 4)>>`` in rank order.

    ``display`` maps feature -> a string Column of the current row; labels
    fall back to the raw feature name."""
    label_map = literal_map(list(labels.items()) if isinstance(labels, Mapping) else labels)
    names = list(display.keys())
    if names:
        value_map = F.create_map(*[x for f in names for x in (F.lit(f), display[f])])
    else:
        value_map = F.create_map().cast("map<string,string>")

    def item(e):
        return F.struct(F.coalesce(label_map[e["feature"]], e["feature"]).alias("feature"),
                        F.coalesce(value_map[e["feature"]], F.lit("")).alias("value"),
                        py_round(e["contribution"], K.PROBABILITY_DECIMALS).alias("contribution"))
    return F.transform(contribs_topk, item)


def response_rows(df: DataFrame, key: str, topk_col: str, labels, display: Mapping[str, Column]) -> DataFrame:
    """EX3 as rows ``(key, rank, feature (label), value, contribution,
    n_items)``:
    explode the top-k first, then plain column expressions per row (label
    from a literal map, display text from a CASE over the feature name)."""
    label_map = literal_map(list(labels.items()) if isinstance(labels, Mapping) else labels)
    x = df.select("*", F.posexplode_outer(topk_col).alias("_pos", "_e"))
    feat = F.col("_e.feature")
    value = None
    for f, expr in display.items():
        value = (F.when(feat == f, expr.cast("string")) if value is None
                 else value.when(feat == f, expr.cast("string")))
    value = value.otherwise(F.lit("")) if value is not None else F.lit("")
    return x.select(col(key), (F.col("_pos") + 1).alias("rank"),
                    F.coalesce(label_map[feat], feat).alias("feature"), value.alias("value"),
                    py_round(F.col("_e.contribution"), K.PROBABILITY_DECIMALS).alias("contribution"),
                    F.size(topk_col).alias("n_items"))


def chart_rows(responses: DataFrame, key: str = "row_id") -> DataFrame:
    """EX4 over response rows: reversed position, ``label (value)`` text,
    signed percent text and the sign class (map-only)."""
    return responses.select(
        col(key), (F.col("n_items") - F.col("rank") + 1).alias("position"),
        F.concat(F.col("feature"), F.lit(" ("), F.col("value"), F.lit(")")).alias("text"),
        F.col("contribution"), py_signed_percent(F.col("contribution"), 1).alias("percent_text"),
        F.when(F.col("contribution") > 0, F.lit("increase")).otherwise(F.lit("decrease")).alias("direction"))


# --------------------------------------------------------------------------
# generic path for fitted Spark ML models
# --------------------------------------------------------------------------

def ablation_model(model, df: DataFrame, features: Sequence[str], baseline: Mapping[str, float],
                   key: str = "row_id", num_partitions: int | None = None) -> DataFrame:
    """EX1 for any fitted Spark ML classifier: ``(key, feature, contribution)``.

    One hash repartition by key, a narrow explode into p+1 variants, ONE
    ``model.transform``, then a window on the key (same partitioning)."""
    from pyspark.ml.functions import vector_to_array

    from .models import assemble

    parts = num_partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    base = df.select(col(key), *[col(f).cast("double").alias(f) for f in features])
    base = base.repartition(int(parts), col(key))
    variants = [F.struct(F.lit(-1).alias("_j"), *[col(f).alias(f) for f in features])]
    for j, f in enumerate(features):
        variants.append(F.struct(F.lit(j).alias("_j"), *[
            (F.lit(float(baseline.get(f, 0.0))) if g == f else col(g)).alias(g) for g in features]))
    exploded = base.select(col(key), F.explode(F.array(*variants)).alias("_v")).select(col(key), "_v.*")
    scored = model.transform(assemble(exploded, features, model.getFeaturesCol()))
    p = vector_to_array(F.col(model.getProbabilityCol()))[1]
    s = scored.select(col(key), "_j", p.alias("_p"))
    w = W.partitionBy(key)
    s = s.withColumn("_p0", F.max(F.when(F.col("_j") == -1, F.col("_p"))).over(w))
    names = literal_map([(j, f) for j, f in enumerate(features)])
    return (s.filter(F.col("_j") >= 0)
            .select(col(key), names[F.col("_j")].alias("feature"),
                    (F.col("_p0") - F.col("_p")).alias("contribution"), F.col("_j").alias("idx")))


def topk_from_long(long_df: DataFrame, key: str = "row_id", k: int = K.TOP_CONTRIBUTORS) -> DataFrame:
    """EX2 over a long contribution table (needs ``idx``): row_number over
    the key; Spark's window group limit trims each partition to k first."""
    w = W.partitionBy(key).orderBy(F.desc(F.abs("contribution")), "idx")
    return (long_df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(col(key), "rank", "feature", "contribution"))
