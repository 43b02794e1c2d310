"""Column-expression helpers (JVM-side, codegen-friendly; no Python UDFs)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def py_strip(c: str | Column) -> Column:
    """Python ``str.strip()``: removes every Unicode whitespace character at
    both ends (plain ``trim`` only removes blanks; this passes the full set,
    no regex)."""
    return F.trim(col(c), F.lit(K.PY_WHITESPACE_CHARS))


def nan_to_null(c: str | Column) -> Column:
    """NaN -> NULL so comparisons behave like pandas (``NaN > 0`` is true in
    Spark but false in pandas)."""
    x = col(c)
    return F.when(~F.isnan(x), x)


def risk_level(p: str | Column, low_below: float = K.RISK_LOW_BELOW,
               medium_below: float = K.RISK_MEDIUM_BELOW) -> Column:
    """Low below 0.3, Medium below 0.6, else High, on the unrounded value."""
    x = col(p)
    return (F.when(x < F.lit(low_below), F.lit("Low"))
            .when(x < F.lit(medium_below), F.lit("Medium"))
            .otherwise(F.lit("High")))


def serve_decision(p: str | Column, threshold: float = K.DECISION_THRESHOLD) -> Column:
    """Serving rule: p >= threshold -> 1."""
    return (col(p) >= F.lit(threshold)).cast("int")


def argmax_decision(p: str | Column) -> Column:
    """Batch rule (argmax of two classes): p = 0.5 -> 0."""
    return (col(p) > F.lit(0.5)).cast("int")


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def literal_map(pairs: Iterable[tuple]) -> Column:
    """A literal ``map`` from (key, value) pairs, for dictionary lookups of a
    fixed, small size (kept inside the projection; no join)."""
    flat: list[Column] = []
    for k, v in pairs:
        flat.extend([F.lit(k), F.lit(v)])
    return F.create_map(*flat)


def yes_no(c: str | Column) -> Column:
    return F.when(col(c), F.lit(K.YES_TEXT)).otherwise(F.lit(K.NO_TEXT))


def round_n(c: str | Column, n: int = 6) -> Column:
    return F.round(col(c), n)


def quote_all(names: Sequence[str]) -> list[Column]:
    return [col(n) for n in names]


def py_round(c: str | Column, digits: int) -> Column:
    """Python ``round(x, digits)`` for doubles: correctly rounded from the
    exact binary value, ties to even (``round(2.675, 2) == 2.67``).

    Spark's ``bround`` rounds the shortest decimal text instead, so it
    disagrees near decimal ties; ``format_number`` uses the exact value."""
    x = col(c)
    text = F.regexp_replace(F.format_number(x, digits), ",", "")
    finite = ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    # NULL, NaN and infinities pass through unchanged (no text round trip)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(finite, text.cast("double")).otherwise(x)


def py_fixed(c: str | Column, digits: int) -> Column:
    """Python ``f"{x:.{digits}f}"`` (no grouping separators)."""
    return F.regexp_replace(F.format_number(col(c), digits), ",", "")


def py_signed_percent(c: str | Column, digits: int = 1) -> Column:
    """Python ``f"{x:+.{digits}%}"``."""
    x = col(c) * F.lit(100.0)
    body = py_fixed(x, digits)
    sign = F.when(F.substring(body, 1, 1) == "-", F.lit("")).otherwise(F.lit("+"))
    return F.concat(sign, body, F.lit("%"))
