"""Record validation as data (PR20, PR21).

A schema is a list of ``Field`` rules: required / optional, an enumeration,
an inclusive range, a minimum length, a default for absent values. The
whole schema compiles into ONE projection:

* defaults are applied with ``coalesce`` only when the value is absent;
* every violation becomes a code ``field:kind`` inside
  ``array_compact(array(when(violation, code), ...))``;
* ``valid`` is ``size(errors) == 0``.

``split_valid`` returns the accepted rows (defaults applied) and the
quarantine (with their error codes) from the same lazy plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .exprs import col

ERRORS = "errors"


@dataclass(frozen=True)
class Field:
    name: str
    required: bool = True
    enum: tuple | None = None
    ge: float | None = None
    le: float | None = None
    min_length: int | None = None
    default: object | None = None


def with_defaults(df: DataFrame, schema: Sequence[Field]) -> DataFrame:
    """Fill declared defaults where the value is absent (NULL)."""
    defaults = {f.name: f.default for f in schema if f.default is not None}
    return df.select(*[
        F.coalesce(col(c), F.lit(defaults[c])).alias(c) if c in defaults else col(c)
        for c in df.columns])


def error_codes(schema: Sequence[Field]) -> Column:
    """``array<string>`` of violated rules for the current row."""
    checks = []
    for f in schema:
        x = col(f.name)
        if f.required and f.default is None:
            checks.append(F.when(x.isNull(), F.lit(f"{f.name}:missing")))
        if f.enum is not None:
            checks.append(F.when(x.isNotNull() & ~x.isin(*f.enum), F.lit(f"{f.name}:enum")))
        if f.ge is not None or f.le is not None:
            bad = F.lit(False)
            if f.ge is not None:
                bad = bad | (x < F.lit(f.ge))
            if f.le is not None:
                bad = bad | (x > F.lit(f.le))
            # NaN is larger than any number to Spark: no range holds it
            bad = bad | F.coalesce(F.isnan(x.cast("double")), F.lit(False))
            checks.append(F.when(x.isNotNull() & bad, F.lit(f"{f.name}:range")))
        if f.min_length is not None:
            checks.append(F.when(x.isNotNull() & (F.length(x) < f.min_length),
                                 F.lit(f"{f.name}:min_length")))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def validate(df: DataFrame, schema: Sequence[Field]) -> DataFrame:
    """Apply defaults and attach ``errors`` (empty = valid). Type errors that
    parsing found (column ``type_errors``) count as errors."""
    errors = error_codes(schema)
    if "type_errors" in df.columns:
        return with_defaults(df, schema).withColumn(ERRORS, F.concat("type_errors", errors)).drop("type_errors")
    return with_defaults(df, schema).withColumn(ERRORS, errors)


def split_valid(df: DataFrame, schema: Sequence[Field]) -> tuple[DataFrame, DataFrame]:
    """(accepted without ``errors``, quarantine with ``errors``)."""
    v = validate(df, schema)
    ok = v.filter(F.size(ERRORS) == 0).drop(ERRORS)
    bad = v.filter(F.size(ERRORS) > 0)
    return ok, bad


def _keys(pairs) -> tuple:
    return tuple(k for k, _ in pairs)


# Request schemas (field rules of the scoring contract).
BASIC_SCHEMA: tuple[Field, ...] = (
    Field("age_group", enum=_keys(K.AGE_GROUP_CODES)),
    Field("sex", enum=tuple(K.SEX_VALUES)),
    Field("height_cm", ge=100, le=250),
    Field("weight_kg", ge=20, le=300),
    Field("high_bp"), Field("high_chol"),
    Field("chol_check", default=True),
    Field("diabetes", enum=_keys(K.DIABETES_CODES) + _keys(K.DIABETES_ALIASES),
          default=K.DIABETES_CODES[0][0]),
    Field("stroke", default=False),
    Field("smoker"), Field("phys_activity"), Field("fruits"), Field("veggies"),
    Field("heavy_alcohol", default=False),
    Field("gen_health", enum=_keys(K.GEN_HEALTH_CODES) + _keys(K.GEN_HEALTH_ALIASES)),
    Field("mental_health_days", ge=0, le=30, default=0),
    Field("phys_health_days", ge=0, le=30, default=0),
    Field("diff_walk"),
    Field("any_healthcare", default=True),
    Field("no_doc_because_cost", default=False),
    Field("education_level", enum=_keys(K.EDUCATION_CODES) + _keys(K.EDUCATION_ALIASES)),
    Field("income_level", enum=_keys(K.INCOME_CODES)),
)

ADVANCED_SCHEMA: tuple[Field, ...] = (
    Field("age", ge=1, le=120),
    Field("sex", enum=tuple(K.SEX_VALUES)),
    Field("cp", enum=tuple(K.CP_VALUES)),
    Field("chol", ge=0),
    Field("fbs"),
    Field("thalch", ge=0),
    Field("exang"),
    Field("oldpeak"),
    Field("ca", required=False, ge=0, le=3),
    Field("thal", required=False, enum=tuple(K.THAL_VALUES)),
)

CHAT_SCHEMA: tuple[Field, ...] = (
    Field("mode", enum=tuple(K.CHAT_MODES)),
    Field("message", min_length=1),
)

CHAT_MESSAGE_SCHEMA: tuple[Field, ...] = (
    Field("role", enum=tuple(K.CHAT_ROLES)),
    Field("content"),
)

# a conversation-turn table (conv_id, turn, role, text) checked as chat messages
CHAT_TURN_SCHEMA: tuple[Field, ...] = (
    Field("role", enum=tuple(K.CHAT_ROLES)),
    Field("text", min_length=1),
)
