"""The stage store: raw -> features -> model -> predictions in one folder.

``fit_stage`` writes the feature table and every fitted artefact (fills,
scaler, vocabulary, feature list) once, and a manifest with the columns and
types of the raw table and a fingerprint of each artefact. Later stages read what is
stored - nothing is fitted twice - and refuse artefacts that are not those
of the manifest, another mode, or a raw table whose columns do not fit it.

    root/features          feature table (Parquet)
    root/scaler, vocabulary, feature_columns, fills
    root/model             Spark ML model, or a linear scorer (root/scorer)
    root/manifest          one JSON record, written last
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NumericType

from .. import constants as K
from ..operators import encode as EN
from ..operators import models as MO
from ..operators import prep as PR
from ..operators import training as TR
from ..sources import io as IO

KEYS = {"basic": "row_id", "advanced": "id"}
TARGETS = {"basic": K.BASIC_TARGET_RAW, "advanced": K.ADVANCED_TARGET_RAW}


class StageMismatch(ValueError):
    """Stored stages that do not belong together, or not to this table."""


def fingerprint(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def raw_columns(mode: str, raw: DataFrame) -> dict[str, str]:
    """Columns and kinds that the features are made from (no key, no target);
    numbers of any width are one kind."""
    skip = {KEYS[mode], TARGETS[mode], *(K.ADVANCED_DROP_COLS if mode == "advanced" else [])}
    return {f.name: "number" if isinstance(f.dataType, NumericType) else f.dataType.simpleString()
            for f in raw.schema.fields if f.name not in skip}


def _artefacts(spark: SparkSession, root: str) -> dict:
    return {"scaler": {c: list(v) for c, v in IO.load_scaler(spark, os.path.join(root, "scaler")).items()},
            "vocabulary": IO.load_vocabulary(spark, os.path.join(root, "vocabulary")),
            "fills": IO.read_record(spark, os.path.join(root, "fills")),
            "features": IO.read_feature_spec(spark, os.path.join(root, "feature_columns"))}


def fit_stage(spark: SparkSession, mode: str, raw: DataFrame, root: str) -> list[str]:
    """Fit on the whole raw table, write features and artefacts; returns the
    ordered feature list. Fills are fitted for all columns, so that a table
    with nulls where the training table had none can be scored."""
    if mode == "basic":
        rows, stats, fill, features = EN.fit_basic(raw, KEYS[mode], complete=True)
        vocab: dict = {}
    else:
        rows, stats, vocab, fill, features = EN.fit_advanced(raw, KEYS[mode], complete=True)
    IO.write_stage(rows, os.path.join(root, "features"))
    IO.save_scaler(spark, stats, os.path.join(root, "scaler"))
    IO.save_vocabulary(spark, vocab, os.path.join(root, "vocabulary"))
    IO.write_feature_spec(spark, features, os.path.join(root, "feature_columns"))
    IO.write_metrics(spark, fill, os.path.join(root, "fills"))
    stored = _artefacts(spark, root)
    IO.write_metrics(spark, {"mode": mode, "raw": raw_columns(mode, raw),
                             "fingerprints": {name: fingerprint(v) for name, v in stored.items()}},
                     os.path.join(root, "manifest"))
    return features


def open_stage(spark: SparkSession, mode: str, root: str) -> tuple[dict, dict]:
    """(manifest, artefacts) of a store, checked against each other."""
    manifest = IO.read_record(spark, os.path.join(root, "manifest"))
    if manifest["mode"] != mode:
        raise StageMismatch(f"the store was fitted for mode '{manifest['mode']}', not '{mode}'")
    artefacts = _artefacts(spark, root)
    changed = [n for n, v in artefacts.items() if fingerprint(v) != manifest["fingerprints"].get(n)]
    if changed:
        raise StageMismatch(f"not the artefacts of the manifest: {', '.join(changed)}")
    return manifest, artefacts


def features_of(spark: SparkSession, mode: str, raw: DataFrame, root: str) -> tuple[DataFrame, list[str]]:
    """The feature table of any raw table (target optional) with the stored
    artefacts: one projection. Columns beyond the stored ones are ignored."""
    manifest, stored = open_stage(spark, mode, root)
    have = raw_columns(mode, raw)
    wrong = [f"{c} {t}" + (f" (is {have[c]})" if c in have else " (absent)")
             for c, t in manifest["raw"].items() if have.get(c) != t]
    if wrong:
        raise StageMismatch("the raw table does not fit the store: " + ", ".join(wrong))
    raw = raw.select(*[f"`{c}`" for c in raw.columns if c in manifest["raw"] or c in (KEYS[mode], TARGETS[mode])])
    stats = {c: tuple(v) for c, v in stored["scaler"].items()}
    if mode == "basic":
        rows = EN.apply_basic(raw, stats, stored["fills"])
    else:
        rows = EN.apply_advanced(raw, stats, stored["vocabulary"], stored["fills"], KEYS[mode])
    return PR.align_features(rows, stored["features"], keep=[KEYS[mode], K.TARGET]), stored["features"]


def save_model(spark: SparkSession, model, root: str) -> None:
    """A fitted Spark ML model or a ``LinearScorer``."""
    if isinstance(model, MO.LinearScorer):
        IO.write_metrics(spark, {"intercept": model.intercept, "terms": [list(t) for t in model.terms]}, os.path.join(root, "scorer"))
    else:
        IO.save_model(model, os.path.join(root, "model"))


def load_model(spark: SparkSession, root: str, kind: str = "random_forest"):
    if kind != "linear":
        return IO.load_model(os.path.join(root, "model"), kind)
    stored = IO.read_record(spark, os.path.join(root, "scorer"))
    return MO.LinearScorer(stored["intercept"], tuple((n, w, c) for n, w, c in stored["terms"]))


def infer(spark: SparkSession, mode: str, raw: DataFrame, root: str, kind: str = "random_forest") -> DataFrame:
    """ML6 from a raw table: key, features, prediction and probability by the
    stored model."""
    rows, features = features_of(spark, mode, raw, root)
    return TR.predict(load_model(spark, root, kind), PR.drop_columns(rows, [K.TARGET]), features, keep=[KEYS[mode]])
