"""The two modes as preset objects (ML9) and the batch jobs built on them
(ML6 batch inference, ML8 training, RA4 index build, ME7/ME11 reports).

A job takes a session and paths; intermediate stages stay in the plan
(nothing is re-read from disk between steps) and only fitted artefacts -
model, scaler stats, vocabulary, feature list - are written.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import encode as EN
from ..operators import prep as PR
from ..operators import retrieval as RT
from ..operators import training as TR
from ..sources import io as IO
from . import stagestore as SS


@dataclass(frozen=True)
class Preset:
    name: str
    key: str
    clean: Callable[[DataFrame], DataFrame]
    forest_local: dict = field(default_factory=dict)
    forest_prod: dict = field(default_factory=dict)

    def features(self, clean: DataFrame):
        """-> (feature table, artefacts dict, ordered feature list)."""
        if self.name == "basic":
            out, stats, feats = EN.build_basic(clean, key=self.key)
            return out, {"scaler": stats}, feats
        out, stats, vocab, feats = EN.build_advanced(clean, key=self.key)
        return out, {"scaler": stats, "vocabulary": vocab}, feats


PRESETS = {
    "basic": Preset("basic", "row_id", lambda raw: PR.clean_survey(raw, "row_id"),
                    K.FOREST_BASIC_LOCAL, K.FOREST_BASIC_PROD),
    "advanced": Preset("advanced", "id", lambda raw: PR.clean_clinical(raw, "id"),
                       K.FOREST_ADVANCED_LOCAL, K.FOREST_ADVANCED_PROD),
}


def preset(name: str) -> Preset:
    """ML9: mode dispatch; an unknown mode raises ``ValueError``."""
    if name not in PRESETS:
        raise ValueError(f"unknown mode '{name}' (expected one of {sorted(PRESETS)})")
    return PRESETS[name]


def train_job(spark: SparkSession, mode: str, raw: DataFrame, out_dir: str, env: str = "local") -> DataFrame:
    """ML8: clean -> features -> split -> fit -> evaluate; writes the stage
    store (features, artefacts, manifest) and the model into ``out_dir``;
    returns the metrics row. The model is fitted on the stored features."""
    p = preset(mode)
    feats = SS.fit_stage(spark, mode, raw, out_dir)
    params = p.forest_local if env == "local" else p.forest_prod
    model, metrics = TR.train_and_evaluate(IO.read_stage(spark, os.path.join(out_dir, "features")), feats, "random_forest",
                                           params, key=p.key)
    SS.save_model(spark, model, out_dir)
    return metrics


def raw_inference_job(spark: SparkSession, mode: str, raw: DataFrame, model_dir: str, out_path: str) -> None:
    """ML6 from a raw table: stored artefacts and model -> predictions."""
    preset(mode)
    IO.write_stage(SS.infer(spark, mode, raw, model_dir), out_path)


def inference_job(spark: SparkSession, mode: str, features_path: str, model_dir: str, out_path: str) -> None:
    """ML6: stored model -> score a feature stage (target dropped) -> write
    predictions (key, features, prediction, probability)."""
    p = preset(mode)
    feats = IO.read_feature_spec(spark, os.path.join(model_dir, "feature_columns"))
    model = IO.load_model(os.path.join(model_dir, "model"))
    rows = PR.drop_columns(IO.read_stage(spark, features_path), [K.TARGET])
    IO.write_stage(TR.predict(model, rows, feats, keep=[p.key]), out_path)


def index_job(spark: SparkSession, corpus_dir: str, index_path: str, num_features: int = 256) -> int:
    """RA4: corpus -> chunks -> embeddings -> index; returns chunk count
    (0 for an empty corpus, which writes an empty index)."""
    docs = IO.read_markdown_corpus(spark, corpus_dir).withColumn("doc_id", F.xxhash64("source"))
    chunks = RT.chunk_markdown(docs, keep=("doc_id",))
    index = RT.hashing_embed(chunks, "text", "embedding", num_features)
    index = index.withColumn("vec_id", F.xxhash64("doc_id", "chunk_index"))
    RT.write_index(index.select("vec_id", "doc_id", "chunk_index", "source", "heading", "text", "embedding"),
                   index_path)
    return RT.read_index(spark, index_path).count()


def importance_job(spark: SparkSession, features_df: DataFrame, features: list[str], key: str,
                   params: dict, out_path: str, repeats: int = K.PERMUTATION_REPEATS) -> DataFrame:
    """ME6-ME9 + IO6: impurity and permutation importance on the test part;
    writes both maps as one JSON record; returns the permutation table."""
    from ..operators.split import split_flag_exact
    flagged = TR.reliable(split_flag_exact(features_df, key))
    model = TR.fit(flagged.filter(~F.col("is_test")), features, "random_forest", params)
    gini = TR.feature_importances(spark, model, features)
    perm = TR.permutation_importance(model, flagged.filter(F.col("is_test")), features, repeats=repeats, key=key)
    maps = TR.importance_maps(gini, perm).first()
    IO.write_metrics(spark, {"gini_importance": dict(maps["gini_importance"]),
                             "permutation_importance": dict(maps["permutation_importance"])}, out_path)
    return perm


def experiment_job(spark: SparkSession, clinical_raw: DataFrame, out_path: str,
                   params: dict | None = None) -> DataFrame:
    """ME10/ME11 + IO7: full vs reduced feature sets -> comparison CSV."""
    params = params or K.FOREST_ADVANCED_LOCAL
    clean = PR.clean_clinical(clinical_raw)
    full, f_full = EN.build_variant(clean)
    reduced, f_red = EN.build_variant(clean, K.ADVANCED_LOW_IMPORTANCE_COLS)
    table = (TR.evaluate_variant(full, f_full, "full", "random_forest", params)
             .unionByName(TR.evaluate_variant(reduced, f_red, "reduced", "random_forest", params)))
    IO.write_table_csv(table, out_path)
    return table
