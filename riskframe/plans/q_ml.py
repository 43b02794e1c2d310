"""Model queries (rows-only checks): ML1-ML4, ML6, ME6-ME12, RA3-RA4.

Forests are non-deterministic across engines (and the reference's forest
is unseeded), so these are checked by row counts here and by property
tests in ``tests/``; the oracle-checked path uses the fixed linear scorer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import encode as EN
from ..operators import prep as PR
from ..operators import retrieval as RT
from ..operators import split as SP
from ..operators import training as TR
from ..operators.models import ADVANCED_SERVE_SCORER, SURVEY_TEST_SCORER
from ..session import shared_folder
from ..sources.fixtures import oracle_views, view
from . import stagestore as SS
from .q_explain import logit_sql
from .q_features import CC
from .registry import register, rounded


def _advanced_features(spark, sf):
    out, _, _, feats = EN.prepare_advanced(view(spark, sf, "clinical_raw"))
    return out, feats


def _basic_features(spark, sf):
    out, _, feats = EN.prepare_basic(view(spark, sf, "survey_raw"))
    return out, feats


@register("train_forest")
def train_forest(spark, sf):
    """ML1 + ML8 + ME12: advanced preset (300 trees, depth 8, balanced)."""
    df, feats = _advanced_features(spark, sf)
    _, metrics = TR.train_and_evaluate(df, feats, "random_forest", K.FOREST_ADVANCED_LOCAL, key="id")
    return rounded(metrics)


@register("train_logistic")
def train_logistic(spark, sf):
    """ML2: logistic regression on the basic features -> coefficients."""
    df, feats = _basic_features(spark, sf)
    model = TR.fit(df, feats, "logistic_regression", {"C": 1.0})
    coefs = model.coefficients.toArray().tolist()
    rows = [(f, float(c)) for f, c in zip(feats, coefs)] + [("(intercept)", float(model.intercept))]
    return rounded(spark.createDataFrame(rows, "feature string, coefficient double"))


@register("cv_scores")
def cv_scores(spark, sf):
    """ML4: 5-fold ROC-AUC of the advanced forest."""
    df, feats = _advanced_features(spark, sf)
    return rounded(TR.cv_scores(df, feats, "random_forest", K.FOREST_ADVANCED_LOCAL, K.CV_FOLDS, key="id"))


@register("gini_importance")
def gini_importance(spark, sf):
    """ME6 (+ ME8 top 10): impurity importance of the advanced forest."""
    df, feats = _advanced_features(spark, sf)
    model = TR.fit(df, feats, "random_forest", K.FOREST_ADVANCED_LOCAL)
    return rounded(TR.feature_importances(spark, model, feats))


def _logit_sql(replace: str | None = None) -> str:
    """The test scorer's logit in its own order, one feature from the donor."""
    z = f"{SURVEY_TEST_SCORER.intercept!r}::DOUBLE"
    for name, w, c in SURVEY_TEST_SCORER.terms:
        x = f"{'d' if name == replace else 't'}.{name}::DOUBLE"
        x = x if c is None else f"({x} - {c!r}::DOUBLE)"
        z = f"({z} {'-' if w < 0 else '+'} {abs(w)!r}::DOUBLE * {x})"
    return z


_FEATURES = SURVEY_TEST_SCORER.features
PERMUTATION_SQL = oracle_views("survey_raw") + f""", s AS (SELECT *, CAST(HeartDiseaseorAttack AS INTEGER) AS target,
 {SP.key_hash_sql("row_id")} AS h FROM survey_raw),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY h, row_id) - 1 AS rk,
 count(*) OVER (PARTITION BY target) AS n_class FROM s),
test AS (SELECT *, row_number() OVER (ORDER BY h, row_id) - 1 AS i FROM ranked WHERE rk < round(n_class * {K.TEST_SIZE})),
size AS (SELECT count(*)::BIGINT AS n FROM test),
each AS (SELECT i, rep.repeat, n FROM test, size, (SELECT unnest(range({K.PERMUTATION_REPEATS})) AS repeat) rep),
{TR.permuted_sql("each", "n")},
cells AS (SELECT repeat, t.target AS t, unnest([{", ".join(f"struct_pack(f := '{f}', s := {_logit_sql(f)})" for f in _FEATURES)}]) AS v
 FROM (SELECT i AS target_i, repeat, x FROM pm{TR.ROUNDS}) m JOIN test t ON t.i = m.target_i JOIN test d ON d.i = m.x),
sums AS (SELECT repeat, v.f AS feature, v.s AS s, sum(t) AS p, sum(1 - t) AS n FROM cells GROUP BY ALL),
upto AS (SELECT *, sum(n) OVER (PARTITION BY repeat, feature ORDER BY s) AS neg FROM sums),
aucs AS (SELECT repeat, feature, sum(p * (neg - n + n * 0.5)) / (sum(p)::DOUBLE * sum(n)) AS auc FROM upto GROUP BY ALL),
base_sums AS (SELECT {_logit_sql()} AS s, sum(target) AS p, sum(1 - target) AS n FROM test t GROUP BY 1),
base AS (SELECT sum(p * (neg - n + n * 0.5)) / (sum(p)::DOUBLE * sum(n)) AS auc0 FROM (
 SELECT *, sum(n) OVER (ORDER BY s) AS neg FROM base_sums))
SELECT feature, round(avg(auc0 - auc), 6) + 0.0 AS importance_mean, round(stddev_pop(auc0 - auc), 6) + 0.0 AS importance_std
FROM aucs, base GROUP BY feature"""


@register("permutation_importance", PERMUTATION_SQL)
def permutation_importance(spark, sf):
    """SP1 + SP4 + ME7: AUC drop over 30 repeats on the stratified test part
    of the survey (linear test scorer)."""
    rows = PR.convert_target(view(spark, sf, "survey_raw"), K.BASIC_TARGET_RAW, K.TARGET)
    test = SP.split_flag_exact(rows, "row_id").filter("is_test")
    return rounded(TR.permutation_importance(SURVEY_TEST_SCORER, test, _FEATURES, repeats=K.PERMUTATION_REPEATS))


@register("permutation_importance_forest")
def permutation_importance_forest(spark, sf):
    """ME7 with the advanced forest."""
    df, feats = _advanced_features(spark, sf)
    flagged = TR.reliable(SP.split_flag_exact(df, "id"))
    model = TR.fit(flagged.filter(~F.col("is_test")), feats, "random_forest", K.FOREST_ADVANCED_LOCAL)
    test = flagged.filter(F.col("is_test"))
    return rounded(TR.permutation_importance(model, test, feats, repeats=K.PERMUTATION_REPEATS, key="id"))


@register("variant_experiment")
def variant_experiment(spark, sf):
    """ME10 + ME11: full (20 features) vs reduced (14) comparison table."""
    clean = PR.clean_clinical(view(spark, sf, "clinical_raw"))
    full, f_full = EN.build_variant(clean)
    reduced, f_red = EN.build_variant(clean, K.ADVANCED_LOW_IMPORTANCE_COLS)
    from concurrent.futures import ThreadPoolExecutor

    jobs = [(full, f_full, "full"), (reduced, f_red, "reduced")]
    # the two variants are independent distributed evaluations: run them as
    # concurrent Spark jobs
    with ThreadPoolExecutor(max_workers=TR.fits_at_once(clean.count(), 2)) as pool:
        a, b = pool.map(lambda j: TR.evaluate_variant(j[0], j[1], j[2], "random_forest",
                                                      K.FOREST_ADVANCED_LOCAL), jobs)
    return rounded(a.unionByName(b))


def _advanced_row_sql() -> dict[str, str]:
    """Model-space columns of a clean clinical row, unrounded."""
    out = {}
    for c in K.ADVANCED_FEATURES:
        base = next((k for k in K.ADVANCED_CATEGORICAL_COLS if c.startswith(k + "_")), None)
        if c in K.ADVANCED_NUMERIC_COLS:
            out[c] = f"(({c} - m_{c}) / s_{c})"
        else:
            out[c] = f"(CASE WHEN {base} = '{c[len(base) + 1:]}' THEN 1 ELSE 0 END)" if base else c
    return out


_STATS_SQL = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}"
                       for c in K.ADVANCED_NUMERIC_COLS)


@register("batch_inference", CC + f""", st AS (SELECT {_STATS_SQL} FROM cc),
p AS (SELECT id, 1.0e0 / (1.0e0 + exp(-({logit_sql(ADVANCED_SERVE_SCORER, _advanced_row_sql())}))) AS probability FROM cc, st)
SELECT id, CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS prediction, round(probability, 6) AS probability FROM p""")
def batch_inference(spark, sf):
    """ML6 + IO14: the stage store is fitted and written, then the raw table
    without its target is scored with what is stored (linear scorer)."""
    root = shared_folder(spark, "batch-inference")
    raw = view(spark, sf, "clinical_raw")
    SS.fit_stage(spark, "advanced", raw, root)
    SS.save_model(spark, ADVANCED_SERVE_SCORER, root)
    scored = SS.infer(spark, "advanced", raw.drop(K.ADVANCED_TARGET_RAW), root, "linear")
    return rounded(scored.select("id", "prediction", "probability"))


@register("batch_inference_forest")
def batch_inference_forest(spark, sf):
    """ML6 with a forest that is trained, stored and loaded again."""
    from . import presets as P
    root = shared_folder(spark, "batch-inference")
    raw = view(spark, sf, "clinical_raw")
    P.train_job(spark, "advanced", raw, root)
    return rounded(SS.infer(spark, "advanced", raw.drop(K.ADVANCED_TARGET_RAW), root).select("id", "prediction", "probability"))


@register("embed_index")
def embed_index(spark, sf):
    """RA3 + RA4: chunk every document, embed with the hashing embedder."""
    chunks = RT.chunk_markdown(view(spark, sf, "kb_docs"))
    emb = RT.hashing_embed(chunks, "text", "embedding", 256)
    return emb.select("doc_id", "chunk_index", "source", "heading", "embedding")


@register("explain_forest")
def explain_forest(spark, sf):
    """EX1 + EX2 with a random forest (the generic path): every feature row
    is expanded into p + 1 variants, scored by ONE transform, re-assembled
    on the key, and the top 8 contributions per row are kept."""
    from ..operators import explain as EX
    df, feats = _advanced_features(spark, sf)
    model = TR.fit(df, feats, "random_forest", K.FOREST_ADVANCED_LOCAL)
    long = EX.ablation_model(model, df, feats, {f: 0.0 for f in feats}, key="id")
    return rounded(EX.topk_from_long(long, key="id"))


@register("serve_forest_advanced")
def serve_forest_advanced(spark, sf):
    """ML7 with the trained forest: every valid advanced request -> model
    row (stored vocabulary and scaler) -> serving response."""
    from ..functions import rules as R
    from ..operators import serve as SV
    df, stats, vocab, feats = EN.prepare_advanced(view(spark, sf, "clinical_raw"))
    model = TR.fit(df, feats, "random_forest", K.FOREST_ADVANCED_LOCAL)
    ok, _ = R.split_valid(view(spark, sf, "requests_advanced"), R.ADVANCED_SCHEMA)
    return rounded(SV.respond_model(model, SV.to_model_space_advanced(ok, stats, vocab, feats), feats))


@register("serve_forest_explained")
def serve_forest_explained(spark, sf):
    """ML7 + EX1-EX3 with the trained forest: top-8 labelled contributions
    (with display values) for every valid advanced request."""
    from ..functions import rules as R
    from ..operators import serve as SV
    df, stats, vocab, feats = EN.prepare_advanced(view(spark, sf, "clinical_raw"))
    model = TR.fit(df, feats, "random_forest", K.FOREST_ADVANCED_LOCAL)
    ok, _ = R.split_valid(view(spark, sf, "requests_advanced"), R.ADVANCED_SCHEMA)
    rows = SV.to_model_space_advanced(ok, stats, vocab, feats)
    return rounded(SV.explain_requests_model(model, ok, rows, feats, K.ADVANCED_FEATURE_LABELS,
                                             SV.advanced_display()))
