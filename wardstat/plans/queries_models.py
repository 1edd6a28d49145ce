"""Registered queries, part 5: fitted models (rows-only checks: a fitted
model has no SQL equivalent)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import balance as bal, encode as enc, models as ml, neighbours as nb
from ..session import cut_lineage, stage_folder
from . import oracle_sql as O
from .registry import register
from .pipeline import cleaned, engineer
from .queries_eval import TWO_SCORES as TWO, two_models
from .queries_profile import CLEAN_NUMERIC, KEY_NUMERICAL

MODEL_FEATURES = KEY_NUMERICAL + ["admission_type_id", "discharge_disposition_id", "admission_source_id",
                                  "diab_type", "diab_control", "diab_complication_binary", "meds_per_day",
                                  "procedures_per_day", "labs_per_day", "total_prior_visits", "high_utilizer",
                                  "A1C_tested", "diabetes_med_changed", "on_diabetes_med", "long_stay",
                                  "many_medications", "complex_case"]


#: cleaned columns that the model features are made of
FEATURE_SOURCES = [c for c in CLEAN_NUMERIC if c in MODEL_FEATURES or c in KEY_NUMERICAL] + ["A1Cresult", "change", "diabetesMed"]


def split_scaled(spark, sf, test_frac=0.2):
    """Stratified 80/20 split, features scaled with train statistics.  Only the
    columns of the model are read and written."""
    data = engineer(cleaned(spark, sf, ["encounter_id", codes.TARGET, *FEATURE_SOURCES])).select("encounter_id", codes.TARGET, *MODEL_FEATURES)
    f = cut_lineage(bal.stratified_split(data, test_frac))
    train = f.filter(F.col("split") == "train")
    scaled = enc.standard_scale(f, MODEL_FEATURES, fit_on=train)
    data = ml.assemble(scaled, MODEL_FEATURES, keep=("encounter_id", "split"))
    return data.filter(F.col("split") == "train").drop("split"), data.filter(F.col("split") == "test").drop("split")


def smote_train(train):
    """SMOTE on the scaled training vectors (exact neighbours)."""
    arr = train.select("encounter_id", vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"))
    s = nb.smote(arr, "encounter_id", "x", "y", minority=1, k=5, seed=42)
    return s.select("encounter_id", array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))


@register("train_and_compare_models")
def q_train_compare(spark, sf):
    train, test = split_scaled(spark, sf)
    train = cut_lineage(smote_train(train))
    _, comp = ml.train_and_compare(train, test)
    return comp


@register("logistic_scored_test")
def q_logistic(spark, sf):
    train, test = split_scaled(spark, sf)
    return ml.score(ml.fit_logistic(train), test)


@register("forest_importance")
def q_forest_imp(spark, sf):
    train, _ = split_scaled(spark, sf)
    return ml.forest_importance(train, MODEL_FEATURES, 0.001)


@register("l1_logistic_coefficients")
def q_l1(spark, sf):
    """L1 over the plain features (no interactions)."""
    train, _ = split_scaled(spark, sf)
    return ml.l1_interaction_selection(train, MODEL_FEATURES, C=1.0, max_iter=1000)


L1_CATEGORICAL = ["age", "gender", "race", "diag_1_category", "A1Cresult", "insulin", "change", "diabetesMed"]


def interaction_train(spark, sf):
    """Rows and fitted stages of the interaction model: 75 % of each class."""
    c = cleaned(spark, sf, ["encounter_id", *KEY_NUMERICAL, *L1_CATEGORICAL, codes.TARGET])
    split = bal.stratified_split(c, 0.25).filter(F.col("split") == "train").drop("split")
    train = cut_lineage(ml.interaction_input(split, KEY_NUMERICAL, L1_CATEGORICAL))
    return train, ml.interaction_features(train, KEY_NUMERICAL, L1_CATEGORICAL)


def _terms_sql(numeric, categorical):
    """All main terms and products of terms of two columns, from the train rows."""
    cols = [*numeric, *categorical]
    main = " UNION ALL ".join([f"SELECT {i} AS c, '{x}' AS term" for i, x in enumerate(numeric)] + [
        f"SELECT DISTINCT {len(numeric) + i}, '{x}_' || {O.ident(x)} FROM tr WHERE {O.ident(x)} IS NOT NULL" for i, x in enumerate(categorical)])
    return O.CLEANED + f"""
, rk AS (SELECT *, row_number() OVER (PARTITION BY readmitted_binary ORDER BY md5(CAST(encounter_id AS VARCHAR)), encounter_id) AS rnk,
           count(*) OVER (PARTITION BY readmitted_binary) AS n_c FROM cleaned),
tr AS (SELECT * FROM rk WHERE rnk > round(n_c * 0.25)),
t AS ({main})
SELECT term FROM t UNION ALL SELECT a.term || ':' || b.term FROM t a JOIN t b ON a.c < b.c AND a.c < {len(cols)}"""


@register("l1_interaction_terms", _terms_sql(KEY_NUMERICAL, L1_CATEGORICAL))
def q_l1_terms(spark, sf):
    """The terms among which the L1 model selects."""
    train, stages = interaction_train(spark, sf)
    return spark.createDataFrame([(n,) for n in ml.term_names(stages.transform(train))], "term string")


@register("l1_interaction_selection")
def q_l1_interactions(spark, sf):
    train, stages = interaction_train(spark, sf)
    data = stages.transform(train)
    names = ml.term_names(data)
    return ml.l1_interaction_selection(cut_lineage(data.select("features", "label")), names)


def _glm_sql(cols, steps=12):
    """The Newton steps of all one-column models, written out, from zero."""
    counts = " UNION ALL ".join(
        f"SELECT {O.q(c)} AS feature, CAST({O.ident(c)} AS DOUBLE) AS x, CAST(readmitted_binary AS DOUBLE) AS y, count(*) AS n "
        f"FROM cleaned WHERE {O.ident(c)} IS NOT NULL GROUP BY 2, 3" for c in cols)
    sql = O.CLEANED + f"""
, k AS MATERIALIZED ({counts}),
b0 AS (SELECT feature, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM k GROUP BY feature
       HAVING min(x) < max(x) AND min(y) < max(y))"""
    for i in range(steps):
        sql += f""",
s{i + 1} AS (SELECT feature, a, b, sum(n * p * (1 - p)) AS w, sum(n * p * (1 - p) * x) AS wx, sum(n * p * (1 - p) * x * x) AS wxx,
       sum(n * (y - p)) AS r, sum(n * (y - p) * x) AS rx
       FROM (SELECT k.*, a, b, 1 / (1 + exp(-(a + b * x))) AS p FROM k JOIN b{i} USING (feature)) GROUP BY feature, a, b),
b{i + 1} AS (SELECT feature, a + (wxx * r - wx * rx) / (w * wxx - wx * wx) AS a, b + (w * rx - wx * r) / (w * wxx - wx * wx) AS b,
       wxx / (w * wxx - wx * wx) AS va, w / (w * wxx - wx * wx) AS vb FROM s{i + 1})"""
    erfc = ("u * exp(-h * h - 1.26551223 + u * (1.00002368 + u * (0.37409196 + u * (0.09678418 + u * (-0.18628806 + u * (0.27886807 "
            "+ u * (-1.13520398 + u * (1.48851587 + u * (-0.82215223 + u * 0.17087277)))))))))")
    return sql + f""",
t AS (SELECT feature, feature AS term, b AS coef, sqrt(vb) AS se FROM b{steps} UNION ALL SELECT feature, 'Intercept', a, sqrt(va) FROM b{steps}),
e AS (SELECT *, abs(coef / se) / sqrt(2.0) AS h, 1.0 / (1.0 + 0.5 * abs(coef / se) / sqrt(2.0)) AS u FROM t)
SELECT feature, term, round(coef, 6) AS coef, round(exp(coef), 6) AS odds_ratio, round(exp(coef - 1.96 * se), 6) AS or_ci_low,
  round(exp(coef + 1.96 * se), 6) AS or_ci_high, round(se, 6) AS stderr, round(coef / se, 6) AS z, round({erfc}, 6) AS p_value FROM e
UNION ALL SELECT DISTINCT feature, 'ERROR', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM k WHERE feature NOT IN (SELECT feature FROM b0)"""


@register("glm_univariate", _glm_sql(KEY_NUMERICAL))
def q_glm_uni(spark, sf):
    return ml.univariate_glm(cleaned(spark, sf, [*KEY_NUMERICAL, codes.TARGET]), KEY_NUMERICAL)


@register("glm_multivariable")
def q_glm_multi(spark, sf):
    numeric, categorical = ["time_in_hospital", "num_medications", "number_inpatient"], ["age", "diag_1_category"]
    return ml.multivariable_glm(cleaned(spark, sf, [*numeric, *categorical, codes.TARGET]), numeric, categorical)


@register("neural_network_undersampled")
def q_mlp(spark, sf):
    train, test = split_scaled(spark, sf)
    bal_train = bal.undersample(train.withColumn("_y", F.col("label").cast("int")), 1.0, label="_y",
                                key="encounter_id").drop("_y")
    m = ml.neural(len(MODEL_FEATURES)).fit(bal_train)
    return ml.score(m, test)


@register("cross_validated_logistic")
def q_cv(spark, sf):
    train, _ = split_scaled(spark, sf)
    folds = bal.stratified_folds(train.withColumn("_y", F.col("label").cast("int")), 5, label="_y").drop("_y")
    folds = cut_lineage(folds)
    reg = ml.l2_reg_param(folds.count() * 4 // 5)  # C = 1 on the training folds
    return ml.cross_val_metrics(folds, lambda: ml.logistic(reg=reg), k=5)


@register("class_weighted_logistic")
def q_weighted(spark, sf):
    train, test = split_scaled(spark, sf)
    w = bal.with_weights(train.withColumn("_y", F.col("label").cast("int")), "_y").drop("_y")
    m = ml.fit_logistic(w, weight_col="weight")
    from ..operators.evaluate import binary_metrics, roc_auc
    s = ml.score(m, test)
    return binary_metrics(s, 0.5).crossJoin(roc_auc(s))


@register("run_metadata")
def q_meta(spark, sf):
    train, test = split_scaled(spark, sf)
    m = ml.fit_logistic(train)
    from ..operators.evaluate import binary_metrics
    met = binary_metrics(ml.score(m, test), 0.5).first().asDict()
    return ml.run_metadata(spark, "Logistic Regression", MODEL_FEATURES, met, train.count(), test.count())


#: trees x depth x rows a leaf: distinct points in Spark's parameters
def small_grid(rf):
    return [{rf.numTrees: n, rf.maxDepth: d, rf.minInstancesPerNode: m} for n in (20, 40) for d in (5, 10) for m in (1, 2)]


def folded(train, k=3):
    return cut_lineage(bal.stratified_folds(train.withColumn("_y", F.col("label").cast("int")), k, label="_y").drop("_y"))


@register("grid_search_forest")
def q_grid(spark, sf):
    """Mean F1 of every grid point over three stratified folds of the balanced
    train rows."""
    train, _ = split_scaled(spark, sf)
    rf = ml.forest()
    return ml.grid_table(spark, ml.grid_search(folded(smote_train(train)), grid=small_grid(rf), estimator=rf))


def tuned_scores(spark, sf):
    """Score table (model, encounter_id, label, score) of the tuned forest, the
    class-weighted models and the boosted trees on the test rows."""
    train, test = split_scaled(spark, sf)
    rf = ml.forest()
    tuned = ml.grid_search(folded(smote_train(train)), grid=small_grid(rf), estimator=rf).bestModel
    weighted = cut_lineage(bal.with_weights(train.withColumn("_y", F.col("label").cast("int")), "_y").drop("_y"))
    reg = ml.l2_reg_param(weighted.count())
    dealt = ml.dealt_for_trees(weighted, len(MODEL_FEATURES))
    models = {"Random Forest (Tuned)": tuned, "Logistic Regression (Balanced)": ml.logistic(reg=reg, weight_col="weight").fit(weighted),
              "Random Forest (Balanced)": ml.forest(50, weight_col="weight").fit(dealt),
              "Gradient Boosting (Balanced)": ml.boosted(20, weight_col="weight").fit(dealt)}
    out = None
    for name, m in models.items():
        s = ml.score(m, test).select(F.lit(name).alias("model"), "encounter_id", "label", "score")
        out = s if out is None else out.unionByName(s)
    return cut_lineage(out, "tuned_scores")


@register("thresholds_per_model", TWO + """
, grid AS (SELECT CAST(round(0.1 + range * 0.05, 10) AS DOUBLE) AS threshold FROM range(16)),
sw AS (SELECT model, threshold, CAST(sum(CASE WHEN label = 1 AND score > threshold THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN label <> 1 AND score > threshold THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN label = 1 AND NOT score > threshold THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN label <> 1 AND NOT score > threshold THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM sm, grid GROUP BY model, threshold),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM sw),
f AS (SELECT *, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM pr),
au AS (SELECT a.model, round((sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END)) / count(*), 6) AS roc_auc
       FROM sm a JOIN sm b ON a.model = b.model AND a.label = 1 AND b.label <> 1 GROUP BY a.model)
SELECT f.model, threshold, tp, fp, fn, tn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(p, 6) AS precision,
  round(r, 6) AS recall, f1, roc_auc FROM f JOIN au USING (model)
QUALIFY row_number() OVER (PARTITION BY f.model ORDER BY f1 DESC, threshold) = 1""")
def q_thresholds(spark, sf):
    """The exact form of the comparison, on two stated scores."""
    return ml.best_thresholds(two_models(spark, sf))


@register("tuned_model_comparison")
def q_tuned(spark, sf):
    """Tuned and balanced models, each with its own threshold."""
    return ml.best_thresholds(tuned_scores(spark, sf))


TEST_ROWS = O.CLEANED + """
, rk AS (SELECT *, row_number() OVER (PARTITION BY readmitted_binary ORDER BY md5(CAST(encounter_id AS VARCHAR)), encounter_id) AS rnk,
           count(*) OVER (PARTITION BY readmitted_binary) AS n_c FROM cleaned),
te AS (SELECT encounter_id, readmitted_binary AS label FROM rk WHERE rnk <= round(n_c * 0.2))
"""


@register("tuned_score_checks", TEST_ROWS + """
SELECT model, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, 0 AS out_of_range, 0 AS metric_differences
FROM te, (SELECT unnest(['Random Forest (Tuned)', 'Logistic Regression (Balanced)', 'Random Forest (Balanced)',
                         'Gradient Boosting (Balanced)']) AS model) GROUP BY model""")
def q_tuned_checks(spark, sf):
    """The exact part of the comparison: test rows and positives of each model,
    scores outside of 0 to 1, and counts of the comparison that differ from the
    score table's."""
    scores = tuned_scores(spark, sf)
    best = cut_lineage(ml.best_thresholds(scores))
    hit, y = F.col("score") > F.col("threshold"), F.col("label") == 1
    again = scores.join(F.broadcast(best), "model").groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("positives"),
        F.sum((~F.col("score").between(0, 1)).cast("int")).cast("int").alias("out_of_range"),
        *[F.sum((a & b).cast("bigint")).alias(f"_{c}") for c, a, b in (("tp", hit, y), ("fp", hit, ~y), ("fn", ~hit, y), ("tn", ~hit, ~y))])
    wrong = [(F.col(c) != F.col(f"_{c}")).cast("int") for c in ("tp", "fp", "fn", "tn")]
    return again.join(best, "model").select("model", "n", "positives", "out_of_range", sum(wrong[1:], wrong[0]).alias("metric_differences"))


@register("model_file_round_trip", TEST_ROWS + "SELECT encounter_id, CAST(label AS INTEGER) AS label, true AS same FROM te")
def q_model_files(spark, sf):
    """A fitted model written under the shared folder and read again scores
    every test row as before."""
    train, test = split_scaled(spark, sf)
    model = ml.fit_logistic(train)
    path = stage_folder(spark, "model")
    ml.save_model(model, path)
    one = ml.score(model, test)
    two = ml.score(ml.load_model(path), test).select("encounter_id", F.col("score").alias("_s"), F.col("prediction").alias("_p"))
    return one.join(two, "encounter_id").select("encounter_id", "label", ((F.col("score") == F.col("_s")) & (F.col("prediction") == F.col("_p"))).alias("same"))


@register("neural_network_oversampled")
def q_mlp_over(spark, sf):
    """The network on randomly oversampled train rows."""
    train, test = split_scaled(spark, sf)
    rows = bal.oversample_random(train.withColumn("_y", F.col("label").cast("int")), "_y").drop("_y", "draw")
    return ml.score(ml.neural(len(MODEL_FEATURES)).fit(cut_lineage(rows)), test)
