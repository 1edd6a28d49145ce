"""Models on Spark ML (#89, #90, #104, #105, #107, #115, #117, #130-#140).

Every model takes one DataFrame with a ``features`` vector and a double
``label`` (plus an optional weight column) - no separate X / y arrays.
Fitting is distributed by Spark ML; tables that come out of a model
(coefficients, importances) are tiny and are turned into DataFrames.
"""

from __future__ import annotations

import math
import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Interaction, OneHotEncoder, RFormula, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes
from ..functions.columns import col_of, r6
from ..session import cut_lineage
from .evaluate import model_comparison

SEED = 42


def assemble(df: DataFrame, features, label: str = codes.TARGET, keep=("encounter_id",)) -> DataFrame:
    """``features`` vector + double ``label`` in one DataFrame (keys kept)."""
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    cols = [c for c in keep if c in df.columns]
    out = va.transform(df.select(*[col_of(c) for c in cols], *[col_of(c).cast("double").alias(c) for c in features],
                                 col_of(label).cast("double").alias("label")))
    return out.select(*cols, "features", "label")


# #130 - #134 ------------------------------------------------------------------
def logistic(max_iter: int = 1000, reg: float = 0.0, weight_col: str | None = None,
             standardization: bool = False) -> LogisticRegression:
    """L2 logistic regression; ``reg`` is Spark's ``regParam`` (see
    ``l2_reg_param`` for the C-style strength).  Inputs are scaled upstream,
    so Spark's internal standardisation is off by default."""
    lr = LogisticRegression(maxIter=max_iter, regParam=reg, elasticNetParam=0.0,
                            standardization=standardization)
    return lr.setWeightCol(weight_col) if weight_col else lr


def l2_reg_param(n_rows: int, C: float = 1.0) -> float:
    """``C * sum(loss) + ||w||^2 / 2`` divided by ``C n`` is Spark's objective
    ``mean(loss) + regParam ||w||^2 / 2`` with ``regParam = 1 / (C n)``."""
    return 1.0 / (C * max(n_rows, 1))


def fit_logistic(train: DataFrame, C: float = 1.0, max_iter: int = 1000, weight_col: str | None = None):
    """The study's default model: L2 with C = 1 on pre-scaled features."""
    return logistic(max_iter, l2_reg_param(train.count(), C), weight_col).fit(train)


def tree(depth: int = 10) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(maxDepth=depth, seed=SEED)


def forest(n_trees: int = 100, depth: int = 10, weight_col: str | None = None) -> RandomForestClassifier:
    """``depth=None`` (unlimited in the study) maps to Spark's maximum, 30.
    Each row keeps its node of every tree (an int a tree) from level to level:
    the same trees, but no row walks down from the roots again."""
    rf = RandomForestClassifier(numTrees=n_trees, maxDepth=30 if depth is None else depth, seed=SEED,
                                cacheNodeIds=True, checkpointInterval=-1)
    return rf.setWeightCol(weight_col) if weight_col else rf


def boosted(n_trees: int = 100, depth: int = 5, step: float = 0.1,
            weight_col: str | None = None) -> GBTClassifier:
    gbt = GBTClassifier(maxIter=n_trees, maxDepth=depth, stepSize=step, seed=SEED)
    return gbt.setWeightCol(weight_col) if weight_col else gbt


def neural(n_features: int, hidden=(64, 32, 16), max_iter: int = 200) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[n_features, *hidden, 2], maxIter=max_iter, seed=SEED,
                                          blockSize=128)


def fit(estimator, train: DataFrame):
    return estimator.fit(train)


# #136
def score(model, df: DataFrame, key: str = "encounter_id") -> DataFrame:
    """``(key, label, score, prediction)``: probability of class 1 and the 0/1
    prediction of the model."""
    p = model.transform(df)
    cols = [key] if key in df.columns else []
    return p.select(*cols, F.col("label").cast("int").alias("label"),
                    vector_to_array("probability")[1].alias("score"),
                    F.col("prediction").cast("int").alias("prediction"))


# #137
def f1_evaluator() -> MulticlassClassificationEvaluator:
    """F1 of the positive class (not the weighted F1 of the default metric)."""
    return MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0)


def forest_grid(rf: RandomForestClassifier):
    """The 24-point grid trees {100, 200} x depth {10, 15, 20} x min rows per
    leaf {1, 2} x min rows per split {2, 5}; 18 of its points differ.  Spark has no minimum-rows-to-split
    rule; a split needs at least ``2 * minInstancesPerNode`` rows, so the split
    axis is expressed through ``minInstancesPerNode = ceil(split / 2)`` where it
    is stricter than the leaf value."""
    points = []
    for n in (100, 200):
        for d in (10, 15, 20):
            for leaf in (1, 2):
                for split in (2, 5):
                    point = {rf.numTrees: n, rf.maxDepth: d, rf.minInstancesPerNode: max(leaf, -(-split // 2))}
                    if point not in points:
                        points.append(point)
    return points


def grid_search(train: DataFrame, folds: int = 3, parallelism: int = 4, grid=None, estimator: RandomForestClassifier | None = None):
    """Cross-validated grid search scored by positive-class F1.  ``train``
    must carry a ``fold`` column (stratified, from ``stratified_folds``);
    ``grid`` holds distinct points over the parameters of ``estimator``."""
    rf = estimator or forest()
    cv = CrossValidator(estimator=rf, estimatorParamMaps=grid or forest_grid(rf), evaluator=f1_evaluator(),
                        numFolds=folds, foldCol="fold", parallelism=parallelism, seed=SEED)
    return cv.fit(train)


def grid_table(spark: SparkSession, fitted) -> DataFrame:
    """A row a grid point: its parameters, its mean F1 over the folds, and
    whether it is the best one (the first of equal ones)."""
    best = max(range(len(fitted.avgMetrics)), key=lambda i: (fitted.avgMetrics[i], -i))
    rows = [(i, ",".join(f"{p.name}={v}" for p, v in sorted(point.items(), key=lambda t: t[0].name)), float(f1), int(i == best))
            for i, (point, f1) in enumerate(zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics))]
    return spark.createDataFrame(rows, "point int, parameters string, f1 double, is_best int").withColumn("f1", r6("f1"))


# #138
def cross_val_metrics(data: DataFrame, make_estimator, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """Per fold F1 and ROC AUC on the held-out fold (``fold`` column given),
    plus the mean row."""
    from .evaluate import _prf, score_prefix
    scored = None
    for f in range(k):
        m = make_estimator().fit(data.filter(F.col("fold") != f))
        s = score(m, data.filter(F.col("fold") == f), key="__none__").select(F.lit(f).alias("fold"), "label", "score")
        scored = s if scored is None else scored.unionByName(s)
    scored = cut_lineage(scored, "fold_scores")
    pred, y = F.col("score") >= threshold, F.col("label") == 1
    counts = scored.groupBy("fold").agg(*[F.sum((p & q).cast("bigint")).alias(n) for n, p, q in [
        ("tp", pred, y), ("fp", pred, ~y), ("fn", ~pred, y)]])
    p = score_prefix(scored, descending=False, groups=["fold"])
    below = F.col("cum_neg") - F.col("neg")
    auc = p.groupBy("fold").agg(r6(F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)),
                                                F.first("P").cast("double") * F.first("N").cast("double"))).alias("roc_auc"))
    folds = data.sparkSession.range(k).select(F.col("id").cast("int").alias("fold"))         # a fold without rows has a row
    f1 = _prf(*[F.coalesce(F.col(n), F.lit(0)) for n in ("tp", "fp", "fn")])[2]
    out = cut_lineage(folds.join(counts, "fold", "left").join(auc, "fold", "left").select("fold", r6(f1).alias("f1"), "roc_auc"), "folds")
    mean = out.agg(F.lit(-1).alias("fold"), r6(F.avg("f1")).alias("f1"), r6(F.avg("roc_auc")).alias("roc_auc"))
    return out.unionByName(mean)


# #139
def baseline_estimators(weight_col: str | None = None, n_train: int | None = None) -> dict:
    reg = l2_reg_param(n_train) if n_train else 0.0
    return {"Logistic Regression": logistic(reg=reg, weight_col=weight_col), "Decision Tree": tree(),
            "Random Forest": forest(weight_col=weight_col), "Gradient Boosting": boosted(weight_col=weight_col)}


def train_and_compare(train: DataFrame, test: DataFrame, estimators: dict | None = None,
                      threshold: float = 0.5):
    """Fit every estimator, score the test table, compare (sorted by F1)."""
    estimators = estimators or baseline_estimators(n_train=train.count())
    fitted, scored = {}, None
    for name, est in estimators.items():
        m = est.fit(train)
        fitted[name] = m
        s = score(m, test).withColumn("model", F.lit(name))
        scored = s if scored is None else scored.unionByName(s)
    comp = model_comparison(scored.withColumnRenamed("encounter_id", "key"), threshold)
    return fitted, comp


def best_thresholds(scored: DataFrame, lo: float = 0.1, hi: float = 0.9, step: float = 0.05) -> DataFrame:
    """A row a model of a score table ``(model, label, score)``: the grid
    threshold of highest F1 (``score > t``; the lowest of equal ones), and
    accuracy, precision, recall, F1 and ROC AUC with it.  All models and
    thresholds come from one aggregate."""
    from .evaluate import _prf, score_prefix, threshold_grid
    grid = threshold_grid(lo, hi, step)
    above = F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t < F.col("score")))
    counts = scored.groupBy("model", above.alias("above")).agg(
        F.sum((F.col("label") == 1).cast("bigint")).alias("pos"), F.sum((F.col("label") != 1).cast("bigint")).alias("neg"))
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("j"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)]))
    hit = F.col("above") > F.col("j")
    sums = counts.select("*", place.alias("g")).select("model", "above", "pos", "neg", "g.*").groupBy("model", "j", "threshold").agg(*[
        F.sum(F.when(c, F.col(n)).otherwise(0)).alias(a) for a, c, n in (("tp", hit, "pos"), ("fp", hit, "neg"), ("fn", ~hit, "pos"), ("tn", ~hit, "neg"))])
    prec, rec, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    acc = F.try_divide((F.col("tp") + F.col("tn")).cast("double"), (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).cast("double"))
    rows = sums.select("model", F.struct((-r6(f1)).alias("o"), "j", "threshold", "tp", "fp", "fn", "tn", r6(acc).alias("accuracy"),
                                         r6(prec).alias("precision"), r6(rec).alias("recall"), r6(f1).alias("f1")).alias("r"))
    best = rows.groupBy("model").agg(F.min("r").alias("r")).select("model", "r.threshold", "r.tp", "r.fp", "r.fn", "r.tn", "r.accuracy", "r.precision", "r.recall", "r.f1")
    p = score_prefix(scored, descending=False, groups=["model"])
    below = F.col("cum_neg") - F.col("neg")
    auc = p.groupBy("model").agg(r6(F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)),
                                                 F.first("P").cast("double") * F.first("N").cast("double"))).alias("roc_auc"))
    return best.join(auc, "model")


# #104 / #105 / #115
def importance_table(spark: SparkSession, model, names, k: int | None = None) -> DataFrame:
    imp = model.featureImportances.toArray().tolist()
    rows = sorted(zip(names, imp), key=lambda t: (-t[1], t[0]))
    rows = rows[:k] if k else rows
    return spark.createDataFrame([(n, float(v)) for n, v in rows], "feature string, importance double")


def coefficient_table(spark: SparkSession, model, names, k: int | None = None) -> DataFrame:
    coef = model.coefficients.toArray().tolist()
    rows = sorted([(n, float(c)) for n, c in zip(names, coef) if c != 0.0], key=lambda t: (-abs(t[1]), t[0]))
    rows = rows[:k] if k else rows
    return spark.createDataFrame(rows, "feature string, coefficient double")


#: most bytes of a task's rows as Spark's trees keep them: an int a feature, zeros too
TREE_TASK_BYTES = 512 * 1024 * 1024
#: rows a core from which a table is dealt evenly over all cores
TREE_CORE_ROWS = 20_000


def dealt_for_trees(data: DataFrame, width: int) -> DataFrame:
    """``data`` over so many partitions that a task's rows, of ``width`` features
    each, stay under ``TREE_TASK_BYTES``, and evenly over all cores where it has
    ``TREE_CORE_ROWS`` for each; as it is where that holds already."""
    rows, cores = data.count(), data.sparkSession.sparkContext.defaultParallelism
    parts = math.ceil(rows * width * 4 / TREE_TASK_BYTES)
    if rows >= cores * TREE_CORE_ROWS:             # every level waits for the last task: equal tasks, a multiple of the cores
        return data.repartition(cores * max(1, math.ceil(parts / cores)))
    return data.repartition(parts) if parts > data.rdd.getNumPartitions() else data


def forest_importance(train: DataFrame, names, threshold: float = 0.001) -> DataFrame:
    m = forest().fit(dealt_for_trees(train, len(names)))
    return importance_table(train.sparkSession, m, names).filter(F.col("importance") > threshold)


def encoded_forest_importance(df: DataFrame, numeric, categorical, target: str = codes.TARGET, estimator=None) -> DataFrame:
    """``(feature, importance)`` of a forest over the numerics and the sparse
    one-hot vectors (first levels left out) of the text columns.  The names
    come from the level dictionary, joined by position.  Where the rows would
    take more than ``TREE_TASK_BYTES`` as Spark's trees keep them, and no
    ``estimator`` is given, the same kind of forest grows over rows that are not
    made wide (``sparse_forest``), with other draws of bags and features."""
    from . import encode as enc
    dictionary = cut_lineage(enc.level_dictionary(df, categorical), "dictionary")
    sizes = enc.vector_sizes(dictionary, categorical, drop_first=True)
    width = len(numeric) + sum(sizes.values())
    y = col_of(target).cast("double")
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max((~y.isin(0.0, 1.0)).cast("int")), F.lit(0)).alias("other")).first() if estimator is None else None
    if seen and not seen["other"] and seen["rows"] * width * 4 > TREE_TASK_BYTES:
        found = _sparse_importance(df, numeric, categorical, target, dictionary, sizes, seen["rows"])
    else:
        hot = enc.one_hot_vectors(df, categorical, dictionary, drop_first=True)
        hot = hot.select(*[col_of(c).cast("double").alias(c) for c in numeric], *[f"oh_{c}" for c in categorical], y.alias("label"))
        data = VectorAssembler(inputCols=[*numeric, *[f"oh_{c}" for c in categorical]], outputCol="features").transform(hot).select("features", "label")
        model = (estimator or forest()).fit(dealt_for_trees(cut_lineage(data, "encoded"), width))
        found = zip(model.featureImportances.indices, model.featureImportances.values)
    found = df.sparkSession.createDataFrame([(int(i), float(v)) for i, v in found], "position int, importance double")
    return enc.encoded_places(numeric, dictionary, categorical).join(found, "position").select("feature", "importance")


def _sparse_importance(df: DataFrame, numeric, categorical, target: str, dictionary: DataFrame, sizes: dict, n: int):
    """``(position, importance)`` of the features that ``forest()`` would split at."""
    from . import encode as enc, sparse_forest
    places, at = [], len(list(numeric))
    for c in categorical:
        index = F.col(f"`{c}__idx`")
        places.append(F.when(index > 0, index + (at - 1)).cast("int").alias(f"{c}__idx"))
        at += sizes[c]
    rows = enc.index_levels(df, categorical, dictionary).select(
        *[col_of(c).cast("double").alias(c) for c in numeric], *places, col_of(target).cast("int").alias("__label"))
    like = forest()
    found = sparse_forest.importances(cut_lineage(rows, "encoded"), numeric, {f"{c}__idx": sizes[c] for c in categorical}, "__label", n,
                                      like.getNumTrees(), like.getMaxDepth(), SEED)
    return [(i, v) for i, v in enumerate(found) if v > 0]


# #117
def interaction_features(fit_on: DataFrame, numeric, categorical):
    """Fitted stages that add ``features``: a sparse vector of all main terms
    (the numerics, one 0/1 term a level of the text columns; a level unknown to
    ``fit_on`` gives zeros) and of all products of terms of two columns.  (Two
    levels of one column never meet, so their products are left out.)  Text
    columns are taken from ``<name>__text``, see ``interaction_input``."""
    numeric, categorical = list(numeric), list(categorical)
    index = StringIndexer(inputCols=[f"{c}__text" for c in categorical], outputCols=[f"{c}__idx" for c in categorical],
                          handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical], outputCols=categorical, dropLast=True)
    cols = [*numeric, *categorical]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    products = [Interaction(inputCols=[a, b], outputCol=f"product{k}") for k, (a, b) in enumerate(pairs)]
    together = VectorAssembler(inputCols=[*cols, *[f"product{k}" for k in range(len(pairs))]], outputCol="features")
    return Pipeline(stages=[index, hot, *products, together]).fit(fit_on)


def interaction_input(df: DataFrame, numeric, categorical, label: str = codes.TARGET, keep=()) -> DataFrame:
    """The columns that ``interaction_features`` reads, and the label."""
    return df.select(*[col_of(k) for k in keep], *[col_of(c).cast("double").alias(c) for c in numeric],
                     *[col_of(c).cast("string").alias(f"{c}__text") for c in categorical], col_of(label).cast("double").alias("label"))


def term_names(df: DataFrame, vector: str = "features") -> list[str]:
    """Names of a vector's terms: ``column``, ``column_level`` and ``a:b``."""
    groups = df.schema[vector].metadata["ml_attr"]["attrs"]
    named = sorted((a["idx"], a["name"]) for g in groups.values() for a in g)
    return [re.sub(r"^product[0-9]+_", "", n) for _, n in named]


def l1_interaction_selection(train: DataFrame, names, C: float = 0.5, max_iter: int = 600) -> DataFrame:
    """L1 logistic regression (C as in the study: regParam = 1 / (C n)),
    unstandardised, over ``features``; the non-zero terms by name."""
    n = train.count()
    lr = LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (C * max(n, 1)), standardization=False,
                            maxIter=max_iter)
    return coefficient_table(train.sparkSession, lr.fit(train), names)


# #89 / #90
def glm_terms(model, names, feature: str | None = None) -> list:
    s = model.summary
    se, z, p = s.coefficientStandardErrors, s.tValues, s.pValues
    coefs = list(model.coefficients) + [model.intercept]
    terms = list(names) + ["Intercept"]
    out = []
    for t, c, e, zz, pp in zip(terms, coefs, se, z, p):
        out.append((feature or t, t, float(c), float(e), float(zz), float(pp)))
    return out


GLM_SCHEMA = "feature string, term string, coef double, stderr double, z double, p_value double"


def _glm_frame(spark, rows):
    df = spark.createDataFrame(rows, GLM_SCHEMA)
    return df.select("feature", "term", r6("coef").alias("coef"), r6(F.exp("coef")).alias("odds_ratio"),
                     r6(F.exp(F.col("coef") - 1.96 * F.col("stderr"))).alias("or_ci_low"),
                     r6(F.exp(F.col("coef") + 1.96 * F.col("stderr"))).alias("or_ci_high"),
                     r6("stderr").alias("stderr"), r6("z").alias("z"), r6("p_value").alias("p_value"))


GLM_STEPS, GLM_TOLERANCE = 25, 1e-10


def univariate_glm(df: DataFrame, cols, target: str = codes.TARGET) -> DataFrame:
    """One binomial GLM (logit) per numeric predictor, all at once: rows are
    counted by (predictor, value, outcome) in one pass, then every Newton step
    of all models is one aggregate over the counts, of which the driver sees
    one row a predictor.  Values are centred and scaled for the steps and the
    coefficients turned back.  Rows without the value or the outcome are left
    out.  A predictor or outcome that does not vary, or steps that do not
    settle (separated outcomes), give an ERROR row."""
    spark, cols = df.sparkSession, list(cols)
    long = df.select(col_of(target).cast("double").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), col_of(c).cast("double").alias("x")) for i, c in enumerate(cols)])).alias("p"))
    counts = (long.select("p.c", "p.x", "y").where("x IS NOT NULL AND y IS NOT NULL")
              .groupBy("c", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    counts = cut_lineage(counts, "glm_counts")
    x, y, n = F.col("x"), F.col("y"), F.col("n")
    first = counts.groupBy("c").agg(F.sum(n).alias("n"), F.sum(n * y).alias("y"), (F.sum(n * x) / F.sum(n)).alias("mean"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    shape = {r["c"]: r for r in first.collect()}                       # one row a predictor
    fits = {c: (0.0, 0.0) for c, r in shape.items() if r["lo"] < r["hi"] and 0 < r["y"] < r["n"]}
    scale = {c: (r["mean"], r["hi"] - r["lo"]) for c, r in shape.items()}
    done: dict = {}
    for _ in range(GLM_STEPS):
        if not fits:
            break
        at = spark.createDataFrame([(c, *scale[c], *b) for c, b in fits.items()], "c int, mean double, span double, b0 double, b1 double")
        z = (x - F.col("mean")) / F.col("span")
        p = 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * F.col("z"))))
        w = n * F.col("p") * (1 - F.col("p"))
        rest = n * (y - F.col("p"))
        step = (counts.join(F.broadcast(at), "c").withColumn("z", z).withColumn("p", p).groupBy("c").agg(
            F.sum(w).alias("w"), F.sum(w * F.col("z")).alias("wz"), F.sum(w * F.col("z") * F.col("z")).alias("wzz"),
            F.sum(rest).alias("r"), F.sum(rest * F.col("z")).alias("rz")))
        for r in step.collect():                                       # one row a predictor
            c, det = r["c"], r["w"] * r["wzz"] - r["wz"] * r["wz"]
            if not det > 0.0:
                del fits[c]
                continue
            d0, d1 = (r["wzz"] * r["r"] - r["wz"] * r["rz"]) / det, (r["w"] * r["rz"] - r["wz"] * r["r"]) / det
            b0, b1 = fits[c][0] + d0, fits[c][1] + d1
            if abs(b0) > 1e3 or abs(b1) > 1e3:
                del fits[c]
            elif abs(d0) + abs(d1) < GLM_TOLERANCE * (1 + abs(b0) + abs(b1)):
                done[c] = (b0, b1, r["wzz"] / det, r["w"] / det, -r["wz"] / det)
                del fits[c]
            else:
                fits[c] = (b0, b1)
    rows = []
    for c, name in enumerate(cols):
        if c not in done:
            rows.append((name, "ERROR", None, None, None, None))
            continue
        (b0, b1, v0, v1, v01), (m, s) = done[c], scale[c]
        k = m / s
        for term, b, v in ((name, b1 / s, v1 / s / s), ("Intercept", b0 - b1 * k, v0 + k * k * v1 - 2 * k * v01)):
            z = b / math.sqrt(v)
            rows.append((name, term, b, math.sqrt(v), z, math.erfc(abs(z) / math.sqrt(2))))
    return _glm_frame(spark, rows)


def multivariable_glm(df: DataFrame, numeric, categorical, target: str = codes.TARGET) -> DataFrame:
    """One binomial GLM over all terms (categoricals dummy-coded against their
    first sorted level); each term is mapped back to its source feature.  Each
    Newton step is one aggregate of the normal equations over the rows."""
    formula = f"{target} ~ " + " + ".join(list(numeric) + list(categorical))
    rf = RFormula(formula=formula, featuresCol="features", labelCol="label",
                  stringIndexerOrderType="alphabetAsc")
    data = cut_lineage(rf.fit(df).transform(df).select("features", "label"), "glm_rows")
    attrs = data.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = [None] * sum(len(v) for v in attrs.values())
    for group in attrs.values():
        for a in group:
            names[a["idx"]] = a["name"]
    m = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=100).fit(data)
    rows = glm_terms(m, names)
    src = list(numeric) + list(categorical)
    src.sort(key=len, reverse=True)            # diag_1_category before diag_1
    mapped = [(next((s for s in src if t == s or t.startswith(s + "_")), t), t, c, e, z, p)
              for _, t, c, e, z, p in rows]
    return _glm_frame(df.sparkSession, mapped)


# #135
def fit_neural_indexed(train: DataFrame, categorical, numeric, hidden=(128, 64)) -> PipelineModel:
    """Indexed categoricals one-hot encoded (unknown -> zeros) plus scaled
    numerics into a feed-forward network, whose input is as wide as the encoder
    fitted on ``train`` makes it."""
    from .encode import one_hot_pipeline
    encoder = Pipeline(stages=one_hot_pipeline(categorical)).fit(train)
    width = sum(size - 1 for size in encoder.stages[-1].categorySizes)       # without the place of unknown levels
    va = VectorAssembler(inputCols=[f"oh_{c}" for c in categorical] + list(numeric), outputCol="raw",
                         handleInvalid="keep")
    sc = StandardScaler(inputCol="raw", outputCol="features", withMean=False, withStd=True)
    rest = Pipeline(stages=[va, sc, neural(width + len(numeric), hidden)]).fit(encoder.transform(train))
    return PipelineModel(stages=[*encoder.stages, *rest.stages])


# #9 / #140
def save_model(model, path: str) -> None:
    pm = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
    pm.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def run_metadata(spark: SparkSession, model_name: str, features, metrics: dict, n_train: int,
                 n_test: int) -> DataFrame:
    schema = T.StructType([
        T.StructField("model_name", T.StringType()), T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("n_features", T.IntegerType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("training_samples", T.LongType()), T.StructField("test_samples", T.LongType())])
    return spark.createDataFrame([(model_name, list(features), len(features),
                                   {k: float(v) for k, v in metrics.items()}, int(n_train), int(n_test))], schema)


def write_metadata(meta: DataFrame, path: str) -> None:
    meta.coalesce(1).write.mode("overwrite").json(path)

