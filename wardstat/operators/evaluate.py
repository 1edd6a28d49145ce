"""Evaluation of a scored table ``(key, label, score)`` (#92-#105).

Threshold metrics are conditional sums (one aggregate).  Curves need
cumulative counts in score order: ``score_prefix`` groups by distinct score
(partial aggregate) and takes running sums by counted ranges
(``operators.ranges``), so no task holds more than a range of scores, however
they are distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..session import cut_lineage
from .ranges import running_sums


def score_prefix(df: DataFrame, label: str = "label", score: str = "score",
                 descending: bool = True, groups=()) -> DataFrame:
    """Per distinct score (within ``groups``): ``pos``, ``neg`` and inclusive
    running sums ``cum_pos``, ``cum_neg`` in score order, plus the group
    totals ``P``, ``N``."""
    groups = list(groups)
    g = df.groupBy(*[F.col(c) for c in groups], F.col(score).alias("score")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("pos"),
        F.sum((F.col(label) != 1).cast("bigint")).alias("neg"))
    g = cut_lineage(g, "score_counts")
    return (running_sums(g, groups, "score", ["pos", "neg"], descending)
            .withColumnsRenamed({"all_pos": "P", "all_neg": "N"}))


# #92
def confusion_matrix(df: DataFrame, threshold: float = 0.5, label: str = "label",
                     score: str = "score", strict: bool = False) -> DataFrame:
    pred = (F.col(score) > threshold) if strict else (F.col(score) >= threshold)
    y = F.col(label) == 1
    return df.agg(*[F.coalesce(F.sum((a & b).cast("bigint")), F.lit(0)).alias(n) for n, a, b in [
        ("tn", ~y, ~pred), ("fp", ~y, pred), ("fn", y, ~pred), ("tp", y, pred)]])


def _prf(tp, fp, fn):
    prec = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return prec, rec, f1


# #93
def binary_metrics(df: DataFrame, threshold: float = 0.5, label: str = "label",
                   score: str = "score", strict: bool = False) -> DataFrame:
    cm = confusion_matrix(df, threshold, label, score, strict)
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    prec, rec, f1 = _prf(tp, fp, fn)
    acc = F.try_divide((tp + tn).cast("double"), (tp + tn + fp + fn).cast("double"))
    return cm.select(r6(acc).alias("accuracy"), r6(prec).alias("precision"),
                     r6(rec).alias("recall"), r6(f1).alias("f1"))


# #94 / #95 / #96
def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Precision and recall at each distinct score used as ``score >= t``;
    points past full recall are dropped (as the usual PR-curve routine)."""
    p = score_prefix(df, label, score)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    rec = F.try_divide(F.col("cum_pos").cast("double"), F.col("P").cast("double"))
    return p.filter(F.col("cum_pos") - F.col("pos") < F.col("P")).select(
        F.col("score").alias("threshold"), r6(prec).alias("precision"), r6(rec).alias("recall"),
        F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """sum over thresholds of (R_i - R_{i-1}) * P_i (step-wise, no interpolation)."""
    p = score_prefix(df, label, score)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return p.agg(r6(F.try_divide(F.sum(F.col("pos") * prec), F.first("P").cast("double")))
                 .alias("average_precision"))


def pr_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Trapezoid area under (recall, precision), starting at (0, 1)."""
    p = score_prefix(df, label, score)
    prev_tp = F.col("cum_pos") - F.col("pos")
    prev_fp = F.col("cum_neg") - F.col("neg")
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    prev_prec = F.when(prev_tp + prev_fp == 0, F.lit(1.0)).otherwise(prev_tp / (prev_tp + prev_fp))
    area = F.col("pos") * (prec + prev_prec) / 2
    return p.agg(r6(F.try_divide(F.sum(area), F.first("P").cast("double"))).alias("pr_auc"))


# #97 / #98
def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """FPR and TPR at each distinct score used as ``score >= t``."""
    p = score_prefix(df, label, score)
    return p.select(F.col("score").alias("threshold"),
                    r6(F.try_divide(F.col("cum_neg").cast("double"), F.col("N").cast("double"))).alias("fpr"),
                    r6(F.try_divide(F.col("cum_pos").cast("double"), F.col("P").cast("double"))).alias("tpr"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area with ties counted half: sum_s pos_s * (neg below s + neg_s / 2) / (P N)."""
    p = score_prefix(df, label, score, descending=False)
    below = F.col("cum_neg") - F.col("neg")
    return p.agg(r6(F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)),
                                 F.first("P").cast("double") * F.first("N").cast("double"))).alias("roc_auc"))


# #99
def threshold_grid(lo: float, hi: float, step: float) -> list[float]:
    """lo, lo + step, ... below hi (half open, as in the study)."""
    n = int(round((hi - lo) / step))
    return [round(lo + i * step, 10) for i in range(n)]


def threshold_sweep(df: DataFrame, lo: float = 0.1, hi: float = 0.9, step: float = 0.05,
                    label: str = "label", score: str = "score") -> DataFrame:
    """F1 (and precision / recall) on a fixed grid with ``score > t``.

    Each row is mapped to the number of grid points strictly below its score,
    counted with a partial aggregate; the per-threshold sums then come from a
    grid-sized table, so the data is read once whatever the grid size."""
    grid = threshold_grid(lo, hi, step)
    arr = F.array(*[F.lit(t) for t in grid])
    s = F.col(score)
    idx = F.size(F.filter(arr, lambda t: t < s))
    c = df.groupBy(idx.alias("idx")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("pos"),
        F.sum((F.col(label) != 1).cast("bigint")).alias("neg"))
    spark = df.sparkSession
    g = spark.createDataFrame([(j, t) for j, t in enumerate(grid)], "j int, threshold double")
    j = F.broadcast(g).crossJoin(c)  # grid x (grid + 1) rows
    above = F.col("idx") > F.col("j")
    agg = j.groupBy("j", "threshold").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"))
    prec, rec, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return agg.select("threshold", "tp", "fp", "fn", r6(prec).alias("precision"),
                      r6(rec).alias("recall"), r6(f1).alias("f1"))


def best_of_sweep(sweep: DataFrame) -> DataFrame:
    """Highest F1 on the grid; the first (lowest) threshold wins ties."""
    return sweep.agg(F.min_by("threshold", F.struct((-F.col("f1")).alias("nf"), F.col("threshold")))
                     .alias("threshold"), F.max("f1").alias("f1"))


# #100
def best_f1_threshold(df: DataFrame, label: str = "label", score: str = "score",
                      eps: float = 1e-9) -> DataFrame:
    """F1 = 2PR / (P + R + eps) at every observed score (``>=``); the lowest
    threshold wins ties."""
    p = score_prefix(df, label, score).filter(F.col("cum_pos") - F.col("pos") < F.col("P"))
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    rec = F.col("cum_pos") / F.col("P")
    p = p.select(F.col("score").alias("threshold"), (2 * prec * rec / (prec + rec + eps)).alias("f1"))
    return p.agg(F.min_by("threshold", F.struct((-F.col("f1")).alias("nf"), F.col("threshold")))
                 .alias("threshold"), r6(F.max("f1")).alias("f1"))


# #101
def classification_report(df: DataFrame, threshold: float = 0.5, label: str = "label",
                          score: str = "score") -> DataFrame:
    cm = confusion_matrix(df, threshold, label, score)
    tp, fp, fn, tn = [F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn")]
    p1, r1, f1 = _prf(tp, fp, fn)
    p0, r0, f0 = _prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    n = s1 + s0
    rows = [("0", p0, r0, f0, s0), ("1", p1, r1, f1, s1),
            ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
            ("weighted avg", (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n)]
    return cm.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(c).alias("class"), r6(p).alias("precision"),
                 r6(r).alias("recall"), r6(f).alias("f1"), s.cast("bigint").alias("support"))
        for i, (c, p, r, f, s) in enumerate(rows)])).alias("r")).select("r.*")


# #102
def model_comparison(df: DataFrame, threshold: float = 0.5, model: str = "model",
                     label: str = "label", score: str = "score") -> DataFrame:
    """One row per model: accuracy, precision, recall, F1 at ``threshold``
    and ROC AUC (ties half), ranked by F1; ``is_best`` marks the top row."""
    pred = F.col(score) >= threshold
    y = F.col(label) == 1
    cm = df.groupBy(model).agg(*[F.sum((a & b).cast("bigint")).alias(n) for n, a, b in [
        ("tn", ~y, ~pred), ("fp", ~y, pred), ("fn", y, ~pred), ("tp", y, pred)]])
    prec, rec, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    acc = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    # AUC per model from grouped, bucketed prefix sums (no per-model task)
    p = score_prefix(df, label, score, descending=False, groups=[model])
    below = F.col("cum_neg") - F.col("neg")
    auc = p.groupBy(model).agg(F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)),
                                            F.first("P").cast("double") * F.first("N").cast("double"))
                               .alias("roc_auc"))
    out = cm.select(model, r6(acc).alias("accuracy"), r6(prec).alias("precision"),
                    r6(rec).alias("recall"), r6(f1).alias("f1")).join(auc, model)
    rank = F.row_number().over(Window.orderBy(F.col("f1").desc(), F.col(model)))
    return out.select(model, "accuracy", "precision", "recall", "f1", r6("roc_auc").alias("roc_auc"),
                      rank.alias("rank")).withColumn("is_best", (F.col("rank") == 1).cast("int"))


# #103
def melt_metrics(df: DataFrame, id_cols, metric_cols) -> DataFrame:
    return df.unpivot(list(id_cols), list(metric_cols), "metric", "value")


# #104 / #105 (fitted models) live in operators.models
