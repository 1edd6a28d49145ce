"""Cohort statistics (#76-#91).

Everything is a grouped aggregate (partial + final stage) over the cohort;
the statistics that need a distribution function (t, normal tails) are
computed on the tiny aggregated result with JVM math where possible.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes
from ..functions.columns import col_of, r6
from ..session import cut_lineage

TARGET = codes.TARGET


# #76
def rate_by(df: DataFrame, col: str, target: str = TARGET) -> DataFrame:
    """Target mean x 100 and size per level (null level kept as its own group)."""
    return df.groupBy(col_of(col).alias(col)).agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg(col_of(target)) * 100).alias("rate"))


# #77
def rate_by_bins(df: DataFrame, col: str = "num_medications", target: str = TARGET,
                 edges=codes.MEDICATION_BINS, labels=codes.MEDICATION_BIN_LABELS) -> DataFrame:
    """Rate per right-closed bin; every bin listed, empty bins get null rate
    and n = 0 (right join to the bin list)."""
    from ..functions.columns import interval_bins
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, lab) for i, lab in enumerate(labels)], "bin_order int, bin string")
    agg = (df.select(interval_bins(col, edges, labels).alias("bin"), col_of(target).alias("_y"))
           .filter(F.col("bin").isNotNull())
           .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("_r")))
    return (F.broadcast(bins).join(agg, "bin", "left")
            .select("bin", "bin_order", F.coalesce("n", F.lit(0)).alias("n"),
                    r6(F.col("_r") * 100).alias("rate")))


# #78
def crosstab_rates(df: DataFrame, col: str, target: str = TARGET, k: int = 5) -> DataFrame:
    """Row-normalised cross table (share of 0 and 1 per level, in %), the top
    ``k`` levels by positive share (ties by level), with n."""
    agg = df.groupBy(col_of(col).alias("level")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((col_of(target) == 1).cast("double")).alias("_p1"))
    w = Window.orderBy(F.col("_p1").desc(), F.col("level").asc_nulls_last())
    return (agg.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("level", "n", "rank", r6(F.col("_p1") * 100).alias("pct_1"),
                    r6((1 - F.col("_p1")) * 100).alias("pct_0")))


# #79
def riskiest_level(df: DataFrame, col: str, target: str = TARGET) -> DataFrame:
    """Level with the highest rate; first level (sorted) on ties."""
    rates = df.groupBy(col_of(col).alias("level")).agg(F.avg(col_of(target)).alias("_r"))
    return rates.agg(
        F.min_by("level", F.struct((-F.col("_r")).alias("nr"), F.col("level"))).alias("level"),
        r6(F.max("_r") * 100).alias("rate"))


# #80 / #81
def _class_moments(df: DataFrame, cols, target: str):
    aggs = []
    for c in cols:
        for cls in (1, 0):
            x = F.when(col_of(target) == cls, col_of(c).cast("double"))
            aggs += [F.count(x).alias(f"{c}__n{cls}"), F.avg(x).alias(f"{c}__m{cls}"),
                     F.var_samp(x).alias(f"{c}__v{cls}")]
    return df.agg(*aggs)


def mean_difference(df: DataFrame, cols, target: str = TARGET) -> DataFrame:
    """Per feature: mean in class 1 and 0, difference, percent difference."""
    m = _class_moments(df, cols, target)
    rows = [F.struct(F.lit(c).alias("feature"),
                     F.col(f"{c}__m1").alias("mean_1"), F.col(f"{c}__m0").alias("mean_0"))
            for c in cols]
    out = m.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.select("feature", r6("mean_1").alias("mean_1"), r6("mean_0").alias("mean_0"),
                      r6(F.col("mean_1") - F.col("mean_0")).alias("diff"),
                      r6(F.try_divide(F.col("mean_1") - F.col("mean_0"), F.col("mean_0")) * 100)
                      .alias("pct_diff"))


def _betacf(a, b, x):
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 300):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > 1e-300 else 1e-300
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > 1e-300 else 1e-300
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return h


def t_two_sided_p(t, df):
    """Two-sided Student-t tail via the regularised incomplete beta."""
    if t is None or df is None or df <= 0 or (isinstance(t, float) and math.isnan(t)):
        return None
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x <= 0:
        return 0.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(math.log(x) * a + math.log(1 - x) * b + lbeta)
    if x < (a + 1) / (a + b + 2):
        ib = front * _betacf(a, b, x) / a
    else:
        ib = 1.0 - front * _betacf(b, a, 1 - x) / b
    return min(1.0, max(0.0, ib))


def normal_two_sided_p(z):
    if z is None or (isinstance(z, float) and math.isnan(z)):
        return None
    return math.erfc(abs(z) / math.sqrt(2.0))


def two_sample_t(df: DataFrame, cols, target: str = TARGET) -> DataFrame:
    """Pooled-variance Student t per feature: n, means, t and degrees of
    freedom from one aggregate.  ``p_value`` is added by ``with_t_pvalues``."""
    m = _class_moments(df, cols, target)
    rows = []
    for c in cols:
        n1, n0 = F.col(f"{c}__n1").cast("double"), F.col(f"{c}__n0").cast("double")
        v1, v0 = F.col(f"{c}__v1"), F.col(f"{c}__v0")
        dof = n1 + n0 - 2
        sp2 = F.try_divide((n1 - 1) * v1 + (n0 - 1) * v0, dof)
        se = F.sqrt(sp2 * (1 / n1 + 1 / n0))
        t = F.try_divide(F.col(f"{c}__m1") - F.col(f"{c}__m0"), F.when(se > 0, se))
        rows.append(F.struct(F.lit(c).alias("feature"), n1.cast("bigint").alias("n_1"),
                             n0.cast("bigint").alias("n_0"), t.alias("t"), dof.alias("dof")))
    out = m.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.select("feature", "n_1", "n_0", r6("t").alias("t"), F.col("dof").cast("bigint").alias("dof"))


def with_t_pvalues(tt: DataFrame) -> DataFrame:
    """Add p-value and stars on the per-feature result (one row per feature)."""
    @F.pandas_udf(T.DoubleType())
    def pval(t, d):
        import pandas as pd
        return pd.Series([t_two_sided_p(a, b) if pd.notna(a) and pd.notna(b) else None
                          for a, b in zip(t, d)], dtype="float64")
    p = pval(F.col("t"), F.col("dof").cast("double"))
    return tt.withColumn("p_value", p).withColumn(
        "flag", F.when(F.col("p_value") < 0.001, "***").when(F.col("p_value") < 0.01, "**")
        .when(F.col("p_value") < 0.05, "*").when(F.col("p_value").isNotNull(), "ns"))


# #82 / #83
def _corr_terms(x, y):
    """Centred moments of the rows where both are present (numerically stable
    aggregates with a partial stage, no raw sums that cancel)."""
    return [F.covar_pop(x, y), F.stddev_pop(F.when(y.isNotNull(), x)), F.stddev_pop(F.when(x.isNotNull(), y))]


def _pearson(cov, sx, sy):
    return F.when((sx > 0) & (sy > 0), cov / (sx * sy))


def _gram(batches, p: int):
    """Sums over the rows of a task for each pair of columns (i, j), of the rows
    where both are present: their number, the values of i, their squares, and
    the products of both."""
    n, s, q, c = (np.zeros((p, p)) for _ in range(4))
    for batch in batches:
        x = np.stack([col.to_numpy(zero_copy_only=False).astype(float) for col in batch.columns], axis=1)
        there = ~np.isnan(x)
        x = np.where(there, x, 0.0)
        there = there.astype(float)
        n += there.T @ there
        s += x.T @ there
        q += (x * x).T @ there
        c += x.T @ x
    i, j = (k.ravel().astype(np.int32) for k in np.indices((p, p)))
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *(pa.array(m.ravel()) for m in (n, s, q, c))], names=["i", "j", "n", "s", "q", "c"])


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation of every pair (long form ``a, b, corr``) of the rows
    where both are present; zero variance gives null.

    One Gram aggregate: each task multiplies its rows as blocks, and sends one
    row a pair of columns.  Values are taken less their column's smallest, so
    that a column which does not vary is all zeros and sums do not cancel."""
    cols = list(cols)
    data = cut_lineage(df.select(*[col_of(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]), "correlated")
    low = data.agg(*[F.min(f"x{i}").alias(f"lo{i}") for i in range(len(cols))])
    shifted = data.crossJoin(F.broadcast(low)).select(*[(F.col(f"x{i}") - F.col(f"lo{i}")).alias(f"x{i}") for i in range(len(cols))])   # one row
    p = len(cols)
    sums = shifted.mapInArrow(lambda batches: _gram(batches, p), "i int, j int, n double, s double, q double, c double")
    total = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "nsqc"])
    back = total.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    n = F.col("n")
    cov = n * F.col("c") - F.col("s") * F.col("s2")
    # what is left of a sum by rounding alone is no variance
    vx, vy = n * F.col("q") - F.col("s") * F.col("s"), n * F.col("q2") - F.col("s2") * F.col("s2")
    varies = (vx > 1e-12 * n * F.col("q")) & (vy > 1e-12 * n * F.col("q2"))
    corr = F.when(varies, F.least(F.greatest(cov / (F.sqrt(vx) * F.sqrt(vy)), F.lit(-1.0)), F.lit(1.0)))
    name = F.array(*[F.lit(c) for c in cols])
    return total.join(back, ["i", "j"]).select(F.element_at(name, F.col("i") + 1).alias("a"), F.element_at(name, F.col("j") + 1).alias("b"), r6(corr).alias("corr"))


def target_correlation(df: DataFrame, cols, target: str = TARGET, k: int | None = None) -> DataFrame:
    """``feature, corr, abs_corr`` sorted by absolute correlation (desc)."""
    aggs = []
    y = col_of(target).cast("double")
    for i, c in enumerate(cols):
        x = col_of(c).cast("double")
        aggs += [t.alias(f"c{i}_{j}") for j, t in enumerate(_corr_terms(x, y))]
    m = df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        r = _pearson(*[F.col(f"c{i}_{j}") for j in range(3)])
        rows.append(F.struct(F.lit(c).alias("feature"), r.alias("corr")))
    out = m.select(F.explode(F.array(*rows)).alias("r")).select(
        "r.feature", r6("r.corr").alias("corr"), r6(F.abs("r.corr")).alias("abs_corr"))
    w = Window.orderBy(F.col("abs_corr").desc_nulls_last(), F.col("feature"))
    out = out.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= k) if k else out


# #84 - #87
def status_distribution(df: DataFrame, slice_cols, target: str = TARGET) -> DataFrame:
    """Count and percent of target 0 and 1 per slice, zero-filled: one
    aggregate per slice with both class counts, then two rows per slice."""
    slice_cols = list(slice_cols)
    y = col_of(target)
    per = df.groupBy(*[col_of(c).alias(c) for c in slice_cols]).agg(
        F.sum(F.when(y == 0, 1).otherwise(0)).cast("bigint").alias("_n0"),
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("bigint").alias("_n1"),
        F.count(F.lit(1)).alias("_total"))
    rows = per.select(*slice_cols, "_total", F.explode(F.array(
        F.struct(F.lit(0).alias("status"), F.col("_n0").alias("n")),
        F.struct(F.lit(1).alias("status"), F.col("_n1").alias("n")))).alias("_r"))
    return rows.select(*slice_cols, F.col("_r.status").alias("status"), F.col("_r.n").alias("n"),
                       r6(F.col("_r.n") * 100.0 / F.col("_total")).alias("pct"))


def slice_by_type_control(df: DataFrame) -> DataFrame:
    return status_distribution(df, ["diab_type", "diab_control"])


def slice_by_complication(df: DataFrame, per_type: bool = False) -> DataFrame:
    cols = (["diab_type"] if per_type else []) + ["diab_complication_categories"]
    return status_distribution(df, cols)


def slice_by_medication_change(df: DataFrame, group_col: str = "insulin") -> DataFrame:
    from .features import medication_group_changes
    return status_distribution(medication_group_changes(df), ["diab_type", group_col])


# #88
def univariate_odds_categorical(df: DataFrame, col: str, target: str = TARGET) -> DataFrame:
    """Logistic regression of the target on one categorical predictor, in
    closed form (saturated model): per level, log odds ratio against the first
    level in sorted order, SE = sqrt(1/a + 1/b + 1/c + 1/d), z, 95 % CI.
    A zero cell gives null statistics.  The intercept row is the reference
    level's log odds."""
    cnt = df.filter(col_of(col).isNotNull()).groupBy(col_of(col).cast("string").alias("level")).agg(
        F.sum((col_of(target) == 1).cast("bigint")).alias("pos"),
        F.sum((col_of(target) == 0).cast("bigint")).alias("neg"))
    # reference level = first in sorted order; a window over the (bounded)
    # level counts reads them once instead of re-joining them to themselves
    w = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    j = cnt.select("level", "pos", "neg", F.first("level").over(w).alias("ref_level"),
                   F.first("pos").over(w).alias("rp"), F.first("neg").over(w).alias("rn"))
    ok = (F.col("pos") > 0) & (F.col("neg") > 0) & (F.col("rp") > 0) & (F.col("rn") > 0)
    lo = F.log(F.col("pos") / F.col("neg"))
    rlo = F.log(F.col("rp") / F.col("rn"))
    is_ref = F.col("level") == F.col("ref_level")
    coef = F.when(ok, F.when(is_ref, rlo).otherwise(lo - rlo))
    se = F.when(ok, F.when(is_ref, F.sqrt(1 / F.col("rp") + 1 / F.col("rn")))
                .otherwise(F.sqrt(1 / F.col("pos") + 1 / F.col("neg") + 1 / F.col("rp") + 1 / F.col("rn"))))
    term = F.when(is_ref, F.lit("Intercept")).otherwise(F.concat(F.lit(f"{col}[T."), F.col("level"), F.lit("]")))
    out = j.select(F.lit(col).alias("feature"), term.alias("term"), coef.alias("coef"), se.alias("stderr"))
    return out.select("feature", "term", "coef", F.exp("coef").alias("odds_ratio"),
                      F.exp(F.col("coef") - 1.96 * F.col("stderr")).alias("or_ci_low"),
                      F.exp(F.col("coef") + 1.96 * F.col("stderr")).alias("or_ci_high"),
                      "stderr", (F.col("coef") / F.col("stderr")).alias("z"))


def with_z_pvalues(t: DataFrame) -> DataFrame:
    """Two-sided normal p-value from ``z`` as a column expression:
    erfc(|z| / sqrt 2) by the Chebyshev-fitted form with relative error
    below 1.2e-7 (Numerical Recipes ``erfcc``)."""
    z = F.abs(F.col("z"))
    tt = 1.0 / (1.0 + 0.5 * z / F.sqrt(F.lit(2.0)))
    x = z / F.sqrt(F.lit(2.0))
    poly = (-x * x - 1.26551223 + tt * (1.00002368 + tt * (0.37409196 + tt * (0.09678418 + tt * (
        -0.18628806 + tt * (0.27886807 + tt * (-1.13520398 + tt * (1.48851587 + tt * (
            -0.82215223 + tt * 0.17087277)))))))))
    p = tt * F.exp(poly)
    return t.withColumn("p_value", p).withColumn("flag", F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
                                                 .when(p.isNotNull(), "ns"))


# #89 / #90 (fitted GLMs) live in operators.models


# #91
def collapse_rare_levels(df: DataFrame, cols, min_share: float = 0.01, other: str = "Other") -> DataFrame:
    """Levels whose share of rows is under ``min_share`` become ``other``; nulls stay.

    One pass counts the levels of all columns.  At most 1 / min_share levels
    of a column have that share, so the kept ones are one short row that goes
    to every task: no join by level and no job per column.  Columns of
    other types become text."""
    cols = list(cols)
    if not cols or min_share <= 0:
        return df
    level = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), col_of(c).cast("string").alias("_lvl")) for i, c in enumerate(cols)]))
    counts = cut_lineage(df.select(level.alias("_x")).groupBy("_x._i", "_x._lvl").agg(F.count("*").alias("_n")), "level_counts")
    total = counts.where("_i = 0").agg(F.sum("_n").alias("_total"))                       # one row
    kept = (counts.crossJoin(F.broadcast(total)).where(F.col("_lvl").isNotNull() & (F.col("_n") / F.col("_total") >= min_share))
            .groupBy("_i").agg(F.collect_list("_lvl").alias("_levels"))
            .agg(F.map_from_entries(F.collect_list(F.struct("_i", "_levels"))).alias("_kept")))

    def shown(i, c):
        text = col_of(c).cast("string")
        common = F.coalesce(F.array_contains(F.col("_kept")[i], text), F.lit(False))
        return F.when(common | text.isNull(), text).otherwise(F.lit(other))

    return df.crossJoin(F.broadcast(kept)).withColumns({c: shown(i, c) for i, c in enumerate(cols)}).drop("_kept")
