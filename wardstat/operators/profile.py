"""Profiling and aggregation (#55-#75).

Wide profiles are computed in one aggregate pass and then unpivoted to long
form, so the number of passes does not grow with the number of columns.
Per-value work (distinct counts, top codes) unpivots to ``(column, value)``
and runs as one grouped aggregate with a partial stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.columns import col_of, r6
from .clean import numeric_columns, string_columns
from .ranges import quantile_row


def _pairs(df: DataFrame, cols, value_cast: str = "string") -> DataFrame:
    """Unpivot ``cols`` to ``(column, value)`` rows (nulls kept)."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col_of(c).cast(value_cast).alias("value"))
        for c in cols])).alias("p")).select("p.column", "p.value")


def metrics(df: DataFrame, items) -> DataFrame:
    """``(ord, metric, value)`` rows from (name, Column) aggregate items."""
    agg = df.agg(*[e.cast("double").alias(f"m{i}") for i, (_, e) in enumerate(items)])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(n).alias("metric"), r6(F.col(f"m{i}")).alias("value"))
        for i, (n, _) in enumerate(items)])).alias("m")).select("m.*")


# #55
def table_shape(df: DataFrame) -> DataFrame:
    nums, strs = numeric_columns(df), string_columns(df)
    return metrics(df, [("rows", F.count(F.lit(1))), ("columns", F.lit(len(df.columns))),
                        ("numeric_columns", F.lit(len(nums))), ("string_columns", F.lit(len(strs)))])


def head_rows(df: DataFrame, key: str = "encounter_id", n: int = 5) -> DataFrame:
    """First ``n`` rows by key (TakeOrderedAndProject: a top-k, no full sort)."""
    return df.orderBy(col_of(key)).limit(n)


# #56 / #70
def describe_numeric(df: DataFrame, cols=None, exclude=codes.ID_COLUMNS) -> DataFrame:
    """count, mean, std (n-1), min, q25, q50, q75, max per numeric column, exact
    linear-interpolated quantiles (by counted ranges); long form, one aggregate
    pass beside them."""
    cols = cols or [c for c in numeric_columns(df) if c not in exclude]
    aggs = []
    for i, c in enumerate(cols):
        x = col_of(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    quartiles = quantile_row(df, {f"q{i}_{k}": (c, k / 4) for i, c in enumerate(cols) for k in (1, 2, 3)})
    m = df.agg(*aggs).crossJoin(F.broadcast(quartiles))                 # one row each
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"),
                     F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                     F.col(f"lo{i}").alias("min"), F.col(f"q{i}_1").alias("q25"),
                     F.col(f"q{i}_2").alias("q50"), F.col(f"q{i}_3").alias("q75"),
                     F.col(f"hi{i}").alias("max")) for i, c in enumerate(cols)]
    out = m.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.select("column", "count", *[r6(c).alias(c) for c in
                                           ["mean", "std", "min", "q25", "q50", "q75", "max"]])


def _moments(df: DataFrame, cols) -> DataFrame:
    """One row: count, mean, std, min, max and skewness of each column."""
    aggs = []
    for i, c in enumerate(cols):
        x = col_of(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.skewness(x).alias(f"g{i}")]
    return df.agg(*aggs)


def _skew(i: int):
    """Bias-corrected skewness."""
    n = F.col(f"n{i}").cast("double")
    return F.when(n > 2, F.col(f"g{i}") * F.sqrt(n * (n - 1)) / (n - 2))


def numeric_profile(df: DataFrame, cols) -> DataFrame:
    """mean, median, std, min, max and bias-corrected skewness per column."""
    m = _moments(df, cols).crossJoin(F.broadcast(quantile_row(df, {f"md{i}": (c, 0.5) for i, c in enumerate(cols)})))   # one row each
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"), F.col(f"a{i}").alias("mean"),
                     F.col(f"md{i}").alias("median"), F.col(f"s{i}").alias("std"),
                     F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), _skew(i).alias("skew")) for i, c in enumerate(cols)]
    out = m.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.select("ord", "column", *[r6(c).alias(c) for c in ["mean", "median", "std", "min", "max", "skew"]])


# #71
def skewed_columns(df: DataFrame, cols, limit: float = 1.0) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"), r6(_skew(i)).alias("skew")) for i, c in enumerate(cols)]
    return _moments(df, cols).select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter(F.abs("skew") > limit)


# #57
def distinct_counts(df: DataFrame, cols=None, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column: one shuffle over (column, value)
    pairs that were de-duplicated map-side.  ``approximate`` switches to
    HyperLogLog++ for very high-cardinality columns."""
    cols = cols or string_columns(df)
    p = _pairs(df, cols).filter(F.col("value").isNotNull())
    if approximate:
        return p.groupBy("column").agg(F.approx_count_distinct("value").alias("n_distinct"))
    return p.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


# #58
def distinct_values(df: DataFrame, cols=None, max_values: int = 10) -> DataFrame:
    """Sorted value list of columns with at most ``max_values`` distinct values.
    Values are only collected after the count passed the bound."""
    cols = cols or string_columns(df)
    p = _pairs(df, cols).filter(F.col("value").isNotNull()).distinct()
    small = p.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct")) \
        .filter(F.col("n_distinct") <= max_values)
    kept = p.join(F.broadcast(small), "column")  # one row per column: bounded
    return kept.groupBy("column", "n_distinct").agg(
        F.concat_ws(", ", F.array_sort(F.collect_list("value"))).alias("values"))


# #59
def value_counts_pct(df: DataFrame, col: str) -> DataFrame:
    """Count and percentage per non-null level, with the rank by count."""
    c = df.filter(col_of(col).isNotNull()).groupBy(col_of(col).alias("level")) \
        .agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    w = Window.orderBy(F.col("n").desc(), F.col("level"))
    return c.select("level", "n", r6(F.col("n") * 100.0 / total).alias("pct"),
                    F.row_number().over(w).alias("rank"))


# #60
def imbalance_ratio(df: DataFrame, target: str = codes.TARGET) -> DataFrame:
    y = col_of(target)
    pos = F.sum((y == 1).cast("bigint"))
    neg = F.sum((y == 0).cast("bigint"))
    n = F.count(F.lit(1))
    return metrics(df, [("n_0", neg), ("n_1", pos), ("share_0", neg / n), ("share_1", pos / n),
                        ("ratio_0_to_1", F.try_divide(neg, pos))])


# #61
def missing_profile(df: DataFrame) -> DataFrame:
    """Null count and share for columns with any null, most missing first."""
    n = F.count(F.lit(1))
    agg = df.agg(n.alias("__n"), *[F.sum(col_of(c).isNull().cast("bigint")).alias(c) for c in df.columns])
    long = agg.select("__n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_missing")) for c in df.columns]))
        .alias("m")).select("__n", "m.*")
    return long.filter(F.col("n_missing") > 0).select(
        "column", "n_missing", r6(F.col("n_missing") * 100.0 / F.col("__n")).alias("pct"))


# #62
def marker_profile(df: DataFrame, marker: str = codes.MARKER) -> DataFrame:
    cols = string_columns(df)
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.sum((col_of(c) == marker).cast("bigint")).alias(c) for c in cols])
    long = agg.select("__n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("n_marker"))
        for c in cols])).alias("m")).select("__n", "m.*")
    return long.filter(F.col("n_marker") > 0).select(
        "column", "n_marker", r6(F.col("n_marker") * 100.0 / F.col("__n")).alias("pct"))


# #63 / #72
def top_codes(df: DataFrame, cols=("diag_1", "diag_2", "diag_3"), k: int = 10) -> DataFrame:
    """Most frequent non-null values per column (ties by value); the window
    runs over distinct values per column only."""
    counts = _pairs(df, cols).filter(F.col("value").isNotNull()) \
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_categories(df: DataFrame, cols, k: int = 3) -> DataFrame:
    """Distinct count, and the top ``k`` values with their percentage."""
    counts = _pairs(df, cols).filter(F.col("value").isNotNull()) \
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    per = Window.partitionBy("column")
    w = per.orderBy(F.col("n").desc(), F.col("value"))
    total = F.count(F.lit(1)).over(Window.partitionBy())  # rows of df via the sum below
    ranked = counts.select("column", "value", "n", F.row_number().over(w).alias("rank"),
                           F.count(F.lit(1)).over(per).alias("n_distinct"))
    n_rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    del total
    return ranked.filter(F.col("rank") <= k).crossJoin(F.broadcast(n_rows)).select(
        "column", "n_distinct", "rank", "value", "n", r6(F.col("n") * 100.0 / F.col("_rows")).alias("pct"))


# #64 / #65 / #66
def entity_summary(df: DataFrame, key: str = "patient_nbr", id_col: str = "encounter_id") -> DataFrame:
    per = df.groupBy(key).agg(F.count(col_of(id_col)).alias("k"))
    return metrics(per, [("encounters", F.sum("k")), ("patients", F.count(F.lit(1))),
                         ("repeat_encounters", F.sum("k") - F.count(F.lit(1))),
                         ("mean_per_patient", F.avg("k")),
                         ("patients_with_repeats", F.sum((F.col("k") > 1).cast("bigint"))),
                         ("max_per_patient", F.max("k"))])


def encounters_per_entity_distribution(df: DataFrame, key: str = "patient_nbr") -> DataFrame:
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_encounters"))
    return per.groupBy("n_encounters").agg(F.count(F.lit(1)).alias("n_patients"))


def ever_positive_rate(df: DataFrame, key: str = "patient_nbr", target: str = codes.TARGET) -> DataFrame:
    per = df.groupBy(key).agg(F.max(col_of(target)).alias("m"))
    return per.agg(r6(F.avg("m")).alias("ever_positive_rate"), F.count(F.lit(1)).alias("patients"))


# #67
def frequency_table(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col_of(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


# #68
def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between min and max (last bin closed), every bin
    listed; the median is attached for the reference line."""
    x = col_of(col).cast("double")
    stats = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).crossJoin(
        F.broadcast(quantile_row(df, {"median": (col, 0.5)})))                # one row each
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    idx = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    counts = (df.select(x.alias("_x")).filter(F.col("_x").isNotNull()).crossJoin(F.broadcast(stats))
              .select(idx.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    grid = stats.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi", "median")
    return grid.join(counts, "bin", "left").select(
        "bin", r6(F.col("lo") + F.col("bin") * width).alias("bin_lo"),
        r6(F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).alias("n"), r6("median").alias("median"))


# #69
def box_stats(df: DataFrame, col: str) -> DataFrame:
    """Quartiles, 1.5 IQR fences, whisker ends inside the fences, outliers."""
    x = col_of(col).cast("double")
    q = quantile_row(df, {"q1": (col, 0.25), "median": (col, 0.5), "q3": (col, 0.75)})
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
        .withColumn("lo_fence", F.col("q1") - 1.5 * F.col("iqr")) \
        .withColumn("hi_fence", F.col("q3") + 1.5 * F.col("iqr"))
    j = df.select(x.alias("_x")).filter(F.col("_x").isNotNull()).crossJoin(F.broadcast(q))
    inside = (F.col("_x") >= F.col("lo_fence")) & (F.col("_x") <= F.col("hi_fence"))
    return j.groupBy("q1", "median", "q3", "iqr", "lo_fence", "hi_fence").agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_hi"),
        F.sum((~inside).cast("bigint")).alias("n_outliers")).select(
        *[r6(c).alias(c) for c in ["q1", "median", "q3", "iqr", "lo_fence", "hi_fence",
                                    "whisker_lo", "whisker_hi"]], "n_outliers")


# #73
def dataset_summary(raw_loaded: DataFrame, target_text: str = codes.TARGET_TEXT) -> DataFrame:
    """Overview of the raw table: records, features (with the target flag
    column), numeric / text features, missing cells on load, repeat
    encounters and the positive share in percent."""
    n_num = len(numeric_columns(raw_loaded)) + 1  # + the 0/1 target added before profiling
    n_str = len(string_columns(raw_loaded))
    missing = None
    for c in raw_loaded.columns:
        e = F.sum(col_of(c).isNull().cast("bigint"))
        missing = e if missing is None else missing + e
    return metrics(raw_loaded, [
        ("total_records", F.count(F.lit(1))), ("total_features", F.lit(n_num + n_str)),
        ("numerical_features", F.lit(n_num)), ("categorical_features", F.lit(n_str)),
        ("missing_values", missing),
        ("duplicate_patients", F.count(F.lit(1)) - F.count_distinct("patient_nbr")),
        ("readmission_lt30_pct", F.avg((col_of(target_text) == codes.POSITIVE_TEXT).cast("double")) * 100)])


# #74
def eda_summary(df: DataFrame, target: str = codes.TARGET) -> DataFrame:
    nums = [c for c in numeric_columns(df) if c != target]
    strs = string_columns(df)
    y = col_of(target)
    return metrics(df, [("total_patients", F.count(F.lit(1))), ("numerical_features", F.lit(len(nums))),
                        ("categorical_features", F.lit(len(strs))),
                        ("target_class_0", F.sum((y == 0).cast("bigint"))),
                        ("target_class_1", F.sum((y == 1).cast("bigint"))),
                        ("imbalance_ratio", F.try_divide(F.sum((y == 0).cast("double")),
                                                         F.sum((y == 1).cast("double"))))])


# #75
def key_insights(df: DataFrame, numeric_cols, target: str = codes.TARGET) -> DataFrame:
    """Five text lines assembled from small results: class ratio, top 3
    features by |corr| with the target, skewed features, riskiest age band and
    riskiest primary diagnosis group."""
    from .stats import riskiest_level, target_correlation
    y = col_of(target)
    ratio = df.agg(F.format_number(F.try_divide(F.sum((y == 0).cast("double")),
                                                F.sum((y == 1).cast("double"))), 1).alias("r"))
    l1 = ratio.select(F.lit(1).alias("n"), F.concat(F.lit("1. Class imbalance ratio: 1:"), F.col("r"),
                                                     F.lit(" - SMOTE recommended")).alias("insight"))
    corr = target_correlation(df, numeric_cols, target).filter(F.col("rank") <= 3)
    l2 = corr.agg(F.concat(F.lit("2. Top 3 predictive features: "), F.concat_ws(
        ", ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda s: s["feature"])))
        .alias("insight")).select(F.lit(2).alias("n"), "insight")
    sk = skewed_columns(df, numeric_cols)
    sk = sk.withColumn("_r", F.row_number().over(Window.orderBy("ord"))).filter(F.col("_r") <= 3)
    l3 = sk.agg(F.array_sort(F.collect_list(F.struct("ord", "column"))).alias("_sk")) \
        .filter(F.size("_sk") > 0).select(  # the line is left out when nothing is skewed
            F.lit(3).alias("n"), F.concat(F.lit("3. Skewed features requiring transformation: "),
                                          F.concat_ws(", ", F.transform("_sk", lambda s: s["column"])))
            .alias("insight"))
    l4 = riskiest_level(df, "age", target).select(
        F.lit(4).alias("n"), F.concat(F.lit("4. Highest readmission risk age group: "), "level").alias("insight"))
    l5 = riskiest_level(df, "diag_1_category", target).select(
        F.lit(5).alias("n"), F.concat(F.lit("5. Highest readmission risk diagnosis: "), "level").alias("insight"))
    return l1.unionByName(l2).unionByName(l3).unionByName(l4).unionByName(l5)
