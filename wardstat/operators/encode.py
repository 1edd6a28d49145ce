"""Encoding and feature selection (#106-#118).

Level lists (one-hot, label index) are distinct values of categorical
columns; joined back as the planner sees fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.columns import col_of, r6
from ..session import cut_lineage
from .ranges import running_sums
from .stats import target_correlation

# #106 - #108: level dictionary
def level_dictionary(df: DataFrame, cols) -> DataFrame:
    """``(column, level, index, levels)``: the distinct non-null levels of each
    column as text, their rank 0..n-1 in sorted order and the column's number
    of levels.  Ranks are running counts by ranges, for any number of levels."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col_of(c).cast("string").alias("level")) for c in cols])).alias("p")).select("p.*")
    pairs = cut_lineage(pairs.filter(F.col("level").isNotNull()).distinct().withColumn("n", F.lit(1)), "levels")
    ranked = running_sums(pairs, ["column"], "level", ["n"])
    return ranked.select("column", "level", (F.col("cum_n") - 1).cast("int").alias("index"), F.col("all_n").cast("int").alias("levels"))


def index_levels(df: DataFrame, cols, dictionary: DataFrame, suffix: str = "__idx") -> DataFrame:
    """``df`` with ``<col>__idx``: a level's index in the dictionary (null for a
    null or unknown one)."""
    for i, c in enumerate(cols):
        own = dictionary.filter(F.col("column") == c).select(F.col("level").alias(f"_l{i}"), F.col("index").alias(f"{c}{suffix}"))
        df = df.join(own, col_of(c).cast("string") == F.col(f"_l{i}"), "left").drop(f"_l{i}")
    return df


def dictionary_sizes(dictionary: DataFrame, cols) -> dict:
    """Number of levels of each column (one row a column to the driver)."""
    found = {r["column"]: r["levels"] for r in dictionary.groupBy("column").agg(F.max("levels").alias("levels")).collect()}
    return {c: found.get(c, 0) for c in cols}


def one_hot_active(df: DataFrame, cols, dictionary: DataFrame | None = None, out: str = "active") -> DataFrame:
    """``df`` with the places of the ones of its one-hot row: a sorted array, the
    columns' levels one after another; null and unknown levels have no place."""
    dictionary = cut_lineage(level_dictionary(df, cols), "dictionary") if dictionary is None else dictionary
    sizes, parts, at = dictionary_sizes(dictionary, cols), [], 0
    for c in cols:
        parts.append(F.col(f"`{c}__idx`") + F.lit(at))
        at += sizes[c]
    found = index_levels(df, cols, dictionary).withColumn(out, F.array_compact(F.array(*parts)))
    return found.drop(*[f"{c}__idx" for c in cols])


def vector_sizes(dictionary: DataFrame, cols, drop_first: bool = False) -> dict:
    """Width of each column's vector: its levels, less the first; 1 at least."""
    return {c: max(n - drop_first, 1) for c, n in dictionary_sizes(dictionary, cols).items()}


def one_hot_vectors(df: DataFrame, cols, dictionary: DataFrame | None = None, output_prefix: str = "oh_",
                    drop_first: bool = False) -> DataFrame:
    """``df`` with a sparse 0/1 vector ``oh_<col>`` for each column, as wide as
    the column's dictionary (less its first level with ``drop_first``); null
    and unknown levels give zeros.  The levels stay in the dictionary: the
    driver sees their numbers only."""
    from pyspark.ml.feature import OneHotEncoder
    dictionary = cut_lineage(level_dictionary(df, cols), "dictionary") if dictionary is None else dictionary
    sizes = vector_sizes(dictionary, cols, drop_first)
    found = index_levels(df, cols, dictionary)
    for c in cols:
        index = F.col(f"`{c}__idx`") - int(drop_first)
        place = F.when(index >= 0, index).otherwise(F.lit(sizes[c])).cast("double")
        found = found.withColumn(f"{c}__idx", place.alias(f"{c}__idx", metadata={
            "ml_attr": {"type": "nominal", "name": c, "num_vals": sizes[c] + 1}}))
    encoder = OneHotEncoder(inputCols=[f"{c}__idx" for c in cols], outputCols=[f"{output_prefix}{c}" for c in cols], dropLast=True)
    return encoder.fit(found).transform(found).drop(*[f"{c}__idx" for c in cols])


def encoded_places(numeric, dictionary: DataFrame, cols) -> DataFrame:
    """``(feature, position)`` of the columns of the encoded vector: numerics,
    then the levels of each column but the first."""
    sizes, at, start = vector_sizes(dictionary, cols, drop_first=True), len(list(numeric)), {}
    for c in cols:
        start[c] = at
        at += sizes[c]
    spark = dictionary.sparkSession
    plain = spark.createDataFrame([(c, i) for i, c in enumerate(numeric)], "feature string, position int")
    offset = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(start[c]))])
    hot = dictionary.filter((F.col("index") > 0) & F.col("column").isin(list(cols))).select(
        F.concat("column", F.lit("_"), "level").alias("feature"), (offset[F.col("column")] + F.col("index") - 1).alias("position"))
    return plain.unionByName(hot)


# #106
def one_hot(df: DataFrame, cols, drop_first: bool = True, keep_source: bool = False) -> DataFrame:
    """0/1 integer dummies ``<col>_<level>`` (first sorted level dropped when
    ``drop_first``); a null gives all zeros.  One column a level: the levels
    read from the dictionary are the result's schema.  Columns whose levels
    grow with the table belong into ``one_hot_vectors`` or ``one_hot_active``."""
    levels: dict = {c: [] for c in cols}
    for r in level_dictionary(df, cols).orderBy("column", "index").toLocalIterator():
        levels[r["column"]].append(r["level"])
    out = df.select("*", *[F.coalesce((col_of(c).cast("string") == F.lit(v)), F.lit(False)).cast("int").alias(f"{c}_{v}")
                           for c in cols for v in levels[c][1 if drop_first else 0:]])
    return out if keep_source else out.drop(*cols)


# #107
def one_hot_pipeline(cols, output_prefix: str = "oh_"):
    """Unfitted stages: keep unknown levels at transform time as all-zero
    vectors (``handleInvalid='keep'`` puts unknown at the last index and
    ``dropLast`` removes it)."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    idx = StringIndexer(inputCols=list(cols), outputCols=[f"{c}__idx" for c in cols],
                        handleInvalid="keep", stringOrderType="alphabetAsc")
    enc = OneHotEncoder(inputCols=[f"{c}__idx" for c in cols],
                        outputCols=[f"{output_prefix}{c}" for c in cols], dropLast=True)
    return [idx, enc]


# #108
def label_index(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Sorted code 0..n-1 per distinct value (null stays null), for any number
    of levels."""
    out = out or f"{col}_idx"
    lv = cut_lineage(df.select(col_of(col).alias("_v")).filter(F.col("_v").isNotNull()).distinct().withColumn("n", F.lit(1)), "levels")
    lv = running_sums(lv, [], "_v", ["n"]).select("_v", (F.col("cum_n") - 1).cast("int").alias(out))
    return df.join(lv, col_of(col).eqNullSafe(F.col("_v")), "left").drop("_v")


# #109
def standard_scale(df: DataFrame, cols, fit_on: DataFrame | None = None,
                   with_mean: bool = True) -> DataFrame:
    """(x - mean) / population std, statistics from ``fit_on`` (the train
    split); a zero std leaves the centred value unscaled (divide by 1)."""
    fit_on = fit_on if fit_on is not None else df
    st = fit_on.agg(*[F.avg(col_of(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(col_of(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)])
    j = df.crossJoin(F.broadcast(st))
    outs = {}
    for i, c in enumerate(cols):
        s = F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(F.lit(1.0))
        x = col_of(c).cast("double")
        outs[c] = ((x - F.col(f"m{i}")) if with_mean else x) / s
    return j.withColumns(outs).drop(*[f"m{i}" for i in range(len(cols))], *[f"s{i}" for i in range(len(cols))])


# #110
def frequency_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    out = out or f"{col}_freq"
    f = df.groupBy(col_of(col).alias("_v")).agg(F.count(F.lit(1)).alias(out))
    return df.join(f, col_of(col).eqNullSafe(F.col("_v")), "left").drop("_v")


# #111
def target_encode(df: DataFrame, col: str, fit_on: DataFrame | None = None,
                  target: str = codes.TARGET, out: str | None = None) -> DataFrame:
    """Level -> mean target on ``fit_on`` (train); unseen levels get the
    overall train mean."""
    out = out or f"{col}_te"
    fit_on = fit_on if fit_on is not None else df
    te = fit_on.groupBy(col_of(col).alias("_v")).agg(F.avg(col_of(target)).alias("_te"))
    prior = fit_on.agg(F.avg(col_of(target)).alias("_prior"))
    j = df.join(te, col_of(col).eqNullSafe(F.col("_v")), "left").crossJoin(F.broadcast(prior))
    return j.withColumn(out, F.coalesce("_te", "_prior")).drop("_v", "_te", "_prior")


# #112
def pairwise_interactions(df: DataFrame, cols) -> DataFrame:
    """All 2-way products ``a_x_b`` (no squares)."""
    cols = list(cols)
    return df.withColumns({f"{a}_x_{b}": col_of(a).cast("double") * col_of(b).cast("double")
                           for i, a in enumerate(cols) for b in cols[i + 1:]})


# #113
def select_by_correlation(df: DataFrame, cols, threshold: float = 0.01,
                          target: str = codes.TARGET) -> DataFrame:
    return target_correlation(df, cols, target).filter(F.col("abs_corr") > threshold)


# #114
def discretise(df: DataFrame, cols, bins: int = 10) -> DataFrame:
    """``(feature, bin, y)`` rows: value itself when a column has at most
    ``bins`` distinct values, else an equal-width bin index over [min, max]."""
    st = df.agg(*[F.min(col_of(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(cols)],
                *[F.max(col_of(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(cols)],
                *[F.count_distinct(col_of(c)).alias(f"nd{i}") for i, c in enumerate(cols)])
    j = df.crossJoin(F.broadcast(st))
    parts = []
    for i, c in enumerate(cols):
        x = col_of(c).cast("double")
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        eq = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))
        b = F.when(F.col(f"nd{i}") <= bins, x).when(hi == lo, F.lit(0.0)).otherwise(eq.cast("double"))
        parts.append(F.struct(F.lit(c).alias("feature"), b.alias("bin")))
    return j.select(F.explode(F.array(*parts)).alias("p"), col_of(codes.TARGET).alias("y")) \
        .select("p.feature", "p.bin", "y")


def mutual_information(df: DataFrame, cols, k: int | None = None, bins: int = 10,
                       target: str = codes.TARGET) -> DataFrame:
    """Plug-in mutual information (nats) between each discretised feature and
    the target, from one contingency aggregate; ranked, top ``k``."""
    d = discretise(df.withColumnRenamed(target, codes.TARGET) if target != codes.TARGET else df, cols, bins)
    d = d.filter(F.col("bin").isNotNull())
    joint = d.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("nxy"))
    def total(*keys):                                             # joint has a few rows a bin
        return F.sum("nxy").over(Window.partitionBy(*keys))
    j = joint.withColumns({"nx": total("feature", "bin"), "ny": total("feature", "y"), "n": total("feature")}).filter(F.col("y").isNotNull())
    term = (F.col("nxy") / F.col("n")) * F.log((F.col("nxy") * F.col("n")) / (F.col("nx") * F.col("ny")))
    mi = j.groupBy("feature").agg(F.sum(term).alias("mi"))
    w = Window.orderBy(F.col("mi").desc(), F.col("feature"))
    out = mi.select("feature", r6("mi").alias("mi"), F.row_number().over(w).alias("rank"))
    return out.filter(F.col("rank") <= k) if k else out


# #113 - #116 over one-hot columns
def encoded_scores(df: DataFrame, numeric, categorical, target: str = codes.TARGET, bins: int = 10) -> DataFrame:
    """``(ord, place, feature, corr, mi)`` of every column of the one-hot encoded
    table: the numerics, then ``<col>_<level>`` for each level of the text
    columns but the first in sorted order (``ord``, ``place``: the column and
    the level's rank).  Correlation and mutual information (nats) of a 0/1
    column come in closed form from the counts of its four cells, so the
    encoded table, however wide, is never made.  Rows of null level count as 0
    in all columns of it."""
    numeric, categorical, y = list(numeric), list(categorical), col_of(target)
    corr = target_correlation(df, numeric, target).select("feature", "corr")
    mi = mutual_information(df, numeric, bins=bins, target=target).select("feature", "mi")
    place = F.create_map(*[x for i, c in enumerate(numeric) for x in (F.lit(c), F.lit(i))])
    plain = corr.join(mi, "feature", "left").select(place[F.col("feature")].alias("ord"), F.lit(0).alias("place"), "feature", "corr", "mi")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), col_of(c).cast("string").alias("level"))
                                          for i, c in enumerate(categorical)])).alias("p"), y.alias("y")).groupBy("p.c", "p.level").agg(
        F.count("y").alias("n1"), F.sum((F.col("y") == 1).cast("bigint")).alias("n11"))
    cells = cut_lineage(cells, "cells").filter(F.col("level").isNotNull()).withColumn("n", F.lit(1))
    levels = running_sums(cells, ["c"], "level", ["n"]).filter(F.col("cum_n") > 1)
    whole = df.agg(F.count(y).alias("_rows"), F.sum((y == 1).cast("bigint")).alias("_positive"))
    j = levels.crossJoin(F.broadcast(whole))                                          # one row
    n1, n11, big, pos = (F.col(c).cast("double") for c in ("n1", "n11", "_rows", "_positive"))
    phi = F.try_divide(big * n11 - n1 * pos, F.sqrt(n1 * (big - n1) * pos * (big - pos)))
    def cell(k, row, column):
        return F.when(k > 0, k / big * F.log(k * big / (row * column))).otherwise(0.0)
    info = (cell(n11, n1, pos) + cell(n1 - n11, n1, big - pos) + cell(pos - n11, big - n1, pos) + cell(big - n1 - pos + n11, big - n1, big - pos))
    name = F.concat(F.element_at(F.array(*[F.lit(c) for c in categorical]), F.col("c") + 1), F.lit("_"), "level")
    hot = j.select((F.col("c") + len(numeric)).alias("ord"), (F.col("cum_n") - 1).cast("int").alias("place"), name.alias("feature"),
                   r6(phi).alias("corr"), r6(info).alias("mi"))
    return plain.unionByName(hot)


# #116
def consensus_vote(lists: dict, min_votes: int = 2, order: DataFrame | None = None) -> DataFrame:
    """``lists``: method name -> DataFrame with a ``feature`` column.  Votes
    per feature, kept at ``min_votes`` or more.  With ``order`` (``feature``
    and its ``ord``, ``place``: the column order), only its features count and
    ``rank`` sorts them by votes, then column order."""
    u = None
    for m, d in lists.items():
        part = d.select("feature").distinct().withColumn("method", F.lit(m))
        u = part if u is None else u.unionByName(part)
    v = u.groupBy("feature").agg(F.count(F.lit(1)).alias("votes"),
                                 F.concat_ws(",", F.array_sort(F.collect_list("method"))).alias("methods"))
    v = v.filter(F.col("votes") >= min_votes)
    if order is None:
        return v
    ranked = Window.orderBy(F.col("votes").desc(), "ord", "place", "feature")          # one row a feature
    return v.join(order.select("feature", "ord", "place"), "feature").select(
        "feature", "votes", "methods", F.row_number().over(ranked).alias("rank"))


# #118
def feature_summary(original: int, interaction: int, polynomial: int, binary: int,
                    after_encoding: int, selected: DataFrame) -> DataFrame:
    """Counts by feature family and reduction % (selected count is data)."""
    n_sel = F.count(F.lit(1))
    red = (F.lit(after_encoding) - n_sel) * 100.0 / F.lit(after_encoding) if after_encoding else F.lit(None)
    from .profile import metrics
    return metrics(selected, [("original_features", F.lit(original)),
                              ("interaction_features", F.lit(interaction)),
                              ("polynomial_features", F.lit(polynomial)),
                              ("binary_indicator_features", F.lit(binary)),
                              ("after_encoding", F.lit(after_encoding)),
                              ("after_selection", n_sel), ("reduction_percentage", red)])

