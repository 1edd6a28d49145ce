"""Splitting, sampling and class balancing (#119-#123, #127-#129).

Random draws are md5 hashes of the key, so every engine and every re-run
makes the same choice.  Exact per-class ranks in hash order come from
``hash_rank``: md5 is uniform, so equal-width hash buckets hold equal shares
of every class; a small window over (class, bucket) counts gives each
bucket's offset and the row number runs inside (class, bucket) only.  No
task ever holds a whole class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.columns import col_of, r6
from ..session import cut_lineage

BUCKETS_PER_PARTITION = 4


def md5_text(key) -> Column:
    return F.md5(col_of(key).cast("string"))


def md5_number(key) -> Column:
    """First 60 bits of md5(key) as a non-negative bigint."""
    return F.conv(F.substring(md5_text(key), 1, 15), 16, 10).cast("bigint")


def hash_rank(df: DataFrame, group_cols, key: str, rank_col: str = "_rank",
              keep_total: bool = False, total_col: str = "_n") -> DataFrame:
    """Exact 1-based rank of each row within ``group_cols`` ordered by
    md5(key); with ``keep_total`` also the group's row count."""
    group_cols = list(group_cols)
    # any bucket count gives the exact rank; size it from the configured
    # shuffle parallelism (no job), which is tuned to the data volume
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    nb = max(1, parts * BUCKETS_PER_PARTITION)
    h = md5_text(key)
    b = (F.conv(F.substring(h, 1, 6), 16, 10).cast("bigint") * nb / (1 << 24)).cast("int")
    # the rows are read twice (bucket counts, then the ranking): write once
    d = cut_lineage(df.withColumn("_h", h).withColumn("_b", b), "hash_rank_input")
    cnt = d.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    wo = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(*group_cols)
    off = cnt.select(*[col_of(c).alias(f"_g{i}") for i, c in enumerate(group_cols)], F.col("_b").alias("_ob"),
                     F.coalesce(F.sum("_bn").over(wo), F.lit(0)).alias("_off"), F.sum("_bn").over(wt).alias(total_col))
    wi = Window.partitionBy(*group_cols, "_b").orderBy("_h", col_of(key))
    same = F.col("_b") == F.col("_ob")
    for i, c in enumerate(group_cols):         # a null group is a group
        same = same & col_of(c).eqNullSafe(F.col(f"_g{i}"))
    j = d.join(off, same).drop("_ob", *[f"_g{i}" for i in range(len(group_cols))])
    out = j.withColumn(rank_col, F.col("_off") + F.row_number().over(wi)).drop("_h", "_b", "_off")
    return out if keep_total else out.drop(total_col)


def minority_majority(df: DataFrame, label: str, minority) -> tuple[int, int]:
    """(minority rows, other rows) in one aggregate."""
    is_min = F.coalesce(col_of(label) == minority, F.lit(False))
    r = df.agg(F.sum(is_min.cast("bigint")).alias("a"), F.sum((~is_min).cast("bigint")).alias("b")).first()
    return int(r["a"] or 0), int(r["b"] or 0)


def class_counts(df: DataFrame, label: str = codes.TARGET) -> DataFrame:
    return df.groupBy(col_of(label).alias("_cls")).agg(F.count(F.lit(1)).alias("_n"))


# #119
def stratified_split(df: DataFrame, test_frac: float = 0.2, label: str = codes.TARGET,
                     key: str = "encounter_id") -> DataFrame:
    """Adds ``split`` ('train' / 'test'): per class, the ``round(frac * n_c)``
    rows first in md5 order go to test, so class shares are kept."""
    r = hash_rank(df, [label], key, keep_total=True)
    k = F.round(F.col("_n") * F.lit(test_frac)).cast("bigint")
    return r.withColumn("split", F.when(F.col("_rank") <= k, "test").otherwise("train")) \
        .drop("_rank", "_n")


# #120
def stratified_sample(df: DataFrame, n: int, label: str = codes.TARGET,
                      key: str = "encounter_id") -> DataFrame:
    """``int(n * share_c)`` rows per class, only when the table has more
    than ``n`` rows (else returned whole)."""
    total = df.count()
    if total <= n:
        return df
    r = hash_rank(df, [label], key, keep_total=True)
    k = F.floor(F.lit(n) * F.col("_n") / F.lit(total))
    return r.filter(F.col("_rank") <= k).drop("_rank", "_n")


# #121
def undersample(df: DataFrame, ratio: float = 1.0, label: str = codes.TARGET,
                key: str = "encounter_id", minority: int = 1) -> DataFrame:
    """Keep every minority row and, of each other class (a null label is one),
    the first ``ratio * n_minority`` rows in md5 order."""
    is_min = col_of(label).eqNullSafe(F.lit(minority))
    n_min = df.filter(is_min).count()
    r = hash_rank(df.filter(~is_min), [label], key)
    kept = r.filter(F.col("_rank") <= int(ratio * n_min)).drop("_rank")
    return kept.unionByName(df.filter(is_min))


# #122
def oversample_random(df: DataFrame, label: str = codes.TARGET, key: str = "encounter_id",
                      minority: int = 1, seed: int = 42) -> DataFrame:
    """Add draws with replacement from the minority class until parity: draw
    ``i`` picks the minority row of rank ``md5(seed:i) mod n_min + 1``.  The
    draws are generated distributed (``range``) and joined on rank, so the
    copies never pass through one task."""
    mino = df.filter(col_of(label) == minority)
    n_min, n_maj = minority_majority(df, label, minority)
    need = n_maj - n_min
    if need <= 0 or n_min == 0:
        return df.withColumn("draw", F.lit(None).cast("bigint"))
    ranked = hash_rank(mino, [label], key)
    spark = df.sparkSession
    draws = spark.range(need).select(
        F.col("id").alias("draw"),
        (F.pmod(md5_number(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), F.lit(n_min)) + 1)
        .alias("_rank"))
    extra = draws.join(ranked, "_rank").drop("_rank")
    return df.withColumn("draw", F.lit(None).cast("bigint")).unionByName(extra)


# #123
def oversample_tile(df: DataFrame, label: str = codes.TARGET, minority: int = 1,
                    factor: int | None = None) -> DataFrame:
    """Majority rows plus the minority class repeated ``factor`` times
    (default ``(n_majority // n_minority) // 2``)."""
    if factor is None:
        cc = {r["_cls"]: r["_n"] for r in class_counts(df, label).collect()}  # two rows
        n_min = cc.get(minority, 0)
        n_maj = sum(v for k, v in cc.items() if k != minority)
        factor = (n_maj // n_min) // 2 if n_min else 0
    mino = df.filter(col_of(label) == minority).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.lit(max(factor, 0)))))
    if factor <= 0:
        mino = mino.limit(0)
    return df.filter(~col_of(label).eqNullSafe(F.lit(minority))).withColumn("copy", F.lit(0)).unionByName(mino)


# #127
def class_weights(df: DataFrame, label: str = codes.TARGET, normalise: bool = False) -> DataFrame:
    """``n / (classes * n_c)`` per class; ``normalise`` scales the weights so
    that they average 1."""
    cc = class_counts(df, label)
    tot = F.sum("_n").over(Window.partitionBy())
    k = F.count(F.lit(1)).over(Window.partitionBy())
    w = tot / (k * F.col("_n"))
    out = cc.select(F.col("_cls").alias("class"), F.col("_n").alias("n"), w.alias("weight"))
    if normalise:
        out = out.withColumn("weight", F.col("weight") / F.avg("weight").over(Window.partitionBy()))
    return out.select("class", "n", "weight")


def with_weights(df: DataFrame, label: str = codes.TARGET, weight_col: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(F.col("class").alias("_cls"), F.col("weight").alias(weight_col))
    return df.join(w, col_of(label).eqNullSafe(F.col("_cls"))).drop("_cls")


# #128
def class_balance(df: DataFrame, label: str = codes.TARGET) -> DataFrame:
    cc = class_counts(df, label)
    return cc.select(F.col("_cls").alias("class"), F.col("_n").alias("n"),
                     r6(F.col("_n") * 100.0 / F.sum("_n").over(Window.partitionBy())).alias("pct"))


# #129
def stratified_folds(df: DataFrame, k: int = 5, label: str = codes.TARGET,
                     key: str = "encounter_id") -> DataFrame:
    """``fold`` = (rank within class in md5 order - 1) mod k."""
    r = hash_rank(df, [label], key)
    return r.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")
