"""Order statistics by counted ranges: running sums and exact quantiles of any
number of distinct values, without a task or a map that holds them all.

A table with a row a distinct value is cut into ranges of about
``ROWS_PER_RANGE`` rows at bounds that Spark samples from it, so the ranges are
even whatever the values' distribution.  Totals of the ranges (a short table)
give each range its offset; running sums are then taken inside ranges, and a
position is looked for in its own range only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col_of
from ..session import cut_lineage

ROWS_PER_RANGE = 50_000


def with_ranges(distinct: DataFrame, by) -> DataFrame:
    """``distinct`` (a written table) with ``_range``: numbers that ascend with
    the columns ``by``."""
    n = math.ceil(distinct.count() / ROWS_PER_RANGE)
    if n <= 1:
        return distinct.withColumn("_range", F.lit(0))
    cut = distinct.repartitionByRange(n, *[col_of(c) for c in by]).withColumn("_range", F.spark_partition_id())
    return cut_lineage(cut, "ranges")


def _same(keys, names) -> Column:
    on = F.lit(True)
    for k, n in zip(keys, names):
        on = on & col_of(k).eqNullSafe(F.col(n))
    return on


def range_offsets(ranged: DataFrame, groups, sums, descending: bool = False) -> DataFrame:
    """A row per group and range: ``_r``, the groups as ``_g0, _g1, ..``, and for each
    column of ``sums`` what the ranges before it add up to (``_before_x``), its
    own sum (``_in_x``) and the group's (``_all_x``)."""
    names = [f"_g{i}" for i in range(len(groups))]
    totals = ranged.groupBy(*[col_of(g).alias(n) for g, n in zip(groups, names)], F.col("_range").alias("_r")).agg(
        *[F.sum(c).alias(f"_in_{c}") for c in sums])
    whole = Window.partitionBy(*names)
    before = whole.orderBy(F.col("_r").desc() if descending else F.col("_r")).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("*", *[F.coalesce(F.sum(f"_in_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
                         *[F.sum(f"_in_{c}").over(whole).alias(f"_all_{c}") for c in sums])


def running_sums(distinct: DataFrame, groups, order: str, sums, descending: bool = False) -> DataFrame:
    """The rows with inclusive running sums ``cum_x`` in the order of ``order``
    within ``groups``, and the groups' totals ``all_x``."""
    groups = list(groups)
    ranged = with_ranges(distinct, [*groups, order])
    offsets = range_offsets(ranged, groups, sums, descending)
    names = [f"_g{i}" for i in range(len(groups))]
    joined = ranged.join(offsets, (F.col("_range") == F.col("_r")) & _same(groups, names))
    inside = (Window.partitionBy("_range", *names).orderBy(col_of(order).desc() if descending else col_of(order))
              .rowsBetween(Window.unboundedPreceding, 0))
    return joined.select(*[col_of(c) for c in distinct.columns],
                         *[(F.col(f"_before_{c}") + F.sum(c).over(inside)).cast("bigint").alias(f"cum_{c}") for c in sums],
                         *[F.col(f"_all_{c}").cast("bigint").alias(f"all_{c}") for c in sums])


def exact_quantiles(df: DataFrame, cols, probabilities) -> DataFrame:
    """``(column, probability, value)``: exact quantiles with linear
    interpolation between neighbouring values of the non-null values of each
    column; a column without any has no rows."""
    cols, probabilities = list(cols), [float(p) for p in probabilities]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("_c"), col_of(c).cast("double").alias("_x")) for i, c in enumerate(cols)])).alias("p")).select("p.*")
    counts = cut_lineage(long.filter(F.col("_x").isNotNull()).groupBy("_c", "_x").agg(F.count(F.lit(1)).alias("n")), "value_counts")
    ranged = with_ranges(counts, ["_c", "_x"])
    ranges = range_offsets(ranged, ["_c"], ["n"])
    # positions looked for: at most two a column and probability
    asked = ranges.select("_g0", "_r", "_before_n", "_in_n", F.explode(F.array(*[F.lit(p) for p in probabilities])).alias("probability"),
                          (F.col("_all_n") - 1).alias("_last"))
    at = F.col("probability") * F.col("_last")
    asked = asked.select("*", at.alias("_at"), F.explode(F.array(F.floor(at), F.ceil(at))).alias("_place")).distinct()
    asked = asked.filter((F.col("_place") >= F.col("_before_n")) & (F.col("_place") < F.col("_before_n") + F.col("_in_n")))
    near = ranged.join(F.broadcast(asked.select(F.col("_g0").alias("_a"), F.col("_r").alias("_b")).distinct()),
                       (F.col("_c") == F.col("_a")) & (F.col("_range") == F.col("_b")), "left_semi")
    inside = Window.partitionBy("_c", "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_till", F.sum("n").over(inside))
    here = F.col("_place") - F.col("_before_n")
    found = near.join(F.broadcast(asked), (F.col("_c") == F.col("_g0")) & (F.col("_range") == F.col("_r"))
                      & (here < F.col("_till")) & (here >= F.col("_till") - F.col("n")))
    ends = found.groupBy("_c", "probability", "_at").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    share = F.col("_at") - F.floor("_at")
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((1 - share) * F.col("lo") + share * F.col("hi"))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_c") + 1)
    return ends.select(name.alias("column"), "probability", value.alias("value"))


def quantile_row(df: DataFrame, names: dict) -> DataFrame:
    """One row with the quantiles ``names``: result column -> (column,
    probability); null where the column has no value."""
    cols = sorted({c for c, _ in names.values()})
    q = exact_quantiles(df, cols, sorted({p for _, p in names.values()}))
    return q.agg(*[F.max(F.when((F.col("column") == c) & (F.col("probability") == float(p)), F.col("value"))).alias(n)
                   for n, (c, p) in names.items()])
