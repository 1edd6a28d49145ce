"""Projections, filters and table-level cleaning (#10-#20, #28-#29, #48-#54).

Data-dependent schema decisions (which columns are sparse, which values
impute) are taken from one-row aggregates; the driver never sees row data.
"""

from __future__ import annotations

import unicodedata
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes
from ..functions.columns import col_of, null_if_tokens
from .ranges import quantile_row

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


# #10
def select_by_type(df: DataFrame, kind: str = "numeric") -> DataFrame:
    names = numeric_columns(df) if kind == "numeric" else string_columns(df)
    return df.select(*[col_of(c) for c in names])


# #11
def drop_columns(df: DataFrame, names, missing: str = "ignore") -> DataFrame:
    absent = [n for n in names if n not in df.columns]
    if absent and missing != "ignore":
        raise ValueError(f"columns not found: {absent}")
    return df.drop(*[n for n in names if n in df.columns])


# #12
def keep_listed(df: DataFrame, names) -> tuple[DataFrame, list[str]]:
    """Keep the wish-list columns that exist (in wish-list order); also return
    the names that were not found."""
    keep = [n for n in names if n in df.columns]
    return df.select(*[col_of(c) for c in keep]), [n for n in names if n not in df.columns]


# #13
def safe_name(name: str) -> str:
    s = "".join(ch for ch in str(name) if ch.isprintable())
    s = unicodedata.normalize("NFKC", s).strip()
    return re.sub(r"[^0-9a-zA-Z_]", "_", s)


def safe_names(df: DataFrame) -> tuple[DataFrame, dict]:
    """Rename columns to safe identifiers; return the reverse map new -> old."""
    new = [safe_name(c) for c in df.columns]
    return df.toDF(*new), dict(zip(new, df.columns))


# #14 / #15
def exclude_codes(df: DataFrame, col: str, values) -> DataFrame:
    """Drop rows whose value is listed; null rows are kept (pandas meaning)."""
    return df.filter(~F.coalesce(col_of(col).isin(list(values)), F.lit(False)))


def exclude_levels(df: DataFrame, col: str = "age", levels=codes.EXCLUDED_AGE_BANDS) -> DataFrame:
    return exclude_codes(df, col, levels)


# #16
def range_trim(df: DataFrame, bounds=codes.RANGE_TRIM) -> DataFrame:
    cond = F.lit(True)
    for c, (lo, hi) in bounds.items():
        if lo is not None:
            cond = cond & (col_of(c) >= lo)
        if hi is not None:
            cond = cond & (col_of(c) <= hi)
    return df.filter(cond)


# #17 / #26
def entity_count_filter(df: DataFrame, key: str = "patient_nbr", id_col: str = "encounter_id",
                        max_count: int = codes.MAX_ENCOUNTERS_PER_PATIENT) -> DataFrame:
    """Rows of entities with at most ``max_count`` distinct ids (inclusive).

    The per-entity count is a partial aggregate; the semi join keeps the big
    side's rows without duplicating them (AQE splits a hot key)."""
    kept = (df.groupBy(key).agg(F.countDistinct(id_col).alias("_n"))
            .filter(F.col("_n") <= max_count).select(key))
    return semi_join_ids(df, kept, key)


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_semi")


# #18
def drop_null_rows(df: DataFrame, subset=None) -> DataFrame:
    return df.dropna(subset=subset)


# #19
def subset_slice(df: DataFrame, predicates: dict) -> DataFrame:
    cond = F.lit(True)
    for c, v in predicates.items():
        cond = cond & (col_of(c) == F.lit(v))
    return df.filter(cond)


# #20
def numeric_matrix(df: DataFrame, exclude=()) -> DataFrame:
    return df.select(*[col_of(c) for c in numeric_columns(df) if c not in exclude])


# #28
def null_if_marker(df: DataFrame, marker: str = codes.MARKER, cols=None) -> DataFrame:
    cols = set(cols or string_columns(df))
    return df.select(*[null_if_tokens(c, [marker]).alias(c) if c in cols else col_of(c)
                       for c in df.columns])


def marker_count(df: DataFrame, marker: str = codes.MARKER) -> DataFrame:
    """One row: number of cells equal to ``marker`` over all string columns."""
    parts = [F.sum(F.when(col_of(c) == marker, 1).otherwise(0)) for c in string_columns(df)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.agg(total.cast("bigint").alias("markers_converted"))


# #29
def fill_marker(df: DataFrame, col: str = "A1Cresult", value: str = "NoTest") -> DataFrame:
    return df.withColumn(col, F.coalesce(col_of(col), F.lit(value)))


# #48
def constant_columns(df: DataFrame) -> DataFrame:
    """``(column, n_distinct)`` for columns holding a single non-null value
    (1) or none (0): the smallest equals the largest, so one aggregate with a
    partial stage and no distinct set does."""
    agg = df.agg(*[F.when(F.min(col_of(c)).isNull(), 0).when(F.min(col_of(c)) == F.max(col_of(c)), 1).otherwise(2).alias(c)
                   for c in df.columns])
    stacked = unpivot_one_row(agg, df.columns, "column", "n_distinct", "bigint")
    return stacked.filter(F.col("n_distinct") <= 1)


def unpivot_one_row(df: DataFrame, cols, name_col: str, value_col: str, cast: str) -> DataFrame:
    """Long form of a wide row: one row per column, via ``stack``."""
    return df.select(*[F.col(f"`{c}`").cast(cast).alias(c) for c in cols]) \
        .unpivot([], list(cols), name_col, value_col)


# #49 ----------------------------------------------------------------------
def null_shares(df: DataFrame) -> DataFrame:
    """One row: ``n`` and the null count of every column (pure sums)."""
    return df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.sum(col_of(c).isNull().cast("int")).alias(c) for c in df.columns])


def null_counts(df: DataFrame) -> dict:
    """``{column: null count}`` plus ``__n`` (one row to the driver)."""
    row = null_shares(df).first()
    return {"__n": row["__n"] or 0, **{c: row[c] or 0 for c in df.columns}}


def sparse_columns(df: DataFrame, threshold: float = 0.39, counts: dict | None = None) -> list[str]:
    counts = counts or null_counts(df)
    n = counts["__n"]
    return [c for c in df.columns if n and counts.get(c, 0) / n > threshold]


def drop_sparse_columns(df: DataFrame, threshold: float = 0.39,
                        counts: dict | None = None) -> tuple[DataFrame, list[str]]:
    """Drop columns whose missing share is above ``threshold``."""
    gone = sparse_columns(df, threshold, counts)
    return df.drop(*gone), gone


# #51
def mode_values(df: DataFrame, cols) -> DataFrame:
    """``(column, mode)``: most frequent non-null value, smallest on ties.

    All columns in one shuffle: unpivot to (column, value), count with a
    partial aggregate, then pick max count / min value per column."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, mode string")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col_of(c).cast("string").alias("value"))
        for c in cols])).alias("p")).select("p.column", "p.value").filter(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("nn"), F.col("value"))).alias("mode"))


# #50
def impute(df: DataFrame, diag_prefix: str = "diag_", diag_fill: str = "0",
           unknown: str = "Unknown", counts: dict | None = None) -> DataFrame:
    """Nulls: ``diag_*`` to '0'; numeric to the exact median; other columns to
    the mode (smallest on ties) or 'Unknown' when the column has no value.
    ``counts`` (null counts known from an earlier pass) saves a pass; columns
    absent from it are counted."""
    if counts is None or any(c not in counts for c in df.columns):
        counts = {**(counts or {}), **null_counts(df)}
    todo = [c for c in df.columns if counts.get(c, 0) > 0]
    if not todo:
        return df
    nums = set(numeric_columns(df))
    diag = [c for c in todo if c.startswith(diag_prefix)]
    num = [c for c in todo if c in nums and c not in diag]
    cat = [c for c in todo if c not in nums and c not in diag]
    fills: dict = {c: diag_fill for c in diag}
    if num:
        med = quantile_row(df, {c: (c, 0.5) for c in num}).first()
        fills.update({c: med[c] for c in num if med[c] is not None})
    if cat:
        modes = {r["column"]: r["mode"] for r in mode_values(df, cat).collect()}  # <= len(cat) rows
        fills.update({c: modes.get(c, unknown) for c in cat})
    out = []
    for c in df.columns:
        if c in fills:
            out.append(F.coalesce(col_of(c), F.lit(fills[c]).cast(df.schema[c].dataType)).alias(c))
        else:
            out.append(col_of(c))
    return df.select(*out)


# #52
def first_encounter_per_patient(df: DataFrame, key: str = "patient_nbr",
                                order_col: str = "encounter_id",
                                strict_first_non_null: bool = False) -> DataFrame:
    """One row per ``key``: the row with the smallest ``order_col`` (a unique
    business key such as the encounter id).

    The first id per patient is a partial aggregate; a left-semi join on
    (patient, id) keeps those rows.  Unlike a ``min_by`` over a struct of all
    columns, this lets Catalyst prune columns down to the scan, so a query
    that needs three columns reads and shuffles three columns, and the
    composite join key spreads a patient with a third of all rows.
    With ``strict_first_non_null`` each column takes its first non-null
    value in ``order_col`` order (pandas ``groupby().first()``)."""
    if strict_first_non_null:
        others = [c for c in df.columns if c != key]
        aggs = [F.min(col_of(order_col)).alias(order_col) if c == order_col else
                F.expr(f"min_by(`{c}`, `{order_col}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c)
                for c in others]
        return df.groupBy(key).agg(*aggs).select(*df.columns)
    firsts = df.groupBy(col_of(key).alias(key)).agg(F.min(col_of(order_col)).alias(order_col))
    return df.join(firsts, [key, order_col], "left_semi")


# #53
def quality_check(df: DataFrame) -> DataFrame:
    """One row: total null cells and number of duplicate rows."""
    nulls = None
    for c in df.columns:
        e = F.sum(col_of(c).isNull().cast("bigint"))
        nulls = e if nulls is None else nulls + e
    dup = F.count(F.lit(1)) - F.count_distinct(F.struct(*[col_of(c) for c in df.columns]))
    return df.agg(F.coalesce(nulls, F.lit(0)).cast("bigint").alias("null_cells"),
                  dup.cast("bigint").alias("duplicate_rows"))

