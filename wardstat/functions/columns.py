"""Column-expression builders (JVM-side, codegen friendly, no Python UDF).

Each function returns a ``Column``; operators in ``wardstat.operators`` use
them inside ``select`` / ``withColumns`` so the work stays in whole-stage
codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes


def col_of(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Trim all leading/trailing whitespace (Python ``str.strip`` meaning)."""
    return F.regexp_replace(col_of(c), r"^\s+|\s+$", "")


def null_if_tokens(c, tokens) -> Column:
    """Marker/token text to null; other values unchanged."""
    c = col_of(c)
    return F.when(F.coalesce(c.isin(list(tokens)), F.lit(False)), F.lit(None)).otherwise(c)


def isin_flag(c, values) -> Column:
    """0/1 integer flag, null-safe (a null input gives 0, as in pandas)."""
    return F.coalesce(col_of(c).isin(list(values)), F.lit(False)).cast("int")


def cmp_flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def icd9_parts(c) -> tuple[Column, Column]:
    """(numeric-looking flag, parsed double) of an ICD-9 code text."""
    t = strip_ws(col_of(c))
    return t.rlike(codes.ICD9_NUMERIC_PATTERN), t.try_cast("double")


def icd9_from_parts(raw, numeric, x) -> Column:
    """ICD-9 group from the code, its numeric flag and its parsed value."""
    raw, numeric, x = col_of(raw), col_of(numeric), col_of(x)
    expr = None
    for name, ranges, exact in codes.ICD9_GROUPS:
        if name == "Diabetes":
            cond = (x >= 250) & (x < 251)
        else:
            cond = F.lit(False)
            for lo, hi in ranges:
                cond = cond | ((x >= lo) & (x <= hi))
            for e in exact:
                cond = cond | (x == e)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return (F.when(raw.isNull(), F.lit(codes.ICD9_NULL_CATEGORY))
            .when(~numeric, F.lit(codes.ICD9_OTHER))
            .otherwise(expr.otherwise(F.lit(codes.ICD9_OTHER))))


def icd9_category(c) -> Column:
    """ICD-9 code text -> one of 9 groups; null gives '0', non-numeric 'Other'.
    (Single expression; ``operators.features.icd9_categories`` splits it in
    two projections so the parse is computed once per row.)"""
    numeric, x = icd9_parts(c)
    return icd9_from_parts(c, numeric, x)


def literal_map(pairs) -> Column:
    """A literal ``map`` column from (key, value) pairs (bounded, plan-time)."""
    items = []
    for k, v in pairs:
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def map_lookup(c, pairs) -> Column:
    """Look a value up in a fixed literal table; unmatched gives null."""
    return F.try_element_at(literal_map(pairs), col_of(c))


def first_matching_code(cols, keys, default=codes.DIABETES_DEFAULT_CODE) -> Column:
    """First of ``cols`` whose text is exactly one of ``keys``, else ``default``."""
    keys = list(keys)
    parts = [F.when(F.coalesce(col_of(c).isin(keys), F.lit(False)), col_of(c)) for c in cols]
    return F.coalesce(*parts, F.lit(default))


def complication_category(description: Column) -> Column:
    """Text between the first 'with' and the next ', ', trimmed, else 'None'."""
    tail = F.substring(description, F.instr(description, "with") + 4, 100000)
    after = F.substring_index(F.substring_index(tail, "with", 1), ", ", 1)
    return F.when(description.contains(codes.COMPLICATION_PHRASE), F.trim(after)) \
        .otherwise(F.lit(codes.NO_COMPLICATION))


def interval_bins(c, edges, labels) -> Column:
    """Right-closed bins (e[i], e[i+1]] -> labels[i]; outside -> null."""
    x = col_of(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > lo) & (x <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def age_lower_bound(c) -> Column:
    return F.regexp_extract(col_of(c), r"(\d+)", 1).try_cast("int")


def group_change(cols) -> Column:
    """Distinct non-'No' values across ``cols``: none 'No', one that value, more
    'Multiple changes'."""
    active = F.array_distinct(F.filter(F.array(*[col_of(c) for c in cols]),
                                       lambda v: v != F.lit("No")))
    return (F.when(F.size(active) == 0, F.lit("No"))
            .when(F.size(active) == 1, active[0])
            .otherwise(F.lit(codes.MULTIPLE_CHANGES)))


def merge_codes(c, mapping: dict) -> Column:
    """Fold several codes into one in one pass (not sequential replaces)."""
    x = col_of(c)
    expr = None
    for src, dst in mapping.items():
        expr = F.when(x == src, F.lit(dst)) if expr is None else expr.when(x == src, F.lit(dst))
    return expr.otherwise(x) if expr is not None else x


def r6(c: Column) -> Column:
    """Round doubles at output so engines that sum in a different order agree."""
    return F.round(c, 6)
