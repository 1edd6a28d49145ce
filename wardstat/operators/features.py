"""Lookups (#21-#25) and scalar features (#30-#47).

Fixed lookups are literal ``map`` columns (bounded, known at plan time, no
join); data-driven lookups are joins whose small side is broadcast only after
its row count is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.columns import (age_lower_bound, cmp_flag, col_of, complication_category,
                                 first_matching_code, group_change, icd9_from_parts, icd9_parts,
                                 interval_bins, isin_flag, map_lookup, merge_codes)
from .ranges import quantile_row

# #21 ----------------------------------------------------------------------
DIAB_KEYS = [c for c, _, _ in codes.DIABETES_CODES]


def diabetes_fields(df: DataFrame, diag_cols=("diag_1", "diag_2", "diag_3")) -> DataFrame:
    """``diab_code`` (first diagnosis found in the code table, else '250') and
    its type, control flag, complication flag and complication category."""
    code = first_matching_code(list(diag_cols), DIAB_KEYS)
    desc = map_lookup(F.col("diab_code"), [(c, d) for c, _, d in codes.DIABETES_CODES])
    dtype = map_lookup(F.col("diab_code"), [(c, t) for c, t, _ in codes.DIABETES_CODES]).cast("int")
    # two projections (code, then everything read from it): fewer plan
    # analyses than one withColumn per field
    out = df.withColumns({"diab_code": code}).withColumns({"_desc": desc, "diab_type": dtype})
    return out.withColumns({
        "diab_control": F.col("_desc").contains(codes.CONTROL_PHRASE).cast("int"),
        "diab_complication_binary": F.col("_desc").contains(codes.COMPLICATION_PHRASE).cast("int"),
        "diab_complication_categories": complication_category(F.col("_desc")),
    }).drop("_desc")


# #22 ----------------------------------------------------------------------
# #23 ----------------------------------------------------------------------
def normalise_key(c) -> F.Column:
    t = F.trim(col_of(c).cast("string"))
    t = F.regexp_replace(t, r"\.0$", "")
    return F.when(F.lower(t) == "nan", F.lit("")).otherwise(t)


def lookup_label_normalised(df: DataFrame, feature: str, sectioned: DataFrame,
                            out: str | None = None) -> DataFrame:
    """Label a coded column from a ``(feature, key, label)`` map: keys compared
    as normalised text, labels meaning 'no information' and unmatched codes
    become 'Missing'."""
    out = out or f"{feature}_label"
    m = (sectioned.filter(F.col("feature") == feature)
         .select(normalise_key("key").alias("_k"),
                 F.when(F.trim("label").rlike(codes.MISSING_LABEL_PATTERN) | F.lower(F.trim("label")).isin("", "nan"),
                        F.lit(codes.MISSING_LABEL))
                 .otherwise(F.trim("label")).alias("_lab")))
    j = df.withColumn("_nk", normalise_key(feature)).join(
        m, F.col("_nk") == F.col("_k"), "left")
    return j.withColumn(out, F.coalesce(F.col("_lab"), F.lit(codes.MISSING_LABEL))) \
        .drop("_nk", "_k", "_lab")


def label_misses(df: DataFrame, feature: str, sectioned: DataFrame) -> DataFrame:
    """``(n_missing, raw_values)``: rows labelled 'Missing' and the distinct raw
    codes behind them (bounded by the code domain)."""
    lab = lookup_label_normalised(df.select(feature), feature, sectioned, "_l")
    return lab.agg(F.sum((F.col("_l") == codes.MISSING_LABEL).cast("bigint")).alias("n_missing"),
                   F.array_sort(F.collect_set(F.when(F.col("_l") == codes.MISSING_LABEL,
                                                     F.col(feature).cast("string")))).alias("raw_values"))


def sectioned_from_labels(spark) -> DataFrame:
    """The fixed ID label maps as a ``(feature, key, label)`` table."""
    rows = []
    for feat, mp in (("admission_type_id", codes.ADMISSION_TYPE_LABELS),
                     ("discharge_disposition_id", codes.DISCHARGE_LABELS),
                     ("admission_source_id", codes.ADMISSION_SOURCE_LABELS)):
        rows += [(feat, str(k), v) for k, v in mp.items()]
    return spark.createDataFrame(rows, "feature string, key string, label string")


# #24 ----------------------------------------------------------------------
def merge_code_values(df: DataFrame, col: str, mapping: dict) -> DataFrame:
    return df.withColumn(col, merge_codes(col, mapping).cast(df.schema[col].dataType))


def id_labels(df: DataFrame) -> DataFrame:
    """Neural-path ID handling: merge codes, then label the three IDs."""
    df = merge_code_values(df, "admission_type_id", codes.ADMISSION_TYPE_MERGE)
    df = merge_code_values(df, "admission_source_id", codes.ADMISSION_SOURCE_MERGE)
    return (df.withColumn("admission_type_desc",
                          map_lookup("admission_type_id", codes.ADMISSION_TYPE_LABELS.items()))
            .withColumn("discharge_disposition_desc",
                        map_lookup("discharge_disposition_id", codes.DISCHARGE_LABELS.items()))
            .withColumn("admission_source_desc",
                        map_lookup("admission_source_id", codes.ADMISSION_SOURCE_LABELS.items())))


# #30 ----------------------------------------------------------------------
def icd9_categories(df: DataFrame, cols=("diag_1", "diag_2", "diag_3")) -> DataFrame:
    """``<col>_category`` for each diagnosis column.  The parse (trim, numeric
    test, cast) is one projection and the range tests read its result, so
    Catalyst does not inline the parse into every range test."""
    parts = {}
    for i, c in enumerate(cols):
        numeric, x = icd9_parts(c)
        parts[f"_icd_n{i}"] = numeric
        parts[f"_icd_x{i}"] = x
    out = df.withColumns(parts)
    out = out.withColumns({f"{c}_category": icd9_from_parts(c, f"_icd_n{i}", f"_icd_x{i}")
                           for i, c in enumerate(cols)})
    return out.drop(*parts.keys())


# #34
def per_day_rates(df: DataFrame, stay: str = "time_in_hospital") -> DataFrame:
    days = F.greatest(col_of(stay), F.lit(1)).cast("double")
    return df.withColumns({
        "meds_per_day": col_of("num_medications") / days,
        "procedures_per_day": col_of("num_procedures") / days,
        "labs_per_day": col_of("num_lab_procedures") / days,
    })


# #35
def binary_target(df: DataFrame, src: str = codes.TARGET_TEXT, out: str = codes.TARGET,
                  positive: str = codes.POSITIVE_TEXT) -> DataFrame:
    return df.withColumn(out, cmp_flag(col_of(src) == positive))


# #36
def died_or_hospice(df: DataFrame) -> DataFrame:
    return df.withColumn("died_or_hospice", isin_flag("discharge_disposition_id",
                                                      codes.DEAD_OR_HOSPICE))


# #37 / #38
def total_prior_visits(df: DataFrame) -> DataFrame:
    parts = [F.coalesce(col_of(c), F.lit(0)).cast("bigint")
             for c in ("number_outpatient", "number_emergency", "number_inpatient")]
    return df.withColumn("total_prior_visits", parts[0] + parts[1] + parts[2])


def high_utilizer(df: DataFrame, col: str = "total_prior_visits", q: float = 0.75) -> DataFrame:
    """1 when the value is strictly above the exact (linear) ``q`` quantile.

    The quantile (by counted ranges) is joined back as a one-row broadcast."""
    p = quantile_row(df, {"_q": (col, q)})
    return df.crossJoin(F.broadcast(p)).withColumn(
        "high_utilizer", cmp_flag(col_of(col) > F.col("_q"))).drop("_q")


# #39
def squared_terms(df: DataFrame, cols=("time_in_hospital", "num_medications",
                                       "num_lab_procedures")) -> DataFrame:
    return df.withColumns({f"{c}_squared": col_of(c).cast("bigint") * col_of(c).cast("bigint")
                           for c in cols})


# #40
def indicator_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "A1C_tested": cmp_flag(col_of("A1Cresult") != "NoTest"),
        "diabetes_med_changed": cmp_flag(col_of("change") == "Ch"),
        "on_diabetes_med": cmp_flag(col_of("diabetesMed") == "Yes"),
        "long_stay": cmp_flag(col_of("time_in_hospital") > 7),
        "many_medications": cmp_flag(col_of("num_medications") > 15),
        "complex_case": cmp_flag(col_of("number_diagnoses") > 7),
    })


# #41
def indicator_flags_extended(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "a1c_flag_bad": isin_flag("A1Cresult", codes.A1C_BAD),
        "had_prior_inpatient": cmp_flag(col_of("number_inpatient") > 0),
        "frequent_ER_user": cmp_flag(col_of("number_emergency") >= 2),
        "discharge_home": isin_flag("discharge_disposition_id", codes.DISCHARGE_HOME),
        "discharge_postacute": isin_flag("discharge_disposition_id", codes.DISCHARGE_POSTACUTE),
        "discharge_psych": isin_flag("discharge_disposition_id", codes.DISCHARGE_PSYCH),
        "admit_emergent": isin_flag("admission_type_id", codes.ADMIT_EMERGENT),
        "admit_elective": isin_flag("admission_type_id", codes.ADMIT_ELECTIVE),
        "admit_transfer": isin_flag("admission_source_id", codes.ADMIT_TRANSFER_SOURCE),
    })


# #42 / #43
def product_features(df: DataFrame) -> DataFrame:
    m, lab, t = col_of("num_medications"), col_of("num_lab_procedures"), col_of("time_in_hospital")
    v = col_of("total_prior_visits")
    return df.withColumns({
        "meds_x_labs": m.cast("bigint") * lab, "meds_x_visits": m.cast("bigint") * v,
        "stay_x_meds": t.cast("bigint") * m, "stay_x_labs": t.cast("bigint") * lab,
        "labs_x_visits": lab.cast("bigint") * v})


def flag_products(df: DataFrame, flag: str = "diab_complication_binary") -> DataFrame:
    return df.withColumns({
        "meds_x_diab_comp": col_of("num_medications").cast("bigint") * col_of(flag),
        "labs_x_diab_comp": col_of("num_lab_procedures").cast("bigint") * col_of(flag)})


# #44
def medication_bins(df: DataFrame, col: str = "num_medications", out: str = "med_bins") -> DataFrame:
    return df.withColumn(out, interval_bins(col, codes.MEDICATION_BINS, codes.MEDICATION_BIN_LABELS))


# #45
def age_lower(df: DataFrame, col: str = "age", out: str = "age_lower") -> DataFrame:
    return df.withColumn(out, age_lower_bound(col))


# #46
def medication_group_changes(df: DataFrame, groups=codes.DRUG_GROUPS) -> DataFrame:
    return df.withColumns({name: group_change(cols) for name, cols in groups.items()})


# #47
def upper_string(df: DataFrame, cols=("diag_1", "diag_2", "diag_3"), fill: str = "UNK") -> DataFrame:
    return df.withColumns({c: F.upper(F.coalesce(col_of(c).cast("string"), F.lit(fill)))
                           for c in cols})
