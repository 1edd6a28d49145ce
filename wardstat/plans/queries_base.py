"""Registered queries, part 1: selection, lookups, scalar features, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from ..operators import clean, features as feat
from . import oracle_sql as O
from .queries_profile import CLEAN_NUMERIC, CLEAN_STRINGS
from .registry import register
from .pipeline import cleaned, featured, raw_encounters

IDS = ["encounter_id"]
MEDS_SQL = ", ".join(O.ident(m) for m in codes.MEDICATIONS)


def nulled(spark, sf):
    return clean.null_if_marker(raw_encounters(spark, sf))


# --- 2.2 projections and filters -------------------------------------------
@register("select_by_type_numeric", O.CLEANED + """
SELECT encounter_id, patient_nbr, admission_type_id, discharge_disposition_id, admission_source_id,
  time_in_hospital, num_lab_procedures, num_procedures, num_medications, number_outpatient,
  number_emergency, number_inpatient, number_diagnoses, diab_type, diab_control,
  diab_complication_binary, meds_per_day, procedures_per_day, labs_per_day, readmitted_binary
FROM cleaned""")
def q_select_by_type(spark, sf):
    return clean.select_by_type(cleaned(spark, sf), "numeric")


@register("drop_leakage_columns", O.CLEANED + """
SELECT * EXCLUDE (encounter_id, patient_nbr, readmitted) FROM cleaned""")
def q_drop_columns(spark, sf):
    return clean.drop_columns(cleaned(spark, sf), ["encounter_id", "patient_nbr", "readmitted",
                                                   "not_a_column"])


@register("keep_listed_columns", O.CLEANED + """
SELECT encounter_id, age, number_inpatient, diag_1_category FROM cleaned""")
def q_keep_listed(spark, sf):
    df, _missing = clean.keep_listed(cleaned(spark, sf), ["encounter_id", "age", "change_Yes",
                                                          "number_inpatient", "diag_1_category",
                                                          "diag_1_cat"])
    return df


@register("safe_names", O.CLEANED + ", ".join(
    [" SELECT encounter_id"] + [f'{O.ident(m)} AS {m.replace("-", "_")}' for m in codes.MEDICATIONS])
    + " FROM cleaned")
def q_safe_names(spark, sf):
    df, _rev = clean.safe_names(cleaned(spark, sf).select("encounter_id", *[f"`{m}`" for m in codes.MEDICATIONS]))
    return df


@register("exclude_hospice_discharges", O.LOADED + """
SELECT * FROM loaded WHERE discharge_disposition_id NOT IN (11, 13, 14, 19, 20, 21)
   OR discharge_disposition_id IS NULL""")
def q_exclude_codes(spark, sf):
    return clean.exclude_codes(raw_encounters(spark, sf), "discharge_disposition_id", codes.DEAD_OR_HOSPICE)


@register("exclude_age_levels", O.LOADED + """
SELECT encounter_id, age FROM loaded WHERE age IS NULL OR age NOT IN ('[0-10)', '[10-20)', '[90-100)')""")
def q_exclude_levels(spark, sf):
    return clean.exclude_levels(raw_encounters(spark, sf).select("encounter_id", "age"))


@register("range_trim", O.LOADED + """
SELECT encounter_id, num_lab_procedures, num_medications, number_diagnoses FROM loaded
WHERE num_lab_procedures <= 99 AND num_medications <= 63 AND number_diagnoses BETWEEN 2 AND 9""")
def q_range_trim(spark, sf):
    return clean.range_trim(raw_encounters(spark, sf).select(
        "encounter_id", "num_lab_procedures", "num_medications", "number_diagnoses"))


@register("entity_count_filter", O.LOADED + """
SELECT encounter_id, patient_nbr FROM loaded WHERE patient_nbr IN (
  SELECT patient_nbr FROM loaded GROUP BY patient_nbr HAVING count(DISTINCT encounter_id) <= 13)""")
def q_entity_count_filter(spark, sf):
    return clean.entity_count_filter(raw_encounters(spark, sf).select("encounter_id", "patient_nbr"))


@register("drop_null_rows", O.NULLED + """
SELECT encounter_id, race, diag_1, diag_2, diag_3 FROM nulled
WHERE race IS NOT NULL AND diag_1 IS NOT NULL AND diag_2 IS NOT NULL AND diag_3 IS NOT NULL""")
def q_drop_null_rows(spark, sf):
    return clean.drop_null_rows(nulled(spark, sf).select("encounter_id", "race", "diag_1", "diag_2", "diag_3"))


@register("subset_slice", O.CLEANED + """
SELECT encounter_id, diab_type, diab_control, readmitted_binary FROM cleaned
WHERE diab_type = 1 AND diab_control = 0""")
def q_subset_slice(spark, sf):
    return clean.subset_slice(cleaned(spark, sf), {"diab_type": 1, "diab_control": 0}).select(
        "encounter_id", "diab_type", "diab_control", "readmitted_binary")


@register("numeric_matrix", O.FEATURED + """
SELECT admission_type_id, discharge_disposition_id, admission_source_id, time_in_hospital,
  num_lab_procedures, num_procedures, num_medications, number_outpatient, number_emergency,
  number_inpatient, number_diagnoses, diab_type, diab_control, diab_complication_binary,
  meds_per_day, procedures_per_day, labs_per_day, total_prior_visits, high_utilizer,
  time_in_hospital_squared, num_medications_squared, num_lab_procedures_squared, "A1C_tested",
  diabetes_med_changed, on_diabetes_med, long_stay, many_medications, complex_case
FROM featured""")
def q_numeric_matrix(spark, sf):
    return clean.numeric_matrix(featured(spark, sf), exclude=codes.ID_COLUMNS + [codes.TARGET])


# --- 2.3 lookups -------------------------------------------------------------
@register("diabetes_code_lookup", O.with_(",\n" + O.nulled_cte(), ",\n" + O.dmap_cte()) + f"""
, dc AS (SELECT encounter_id, coalesce(
    CASE WHEN diag_1 IN (SELECT code FROM dmap) THEN diag_1 END,
    CASE WHEN diag_2 IN (SELECT code FROM dmap) THEN diag_2 END,
    CASE WHEN diag_3 IN (SELECT code FROM dmap) THEN diag_3 END, '250') AS diab_code FROM nulled)
SELECT dc.encounter_id, dc.diab_code, m.dtype AS diab_type,
  CAST(contains(m.descr, 'not stated as uncontrolled') AS INTEGER) AS diab_control,
  CAST(contains(m.descr, ' with ') AS INTEGER) AS diab_complication_binary,
  CASE WHEN contains(m.descr, ' with ') THEN trim(split_part(split_part(m.descr, 'with', 2), ', ', 1))
       ELSE 'None' END AS diab_complication_categories
FROM dc LEFT JOIN dmap m ON dc.diab_code = m.code""")
def q_diabetes_lookup(spark, sf):
    return feat.diabetes_fields(nulled(spark, sf)).select(
        "encounter_id", "diab_code", "diab_type", "diab_control", "diab_complication_binary",
        "diab_complication_categories")


def _values(mapping):
    return ", ".join(f"({k}, {O.q(v)})" for k, v in mapping.items())


@register("id_label_lookup", O.LOADED + f"""
, m AS (SELECT encounter_id,
    CASE WHEN admission_type_id IN (5, 6, 8) THEN 9 ELSE admission_type_id END AS admission_type_id,
    discharge_disposition_id,
    CASE WHEN admission_source_id IN (9, 15, 17, 20) THEN 27 ELSE admission_source_id END AS admission_source_id
  FROM loaded),
atl(k, v) AS (VALUES {_values(codes.ADMISSION_TYPE_LABELS)}),
dd(k, v) AS (VALUES {_values(codes.DISCHARGE_LABELS)}),
src(k, v) AS (VALUES {_values(codes.ADMISSION_SOURCE_LABELS)})
SELECT m.encounter_id, CAST(m.admission_type_id AS INTEGER) AS admission_type_id,
  m.discharge_disposition_id, CAST(m.admission_source_id AS INTEGER) AS admission_source_id,
  atl.v AS admission_type_desc, dd.v AS discharge_disposition_desc, src.v AS admission_source_desc
FROM m LEFT JOIN atl ON m.admission_type_id = atl.k LEFT JOIN dd ON m.discharge_disposition_id = dd.k
LEFT JOIN src ON m.admission_source_id = src.k""")
def q_id_labels(spark, sf):
    return feat.id_labels(raw_encounters(spark, sf).select(
        "encounter_id", "admission_type_id", "discharge_disposition_id", "admission_source_id"))


@register("id_label_normalised", O.LOADED + f"""
, lab(k, v) AS (VALUES {", ".join(f"('{k}', {O.q(v)})" for k, v in codes.DISCHARGE_LABELS.items())}),
lab2 AS (SELECT k, CASE WHEN regexp_matches(trim(v), '^(null|not available|not mapped|unknown/invalid|unknown|invalid)$', 'i')
                   THEN 'Missing' ELSE trim(v) END AS v FROM lab)
SELECT l.encounter_id, l.discharge_disposition_id, coalesce(lab2.v, 'Missing') AS discharge_disposition_id_label
FROM loaded l LEFT JOIN lab2 ON CAST(l.discharge_disposition_id AS VARCHAR) = lab2.k""")
def q_id_label_normalised(spark, sf):
    sec = feat.sectioned_from_labels(spark)
    return feat.lookup_label_normalised(raw_encounters(spark, sf).select(
        "encounter_id", "discharge_disposition_id"), "discharge_disposition_id", sec)


@register("id_label_misses", O.LOADED + f"""
, lab(k, v) AS (VALUES {", ".join(f"('{k}', {O.q(v)})" for k, v in codes.ADMISSION_SOURCE_LABELS.items())}),
lab2 AS (SELECT k, CASE WHEN regexp_matches(trim(v), '^(null|not available|not mapped|unknown/invalid|unknown|invalid)$', 'i')
                   THEN 'Missing' ELSE trim(v) END AS v FROM lab),
j AS (SELECT l.admission_source_id AS a, coalesce(lab2.v, 'Missing') AS v
      FROM loaded l LEFT JOIN lab2 ON CAST(l.admission_source_id AS VARCHAR) = lab2.k)
SELECT CAST(sum(CASE WHEN v = 'Missing' THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
  string_agg(DISTINCT CASE WHEN v = 'Missing' THEN CAST(a AS VARCHAR) END, ',' ORDER BY
             CASE WHEN v = 'Missing' THEN CAST(a AS VARCHAR) END) AS raw_values
FROM j""")
def q_label_misses(spark, sf):
    sec = feat.sectioned_from_labels(spark)
    r = feat.label_misses(raw_encounters(spark, sf), "admission_source_id", sec)
    return r.select("n_missing", F.concat_ws(",", "raw_values").alias("raw_values"))


# --- 2.4 scalar features -----------------------------------------------------
@register("marker_count", O.LOADED + " SELECT CAST(" + " + ".join(
    f"sum(CASE WHEN {O.ident(c)} = '?' THEN 1 ELSE 0 END)" for c in O.ENC_STRING_COLS)
    + " AS BIGINT) AS markers_converted FROM loaded")
def q_marker_count(spark, sf):
    return clean.marker_count(raw_encounters(spark, sf))


@register("icd9_categories", O.NULLED + " SELECT encounter_id, diag_1, diag_2, diag_3, "
          + ", ".join(f"{O.icd_sql(f'diag_{i}')} AS diag_{i}_category" for i in (1, 2, 3)) + " FROM nulled")
def q_icd9(spark, sf):
    return feat.icd9_categories(nulled(spark, sf).select("encounter_id", "diag_1", "diag_2", "diag_3"))


@register("per_day_rates_and_target", O.CLEANED + """
SELECT encounter_id, meds_per_day, procedures_per_day, labs_per_day, readmitted_binary FROM cleaned""")
def q_per_day(spark, sf):
    return cleaned(spark, sf).select("encounter_id", "meds_per_day", "procedures_per_day",
                                     "labs_per_day", "readmitted_binary")


@register("died_or_hospice", O.LOADED + """
SELECT encounter_id, CAST(coalesce(discharge_disposition_id IN (11, 13, 14, 19, 20, 21), false) AS INTEGER)
  AS died_or_hospice FROM loaded""")
def q_died(spark, sf):
    return feat.died_or_hospice(raw_encounters(spark, sf)).select("encounter_id", "died_or_hospice")


@register("engineered_features", O.FEATURED + """
SELECT encounter_id, total_prior_visits, high_utilizer, time_in_hospital_squared, num_medications_squared,
  num_lab_procedures_squared, "A1C_tested", diabetes_med_changed, on_diabetes_med, long_stay,
  many_medications, complex_case FROM featured""")
def q_engineered(spark, sf):
    return featured(spark, sf).select(
        "encounter_id", "total_prior_visits", "high_utilizer", "time_in_hospital_squared",
        "num_medications_squared", "num_lab_procedures_squared", "A1C_tested", "diabetes_med_changed",
        "on_diabetes_med", "long_stay", "many_medications", "complex_case")


@register("extended_flags_and_products", O.FEATURED + """
SELECT encounter_id,
  CAST(coalesce("A1Cresult" IN ('>8', '>9'), false) AS INTEGER) AS a1c_flag_bad,
  CAST(number_inpatient > 0 AS INTEGER) AS had_prior_inpatient,
  CAST(number_emergency >= 2 AS INTEGER) AS "frequent_ER_user",
  CAST(discharge_disposition_id IN (1, 6, 8) AS INTEGER) AS discharge_home,
  CAST(discharge_disposition_id IN (3, 4, 5, 15, 22, 23, 24, 29, 30) AS INTEGER) AS discharge_postacute,
  CAST(discharge_disposition_id IN (28) AS INTEGER) AS discharge_psych,
  CAST(admission_type_id IN (1, 2, 7) AS INTEGER) AS admit_emergent,
  CAST(admission_type_id IN (3) AS INTEGER) AS admit_elective,
  CAST(admission_source_id IN (5, 6) AS INTEGER) AS admit_transfer,
  CAST(num_medications AS BIGINT) * num_lab_procedures AS meds_x_labs,
  CAST(num_medications AS BIGINT) * total_prior_visits AS meds_x_visits,
  CAST(time_in_hospital AS BIGINT) * num_medications AS stay_x_meds,
  CAST(time_in_hospital AS BIGINT) * num_lab_procedures AS stay_x_labs,
  CAST(num_lab_procedures AS BIGINT) * total_prior_visits AS labs_x_visits,
  CAST(num_medications AS BIGINT) * diab_complication_binary AS meds_x_diab_comp,
  CAST(num_lab_procedures AS BIGINT) * diab_complication_binary AS labs_x_diab_comp
FROM featured""")
def q_extended(spark, sf):
    df = feat.flag_products(feat.product_features(feat.indicator_flags_extended(featured(spark, sf))))
    return df.select("encounter_id", "a1c_flag_bad", "had_prior_inpatient", "frequent_ER_user",
                     "discharge_home", "discharge_postacute", "discharge_psych", "admit_emergent",
                     "admit_elective", "admit_transfer", "meds_x_labs", "meds_x_visits", "stay_x_meds",
                     "stay_x_labs", "labs_x_visits", "meds_x_diab_comp", "labs_x_diab_comp")


@register("medication_bins_and_age", O.CLEANED + """
SELECT encounter_id,
  CASE WHEN num_medications > 0 AND num_medications <= 5 THEN '1-5'
       WHEN num_medications > 5 AND num_medications <= 10 THEN '6-10'
       WHEN num_medications > 10 AND num_medications <= 15 THEN '11-15'
       WHEN num_medications > 15 AND num_medications <= 20 THEN '16-20'
       WHEN num_medications > 20 AND num_medications <= 100 THEN '20+' END AS med_bins,
  CAST(regexp_extract(age, '(\\d+)', 1) AS INTEGER) AS age_lower
FROM cleaned""")
def q_bins_age(spark, sf):
    return feat.age_lower(feat.medication_bins(cleaned(spark, sf))).select("encounter_id", "med_bins", "age_lower")


def _group_sql(name, cols):
    arr = "[" + ", ".join(O.ident(c) for c in cols) + "]"
    act = f"list_distinct(list_filter({arr}, lambda x: x <> 'No'))"
    return (f"CASE WHEN len({act}) = 0 THEN 'No' WHEN len({act}) = 1 THEN {act}[1] "
            f"ELSE 'Multiple changes' END AS {name}")


@register("medication_group_change", O.LOADED + " SELECT encounter_id, " + ", ".join(
    _group_sql(n, c) for n, c in codes.DRUG_GROUPS.items()) + " FROM loaded")
def q_group_change(spark, sf):
    return feat.medication_group_changes(raw_encounters(spark, sf)).select(
        "encounter_id", *codes.DRUG_GROUPS.keys())


@register("upper_diagnosis_codes", O.NULLED + """
SELECT encounter_id, upper(coalesce(diag_1, 'UNK')) AS diag_1, upper(coalesce(diag_2, 'UNK')) AS diag_2,
  upper(coalesce(diag_3, 'UNK')) AS diag_3 FROM nulled""")
def q_upper(spark, sf):
    return feat.upper_string(nulled(spark, sf).select("encounter_id", "diag_1", "diag_2", "diag_3"))


@register("constant_columns", O.LOADED + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {O.q(c)} AS \"column\", count(DISTINCT {O.ident(c)}) AS n_distinct FROM loaded"
    for c in O.ENC_COLS) + ") WHERE n_distinct <= 1")
def q_constant(spark, sf):
    return clean.constant_columns(raw_encounters(spark, sf))


# --- 2.5 table-level cleaning --------------------------------------------------
@register("sparse_columns", O.with_(",\n" + O.nulled_cte()) + """
, f AS (SELECT * REPLACE (coalesce("A1Cresult", 'NoTest') AS "A1Cresult") FROM nulled)
SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT {O.q(c)} AS \"column\", round(avg(CASE WHEN {O.ident(c)} IS NULL THEN 1.0 ELSE 0.0 END), 6) "
    f"AS missing_share FROM f" for c in O.ENC_COLS) + ") WHERE missing_share > 0.39")
def q_sparse(spark, sf):
    df = clean.fill_marker(nulled(spark, sf), "A1Cresult", "NoTest")
    row = clean.null_shares(df)
    n = F.col("__n")
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.round(F.col(f"`{c}`") / n, 6).alias("missing_share"))
        for c in df.columns])).alias("m")).select("m.*")
    return long.filter(F.col("missing_share") > 0.39)


@register("impute_modes", O.NULLED + " SELECT * FROM (" + " UNION ALL ".join(
    f"(SELECT {O.q(c)} AS \"column\", {O.ident(c)} AS mode FROM nulled WHERE {O.ident(c)} IS NOT NULL "
    f"GROUP BY {O.ident(c)} ORDER BY count(*) DESC, {O.ident(c)} LIMIT 1)"
    for c in ["race", "diag_1", "diag_2", "diag_3", "payer_code", "medical_specialty"]) + ")")
def q_modes(spark, sf):
    return clean.mode_values(nulled(spark, sf), ["race", "diag_1", "diag_2", "diag_3", "payer_code",
                                                 "medical_specialty"])


@register("cleaned_table", O.CLEANED + " SELECT * FROM cleaned")
def q_cleaned(spark, sf):
    return cleaned(spark, sf)


#: null cells of the cleaned table, counted column by column
NULL_CELLS = " + ".join(f"count(*) - count({O.ident(c)})"
                        for c in ["encounter_id", "patient_nbr", codes.TARGET, *CLEAN_NUMERIC, *CLEAN_STRINGS])


@register("quality_check", O.CLEANED + """
SELECT CAST((SELECT """ + NULL_CELLS + """ FROM cleaned) AS BIGINT) AS null_cells,
  CAST((SELECT count(*) FROM cleaned) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cleaned)) AS BIGINT)
  AS duplicate_rows""")
def q_quality(spark, sf):
    return clean.quality_check(cleaned(spark, sf))


@register("cleaning_report", O.CLEANED + ", filled AS (SELECT " + ", ".join(
    f"CASE WHEN {O.ident(c)} IN ('None', '', '?') THEN {A1C} ELSE {O.ident(c)} END AS {O.ident(c)}"
    if c in O.ENC_STRING_COLS else O.ident(c) for c in O.ENC_COLS for A1C in ["'NoTest'" if c == "A1Cresult" else "NULL"]) + " FROM encounters)" + """
, r AS (
  SELECT 0 AS ord, 'initial_rows' AS metric, CAST((SELECT count(*) FROM encounters) AS DOUBLE) AS value
  UNION ALL SELECT 1, 'final_rows', (SELECT count(*) FROM cleaned)
  UNION ALL SELECT 2, 'rows_removed', (SELECT count(*) FROM encounters) - (SELECT count(*) FROM cleaned)
  UNION ALL SELECT 3, 'initial_columns', (SELECT len(json_keys(to_json(e))) FROM (SELECT * FROM encounters LIMIT 1) e)
  UNION ALL SELECT 4, 'final_columns', (SELECT len(json_keys(to_json(c))) FROM (SELECT * FROM cleaned LIMIT 1) c)
  UNION ALL SELECT 5, 'columns_dropped', (SELECT """ + " + ".join(
    f"CAST(count(*) - count({O.ident(c)}) > 0.39 * count(*) AS INTEGER)" for c in O.ENC_COLS) + """ FROM filled)
  UNION ALL SELECT 6, 'markers_converted', (SELECT """ + " + ".join(
    f"sum(CASE WHEN {O.ident(c)} = '?' THEN 1 ELSE 0 END)" for c in O.ENC_STRING_COLS) + """ FROM encounters)
  UNION ALL SELECT 7, 'final_missing_values', (SELECT """ + NULL_CELLS + """ FROM cleaned))
SELECT CAST(ord AS INTEGER) AS ord, metric, CAST(value AS DOUBLE) AS value FROM r""")
def q_cleaning_report(spark, sf):
    from .pipeline import cleaning_report
    return cleaning_report(spark, sf)


# --- the neural path, end to end ---------------------------------------------------
NEURAL_OUT = ["encounter_id", "patient_nbr", "admission_type_id", "admission_type_desc",
              "discharge_disposition_desc", "admission_source_id", "admission_source_desc",
              "died_or_hospice", "race", "A1Cresult", "diag_1", "diag_2", "diag_3", "diag_1_category", "diab_type",
              "meds_per_day", "readmitted_binary"]


@register("neural_path_cleaned", O.with_(O.loaded_cte(), ",\n" + O.dmap_cte()) + f"""
, atl(k, v) AS (VALUES {_values(codes.ADMISSION_TYPE_LABELS)}),
dd(k, v) AS (VALUES {_values(codes.DISCHARGE_LABELS)}),
src(k, v) AS (VALUES {_values(codes.ADMISSION_SOURCE_LABELS)}),
s0 AS (SELECT encounter_id, patient_nbr,
    CAST(CASE WHEN admission_type_id IN (5, 6, 8) THEN 9 ELSE admission_type_id END AS INTEGER) AS admission_type_id,
    discharge_disposition_id,
    CAST(CASE WHEN admission_source_id IN (9, 15, 17, 20) THEN 27 ELSE admission_source_id END AS INTEGER)
      AS admission_source_id,
    CAST(coalesce(discharge_disposition_id IN (11, 13, 14, 19, 20, 21), false) AS INTEGER) AS died_or_hospice,
    CASE WHEN race = '?' THEN NULL ELSE race END AS race,
    coalesce(CASE WHEN "A1Cresult" = '?' THEN NULL ELSE "A1Cresult" END, 'NoTest') AS "A1Cresult",
    CASE WHEN diag_1 = '?' THEN NULL ELSE diag_1 END AS diag_1,
    CASE WHEN diag_2 = '?' THEN NULL ELSE diag_2 END AS diag_2,
    CASE WHEN diag_3 = '?' THEN NULL ELSE diag_3 END AS diag_3,
    age, time_in_hospital, num_lab_procedures, num_medications, number_diagnoses, readmitted
  FROM loaded WHERE NOT coalesce(discharge_disposition_id IN (11, 13, 14, 19, 20, 21), false)),
s1 AS (SELECT s0.*, atl.v AS admission_type_desc, dd.v AS discharge_disposition_desc, src.v AS admission_source_desc FROM s0
  LEFT JOIN atl ON s0.admission_type_id = atl.k LEFT JOIN dd ON s0.discharge_disposition_id = dd.k
  LEFT JOIN src ON s0.admission_source_id = src.k),
s2 AS (SELECT * REPLACE (coalesce(race, (SELECT race FROM s1 WHERE race IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), 'Unknown') AS race, coalesce(admission_type_desc, (SELECT admission_type_desc FROM s1 WHERE admission_type_desc IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), 'Unknown') AS admission_type_desc, coalesce(discharge_disposition_desc, (SELECT discharge_disposition_desc FROM s1 WHERE discharge_disposition_desc IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), 'Unknown') AS discharge_disposition_desc, coalesce(admission_source_desc, (SELECT admission_source_desc FROM s1 WHERE admission_source_desc IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), 'Unknown') AS admission_source_desc) FROM s1 WHERE NOT coalesce(age IN ('[0-10)', '[10-20)', '[90-100)'), false)),
s3 AS (SELECT * FROM s2 WHERE patient_nbr IN (SELECT patient_nbr FROM s2 GROUP BY patient_nbr
         HAVING count(DISTINCT encounter_id) <= 13)),
s4 AS (SELECT * FROM s3 WHERE num_lab_procedures <= 99 AND num_medications <= 63
         AND number_diagnoses >= 2 AND number_diagnoses <= 9),
s5 AS (SELECT *, coalesce(CASE WHEN diag_1 IN (SELECT code FROM dmap) THEN diag_1 END,
         CASE WHEN diag_2 IN (SELECT code FROM dmap) THEN diag_2 END,
         CASE WHEN diag_3 IN (SELECT code FROM dmap) THEN diag_3 END, '250') AS diab_code FROM s4)
SELECT s5.encounter_id, s5.patient_nbr, s5.admission_type_id, s5.admission_type_desc,
  s5.discharge_disposition_desc, s5.admission_source_id, s5.admission_source_desc,
  s5.died_or_hospice, s5.race, s5."A1Cresult", coalesce(s5.diag_1, '0') AS diag_1, coalesce(s5.diag_2, '0') AS diag_2,
  coalesce(s5.diag_3, '0') AS diag_3, {O.icd_sql('s5.diag_1')} AS diag_1_category,
  m.dtype AS diab_type, s5.num_medications / greatest(s5.time_in_hospital, 1)::DOUBLE AS meds_per_day,
  CAST(coalesce(s5.readmitted = '<30', false) AS INTEGER) AS readmitted_binary
FROM s5 LEFT JOIN dmap m ON s5.diab_code = m.code""")
def q_neural_path(spark, sf):
    from .pipeline import neural_clean
    return neural_clean(raw_encounters(spark, sf)).select(*NEURAL_OUT)
