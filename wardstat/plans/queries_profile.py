"""Registered queries, part 2: profiling (#55-#75) and cohort statistics (#76-#91)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from ..operators import clean, profile as pf, stats as st
from . import oracle_sql as O
from .registry import register
from .pipeline import cleaned, raw_encounters

KEY_NUMERICAL = ["time_in_hospital", "num_lab_procedures", "num_procedures", "num_medications",
                 "number_outpatient", "number_emergency", "number_inpatient", "number_diagnoses"]
KEY_CATEGORICAL = ["age", "gender", "race", "diag_1_category", "diag_2_category", "diag_3_category"]
CLEAN_NUMERIC = ["admission_type_id", "discharge_disposition_id", "admission_source_id"] + KEY_NUMERICAL + [
    "diab_type", "diab_control", "diab_complication_binary", "meds_per_day", "procedures_per_day",
    "labs_per_day"]
CLEAN_STRINGS = ["race", "gender", "age", "diag_1", "diag_2", "diag_3", "A1Cresult"] + codes.MEDICATIONS + [
    "change", "diabetesMed", "readmitted", "diag_1_category", "diag_2_category", "diag_3_category",
    "diab_code", "diab_complication_categories"]


def nulled(spark, sf):
    return clean.null_if_marker(raw_encounters(spark, sf))


def union(parts):
    return " UNION ALL ".join(parts)


# --- profiling ----------------------------------------------------------------
@register("table_shape", O.LOADED + """
SELECT * FROM (VALUES (0, 'rows', CAST((SELECT count(*) FROM loaded) AS DOUBLE)), (1, 'columns', 50.0),
  (2, 'numeric_columns', 13.0), (3, 'string_columns', 37.0)) t(ord, metric, value)""")
def q_shape(spark, sf):
    return pf.table_shape(raw_encounters(spark, sf))


@register("head_rows", O.LOADED + " SELECT * FROM loaded ORDER BY encounter_id LIMIT 5")
def q_head(spark, sf):
    return pf.head_rows(raw_encounters(spark, sf))


def _describe_sql(cols, src):
    parts = []
    for c in cols:
        x = f"CAST({O.ident(c)} AS DOUBLE)"
        parts.append(f"SELECT {O.q(c)} AS \"column\", count({x}) AS count, round(avg({x}), 6) AS mean, "
                     f"round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, "
                     f"round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.5), 6) AS q50, "
                     f"round(quantile_cont({x}, 0.75), 6) AS q75, round(max({x}), 6) AS max FROM {src}")
    return union(parts)


@register("describe_numeric", O.CLEANED + " " + _describe_sql(CLEAN_NUMERIC + ["readmitted_binary"], "cleaned"))
def q_describe(spark, sf):
    return pf.describe_numeric(cleaned(spark, sf))


@register("distinct_counts", O.LOADED + " " + union(
    f"SELECT {O.q(c)} AS \"column\", count(DISTINCT {O.ident(c)}) AS n_distinct FROM loaded"
    for c in O.ENC_STRING_COLS))
def q_distinct(spark, sf):
    return pf.distinct_counts(raw_encounters(spark, sf))


@register("distinct_values", O.LOADED + " SELECT * FROM (" + union(
    f"SELECT {O.q(c)} AS \"column\", count(DISTINCT {O.ident(c)}) AS n_distinct, "
    f"string_agg(DISTINCT {O.ident(c)}, ', ' ORDER BY {O.ident(c)}) AS \"values\" FROM loaded"
    for c in O.ENC_STRING_COLS) + ") WHERE n_distinct <= 10")
def q_distinct_values(spark, sf):
    return pf.distinct_values(raw_encounters(spark, sf))


@register("value_counts_readmitted", O.LOADED + """
SELECT readmitted AS level, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct,
  row_number() OVER (ORDER BY count(*) DESC, readmitted) AS rank
FROM loaded WHERE readmitted IS NOT NULL GROUP BY readmitted""")
def q_value_counts(spark, sf):
    return pf.value_counts_pct(raw_encounters(spark, sf), "readmitted")


@register("imbalance_ratio", O.CLEANED + """
, a AS (SELECT sum(CASE WHEN readmitted_binary = 0 THEN 1 ELSE 0 END) AS n0,
               sum(CASE WHEN readmitted_binary = 1 THEN 1 ELSE 0 END) AS n1, count(*) AS n FROM cleaned)
SELECT * FROM (SELECT 0 AS ord, 'n_0' AS metric, CAST(n0 AS DOUBLE) AS value FROM a
  UNION ALL SELECT 1, 'n_1', n1 FROM a UNION ALL SELECT 2, 'share_0', round(n0 / n, 6) FROM a
  UNION ALL SELECT 3, 'share_1', round(n1 / n, 6) FROM a
  UNION ALL SELECT 4, 'ratio_0_to_1', round(n0 / nullif(n1, 0), 6) FROM a)""")
def q_imbalance(spark, sf):
    return pf.imbalance_ratio(cleaned(spark, sf))


@register("missing_profile", O.NULLED + " SELECT * FROM (" + union(
    f"SELECT {O.q(c)} AS \"column\", CAST(sum(CASE WHEN {O.ident(c)} IS NULL THEN 1 ELSE 0 END) AS BIGINT) "
    f"AS n_missing, round(sum(CASE WHEN {O.ident(c)} IS NULL THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS pct "
    f"FROM nulled" for c in O.ENC_COLS) + ") WHERE n_missing > 0")
def q_missing(spark, sf):
    return pf.missing_profile(nulled(spark, sf))


@register("marker_profile", O.LOADED + " SELECT * FROM (" + union(
    f"SELECT {O.q(c)} AS \"column\", CAST(coalesce(sum(CASE WHEN {O.ident(c)} = '?' THEN 1 ELSE 0 END), 0) "
    f"AS BIGINT) AS n_marker, round(coalesce(sum(CASE WHEN {O.ident(c)} = '?' THEN 1 ELSE 0 END), 0) * 100.0 "
    f"/ count(*), 6) AS pct FROM loaded" for c in O.ENC_STRING_COLS) + ") WHERE n_marker > 0")
def q_marker_profile(spark, sf):
    return pf.marker_profile(raw_encounters(spark, sf))


@register("top_diagnosis_codes", O.NULLED + """
, p AS (""" + union(f"SELECT 'diag_{i}' AS \"column\", diag_{i} AS value FROM nulled" for i in (1, 2, 3)) + """),
c AS (SELECT "column", value, count(*) AS n FROM p WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM c)
WHERE rank <= 10""")
def q_top_codes(spark, sf):
    return pf.top_codes(nulled(spark, sf))


@register("top_categories", O.CLEANED + """
, p AS (""" + union(f"SELECT {O.q(c)} AS \"column\", CAST({O.ident(c)} AS VARCHAR) AS value FROM cleaned"
                    for c in KEY_CATEGORICAL) + """),
c AS (SELECT "column", value, count(*) AS n FROM p WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT "column", count(*) OVER (PARTITION BY "column") AS n_distinct,
        row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, value, n FROM c)
SELECT "column", n_distinct, rank, value, n, round(n * 100.0 / (SELECT count(*) FROM cleaned), 6) AS pct
FROM r WHERE rank <= 3""")
def q_top_categories(spark, sf):
    return pf.top_categories(cleaned(spark, sf, KEY_CATEGORICAL), KEY_CATEGORICAL)


@register("entity_summary", O.LOADED + """
, per AS (SELECT patient_nbr, count(encounter_id) AS k FROM loaded GROUP BY patient_nbr)
SELECT * FROM (SELECT 0 AS ord, 'encounters' AS metric, CAST(sum(k) AS DOUBLE) AS value FROM per
 UNION ALL SELECT 1, 'patients', count(*) FROM per
 UNION ALL SELECT 2, 'repeat_encounters', sum(k) - count(*) FROM per
 UNION ALL SELECT 3, 'mean_per_patient', round(avg(k), 6) FROM per
 UNION ALL SELECT 4, 'patients_with_repeats', sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) FROM per
 UNION ALL SELECT 5, 'max_per_patient', max(k) FROM per)""")
def q_entity(spark, sf):
    return pf.entity_summary(raw_encounters(spark, sf))


@register("encounters_per_patient", O.LOADED + """
SELECT n_encounters, count(*) AS n_patients FROM (SELECT patient_nbr, count(*) AS n_encounters
FROM loaded GROUP BY patient_nbr) GROUP BY n_encounters""")
def q_per_patient(spark, sf):
    return pf.encounters_per_entity_distribution(raw_encounters(spark, sf))


@register("ever_positive_rate", O.LOADED + """
SELECT round(avg(m), 6) AS ever_positive_rate, count(*) AS patients FROM (
  SELECT patient_nbr, max(CAST(readmitted = '<30' AS INTEGER)) AS m FROM loaded GROUP BY patient_nbr)""")
def q_ever(spark, sf):
    from ..operators.features import binary_target
    return pf.ever_positive_rate(binary_target(raw_encounters(spark, sf)))


@register("frequency_time_in_hospital", O.LOADED + """
SELECT time_in_hospital AS value, count(*) AS n FROM loaded GROUP BY time_in_hospital""")
def q_freq(spark, sf):
    return pf.frequency_table(raw_encounters(spark, sf), "time_in_hospital")


@register("histogram_lab_procedures", O.CLEANED + """
, s AS (SELECT min(CAST(num_lab_procedures AS DOUBLE)) AS lo, max(CAST(num_lab_procedures AS DOUBLE)) AS hi,
          median(CAST(num_lab_procedures AS DOUBLE)) AS med FROM cleaned),
b AS (SELECT CAST(CASE WHEN s.hi = s.lo THEN 0 ELSE least(floor((CAST(num_lab_procedures AS DOUBLE) - s.lo)
          / ((s.hi - s.lo) / 30)), 29) END AS INTEGER) AS bin FROM cleaned, s WHERE num_lab_procedures IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT g.bin, round(s.lo + g.bin * ((s.hi - s.lo) / 30), 6) AS bin_lo,
  round(s.lo + (g.bin + 1) * ((s.hi - s.lo) / 30), 6) AS bin_hi, coalesce(c.n, 0) AS n,
  round(s.med, 6) AS median
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(0, 30)) g CROSS JOIN s LEFT JOIN c ON g.bin = c.bin""")
def q_hist(spark, sf):
    return pf.histogram(cleaned(spark, sf, ["num_lab_procedures"]), "num_lab_procedures", 30)


@register("box_stats_medications", O.CLEANED + """
, q AS (SELECT quantile_cont(CAST(num_medications AS DOUBLE), 0.25) AS q1,
          quantile_cont(CAST(num_medications AS DOUBLE), 0.5) AS median,
          quantile_cont(CAST(num_medications AS DOUBLE), 0.75) AS q3 FROM cleaned),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM q)
SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
  round(lo_fence, 6) AS lo_fence, round(hi_fence, 6) AS hi_fence,
  round(min(CASE WHEN x BETWEEN lo_fence AND hi_fence THEN x END), 6) AS whisker_lo,
  round(max(CASE WHEN x BETWEEN lo_fence AND hi_fence THEN x END), 6) AS whisker_hi,
  CAST(sum(CASE WHEN x BETWEEN lo_fence AND hi_fence THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM (SELECT CAST(num_medications AS DOUBLE) AS x FROM cleaned WHERE num_medications IS NOT NULL), f
GROUP BY q1, median, q3, iqr, lo_fence, hi_fence""")
def q_box(spark, sf):
    return pf.box_stats(cleaned(spark, sf, ["num_medications"]), "num_medications")


def _profile_sql(cols, src):
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({O.ident(c)} AS DOUBLE)"
        parts.append(f"SELECT {i} AS ord, {O.q(c)} AS \"column\", round(avg({x}), 6) AS mean, "
                     f"round(median({x}), 6) AS median, round(stddev_samp({x}), 6) AS std, "
                     f"round(min({x}), 6) AS min, round(max({x}), 6) AS max, "
                     f"round(CASE WHEN count({x}) > 2 THEN skewness({x}) END, 6) AS skew FROM {src}")
    return union(parts)


@register("numeric_profile", O.CLEANED + " " + _profile_sql(KEY_NUMERICAL, "cleaned"))
def q_numeric_profile(spark, sf):
    return pf.numeric_profile(cleaned(spark, sf, KEY_NUMERICAL), KEY_NUMERICAL)


@register("skewed_columns", O.CLEANED + " SELECT ord, \"column\", skew FROM (" + _profile_sql(
    KEY_NUMERICAL, "cleaned") + ") WHERE abs(skew) > 1")
def q_skewed(spark, sf):
    return pf.skewed_columns(cleaned(spark, sf, KEY_NUMERICAL), KEY_NUMERICAL)


@register("dataset_summary", O.LOADED + """
, a AS (SELECT count(*) AS n, count(DISTINCT patient_nbr) AS p,
    avg(CASE WHEN readmitted = '<30' THEN 1.0 ELSE 0.0 END) * 100 AS r,
    """ + " + ".join(f"sum(CASE WHEN {O.ident(c)} IS NULL THEN 1 ELSE 0 END)" for c in O.ENC_COLS) + """ AS m
  FROM loaded)
SELECT * FROM (SELECT 0 AS ord, 'total_records' AS metric, CAST(n AS DOUBLE) AS value FROM a
 UNION ALL SELECT 1, 'total_features', 51 FROM a UNION ALL SELECT 2, 'numerical_features', 14 FROM a
 UNION ALL SELECT 3, 'categorical_features', 37 FROM a UNION ALL SELECT 4, 'missing_values', m FROM a
 UNION ALL SELECT 5, 'duplicate_patients', n - p FROM a
 UNION ALL SELECT 6, 'readmission_lt30_pct', round(r, 6) FROM a)""")
def q_dataset_summary(spark, sf):
    return pf.dataset_summary(raw_encounters(spark, sf))


@register("eda_summary", O.CLEANED + """
, a AS (SELECT count(*) AS n, sum(CASE WHEN readmitted_binary = 0 THEN 1 ELSE 0 END) AS n0,
               sum(CASE WHEN readmitted_binary = 1 THEN 1 ELSE 0 END) AS n1 FROM cleaned)
SELECT * FROM (SELECT 0 AS ord, 'total_patients' AS metric, CAST(n AS DOUBLE) AS value FROM a
 UNION ALL SELECT 1, 'numerical_features', 19 FROM a UNION ALL SELECT 2, 'categorical_features', 38 FROM a
 UNION ALL SELECT 3, 'target_class_0', n0 FROM a UNION ALL SELECT 4, 'target_class_1', n1 FROM a
 UNION ALL SELECT 5, 'imbalance_ratio', round(n0 / nullif(n1, 0), 6) FROM a)""")
def q_eda(spark, sf):
    return pf.eda_summary(cleaned(spark, sf))


# --- cohort statistics ----------------------------------------------------------
@register("rate_by_age", O.CLEANED + """
SELECT age, count(*) AS n, round(avg(readmitted_binary) * 100, 6) AS rate FROM cleaned GROUP BY age""")
def q_rate_age(spark, sf):
    return st.rate_by(cleaned(spark, sf, ["age", codes.TARGET]), "age")


@register("rate_by_time_in_hospital", O.CLEANED + """
SELECT time_in_hospital, count(*) AS n, round(avg(readmitted_binary) * 100, 6) AS rate
FROM cleaned GROUP BY time_in_hospital""")
def q_rate_stay(spark, sf):
    return st.rate_by(cleaned(spark, sf, ["time_in_hospital", codes.TARGET]), "time_in_hospital")


@register("rate_by_medication_bins", O.CLEANED + """
, b AS (SELECT CASE WHEN num_medications > 0 AND num_medications <= 5 THEN '1-5'
       WHEN num_medications > 5 AND num_medications <= 10 THEN '6-10'
       WHEN num_medications > 10 AND num_medications <= 15 THEN '11-15'
       WHEN num_medications > 15 AND num_medications <= 20 THEN '16-20'
       WHEN num_medications > 20 AND num_medications <= 100 THEN '20+' END AS bin, readmitted_binary FROM cleaned),
c AS (SELECT bin, count(*) AS n, avg(readmitted_binary) AS r FROM b WHERE bin IS NOT NULL GROUP BY bin)
SELECT l.bin, CAST(l.bin_order AS INTEGER) AS bin_order, coalesce(c.n, 0) AS n, round(c.r * 100, 6) AS rate
FROM (VALUES ('1-5', 0), ('6-10', 1), ('11-15', 2), ('16-20', 3), ('20+', 4)) l(bin, bin_order)
LEFT JOIN c ON l.bin = c.bin""")
def q_rate_bins(spark, sf):
    return st.rate_by_bins(cleaned(spark, sf))


@register("crosstab_rates_age", O.CLEANED + """
, a AS (SELECT age AS level, count(*) AS n, avg(CASE WHEN readmitted_binary = 1 THEN 1.0 ELSE 0.0 END) AS p1
        FROM cleaned GROUP BY age),
r AS (SELECT *, row_number() OVER (ORDER BY p1 DESC, level) AS rank FROM a)
SELECT level, n, rank, round(p1 * 100, 6) AS pct_1, round((1 - p1) * 100, 6) AS pct_0 FROM r WHERE rank <= 5""")
def q_crosstab(spark, sf):
    return st.crosstab_rates(cleaned(spark, sf), "age")


@register("riskiest_diagnosis", O.CLEANED + """
SELECT level, round(r * 100, 6) AS rate FROM (SELECT diag_1_category AS level, avg(readmitted_binary) AS r
FROM cleaned GROUP BY 1) ORDER BY r DESC, level LIMIT 1""")
def q_riskiest(spark, sf):
    return st.riskiest_level(cleaned(spark, sf, ["diag_1_category", codes.TARGET]), "diag_1_category")


def _moments_sql(cols):
    parts = []
    for c in cols:
        x = f"CAST({O.ident(c)} AS DOUBLE)"
        parts.append(f"SELECT {O.q(c)} AS feature, avg(CASE WHEN readmitted_binary = 1 THEN {x} END) AS m1, "
                     f"avg(CASE WHEN readmitted_binary = 0 THEN {x} END) AS m0, "
                     f"count(CASE WHEN readmitted_binary = 1 THEN {x} END) AS n1, "
                     f"count(CASE WHEN readmitted_binary = 0 THEN {x} END) AS n0, "
                     f"var_samp(CASE WHEN readmitted_binary = 1 THEN {x} END) AS v1, "
                     f"var_samp(CASE WHEN readmitted_binary = 0 THEN {x} END) AS v0 FROM cleaned")
    return union(parts)


@register("mean_difference", O.CLEANED + ", m AS (" + _moments_sql(KEY_NUMERICAL[:5]) + """)
SELECT feature, round(m1, 6) AS mean_1, round(m0, 6) AS mean_0, round(m1 - m0, 6) AS diff,
  round((m1 - m0) / nullif(m0, 0) * 100, 6) AS pct_diff FROM m""")
def q_mean_diff(spark, sf):
    return st.mean_difference(cleaned(spark, sf, [*KEY_NUMERICAL[:5], codes.TARGET]), KEY_NUMERICAL[:5])


@register("two_sample_t", O.CLEANED + ", m AS (" + _moments_sql(KEY_NUMERICAL) + """),
s AS (SELECT *, sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / nullif(n1 + n0 - 2, 0) * (1.0 / n1 + 1.0 / n0)) AS se FROM m)
SELECT feature, n1 AS n_1, n0 AS n_0, round((m1 - m0) / CASE WHEN se > 0 THEN se END, 6) AS t,
  CAST(n1 + n0 - 2 AS BIGINT) AS dof FROM s""")
def q_ttest(spark, sf):
    return st.two_sample_t(cleaned(spark, sf, [*KEY_NUMERICAL, "readmitted_binary"]), KEY_NUMERICAL)


CORR_COLS = [*CLEAN_NUMERIC, *([] if "readmitted_binary" in CLEAN_NUMERIC else ["readmitted_binary"])]


def _corr_sql(a, b):
    x, y = f"CAST({O.ident(a)} AS DOUBLE)", f"CAST({O.ident(b)} AS DOUBLE)"
    n, sx, sy = "count(*)", f"sum({x})", f"sum({y})"
    sxy, sxx, syy = f"sum({x} * {y})", f"sum({x} * {x})", f"sum({y} * {y})"
    vx, vy = f"({n} * {sxx} - {sx} * {sx})", f"({n} * {syy} - {sy} * {sy})"
    r = f"CASE WHEN {vx} > 0 AND {vy} > 0 THEN ({n} * {sxy} - {sx} * {sy}) / sqrt({vx} * {vy}) END"
    return f"round(CASE WHEN ({r}) IS NOT NULL THEN greatest(least({r}, 1.0), -1.0) END, 6)"


@register("correlation_matrix", O.CLEANED + " " + union(
    f"SELECT {O.q(a)} AS a, {O.q(b)} AS b, {_corr_sql(a, b)} AS corr FROM cleaned"
    for a in CORR_COLS for b in CORR_COLS))
def q_corr(spark, sf):
    return st.correlation_matrix(cleaned(spark, sf, CORR_COLS), CORR_COLS)


@register("target_correlation", O.CLEANED + ", c AS (" + union(
    f"SELECT {O.q(a)} AS feature, {_corr_sql(a, 'readmitted_binary')} AS corr FROM cleaned"
    for a in CLEAN_NUMERIC) + """)
SELECT feature, corr, abs(corr) AS abs_corr, row_number() OVER (ORDER BY abs(corr) DESC NULLS LAST, feature)
  AS rank FROM c""")
def q_target_corr(spark, sf):
    return st.target_correlation(cleaned(spark, sf, CORR_COLS), CLEAN_NUMERIC)


def _status_sql(cols, src="cleaned"):
    sel = ", ".join(cols)
    on = " AND ".join([f"g.{c} IS NOT DISTINCT FROM c.{c}" for c in cols] + ["g.status = c.status"])
    return f"""
, c AS (SELECT {sel}, readmitted_binary AS status, count(*) AS n FROM {src} GROUP BY {sel}, readmitted_binary),
t AS (SELECT {sel}, sum(n) AS total FROM c GROUP BY {sel}),
g AS (SELECT t.*, s.status FROM t CROSS JOIN (VALUES (0), (1)) s(status))
SELECT {", ".join("g." + c for c in cols)}, CAST(g.status AS INTEGER) AS status, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
  round(coalesce(c.n, 0) * 100.0 / g.total, 6) AS pct
FROM g LEFT JOIN c ON {on}"""


@register("status_by_type_control", O.CLEANED + _status_sql(["diab_type", "diab_control"]))
def q_status_tc(spark, sf):
    return st.slice_by_type_control(cleaned(spark, sf, ["diab_type", "diab_control", codes.TARGET]))


@register("status_by_complication", O.CLEANED + _status_sql(["diab_type", "diab_complication_categories"]))
def q_status_comp(spark, sf):
    return st.slice_by_complication(cleaned(spark, sf, ["diab_type", "diab_complication_categories", codes.TARGET]), per_type=True)


@register("status_by_insulin_change", O.CLEANED + _status_sql(["diab_type", "insulin"]))
def q_status_insulin(spark, sf):
    return st.slice_by_medication_change(cleaned(spark, sf, ["diab_type", *codes.MEDICATIONS, codes.TARGET]), "insulin")


def _grp(name, cols):
    arr = "[" + ", ".join(O.ident(c) for c in cols if c not in codes.CONSTANT_MEDICATIONS or True) + "]"
    act = f"list_distinct(list_filter({arr}, lambda x: x <> 'No'))"
    return (f"CASE WHEN len({act}) = 0 THEN 'No' WHEN len({act}) = 1 THEN {act}[1] "
            f"ELSE 'Multiple changes' END AS {name}")


def _register_group(name, group):
    @register(name, O.CLEANED + ", gc AS (SELECT *, " + _grp(group, codes.DRUG_GROUPS[group]) + " FROM cleaned)" + _status_sql(["diab_type", group], "gc"))
    def run(spark, sf):
        return st.slice_by_medication_change(cleaned(spark, sf, ["diab_type", *codes.MEDICATIONS, codes.TARGET]), group)


for _group in codes.DRUG_GROUPS:
    _register_group("status_by_drug_group_change" if _group == "insulin_production_change" else f"status_by_{_group}", _group)


def _round6(df, *but):
    return df.select(*[c if c in but else F.round(c, 6).alias(c) for c in df.columns])


def _odds_sql(col):
    """Closed-form odds of one categorical column, with the two-sided normal
    p-value by the same Chebyshev form of erfc."""
    return f"""(WITH c AS (SELECT CAST({col} AS VARCHAR) AS level, sum(CASE WHEN readmitted_binary = 1 THEN 1 ELSE 0 END) AS pos,
          sum(CASE WHEN readmitted_binary = 0 THEN 1 ELSE 0 END) AS neg FROM cleaned WHERE {col} IS NOT NULL GROUP BY 1),
r AS (SELECT level AS ref_level, pos AS rp, neg AS rn FROM c ORDER BY level LIMIT 1),
j AS (SELECT c.*, r.* FROM c CROSS JOIN r),
k AS (SELECT level = ref_level AS is_ref, level, pos > 0 AND neg > 0 AND rp > 0 AND rn > 0 AS ok,
        ln(pos / neg) AS lo, ln(rp / rn) AS rlo, pos, neg, rp, rn FROM j),
e AS (SELECT CASE WHEN is_ref THEN 'Intercept' ELSE '{col}[T.' || level || ']' END AS term,
        CASE WHEN ok THEN CASE WHEN is_ref THEN rlo ELSE lo - rlo END END AS coef,
        CASE WHEN ok THEN CASE WHEN is_ref THEN sqrt(1.0 / rp + 1.0 / rn)
             ELSE sqrt(1.0 / pos + 1.0 / neg + 1.0 / rp + 1.0 / rn) END END AS se FROM k)
SELECT '{col}' AS feature, term, round(coef, 6) AS coef, round(exp(coef), 6) AS odds_ratio,
  round(exp(coef - 1.96 * se), 6) AS or_ci_low, round(exp(coef + 1.96 * se), 6) AS or_ci_high,
  round(se, 6) AS stderr, round(coef / se, 6) AS z, round(p, 6) AS p_value,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p IS NOT NULL THEN 'ns' END AS flag
FROM (SELECT *, u * exp(-x * x - 1.26551223 + u * (1.00002368 + u * (0.37409196 + u * (0.09678418 + u * (-0.18628806 + u * (
  0.27886807 + u * (-1.13520398 + u * (1.48851587 + u * (-0.82215223 + u * 0.17087277))))))))) AS p
  FROM (SELECT *, abs(coef / se) / sqrt(2.0) AS x, 1.0 / (1.0 + 0.5 * abs(coef / se) / sqrt(2.0)) AS u FROM e)))"""


#: categorical predictors of the study's odds table
ODDS_COLS = ["race", "gender", "age", "A1Cresult", "insulin", "change", "diabetesMed", "diag_1_category", "diag_2_category",
             "diag_3_category", "diab_complication_categories"]


@register("odds_ratios_categorical", O.CLEANED + " " + " UNION ALL ".join("SELECT * FROM " + _odds_sql(O.ident(c)).replace(f"'{O.ident(c)}", f"'{c}")
                                                                         for c in ODDS_COLS))
def q_odds_all(spark, sf):
    """Odds table over all categorical candidates, with p-values and stars."""
    c = cleaned(spark, sf, [*ODDS_COLS, "readmitted_binary"])
    out = None
    for col in ODDS_COLS:
        t = st.with_z_pvalues(st.univariate_odds_categorical(c, col))
        out = t if out is None else out.unionByName(t)
    return _round6(out, "feature", "term", "flag")


@register("odds_ratio_by_age", O.CLEANED + """
, c AS (SELECT age AS level, sum(CASE WHEN readmitted_binary = 1 THEN 1 ELSE 0 END) AS pos,
          sum(CASE WHEN readmitted_binary = 0 THEN 1 ELSE 0 END) AS neg FROM cleaned WHERE age IS NOT NULL GROUP BY age),
r AS (SELECT level AS ref_level, pos AS rp, neg AS rn FROM c ORDER BY level LIMIT 1),
j AS (SELECT c.*, r.* FROM c CROSS JOIN r),
k AS (SELECT level = ref_level AS is_ref, level, pos > 0 AND neg > 0 AND rp > 0 AND rn > 0 AS ok,
        ln(pos / neg) AS lo, ln(rp / rn) AS rlo, pos, neg, rp, rn FROM j),
e AS (SELECT CASE WHEN is_ref THEN 'Intercept' ELSE 'age[T.' || level || ']' END AS term,
        CASE WHEN ok THEN CASE WHEN is_ref THEN rlo ELSE lo - rlo END END AS coef,
        CASE WHEN ok THEN CASE WHEN is_ref THEN sqrt(1.0 / rp + 1.0 / rn)
             ELSE sqrt(1.0 / pos + 1.0 / neg + 1.0 / rp + 1.0 / rn) END END AS se FROM k)
SELECT 'age' AS feature, term, round(coef, 6) AS coef, round(exp(coef), 6) AS odds_ratio,
  round(exp(coef - 1.96 * se), 6) AS or_ci_low, round(exp(coef + 1.96 * se), 6) AS or_ci_high,
  round(se, 6) AS stderr, round(coef / se, 6) AS z FROM e""")
def q_odds(spark, sf):
    return _round6(st.univariate_odds_categorical(cleaned(spark, sf, ["age", "readmitted_binary"]), "age"), "feature", "term")


@register("collapse_rare_diagnoses", O.CLEANED + """
, s AS (SELECT diag_1 AS lvl FROM cleaned GROUP BY diag_1 HAVING count(*) / (SELECT count(*) FROM cleaned) >= 0.01)
SELECT encounter_id, CASE WHEN diag_1 IS NULL OR diag_1 IN (SELECT lvl FROM s) THEN diag_1 ELSE 'Other' END AS diag_1
FROM cleaned""")
def q_collapse(spark, sf):
    return st.collapse_rare_levels(cleaned(spark, sf, ["encounter_id", "diag_1"]), ["diag_1"])


@register("collapse_rare_three_diagnoses", O.CLEANED + """
, n AS (SELECT count(*) * 0.01 AS least FROM cleaned)
, s AS (SELECT diag, lvl FROM (UNPIVOT (SELECT diag_1, diag_2, diag_3 FROM cleaned) ON diag_1, diag_2, diag_3 INTO NAME diag VALUE lvl)
        GROUP BY diag, lvl HAVING count(*) >= (SELECT least FROM n))
SELECT encounter_id, """ + ", ".join(
    f"CASE WHEN {c} IS NULL OR {c} IN (SELECT lvl FROM s WHERE diag = '{c}') THEN {c} ELSE 'Other' END AS {c}"
    for c in ("diag_1", "diag_2", "diag_3")) + " FROM cleaned")
def q_collapse_three(spark, sf):
    cols = ["diag_1", "diag_2", "diag_3"]
    return st.collapse_rare_levels(cleaned(spark, sf, ["encounter_id", *cols]), cols)
