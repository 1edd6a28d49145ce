"""Registered queries, part 6: report tables built from other results
(#75 key insights, #118 feature summary) and the indexed-categorical
network (#135)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from ..operators import balance as bal, encode as enc, models as ml, profile as pf
from . import oracle_sql as O
from .pipeline import cleaned, engineer
from .queries_models import MODEL_FEATURES
from .queries_profile import CLEAN_NUMERIC, KEY_NUMERICAL, _corr_sql, _profile_sql, union
from .registry import register


def _corr_union(cols, src):
    return union(f"SELECT {O.q(a)} AS feature, {_corr_sql(a, 'readmitted_binary')} AS corr FROM {src}"
                 for a in cols)


@register("key_insights", O.CLEANED + f"""
, r AS (SELECT sum(CASE WHEN readmitted_binary = 0 THEN 1 ELSE 0 END)::DOUBLE
          / nullif(sum(CASE WHEN readmitted_binary = 1 THEN 1 ELSE 0 END), 0) AS ratio FROM cleaned),
tc AS (SELECT feature, row_number() OVER (ORDER BY abs(corr) DESC NULLS LAST, feature) AS rank
       FROM ({_corr_union(CLEAN_NUMERIC, "cleaned")})),
sk AS (SELECT * FROM ({_profile_sql(CLEAN_NUMERIC, "cleaned")}) WHERE abs(skew) > 1 ORDER BY ord LIMIT 3),
ra AS (SELECT age AS level FROM cleaned GROUP BY age ORDER BY avg(readmitted_binary) DESC, age LIMIT 1),
rd AS (SELECT diag_1_category AS level FROM cleaned GROUP BY diag_1_category
       ORDER BY avg(readmitted_binary) DESC, diag_1_category LIMIT 1)
SELECT 1 AS n, '1. Class imbalance ratio: 1:' || printf('%.1f', ratio) || ' - SMOTE recommended' AS insight FROM r
UNION ALL SELECT 2, '2. Top 3 predictive features: ' || string_agg(feature, ', ' ORDER BY rank) FROM tc WHERE rank <= 3
UNION ALL SELECT 3, '3. Skewed features requiring transformation: ' || string_agg("column", ', ' ORDER BY ord)
  FROM sk HAVING count(*) > 0
UNION ALL SELECT 4, '4. Highest readmission risk age group: ' || level FROM ra
UNION ALL SELECT 5, '5. Highest readmission risk diagnosis: ' || level FROM rd""")
def q_insights(spark, sf):
    return pf.key_insights(cleaned(spark, sf), CLEAN_NUMERIC)


#: families of the engineered features
RATE_FEATURES = ["meds_per_day", "procedures_per_day", "labs_per_day", "total_prior_visits", "high_utilizer"]
SQUARED_FEATURES = ["time_in_hospital", "num_medications", "num_lab_procedures"]
FLAG_FEATURES = ["A1C_tested", "diabetes_med_changed", "on_diabetes_med", "long_stay", "many_medications", "complex_case"]


def _columns_sql(table, where="true"):
    return f"(SELECT CAST(count(*) AS DOUBLE) FROM (SELECT unnest(json_keys(to_json(x))) AS k FROM (SELECT * FROM {table} LIMIT 1) x) WHERE {where})"


@register("feature_summary", O.FEATURED + f"""
, sel AS (SELECT count(*) AS k FROM ({_corr_union(MODEL_FEATURES, "featured")}) WHERE abs(corr) > 0.01)
SELECT * FROM (SELECT 0 AS ord, 'original_features' AS metric, {_columns_sql("cleaned")} AS value
  UNION ALL SELECT 1, 'interaction_features', {_columns_sql("featured", f"k IN ({', '.join(O.q(c) for c in RATE_FEATURES)})")}
  UNION ALL SELECT 2, 'polynomial_features', {_columns_sql("cleaned", f"k IN ({', '.join(O.q(c) for c in SQUARED_FEATURES)})")}
  UNION ALL SELECT 3, 'binary_indicator_features', {_columns_sql("featured", f"k IN ({', '.join(O.q(c) for c in FLAG_FEATURES)})")}
  UNION ALL SELECT 4, 'after_encoding', {_columns_sql("featured", f"k IN ({', '.join(O.q(c) for c in MODEL_FEATURES)})")}
  UNION ALL SELECT 5, 'after_selection', CAST(k AS DOUBLE) FROM sel
  UNION ALL SELECT 6, 'reduction_percentage', round(({len(MODEL_FEATURES)} - k) * 100.0 / {len(MODEL_FEATURES)}, 6)
    FROM sel)""")
def q_feature_summary(spark, sf):
    c = cleaned(spark, sf)
    f = engineer(c)
    families = [sum(x in RATE_FEATURES for x in f.columns), sum(x.endswith("_squared") for x in f.columns), sum(x in FLAG_FEATURES for x in f.columns)]
    sel = enc.select_by_correlation(f, MODEL_FEATURES, 0.01)
    return enc.feature_summary(len(c.columns), *families, len(MODEL_FEATURES), sel)


NN_CATEGORICAL = ["age", "race", "gender", "diag_1_category", "A1Cresult"]


@register("neural_network_indexed")
def q_neural_indexed(spark, sf):
    c = bal.stratified_split(cleaned(spark, sf, ["encounter_id", *NN_CATEGORICAL, *KEY_NUMERICAL, codes.TARGET]), 0.2)
    data = c.select("encounter_id", "split", *NN_CATEGORICAL,
                    *[F.col(x).cast("double").alias(x) for x in KEY_NUMERICAL],
                    F.col(codes.TARGET).cast("double").alias("label"))
    train = bal.undersample(data.filter(F.col("split") == "train").withColumn("_y", F.col("label").cast("int")),
                            1.0, label="_y").drop("_y")
    model = ml.fit_neural_indexed(train, NN_CATEGORICAL, KEY_NUMERICAL)
    return ml.score(model, data.filter(F.col("split") == "test"))
