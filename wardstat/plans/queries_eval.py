"""Registered queries, part 3: evaluation (#92-#103), encoding and selection
(#106-#118), splitting and balancing (#119-#129)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from ..functions.columns import r6
from ..operators import balance as bal, encode as enc, evaluate as ev, stats as st
from ..session import cut_lineage
from . import oracle_sql as O
from .registry import register
from .pipeline import cleaned, raw_encounters, scored
from .queries_profile import KEY_NUMERICAL, union

S = O.SCORED
G = """
, g AS (SELECT score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
          CAST(sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM scored GROUP BY score),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM g),
c AS (SELECT score, pos, neg, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS cum_pos,
        CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS cum_neg, tot.P, tot.N FROM g, tot)"""

CM = """
, cm AS (SELECT CAST(sum(CASE WHEN label <> 1 AND score < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN label <> 1 AND score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN label = 1 AND score < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN label = 1 AND score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM scored)"""


@register("confusion_matrix", S + CM + " SELECT tn, fp, fn, tp FROM cm")
def q_cm(spark, sf):
    return ev.confusion_matrix(scored(spark, sf), 0.5)


@register("binary_metrics", S + CM + """
, m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM cm)
SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM m""")
def q_metrics(spark, sf):
    return ev.binary_metrics(scored(spark, sf), 0.5)


@register("pr_curve", S + G + """
SELECT score AS threshold, round(cum_pos / (cum_pos + cum_neg), 6) AS precision, round(cum_pos / P, 6) AS recall,
  cum_pos AS tp, cum_neg AS fp FROM c WHERE cum_pos - pos < P""")
def q_pr(spark, sf):
    return ev.pr_curve(scored(spark, sf))


PR_POINTS_SQL = S + G + """
SELECT score AS threshold, round(cum_pos / (cum_pos + cum_neg), 6) AS precision, round(cum_pos / P, 6) AS recall
FROM c WHERE cum_pos - pos < P"""


@register("average_precision", S + G + """
SELECT round(sum(pos * (cum_pos / (cum_pos + cum_neg))) / max(P), 6) AS average_precision FROM c""")
def q_ap(spark, sf):
    return ev.average_precision(scored(spark, sf))


@register("pr_auc", S + G + """
SELECT round(sum(pos * (cum_pos / (cum_pos + cum_neg) + CASE WHEN cum_pos - pos + cum_neg - neg = 0 THEN 1.0
  ELSE (cum_pos - pos) / (cum_pos - pos + cum_neg - neg) END) / 2) / max(P), 6) AS pr_auc FROM c""")
def q_prauc(spark, sf):
    return ev.pr_auc(scored(spark, sf))


@register("roc_curve", S + G + """
SELECT score AS threshold, round(cum_neg / N, 6) AS fpr, round(cum_pos / P, 6) AS tpr FROM c""")
def q_roc(spark, sf):
    return ev.roc_curve(scored(spark, sf))


@register("roc_auc", S + G + """
SELECT round(sum(pos * (coalesce((SELECT sum(neg) FROM g g2 WHERE g2.score < c.score), 0) + neg / 2.0)) / (max(P) * max(N)), 6)
  AS roc_auc FROM c""")
def q_auc(spark, sf):
    return ev.roc_auc(scored(spark, sf))


SWEEP = S + """
, grid AS (SELECT CAST(round(0.1 + range * 0.05, 10) AS DOUBLE) AS threshold FROM range(16)),
sw AS (SELECT threshold, CAST(sum(CASE WHEN label = 1 AND score > threshold THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN label <> 1 AND score > threshold THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN label = 1 AND NOT score > threshold THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM grid CROSS JOIN scored GROUP BY threshold),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM sw),
res AS (SELECT threshold, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM m)"""


@register("threshold_sweep", SWEEP + " SELECT * FROM res")
def q_sweep(spark, sf):
    return ev.threshold_sweep(scored(spark, sf), 0.1, 0.9, 0.05)


@register("best_sweep_threshold", SWEEP + " SELECT threshold, f1 FROM res ORDER BY f1 DESC, threshold LIMIT 1")
def q_best_sweep(spark, sf):
    return ev.best_of_sweep(ev.threshold_sweep(scored(spark, sf), 0.1, 0.9, 0.05))


@register("best_f1_threshold", S + G + """
, f AS (SELECT score AS threshold, 2 * (cum_pos / (cum_pos + cum_neg)) * (cum_pos / P)
          / ((cum_pos / (cum_pos + cum_neg)) + (cum_pos / P) + 1e-9) AS f1 FROM c WHERE cum_pos - pos < P)
SELECT threshold, round(f1, 6) AS f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1""")
def q_best_f1(spark, sf):
    return ev.best_f1_threshold(scored(spark, sf))


@register("classification_report", S + CM + """
, d AS (SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn,
          CAST(tn AS DOUBLE) AS tn FROM cm),
m AS (SELECT coalesce(tp / nullif(tp + fp, 0), 0.0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r1,
        coalesce(tn / nullif(tn + fn, 0), 0.0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0.0) AS r0,
        tp + fn AS s1, tn + fp AS s0 FROM d),
f AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1,
        CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0 FROM m)
SELECT * FROM (
  SELECT 0 AS ord, '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1,
    CAST(s0 AS BIGINT) AS support FROM f
  UNION ALL SELECT 1, '1', round(p1, 6), round(r1, 6), round(f1, 6), CAST(s1 AS BIGINT) FROM f
  UNION ALL SELECT 2, 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6),
    CAST(s0 + s1 AS BIGINT) FROM f
  UNION ALL SELECT 3, 'weighted avg', round((p0 * s0 + p1 * s1) / (s0 + s1), 6),
    round((r0 * s0 + r1 * s1) / (s0 + s1), 6), round((f0 * s0 + f1 * s1) / (s0 + s1), 6),
    CAST(s0 + s1 AS BIGINT) FROM f)""")
def q_report(spark, sf):
    return ev.classification_report(scored(spark, sf))


def two_models(spark, sf):
    c = cleaned(spark, sf)
    a = c.select(F.lit("stay_visits").alias("model"), F.col("encounter_id").alias("key"),
                 F.col(codes.TARGET).alias("label"),
                 ((F.least("number_inpatient", F.lit(5)) * 10 + F.least("time_in_hospital", F.lit(14))
                   + F.col("number_diagnoses")) / F.lit(80.0)).alias("score"))
    b = c.select(F.lit("emergency_meds").alias("model"), F.col("encounter_id").alias("key"),
                 F.col(codes.TARGET).alias("label"),
                 ((F.least("number_emergency", F.lit(4)) * 10 + F.least("num_medications", F.lit(60)))
                  / F.lit(100.0)).alias("score"))
    return a.unionByName(b)


TWO_SCORES = O.CLEANED + """
, sm AS (SELECT 'stay_visits' AS model, encounter_id AS key, readmitted_binary AS label,
    (least(number_inpatient, 5) * 10 + least(time_in_hospital, 14) + number_diagnoses) / 80.0 AS score FROM cleaned
  UNION ALL SELECT 'emergency_meds', encounter_id, readmitted_binary,
    (least(number_emergency, 4) * 10 + least(num_medications, 60)) / 100.0 FROM cleaned)"""
TWO = TWO_SCORES + """,
cm AS (SELECT model, sum(CASE WHEN label <> 1 AND score < 0.5 THEN 1 ELSE 0 END) AS tn,
  sum(CASE WHEN label <> 1 AND score >= 0.5 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN label = 1 AND score < 0.5 THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN label = 1 AND score >= 0.5 THEN 1 ELSE 0 END) AS tp FROM sm GROUP BY model),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM cm),
gs AS (SELECT model, score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
         sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS neg FROM sm GROUP BY model, score),
gb AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
         AND 1 PRECEDING), 0) AS below FROM gs),
auc AS (SELECT model, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc FROM gb GROUP BY model),
mc AS (SELECT m.model, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(p, 6) AS precision,
  round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1,
  round(auc.roc_auc, 6) AS roc_auc FROM m JOIN auc ON m.model = auc.model),
rk AS (SELECT *, CAST(row_number() OVER (ORDER BY f1 DESC, model) AS INTEGER) AS rank FROM mc)"""


@register("model_comparison", TWO + " SELECT *, CAST(rank = 1 AS INTEGER) AS is_best FROM rk")
def q_compare(spark, sf):
    return ev.model_comparison(two_models(spark, sf))


@register("melt_metrics", TWO + """
SELECT model, metric, value FROM (UNPIVOT (SELECT model, accuracy, precision, recall, f1 FROM rk)
  ON accuracy, precision, recall, f1 INTO NAME metric VALUE value)""")
def q_melt(spark, sf):
    mc = ev.model_comparison(two_models(spark, sf))
    return ev.melt_metrics(mc.select("model", "accuracy", "precision", "recall", "f1"), ["model"],
                           ["accuracy", "precision", "recall", "f1"])


# --- encoding and selection --------------------------------------------------------
RACE_LEVELS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]  # first sorted level dropped


@register("one_hot_race_gender", O.CLEANED + " SELECT encounter_id, " + ", ".join(
    f"CAST(coalesce(race = '{v}', false) AS INTEGER) AS race_{v}" for v in RACE_LEVELS)
    + ", CAST(coalesce(gender = 'Male', false) AS INTEGER) AS \"gender_Male\" FROM cleaned")
def q_onehot(spark, sf):
    return enc.one_hot(cleaned(spark, sf, ["encounter_id", "race", "gender"]), ["race", "gender"])


SPARSE_COLS = ["diag_1", "diag_2", "diag_3"]


@register("one_hot_sparse_diagnoses", O.CLEANED + """
, l AS (""" + union(f"SELECT DISTINCT {i} AS c, {c} AS level FROM cleaned" for i, c in enumerate(SPARSE_COLS)) + """),
r AS (SELECT c, level, CAST(row_number() OVER (ORDER BY c, level) - 1 AS INTEGER) AS place FROM l WHERE level IS NOT NULL)
""" + union(f"SELECT encounter_id, place FROM cleaned JOIN r ON r.c = {i} AND r.level = cleaned.{c}" for i, c in enumerate(SPARSE_COLS)))
def q_onehot_sparse(spark, sf):
    c = cleaned(spark, sf, ["encounter_id", *SPARSE_COLS])
    return enc.one_hot_active(c, SPARSE_COLS).select("encounter_id", F.explode("active").alias("place"))


@register("label_index_age", O.CLEANED + """
SELECT encounter_id, age, CAST(dense_rank() OVER (ORDER BY age) - 1 AS INTEGER) AS age_idx FROM cleaned""")
def q_label_index(spark, sf):
    return enc.label_index(cleaned(spark, sf, ["encounter_id", "age"]), "age")


SCALE_COLS = ["time_in_hospital", "num_medications", "number_inpatient"]


@register("standard_scale", O.CLEANED + ", s AS (SELECT " + ", ".join(
    f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in SCALE_COLS)
    + " FROM cleaned) SELECT encounter_id, " + ", ".join(
    f"round((CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END, 6) AS {c}" for c in SCALE_COLS)
    + " FROM cleaned, s")
def q_scale(spark, sf):
    df = enc.standard_scale(cleaned(spark, sf, ["encounter_id", *SCALE_COLS]), SCALE_COLS)
    return df.select("encounter_id", *[r6(F.col(c)).alias(c) for c in SCALE_COLS])


@register("frequency_encode_diag", O.CLEANED + """
SELECT encounter_id, diag_1_category, count(*) OVER (PARTITION BY diag_1_category) AS diag_1_category_freq
FROM cleaned""")
def q_freq_enc(spark, sf):
    return enc.frequency_encode(cleaned(spark, sf, ["encounter_id", "diag_1_category"]), "diag_1_category")


@register("target_encode_age", O.CLEANED + """
, tr AS (SELECT * FROM cleaned WHERE (""" + O.hex60("encounter_id") + """) % 5 <> 0),
te AS (SELECT age, avg(readmitted_binary) AS te FROM tr GROUP BY age)
SELECT c.encounter_id, c.age, round(coalesce(te.te, (SELECT avg(readmitted_binary) FROM tr)), 6) AS age_te
FROM cleaned c LEFT JOIN te ON c.age = te.age""")
def q_target_enc(spark, sf):
    c = cleaned(spark, sf)
    train = c.filter(bal.md5_number("encounter_id") % 5 != 0)
    out = enc.target_encode(c.select("encounter_id", "age"), "age", fit_on=train.select("age", codes.TARGET))
    return out.select("encounter_id", "age", r6(F.col("age_te")).alias("age_te"))


PAIR_COLS = ["time_in_hospital", "num_medications", "number_inpatient", "number_diagnoses"]


@register("pairwise_interactions", O.CLEANED + " SELECT encounter_id, " + ", ".join(PAIR_COLS) + ", " + ", ".join(
    f"CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE) AS {a}_x_{b}"
    for i, a in enumerate(PAIR_COLS) for b in PAIR_COLS[i + 1:]) + " FROM cleaned")
def q_pairs(spark, sf):
    return enc.pairwise_interactions(cleaned(spark, sf, ["encounter_id", *PAIR_COLS]), PAIR_COLS)


def _corr_list_sql():
    from .queries_profile import CLEAN_NUMERIC, _corr_sql
    return "(" + union(f"SELECT {O.q(a)} AS feature, {_corr_sql(a, 'readmitted_binary')} AS corr FROM cleaned"
                       for a in CLEAN_NUMERIC) + ")"


@register("select_by_correlation", O.CLEANED + f"""
SELECT feature, corr, abs(corr) AS abs_corr, rank FROM (SELECT feature, corr,
  row_number() OVER (ORDER BY abs(corr) DESC NULLS LAST, feature) AS rank FROM {_corr_list_sql()}) WHERE abs(corr) > 0.01""")
def q_select_corr(spark, sf):
    from .queries_profile import CLEAN_NUMERIC
    return enc.select_by_correlation(cleaned(spark, sf, [*CLEAN_NUMERIC, codes.TARGET]), CLEAN_NUMERIC, 0.01)


def _mi_sql(cols, bins=10):
    parts = []
    for c in cols:
        x = f"CAST({O.ident(c)} AS DOUBLE)"
        parts.append(
            f"SELECT {O.q(c)} AS feature, CASE WHEN st.nd <= {bins} THEN {x} WHEN st.hi = st.lo THEN 0.0 "
            f"ELSE CAST(least(floor(({x} - st.lo) / (st.hi - st.lo) * {bins}), {bins - 1}) AS DOUBLE) END AS bin, "
            f"readmitted_binary AS y FROM cleaned, (SELECT min({x}) AS lo, max({x}) AS hi, "
            f"count(DISTINCT {O.ident(c)}) AS nd FROM cleaned) st")
    return f"""
, d AS ({union(parts)}),
j AS (SELECT feature, bin, y, count(*) AS nxy FROM d WHERE bin IS NOT NULL GROUP BY 1, 2, 3),
px AS (SELECT feature, bin, sum(nxy) AS nx FROM j GROUP BY 1, 2),
py AS (SELECT feature, y, sum(nxy) AS ny FROM j GROUP BY 1, 2),
n AS (SELECT feature, sum(nxy) AS n FROM j GROUP BY 1),
mi AS (SELECT j.feature, sum((nxy / n) * ln((nxy * n) / (nx * ny))) AS mi FROM j
  JOIN px USING (feature, bin) JOIN py USING (feature, y) JOIN n USING (feature) GROUP BY j.feature),
mir AS (SELECT feature, round(mi, 6) AS mi, row_number() OVER (ORDER BY round(mi, 6) DESC, feature) AS rank FROM mi)"""


@register("mutual_information", O.CLEANED + _mi_sql(KEY_NUMERICAL) + " SELECT * FROM mir")
def q_mi(spark, sf):
    return enc.mutual_information(cleaned(spark, sf, [*KEY_NUMERICAL, codes.TARGET]), KEY_NUMERICAL)


@register("consensus_vote", O.CLEANED + _mi_sql(KEY_NUMERICAL) + f"""
, corr_l AS (SELECT feature FROM {_corr_list_sql()} WHERE abs(corr) > 0.01),
mi_l AS (SELECT feature FROM mir WHERE rank <= 4),
""" + "t_l AS (SELECT feature FROM (" + """
  SELECT feature, row_number() OVER (ORDER BY abs(t) DESC NULLS LAST, feature) AS rk FROM (
""" + union(
    f"SELECT {O.q(c)} AS feature, (avg(CASE WHEN readmitted_binary = 1 THEN CAST({c} AS DOUBLE) END) - "
    f"avg(CASE WHEN readmitted_binary = 0 THEN CAST({c} AS DOUBLE) END)) / nullif(sqrt(((count(CASE WHEN "
    f"readmitted_binary = 1 THEN 1 END) - 1) * var_samp(CASE WHEN readmitted_binary = 1 THEN CAST({c} AS DOUBLE) END) "
    f"+ (count(CASE WHEN readmitted_binary = 0 THEN 1 END) - 1) * var_samp(CASE WHEN readmitted_binary = 0 THEN "
    f"CAST({c} AS DOUBLE) END)) / (count(*) - 2) * (1.0 / count(CASE WHEN readmitted_binary = 1 THEN 1 END) + "
    f"1.0 / count(CASE WHEN readmitted_binary = 0 THEN 1 END))), 0) AS t FROM cleaned" for c in KEY_NUMERICAL)
    + """)) WHERE rk <= 4),
u AS (SELECT feature, 'correlation' AS method FROM corr_l UNION ALL SELECT feature, 'mutual_information' FROM mi_l
      UNION ALL SELECT feature, 't_test' FROM t_l)
SELECT feature, count(*) AS votes, string_agg(method, ',' ORDER BY method) AS methods FROM u
WHERE feature IN (""" + ", ".join(O.q(c) for c in KEY_NUMERICAL) + """)
GROUP BY feature HAVING count(*) >= 2""")
def q_vote(spark, sf):
    c = cleaned(spark, sf)
    corr_l = enc.select_by_correlation(c, KEY_NUMERICAL, 0.01)
    mi_l = enc.mutual_information(c, KEY_NUMERICAL, k=4)
    t = st.two_sample_t(c, KEY_NUMERICAL)
    from pyspark.sql import Window
    t_l = t.withColumn("rk", F.row_number().over(Window.orderBy(F.abs("t").desc_nulls_last(), "feature"))) \
        .filter(F.col("rk") <= 4)
    return enc.consensus_vote({"correlation": corr_l, "mutual_information": mi_l, "t_test": t_l})


ENCODED_TEXT = ["race", "gender", "age", "diag_1", "diag_2", "diag_3", "A1Cresult", *codes.MEDICATIONS, "change", "diabetesMed",
                "diag_1_category", "diag_2_category", "diag_3_category", "diab_code", "diab_complication_categories"]


def _encoded_sql():
    """Correlation and mutual information of every one-hot column."""
    from .queries_profile import CLEAN_NUMERIC
    text = union(f"SELECT {i} AS c, {O.q(x)} AS name, CAST({O.ident(x)} AS VARCHAR) AS level, readmitted_binary AS y FROM cleaned" for i, x in enumerate(ENCODED_TEXT))
    return _mi_sql(CLEAN_NUMERIC) + f"""
, tx AS ({text}),
lv AS (SELECT c, name, level, count(*) AS n1, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS n11,
         row_number() OVER (PARTITION BY c ORDER BY level) AS rk FROM tx WHERE level IS NOT NULL GROUP BY c, name, level),
al AS (SELECT CAST(count(*) AS DOUBLE) AS big, CAST(sum(readmitted_binary) AS DOUBLE) AS pos FROM cleaned),
ce AS (SELECT name || '_' || level AS feature, unnest([
         {{'k': n11, 'r': n1, 's': pos}}, {{'k': n1 - n11, 'r': n1, 's': big - pos}},
         {{'k': pos - n11, 'r': big - n1, 's': pos}}, {{'k': big - n1 - pos + n11, 'r': big - n1, 's': big - pos}}]) AS x, big
       FROM lv, al WHERE rk > 1),
hm AS (SELECT feature, sum(CASE WHEN x.k > 0 THEN x.k / big * ln(x.k * big / (x.r * x.s)) ELSE 0 END) AS mi FROM ce GROUP BY feature),
enc_scores AS (
  SELECT f.feature, corr, mi FROM {_corr_list_sql()} f LEFT JOIN mir USING (feature)
  UNION ALL
  SELECT name || '_' || level, round((big * n11 - n1 * pos) / nullif(sqrt(n1 * (big - n1)) * sqrt(pos * (big - pos)), 0), 6), round(mi, 6)
  FROM lv JOIN hm ON hm.feature = name || '_' || level, al WHERE rk > 1)"""


@register("encoded_feature_scores", O.CLEANED + _encoded_sql() + " SELECT feature, corr, mi FROM enc_scores")
def q_encoded_scores(spark, sf):
    from .queries_profile import CLEAN_NUMERIC
    c = cut_lineage(cleaned(spark, sf, [*CLEAN_NUMERIC, *ENCODED_TEXT, codes.TARGET]))
    return enc.encoded_scores(c, CLEAN_NUMERIC, ENCODED_TEXT).select("feature", "corr", "mi")


@register("consensus_selection")
def q_consensus(spark, sf):
    """Votes of correlation (over 0.01), mutual information (first 50) and
    forest importance (over 0.001) on all encoded columns, two or more, sorted
    by votes, then column order."""
    from pyspark.sql import Window
    from ..operators import models as ml
    from .queries_profile import CLEAN_NUMERIC
    c = cut_lineage(cleaned(spark, sf, [*CLEAN_NUMERIC, *ENCODED_TEXT, codes.TARGET]))
    scores = cut_lineage(enc.encoded_scores(c, CLEAN_NUMERIC, ENCODED_TEXT), "scores")
    first = Window.orderBy(F.col("mi").desc_nulls_last(), "ord", "place")               # one row a feature
    return enc.consensus_vote({
        "correlation": scores.filter(F.abs("corr") > 0.01),
        "mutual_information": scores.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= 50),
        "random_forest": ml.encoded_forest_importance(c, CLEAN_NUMERIC, ENCODED_TEXT).filter(F.col("importance") > 0.001)}, order=scores)


# --- splitting and balancing ---------------------------------------------------------
RANKED = """
, rk AS (SELECT *, row_number() OVER (PARTITION BY readmitted_binary ORDER BY md5(CAST(encounter_id AS VARCHAR)),
           encounter_id) AS rnk, count(*) OVER (PARTITION BY readmitted_binary) AS n_c FROM cleaned)"""


@register("stratified_split", O.CLEANED + RANKED + """
SELECT encounter_id, readmitted_binary, CASE WHEN rnk <= round(n_c * 0.2) THEN 'test' ELSE 'train' END AS split FROM rk""")
def q_split(spark, sf):
    return bal.stratified_split(cleaned(spark, sf, ["encounter_id", codes.TARGET]), 0.2)


@register("stratified_folds", O.CLEANED + RANKED + """
SELECT encounter_id, readmitted_binary, CAST((rnk - 1) % 5 AS INTEGER) AS fold FROM rk""")
def q_folds(spark, sf):
    return bal.stratified_folds(cleaned(spark, sf, ["encounter_id", codes.TARGET]), 5)


@register("stratified_sample", O.LOADED + """
, b AS (SELECT encounter_id, CAST(coalesce(readmitted = '<30', false) AS INTEGER) AS readmitted_binary FROM loaded),
rk AS (SELECT *, row_number() OVER (PARTITION BY readmitted_binary ORDER BY md5(CAST(encounter_id AS VARCHAR)),
        encounter_id) AS rnk, count(*) OVER (PARTITION BY readmitted_binary) AS n_c, count(*) OVER () AS n FROM b)
SELECT encounter_id, readmitted_binary FROM rk WHERE rnk <= floor(5000 * n_c / n)""")
def q_sample(spark, sf):
    from ..operators.features import binary_target
    return bal.stratified_sample(binary_target(raw_encounters(spark, sf)).select("encounter_id", codes.TARGET), 5000)


@register("undersample", O.CLEANED + RANKED + """
SELECT encounter_id, readmitted_binary FROM rk WHERE readmitted_binary = 1
   OR rnk <= (SELECT count(*) FROM cleaned WHERE readmitted_binary = 1)""")
def q_under(spark, sf):
    return bal.undersample(cleaned(spark, sf, ["encounter_id", codes.TARGET]), 1.0)


@register("oversample_random", O.CLEANED + RANKED + """
, nm AS (SELECT count(*) AS n_min FROM cleaned WHERE readmitted_binary = 1),
need AS (SELECT (SELECT count(*) FROM cleaned WHERE readmitted_binary <> 1) - n_min AS k, n_min FROM nm),
draws AS (SELECT range AS draw, (""" + O.hex60("'42:' || CAST(range AS VARCHAR)") + """) % need.n_min + 1 AS pick
          FROM need, range(0, (SELECT k FROM need)))
SELECT encounter_id, readmitted_binary, CAST(NULL AS BIGINT) AS draw FROM cleaned
UNION ALL SELECT rk.encounter_id, rk.readmitted_binary, draws.draw FROM draws JOIN rk
  ON rk.readmitted_binary = 1 AND rk.rnk = draws.pick""")
def q_over(spark, sf):
    return bal.oversample_random(cleaned(spark, sf, ["encounter_id", codes.TARGET]))


@register("oversample_tile", O.CLEANED + """
, f AS (SELECT ((SELECT count(*) FROM cleaned WHERE readmitted_binary <> 1)
                // (SELECT count(*) FROM cleaned WHERE readmitted_binary = 1)) // 2 AS k)
SELECT encounter_id, readmitted_binary, 0 AS copy FROM cleaned WHERE readmitted_binary <> 1
UNION ALL SELECT encounter_id, readmitted_binary, CAST(s.copy AS INTEGER) FROM cleaned,
  (SELECT unnest(range(1, (SELECT k FROM f) + 1)) AS copy) s WHERE readmitted_binary = 1""")
def q_tile(spark, sf):
    return bal.oversample_tile(cleaned(spark, sf, ["encounter_id", codes.TARGET]))


@register("class_weights", O.CLEANED + """
SELECT readmitted_binary AS class, count(*) AS n,
  round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM cleaned GROUP BY readmitted_binary""")
def q_weights(spark, sf):
    return bal.class_weights(cleaned(spark, sf, [codes.TARGET])).withColumn("weight", F.round("weight", 6))


@register("class_balance", O.CLEANED + """
SELECT readmitted_binary AS class, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM cleaned GROUP BY readmitted_binary""")
def q_balance(spark, sf):
    return bal.class_balance(cleaned(spark, sf, [codes.TARGET]))
