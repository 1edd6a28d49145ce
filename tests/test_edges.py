"""Hand-made edge fixtures (ICD boundaries, imputation, bins, scores,
correlation, medication groups)."""

import pytest
from pyspark.sql import functions as F

from wardstat.functions import codes
from wardstat.functions.columns import group_change, icd9_category, interval_bins
from wardstat.operators import clean, evaluate as ev, stats as st

ICD_CASES = [
    ("389", "Other"), ("390", "Circulatory"), ("459", "Circulatory"), ("459.5", "Other"),
    ("460", "Respiratory"), ("519", "Respiratory"), ("785", "Circulatory"), ("785.5", "Other"),
    ("786", "Respiratory"), ("787", "Digestive"), ("788", "Genitourinary"), ("250", "Diabetes"),
    ("250.99", "Diabetes"), ("251", "Other"), ("139", "Other"), ("140", "Neoplasms"), ("239", "Neoplasms"),
    ("800", "Injury"), ("999", "Injury"), ("1000", "Other"), (" 250.01 ", "Diabetes"), ("250d", "Other"),
    ("V45", "Other"), ("E812", "Other"), (None, "0"),
]


def test_icd9_boundaries(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(ICD_CASES)], "i int, code string")
    got = {r["i"]: r["cat"] for r in df.select("i", icd9_category("code").alias("cat")).collect()}
    assert [got[i] for i in range(len(ICD_CASES))] == [e for _, e in ICD_CASES]


def test_interval_bins_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (5.5,), (100.0,), (101.0,), (None,)], "x double")
    out = [r["b"] for r in df.select(interval_bins("x", codes.MEDICATION_BINS,
                                                    codes.MEDICATION_BIN_LABELS).alias("b")).collect()]
    assert out == [None, "1-5", "6-10", "20+", None, None]


def test_group_change(spark):
    rows = [("No", "No"), ("Up", "No"), ("Up", "Up"), ("Up", "Down")]
    df = spark.createDataFrame(rows, "a string, b string")
    out = [r["g"] for r in df.select(group_change(["a", "b"]).alias("g")).collect()]
    assert out == ["No", "Up", "Up", "Multiple changes"]


def test_impute_rules(spark):
    df = spark.createDataFrame(
        [(1, None, "b", 1.0, None), (2, None, "a", 2.0, None), (3, None, "a", None, "x"),
         (4, None, "b", 4.0, None), (5, None, None, 5.0, None)],
        "id int, empty string, tied string, num double, diag_1 string")
    out = {r["id"]: r for r in clean.impute(df).collect()}
    assert out[1]["empty"] == "Unknown"          # no mode at all
    assert out[5]["tied"] == "a"                 # tie -> smallest value
    assert out[3]["num"] == 3.0                  # even-count median 1,2,4,5 -> 3
    assert out[1]["diag_1"] == "0"               # diagnosis columns -> '0'


def test_mode_values_smallest_on_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    assert clean.mode_values(df, ["x"]).first()["mode"] == "a"


def scored(spark, rows):
    return spark.createDataFrame(rows, "key long, label int, score double")


def test_all_tied_scores_auc_half(spark):
    df = scored(spark, [(i, i % 2, 0.3) for i in range(10)])
    assert ev.roc_auc(df).first()["roc_auc"] == 0.5


def test_perfect_split(spark):
    df = scored(spark, [(i, 1 if i >= 5 else 0, i / 10.0) for i in range(10)])
    assert ev.roc_auc(df).first()["roc_auc"] == 1.0
    assert ev.pr_auc(df).first()["pr_auc"] == 1.0
    assert ev.average_precision(df).first()["average_precision"] == 1.0


def test_one_class_only_gives_null_auc(spark):
    df = scored(spark, [(i, 0, i / 10.0) for i in range(10)])
    assert ev.roc_auc(df).first()["roc_auc"] is None


def test_empty_positive_prediction(spark):
    df = scored(spark, [(i, i % 2, 0.1) for i in range(10)])
    m = ev.binary_metrics(df, 0.5).first()
    assert (m["precision"], m["recall"], m["f1"]) == (0.0, 0.0, 0.0)
    cm = ev.confusion_matrix(df, 0.5).first()
    assert cm["tp"] + cm["fp"] + cm["tn"] + cm["fn"] == 10


def test_correlation_constant_and_null_pairs(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, None), (3.0, 5.0, 3.0), (4.0, 5.0, 4.0)],
                               "a double, c double, b double")
    m = {(r["a"], r["b"]): r["corr"] for r in st.correlation_matrix(df, ["a", "c", "b"]).collect()}
    assert m[("a", "c")] is None                 # zero variance -> null, no error
    assert m[("a", "b")] == pytest.approx(1.0)   # null pair skipped


def test_t_pvalue_matches_known_value():
    # two-sided p for t = 2.0, dof = 10 is 0.0734 (standard tables)
    assert st.t_two_sided_p(2.0, 10) == pytest.approx(0.07339, abs=1e-4)
    assert st.normal_two_sided_p(1.96) == pytest.approx(0.05, abs=1e-3)


def test_exclude_codes_keeps_nulls(spark):
    df = spark.createDataFrame([(11,), (1,), (None,)], "d int")
    assert clean.exclude_codes(df, "d", codes.DEAD_OR_HOSPICE).count() == 2


def test_first_encounter_strict_non_null(spark):
    df = spark.createDataFrame([(1, 10, None), (1, 11, "x"), (2, 20, "y")], "p int, e int, v string")
    strict = {r["p"]: r["v"] for r in clean.first_encounter_per_patient(
        df, "p", "e", strict_first_non_null=True).collect()}
    plain = {r["p"]: r["v"] for r in clean.first_encounter_per_patient(df, "p", "e").collect()}
    assert strict == {1: "x", 2: "y"} and plain == {1: None, 2: "y"}
