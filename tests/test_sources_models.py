"""Sources, sinks and fitted models (rows-only checks)."""

import json
import os

from pyspark.sql import functions as F

from wardstat.operators import models as ml, stats as st
from wardstat.plans import pipeline as P
from wardstat.sources import tables as tb

from conftest import SMALL


def test_read_table_na_tokens(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t.csv")
    with open(path, "w") as f:
        f.write("a,b,c\n1,None,x\n2,?,\n3,y,z\n")
    df = tb.read_table(spark, path, None)
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("1", None, "x"), ("2", "?", None), ("3", "y", "z")]


def test_read_csv_tolerant(spark, tmp_dir):
    path = os.path.join(tmp_dir, "bad.csv")
    with open(path, "wb") as f:
        f.write("a;b\n1;café\n2;x;extra\n".encode("utf-8") + "3;naïve\n".encode("latin-1"))
    rows = sorted(tuple(r) for r in tb.read_csv_tolerant(spark, path, sep=";").collect())
    assert rows == [("1", "café"), ("3", "naïve")]


def test_read_sectioned_map(spark, tmp_dir):
    path = os.path.join(tmp_dir, "ids.csv")
    with open(path, "w") as f:
        f.write("admission_type_id,description\r\n1,Emergency\r\n6,NULL\r\n,\r\n"
                "discharge_disposition_id,description\r\n19,\"Expired at home. Medicaid only, hospice.\"\r\n"
                "30,Other\r\n27,Federal\r\n")
    rows = sorted(tuple(r) for r in tb.read_sectioned_map(spark, path).collect())
    assert rows == [("admission_type_id", "1", "Emergency"), ("admission_type_id", "6", "NULL"),
                    ("discharge_disposition_id", "19", "Expired at home. Medicaid only, hospice."),
                    ("discharge_disposition_id", "27", "Federal"), ("discharge_disposition_id", "30", "Other")]


def test_read_code_map(spark, tmp_dir):
    path = os.path.join(tmp_dir, "m.json")
    with open(path, "w") as f:
        json.dump({"250": 2, "250.01": 1}, f)
    rows = sorted(tuple(r) for r in tb.read_code_map(spark, path, "int").collect())
    assert rows == [("250", 2), ("250.01", 1)]


def test_report_and_locale_sinks(spark, tmp_dir):
    rep = P.cleaning_report(spark, SMALL)
    tb.write_report(rep, os.path.join(tmp_dir, "rep"))
    back = spark.read.option("header", True).csv(os.path.join(tmp_dir, "rep"))
    assert back.count() == 8
    odds = st.univariate_odds_categorical(P.cleaned(spark, SMALL), "gender")
    tb.write_locale_csv(odds, os.path.join(tmp_dir, "loc"))
    txt = spark.read.option("header", True).option("sep", ";").csv(os.path.join(tmp_dir, "loc"))
    assert txt.filter(F.col("coef").contains(".")).count() == 0


def test_dataset_roundtrip(spark, tmp_dir):
    c = P.cleaned(spark, SMALL)
    tb.write_dataset(c, os.path.join(tmp_dir, "c"))
    assert tb.read_dataset(spark, os.path.join(tmp_dir, "c")).count() == c.count()


def test_models_score_and_persist(spark, tmp_dir):
    from wardstat.plans.queries_models import split_scaled
    train, test = split_scaled(spark, SMALL)
    m = ml.logistic(max_iter=50).fit(train)
    s = ml.score(m, test)
    assert s.count() == test.count()
    assert s.filter((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    ml.save_model(m, os.path.join(tmp_dir, "m"))
    again = ml.load_model(os.path.join(tmp_dir, "m"))
    assert ml.score(again, test).count() == test.count()


def test_grid_search_small_grid(spark):
    from wardstat.operators import balance as bal
    from wardstat.plans.queries_models import split_scaled
    train, _ = split_scaled(spark, SMALL)
    f = bal.stratified_folds(train.withColumn("_y", F.col("label").cast("int")), 3, label="_y").drop("_y")
    rf = ml.forest(n_trees=5, depth=3)
    grid = [{rf.numTrees: 5, rf.maxDepth: 3}, {rf.numTrees: 5, rf.maxDepth: 4}]
    from pyspark.ml.tuning import CrossValidator
    cv = CrossValidator(estimator=rf, estimatorParamMaps=grid, evaluator=ml.f1_evaluator(), foldCol="fold")
    model = cv.fit(f)
    assert len(model.avgMetrics) == 2
    points = ml.forest_grid(ml.forest())       # the study's 24 points, of which 18 differ in Spark's parameters
    assert len(points) == 18 and all(a != b for i, a in enumerate(points) for b in points[:i])


def test_closed_form_odds_equals_glm(spark):
    """Saturated one-factor logistic model: closed form == fitted GLM."""
    from pyspark.ml.regression import GeneralizedLinearRegression
    c = P.cleaned(spark, SMALL).select("gender", "readmitted_binary")
    closed = {r["term"]: r for r in st.univariate_odds_categorical(c, "gender").collect()}
    data = c.withColumn("male", (F.col("gender") == "Male").cast("double"))
    data = ml.assemble(data, ["male"], "readmitted_binary", keep=())
    fit = GeneralizedLinearRegression(family="binomial", link="logit").fit(data)
    assert abs(fit.coefficients[0] - closed["gender[T.Male]"]["coef"]) < 1e-4
    assert abs(fit.summary.coefficientStandardErrors[0] - closed["gender[T.Male]"]["stderr"]) < 1e-4


def test_stage_tables_released(spark):
    from wardstat import session as S
    df = S.cut_lineage(spark.range(10), "probe")
    assert df.count() == 10
    path = S._STAGE_TABLES[-1]
    assert S.release_stage_tables(spark) >= 1
    assert not os.path.exists(path.replace("file:", ""))
