"""Readers over file splits, the level dictionary, closed-form scores of one-hot
columns, batched GLMs, interaction terms, and model files."""

import csv
import io
import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstat.operators import encode as enc, models as ml, ranges, stats as st
from wardstat.sources import tables as tb


@pytest.fixture
def tiny_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def write(folder, name, text):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(text.encode())


def test_quoted_breaks_across_splits(spark, tmp_dir, tiny_splits):
    rng = random.Random(1)
    want = []
    for k in range(4):
        rows = [[str(i), rng.choice(["plain", "a;b", 'say "x"', "two\nlines", "\n\n\nmany\n;\n", "l" * 150, "", 'q"\n"q', "id;note"])] for i in range(40)]
        rows.append(["id", "note"])
        out = io.StringIO()
        w = csv.writer(out, delimiter=";", lineterminator="\n")
        w.writerows([["id", "note"], *rows])
        write(tmp_dir, f"p{k}.csv", out.getvalue())
        want += [(a, b or None) for a, b in rows]
    df = tb.read_csv_tolerant(spark, tmp_dir, sep=None)
    assert df.columns == ["id", "note"] and tb._lines(spark, tmp_dir).select("file", "block").distinct().count() > 40
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want))


def test_lone_quotes_inside_fields_are_text(spark, tmp_dir):
    write(tmp_dir, "a.csv", 'a,b\n1,5" pipe\n2,"x, y"\n3,it\'s 6"\n4,"open\nend"\n5,z,surplus\n6,last')
    got = sorted(tuple(r) for r in tb.read_csv_tolerant(spark, os.path.join(tmp_dir, "a.csv")).collect())
    assert got == [("1", '5" pipe'), ("2", "x, y"), ("3", "it's 6\""), ("4", "open\nend"), ("6", "last")]


def test_sections_across_splits_and_files(spark, tmp_dir, tiny_splits):
    want = []
    for k in range(3):
        lines = []
        for s in range(6):
            lines.append(f"feature_{k}_{s},description")
            for i in range(12):
                lines.append(f'{i},"label, {k} {s} {i}"')
                want.append((f"feature_{k}_{s}", str(i), f"label, {k} {s} {i}"))
            lines.append(",")
        write(tmp_dir, f"f{k}.csv", "\n".join(lines) + "\n")
    got = sorted(tuple(r) for r in tb.read_sectioned_map(spark, tmp_dir).collect())
    assert got == sorted(want)


def test_fifty_thousand_levels(spark, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 5_000)
    df = spark.range(100_000).select("id", F.concat(F.lit("v"), (F.col("id") % 50_000).cast("string")).alias("c"),
                                     F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("d"))
    dictionary = enc.level_dictionary(df, ["c", "d"]).cache()
    assert enc.dictionary_sizes(dictionary, ["c", "d"]) == {"c": 50_000, "d": 2}
    order = {v: i for i, v in enumerate(sorted(f"v{k}" for k in range(50_000)))}
    got = {r.id: r.active for r in enc.one_hot_active(df, ["c", "d"], dictionary).select("id", "active").collect()}
    assert all(got[i] == [order[f"v{i % 50_000}"]] + ([50_000 + i % 3 - 1] if i % 3 else []) for i in range(100_000))
    vectors = enc.one_hot_vectors(df.filter("id < 50"), ["c", "d"], dictionary)
    for r in vectors.collect():
        assert r.oh_c.size == 50_000 and list(r.oh_c.indices) == [order[r.c]] and list(r.oh_d.indices) == ([int(r.d) - 1] if r.d else [])
    fresh = spark.createDataFrame([(1, "unknown", "2")], "id long, c string, d string")
    r = enc.one_hot_vectors(fresh, ["c", "d"], dictionary, drop_first=True).first()
    assert r.oh_c.size == 49_999 and len(r.oh_c.indices) == 0 and r.oh_d.size == 1 and list(r.oh_d.indices) == [0]


def test_scores_of_one_hot_columns_are_those_of_the_encoded_table(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 20), rng.choice(["a", "b", "c", None]), rng.choice(["x", "y"]), "one", int(rng.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "n int, s string, t string, k string, readmitted_binary int")
    got = {r.feature: r for r in enc.encoded_scores(df, ["n"], ["s", "t", "k"]).collect()}
    assert [f for f in sorted(got, key=lambda f: (got[f].ord, got[f].place))] == ["n", "s_b", "s_c", "t_y"]
    y = np.array([r[4] for r in rows])
    for feature, x in {"s_b": [r[1] == "b" for r in rows], "s_c": [r[1] == "c" for r in rows], "t_y": [r[2] == "y" for r in rows]}.items():
        x = np.array(x, int)
        assert got[feature].corr == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6)
        mi = sum(np.mean((x == a) & (y == b)) * math.log(np.mean((x == a) & (y == b)) / (np.mean(x == a) * np.mean(y == b))) for a, b in itertools.product((0, 1), repeat=2))
        assert got[feature].mi == pytest.approx(mi, abs=1e-6)
    lists = {"u": spark.createDataFrame([("t_y",), ("s_c",), ("n",)], "feature string"), "v": spark.createDataFrame([("s_c",), ("t_y",)], "feature string"),
             "w": spark.createDataFrame([("t_y",), ("n",), ("other",)], "feature string")}
    votes = enc.consensus_vote(lists, order=enc.encoded_scores(df, ["n"], ["s", "t", "k"])).orderBy("rank").collect()
    assert [(r.feature, r.votes, r.methods) for r in votes] == [("t_y", 3, "u,v,w"), ("n", 2, "u,w"), ("s_c", 2, "u,v")]
    names = {r.feature: r.position for r in enc.encoded_places(["n"], enc.level_dictionary(df, ["s", "t", "k"]), ["s", "t", "k"]).collect()}
    assert names == {"n": 0, "s_b": 1, "s_c": 2, "t_y": 3}
    important = {r.feature: r.importance for r in ml.encoded_forest_importance(df, ["n"], ["s", "t", "k"], estimator=ml.forest(5, 4)).collect()}
    assert set(important) <= set(names) and sum(important.values()) == pytest.approx(1)


def newton(x, y, steps=40):
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        h = (x * (p * (1 - p))[:, None]).T @ x
        b = b + np.linalg.solve(h, x.T @ (y - p))
    return b, np.sqrt(np.diag(np.linalg.inv(h)))


def test_univariate_glms_against_plain_newton_steps(spark):
    rng = np.random.default_rng(5)
    n = 500
    cols = {"a": rng.normal(1000, 3, n), "b": rng.integers(0, 5, n).astype(float), "c": rng.normal(0, 1e-3, n)}
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 * (cols["a"] - 1000) - 0.5 * cols["b"])))).astype(int)
    rows = [(float(cols["a"][i]), None if i % 11 == 0 else float(cols["b"][i]), float(cols["c"][i]), 7.0, float(y[i]), None, int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, same double, split double, none double, readmitted_binary int")
    got = {(r.feature, r.term): r for r in ml.univariate_glm(df, ["a", "b", "c", "same", "split", "none"]).collect()}
    assert {k for k in got if k[1] == "ERROR"} == {("same", "ERROR"), ("split", "ERROR"), ("none", "ERROR")} and len(got) == 9
    for c in "abc":
        keep = [i for i in range(n) if c != "b" or i % 11]
        x = np.column_stack([np.ones(len(keep)), cols[c][keep]])
        if c == "a":
            x[:, 1] -= 1000
        b, se = newton(x, y[keep])
        r = got[c, c]
        assert r.coef == pytest.approx(b[1], rel=1e-5) and r.stderr == pytest.approx(se[1], rel=1e-5)
        want = b[0] - (1000 * b[1] if c == "a" else 0)
        assert got[c, "Intercept"].coef == pytest.approx(want, rel=1e-5)


def test_multivariable_glm_against_plain_newton_steps(spark):
    rng = np.random.default_rng(6)
    n = 600
    x, g = rng.normal(0, 1, n), rng.integers(0, 3, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * x - 0.7 * (g == 1) + 0.4)))).astype(int)
    df = spark.createDataFrame([(float(x[i]), "abc"[g[i]], int(y[i])) for i in range(n)], "x double, g string, readmitted_binary int")
    got = {r.term: r for r in ml.multivariable_glm(df, ["x"], ["g"]).collect()}
    base = [t for t in ("g_a", "g_b", "g_c") if t not in got]
    assert len(base) == 1 and len(got) == 4
    terms = ["x", *[t for t in ("g_a", "g_b", "g_c") if t in got]]
    m = np.column_stack([x] + [(g == "abc".index(t[2])).astype(float) for t in terms[1:]] + [np.ones(n)])
    b, se = newton(m, y)
    for t, c, e in zip([*terms, "Intercept"], b, se):
        assert got[t].coef == pytest.approx(c, abs=1e-5) and got[t].stderr == pytest.approx(e, abs=1e-5)


def test_interaction_terms_and_values(spark):
    rows = [(2.0, 3.0, "u", "p", 1), (5.0, 0.0, "v", "q", 0), (1.0, 1.0, "u", "q", 0), (4.0, 2.0, None, "p", 1)]
    df = spark.createDataFrame(rows, "x double, z double, s string, t string, readmitted_binary int")
    data = ml.interaction_input(df, ["x", "z"], ["s", "t"])
    out = ml.interaction_features(data.filter("z > 0.5"), ["x", "z"], ["s", "t"]).transform(data)
    names = ml.term_names(out)
    assert set(names) == {"x", "z", "s_u", "t_p", "t_q", "x:z", "x:s_u", "x:t_p", "x:t_q", "z:s_u", "z:t_p", "z:t_q", "s_u:t_p", "s_u:t_q"}
    for r in out.collect():
        base = {"x": r.x, "z": r.z, "s_u": float(r["s__text"] == "u"), "t_p": float(r["t__text"] == "p"), "t_q": float(r["t__text"] == "q")}
        assert dict(zip(names, r.features.toArray())) == {n: math.prod(base[p] for p in n.split(":")) for n in names}


def test_correlations_of_pairs_with_nulls(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(1e6, 1, (300, 4))
    x[:, 1] += x[:, 0]
    x[:, 3] = 0.1
    gaps = rng.random((300, 4)) < 0.2
    rows = [tuple(None if g else float(v) for v, g in zip(a, b)) for a, b in zip(x, gaps)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r.a, r.b): r["corr"] for r in st.correlation_matrix(df, list("abcd")).collect()}
    for i, j in itertools.product(range(4), repeat=2):
        both = ~gaps[:, i] & ~gaps[:, j]
        want = None if 3 in (i, j) else np.corrcoef(x[both, i], x[both, j])[0, 1]
        assert got["abcd"[i], "abcd"[j]] == (want if want is None else pytest.approx(want, abs=1e-6))



def test_trees_of_wide_rows_are_dealt_over_tasks(spark, monkeypatch):
    """A row of many levels is an int a level in the trees: few rows go to a task."""
    monkeypatch.setattr(ml, "TREE_TASK_BYTES", 20_000, raising=False)
    rows = [(float(i % 7), f"level{i % 200}", i % 2) for i in range(1000)]
    df = spark.createDataFrame(rows, "n double, s string, y int").coalesce(2)
    seen = []

    class Forest:
        def fit(self, data):
            seen.extend(data.rdd.glom().map(len).collect())
            return ml.forest(3, 3).fit(data)

    found = ml.encoded_forest_importance(df, ["n"], ["s"], target="y", estimator=Forest())
    assert sum(seen) == 1000 and max(seen) * 200 * 4 <= 1.5 * 20_000
    assert found.where("feature = 'n' OR feature LIKE 's_level%'").count() == found.count()



def test_forest_keeps_the_nodes_of_rows(spark):
    """Rows keep their node of every tree between levels; the forest is the one that walks down again."""
    from pyspark.ml.linalg import Vectors
    rows = [(Vectors.dense([float(i % 13), float(i % 5), float(i % 3)]), float((i % 13) + (i % 3) > 8)) for i in range(400)]
    data = spark.createDataFrame(rows, ["features", "label"]).coalesce(2).persist()
    kept = ml.forest(5, 6)
    assert kept.getCacheNodeIds()
    a, b = kept.fit(data), ml.forest(5, 6).setCacheNodeIds(False).fit(data)
    assert a.toDebugString.split("\n")[1:] == b.toDebugString.split("\n")[1:]


def test_forest_of_many_rows_is_dealt_evenly_over_the_cores(spark, monkeypatch):
    """Every level waits for the largest task: no core is left without rows."""
    from pyspark.ml.linalg import Vectors
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(ml, "TREE_CORE_ROWS", 50, raising=False)
    rows = [(Vectors.dense([float(i % 13), float(i % 5)]), float((i % 13) > 8)) for i in range(cores * 50)]
    data = spark.createDataFrame(rows, ["features", "label"]).coalesce(max(1, cores - 1))
    plain, seen = ml.forest, []

    class Forest:
        def fit(self, data):
            seen.append(data.rdd.glom().map(len).collect())
            return plain(3, 3).fit(data)

    monkeypatch.setattr(ml, "forest", lambda *a, **k: Forest())
    ml.forest_importance(data, ["a", "b"]).collect()
    assert sum(seen[0]) == cores * 50 and len(seen[0]) == cores and min(seen[0]) >= 40
    few = data.limit(cores * 50 - 1).coalesce(1)
    assert ml.dealt_for_trees(few, 2).rdd.getNumPartitions() == 1               # few rows stay as they are


def test_cross_validation_scores_each_fold_once(spark):
    """A metric row per fold, one without rows too, and few jobs behind them."""
    from pyspark.ml.linalg import Vectors
    from wardstat.operators.evaluate import binary_metrics, roc_auc
    rows = [(Vectors.dense([float(i % 13), float(i % 5)]), float((i % 13) + (i % 3) > 8), i % 3) for i in range(300)]
    data = spark.createDataFrame(rows, ["features", "label", "fold"]).withColumn("fold", F.col("fold").cast("int"))
    calls = []

    def estimator():
        return ml.logistic(20, 0.01)

    score = ml.score
    try:
        ml.score = lambda *a, **b: calls.append(1) or score(*a, **b)
        got = {r["fold"]: (r["f1"], r["roc_auc"]) for r in ml.cross_val_metrics(data, estimator, 4).collect()}
    finally:
        ml.score = score
    assert len(calls) == 4 and set(got) == {-1, 0, 1, 2, 3} and got[3] == (0.0, None)
    for f in range(3):
        s = score(estimator().fit(data.where(F.col("fold") != f)), data.where(F.col("fold") == f), key="none")
        assert got[f] == (binary_metrics(s, 0.5).first()["f1"], roc_auc(s).first()["roc_auc"])
    out = ml.cross_val_metrics(data, estimator, 2)
    assert "MLPredict" not in out._jdf.queryExecution().toString() and "UDF" not in out._jdf.queryExecution().toString()



def test_cleaning_report_reads_the_raw_joins_once(spark):
    from wardstat.plans import pipeline as P
    plan = P.cleaning_report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan


def _encoded_rows(spark, n=1200):
    """Rows with places of text levels as ``sparse_forest`` takes them, and as Spark's trees do."""
    from pyspark.ml.linalg import Vectors
    rng = random.Random(9)
    rows, wide = [], []
    for i in range(n):
        a, b, s, t = rng.randint(0, 300) / 7, float(rng.randint(0, 4)), rng.randint(0, 12), rng.choice([None, 0, 1, 2])
        y = int(rng.random() < .2 + .4 * (a > 25 and s < 5) + .3 * (t == 2))
        rows.append((a, b, None if s == 0 else 1 + s, None if not t else 13 + t, y))
        x = {0: a, 1: b} | ({1 + s: 1.0} if s else {}) | ({13 + t: 1.0} if t else {})
        wide.append((Vectors.sparse(16, x), float(y)))
    return (spark.createDataFrame(rows, "a double, b double, s int, t int, y int").repartition(3),
            spark.createDataFrame(wide, ["features", "label"]).persist())


def test_sparse_forest_grows_the_trees_of_spark(spark, monkeypatch):
    """Without draws there is one tree, in blocks of any size: the splits, joined leaves and importances of Spark's."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from wardstat.operators import sparse_forest as sf
    rows, wide = _encoded_rows(spark)
    monkeypatch.setattr(sf, "BLOCK_ROWS", 100)
    for depth in (2, 7):
        want = DecisionTreeClassifier(maxDepth=depth).fit(wide).featureImportances.toArray()
        got = sf.importances(rows, ["a", "b"], {"s": 12, "t": 2}, "y", 1200, trees=1, depth=depth, drawn=16, bagged=False)
        assert got == pytest.approx(want, abs=1e-9) and got.sum() == pytest.approx(1)
    forest = sf.importances(rows, ["a", "b"], {"s": 12, "t": 2}, "y", 1200, trees=60, depth=3)
    assert np.corrcoef(forest, ml.forest(60, 3).fit(wide).featureImportances.toArray())[0, 1] > 0.9
    monkeypatch.setattr(sf, "COUNT_BYTES", 1)                          # a pass a tree
    assert sf.importances(rows, ["a", "b"], {"s": 12, "t": 2}, "y", 1200, trees=3, depth=2).sum() == pytest.approx(1)
    with pytest.raises(Exception, match="null or NaN in a"):
        sf.importances(rows.withColumn("a", F.lit(None).cast("double")), ["a", "b"], {"s": 12, "t": 2}, "y", 1200, trees=1, depth=1)


def test_encoded_forest_makes_no_wide_rows_of_a_large_table(spark, monkeypatch):
    monkeypatch.setattr(ml, "TREE_TASK_BYTES", 1000)
    monkeypatch.setattr(ml, "VectorAssembler", None)
    plain = ml.forest
    monkeypatch.setattr(ml, "forest", lambda *a, **k: plain(10, 3))
    rows = [(float(i % 7), f"level{i % 40:02d}", "one", int(i % 7 > 3)) for i in range(1000)]
    df = spark.createDataFrame(rows, "n double, s string, k string, readmitted_binary int")
    got = {r.feature: r.importance for r in ml.encoded_forest_importance(df, ["n"], ["s", "k"]).collect()}
    assert sum(got.values()) == pytest.approx(1) and set(got) <= {"n", *[f"s_level{i:02d}" for i in range(1, 40)]}
    assert max(got, key=got.get) == "n" and len(got) > 5
