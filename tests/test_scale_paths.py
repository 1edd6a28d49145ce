"""Partition and bucket independence: the scale paths (range prefix sums,
hash-bucket ranks, multi-pivot kNN) give the same answers as brute force."""

import hashlib
import os
import random
import tracemalloc
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstat.operators import balance as bal, evaluate as ev, neighbours as nb, ranges


@pytest.fixture
def scored(spark):
    rnd = random.Random(7)
    rows = [(i, int(rnd.random() < 0.3), round(rnd.random(), 3)) for i in range(3000)]
    return spark.createDataFrame(rows, "key long, label int, score double"), rows


def brute_auc(rows):
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y != 1]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_prefix_sums_many_ranges(spark, scored, monkeypatch):
    df, rows = scored
    one = ev.roc_auc(df).first()["roc_auc"]
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 7)   # forces ~140 ranges
    many = ev.roc_auc(df).first()["roc_auc"]
    assert one == many == pytest.approx(round(brute_auc(rows), 6))
    a = sorted(tuple(r) for r in ev.pr_curve(df).collect())
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 50_000)
    b = sorted(tuple(r) for r in ev.pr_curve(df).collect())
    assert a == b


def test_curves_of_scores_in_one_spot(spark, monkeypatch):
    """99 % of the scores within 1e-6, and one far away: even ranges, and the
    same curve points as from one range."""
    df = spark.range(60_000).select(
        F.col("id").alias("key"), (F.col("id") % 7 == 0).cast("int").alias("label"),
        F.when(F.col("id") == 0, 1e9).when(F.col("id") % 100 == 1, F.col("id").cast("double")).otherwise(0.5 + F.col("id") * 1e-11).alias("score"))
    one = sorted(tuple(r) for r in ev.roc_curve(df).collect())
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 3_000)
    assert sorted(tuple(r) for r in ev.roc_curve(df).collect()) == one
    sizes = sorted(r["count"] for r in ranges.with_ranges(df.select("score"), ["score"]).groupBy("_range").count().collect())
    assert len(sizes) == 20 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_grouped_running_sums(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "b", None]), rnd.randint(0, 300), rnd.randint(1, 9)) for _ in range(900)]
    rows = [(g, x, sum(n for h, y, n in rows if (h, y) == (g, x))) for g, x in {(g, x) for g, x, _ in rows}]
    df = spark.createDataFrame(rows, "g string, x int, n long")
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 40)
    for descending in (False, True):
        got = {(r.g, r.x): (r.cum_n, r.all_n) for r in ranges.running_sums(df, ["g"], "x", ["n"], descending).collect()}
        assert got == {(g, x): (sum(m for h, y, m in rows if h == g and (y >= x if descending else y <= x)),
                                sum(m for h, _, m in rows if h == g)) for g, x, _ in rows}


def test_quantiles_are_exact(spark, monkeypatch):
    rnd = random.Random(9)
    cols = {"a": [rnd.gauss(0, 1) for _ in range(701)], "b": [float(rnd.choice([1, 2, 2, 7])) for _ in range(500)] + [None] * 201,
            "c": [None] * 701, "d": [3.0] + [None] * 700}
    df = spark.createDataFrame(list(zip(*cols.values())), "a double, b double, c double, d double")
    p = [0, 0.01, 0.25, 0.5, 0.75, 0.9, 1]
    for size in (50_000, 60):
        monkeypatch.setattr(ranges, "ROWS_PER_RANGE", size)
        got = {(r.column, r.probability): r.value for r in ranges.exact_quantiles(df, cols, p).collect()}
        want = {(c, q): np.quantile([x for x in v if x is not None], q) for c, v in cols.items() if c != "c" for q in p}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    row = ranges.quantile_row(df, {"x": ("c", 0.5), "y": ("d", 0.5)}).first()
    assert (row.x, row.y) == (None, 3.0)
    assert ranges.quantile_row(df.limit(0), {"x": ("a", 0.5)}).first().x is None


BIG = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from wardstat.session import get_session
from wardstat.operators import ranges
spark = get_session("local[4]", 16, extra={{"spark.driver.memory": "900m", "spark.checkpoint.dir": {folder!r}}})
n = 10_000_000
df = spark.range(n).select(((F.col("id") * 7919 + 13) % n / 3).alias("x"))
print("QUANTILES", [r.value for r in ranges.exact_quantiles(df, ["x"], [0, 0.25, 0.5, 1]).orderBy("probability").collect()])
spark.stop()
"""


def test_quantiles_of_ten_million_distinct_values(tmp_dir):
    """A heap of 900 MB for driver and executors together."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", BIG.format(root=root, folder=tmp_dir)], capture_output=True, text=True, timeout=600,
                         env={**os.environ, "PYSPARK_SUBMIT_ARGS": "--driver-memory 900m pyspark-shell"})
    last = 10_000_000 - 1
    want = [0.0, last / 4 / 3, last / 2 / 3, last / 3]
    got = next(x for x in out.stdout.splitlines() if x.startswith("QUANTILES"))
    assert [float(x) for x in got[len("QUANTILES ["):-1].split(",")] == pytest.approx(want)


def test_hash_rank_is_exact_and_partition_independent(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("g"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    r1 = {(r["k"]): r["_rank"] for r in bal.hash_rank(df, ["g"], "k").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    r2 = {(r["k"]): r["_rank"] for r in bal.hash_rank(df, ["g"], "k").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert r1 == r2
    import hashlib
    for g in range(3):
        keys = sorted((hashlib.md5(str(k).encode()).hexdigest(), k) for k in range(5000) if k % 3 == g)
        assert [r1[k] for _, k in keys] == list(range(1, len(keys) + 1))


def test_split_keeps_class_shares(spark):
    df = spark.range(1000).select(F.col("id").alias("encounter_id"),
                                  (F.col("id") % 10 == 0).cast("int").alias("readmitted_binary"))
    s = bal.stratified_split(df, 0.2)
    c = {(r["readmitted_binary"], r["split"]): r["count"] for r in s.groupBy("readmitted_binary", "split").count().collect()}
    assert c[(1, "test")] == 20 and c[(0, "test")] == 180


def brute_knn(points, k):
    out = {}
    for i, (ki, vi) in enumerate(points):
        d = sorted((sum((a - b) ** 2 for a, b in zip(vi, vj)), hashlib.md5(str(kj).encode()).hexdigest(), kj)
                   for kj, vj in points if kj != ki)
        out[ki] = [kj for _, _, kj in d[:k]]
    return out


def test_knn_many_pivots_equals_brute_force(spark):
    rnd = random.Random(3)
    pts = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    got = {}
    for r in nb.knn(df, "id", "v", 3).collect():
        got.setdefault(r["id"], []).append((r["nb_rank"], r["nb_key"]))
    got = {k: [b for _, b in sorted(v)] for k, v in got.items()}
    assert got == brute_knn(pts, 3)


def test_smote_balanced_and_on_segments(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.random(), rnd.random()], 1 if i < 12 else 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    out = nb.smote(df, "id", "v", "y", minority=1, k=5).collect()
    ys = [r["y"] for r in out]
    assert ys.count(1) == ys.count(0) == 48
    vec = {i: v for i, v, _ in rows}
    for r in out:
        if r["synthetic"] == 1:
            x, n, u = vec[r["x_key"]], vec[r["nb_key"]], r["u"]
            assert 0.0 <= u < 1.0
            assert r["v"] == pytest.approx([a + u * (b - a) for a, b in zip(x, n)])


def test_smote_single_minority_row_adds_nothing(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [1.0, 1.0], 0), (3, [2.0, 2.0], 0)],
                               "id long, v array<double>, y int")
    assert nb.smote(df, "id", "v", "y").filter("synthetic = 1").count() == 0


def test_smote_minority_smaller_than_k(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0], 1 if i < 3 else 0) for i in range(10)],
                               "id long, v array<double>, y int")
    out = nb.smote(df, "id", "v", "y", k=5)
    assert out.filter("y = 1").count() == out.filter("y = 0").count()


def test_tomek_links_mutual_opposite(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (2, [0.1], 1), (3, [5.0], 0), (4, [5.2], 0)],
                               "id long, v array<double>, y int")
    assert [tuple(r) for r in nb.tomek_links(df, "id", "v", "y").collect()] == [(1, 2)]
    assert sorted(r["id"] for r in nb.remove_tomek_links(df, "id", "v", "y").collect()) == [3, 4]


def test_knn_with_hot_copies(spark):
    """A third of the rows are one repeated vector: exact result, copies first."""
    rnd = random.Random(11)
    pts = [(i, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(200)]
    pts += [(1000 + i, [0.5, 0.5, 0.5]) for i in range(100)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    got = {}
    for r in nb.knn(df, "id", "v", 4).collect():
        got.setdefault(r["id"], []).append((r["nb_rank"], r["nb_key"]))
    got = {k: [b for _, b in sorted(v)] for k, v in got.items()}
    assert got == brute_knn(pts, 4)


def test_knn_in_rare_and_null_blocks(spark):
    """Bounds are per block: a block of 1/50 of the rows, and the null block,
    get all their neighbours."""
    rnd = random.Random(12)
    pts = [(i, [rnd.gauss(0, 1) for _ in range(2)], 1 if i % 50 == 0 else None if i % 50 == 1 else 0) for i in range(1500)]
    df = spark.createDataFrame(pts, "id long, v array<double>, b int")
    got = {}
    for r in nb.knn(df, "id", "v", 5, block=["b"]).collect():
        got.setdefault(r["id"], []).append((r["nb_rank"], r["nb_key"]))
    got = {k: [b for _, b in sorted(v)] for k, v in got.items()}
    want = {}
    for block in (1, None):
        want |= brute_knn([(i, v) for i, v, b in pts if b == block], 5)
    assert len(got) == len(pts) and {k: got[k] for k in want} == want


def knn_of(df, k, **kw):
    got = {}
    for r in nb.knn(df, "id", "v", k, **kw).collect():
        got.setdefault(r["id"], []).append((r["nb_rank"], r["nb_key"]))
    return {k: [b for _, b in sorted(v)] for k, v in got.items()}


def test_knn_over_many_tiles(spark, monkeypatch):
    """Tiles of a few rows: dense near copies, exact ties on a grid, a rare
    block; the same neighbours as by brute force."""
    monkeypatch.setattr(nb, "TILE_ROWS", 25)
    monkeypatch.setattr(nb, "QUERY_ROWS", 7)
    monkeypatch.setattr(nb, "PAIRS", 50)
    rnd = random.Random(21)
    pts = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    pts += [(200 + i, [0.25 + rnd.random() * 1e-7] + [0.5] * 5) for i in range(60)]
    pts += [(300 + i, [float(i % 5), float(i // 5), 0.0, 0.0, 0.0, 1000.0]) for i in range(25)]
    rare = [(900 + i, [float(i)] * 6) for i in range(4)]
    df = spark.createDataFrame([(i, v, 0) for i, v in pts] + [(i, v, 1) for i, v in rare], "id long, v array<double>, b int")
    assert knn_of(df, 4, block=["b"]) == {**brute_knn(pts, 4), **brute_knn(rare, 4)}
    assert knn_of(df, 1) == brute_knn(pts + rare, 1)


def test_knn_leaves_out_unusable_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 0.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert knn_of(df, 9) == {1: [7, 2] if hashlib.md5(b"7").hexdigest() < hashlib.md5(b"2").hexdigest() else [2, 7], 2: [7, 1], 7: [2, 1]}
    assert nb.knn(df.limit(0), "id", "v", 3).collect() == []


def test_bounds_hold_and_leave_few_pairs_to_measure(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x = np.array([r.embedding for r in e], float)
    true = np.sqrt(((x[:300, None] - x[None, :300]) ** 2).sum(axis=2))
    for bits in (2, 4, 8):
        low, high = nb.bounds(*nb.approximate(x[:300], bits), np.arange(300), np.arange(300))
        assert (low <= true).all() and (true <= high).all()
    every = np.arange(len(x))
    *_, pairs = nb.nearest(x, every, every, 5)
    assert pairs < 0.05 * len(x) ** 2


def test_few_pairs_are_measured_beside_a_far_value():
    """One far component does not make the other rows alike."""
    x = np.random.default_rng(4).normal(size=(1500, 8))
    x[7, 3] = 1e6
    every = np.arange(len(x))
    q, c, dist, pairs = nb.nearest(x, every, every, 5)
    assert len(q) == 5 * len(x) and pairs < 0.05 * len(x) ** 2
    for i in range(0, len(x), 100):
        true = ((x - x[i]) ** 2).sum(axis=1)
        assert list(c[q == i]) == list(np.lexsort((every, np.where(every == i, np.inf, true)))[:5])


def test_memory_of_a_group_does_not_grow_with_its_pairs():
    x = np.random.default_rng(5).normal(size=(6000, 16))
    x[:, 0] = np.arange(6000) % 2
    x[3000:, 1:] = 0.0
    x[3000:, 1] = np.arange(3000) % 50                     # many rows of the same distances
    half = np.arange(3000)
    tracemalloc.start()
    nb.nearest(x, np.arange(6000), np.arange(6000), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6, peak
    limit = np.full(6000, 4.0)
    tracemalloc.start()
    q, c, dist, _ = nb.nearest_across(x, half, half + 3000, 5, limit)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    true = ((x[:3000, None] - x[None, 3000:]) ** 2).sum(axis=2)
    want = {(i, j + 3000) for i in half for j in [j for j in np.lexsort((half, true[i]))[:5] if true[i, j] <= 4.0]}
    want |= {(j + 3000, i) for j in half for i in [i for i in np.lexsort((half, true[:, j]))[:5] if true[i, j] <= 4.0]}
    assert set(zip(q.tolist(), c.tolist())) == want and len(q) == len(want)


def test_null_labels_keep_their_rows(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(100)], "encounter_id long, y int")
    assert bal.stratified_split(df, 0.2, "y").count() == 100
    assert bal.stratified_folds(df, 5, "y").count() == 100
    assert bal.with_weights(df, "y").count() == 100
    assert bal.undersample(df, 1.0, "y").where("y IS NULL").count() == 20
    assert bal.oversample_tile(df, "y").where("y IS NULL").count() == 20


def test_label_index_of_many_levels(spark):
    from wardstat.operators import encode as enc
    df = spark.range(30000).select(F.md5(F.col("id").cast("string")).alias("c")).unionByName(
        spark.createDataFrame([(None,)], "c string"))
    got = [tuple(r) for r in enc.label_index(df, "c").collect()]
    order = {v: i for i, v in enumerate(sorted(c for c, _ in got if c is not None))}
    assert all(i == order.get(c) for c, i in got) and len(order) == 30000


def test_threshold_grid_is_half_open():
    assert len(ev.threshold_grid(0.1, 0.9, 0.05)) == 16 and len(ev.threshold_grid(0.1, 0.9, 0.01)) == 80
    assert max(ev.threshold_grid(0.1, 0.9, 0.01)) == 0.89

def test_rare_levels_of_all_columns_in_one_pass(spark):
    from wardstat.operators import stats
    rows = [("a", 1, None)] * 6 + [("b", 2, "x")] * 3 + [(None, 3, "y")]
    df = spark.createDataFrame(rows, "p string, q int, r string")
    got = sorted(map(tuple, stats.collapse_rare_levels(df, ["p", "q", "r"], min_share=0.3).collect()), key=str)
    assert got == sorted([("a", "1", None)] * 6 + [("b", "2", "x")] * 3 + [(None, "Other", "Other")], key=str)
    assert stats.collapse_rare_levels(df.limit(0), ["p", "r"]).collect() == []
    assert stats.collapse_rare_levels(df, ["p"], min_share=0).columns == df.columns
