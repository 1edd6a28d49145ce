"""Operators 11 to 13 against brute force."""

import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstat.llm import bit_sliced, filter_audit, hard_negatives, vectors

VECTORS = "vec_id long, embedding array<float>, label int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_vectors(seed, n, dims=8, hot=0.3):
    """Random rows with a hot vector, near ties, repeated and null ids, bad
    components, short, empty and null vectors, null labels."""
    rng = random.Random(seed)
    def vec():
        return [round(rng.gauss(0, 0.4), rng.choice([1, 3])) for _ in range(dims)]
    one, rows = vec(), []
    for i in range(n):
        v = one if rng.random() < hot else vec()
        rows.append((i, v, rng.randint(0, 3)))
    rows += [(0, one, 1), (0, one, 1), (100, vec(), None), (n, None, 1), (n + 1, vec()[:3] + [None] + vec()[4:], 1), (None, one, 2), (None, vec(), 2),
             (n + 2, [float("nan")] * dims, 1), (n + 3, [float("inf")] + [0.0] * (dims - 1), 1), (n + 4, [], 1), (n + 5, vec()[:4], 1), (n + 6, [-3000.5] + vec()[1:], 0)]
    rng.shuffle(rows)
    return rows


def usable(rows):
    out = []
    for i, v, c in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(256 * float(np.float32(x))) for x in v], c))
    return out


def inner(a, b):
    return sum(x * y for x, y in zip(a, b))


def by_score(pairs):
    return sorted(pairs, key=lambda p: (-p[1], p[0] is None, p[0] or 0))


def brute_top(rows, step, k):
    rows = usable(rows)
    out = []
    for n, (i, v, _) in enumerate(rows):
        if i is not None and i % step == 0:
            best = by_score([(j, inner(v, w)) for m, (j, w, _) in enumerate(rows) if m != n])[:k]
            out += [(i, r + 1, j, s) for r, (j, s) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, queries, keep, k", [(65536, 4096, 6, 5), (64, 3, 3, 5), (37, 2, 1, 1), (100, 7, 12, 40)])
def test_top_k_is_exact(spark, block, queries, keep, k):
    rows = some_vectors(block, 400)
    p = bit_sliced.TopKParams(k=k, keep_bits=keep, block_rows=block, query_rows=queries)
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumn("score", F.lit("x")).withColumn("rid", F.lit(1)).withColumn("rank", F.lit(2))
    assert rows_of(bit_sliced.top_k(df, F.col("vec_id") % 50 == 0, p=p)) == brute_top(rows, 50, k)


def test_bit_sliced_sums_are_the_products():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (150, 5))
    index = bit_sliced.Slices(x, 20)
    for q in rng.integers(-400, 400, (20, 5)):
        total, constant = index.add(bit_sliced.signed_digits(q[None])[0])
        bits = [np.unpackbits(t.view(np.uint8), bitorder="little", count=150).astype(np.int64) << w for w, t in enumerate(total)]
        scores = sum(bits) + constant + int(q @ index.low)
        assert (scores == x @ q).all()
        value = index.best(total, 10)
        kept = index.at_least(total, value)
        assert set(kept) == set(np.flatnonzero(x @ q >= np.sort(x @ q)[-10]))


def test_signed_digits():
    x = np.arange(-300, 300)
    d = bit_sliced.signed_digits(x)
    assert ((d << np.arange(d.shape[-1])).sum(axis=-1) == x).all() and not (d[:, 1:] * d[:, :-1]).any()


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e20], 1), (1, [1.0], 1)], VECTORS)
    with pytest.raises(Exception, match="too large"):
        bit_sliced.top_k(df, F.col("vec_id") == 0).collect()


# --- 11 ------------------------------------------------------------------------

def brute_mined(rows, step, p):
    rows = [r for r in usable(rows) if r[2] is not None]
    out = []
    for n, (i, v, c) in enumerate(rows):
        if i is None or i % step:
            continue
        others = [(j, inner(v, w), d) for m, (j, w, d) in enumerate(rows) if m != n]
        negatives = by_score([(j, s) for j, s, d in others if d != c])
        for j, s in by_score([(j, s) for j, s, d in others if d == c])[:p.positives]:
            inside = [x for x in negatives if p.low * s <= 100 * x[1] <= p.high * s][:p.negatives]
            out += [(i, j, r + 1, m, s, t) for r, (m, t) in enumerate(inside)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, anchors, negatives, low", [(16384, 8192, 10, 30), (50, 3, 10, 30), (33, 1, 3, 0), (64, 4, 200, -50)])
def test_mined_negatives_are_exact(spark, block, anchors, negatives, low):
    rows = some_vectors(block + 1, 500) + [(700, [0.0] * 8, 0), (701, [0.0] * 8, 1), (702, [0.0] * 8, 2)]
    p = hard_negatives.MiningParams(negatives=negatives, low=low, block_rows=block, anchor_rows=anchors, chunk=2)
    df = spark.createDataFrame(rows, VECTORS).repartition(4).withColumn("id", F.lit("x")).withColumn("key", F.lit(1)).withColumn("a", F.lit(2))
    want = brute_mined(rows, 100, p)
    assert want and rows_of(hard_negatives.mine(df, F.col("vec_id") % 100 == 0, p=p)) == want


def test_keys_sort_as_the_pairs():
    rng = random.Random(3)
    pairs = [(rng.randint(-3, 3), rng.randint(-5, 5), rng.randint(0, 1), rng.choice([None, rng.randint(-4, 4)])) for _ in range(500)]
    import struct
    keys = sorted(struct.pack(hard_negatives.KEY, a + hard_negatives.MID, hard_negatives.MID, hard_negatives.MID - 1 - s, n, i is None, (i or 0) + hard_negatives.MID)
                  for a, s, n, i in pairs)
    want = sorted(pairs, key=lambda x: (x[0], -x[1], x[2], x[3] is None, x[3] or 0))
    for key, (a, s, n, i) in zip(keys, want):
        x = struct.unpack(hard_negatives.KEY, key)
        assert (x[0] - hard_negatives.MID, hard_negatives.MID - 1 - x[2], x[3]) == (a, s, n) and (None if x[4] else x[5] - hard_negatives.MID) == i


def test_the_iterator_holds_open_windows_only():
    mid = hard_negatives.MID
    import struct
    def stream():
        yield struct.pack(hard_negatives.KEY, mid, mid, mid - 1 - 1000, 0, 0, mid + 1), None
        for k in range(100_000):
            yield struct.pack(hard_negatives.KEY, mid, mid, mid - 1 - 800 + k // 200, 1, 0, mid + k), None
    got = list(hard_negatives.mined(stream(), hard_negatives.MiningParams()))
    assert [r[2] for r in got] == list(range(1, 11)) and [r[3] for r in got] == list(range(10))


@pytest.mark.parametrize("query", [lambda df: bit_sliced.top_k(df, F.col("vec_id") % 2 == 0), lambda df: hard_negatives.mine(df, F.col("vec_id") % 2 == 0)])
def test_empty_and_lone_vectors(spark, query):
    assert query(spark.createDataFrame([], VECTORS)).collect() == []
    assert query(spark.createDataFrame([(2, [0.5], 1)], VECTORS)).collect() == []
    assert query(spark.createDataFrame([(2, None, 1), (None, [0.5], 1), (1, [0.5], 2)], VECTORS)).collect() == []


# --- 12 ------------------------------------------------------------------------

def brute_shapley(m, value):
    out = [0] * m
    for order in itertools.permutations(range(m)):
        before = 0
        for f in order:
            out[f] += value(before | 1 << f) - value(before)
            before |= 1 << f
    return out


@pytest.mark.parametrize("m", [2, 3, 5, 6])
def test_least_squares_gives_shapley_values(m):
    rng = random.Random(m)
    v = [0] + [rng.randint(0, 1000) for _ in range((1 << m) - 1)]
    table = filter_audit.shapley_map(m)
    assert [sum(c * x for c, x in zip(row, v)) for row in table] == brute_shapley(m, v.__getitem__)
    assert all(sum(row[s] for row in table) == (math.factorial(m) if s == (1 << m) - 1 else 0) for s in range(1 << m))
    assert all(isinstance(c, int) and not isinstance(c, Fraction) for row in table for c in row)


def brute_audit(docs, labels):
    good = {i: max(int(q == 1) for j, q, _ in labels if j == i) for i, _, _ in labels if i is not None}
    bad = {i: max(int(t == 1) for j, _, t in labels if j == i) for i, _, _ in labels if i is not None}
    rows = []
    for i, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in docs)}
        rows.append((lang or "", {c for c, x in fails.items() if x}, good.get(i, 0), bad.get(i, 0)))
    out, total = [], {}
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for k, c in enumerate(order):
                gone = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                failing = [r for r in rows if r[0] == part and c in r[1]]
                total[part, c] = total.get((part, c), 0) + len(gone)
                out.append([part, order, k + 1, len(left), len(gone), len(failing) - len(gone), sum(r[1] == {c} for r in failing),
                            sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return sorted(tuple(r) + (total[r[0], r[1][r[2] - 1]],) for r in out)


def test_audit_against_running_the_filters(spark):
    rng = random.Random(12)
    hot = " ".join(f"w{k}" for k in range(120))
    docs = []
    for i in range(150):
        n = rng.choice([0, 5, 99, 100, 150])
        words = [rng.choice(["a", "É", "AB", "x%", "wort", f"u{rng.randint(0, 999)}"]) if rng.random() < 0.3 else f"w{rng.randint(0, 10 ** 6)}" for _ in range(n)]
        text = hot if rng.random() < 0.3 else rng.choice([" ", "\n\t"]).join(words)
        docs.append((rng.choice([i, i, i % 20, None]), rng.choice([text, text, text, None, ""]), rng.choice(["en", "de", "", None])))
    labels = [(rng.choice([rng.randint(0, 149), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("mask", F.lit("x")).withColumn("n", F.lit(1)).withColumn("good", F.lit(2))
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit(3)))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, labels)


def test_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "abc", "x"), (2, "ab", "x"), (3, "ab", "y")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels, filters=lambda t: {"S": F.length(t) < 3}, copies="E").where("filter_order = 'SE'").collect()
    assert sorted((r.part, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got) == [
        ("x", 1, 1, 1, 0, 1, 2), ("x", 2, 1, 0, 0, 0, 0), ("y", 1, 0, 1, 0, 0, 1), ("y", 2, 0, 0, 1, 0, 1)]


def test_query_blocks_are_bounded(spark):
    df = spark.createDataFrame([(k, [float(k % 7)], 0) for k in range(50)], VECTORS).repartition(4)
    rows = vectors.prepare(df, "vec_id", "embedding", 256, F.col("vec_id") % 2 == 0)
    sizes = [len(b["id"]) for b in vectors.query_blocks(rows, 7)]
    assert sum(sizes) == 25 and max(sizes) <= 7
