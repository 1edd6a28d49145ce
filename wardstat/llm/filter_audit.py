"""Operator 12: filter interaction audit by exact constrained least squares.

A document's failures are a set of filters.  Documents are counted by part and
failure set (at most 2^m rows a part), which gives the removals of all 2^m
coalitions of the m filters: a coalition removes what fails any of its
filters.  The Shapley values are the solution of a least-squares problem over
the coalitions: weights (m - 1) / (C(m, s) s (m - s)) for coalitions of s
filters, constrained so that the values add up to the removal of all filters.
Its normal equations are solved in rationals, once for the linear map from
coalition removals to values; the map times m! is whole, so the values are
exact sums of longs in Spark.  What a filter removes as a step of an order is
a difference of two coalitions.

Scale: a text is read once, in place, and leaves as a short row (id, part,
failures, digest); texts never move.  Rows meet by document id, and by (digest,
id), so a text that a third of all rows share is spread over all tasks; the
smallest id of each digest is a partial aggregate.  Orders and coalitions are
joined to a few counts a part.

Defined results: a null text is empty; a null part is the empty string; rows
of null id are never a later copy and have no labels; repeated rows count
each; of repeated labels the largest counts, null labels are 0; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import WS


def shapley_map(m: int) -> list[list[int]]:
    """Whole numbers c: m! times the Shapley value of filter f is the sum of
    c[f][s] * removal(s) over the coalitions s (bit sets of filters)."""
    full = (1 << m) - 1
    weight = {s: Fraction(m - 1, comb(m, n) * n * (m - n)) for s in range(1, full) for n in [s.bit_count()]}
    a = [[sum((w for s, w in weight.items() if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(m)] for i in range(m)]
    # with the multiplier of the constraint as a further unknown
    a = [[*row, Fraction(1)] for row in a] + [[Fraction(1)] * m + [Fraction(0)]]
    b = [[weight.get(s, Fraction(0)) * (s >> i & 1) for s in range(full + 1)] for i in range(m)] + [[Fraction(s == full) for s in range(full + 1)]]
    rows = [x + y for x, y in zip(a, b)]
    for k in range(m + 1):
        pivot = next(r for r in range(k, m + 1) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(m + 1):
            if r != k and rows[r][k]:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k])]
    out = [[x * factorial(m) for x in row[m + 1:]] for row in rows[:m]]
    assert all(x.denominator == 1 for row in out for x in row)
    return [[int(x) for x in row] for row in out]


def text_filters(text: Column) -> dict[str, Column]:
    """The production filters by letter: true where a text fails."""
    words = F.filter(F.split(text, f"{WS}+"), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 100, "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(80) * n,
            "C": F.lit(100) * capitals > F.lit(10) * F.length(text), "D": F.rlike(text, F.lit("[#$%&*|]"))}


def failures(docs: DataFrame, labels: DataFrame, filters=text_filters, copies: str = "E", part: str = "lang",
             good: str = "quality", bad: str = "toxic") -> tuple[DataFrame, list[str]]:
    """part, mask, n, good, toxic: documents by part and failure set, and the
    filters' letters (bit k of a mask stands for letter k)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tests = filters(F.col("text"))
    letters = [*tests, copies]
    mask = sum((F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests.values())), F.lit(0))
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text")).select(
        "doc_id", "part", mask.cast("int").alias("mask"), F.sha2("text", 256).alias("digest"))
    rows = cut_lineage(rows, "audit_rows")
    named = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    marks = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
             .agg(F.max((F.col(good) == 1).cast("int")).alias("good"), F.max((F.col(bad) == 1).cast("int")).alias("toxic")))
    named = named.join(marks, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "digest", "part", "mask", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    named = cut_lineage(named, "audit_named")
    first = named.groupBy(F.col("digest").alias("d")).agg(F.min("doc_id").alias("first"))
    copy = 1 << (len(letters) - 1)
    groups = ["part", "mask", "good", "toxic"]
    # every row as a copy, those of the smallest ids taken back
    every = named.groupBy(*groups).agg(F.sum("n").alias("n"))
    firsts = named.join(first, (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("first"))).groupBy(*groups).agg(F.sum("n").alias("n"))
    nameless = rows.where("doc_id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    late = (F.col("mask") + copy).alias("mask")
    counts = (every.select("part", late, "good", "toxic", "n")
              .unionByName(firsts.select("part", late, "good", "toxic", (-F.col("n")).alias("n")))
              .unionByName(firsts).unionByName(nameless))
    return counts.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")), letters


def coalitions(counts: DataFrame, m: int) -> DataFrame:
    """A row a part: ``n`` documents, and the removals of all coalitions (place:
    bit set of filters) of documents, good and toxic ones."""
    def removed(c):
        return F.array(*[F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(c))), F.lit(0)) for s in range(1 << m)])
    return counts.groupBy("part").agg(F.sum("n").alias("n"), removed("n").alias("removed"), removed("good").alias("good"), removed("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, filters=text_filters, copies: str = "E", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley for every part and order of the filters."""
    counts, letters = failures(docs, labels, filters, copies, part)
    m = len(letters)
    full, spark = (1 << m) - 1, docs.sparkSession
    values = shapley_map(m)
    steps = []
    for order in permutations(range(m)):
        before = 0
        for k, f in enumerate(order):
            steps.append((len(steps), "".join(letters[x] for x in order), k + 1, f, before, before | 1 << f))
            before |= 1 << f
    orders = spark.createDataFrame(steps, "place int, filter_order string, step int, f int, before int, after int")
    table = coalitions(counts, m)
    shapley = F.array(*[sum((F.lit(c) * F.element_at("removed", s + 1) for s, c in enumerate(row) if c), F.lit(0)) for row in values])
    table = table.withColumn("values", shapley)

    def at(array, place):
        return F.element_at(array, place + 1)

    def step(array):
        return at(array, F.col("after")) - at(array, F.col("before"))
    alone = F.call_function("shiftleft", F.lit(1), F.col("f"))
    columns = {
        "kept": F.col("n") - at("removed", F.col("after")), "removed": step("removed"),
        "redundant": at("removed", alone) - step("removed"),
        "unique_fails": F.element_at("removed", full + 1) - at("removed", F.lit(full) - alone),
        "good_lost": step("good"), "toxic_lost": step("toxic"), "shapley": F.element_at("values", F.col("f") + 1)}
    # the orders are m! * m rows, whatever the table holds
    table = table.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    return table.join(F.broadcast(orders), "place").select("part", "filter_order", "step", *[c.cast("long").alias(name) for name, c in columns.items()])
