"""Exact k nearest neighbours, SMOTE and Tomek links (#27, #124-#126).

Exact kNN join by quantised approximations, over distinct vectors (copies are
handled in ``knn``):

1. The rows of a block are dealt to tiles of about ``TILE_ROWS`` rows by the
   hash of their id; every pair of tiles of a block is one group, so a block
   of any size is spread over tasks, and a group is bounded.
2. In a group each component is rounded to ``BITS`` bits of a common step.
   With ``e`` the length of what rounding left of a vector, the distance of
   two vectors lies within ``e + e'`` of the distance of their
   approximations, which comes from one product in single precision, whose
   own error is bounded by the vectors' lengths.
3. Each tile is searched alone first: the ``k`` rows of the smallest bounds
   are measured, and only rows whose lower bound is not above the largest of
   them are measured too.  The distance of a row's k-th neighbour in its own
   tile is its limit.
4. A pair of tiles is bounded once for both directions, and only pairs within
   the limit of one of their rows are measured.  ``PAIRS`` pairs are bounded
   at once, so the memory of a group does not depend on its distances.
5. The ``k`` nearest over all groups of a query are its neighbours.

No column grows with the table, and nothing is sent to the driver.  Distances
are squared Euclidean, summed left to right over the vector; ties go by
(md5(key), key).  Rows without a vector, or with a null, NaN or infinite
component, take no part; shorter vectors count as filled up with zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col_of
from ..session import cut_lineage
from .balance import hash_rank, md5_number, md5_text, minority_majority

TILE_ROWS = 16384
#: bits of an approximation's component; 24 at most, what single precision holds
BITS = 24
#: rows of a tile, and pairs, that are bounded and measured at once
QUERY_ROWS = 512
PAIRS = 1 << 20
#: share of a bound that covers the rounding of its own arithmetic
TOLERANCE = 1e-6


def approximate(x: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Integer codes of the rows (less each column's median, in steps of one
    common size), the length of each row's rounding error, and the step."""
    gap = x - np.median(x, axis=0) if len(x) else x
    step = float(np.abs(gap).max(initial=0.0)) / ((1 << bits) - 1) or 1.0
    codes = np.rint(gap / step)
    return codes.astype(np.float32), np.sqrt(((gap - codes * step) ** 2).sum(axis=1)), step


def sides(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two matrices whose rows' products are the squared distances of the codes
    less a bound of their rounding, and each row's part of that bound: with
    ``u = 2^-24``, a product of ``d`` terms is off by ``d u`` of the sum of their
    sizes at most, which is twice the squared lengths."""
    share = (2 * codes.shape[1] + 32) * 2.0 ** -24
    long = np.square(codes, dtype=np.float64).sum(axis=1)
    least, one = ((1 - share) * long).astype(np.float32)[:, None], np.ones((len(codes), 1), np.float32)
    return np.hstack([codes, least, one]), np.hstack([-2 * codes, one, least]), share * long


def bounds(codes: np.ndarray, error: np.ndarray, step: float, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of rows ``a`` to rows ``b``."""
    left, right, off = sides(codes)
    least = left[a] @ right[b].T
    slack = error[a][:, None] + error[b] + TOLERANCE * step
    low = np.sqrt(np.maximum(least, 0, dtype=np.float64)) * step
    high = np.sqrt(np.maximum(least + 2 * (off[a][:, None] + off[b]), 0)) * step
    return low * (1 - TOLERANCE) - slack, high * (1 + TOLERANCE) + slack


def code_limit(limit: np.ndarray, error: np.ndarray, step: float) -> np.ndarray:
    """Squared distances as limits of the products of ``sides``: no row within the limit is above."""
    reach = (np.sqrt(limit) * (1 + TOLERANCE) + 2 * error.max(initial=0.0)) / step + TOLERANCE
    with np.errstate(over="ignore"):
        return np.square(reach * (1 + TOLERANCE)).astype(np.float32)


def measured(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, summed from left to right."""
    out = np.zeros(len(a))
    for at in range(0, len(a), PAIRS):
        part = slice(at, at + PAIRS)
        for d in range(x.shape[1]):
            gap = x[a[part], d] - x[b[part], d]
            out[part] += gap * gap
    return out


def first_k(q: np.ndarray, c: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` pairs of each ``q`` that are first by distance, then ``c``."""
    order = np.lexsort((c, dist, q))
    q, c, dist = q[order], c[order], dist[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], c[kept], dist[kept]


def _parts(n: int, size: int):
    return (slice(at, at + size) for at in range(0, n, size))


def nearest(x: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of rows ``a``, the ``k`` nearest other rows among ``b`` (ties: the first
    of ``b``): pairs (a, b), their squared distances, and how many pairs were
    measured."""
    codes, error, step = approximate(x, bits)
    left, right, _ = sides(codes)
    right = right[b].T
    own, out, n = np.zeros(len(x), np.int64) - 1, [(a[:0], b[:0], np.zeros(0))], 0
    own[b] = np.arange(len(b))
    for part in _parts(len(a), max(1, min(QUERY_ROWS, PAIRS // max(1, len(b))))):
        rows = a[part]
        least = left[rows] @ right
        here = np.flatnonzero(own[rows] >= 0)
        least[here, own[rows[here]]] = np.inf
        wanted = np.ones(least.shape, bool)
        if len(b) > k:
            some = np.argpartition(least, k - 1, axis=1)[:, :k]
            limit = measured(x, np.repeat(rows, k), b[some].ravel()).reshape(-1, k).max(axis=1)
            n += some.size
            wanted = ~(least > code_limit(limit, error, step)[:, None])      # what is no number stays
        wanted[here, own[rows[here]]] = False
        q, c = np.nonzero(wanted)
        n += len(q)
        q, c, dist = first_k(q, c, measured(x, rows[q], b[c]), k)
        out.append((rows[q], b[c], dist))
    return *(np.concatenate(z) for z in zip(*out)), n


class Nearest:
    """The ``k`` first pairs of each query of those added."""

    def __init__(self, k: int):
        self.k, self.parts, self.n = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

    def add(self, q: np.ndarray, c: np.ndarray, dist: np.ndarray) -> None:
        self.parts.append((q, c, dist))
        self.n += len(q)
        if self.n > PAIRS:
            self.pairs()

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.parts, self.n = [first_k(*(np.concatenate(z) for z in zip(*self.parts)), self.k)], 0
        return self.parts[0]


def nearest_across(x: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, limit: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``nearest`` of rows ``a`` among ``b`` and of rows ``b`` among ``a``, which
    have no row in common, as far as within each row's ``limit`` (a squared
    distance)."""
    codes, error, step = approximate(x, bits)
    left, right, _ = sides(codes)
    most, one, two, n = code_limit(limit, error, step), Nearest(k), Nearest(k), 0
    for i in _parts(len(a), QUERY_ROWS):
        for j in _parts(len(b), QUERY_ROWS):
            least = left[a[i]] @ right[b[j]].T
            q, c = np.nonzero(~(least > np.maximum.outer(most[a[i]], most[b[j]])))
            q, c = q + i.start, c + j.start
            dist = measured(x, a[q], b[c])
            n += len(q)
            near, back = ~(dist > limit[a[q]]), ~(dist > limit[b[c]])
            one.add(q[near], c[near], dist[near])
            two.add(c[back], q[back], dist[back])
    (p, q, d), (s, t, e) = one.pairs(), two.pairs()
    return np.concatenate([a[p], b[s]]), np.concatenate([b[q], a[t]]), np.concatenate([d, e]), n


def _rows_of(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    size = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    return out


def _knn_distinct(pts: DataFrame, k: int, block) -> DataFrame:
    """kNN over ``(block.., _id, _v)`` rows whose vectors are distinct within
    a block; ``(_q, nb_key, dist2, nb_rank)``."""
    names = [f"_b{i}" for i in range(len(block))]
    tiles = pts.groupBy(*[col_of(b).alias(n) for b, n in zip(block, names)]).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(TILE_ROWS)).cast("int").alias("_tiles"))
    here = F.lit(True)
    for b, n in zip(block, names):
        here = here & col_of(b).eqNullSafe(F.col(n))
    dealt = pts.join(tiles, here) if block else pts.crossJoin(F.broadcast(tiles))      # without a block, tiles is one row
    dealt = dealt.select(*[col_of(b).alias(n) for b, n in zip(block, names)], "_id", "_v", md5_text("_id").alias("_h"),
                         F.pmod(F.xxhash64("_id"), F.col("_tiles")).cast("int").alias("_tile"), "_tiles")
    kind = pts.schema["_id"].dataType.simpleString()
    schema = f"_q {kind}, nb_key {kind}, dist2 double"

    def result(ids, q, c, dist, _):
        return pa.table({"_q": ids.take(pa.array(q)), "nb_key": ids.take(pa.array(c)), "dist2": pa.array(dist)})

    def inside(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_h", "ascending"), ("_id", "ascending")])
        x = _rows_of(group["_v"])
        return result(group["_id"].combine_chunks(), *nearest(x, np.arange(len(x)), np.arange(len(x)), k))

    def across(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_h", "ascending"), ("_id", "ascending")])
        x, first = _rows_of(group["_v"]), group["_tile"].to_numpy() == group["_i"][0].as_py()
        return result(group["_id"].combine_chunks(), *nearest_across(x, np.flatnonzero(first), np.flatnonzero(~first), k, group["_limit"].to_numpy()))

    # read for the limits and for the result
    own = cut_lineage(dealt.groupBy(*names, "_tile").applyInArrow(inside, schema), "knn_own")
    limits = own.groupBy(F.col("_q").alias("_l")).agg(
        F.when(F.count(F.lit(1)) >= k, F.max("dist2")).otherwise(F.lit(float("inf"))).alias("_limit"))
    limited = dealt.filter(F.col("_tiles") > 1).join(limits, F.col("_id").eqNullSafe(F.col("_l")), "left")
    pairs = limited.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).filter("_other <> _tile").select(
        *names, "_id", "_v", "_h", "_tile", F.coalesce("_limit", F.lit(float("inf"))).alias("_limit"),
        F.least("_tile", "_other").alias("_i"), F.greatest("_tile", "_other").alias("_j"))
    near = own.unionByName(pairs.groupBy(*names, "_i", "_j").applyInArrow(across, schema))
    w = Window.partitionBy("_q").orderBy("dist2", md5_text("nb_key"), "nb_key")
    return near.withColumn("nb_rank", F.row_number().over(w)).filter(F.col("nb_rank") <= k)


def knn(df: DataFrame, key: str, vec: str, k: int = 5, block=()) -> DataFrame:
    """``(key, nb_rank, nb_key, dist2)``: the ``k`` nearest other rows of the
    same ``block`` for every row, exact; ties by (md5(key), key).

    Copies are collapsed first: the search runs over distinct vectors, and
    each row's candidates are its own copies (distance 0) plus the first
    ``k + 1`` members (md5 order) of each neighbouring vector.  A vector
    repeated in a third of all rows is therefore one search point, its
    member ranks come from the bucketed ``hash_rank`` and its rows meet a
    candidate list of at most ``(k + 1)(k + 1)`` entries."""
    block = list(block)
    pts = df.select(*[col_of(b).alias(b) for b in block], col_of(key).alias("_id"),
                    F.transform(col_of(vec), lambda x: x.cast("double")).alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # several passes read the points: write them once (Parquet lineage cut)
    pts = cut_lineage(pts.filter(F.col("_v").isNotNull() & finite), "knn_points")
    # distinct vectors; representative = first member in md5 order
    dv = pts.groupBy(*block, "_v").agg(
        F.min_by("_id", F.struct(md5_text("_id"), F.col("_id"))).alias("_vid"),
        F.count(F.lit(1)).alias("_m"))
    dv = cut_lineage(dv, "knn_vectors")
    named = [f"_b{i}" for i in range(len(block))]
    heads_of = dv.select(*[col_of(b).alias(n) for b, n in zip(block, named)], F.col("_v").alias("_w"), "_vid")
    same = F.col("_v").eqNullSafe(F.col("_w"))
    for b, n in zip(block, named):
        same = same & col_of(b).eqNullSafe(F.col(n))
    withv = pts.join(heads_of, same).drop("_w", *named)
    ranked = hash_rank(withv.select(*block, "_id", "_vid"), block + ["_vid"], "_id", "_mr")
    heads = ranked.filter(F.col("_mr") <= k + 1).select("_vid", F.col("_id").alias("_cand"))
    nn = _knn_distinct(dv.select(*block, F.col("_vid").alias("_id"), "_v"), k, block)
    # candidate list per vector: own copies at 0, heads of neighbour vectors
    own = heads.select("_vid", "_cand", F.lit(0.0).alias("dist2"))
    other = nn.select(F.col("_q").alias("_vid"), F.col("nb_key").alias("_nv"), "dist2") \
        .join(heads.withColumnRenamed("_vid", "_nv"), "_nv").select("_vid", "_cand", "dist2")
    cands = own.unionByName(other)
    pairs = withv.select("_id", "_vid").join(cands, "_vid").filter(F.col("_cand") != F.col("_id"))
    w = Window.partitionBy("_id").orderBy("dist2", md5_text("_cand"), "_cand")
    out = pairs.withColumn("nb_rank", F.row_number().over(w)).filter(F.col("nb_rank") <= k)
    return out.select(F.col("_id").alias(key), "nb_rank", F.col("_cand").alias("nb_key"), "dist2")


def uniform01(seed_text: Column) -> Column:
    """Uniform [0, 1) from 60 bits of md5."""
    return md5_number(seed_text).cast("double") / F.lit(float(1 << 60))


# #124
def smote(df: DataFrame, key: str, vec: str, label: str = "label", minority: int = 1, k: int = 5,
          seed: int = 42) -> DataFrame:
    """Synthetic minority rows until the classes are level.

    Draw ``i`` picks cell ``md5(seed:i:n) mod (n_min k)`` of the minority
    neighbour table (row = rank in md5 order, neighbour = column) and a step
    ``u = md5(seed:i:u) / 2^60``; the new vector is ``x + u (nb - x)``.
    Returns the input rows (``synthetic = 0``) plus the new ones (``= 1``,
    key = -(i + 1))."""
    mino = df.filter(col_of(label) == minority)
    n_min, n_maj = minority_majority(df, label, minority)
    need = n_maj - n_min
    base = df.select(col_of(key).alias(key), F.transform(col_of(vec), lambda x: x.cast("double")).alias(vec),
                     col_of(label).alias(label), F.lit(0).alias("synthetic"), col_of(key).alias("x_key"),
                     F.lit(None).cast(df.schema[key].dataType).alias("nb_key"),
                     F.lit(None).cast("double").alias("u"))
    if need <= 0 or n_min < 2:
        return base
    kk = min(k, n_min - 1)
    nbrs = knn(mino, key, vec, kk)
    ranked = hash_rank(mino.select(key), [], key).withColumnRenamed("_rank", "_row")
    nb = nbrs.join(ranked, key)
    spark = df.sparkSession
    draws = spark.range(need).select(
        F.col("id").alias("_i"),
        F.pmod(md5_number(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"), F.lit(":n"))),
               F.lit(n_min * kk)).alias("_cellno"),
        uniform01(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"), F.lit(":u"))).alias("_u"))
    draws = draws.select("_i", "_u", (F.floor(F.col("_cellno") / kk) + 1).cast("bigint").alias("_row"),
                         (F.col("_cellno") % kk + 1).cast("int").alias("nb_rank"))
    picked = draws.join(nb, ["_row", "nb_rank"])
    vecs = mino.select(col_of(key).alias("_k"), F.transform(col_of(vec), lambda x: x.cast("double")).alias("_x"))
    j = picked.join(vecs, picked[key] == vecs["_k"]).drop("_k") \
        .join(vecs.withColumnRenamed("_k", "_nk").withColumnRenamed("_x", "_nx"),
              F.col("nb_key") == F.col("_nk"))
    new = j.select((-(F.col("_i") + 1)).cast(df.schema[key].dataType).alias(key),
                   F.zip_with("_x", "_nx", lambda x, y: x + F.col("_u") * (y - x)).alias(vec),
                   F.lit(minority).cast(df.schema[label].dataType).alias(label), F.lit(1).alias("synthetic"),
                   F.col(key).alias("x_key"), F.col("nb_key").cast(df.schema[key].dataType).alias("nb_key"),
                   F.col("_u").alias("u"))
    return base.unionByName(new)


# #125
def tomek_links(df: DataFrame, key: str, vec: str, label: str = "label") -> DataFrame:
    """Pairs ``(a, b)`` that are each other's nearest neighbour and have
    different labels (``a < b``)."""
    nn = knn(df, key, vec, 1).select(F.col(key).alias("a"), F.col("nb_key").alias("b"))
    lab = df.select(col_of(key).alias("_k"), col_of(label).alias("_l"))
    mutual = nn.join(nn.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"])
    m = mutual.join(lab.withColumnRenamed("_k", "a").withColumnRenamed("_l", "la"), "a") \
        .join(lab.withColumnRenamed("_k", "b").withColumnRenamed("_l", "lb"), "b")
    return m.filter((F.col("la") != F.col("lb")) & (F.col("a") < F.col("b"))).select("a", "b")


def remove_tomek_links(df: DataFrame, key: str, vec: str, label: str = "label") -> DataFrame:
    """Drop both rows of every Tomek link."""
    links = tomek_links(df, key, vec, label)
    gone = links.select(F.col("a").alias("_k")).unionByName(links.select(F.col("b").alias("_k")))
    return df.join(gone, col_of(key) == F.col("_k"), "left_anti")


# #126
def smote_tomek(df: DataFrame, key: str, vec: str, label: str = "label", minority: int = 1, k: int = 5,
                seed: int = 42) -> DataFrame:
    s = cut_lineage(smote(df, key, vec, label, minority, k, seed))
    return remove_tomek_links(s, key, vec, label)


def rounded_vector(c: str) -> Column:
    return F.transform(F.col(c), lambda x: F.round(x, 6))


__all__ = ["knn", "smote", "tomek_links", "remove_tomek_links", "smote_tomek", "rounded_vector"]
