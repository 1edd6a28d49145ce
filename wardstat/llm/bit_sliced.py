"""Operator 13: exact top-k inner products by a bit-sliced index.

Each task holds its rows in blocks, as a bit-sliced index: of every attribute
(component, less the block's least value) the ``keep_bits`` highest bits, one
bitmap over the block's rows for each bit, and their complements.  A query's
component is written in signed binary digits, so its product with an attribute
is a sum of shifted bitmaps (complements for negative digits, whose constants
are added once).  All bitmaps of a weight are added by bitwise full adders,
three to a sum and a carry, until one bitmap for each weight is left: the
bit-sliced coarse scores of all rows.  From the most significant slice down,
rows are split into above and equal until the k best are known; what the cut
low bits can add bounds every score, and the rows at the boundary are scored
exactly from their integers.

Scale: rows never move; the queries, a stated set, are sent in blocks of at most
``query_rows`` rows (a bound of the broadcast), each block a pass that is
written before the next.  A task returns k rows a query.  Copies of a vector
within a block are one row with the k + 1 first ids, so a vector that a third
of all rows share costs no more.

Defined results: vectors null or with null or non-finite components take no
part, as query or as candidate; shorter vectors count as filled up with zeros;
rows of null id are candidates, after all others of the same score; repeated
rows are rows of their own, and each is a candidate for the other; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage_folder
from . import vectors


@dataclass(frozen=True)
class TopKParams:
    k: int = 5
    scale: int = 256
    keep_bits: int = 6                      # slices of an attribute in the coarse sum
    block_rows: int = vectors.BLOCK_ROWS
    query_rows: int = vectors.QUERY_ROWS


def signed_digits(x: np.ndarray) -> np.ndarray:
    """Non-adjacent digits -1, 0, 1 of each number (last axis: weight 1, 2, 4, ...)."""
    x = x.copy()
    out = []
    while x.any() or not out:
        d = np.where(x & 1, 2 - (x & 3), 0)
        out.append(d)
        x = (x - d) >> 1
    return np.stack(out, axis=-1)


class Slices:
    """The bit-sliced index of one block of integer rows."""

    def __init__(self, x: np.ndarray, keep_bits: int):
        self.x, n = x, len(x)
        self.low = x.min(axis=0)
        span = x.max(axis=0) - self.low
        bits = np.array([int(s).bit_length() for s in span], np.int64)
        self.cut = np.maximum(bits - keep_bits, 0)
        self.bits = bits - self.cut
        self.base = np.concatenate([[0], np.cumsum(self.bits)[:-1]]).astype(np.int64)
        planes = int(self.bits.sum())
        words = -(-n // 64)
        packed = np.zeros((2 * planes, words * 8), np.uint8)
        high = (x - self.low) >> self.cut
        for d in range(x.shape[1]):
            for j in range(int(self.bits[d])):
                packed[self.base[d] + j, :-(-n // 8)] = np.packbits((high[:, d] >> j) & 1 != 0, bitorder="little")
        packed[planes:] = ~packed[:planes]
        self.planes, self.maps = planes, packed.view(np.uint64)
        valid = np.zeros(words * 8, np.uint8)
        valid[:-(-n // 8)] = np.packbits(np.ones(n, bool), bitorder="little")
        self.valid = valid.view(np.uint64)
        # pairs (attribute, slice) of the index, and what one of weight 1 stands for
        self.of = np.repeat(np.arange(x.shape[1]), self.bits)
        self.at = np.concatenate([np.arange(b) for b in self.bits]).astype(np.int64) if planes else np.zeros(0, np.int64)

    def add(self, digits: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bit-sliced sum (one bitmap a weight) of the coarse products with a
        query's digits, and the constant of its negative digits."""
        d, t = np.nonzero(digits)
        minus = digits[d, t] < 0
        wide = self.bits[d]
        constant = -int((((1 << wide[minus]) - 1) << (t[minus] + self.cut[d[minus]])).sum())
        which = np.repeat(np.arange(len(d)), wide)
        j = np.arange(len(which)) - np.repeat(np.cumsum(wide) - wide, wide)
        rows = self.base[d[which]] + j + np.where(minus[which], self.planes, 0)
        weight = t[which] + j + self.cut[d[which]]
        rows = rows[np.argsort(weight, kind="stable")]
        ends = np.cumsum(np.bincount(weight)) if len(weight) else []
        out, carried, at, w = [], [], 0, 0
        while w < len(ends) or carried:
            till = int(ends[w]) if w < len(ends) else at
            here = np.concatenate([self.maps[rows[at:till]], *carried]) if carried else self.maps[rows[at:till]]
            carried, at, w = [], till, w + 1
            while len(here) > 2:
                m = len(here) // 3
                x, y, z = here[:m], here[m:2 * m], here[2 * m:3 * m]
                half = x ^ y
                carried.append((x & y) | (half & z))
                half ^= z
                here = np.concatenate([half, here[3 * m:]])
            if len(here) == 2:
                carried.append(here[:1] & here[1:])
                here = here[:1] ^ here[1:]
            out.append(here[0] if len(here) else np.zeros_like(self.valid))
        return out, constant

    def best(self, total: list[np.ndarray], k: int) -> int | None:
        """The k-th largest number of a bit-sliced sum (None: fewer rows)."""
        if len(self.x) < k:
            return None
        above, equal, value = 0, self.valid, 0
        for w in range(len(total) - 1, -1, -1):
            ones = equal & total[w]
            n = int(np.bitwise_count(ones).sum())
            if above + n >= k:
                equal, value = ones, value | 1 << w
            else:
                above, equal = above + n, equal & ~total[w]
        return value

    def at_least(self, total: list[np.ndarray], value: int) -> np.ndarray:
        """Places of the rows whose number is ``value`` or more."""
        if value <= 0:
            return np.arange(len(self.x))
        if value >> len(total):
            return np.zeros(0, np.int64)
        more, equal = np.zeros_like(self.valid), self.valid
        for w in range(len(total) - 1, -1, -1):
            if value >> w & 1:
                equal = equal & total[w]
            else:
                more, equal = more | (equal & total[w]), equal & ~total[w]
        return np.flatnonzero(np.unpackbits((more | equal).view(np.uint8), bitorder="little", count=len(self.x)))

    def candidates(self, q: np.ndarray, digits: np.ndarray, k: int, floor: int | None) -> np.ndarray:
        """Rows that may be among the k best of the block and reach ``floor``."""
        total, constant = self.add(digits)
        constant += int(q @ self.low)
        slack = (np.int64(1) << self.cut) - 1
        least, most = int((slack * np.minimum(q, 0)).sum()), int((slack * np.maximum(q, 0)).sum())
        bound = self.best(total, k)
        bound = None if bound is None else bound + least - most
        if floor is not None:
            bound = max(bound if bound is not None else 0, floor - constant - most)
        return self.at_least(total, 0 if bound is None else bound)


def first_copies(x: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` rows of each distinct vector, in order."""
    if not len(x) or not x.shape[1]:
        return np.arange(min(n, len(x)))
    _, group = np.unique(np.ascontiguousarray(x).view([("", x.dtype)] * x.shape[1]).ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    group = group[order]
    start = np.concatenate([[True], group[1:] != group[:-1]])
    nth = np.arange(len(group)) - np.maximum.accumulate(np.where(start, np.arange(len(group)), 0))
    return np.sort(order[nth < n])


SCHEMA = "query_id long, query_rid long, vec_id long, score long"


def search(batches, queries: dict, p: TopKParams):
    """The k best rows of a task for each query."""
    digits = signed_digits(queries["v"])
    n, width = queries["v"].shape
    # of each query: score, id, whether it is missing; best first
    best = [(np.zeros(0, np.int64),) * 3 for _ in range(n)]
    for table in vectors.blocks(batches, p.block_rows):
        x = vectors.widened(vectors.matrix(table["v"]), width)
        keep = first_copies(x, p.k + 1)
        x, ids, rids = x[keep], table["id"].combine_chunks().take(pa.array(keep)), table["rid"].to_numpy()[keep]
        missing = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.int64)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        index = Slices(x, p.keep_bits)
        for i in range(n):
            q, (score, own, void) = queries["v"][i], best[i]
            found = index.candidates(q, digits[i], p.k + 1, int(score[-1]) if len(score) == p.k else None)
            found = found[rids[found] != queries["rid"][i]]
            if not len(found):
                continue
            score = np.concatenate([score, x[found] @ q])
            own, void = np.concatenate([own, ids[found]]), np.concatenate([void, missing[found]])
            first = np.lexsort((own, void, -score))[:p.k]
            best[i] = score[first], own[first], void[first]
    sizes = [len(s) for s, _, _ in best]
    if sum(sizes):
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(queries["id"], sizes)), pa.array(np.repeat(queries["rid"], sizes)),
            pa.array(np.concatenate([b[1] for b in best]), mask=np.concatenate([b[2] for b in best]) == 1),
            pa.array(np.concatenate([b[0] for b in best]))], names=["query_id", "query_rid", "vec_id", "score"])


def top_k(df: DataFrame, asks: Column, key: str = "vec_id", vec: str = "embedding", p: TopKParams = TopKParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``p.k`` highest inner products of every
    row for which ``asks`` holds with the other rows, ties by smaller id."""
    spark = df.sparkSession
    rows = vectors.prepare(df, key, vec, p.scale, asks)
    out = stage_folder(spark, "top_k")
    spark.createDataFrame([], SCHEMA).write.parquet(out)
    for block in vectors.query_blocks(rows, p.query_rows):
        sent = spark.sparkContext.broadcast(block)
        rows.select("rid", "id", "v").mapInArrow(lambda batches, sent=sent: search(batches, sent.value, p), SCHEMA).write.mode("append").parquet(out)
        sent.destroy()
    best = Window.partitionBy("query_rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (spark.read.schema(SCHEMA).parquet(out).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.k)
            .select("query_id", "rank", "vec_id", "score"))
