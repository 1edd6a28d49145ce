"""Operator 11: hard-negative mining by a secondary-sort shuffle.

For an anchor, rows of the same label are positives, the others negatives;
the score of a row is its integer inner product with the anchor.  Pairs are
packed into byte keys (anchor, descending score, positives first, id), so that
sorting the bytes sorts the pairs.  ``repartitionAndSortWithinPartitions`` by
the anchor brings each anchor's pairs together in order, and an iterator reads
them once: a positive opens a window of negative scores, a negative goes to
every open window that it falls into, and a window closes when it is full.
The iterator holds an anchor's open windows, never its pairs.

Scale: pairs are thinned out before the shuffle, exactly.  A task keeps for
an anchor the positives that can be among the first ``positives`` (its first
ones by score, then id), and once these are known, for each window the first
``negatives`` rows of the task that fall into it; no other row of the task can
be returned.  So an anchor, a label or a vector that a third of all rows share
sends a few keys a task.  The anchors, a stated set, are sent in blocks of at
most ``anchor_rows`` rows with their at most ``positives`` windows each (a
bound of both the broadcast and what the driver sees); each block is written
before the next.

Defined results: rows with a null label, a null vector or null or non-finite
components take no part; shorter vectors count as filled up with zeros; rows of
null id come last among equal scores and are no anchors; repeated rows are rows
of their own; a positive of score 0 takes negatives of score 0, one below 0
takes none; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage_folder
from . import vectors


@dataclass(frozen=True)
class MiningParams:
    positives: int = 5
    negatives: int = 10
    low: int = 30                           # window of a negative's score, in hundredths
    high: int = 90                          # of the positive's score
    scale: int = 256
    block_rows: int = 16_384
    anchor_rows: int = 8_192
    chunk: int = 128                        # anchors scored at once against a block


#: anchor id, anchor row, descending score, 1 for a negative, 1 for a null id, id; all numbers ascend as unsigned bytes
KEY = ">QQQBBQ"
MID = 1 << 63
PAIRS = "a int, rid long, id long, score long"
KEYS = "key binary"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def exact_scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products of rows with rows: by floating point where it is exact."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1] < 2.0 ** 53:
        return np.rint(a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return a @ x.T


def first_by_score(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, of equal ones the earlier places."""
    if len(scores) <= n:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - n)[len(scores) - n]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[:n - len(above)]])


class Kept:
    """The rows a task keeps for each anchor: place, score and row of the pairs
    so far, thinned by ``choose`` when a block has been added."""

    def __init__(self, n: int, choose):
        self.choose, self.of = choose, [None] * n

    def add(self, a: int, places: np.ndarray, scores: np.ndarray, ids, rids, missing):
        new = np.stack([scores[places], missing[places], ids[places], rids[places]])
        if self.of[a] is not None:
            new = np.concatenate([self.of[a], new], axis=1)
            new = new[:, np.lexsort((new[2], new[1]))]        # by id, as the rows of a block
            new = new[:, self.choose(a, new[0])]
        self.of[a] = new

    def batch(self) -> list:
        some = [(a, x) for a, x in enumerate(self.of) if x is not None and x.shape[1]]
        if not some:
            return []
        x = np.concatenate([x for _, x in some], axis=1)
        a = np.repeat(np.array([a for a, _ in some], np.int32), [x.shape[1] for _, x in some])
        return [pa.RecordBatch.from_arrays([pa.array(a), pa.array(x[3]), pa.array(x[2], mask=x[1] == 1), pa.array(x[0])],
                                           names=["a", "rid", "id", "score"])]


def thinned(batches, anchors: dict, p: MiningParams, same_label: bool, choose):
    """Pairs (a, rid, id, score) of a task that ``choose`` keeps."""
    n, width = anchors["v"].shape
    kept = Kept(n, choose)
    for table in vectors.blocks(batches, p.block_rows):
        x = vectors.widened(vectors.matrix(table["v"]), width)
        ids = table["id"].combine_chunks()
        missing = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.int64)
        ids, rids, labels = ids.fill_null(0).to_numpy(zero_copy_only=False), table["rid"].to_numpy(), table["label"].to_numpy()
        for at in range(0, n, p.chunk):
            scores = exact_scores(anchors["v"][at:at + p.chunk], x)
            for a in range(at, min(n, at + p.chunk)):
                eligible = labels == anchors["label"][a]
                eligible = eligible & (rids != anchors["rid"][a]) if same_label else ~eligible
                places = np.flatnonzero(eligible)
                places = places[choose(a, scores[a - at, places])]
                if len(places):
                    kept.add(a, places, scores[a - at], ids, rids, missing)
    yield from kept.batch()


def in_windows(windows: list, scores: np.ndarray, p: MiningParams) -> np.ndarray:
    """Places of the rows that are among the first of one of the windows."""
    some = []
    for positive in set(windows):
        inside = np.flatnonzero((100 * scores <= p.high * positive) & (100 * scores >= p.low * positive))
        some.append(inside[first_by_score(scores[inside], p.negatives)])
    return np.unique(np.concatenate(some)) if some else np.zeros(0, np.int64)


def keys_of(batches, anchors: dict, negative: int):
    """The packed keys of pairs."""
    for b in batches:
        a, score, rid = b.column("a").to_pylist(), b.column("score").to_pylist(), b.column("id").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([
            struct.pack(KEY, int(anchors["id"][k]) + MID, int(anchors["rid"][k]) + MID, MID - 1 - s, negative, i is None, (i or 0) + MID)
            for k, s, i in zip(a, score, rid)], pa.binary())], names=["key"])


def mined(keys, p: MiningParams):
    """Rows of the result from the sorted keys of a partition."""
    now, windows = None, []
    for key, _ in keys:
        anchor, row, score, negative, void, i = struct.unpack(KEY, key)
        if (anchor, row) != now:
            now, windows = (anchor, row), []
        score, i = MID - 1 - score, None if void else i - MID
        if not negative:
            windows.append([i, score, 0])
            continue
        for w in windows:
            if p.low * w[1] <= 100 * score <= p.high * w[1]:
                w[2] += 1
                yield anchor - MID, w[0], w[2], i, w[1], score
        windows = [w for w in windows if w[2] < p.negatives]


def mine(df: DataFrame, anchors: Column, key: str = "vec_id", vec: str = "embedding", label: Column | str = "label",
         p: MiningParams = MiningParams()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    of every row for which ``anchors`` holds."""
    spark = df.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.prepare(df.where(label.isNotNull()), key, vec, p.scale, anchors & F.col(key).isNotNull(), label).select("rid", "id", "label", "asks", "v")
    out = stage_folder(spark, "mining_keys")
    spark.createDataFrame([], KEYS).write.parquet(out)
    best = Window.partitionBy("a").orderBy(F.desc("score"), F.asc_nulls_last("id"), "rid")
    for block in vectors.query_blocks(rows, p.anchor_rows):
        sent = spark.sparkContext.broadcast(block)
        found = rows.mapInArrow(lambda batches, sent=sent: thinned(batches, sent.value, p, True, lambda a, s: first_by_score(s, p.positives)), PAIRS)
        # at most ``positives`` rows for each anchor of the block
        first = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= p.positives).select("a", "rid", "id", "score").toArrow()
        windows: list = [[] for _ in block["id"]]
        for a, s in zip(first["a"].to_pylist(), first["score"].to_pylist()):
            windows[a].append(s)
        opened = spark.sparkContext.broadcast(windows)

        def negatives(batches, sent=sent, opened=opened):
            pairs = thinned(batches, sent.value, p, False, lambda a, s: in_windows(opened.value[a], s, p))
            return keys_of(pairs, sent.value, 1)

        rows.mapInArrow(negatives, KEYS).write.mode("append").parquet(out)
        spark.createDataFrame(pa.Table.from_batches(keys_of(first.to_batches(), block, 0), pa.schema([("key", pa.binary())]))).write.mode("append").parquet(out)
        sent.destroy()
        opened.destroy()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = spark.read.schema(KEYS).parquet(out).rdd.map(lambda r: (bytes(r[0]), None))
    ordered = pairs.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:16]))
    return spark.createDataFrame(ordered.mapPartitions(lambda keys: mined(keys, p)), RESULT)
