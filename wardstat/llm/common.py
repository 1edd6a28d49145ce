"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: white space of the contracts: space and tab to carriage return
WS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_row() -> Column:
    """A number of each row of a table read from files, by file and place: the
    same each time the table is read."""
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def by_key(df: DataFrame) -> DataFrame:
    """A side of a join whose sides both grow with the table: rows meet by a
    shuffle, whatever their size.  (A broadcast is built in the driver, so a
    few of tens of MB at a time take all its memory.)"""
    return df.hint("merge")


def join_totals(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``totals``, a grouped aggregate by ``key``
    (never null), by a shuffle.  The null-safe comparison deals the totals anew
    instead of leaving the rows to the aggregate's partitions: only then can AQE
    split the rows of a hot key."""
    of = totals.withColumnRenamed(key, "_key")
    return rows.join(by_key(of), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_labels(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids (doc_id, label) that are not held out.

    ``rows`` is the documented bound of a classifier's training sample; the
    ids kept are those of smallest hash, so the choice does not depend on
    partitioning.  Repeated ids count once with their largest label; null
    ids and null labels are left out.
    """
    return (labels.select("doc_id", F.col(label).cast("int").alias("label"))
            .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max("label").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


def sample_rows(docs: DataFrame, ids: DataFrame, cols: list[str]) -> DataFrame:
    """The sampled documents, one row per id: the sample is bounded by a
    parameter, so it is safe to broadcast its ids."""
    return (docs.select("doc_id", *cols).join(F.broadcast(ids), "doc_id")
            .groupBy("doc_id").agg(F.max("label").alias("label"), *[F.min(c).alias(c) for c in cols]))


class WordHash(dict):
    """word -> feature hash, remembered for frequent words (bounded)."""

    def __init__(self, buckets: int, limit: int = 150_000, normal=None):
        super().__init__()
        self.buckets, self.limit, self.normal = buckets, limit, normal

    def __missing__(self, word: str) -> int:
        key = self.normal(word) if self.normal else word
        h = zlib.crc32(key.encode("utf-8", "surrogatepass")) % self.buckets
        if len(self) < self.limit:
            self[word] = h
        return h
