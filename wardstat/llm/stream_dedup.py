"""Operator 7: exact deduplication by a stateful stream.

The documents folder is read as a stream of files.  A streaming aggregation
keyed on the digest of the normalised text keeps, in a disk-backed state
store and without expiry, one entry per digest: how many rows came in, the
stable identifier of the row to keep and its content locator (file and row
number).  When the stream has taken in all files, the state itself is read
as a table, joined to the rows, and every hit is checked on its full bytes
against the content that the locator names.  Rows whose digest is equal and
whose bytes are not form groups of their own.

Scale: the state holds one short entry per distinct text and is spread over
the shuffle partitions; rows of one text are counted before the shuffle.  In
the check of the bytes a group is cut into parts of ``PART`` rows, each with
its own copy of the kept text, so a text that a third of all rows share is
spread over many tasks.  DataFrame and streaming functions only.

Defined results: null counts as empty; of equal texts the row of most code
points, then of smallest id (null ids last), then of smallest locator stays,
so of repeated rows exactly one is kept; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_dir, cut_lineage
from .common import WS

PART = 1000      # rows of a group that are compared with one copy of the kept text
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONF = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE,
         "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
         "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
         # many small stores: no disk space set aside ahead of their logs
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS + "+", "")


def _rows(docs: DataFrame, digest_digits: int, text: bool = False) -> DataFrame:
    """Identifier, digests and locator of every row."""
    sha = F.sha2(F.col("_norm"), 256)
    named = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("points"), normalised(F.col("text")).alias("_norm"),
                        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return named.select("doc_id", "points", sha.alias("text_sha256"), F.substring(sha, 1, digest_digits).alias("digest"),
                        "file", "row", *(["_norm"] if text else []))


def _best() -> Column:
    """The row that stays: most code points, smallest id, smallest locator."""
    return F.min(F.struct((-F.col("points")).alias("order"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"),
                          F.col("file").alias("file"), F.col("row").alias("row")))


def run_stream(spark: SparkSession, path: str, checkpoint: str, digest_digits: int = 64) -> DataFrame:
    """Take in all files of ``path`` that this checkpoint has not seen and
    return the state: digest, group_size, best (order, no_id, id, file, row).
    Running it again after files were added continues from the kept state."""
    schema = spark.read.parquet(path).schema
    path = path.rstrip("/")
    source = f"{path[:-1]}[{path[-1]}]"      # as a pattern the source takes a folder or a single file
    before = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        keyed = (_rows(spark.readStream.schema(schema).parquet(source), digest_digits)
                 .groupBy("digest").agg(F.count("*").alias("group_size"), _best().alias("best")))
        (keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())
        state = spark.read.format("statestore").load(checkpoint)
        size, best = state.schema["value"].dataType.names[:2]
        return cut_lineage(state.select(F.col("key").getField("digest").alias("digest"),
                                        F.col("value").getField(size).alias("group_size"),
                                        F.col("value").getField(best).alias("best")), "dedup_state")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def deduplicate(spark: SparkSession, path: str, checkpoint: str | None = None, digest_digits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    checkpoint = checkpoint or f"{checkpoint_dir(spark)}/dedup-{uuid.uuid4().hex[:12]}"
    docs = spark.read.parquet(path)
    if not docs.head(1):
        return (_rows(docs, digest_digits)
                .select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                        F.lit(True).alias("kept"), "text_sha256"))
    state = run_stream(spark, path, checkpoint, digest_digits)
    rows = cut_lineage(_rows(docs, digest_digits), "dedup_rows")

    # every row with the row that stays for its digest
    named = (rows.join(state, "digest")
             .withColumn("is_best", (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))))
    # full bytes of the rows of groups, by their locators
    parts = F.ceil(F.col("group_size") / PART).cast("long")
    hits = (named.where("group_size > 1")
            .select("file", "row", "digest", "is_best", parts.alias("parts"), F.pmod(F.xxhash64("file", "row"), parts).alias("part")))
    content = docs.select(normalised(F.col("text")).alias("norm"), F.col("_metadata.file_path").alias("file"),
                          F.col("_metadata.row_index").alias("row"))
    found = content.join(hits, ["file", "row"])
    kept = (found.where("is_best").select("digest", F.col("norm").alias("kept_norm"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")))
    differs = cut_lineage(found.where("NOT is_best").join(kept, ["digest", "part"]).where("NOT (norm <=> kept_norm)")
                          .select("file", "row", "digest", "norm"), "dedup_differs")
    plain = named.select("doc_id", "points", "text_sha256", "digest", "file", "row", "group_size", "best", "is_best")
    if not differs.head(1):
        return plain.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", F.col("is_best").alias("kept"), "text_sha256")
    # equal digests of different bytes: such rows are grouped on their whole text
    odd = differs.join(plain.drop("digest", "group_size", "best", "is_best"), ["file", "row"])
    odd_best = odd.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), _best().alias("best"))
    odd_rows = (odd.join(odd_best, ["digest", "norm"])
                .withColumn("is_best", (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))))
    fewer = differs.groupBy("digest").agg(F.count("*").alias("odd"))
    same = (plain.join(differs.select("file", "row"), ["file", "row"], "left_anti").join(fewer, "digest", "left")
            .withColumn("group_size", F.col("group_size") - F.coalesce("odd", F.lit(0))))
    out = ["doc_id", F.col("best.id").alias("keep_id"), "group_size", F.col("is_best").alias("kept"), "text_sha256"]
    return same.select(*out).unionByName(odd_rows.select(*out))
