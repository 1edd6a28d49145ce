"""The training-data pipeline: five stages over the ``documents`` table, each
written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardstat.llm import bpe_chunks, fm_quality, line_dedup, sieve, simhash_golay, spaced_seeds
from wardstat.llm.common import file_row, table
from wardstat.llm.queries import vocabulary_path
from wardstat.session import checkpoint_dir, cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the factorisation machine accepts (score >= 0.3).
    It learns from the labelled documents of the stage's own input."""
    rows = docs.select("doc_id", "text", "n_chars", F.struct("*").alias("__row"))
    return fm_quality.classify(rows, table(spark, sf_dir, "labels"), keep=["__row"]).where("predicted = 1").select("__row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that an earlier line repeats, exactly or but for an edit.
    Every document stays; n_chars follows the text where lines went.  ``docs``
    is a table read from files, whose rows are told apart by their place."""
    other = F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")])
    numbered = docs.select("doc_id", "text", other.alias("__row"), file_row().alias("__key"))
    kept = line_dedup.deduplicate(numbered, row=F.col("__key"))
    size = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("__row.n_chars")).cast("long")
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": size}
    return kept.select(*[new.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked fingerprints: the one of
    smallest id (null last), then of smallest content hash; of identical rows
    one.  Only the texts of documents in question move: the others pass a
    bitmap of fixed size without a shuffle."""
    content = F.xxhash64(*[c for c in docs.columns if c != "doc_id"])
    rows = docs.select("doc_id", "text", content.alias("h"))
    named = simhash_golay.near_duplicates(rows, shingle=3, max_bits=3, keep=["h"])
    counted = cut_lineage(named.groupBy("root", "doc_id", "h").agg(F.count("*").alias("n")), "simhash_rows")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("h").alias("h"))
    best = counted.groupBy("root").agg(F.min(rank).alias("best"))
    marks = counted.join(best, "root").withColumn("stays", rank.eqNullSafe(F.col("best")))
    asked = cut_lineage(marks.where("n > 1 OR NOT stays").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "stays")
                        .withColumn("key", F.xxhash64("_id", "_h")), "simhash_asked")
    some = cut_lineage(sieve.build(asked, "key"), "simhash_sieve")
    keyed = docs.select(F.struct("*").alias("__row"), "doc_id", content.alias("h")).withColumn("key", F.xxhash64("doc_id", "h"))
    touched = (sieve.sift(keyed, "key", some)
               .join(asked.drop("key"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
               .where("stays IS NULL OR stays").dropDuplicates(["doc_id", "h"]))
    return sieve.sift(keyed, "key", some, inside=False).select("__row.*").unionByName(touched.select("__row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that overlap a benchmark item."""
    return spaced_seeds.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return bpe_chunks.encode_rows(docs, vocabulary_path())


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_duplicates),
          ("benchmark decontamination", decontamination), ("bpe encoding", encoding)]

#: a fitted model, fingerprints, seeds and BPE have no SQL form; the tests hold
#: the pipeline against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    top = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{top}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
