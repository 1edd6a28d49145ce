"""The registered queries of this subpackage: each binds one operator, with
production parameters, to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bit_sliced, bpe_chunks, filter_audit, fm_quality, ftrl_toxicity, hard_negatives, line_dedup, pii_disclosure, simhash_golay, spaced_seeds, stream_dedup, suffix_dedup, text_density
from .common import file_row, table
from .oracle import ORACLE  # noqa: F401

#: vocabulary of the BPE query, in the public_tokenizers package
VOCABULARY = "byte_bpe_50k.json"

QUERIES: dict = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_fm_quality(spark, sf_dir):
    return fm_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_simhash_golay(spark, sf_dir):
    return simhash_golay.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


@query
def op3_ftrl_toxicity(spark, sf_dir):
    return ftrl_toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.cut(table(spark, sf_dir, "documents"), length=50, row=file_row())


@query
def op5_text_density(spark, sf_dir):
    return text_density.extract(table(spark, sf_dir, "pages"))


@query
def op6_segment_line_dedup(spark, sf_dir):
    kept = line_dedup.deduplicate(table(spark, sf_dir, "documents"), row=file_row())
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op7_stream_dedup(spark, sf_dir):
    return stream_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


@query
def op8_pii_disclosure(spark, sf_dir):
    return pii_disclosure.digest(pii_disclosure.find(table(spark, sf_dir, "documents")))


@query
def op9_bpe_chunks(spark, sf_dir, vocabulary=None):
    return bpe_chunks.encode_rows(table(spark, sf_dir, "documents"), vocabulary or vocabulary_path())


@query
def op10_spaced_seed_decontamination(spark, sf_dir):
    found = spaced_seeds.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct("overlaps.item_id"))
    return found.select(
        "doc_id", (F.size("overlaps") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"),
        F.array_join(ids.cast("array<string>"), ",").alias("items"),
        F.array_join(F.transform("overlaps", lambda o: F.concat_ws(":", o["item_id"], o["first"], o["last"])), ",").alias("runs"))


@query
def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


@query
def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_bit_sliced_top_k(spark, sf_dir):
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
