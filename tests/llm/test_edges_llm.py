"""Nulls, empty and long texts, repeated rows, empty tables and extra columns
with clashing names: each operator, query and pipeline stage has a defined
result for them."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardstat.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30000
ROWS = [(1, "Some plain text here, long enough to stay.", "en", "s", 42), (1, "Some plain text here, long enough to stay.", "en", "s", 42),
        (2, None, None, None, None), (3, "", "en", "s", 0), (None, "no id at all, but a text", "en", None, 24), (4, LONG, "en", "s", len(LONG)),
        (5, " \t\n", "en", "s", 3), (6, "Some plain text here, long enough to stay!", "en", "s", 42), (None, None, None, None, None)]
VECS = [(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (100, [0.5, 0.25], 1), (3, [0.25, 0.25], 2), (None, [0.25, 0.25], 3), (5, None, 1),
        (6, [0.5, None], 1), (7, [0.5, float("nan")], 1), (8, [0.5], None), (9, [], 1), (None, None, None)]
#: rows of the result on the full tables, where it isn't a row a document
SIZES = {"op5": 5, "op11": 4, "op12": 2 * 600, "op13": 15}
CLASH = ["score", "held_out", "predicted", "overlaps", "fp", "root", "h", "key", "row", "id", "_text", "line", "pos", "n_lines", "dropped",
         "component_id", "label", "digest", "chunk", "base", "spans", "keep_id"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    def write(name, rows, extra):
        top = str(tmp_path_factory.mktemp(name))
        docs = spark.createDataFrame(rows, DOCS)
        for c in extra:
            docs = docs.withColumn(c, F.lit("x"))
        docs.write.parquet(f"{top}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (6, 1, 0)] if rows else [],
                              "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
        spark.createDataFrame([(1, None), (2, ""), (None, "seven words that stand nowhere else here")] if rows else [],
                              "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
        pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u", "<p>x"), (3, "u", "<p>" + LONG), (3, "u", "<p>" + LONG)] if rows else [],
                                      "page_id long, url string, html string")
        for c in extra:
            pages = pages.withColumn(c, F.lit("x"))
        pages.write.parquet(f"{top}/pages.parquet")
        vecs = spark.createDataFrame(VECS if rows else [], "vec_id long, embedding array<float>, label int")
        for c in extra:
            if c != "label":
                vecs = vecs.withColumn(c, F.lit("x"))
        vecs.write.parquet(f"{top}/embeddings.parquet")
        return top
    return {"full": write("full", ROWS, []), "clash": write("clash", ROWS, CLASH), "empty": write("empty", [], []), "empty_clash": write("ec", [], CLASH)}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_on_edge_tables(spark, folder, name):
    results = {}
    for kind, top in folder.items():
        results[kind] = [r.asDict() for r in queries.QUERIES[name](spark, top).collect()]
    assert results["empty"] == results["empty_clash"] == []
    def plain(rows):
        return sorted(str(sorted((k, v) for k, v in r.items() if k not in ("url",))) for r in rows)
    assert plain(results["full"]) == plain(results["clash"])
    assert len(results["full"]) == SIZES.get(name.split("_")[0], len(ROWS))


def test_stages_on_edge_tables(spark, folder, tmp_path):
    for kind in ("full", "clash", "empty"):
        docs = spark.read.parquet(f"{folder[kind]}/documents.parquet")
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder[kind])
            if k < 4:
                assert out.columns == columns
            out.write.parquet(f"{tmp_path}/{kind}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{kind}{k}")
        if kind == "empty":
            assert docs.count() == 0


def test_near_duplicate_stage_keeps_one_of_each_group(spark, folder):
    rows = [(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (1, "other words entirely in here", "en", "s", 28), (2, "A b c d", "en", "s", 7),
            (None, None, None, None, None), (None, "", "en", "s", 0), (None, "words of a row without id", "en", "s", 25), (7, "lone text of its own", "en", "s", 20)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), folder["full"]).collect()
    texts = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")) for r in got)
    assert texts == [(False, 1, "a b c d"), (False, 1, "other words entirely in here"), (False, 7, "lone text of its own"),
                     (True, 0, ""), (True, 0, "words of a row without id")]


def test_pipeline_run(spark):
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got and {r.doc_id for r in got} <= docs and len({r.doc_id for r in got}) == len(got)
