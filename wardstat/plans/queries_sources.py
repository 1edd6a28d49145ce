"""Registered queries, part 7: sources and sinks as round trips.  A driver
table is written in the format under the shared checkpoint folder, read back
with the library's reader and compared with the Parquet table it came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from ..operators import evaluate as ev
from ..session import stage_folder
from ..sources import tables as src
from . import queries_eval as qe, registry as qb
from .pipeline import cleaning_report, scored
from .registry import register


def _path(spark, name: str) -> str:
    return stage_folder(spark, name)


def _customers(spark, sf):
    """Customers with missing-value tokens in the segment of every 7th row."""
    return src.table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 7 == 0, "None").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), "c_acctbal")


@register("source_csv_tokens", """
SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS c_mktsegment, c_acctbal FROM customer""")
def q_csv(spark, sf):
    c = _customers(spark, sf)
    path = _path(spark, "csv")
    c.write.option("header", True).csv(path)
    return src.read_table(spark, path, c.schema, codes.NA_TOKENS)


@register("source_csv_tolerant", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0""")
def q_csv_tolerant(spark, sf):
    """Every tenth line has a field too many and is skipped."""
    c = src.table(spark, sf, "customer")
    path = _path(spark, "csv_tolerant")
    segment = F.when(F.col("c_custkey") % 10 == 0, F.concat("c_mktsegment", F.lit(",surplus"))).otherwise(F.col("c_mktsegment"))
    # quotes off: the surplus separator is written as it is
    c.select(F.col("c_custkey").cast("string").alias("c_custkey"), segment.alias("c_mktsegment")).write.options(
        header=True, quote="").csv(path)
    return src.read_csv_tolerant(spark, path)


@register("source_csv_quoted_breaks", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey,
  CASE WHEN c_custkey % 3 = 0 THEN 'line 1' || chr(10) || c_mktsegment || ';"x"' ELSE c_mktsegment END AS note FROM customer
UNION ALL SELECT 'c_custkey', 'note' FROM customer WHERE c_custkey % 50 = 0""")
def q_csv_breaks(spark, sf):
    """Many part files with headers, a separator to be found, quoted line breaks
    and separators, and data rows that equal the header."""
    c = src.table(spark, sf, "customer")
    note = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("line 1\n"), "c_mktsegment", F.lit(';"x"'))).otherwise(F.col("c_mktsegment"))
    rows = c.select(F.col("c_custkey").cast("string").alias("c_custkey"), note.alias("note"))
    rows = rows.unionByName(c.filter("c_custkey % 50 = 0").select(F.lit("c_custkey").alias("c_custkey"), F.lit("note").alias("note")))
    path = _path(spark, "csv_breaks")
    rows.repartition(5).write.options(header=True, sep=";", escape='"').csv(path)
    return src.read_csv_tolerant(spark, path, sep=None)


@register("sectioned_map_round_trip", """
SELECT 'nation_' || CAST(c_nationkey AS VARCHAR) AS feature, CAST(c_custkey AS VARCHAR) AS key,
  c_mktsegment || ', "' || CAST(c_nationkey AS VARCHAR) || '"' AS label FROM customer""")
def q_sectioned(spark, sf):
    """A section a nation, the customers as its keys, in several files."""
    c = src.table(spark, sf, "customer")
    label = F.concat(F.lit('"'), "c_mktsegment", F.lit(', ""'), F.col("c_nationkey").cast("string"), F.lit('"""'))
    # sections of about equal size, however many customers a nation has: each file repeats the headers it needs
    keys = c.select("c_nationkey", F.pmod("c_custkey", F.lit(4)).alias("part"), F.lit(1).alias("o"), F.concat_ws(",", F.col("c_custkey").cast("string"), label).alias("value"))
    heads = keys.select("c_nationkey", "part").distinct()
    head = F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"), F.lit(",description"))
    lines = (keys.unionByName(heads.select("c_nationkey", "part", F.lit(0).alias("o"), head.alias("value")))
             .unionByName(heads.select("c_nationkey", "part", F.lit(2).alias("o"), F.lit(",").alias("value"))))
    path = _path(spark, "sections")
    lines.repartition("c_nationkey", "part").sortWithinPartitions("c_nationkey", "part", "o").select("value").write.text(path)
    return src.read_sectioned_map(spark, path)


@register("code_map_round_trip", """
SELECT CAST(c_custkey AS VARCHAR) AS code, c_mktsegment AS value FROM customer""")
def q_code_map(spark, sf):
    """JSON objects of at most 1,000 codes, a file each."""
    c = src.table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 1000).alias("chunk"), F.col("c_custkey").cast("string").alias("code"), "c_mktsegment")
    objects = c.groupBy("chunk").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("code", "c_mktsegment")))).alias("value"))
    path = _path(spark, "code_map")
    objects.write.partitionBy("chunk").text(path)
    return src.read_code_map(spark, path)


@register("report_round_trip", "SELECT metric, value FROM (" + qb.ORACLE["cleaning_report"] + ")")
def q_report_file(spark, sf):
    path = _path(spark, "report")
    src.write_report(cleaning_report(spark, sf), path)
    return src.read_table(spark, path).select("metric", F.col("value").cast("double").alias("value"))


@register("dataset_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def q_dataset(spark, sf):
    path = _path(spark, "dataset")
    src.write_dataset(src.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path, ["o_orderstatus"])
    return src.read_dataset(spark, path).select("o_orderkey", "o_custkey", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


@register("locale_csv_round_trip", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, replace(CAST(CAST(c_acctbal AS DOUBLE) AS VARCHAR), '.', ',') AS c_acctbal FROM customer""")
def q_locale(spark, sf):
    path = _path(spark, "locale")
    src.write_locale_csv(src.table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal")), path)
    return spark.read.option("header", True).option("sep", ";").csv(path)


@register("pr_points_round_trip", qe.PR_POINTS_SQL)
def q_pr_points(spark, sf):
    path = _path(spark, "pr_points")
    src.write_pr_points(ev.pr_curve(scored(spark, sf)), path)
    return src.read_table(spark, path).select(*[F.col(c).cast("double").alias(c) for c in ("threshold", "precision", "recall")])
