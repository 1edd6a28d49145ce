"""Sources and sinks (#1-#9 of the inventory).

Readers return lazy DataFrames; Catalyst prunes columns and pushes filters to
the Parquet scan.  Sinks write with Spark writers (no driver-side file I/O).
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes
from ..functions.columns import col_of, null_if_tokens

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (Parquet)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# #1 -----------------------------------------------------------------------
def apply_na_tokens(df: DataFrame, na_tokens=codes.NA_TOKENS) -> DataFrame:
    """Missing-value tokens in string columns to null (explicit list: Spark's
    CSV reader does not treat the text 'None' as missing)."""
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[null_if_tokens(c, na_tokens).alias(c) if c in strings else col_of(c)
                       for c in df.columns])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               na_tokens=codes.NA_TOKENS, sep: str = ",") -> DataFrame:
    """Headered CSV with an explicit schema; listed tokens become null."""
    r = spark.read.option("header", True).option("sep", sep)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", False)
    return apply_na_tokens(r.csv(path), na_tokens)


# lines of text files, in the order of their file ---------------------------
def _lines(spark: SparkSession, path) -> DataFrame:
    """``file, block, n, line``: the lines of text files (one or many, a folder
    too) with their file, the start of their split in it, and a number that
    ascends inside a split.  Bytes are kept as read but for a carriage return
    at the end."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))


def _before(lines: DataFrame, state: Column, carry) -> DataFrame:
    """``carry(state, window)`` over the lines of each file, split by split: the
    lines with ``_own`` (over the lines of the split so far) and ``_till`` (over
    the splits before it, one row each)."""
    inside = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_own", carry(state, inside))
    ends = lines.groupBy("file", "block").agg(F.max_by("_own", "n").alias("_end"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("file", "block", carry(F.col("_end"), earlier).alias("_till"))
    return lines.join(starts, ["file", "block"])


# #2 -----------------------------------------------------------------------
SEPARATORS = (",", ";", "\t", "|")


def detect_separator(lines: DataFrame) -> str:
    """The separator that is most frequent, outside of quotes, in the first
    lines of the files (one row a file, counted before the driver sees them)."""
    first = lines.filter(F.col("block") == 0).groupBy("file").agg(F.min_by("line", "n").alias("line"))
    plain = F.regexp_replace("line", '"[^"]*"', "")
    counts = first.agg(*[F.sum(F.length(plain) - F.length(F.replace(plain, F.lit(s), F.lit("")))).alias(f"c{i}")
                         for i, s in enumerate(SEPARATORS)]).first()
    return SEPARATORS[max(range(len(SEPARATORS)), key=lambda i: (counts[i] or 0, -i))]


def _quote_steps(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line that begins outside (inside) of a quoted field ends inside
    of one.  A quote opens a field at its start only and closes it at its end
    only, so a lone quote inside a field is text."""
    s = re.escape(sep)
    whole = rf'(?:(?<=^)|(?<={s}))"(?:[^"]|"")*+"(?={s}|$)'
    opened = rf'(?:^|{s})"'
    closing = rf'^(?:[^"]|"")*+"(?={s}|$)'
    outside = F.regexp_like(F.regexp_replace(line, whole, ""), F.lit(opened))
    after = F.regexp_replace(line, closing, "")
    inside = F.when(F.regexp_like(line, F.lit(closing)), F.regexp_like(F.regexp_replace(after, whole, ""), F.lit(opened))).otherwise(F.lit(True))
    return outside, inside


def csv_records(lines: DataFrame, sep: str) -> DataFrame:
    """``file, block, n, line``: lines joined to records where a quoted field
    holds line breaks, also across the splits of a file.

    Each line maps the state before it (outside 0, inside 1) to the state after:
    it sets it, keeps it or turns it.  The state before a line is the last one
    set, turned as often as lines since then say; so it needs running counts
    only, by split and from split to split.  A record is then a run of lines up
    to the first that ends outside."""
    out, ins = _quote_steps(F.col("line"), sep)
    steps = lines.select("*", out.alias("_0"), ins.alias("_1"))
    turns = (F.col("_0") & ~F.col("_1")).cast("int")
    sets = F.when(F.col("_0") == F.col("_1"), F.col("_0").cast("int"))
    split = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("file", "block", "n", "line", F.sum(turns).over(split).alias("_turns"), sets.alias("_set"))
    steps = steps.withColumn("_last", F.last(F.when(F.col("_set").isNotNull(), F.struct(F.col("_set").alias("s"), F.col("_turns").alias("t"))), True).over(split))
    ends = steps.groupBy("file", "block").agg(F.max_by(F.struct("_turns", "_last"), "n").alias("e"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_all", F.coalesce(F.sum("e._turns").over(earlier), F.lit(0)))
    ends = ends.withColumn("_set", F.last(F.when(F.col("e._last").isNotNull(), F.struct(
        F.col("e._last.s").alias("s"), (F.col("_all") + F.col("e._last.t")).alias("t"))), True).over(earlier))
    begins = F.when(F.col("_set").isNull(), F.col("_all") % 2).otherwise((F.col("_set.s") + F.col("_all") - F.col("_set.t")) % 2)
    steps = steps.drop("_set").join(ends.select("file", "block", begins.alias("_start")), ["file", "block"])
    after = F.when(F.col("_last").isNull(), (F.col("_start") + F.col("_turns")) % 2).otherwise(
        (F.col("_last.s") + F.col("_turns") - F.col("_last.t")) % 2)
    # a line begins a record where the line before it ends outside
    steps = steps.withColumn("_inside", after)
    steps = steps.withColumn("_begins", F.coalesce(F.lag("_inside").over(Window.partitionBy("file", "block").orderBy("n")), F.col("_start")) == 0)
    own = F.last(F.when(F.col("_begins"), F.struct("block", "n")), True).over(split)
    steps = steps.withColumn("_own", own)
    heads = steps.groupBy("file", "block").agg(F.max_by("_own", "n").alias("_end"))
    heads = heads.select("file", "block", F.last("_end", True).over(earlier).alias("_from"))
    steps = steps.join(heads, ["file", "block"]).withColumn("_r", F.coalesce("_own", "_from"))
    return steps.groupBy("file", "_r").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "line"))), lambda x: x["line"]), "\n").alias("line")
    ).select("file", "_r.block", "_r.n", "line")


def read_csv_tolerant(spark: SparkSession, path, sep: str | None = ",",
                      schema: T.StructType | None = None) -> DataFrame:
    """Headered CSV files (each with a header of its own): malformed records are
    skipped, text is UTF-8 or, line by line, Latin-1, quoted fields may hold line
    breaks, and ``sep=None`` finds the separator from the headers.

    The text reader keeps each line's bytes; lines that are not valid UTF-8
    are decoded from those bytes as Latin-1.  Records with a wrong field count
    or that the CSV parser rejects are dropped; the first record of each file
    is its header, by its place (a data row that equals it stays).  Columns
    are those of the first file's header, by position.
    """
    fixed = F.when(F.is_valid_utf8("line"), F.col("line")).otherwise(F.decode(F.col("line").cast("binary"), "ISO-8859-1"))
    lines = _lines(spark, path).withColumn("line", F.regexp_replace(fixed, "\r$", ""))
    sep = detect_separator(lines) if sep is None else sep
    records = csv_records(lines, sep)
    # the first record of each file begins with its first line
    first = lines.filter(F.col("block") == 0).groupBy(F.col("file").alias("_f")).agg(F.min("n").alias("_n"))
    if schema is None:
        header = records.join(first, (F.col("file") == F.col("_f")) & (F.col("n") == F.col("_n")) & (F.col("block") == 0)).orderBy("file").first()
        if header is None:
            return spark.createDataFrame([], T.StructType([]))
        names = [n.strip().strip('"') for n in header["line"].split(sep)]      # one row to the driver
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    with_bad = T.StructType(list(schema.fields) + [T.StructField("_bad", T.StringType())])
    s = re.escape(sep)
    fields = F.size(F.split(F.regexp_replace("line", rf'(?:(?<=^)|(?<={s}))"(?:[^"]|"")*+"(?={s}|$)', "x"), s, -1))
    data = records.join(first, (F.col("file") == F.col("_f")) & (F.col("n") == F.col("_n")) & (F.col("block") == 0), "left_anti")
    parsed = data.filter(F.col("line") != "").select(
        F.from_csv("line", ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                                     for f in with_bad.fields),
                   {"sep": sep, "mode": "PERMISSIVE", "multiLine": "true", "escape": '"', "quote": '"',
                    "columnNameOfCorruptRecord": "_bad"}).alias("r"),
        (fields == len(schema.fields)).alias("_ok"))
    return parsed.filter(F.col("_ok") & F.col("r._bad").isNull()).select(
        *[F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields])


# #3 -----------------------------------------------------------------------
def read_sectioned_map(spark: SparkSession, path) -> DataFrame:
    """Stacked CSV of several ``<feature>,description`` sections separated by
    blank rows, in one file or many -> ``(feature, key, label)``.

    The last header before a line is carried forward in the order of its file:
    inside a split by a window over the split, from split to split over one
    row a split.  Header / blank rows are dropped.  All text is kept as text
    (no NA parsing), keys are trimmed.
    """
    lines = _lines(spark, path).withColumn("line", F.regexp_replace("line", "\r$", ""))
    key = F.trim(F.substring_index("line", ",", 1))
    rest = F.expr("substring(line, length(substring_index(line, ',', 1)) + 2)")
    label = F.regexp_replace(F.regexp_replace(rest, r'^"|"$', ""), '""', '"')
    is_header = F.lower(F.trim(rest)) == "description"
    tagged = lines.select("file", "block", "n", key.alias("key"), label.alias("label"), F.when(is_header, key).alias("hdr"))
    tagged = _before(tagged, F.col("hdr"), lambda state, window: F.last(state, ignorenulls=True).over(window))
    return (tagged.filter(F.col("hdr").isNull() & (F.col("key") != ""))
            .select(F.coalesce("_own", "_till").alias("feature"), "key", "label"))


# #4 -----------------------------------------------------------------------
def read_code_map(spark: SparkSession, path: str, value_type: str = "string") -> DataFrame:
    """JSON object file -> ``(code, value)`` rows."""
    txt = spark.read.option("wholetext", True).text(path)
    m = F.from_json("value", f"map<string,{value_type}>")
    return txt.select(F.explode(m).alias("code", "value"))


# #5 -----------------------------------------------------------------------
def write_dataset(df: DataFrame, path: str, partition_by=None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# #6 -----------------------------------------------------------------------
def write_report(report: DataFrame, path: str) -> None:
    """``(metric, value)`` report as one headered CSV file (tiny aggregate)."""
    (report.select(F.col("metric").cast("string"), F.col("value").cast("string"))
     .coalesce(1).write.mode("overwrite").option("header", True).csv(path))


# #7 -----------------------------------------------------------------------
def locale_format(df: DataFrame, decimal: str = ",") -> DataFrame:
    """Doubles as text with a decimal comma (the rows a locale CSV holds)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(F.regexp_replace(F.col(f"`{f.name}`").cast("string"), r"\.", decimal)
                       .alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def write_locale_csv(df: DataFrame, path: str, sep: str = ";", decimal: str = ",") -> None:
    """Part files of a folder, each with its header."""
    (locale_format(df, decimal).write.mode("overwrite")
     .option("header", True).option("sep", sep).csv(path))


# #8 -----------------------------------------------------------------------
def write_pr_points(points: DataFrame, path: str) -> None:
    """Threshold / precision / recall points of ``pr_curve`` as CSV."""
    (points.select("threshold", "precision", "recall").orderBy("threshold")
     .write.mode("overwrite").option("header", True).csv(path))
