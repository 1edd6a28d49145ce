"""The ``encounters`` adapter view: the study's 50-column raw encounter table
derived from the driver's ``orders`` / ``lineitem`` / ``customer`` tables.

One row per order (encounter = order, patient = customer).  All formulas are
integer or text so a second engine reproduces every cell exactly.  The
30-day label is the gap to the same customer's next order.

Scale notes
-----------
* ``lineitem`` is reduced to one row per order with a partial (map-side)
  aggregate before any shuffle; a hot order key only costs its partial rows.
* The "next order" label is computed per (customer, day), not with one window
  per customer: a customer holding a third of all orders is spread over its
  distinct days; the only per-customer window runs over the per-day rows,
  which are bounded by the number of calendar days in the data.
* ``customer`` is data-sized, so it is joined by key (AQE may still turn it
  into a broadcast at run time and splits skewed partitions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes
from .tables import table

# FIXED VALUES of the adapter (our own encoding, mirrored by the oracle SQL)
PAYER_CODES = ["MC", "HM", "SP", "BC", "MD", "CP", "UN"]
SPECIALTIES = ["InternalMedicine", "Emergency/Trauma", "Family/GeneralPractice",
               "Cardiology", "Surgery-General", "Nephrology", "Orthopedics"]
A1C_VALUES = [">7", ">8", "Norm"]
GLU_VALUES = [">200", ">300", "Norm"]
DIAG_MULTIPLIERS = [3, 5, 7]
MED_VALUES = {1: "Steady", 2: "Up", 3: "Down"}  # any other residue is "No"


def med_modulus(i: int) -> int:
    """Cycle length of medication column number ``i`` (1-based)."""
    return 4 + (i % 3) * 3


def pick(idx: Column, values) -> Column:
    """``values[idx]`` for a 0-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _s(c: Column) -> Column:
    return c.cast("string")


def diag_code(h: Column) -> Column:
    x = h % 997 % 100
    x2 = F.lpad(_s(x), 2, "0")
    diab = (F.when(x == 0, F.lit("250"))
            .when(x % 10 == 0, F.concat(F.lit("250."), F.substring(x2, 1, 1)))
            .otherwise(F.concat(F.lit("250."), x2)))
    n = h % 1000
    plain = F.when(h % 9 == 4, F.concat(_s(n), F.lit("."), _s(h % 10))).otherwise(_s(n))
    return (F.when(h % 50 == 0, F.lit("?"))
            .when(h % 40 == 1, F.concat(F.lit("V"), F.lpad(_s(h % 90), 2, "0")))
            .when(h % 40 == 21, F.concat(F.lit("E"), _s(800 + h % 200)))
            .when(h % 6 == 2, diab)
            .otherwise(plain))


def per_order_lines(lineitem: DataFrame) -> DataFrame:
    flag = F.col("l_returnflag")
    return lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        F.sum(F.when(flag == "A", 1).otherwise(0)).alias("n_a"),
        F.sum(F.when(flag == "N", 1).otherwise(0)).alias("n_n"),
        F.sum(F.when(flag == "R", 1).otherwise(0)).alias("n_r"),
        F.min("l_partkey").alias("p_min"),
        F.max("l_partkey").alias("p_max"))


def next_order_gap(orders: DataFrame) -> DataFrame:
    """``(o_orderkey, gap_days)``: days to the customer's next order by
    (date, orderkey); null for the last order.  Skew-safe (see module doc)."""
    od = orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    per_day = od.groupBy("o_custkey", "d").agg(F.max("o_orderkey").alias("last_k"))
    w = Window.partitionBy("o_custkey").orderBy("d")
    per_day = per_day.withColumn("next_d", F.lead("d").over(w))
    j = od.join(per_day, ["o_custkey", "d"])
    gap = F.when(F.col("o_orderkey") < F.col("last_k"), F.lit(0)) \
        .otherwise(F.datediff("next_d", "d"))
    return j.select("o_orderkey", gap.alias("gap_days"))


def encounter_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined, narrow per-order table every encounter column derives
    from: keys, market segment, line aggregates and the next-order gap."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    base = (orders.join(next_order_gap(orders), "o_orderkey")
            .join(per_order_lines(lineitem), F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left"))
    return base.select("o_orderkey", "o_custkey", "c_mktsegment", "n_lines", "qty", "n_a", "n_n", "n_r",
                       "p_min", "p_max", "gap_days")


_COLUMNS: list = []


def encounter_columns() -> list:
    """The 50 encounter columns as expressions over ``encounter_base`` (built
    once: they refer to columns by name and apply to any base table)."""
    if _COLUMNS:
        return _COLUMNS
    k = F.col("o_orderkey")
    c = F.col("o_custkey")
    z = lambda name: F.coalesce(F.col(name), F.lit(0))
    n_lines, qty, p_min, p_max = z("n_lines"), z("qty"), z("p_min"), z("p_max")
    band = (c % 10) * 10

    cols = [
        k.alias("encounter_id"),
        c.alias("patient_nbr"),
        F.when(k % 45 == 0, F.lit("?")).otherwise(F.col("c_mktsegment")).alias("race"),
        F.when(c % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")).alias("gender"),
        F.concat(F.lit("["), _s(band), F.lit("-"), _s(band + 10), F.lit(")")).alias("age"),
        F.when(k % 100 < 97, F.lit("?")).otherwise(
            F.concat(F.lit("["), _s((k % 4) * 25), F.lit("-"), _s((k % 4) * 25 + 25),
                     F.lit(")"))).alias("weight"),
        (1 + k % 8).cast("int").alias("admission_type_id"),
        (1 + (7 * k) % 30).cast("int").alias("discharge_disposition_id"),
        (1 + (11 * k) % 26).cast("int").alias("admission_source_id"),
        F.least(F.lit(14), 1 + n_lines).cast("int").alias("time_in_hospital"),
        F.when(k % 100 < 40, F.lit("?")).otherwise(pick(k % 7, PAYER_CODES)).alias("payer_code"),
        F.when(k % 100 < 49, F.lit("?")).otherwise(pick(k % 7, SPECIALTIES))
        .alias("medical_specialty"),
        (qty % 133).cast("int").alias("num_lab_procedures"),
        (p_min % 7).cast("int").alias("num_procedures"),
        (1 + p_max % 80).cast("int").alias("num_medications"),
        z("n_a").cast("int").alias("number_outpatient"),
        z("n_n").cast("int").alias("number_emergency"),
        z("n_r").cast("int").alias("number_inpatient"),
    ]
    for i, m in enumerate(DIAG_MULTIPLIERS, start=1):
        cols.append(diag_code(p_max * m + k).alias(f"diag_{i}"))
    cols += [
        (1 + (p_min + p_max) % 16).cast("int").alias("number_diagnoses"),
        F.when(k % 100 < 95, F.lit("None")).otherwise(pick(k % 3, GLU_VALUES))
        .alias("max_glu_serum"),
        F.when(k % 100 < 83, F.lit("None")).otherwise(pick(k % 3, A1C_VALUES))
        .alias("A1Cresult"),
    ]
    for i, name in enumerate(codes.MEDICATIONS, start=1):
        if name in codes.CONSTANT_MEDICATIONS:
            cols.append(F.lit("No").alias(name))
            continue
        r = (k + i) % med_modulus(i)
        e = F.lit("No")
        for v in sorted(MED_VALUES, reverse=True):
            e = F.when(r == v, F.lit(MED_VALUES[v])).otherwise(e)
        cols.append(e.alias(name))
    gap = F.col("gap_days")
    cols += [
        F.when(k % 2 == 0, F.lit("Ch")).otherwise(F.lit("No")).alias("change"),
        F.when(k % 4 > 0, F.lit("Yes")).otherwise(F.lit("No")).alias("diabetesMed"),
        F.when(gap.isNull(), F.lit("NO")).when(gap < 30, F.lit("<30"))
        .otherwise(F.lit(">30")).alias("readmitted"),
    ]
    _COLUMNS.extend(cols)
    return _COLUMNS


def encounters_from_base(base: DataFrame) -> DataFrame:
    return base.select(*encounter_columns())


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encounters_from_base(encounter_base(spark, sf_dir))
