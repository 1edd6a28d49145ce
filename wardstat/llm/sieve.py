"""A bitmap of fixed size that keeps rows which a join cannot need out of its
shuffle.  Built and tested with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BITS = 1 << 24        # the broadcast bitmap has BITS / 8 bytes at most


def _bit(col: str):
    return F.pmod(F.xxhash64(col), F.lit(BITS)) + 1


def build(ids: DataFrame, col: str) -> DataFrame:
    """Bitmap rows (at most BITS / 32768 of 4 KB) of the hashes of ``col``."""
    at = _bit(col)
    return (ids.select(F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_bit"))
            .groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bitmap")))


def sift(rows: DataFrame, col: str, sieve: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose hash is in the sieve (all that match, and few others), or
    with ``inside`` false the rows that match none for certain."""
    at = _bit(col)
    hit = (rows.withColumn("_bucket", F.bitmap_bucket_number(at)).withColumn("_bit", F.bitmap_bit_position(at))
           .join(F.broadcast(sieve), "_bucket", "left"))
    byte = F.conv(F.hex(F.substring("_bitmap", (F.col("_bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    found = F.coalesce(F.call_function("shiftright", byte, (F.col("_bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return hit.where(found if inside else ~found).drop("_bucket", "_bit", "_bitmap")
