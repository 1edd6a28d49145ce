"""Quantised vectors for the operators on embeddings: one written table of
integer rows, and a stated query set read from it in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

#: rows that a task holds as one matrix
BLOCK_ROWS = 65_536
#: queries that are sent to the executors at once
QUERY_ROWS = 16_384
#: largest magnitude of a quantised component; scores then fit a long up to 2^9 components
LARGEST = 1 << 26


def quantised(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double.  A component beyond
    ``LARGEST`` ends the job with an error, since scores would leave a long."""
    def whole(x):
        y = F.floor(F.lit(float(scale)) * x)
        return F.when(F.abs(x) * scale > LARGEST, F.raise_error(F.lit("a component is too large for exact scores")).cast("long")).otherwise(y)
    return F.transform(vec.cast("array<double>"), whole)


def usable(vec: Column) -> Column:
    """Not null, and all components present and finite."""
    return F.coalesce(vec.isNotNull() & F.forall(
        vec.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def prepare(df: DataFrame, key: str, vec: str, scale: int, asks: Column, label: Column | None = None) -> DataFrame:
    """The written table ``rid, id, label, asks, v``: rows with a usable vector,
    a row number of their own, and whether they are queries (null: not)."""
    rows = df.where(usable(F.col(vec)))
    rows = rows.select(F.col(key).cast("long").alias("id"), (F.lit(0) if label is None else label).cast("long").alias("label"),
                       F.coalesce(asks, F.lit(False)).alias("asks"), quantised(F.col(vec), scale).alias("v"))
    return cut_lineage(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")


def matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Rows of integers; shorter vectors are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy().astype(np.int64)
    size, flat = np.diff(ends), column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]] if len(column) else np.zeros(0, np.int64)
    width = int(size.max(initial=0))
    if len(size) and size.min() == width:
        return flat.reshape(len(size), width).astype(np.int64)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    """``width`` columns of ``x``, zeros where it has fewer."""
    if x.shape[1] >= width:
        return x[:, :width]
    return np.hstack([x, np.zeros((len(x), width - x.shape[1]), np.int64)])


def order_of(ids: pa.Array) -> np.ndarray:
    """Place of each row by id, null last; rows of one id in their given order."""
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    return np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), missing))


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The record batches of a task as tables of at most ``rows`` rows, sorted by id."""
    held, n = [], 0

    def sorted_rows(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        return t.take(pa.array(order_of(t["id"].combine_chunks() if isinstance(t["id"], pa.ChunkedArray) else t["id"])))

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == rows:
                yield sorted_rows(held)
                held, n = [], 0
    if n:
        yield sorted_rows(held)


def query_blocks(prepared: DataFrame, rows: int) -> Iterator[dict]:
    """The queries as blocks of at most ``rows`` rows.  The driver holds one
    block at a time, read partition by partition."""
    held: list = []

    def block():
        width = max((len(r.v) for r in held), default=0)
        return {"rid": np.array([r.rid for r in held], np.int64), "id": np.array([r.id for r in held], np.int64),
                "label": np.array([r.label for r in held], np.int64),
                "v": np.array([list(r.v) + [0] * (width - len(r.v)) for r in held], np.int64).reshape(len(held), width)}

    for row in prepared.where("asks").select("rid", "id", "label", "v").toLocalIterator():
        held.append(row)
        if len(held) == rows:
            yield block()
            held = []
    if held:
        yield block()
