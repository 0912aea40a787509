"""Helpers shared by the operators of this package."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, read_table

__all__ = ["materialize", "read_table", "slices", "text_or_empty", "unsigned_part"]

# Rows turned into Python objects at a time inside a task; bounds memory when
# texts are long, whatever the size of the Arrow batch Spark hands over.
SLICE_ROWS = 128


def slices(batch, rows: int = SLICE_ROWS):
    """Zero-copy slices of an Arrow batch; freed memory goes back to the
    machine afterwards, as a worker lives on for other tasks."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


def text_or_empty(col: str | Column) -> Column:
    """A text column as a string, null read as the empty text."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def unsigned_part(text: Column) -> Column:
    """The first 52 bits of a text's MD5 as a non-negative long; any engine
    with MD5 computes the same number."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns of these names, upper or lower case."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])
