"""Sizes of batches, and caps on them. A cap is on a whole batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.plans.model import Field, Schema

#: Bytes of one value in a column buffer, and of a constant with its length.
WIDTHS = {"U16Dictionary": 2, "U64BitmaskDictionary": 8, "I32": 4, "U32": 4, "I64": 8, "F32": 4, "F64": 8}
CONSTANT = 10
OFFSET_LIMIT = (1 << 31) - 1


def bitmap(rows: Column) -> Column:
    """Bytes of one bit a row, in words of 64."""
    return F.ceil(rows / 64) * 8


def column_bytes(f: Field, rows: Column) -> Column:
    """Bytes of a physical column's buffers over a group of rows; rows is how many."""
    validity = bitmap(rows) if f.bit is not None else F.lit(0)
    c = F.col(f.column)
    if f.kind == "ConstU16":
        return F.lit(CONSTANT).cast("long")
    if f.kind == "Bool":
        return bitmap(rows) + validity
    if f.element:
        return (rows + 1) * 4 + F.coalesce(F.sum(F.size(c)), F.lit(0)) * WIDTHS[f.element] + validity
    if f.kind in ("RawString", "Bytes"):
        return (rows + 1) * 4 + F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) + validity
    return rows * WIDTHS[f.kind] + validity


def columnar_size(rows: DataFrame, schema: Schema) -> DataFrame:
    """(batch_id, n_rows, columnar_bytes) of physical rows."""
    n = F.count("*")
    total = F.lit(0).cast("long")
    for f in schema.fields:
        total = total + column_bytes(f, n)
    return rows.groupBy("batch_id").agg(n.alias("n_rows"), total.cast("long").alias("columnar_bytes"))


def capped(sizes: DataFrame, column: str, cap: int) -> DataFrame:
    """sizes with error_code: ResponseTooLarge where the column exceeds the cap, else null."""
    return sizes.withColumn("error_code", F.when(F.col(column) > cap, F.lit("ResponseTooLarge")))


def offset_overflow(rows: DataFrame, schema: Schema, limit: int = OFFSET_LIMIT) -> DataFrame:
    """(batch_id, field) of columns of varying width whose offsets pass the limit, 31 bits."""
    sums = [(f, F.sum(F.size(f.column) if f.element else F.octet_length(f.column))) for f in schema.fields if not f.fixed]
    found = F.array_compact(F.array(*[F.when(s > limit, F.lit(f.path)) for f, s in sums])) if sums else F.array().cast("array<string>")
    return rows.groupBy("batch_id").agg(found.alias("fields")).select("batch_id", F.explode("fields").alias("field"))
