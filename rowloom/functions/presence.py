"""Absence as NULL, and its written form: presence bits beside zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.plans.model import Field, Schema

from .codes import bit


def zero(f: Field) -> Column:
    """What an absent field holds when it is written."""
    if f.element:
        return F.array().cast(f.spark_type)
    return F.lit({"Bool": False, "RawString": "", "Bytes": bytearray()}.get(f.kind, 0)).cast(f.spark_type)


def word(fields: list[Field], present) -> Column:
    """One word of presence bits; present(field) tells whether a field is there."""
    out = F.lit(0).cast("long")
    for f in fields:
        out = out.bitwiseOR(F.when(present(f), F.lit(bit(f.bit % 64)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def presence(schema: Schema) -> Column:
    """Presence bits of physical rows: a long, or an array of words beyond 64 nullable fields."""
    words = [word([f for f in schema.nullable if f.bit // 64 == i], lambda f: F.col(f.column).isNotNull()) for i in range(schema.words)]
    return words[0] if len(words) == 1 else F.array(*words)


def is_present(f: Field, schema: Schema) -> Column:
    """Whether a stored row's bit of a nullable field is set."""
    bits = F.col("presence_bits") if schema.words == 1 else F.get(F.col("presence_bits"), F.lit(f.bit // 64))
    return bits.bitwiseAND(F.lit(bit(f.bit % 64)).cast("long")) != 0


def stored(rows: DataFrame, schema: Schema, *keep: str) -> DataFrame:
    """Physical rows as they are written: zeros for nulls, then presence_bits."""
    columns = [F.coalesce(F.col(f.column), zero(f)).alias(f.column) if f.bit is not None else F.col(f.column) for f in schema.fields]
    return rows.select(*keep, *columns, *([presence(schema).alias("presence_bits")] if schema.words else []))


def loaded(rows: DataFrame, schema: Schema, *keep: str) -> DataFrame:
    """Stored rows as physical rows: null where the presence bit is not set."""
    return rows.select(*keep, *[F.when(is_present(f, schema), F.col(f.column)).alias(f.column) if f.bit is not None else F.col(f.column) for f in schema.fields])
