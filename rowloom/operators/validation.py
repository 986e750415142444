"""Row rules as one expression: the first rule that a row breaks, and the first such row of a batch.

Rules apply in the order of the fields, then presence, then key order. A row's verdict is a column of its
own, so no optimizer can drop it from under a result that depends on it; `strict` puts the failure into
the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.functions.codes import bit
from rowloom.functions.presence import is_present, stored, zero
from rowloom.plans.model import Field, Schema

ERROR = "struct<code:string,field:string,value:string>"


def _error(broken: Column, code: str, name: str, value: Column) -> Column:
    return F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(name).alias("field"), value.cast("string").alias("value")))


def _infinite(value: Column) -> Column:
    return F.isnan(value) | (F.abs(value) == float("inf"))


def field_rule(f: Field, schema: Schema) -> Column | None:
    """The rule of one stored field; null where it holds, None if the kind has no rule."""
    c = F.col(f.column)
    if f.kind == "ConstU16":
        return _error(c != f.const, "SchemaVersionMismatch", f.path, c)
    if f.kind == "U16Dictionary":
        base = schema.base(f.dictionary)
        beyond = ~c.between(base, base + len(schema.dictionaries[f.dictionary]) - 1)
        return _error(beyond & (c != 0) if f.bit is not None else beyond, "InvalidEnumOrdinal", f.path, c)
    if f.kind == "U64BitmaskDictionary":
        n = len(schema.dictionaries[f.dictionary])
        valid = -1 if n == 64 else (1 << n) - 1
        return _error(c.bitwiseAND(F.lit(~valid).cast("long")) != 0, "InvalidBitmask", f.path, F.conv(F.hex(c), 16, 10))
    if f.element:
        missing = _error(F.exists(c, lambda x: x.isNull()), "MalformedArchive", f.path, F.lit(None))
        return F.coalesce(missing, _error(F.exists(c, _infinite), "NonFiniteNumeric", f.path, F.lit(None))) if f.storage.floating else missing
    if f.storage.floating:
        return _error(_infinite(c), "NonFiniteNumeric", f.path, c)
    if f.kind == "U32":
        return _error(~c.between(0, (1 << 32) - 1), "MalformedArchive", f.path, c)
    return None


def presence_rules(schema: Schema) -> list[Column]:
    """No bit beyond the nullable fields; what is absent is zero."""
    if not schema.words:
        return []
    code = "InvalidPresenceBits" if schema.words == 1 else "InvalidPresenceWord"
    rules = []
    for i in range(schema.words):
        n = min(64, len(schema.nullable) - 64 * i)
        allowed = -1 if n == 64 else (1 << n) - 1  # 64 fields fill the word
        word = F.col("presence_bits") if schema.words == 1 else F.get(F.col("presence_bits"), F.lit(i))
        rules.append(_error(word.bitwiseAND(F.lit(~allowed).cast("long")) != 0, code, f"presence_bits[{i}]" if schema.words > 1 else "presence_bits", F.conv(F.hex(word), 16, 10)))
    for f in schema.fields:
        if f.bit is not None:
            c = F.col(f.column)
            held = F.size(c) > 0 if f.element else F.octet_length(c) > 0 if f.kind in ("Bytes", "RawString") else c if f.kind == "Bool" else c != zero(f)
            word = F.col("presence_bits") if schema.words == 1 else F.get(F.col("presence_bits"), F.lit(f.bit // 64))
            rules.append(_error(~is_present(f, schema) & held, code, f.path, F.conv(F.hex(word), 16, 10)))
    return rules


def key_rule(schema: Schema, batch: str = "batch_id", pos: str = "pos") -> Column | None:
    """Keys do not fall from row to row; equal keys follow each other freely."""
    if not schema.keys:
        return None
    key = F.struct(*[F.col(f.column) for f in schema.keys])
    before = F.lag(key).over(Window.partitionBy(batch).orderBy(pos))
    return _error(key < before, "InvalidTimeGrid", "key order regression", F.col(pos))


def row_error(schema: Schema, ordered: bool = True) -> Column:
    """The first rule that a stored row breaks: a struct of code, field and value, else null."""
    rules = [r for r in (field_rule(f, schema) for f in schema.fields) if r is not None] + presence_rules(schema)
    if ordered and (keys := key_rule(schema)) is not None:
        rules.append(keys)
    return F.coalesce(*rules) if rules else F.lit(None).cast(ERROR)


def report(rows: DataFrame, schema: Schema) -> DataFrame:
    """Stored rows that break a rule: batch_id, pos, error_code, error_field, error_value."""
    checked = rows.withColumn("error", row_error(schema)).where(F.col("error").isNotNull())
    return checked.select("batch_id", "pos", F.col("error.code").alias("error_code"), F.col("error.field").alias("error_field"), F.col("error.value").alias("error_value"))


def batch_report(rows: DataFrame, schema: Schema) -> DataFrame:
    """One row per batch: n_rows and the error of its first wrong row (null: none)."""
    checked = rows.withColumn("error", row_error(schema))
    first = F.min(F.when(F.col("error").isNotNull(), F.struct("pos", "error")))
    out = checked.groupBy("batch_id").agg(F.count("*").alias("n_rows"), first.alias("e"))
    return out.select("batch_id", "n_rows", F.col("e.pos").alias("error_pos"), F.col("e.error.code").alias("error_code"), F.col("e.error.field").alias("error_field"))


def strict(rows: DataFrame, schema: Schema, carrier: str | None = None) -> DataFrame:
    """The rows; reading one that breaks a rule raises the rule's code.

    The check rides on one column, the first unless carrier names another; what reads all columns may name
    one that is no part of a partitioning or order that it wants to keep.
    """
    error = F.col("__error")
    failure = F.raise_error(F.concat_ws(" ", error["code"], error["field"], error["value"]))
    carrier = carrier or rows.columns[0]
    loaded = F.when(error.isNull(), F.col(carrier)).otherwise(failure.cast(rows.schema[carrier].dataType)).alias(carrier)
    return rows.withColumn("__error", row_error(schema)).select(*[loaded if c == carrier else F.col(c) for c in rows.columns])


def physical_error(rows: DataFrame, schema: Schema) -> DataFrame:
    """report() of physical rows, for which the presence rules hold by construction."""
    return report(stored(rows, schema, "batch_id", "pos"), schema)


def unknown_bits(schema: Schema) -> int:
    """Bits of the last presence word that no field has, as a signed long."""
    n = len(schema.nullable) % 64
    return ~(bit(n) - 1) if n else 0
