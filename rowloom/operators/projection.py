"""Named projections: a select under a new identity. Order and number of rows stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions import codes, text
from rowloom.functions.presence import loaded, stored
from rowloom.plans.model import Output, Schema


def project(rows: DataFrame, schema: Schema, name: str, *keep: str) -> DataFrame:
    """Physical rows of a declared projection; Catalyst prunes the rest down to the scan."""
    return rows.select(*keep, *[f.column for f in schema.projections[name].fields])


def project_stored(rows: DataFrame, schema: Schema, name: str, *keep: str) -> DataFrame:
    """Stored rows of a projection: presence bits close ranks in the order of the kept fields."""
    return stored(project(loaded(rows, schema, *keep), schema, name, *keep), schema.projections[name], *keep)


def logical_value(o: Output, schema: Schema, strict: bool = True):
    """An output as row formats show it: symbols, arrays of symbols, UTC text."""
    if o.utc_of:
        return text.utc(F.col(o.utc_of.column))
    f = o.field
    if f.kind == "U16Dictionary":
        return codes.symbol(F.col(f.column), schema.dictionaries[f.dictionary], schema.base(f.dictionary), strict)
    if f.kind == "U64BitmaskDictionary":
        return codes.symbols_of(F.col(f.column), schema.dictionaries[f.dictionary])
    return F.col(f.column)


def logical(rows: DataFrame, schema: Schema, *keep: str, strict: bool = True) -> DataFrame:
    """Flat logical rows; columns have dotted paths (write them in backticks)."""
    return rows.select(*keep, *[logical_value(o, schema, strict).alias(o.path) for o in schema.flat_outputs])


def physical(rows: DataFrame, schema: Schema, *keep: str, strict: bool = True) -> DataFrame:
    """Flat logical rows back as physical rows."""
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.path}`")
        if f.kind == "U16Dictionary":
            c = codes.ordinal(c, schema.dictionaries[f.dictionary], schema.base(f.dictionary), strict)
        elif f.kind == "U64BitmaskDictionary":
            c = codes.mask_of(c, schema.dictionaries[f.dictionary])
        out.append(c.cast(f.spark_type).alias(f.column))
    return rows.select(*keep, *out)
