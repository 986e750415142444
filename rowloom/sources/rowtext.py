"""JSON and CSV as expressions over physical rows; a batch is its rows in order inside a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import codes, text
from rowloom.plans.model import Output, Schema


def _scalar(kind: str, value: Column, string) -> Column:
    if kind in ("F32", "F64"):
        return text.number(value, kind == "F32")
    if kind == "Bool":
        return text.boolean(value)
    if kind == "RawString":
        return string(value)
    if kind == "Bytes":
        return string(text.base64(value))
    return text.integer(value)


def _bracketed(items: Column) -> Column:
    return F.concat(F.lit("["), items, F.lit("]"))


def _list(items: Column) -> Column:
    return _bracketed(F.array_join(items, ","))


def json_value(o: Output, schema: Schema) -> Column:
    """An output as JSON text; null where it is absent."""
    if o.utc_of:
        return F.concat(F.lit('"'), text.utc(F.col(o.utc_of.column)), F.lit('"'))
    f = o.field
    c = F.col(f.column)
    if f.kind == "U16Dictionary":
        return codes.symbol(c, [text.json_literal(v) for v in schema.dictionaries[f.dictionary]], schema.base(f.dictionary))
    if f.kind == "U64BitmaskDictionary":
        return _bracketed(codes.symbols_text(c, [text.json_literal(v) for v in schema.dictionaries[f.dictionary]]))
    if f.element:
        return _list(F.transform(c, lambda x: _scalar(f.element, x, text.json_string)))
    return _scalar(f.kind, c, text.json_string)


def csv_value(o: Output, schema: Schema) -> Column:
    """An output as a CSV cell; null where it is absent."""
    if o.utc_of:
        return F.concat(F.lit('"'), text.utc(F.col(o.utc_of.column)), F.lit('"'))
    f = o.field
    c = F.col(f.column)
    quoted_text = lambda v: '"' + v.replace('"', '""') + '"'
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    if f.kind == "U16Dictionary":
        return codes.symbol(c, [quoted_text(v) for v in schema.dictionaries[f.dictionary]], schema.base(f.dictionary))
    if f.kind == "U64BitmaskDictionary":
        return quoted(_bracketed(codes.symbols_text(c, [text.json_literal(v, False).replace('"', '""') for v in schema.dictionaries[f.dictionary]])))
    if f.element:
        return quoted(_list(F.transform(c, lambda x: _scalar(f.element, x, text.csv_string))))
    return _scalar(f.kind, c, text.csv_string)


def json_row(schema: Schema) -> Column:
    """A row as an object of dotted paths; absent members are left out."""
    members = [F.concat(F.lit(f'"{o.path}":'), json_value(o, schema)) for o in schema.flat_outputs]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def csv_header(schema: Schema) -> str:
    return ",".join(o.path for o in schema.flat_outputs)


def csv_row(schema: Schema) -> Column:
    """A row as cells; an absent cell is empty."""
    return F.concat_ws(",", *[F.coalesce(csv_value(o, schema), F.lit("")) for o in schema.flat_outputs])


def _framed(rows: DataFrame, line: Column, head: str, between: str, tail: str, cap: int | None) -> DataFrame:
    """One text per batch. Lines are made once; their sizes are summed beside, and a text over the cap is not put together."""
    lines = rows.select("batch_id", "pos", line.alias("line"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "line")))["line"]
    if cap is not None:
        size = F.sum(F.octet_length("line")) + F.lit(len(head.encode()) + len(tail.encode())) + (F.count("*") - (1 if between == "," else 0)) * len(between)
        each = lines.groupBy("batch_id").agg(size.alias("n_bytes"), ordered.alias("lines"))
        data = F.when(F.col("n_bytes") <= cap, F.concat(F.lit(head), F.array_join("lines", between), F.lit(tail)))
        return each.select("batch_id", data.alias("data"), F.when(F.col("n_bytes") > cap, F.lit("ResponseTooLarge")).alias("error_code"))
    body = F.array_join(ordered, between)
    return lines.groupBy("batch_id").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("data"))


def json_batches(rows: DataFrame, schema: Schema, cap: int | None = None) -> DataFrame:
    """(batch_id, data) and, with a cap, error_code."""
    return _framed(rows, json_row(schema), f'{{"schema_version":{schema.version_value},"rows":[', ",", "]}", cap)


def csv_batches(rows: DataFrame, schema: Schema, cap: int | None = None) -> DataFrame:
    """(batch_id, data) and, with a cap, error_code; a line feed ends every line."""
    return _framed(rows, F.concat(csv_row(schema), F.lit("\n")), csv_header(schema) + "\n", "", "", cap)


def write_lines(rows: DataFrame, schema: Schema, path: str, form: str = "json") -> None:
    """Rows in order within each partition as text files: JSON lines, or CSV without a header."""
    line = {"json": json_row, "csv": csv_row}[form](schema)
    rows.select(line.alias("value")).write.text(path)
