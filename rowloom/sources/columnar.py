"""Arrow, Arrow IPC and Parquet of physical rows: ordinals and masks stay numbers, names are dotted paths.

A batch becomes one record batch. Field metadata names the physical column where it differs, and the
dictionary behind a number.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import codes
from rowloom.operators.sizes import CONSTANT, WIDTHS
from rowloom.plans.errors import BatchError
from rowloom.plans.model import SCALARS, Field, Schema

from .grouping import per_batch

# Keys of field and schema metadata.
PHYSICAL, DICTIONARY, BITMASK = "mbt.physical_name", "mbt.dictionary", "mbt.bitmask_dictionary"
NAME, ID, VERSION, HASH = "mbt.transport_name", "mbt.schema_id", "mbt.schema_version", "mbt.schema_hash"


def arrow_type(f: Field) -> pa.DataType:
    kind = pa.type_for_alias(SCALARS[f.element or f.kind].arrow)
    return pa.list_(pa.field("item", kind, nullable=False)) if f.element else kind


def arrow_field(f: Field) -> pa.Field:
    notes = {}
    if f.path != f.column:
        notes[PHYSICAL] = f.column
    if f.dictionary:
        notes[DICTIONARY if f.kind == "U16Dictionary" else BITMASK] = f.dictionary
    return pa.field(f.path, arrow_type(f), nullable=f.bit is not None, metadata=notes or None)


def arrow_schema(schema: Schema, identity: bool = False) -> pa.Schema:
    """The record batch's schema; with identity, schema metadata says whose rows it has."""
    notes = {NAME: schema.transport, ID: str(schema.id), VERSION: str(schema.version), HASH: str(schema.hash)} if identity else None
    return pa.schema([arrow_field(f) for f in schema.fields], metadata=notes)


def record_batch(table: pa.Table, schema: Schema, identity: bool = False) -> pa.RecordBatch:
    """Physical columns as one record batch."""
    out = []
    for f in schema.fields:
        c = table.column(f.column).combine_chunks()
        kind = arrow_type(f)
        if f.kind == "U64BitmaskDictionary":
            c = c.view(pa.uint64())
        elif f.element:
            offsets, valid = c.offsets, c.is_null() if c.null_count else None
            values = c.values.cast(kind.value_type)
            c = pa.ListArray.from_arrays(offsets, values, type=kind, mask=valid)
        elif c.type != kind:
            c = c.cast(kind)
        out.append(c)
    return pa.RecordBatch.from_arrays(out, schema=arrow_schema(schema, identity))


def batch_size(table: pa.Table, schema: Schema) -> int:
    """Bytes of a batch's column buffers, as operators.sizes reckons them."""
    n, total = len(table), 0
    bitmap = -(-n // 64) * 8
    for f in schema.fields:
        c = table.column(f.column).combine_chunks()
        if f.kind == "ConstU16":
            total += CONSTANT
            continue
        if f.kind == "Bool":
            total += bitmap
        elif f.element:
            total += (n + 1) * 4 + len(c.flatten()) * WIDTHS[f.element]
        elif f.kind in ("RawString", "Bytes"):
            total += (n + 1) * 4 + int(pa.compute.sum(pa.compute.binary_length(c)).as_py() or 0)
        else:
            total += n * WIDTHS[f.kind]
        total += bitmap if f.bit is not None else 0
    return total


def to_arrow(rows: DataFrame, schema: Schema, identity: bool = False) -> pa.Table:
    """Rows in order, on the driver: for results of a size that the caller knows."""
    table = rows.orderBy("batch_id", "pos").select(*[f.column for f in schema.fields]).toArrow()
    return pa.Table.from_batches([record_batch(table, schema, identity)])


def _encoded(rows: DataFrame, schema: Schema, write, cap: int | None) -> DataFrame:
    def make(table: pa.Table, bounds: np.ndarray) -> dict[str, pa.Array]:
        data, codes_ = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            part = pa.Table.from_batches([x for x in table.slice(a, b - a).combine_chunks().to_batches()])
            d = None if cap is not None and batch_size(part, schema) > cap else write(record_batch(part, schema))
            d = None if d is not None and cap is not None and len(d) > cap else d
            data.append(d)
            codes_.append(None if d is not None else "ResponseTooLarge")
        return {"data": pa.array(data, pa.binary()), "error_code": pa.array(codes_, pa.string())}

    physical = rows.select("batch_id", "pos", *[f.column for f in schema.fields])
    return per_batch(physical, make, {"data": T.BinaryType(), "error_code": T.StringType()})


def ipc_batches(rows: DataFrame, schema: Schema, cap: int | None = None) -> DataFrame:
    """(batch_id, data, error_code): an IPC stream of one record batch."""

    def write(batch: pa.RecordBatch) -> bytes:
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue()

    return _encoded(rows, schema, write, cap)


def parquet_batches(rows: DataFrame, schema: Schema, cap: int | None = None) -> DataFrame:
    """(batch_id, data, error_code): an uncompressed Parquet file."""

    def write(batch: pa.RecordBatch) -> bytes:
        sink = io.BytesIO()
        pq.write_table(pa.Table.from_batches([batch]), sink, compression="NONE")
        return sink.getvalue()

    return _encoded(rows, schema, write, cap)


def record_batches(rows: DataFrame, schema: Schema, cap: int | None = None) -> DataFrame:
    """(batch_id, data, error_code): one record batch for each batch, made where its rows are, as an encapsulated message."""
    return _encoded(rows, schema, lambda batch: batch.serialize().to_pybytes(), cap)


def write_parquet(rows: DataFrame, schema: Schema, path: str, *keep: str) -> None:
    """Rows as an uncompressed Parquet table under their dotted paths, in Spark's own types."""
    rows.select(*keep, *[F.col(f.column).alias(f.path) for f in schema.fields]).write.option("compression", "uncompressed").parquet(path)


def read_parquet(spark: SparkSession, schema: Schema, path: str, *keep: str) -> DataFrame:
    """Physical rows of a Parquet table under dotted paths, also one with unsigned columns."""
    table = spark.read.parquet(path)
    out = []
    for f in schema.fields:
        c, kind = F.col(f"`{f.path}`"), table.schema[f.path].dataType
        out.append((codes.mask_from_decimal(c) if f.kind == "U64BitmaskDictionary" and isinstance(kind, T.DecimalType) else c.cast(f.spark_type)).alias(f.column))
    return table.select(*keep, *out)


def single_batch(data: bytes) -> pa.RecordBatch:
    """The only record batch of an IPC stream."""
    try:
        found = list(pa.ipc.open_stream(data))
    except pa.ArrowInvalid as e:
        raise BatchError("MalformedArchive", e) from None
    if len(found) != 1:
        raise BatchError("MalformedArchive", f"{len(found)} record batches")
    return checked_batch(found[0])


def checked_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch, if its offsets, lengths and texts are sound."""
    try:
        batch.validate(full=True)
    except pa.ArrowInvalid as e:
        raise BatchError("MalformedArchive", e) from None
    return batch


def read_ipc(batches: DataFrame, schema: Schema) -> DataFrame:
    """Physical rows with batch_id and pos of (batch_id, data), each an IPC stream of one record batch."""
    return _read(batches, schema, single_batch)


def read_record_batches(batches: DataFrame, schema: Schema) -> DataFrame:
    """Physical rows of what record_batches wrote."""

    def opened(data: bytes) -> pa.RecordBatch:
        try:
            return checked_batch(pa.ipc.read_record_batch(pa.py_buffer(data), arrow_schema(schema)))
        except (pa.ArrowInvalid, OSError) as e:
            raise BatchError("MalformedArchive", e) from None

    return _read(batches, schema, opened)


def read_parquet_batches(batches: DataFrame, schema: Schema) -> DataFrame:
    """Physical rows of what parquet_batches wrote."""

    def opened(data: bytes) -> pa.RecordBatch:
        try:
            table = pq.read_table(pa.BufferReader(data)).combine_chunks()
        except (pa.ArrowInvalid, OSError) as e:
            raise BatchError("MalformedArchive", e) from None
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns], schema=table.schema)

    return _read(batches, schema, opened)


def _read(batches: DataFrame, schema: Schema, opened) -> DataFrame:
    names = [f.column for f in schema.fields]

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i, data in enumerate(b.column(1).to_pylist()):
                rb = opened(data)
                if rb.schema != arrow_schema(schema):
                    raise BatchError("SchemaHashMismatch", "columns of another schema")
                columns = []
                for f, c in zip(schema.fields, rb.columns, strict=True):
                    spark = pa.uint64() if f.storage.code == "Q" else {"H": pa.int32(), "I": pa.int64()}.get(f.storage.code)
                    if f.element == "U32":
                        c = c.cast(pa.list_(pa.int64()))
                    elif spark is not None and not f.element:
                        c = c.view(pa.int64()) if spark == pa.uint64() else c.cast(spark)
                    columns.append(c)
                ids = b.column(0).take(pa.array(np.full(len(rb), i)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(rb))), *columns], ["batch_id", "pos", *names])

    kind = T.StructType([batches.schema["batch_id"], T.StructField("pos", T.LongType(), False), *schema.physical.fields])
    return batches.select("batch_id", "data").mapInArrow(each, kind)
