"""Encoded batches: a header of 128 bytes and a payload; writing, checked reading, trusted reading."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.presence import loaded, stored
from rowloom.operators.validation import row_error, strict
from rowloom.plans.errors import BatchError
from rowloom.plans.model import Schema, fnv1a64

from . import layout
from .grouping import per_batch

# Fixed values of the format.
MAGIC = b"MATBT001"
HEADER = 128
TRANSPORT, ENCODING, FLAGS = 1, 1, 0
BUILD = fnv1a64(b"mbt:v1:synthetic_example")
#: magic, transport, header length, encoding, flags, schema id, schema version, reserved, hash, build, rows, length, checksum
FORM = struct.Struct("<8sHHHHIHHQQQQQ")


@dataclass(frozen=True)
class Header:
    schema_id: int
    schema_version: int
    schema_hash: int
    rows: int
    length: int
    checksum: int

    def encode(self) -> bytes:
        return FORM.pack(MAGIC, TRANSPORT, HEADER, ENCODING, FLAGS, self.schema_id, self.schema_version, 0, self.schema_hash, BUILD, self.rows, self.length, self.checksum).ljust(HEADER, b"\0")


def open_header(data: bytes, schema: Schema) -> tuple[Header, bytes]:
    """Header and payload if the header is one of the schema's; rules in the order in which they report."""
    if len(data) < HEADER:
        raise BatchError("TruncatedPayload")
    magic, transport, size, encoding, flags, id_, version, spare, hash_, _, rows, length, checksum = FORM.unpack_from(data)
    if magic != MAGIC:
        raise BatchError("CorruptMagic")
    if spare or any(data[FORM.size : HEADER]):
        raise BatchError("InvalidHeaderLength", size)
    payload = data[HEADER:]
    for found, wanted, code in (
        (transport, TRANSPORT, "UnsupportedTransportVersion"),
        (size, HEADER, "InvalidHeaderLength"),
        (encoding, ENCODING, "UnsupportedEncodingKind"),
        (flags, FLAGS, "InvalidFlags"),
        (id_, schema.id, "UnknownSchemaId"),
        (version, schema.version, "SchemaVersionMismatch"),
        (hash_, schema.hash, "SchemaHashMismatch"),
        (len(payload), length, "PayloadLengthMismatch"),
    ):
        if found != wanted:
            raise BatchError(code, found)
    return Header(id_, version, hash_, rows, length, checksum), payload


def open_batch(data: bytes, schema: Schema, trusted: bool = False) -> tuple[np.ndarray, dict[str, list]]:
    """Packed rows and values of varying fields; trusted reading skips the checksum and the row count."""
    header, payload = open_header(data, schema)
    if not trusted and int(layout.fold([payload], layout.FNV_BASIS)[0]) != header.checksum:
        raise BatchError("PayloadChecksumMismatch")
    version, rows, varying = layout.unpacked(payload, schema)
    if not trusted:
        if version != schema.version_value:
            raise BatchError("SchemaVersionMismatch", version)
        if len(rows) != header.rows:
            raise BatchError("RowCountMismatch", len(rows))
    return rows, varying


def column(rows: np.ndarray, varying: dict[str, list], schema: Schema, name: str) -> pa.Array:
    """A stored column as Spark takes it."""
    if name == "presence_bits":
        bits = np.ascontiguousarray(rows[name]).view(np.int64)
        return pa.array(bits) if schema.words == 1 else pa.array(list(bits.reshape(-1, schema.words)), pa.list_(pa.int64()))
    f = schema.by_column(name)
    if not f.fixed:
        kinds = {"RawString": pa.string(), "Bytes": pa.binary()}
        element = {"I32": pa.int32(), "F32": pa.float32(), "F64": pa.float64()}.get(f.element, pa.int64())
        return pa.array(varying[name], pa.list_(element) if f.element else kinds[f.kind])
    v = np.ascontiguousarray(rows[name])
    if f.kind == "Bool":
        return pa.array(v.astype(bool))
    if f.storage.code == "Q":
        return pa.array(v.view(np.int64))
    return pa.array(v.astype({"H": np.int32, "I": np.int64}.get(f.storage.code, v.dtype.newbyteorder("="))))


def encode(rows: DataFrame, schema: Schema, cap: int | None = None, trusted: bool = False) -> DataFrame:
    """(batch_id, n_rows, n_bytes, data, error_code) of physical rows; checked rows raise their first error."""
    ready, dealt = _checked(rows, schema, trusted)
    return _encode_stored(ready, schema, cap, dealt)


def _checked(rows: DataFrame, schema: Schema, trusted: bool) -> tuple[DataFrame, bool]:
    """Stored rows, and whether checking the order of keys has dealt them out by batch."""
    ready = stored(rows, schema, "batch_id", "pos")
    if trusted:
        return ready, False
    return strict(ready, schema, carrier=schema.fields[0].column), bool(schema.keys)


def _encode_stored(ready: DataFrame, schema: Schema, cap: int | None, dealt: bool = False) -> DataFrame:
    def make(table: pa.Table, bounds: np.ndarray) -> dict[str, pa.Array]:
        whole = layout.packed(table, schema)
        payloads, counts = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            payloads.append(layout.payload(whole[a:b], schema, None if schema.fixed else table.slice(a, b - a)))
            counts.append(b - a)
        sums = layout.fold(payloads, layout.FNV_BASIS).tolist()
        sizes = [HEADER + len(p) for p in payloads]
        over = [cap is not None and n > cap for n in sizes]
        data = [None if o else Header(schema.id, schema.version, schema.hash, n, len(p), s).encode() + p for o, n, p, s in zip(over, counts, payloads, sums, strict=True)]
        return {
            "n_rows": pa.array(counts, pa.int64()),
            "n_bytes": pa.array(sizes, pa.int64()),
            "data": pa.array(data, pa.binary()),
            "error_code": pa.array(["ResponseTooLarge" if o else None for o in over], pa.string()),
        }

    return per_batch(ready, make, {"n_rows": T.LongType(), "n_bytes": T.LongType(), "data": T.BinaryType(), "error_code": T.StringType()}, dealt)


def decode(batches: DataFrame, schema: Schema, trusted: bool = False) -> DataFrame:
    """Stored rows with batch_id and pos of (batch_id, data); data that is no batch raises its error."""
    names = schema.stored.fieldNames()

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i, data in enumerate(b.column(1).to_pylist()):
                rows, varying = open_batch(data, schema, trusted)
                n = len(rows)
                ids = b.column(0).take(pa.array(np.full(n, i)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(n)), *(column(rows, varying, schema, c) for c in names)], ["batch_id", "pos", *names])

    kind = T.StructType([batches.schema["batch_id"], T.StructField("pos", T.LongType(), False), *schema.stored.fields])
    return batches.select("batch_id", "data").mapInArrow(each, kind)


def access(batches: DataFrame, schema: Schema, trusted: bool = False) -> DataFrame:
    """Physical rows with batch_id and pos; checked reading raises the first error of a batch."""
    rows = decode(batches, schema, trusted)
    return loaded(rows if trusted else strict(rows, schema), schema, "batch_id", "pos")


def check(batches: DataFrame, schema: Schema) -> DataFrame:
    """(batch_id, error_code): what checked reading of the envelope would raise, else null; rows are not checked."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            codes = []
            for data in b.column(1).to_pylist():
                try:
                    open_batch(data, schema)
                    codes.append(None)
                except BatchError as e:
                    codes.append(e.code)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.string())], ["batch_id", "error_code"])

    return batches.select("batch_id", "data").mapInArrow(each, T.StructType([batches.schema["batch_id"], T.StructField("error_code", T.StringType())]))


def inspect(rows: DataFrame, schema: Schema, trusted: bool = False) -> DataFrame:
    """(batch_id, row_count, semantic, minimal) of physical rows; fingerprints are signed longs of 64 bits."""
    ready, dealt = _checked(rows, schema, trusted)

    def make(table: pa.Table, bounds: np.ndarray) -> dict[str, pa.Array]:
        semantic, minimal = (pa.array(layout.fingerprints(table, bounds, schema, full).view(np.int64)) for full in (True, False))
        return {"row_count": pa.array(np.diff(bounds)), "semantic": semantic, "minimal": minimal}

    return per_batch(ready, make, {"row_count": T.LongType(), "semantic": T.LongType(), "minimal": T.LongType()}, dealt)


def checksum(batches: DataFrame, data: str = "data") -> DataFrame:
    """(batch_id, checksum): FNV-1a of the encoded bytes, as a signed long."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            raw = [x.encode() if isinstance(x, str) else x for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(layout.fold(raw, layout.FNV_BASIS).view(np.int64))], ["batch_id", "checksum"])

    return batches.select("batch_id", F.col(data)).mapInArrow(each, T.StructType([batches.schema["batch_id"], T.StructField("checksum", T.LongType())]))


def errors(batches: DataFrame, schema: Schema) -> DataFrame:
    """(batch_id, pos, error_code) of rows that break a rule, read without raising."""
    rows = decode(batches, schema, trusted=True).withColumn("error", row_error(schema))
    return rows.where("error is not null").select("batch_id", "pos", F.col("error.code").alias("error_code"))
