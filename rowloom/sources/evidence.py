"""Diagnostic checksums of columns and of record batches: FNV-1a over names, lengths, validity and values.

Names and lengths go before what they describe, so columns cannot run into each other. The type text of
lists depends on the writing library's release; no recorded values exist for it.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rowloom.plans.model import FNV_BASIS, SCALARS, Field, Schema

from . import columnar, layout
from .grouping import per_batch

# The seed's name, and type names.
SEED = "arrow-record-batch"
TYPES = {"uint16": "UInt16", "uint32": "UInt32", "uint64": "UInt64", "int32": "Int32", "int64": "Int64", "float32": "Float32", "float64": "Float64", "bool": "Boolean", "binary": "Binary", "string": "Utf8"}


def _long(n: int) -> bytes:
    return struct.pack("<Q", n)


def _text(s: str) -> bytes:
    return _long(len(s.encode())) + s.encode()


def _validity(present: np.ndarray) -> bytes:
    """Words of 64 bits, row i at bit i."""
    bits = np.zeros(-(-len(present) // 64) * 64, np.uint8)
    bits[: len(present)] = present
    words = np.packbits(bits, bitorder="little").tobytes()
    return _text("validity") + _long(len(present)) + _long(len(words) // 8) + words


def _plain(kind: str, values: list) -> bytes:
    return np.array(values, layout.NUMPY[SCALARS[kind].code]).tobytes()


def column_bytes(table: pa.Table, f: Field) -> bytes:
    """What the checksum of a physical column reads: name, lengths, validity, offsets, values."""
    c = table.column(f.column).combine_chunks()
    n, out = len(c), _text(f.path)
    if f.kind == "ConstU16":
        return out + struct.pack("<H", f.const) + _long(n)
    nullable = b"\0" if f.bit is None else b"\1" + _validity(c.is_valid().to_numpy(zero_copy_only=False))
    values = c.to_pylist()
    if f.element:
        flat = [x for v in values for x in v or ()]
        offsets = np.concatenate(([0], np.cumsum([len(v or ()) for v in values]))).astype("<i4")
        return out + _long(n + 1) + _long(len(flat)) + nullable + offsets.tobytes() + _plain(f.element, flat)
    if f.kind in ("RawString", "Bytes"):
        raw = [(v.encode() if isinstance(v, str) else v) or b"" if v is not None else b"" for v in values]
        offsets = np.concatenate(([0], np.cumsum([len(v) for v in raw]))).astype("<i4")
        return out + _long(n + 1) + _long(sum(map(len, raw))) + nullable + offsets.tobytes() + b"".join(raw)
    if f.storage.code == "Q":
        data = np.array([v or 0 for v in values], "<i8").tobytes()
    else:
        data = _plain(f.kind, [v or 0 for v in values])
    return out + _long(n) + nullable + data


def _array_bytes(a: pa.Array) -> bytes:
    out = _long(len(a)) + a.is_null().to_numpy(zero_copy_only=False).astype("<u8").tobytes()
    if pa.types.is_list(a.type):
        lengths = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return out + np.concatenate(([0], np.cumsum(lengths))).astype("<i4").tobytes() + _array_bytes(a.flatten())
    kind, values = _type_text(a.type), a.to_pylist()
    if kind == "Utf8":
        return out + b"".join(_text(v or "") for v in values)
    if kind == "Binary":
        return out + b"".join(v or b"" for v in values)
    codes = {"UInt16": "<u2", "UInt32": "<u4", "UInt64": "<u8", "Int32": "<i4", "Int64": "<i8", "Float32": "<f4", "Float64": "<f8", "Boolean": "u1"}
    return out + np.array([v or 0 for v in values], codes[kind]).tobytes()


def _type_text(t: pa.DataType) -> str:
    if pa.types.is_list(t):
        return f"List({_type_text(t.value_type)})"
    return TYPES[{"float": "float32", "double": "float64"}.get(str(t), str(t))]


def batch_bytes(batch: pa.RecordBatch) -> bytes:
    """What the checksum of a record batch reads: counts, then each field's name, type, nullability and values."""
    parts = [_text(SEED), _long(batch.num_rows), _long(batch.num_columns)]
    for f, a in zip(batch.schema, batch.columns, strict=True):
        parts += [_text(f.name), _text(_type_text(f.type)), _long(f.nullable), _array_bytes(a)]
    return b"".join(parts)


def _of(rows: DataFrame, schema: Schema) -> DataFrame:
    return rows.select("batch_id", "pos", *[f.column for f in schema.fields])


def column_checksums(rows: DataFrame, schema: Schema) -> DataFrame:
    """(batch_id, checksums): a signed long for each field, in their order."""

    def make(table: pa.Table, bounds: np.ndarray) -> dict[str, pa.Array]:
        cuts = [table.slice(a, b - a) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        sums = [layout.fold([column_bytes(t, f) for t in cuts], FNV_BASIS).view(np.int64) for f in schema.fields]
        return {"checksums": pa.array([[int(s[i]) for s in sums] for i in range(len(cuts))], pa.list_(pa.int64()))}

    return per_batch(_of(rows, schema), make, {"checksums": T.ArrayType(T.LongType())})


def batch_checksums(rows: DataFrame, schema: Schema) -> DataFrame:
    """(batch_id, checksum) of the Arrow record batches of physical rows."""

    def make(table: pa.Table, bounds: np.ndarray) -> dict[str, pa.Array]:
        data = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            part = pa.Table.from_batches(table.slice(a, b - a).combine_chunks().to_batches())
            data.append(batch_bytes(columnar.record_batch(part, schema)))
        return {"checksum": pa.array(layout.fold(data, FNV_BASIS).view(np.int64))}

    return per_batch(_of(rows, schema), make, {"checksum": T.LongType()})
