"""Protobuf wire bytes of physical rows.

Bytes are made column by column over an Arrow batch, as pieces: of every row how many bytes, and the bytes of
all rows in a row. Pieces are laid side by side by numpy, so no value becomes a Python object. Zeros are
written; lists are unpacked, a key for every element, so an empty list and an absent one look alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import text
from rowloom.operators.projection import logical_value
from rowloom.plans.model import Output, Schema

from .grouping import per_batch

VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5
WIRE = {"F64": FIXED64, "F32": FIXED32, "RawString": BYTES, "Bytes": BYTES, "U16Dictionary": BYTES, "U64BitmaskDictionary": BYTES}


def varint(n: int) -> bytes:
    """A number's low 64 bits, seven at a time; negative numbers take ten bytes."""
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def key(number: int, wire: int) -> bytes:
    return varint(number << 3 | wire)


#: Of every row how many bytes, and the bytes of all rows one after the other.
Piece = tuple[np.ndarray, np.ndarray]


#: So many bytes are laid out at a time, for each takes three numbers.
PART = 1 << 20


def _joined(pieces: list[Piece], n: int) -> Piece:
    """The pieces of each row side by side."""
    sizes = np.zeros(n, np.int64)
    for own, _ in pieces:
        sizes += own
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if n else 0
    out = np.empty(total, np.uint8)
    long = np.flatnonzero(sizes > PART)
    cuts = np.unique(np.concatenate(([0, n], long, long + 1, np.searchsorted(ends, np.arange(PART, total, PART))))).tolist()
    to = ends - sizes
    for own, data in pieces:
        last = np.cumsum(own)
        first = last - own
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = data[first[a] : last[b - 1]]
            if b - a == 1:
                out[to[a] : to[a] + len(part)] = part
            else:
                out[np.arange(len(part)) + np.repeat(to[a:b] - first[a:b] + first[a], own[a:b])] = part
        to += own
    return sizes, out


def _constant(data: bytes, there: np.ndarray) -> Piece:
    """The same bytes in every row that is there."""
    return there * np.int64(len(data)), np.tile(np.frombuffer(data, np.uint8), int(np.count_nonzero(there)))


def _varints(numbers: np.ndarray, there: np.ndarray) -> Piece:
    """Numbers of 64 bits, of the rows that are there."""
    rest, sizes = numbers[there].astype(np.int64).view(np.uint64), np.zeros(len(there), np.int64)
    own, digits = np.ones(len(rest), np.int64), []
    while True:
        digits.append((rest & np.uint64(0x7F)).astype(np.uint8))
        rest = rest >> np.uint64(7)
        if not rest.any():
            break
        own += rest != 0
    table = np.stack(digits, axis=1)
    place = np.arange(len(digits))
    table[place < own[:, None] - 1] |= 0x80
    sizes[there] = own
    return sizes, table[place < own[:, None]]


def _texts(column: pa.Array, there: np.ndarray) -> list[Piece]:
    """Length and bytes of texts, or of bytes, of the rows that are there."""
    if not len(column):
        return []
    data = column.fill_null(b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, data.offset * 8)
    sizes, raw = np.diff(ends), data.buffers()[2]
    flat = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    return [_varints(sizes, there), (sizes, flat)]


def _value(kind: str, column: pa.Array, there: np.ndarray) -> list[Piece]:
    if kind in ("F64", "F32"):
        raw = column.fill_null(0).to_numpy(zero_copy_only=False).astype("<f8" if kind == "F64" else "<f4")[there]
        return [(there * np.int64(raw.itemsize), raw.view(np.uint8))]
    if kind in ("RawString", "U16Dictionary", "U64BitmaskDictionary", "Bytes"):
        return _texts(column, there)
    return [_varints(column.fill_null(False if pa.types.is_boolean(column.type) else 0).to_numpy(zero_copy_only=False), there)]


def _there(column: pa.Array) -> np.ndarray:
    return column.is_valid().to_numpy(zero_copy_only=False)


def _member(o: Output, column: pa.Array) -> list[Piece]:
    kind = "RawString" if o.utc_of else o.field.element or o.field.kind
    head = key(o.number, WIRE.get(kind, VARINT))
    if isinstance(column, pa.ListArray):
        flat = column.flatten()
        there = _there(flat)
        sizes, data = _joined([_constant(head, there), *_value(kind, flat, there)], len(flat))
        ends = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
        return [(np.diff(np.concatenate(([0], np.cumsum(sizes)))[ends]), data)]
    there = _there(column)
    return [_constant(head, there), *_value(kind, column, there)]


def _framed(head: bytes, message: Piece) -> list[Piece]:
    """A message in another one: key, length and bytes, in every row."""
    sizes, _ = message
    always = np.ones(len(sizes), bool)
    return [_constant(head, always), _varints(sizes, always), message]


def _message(outputs: tuple[Output, ...], columns: dict[str, pa.Array], n: int) -> Piece:
    parts: list[Piece] = []
    for o in outputs:
        parts += _framed(key(o.number, BYTES), _message(o.members, columns, n)) if o.members else _member(o, columns[o.path])
    return _joined(parts, n)


def _binary(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """The rows of a piece as an Arrow column; more than its offsets can say is an error."""
    ends = pa.array(np.concatenate(([0], np.cumsum(sizes)))).cast(pa.int32())
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, ends.buffers()[1], pa.py_buffer(data)])


def _shown(rows: DataFrame, schema: Schema) -> DataFrame:
    """Physical rows with symbols, arrays of symbols and UTC text; numbered, as Arrow functions take no dotted names."""
    return rows.select("batch_id", "pos", *[logical_value(o, schema).alias(f"o{i}") for i, o in enumerate(schema.flat_outputs)])


def protobuf_rows(rows: DataFrame, schema: Schema) -> DataFrame:
    """(batch_id, pos, data): each row's message, without its key."""
    paths = [o.path for o in schema.flat_outputs]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = dict(zip(paths, b.columns[2:], strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binary(*_message(schema.outputs, columns, len(b)))], ["batch_id", "pos", "data"])

    return _shown(rows, schema).mapInArrow(each, T.StructType([rows.schema["batch_id"], rows.schema["pos"], T.StructField("data", T.BinaryType())]))


def protobuf_batches(rows: DataFrame, schema: Schema, cap: int | None = None) -> DataFrame:
    """(batch_id, data, error_code): the version, then every row under the row key."""
    head = key(1, VARINT) + varint(schema.version_value)
    row_key = key(schema.row_number, BYTES)
    paths = [o.path for o in schema.flat_outputs]

    def make(table: pa.Table, bounds: np.ndarray) -> dict[str, pa.Array]:
        columns = {p: c.combine_chunks() for p, c in zip(paths, table.columns[2:], strict=True)}
        sizes, flat = _joined(_framed(row_key, _message(schema.outputs, columns, len(table))), len(table))
        ends = np.concatenate(([0], np.cumsum(sizes)))[bounds].tolist()
        data = [head + flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        over = [cap is not None and len(d) > cap for d in data]
        return {
            "data": pa.array([None if o else d for o, d in zip(over, data, strict=True)], pa.binary()),
            "error_code": pa.array(["ResponseTooLarge" if o else None for o in over], pa.string()),
        }

    return per_batch(_shown(rows, schema), make, {"data": T.BinaryType(), "error_code": T.StringType()})


def text_length(rows: DataFrame, name: str) -> DataFrame:
    """(batch_id, pos, utc_len) of a millisecond column."""
    return rows.select("batch_id", "pos", F.length(text.utc(F.col(name))).alias("utc_len"))
