"""Bytes of stored rows: packed little-endian values, and the order in which fingerprints read them.

Rows of fixed width are packed by numpy, many batches at a time. Texts, bytes and lists are written before
the rows of their batch, and the rows hold places relative to themselves; this form follows the published
description of the archive format, and no recorded bytes exist to hold it against.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

from rowloom.plans.errors import BatchError
from rowloom.plans.model import FNV_BASIS, FNV_PRIME, SCALARS, U64, Field, Schema

NUMPY = {"H": "<u2", "Q": "<u8", "i": "<i4", "I": "<u4", "q": "<i8", "f": "<f4", "d": "<f8", "?": "u1"}
INLINE = 8
#: Below so many batches a plain loop folds faster than vectors over batches.
FEW = 48


def kind_of(f: Field) -> np.dtype:
    return np.dtype(NUMPY[f.storage.code])


def row_type(schema: Schema) -> np.dtype:
    """The packed row. Strings, bytes and lists take 8 bytes: text or place, and length."""
    parts = [(f.column, kind_of(f) if f.fixed else np.dtype("V8")) for f in schema.fields]
    if schema.words:
        parts.append(("presence_bits", np.dtype("<u8") if schema.words == 1 else np.dtype(("<u8", schema.words))))
    return np.dtype(parts)


def values(table: pa.Table, f: Field) -> np.ndarray:
    """A fixed-width column as it is packed."""
    got = table.column(f.column).combine_chunks().to_numpy(zero_copy_only=False)
    return got.astype(np.int64, copy=False).view(np.uint64) if f.storage.code == "Q" else got.astype(kind_of(f))


def presence_words(table: pa.Table, schema: Schema) -> np.ndarray:
    column = table.column("presence_bits").combine_chunks()
    if schema.words == 1:
        return column.to_numpy(zero_copy_only=False).view(np.uint64)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, schema.words)


def packed(table: pa.Table, schema: Schema) -> np.ndarray:
    """Rows of a schema of fixed width."""
    out = np.zeros(len(table), row_type(schema))
    for f in schema.fields:
        if f.fixed:
            out[f.column] = values(table, f)
    if schema.words:
        out["presence_bits"] = presence_words(table, schema)
    return out


def _far_length(n: int) -> int:
    """A length whose first byte cannot begin a text that is held in place."""
    return n & 0x3F | 0x80 | (n & ~0x3F) << 2


def payload(rows: np.ndarray, schema: Schema, table: pa.Table | None = None) -> bytes:
    """A batch: rows, then version, place of the first row and count. table has the rows' varying fields."""
    heap = bytearray()
    if not schema.fixed:
        rows = rows.copy()
        varying = [f for f in schema.fields if not f.fixed]
        columns = {f.column: table.column(f.column).to_pylist() for f in varying}
        places: list[tuple[str, int, int, int]] = []  # column, row, place in the heap or -1, length
        for i in range(len(rows)):
            for f in varying:
                v = columns[f.column][i]
                if f.element:
                    data = np.array(v, NUMPY[SCALARS[f.element].code]).tobytes()
                else:
                    data = v.encode() if isinstance(v, str) else bytes(v)
                if f.kind == "RawString" and len(data) <= INLINE:
                    rows[f.column][i] = data.ljust(INLINE, b"\xff")
                    continue
                places.append((f.column, i, len(heap), len(v) if f.element else len(data)))
                heap += data
        width, offset = rows.dtype.itemsize, {n: rows.dtype.fields[n][1] for n in rows.dtype.names}
        kinds = {f.column: f.kind for f in varying}
        for name, i, place, n in places:
            at = len(heap) + i * width + offset[name]
            if kinds[name] == "RawString":
                rows[name][i] = struct.pack("<Ii", _far_length(n) & 0xFFFFFFFF, place - at)
            else:
                rows[name][i] = struct.pack("<iI", place - at, n)
    body = rows.tobytes()
    return bytes(heap) + body + struct.pack("<HiI", schema.version_value, -(len(body) + 2), len(rows))


def unpacked(data: bytes, schema: Schema) -> tuple[int, np.ndarray, dict[str, list]]:
    """(version, rows, values of varying fields) of a payload."""
    if len(data) < 10:
        raise BatchError("MalformedArchive", "no root")
    version, place, count = struct.unpack("<HiI", data[-10:])
    first, kind = len(data) - 8 + place, row_type(schema)
    if first < 0 or first + count * kind.itemsize > len(data) - 10:
        raise BatchError("MalformedArchive", "rows outside of the payload")
    rows = np.frombuffer(data, kind, count, first)
    varying: dict[str, list] = {}
    for f in schema.fields:
        if f.fixed:
            if f.kind == "Bool" and (rows[f.column] > 1).any():
                raise BatchError("MalformedArchive", f"{f.path} is no boolean")
            continue
        offset, out = kind.fields[f.column][1], []
        for i in range(count):
            at = first + i * kind.itemsize + offset
            cell = data[at : at + 8]
            if f.kind == "RawString" and cell[0] & 0xC0 != 0x80:
                raw = cell.rstrip(b"\xff")
            else:
                a, b = struct.unpack("<Ii" if f.kind == "RawString" else "<iI", cell)
                where, n = (b, a & 0x3F | (a >> 2) & ~0x3F) if f.kind == "RawString" else (a, b)
                size = n * (np.dtype(NUMPY[SCALARS[f.element].code]).itemsize if f.element else 1)
                if at + where < 0 or at + where + size > len(data):
                    raise BatchError("MalformedArchive", f"{f.path} outside of the payload")
                raw = data[at + where : at + where + size]
            try:
                out.append(np.frombuffer(raw, NUMPY[SCALARS[f.element].code]).tolist() if f.element else raw.decode() if f.kind == "RawString" else raw)
            except UnicodeDecodeError as e:
                raise BatchError("MalformedArchive", f"{f.path}: {e.reason}") from None
        varying[f.column] = out
    return version, rows, varying


# fingerprints


def fold(data: list[bytes], seed: int) -> np.ndarray:
    """FNV-1a of each byte string, from the same state on: byte by byte, over all strings at once."""
    if len(data) < FEW:
        out = []
        for d in data:
            h = seed
            for b in d:
                h = ((h ^ b) * FNV_PRIME) & U64
            out.append(h)
        return np.array(out, np.uint64)
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes[order[0]]) if len(data) else 0
    state = np.full(len(data), seed, np.uint64)
    prime = np.uint64(FNV_PRIME)
    # strings by falling length: at byte i the first live[i] of them go on
    live = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    step = max(1, (1 << 24) // max(1, len(data)))
    for start in range(0, longest, step):
        stop = min(longest, start + step)
        n = int(live[start])
        block = np.zeros((n, stop - start), np.uint8)
        for row, i in enumerate(order[:n]):
            part = data[i][start:stop]
            block[row, : len(part)] = np.frombuffer(part, np.uint8)
        block = np.ascontiguousarray(block.T).astype(np.uint64)
        for j in range(stop - start):
            k = int(live[start + j])
            s = state[:k]
            np.bitwise_xor(s, block[j, :k], out=s)
            np.multiply(s, prime, out=s)
    out = np.empty_like(state)
    out[order] = state
    return out


def _folded(f: Field) -> np.dtype:
    """A value as a fingerprint reads it: booleans as 64 bits, all else as it is packed."""
    return np.dtype("<u8") if f.kind == "Bool" else kind_of(f)


def fingerprint_bytes(table: pa.Table, schema: Schema, full: bool) -> list[bytes] | tuple[np.ndarray, int]:
    """What a fingerprint reads of each row: the minimal fields, and if full the presence words and the rest.

    Rows of fixed width come as one array of bytes and the width of a row.
    """
    rest = [f for f in schema.fields if f not in schema.minimal]
    split = bool(schema.projections)
    with_presence = bool(schema.words) and (full or not split)
    parts: list = [*schema.minimal, *(["presence"] if with_presence else []), *(rest if full and split else [])]
    if all(p == "presence" or p.fixed for p in parts):
        kinds = [("presence_bits", np.dtype(("<u8", schema.words)) if schema.words > 1 else "<u8") if p == "presence" else (p.column, _folded(p)) for p in parts]
        out = np.zeros(len(table), np.dtype(kinds))
        for p in parts:
            if p == "presence":
                out["presence_bits"] = presence_words(table, schema)
            else:
                out[p.column] = values(table, p)
        return out.view(np.uint8), out.dtype.itemsize
    columns: list[list[bytes]] = []
    for p in parts:
        if p == "presence":
            words = presence_words(table, schema)
            columns.append([w.tobytes() for w in words.reshape(len(table), -1)])
        elif p.fixed:
            raw, w = values(table, p).astype(_folded(p)).tobytes(), np.dtype(_folded(p)).itemsize
            columns.append([raw[i : i + w] for i in range(0, len(raw), w)])
        elif p.element:
            kind = NUMPY[SCALARS[p.element].code]
            columns.append([struct.pack("<Q", len(v)) + np.array(v, kind).tobytes() for v in table.column(p.column).to_pylist()])
        else:
            texts = [v.encode() if isinstance(v, str) else bytes(v) for v in table.column(p.column).to_pylist()]
            columns.append([struct.pack("<Q", len(t)) + t for t in texts])
    return [b"".join(x) for x in zip(*columns, strict=True)]


def fingerprints(table: pa.Table, bounds: np.ndarray, schema: Schema, full: bool) -> np.ndarray:
    """Semantic (full) or minimal fingerprint of each batch."""
    name = schema.transport if full or not schema.projections else f"{schema.transport}-minimal"
    seed = FNV_BASIS
    for b in name.encode():
        seed = ((seed ^ b) * FNV_PRIME) & U64
    got = fingerprint_bytes(table, schema, full)
    pairs = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
    if isinstance(got, tuple):
        flat, width = got
        data = [flat[a * width : b * width].tobytes() for a, b in pairs]
    else:
        data = [b"".join(got[a:b]) for a, b in pairs]
    return fold(data, seed)
