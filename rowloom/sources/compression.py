"""zstd of binary columns, with a cap on what comes out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rowloom.plans.errors import BatchError

LEVEL = 3
PIECE = 1 << 16


def compress(data: bytes, cap: int | None = None, level: int = LEVEL) -> bytes:
    out = zstandard.ZstdCompressor(level=level).compress(data)
    if cap is not None and len(out) > cap:
        raise BatchError("ResponseTooLarge", f"{len(out)} over {cap}")
    return out


def decompress(data: bytes, cap: int | None = None) -> bytes:
    """The bytes of one frame; reading stops at the cap, so a small input cannot make a huge output."""
    out = bytearray()
    try:
        reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=False)
        while piece := reader.read(PIECE):
            out += piece
            if cap is not None and len(out) > cap:
                raise BatchError("ResponseTooLarge", f"{len(out)} over {cap}")
        if not data or zstandard.get_frame_parameters(data).content_size not in (zstandard.CONTENTSIZE_UNKNOWN, len(out)):
            raise BatchError("MalformedArchive", "the frame ends too early")
    except zstandard.ZstdError as e:
        raise BatchError("MalformedArchive", e) from None
    return bytes(out)


def _mapped(batches: DataFrame, work: Callable[[bytes], bytes]) -> DataFrame:
    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            data, codes = [], []
            for x in b.column(1).to_pylist():
                try:
                    data.append(None if x is None else work(x))
                    codes.append(None)
                except BatchError as e:
                    data.append(None)
                    codes.append(e.code)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary()), pa.array(codes, pa.string())], ["batch_id", "data", "error_code"])

    kind = T.StructType([batches.schema["batch_id"], T.StructField("data", T.BinaryType()), T.StructField("error_code", T.StringType())])
    return batches.select("batch_id", "data").mapInArrow(each, kind)


def compressed(batches: DataFrame, cap: int | None = None, level: int = LEVEL) -> DataFrame:
    """(batch_id, data, error_code) of (batch_id, data)."""
    return _mapped(batches, lambda x: compress(x, cap, level))


def decompressed(batches: DataFrame, cap: int | None = None) -> DataFrame:
    return _mapped(batches, lambda x: decompress(x, cap))
