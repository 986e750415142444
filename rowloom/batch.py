"""Batch: rows of a schema with the library's operators as methods.

rows has batch_id, pos and the schema's physical columns (null where a field is absent). Operators that
write or read a batch check its rows first; `trusted=True` leaves the checks out of the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from rowloom.functions.presence import loaded, stored
from rowloom.operators import projection, sizes, validation
from rowloom.plans.model import Schema
from rowloom.sources import columnar, compression, envelope, rowtext, wire

IDS = ("batch_id", "pos")


@dataclass(frozen=True)
class Batch:
    rows: DataFrame
    schema: Schema

    # sources

    @classmethod
    def from_logical(cls, rows: DataFrame, schema: Schema) -> Batch:
        """Rows with symbols and arrays of symbols under dotted paths."""
        return cls(projection.physical(rows, schema, *IDS), schema)

    @classmethod
    def from_stored(cls, rows: DataFrame, schema: Schema) -> Batch:
        """Rows with zeros and presence bits."""
        return cls(loaded(rows, schema, *IDS), schema)

    @classmethod
    def access(cls, batches: DataFrame, schema: Schema, trusted: bool = False) -> Batch:
        """Encoded batches (batch_id, data)."""
        return cls(envelope.access(batches, schema, trusted), schema)

    @classmethod
    def from_ipc(cls, batches: DataFrame, schema: Schema) -> Batch:
        return cls(columnar.read_ipc(batches, schema), schema)

    @classmethod
    def from_parquet(cls, spark, path: str, schema: Schema) -> Batch:
        """What write_parquet wrote."""
        return cls(columnar.read_parquet(spark, schema, path, *IDS), schema)

    # rows

    def stored(self) -> DataFrame:
        return stored(self.rows, self.schema, *IDS)

    def logical(self) -> DataFrame:
        return projection.logical(self.rows, self.schema, *IDS)

    def project(self, name: str, trusted: bool = False) -> Batch:
        """Rows of a declared projection, of rows that were checked unless trusted."""
        source = self if trusted else self.checked()
        return Batch(projection.project(source.rows, self.schema, name, *IDS), self.schema.projections[name])

    def checked(self) -> Batch:
        """The same rows; reading one that breaks a rule raises."""
        return Batch(loaded(validation.strict(self.stored(), self.schema), self.schema, *IDS), self.schema)

    def report(self) -> DataFrame:
        """Rows that break a rule, and which."""
        return validation.report(self.stored(), self.schema)

    def batch_report(self) -> DataFrame:
        """The first error of each batch."""
        return validation.batch_report(self.stored(), self.schema)

    # folds

    def inspect(self, trusted: bool = False) -> DataFrame:
        return envelope.inspect(self.rows, self.schema, trusted)

    def columnar_size(self) -> DataFrame:
        return sizes.columnar_size(self.rows, self.schema)

    # sinks; each returns (batch_id, data, ...)

    def encode(self, cap: int | None = None, trusted: bool = False) -> DataFrame:
        return envelope.encode(self.rows, self.schema, cap, trusted)

    def _ready(self, trusted: bool) -> DataFrame:
        return self.rows if trusted else self.checked().rows

    def to_json(self, cap: int | None = None, trusted: bool = False) -> DataFrame:
        return rowtext.json_batches(self._ready(trusted), self.schema, cap)

    def to_csv(self, cap: int | None = None, trusted: bool = False) -> DataFrame:
        return rowtext.csv_batches(self._ready(trusted), self.schema, cap)

    def to_protobuf(self, cap: int | None = None, trusted: bool = False) -> DataFrame:
        return wire.protobuf_batches(self._ready(trusted), self.schema, cap)

    def to_ipc(self, cap: int | None = None, trusted: bool = False) -> DataFrame:
        return columnar.ipc_batches(self._ready(trusted), self.schema, cap)

    def to_parquet(self, cap: int | None = None, trusted: bool = False) -> DataFrame:
        return columnar.parquet_batches(self._ready(trusted), self.schema, cap)

    def to_record_batches(self, cap: int | None = None, trusted: bool = False) -> DataFrame:
        return columnar.record_batches(self._ready(trusted), self.schema, cap)

    def to_arrow(self, identity: bool = False, trusted: bool = False) -> pa.Table:
        return columnar.to_arrow(self._ready(trusted), self.schema, identity)

    def convert(self, form: str, cap: int | None = None, trusted: bool = False) -> DataFrame:
        """One of FORMS by name."""
        return FORMS[form](self, cap, trusted)

    def write_parquet(self, path: str, trusted: bool = False) -> None:
        columnar.write_parquet(self._ready(trusted), self.schema, path, *IDS)

    def compressed(self, cap: int | None = None, level: int = compression.LEVEL, trusted: bool = False) -> DataFrame:
        """Encoded and compressed."""
        return compression.compressed(self.encode(trusted=trusted), cap, level)


FORMS = {"binary": Batch.encode, "json": Batch.to_json, "csv": Batch.to_csv, "protobuf": Batch.to_protobuf, "arrow": Batch.to_record_batches, "arrow_ipc": Batch.to_ipc, "parquet": Batch.to_parquet}


def convert(batches: DataFrame, schema: Schema, form: str, cap: int | None = None, trusted: bool = False) -> DataFrame:
    """Encoded batches (batch_id, data) in another form, by its name; they are checked once, as they are read, unless trusted."""
    return Batch.access(batches, schema, trusted).convert(form, cap, trusted=True)
