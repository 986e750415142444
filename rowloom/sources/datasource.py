"""Encoded batches as a Spark data source: files of one batch each.

    read_source(spark, folder, "telemetry_v1")
    write_source(rows, folder, "telemetry_v1", mode="append")

write_source deals stored rows by batch_id, sorts them by pos and checks them; the writer makes a file wherever
the batch_id changes, so a task holds one batch. The folder is one that driver and workers all see under its
path; on a store that only Spark opens, read_files() reads through Spark's binaryFile reader, and encoded batches
are kept as rows of a Parquet table instead.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from rowloom.functions.presence import loaded
from rowloom.operators.validation import strict
from rowloom.plans.model import Schema
from rowloom.plans.registry import schema as registered

from . import envelope, layout

SUFFIX = ".rowbatch"


def _schema(options: dict) -> Schema:
    return registered(options["module"], options.get("projection"))


class RowBatchSource(DataSource):
    """Stored rows with the file name as batch_id; options: path, module, projection, trusted."""

    @classmethod
    def name(cls) -> str:
        return "rowbatch"

    def schema(self) -> T.StructType:
        head = [T.StructField("batch_id", T.StringType()), T.StructField("pos", T.LongType())]
        return T.StructType([*head, *_schema(self.options).stored.fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(dict(self.options), overwrite)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.options["path"]).glob(f"*{SUFFIX}"))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        s = _schema(self.options)
        path = Path(partition.value)
        rows, varying = envelope.open_batch(path.read_bytes(), s, self.options.get("trusted") == "true")
        columns = [envelope.column(rows, varying, s, n) for n in s.stored.fieldNames()]
        yield pa.RecordBatch.from_arrays([pa.array([path.stem] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), *columns], ["batch_id", "pos", *s.stored.fieldNames()])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    """A file for each batch of a task's rows, which come batch by batch; files get their places at commit."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def write(self, rows: Iterator) -> Written:
        files, seen = [], set()
        for id_, part in groupby(rows, key=lambda r: r["batch_id"]):
            if id_ in seen:
                raise ValueError(f"the rows of batch {id_} do not come together; write_source() sorts them")
            seen.add(id_)
            found = sorted(part, key=lambda r: r["pos"])
            files.append(self._file(found))
        return Written(files)

    def _file(self, rows: list) -> tuple[str, str]:
        """One batch in a file without its final name yet."""
        s = _schema(self.options)
        names = s.stored.fieldNames()
        found = [tuple(r[n] for n in names) for r in rows]
        table = pa.table({n: pa.array(v) for n, v in zip(names, zip(*found, strict=True), strict=True)})
        payload = layout.payload(layout.packed(table, s), s, None if s.fixed else table)
        header = envelope.Header(s.id, s.version, s.hash, len(found), len(payload), int(layout.fold([payload], layout.FNV_BASIS)[0]))
        folder = Path(self.options["path"])
        folder.mkdir(parents=True, exist_ok=True)
        stem = uuid.uuid4().hex
        place = folder / f".{stem}"
        place.write_bytes(header.encode() + payload)
        return str(place), str(folder / (stem + SUFFIX))

    def commit(self, messages: list[Written | None]) -> None:
        new = [x for m in messages if m for x in m.files]
        old = list(Path(self.options["path"]).glob(f"*{SUFFIX}")) if self.overwrite else []
        for place, final in new:
            os.replace(place, final)
        for path in old:  # only now, so that there is never neither
            path.unlink()

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for place, _ in m.files if m else ():
                Path(place).unlink(missing_ok=True)


def read_files(spark: SparkSession, path: str, schema: Schema, trusted: bool = False) -> DataFrame:
    """Physical rows of files of one encoded batch each, on any store that Spark reads; batch_id is the path."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("batch_id"), F.col("content").alias("data"))
    return envelope.access(files, schema, trusted)


def write_source(rows: DataFrame, path: str, module: str, projection: str | None = None, mode: str = "append", trusted: bool = False) -> None:
    """Stored rows (batch_id, pos, ...) as files of one batch each; a row that breaks a rule raises, unless trusted."""
    rows.sparkSession.dataSource.register(RowBatchSource)
    s = registered(module, projection)
    ready = rows if trusted else strict(rows, s, carrier=s.fields[0].column)
    writer = ready.repartition("batch_id").sortWithinPartitions("batch_id", "pos").write.format("rowbatch").option("module", module)
    (writer.option("projection", projection) if projection else writer).mode(mode).save(path)


def read_source(spark: SparkSession, path: str, module: str, projection: str | None = None, trusted: bool = False) -> DataFrame:
    """Physical rows through the data source; checked reading raises the first error."""
    spark.dataSource.register(RowBatchSource)
    reader = spark.read.format("rowbatch").option("module", module).option("trusted", str(trusted).lower())
    s = registered(module, projection)
    rows = (reader.option("projection", projection) if projection else reader).load(path)
    return loaded(rows if trusted else strict(rows, s), s, "batch_id", "pos")
