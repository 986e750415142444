"""Intermediate tables in the folder that driver and executors share.

A job that reads one of these tables again does not depend on the shuffle files or memory of the
executors that made it, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SETTING = "spark.checkpoint.dir"
_written: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local folder, but only if all runs in one process."""
    found = spark.conf.get(SETTING, None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {SETTING} to a folder that driver and executors share")
    return _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="rowloom-"))


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: Shuffle files go when the query that made them has ended, not when the driver collects its garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(SWEEP, "false")
    spark.conf.set(SWEEP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SWEEP, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet under the shared folder and return a reader of it."""
    return _write(df, new_path(df.sparkSession, name))


class Scratch:
    """written() for tables that nothing reads after the `with` block; they are deleted at its end, or by drop()."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        out = _write(df, path)
        self.tables.append((out, path))
        return out

    def drop(self, table: DataFrame) -> None:
        """Delete a table that has had its last reader."""
        for kept in [x for x in self.tables if x[0] is table]:
            self.tables.remove(kept)
            discard(self.spark, kept[1])
            _written.remove((self.spark, kept[1]))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for table, _ in list(self.tables):
            self.drop(table)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that no later plan reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            discard(spark, path)
        except Exception:  # the session is gone, and its folder with it or left to the cluster's own clean-up
            return


#: Bytes of rows that go to a Python worker at a time, so that batches of long texts stay small.
ARROW_BYTES = 8 << 20
ARROW_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, each: Callable, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow over batches of bounded size; the setting holds for the session."""
    df.sparkSession.conf.set(ARROW_CONF, str(ARROW_BYTES))
    return df.mapInArrow(each, schema)


def with_fields(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    """schema with more nullable fields; schema itself stays as it is."""
    return T.StructType([*schema.fields, *(T.StructField(n, k, True) for n, k in kinds.items())])


def own_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns whose names an operator is about to add (compared without case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])
