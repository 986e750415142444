"""Schemas from declaration files, on the driver's disk or on any store that Spark reads."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import SparkSession

from .model import Schema
from .proto import compile_schema


def read_text(path: str, spark: SparkSession | None = None) -> str:
    """A file as text; with a session, by Spark's readers."""
    if spark is None:
        return Path(path).read_text(encoding="utf-8")
    return spark.read.text(path, wholetext=True).first()[0]


def load(path: str, module: str | None = None, root: str | None = None, dictionaries: Iterable[str] = (), proto_root: str | None = None, spark: SparkSession | None = None) -> Schema:
    """The schema that a declaration file has; its module is the file's name, unless given.

    Paths count from proto_root, if there is one; dictionaries are files whose dictionaries the schema uses.
    """

    def at(p: str) -> str:
        return f"{proto_root.rstrip('/')}/{p}" if proto_root and not p.startswith("/") and "://" not in p else p

    name = module or path.rsplit("/", 1)[-1].removesuffix(".proto")
    return compile_schema(read_text(at(path), spark), name, root, tuple(read_text(at(p), spark) for p in dictionaries))
