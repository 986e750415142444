"""Session settings that every plan in this library relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: chunkBase64String would put line breaks into base64 text; UTC keeps derived time text stable.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Give this package to the workers, once a context, unless they find it by PYTHONPATH or the working folder."""
    root = Path(__file__).resolve().parents[1]
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    if any(Path(p).resolve() == root for p in [*known, *([os.getcwd()] if local else [])]):
        return
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    _sent.add(app)
    place = Path(tempfile.mkdtemp(prefix="rowloom-")) / "rowloom.zip"
    with zipfile.ZipFile(place, "w") as z:
        for f in sorted((root / "rowloom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(place))


def prepare(spark: SparkSession) -> SparkSession:
    """Put the run-time settings on a session that someone else made, and the package on its workers."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    send_package(spark)
    return spark


def local_session(cpus: int = 8, memory: str = "12g", partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rowloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
