"""What a session needs before it can run this package's functions."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once a session, so
    that it need not be installed on every machine."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="wavegrid-code-")) / "wavegrid_code.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one named in ``spark.checkpoint.dir``, or set on the context.  Only
    a session on one machine (as in tests) that names none gets a temporary
    folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("wavegrid.shared.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        path = "file://" + tempfile.mkdtemp(prefix="wavegrid-")
        spark.conf.set("wavegrid.shared.dir", path)
    return path


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes one small file where Spark can read it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether there is a file that Spark can read."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(system.exists(place)) and bool(system.getFileStatus(place).isFile())
