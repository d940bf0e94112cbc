"""Makes the package importable on executors that do not share the driver's folders."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """A fresh folder name in the shared spark.checkpoint.dir; a temporary one only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lexloom-")
    return f"{root.rstrip('/')}/lexloom-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="lexloom-src-"), "lexloom_src.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, str(Path(root.name) / source.relative_to(root)))
    spark.sparkContext.addPyFile(target)
    _SENT.add(app)
