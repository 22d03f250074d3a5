"""Spark sessions for this library."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, before a Python function of it runs there."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="kinweave-code-")) / f"{package.name}.zip"
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(at))
        _shipped.add(context.applicationId)


def session(name: str = "kinweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; sizes of shuffles stay the cluster's own unless given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
