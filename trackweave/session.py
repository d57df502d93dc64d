"""A session with the settings the engine is designed for."""

import os
import site
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def session(name: str = "trackweave", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application.

    Nothing is sent where the Python workers find it by themselves: the package's folder
    is on ``PYTHONPATH``, is where the driver was started, or is an installed one.
    """
    root = Path(__file__).resolve().parents[1]
    known = {Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]}
    app = spark.sparkContext.applicationId
    if root in known or app in _SHIPPED:
        return
    target = Path(tempfile.mkdtemp(prefix="trackweave-")) / "trackweave.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted((root / "trackweave").rglob("*.py")):
            z.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
