"""Session set-up."""

from __future__ import annotations

import importlib.util
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, with the settings that tests and the bench use."""
    build = SparkSession.builder.master(f"local[{cores}]").appName("tallyspark")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
    } | conf
    for k, v in settings.items():
        build = build.config(k, v)
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, through Spark's own file service."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = Path(tempfile.mkdtemp())
    shutil.copytree(PACKAGE, folder / "src" / PACKAGE.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(folder / PACKAGE.name), "zip", folder / "src"))
    _shipped.add(app)


def has(module: str) -> bool:
    return importlib.util.find_spec(module) is not None
