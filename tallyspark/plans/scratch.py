"""Tables that an operator writes between two jobs, in the folder that driver and executors share.

Each application has a folder of its own below `spark.checkpoint.dir`, which is deleted when the driver process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Where that is unset: one of our own on a local master, an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext.getCheckpointDir()
        found = kept.rsplit("/", 1)[0] if kept else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own for one table or set of files."""
    home = f"{shared_dir(spark)}/tallyspark-{spark.sparkContext.applicationId}"
    if home not in _folders:
        _folders.add(home)
        atexit.register(_sweep, home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def _sweep(home: str) -> None:
    """Delete what this application left; the session may be gone by then, so without it."""
    from pyarrow import fs

    with contextlib.suppress(OSError, ValueError):
        store, path = fs.FileSystem.from_uri(home if "://" in home or home.startswith("file:") else f"file://{home}")
        store.delete_dir(path)


def stash(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write to the shared folder, read back with the same schema. Survives the loss of executors."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the files behind a `stash` that nothing will read again."""
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        delete(df.sparkSession, folder)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in store.listStatus(target)] if store.exists(target) else []
