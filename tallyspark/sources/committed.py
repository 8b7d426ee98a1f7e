"""Files from rows, all or none: a data source that Spark's own job commit closes.

Tasks write their files into a staging folder beside the place. When all have ended well, the driver moves the staging
folder to the place with one rename (what stood there goes aside first and is deleted after); when the job fails, the
staging folder is deleted and the place is as it was (a task that outlives its job may leave some of the staging folder
behind, which nothing reads). A task that is repeated, or runs twice, leaves the same files: the
rows of a path give the same bytes. Two rows with one path are an error. Beside the files stands `_manifest`, JSON lines
of path, bytes and sha256 that the tasks wrote.

On a store where a rename is no single step (object stores), the place is whole once `_manifest/_DONE` is there.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "path string, bytes long, sha256 string"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


@dataclass
class Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, place: str):
        self.place = place.rstrip("/")
        self.staging = f"{self.place}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        store, base = _store(self.staging)
        told: dict[str, dict] = {}
        for path, content in iterator:
            if path is None or path.startswith(("/", "_")) or ".." in path.split("/"):
                raise ValueError(f"no path for a file: {path}")
            raw = bytes(content or b"")
            self._put(store, f"{base}/{path}", raw)
            told[path] = {"path": path, "bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest()}
        lines = "".join(json.dumps(x) + "\n" for x in told.values())
        if told:
            self._put(store, f"{base}/_manifest/{TaskContext.get().partitionId()}.json", lines.encode())
        return Written(len(told))

    def _put(self, store, place: str, raw: bytes) -> None:
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        beside = f"{place}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(beside) as out:
            out.write(raw)
        store.move(beside, place)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, staged = _store(self.staging)
        _, place = _store(self.place)
        store.create_dir(f"{staged}/_manifest", recursive=True)
        with store.open_output_stream(f"{staged}/_manifest/_DONE") as out:
            out.write(str(sum(m.files for m in messages)).encode())
        aside = f"{place}.before-{uuid.uuid4().hex}"
        stood = store.get_file_info(place).type != fs.FileType.NotFound
        if stood:
            store.move(place, aside)
        try:
            store.move(staged, place)
        except OSError:
            if stood:
                store.move(aside, place)
            raise
        if stood:
            store.delete_dir(aside)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, staged = _store(self.staging)
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)


class FileSink(DataSource):
    """`df.write.format("files")` for rows (path, content): see `write_files`."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """(path, content) rows as the files of a folder, which then holds these and no others; returns their manifest."""
    spark = files.sparkSession
    spark.dataSource.register(FileSink)
    rows = files.selectExpr("cast(path AS string) AS path", "cast(content AS binary) AS content")
    if rows.groupBy("path").count().where("count > 1").limit(1).count():
        raise ValueError("two rows for one path")
    rows.write.format("files").mode("overwrite").option("path", folder).save()
    return spark.read.schema(MANIFEST).json(f"{folder.rstrip('/')}/_manifest")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder that `write_files` wrote, with their manifest: path, bytes, sha256, content.

    Tasks open what the manifest names, so no folder is listed and many small files are few tasks. A file that is not as
    the manifest has it is an error.
    """
    place = folder.rstrip("/")
    many = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = spark.read.schema(MANIFEST).json(f"{place}/_manifest").repartition(many)

    def run(batches):
        store, base = _store(place)
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part, found = b.slice(k, 64), []
                for path, sha in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                    with store.open_input_stream(f"{base}/{path}", compression=None) as f:
                        found.append(f.read())
                    if hashlib.sha256(found[-1]).hexdigest() != sha:
                        raise ValueError(f"not as the manifest has it: {path}")
                columns = [*part.columns, pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "bytes", "sha256", "content"])

    return rows.mapInArrow(run, f"{MANIFEST}, content binary")
