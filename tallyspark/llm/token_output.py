"""Token ids in Arrow files of fixed-size-list batches, and reading them back.

Documents are dealt out by ranges of their id (rows of one id, or without one, by a hash of the text and by their place
in the input, so that any number of them are many tasks), so that files in order hold documents in order. Each file is an Arrow
IPC file (a stream of record batches with a footer) of sequences: `ids` (fixed-size list of SEQUENCE ids; 16 bits where
the vocabulary allows) and `mask` (fixed-size list of booleans, false where the last sequence is padded). Batches hold
BATCH sequences each, so sequence i is row i % BATCH of batch i // BATCH; from a memory-mapped file it is a view, not a
copy. Beside it an index file holds (doc_id, start, n_tokens), one row a document, in order, starts within the file.

Each task writes under a name of its own and returns it, so a repeated or speculative task does no harm: only the names
of the tasks that counted are read. One row per file reaches the driver.

The crc32 of a document is taken over 32-bit ids, so reading them back for it widens the stored 16-bit ones; only
`sequence_at` is free of copies.

Cases: null and empty texts are one end id; null ids come first; repeated rows are documents of their own, in the order
of a hash of their text; strings of special tokens are the tokens that the vocabulary file has for them; ids are whole
numbers; other columns are ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, open_store, slices
from .segments import encoder_for, load_tokenizer, tokenizer_file

SEQUENCE = 2048
BATCH = 64
END_ID = 2
FILE_FIELDS = "part int, ids_file string, index_file string, n_ids long, n_docs long"


def _uri(path: str) -> str:
    return path.replace("file:///", "file:/").replace("file:/", "file:///") if path.startswith("file:") else path


class SequenceWriter:
    """Writes a stream of ids as equal-length sequences."""

    def __init__(self, out, sequence: int, width: np.dtype):
        self.kind = pa.schema(
            [("ids", pa.list_(pa.from_numpy_dtype(width), sequence)), ("mask", pa.list_(pa.bool_(), sequence))]
        )
        self.sequence, self.width = sequence, width
        self.writer = pa.ipc.new_file(out, self.kind)
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.width))
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= BATCH * self.sequence:
            flat = np.concatenate(self.held)
            size = BATCH * self.sequence
            k = 0
            while len(flat) - k >= size:
                self._write(flat[k : k + size], size)
                k += size
            self.held, self.n_held = [flat[k:].copy()], len(flat) - k

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(flat)) < real)
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(flat), self.sequence),
            pa.FixedSizeListArray.from_arrays(mask, self.sequence),
        ]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.kind))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            whole = -(-len(flat) // self.sequence) * self.sequence
            self._write(np.concatenate([flat, np.zeros(whole - len(flat), self.width)]), len(flat))
        self.writer.close()


def write_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    sequence: int = SEQUENCE,
    files: int | None = None,
) -> DataFrame:
    """Encode whole texts and write the files; one row a file (FILE_FIELDS and `before`: ids in the files before it)."""
    spark = docs.sparkSession
    path = tokenizer or tokenizer_file("byte_bpe_50k.json")
    files = files or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "place"]
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    folder = _uri(folder)

    def run(batches):
        from pyspark import TaskContext

        part, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
        encoder = encoder_for(path)
        width = np.dtype(np.uint16 if load_tokenizer(path).get_vocab_size() <= 65_536 else np.uint32)
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        names = [f"{folder}/{part:06d}-{mark}.{kind}.arrow" for kind in ("ids", "index")]
        kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        writer = index = None
        outs, n_docs = [], 0
        for b in slices(batches):
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            if writer is None:
                outs = [store.open_output_stream(open_store(n)[1]) for n in names]
                writer, index = SequenceWriter(outs[0], sequence, width), pa.ipc.new_file(outs[1], kind)
            starts, sizes = [], []
            for raw in encoder.encode(texts):
                ids = np.append(np.frombuffer(raw, np.uint32), np.uint32(end_id))
                starts.append(writer.n)
                sizes.append(len(ids))
                writer.add(ids)
            index.write_batch(
                pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, sizes)], schema=kind)
            )
            n_docs += len(keys)
        if writer is not None:
            writer.close()
            index.close()
            for o in outs:
                o.close()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([names[0]]),
                    pa.array([names[1]]),
                    pa.array([writer.n], pa.int64()),
                    pa.array([n_docs], pa.int64()),
                ],
                ["part", "ids_file", "index_file", "n_ids", "n_docs"],
            )

    rows = sorted(dealt.mapInArrow(run, FILE_FIELDS).collect(), key=lambda r: r.part)
    before, table = 0, []
    for r in rows:
        table.append((*r, before))
        before += r.n_ids
    return spark.createDataFrame(table, FILE_FIELDS + ", before long")


def _open(uri: str):
    store, path = open_store(uri)
    return pa.memory_map(path) if type(store).__name__ == "LocalFileSystem" else store.open_input_file(path)


def sequence_at(uri: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence i of a file; the ids are a view of the mapped file."""
    batch = pa.ipc.open_file(_open(uri)).get_batch(i // BATCH)
    row = i % BATCH
    size = batch.schema.field("ids").type.list_size
    ids = batch.column(0).flatten().to_numpy()[row * size : (row + 1) * size]
    return ids, batch.column(1).flatten()[row * size : (row + 1) * size].to_numpy(zero_copy_only=False)


def documents_in(ids_file: str, index_file: str) -> Iterator[tuple[int, int, int, int]]:
    """(doc_id, start in the file, n_tokens, crc32 of the ids as little-endian unsigned 32-bit) of each document, in order."""
    ids, index = pa.ipc.open_file(_open(ids_file)), pa.ipc.open_file(_open(index_file))
    at, block, low, high = -1, b"", 0, 0
    for k in range(index.num_record_batches):
        for key, start, n in zip(*(c.to_pylist() for c in index.get_batch(k).columns), strict=True):
            crc, now, end = 0, start, start + n
            while now < end:
                if now >= high:
                    at += 1
                    flat = ids.get_batch(at).column(0).flatten().to_numpy()
                    block, low, high = flat.astype("<u4").tobytes(), high, high + len(flat)
                    continue
                take = min(end, high)
                crc = zlib.crc32(memoryview(block)[(now - low) * 4 : (take - low) * 4], crc)
                now = take
            yield key, start, n, crc


def read_files(files: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (over all files), n_tokens, ids_crc32."""
    spark: SparkSession = files.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        for b in batches:
            for ids_file, index_file, before in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                rows = []
                for key, start, n, crc in documents_in(ids_file, index_file):
                    rows.append((key, before + start, n, crc))
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return files.select("ids_file", "index_file", "before").repartition(parts).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"]
    )


def op6_arrow_sequences(spark, sf_dir: str) -> DataFrame:
    """Encode all documents, write the files in ascending doc_id, and read them back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_files(write_files(docs, new_folder(spark, "sequences")))
