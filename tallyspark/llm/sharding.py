"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a vector of `shards` sums. Differencing takes the two partial partitions with the largest spread
(largest less smallest sum) and lays them on each other in opposite order, until one is left. It works on partial
partitions as well as on single groups, so it is done in a tree: groups fall into hash blocks of about BLOCK groups,
each block is differenced in a task of its own, then the blocks' results are, FAN of them to a task, until one is left.
No task holds more than about BLOCK groups or FAN vectors, and the driver holds none of the groups.

Groups are equal texts (null as empty) and are never split: a group larger than a shard's fair share makes its shard
that much larger, and differencing puts nothing beside it. Rows of a group may be many; only (group, bytes, rows) are
dealt with, summed before the shuffle.

Law: `bytes`. Cases: null text counts as empty with 0 bytes; null ids are kept; repeated rows are rows of their own;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless, join_rows, stash

BLOCK = 20_000
FAN = 512
OVERHEAD = 16


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of sums) into one.

    Returns its sums in falling order, and for each row where its columns went: out[i, j] is the place of column j.
    """
    n, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    total = max(0, 2 * n - 1)
    values = np.zeros((total, k), np.int64)
    values[:n] = np.take_along_axis(sums, order, axis=1)
    left, right = np.zeros(total, np.int64), np.zeros(total, np.int64)
    turn = np.zeros((total, k), np.int64)  # place of each column of the laid-over vector after sorting
    heap = [(-int(values[i, 0] - values[i, -1]), i) for i in range(n)]
    heapq.heapify(heap)
    new = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = values[a] + values[b, ::-1]
        by = np.argsort(-both, kind="stable")
        values[new] = both[by]
        turn[new, by] = np.arange(k)
        left[new], right[new] = a, b
        heapq.heappush(heap, (-int(values[new, 0] - values[new, -1]), new))
        new += 1
    place = np.zeros((total, k), np.int64)
    place[total - 1] = np.arange(k)
    for m in range(total - 1, n - 1, -1):  # from the root down to the rows
        at = place[m][turn[m]]
        place[left[m]] = at
        place[right[m]] = at[::-1]
    out = np.zeros((n, k), np.int64)
    np.put_along_axis(out, order, place[:n], axis=1)
    return values[total - 1], out


def _difference_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(block, key binary, bytes) -> one row a group (block, key, place) and one a block (block, null, sums)."""

    def run(batches):
        now, keys, sizes = None, [], []

        def done():
            first = np.zeros((len(keys), shards), np.int64)
            first[:, 0] = sizes
            sums, place = difference(first)
            n = len(keys)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([now] * (n + 1), pa.int64()),
                    pa.array([*keys, None], pa.binary()),
                    pa.array([*place[:, 0].tolist(), None], pa.int32()),
                    pa.array([*[None] * n, sums.tolist()], pa.list_(pa.int64())),
                ],
                ["block", "key", "place", "sums"],
            )

        for b in batches:
            for k, key, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if k != now:
                    if keys:
                        yield done()
                    now, keys, sizes = k, [], []
                keys.append(key)
                sizes.append(size)
        if keys:
            yield done()

    return groups.mapInArrow(run, "block long, key binary, place int, sums array<long>")


def _difference_blocks(rows: DataFrame, shards: int) -> DataFrame:
    """(up, block, sums) sorted by up -> (up, block, places) for each block, and (up, null, sums) for each up."""

    def run(batches):
        now, blocks, sums = None, [], []

        def done():
            total, place = difference(np.array(sums, np.int64))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([now] * (len(blocks) + 1), pa.int64()),
                    pa.array([*blocks, None], pa.int64()),
                    pa.array([*place.tolist(), total.tolist()], pa.list_(pa.int64())),
                ],
                ["up", "block", "values"],
            )

        for b in batches:
            for u, k, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if u != now:
                    if blocks:
                        yield done()
                    now, blocks, sums = u, [], []
                blocks.append(k)
                sums.append(s)
        if blocks:
            yield done()

    return rows.mapInArrow(run, "up long, block long, values array<long>")


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(key binary, bytes long), one row a group -> (key, shard int), by differencing in a tree of blocks."""
    count = groups.count()
    parts = max(1, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(1, -(-count // BLOCK))
    dealt = groups.select(
        F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "key", "bytes"
    ).repartition(min(parts, blocks), "block").sortWithinPartitions("block", "key")
    done = stash(_difference_groups(dealt, shards), "blocks")
    out = done.where("key IS NOT NULL").select("key", "block", F.col("place").alias("shard"))
    level = done.where("key IS NULL").select("block", "sums")
    while blocks > 1:
        ups = -(-blocks // FAN)
        rows = level.select(
            F.pmod(F.col("block"), F.lit(ups)).alias("up"), "block", "sums"
        ).repartition(min(parts, ups), "up").sortWithinPartitions("up", "block")
        step = stash(_difference_blocks(rows, shards), "blocks")
        places = step.where("block IS NOT NULL").select(
            F.col("block").alias("b"), F.col("up").alias("u"), F.col("values").alias("places")
        )
        out = out.join(places, F.col("block") == F.col("b")).select(
            "key", F.col("u").alias("block"), F.element_at("places", F.col("shard") + 1).cast("int").alias("shard")
        )
        level = step.where("block IS NULL").select(F.col("up").alias("block"), F.col("values").alias("sums"))
        blocks = ups
    return out.select("key", "shard")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, size, text_crc32, shard, slot (0, 1, ... within the shard)."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size = (F.length(raw) + OVERHEAD).cast("long").alias("size")
    place = F.monotonically_increasing_id().alias("_place")  # tells equal rows apart
    rows = stash(
        docs.select(
            F.col(id_col).alias("doc_id"),
            size,
            F.crc32(raw).alias("text_crc32"),
            F.unhex(F.sha2(raw, 256)).alias("key"),
            place,
        ),
        "sizes",
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    shard = assign_groups(groups, shards)
    placed = stash(join_rows(rows, shard, ["key"]).select("doc_id", "size", "text_crc32", "shard", "_place"), "placed")
    return gapless(placed, "shard", ["doc_id", "text_crc32", "_place"], "slot").drop("_place")


def op4_differencing_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes, equal texts together."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
