"""Greedy size-bounded shards of ordered rows: exact, and no group of rows in one task.

A new shard starts where the next row would pass the limit; a larger row stands alone. So where a shard starts depends
on all rows before it. Rows are sorted by range into blocks of about BLOCK_ROWS. What a block does to those after it
depends on nothing but the bytes that the open shard holds where the block begins (the carry): the carry gives the first
cut inside the block, and that one all others. So

1. each block tells, for every row that may be its first cut, how many shards start from there and what the last holds;
2. a scan over these tables, a block at a time, gives every block its carry and the number of its open shard;
3. the blocks number their rows.

With several counters (bytes of two files, say) a shard is full when any would pass the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.plans.scratch import stash

BLOCK_ROWS = 100_000


class Block:
    """Running sums of the sizes of one block of rows: one row a counter, a 0 in front."""

    def __init__(self, sums: np.ndarray, limit: int):
        self.sums, self.limit, self.rows = sums, limit, sums.shape[1] - 1

    @classmethod
    def of(cls, sizes: np.ndarray, limit: int) -> Block:
        return cls(np.concatenate([np.zeros((len(sizes), 1), np.int64), np.cumsum(sizes, axis=1)], axis=1), limit)

    def first_cut(self, carry: list[int]) -> int:
        """The first row that opens a shard where the open one holds `carry`; the number of rows if none does."""
        full = min(
            int(np.searchsorted(s, self.limit - c, side="right")) - 1 for s, c in zip(self.sums, carry, strict=True)
        )
        begun = 0 if carry[0] > 0 else int(np.searchsorted(self.sums[0], 0, side="right"))
        return min(max(full, begun, 0), self.rows)

    def next_cuts(self) -> list[int]:
        """For a shard that starts at each row, the start of the next."""
        full = np.min([np.searchsorted(s, s[:-1] + self.limit, side="right") - 1 for s in self.sums], axis=0)
        begun = np.searchsorted(self.sums[0], self.sums[0][:-1], side="right")
        return np.minimum(np.maximum(full, begun), self.rows).tolist()

    def table(self) -> tuple[np.ndarray, list[int], np.ndarray]:
        """For every row that may be the first cut: running sums up to it, shards from it on, what the last one holds."""
        after = self.next_cuts()
        count, last = [0] * (self.rows + 1), list(range(self.rows + 1))
        for i in range(self.rows - 1, -1, -1):
            count[i] = 1 + count[after[i]]
            last[i] = i if after[i] == self.rows else last[after[i]]
        most = min(self.first_cut([0] * len(self.sums)) + 1, self.rows)
        return self.sums[:, : most + 1], count[:most], self.sums[:, -1:] - self.sums[:, last[:most]]

    def starts(self, carry: list[int]) -> list[int]:
        after, out, at = self.next_cuts(), [], self.first_cut(carry)
        while at < self.rows:
            out.append(at)
            at = after[at]
        return out


def _pieces(batches) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of equal keys (the first two columns) in sorted batches."""
    now, held = None, []
    for b in batches:
        marks = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        edges = [i for i in range(len(marks)) if i == 0 or marks[i] != marks[i - 1]]
        for start, end in zip(edges, [*edges[1:], len(marks)], strict=True):
            if marks[start] != now and held:
                yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            now = marks[start]
            held.append(b.slice(start, end - start))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _sizes(batch: pa.RecordBatch, many: int) -> np.ndarray:
    return np.array(
        [batch.column(3 + k).to_numpy(zero_copy_only=False) for k in range(many)], np.int64
    ).reshape(many, -1)


def _packed(rows: Iterator[tuple[list, ...]], schema: pa.Schema, at_least: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Columns of several pieces in one batch."""
    held: list[list] = [[] for _ in schema]
    for columns in rows:
        for into, new in zip(held, columns, strict=True):
            into += new
        if len(held[0]) >= at_least:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(held, schema, strict=True)], schema=schema
            )
            held = [[] for _ in schema]
    if held[0]:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(held, schema, strict=True)], schema=schema
        )


_KEY = [("_block", pa.int64()), ("_g", pa.string())]
_LONGS = pa.list_(pa.int64())
_TABLE = pa.schema([*_KEY, ("sums", _LONGS), ("total", _LONGS), ("count", _LONGS), ("held", _LONGS)])
_CARRY = pa.schema([*_KEY, ("_carry", _LONGS), ("_open", pa.int64())])
_PLACED = pa.schema([("_at", pa.int64()), ("_shard", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", _LONGS: "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _tell(batches, many: int, limit: int):
    """Step 1."""
    for (block, group), piece in _pieces(batches):
        told = Block.of(_sizes(piece, many), limit)
        sums, count, held = told.table()
        yield [block], [group], [sums.ravel().tolist()], [told.sums[:, -1].tolist()], [count], [held.ravel().tolist()]


def _scan(batches, many: int, limit: int):
    """Step 2, over the blocks of a group in order."""
    now, carry, shard = None, [], 0
    for b in batches:
        for block, group, sums, total, count, held in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if group != now:
                now, carry, shard = group, [0] * many, 0
            yield [block], [group], [carry], [shard]
            cut = Block(np.array(sums, np.int64).reshape(many, -1), limit).first_cut(carry)
            if cut < len(count):
                shard += count[cut]
                carry = np.array(held, np.int64).reshape(many, -1)[:, cut].tolist()
            else:
                carry = [c + t for c, t in zip(carry, total, strict=True)]


def _number(batches, many: int, limit: int):
    """Step 3."""
    for _, piece in _pieces(batches):
        carry, shard = piece.column(3 + many)[0].as_py(), piece.column(4 + many)[0].as_py()
        starts = Block.of(_sizes(piece, many), limit).starts(carry)
        numbers = shard + np.searchsorted(np.array(starts, np.int64), np.arange(piece.num_rows), side="right")
        yield piece.column(2).to_pylist(), numbers.tolist()


def greedy_shards(rows: DataFrame, group: list[str], order: list[str], sizes: list[str], limit: int) -> DataFrame:
    """group, order and shard: the number of the shard of each row within its group, rows in order.

    A null size counts as 0. Rows that are equal in group and order stand in any order among themselves.
    """
    many, wide = len(sizes), max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    measures = [f"_s{k}" for k in range(many)]
    counted = [
        F.coalesce(F.col(s).cast("long"), F.lit(0).cast("long")).alias(m) for s, m in zip(sizes, measures, strict=True)
    ]
    slim = rows.select(*group, *order, *counted)
    blocks = max(1, -(-slim.count() // BLOCK_ROWS))
    sort = [*group, *order]
    dealt = slim.repartitionByRange(blocks, *sort).sortWithinPartitions(*sort)
    name = F.to_json(F.struct(*group)) if group else F.lit("")
    keyed = dealt.select(
        "*",
        F.spark_partition_id().cast("long").alias("_block"),
        name.alias("_g"),
        F.monotonically_increasing_id().alias("_at"),
    )
    fixed = stash(keyed, "shard-rows")
    slim = fixed.select("_block", "_g", "_at", *measures)

    def by_block(df: DataFrame) -> DataFrame:
        return df.repartition(blocks, "_block").sortWithinPartitions("_block", "_g", "_at")

    told = by_block(slim).mapInArrow(lambda bs: _packed(_tell(bs, many, limit), _TABLE, 100), _ddl(_TABLE))
    in_turn = told.repartition(wide, "_g").sortWithinPartitions("_g", "_block")
    carries = stash(
        in_turn.mapInArrow(lambda bs: _packed(_scan(bs, many, limit), _CARRY), _ddl(_CARRY)), "shard-carries"
    )
    met = by_block(slim.join(carries, ["_block", "_g"]).select("_block", "_g", "_at", *measures, "_carry", "_open"))
    numbered = met.mapInArrow(lambda bs: _packed(_number(bs, many, limit), _PLACED), _ddl(_PLACED))
    return fixed.join(numbered, "_at").select(*group, *order, F.col("_shard").cast("int").alias("shard"))


def shard_rows(rows: DataFrame, group: str, order: list[str], size: str, limit: int) -> DataFrame:
    """The rows with the number of their shard; group and order tell rows apart."""
    return rows.join(greedy_shards(rows, [group], order, [size], limit), [group, *order])
