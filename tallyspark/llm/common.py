"""Pieces that several operators of this subpackage share.

Nothing here (or anywhere else in the subpackage) is imported by the rest of the library.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.plans.scratch import drop_stash, new_folder, stash

__all__ = [
    "bounded",
    "components",
    "drop_stash",
    "gapless",
    "join_rows",
    "new_folder",
    "open_store",
    "remainder",
    "slices",
    "stash",
    "tokens",
]

ROWS_PER_BLOCK = 50_000
#: A key with at least one in so many rows is met by a broadcast, so that there are never more than so many such keys.
COMMON = 512
#: A key with fewer rows than this is never worth one.
FEW = 64


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words `[^\\x20\\x09-\\x0D]+` of a whole text as UTF-8; null has none.

    `bytes.split()` splits at exactly these characters, and `bytes.lower()` lowers exactly A-Z.
    """
    return (text or "").encode("utf-8", "replace").lower().split()


def slices(batches, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches a few rows at a time, so that what Python makes of whole texts stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def bounded(texts: list[str | None], rows: int = 64, chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts: at most so many, and of so many characters together unless one text alone has more."""
    start, held = 0, 0
    for k, x in enumerate(texts):
        size = len(x) if x else 0
        if k > start and (k - start == rows or held + size > chars):
            yield start, k
            start, held = k, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def open_store(uri: str):
    """File system and path of a folder or file, local or remote."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def remainder(key: str, divisor: int, equals: int) -> Column:
    """crc32 of the key as text, modulo `divisor`, equals `equals`; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % divisor == equals, F.lit(False))


def common_keys(rows: DataFrame, key: list[str], total: int) -> DataFrame:
    """The keys of at least FEW rows and of one in COMMON of all rows, which are COMMON keys at most."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).where(
        F.col("_rows") >= max(FEW, -(-total // COMMON))
    ).select(*key)


def join_rows(rows: DataFrame, keyed: DataFrame, key: list[str], total: int | None = None) -> DataFrame:
    """Inner join of many rows with a table of one row a key, whatever share of the rows one key has.

    The rows of common keys (COMMON at most) are met by a broadcast where they are; the others by a shuffle, in which no
    key is large then.
    """
    common = F.broadcast(common_keys(rows, key, rows.count() if total is None else total))
    hot = rows.join(F.broadcast(keyed.join(common, key)), key)
    rest = rows.join(common, key, "left_anti").join(keyed, key)
    return hot.unionByName(rest.select(hot.columns))


def gapless(df: DataFrame, group: str, order: list[str], out: str, rows: int | None = None) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without putting a group into one task.

    Rows of a group fall into hash blocks of about ROWS_PER_BLOCK rows; a block is numbered by a window of its own
    and shifted by the sizes of the blocks before it (a running sum over one row per block). `order` must tell rows
    apart, or equal rows meet in one block. `df` is read twice.
    """
    rows = df.count() if rows is None else rows
    blocks = max(1, -(-rows // ROWS_PER_BLOCK))
    cut = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    sizes = cut.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(
        F.col(group).alias("_g"),
        F.col("_block").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"),
    )
    within = Window.partitionBy(group, "_block").orderBy(*order)
    numbered = cut.withColumn("_r", F.row_number().over(within) - 1)
    met = numbered.join(shift, (F.col(group) == F.col("_g")) & (F.col("_block") == F.col("_b")))
    return met.withColumn(out, (F.col("_shift") + F.col("_r")).cast("long")).drop("_block", "_r", "_g", "_b", "_shift")


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """Rows (u, v) with m, the least v of their u."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return join_rows(rows, least.select("u", "m"), ["u"], total)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (id, root), root the smallest id reachable.

    Alternating large-star and small-star rounds, each written to the shared folder; nothing is collected but numbers of
    edges. A node with many edges meets its least neighbour by a broadcast (`join_rows`). Ids without an edge do not
    appear.
    """
    now = stash(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    for _ in range(most_rounds):
        total = now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met = _with_least(both, 2 * total).where("v > u")  # large star: larger neighbours to the least of all
        large = stash(
            met.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct(), "edges"
        )
        drop_stash(now)
        met = _with_least(large, total)  # small star: smaller neighbours and the node itself to the least
        small = met.select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        now = stash(small.where("u <> v").distinct(), "edges")
        drop_stash(large)
        # settled: every node points at one root, and no root points on
        ends = now.select(F.col("u").alias("k"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            now.select(F.col("v").alias("k"), F.lit(0).alias("out"), F.lit(1).alias("into"))
        )
        if not ends.groupBy("k").agg(
            F.sum("out").alias("out"), F.max("into").alias("into")
        ).where("out > 1 OR (out = 1 AND into = 1)").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return ids.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
