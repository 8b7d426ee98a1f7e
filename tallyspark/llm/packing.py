"""Optimal length buckets and token-budget batches.

Each text becomes sequences of at most MAX_LENGTH tokens (all of it: longer ones are cut into full sequences and a
rest). The histogram of sequence lengths over all documents has at most MAX_LENGTH rows, whatever the input; a dynamic
program over it chooses the BUCKETS bucket boundaries with the least padding in total. Within a bucket every batch
holds floor(BUDGET / boundary) sequences, so that its padded tokens stay within the budget; only the last is smaller.
Places in a bucket come from hash blocks, so a bucket with most of the rows is still many tasks.

Cases: a null or empty text is one sequence of one token (the end); fewer lengths than buckets give a bucket a length
and no padding; null ids are kept; repeated rows are sequences of their own; strings of special tokens are counted as
ordinary text; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless, stash
from .segments import load_ranks, tokenizer_file

MAX_LENGTH = 2048
BUCKETS = 8
BUDGET = 65_536


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Boundaries (the last is the greatest length) with the least sum of count * (boundary - length)."""
    order = np.argsort(lengths)
    x = np.array(lengths, np.int64)[order]
    c = np.array(counts, np.int64)[order]
    n = len(x)
    if not n:
        return []
    buckets = min(buckets, n)
    rows, mass = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    best = np.full(n + 1, np.iinfo(np.int64).max // 2)
    best[0] = 0
    came = np.zeros((buckets, n + 1), np.int64)
    for k in range(buckets):
        new = np.full(n + 1, np.iinfo(np.int64).max // 2)
        for j in range(k + 1, n + 1):
            cost = best[:j] + (rows[j] - rows[:j]) * x[j - 1] - (mass[j] - mass[:j])
            i = int(cost.argmin())
            new[j], came[k, j] = cost[i], i
        best = new
    out, j = [], n
    for k in range(buckets - 1, -1, -1):
        out.append(int(x[j - 1]))
        j = int(came[k, j])
    return out[::-1]


def token_lengths(docs: DataFrame, text: str, out: str, tokenizer: str | None = None) -> DataFrame:
    """Adds the number of tokens of each whole text, its end included."""
    path = tokenizer or tokenizer_file("byte_bpe_50k.tiktoken")

    def run(texts: pd.Series) -> pd.Series:
        read = load_ranks(path).encode_ordinary
        return pd.Series([0 if pd.isna(x) else len(read(x)) for x in texts], dtype="int64") + 1

    return docs.withColumn(out, F.pandas_udf(run, "long")(F.col(text)))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    max_length: int = MAX_LENGTH,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    tokenizer: str | None = None,
) -> DataFrame:
    """One row per sequence: doc_id, part, length, bucket, bucket_length, batch, slot."""
    rows = token_lengths(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "text", "n", tokenizer
    ).select("doc_id", "n")
    whole = F.floor((F.col("n") - 1) / max_length)
    cut = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), whole)).alias("part"))
    length = F.least(
        F.lit(max_length).cast("long"), F.col("n") - F.col("part") * max_length
    ).cast("int").alias("length")
    place = F.monotonically_increasing_id().alias("_place")  # tells equal rows apart
    cut = stash(cut.select("doc_id", F.col("part").cast("int").alias("part"), length, place), "sequences")
    histogram = cut.groupBy("length").count().collect()  # max_length rows at most
    bounds = optimal_boundaries([r.length for r in histogram], [r["count"] for r in histogram], buckets)
    if not bounds:
        kinds = {"bucket": "int", "bucket_length": "int", "batch": "long", "slot": "int"}
        return cut.select("doc_id", "part", "length", *[F.lit(None).cast(v).alias(k) for k, v in kinds.items()])
    number = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        number = F.when(F.col("length") <= bounds[k], F.lit(k)).otherwise(number)
    placed = cut.withColumn("bucket", number)
    placed = gapless(placed, "bucket", ["doc_id", "part", "_place"], "at", sum(r["count"] for r in histogram))
    length = F.element_at(F.array(*[F.lit(b) for b in bounds]), F.col("bucket") + 1)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / length))
    return placed.select(
        "doc_id",
        "part",
        "length",
        "bucket",
        length.alias("bucket_length"),
        F.floor(F.col("at") / room).cast("long").alias("batch"),
        (F.col("at") % room).cast("int").alias("slot"),
    )


def op2_length_buckets(spark, sf_dir: str) -> DataFrame:
    """Sequences of all documents in buckets of least padding, batched within a token budget."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
