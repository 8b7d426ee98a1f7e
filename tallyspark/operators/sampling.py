"""Samples, ordinals, de-duplicated pools and batches."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import claim_key, digest, fold, text_windows

from .stats import positions


def hash_top_k(rows: DataFrame, group: str, id_col: str, k: int, seed: int = 8105) -> DataFrame:
    """Per group the k ids with the least sha256 of `seed:id`; independent of the order of rows.

    Partial top-k first: Spark's window group limit drops all but k rows a group before the shuffle.
    """
    rank = Window.partitionBy(group).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256))
    return rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def allocate(sizes: dict, total: int, floor: int) -> dict:
    """Shares of `total` in proportion to the sizes of a few cells, at least `floor` each (all of a smaller cell).

    If the floors alone are too many, there are none.
    """
    sizes = {k: n for k, n in sizes.items() if n > 0}
    if total >= sum(sizes.values()):
        return sizes
    fits = sum(min(floor, n) for n in sizes.values()) <= total
    return _proportional(sizes, total, floor if fits else 0)


def _proportional(sizes: dict, total: int, floor: int) -> dict:
    """Cells below their floor get it and the others share the rest anew; fractions go by largest remainder.

    A share never exceeds its cell, so rounding one up never does either.
    """
    mass = sum(sizes.values())
    short = {k: min(floor, n) for k, n in sizes.items() if total * n < min(floor, n) * mass}
    if short:
        others = {k: n for k, n in sizes.items() if k not in short}
        return short | (_proportional(others, total - sum(short.values()), floor) if others else {})
    exact = {k: divmod(total * n, mass) for k, n in sizes.items()}
    up = sorted(exact, key=lambda k: (-exact[k][1], k))[: total - sum(q for q, _ in exact.values())]
    return {k: q + (k in up) for k, (q, _) in exact.items()}


def cell_key(c: str) -> Column:
    """The text of a cell value; a null is a value of its own."""
    return F.coalesce(F.col(c).cast("string"), F.lit("\0null"))


def cell_sizes(rows: DataFrame, cell: list[str]) -> dict:
    """Sizes of the cells, which are few: categories by strata."""
    return {
        tuple(r[:-1]): r[-1] for r in rows.groupBy(
            *[cell_key(c).alias(f"_c{i}") for i, c in enumerate(cell)]
        ).count().collect()
    }


def stratified_sample(
    rows: DataFrame,
    cell: list[str],
    id_col: str,
    size: int,
    seed: int = 8105,
    floor: int = 10,
    prefix: str = "X",
    parity: bool = False,
) -> DataFrame:
    """An allocated sample of each cell, numbered X001, X002, ... in order of cell and id.

    By default the first ids by hash; with `parity` the positions that Python's seeded generator draws from each cell's
    sorted ids (positions are drawn on the driver, the rows are met by rank).
    """
    sizes = cell_sizes(rows, cell)
    want = allocate(sizes, size, floor)
    spark = rows.sparkSession
    keyed = rows.withColumns({f"_c{i}": cell_key(c) for i, c in enumerate(cell)})
    keys = [f"_c{i}" for i in range(len(cell))]
    if parity:
        rng = random.Random(seed)
        picks = [
            (*c, p) for c in sorted(sizes) for p in (
                rng.sample(range(sizes[c]), want.get(c, 0)) if want.get(c, 0) < sizes[c] else range(sizes[c])
            )
        ]
        by = Window.partitionBy(*keys).orderBy(id_col)
        chosen = spark.createDataFrame(picks, ", ".join(f"{k} string" for k in keys) + ", _p int")
        got = keyed.withColumn("_p", F.row_number().over(by) - 1).join(F.broadcast(chosen), [*keys, "_p"]).drop("_p")
    else:
        limits = spark.createDataFrame(
            [(*c, n) for c, n in want.items()], ", ".join(f"{k} string" for k in keys) + ", _want int"
        )
        by = Window.partitionBy(*keys).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256))
        got = keyed.withColumn(
            "_n", F.row_number().over(by)
        ).where(F.col("_n") <= size).join(F.broadcast(limits), keys).where("_n <= _want").drop("_n", "_want")
    number = F.row_number().over(Window.orderBy(*keys, id_col))  # `size` rows
    return got.withColumn("row_id", F.format_string(prefix + "%03d", number)).drop(*keys)


def extension_sample(
    rows: DataFrame, sampled: DataFrame, cell: list[str], id_col: str, size: int, kind: str, seed: int = 8106
) -> DataFrame:
    """A second sample of one kind among the rows that the first left, numbered E001, E002, ..."""
    rest = rows.where(F.col("kind") == kind).join(sampled.select(id_col), id_col, "left_anti")
    return stratified_sample(rest, cell, id_col, size, seed, prefix="E")


def audit_sample(
    rows: DataFrame, id_col: str, contradicted: int = 30, confirmed: int = 10, seed: int = 8105
) -> DataFrame:
    top = hash_top_k(
        rows.where(F.col("bin").isin("contradicted", "confirmed")), "bin", id_col, max(contradicted, confirmed), seed
    )
    return top.where(
        F.col("rank") <= F.when(F.col("bin") == "contradicted", contradicted).otherwise(confirmed)
    ).drop("rank")


def labels(rows: DataFrame, group: str, order: list[str], prefix: str, out: str = "label") -> DataFrame:
    """F1, F2, ... within each group, whatever its size (`stats.positions`)."""
    placed = positions(rows, [group], order, "_at")
    return placed.withColumn(out, F.concat(F.lit(prefix), (F.col("_at") + 1).cast("string"))).drop("_at", "_n")


def shuffled_labels(rows: DataFrame, group: str, id_col: str, prefix: str, seed: int = 8105) -> DataFrame:
    """Labels in an order that the seed, the group and the id decide."""
    mixed = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.col(id_col).cast("string")), 256)
    return labels(rows.withColumn("_mixed", mixed), group, ["_mixed"], prefix).drop("_mixed")


def batches(rows: DataFrame, group: str, key: str, size: int, prefix: str) -> DataFrame:
    """Fixed-size batches of each group in order of key: group, batch (prefix and 12 hex of the keys' hash), items."""
    placed = positions(rows.select(group, key), [group], key, "_at")
    out = placed.withColumn("_b", F.floor(F.col("_at") / size)).groupBy(group, "_b").agg(
        F.array_sort(F.collect_list(F.col(key).cast("string"))).alias("items")
    )
    return out.select(group, F.concat(F.lit(prefix), digest(F.array_join("items", "\n"))).alias("batch"), "items")


def text_pool(texts: DataFrame, size: int = 8000, overlap: int = 1000) -> DataFrame:
    """Windows of all texts (run_id, question_id, companies, category, host, kind, stratum, text), each distinct folded window once.

    The first run's attributes stay, by order of run and position; runs, questions and companies are gathered.
    """
    parent = digest(fold("text"))
    rows = texts.select(
        "*", parent.alias("_parent"), F.posexplode(text_windows(F.col("text"), size, overlap)).alias("window", "_w")
    ).withColumn("_f", fold("_w")).where("_f <> ''")
    rows = rows.withColumn("text_id", F.concat(F.lit("T"), digest(F.col("_f"))))
    first = F.struct("run_id", F.coalesce("ord", F.lit(0)).alias("ord"), "window")
    keep = F.struct(
        F.concat(F.lit("T"), F.col("_parent")).alias("parent_text_id"),
        "window",
        "category",
        "host",
        "kind",
        "stratum",
        F.col("_w").alias("text"),
    )
    one = rows.groupBy("text_id").agg(
        F.min_by(keep, first).alias("x"),
        F.array_sort(F.collect_set("run_id")).alias("run_ids"),
        F.array_sort(F.collect_set("question_id")).alias("question_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("companies")))).alias("companies"),
    )
    return one.select("text_id", "x.*", "run_ids", "question_ids", "companies")


def text_sample(pool: DataFrame, size: int = 1500, floor: int = 60, seed: int = 8105) -> DataFrame:
    return stratified_sample(pool, ["category", "stratum"], "text_id", size, seed, floor)


def dedupe(
    rows: DataFrame, key: Column, order: list[str], out: str = "key", keep: list[str] | None = None
) -> DataFrame:
    """The first row of each key and how often the key occurs. One shuffle: counts and the first row in one aggregate.

    `keep` names the columns to carry (all, unless given); if they are the one order column, the aggregate is a plain
    minimum, which needs no sort.
    """
    keep = keep or rows.columns
    keyed = rows.withColumn(out, key)
    if keep == order and len(order) == 1:
        return keyed.groupBy(out).agg(F.min(order[0]).alias(order[0]), F.count(F.lit(1)).alias("occurrences"))
    got = keyed.groupBy(out).agg(
        F.min_by(F.struct(*keep), F.struct(*order)).alias("x"), F.count(F.lit(1)).alias("occurrences")
    )
    return got.select(out, "x.*", "occurrences")


def dedupe_claims(claims: DataFrame) -> DataFrame:
    """Claims (text_id, claim_ord, company, metric, value, period, ...) by their normal form, with an id from its hash."""
    got = dedupe(
        claims,
        claim_key(F.col("company"), F.col("metric"), F.col("value"), F.col("period")),
        ["text_id", "claim_ord"],
        "claim_key",
    )
    return got.withColumn("claim_id", F.concat(F.lit("C"), digest(F.col("claim_key")))).drop("claim_key")
