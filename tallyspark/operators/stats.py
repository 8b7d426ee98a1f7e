"""Question-paired statistics: two-phase means, paired comparisons, seeded bootstrap and Wilson intervals.

All cells of a grid go through one job: cells and blocks of draws are keys, not loops. Means of repetitions (phase one) and
statistics over questions (phase two) are two aggregations on purpose, as a mean of question means is not a mean of runs.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tallyspark.plans.scratch import children, shared_dir, stash

RESAMPLES, SEED = 10_000, 8105
Z = 1.959964
CELL = ["agent", "stratum"]
#: (arm, baseline) pairs that are always compared.
PAIRS = (("archive", "web"), ("both", "web"), ("both", "archive"))
METRICS = {
    "token_ratio_baseline_over_arm": ("total_tokens", "ratio"),
    "accuracy_diff_arm_minus_baseline": ("accuracy", "mean_difference"),
    "completion_diff_arm_minus_baseline": ("completion", "mean_difference"),
}


def question_means(
    rows: DataFrame, value: str, keys: list[str] | None = None, question: str = "question_id"
) -> DataFrame:
    """Mean over the repetitions of each question; nulls are skipped, questions with nothing else are left out."""
    keys = keys or [*CELL, "arm"]
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, question).agg(
        F.avg(F.col(value).cast("double")).alias("mean")
    )


def paired(
    means: DataFrame, arm: str, baseline: str, cell: list[str] | None = None, question: str = "question_id"
) -> DataFrame:
    """Questions that both arms have: a is the baseline's mean, b the arm's. One shuffle: a conditional aggregate, no self-join."""
    cell = cell or CELL
    both = means.where(F.col("arm").isin(arm, baseline)).groupBy(*cell, question).agg(
        F.max(F.when(F.col("arm") == baseline, F.col("mean"))).alias("a"),
        F.max(F.when(F.col("arm") == arm, F.col("mean"))).alias("b"),
    )
    return both.where("a IS NOT NULL AND b IS NOT NULL").withColumns({"arm": F.lit(arm), "baseline": F.lit(baseline)})


def paired_all(
    rows: DataFrame, value: str, pairs: tuple = PAIRS, cell: list[str] | None = None, question: str = "question_id"
) -> DataFrame:
    """`paired` for several (arm, baseline) pairs from run rows, in one shuffle and one scan.

    The mean of each arm's repetitions is a conditional average per question, so both phases share one exchange.
    """
    cell = cell or CELL
    arms = sorted({x for p in pairs for x in p})
    v = F.col(value).cast("double")
    per = rows.where(F.col(value).isNotNull() & F.col("arm").isin(*arms)).groupBy(*cell, question).agg(
        *[F.avg(F.when(F.col("arm") == x, v)).alias(f"_m_{x}") for x in arms]
    )
    both = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(arm).alias("arm"),
                    F.lit(base).alias("baseline"),
                    F.col(f"_m_{base}").alias("a"),
                    F.col(f"_m_{arm}").alias("b"),
                ) for arm, base in pairs
            ]
        )
    ).alias("p")
    return per.select(*cell, question, both).select(*cell, question, "p.*").where("a IS NOT NULL AND b IS NOT NULL")


def dropped(
    rows: DataFrame, pairs: DataFrame, cell: list[str] | None = None, question: str = "question_id"
) -> DataFrame:
    """Questions seen in a cell (any value, null too) that the pairs lack, as a sorted list per cell and pair."""
    cell = cell or CELL
    seen = rows.select(*cell, question).distinct()
    asked = seen.join(pairs.select(*cell, "arm", "baseline").distinct(), cell)
    gone = asked.join(
        pairs.select(*cell, "arm", "baseline", question), [*cell, "arm", "baseline", question], "left_anti"
    )
    return gone.groupBy(*cell, "arm", "baseline").agg(F.array_sort(F.collect_set(question)).alias("dropped_questions"))


#: A statistic of (a, b) over questions: a function of `total`, which gives the sum of a column, and of the number of rows.
Statistic = Callable[[Callable[[str], Column], Column], Column]


def _ratio(total, n):
    return F.when(total("b") == 0, F.lit(float("inf"))).otherwise(total("a") / F.nullif(total("b"), F.lit(0.0)))


def _difference(total, n):
    return (total("b") - total("a")) / F.nullif(n, F.lit(0))


def _share(total, n):
    return total("a") / F.nullif(total("b"), F.lit(0.0))


def _mean(total, n):
    return total("a") / F.nullif(n, F.lit(0))


#: ratio: sum of a over sum of b, infinite over nothing. mean_difference: mean of b - a. share: sum over sum, null over
#: nothing (such draws are skipped). mean: mean of a.
STATISTICS: dict[str, Statistic] = {"ratio": _ratio, "mean_difference": _difference, "share": _share, "mean": _mean}


def aggregate(statistic: str | Statistic) -> Column:
    """A statistic as an aggregate over rows."""
    made = STATISTICS[statistic] if isinstance(statistic, str) else statistic
    return made(lambda c: F.sum(c), F.count(F.lit(1)))


def token_ratio() -> Column:
    """Aggregate: sum of a over sum of b; infinite over nothing."""
    return aggregate("ratio")


def mean_difference() -> Column:
    return aggregate("mean_difference")


def draws_seeded(spark: SparkSession, sizes: list[int], resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(n, draw, idx array) as Python's generator draws them, one generator per size. For parity with earlier results.

    Made on the driver, so for sizes of questions, not of corpora: n * resamples numbers a size.
    """
    rows = []
    for n in sorted(set(sizes)):
        rng = random.Random(seed)
        rows += [(n, d, [rng.randrange(n) for _ in range(n)]) for d in range(resamples)]
    return spark.createDataFrame(rows, "n int, draw int, idx array<int>")


# The finaliser of MurmurHash3 and the golden ratio, in 32 bits.
_C1, _C2, _STEP = 0x85EBCA6B, 0xC2B2AE35, 0x9E3779B9
#: Draws of one task, places of one task, and numbers that a task draws at a time.
DRAW_BLOCK, PLACE_BLOCK, AT_A_TIME = 1000, 1 << 21, 1 << 21


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of 32-bit numbers that any engine with whole numbers can repeat."""
    x = x.astype(np.uint32)
    x ^= x >> np.uint32(16)
    x *= np.uint32(_C1)
    x ^= x >> np.uint32(13)
    x *= np.uint32(_C2)
    x ^= x >> np.uint32(16)
    return x


def drawn_places(seed: int, draws: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Place in 0..n-1 that each draw takes at each of its steps `at`: (draws, steps)."""
    start = _mixed((np.uint64(seed * _STEP % 2**32) + draws.astype(np.uint64)) & np.uint64(0xFFFFFFFF))
    steps = (at.astype(np.uint64) * np.uint64(_STEP) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return _mixed(start[:, None] + steps) % np.uint32(n)


def draws_hashed(spark: SparkSession, sizes: list[int], resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(n, draw, idx array): the places that `bootstrap` draws, for a few sizes of questions."""
    kinds = sorted(set(sizes))

    def run(batches):
        for b in batches:
            draws = b.column(0).to_numpy()
            for n in kinds:
                for k in range(0, len(draws), max(1, AT_A_TIME // n)):
                    part = draws[k : k + max(1, AT_A_TIME // n)]
                    flat = drawn_places(seed, part, np.arange(n), n).astype(np.int32)
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.arange(0, flat.size + 1, n, dtype=np.int32)), pa.array(flat.ravel())
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n] * len(part), pa.int32()), pa.array(part.astype(np.int32)), lists],
                        ["n", "draw", "idx"],
                    )

    return spark.range(0, resamples).mapInArrow(run, "n int, draw int, idx array<int>")


def kept_draws(
    spark: SparkSession, sizes: list[int], resamples: int = RESAMPLES, seed: int = SEED, home: str | None = None
) -> tuple[DataFrame, list[int]]:
    """The index matrix (n, draw, idx) of each size, from a table that is kept below `home` (by default in the shared
    folder, for all applications), one folder for each size, number of draws and seed; and the sizes that had to be made.

    A folder counts once its write is complete, and is never written again.
    """
    home = home or f"{shared_dir(spark)}/tallyspark-draws"
    at = {n: f"{home}/resamples={resamples}/seed={seed}/n={n}" for n in sorted(set(sizes))}
    made = [n for n, path in at.items() if "_SUCCESS" not in children(spark, path)]
    for n in made:
        draws_hashed(spark, [n], resamples, seed).select("draw", "idx").write.mode("overwrite").parquet(at[n])
    kind = "draw int, idx array<int>, n int"
    found = spark.read.schema(kind).option("basePath", f"{home}/resamples={resamples}/seed={seed}").parquet(*at.values())
    return found.select("n", "draw", "idx"), made


def positions(rows: DataFrame, cell: list[str], order: str | list[str], out: str = "_pos") -> DataFrame:
    """Rows with their place 0, 1, ... in their cell by `order` and the cell's size `_n`; no task ranks more than
    PLACE_BLOCK rows of a cell, or one range of it.

    The rows are written once. PLACE_BLOCK rows at most are ranked by a window over the cell. More are dealt by ranges of
    cell and order; a place is the rank within the range of the cell plus the sizes of the cell's ranges before it, a
    running sum over one row a range.
    """
    order = [order] if isinstance(order, str) else order
    rows = stash(rows, "rows")
    if rows.count() <= PLACE_BLOCK:
        by = Window.partitionBy(*cell)
        return rows.withColumns({out: F.row_number().over(by.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(by)})
    many = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(many, *cell, *order).withColumn("_part", F.spark_partition_id())
    dealt = stash(dealt, "places")
    sizes = dealt.groupBy(*cell, "_part").agg(F.count(F.lit(1)).alias("_here"))
    ranges = Window.partitionBy(*cell)
    before = ranges.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(cell)],
        F.col("_part").alias("_at"),
        F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"),
        F.sum("_here").over(ranges).alias("_n"),
    )
    rank = F.row_number().over(Window.partitionBy(*cell, "_part").orderBy(*order)) - 1
    same = F.col("_part") == F.col("_at")
    for i, c in enumerate(cell):
        same = same & F.col(c).eqNullSafe(F.col(f"_c{i}"))
    met = dealt.withColumn("_rank", rank).join(sizes, same)
    return met.select(*rows.columns, (F.col("_before") + F.col("_rank")).alias(out), "_n")


def _summed(placed: DataFrame, cell: list[str], values: list[str], resamples: int, seed: int) -> DataFrame:
    """cell, _draw, sums of the values over each draw and _n, the number of places drawn.

    A task has one cell, one block of draws and one block of places: the numbers drawn are made where they are summed,
    so what is shuffled is the values once for each block of draws, and one row a cell, draw and block of places.
    """
    spark = placed.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = [*cell, "_d", "_p"]
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // DRAW_BLOCK) - 1))).alias("_d")
    rows = placed.select(
        *cell,
        F.col("_n").cast("long"),
        F.col("_pos").cast("long"),
        *[F.col(v).cast("double") for v in values],
        F.floor(F.col("_pos") / PLACE_BLOCK).alias("_p"),
        blocks,
    )
    kind = StructType(
        [placed.schema[c] for c in cell] + [
            StructField("_draw", LongType()), StructField("_n", LongType())
        ] + [StructField(v, DoubleType()) for v in values]
    )

    def run(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n, low, mine = table["_n"][0].as_py(), keys[-1].as_py() * PLACE_BLOCK, table.num_rows
        order = np.argsort(table["_pos"].to_numpy())
        value = [np.append(table[v].to_numpy()[order], 0.0) for v in values]
        value = [np.where(np.isnan(v), 0.0, v) for v in value]
        draws = np.arange(keys[-2].as_py() * DRAW_BLOCK, min(resamples, (keys[-2].as_py() + 1) * DRAW_BLOCK))
        sums = np.zeros((len(values), len(draws)))
        wide = max(1, AT_A_TIME // n)
        for a in range(0, len(draws), wide):
            for k in range(0, n, AT_A_TIME):
                at = drawn_places(seed, draws[a : a + wide], np.arange(k, min(n, k + AT_A_TIME)), n).astype(np.int64)
                if mine < n:
                    at = np.where((at >= low) & (at < low + mine), at - low, mine)
                for j, v in enumerate(value):
                    sums[j, a : a + wide] += v[at].sum(axis=1)
        fixed = [
            pa.array([k.as_py()] * len(draws), f.type) for k, f in zip(keys, to_arrow_schema(kind), strict=False)
        ][: len(cell)]
        return pa.Table.from_arrays(
            [*fixed, pa.array(draws), pa.array(np.full(len(draws), n)), *map(pa.array, sums)], names=kind.names
        )

    made = rows.repartition(tasks, *key).groupBy(*key).applyInArrow(run, kind)
    return made.groupBy(*cell, "_draw").agg(F.max("_n").alias("_n"), *[F.sum(v).alias(v) for v in values])


def _columns_of(statistic: Statistic) -> list[str]:
    """The columns that a statistic sums, in order of name."""
    asked: set[str] = set()
    statistic(lambda c: asked.add(c) or F.lit(1.0), F.lit(1))
    return sorted(asked)


class Weighted(NamedTuple):
    """Any statistic of a cell from how often each draw takes each row: `of(values, weights)` gets a list of arrays (one
    for each of `columns`, a number a row) and an array (draws, rows), and gives a number a draw.

    For cells of PLACE_BLOCK rows at most, of which a task holds one; larger ones are refused. `Quantile` has no bound.
    """

    columns: tuple[str, ...]
    of: Callable[[list[np.ndarray], np.ndarray], np.ndarray]


class Quantile(NamedTuple):
    """The quantile of a column, interpolated between neighbours; nulls are to be left out before."""

    column: str
    share: float


class Taken:
    """How often draws take the rows of a block: rows at places `pos` of a cell of n."""

    def __init__(self, pos: np.ndarray, n: int, seed: int):
        self.order = np.argsort(pos)
        self.pos, self.n, self.seed = pos[self.order], n, seed
        self.wide = max(1, AT_A_TIME // max(1, len(pos)))  # draws at a time

    def __call__(self, draws: np.ndarray) -> np.ndarray:
        mine = len(self.pos)
        got = np.zeros(len(draws) * mine, np.int64)
        base = np.arange(len(draws))[:, None] * mine
        steps = max(1, AT_A_TIME // len(draws))
        for k in range(0, self.n, steps):
            at = drawn_places(self.seed, draws, np.arange(k, min(self.n, k + steps)), self.n).astype(np.int64)
            place = np.minimum(np.searchsorted(self.pos, at), mine - 1)
            here = self.pos[place] == at
            got += np.bincount((base + self.order[place])[here], minlength=len(got))
        return got.reshape(len(draws), mine)


def _by_draws(placed: DataFrame, cell: list[str], values: tuple[str, ...], block: Column, resamples: int) -> DataFrame:
    """Rows once for each block of draws (_d), with their block of rows (_p) and values _v0, _v1, ..."""
    return placed.select(
        *cell,
        F.col("_n").cast("long"),
        F.col("_pos").cast("long"),
        *[F.col(v).cast("double").alias(f"_v{k}") for k, v in enumerate(values)],
        block.cast("long").alias("_p"),
        F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // DRAW_BLOCK) - 1))).alias("_d"),
    )


def _cell_kind(placed: DataFrame, cell: list[str], more: str) -> StructType:
    return StructType([placed.schema[c] for c in cell] + list(StructType.fromDDL(more)))


def _told(keys, cell: list[str], kind: StructType, columns: list[np.ndarray]) -> pa.Table:
    """A table of the cell's keys and some columns."""
    fields = to_arrow_schema(kind)
    fixed = [pa.array([keys[i].as_py()] * len(columns[0]), fields[i].type) for i in range(len(cell))]
    return pa.Table.from_arrays([*fixed, *map(pa.array, columns)], schema=fields)


def _weighted(placed: DataFrame, cell: list[str], statistic: Weighted, resamples: int, seed: int) -> DataFrame:
    """cell, _draw, _v of a `Weighted` statistic; a task has one cell and one block of draws."""
    tasks = max(1, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = _cell_kind(placed, cell, "_draw long, _v double")
    values = [f"_v{k}" for k in range(len(statistic.columns))]

    def run(keys, table):
        taken = Taken(table["_pos"].to_numpy(), table.num_rows, seed)
        draws = np.arange(keys[-1].as_py() * DRAW_BLOCK, min(resamples, (keys[-1].as_py() + 1) * DRAW_BLOCK))
        rows = [table[v].to_numpy() for v in values]
        parts = [draws[a : a + taken.wide] for a in range(0, len(draws), taken.wide)]
        made = [np.asarray(statistic.of(rows, taken(p)), float) for p in parts]
        return _told(keys, cell, kind, [draws, np.concatenate(made)])

    rows = _by_draws(placed, cell, statistic.columns, F.lit(0), resamples)
    return rows.repartition(tasks, *cell, "_d").groupBy(*cell, "_d").applyInArrow(run, kind)


def weighted_quantile(share: float) -> Callable[[list[np.ndarray], np.ndarray], np.ndarray]:
    """The interpolated quantile of rows that are there as often as their weights say."""

    def of(values, weights):
        order = np.argsort(values[0], kind="stable")
        ends = np.cumsum(weights[:, order], axis=1)
        at = (ends[:, -1] - 1) * share
        low = np.floor(at)
        find = lambda rank: values[0][order][(ends <= rank[:, None]).sum(axis=1)]
        a, b = find(low), find(np.ceil(at))
        return a + (b - a) * (at - low)

    return of


def _quantiles(placed: DataFrame, cell: list[str], statistic: Quantile, resamples: int, seed: int) -> DataFrame:
    """cell, _draw, _v of a quantile for cells of any size: rows in blocks by value; the weight of each block in each draw
    tells which block has the wanted ranks, and that block which values."""
    tasks = max(1, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = placed.withColumnRenamed("_n", "_all")
    ranked = positions(named, cell, statistic.column, "_by").drop("_n").withColumnRenamed("_all", "_n")
    rows = _by_draws(ranked, cell, (statistic.column,), F.floor(F.col("_by") / PLACE_BLOCK), resamples)
    key = [*cell, "_d", "_p"]
    sums = _cell_kind(placed, cell, "_d int, _p long, _draw long, _n long, _weight long")

    def weigh(keys, table):
        n = table["_n"][0].as_py()
        taken = Taken(table["_pos"].to_numpy(), n, seed)
        draws = np.arange(keys[-2].as_py() * DRAW_BLOCK, min(resamples, (keys[-2].as_py() + 1) * DRAW_BLOCK))
        parts = [draws[a : a + taken.wide] for a in range(0, len(draws), taken.wide)]
        weight = np.concatenate([taken(p).sum(axis=1) for p in parts])
        full = lambda x, t: np.full(len(draws), x, t)
        columns = [full(keys[-2].as_py(), np.int32), full(keys[-1].as_py(), np.int64), draws, full(n, np.int64), weight]
        return _told(keys, cell, sums, columns)

    weights = rows.repartition(tasks, *key).groupBy(*key).applyInArrow(weigh, sums)
    before = Window.partitionBy(*cell, "_draw").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    at = (F.col("_n") - 1) * F.lit(float(statistic.share))
    asked = weights.withColumn("_before", F.coalesce(F.sum("_weight").over(before), F.lit(0))).select(
        *key, "_draw", "_before", "_weight", F.posexplode(F.array(F.floor(at), F.ceil(at))).alias("_k", "_rank")
    ).where("_rank >= _before AND _rank < _before + _weight").select(
        *key, "_draw", F.col("_k").cast("long"), (F.col("_rank") - F.col("_before")).alias("_rank")
    )
    found = _cell_kind(placed, cell, "_draw long, _k long, _v double, _n long")

    def pick(keys, table, wanted):
        if not wanted.num_rows:
            return found_none()
        value = table["_v0"].to_numpy()
        order = np.argsort(value, kind="stable")
        taken = Taken(table["_pos"].to_numpy(), table["_n"][0].as_py(), seed)
        draw, rank = wanted["_draw"].to_numpy(), wanted["_rank"].to_numpy()
        out = np.empty(len(draw))
        for a in range(0, len(draw), taken.wide):
            ends = np.cumsum(taken(draw[a : a + taken.wide])[:, order], axis=1)
            out[a : a + taken.wide] = value[order][(ends <= rank[a : a + taken.wide, None]).sum(axis=1)]
        n = np.full(len(draw), table["_n"][0].as_py())
        return _told(keys, cell, found, [draw, wanted["_k"].to_numpy(), out, n])

    def found_none():
        return pa.Table.from_pylist([], schema=to_arrow_schema(found))

    met = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(pick, found)
    ends = met.groupBy(*cell, "_draw").agg(
        F.max("_n").alias("_n"),
        F.max(F.when(F.col("_k") == 0, F.col("_v"))).alias("_a"),
        F.max(F.when(F.col("_k") == 1, F.col("_v"))).alias("_b"),
    )
    return ends.select(*cell, "_draw", (F.col("_a") + (F.col("_b") - F.col("_a")) * (at - F.floor(at))).alias("_v"))


def bootstrap(
    pairs: DataFrame,
    cell: list[str],
    statistic: str | Statistic | Weighted | Quantile | Column,
    order: str = "question_id",
    resamples: int = RESAMPLES,
    seed: int = SEED,
    draws: DataFrame | None = None,
) -> DataFrame:
    """Percentile 95 % interval of a statistic per cell: estimate, ci_low, ci_high, n_questions, resamples, seed.

    All cells and draws in one job. A named statistic, or a function of sums, is summed by blocks of draws (`_summed`);
    a `Quantile` or `Weighted` statistic goes by how often each draw takes each row. Any other aggregate, and draws given
    as index lists (`draws`: n, draw, idx), go as one row a draw and place, met with the values by an equi-join: for cells
    of report size.
    """
    summed = STATISTICS.get(statistic) if isinstance(statistic, str) else statistic
    summed = None if isinstance(statistic, (Column, Weighted, Quantile)) else summed
    placed = positions(pairs, cell, order)
    if isinstance(statistic, (Weighted, Quantile)):
        columns = statistic.columns if isinstance(statistic, Weighted) else (statistic.column,)
        one = placed.agg(F.max("_n")).first()[0] or 0
        if isinstance(statistic, Quantile):
            made = F.percentile(statistic.column, F.lit(statistic.share))
            plain = Weighted(columns, weighted_quantile(statistic.share))
            how = _weighted if one <= PLACE_BLOCK else _quantiles
            drawn = how(placed, cell, plain if how is _weighted else statistic, resamples, seed)
        elif one > PLACE_BLOCK:
            raise ValueError(f"a cell has {one} rows: too many for a weighted statistic")
        else:
            drawn = _weighted(placed, cell, statistic, resamples, seed)
            made = None
    elif summed is not None and draws is None:
        made = aggregate(summed)
        sums = _summed(placed, cell, _columns_of(summed), resamples, seed)
        drawn = sums.select(*cell, "_draw", summed(lambda c: F.col(c), F.col("_n")).alias("_v"))
    else:
        made = statistic if summed is None else aggregate(summed)
        sizes = placed.select(*cell, F.col("_n").cast("int").alias("_n")).distinct()
        if draws is None:
            counts = [r[0] for r in sizes.select("_n").distinct().collect()]
            draws = draws_hashed(pairs.sparkSession, counts, resamples, seed)
        rows = sizes.join(draws, F.col("_n") == F.col("n")).select(
            *cell, F.col("draw").alias("_draw"), F.explode("idx").alias("_pos")
        )
        drawn = rows.join(placed, [*cell, "_pos"]).groupBy(*cell, "_draw").agg(made.alias("_v"))
    ends = drawn.groupBy(*cell).agg(F.percentile("_v", F.array(F.lit(0.025), F.lit(0.975))).alias("_ends")).select(
        *cell, F.col("_ends")[0].alias("ci_low"), F.col("_ends")[1].alias("ci_high")
    )
    if made is None:
        whole = _estimates(placed, cell, statistic)
    else:
        whole = placed.groupBy(*cell).agg(made.alias("estimate"), F.count(F.lit(1)).alias("n_questions"))
    return whole.join(ends, cell).withColumns(
        {"resamples": F.lit(resamples), "seed": F.lit(seed)}
    ).where("estimate IS NOT NULL")


def _estimates(placed: DataFrame, cell: list[str], statistic: Weighted) -> DataFrame:
    """A weighted statistic of each cell as it is: every row once."""
    kind = _cell_kind(placed, cell, "estimate double, n_questions long")

    def run(keys, table):
        rows = [table[c].to_numpy().astype(float) for c in statistic.columns]
        made = np.asarray(statistic.of(rows, np.ones((1, table.num_rows), np.int64)), float)
        return _told(keys, cell, kind, [made, np.array([table.num_rows])])

    return placed.groupBy(*cell).applyInArrow(run, kind)


def mean_interval(values: DataFrame, cell: list[str], **how) -> DataFrame:
    """Interval of the mean of question values in column a; nulls are no values."""
    return bootstrap(values.where("a IS NOT NULL"), cell, "mean", **how)


def ratio_interval(values: DataFrame, cell: list[str], **how) -> DataFrame:
    """Interval of sum a over sum b; draws without a denominator are skipped, cells without one left out."""
    return bootstrap(values, cell, "share", **how)


def family_interaction(
    runs: DataFrame,
    first: str,
    second: str,
    cell: list[str] | None = None,
    family: str = "family",
    question: str = "question_id",
    resamples: int = RESAMPLES,
    seed: int = SEED,
    draws: DataFrame | None = None,
) -> DataFrame:
    """Difference of differences of two judges (columns x, y) over two answer families, questions as clusters.

    Only questions that both families have; a question is drawn with all its runs. `flagged` if the interval leaves 0.
    """
    cell = cell or []
    sums = runs.where(F.col(family).isin(first, second)).groupBy(*cell, question).agg(
        *[
            F.sum(
                F.when(F.col(family) == f, F.col(v))
            ).alias(f"{v}{i}") for i, f in enumerate((first, second)) for v in ("x", "y")
        ],
        *[F.count_if(F.col(family) == f).alias(f"n{i}") for i, f in enumerate((first, second))],
    )
    shared = sums.where("n0 > 0 AND n1 > 0").withColumn("_one", F.lit(1))

    def gaps(total, n):
        by = lambda v: total(f"{v}0") / total("n0") - total(f"{v}1") / total("n1")
        return by("x") - by("y")

    out = bootstrap(shared, [*cell, "_one"], gaps, question, resamples, seed, draws).drop("_one")
    return out.withColumn("flagged", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Score interval of k in n, clamped to [0, 1], four digits; null without cases."""
    share_ = k / F.nullif(n, F.lit(0))
    base = 1 + z * z / F.nullif(n, F.lit(0))
    mid = (share_ + z * z / (2 * n)) / base
    half = z * F.sqrt(share_ * (1 - share_) / n + z * z / (4 * n * n)) / base
    ok = n > 0
    return F.when(
        ok, F.round(F.greatest(F.lit(0.0), mid - half), 4)
    ), F.when(ok, F.round(F.least(F.lit(1.0), mid + half), 4))


def comparison_grid(
    rows: DataFrame,
    pairs: tuple = PAIRS,
    metrics: dict | None = None,
    resamples: int = RESAMPLES,
    seed: int = SEED,
    draws: DataFrame | None = None,
) -> DataFrame:
    """Every cell, pair of arms and metric with its interval and the questions dropped; two bootstrap jobs in all.

    Rows without an interval appear where questions were dropped.
    """
    metrics = metrics or METRICS
    long = rows.select(
        *CELL,
        "arm",
        "question_id",
        F.explode(
            F.map_from_arrays(
                F.array(*map(F.lit, metrics)), F.array(*[F.col(v).cast("double") for v, _ in metrics.values()])
            )
        ).alias("metric", "value"),
    )
    cell = [*CELL, "metric"]
    both = paired_all(long, "value", pairs, cell)
    keys = [*cell, "arm", "baseline"]
    out = None
    for kind in sorted({k for _, k in metrics.values()}):
        part = bootstrap(
            both.where(F.col("metric").isin(*[m for m, (_, k) in metrics.items() if k == kind])),
            keys,
            kind,
            "question_id",
            resamples,
            seed,
            draws,
        )
        out = part if out is None else out.unionByName(part)
    seen = long.select(*cell, "question_id").distinct().withColumn(
        "p", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(b).alias("baseline")) for a, b in pairs]))
    ).select(*cell, "question_id", "p.*")
    gone = seen.join(
        both.select(*keys, "question_id"), [*keys, "question_id"], "left_anti"
    ).groupBy(*keys).agg(F.array_sort(F.collect_set("question_id")).alias("dropped_questions"))
    return out.join(gone, keys, "full")


def single_judge_grid(rows: DataFrame, passes: dict[str, tuple[str, str]], **how) -> DataFrame:
    """The grid once per judge: passes maps a judge to its accuracy and completion columns; one job for all judges."""
    out = None
    for name, (accuracy, completion) in passes.items():
        part = rows.select(
            F.concat_ws("|", "agent", F.lit(name)).alias("agent"),
            "stratum",
            "arm",
            "question_id",
            "total_tokens",
            F.col(accuracy).alias("accuracy"),
            F.col(completion).alias("completion"),
        )
        out = part if out is None else out.unionByName(part)
    grid = comparison_grid(out, **how)
    return grid.withColumn(
        "judge", F.split_part("agent", F.lit("|"), F.lit(-1))
    ).withColumn("agent", F.split_part("agent", F.lit("|"), F.lit(1)))


def completion_rates(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Runs, runs without a verdict, mean completion, timeouts, turn limits, compactions and truncations per cell."""
    keys = keys or [*CELL, "arm"]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("completion").isNull()).alias("unjudged"),
        F.avg("completion").alias("completion_rate"),
        F.count_if(F.col("status") == "timeout").alias("timeouts"),
        F.count_if(F.col("status") == "turn_limit").alias("turn_limits"),
        F.coalesce(F.sum("compactions"), F.lit(0)).alias("compactions"),
        F.coalesce(F.sum("truncations"), F.lit(0)).alias("truncations"),
        F.count_if(F.col("truncations") > 0).alias("runs_with_truncation"),
    )


def pooled(rows: DataFrame, scored: Column, label: str = "all_scored", stratum: str = "stratum") -> DataFrame:
    """Rows and a second copy of the scored ones under one label: controls are in their own cell only."""
    return rows.unionByName(rows.where(scored).withColumn(stratum, F.lit(label)))
