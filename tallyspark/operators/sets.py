"""Sets of keys and bags of rows: what two tables share, lack and hold together; rates and bins per group and in total;
changes between readings.

Keys are compared null-safely, as SQL's set operators do: a null is a key of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import wilson

ALL = "all"


def keys_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys).distinct()


def shared(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both have."""
    return first.select(*keys).intersect(second.select(*keys))


def lacking(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the first that the second lacks."""
    return first.select(*keys).subtract(second.select(*keys))


def together(keys: list[str], *tables: DataFrame) -> DataFrame:
    """Keys that any of the tables has."""
    return reduce(DataFrame.unionByName, (t.select(*keys) for t in tables)).distinct()


def feeds(**tables: DataFrame) -> DataFrame:
    """All rows of several feeds, repeated ones too, with the feed's name; a column that a feed lacks is null."""
    named = [t.withColumn("feed", F.lit(name)) for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def differences(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of the two has, and which: empty if the sets are equal. One shuffle for both directions."""
    marked = first.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        second.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    sides = marked.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).where("_a <> _b")
    return sides.select(*keys, F.when(F.col("_a") == 1, "first").otherwise("second").alias("only"))


def covers(first: DataFrame, second: DataFrame, keys: list[str]) -> bool:
    """Whether two tables have the same set of keys."""
    return not differences(first, second, keys).limit(1).count()


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, violations: the names of the rules that any of the key's rows breaks, sorted and told once; keys that break
    none are left out."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    found = rows.select(key, F.explode(broken).alias("_rule"))
    return found.groupBy(key).agg(F.array_sort(F.collect_set("_rule")).alias("violations"))


def occurrence_order(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, first, last, times: where each key comes up first and last in the order, and how often."""
    return rows.groupBy(*keys).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(order).alias("times"))


def moved(readings: DataFrame, key: str, order: str, value: str, step: float, out: str = "moved") -> DataFrame:
    """Marks readings that differ from the one before of their key by more than a step; the first of a key is none."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return readings.withColumn(out, F.coalesce(F.abs(F.col(value) - before) > step, F.lit(False)))


def _levels(category: str, stratum: str) -> Column:
    """The groups that a row counts in: its category and stratum, its category, all."""
    one, other, every = F.col(category), F.col(stratum), F.lit(ALL)
    pairs = [(0, one, other), (1, one, every), (2, every, every)]
    made = [F.struct(F.lit(k).alias("level"), a.alias("category"), b.alias("stratum")) for k, a, b in pairs]
    return F.explode(F.array(*made)).alias("g")


def rate_rows(
    rows: DataFrame,
    category: str,
    stratum: str,
    bins: dict[str, Column],
    checkable: Column | None = None,
    histograms: tuple[str, ...] = (),
) -> DataFrame:
    """Counts and rates for each category and stratum, each category, and all rows.

    category, stratum (`all` for a total), rows; for each bin its count, rate (four digits) and Wilson interval; the share
    of checkable rows; and a map of counts for each histogram column, nulls left out. A row goes into three groups, whose
    sums are combined before they are shuffled.
    """
    tested = {"checkable": checkable} if checkable is not None else {}
    flat = rows.select(
        _levels(category, stratum),
        *[F.coalesce(c, F.lit(False)).alias(f"_in_{n}") for n, c in (bins | tested).items()],
        *[F.col(h).cast("string").alias(f"_of_{h}") for h in histograms],
    ).select("g.*", "*").drop("g")
    group = ["level", "category", "stratum"]
    counts = flat.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(f"_in_{n}").alias(n) for n in bins | tested]
    )
    rate = lambda n: F.round(F.col(n) / F.col("rows"), 4)
    for n in bins:
        low, high = wilson(F.col(n).cast("double"), F.col("rows").cast("double"))
        counts = counts.withColumns({f"{n}_rate": rate(n), f"{n}_low": low, f"{n}_high": high})
    if tested:
        counts = counts.withColumn("checkable_share", rate("checkable"))
    for h in histograms:
        told = flat.where(F.col(f"_of_{h}").isNotNull()).groupBy(*group, f"_of_{h}").agg(F.count(F.lit(1)).alias("_n"))
        entry = F.array_sort(F.collect_list(F.struct(f"_of_{h}", "_n")))
        maps = told.groupBy(*group).agg(F.map_from_entries(entry).alias(h))
        same = reduce(Column.__and__, [counts[c].eqNullSafe(maps[c]) for c in group])
        counts = counts.join(maps, same, "left").select(*[counts[c] for c in counts.columns], h)
    return counts.drop("level")


def bin_counts(rows: DataFrame, category: str, bins: dict[str, Column]) -> DataFrame:
    """category (`all` for the total) and the count of each bin, for each category and in total."""
    out = rows.rollup(category).agg(
        F.grouping(category).alias("_total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in bins.items()]
    )
    return out.select(F.when(F.col("_total") == 1, ALL).otherwise(F.col(category)).alias("category"), *bins)
