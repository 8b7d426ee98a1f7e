"""Sets, bags, rates and changes on small tables."""

from pyspark.sql import functions as F

from tallyspark.operators import sets


def test_sets_with_nulls_and_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(2, 0), (3, 0), (None, 1), (None, 1)], "k int, w int")
    of = lambda df: sorted((r.k for r in df.collect()), key=str)
    assert of(sets.shared(a, b, ["k"])) == [2, None]
    assert of(sets.lacking(a, b, ["k"])) == [1] and of(sets.lacking(b, a, ["k"])) == [3]
    assert of(sets.together(["k"], a, b, a)) == [1, 2, 3, None]
    assert {(r.k, r.only) for r in sets.differences(a, b, ["k"]).collect()} == {(1, "first"), (3, "second")}
    assert sets.covers(a, a.where("v <> 'q'").distinct(), ["k"]) and not sets.covers(a, b, ["k"])
    bag = sets.feeds(a=a, b=b).collect()
    assert len(bag) == 8 and {(r.feed, r.v, r.w) for r in bag if r.k == 2} == {("a", "y", None), ("b", None, 0)}


def test_violations_and_moves(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 200.0), ("b", 1, None), ("a", 3, 150.0), ("b", 2, 9.0)], "k string, o int, v double")
    rules = {"z large": F.col("v") > 100, "a none": F.col("v").isNull(), "m odd": F.col("o") % 2 == 1}
    got = {r.k: r.violations for r in sets.violations(rows, "k", rules).collect()}
    assert got == {"a": ["m odd", "z large"], "b": ["a none", "m odd"]}
    moved = {(r.k, r.o) for r in sets.moved(rows, "k", "o", "v", 50).collect() if r.moved}
    assert moved == {("a", 2)}
    seen = {(r.k, r.first, r.last, r.times) for r in sets.occurrence_order(rows, ["k"], "o").collect()}
    assert seen == {("a", 1, 3, 3), ("b", 1, 2, 2)}


def test_rates_bins_and_histograms(spark):
    rows = spark.createDataFrame(
        [("s", "t", "yes", 1), ("s", "t", "no", 1), ("s", "u", None, 2), (None, "t", "yes", None)], "c string, s string, r string, m int"
    )
    bins = {"yes": F.col("r") == "yes", "no": F.col("r") == "no"}
    got = {(r.category, r.stratum): r for r in sets.rate_rows(rows, "c", "s", bins, F.col("r").isNotNull(), ("m",)).collect()}
    assert set(got) == {("s", "t"), ("s", "u"), ("s", "all"), ("all", "all"), (None, "t"), (None, "all")}
    total = got["all", "all"]
    assert (total.rows, total.yes, total.no, total.yes_rate, total.checkable, total.checkable_share) == (4, 2, 1, 0.5, 3, 0.75)
    assert total.m == {"1": 2, "2": 1} and got[None, "t"].m is None and 0 < total.yes_low < 0.5 < total.yes_high < 1
    counts = {r.category: (r.yes, r.no) for r in sets.bin_counts(rows, "c", bins).collect()}
    assert counts == {"s": (1, 1), None: (1, 0), "all": (2, 1)}
    assert sets.rate_rows(rows.where("false"), "c", "s", bins).count() == 0
