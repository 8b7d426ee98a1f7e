"""Statistics against published and hand-made values."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import stats


def percentile(values, q):
    values = sorted(values)
    at = (len(values) - 1) * q
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


PAIRS = [(100.0, 50.0), (200.0, 80.0), (150.0, 100.0), (90.0, 60.0), (300.0, 120.0)]


def test_seeded_bootstrap_equals_plain_python(spark):
    rows = spark.createDataFrame(
        [("c", i, a, b) for i, (a, b) in enumerate(PAIRS)], "cell string, question_id int, a double, b double"
    )
    draws = stats.draws_seeded(spark, [5], 2000)
    got = stats.bootstrap(rows, ["cell"], "ratio", resamples=2000, draws=draws).first()
    rng = random.Random(8105)
    values = []
    for _ in range(2000):
        s = [PAIRS[rng.randrange(5)] for _ in range(5)]
        values.append(sum(a for a, _ in s) / sum(b for _, b in s))
    assert got.estimate == pytest.approx(840 / 410)
    assert got.ci_low == pytest.approx(
        percentile(values, 0.025)
    ) and got.ci_high == pytest.approx(percentile(values, 0.975))
    assert got.n_questions == 5 and got.seed == 8105


RUNS = [
    ("x", "s", "web", "A", 100.0, 1.0),
    ("x", "s", "web", "A", 120.0, 1.0),
    ("x", "s", "archive", "A", 50.0, 0.5),
    ("x", "s", "web", "B", 200.0, None),
    ("x", "s", "archive", "B", 80.0, 0.0),
    ("x", "s", "web", "D", 10.0, 1.0),
]


def frame(spark):
    return spark.createDataFrame(
        RUNS, "agent string, stratum string, arm string, question_id string, total_tokens double, accuracy double"
    ).withColumn("completion", F.lit(1.0))


def test_pairing_and_dropped(spark):
    rows = frame(spark)
    pairs = stats.paired(stats.question_means(rows, "total_tokens"), "archive", "web")
    assert {r.question_id: (r.a, r.b) for r in pairs.collect()} == {"A": (110.0, 50.0), "B": (200.0, 80.0)}
    assert stats.dropped(rows, pairs).first().dropped_questions == ["D"]
    assert pairs.agg(stats.token_ratio().alias("r")).first().r == pytest.approx(310 / 130)


def test_all_pairs_equal_single_pairs(spark):
    rows = frame(spark)
    means = stats.question_means(rows, "total_tokens")
    for arm, base in stats.PAIRS:
        one = {(r.question_id, r.a, r.b) for r in stats.paired(means, arm, base).collect()}
        assert one == {
            (r.question_id, r.a, r.b) for r in stats.paired_all(rows, "total_tokens").where(
                (F.col("arm") == arm) & (F.col("baseline") == base)
            ).collect()
        }


def test_ratio_over_nothing_is_infinite(spark):
    rows = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert rows.agg(stats.token_ratio().alias("r")).first().r == float("inf")


def test_ratio_interval_skips_empty_draws(spark):
    rows = spark.createDataFrame(
        [("c", 0, 1.0, 2.0), ("c", 1, 0.0, 0.0), ("e", 0, 0.0, 0.0)], "cell string, question_id int, a double, b double"
    )
    got = stats.ratio_interval(rows, ["cell"], resamples=200).collect()
    assert [(r.cell, r.estimate, r.ci_low, r.ci_high) for r in got] == [("c", 0.5, 0.5, 0.5)]


@pytest.mark.parametrize(
    "k, n, low, high",
    [
        (0, 10, 0.0, 0.2775),
        (5, 10, 0.2366, 0.7634),
        (0, 0, None, None),
        (274, 400, 0.6379, 0.7286),
        (14, 400, 0.021, 0.0579),
    ],
)
def test_wilson(spark, k, n, low, high):
    a, b = stats.wilson(F.lit(float(k)), F.lit(float(n)))
    r = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (r.a, r.b) == (low, high)


def test_grid(spark):
    got = stats.comparison_grid(frame(spark), resamples=50)
    rows = {(r.metric, r.arm, r.baseline): r for r in got.collect()}
    r = rows["token_ratio_baseline_over_arm", "archive", "web"]
    assert r.estimate == pytest.approx(310 / 130) and r.dropped_questions == ["D"]
    assert rows["accuracy_diff_arm_minus_baseline", "archive", "web"].dropped_questions == ["B", "D"]
    assert rows["token_ratio_baseline_over_arm", "both", "web"].estimate is None


def test_family_interaction(spark):
    rows = spark.createDataFrame(
        [
            ("p", "q1", 1.0, 0.5),
            ("r", "q1", 0.0, 0.5),
            ("p", "q2", 1.0, 1.0),
            ("r", "q2", 1.0, 0.0),
            ("p", "q3", 1.0, 0.0),
        ],
        "family string, question_id string, x double, y double",
    )
    got = stats.family_interaction(rows, "p", "r", resamples=50).first()
    assert got.estimate == pytest.approx((1.0 - 0.5) - (0.75 - 0.25)) and got.n_questions == 2


def test_pooled_leaves_controls_out(spark):
    rows = spark.createDataFrame([("s",), ("control",)], "stratum string")
    assert sorted(
        r.stratum for r in stats.pooled(rows, F.col("stratum") != "control").collect()
    ) == ["all_scored", "control", "s"]
