"""Registered intervals of all draws against brute force in plain Python."""

from collections import defaultdict
from functools import cache

import numpy as np
import pytest

import __spark_entry__ as entry
from tallyspark.operators import stats
from tallyspark.plans.registry import QUERIES, event_runs

BASES = ("token_ratio_interval", "accuracy_interval", "timeout_share_interval", "family_interaction")


def plain_hash(x):
    """32-bit mix of one number, in Python's whole numbers."""
    x ^= x >> 16
    x = x * 0x85EBCA6B % 2**32
    x ^= x >> 13
    x = x * 0xC2B2AE35 % 2**32
    return x ^ (x >> 16)


@cache
def hashes(n):
    golden = 0x9E3779B9
    return np.array(
        [
            [plain_hash((start + k * golden) % 2**32) for k in range(n)] for start in (
                plain_hash((stats.SEED * golden + d) % 2**32) for d in range(stats.RESAMPLES)
            )
        ]
    )


def interval(values, statistic):
    """Estimate and ends over (a, b) in order of question, of 10,000 draws."""
    v = np.array(values, float)
    at = hashes(len(v)) % len(v)
    stat = {"ratio": lambda a, b: a.sum(-1) / b.sum(-1), "mean_difference": lambda a, b: (b - a).mean(-1)}[statistic]
    drawn = stat(v[:, 0][at], v[:, 1][at])
    return [float(stat(v[:, 0], v[:, 1])), *np.quantile(drawn, [0.025, 0.975]).tolist()]


def question_pairs(rows, value, question=lambda r: r["question_id"]):
    """(agent, stratum, arm, baseline) -> {question: (mean of the baseline, mean of the arm)}."""
    seen = defaultdict(list)
    for r in rows:
        if r[value] is not None:
            seen[r["agent"], r["stratum"], r["arm"], question(r)].append(float(r[value]))
    means = {k: sum(v) / len(v) for k, v in seen.items()}
    out = defaultdict(dict)
    for arm, base in stats.PAIRS:
        for (agent, stratum, a, q), m in means.items():
            if a == arm and (agent, stratum, base, q) in means:
                out[agent, stratum, arm, base][q] = (means[agent, stratum, base, q], m)
    return out


def test_entry_makes_all_draws(spark, sf_dir):
    want = {
        k: interval([v for _, v in sorted(p.items())], "ratio") for k, p in question_pairs(
            event_runs(spark, sf_dir).collect(), "total_tokens"
        ).items()
    }
    got = {
        (r.agent, r.stratum, r.arm, r.baseline): [r.estimate, r.ci_low, r.ci_high] for r in entry.entry(spark).collect()
    }
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=2e-6)


@pytest.mark.parametrize("name", BASES)
def test_whole_query_makes_the_operators_draws(spark, sf_dir, name, monkeypatch):
    asked, real = [], stats.bootstrap
    monkeypatch.setattr(
        stats,
        "bootstrap",
        lambda *a, **k: (lambda d: asked.extend(d.select("resamples").distinct().collect()) or d)(real(*a, **k)),
    )
    QUERIES[name](spark, sf_dir)
    assert [r.resamples for r in asked] == [stats.RESAMPLES]


@pytest.fixture(scope="module")
def few_events(spark, sf_dir, tmp_path_factory):
    """Events of 24 users, with one user's purchases left out."""
    folder = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.withColumn("user_id", e.user_id % 24).where("NOT (user_id = 7 AND event_type = 'purchase')")
    e.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def grid(rows, columns, judge=()):
    out = {}
    text = lambda r: str(r["question_id"])
    for metric, (value, statistic) in stats.METRICS.items():
        found = question_pairs(rows, columns.get(value, value), text)
        for agent, stratum in {(r["agent"], r["stratum"]) for r in rows}:
            seen = {text(r) for r in rows if (r["agent"], r["stratum"]) == (agent, stratum)}
            for arm, base in stats.PAIRS:
                have = found.get((agent, stratum, arm, base), {})
                ends = interval([v for _, v in sorted(have.items())], statistic) if have else [None] * 3
                out[agent, *judge, stratum, metric, arm, base] = (
                    ends, len(have) or None, ",".join(sorted(seen - set(have))) or None
                )
    return out


@pytest.mark.parametrize("name", ["comparison_grid", "single_judge_grid"])
def test_whole_grids_equal_brute_force(spark, few_events, name):
    rows = event_runs(spark, few_events).collect()
    one = name == "comparison_grid"
    want = grid(rows, {}) if one else grid(rows, {}, ("A",)) | grid(
        rows, {"accuracy": "completion", "completion": "accuracy"}, ("B",)
    )
    keys = ["agent", *([] if one else ["judge"]), "stratum", "metric", "arm", "baseline"]
    got = {
        tuple(r[k] for k in keys): (
            [r.estimate, r.ci_low, r.ci_high], r.n_questions, r.dropped
        ) for r in QUERIES[name](spark, few_events).collect()
    }
    want = {k: v for k, v in want.items() if v[1] or v[2]}
    assert set(got) == set(want) and any(v[2] for v in want.values())
    for k, (ends, n, dropped) in want.items():
        assert got[k][0] == pytest.approx(ends, abs=2e-6) and got[k][1:] == (n, dropped), k


def test_blocks_of_draws_and_places_add_up(spark, monkeypatch):
    monkeypatch.setattr(stats, "PLACE_BLOCK", 7)
    monkeypatch.setattr(stats, "DRAW_BLOCK", 30)
    rng = np.random.default_rng(3)
    pairs = [
        (c, q, float(a), float(b)) for c, n in (
            ("x", 23), ("y", 7), ("z", 1)
        ) for q, (a, b) in enumerate(rng.integers(1, 90, (n, 2)))
    ]
    frame = spark.createDataFrame(pairs, "cell string, question_id int, a double, b double")
    for statistic in ("ratio", "mean_difference"):
        got = {r.cell: [r.estimate, r.ci_low, r.ci_high] for r in stats.bootstrap(frame, ["cell"], statistic).collect()}
        for c in "xyz":
            assert got[c] == pytest.approx(interval([p[2:] for p in pairs if p[0] == c], statistic), abs=1e-9)
    rows = stats.bootstrap(frame, ["cell"], stats.aggregate("ratio")).collect()  # one row a draw and place
    blocks = {r.cell: r.ci_low for r in stats.bootstrap(frame, ["cell"], "ratio").collect()}
    assert {r.cell: r.ci_low for r in rows} == pytest.approx(blocks)


@pytest.mark.parametrize("block", [1 << 21, 5])
def test_quantiles_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(stats, "PLACE_BLOCK", block)
    rng = np.random.default_rng(3)
    cells = {c: rng.integers(0, 9, n).astype(float) for c, n in (("a", 1), ("b", 4), ("c", 23))}
    frame = spark.createDataFrame([(c, i, float(v)) for c, x in cells.items() for i, v in enumerate(x)], "cell string, question_id int, a double")
    for share in (0.5, 0.1):
        got = {
            r.cell: [r.estimate, r.ci_low, r.ci_high, r.n_questions]
            for r in stats.bootstrap(frame, ["cell"], stats.Quantile("a", share), resamples=1500).collect()
        }
        for c, x in cells.items():
            drawn = np.quantile(x[hashes(len(x))[:1500] % len(x)], share, axis=1)
            want = [np.quantile(x, share), *np.quantile(drawn, [0.025, 0.975]), len(x)]
            assert got[c] == pytest.approx(want, abs=1e-9)


def test_any_weighted_statistic(spark, monkeypatch):
    x = np.array([3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0])
    frame = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(x)], "cell string, question_id int, a double")
    spread = stats.Weighted(("a",), lambda v, w: np.where(w > 0, v[0], -np.inf).max(1) - np.where(w > 0, v[0], np.inf).min(1))
    r = stats.bootstrap(frame, ["cell"], spread).first()
    drawn = x[hashes(len(x)) % len(x)]
    want = np.quantile(drawn.max(1) - drawn.min(1), [0.025, 0.975])
    assert [r.estimate, r.ci_low, r.ci_high] == pytest.approx([8.0, *want])
    monkeypatch.setattr(stats, "PLACE_BLOCK", 3)
    with pytest.raises(ValueError, match="too many"):
        stats.bootstrap(frame, ["cell"], spread)


@pytest.mark.parametrize("block", [1 << 21, 100])
def test_positions_without_a_cell_in_one_task(spark, monkeypatch, block):
    monkeypatch.setattr(stats, "PLACE_BLOCK", block)
    rows = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN 'x' WHEN id % 50 = 1 THEN null ELSE 'y' END AS c", "hash(id) AS k")
    got = stats.positions(rows.repartition(5), ["c"], "k").collect()
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r.k):
        want.setdefault(r.c, []).append(r.k)
    assert sorted((str(r.c), r.k, r._pos, r._n) for r in got) == sorted(
        (str(c), k, i, len(ks)) for c, ks in want.items() for i, k in enumerate(ks)
    )


def test_kept_draws_are_made_once(spark, tmp_path):
    home = str(tmp_path / "draws")
    first, made = stats.kept_draws(spark, [3, 5, 3], 40, 7, home)
    assert made == [3, 5] and first.count() == 80
    again, made = stats.kept_draws(spark, [5, 4], 40, 7, home)
    assert made == [4]
    want = {(r.n, r.draw): list(r.idx) for r in stats.draws_hashed(spark, [4, 5], 40, 7).collect()}
    assert {(r.n, r.draw): list(r.idx) for r in again.collect()} == want
    assert stats.kept_draws(spark, [5], 40, 8, home)[1] == [5]
