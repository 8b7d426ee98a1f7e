"""Hard negatives against all products."""

import math
import random

import duckdb
import numpy as np
import pytest

from tallyspark.llm import negatives
from tallyspark.llm.queries import SQL

KIND = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every=50, positives=5, wanted=3, low=50, high=95):
    """rows: (id, vector, label) that may be unfit; ids told once."""
    fit = {
        i: (label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)
    }
    out = set()
    for a, (la, va) in fit.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(va, v, strict=False)) for i, (_, v) in fit.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if fit[i][0] == la][:positives]:
            band = [i for i in order if fit[i][0] != la and low * score[p] <= 100 * score[i] <= high * score[p]]
            out |= {(a, p, k, n, score[p], score[n]) for k, n in enumerate(band[:wanted], 1)}
    return out


def table(seed=1, many=400, width=12, labels=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(many):
        c = rng.choice(centres)
        v = [float(np.float32((x + rng.gauss(0, 0.4)) / 4)) for x in c]
        rows.append((i, v, rng.randrange(labels)))
    for i in range(0, many, 9):  # ties
        rows[i] = (i, rows[0][1], rows[i][2])
    return rows


def result(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(("sample", "chunk", "block"), [(4096, 4096, 512), (40, 16, 3), (1, 7, 1)])
def test_equal_to_all_products(spark, monkeypatch, sample, chunk, block):
    for name, value in (("SAMPLE", sample), ("CHUNK", chunk), ("BLOCK", block)):
        monkeypatch.setattr(negatives, name, value)
    rows = table()
    got = result(negatives.hard_negatives(spark.createDataFrame(rows, KIND).repartition(3)))
    assert got == brute(rows) and len(got) > 50


def test_other_bounds(spark):
    rows = table(7, 250, 5, 2)
    made = negatives.hard_negatives(spark.createDataFrame(rows, KIND), positives=2, negatives=4, low=10, high=100)
    assert result(made) == brute(rows, positives=2, wanted=4, low=10, high=100)


def test_unfit_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = table(3, 220, 6)
    rows += [(None, rows[1][1], 1), (1000, None, 1), (1050, rows[1][1], None), (1100, [nan] * 6, 1), (1150, [inf] * 6, 1),
             (1200, [None] * 6, 1), (1250, [], 1), (1300, rows[2][1][:3], 2), (1350, [0.0] * 6, 0), (-50, rows[4][1], 2)]
    plain = spark.createDataFrame(rows, KIND)
    extra = plain.selectExpr("*", "'x' as q", "1 as low", "2 as score", "vec_id as id").repartition(2)
    padded = [(i, v + [0.0] * (6 - len(v)) if v is not None else v, k) for i, v, k in rows]
    assert result(negatives.hard_negatives(extra)) == brute(padded)
    # repeated rows count once; of rows that share an id the first by label and numbers stands
    again = extra.unionByName(extra).unionByName(extra.where("vec_id = 7").withColumn("label", extra.label + 90))
    assert result(negatives.hard_negatives(again)) == brute(padded)


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], KIND)
    assert negatives.hard_negatives(none).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 0)], KIND)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(0, [], 1), (50, [], 1), (3, [], 0)], KIND)).count() == 6 // 3


def test_large_components_are_exact_or_stop(spark):
    rows = [(i, [float(1 << 17) + i, -3.5 * i, 1.25], i % 2) for i in range(120)]
    got = result(negatives.hard_negatives(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")))
    assert got == brute(rows)
    with pytest.raises(ValueError, match="too large"):
        negatives.hard_negatives(spark.createDataFrame([(0, [1e30], 1)], "vec_id bigint, embedding array<double>, label int"))


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(2)
    for width in (1, 2, 17, 64):
        q = rng.integers(-400, 400, (90, width)) * (rng.random((90, width)) < 0.5)
        turn = negatives.Rotation(q[:30], width)
        rows = negatives.Rows(np.arange(90), np.zeros(90, np.int64), q, turn)
        exact = q @ q.T
        low = np.percentile(exact, 80, axis=1).astype(np.int64)
        high = np.percentile(exact, 95, axis=1).astype(np.int64)
        i, j, s = negatives.survivors(rows, rows, turn, np.ones((90, 90), bool), low, high)
        assert (s == exact[i, j]).all()
        want = {(a, b) for a in range(90) for b in range(90) if low[a] <= exact[a, b] <= high[a]}
        assert want <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_the_query_over_the_tables(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.sql(SQL["op11_pca_negatives"])
    names = want.columns
    got = result(negatives.op11_pca_negatives(spark, sf_dir).select(*names))
    assert got == {tuple(map(int, r)) for r in want.fetchall()} and got
