"""Published intervals, from the published tables they come from: seeded draws, 10,000 of them.

Fixed values: tokens of the web, archive and both arms by question, and estimate, low and high end of each ratio.
"""

import pytest

from tallyspark.operators import stats

CONTAMINATION = {
    "CN02": (18475, 18643, 20457),
    "CN03": (47267, 44733, 24001),
    "CN04": (41320, 22521, 24346),
    "CN05": (124538, 23520, 25463),
    "CN10": (21239, 21352, 20756),
    "CN11": (49314, 21731, 23258),
    "CN15": (281768, 22434, 24386),
    "CN16": (149100, 22064, 23819),
}
MULTI_PERIOD = {
    "MP01": (260959, 133324, 260243),
    "MP02": (410570, 162446, 239410),
    "MP03": (290921, 231171, 373940),
    "MP04": (174804, 147068, 165911),
    "MP05": (583132, 286923, 277475),
    "MP06": (142616, 203965, 266661),
    "MP07": (234009, 178175, 331896),
    "MP08": (154085, 159075, 178877),
    "MP09": (166610, 161338, 145363),
    "MP10": (124494, 180333, 99578),
    "MP11": (326305, 258095, 303488),
    "MP12": (141114, 169943, 176475),
    "MP13": (139409, 197182, 165326),
    "MP14": (124082, 189559, 148361),
    "MP15": (104213, 110905, 140200),
}
PAIRS = {("archive", "web"): (0, 1), ("both", "web"): (0, 2), ("both", "archive"): (1, 2)}
WANT = [
    (CONTAMINATION, ("archive", "web"), (3.721, 1.6174, 6.7129)),
    (CONTAMINATION, ("both", "web"), (3.9307, 1.855, 6.5127)),
    (CONTAMINATION, ("both", "archive"), (1.0564, 0.9219, 1.3017)),
    (MULTI_PERIOD, ("archive", "web"), (1.2195, 0.9488, 1.5082)),
    (MULTI_PERIOD, ("both", "web"), (1.0318, 0.8218, 1.2923)),
]


def test_seeded_intervals_equal_the_published_ones(spark):
    rows = []
    for k, (tokens, pair, _) in enumerate(WANT):
        base, arm = PAIRS[pair]
        rows += [(k, q, float(v[base]), float(v[arm])) for q, v in tokens.items()]
    frame = spark.createDataFrame(rows, "cell int, question_id string, a double, b double")
    draws = stats.draws_seeded(spark, [len(CONTAMINATION), len(MULTI_PERIOD)])
    got = {r.cell: r for r in stats.bootstrap(frame, ["cell"], "ratio", draws=draws).collect()}
    for k, (tokens, _, want) in enumerate(WANT):
        r = got[k]
        assert (r.n_questions, r.resamples, r.seed) == (len(tokens), 10_000, 8105)
        assert [round(x, 4) for x in (r.estimate, r.ci_low, r.ci_high)] == pytest.approx(want, abs=1.01e-4)


@pytest.mark.parametrize(
    "k, n, low, high",
    [(274, 400, 63.8, 72.9), (14, 400, 2.1, 5.8), (14, 288, 2.9, 8.0), (10, 400, 1.4, 4.5), (10, 286, 1.9, 6.3)],
)
def test_score_intervals_equal_the_published_ones(spark, k, n, low, high):
    from pyspark.sql import functions as F

    a, b = stats.wilson(F.lit(float(k)), F.lit(float(n)))
    r = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (round(100 * r.a, 1), round(100 * r.b, 1)) == (low, high)
