"""Periodic runs against a search of every period, and the query against plain loops."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import periodic


def brute(w, least, times):
    """Every period: the stretches where words that far apart are equal."""
    n, found = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, times * q):
                found.setdefault((s, e), q)  # smaller periods come first
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(rng, letters):
    w = []
    while len(w) < rng.choice([30, 120, 400]):
        piece = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 7, 20, 40]))]
        w += (piece * rng.choice([1, 1, 3, 4, 12]))[: rng.choice([20, 60, 200])]
        if rng.random() < 0.3 and len(w) > 40:
            at = rng.randrange(len(w) - 30)
            w += w[at : at + rng.choice([10, 30, 90])]
    return w


@pytest.mark.parametrize("seed", range(60))
@pytest.mark.parametrize(("least", "times"), [(24, 3), (3, 2), (12, 3), (5, 4)])
def test_runs_equal_the_search_of_every_period(seed, least, times):
    rng = random.Random(seed * 31 + least)
    w = planted(rng, rng.choice([2, 3, 50]))
    assert periodic.runs_of_words([b"%d" % x for x in w], least, times) == brute(w, least, times)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.sampled_from([(3, 2), (3, 3), (6, 3), (24, 3)]))
def test_runs_of_short_alphabets(w, bounds):
    assert periodic.runs_of_words([b"%d" % x for x in w], *bounds) == brute(w, *bounds)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_factors_are_the_longest_that_came_before(w):
    at = 0
    for begin, long, earlier in periodic.factors(w):
        assert begin == at
        longest = max(
            (k for j in range(begin) for k in range(1, len(w) - begin + 1) if w[j : j + k] == w[begin : begin + k]), default=0
        )
        assert (long, earlier) == (1, -1) if not longest else long == longest and w[earlier : earlier + long] == w[begin : begin + long]
        assert earlier < begin
        at += long
    assert at == len(w)


def plain(doc_id, text):
    """The contract, word by word."""
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words, 24, 3)
    dropped = {i for s, e, q in found for i in range(s + q, e)}
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    s, e, q = best or (None, None, None)
    numbers = (s, e - s, q, 1000 * (e - s) // q) if best else (None,) * 4
    kept = b" ".join(x for i, x in enumerate(words) if i not in dropped)
    return (len(found), *numbers, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_the_query_over_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = rows_of(periodic.op12_kolpakov_kucherov(spark, sf_dir))
    assert got == sorted(((r.doc_id, *plain(r.doc_id, r.text)) for r in docs), key=str)
    assert sum(r[1] > 0 for r in got) > len(got) // 30


def test_odd_rows(spark, odd, empty, tmp_path):
    rows = [r.asDict() for r in odd.collect()]
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(periodic.op12_kolpakov_kucherov(spark, str(tmp_path)))
    assert got == sorted(((r["doc_id"], *plain(r["doc_id"], r["text"])) for r in rows), key=str)
    assert periodic.periodic_runs(empty).count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    assert (3, 0, None, None, None, None, nothing, nothing) in got


def test_long_texts():
    unit = [b"w%d" % i for i in range(4_000)]
    words = [b"head", *unit * 40, b"tail"]
    assert periodic.runs_of_words(words) == [(1, 160_001, 4_000)]
    assert periodic.runs_of_words([b"x" * (1 << 20)] * 30) == [(0, 30, 1)]
    assert periodic.runs_of_words([b"x" * (1 << 20)]) == []
    assert periodic.runs_of_words([b"%d" % i for i in range(200_000)]) == []
