"""Periodic runs of words, by the method of Kolpakov and Kucherov, and texts without the repeated periods.

A run is a stretch of consecutive words with smallest period q, at least `times` periods and `least` words long, that no
neighbouring word extends. For each whole text:

1. Words become numbers. Every start of GRAM words inside a run has the same GRAM words one period before or after it, so
   a run lies in a stretch of consecutive starts whose GRAM words come up elsewhere in the text; all else is passed over.
   Hashes that meet by chance only make stretches longer. A run of a stretch is a run of the text: a word that extends it
   would lie in the stretch too.
2. A suffix automaton of the stretch, with the first end of each state, gives its Lempel-Ziv factors: the longest pieces
   that occur earlier (also overlapping), or a new word.
3. Main's algorithm finds the runs that touch a factor's start: for each period the common extensions to both sides, from
   two Z arrays over the factor and as much text before it as the factor and twice the one before it are long. The first
   occurrence of every run is found so.
4. Other runs lie strictly inside a factor: they are copies of runs in its earlier occurrence, taken factor by factor.

Of two periods that give one stretch of words the smaller one counts.

Cases: a null, empty or blank text has no words and no runs and collapses to the empty text; a null id is kept; repeated
rows are worked out each; an empty table gives no rows; other columns are ignored. A text is worked out in one row, so
memory follows the longest text, and that of the automaton its longest repetitive stretch.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices

LEAST = 24
TIMES = 3
GRAM = 8

_MIX = np.uint64(0x9E3779B97F4A7C15)


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers 0, 1, ... in order of their first place."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def stretches(w: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Ranges of words outside of which no run lies."""
    gram = min(GRAM, least // 3) if times > 2 else 1
    if len(w) < least:
        return []
    x = (w.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    starts = len(w) - gram + 1
    h = np.zeros(starts, np.uint64)
    for k in range(gram):
        h = h * _MIX + x[k : k + starts]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(starts + 2, np.int8)
    again[1 + order[1:][same]] = 1
    again[1 + order[:-1][same]] = 1
    turn = np.diff(again)
    low, high = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    long = high - low + gram - 1 >= least
    return list(zip(low[long].tolist(), (high[long] + gram - 1).tolist(), strict=True))


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors (start, length, start of the earlier occurrence or -1), from a suffix automaton."""
    step: list[dict[int, int]] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        now = len(step)
        step.append({})
        size.append(i + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[now] = q
            else:
                split = len(step)
                step.append(step[q].copy())
                size.append(size[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = split
                    p = link[p]
                link[q] = link[now] = split
        last = now
    out, begin, n = [], 0, len(w)
    while begin < n:
        state, j = 0, begin
        while j < n:
            follow = step[state][w[j]]
            if first[follow] >= j:  # this is where it comes up for the first time
                break
            state, j = follow, j + 1
        long = j - begin
        out.append((begin, long, first[state] - long + 1) if long else (begin, 1, -1))
        begin += max(1, long)
    return out


def z_array(s: list[int]) -> list[int]:
    """For each place, how many letters from there on equal the beginning."""
    n = len(s)
    z = [0] * n
    low = high = 0
    for i in range(1, n):
        k = 0
        if i < high:
            k = z[i - low]
            if k < high - i:
                z[i] = k
                continue
            k = high - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def touching(w: list[int], low: int, at: int, high: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of stretches of w[low:high] that touch the place `at` and are long enough: Main's algorithm.

    A stretch as long as that has a whole period to the right of the place or to the left of it.
    """
    right, left = w[at:high], w[low:at][::-1]
    r, m = len(right), len(left)
    back = np.array(z_array([*left, -1, *right[::-1], *left]), np.int64)
    ahead = np.array(z_array([*right, -1, *left[::-1], *right]), np.int64)
    out = []
    if r:
        q = np.arange(1, r + 1)
        start = at - back[m + 1 + r - q]
        end = at + q + np.concatenate([ahead[1:r], [0]])
        out.append((start, end, q))
    if m:
        q = np.arange(1, m + 1)
        start = at - q - np.concatenate([back[1:m], [0]])
        end = at + ahead[r + 1 + m - q]
        out.append((start, end, q))
    found = []
    for start, end, q in out:
        fits = end - start >= np.maximum(least, times * q)
        found += zip(start[fits].tolist(), end[fits].tolist(), q[fits].tolist(), strict=True)
    return found


def runs(w: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of a sequence of numbers."""
    n = len(w)
    pieces = factors(w)
    period: dict[tuple[int, int], int] = {}
    bounds = [(0, 0), *((b, b + k) for b, k, _ in pieces), (n, n)]
    for (b0, e0), (b1, e1) in zip(bounds, bounds[1:], strict=False):
        before, after = e0 - b0, e1 - b1
        low = max(0, b1 - 2 * before - after)
        if e1 - low < least:
            continue
        for s, e, q in touching(w, low, b1, e1, least, times):
            if (s and w[s - 1] == w[s - 1 + q]) or (e < n and w[e] == w[e - q]):
                continue  # it goes on: found whole from another place
            if q < period.get((s, e), q + 1):
                period[s, e] = q
    starting: dict[int, list[int]] = {}
    for s, e in period:
        starting.setdefault(s, []).append(e)
    for b, k, earlier in pieces:
        if k < least + 2:
            continue
        shift = b - earlier
        for s in range(earlier + 1, earlier + k):
            for e in starting.get(s, ()):
                if e < earlier + k and (s + shift, e + shift) not in period:
                    period[s + shift, e + shift] = period[s, e]
                    starting.setdefault(s + shift, []).append(e + shift)
    return [(s, e, q) for (s, e), q in period.items()]


def runs_of_words(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of a list of words, by start and period."""
    w = numbered(words)
    out = []
    for low, high in stretches(w, least, times):
        out += [(low + s, low + e, q) for s, e, q in runs(w[low:high].tolist(), least, times)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for s, e, q in found:
        keep[s + q : e] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    times: int = TIMES,
    edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Rows (doc_id, runs by start and period, collapsed text), one for each row of the input.

    `edit` changes the words of a text before they are searched. `least` is 3 at least, `times` 2 or more.
    """
    if least < 3 or times < 2:
        raise ValueError("a run has at least two periods and three words")

    def run(batches):
        for b in slices(batches):
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for low, high in bounded(texts):
                found, left = [], []
                for i in range(low, high):
                    words = (texts[i] or "").encode("utf-8", "replace").split()
                    if edit:
                        words = edit(keys[i], words)
                    got = runs_of_words(words, least, times)
                    found.append([{"start": s, "length": e - s, "period": q} for s, e, q in got])
                    left.append(collapsed(words, got).decode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(low, high - low), pa.array(found, pa.list_(RUN)), pa.array(left, pa.string())],
                    ["doc_id", "runs", "collapsed"],
                )

    kind = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, kind)


def greatest_run(runs: str) -> Column:
    """The run with the greatest length / period, compared exactly; the first one of equals."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    better = lambda x, best: x.length * best.period > best.length * x.period
    return F.aggregate(runs, none, lambda best, x: F.when(best.isNull() | better(x, best), x).otherwise(best))


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's edit: in a tenth of the documents the words from a place on repeat with a period."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def op12_kolpakov_kucherov(spark, sf_dir: str) -> DataFrame:
    """Runs of words of all documents, and digests of the runs and of the collapsed texts."""
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), edit=repeated_tail)
    line = lambda r: F.concat_ws(
        ",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")
    )
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    found = found.withColumn("best", greatest_run("runs"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
