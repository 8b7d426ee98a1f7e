"""Toxicity of whole texts: gradient-boosted trees over dense features, with isotonic calibration.

Features: density, count and variety of words of a lexicon (plain, and weighted by their log odds), lexicon words near
second-person words, capitals, punctuation, digits, symbols, obfuscated words, and length. The lexicon, the trees and
the calibration are learnt from a bounded sample of labelled rows: the FIT_ROWS first by a hash of the id. The lexicon
are words that stand in clearly more toxic than other documents of the sample. Words are counted and features made where
the texts are: what reaches the driver are lexicons of LEXICON words and the sample's features. Scoring is one pass over
the corpus.

The score is the isotonic fit of the labels on margins of rows that the trees and their lexicon had not seen (three
folds), with straight lines between the centres of its steps.

Words are compared without case, accents of look-alike characters (0 for o, @ for a, ...), inner separators and
repeated letters, so `1d10t`, `i.d.i.o.t` and `idiooot` meet `idiot`.

Cases: null and empty texts have all features 0 and get the score of such a text; without labels of both kinds every
score is the share of toxic labels (0 if none); repeated rows get equal scores; a null doc_id is kept and counts as not
held out; labels that contradict each other for one id are each used; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, slices, stash

FIT_ROWS = 6000
LEXICON = 500
FOLDS = 3
#: Least summed second derivative on either side of a split.
LEAST_HESSIAN = 2.0
#: Look-alike characters, and second-person words of the languages at hand.
LOOKALIKES = str.maketrans(
    {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e", "|": "l"}
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
NEAR = 4
EDGES = ".,;:!?\"'()[]{}<>*#%&$-_|/\\+=~`“”„‘’«»…"
NAMES = (
    "hits_per_word",
    "hits",
    "kinds",
    "weight",
    "weight_per_word",
    "weight_max",
    "near_you",
    "you_per_word",
    "capitals",
    "shouting",
    "punctuation",
    "bangs",
    "digits",
    "symbols",
    "disguised_per_word",
    "disguised_hits",
    "log_words",
    "word_length",
)
KEPT_WORDS = 300_000


def bare(word: str) -> tuple[str, bool]:
    """The form of a lower-cased word that the lexicon holds, and whether it had to be undisguised for that."""
    core = word.strip(EDGES)
    if core.isalpha():
        plain = core
    else:
        plain = core.translate(LOOKALIKES)
        plain = "".join(c for c in plain if c.isalpha())
        if not any(c.isalpha() for c in core):
            plain = ""
    short = plain
    for c in set(plain):  # runs of three and more of a letter shrink to one
        while c * 3 in short:
            short = short.replace(c * 3, c)
    return short, short != core and bool(short)


class Words(dict):
    """What a word counts for: (lexicon weight, second person, disguised)."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str):
        if len(self) >= KEPT_WORDS:
            self.clear()
        form, hidden = bare(word)
        got = self[word] = (self.lexicon.get(form, 0.0), form in SECOND_PERSON, hidden)
        return got


_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*@^~|<>[]{}=+_/\\`"]] = True


def features(text: str | None, words: Words) -> list[float]:
    """The NAMES of a whole text."""
    if not text:
        return [0.0] * len(NAMES)
    found = text.lower().split()
    n = max(1, len(found))
    got = [words[w] for w in found]
    hits = [i for i, g in enumerate(got) if g[0]]
    hidden = sum(g[2] for g in got)
    you = [i for i, g in enumerate(got) if g[1]]
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = max(1, int(counts.sum()))
    weights = [got[i][0] for i in hits]
    near = 0
    if hits and you:
        spots = np.array(you)
        at = np.searchsorted(spots, hits)
        near = sum(
            min(
                abs(spots[min(k, len(spots) - 1)] - i), abs(spots[max(k - 1, 0)] - i)
            ) <= NEAR for i, k in zip(hits, at, strict=True)
        )
    upper = int(counts[_UPPER].sum())
    letters = max(1, upper + int(counts[97:123].sum()))
    return [
        len(hits) / n, float(len(hits)), float(
            len({found[i] for i in hits})
        ), float(sum(weights)), sum(weights) / n, max(weights, default=0.0),
        near / n, len(you) / n, upper / letters, float(upper / letters > 0.5), counts[_PUNCT].sum() / size, counts[33] / size,
        counts[_DIGIT].sum() / size, counts[_SYMBOL].sum() / size, hidden / n, float(
            sum(got[i][2] for i in hits)
        ), float(np.log1p(len(found))), size / n,
    ]


def kinds_of(text: str | None) -> set[str]:
    """The forms of a text's words."""
    return {bare(w)[0] for w in set((text or "").lower().split())} - {""}


def count_forms(sample: DataFrame) -> DataFrame:
    """form, and in how many toxic and other documents of each fold it stands: t0, n0, t1, n1, ..."""

    def run(batches):
        for b in slices(batches, 64):
            found = [sorted(kinds_of(x)) for x in b.column(0).to_pylist()]
            owner = np.repeat(np.arange(b.num_rows), [len(x) for x in found])
            columns = [
                pa.array([f for x in found for f in x], pa.string()),
                *(b.column(k).take(pa.array(owner)) for k in (1, 2)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["form", "y", "fold"])

    rows = sample.select("t", "y", "fold").mapInArrow(run, "form string, y int, fold int")
    in_ = lambda k, y: F.count_if((F.col("fold") == k) & (F.col("y") == y))
    return rows.groupBy("form").agg(*[in_(k, y).alias(f"{'nt'[y]}{k}") for k in range(FOLDS) for y in (1, 0)])


def learn_lexicon(
    forms: DataFrame, sizes: dict[int, tuple[int, int]], without: int | None, least: int = 4, most: int = LEXICON
) -> dict[str, float]:
    """Words with much greater odds in toxic documents of all folds but one; the smoothed log odds are their weights.

    `sizes` is (documents, toxic ones) by fold. A word must stand in 1.5 % of the toxic documents, so that a family of
    copies with a wrong label teaches nothing.
    """
    folds = [k for k in range(FOLDS) if k != without]
    toxic = max(1, sum(sizes.get(k, (0, 0))[1] for k in folds))
    other = max(1, sum(sizes.get(k, (0, 0))[0] - sizes.get(k, (0, 0))[1] for k in folds))
    least = max(least, int(np.ceil(0.015 * toxic)))
    inside, outside = (sum((F.col(f"{c}{k}") for k in folds[1:]), F.col(f"{c}{folds[0]}")) for c in "tn")
    odds = F.log((inside + 0.5) / (toxic + 1)) - F.log((outside + 0.5) / (other + 1))
    z = odds / F.sqrt(1 / (inside + 0.5) + 1 / (outside + 0.5))
    rows = forms.where((inside >= least) & (F.length("form") > 2)).select("form", odds.alias("odds"), z.alias("z"))
    top = rows.where("odds > 1.2 AND z > 3").orderBy(F.col("z").desc(), "form").limit(most)
    return {r.form: r.odds for r in top.collect()}


class BoostedTrees:
    """Boosted regression trees of fixed depth on binned features, logistic loss, second-order gains."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 48, ridge: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        self.cuts = [
            np.unique(np.quantile(c[c != 0] if np.any(c != 0) else c, np.linspace(0, 1, self.bins - 1))) for c in x.T
        ]
        b = self._bin(x)
        n, k = x.shape
        p0 = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start = float(np.log(p0 / (1 - p0)))
        f = np.full(n, self.start)
        wide = self.bins + 1
        flat = b + np.arange(k) * wide
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            wide_g, wide_h = np.repeat(g, k), np.repeat(h, k)
            size = 2**self.depth - 1
            feature, cut, value = np.zeros(size, int), np.full(size, wide), np.zeros(2 ** (self.depth + 1) - 1)
            node = np.zeros(n, int)
            for level in range(self.depth):
                low, many = 2**level - 1, 2**level
                at = ((node - low)[:, None] * (k * wide) + flat).ravel()
                gs, hs = (
                    np.bincount(at, x, many * k * wide).reshape(many, k, wide).cumsum(axis=2) for x in (wide_g, wide_h)
                )
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < LEAST_HESSIAN) | (ht - hs < LEAST_HESSIAN)] = 0
                gain[np.bincount(node - low, minlength=many) < 20] = 0
                best = gain.reshape(many, -1).argmax(axis=1)
                some = np.flatnonzero(gain.reshape(many, -1)[np.arange(many), best] > 1e-6)
                feature[low + some], cut[low + some] = best[some] // wide, best[some] % wide
                node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
            leaves = np.bincount(node, g, len(value)), np.bincount(node, h, len(value))
            value[size:] = self.rate * leaves[0][size:] / (leaves[1][size:] + self.ridge)
            f += value[node]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        at, f = np.arange(len(x)), np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[at, feature[node]] > cut[node])
            f += value[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: steps (least x, greatest x, centre, value) of the non-decreasing least-squares fit."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, least x, greatest x, sum of x
    for v, t in zip(x[order], y[order], strict=True):
        if blocks and blocks[-1][3] == v:  # ties share a block
            last = blocks[-1]
            last[0], last[1], last[4] = last[0] + t, last[1] + 1, last[4] + v
        else:
            blocks.append([float(t), 1.0, float(v), float(v), float(v)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, _, high, total = blocks.pop()
            last = blocks[-1]
            last[0], last[1], last[3], last[4] = last[0] + s, last[1] + c, high, last[4] + total
    return np.array([(low, high, total / c, s / c) for s, c, low, high, total in blocks])


class ToxicityModel:
    """Lexicon, trees and calibration."""

    def __init__(
        self,
        share: float,
        lexicon: dict[str, float] | None = None,
        trees: BoostedTrees | None = None,
        steps: np.ndarray | None = None,
    ):
        self.share, self.lexicon, self.trees, self.steps = share, lexicon or {}, trees, steps

    @classmethod
    def fitted(
        cls, lexicons: list[dict[str, float]], tables: np.ndarray, y: np.ndarray, fold: np.ndarray
    ) -> ToxicityModel:
        """`lexicons` without each fold and of all rows; `tables` the features under each of them: (row, lexicon, name)."""
        unseen = np.zeros(len(y))
        for k in range(FOLDS):
            rest = fold != k
            if 0 < y[rest].sum() < rest.sum():
                unseen[~rest] = BoostedTrees().fit(tables[rest, k], y[rest]).margin(tables[~rest, k])
        return cls(float(y.mean()), lexicons[-1], BoostedTrees().fit(tables[:, -1], y), isotonic(unseen, y))

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(margin, self.steps[:, 2], self.steps[:, 3]), 0.0, 1.0)

    def score(self, texts: list[str | None], words: Words | None = None) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        words = Words(self.lexicon) if words is None else words
        if not texts:
            return np.zeros(0)
        return self.calibrated(self.trees.margin(np.array([features(x, words) for x in texts], float)))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> ToxicityModel:
    """Fit on the first `fit_rows` labelled rows by hash of id."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")
    ).distinct()
    chosen = known.orderBy(F.xxhash64("i"), "i", "y").limit(fit_rows)
    found = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen), "i")
    once = found.groupBy(F.xxhash64("i", "t", "y").alias("h")).agg(
        F.min("t").alias("t"), F.min("y").alias("y")
    ).orderBy("h").limit(2 * fit_rows)
    parts = min(64, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    folded = once.withColumn("fold", F.pmod("h", F.lit(FOLDS)).cast("int")).repartition(parts, "h")
    sample = stash(folded, "toxicity-sample")
    sizes = {
        r.fold: (r.n, r.y) for r in sample.groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")
        ).collect()
    }
    n, toxic = sum(a for a, _ in sizes.values()), sum(b for _, b in sizes.values())
    if n < 10 or not 0 < toxic < n:
        return ToxicityModel(toxic / n if n else 0.0)
    forms = stash(count_forms(sample), "toxicity-forms")
    lexicons = [learn_lexicon(forms, sizes, k) for k in (*range(FOLDS), None)]

    def run(batches):
        words = [Words(x) for x in lexicons]
        for b in slices(batches):
            rows = [np.array([features(x, w) for w in words]).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(rows, pa.binary())], ["h", "y", "fold", "x"]
            )

    rows = sorted(
        sample.select("h", "t", "y", "fold").mapInArrow(run, "h long, y int, fold int, x binary").collect(),
        key=lambda r: r.h,
    )
    tables = np.stack([np.frombuffer(bytes(r.x)).reshape(FOLDS + 1, len(NAMES)) for r in rows])
    return ToxicityModel.fitted(
        lexicons, tables, np.array([r.y for r in rows], float), np.array([r.fold for r in rows])
    )


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Adds score and predicted to all columns of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept: dict[str, Words] = {}

    def run(texts: pd.Series) -> pd.Series:
        got = sent.value
        words = kept.setdefault("words", Words(got.lexicon))
        return pd.Series(got.score([None if pd.isna(x) else x for x in texts], words), dtype=float)

    clash = [c for c in ("score", "predicted") if c in docs.columns]
    return docs.drop(*clash).withColumn(
        "score", F.pandas_udf(run, "double")(F.col(text))
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_boosted_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score all documents; labels of rows whose crc32(doc_id) mod 5 is 0 are never read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~remainder("doc_id", 5, 0))
    model = fit_toxicity(docs, labels)
    out = score_toxicity(docs, model)
    return out.select("doc_id", remainder("doc_id", 5, 0).alias("held_out"), "score", "predicted")
