"""Lattice likelihood, language and toxicity."""

import itertools
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import langid, lm_score, toxicity
from tallyspark.llm.segments import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")


def segmentations(text, index):
    """Every way to cut a text into pieces, as lists of piece numbers."""
    for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, len(text)), r) for r in range(len(text))):
        parts = [text[a:b] for a, b in itertools.pairwise([0, *cuts, len(text)])]
        if all(p in index for p in parts):
            yield [index[p] for p in parts]


def test_lattice_sums_all_segmentations():
    trie = lm_score.pieces(PATH)
    logs = np.log(trie.prior)
    index = {x: i for i, x in enumerate(trie.names)}
    for word in (b"the", b"ing", b"q", "né".encode(), b"xyzzy"):
        total = sum(math.exp(sum(logs[k] for k in parts)) for parts in segmentations(b" " + word, index))
        assert lm_score.lattice([b" " + word], trie, logs)[0] == pytest.approx(math.log(total), rel=1e-5)


def test_expected_uses_add_up():
    trie = lm_score.pieces(PATH)
    expected = np.zeros(len(trie.names))
    lm_score.lattice([b" the", b" cat", b" thethe"], trie, np.log(trie.prior), np.array([1.0, 2.0, 1.0]), expected)
    sizes = np.array([len(x) for x in trie.names])
    assert (expected * sizes).sum() == pytest.approx(4 + 2 * 4 + 7, rel=1e-4)  # every byte is in one piece


def test_long_words_are_rows_of_small_lattices(monkeypatch):
    trie = lm_score.pieces(PATH)
    logs = np.log(trie.prior)
    monkeypatch.setattr(lm_score, "CHUNK", 7)
    word = b"understandings"
    assert lm_score.chunks(word) == [b" unders", b"tanding", b"s"]
    parts = sum(lm_score.lattice([c], trie, logs)[0] for c in lm_score.chunks(word))
    assert lm_score.spell([b"a", word, b"bc"], trie, logs)[1] == pytest.approx(parts, rel=1e-6)
    expected = np.zeros(len(trie.names))
    lm_score.spell([word], trie, logs, expected)
    assert expected[trie.first].sum() == pytest.approx(1 / 3)  # a word counts once, its chunks by equal shares


def test_memory_does_not_grow_with_a_word():
    trie = lm_score.pieces(PATH)
    logs, rng, peaks = np.log(trie.prior), np.random.default_rng(0), []
    for size in (200_000, 1_600_000):
        word = rng.integers(97, 123, size).astype(np.uint8).tobytes()
        tracemalloc.start()
        assert np.isfinite(lm_score.spell([word], trie, logs)[0])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + 10 * size


def test_probabilities_of_all_words_add_up_to_one():
    ranks = {b" ": 9, b" a": 0, b" ba": 2, b"a": 1, b"b": 3, b"ab": 0, b"bba": 5}
    trie = lm_score.Pieces(ranks)
    stop = 0.4
    logs = np.log(np.where(trie.first, trie.prior, trie.prior * (1 - stop)))
    total, by_length = 0.0, []
    for n in range(0, 15):
        words = [bytes(w) for w in itertools.product(b"ab", repeat=n)]
        total += float(np.exp(lm_score.spell(words, trie, logs) + math.log(stop)).sum())
        by_length.append(total)
    assert by_length == sorted(by_length) and 0.95 < total <= 1 + 1e-6


def plain_model(texts, train, rounds=2, prior=500.0):
    """The model by enumeration: probability of each text in log10."""
    trie = lm_score.pieces(PATH)
    index = {x: i for i, x in enumerate(trie.names)}
    split = lambda x: (x or "").encode().lower().split()
    counts = Counter(w for x, t in zip(texts, train, strict=True) if t for w in split(x))
    ends = sum(train)
    cuts = {w: list(segmentations(b" " + w, index)) for x in texts for w in split(x)}
    weight, stop = trie.prior.copy(), 0.25
    for _ in range(rounds):
        uses = np.zeros(len(weight))
        for w in counts:
            paths = [math.prod(weight[k] for k in p) for p in cuts[w]]
            for p, v in zip(cuts[w], paths, strict=True):
                for k in p:
                    uses[k] += v / sum(paths)
        uses += trie.prior * np.where(trie.first, prior, 3 * prior)
        words = len(counts) + prior
        further = uses[~trie.first].sum() + words
        weight, stop = np.where(trie.first, uses / uses[trie.first].sum(), uses / further), words / further
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    cut = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    new, end = max(cut * len(counts), 0.5), max(ends, 0.5)
    mass = sum(counts.values()) - cut * len(counts) + new + end

    def word(w):
        spelled = sum(math.prod(weight[k] for k in p) for p in cuts[w]) * stop
        return (counts[w] - cut if counts[w] else 0) / mass + new / mass * spelled

    return [math.log10(end / mass) + sum(math.log10(word(w)) for w in split(x)) for x in texts]


def test_whole_documents_equal_enumeration(spark):
    texts = ["the cat sat", "the dog sat on the cat", "a new dog", "", None, "zzq Cat", "the the the xyzzy"]
    train = [True, True, True, True, False, False, False]
    rows = spark.createDataFrame(
        [(i, x, t) for i, (x, t) in enumerate(zip(texts, train, strict=True))], "doc_id int, text string, t boolean"
    )
    got = {r.doc_id: r.score for r in lm_score.score_documents(rows, "t").collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(plain_model(texts, train), rel=1e-4)


def test_gibberish_scores_far_below_text(spark):
    rng = np.random.default_rng(1)
    lines = ["the quick brown fox jumps over the lazy dog near the river bank today"] * 30
    junk = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(14))
    rows = spark.createDataFrame(
        [(i, x, True) for i, x in enumerate(lines)] + [(100, lines[0], False), (101, junk, False)],
        "doc_id int, text string, t boolean",
    )
    got = {r.doc_id: r.score / r.n_tokens for r in lm_score.score_documents(rows, "t").collect()}
    assert got[101] < got[100] - 5


def test_counts_and_base_match_plain_python(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    split = lambda x: [*(x or "").encode().lower().split(), b""]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = Counter(w for i, x in docs.items() if not held[i] for w in split(x))
    n, v = sum(counts.values()), len(counts)
    rows = lm_score.op1_lattice_lm(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = split(docs[r.doc_id])
        assert r.held_out == held[r.doc_id] and r.train_tokens == n and r.n_tokens == len(t) and r.n_known == sum(counts[w] > 0 for w in t)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r.score < 0
    per_token = lambda held_out: sum(r.score for r in rows if r.held_out == held_out) / sum(
        r.n_tokens for r in rows if r.held_out == held_out
    )
    assert per_token(True) < per_token(False)  # what it learnt from is likelier


def test_score_odd_rows(odd, empty):
    rows = lm_score.score_documents(odd.withColumn("_t", F.lit(True)), "_t").collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) for r in rows)
    blank = [r for r in rows if r.doc_id in (3, 4, 5)]
    assert [r.n_tokens for r in blank] == [1, 1, 1]
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1 and sum(r.doc_id is None for r in rows) == 6
    assert lm_score.score_documents(empty.withColumn("_t", F.lit(True)), "_t").count() == 0
    none = lm_score.score_documents(odd.withColumn("_t", F.lit(False)), "_t").first()
    assert none.train_tokens == 0 and math.isfinite(none.score)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = langid.ByteGRU(["a", "b", "c"], 3)
    x = rng.integers(0, 257, (6, 4)).astype(np.int16)
    y = np.array([0, 1, 2, 1])
    for w in (*model.fwd.values(), *model.bwd.values(), model.out):
        w *= 0.7
    _, grads = model.step(x, y)
    for name, w in model.weights().items():
        flat = np.argsort(-np.abs(grads[name]).ravel())[:3]
        for k in flat:
            at = np.unravel_index(k, w.shape)
            old, e = w[at], 1e-2
            w[at] = old + e
            up = model.step(x, y)[0]
            w[at] = old - e
            down = model.step(x, y)[0]
            w[at] = old
            assert grads[name][at] == pytest.approx((up - down) / (2 * e), rel=0.08, abs=2e-4), name


def naive_language(model, text):
    """Mean over all bytes of the class distribution, position by position and unit by unit."""
    hard = lambda v: min(1.0, max(0.0, 0.25 * v + 0.5))
    raw, total, n, size = text.encode(), np.zeros(len(model.classes)), 0, langid.HIDDEN

    def states(w, window):
        h, out = [0.0] * size, []
        for byte in window:
            u = [sum(float(w["u"][k, j]) * h[j] for j in range(size)) for k in range(3 * size)]
            x = [float(w["x"][k, byte]) for k in range(3 * size)]
            z, r = ([hard(x[o + k] + u[o + k]) for k in range(size)] for o in (0, size))
            c = [math.tanh(x[2 * size + k] + r[k] * u[2 * size + k]) for k in range(size)]
            h = [z[k] * h[k] + (1 - z[k]) * c[k] for k in range(size)]
            out.append(h)
        return out

    for at in range(0, len(raw), langid.WINDOW):
        real = raw[at : at + langid.WINDOW]
        window = [*real, *[256] * (langid.WINDOW - len(real))]
        f, b = states(model.fwd, window), states(model.bwd, window[::-1])[::-1]
        for t in range(len(real)):
            y = np.array(
                [
                    float(
                        model.out[k] @ np.array([*f[t], *b[t]])
                    ) + float(model.bias[k, 0]) for k in range(len(model.classes))
                ]
            )
            p = np.exp(y - y.max())
            total += p / p.sum()
            n += 1
    return total / n


def test_forward_pass_and_pooling_equal_plain_loops():
    model = langid.ByteGRU(["a", "b", "c"], 5)
    texts = ["short", "a longer text of more than one window of bytes, " * 6, "é日本"]
    _, score, probs = langid.label_texts(model, model.classes, texts)
    for k, x in enumerate(texts):
        assert probs[k] == pytest.approx(
            naive_language(model, x), abs=1e-4
        ) and score[k] == pytest.approx(probs[k].max())


def test_the_fit_sees_whole_texts_in_turn(monkeypatch):
    texts = ["".join(map(str, range(k, k + 700))) for k in range(3)] + ["abc" * 900]
    windows, owner = langid.windows_of(texts)
    seen = []

    def step(self, x, label):
        seen.extend(w.astype(np.int16).tobytes() for w in x.T)
        return 0.0, {k: np.zeros_like(v) for k, v in self.weights().items()}

    monkeypatch.setattr(langid.ByteGRU, "step", step)
    langid.ByteGRU(["a", "b"]).fit(windows, np.array([0, 0, 0, 1])[owner], rounds=12, batch=6)
    assert {w.tobytes() for w in windows} == set(seen) and len(seen) == 12 * 6


def test_long_texts_are_labelled_whole():
    model = langid.ByteGRU(["a", "b"], 3)
    tail = "zyx " * 100_000
    _, _, probs = langid.label_texts(model, model.classes, ["abc " * 64, "abc " * 64 + tail, tail, "x" * (1 << 20)])
    n, m = 256, len(tail)
    assert probs[1] == pytest.approx((probs[0] * n + probs[2] * m) / (n + m), abs=1e-4) and len(probs) == 4


def test_windows_hold_whole_texts():
    rows, owner = langid.windows_of(["a" * (2 * langid.WINDOW + 2), "", "é"])
    assert list(owner) == [0, 0, 0, 2] and int((rows < 256).sum()) == 2 * langid.WINDOW + 4


def test_language_held_out(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = langid.op3_byte_gru(spark, sf_dir).collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(odd, empty):
    docs = odd.withColumn("_learn", F.lit(True))
    model, classes = langid.fit_language(docs, "_learn")
    assert model is None and classes == ["en"]
    got = langid.identify(odd, model, classes)
    rows = {(r.doc_id, r.text): r for r in got.collect()}
    assert got.columns.count("score") == 1 and all(
        rows[k].lang_pred == "und" and rows[k].score == 0 for k in ((3, None), (4, ""), (9, "12345 !!! ???"))
    )
    two = langid.ByteGRU(["a", "b"])
    assert {r.lang_pred for r in langid.identify(odd, two, ["a", "b"]).collect()} <= {"a", "b", "und"}
    assert langid.fit_language(empty.withColumn("_learn", F.lit(True)), "_learn") == (None, [])
    assert langid.identify(empty, None, []).count() == 0


def test_bare_forms():
    assert toxicity.bare("1d10t!!") == ("idiot", True) and toxicity.bare("i.d.i.o.t") == ("idiot", True)
    assert toxicity.bare("idiooooot")[0] == "idiot" and toxicity.bare("clown,") == ("clown", False) and toxicity.bare("123")[0] == ""


def test_isotonic_is_least_squares():
    x = np.array([1.0, 2, 3, 4, 4, 5])
    y = np.array([0.0, 1, 0, 1, 0, 1])
    steps = toxicity.isotonic(x, y)
    got = [next(v for low, high, _, v in steps if low <= q <= high) for q in x]
    assert got == pytest.approx([0.0, 0.5, 0.5, 0.5, 0.5, 1.0])
    model = toxicity.ToxicityModel(0.5, steps=steps)
    line = model.calibrated(np.linspace(0, 6, 50))
    assert np.all(np.diff(line) >= 0) and model.calibrated(steps[:, 2]) == pytest.approx(steps[:, 3])


def test_margins_equal_a_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.random((300, 4))
    model = toxicity.BoostedTrees(20).fit(x, (x[:, 0] + x[:, 3] > 1).astype(float))
    for row, margin in zip(x[:40], model.margin(x[:40]), strict=True):
        total = model.start
        for feature, cut, value in model.trees:
            node = 0
            while node < len(feature):
                held = int((model.cuts[feature[node]] <= row[feature[node]]).sum())
                node = 2 * node + (2 if held > cut[node] else 1)
            total += value[node]
        assert margin == pytest.approx(total)


def test_features_equal_plain_counts():
    words = toxicity.Words({"idiot": 2.0, "scum": 1.5})
    text = "YOU are an 1d10t, scum! Plain words here and here and here: i.d.i.o.t; your 3 cats"
    got = dict(zip(toxicity.NAMES, toxicity.features(text, words), strict=True))
    found = text.lower().split()
    hits, you = [3, 4, 12], [0, 13]
    assert [toxicity.bare(found[i])[0] for i in hits] == ["idiot", "scum", "idiot"]
    assert got["hits"] == 3 and got["kinds"] == 3 and got["weight"] == 5.5 and got["weight_max"] == 2.0 and got["hits_per_word"] == 3 / len(found)
    assert got["near_you"] == sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in hits) / len(found)
    assert got["you_per_word"] == 2 / len(found) and got["disguised_hits"] == 2 and got["digits"] == sum(
        c.isdigit() for c in text
    ) / len(text)
    letters = sum(c.isalpha() for c in text)
    assert got["capitals"] == sum(c.isupper() for c in text) / letters and got["bangs"] == text.count("!") / len(text)
    assert got["punctuation"] == sum(
        c in ".,;:!?'\"()-" for c in text
    ) / len(text) and got["log_words"] == pytest.approx(math.log1p(len(found)))


def labelled(spark):
    rows = [
        (i, f"you {w} there now", 1) for i, w in enumerate(["idiot"] * 16)
    ] + [(100 + i, "a calm and friendly day", 0) for i in range(60)]
    rows = [(i, f"{t} number w{i}", y) for i, t, y in rows]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")


def test_lexicon_equals_plain_counts(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    y = {r.doc_id: r.toxic for r in labels.collect()}
    inside, outside = (Counter(w for i, t in texts.items() if y[i] == k for w in toxicity.kinds_of(t)) for k in (1, 0))
    want = {}
    for w, k in inside.items():
        odds = math.log((k + 0.5) / 17) - math.log((outside[w] + 0.5) / 61)
        if k >= 4 and len(w) > 2 and odds > 1.2 and odds / math.sqrt(1 / (k + 0.5) + 1 / (outside[w] + 0.5)) > 3:
            want[w] = odds
    assert "idiot" in want and model.lexicon == pytest.approx(want)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = toxicity.BoostedTrees(60).fit(x, y)
    assert ((m.margin(x) > 0) == (y > 0)).mean() > 0.95


def test_toxic_documents_are_found(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in toxicity.op7_boosted_toxicity(spark, big).collect()}
    texts = {r.doc_id: r.text.lower() for r in spark.read.parquet(f"{big}/documents.parquet").collect()}
    planted = {
        i for i, t in texts.items() if sum(t.count(w) for w in ("idiot", "moron", "scum", "pathetic", "clown")) >= 2
    }
    assert planted and sum(rows[i].predicted for i in planted) / len(planted) > 0.9
    plain = [
        i for i, t in texts.items() if not any(
            w in t for w in (
                "idiot", "moron", "scum", "pathetic", "clown", "loser", "stupid", "trash", "worthless", "disgust"
            )
        )
    ]
    assert sum(rows[i].predicted for i in plain) / len(plain) < 0.01


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(odd, labels)
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    made = toxicity.fit_toxicity(*labelled(spark))
    rows = toxicity.score_toxicity(odd, made).collect()
    assert made.trees and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.score_toxicity(empty, made).count() == 0
    assert toxicity.fit_toxicity(empty, labels).share == 0.0


def naive_trees(model, x, y):
    """Margins of trees whose splits are found by trying every feature and cut on the rows of each node."""
    start = math.log(y.mean() / (1 - y.mean()))
    f = np.full(len(x), start)
    bins = model._bin(x)
    for _ in range(model.rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)

        def grow(rows, level):
            best = (1e-6, None, None)
            if level < model.depth and len(rows) >= 20:
                score = lambda r: g[r].sum() ** 2 / (h[r].sum() + model.ridge)
                for j in range(x.shape[1]):
                    for c in range(model.bins + 1):
                        a, b = rows[bins[rows, j] <= c], rows[bins[rows, j] > c]
                        if h[a].sum() >= toxicity.LEAST_HESSIAN and h[b].sum() >= toxicity.LEAST_HESSIAN:
                            gain = score(a) + score(b) - score(rows)
                            if gain > best[0] + 1e-9:
                                best = (gain, a, b)
            if best[1] is None:
                f[rows] += model.rate * g[rows].sum() / (h[rows].sum() + model.ridge)
                return
            grow(best[1], level + 1)
            grow(best[2], level + 1)

        before = f.copy()
        grow(np.arange(len(x)), 0)
        assert not np.array_equal(before, f)
    return f


def test_splits_are_those_of_a_search_over_all():
    rng = np.random.default_rng(8)
    x = np.round(rng.random((260, 4)), 2)
    y = ((x[:, 0] + rng.normal(0, 0.2, 260) > 0.6) | (x[:, 2] > 0.9)).astype(float)
    model = toxicity.BoostedTrees(rounds=4, depth=2, bins=12)
    model.fit(x, y)
    assert model.margin(x) == pytest.approx(naive_trees(model, x, y), abs=1e-9)
