"""Near duplicates and benchmark passages against brute force."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tallyspark.llm import common, decontam, jaccard
from tallyspark.llm.common import components, tokens


def shingle_set(text):
    t = tokens(text)
    return {tuple(t[i : i + 5]) for i in range(len(t) - 4)} if len(t) >= 5 else ({tuple(t)} if t else set())


def brute(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(seed=0, many=70):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs, base = [], None
    for i in range(many):
        if i % 7 == 0:
            base = [rng.choice(words) for _ in range(rng.choice([3, 4, 5, 12, 60, 120]))]
        text = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            text[rng.randrange(len(text))] = rng.choice(words)
        docs.append((i, " ".join(text) + rng.choice(["", " ", "\n"])))
    return docs


@pytest.mark.parametrize("part", [1000, 3, 1])
def test_components_equal_brute_force(spark, part):
    docs = family()
    got = {
        r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(
            spark.createDataFrame(docs, "doc_id bigint, text string"), part=part
        ).collect()
    }
    assert got == brute(docs)


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {
        r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op5_jaccard_rtree(spark, sf_dir).collect()
    } == brute(docs)


def test_odd_rows(odd, empty):
    rows = jaccard.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].component_id == 1 and by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and by[3].component_id == 3
    assert by[6].n_shingles == 1 and by[None].component_id is None and by[None].n_shingles == 1 and by[10].n_shingles == 1
    assert jaccard.near_duplicates(empty).count() == 0


def test_rows_that_share_an_id_belong_together(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = spark.createDataFrame([(5, a), (5, b), (3, b), (9, a)], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(rows).collect()} == {(5, 3), (3, 3), (9, 3)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), min_size=1, max_size=40), min_size=2, max_size=60))
def test_tree_bound_loses_no_link(raw):
    sets = [np.unique(jaccard._scramble(np.array(sorted(set(x)), np.uint64))) for x in raw]
    points = jaccard.count_vectors(sets)
    tree = jaccard.CountVectorTree(points, np.array([len(s) for s in sets]))
    for i, s in enumerate(sets):
        found = set(tree.search(points[i], len(s), 80).tolist())
        assert {j for j, t in enumerate(sets) if jaccard.links(s, t, 80)} <= found


@pytest.mark.parametrize("hot", [3, 1])
def test_hot_shingles_lose_no_link(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    docs = family(seed=hot, many=90)
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    loads = jaccard.shingle_loads(rows, 5)
    assert jaccard.sketches(rows, loads, 5, 80).where("size(hot) > 0").count()
    # workers are processes of their own: the setting travels with the function that reads it
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(rows).collect()} == brute(docs)


def test_shares_of_a_shingle_are_tied_where_they_touch(spark):
    rng = random.Random(2)
    sizes = sorted(rng.sample(range(1, 400), 60))
    rows = spark.createDataFrame(
        [(n, i, [7], [4]) for i, n in enumerate(sizes)], "n bigint, f1 bigint, hot array<bigint>, shares array<bigint>"
    ).withColumn("prefix", F.array().cast("array<bigint>"))
    got = {r.id: r.root for r in components(jaccard.ties(rows, 80)).collect()}
    want, head = {}, 0
    for i, n in enumerate(sizes):
        head = i if i == 0 or 100 * sizes[i - 1] < 80 * n else head
        want[i] = head
    assert {i: got.get(i, i) for i in want} == want


def test_hubs_meet_their_least_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 2)
    edges = [(0, k) for k in range(1, 150)] + [(k, 500 + k) for k in range(1, 150, 7)] + [(900, 901), (901, 902)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{x: 0 for e in edges[:-2] for x in e}, 900: 900, 901: 900, 902: 900}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a bigint, b bigint")
    got = {r.id: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def plain_contamination(docs, items):
    """(doc, item) by scoring every item against each of its windows: no index, no bounds, no other item's windows."""
    read = [(i, decontam.forms(t or ""), t) for i, t in items]
    read = [x for x in read if x[1]]
    df = Counter(w for _, words, _ in read for w in set(words))
    mean = sum(len(w) for _, w, _ in read) / max(1, len(read))
    out = set()
    for i, words, text in read:
        m, tf = len(words), Counter(words)
        idf = {w: math.log(1 + (len(read) - df[w] + 0.5) / (df[w] + 0.5)) for w in tf}
        weight = {w: idf[w] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * m / mean)) for w, n in tf.items()}
        step = 4
        while step < m:
            step *= 2
        step = step * 5 // 4
        asked, told = decontam.split_item(text)
        k = min(5, len(asked))
        shingles = {tuple(asked[j : j + k]) for j in range(len(asked) - k + 1)} if k else set()
        for d, doc in docs:
            w = decontam.forms(doc or "")
            for at in range(0, max(1, len(w)), step):
                window = w[at : at + 2 * step]
                if (at and len(window) <= step) or (d, i) in out:
                    continue
                here = set(window)
                if sum(x for v, x in weight.items() if v in here) < (0.6 - 1e-9) * sum(weight.values()):
                    continue
                found = decontam.nearly(words, window)
                for s in range(max(1, len(window) - 2 * m + 1)):
                    part = window[s : s + 2 * m]
                    grams = {tuple(part[j : j + k]) for j in range(len(part) - k + 1)} if k else set()
                    if len(set(told) & set(part)) >= 0.8 * len(set(told)):
                        found |= len(shingles & grams) >= 0.8 * len(shingles) or decontam.nearly(asked, part)
                if found:
                    out.add((d, i))
    return out


def test_whole_table_equals_plain_scoring(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in decontam.op10_blockmax_wand(spark, sf_dir).collect()}
    assert got and got == plain_contamination(docs, items)


ITEMS = [
    (1, "What is the tallest mountain on the whole earth today? It is Mount Everest in Nepal."),
    (2, "Name the river that flows through the old city of Cairo. The river is the Nile."),
    (3, ""),
    (4, "short"),
    (5, "What is the tallest mountain on the whole earth today? It is Mount Everest in Nepal."),
]


def filler(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "the", "of", "gamma", "delta", "is", "what"]) for _ in range(n))


def test_passages_are_found(spark):
    q = ITEMS[0][1]
    docs = [
        (10, filler(1, 90) + " " + q + " " + filler(2, 70)),
        (11, filler(3, 200)),
        (12, q.upper().replace(" ", "&&& ")),
        (13, " ".join(q.split()[:8])),
        (14, filler(4, 33) + " " + ITEMS[1][1]),
    ]
    rows = decontam.contaminated(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(ITEMS, "item_id bigint, text string"),
    ).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(10, 1), (10, 5), (12, 1), (12, 5), (14, 2)}


def test_every_cut_of_a_passage_is_found():
    index = decontam.ItemIndex(ITEMS[:2])
    lookup = decontam.Lookup(index.terms)
    texts = [filler(n, n) + " " + ITEMS[0][1] + " " + filler(n + 1, 150 - n) for n in range(0, 150, 7)]
    assert {x[0] for x in decontam.find_items(index, texts, lookup)} == set(range(len(texts)))


@pytest.mark.parametrize("least, postings", [(0.05, 2_000_000), (0.15, 1), (0.3, 50)])
def test_wand_equals_full_scores(spark, sf_dir, monkeypatch, least, postings):
    monkeypatch.setattr(decontam, "POSTINGS", postings)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    index = decontam.ItemIndex(items)
    texts = [
        decontam.forms(r.text)[:120] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()
    ]
    asked = [np.unique([index.terms[w] for w in x if w in index.terms]).astype(np.int64) for x in texts]
    window, term = np.repeat(np.arange(len(asked)), list(map(len, asked))), np.concatenate(asked)
    found = {}
    for w, b in index.survivors(window, term, len(asked), least).tolist():
        found.setdefault(w, set()).update(i for i, _ in index.search(asked[w], b, least))
    for w, t in enumerate(asked):
        full = np.zeros(len(index.ids))
        for k in t:
            part = slice(index.starts[k], index.starts[k + 1])
            full[index.items[part]] += index.weights[part]
        assert found.get(w, set()) == set(np.flatnonzero(full >= least).tolist())


def test_memory_of_bounds_follows_the_postings():
    rng = np.random.default_rng(9)
    words = np.array([f"w{k}" for k in range(6000)])
    index = decontam.ItemIndex([(k, " ".join(rng.choice(words, 20))) for k in range(8000)])
    texts = [" ".join(rng.choice(words, 20_000)) for _ in range(2)]
    lookup = decontam.Lookup(index.terms)
    tracemalloc.start()
    assert decontam.find_items(index, texts, lookup) == []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400_000_000


def test_whole_table_finds_all_exact_copies(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    form = lambda x: " " + " ".join(decontam.forms(x)) + " "
    items = {r.item_id: form(r.text) for r in spark.read.parquet(f"{big}/benchmark.parquet").collect()}
    want = {
        (r.doc_id, i) for r in spark.read.parquet(
            f"{big}/documents.parquet"
        ).collect() for i, t in items.items() if t in form(r.text)
    }
    got = {(r.doc_id, r.item_id) for r in decontam.op10_blockmax_wand(spark, big).collect()}
    assert want and want <= got


def test_passes_over_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontam, "CHUNK_BYTES", 100)
    docs = spark.createDataFrame([(1, ITEMS[0][1]), (2, ITEMS[1][1]), (3, "x")], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()} == {(1, 1), (1, 5), (2, 2)}
    assert [r.doc_id for r in decontam.without_items(docs, items).collect()] == [3]


def test_decontamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([*ITEMS, (None, None), (6, "12345")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(odd, items).collect()} == {(9, 6)}
    kept = decontam.without_items(odd, items.where("item_id = 1"))
    assert kept.count() == odd.count() and kept.columns == odd.columns
    assert decontam.contaminated(empty, items).count() == 0
    assert decontam.contaminated(odd, items.where("item_id = -1")).count() == 0


def test_one_id_in_two_parts_joins_them(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (7, a + " x"), (8, b + " y"), (9, b + " y")]
    got = {
        r.doc_id: r.component_id for r in jaccard.near_duplicates(
            spark.createDataFrame(rows, "doc_id bigint, text string")
        ).collect()
    }
    assert got == {5: 5, 7: 5, 8: 5, 9: 5}


def test_copies_edited_in_one_word_are_found():
    index = decontam.ItemIndex(ITEMS[:2])
    lookup = decontam.Lookup(index.terms)
    edits = []
    for _, t in ITEMS[:2]:
        w = t.split()
        for k in range(len(w)):
            end = "." if w[k][-1] in ".?" else ""
            edits += [[*w[:k], "zebra" + end, *w[k + 1 :]], [*w[:k], *w[k + 1 :]], [*w[:k], "zebra", *w[k:]]]
    texts = [filler(1, 40) + " " + " ".join(e) + " " + filler(2, 30) for e in edits]
    assert {x[0] for x in decontam.find_items(index, texts, lookup)} == set(range(len(texts)))
    clean = [filler(3, 200), " ".join(ITEMS[0][1].split()[:8]), " ".join(reversed(ITEMS[0][1].split()))]
    assert decontam.find_items(index, clean, lookup) == []


def test_scores_do_not_depend_on_the_passes(spark, monkeypatch):
    items = spark.createDataFrame(
        [*ITEMS, *[(10 + k, filler(k, 12) + f". Answer word{k} here.") for k in range(20)]],
        "item_id bigint, text string",
    )
    docs = spark.createDataFrame(
        [(1, ITEMS[0][1]), (2, ITEMS[1][1].replace("Cairo", "Kairo")), (3, filler(7, 12) + ". Answer word7 here.")],
        "doc_id bigint, text string",
    )
    rows = lambda: {
        (r.doc_id, r.item_id): round(r.score, 12) for r in decontam.contaminated(docs, items).collect()
    }
    want = rows()
    monkeypatch.setattr(decontam, "CHUNK_BYTES", 2000)
    assert {1, 2, 3} == {d for d, _ in want} and rows() == want


def mixed_items(seed=5):
    """Items of 8 to 2,000 words."""
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(30_000)]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    sizes = [8, 9, 12, 17, 33, 60, 64, 65, 128, 129, 300, 513, 2000]
    return [(k, f"{pick(n - max(2, n // 5))}? {pick(max(2, n // 5))}.") for k, n in enumerate(sizes)]


def mixed_docs(items, seed=6):
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(30_000)]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = []
    for i, text in items:
        question, answer = text.split("? ")
        part = text.split()
        part[len(part) // 3] = "zebra"
        tail = answer.rstrip(".").split()
        rng.shuffle(tail)
        n = len(part)
        docs += [
            (10 * i, f"{pick(50)} {text} {pick(70)}"),
            (10 * i + 1, f"{pick(31)} {' '.join(part)} {pick(3)}"),
            (10 * i + 2, f"{question} {pick(3 * n + 9)} {' '.join(tail)}"),  # the answer's words far away
            (10 * i + 3, f"{question} {pick(n // 5)} {' '.join(tail)} {pick(2 * n)}"),
            (10 * i + 4, f"{pick(n)} {question}"),
        ]
    return docs


@pytest.mark.parametrize(("chunk", "spread"), [(8_000_000, 4), (8_000_000, 40), (3_000, 4), (300, 2), (3_000, 40)])
def test_results_do_not_depend_on_what_shares_an_index(spark, monkeypatch, chunk, spread):
    items = mixed_items()
    docs = mixed_docs(items)
    monkeypatch.setattr(decontam, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(decontam, "SPREAD", spread)
    found = decontam.contaminated(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4),
        spark.createDataFrame(items, "item_id bigint, text string"),
    ).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(got) == len(found) and got == plain_contamination(docs, items)
    for i, _ in items:
        assert {(10 * i, i), (10 * i + 1, i), (10 * i + 3, i)} <= got
        assert (10 * i + 2, i) not in got and (10 * i + 4, i) not in got
    if chunk == 8_000_000 and spread == 4:
        test_results_do_not_depend_on_what_shares_an_index.scores = {tuple(r) for r in found}
    else:
        want = test_results_do_not_depend_on_what_shares_an_index.scores
        assert {tuple(round(x, 9) for x in r) for r in found} == {tuple(round(x, 9) for x in r) for r in want}


def test_a_long_item_does_not_widen_a_short_one():
    far = (1, "one two three four five six seven eight? nine ten.")
    text = "one two three four five six seven eight " + "filler " * 60 + "ten nine"
    long = (2, " ".join(f"w{k}" for k in range(400)) + "? yes.")
    for items in ([far], [far, long]):
        index = decontam.ItemIndex(items, 2, 200.0, Counter(w for _, t in [far, long] for w in set(decontam.forms(t))))
        assert decontam.find_items(index, [text], decontam.Lookup(index.terms)) == []


def test_long_passages():
    item = mixed_items()[4]
    index = decontam.ItemIndex([item])
    lookup = decontam.Lookup(index.terms)
    texts = ["y" * (1 << 20), "word " * 250_000 + item[1], None, item[1] + " " + "z" * (1 << 20)]
    assert [x[0] for x in decontam.find_items(index, texts, lookup)] == [1, 3]


def test_shared_passages_chain_no_texts(spark, monkeypatch):
    passages = [" ".join(f"p{i}w{k}" for k in range(12)) for i in range(61)]
    docs = [(i, f"{passages[i]} {passages[i + 1]}") for i in range(60)] + [(60, f"{passages[7]} {passages[8]}\n")]
    rows, tied = spark.createDataFrame(docs, "doc_id bigint, text string"), []
    plan = jaccard._tasks
    monkeypatch.setattr(jaccard, "_tasks", lambda parts, *rest: tied.append(parts.count()) or plan(parts, *rest))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(rows).collect()}
    assert got == brute(docs) and tied == [0]


@given(st.lists(st.integers(0, 900), max_size=700, unique=True), st.integers(0, 400), st.integers(0, 900))
@settings(max_examples=100, deadline=None)
def test_group_counts_lose_no_link(raw, cut, more):
    a, b = (
        np.unique(jaccard._scramble(np.array(sorted(x), np.uint64))) for x in (set(raw), set(raw[cut:]) | set(range(more)))
    )
    assert jaccard.apart(*(jaccard.group_counts(x).tobytes() for x in (a, b))) <= len(np.setxor1d(a, b))
