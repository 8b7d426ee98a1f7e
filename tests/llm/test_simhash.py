"""Fingerprints bit by bit, and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from tallyspark.llm import simhash
from tallyspark.llm.common import tokens


def plain_print(text):
    t = tokens(text)
    grams = [b" ".join(t[i : i + 4]) for i in range(len(t) - 3)] if len(t) >= 4 else ([b" ".join(t)] if t else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints, radius=4):
    """prints: (id, fingerprint) with ids told once; the least id reachable."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in prints:
        for j, y in prints:
            if i < j and (x ^ y).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def corpus(seed=3, many=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out, base = [], []
    for i in range(many):
        if i % 8 == 0:
            base = [rng.choice(words) for _ in range(rng.choice([2, 4, 30, 200, 400]))]
        text = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append((i, " ".join(text).title() if i % 5 == 0 else "  ".join(text)))
    return [*out, (many, ""), (many + 1, None), (many + 2, " \t\r\n")]


def test_fingerprint_is_the_majority_of_every_bit():
    texts = [None, "", "one", "Two Words", "a b c", "a b c d", "a\x0bb\x1cc\x85d e", "Ünï ÇÖDÉ 日本 😀 x", *[t for _, t in corpus()]]
    for t in texts:
        assert simhash.fingerprint(t) == plain_print(t)


def test_long_texts_are_counted_in_batches(monkeypatch):
    text = " ".join(str(i % 977) for i in range(5_000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BATCH", 64)
    assert simhash.fingerprint(text) == whole == plain_print(text)


def test_unbroken_word_of_a_megabyte():
    text = "x" * (1 << 20)
    assert simhash.fingerprint(text) == plain_print(text)


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_masks_leave_no_near_pair_apart(blocks):
    rng = random.Random(blocks)
    kept = [m % (1 << 64) for m in simhash.masks(blocks)]
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for m in kept)


def test_a_tree_finds_what_all_distances_find():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 10, 400).astype(np.uint64) * np.uint64(0x0101010101010101)
    shards = np.sort(rng.integers(0, 9, 400))
    forest = simhash.Forest(prints, shards)
    find = lambda before: {
        (int(a), int(b)) for w, m in forest.search(prints, forest.root, before, 4) for a, b in zip(w, m, strict=True)
    }
    want = {
        (i, j)
        for i in range(400)
        for j in range(400)
        if shards[i] == shards[j] and int(prints[i] ^ prints[j]).bit_count() <= 4
    }
    assert find(np.full(400, 400)) == want
    assert find(np.arange(400)) == {(i, j) for i, j in want if j < i}


@pytest.mark.parametrize(("shard", "blocks"), [(2000, None), (3, 5), (2, 6), (1, 5)])
def test_components_equal_all_pairs(spark, shard, blocks):
    docs = corpus()
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(rows, shard=shard, blocks=blocks).collect()}
    prints = [(i, plain_print(t)) for i, t in docs]
    roots = brute(prints)
    assert got == {i: (f"{f:016x}", roots[i]) for i, f in prints}
    assert len(set(roots.values())) < len(docs) - 20


def test_odd_rows(spark, odd, empty):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == odd.count()
    by_id = {i: c for i, _, c in got}
    zero = [i for i, f, _ in got if f == "0" * 16]
    assert {3, 4, 5} <= set(zero) and {by_id[i] for i in (3, 4, 5)} == {3}
    assert all(c is None for i, _, c in got if i is None) and by_id[2] == 1
    assert sum(i == 1 for i, _, _ in got) == 2
    assert simhash.near_duplicates(empty).count() == 0


def test_rows_that_share_an_id_hold_together(spark):
    texts = {1: "alpha beta gamma delta", 2: "one two three four five", 3: "red green blue yellow"}
    rows = [(5, texts[1]), (2, texts[1]), (5, texts[2]), (9, texts[2]), (7, texts[3])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 2), (2, 2), (9, 2), (7, 7)}


def test_the_query_over_the_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    prints = [(i, plain_print(t)) for i, t in docs]
    roots = brute(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op13_bk_trees(spark, sf_dir).collect()}
    assert got == {i: (f"{f:016x}", roots[i]) for i, f in prints}
