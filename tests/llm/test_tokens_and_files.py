"""Packing, shards, token files, edit-aware counts, media and the pipeline."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import media, packing, segments, sharding, token_counts, token_output
from tallyspark.llm.common import gapless, new_folder, stash

TOKENIZER = segments.tokenizer_file("byte_bpe_50k.json")
RANKS = segments.tokenizer_file("byte_bpe_50k.tiktoken")
_plain = Tokenizer.from_file(TOKENIZER)


def plain_ids(text):
    """What the tokenizers library gives for a text with the file as it is."""
    return _plain.encode(text or "", add_special_tokens=False).ids


WEIRD = [
    "",
    " ",
    " a",
    "a  b",
    "a\n b",
    " \n a  ",
    "x <|endoftext|> y",
    "a \x1cb",
    "a\x85 b",
    "tab\t x",
    "don't  'll we're",
    "ñ é",
    "  x",
    "日本 語 😀",
    "x\ty z\n",
    "a\xa0b \xa0c",
]


@settings(max_examples=150, deadline=None)
@given(
    st.lists(
        st.sampled_from([*" \t\n\x1c\x85\xa0aé.,'1$日<|", "<|endoftext|>", "endoftext|>"]), max_size=40
    ).map("".join)
)
def test_segments_keep_the_ids(text):
    whole = plain_ids(text)
    assert np.frombuffer(segments.SegmentEncoder(TOKENIZER).encode([text])[0], np.uint32).tolist() == whole
    assert "".join(segments.segments(text)) == text
    if "<|endoftext|>" not in text:
        assert len(segments.load_ranks(RANKS).encode_ordinary(text)) == len(whole)


def test_special_strings_are_their_tokens():
    encoder = segments.SegmentEncoder(TOKENIZER)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", " <|endoftext|>  y z", "<|endoftext"]
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        ids = np.frombuffer(raw, np.uint32).tolist()
        assert ids == plain_ids(text) and ids.count(50256) == text.count("<|endoftext|>")


def test_cache_may_be_emptied(monkeypatch):
    monkeypatch.setattr(segments, "CACHE_CHARS", 20)
    encoder = segments.SegmentEncoder(TOKENIZER)
    texts = ["some words here"] * 300 + ["other words there"] * 300 + WEIRD
    assert [np.frombuffer(x, np.uint32).tolist() for x in encoder.encode(texts)] == [plain_ids(x) for x in texts]


def test_boundaries_are_optimal():
    rng = random.Random(0)
    for _ in range(150):
        lengths = rng.sample(range(1, 30), rng.randint(1, 8))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 4)
        cost = lambda bounds: sum(
            c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True)
        )
        top = max(lengths)
        best = min(
            cost([*s, top]) for r in range(min(k, len(lengths))) for s in itertools.combinations(
                [x for x in lengths if x < top], r
            )
        )
        assert cost(packing.optimal_boundaries(lengths, counts, k)) == best


def check_packing(rows, budget):
    groups = {}
    for r in rows:
        assert r.length <= r.bucket_length
        groups.setdefault((r.bucket, r.batch), []).append(r)
    for part in groups.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert len(part) * part[0].bucket_length <= max(budget, part[0].bucket_length)
    for b in {k[0] for k in groups}:
        sizes = [len(groups[b, n]) for n in range(sum(k[0] == b for k in groups))]
        assert len(set(sizes[:-1])) <= 1  # only the last batch may be smaller


def test_packing_whole_table(spark, sf_dir):
    rows = packing.op2_length_buckets(spark, sf_dir).collect()
    want = {r.doc_id: len(plain_ids(r.text)) + 1 for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    check_packing(rows, packing.BUDGET)


def test_packing_odd_rows(odd, empty):
    rows = packing.pack(odd, max_length=64, budget=256).collect()
    check_packing(rows, 256)
    assert sum(r.doc_id is None and r.part == 0 for r in rows) == 6
    assert {r.length for r in rows if r.doc_id in (3, 4)} == {1} and max(r.part for r in rows if r.doc_id == 6) > 100
    assert packing.pack(empty).count() == 0


def test_gapless_numbers(spark, monkeypatch):
    from tallyspark.llm import common

    monkeypatch.setattr(common, "ROWS_PER_BLOCK", 7)
    rows = spark.range(200).select(F.when(F.col("id") < 150, 0).otherwise(F.col("id") % 3).alias("g"), "id")
    got = gapless(rows, "g", ["id"], "n").collect()
    for g in {r.g for r in got}:
        part = [r.n for r in got if r.g == g]
        assert sorted(part) == list(range(len(part)))


def test_differencing_beats_greedy_spread():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 300):
        sizes = rng.integers(1, 9000, n)
        first = np.zeros((n, 8), np.int64)
        first[:, 0] = sizes
        sums, place = sharding.difference(first)
        assert np.array_equal(np.bincount(place[:, 0], sizes, 8).astype(int), sums)
        assert sums[0] - sums[-1] <= sizes.max()
    parts = rng.integers(0, 1000, (40, 8))
    sums, place = sharding.difference(parts)
    check = np.zeros(8, int)
    for i in range(40):
        check[place[i]] += parts[i]
    assert np.array_equal(check, sums) and sums[0] - sums[-1] < 50


def plain_differencing(rows):
    """Largest differencing on lists: the two partial partitions of largest spread, oppositely ordered, until one is left."""
    left = [(sorted(r, reverse=True), i) for i, r in enumerate(rows)]
    new = len(left)
    while len(left) > 1:
        left.sort(key=lambda p: (-(p[0][0] - p[0][-1]), p[1]))
        (a, _), (b, _) = left[:2]
        left = [*left[2:], (sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True), new)]
        new += 1
    return left[0][0]


def test_differencing_equals_a_plain_replay():
    rng = np.random.default_rng(4)
    for n, k in ((1, 3), (2, 3), (7, 2), (60, 5), (90, 8)):
        parts = rng.integers(0, 500, (n, k)) if n % 2 else np.concatenate(
            [rng.integers(1, 500, (n, 1)), np.zeros((n, k - 1), int)], axis=1
        )
        sums, place = sharding.difference(parts.astype(np.int64))
        assert sums.tolist() == plain_differencing(parts.tolist())
        check = np.zeros(k, int)
        for i in range(n):
            check[place[i]] += parts[i]
        assert check.tolist() == sums.tolist()


@pytest.mark.parametrize("block, fan", [(20_000, 512), (9, 3)])
def test_shards(spark, sf_dir, monkeypatch, block, fan):
    monkeypatch.setattr(sharding, "BLOCK", block)
    monkeypatch.setattr(sharding, "FAN", fan)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sharding.shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 5).collect()
    assert len(rows) == len(docs)
    sizes, homes = {}, {}
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
        sizes.setdefault(r.shard, []).append(r)
        homes.setdefault(docs[r.doc_id], set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    totals = [sum(r["size"] for r in p) for p in sizes.values()]
    largest = max(sum(r["size"] for r in rows if docs[r.doc_id] == t) for t in homes)
    assert len(totals) == 5 and max(totals) - min(totals) <= (largest if block < 100 else 100)
    assert all(sorted(r.slot for r in p) == list(range(len(p))) for p in sizes.values())


def test_shard_odd_rows(odd, empty):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == odd.count() and len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1
    assert all(
        sorted(r.slot for r in rows if r.shard == s) == list(
            range(sum(r.shard == s for r in rows))
        ) for s in {r.shard for r in rows}
    )
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id in (3, 4)} == {(16, 0)}
    assert sharding.shard_documents(empty).count() == 0


def test_token_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = token_output.write_files(docs, new_folder(spark, "test"), sequence=128, files=3)
    got = {r.doc_id: r for r in token_output.read_files(files).collect()}
    start, stream = 0, []
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*plain_ids(r.text), 2], "<u4")
        assert (
            got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32
        ) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        stream.append(ids)
    whole = np.concatenate(stream)
    first = files.orderBy("part").first()
    before = pa.total_allocated_bytes()
    ids, mask = token_output.sequence_at(first.ids_file, 2)
    assert ids.tolist() == whole[256:384].tolist() and mask.all() and pa.total_allocated_bytes() - before < 4096  # a view of the map
    last = -(-first.n_ids // 128) - 1
    _, mask = token_output.sequence_at(first.ids_file, last)
    assert mask.sum() == first.n_ids - last * 128


def test_token_file_odd_rows(spark, odd, empty):
    files = token_output.write_files(odd, new_folder(spark, "test"), files=4)
    rows = token_output.read_files(files).orderBy("start").collect()
    assert len(rows) == odd.count() and rows[0].doc_id is None and rows[0].start == 0
    assert max(r.n_docs for r in files.collect()) < odd.count() / 2  # rows without an id are in several files
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append(zlib.crc32(np.array([*plain_ids(r.text), 2], "<u4").tobytes()))
    assert {k: sorted(v) for k, v in texts.items()} == {
        k: sorted(r.ids_crc32 for r in rows if r.doc_id == k) for k in texts
    }
    assert all(b.start == a.start + a.n_tokens for a, b in itertools.pairwise(rows))
    assert [r.n_tokens for r in rows if r.doc_id in (3, 4)] == [1, 1]
    assert token_output.read_files(token_output.write_files(empty, new_folder(spark, "test"), files=2)).count() == 0


def test_edits_equal_full_encoding():
    rng = random.Random(3)
    known, read = segments.SegmentCounts(RANKS), segments.load_ranks(RANKS).encode_ordinary
    for text in [*WEIRD, "the quick brown fox " * 60, "word\nline  two " * 50]:
        tree = token_counts.CountTree.of(text, known)
        for step in range(25):
            at, gone, new = rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 3, 9, 80]), rng.choice(
                [" added words", "x", "", " ", "\n", "  two", "end. ", "w " * 90]
            )
            tree.edit(at, gone, new)
            at = min(at, len(text))
            text = text[:at] + new + text[at + gone :]
            assert tree.text() == text and tree.total == len(read(text))
            assert tree.node_chars[1] == len(text) and all(
                tree.node_tokens[k] == tree.node_tokens[2 * k] + tree.node_tokens[2 * k + 1] for k in range(1, tree.size)
            )
            if step % 5 == 0:  # from what is kept
                tree = token_counts.CountTree.kept(*tree.state(), known)
            elif step % 5 == 3:  # from a table and what changed since
                base = token_counts.CountTree.of(text, known)
                base.edit(2, 1, "ab c")
                base.edit(len(text) // 2, 5, " de")
                again = token_counts.CountTree.kept(
                    *token_counts.CountTree.of(text, known).state(), known, base.patch()
                )
                assert (
                    again.text(), again.total, again.node_chars, again.node_tokens
                ) == (base.text(), base.total, base.node_chars, base.node_tokens)


def test_edits_touch_little():
    known = segments.SegmentCounts(RANKS)
    tree = token_counts.CountTree.of("some words of text " * 5000, known)
    tree.edit(40_000, 3, "new")
    assert tree.encoded <= 6


def test_kept_trees_are_edited_again(spark):
    read = segments.load_ranks(RANKS).encode_ordinary
    texts = {1: "some words of text " * 300, 2: "", 3: None, 4: "a <|endoftext|> b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    edit = lambda at, gone, new: F.array(
        F.struct(F.lit(at).alias("start"), F.lit(gone).alias("remove"), F.lit(new).alias("insert"))
    )
    base = stash(token_counts.build_trees(docs), "test")
    rows, want = base, {k: v or "" for k, v in texts.items()}
    for at, gone, new in [(7, 3, " other words"), (4000, 0, "end"), (0, 2, "")]:
        patches = stash(token_counts.apply_edits(rows.withColumn("edits", edit(at, gone, new))), "test")
        rows = base.join(patches.select("doc_id", "patch"), "doc_id")
        folded = {r.doc_id: r for r in token_counts.fold_patches(rows).collect()}
        for r in patches.collect():
            old, p = want[r.doc_id], min(at, len(want[r.doc_id]))
            want[r.doc_id] = old[:p] + new + old[p + gone :]
            assert (r.n_before, r.n_after) == (len(read(old)), len(read(want[r.doc_id]))) and r.n_encoded <= 8
            f = folded[r.doc_id]
            assert f.tree_text == want[r.doc_id] and sum(f.segment_tokens) == r.n_after and sum(f.leaf_segments) == len(f.segment_chars)
    assert max(sum(len(x.chars) for x in r.patch) for r in patches.collect()) < 200  # of 1,200 segments


def test_edit_query(spark, sf_dir):
    read = segments.load_ranks(RANKS).encode_ordinary
    docs = {
        r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn(
            "e", token_counts.derived_edits("doc_id", "text")
        ).collect()
    }
    for r in token_counts.op8_edit_counts(spark, sf_dir).collect():
        text = docs[r.doc_id].text
        assert r.n_before == len(read(text))
        for e in docs[r.doc_id].e:
            at = min(e.start, len(text))
            text = text[:at] + e.insert + text[at + e.remove :]
        assert r.n_after == len(read(text))


def test_edit_odd_rows(odd, empty):
    edits = F.array(
        F.struct(F.lit(-3).alias("start"), F.lit(10**6).alias("remove"), F.lit(None).cast("string").alias("insert"))
    )
    rows = token_counts.recount(odd.withColumn("edits", edits)).collect()
    assert len(rows) == odd.count() and all(r.n_after == 0 for r in rows)
    none = token_counts.recount(
        odd.withColumn("edits", F.lit(None).cast("array<struct<start:int,remove:int,insert:string>>"))
    ).collect()
    assert all(r.n_before == r.n_after for r in none)
    assert token_counts.recount(empty.withColumn("edits", edits)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600))
def test_wav_round_trip(raw):
    p = media.payload_of(raw)
    assert media.from_wav(media.to_wav(p)) == p and len(p) % 64 == 0 and p.startswith(raw) and len(p) >= 64


def test_spectrogram_equals_direct_transform():
    p = media.payload_of(bytes(range(256)) * 2)
    m = media.spectrogram(p)
    x = np.frombuffer(p, np.uint8).astype(float) - 128
    frame = x[media.HOP * 3 : media.HOP * 3 + media.FRAME] * np.hanning(media.FRAME)
    for k in (1, 5, 40):
        direct = abs(sum(v * np.exp(-2j * np.pi * k * n / media.FRAME) for n, v in enumerate(frame)))
        assert m[3, k] == pytest.approx(direct, rel=1e-3, abs=1e-2)


def test_a_tone_has_its_peak():
    n = np.arange(2048)
    p = (128 + 90 * np.sin(2 * np.pi * 20 * n / media.FRAME)).astype(np.uint8).tobytes()
    t, c = media.fingerprint(p)
    assert len(t) and np.all(np.diff(t) >= 0) and np.bincount(c >> 16).argmax() == 20


def test_media_odd_rows(odd, empty):
    rows = media.media_features(media.store_media(odd)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == odd.count() and by[3][0].payload_bytes == 64 and by[3][0].payload_sha256 == by[4][0].payload_sha256 and by[3][0].n_bytes == 0
    assert {
        (x.media_sha256, tuple(x.codes)) for i in (1, 2) for x in by[i]
    } == {(by[1][0].media_sha256, tuple(by[1][0].codes))}
    assert media.store_features(empty).count() == 0


def plain_pairs(payload):
    """Peaks of each frame and their pairs, one by one."""
    m = media.spectrogram(payload)
    peaks = []
    for row in m:
        found = [k for k in range(2, len(row) - 1) if row[k] > row[k - 1] and row[k] >= row[k + 1] and row[k] > 1.0]
        peaks.append(sorted(sorted(found, key=lambda k: -row[k])[: media.PEAKS]))
    return sorted(
        (
            t, (a << 16) | (b << 8) | step
        ) for t, first in enumerate(peaks) for step in range(1, media.SPAN + 1) if t + step < len(peaks) for a in first for b in peaks[t + step]
    )


def test_pairs_equal_plain_enumeration():
    rng = np.random.default_rng(5)
    for size in (64, 128, 640, 4096):
        p = media.payload_of(rng.integers(32, 127, size - 7).astype(np.uint8).tobytes())
        t, c = media.fingerprint(p)
        assert list(zip(t.tolist(), c.tolist(), strict=True)) == plain_pairs(p)


def test_media_columns_of_the_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = media.op9_wav_fingerprints(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        p = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        wav = media.to_wav(p)
        pairs = plain_pairs(p)
        told = ",".join(map(str, [*(t for t, _ in pairs), *(c for _, c in pairs)]))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (
            len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])
        )
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        assert r.feature == f"{len(media.spectrogram(p))}:{len(pairs)}:{hashlib.sha256(told.encode()).hexdigest()[:32]}"
