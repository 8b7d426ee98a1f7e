"""Every query over texts of a megabyte: many words, one unbroken word, and copies of both among short texts."""

import hashlib
import zlib

import pytest

from tallyspark.llm import segments
from tallyspark.llm.queries import QUERIES

MEGA = 1 << 20
ITEM = "Which of the long rivers of the far north freezes first in a hard winter? It is the small one."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with the tables that the queries read."""
    many = " ".join(f"word{i * i % 9973}" for i in range(MEGA // 9)) + f" {ITEM} " + "tail " * 5
    word = "unbroken" * (MEGA // 8)
    short = [(100 + i, f"the short text number {i} tells of rivers and of hills {i % 5}", "en") for i in range(60)]
    spanish = [(200 + i, f"el texto corto número {i} habla de ríos y de montañas {i % 7}", "es") for i in range(60)]
    docs = [(1, many, "en"), (2, word, "en"), (3, many, "es"), (4, word + " end", "es"), (5, many + " and more", None)]
    rows = [(i, t, k, "s", len(t)) for i, t, k in [*docs, *short, *spanish]]
    made = tmp_path_factory.mktemp("long")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(
        4
    ).write.parquet(f"{made}/documents.parquet")
    labels = [(i, 1, i % 2) for i, *_ in rows]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{made}/labels.parquet")
    items = [(1, ITEM), (2, "Nothing of this kind is told here? no.")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{made}/benchmark.parquet")
    return str(made), {i: t for i, t, *_ in rows}


def result(spark, folder, name):
    return QUERIES[name](spark, folder[0]).collect()


def test_packing_and_token_files(spark, folder):
    _, texts = folder
    ranks = segments.load_ranks(segments.tokenizer_file("byte_bpe_50k.tiktoken"))
    want = {i: len(ranks.encode_ordinary(t)) + 1 for i, t in texts.items()}
    packed = {}
    for r in result(spark, folder, "op2_length_buckets"):
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == want
    assert {r.doc_id: r.n_tokens for r in result(spark, folder, "op6_arrow_sequences")} == want


def test_shards_and_media(spark, folder):
    _, texts = folder
    rows = result(spark, folder, "op4_differencing_shards")
    crc = {r.doc_id: r.text_crc32 for r in rows}
    assert crc == {i: zlib.crc32(t.encode()) for i, t in texts.items()}
    assert {r.doc_id: r.size for r in rows} == {i: len(t.encode()) + 16 for i, t in texts.items()}
    for r in result(spark, folder, "op9_wav_fingerprints"):
        raw = texts[r.doc_id].encode()
        payload = raw + b"\0" * (-len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()


def test_near_duplicates(spark, folder):
    five = {r.doc_id: r.component_id for r in result(spark, folder, "op5_jaccard_rtree")}
    assert (five[1], five[3], five[5], five[2], five[4]) == (1, 1, 1, 2, 4)
    bits = {r.doc_id: r for r in result(spark, folder, "op13_bk_trees")}
    assert bits[1].fingerprint == bits[3].fingerprint and {bits[i].component_id for i in (1, 3, 5)} == {1}


def test_labels_and_scores(spark, folder):
    _, texts = folder
    spoken = {r.doc_id: r.lang_pred for r in result(spark, folder, "op3_byte_gru")}
    assert len(spoken) == len(texts) and set(spoken.values()) <= {"en", "es"}
    toxic = result(spark, folder, "op7_boosted_toxicity")
    assert len(toxic) == len(texts) and all(0 <= r.score <= 1 for r in toxic)


def test_counts_after_edits(spark, folder):
    rows = result(spark, folder, "op8_edit_counts")
    assert {r.doc_id for r in rows} == set(folder[1])


def test_runs_and_items(spark, folder):
    _, texts = folder
    runs = {r.doc_id: r for r in result(spark, folder, "op12_kolpakov_kucherov")}
    assert set(runs) == set(texts) and runs[2].n_runs == 0
    assert {(r.doc_id, r.item_id) for r in result(spark, folder, "op10_blockmax_wand")} == {(i, 1) for i in (1, 3, 5)}
