"""Stages of the pipeline on small tables, and the whole of it against plain loops."""

import re

import corpus_pipeline
import numpy as np
import regex
from pyspark.sql import functions as F
from test_sets_and_passages import brute, plain_contamination
from test_tokens_and_files import check_packing

from tallyspark.llm import packing, segments
from tallyspark.llm.common import remainder
from tallyspark.llm.toxicity import fit_toxicity

STAGES = dict(corpus_pipeline.STAGES)


def test_language_without_labels_keeps_texts_with_letters(spark):
    docs = spark.createDataFrame(
        [(1, "plain words", None), (2, None, None), (3, "12 !?", None), (4, "日本", None), (None, "ä", None)],
        "doc_id bigint, text string, lang string",
    )
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text) for r in got.collect()} == {(1, "plain words"), (4, "日本"), (None, "ä")}


def test_whole_pipeline_equals_plain_loops(spark, sf_dir):
    """Each stage's decision in plain Python over what the one before kept, down to the lengths of the sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if t and regex.search(r"\p{L}", t)}
    after = docs.where(F.col("doc_id").isin(sorted(kept)))
    model = fit_toxicity(after, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~remainder("doc_id", 5, 0)))
    ids = sorted(kept)
    score = model.score([kept[i] for i in ids])
    kept = {i: kept[i] for i, s in zip(ids, score, strict=True) if s < 0.5}
    groups = brute(list(kept.items()))
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = {d for d, _ in plain_contamination(list(kept.items()), items)}
    kept = {i: t for i, t in kept.items() if i not in dirty}
    read = segments.load_ranks(segments.tokenizer_file("byte_bpe_50k.tiktoken")).encode_ordinary
    want = {i: len(read(t)) + 1 for i, t in kept.items()}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and dirty and len(want) < len(rows)
    check_packing(out, packing.BUDGET)
    lengths = sorted(r.length for r in out)
    counts = np.bincount(lengths)
    bounds = packing.optimal_boundaries(np.flatnonzero(counts).tolist(), counts[counts > 0].tolist(), packing.BUCKETS)
    assert sorted({r.bucket_length for r in out}) == bounds


def test_odd_rows_pass_each_stage(spark, odd, sf_dir):
    docs = odd.select(
        "doc_id",
        "text",
        "lang",
        "source",
        F.length("text").cast("long").alias("n_chars"),
        F.lit("mine").alias("row"),
        F.lit(1.5).alias("score"),
        F.lit(7).alias("_n"),
        F.lit(True).alias("_learn"),
    )
    names = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, docs, sf_dir)
        assert made.columns == docs.columns
        rows = made.collect()
        assert all(r.row == "mine" and r.score == 1.5 and r._n == 7 and r._learn for r in rows)
        names[name] = [r.doc_id for r in rows]
    assert set(names["language ID"]).isdisjoint({3, 4, 5, 9}) and len(names["language ID"]) == odd.count() - 4
    single = names["n-gram Jaccard join"]
    assert single.count(None) == 1 and single.count(1) == 1 and 2 not in single and {3, 4, 5} <= set(single)
    assert STAGES["packing"](spark, docs, sf_dir).count() >= odd.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id = -1"), sf_dir).count() == 0


def test_rows_that_share_an_id_stay_if_their_texts_differ(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = spark.createDataFrame(
        [(5, a), (5, b), (3, b), (9, a + " end"), (7, c), (None, c), (7, c)], "doc_id bigint, text string"
    )
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate(spark, docs, "").collect())
    assert got == [(3, b), (5, a), (7, c)]


def test_no_stage_swallows_an_error():
    source = open(corpus_pipeline.__file__, encoding="utf-8").read()
    assert not re.search(r"\bexcept\b", source)
