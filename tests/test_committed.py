"""Files that are there whole or not at all, and logs read in splits."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import committed, readers, sinks


def files_of(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in Path(folder).rglob("*") if p.is_file() and "_manifest" not in p.parts}


def rows(spark, n, mark):
    return spark.range(0, n, 1, 4).select(
        F.concat(F.lit("d"), F.col("id") % 3, F.lit("/f"), "id").alias("path"), F.concat(F.lit(mark), "id").alias("text")
    )


def test_files_and_manifest(spark, tmp_path):
    folder = str(tmp_path / "out")
    told = sinks.write_texts(rows(spark, 20, "a"), folder)
    assert files_of(folder) == {f"d{i % 3}/f{i}": f"a{i}" for i in range(20)}
    assert {(r.path, r.bytes) for r in told.collect()} == {(f"d{i % 3}/f{i}", len(f"a{i}")) for i in range(20)}
    sinks.write_texts(rows(spark, 3, "b"), folder)
    assert files_of(folder) == {f"d{i % 3}/f{i}": f"b{i}" for i in range(3)}
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    sinks.write_texts(rows(spark, 0, "c"), str(tmp_path / "none"))
    assert files_of(tmp_path / "none") == {}


@pytest.mark.parametrize("stood", [False, True])
def test_a_task_that_dies_leaves_all_as_it_was(spark, tmp_path, stood):
    folder = str(tmp_path / "out")
    if stood:
        sinks.write_texts(rows(spark, 5, "old"), folder)
    before = files_of(folder)

    @F.udf("string")
    def dying(text):
        import os

        if text == "new17":
            os._exit(1)  # the worker goes, not just its row
        return text

    with pytest.raises(Exception):  # noqa: B017
        sinks.write_texts(rows(spark, 20, "new").withColumn("text", dying("text")), folder)
    assert files_of(folder) == before and bool(before) == stood
    left = {p.name for p in tmp_path.iterdir() if ".staging-" not in p.name}  # of tasks that outlived the job
    assert left == ({"out"} if stood else set())
    sinks.write_texts(rows(spark, 20, "new"), folder)
    assert len(files_of(folder)) == 20


def test_paths_that_may_not_be(spark, tmp_path):
    for path in ("/etc/x", "../x", "_manifest/x", None):
        with pytest.raises(Exception):  # noqa: B017
            committed.write_files(spark.createDataFrame([(path, b"")], "path string, content binary"), str(tmp_path / "o"))
    twice = spark.createDataFrame([("a", b"1"), ("a", b"2")], "path string, content binary")
    with pytest.raises(ValueError, match="one path"):
        committed.write_files(twice, str(tmp_path / "o"))
    assert not (tmp_path / "o").exists()


def test_logs_and_answers(spark, tmp_path):
    import gzip

    logs = spark.createDataFrame([("a.gz", b'{"password": "p"}\nno json\n')], "path string, content binary")
    told = sinks.write_logs(logs, str(tmp_path / "logs")).first()
    raw = (tmp_path / "logs" / "a.gz").read_bytes()
    assert gzip.decompress(raw) == b'{"password": "<redacted>"}\n' and told.bytes == len(raw) and told.clipped == 0
    answers = spark.createDataFrame([("r", "token = abc", "x", "x")], "run_id string, text string, pointer string, canonical string")
    sinks.write_answers(answers, str(tmp_path / "answers"))
    assert files_of(tmp_path / "answers") == {"r.txt": "token = <redacted>"}


def test_markdown_by_tasks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a|{i}") for i in range(9)], "k int, t string")
    sinks.write_markdown(df.repartition(3), ["k", "t"], ["k"], str(tmp_path / "md"), 2)
    parts = [p.read_text().splitlines() for p in sorted((tmp_path / "md").glob("part-*"))]
    assert all(p[:2] == ["| k | t |", "|---|---|"] for p in parts if p)
    assert [x for p in parts for x in p[2:]] == [f"| {i} | a\\|{i} |" for i in range(9)]


@pytest.mark.parametrize("size", ["200", "1000", "128m"])
def test_ordinals_do_not_depend_on_splits(spark, tmp_path, size):
    for name, n in (("a", 400), ("b", 3), ("c", 0)):
        lines = [["", json.dumps({"k": k, "t": "x" * (k % 40)}), "[1]", "{broken", f'  {{"k": {k}}}\t'][k % 5] for k in range(n)]
        ends = ["\n", "\r\n", "\n\n", "\u2028", "\x0b"]
        text = "".join(x + ends[k % 5] for k, x in enumerate(lines))
        (tmp_path / f"{name}.jsonl").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = readers.json_lines(spark, str(tmp_path))
        got = {(Path(r.path).name, r.ord, r.raw) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = set()
    for p in tmp_path.glob("*.jsonl"):
        kept = []
        for line in p.read_bytes().decode().splitlines():
            try:
                value = json.loads(line)
            except ValueError:
                continue
            kept += [line.strip()] if isinstance(value, dict) else []
        want |= {(p.name, k, x) for k, x in enumerate(kept)}
    assert got == want and len(want) > 150


@pytest.mark.parametrize("hashed", [sinks.fingerprint, sinks.grouped_fingerprint])
def test_fingerprints_see_every_change(spark, hashed):
    base = [(f"f{i}", bytes([i])) for i in range(40)] + [("gone", None)]
    of = lambda r, n=3: hashed(spark.createDataFrame(r, "label string, content binary").repartition(n))
    assert of(base) == of(base[::-1], 5) == of(base + base[:3])
    others = [base[:-1], [*base, ("x", b"")], [("f0", b"other"), *base[1:]], [("g0", b"\0"), *base[1:]]]
    assert len({of(base), *map(of, others)}) == 5


def test_files_are_read_by_their_manifest(spark, tmp_path):
    texts = {f"d{i}/a b{i}.json": bytes([i % 7]) * i for i in range(70)} | {"x.gz": b"no gzip"}
    rows = spark.createDataFrame([*texts.items()], "path string, content binary").repartition(4)
    folder = f"file://{tmp_path}/out"
    committed.write_files(rows, folder)
    got = committed.read_files(spark, folder).collect()
    assert {r.path: bytes(r.content) for r in got} == texts and len(got) == len(texts)
    (tmp_path / "out" / "d5" / "a b5.json").write_bytes(b"other")
    with pytest.raises(Exception, match="not as the manifest has it"):
        committed.read_files(spark, folder).collect()
