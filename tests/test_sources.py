"""Readers over small files, and the SQL surface."""

import json

import pytest

from tallyspark.plans import sql
from tallyspark.sources import readers

QUESTIONS = {
    "set": "main",
    "questions": [
        {
            "id": "Q1",
            "stratum": "lookup",
            "question": "what?",
            "unknown": 1,
            "facts": [{"id": "F1", "kind": "sourced", "value": "1"}, {"id": "F2", "kind": "absence"}],
        }
    ],
}


def put(folder, name, value):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=1), encoding="utf-8")
    return str(path)


def test_records_drop_unknown_fields_and_default_missing_ones(spark, tmp_path):
    put(tmp_path, "runs/a/record.json", {"run_id": "a", "status": "completed", "usage": {"total": 5}, "new_field": 1})
    put(tmp_path, "runs/b/record.json", {"run_id": "b", "paged_results": 2, "notes": ["x"]})
    put(tmp_path, "runs/b/other.json", {"run_id": "no"})
    rows = {r.run_id: r for r in readers.run_records(spark, str(tmp_path / "runs")).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].usage.total == 5 and rows["a"].usage.cached_input is None
    assert rows["a"].notes == [] and rows["a"].paged_results == 0 and rows["b"].notes == ["x"]


def test_question_set(spark, tmp_path):
    q = readers.question_set(spark, put(tmp_path, "q.json", QUESTIONS))
    assert [
        (r.question_id, r.fact_id, r.kind) for r in readers.facts(q).orderBy("f_ord").collect()
    ] == [("Q1", "F1", "sourced"), ("Q1", "F2", "absence")]
    with pytest.raises(Exception, match="list of questions"):
        readers.question_set(spark, put(tmp_path, "bad.json", {"set": "x"})).collect()


def test_audit_cells_may_hold_lines(spark, tmp_path):
    put(tmp_path, "audit-queue-1.csv", 'run_id,fact_id,verdict\nr,f,"two\nlines, ""quoted"""\nr,g,\n')
    put(tmp_path, "notes.csv", "run_id,fact_id,verdict\nz,z,z\n")
    rows = readers.audit_rows(spark, [str(tmp_path)], ["run_id", "fact_id", "verdict"]).orderBy("_row").collect()
    assert [(r._row, r.fact_id, r.verdict) for r in rows] == [(1, "f", 'two\nlines, "quoted"'), (2, "g", None)]


def test_pick_log(spark):
    files = spark.createDataFrame(
        [
            ("a", "h/x.jsonl"),
            ("a", "h/sessions/rollout-1.jsonl"),
            ("a", "h/sessions/rollout-2.jsonl"),
            ("b", "h/y.jsonl"),
        ],
        "run_id string, path string",
    )
    got = {r.run_id: r.path for r in readers.pick_log(files, [r"sessions/rollout-", r"x\.jsonl$"]).collect()}
    assert got == {"a": "h/sessions/rollout-2.jsonl"}


def test_host_table_and_incomplete_sources(spark, tmp_path):
    path = put(tmp_path, "hosts.json", {"a.example": {"category": "news", "status": "ok", "reason": "r"}})
    assert readers.host_table(spark, path).first().category == "news"
    put(tmp_path, "sources/a.json", {"run_id": "a", "complete": True, "sources": []})
    put(tmp_path, "sources/b.json", {"run_id": "b", "complete": False})
    done = readers.complete_sources(spark, str(tmp_path / "sources"))
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    assert [r.run_id for r in done.collect()] == ["a"] and sorted(
        r.run_id for r in readers.missing(wanted, done).collect()
    ) == ["b", "c"]


def test_old_analysis_has_a_default_rule(spark, tmp_path):
    assert readers.analysis(spark, put(tmp_path, "a.json", {"rows": []})).first().primary_judge == "combined"


def test_views_and_functions(spark, tmp_path):
    sql.register(spark)
    sql.views(spark, questions=put(tmp_path, "q.json", QUESTIONS))
    got = spark.sql(
        "SELECT fold('Türkiye') AS f, scrub_free_text('token = abc') AS s, (SELECT count(*) FROM facts) AS n"
    ).first()
    assert (got.f, got.s, got.n) == ("turkiye", "token = <redacted>", 2)
