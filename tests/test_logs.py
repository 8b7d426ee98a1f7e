"""Log extraction, sources and attribution on small invented logs."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import extraction, provenance
from tallyspark.sources import readers, sinks

ID = "12345678-1234-1234-1234-123456789abc"


def logs(spark, records, run="r"):
    return spark.createDataFrame(
        [(run, i, json.dumps(r)) for i, r in enumerate(records)], "run_id string, ord bigint, raw string"
    )


def event(kind, **payload):
    return {"type": "event_msg", "payload": {"type": kind, **payload}}


def usage(total, **more):
    return event(
        "token_count",
        info={
            "total_token_usage": {
                "input_tokens": total - 10, "cached_input_tokens": 5, "output_tokens": 10, "total_tokens": total
            }
        },
        **more,
    )


ROLLOUT = [
    {"type": "session_meta", "payload": {"cli_version": "1.0"}},
    {"type": "turn_context", "payload": {"model": "m", "effort": "low"}},
    {"type": "turn_context", "payload": {"model": None, "effort": "high"}},
    {"type": "token_usage_record", "payload": {"usage": {"input_tokens": 7, "output_tokens": None}}},
    usage(50, rate_limits={"credits": {"balance": "9", "has_credits": True}, "rate_limit_reached_type": "x"}),
    {"type": "response_item", "payload": {"type": "custom_tool_call", "call_id": "c1", "name": "exec"}},
    {
        "type": "response_item",
        "payload": {
            "type": "custom_tool_call_output",
            "call_id": "c1",
            "output": [
                {"type": "t", "text": "Warning: truncated output (original token count: 123) mcp__archive__find"}
            ],
        },
    },
    event(
        "item_completed",
        item={
            "type": "McpToolCall",
            "id": "k",
            "server": "archive",
            "tool": "find",
            "status": "completed",
            "result": {"content": [{"text": '"filing_id": "' + ID + '", "truncated": true'}]},
        },
    ),
    event(
        "item_completed",
        item={
            "type": "Extension",
            "kind": "web.search",
            "query": "q",
            "action": {"type": "search"},
            "results": [
                {
                    "url": "https://a.example/1",
                    "domain": "a.example",
                    "ref_id": "turn0search1",
                    "title": "T",
                    "snippet": "sales of 5,323",
                }
            ],
        },
    ),
    usage(90, rate_limits={"credits": {"balance": "4", "has_credits": True}}),
    event("task_complete", last_agent_message="done"),
]


def test_rollout(spark):
    r = extraction.rollout_extraction(logs(spark, ROLLOUT)).first()
    assert r.usage.total == 90 and r.usage.uncached_input == 75  # the last total, not a sum
    assert (r.model, r.effort, r.model_calls, r.answer) == ("m", "high", 1, "done")
    assert r.tool_calls == {"mcp:archive.find": 1, "web.search": 1} and r.web_actions == {"search": 1}
    assert [(t.call_id, t.tool, t.original_tokens) for t in r.truncated_calls] == [("c1", "exec", 123)]
    assert r.paged_results == 1 and r.mcp_servers == {"archive": "connected"} and r.web_urls == [
        "https://a.example/1", "q"
    ]
    c = r.plan_window.credits
    assert (
        c.balance, c.balance_first, c.balance_min
    ) == ("4", "9", "4") and r.plan_window.rate_limit_reached_seen == "x"


def test_stop_reason_is_sticky(spark):
    records = [
        usage(20),
        event("error", message="overloaded"),
        event("error", codex_error_info="usage_limit_exceeded"),
        event("error", message="capacity"),
    ]
    r = extraction.rollout_extraction(logs(spark, records)).first()
    assert r.infra_reason == "usage_limit_exceeded" and r.errors == [
        "error:overloaded", "error:usage_limit_exceeded", "error:capacity"
    ]


def test_no_usage_is_not_zero(spark):
    r = extraction.rollout_extraction(logs(spark, [event("task_complete", last_agent_message="x")])).first()
    assert r.usage is None and r.incomplete_reason == "no_usage"


def stream(*more, result=True):
    out = [
        {
            "type": "system",
            "subtype": "init",
            "model": "m",
            "tools": ["WebSearch"],
            "mcp_servers": [{"name": "archive", "status": "connected"}],
        },
        {
            "type": "assistant",
            "message": {
                "id": "1",
                "usage": {"input_tokens": 1, "output_tokens": 1},
                "content": [{"type": "tool_use", "id": "t1", "name": "WebSearch", "input": {"query": "q"}}],
            },
        },
        {
            "type": "assistant",
            "message": {
                "id": "1",
                "usage": {"input_tokens": 3, "output_tokens": 1},
                "content": [{"type": "tool_use", "id": "t1", "name": "WebSearch", "input": {"query": "q"}}],
            },
        },
        {
            "type": "user",
            "message": {
                "content": [
                    {
                        "type": "tool_result",
                        "tool_use_id": "t1",
                        "content": 'Links: [{"title": "A", "url": "https://a.example/1"}]\n\nSummary here.\n\nREMINDER: x',
                    }
                ]
            },
        },
        *more,
    ]
    if result:
        out.append(
            {
                "type": "result",
                "subtype": "success",
                "result": "ok",
                "modelUsage": {
                    "a": {"inputTokens": 10, "outputTokens": 2, "cacheReadInputTokens": 5},
                    "b": {"inputTokens": 1, "outputTokens": 1, "thinkingTokens": 4},
                },
            }
        )
    return out


def test_stream(spark):
    r = extraction.stream_extraction(logs(spark, stream())).first()
    assert (r.usage.total, r.usage.input, r.usage.cached_input, r.usage.reasoning) == (19, 16, 5, 4)
    assert r.tool_calls == {"WebSearch": 1} and r.model_calls == 1 and r.answer == "ok" and r.incomplete_reason is None


def test_stream_without_result(spark):
    r = extraction.stream_extraction(logs(spark, stream(result=False))).first()
    assert r.incomplete_reason == "no_result" and (r.usage.input, r.usage.output) == (3, 1)


@pytest.mark.parametrize(
    "status, text, reason",
    [
        (529, "", "api_error:529"),
        (429, "", "usage_limit:429"),
        (None, "usage limit reached", "usage_limit:text"),
        (None, "API Error: 500", "api_error:text"),
    ],
)
def test_stream_errors(spark, status, text, reason):
    last = {
        "type": "result",
        "subtype": "error_during_execution",
        "is_error": True,
        "api_error_status": status,
        "result": text,
        "usage": {"input_tokens": 1, "output_tokens": 0},
    }
    assert extraction.stream_extraction(logs(spark, [*stream(result=False), last])).first().infra_reason == reason


def test_rejection_is_sticky(spark):
    windows = [
        {
            "type": "rate_limit_event",
            "rate_limit_info": {
                "status": s, "isUsingOverage": o, "unifiedWindows": {"five_hour": {"utilization": 0.4, "resetsAt": 9}}
            },
        } for s, o in (("rejected", True), ("allowed", False))
    ]
    w = extraction.stream_extraction(logs(spark, stream(*windows))).first().plan_window
    assert w.status == "allowed" and w.rejected_seen and w.is_using_overage and w.windows == {"five_hour": 0.4}


def test_classify_order(spark):
    none = F.array().cast("array<string>")
    pick = lambda v, i, t, l, n, e, a: spark.range(1).select(
        extraction.classify(
            v, F.lit(i).cast("string"), F.lit(t), F.lit(l), F.lit(n).cast("string"), F.lit(e).cast("int"), F.lit(a)
        ).alias("s")
    ).first().s
    assert pick(F.array(F.lit("x")), "i", True, True, "n", 1, "")[0] == "invalid"
    assert pick(none, "i", True, True, "n", 1, "")[0] == "infra_error"
    assert pick(none, None, True, True, "n", 1, "")[0] == "timeout"
    assert pick(none, None, False, False, None, 3, "a") == ("incomplete", "exit 3")
    assert pick(none, None, False, False, None, 0, " ") == ("incomplete", "no_answer")
    assert pick(none, None, False, False, None, None, "a") == ("completed", None)


def test_violations(spark):
    row = spark.createDataFrame(
        [("web", {"archive": "connected"}, {"shell": 1, "web.search": 2})],
        "arm string, s map<string,string>, t map<string,bigint>",
    )
    got = row.select(extraction.rollout_violations(F.col("arm"), F.col("s"), F.col("t")).alias("v")).first().v
    assert got == ["server archive loaded outside the arm's list", "tool shell outside the arm's list"]


def test_line_scan(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\n{"a": 1}\nbroken {\n[1]\n  {"b": 2}   {"c": 3}', encoding="utf-8")
    rows = readers.json_lines(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.ord, json.loads(r.raw)) for r in rows] == [(0, {"a": 1}), (1, {"b": 2}), (2, {"c": 3})]


def test_rollout_sources_and_attribution(spark):
    src = provenance.rollout_sources(logs(spark, ROLLOUT))
    rows = {(r.kind, r.key): r for r in src.collect()}
    assert rows["shown", "https://a.example/1"].title == "T" and rows["archive", ID].filing_id == ID
    named = src.withColumn("category", F.when(F.col("kind") == "archive", "filing").otherwise("news"))
    claims = spark.createDataFrame(
        [("r", 1, ["5.3 thousand"], ["filing"]), ("r", 2, ["77.1"], []), ("r", 3, [], ["news"])],
        "run_id string, claim_index int, values array<string>, cited array<string>",
    )
    got = {r.claim_index: r for r in provenance.attribute_claims(claims, named).collect()}
    assert (
        got[1].label, got[1].category, got[1].values_in_nonfiling_source, got[1].primary_read
    ) == ("secondary", "news", True, False)
    assert got[2].label == "unattributed" and got[3].citation_only and got[3].category == "news"


def test_stream_sources(spark):
    rows = {(r.kind, r.key): r for r in provenance.stream_sources(logs(spark, stream())).collect()}
    assert set(rows) == {("shown", "https://a.example/1"), ("summary", "summary:t1")}
    assert [s.text for s in rows["summary", "summary:t1"].segments] == ["Summary here."]


def test_blocks_attach_to_their_reference(spark):
    block = "T2 (https://b.example/2)\nciteturn0search9\nread text"
    records = [
        *ROLLOUT,
        {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "z", "output": block}},
        {
            "type": "response_item",
            "payload": {"type": "function_call_output", "call_id": "z", "output": "x\nciteturn0search1\nmore"},
        },
    ]
    rows = {(r.kind, r.key): r for r in provenance.rollout_sources(logs(spark, records)).collect()}
    assert [s.text for s in rows["shown", "https://b.example/2"].segments] == ["read text"]
    assert [s.text for s in rows["shown", "https://a.example/1"].segments] == ["sales of 5,323", "more"]


def test_host_categories(spark):
    seeds = provenance.seed_hosts(spark)
    hosts = spark.createDataFrame(
        [("old.reddit.com",), ("finance.yahoo.com",), ("notreddit.com",), ("mine.example",), ("",)], "host string"
    )
    table = spark.createDataFrame(
        [("mine.example", "news", "ok", "")], "host string, category string, status string, reason string"
    )
    got = {r.host: (r.category, r.basis) for r in provenance.host_categories(hosts, seeds, table).collect()}
    assert got == {
        "old.reddit.com": ("forum", "seed"),
        "finance.yahoo.com": ("aggregator", "seed"),
        "notreddit.com": ("other", "unclassified"),
        "mine.example": ("news", "classified"),
        "unknown": ("other", "seed"),
    }


def test_absent_from_filing(spark):
    src = spark.createDataFrame(
        [("r", "archive", "k", "filing", "", "", 0, [(1, "Strong growth in cloud revenue")])],
        "run_id string, kind string, key string, category string, title string, snippet string, order int, segments array<struct<ord:int,text:string>>",
    )
    claims = spark.createDataFrame(
        [("r", 1, "growth of the cloud", None), ("r", 2, "market leader", None), ("r", 3, "market leader", "filer")],
        "run_id string, claim_index int, phrase string, attributed_to string",
    )
    assert {
        r.claim_index: r.absent_from_filing for r in provenance.absent_from_filing(claims, src).collect()
    } == {1: False, 2: True, 3: False}


def test_csv_and_shards(spark):
    df = spark.createDataFrame(
        [(1, True, 1234567.891, "a,b", {"k": "v"}), (2, None, 0.1234567, 'q"x', None)],
        "id int, ok boolean, n double, s string, m map<string,string>",
    )
    got = sinks.csv_text(df, ["id", "ok", "n", "s", "m"], ["id"])
    assert got == 'id,ok,n,s,m\n1,true,1234568,"a,b","{""k"":""v""}"\n2,,0.123457,"q""x",\n'
    parts = sinks.csv_shards(df, ["id", "s"], ["id"], 14).orderBy("shard").collect()
    assert [p.text for p in parts] == ['id,s\n1,"a,b"\n', 'id,s\n2,"q""x"\n']


def test_scrubbed_log_is_stable(spark, tmp_path):
    (tmp_path / "x.log").write_text('{"password": "p", "t": "ok"}\n')
    files = readers.raw_files(spark, str(tmp_path))
    a, b = sinks.scrubbed_logs(files).first(), sinks.scrubbed_logs(files).first()
    import gzip

    assert a.sha256 == b.sha256 and b"<redacted>" in gzip.decompress(bytes(a.data))


def test_output_gate(spark):
    files = spark.createDataFrame(
        [("a", '{"token": "x"}'), ("b", "me@x.example"), ("c", "fine")], "path string, text string"
    )
    assert {(r.path, r.what) for r in sinks.check_outputs(files).collect()} == {("a", "$<json>.token"), ("b", "email")}


def test_fingerprint_ignores_order(spark):
    rows = [("a", bytearray(b"1")), ("b", None)]
    kind = "label string, content binary"
    assert sinks.fingerprint(spark.createDataFrame(rows, kind)) == sinks.fingerprint(
        spark.createDataFrame(rows[::-1], kind)
    )


def test_judge_replies_and_signs(spark):
    from tallyspark.operators import verdicts

    rows = verdicts.judge_replies(extraction.stream_extraction(logs(spark, stream()))).first()
    assert rows.reply == "ok" and rows.error == "tools used: WebSearch"
    r = extraction.rollout_extraction(logs(spark, ROLLOUT))
    from tallyspark.sources.readers import PLAN_WINDOW

    whole = r.select(F.from_json(F.to_json("plan_window"), PLAN_WINDOW).alias("w"))
    assert whole.select(extraction.metered_signs(F.col("w")).alias("s")).first().s == ["limit reached", "credits drawn"]


def test_claims_of_runs(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    claims = spark.createDataFrame(
        [("a", "ok", [("fact", "x")]), ("b", "error", None)],
        "run_id string, status string, claims array<struct<type:string,text:string>>",
    )
    sources = spark.createDataFrame([("a",), ("b",)], "run_id string")
    ok, missing, failed = provenance.claims_of_runs(runs, claims, sources)
    assert [
        (r.run_id, r.claim_index) for r in ok.collect()
    ] == [("a", 1)] and [r.run_id for r in missing.collect()] == ["c"] and [r.run_id for r in failed.collect()] == ["b"]
