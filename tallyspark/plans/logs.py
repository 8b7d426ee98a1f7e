"""Queries of log extraction: logs are made of tables, so that SQL over the tables tells what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import extraction, provenance, runs, verdicts

from .files import _text
from .more import _rollout_logs
from .registry import query, r6, table




def _none(kind: str) -> F.Column:
    return F.lit(None).cast(kind)


@query("""WITH s AS (SELECT user_id AS run_id, event_id % 3 AS server, event_id, CASE event_type WHEN 'view' THEN 'connected' ELSE 'failed' END AS
 state FROM events WHERE event_type IN ('view', 'signup')), l AS (SELECT run_id, server, arg_max(state, event_id) AS state FROM s GROUP BY
 ALL),
 u AS (SELECT user_id AS run_id, bool_or(event_type = 'error' AND event_id % 3 = 0) AS stopped, bool_or(event_type = 'error') AS failed,
 min(event_id) FILTER (WHERE event_type = 'purchase') AS turn FROM events GROUP BY ALL)
 SELECT u.run_id, coalesce((SELECT state FROM l WHERE l.run_id = u.run_id AND server = 0), 'connected') AS s0, coalesce((SELECT state FROM l
 WHERE l.run_id = u.run_id AND server = 1), 'none') AS s1, CASE WHEN u.run_id % 5 = 0 THEN 'failed' ELSE coalesce((SELECT state FROM l WHERE
 l.run_id = u.run_id AND server = 2), 'none') END AS s2,
 CASE WHEN stopped THEN 'usage_limit_exceeded' WHEN failed THEN 'server_overloaded' END AS infra_reason, 'turn.failed: context ' || turn AS
 incomplete_reason FROM u""")
def side_logs(spark, sf_dir):
    """Start-up states and failures that only a client's output tells: events as its lines, one run a user."""
    e, i, kind = table(spark, sf_dir, "events"), F.col("event_id"), F.col("event_type")
    server = _text("s", i % 3)
    update = F.struct(
        F.lit("mcp_startup_update").alias("type"),
        server.alias("server"),
        F.struct(F.lit("Ready").alias("state")).alias("status"),
    )
    done = F.struct(F.struct(F.lit("mcp_startup_complete").alias("type"), F.array(server).alias("failed")).alias("msg"))
    error = F.struct(
        F.lit("error").alias("type"), F.when(i % 3 == 0, "usage limit").otherwise("at capacity").alias("message")
    )
    turn = F.struct(F.lit("turn.failed").alias("type"), F.struct(_text("context ", i).alias("message")).alias("error"))
    raw = F.when(kind == "view", F.to_json(update)).when(kind == "signup", F.to_json(done)).when(kind == "error", F.to_json(error)).when(
        kind == "purchase", F.to_json(turn)
    ).otherwise('{"type": "other"}')
    stdout = e.select(F.col("user_id").alias("run_id"), i.alias("ord"), raw.alias("raw"))
    users = e.select(F.col("user_id").alias("run_id")).distinct()
    stderr = users.select(
        "run_id",
        F.when(F.col("run_id") % 5 == 0, "MCP client for `s2` failed to start").otherwise("fine").alias("text"),
    )
    base = users.select(
        "run_id",
        F.create_map(F.lit("s0"), F.lit("connected")).alias("mcp_servers"),
        _none("string").alias("infra_reason"),
        _none("string").alias("incomplete_reason"),
    )
    out = extraction.fold_side_logs(base, stdout, stderr)
    state = lambda s: F.coalesce(F.try_element_at("mcp_servers", F.lit(s)), F.lit("none")).alias(s)
    return out.select("run_id", state("s0"), state("s1"), state("s2"), "infra_reason", "incomplete_reason")


def _rate_limits(spark, sf_dir: str):
    """Every event as a rate-limit reading of its user's run."""
    e, i, kind = table(spark, sf_dir, "events"), F.col("event_id"), F.col("event_type")
    info = F.struct(
        F.when(kind == "error", "rejected").otherwise("allowed").alias("status"),
        i.alias("resetsAt"),
        (kind == "signup").alias("isUsingOverage"),
        F.create_map(
            F.lit("five_hour"), F.struct((F.col("value") / 1000).alias("utilization"), (i + 5).alias("resetsAt"))
        ).alias("unifiedWindows"),
    )
    return e.select(
        F.col("user_id").alias("run_id"),
        i.alias("ord"),
        F.to_json(F.struct(F.lit("rate_limit_event").alias("type"), info.alias("rate_limit_info"))).alias("raw"),
    )


@query("""SELECT user_id AS run_id, CASE arg_max(event_type, event_id) WHEN 'error' THEN 'rejected' ELSE 'allowed' END AS status,
 round(arg_max(value, event_id) / 1000, 6) AS used, max(event_id) + 5 AS resets, bool_or(event_type = 'signup') AS over, bool_or(event_type
 = 'error') AS rejected FROM events GROUP BY ALL""")
def plan_windows(spark, sf_dir):
    """The last reading of each run as a window struct; overage and rejection stay once seen."""
    w = extraction.stream_window(extraction.stream_events(_rate_limits(spark, sf_dir)))
    at = lambda m: F.try_element_at(F.col(f"plan_window.{m}"), F.lit("five_hour"))
    return w.select(
        "run_id",
        "plan_window.status",
        r6(at("windows")).alias("used"),
        at("window_resets").alias("resets"),
        F.col("plan_window.is_using_overage").alias("over"),
        F.col("plan_window.rejected_seen").alias("rejected"),
    )


@query("""WITH a AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_id % 3 <> 0 GROUP BY ALL), b AS (SELECT user_id, max(event_id)
 AS last FROM events WHERE event_id % 3 = 0 GROUP BY ALL)
 SELECT coalesce(a.user_id, b.user_id) AS account, CASE WHEN a.last IS NULL OR b.user_id % 2 = 0 THEN b.last ELSE a.last END AS resets, CASE
 WHEN a.last IS NULL OR b.user_id % 2 = 0 THEN 20 ELSE 10 END AS observed_at, '{"n":' || coalesce(a.user_id, b.user_id) || ',"in":{"k":1}}'
 AS kept FROM a FULL JOIN b USING (user_id)""")
def probe_readings(spark, sf_dir):
    """Two feeds of probe logs; the newest reading of each account, and its raw form without account identifiers."""
    logs = _rate_limits(spark, sf_dir)
    first = extraction.probe_reading(logs.where(F.col("ord") % 3 != 0), F.lit(10))
    second = extraction.probe_reading(
        logs.where(F.col("ord") % 3 == 0), F.when(F.col("run_id") % 2 == 0, 20).otherwise(5)
    )
    newest = extraction.latest_reading(first, second)
    raw = _text(
        '{"email": "u',
        F.col("account"),
        '@x.example", "n":',
        F.col("account"),
        ',"in":{"userId": ',
        F.col("account"),
        ', "k":1}}',
    )
    newest = newest.withColumn("observed_at", F.when(F.col("observed_at") == 5, 20).otherwise(F.col("observed_at")))
    kept = F.regexp_replace(extraction.without_accounts(raw), r"\{\s+", "{")
    return newest.select("account", F.col("reading.resets_at").alias("resets"), "observed_at", kept.alias("kept"))


@query("""SELECT conv_id, turn, md5(role || chr(10) || coalesce(text, '') || chr(10) || role || chr(10)) AS digest FROM conversations""")
def json_text(spark, sf_dir):
    """Every string of a JSON value in document order; a number leaves an empty line."""
    deep = F.struct(F.col("role").alias("z"), F.col("turn").alias("n"))
    raw = F.to_json(
        F.struct(
            F.col("role").alias("b"), F.struct(F.coalesce("text", F.lit("")).alias("y"), deep.alias("x")).alias("a")
        )
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.md5(text.json_strings(raw).cast("binary")).alias("digest")
    )


_PRICE = {
    "input": 2.0,
    "cached_input": 0.1,
    "cache_write": 2.5,
    "output": 10.0,
    "long_context_threshold": 30,
    "long_context_multiplier": 2.0,
}


@query("""WITH u AS (SELECT user_id AS k, arg_max(event_id, event_id) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE event_type =
 'signup') AS calls, sum(CASE WHEN CAST(trunc(value) AS BIGINT) > 30 THEN 2 ELSE 1 END * CAST(trunc(value) AS BIGINT) * 2.0 / 1000000)
 FILTER (WHERE event_type = 'signup') AS spent,
 count(*) FILTER (WHERE event_type = 'click' AND event_id % 3 <> 0) AS searches, count(*) FILTER (WHERE event_type = 'click') AS clicks,
 bool_or(event_type = 'error' AND event_id % 3 = 0) AS stopped, bool_or(event_type = 'error') AS failed FROM events GROUP BY ALL),
 c AS (SELECT *, k % 2 = 0 AS stream, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN CAST(k AS DOUBLE) / 8 END AS client FROM u)
 SELECT k AS run_id, CASE WHEN stream THEN 'stream' ELSE 'rollout' END || '.web.Q' || (k % 7) || '.r' || (k % 3) AS run_key, k % 11 = 0 AS
 contaminated, 2 * v + 3 AS total, 2 * v AS input, v AS cached_input, v AS uncached_input, CASE WHEN v IS NOT NULL THEN 3 END AS output,
 calls AS model_calls, clicks AS web_searches,
 CASE WHEN stopped THEN 'usage_limit_exceeded' WHEN failed THEN 'server_overloaded' END AS infra_reason, round(CASE WHEN v IS NULL THEN NULL
 WHEN client IS NOT NULL THEN client WHEN k % 13 = 0 THEN NULL ELSE CASE WHEN calls > 0 THEN spent ELSE (v * 2.0 + v * 0.1 + 3 * 10.0) /
 1000000 END + searches * 0.01 END, 6) AS cost_usd,
 CASE WHEN v IS NULL THEN 'no usage' WHEN client IS NOT NULL THEN CASE WHEN k % 4 = 0 THEN 'client estimate, metered' ELSE
 'client estimate, plan allowance' END WHEN k % 13 = 0 THEN 'no price for m' WHEN k % 4 <> 0 THEN 'list price equivalent, plan allowance'
 ELSE 'list price' END AS cost_basis FROM c""")
def run_record(spark, sf_dir):
    """Run records from logs: extraction, what was asked for, cost with its basis, forbidden hits."""
    x = extraction.rollout_extraction(_rollout_logs(spark, sf_dir))
    k = F.col("run_id")
    agent, auth = F.when(k % 2 == 0, "stream").otherwise("rollout"), F.when(k % 4 == 0, "api_key").otherwise("plan")
    kinds = {"long_context_threshold": "int"}
    price = F.when(k % 13 != 0, F.struct(*[F.lit(v).cast(kinds.get(n, "double")).alias(n) for n, v in _PRICE.items()]))
    of = lambda m, c: F.try_element_at(m, F.lit(c)).alias(c)
    calls = F.transform(
        "per_call_usage",
        lambda m: F.struct(
            *[of(m, c) for c in ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens")]
        ),
    )
    client = F.when((k % 2 == 0) & (k % 3 == 0), k.cast("double") / 8)
    searches = runs.billable_searches(F.lit("rollout"), F.col("web_actions"))
    cost = x.select(
        "run_id", runs.run_cost(agent, F.col("usage"), calls, searches, client, auth, price, F.lit("m")).alias("c")
    ).select("run_id", "c.*")
    meta = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id")).distinct()
    meta = meta.select(
        "run_id",
        agent.alias("agent"),
        F.lit("web").alias("arm"),
        _text("Q", k % 7).alias("question_id"),
        (k % 3).alias("repetition"),
    )
    url = F.when(k % 11 == 0, F.lit("https://BAD.example/x")).otherwise(F.lit("https://h.example/"))
    hits = meta.select("run_id", text.marker_hits(F.array(url, F.lit("an answer")), ["bad.example"]).alias("hits"))
    r = extraction.run_records(x, meta, cost, hits)
    web = F.coalesce(F.try_element_at("tool_calls", F.lit("web.search")), F.lit(0)).alias("web_searches")
    usage = [F.col(f"usage.{c}").alias(c) for c in ("total", "input", "cached_input", "uncached_input", "output")]
    return r.select(
        "run_id",
        "run_key",
        "contaminated",
        *usage,
        "model_calls",
        web,
        "infra_reason",
        r6("cost_usd").alias("cost_usd"),
        "cost_basis",
    )


@query("""SELECT page_id, k, CASE WHEN k = 0 THEN 'Page ' || page_id ELSE 'no address ' || page_id END AS title, CASE WHEN k = 0 THEN url END AS
 url, CASE WHEN k = 0 THEN 'turn0search' || page_id || ',turn1view2' ELSE 'turn9fetch1' END AS refs, CASE WHEN k = 0 THEN 'body of ' ||
 page_id ELSE 'more' END AS body FROM pages, (VALUES (0), (1)) t(k)""")
def output_blocks(spark, sf_dir):
    i, url = F.col("page_id"), F.col("url")
    mark = lambda *refs: _text("cite", *[x for r in refs for x in ("", r)], "")
    rule = "\n" + "-" * 24 + "\n"
    told = _text(
        "head without a mark",
        rule,
        "above\nPage ",
        i,
        " (",
        url,
        ")\n",
        mark(_text("turn0search", i), F.lit("turn1view2")),
        "\nbody of ",
        i,
        "\n",
        rule,
        "no address ",
        i,
        "\n\n",
        mark(F.lit("turn9fetch1")),
        " more ",
        rule,
        "end",
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(provenance.output_blocks(told)).alias("k", "b"))
    return rows.select(
        "page_id", "k", "b.title", "b.url", F.array_join("b.refs", ",").alias("refs"), F.col("b.text").alias("body")
    )


@query("""WITH t AS (SELECT conv_id, turn, 'https://h' || (turn % 2) || '.example/p' AS url FROM conversations) SELECT conv_id AS run_id, 'shown'
 AS kind, url AS key, min(2 * turn + 1) AS "order", 'Title ' || min(turn) AS title, 0 AS segments FROM t GROUP BY conv_id, url
 UNION ALL SELECT conv_id, 'summary', 'summary:t' || turn, 2 * turn + 1, NULL, 1 FROM t UNION ALL SELECT conv_id, 'opened',
 'https://f.example/' || conv_id, min(2 * turn + 1), NULL, count(*) FILTER (WHERE turn % 3 = 0) FROM t WHERE turn % 3 = 0 GROUP BY
 conv_id""")
def stream_sources(spark, sf_dir):
    """Search links with their summaries, and fetched pages, from a call and its result for each turn."""
    c, n = table(spark, sf_dir, "conversations"), F.col("turn")
    use = lambda name, ident, field, value: F.struct(
        F.lit("tool_use").alias("type"),
        ident.alias("id"),
        F.lit(name).alias("name"),
        F.struct(value.alias(field)).alias("input"),
    )
    page = _text("https://f.example/", F.col("conv_id"))
    search, fetch = F.to_json(
        use("WebSearch", _text("t", n), "query", F.lit("q"))
    ), F.to_json(use("WebFetch", _text("f", n), "url", page))
    call = _text(
        '{"type": "assistant", "message": {"id": "m',
        n,
        '", "content": [',
        search,
        F.when(n % 3 == 0, F.concat(F.lit(", "), fetch)).otherwise(""),
        "]}}",
    )
    links = F.to_json(
        F.array(F.struct(_text("Title  ", n).alias("title"), _text("https://h", n % 2, ".example/p").alias("url")))
    )
    found = F.to_json(
        F.struct(
            F.lit("tool_result").alias("type"),
            _text("t", n).alias("tool_use_id"),
            _text("Links: ", links, "\n\nSummary ", n, "\n\nREMINDER: x").alias("content"),
        )
    )
    read = F.to_json(
        F.struct(
            F.lit("tool_result").alias("type"),
            _text("f", n).alias("tool_use_id"),
            _text("page text ", n).alias("content"),
        )
    )
    result = _text(
        '{"type": "user", "message": {"content": [',
        found,
        F.when(n % 3 == 0, F.concat(F.lit(", "), read)).otherwise(""),
        "]}}",
    )
    rows = c.select(
        F.col("conv_id").alias("run_id"),
        F.explode(
            F.array(
                F.struct((2 * n).alias("ord"), call.alias("raw")),
                F.struct((2 * n + 1).alias("ord"), result.alias("raw")),
            )
        ).alias("x"),
    )
    logs = rows.select("run_id", F.col("x.ord").cast("bigint").alias("ord"), "x.raw")
    return provenance.stream_sources(logs).select(
        "run_id", "kind", "key", "order", "title", F.size("segments").cast("bigint").alias("segments")
    )


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 4 = 3 THEN 'result not success (error_max_turns)' WHEN o_orderstatus <> 'F' THEN
 'no end of the task in the log' WHEN o_orderkey % 5 = 0 THEN 'no usage in the log' END AS problem FROM orders""")
def log_problems(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("run_id"),
        (F.col("o_orderstatus") == "F").alias("ended"),
        F.when(k % 5 != 0, k).alias("usage"),
        F.when(k % 4 == 3, "error_max_turns").when(k % 4 == 2, "success").alias("subtype"),
    )
    return extraction.log_problem(rows, "ended", "subtype")


@query("""WITH c AS (SELECT conv_id AS k, arg_max(text, turn) FILTER (WHERE role = 'assistant' AND text <> '') AS last FROM conversations GROUP BY
 ALL)
 SELECT k AS run_id, md5(CASE WHEN k % 5 = 0 THEN coalesce(last, '') ELSE 'reply ' || k END) AS reply, 15 AS total, CASE WHEN k % 7 = 0 THEN
 'tools used: Bash' WHEN k % 3 = 0 THEN 'servers loaded: x' WHEN k % 5 = 0 AND trim(coalesce(last, '')) = '' THEN 'no answer' END AS error
 FROM c""")
def judge_replies(spark, sf_dir):
    """Calls of a judge as stream logs: text and usage, and why a reply may not be used."""
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "run_id")
    k = F.col("run_id")
    runs_ = c.select("run_id").distinct()
    server = F.when(k % 3 == 0, F.lit('{"name": "x", "status": "connected"}')).otherwise("")
    init = runs_.select(
        "run_id",
        F.lit(-2).cast("bigint").alias("ord"),
        _text('{"type": "system", "subtype": "init", "tools": [], "mcp_servers": [', server, "]}").alias("raw"),
    )
    tool = runs_.where(k % 7 == 0).select(
        "run_id",
        F.lit(-1).cast("bigint").alias("ord"),
        F.lit(
            '{"type": "assistant", "message": {"id": "t", "content": [{"type": "tool_use", "id": "b", "name": "Bash"}]}}'
        ).alias("raw"),
    )
    part = F.struct(F.lit("text").alias("type"), F.col("text"))
    message = F.struct(
        F.lit("assistant").alias("type"),
        F.struct(_text("m", F.col("turn")).alias("id"), F.array(part).alias("content")).alias("message"),
    )
    said = c.where("role = 'assistant'").select(
        "run_id", F.col("turn").cast("bigint").alias("ord"), F.to_json(message).alias("raw")
    )
    answer = F.when(k % 5 != 0, _text("reply ", k)).otherwise("")
    end = runs_.select(
        "run_id",
        F.lit(1 << 30).cast("bigint").alias("ord"),
        _text(
            '{"type": "result", "subtype": "success", "result": "',
            answer,
            '", "usage": {"input_tokens": 10, "output_tokens": 5}}',
        ).alias("raw"),
    )
    logs = init.unionByName(tool).unionByName(said).unionByName(end)
    rows = verdicts.judge_replies(extraction.stream_extraction(logs))
    return rows.select(
        "run_id", F.md5(F.col("reply").cast("binary")).alias("reply"), F.col("usage.total").alias("total"), "error"
    )


@query("""WITH e AS (SELECT event_id AS k, CASE event_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'archive' ELSE 'both' END AS arm FROM events), v AS
 (SELECT k, list_sort(list_filter([CASE WHEN arm <> 'web' AND k % 2 = 0 THEN 'archive server not connected (failed)' END, CASE WHEN arm =
 'web' THEN 'server archive loaded outside the arm''s list' END, CASE WHEN k % 4 = 0 THEN 'server x loaded outside the arm''s list' END,
 CASE WHEN k % 5 = 0 THEN 'tool shell outside the arm''s list' END, CASE WHEN arm = 'web' THEN
 'tool mcp:archive.find outside the arm''s list' END, CASE WHEN arm = 'archive' AND k % 7 = 0 THEN 'web search in an arm without it' END],
 lambda x: x IS NOT NULL)) AS list FROM e)
 SELECT k AS run_id, array_to_string(list, '; ') AS violations FROM v""")
def isolation_violations(spark, sf_dir):
    """Sorted distinct reasons why a run used what its arm may not use."""
    k = F.col("event_id")
    arm = F.when(k % 3 == 0, "web").when(k % 3 == 1, "archive").otherwise("both")
    entry = lambda name, value: F.struct(F.lit(name).alias("k"), value.alias("v"))
    servers = F.map_from_entries(
        F.array_compact(
            F.array(
                entry("archive", F.when(k % 2 == 0, "failed").otherwise("connected")),
                F.when(k % 4 == 0, entry("x", F.lit("connected"))),
            )
        )
    )
    one = F.lit(1).cast("bigint")
    tools = F.map_from_entries(
        F.array_compact(
            F.array(
                entry("mcp:archive.find", one),
                F.when(k % 5 == 0, entry("shell", one)),
                F.when(k % 7 == 0, entry("web.search", one)),
            )
        )
    )
    rows = table(spark, sf_dir, "events").select(
        k.alias("run_id"), arm.alias("arm"), servers.alias("s"), tools.alias("t")
    )
    return rows.select(
        "run_id",
        F.array_join(extraction.rollout_violations(F.col("arm"), F.col("s"), F.col("t")), "; ").alias("violations"),
    )
