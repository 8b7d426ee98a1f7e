"""Folds of event logs: one row of usage and events per run, from two log dialects.

Input is (run_id, ord, raw): one JSON object a row, in order of ord (see `sources.readers.json_lines`). A fold is
expressed as aggregates: last or first by order, counts, and sums over the last record of each message; nothing is
collected to one task but the arrays that a run record itself holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import json_strings

# Names of tools, markers and reasons in the logs.
SHELL_NAMES = ("exec_command", "shell", "shell_command", "local_shell", "container.exec", "write_stdin")
PATCH_NAMES = ("apply_patch",)
RESOURCE_TOOLS = ("list_mcp_resources", "list_mcp_resource_templates", "read_mcp_resource")
STREAM_RESOURCE_TOOLS = ("ListMcpResourcesTool", "ReadMcpResourceTool")
NEUTRAL_TOOLS = ("TodoWrite", "ExitPlanMode", "EnterPlanMode")
STREAM_WEB_TOOLS = ("WebSearch", "WebFetch")
INFRA_CODES = ("usage_limit_exceeded", "server_overloaded", "internal_server_error", "rate_limit_exceeded")
TRANSIENT_STATUS = (500, 502, 503, 529)
BURST = r"(?i)CLI_QUOTA|RATE_LIMITED|Too Many Requests|HTTP 429|status(?: code)?:? 429"
CUT = r"Warning: truncated output \(original token count: (\d+)\)"
STREAM_CUT = r"(?i)exceeds maximum allowed tokens|MAX_MCP_OUTPUT_TOKENS|Output too large|saved to (?:a )?file|output (?:has been |was )?truncated|\[truncated"
TOKEN_COUNT = r"\((\d[\d,]*) tokens\)|(\d[\d,]*) tokens"
PAGED = r'"truncated": ?true'
CATALOG = r"\bmcp__([A-Za-z0-9-]+?)__([A-Za-z0-9_]+)"
PLAN_TEXT = r"(?i)usage limit|rate limit|limit reached|hit your limit|API Error: 429"
INFRA_TEXT = r"(?i)rate limit|overloaded|usage limit|API Error: 5\d\d|API Error: 429"

_USAGE = "map<string,bigint>"
_WINDOW = "struct<used_percent:double,window_minutes:bigint,resets_at:bigint>"
ROLLOUT = (
    "type string, payload struct<type:string,cli_version:string,model:string,effort:string,usage:map<string,bigint>,call_id:string,name:string,output:string,role:string,content:array<struct<text:string>>,"
    "info:struct<total_token_usage:map<string,bigint>>,rate_limits:struct<limit_id:string,plan_type:string,primary:" + _WINDOW + ",secondary:" + _WINDOW + ",credits:struct<has_credits:boolean,unlimited:boolean,balance:string>,rate_limit_reached_type:string>,"
    "thread_settings:struct<service_tier:string>,server:string,status:string,ready:array<string>,failed:array<string>,cancelled:array<string>,last_agent_message:string,error:struct<codex_error_info:string,message:string>,message:string,codex_error_info:string,"
    "item:struct<id:string,type:string,server:string,tool:string,status:string,result:string,kind:string,query:string,action:struct<type:string,url:string>,results:array<struct<url:string,domain:string,ref_id:string,title:string,snippet:string>>>>"
)
STREAM = (
    "type string, subtype string, model string, claude_code_version string, apiKeySource string, tools array<string>, mcp_servers array<struct<name:string,status:string>>, error string, is_error boolean, num_turns bigint, result string, total_cost_usd double, api_error_status int, errors array<string>, tool_use_result string, "
    "rate_limit_info struct<status:string,resetsAt:bigint,rateLimitType:string,overageStatus:string,overageDisabledReason:string,isUsingOverage:boolean,unifiedWindows:map<string,struct<utilization:double,resetsAt:bigint>>>, "
    "usage struct<input_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint,output_tokens:bigint,output_tokens_details:struct<thinking_tokens:bigint>,server_tool_use:struct<web_search_requests:bigint>>, "
    "modelUsage map<string,struct<inputTokens:bigint,outputTokens:bigint,cacheReadInputTokens:bigint,cacheCreationInputTokens:bigint,thinkingTokens:bigint,webSearchRequests:bigint>>, "
    "message struct<id:string,error:string,usage:struct<input_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint,output_tokens:bigint,output_tokens_details:struct<thinking_tokens:bigint>,server_tool_use:struct<web_search_requests:bigint>>,content:array<struct<type:string,text:string,id:string,name:string,input:struct<query:string,url:string>,tool_use_id:string,content:string,is_error:boolean>>>"
)


def last_by(value: Column, order: Column, when: Column | None = None) -> Column:
    """The last value that is neither null nor empty."""
    ok = value.isNotNull() & (value.cast("string") != "")
    ok = ok if when is None else ok & when
    return F.max_by(F.when(ok, value), F.when(ok, order))


def stops(reason: Column) -> Column:
    """Plan and quota limits, which stop a batch; others are transient."""
    return reason.isin(
        "usage_limit_exceeded", "rate_limit_exceeded", "archive_quota"
    ) | reason.startswith("usage_limit:")


def merge_reasons(reason: Column, order: Column) -> Column:
    """Aggregate: the first stopping reason, else the first."""
    return F.coalesce(
        F.min_by(F.when(stops(reason), reason), F.when(stops(reason), order)),
        F.min_by(reason, F.when(reason.isNotNull(), order)),
    )


def error_reason(code: Column, message: Column) -> Column:
    """The structured code if it is known, else what the text shows; null for other errors."""
    return (
        F.when(code.isin(*INFRA_CODES), code)
        .when(message.rlike("(?i)usage limit|usage_limit"), F.lit("usage_limit_exceeded"))
        .when(message.rlike("(?i)rate limit reached|rate limit exceeded|rate_limit"), F.lit("rate_limit_exceeded"))
        .when(message.rlike("(?i)capacity|overloaded"), F.lit("server_overloaded"))
    )


def quota_reason(text: Column) -> Column:
    return F.when(text.rlike("(?i)CLI_QUOTA"), F.lit("archive_quota")).when(text.rlike(BURST), F.lit("archive_429"))


def usage_struct(fresh: Column, cached: Column, write: Column, output: Column, reasoning: Column) -> Column:
    """Totals from parts: input holds fresh, cached and written tokens; uncached is input without cached."""
    full = fresh + cached + write
    return F.struct(
        (full + output).alias("total"),
        full.alias("input"),
        cached.alias("cached_input"),
        write.alias("cache_write_input"),
        (fresh + write).alias("uncached_input"),
        output.alias("output"),
        reasoning.alias("reasoning"),
    )


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


def usage_of_models(models: Column) -> Column:
    """Sum over the models of a map; null for an empty map; reasoning null if no model tells it."""
    zero = F.struct(
        *[F.lit(0).cast("bigint").alias(n) for n in ("fresh", "cached", "write", "output", "thinking")],
        F.lit(False).alias("told"),
    )
    total = F.aggregate(
        F.map_values(models),
        zero,
        lambda a, m: F.struct(
            (a["fresh"] + _zero(m["inputTokens"])).alias("fresh"),
            (a["cached"] + _zero(m["cacheReadInputTokens"])).alias("cached"),
            (a["write"] + _zero(m["cacheCreationInputTokens"])).alias("write"),
            (a["output"] + _zero(m["outputTokens"])).alias("output"),
            (a["thinking"] + _zero(m["thinkingTokens"])).alias("thinking"),
            (a["told"] | m["thinkingTokens"].isNotNull()).alias("told"),
        ),
    )
    return F.when(
        F.size(models) > 0,
        usage_struct(
            total["fresh"], total["cached"], total["write"], total["output"], F.when(total["told"], total["thinking"])
        ),
    )


def counts_map(rows: DataFrame, run: str, name: str, out: str, count: str | None = None) -> DataFrame:
    """run -> map of names to counts, in order of name."""
    per = rows.groupBy(run, name).agg((F.sum(count) if count else F.count(F.lit(1))).cast("bigint").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), F.col("n").alias("v"))))
    return per.groupBy(run).agg(F.map_from_entries(pairs).alias(out))


def status_word(raw: Column) -> Column:
    """The state of a server as one word, from text or from an object with a state, status or type, or one key."""
    keys = F.json_object_keys(raw)
    named = F.coalesce(
        *[F.get_json_object(raw, f"$.{k}") for k in ("state", "status", "type")], F.when(F.size(keys) == 1, keys[0])
    )
    return F.lower(
        F.when(raw.startswith("{"), F.coalesce(named, F.lit("unknown"))).otherwise(F.coalesce(raw, F.lit("unknown")))
    )


def server_states(events: DataFrame) -> DataFrame:
    """run_id -> map of servers to their last start-up state. Events: run_id, ord, p (payload)."""
    p = F.col("p")
    one = events.where(p["type"] == "mcp_startup_update").select(
        "run_id",
        "ord",
        p["server"].alias("server"),
        F.when(
            status_word(p["status"]) == "ready", F.lit("connected")
        ).otherwise(status_word(p["status"])).alias("state"),
        F.lit(0).alias("rank"),
    )
    name = lambda c: F.when(c.startswith("{"), F.get_json_object(c, "$.server")).otherwise(c)
    done = events.where(p["type"] == "mcp_startup_complete")
    lists = [
        done.select("run_id", "ord", F.explode(p[f]).alias("server")).select(
            "run_id", "ord", name(F.col("server")).alias("server"), F.lit(s).alias("state"), F.lit(i).alias("rank")
        ) for i, (f, s) in enumerate((("ready", "connected"), ("failed", "failed"), ("cancelled", "cancelled")))
    ]
    rows = one
    for x in lists:
        rows = rows.unionByName(x)
    last = rows.where("server IS NOT NULL").groupBy("run_id", "server").agg(
        F.max_by("state", F.struct("ord", "rank")).alias("state")
    )
    return last


def credit_window(events: DataFrame) -> DataFrame:
    """run_id -> plan window: the last reading, with first and least balance and a limit once reached kept."""
    r, o = F.col("p.rate_limits"), F.col("ord")
    balance = r["credits"]["balance"]
    number = balance.try_cast("double")
    agg = events.where(r.isNotNull() & (F.col("p.type") == "token_count")).groupBy("run_id").agg(
        F.max_by(r, o).alias("last"),
        F.min_by(balance, F.when(balance.isNotNull(), o)).alias("first"),
        F.min_by(balance, F.when(number.isNotNull(), F.struct(number.alias("n"), o.alias("o")))).alias("least"),
        F.min_by(r["rate_limit_reached_type"], F.when(r["rate_limit_reached_type"].isNotNull(), o)).alias("seen"),
    )
    last = F.col("last")
    credits = F.when(
        last["credits"].isNotNull(),
        F.struct(
            last["credits"]["has_credits"].alias("has_credits"),
            last["credits"]["unlimited"].alias("unlimited"),
            last["credits"]["balance"].alias("balance"),
            F.col("first").alias("balance_first"),
            F.col("least").alias("balance_min"),
        ),
    )
    return agg.select(
        "run_id",
        F.struct(
            F.lit("rollout_rate_limits").alias("source"),
            last["limit_id"].alias("limit_id"),
            last["plan_type"].alias("plan_type"),
            last["primary"].alias("primary"),
            last["secondary"].alias("secondary"),
            credits.alias("credits"),
            last["rate_limit_reached_type"].alias("rate_limit_reached_type"),
            F.col("seen").alias("rate_limit_reached_seen"),
        ).alias("plan_window"),
    )


def rollout_events(logs: DataFrame) -> DataFrame:
    return logs.select("run_id", "ord", F.from_json("raw", ROLLOUT).alias("r")).select(
        "run_id", "ord", F.col("r.type").alias("type"), F.col("r.payload").alias("p")
    )


def rollout_extraction(logs: DataFrame, server: str = "archive", pseudo: str = "codex") -> DataFrame:
    """One row per run of rollout logs. `server` is the governed tool server, `pseudo` the client's own."""
    ev = rollout_events(logs)
    p, o, kind = F.col("p"), F.col("ord"), F.col("type")
    event, item = kind == "event_msg", (kind == "event_msg") & (p["type"] == "item_completed")
    done = (kind == "event_msg") & (p["type"] == "task_complete")
    failed = (kind == "event_msg") & p["type"].isin("error", "stream_error")
    reply = F.when(
        (kind == "response_item") & (p["type"] == "message") & (p["role"] == "assistant"),
        F.array_join(F.transform(p["content"], lambda c: F.coalesce(c["text"], F.lit(""))), ""),
    ).when(done & (p["last_agent_message"] != ""), p["last_agent_message"])
    code = F.when(
        done & p["error"].isNotNull(), F.coalesce(F.nullif(p["error"]["codex_error_info"], F.lit("")), F.lit("error"))
    ).when(failed, F.coalesce(p["codex_error_info"], F.lit("")))
    message = F.coalesce(F.when(done, p["error"]["message"]).otherwise(p["message"]), F.lit(""))
    base = ev.withColumn("reason", F.when(code.isNotNull(), error_reason(code, message))).groupBy("run_id").agg(
        last_by(p["cli_version"], o, kind == "session_meta").alias("cli_version"),
        last_by(p["model"], o, kind == "turn_context").alias("model"),
        last_by(p["effort"], o, kind == "turn_context").alias("effort"),
        last_by(
            p["thread_settings"]["service_tier"], o, event & (p["type"] == "thread_settings_applied")
        ).alias("service_tier"),
        F.count_if(kind == "token_usage_record").alias("model_calls"),
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.when(kind == "token_usage_record", F.struct(o.alias("o"), F.map_entries(p["usage"]).alias("u")))
                )
            ),
            lambda x: F.map_from_entries(x["u"]),
        ).alias("per_call_usage"),
        F.count_if(kind == "compacted").alias("compactions"),
        F.max_by(reply, F.when(reply.isNotNull(), o)).alias("answer"),
        F.max_by(
            p["info"]["total_token_usage"],
            F.when(event & (p["type"] == "token_count") & p["info"]["total_token_usage"].isNotNull(), o),
        ).alias("total"),
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.when(
                        code.isNotNull(),
                        F.struct(
                            o.alias("o"),
                            F.concat(
                                p["type"],
                                F.lit(":"),
                                F.when(done, code).otherwise(
                                    F.substring(F.when(code != "", code).otherwise(message), 1, 200)
                                ),
                            ).alias("e"),
                        ),
                    )
                )
            ),
            lambda x: x["e"],
        ).alias("errors"),
        F.max_by(
            F.concat(F.lit("error:"), code), F.when(done & code.isNotNull() & F.col("reason").isNull(), o)
        ).alias("error_end"),
        merge_reasons(F.col("reason"), F.struct(o, F.lit(0))).alias("event_reason"),
        F.min(F.when(F.col("reason").isNotNull(), o)).alias("event_at"),
        F.max(F.when(done, o)).isNotNull().alias("ended"),
    )
    items = ev.where(item).select(
        "run_id", "ord", F.col("p.item").alias("i")
    ).withColumn("text", json_strings("i.result"))
    i = F.col("i")
    own = (i["server"] == pseudo) & i["tool"].isin(*RESOURCE_TOOLS)
    web = (i["type"] == "Extension") & (i["kind"] == "web.search")
    tool = F.when(
        i["type"] == "McpToolCall", F.concat(F.lit("mcp:"), i["server"], F.lit("."), i["tool"])
    ).when(web, F.lit("web.search")).when(
        i["type"] == "Extension", F.concat(F.lit("ext:"), i["kind"])
    ).when(i["type"] == "CommandExecution", F.lit("shell")).when(i["type"] == "FileChange", F.lit("file_change"))
    flagged = F.get_json_object(i["result"], "$.isError").isin("true") | F.get_json_object(
        i["result"], "$.is_error"
    ).isin("true")
    broken = (i["type"] == "McpToolCall") & (i["server"] == server) & (
        (i["status"] == "failed") | F.coalesce(flagged, F.lit(False))
    )
    items = items.withColumn("tool", tool).withColumn("quota", F.when(broken, quota_reason(F.col("text"))))
    urls = F.concat(
        F.when(i["action"]["url"].isNotNull(), F.array(i["action"]["url"])).otherwise(F.array().cast("array<string>")),
        F.array_compact(
            F.transform(
                F.coalesce(i["results"], F.array().cast(items.schema["i"].dataType["results"].dataType)),
                lambda r: r["url"],
            )
        ),
        F.when(i["query"].isNotNull(), F.array(i["query"])).otherwise(F.array().cast("array<string>")),
    )
    seen = items.groupBy("run_id").agg(
        F.count_if((i["type"] == "McpToolCall") & F.col("text").rlike(PAGED)).alias("paged_results"),
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.when(web, F.struct(F.col("ord").alias("o"), urls.alias("u"))))),
                lambda x: x["u"],
            )
        ).alias("web_urls"),
        merge_reasons(F.col("quota"), F.struct(F.col("ord"), F.lit(0))).alias("item_reason"),
        F.min(F.when(F.col("quota").isNotNull(), F.col("ord"))).alias("item_at"),
    )
    actions = counts_map(
        items.where(web).select(
            "run_id", F.coalesce(F.nullif(i["action"]["type"], F.lit("")), F.lit("other")).alias("name")
        ),
        "run_id",
        "name",
        "web_actions",
    )
    asked = ev.where((kind == "response_item") & p["type"].isin("custom_tool_call", "function_call", "local_shell_call")).select(
        "run_id",
        "ord",
        p["call_id"].alias("call_id"),
        F.coalesce(F.nullif(p["name"], F.lit("")), p["type"]).alias("name"),
        p["type"].alias("t"),
    )
    wanted = asked.select(
        "run_id",
        "call_id",
        F.when(
            F.col("name").isin(*SHELL_NAMES) | (F.col("t") == "local_shell_call"), F.lit("shell")
        ).when(F.col("name").isin(*PATCH_NAMES), F.lit("file_change")).alias("tool"),
    ).where("tool IS NOT NULL").groupBy("run_id", "tool").agg(F.count_distinct("call_id").alias("n"))
    # a call and its finished item are the same call under two ids: the larger count holds
    used = items.where("tool IS NOT NULL").groupBy("run_id", "tool").agg(
        F.count(F.lit(1)).alias("n")
    ).unionByName(wanted).groupBy("run_id", "tool").agg(F.max("n").alias("n"))
    tools = counts_map(used, "run_id", "tool", "tool_calls", "n")
    outputs = ev.where((kind == "response_item") & p["type"].isin("custom_tool_call_output", "function_call_output")).select(
        "run_id",
        "ord",
        p["call_id"].alias("call_id"),
        json_strings(
            F.when(p["output"].rlike(r"^\s*[\[{]"), p["output"]).otherwise(F.to_json(F.array(p["output"])))
        ).alias("text"),
    )
    names = asked.groupBy("run_id", "call_id").agg(F.max_by("name", "ord").alias("tool"))
    cuts = outputs.select(
        "run_id", "ord", "call_id", F.posexplode(F.regexp_extract_all("text", F.lit(CUT), F.lit(1))).alias("k", "n")
    ).join(names, ["run_id", "call_id"], "left")
    cuts = cuts.groupBy("run_id").agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct("ord", "k", "call_id", "tool", F.col("n").cast("bigint").alias("original_tokens"))
                )
            ),
            lambda x: F.struct(
                x["call_id"].alias("call_id"), x["tool"].alias("tool"), x["original_tokens"].alias("original_tokens")
            ),
        ).alias("truncated_calls")
    )
    # a server counts as connected if its tools are listed or answered, unless start-up events say otherwise
    listed = outputs.select(
        "run_id",
        F.explode(
            F.arrays_zip(
                F.regexp_extract_all("text", F.lit(CATALOG), F.lit(1)).alias("s"),
                F.regexp_extract_all("text", F.lit(CATALOG), F.lit(2)).alias("t"),
            )
        ).alias("m"),
    ).where(
        ~((F.col("m.s") == pseudo) & F.col("m.t").isin(*RESOURCE_TOOLS))
    ).select("run_id", F.col("m.s").alias("server"))
    answered = items.where(
        (i["type"] == "McpToolCall") & (i["status"] == "completed") & ~own
    ).select("run_id", i["server"].alias("server"))
    told = server_states(ev.where(event).select("run_id", "ord", "p"))
    found = listed.unionByName(answered).distinct().join(
        told, ["run_id", "server"], "left_anti"
    ).withColumn("state", F.lit("connected"))
    servers = told.unionByName(found).groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("server", "state")))).alias("mcp_servers")
    )
    out = base
    for part in (seen, actions, tools, cuts, servers, credit_window(ev.where(event))):
        out = out.join(part, "run_id", "left")
    total = F.col("total")
    inp, cached, write, made = (
        _zero(total[k]) for k in ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens")
    )
    usage = F.when(
        total.isNotNull(),
        F.struct(
            F.coalesce(F.nullif(total["total_tokens"], F.lit(0).cast("bigint")), inp + made).alias("total"),
            inp.alias("input"),
            cached.alias("cached_input"),
            write.alias("cache_write_input"),
            (inp - cached).alias("uncached_input"),
            made.alias("output"),
            _zero(total["reasoning_output_tokens"]).alias("reasoning"),
        ),
    )
    event_reason, item_reason = F.col("event_reason"), F.col("item_reason")
    early = F.when(
        F.coalesce(F.col("item_at") < F.col("event_at"), event_reason.isNull()), item_reason
    ).otherwise(event_reason)
    infra = F.coalesce(
        F.when(stops(early), early),
        F.when(stops(event_reason), event_reason),
        F.when(stops(item_reason), item_reason),
        early,
    )
    empty_map = F.create_map().cast("map<string,bigint>")
    return out.select(
        "run_id", usage.alias("usage"), "model", "effort", "service_tier", "cli_version", "model_calls", "per_call_usage", "compactions",
        F.coalesce("tool_calls", empty_map).alias("tool_calls"), F.coalesce("web_actions", empty_map).alias("web_actions"), F.coalesce(
            "web_urls", F.array().cast("array<string>")
        ).alias("web_urls"),
        F.coalesce(
            "truncated_calls", F.array().cast("array<struct<call_id:string,tool:string,original_tokens:bigint>>")
        ).alias("truncated_calls"), F.coalesce(F.size("truncated_calls"), F.lit(0)).cast("bigint").alias("truncations"),
        _zero(F.col("paged_results")).alias("paged_results"), F.coalesce(
            "mcp_servers", F.create_map().cast("map<string,string>")
        ).alias("mcp_servers"), F.coalesce("answer", F.lit("")).alias("answer"), "errors",
        infra.alias("infra_reason"), F.coalesce(
            "error_end", F.when(total.isNull(), F.lit("no_usage"))
        ).alias("incomplete_reason"), F.lit(False).alias("turn_limit"), "plan_window", "ended",
    )


def stream_events(logs: DataFrame) -> DataFrame:
    return logs.select(
        "run_id", "ord", F.from_json("raw", STREAM).alias("r"), "raw"
    ).select("run_id", "ord", "raw", "r.*")


def first_calls(ev: DataFrame) -> DataFrame:
    """Tool calls of a stream: the first of each id. run_id, call_id, ord, k, name, input."""
    parts = ev.where("type = 'assistant'").select(
        "run_id", "ord", F.posexplode("message.content").alias("k", "c")
    ).where(F.col("c.type").isin("tool_use", "server_tool_use"))
    first = Window.partitionBy("run_id", "call_id").orderBy("ord", "k")
    return parts.select(
        "run_id",
        "ord",
        "k",
        F.coalesce("c.id", F.lit("None")).alias("call_id"),
        F.col("c.name").alias("name"),
        F.col("c.input").alias("input"),
    ).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def tool_results(ev: DataFrame, calls: DataFrame) -> DataFrame:
    """Tool results with the call that they answer; the name is empty where no call is known."""
    parts = ev.where("type = 'user'").select(
        "run_id",
        "ord",
        "tool_use_result",
        F.col("message.content").alias("all"),
        F.posexplode("message.content").alias("k", "c"),
    ).where(F.col("c.type") == "tool_result")
    told = F.col("c.content")
    text = json_strings(F.when(told.rlike(r"^\s*[\[{]"), told).otherwise(F.to_json(F.array(told))))
    many = F.size(F.filter("all", lambda x: x["type"] == "tool_result"))
    rows = parts.select(
        "run_id",
        "ord",
        "k",
        F.col("c.tool_use_id").alias("call_id"),
        F.coalesce("c.is_error", F.lit(False)).alias("is_error"),
        text.alias("text"),
        "tool_use_result",
        many.alias("in_event"),
    )
    return rows.join(
        calls.select("run_id", "call_id", "name", "input"), ["run_id", "call_id"], "left"
    ).withColumn("name", F.coalesce("name", F.lit("")))


def stream_window(ev: DataFrame) -> DataFrame:
    """run_id -> plan window: the last reading; overage and rejection stay once seen."""
    info, o = F.col("rate_limit_info"), F.col("ord")
    agg = ev.where((F.col("type") == "rate_limit_event") & info.isNotNull()).groupBy("run_id").agg(
        F.max_by(info, o).alias("i"),
        F.bool_or(F.coalesce(info["isUsingOverage"], F.lit(False))).alias("over"),
        F.bool_or(F.coalesce(info["status"] == "rejected", F.lit(False))).alias("rejected"),
    )
    i = F.col("i")
    return agg.select("run_id", F.struct(
        F.lit("stream_rate_limit_event").alias("source"), i["status"].alias("status"), i["rateLimitType"].alias("rate_limit_type"), F.transform_values(
            i["unifiedWindows"], lambda _, v: v["utilization"]
        ).alias("windows"), F.transform_values(i["unifiedWindows"], lambda _, v: v["resetsAt"]).alias("window_resets"),
        i["resetsAt"].alias("resets_at"), F.when(
            F.col("over"), F.lit(True)
        ).otherwise(i["isUsingOverage"]).alias("is_using_overage"), i["overageStatus"].alias("overage_status"), i["overageDisabledReason"].alias(
            "overage_disabled_reason"
        ), F.col("rejected").alias("rejected_seen"),
    ).alias("plan_window"))


def stream_extraction(logs: DataFrame, server: str = "archive") -> DataFrame:
    """One row per run of stream logs."""
    ev = stream_events(logs)
    o, kind, m = F.col("ord"), F.col("type"), F.col("message")
    init = (kind == "system") & (F.col("subtype") == "init")
    text = F.element_at(
        F.filter(
            F.transform(m["content"], lambda c: F.when((c["type"] == "text") & (c["text"] != ""), c["text"])),
            lambda t: t.isNotNull(),
        ),
        -1,
    )
    said = F.when(
        (kind == "assistant") & (
            F.size(F.filter(m["content"], lambda c: (c["type"] == "text") & (c["text"] != ""))) > 0
        ),
        text,
    )
    wrong = F.coalesce(m["error"], F.col("error"))
    result = F.struct(
        "subtype",
        "is_error",
        "num_turns",
        "result",
        "total_cost_usd",
        "api_error_status",
        "errors",
        "usage",
        "modelUsage",
    )
    base = ev.groupBy("run_id").agg(
        last_by(F.col("model"), o, init).alias("model"),
        last_by(F.col("claude_code_version"), o, init).alias("cli_version"),
        F.max_by(F.col("apiKeySource"), F.when(init, o)).alias("api_key_source"),
        F.max_by(F.coalesce("tools", F.array().cast("array<string>")), F.when(init, o)).alias("init_tools"),
        F.count_if((kind == "system") & (F.col("subtype") == "compact_boundary")).alias("compactions"),
        F.count_distinct(F.when(kind == "assistant", m["id"])).alias("model_calls"),
        F.max_by(said, F.when(said.isNotNull(), o)).alias("last_text"),
        F.max_by(result, F.when(kind == "result", o)).alias("result"),
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.when(
                        (kind == "assistant") & wrong.isNotNull(),
                        F.struct(o.alias("o"), F.concat(F.lit("assistant_error:"), wrong).alias("e")),
                    )
                )
            ),
            lambda x: x["e"],
        ).alias("errors"),
    )
    states = ev.where(init).select("run_id", "ord", F.explode("mcp_servers").alias("s")).groupBy("run_id", F.col("s.name").alias("server")).agg(
        F.max_by(F.coalesce("s.status", F.lit("unknown")), "ord").alias("state")
    )
    servers = states.where("server IS NOT NULL").groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("server", "state")))).alias("mcp_servers")
    )
    calls = first_calls(ev)
    tools = counts_map(calls, "run_id", "name", "tool_calls")
    action = F.when(F.col("name") == "WebSearch", F.lit("search")).when(F.col("name") == "WebFetch", F.lit("fetch"))
    webs = calls.withColumn("action", action).where("action IS NOT NULL")
    actions = counts_map(webs, "run_id", "action", "web_actions")
    urls = webs.groupBy("run_id").agg(
        F.array_compact(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.struct(
                            "ord",
                            "k",
                            F.when(
                                F.col("action") == "search", F.col("input.query")
                            ).otherwise(F.col("input.url")).alias("u"),
                        )
                    )
                ),
                lambda x: x["u"],
            )
        ).alias("web_urls")
    )
    res = tool_results(ev, calls)
    count = F.regexp_replace(
        F.coalesce(
            F.nullif(F.regexp_extract("text", TOKEN_COUNT, 1), F.lit("")),
            F.nullif(F.regexp_extract("text", TOKEN_COUNT, 2), F.lit("")),
        ),
        ",",
        "",
    ).cast("bigint")
    quota = F.when(F.col("is_error") & F.col("name").startswith(f"mcp__{server}__"), quota_reason(F.col("text")))
    seen = res.withColumn("quota", quota).groupBy("run_id").agg(
        F.count_if(F.col("text").rlike(PAGED)).alias("paged_results"),
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.when(
                        F.col("text").rlike(STREAM_CUT),
                        F.struct(
                            "ord",
                            "k",
                            "call_id",
                            F.nullif("name", F.lit("")).alias("tool"),
                            count.alias("original_tokens"),
                        ),
                    )
                )
            ),
            lambda x: F.struct(
                x["call_id"].alias("call_id"), x["tool"].alias("tool"), x["original_tokens"].alias("original_tokens")
            ),
        ).alias("truncated_calls"),
        merge_reasons(F.col("quota"), F.struct("ord", "k")).alias("quota"),
    )
    # without a result: the last usage of each message, summed
    u = F.col("u")
    steps = ev.where(
        (kind == "assistant") & m["id"].isNotNull() & m["usage"].isNotNull()
    ).groupBy("run_id", m["id"].alias("mid")).agg(F.max_by(m["usage"], o).alias("u"))
    partial = steps.groupBy("run_id").agg(
        *[
            _zero(F.sum(u[k])).alias(k) for k in (
                "input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens"
            )
        ],
        F.sum(u["output_tokens_details"]["thinking_tokens"]).alias("thinking"),
        _zero(F.sum(u["server_tool_use"]["web_search_requests"])).alias("partial_searches"),
    )
    partial = partial.select(
        "run_id",
        usage_struct(
            F.col("input_tokens"),
            F.col("cache_read_input_tokens"),
            F.col("cache_creation_input_tokens"),
            F.col("output_tokens"),
            F.col("thinking"),
        ).alias("partial"),
        "partial_searches",
    )
    out = base
    for part in (servers, tools, actions, urls, seen, partial, stream_window(ev)):
        out = out.join(part, "run_id", "left")
    r = F.col("result")
    known = r.isNotNull()
    own = r["usage"]
    some = F.coalesce(
        own["input_tokens"], own["cache_read_input_tokens"], own["cache_creation_input_tokens"], own["output_tokens"]
    ).isNotNull()
    whole = usage_of_models(r["modelUsage"])
    from_own = F.when(
        some,
        usage_struct(
            _zero(own["input_tokens"]),
            _zero(own["cache_read_input_tokens"]),
            _zero(own["cache_creation_input_tokens"]),
            _zero(own["output_tokens"]),
            own["output_tokens_details"]["thinking_tokens"],
        ),
    )
    usage = F.when(known, F.coalesce(whole, from_own)).otherwise(F.col("partial"))
    searched = F.aggregate(
        F.map_values(r["modelUsage"]), F.lit(0).cast("bigint"), lambda a, v: a + _zero(v["webSearchRequests"])
    )
    searches = F.when(~known, _zero(F.col("partial_searches"))).when(whole.isNotNull(), searched).when(
        some, _zero(own["server_tool_use"]["web_search_requests"])
    ).otherwise(F.lit(0).cast("bigint"))
    empty_map = F.create_map().cast("map<string,bigint>")
    web = F.coalesce("web_actions", empty_map)
    rejected = F.coalesce(F.col("plan_window.rejected_seen"), F.lit(False))
    status = r["api_error_status"]
    told = F.concat(
        F.coalesce(r["result"], F.lit("")), F.array_join(F.coalesce(r["errors"], F.array().cast("array<string>")), " ")
    )
    transient = F.coalesce(status.isin(*TRANSIENT_STATUS), F.lit(False))
    bad = known & (F.coalesce(r["subtype"], F.lit("")) != "error_max_turns") & (
        (F.coalesce(r["subtype"], F.lit("")) != "success") | F.coalesce(r["is_error"], F.lit(False))
    )
    plan = F.coalesce(status == 429, F.lit(False)) | rejected | (~transient & told.rlike(PLAN_TEXT))
    word = F.coalesce(status.cast("string"), F.lit("text"))
    ending = F.when(~known & rejected, F.lit("usage_limit:rate_limit_event")).when(bad & plan, F.concat(F.lit("usage_limit:"), word)).when(
        bad & (transient | told.rlike(INFRA_TEXT)), F.concat(F.lit("api_error:"), word)
    )
    quota_ = F.col("quota")
    infra = F.when(stops(quota_), quota_).when(stops(ending), ending).otherwise(F.coalesce(quota_, ending))
    incomplete = F.when(~known, F.lit("no_result")).when(
        bad & ending.isNull(), F.concat(F.lit("result:"), F.coalesce(F.nullif(r["subtype"], F.lit("")), F.lit("error")))
    ).when(known & usage.isNull(), F.lit("no_usage"))
    return out.select(
        "run_id", usage.alias("usage"), "model", "cli_version", "api_key_source", "init_tools", "model_calls", "compactions", F.coalesce("tool_calls", empty_map).alias("tool_calls"),
        F.when(
            searches > 0,
            F.map_from_entries(
                F.array_sort(F.map_entries(F.map_concat(web, F.create_map(F.lit("server_searches"), searches))))
            ),
        ).otherwise(web).alias("web_actions"), F.coalesce(
            "web_urls", F.array().cast("array<string>")
        ).alias("web_urls"),
        F.coalesce(
            "truncated_calls", F.array().cast("array<struct<call_id:string,tool:string,original_tokens:bigint>>")
        ).alias("truncated_calls"), F.coalesce(
            F.size("truncated_calls"), F.lit(0)
        ).cast("bigint").alias("truncations"), _zero(F.col("paged_results")).alias("paged_results"),
        F.coalesce("mcp_servers", F.create_map().cast("map<string,string>")).alias("mcp_servers"), F.coalesce(
            F.nullif(r["result"], F.lit("")), F.col("last_text"), F.lit("")
        ).alias("answer"),
        F.when(
            ~known & F.col("partial").isNotNull(),
            F.concat("errors", F.array(F.lit("partial usage from assistant messages; output is a placeholder"))),
        ).otherwise(F.col("errors")).alias("errors"),
        infra.alias("infra_reason"), incomplete.alias("incomplete_reason"), F.coalesce(
            r["subtype"] == "error_max_turns", F.lit(False)
        ).alias("turn_limit"), r["num_turns"].alias("num_turns"), r["total_cost_usd"].alias("client_cost_usd"), r["modelUsage"].alias("model_usage"), "plan_window",
    )


def rollout_violations(
    arm: Column, servers: Column, tools: Column, server: str = "archive", pseudo: str = "codex"
) -> Column:
    """Sorted distinct reasons why a run used what its arm may not use. Arms: web, archive, both."""
    with_server = arm.isin("archive", "both")
    state = F.try_element_at(servers, F.lit(server))
    link = F.when(
        with_server & (F.coalesce(state, F.lit("")) != "connected"),
        F.array(F.concat(F.lit(f"{server} server not connected ("), F.coalesce(state, F.lit("unseen")), F.lit(")"))),
    )
    others = F.transform(
        F.filter(F.map_keys(servers), lambda n: (n != server) | (arm == "web")),
        lambda n: F.concat(F.lit("server "), n, F.lit(" loaded outside the arm's list")),
    )
    own = [f"mcp:{pseudo}.{t}" for t in RESOURCE_TOOLS]
    bad = lambda t: (
        t.startswith("mcp:") & ((arm == "web") | ~(t.startswith(f"mcp:{server}.") | t.isin(*own)))
    ) | t.isin("shell", "file_change") | t.startswith("ext:")
    wrong = F.transform(
        F.filter(F.map_keys(tools), bad), lambda t: F.concat(F.lit("tool "), t, F.lit(" outside the arm's list"))
    )
    web = F.when(
        (arm == "archive") & F.map_contains_key(tools, "web.search"), F.array(F.lit("web search in an arm without it"))
    )
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(link, none), others, wrong, F.coalesce(web, none))))


def stream_violations(
    arm: Column, servers: Column, tools: Column, init_tools: Column, server: str = "archive"
) -> Column:
    with_server, with_web = arm.isin("archive", "both"), arm.isin("web", "both")
    ok = lambda t: (
        with_server & (t.startswith(f"mcp__{server}__") | t.isin(*STREAM_RESOURCE_TOOLS))
    ) | (with_web & t.isin(*STREAM_WEB_TOOLS)) | t.isin(*NEUTRAL_TOOLS)
    none = F.array().cast("array<string>")
    start = F.when(init_tools.isNull(), F.array(F.lit("no init event"))).otherwise(
        F.transform(
            F.filter(init_tools, lambda t: ~ok(t)),
            lambda t: F.concat(F.lit("tool "), t, F.lit(" outside the arm's list")),
        )
    )
    used = F.transform(
        F.filter(F.map_keys(tools), lambda t: ~ok(t)),
        lambda t: F.concat(F.lit("tool "), t, F.lit(" used outside the arm's list")),
    )
    state = F.try_element_at(servers, F.lit(server))
    link = F.when(
        with_server & (F.coalesce(state, F.lit("")) != "connected"),
        F.array(F.concat(F.lit(f"{server} server not connected ("), F.coalesce(state, F.lit("unseen")), F.lit(")"))),
    )
    others = F.transform(
        F.filter(F.map_keys(servers), lambda n: (n != server) | (arm == "web")),
        lambda n: F.concat(F.lit("server "), n, F.lit(" loaded outside the arm's list")),
    )
    return F.array_sort(F.array_distinct(F.concat(start, used, F.coalesce(link, none), others)))


def classify(
    violations: Column,
    infra: Column,
    timed_out: Column,
    turn_limit: Column,
    incomplete: Column,
    exit_code: Column,
    answer: Column,
) -> Column:
    """struct(status, status_reason): the first rule that holds."""
    pair = lambda s, why: F.struct(F.lit(s).alias("status"), why.cast("string").alias("status_reason"))
    return (
        F.when(
            F.size(violations) > 0, pair("invalid", F.concat(F.lit("arm_isolation: "), F.array_join(violations, "; ")))
        )
        .when(infra.isNotNull(), pair("infra_error", infra))
        .when(timed_out, pair("timeout", F.lit("wall time limit")))
        .when(turn_limit, pair("turn_limit", F.lit("max turns reached")))
        .when(incomplete.isNotNull(), pair("incomplete", incomplete))
        .when(
            F.coalesce(exit_code, F.lit(0)) != 0, pair("incomplete", F.concat(F.lit("exit "), exit_code.cast("string")))
        )
        .when(F.trim(F.coalesce(answer, F.lit(""))) == "", pair("incomplete", F.lit("no_answer")))
        .otherwise(pair("completed", F.lit(None)))
    )


def fold_side_logs(extraction: DataFrame, stdout: DataFrame, stderr: DataFrame) -> DataFrame:
    """Start-up states and failures that only the client's output tells.

    stdout: (run_id, ord, raw) JSON lines; stderr: (run_id, text). Later feeds win for the state of a server; the first
    stopping reason over all feeds wins; a reason for being incomplete stays if there was one.
    """
    kind = "type string, server string, status string, ready array<string>, failed array<string>, cancelled array<string>"
    j = stdout.select(
        "run_id",
        "ord",
        F.from_json("raw", kind).alias("a"),
        F.from_json(F.get_json_object("raw", "$.msg"), kind).alias("b"),
        F.from_json(
            "raw",
            "type string, message string, codex_error_info string, error struct<message:string,codex_error_info:string>",
        ).alias("e"),
    )
    states = server_states(
        j.select("run_id", "ord", F.col("a").alias("p")).unionByName(
            j.select("run_id", "ord", F.col("b").alias("p"))
        ).where("p IS NOT NULL")
    )
    lost = stderr.select(
        "run_id",
        F.explode(
            F.regexp_extract_all("text", F.lit(r"MCP (?:client|server) for `?([\w-]+)`? failed"), F.lit(1))
        ).alias("server"),
    ).distinct().withColumn("state", F.lit("failed"))
    states = states.join(lost, ["run_id", "server"], "left_anti").unionByName(lost)
    states = states.groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("server", "state")))).alias("_states")
    )
    e = F.col("e")
    message, code = F.coalesce(e["error"]["message"], e["message"], F.lit("")), F.coalesce(
        e["error"]["codex_error_info"], e["codex_error_info"], F.lit("")
    )
    bad = j.where(e["type"].isin("turn.failed", "error")).select(
        "run_id",
        "ord",
        error_reason(code, message).alias("reason"),
        F.concat(e["type"], F.lit(": "), F.substring(message, 1, 120)).alias("why"),
    )
    bad = bad.groupBy("run_id").agg(
        merge_reasons(F.col("reason"), F.struct("ord")).alias("_infra"),
        F.min_by("why", F.when(F.col("reason").isNull(), F.col("ord"))).alias("_why"),
    )
    out = extraction.join(states, "run_id", "left").join(bad, "run_id", "left")
    kept = F.map_filter("mcp_servers", lambda k, _: ~F.coalesce(F.map_contains_key("_states", k), F.lit(False)))
    infra = F.when(
        stops(F.col("infra_reason")), F.col("infra_reason")
    ).when(stops(F.col("_infra")), F.col("_infra")).otherwise(F.coalesce("infra_reason", "_infra"))
    return out.withColumns(
        {
            "mcp_servers": F.when(
                F.col("_states").isNotNull(), F.map_concat(kept, F.col("_states"))
            ).otherwise(F.col("mcp_servers")),
            "infra_reason": infra,
            "incomplete_reason": F.coalesce("incomplete_reason", "_why"),
        }
    ).drop("_states", "_infra", "_why")


def log_problem(extraction: DataFrame, ended: str, success: str | None = None) -> DataFrame:
    """run_id -> why a log cannot back a table of sources; null if it can."""
    problem = F.when(~F.col(ended), F.lit("no end of the task in the log"))
    if success:
        problem = F.when(
            F.col(success).isNotNull() & (F.col(success) != "success"),
            F.concat(F.lit("result not success ("), F.col(success), F.lit(")")),
        ).otherwise(problem)
    return extraction.select(
        "run_id", F.coalesce(problem, F.when(F.col("usage").isNull(), F.lit("no usage in the log"))).alias("problem")
    )


def run_records(extraction: DataFrame, meta: DataFrame, cost: DataFrame, hits: DataFrame) -> DataFrame:
    """Extraction, what was asked for, cost and forbidden hits as one run record."""
    found = hits.select("run_id", (F.size("hits") > 0).alias("contaminated"))
    out = meta.join(extraction, "run_id", "left").join(cost, "run_id", "left").join(found, "run_id", "left")
    return out.withColumn("contaminated", F.coalesce("contaminated", F.lit(False))).withColumn(
        "run_key",
        F.concat_ws(".", "agent", "arm", "question_id", F.concat(F.lit("r"), F.col("repetition").cast("string"))),
    )


def window_percents(window: Column) -> Column:
    """(name, percent) of each window of either dialect; utilisation is a fraction."""
    fixed = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"), window[n]["used_percent"].alias("percent")
            ) for n in ("primary", "secondary")
        ]
    )
    named = F.transform(
        F.map_entries(window["windows"]),
        lambda e: F.struct(e["key"].alias("name"), (e["value"] * 100).alias("percent")),
    )
    both = F.concat(fixed, F.coalesce(named, F.array().cast("array<struct<name:string,percent:double>>")))
    return F.filter(both, lambda x: x["percent"].isNotNull())


def guard_notes(notes: Column, prefix: str = "guard:") -> Column:
    """Distinct parts of the notes that a guard wrote."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.filter(notes, lambda n: n.startswith(prefix)),
                lambda n: F.split(F.substring(n, F.lit(len(prefix) + 1), F.length(n)), "; "),
            )
        )
    )


def latest_reading(*feeds: DataFrame) -> DataFrame:
    """The newest reading per account over several feeds (account, observed_at, reading)."""
    rows = feeds[0]
    for f in feeds[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    return rows.groupBy("account").agg(
        F.max("observed_at").alias("observed_at"), F.max_by("reading", "observed_at").alias("reading")
    )


def without_accounts(
    raw: Column, keys: tuple[str, ...] = ("email", "account_id", "accountId", "organization", "user_id", "userId")
) -> Column:
    """JSON text without account identifiers at any depth (their members are cut out)."""
    out = raw
    for k in keys:
        out = F.regexp_replace(out, rf'"{k}"\s*:\s*("(?:[^"\\]|\\.)*"|[^,}}\]]+)\s*,?', "")
    return F.regexp_replace(out, r",\s*}", "}")


def probe_reading(logs: DataFrame, observed: Column) -> DataFrame:
    """The plan reading of a probe's log (run_id as account): its window without account identifiers, when it was seen."""
    return stream_window(stream_events(logs)).select(
        F.col("run_id").alias("account"), observed.alias("observed_at"), F.col("plan_window").alias("reading")
    )


def metered_signs(window: Column, limit: float = 100.0) -> Column:
    """Signs that a run was billed beyond its plan: overage in use, a limit reached, credits drawn, a window used up."""
    c = window["credits"]
    drawn = c["balance_first"].try_cast("double") > c["balance_min"].try_cast("double")
    full = F.exists(window_percents(window), lambda x: x["percent"] >= limit)
    signs = (
        (window["is_using_overage"], "overage in use"),
        (window["rate_limit_reached_seen"].isNotNull(), "limit reached"),
        (drawn, "credits drawn"),
        (window["rejected_seen"], "rejected"),
        (full, "window used up"),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(s, F.lit(False)), F.lit(n)) for s, n in signs]))
