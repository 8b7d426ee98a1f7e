"""Further queries: logs, grids, corrections, shards and work lists over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import extraction, provenance, runs, sampling, stats, validation, verdicts

from .registry import KEYS, RUNS, draws_sql, event_runs, query, r6, table

# --- logs made of tables ------------------------------------------------------------------------------


def _rollout_logs(spark, sf_dir: str) -> DataFrame:
    """Events as rollout records of one run a user: readings, tool calls, searches, model calls and errors."""
    e, i, v = table(spark, sf_dir, "events"), F.col("event_id"), F.col("value")
    wrap = lambda kind, *parts: F.struct(
        F.lit("event_msg").alias("type"), F.struct(F.lit(kind).alias("type"), *parts).alias("payload")
    )
    total = F.struct(
        F.struct(
            (i * 2).alias("input_tokens"),
            i.alias("cached_input_tokens"),
            F.lit(3).alias("output_tokens"),
            (i * 2 + 3).alias("total_tokens"),
        ).alias("total_token_usage")
    ).alias("info")
    tool = F.struct(
        F.lit("McpToolCall").alias("type"),
        F.when(i % 2 == 0, "archive").otherwise("other").alias("server"),
        F.lit("find").alias("tool"),
        F.lit("completed").alias("status"),
        F.lit("{}").alias("result"),
    ).alias("item")
    search = F.struct(
        F.lit("Extension").alias("type"),
        F.lit("web.search").alias("kind"),
        F.struct(
            F.when(i % 3 == 0, "openPage").otherwise("search").alias("type"),
            F.concat(F.lit("https://h.example/"), (i % 7).cast("string")).alias("url"),
        ).alias("action"),
    ).alias("item")
    message = F.when(i % 3 == 0, "usage limit reached").otherwise("overloaded").alias("message")
    raw = (
        F.when(F.col("event_type") == "view", F.to_json(wrap("token_count", total)))
        .when(F.col("event_type") == "purchase", F.to_json(wrap("item_completed", tool)))
        .when(F.col("event_type") == "click", F.to_json(wrap("item_completed", search)))
        .when(F.col("event_type") == "error", F.to_json(wrap("error", message)))
        .otherwise(
            F.to_json(
                F.struct(
                    F.lit("token_usage_record").alias("type"),
                    F.struct(F.struct(v.cast("bigint").alias("input_tokens")).alias("usage")).alias("payload"),
                )
            )
        )
    )
    return e.select(F.col("user_id").alias("run_id"), i.alias("ord"), raw.alias("raw"))


@query("""SELECT user_id AS run_id, arg_max(event_id, event_id) FILTER (WHERE event_type = 'view') * 2 + 3 AS total, arg_max(event_id, event_id)
 FILTER (WHERE event_type = 'view') AS uncached, count(*) FILTER (WHERE event_type = 'signup') AS model_calls,
 count(*) FILTER (WHERE event_type = 'purchase' AND event_id % 2 = 0) AS archive_calls, count(*) FILTER (WHERE event_type = 'click') AS
 searches, count(*) FILTER (WHERE event_type = 'click' AND event_id % 3 = 0) AS opened,
 CASE WHEN bool_or(event_type = 'error' AND event_id % 3 = 0) THEN 'usage_limit_exceeded' WHEN bool_or(event_type = 'error') THEN
 'server_overloaded' END AS infra_reason FROM events GROUP BY ALL""")
def rollout_extraction(spark, sf_dir):
    x = extraction.rollout_extraction(_rollout_logs(spark, sf_dir))
    get = lambda m, k: F.coalesce(F.try_element_at(F.col(m), F.lit(k)), F.lit(0))
    return x.select(
        "run_id",
        F.col("usage.total").alias("total"),
        F.col("usage.uncached_input").alias("uncached"),
        "model_calls",
        get("tool_calls", "mcp:archive.find").alias("archive_calls"),
        get("tool_calls", "web.search").alias("searches"),
        get("web_actions", "openPage").alias("opened"),
        "infra_reason",
    )


@query("""SELECT user_id AS run_id, CASE WHEN event_type = 'click' THEN 'opened' ELSE 'archive' END AS kind, CASE WHEN event_type = 'click' THEN
 'https://h.example/' || (event_id % 7) ELSE 'call:' || event_id END AS key, min(event_id) AS "order" FROM events
 WHERE (event_type = 'click' AND event_id % 3 = 0) OR (event_type = 'purchase' AND event_id % 2 = 0) GROUP BY ALL""")
def rollout_sources(spark, sf_dir):
    return provenance.rollout_sources(_rollout_logs(spark, sf_dir)).select("run_id", "kind", "key", "order")


@query("""WITH a AS (SELECT conv_id, turn, turn // 2 AS mid, length(text) AS size FROM conversations WHERE role = 'assistant'), l AS (SELECT
 conv_id, mid, arg_max(size, turn) AS u FROM a GROUP BY ALL), t AS (SELECT conv_id, sum(u) AS input, count(*) AS model_calls FROM l GROUP BY
 ALL)
 SELECT c.conv_id AS run_id, CAST(input AS BIGINT) AS input, coalesce(model_calls, 0) AS model_calls, count(*) FILTER (WHERE role =
 'system') AS compactions, 'no_result' AS incomplete_reason FROM conversations c LEFT JOIN t USING (conv_id) GROUP BY ALL HAVING input IS
 NOT NULL""")
def stream_extraction(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    made = F.struct(
        F.lit("assistant").alias("type"),
        F.struct(
            F.concat(F.lit("m"), F.floor(F.col("turn") / 2).cast("string")).alias("id"),
            F.struct(F.length("text").alias("input_tokens"), F.lit(0).alias("output_tokens")).alias("usage"),
            F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content"),
        ).alias("message"),
    )
    raw = F.when(F.col("role") == "assistant", F.to_json(made)).when(
        F.col("role") == "system", F.lit('{"type": "system", "subtype": "compact_boundary"}')
    ).otherwise(F.lit('{"type": "user"}'))
    x = extraction.stream_extraction(
        c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("ord"), raw.alias("raw"))
    )
    return x.where("usage IS NOT NULL").select(
        "run_id", F.col("usage.input").alias("input"), "model_calls", "compactions", "incomplete_reason"
    )


@query("""WITH s AS (SELECT user_id AS run_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'cancelled' ELSE
 'connected' END AS state, 's' || (event_id % 4) AS server, event_id FROM events WHERE event_type IN ('error', 'signup', 'view')) SELECT
 run_id, server, arg_max(state, event_id) AS state FROM s GROUP BY ALL""")
def server_states(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup", "view"))
    server, none = F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")), F.array().cast("array<string>")
    lists = [
        F.when(F.col("event_type") == t, F.array(server)).otherwise(none).alias(n) for t, n in (
            ("view", "ready"), ("error", "failed"), ("signup", "cancelled")
        )
    ]
    p = F.struct(
        F.lit("mcp_startup_complete").alias("type"),
        F.lit(None).cast("string").alias("server"),
        F.lit(None).cast("string").alias("status"),
        *lists,
    )
    return extraction.server_states(
        e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), p.alias("p"))
    )


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) SELECT o_custkey AS run_id,
 sum(o_totalprice) FILTER (WHERE n = 1) AS balance, arg_min(o_totalprice, o_orderkey) AS balance_first, min(o_totalprice) AS balance_min
 FROM l GROUP BY ALL""")
def credit_balances(spark, sf_dir):
    window = "struct<used_percent:double,window_minutes:bigint,resets_at:bigint>"
    none = F.lit(None).cast("string")
    limits = F.struct(
        none.alias("limit_id"),
        none.alias("plan_type"),
        F.lit(None).cast(window).alias("primary"),
        F.lit(None).cast(window).alias("secondary"),
        F.struct(
            F.lit(True).alias("has_credits"),
            F.lit(False).alias("unlimited"),
            F.col("o_totalprice").cast("string").alias("balance"),
        ).alias("credits"),
        none.alias("rate_limit_reached_type"),
    )
    p = F.struct(F.lit("token_count").alias("type"), limits.alias("rate_limits"))
    w = extraction.credit_window(
        table(spark, sf_dir, "orders").select(
            F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("ord"), p.alias("p")
        )
    )
    return w.select(
        "run_id",
        *[
            F.col(f"plan_window.credits.{c}").cast("double").alias(c) for c in (
                "balance", "balance_first", "balance_min"
            )
        ],
    )


# --- grids and plans ----------------------------------------------------------------------------------------


METRIC = """CASE any_value(p.metric) WHEN 'token_ratio_baseline_over_arm' THEN CASE WHEN sum(p.b) = 0 THEN CAST('inf' AS DOUBLE) ELSE sum(p.a) / sum(p.b) END ELSE avg(p.b - p.a) END"""


def _grid_sql(rows: str, *keys: str) -> str:
    """SQL of the whole grid over `rows` (keys, stratum, arm, question_id, total_tokens, accuracy, completion)."""
    key = ", ".join(keys)
    own = ", ".join(f"a.{k}" for k in keys)
    cell = f"{key}, metric, arm, baseline"
    draws = draws_sql("pairs", cell, METRIC)
    return f"""{rows}, pairing(arm, baseline) AS (VALUES ('archive', 'web'), ('both', 'web'), ('both', 'archive')),
 v AS (SELECT *, 'token_ratio_baseline_over_arm' AS metric, CAST(total_tokens AS DOUBLE) AS x FROM judged UNION ALL SELECT *,
 'accuracy_diff_arm_minus_baseline', accuracy FROM judged UNION ALL SELECT *, 'completion_diff_arm_minus_baseline', completion FROM judged),
 m AS (SELECT {key}, metric, arm, question_id, avg(x) AS mean FROM v WHERE x IS NOT NULL GROUP BY ALL),
 pairs AS (SELECT {own}, a.metric, t.arm, t.baseline, a.question_id, a.mean AS a, b.mean AS b FROM pairing t JOIN m a ON a.arm = t.baseline
 JOIN m b ON b.arm = t.arm AND a.metric = b.metric AND a.question_id = b.question_id AND {" AND ".join(f"a.{k} = b.{k}" for k in keys)}),
 {draws}, seen AS (SELECT DISTINCT {key}, metric, question_id FROM v),
 gone AS (SELECT {key}, metric, t.arm, t.baseline, array_to_string(list_sort(list(question_id)), ',') AS dropped FROM seen, pairing t WHERE
 NOT EXISTS (SELECT 1 FROM pairs p WHERE {" AND ".join(f"p.{k} = seen.{k}" for k in keys)} AND p.metric = seen.metric AND p.question_id =
 seen.question_id AND p.arm = t.arm AND p.baseline = t.baseline) GROUP BY ALL),
 told AS (SELECT {cell}, estimate, low, high, n_questions FROM whole JOIN ends USING ({cell}) WHERE estimate IS NOT NULL)
 SELECT {cell}, round(estimate, 6) AS estimate, round(low, 6) AS ci_low, round(high, 6) AS ci_high, n_questions, dropped FROM told FULL JOIN
 gone USING ({cell})"""


def _grid(grid: DataFrame, *keys: str) -> DataFrame:
    return grid.select(
        *keys,
        "metric",
        "arm",
        "baseline",
        *[r6(c).alias(c) for c in ("estimate", "ci_low", "ci_high")],
        "n_questions",
        F.array_join("dropped_questions", ",").alias("dropped"),
    )


JUDGED = "judged AS (SELECT agent, stratum, arm, CAST(question_id AS VARCHAR) AS question_id, total_tokens, accuracy, completion FROM runs)"
TWO_JUDGES = """judged AS (SELECT agent, 'A' AS judge, stratum, arm, CAST(question_id AS VARCHAR) AS question_id, total_tokens, accuracy, completion FROM
 runs
 UNION ALL SELECT agent, 'B', stratum, arm, CAST(question_id AS VARCHAR), total_tokens, completion, accuracy FROM runs)"""


@query(f"WITH {RUNS}, " + _grid_sql(JUDGED, "agent", "stratum"))
def comparison_grid(spark, sf_dir):
    rows = event_runs(spark, sf_dir).withColumn("question_id", F.col("question_id").cast("string"))
    return _grid(stats.comparison_grid(rows), "agent", "stratum")


@query(f"WITH {RUNS}, " + _grid_sql(TWO_JUDGES, "agent", "judge", "stratum"))
def single_judge_grid(spark, sf_dir):
    rows = event_runs(spark, sf_dir).withColumn("question_id", F.col("question_id").cast("string"))
    return _grid(
        stats.single_judge_grid(rows, {"A": ("accuracy", "completion"), "B": ("completion", "accuracy")}),
        "agent",
        "judge",
        "stratum",
    )


@query("""SELECT n_nationkey AS q_ord, arm, repetition FROM nation, (VALUES ('web'), ('archive'), ('both')) a(arm), (VALUES (1), (2), (3))
 r(repetition)""")
def planned_cells(spark, sf_dir):
    return runs.plan_cells(
        table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("q_ord")), ["web", "archive", "both"], 3
    ).select("q_ord", "arm", "repetition")


@query(f"""WITH {RUNS}, c AS (SELECT agent, stratum, arm, avg(total_tokens) AS t, avg(accuracy) AS a FROM runs GROUP BY ALL) SELECT agent, stratum,
 arm, 'tokens' AS metric, round(t, 6) AS estimate FROM c WHERE t IS NOT NULL UNION ALL SELECT agent, stratum, arm, 'accuracy', round(a, 6)
 FROM c WHERE a IS NOT NULL""")
def comparison_rows(spark, sf_dir):
    c = event_runs(spark, sf_dir).groupBy(*KEYS[:3]).agg(
        *[
            F.struct(r6(F.avg(v)).alias("estimate")).alias(n) for n, v in (
                ("tokens", "total_tokens"), ("accuracy", "accuracy")
            )
        ]
    )
    return runs.comparison_rows(c, ["tokens", "accuracy"]).where("estimate IS NOT NULL")


@query("""WITH f AS (SELECT l_orderkey % 200 AS question_id, count(DISTINCT l_partkey) AS filings FROM lineitem GROUP BY ALL), r AS (SELECT
 event_id % 200 AS question_id, event_type AS arm, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS t FROM events)
 SELECT question_id, arm, coalesce(filings, 0) AS distinct_key_filings, count(*) AS runs, count(t) AS completed_reps, round(avg(t), 6) AS
 mean_total_tokens FROM r LEFT JOIN f USING (question_id) GROUP BY ALL""")
def multi_period(spark, sf_dir):
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        (i % 200).alias("question_id"),
        F.col("event_type").alias("arm"),
        F.lit("x").alias("agent"),
        F.lit("multi_period").alias("stratum"),
        F.when(i % 5 != 0, F.col("value")).alias("total_tokens"),
        F.lit(1.0).alias("accuracy"),
    )
    facts = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 200).alias("question_id"),
        F.struct(F.col("l_partkey").cast("string").alias("filing_uuid")).alias("source"),
    )
    return runs.multi_period(rows, facts).select(
        "question_id",
        "arm",
        "distinct_key_filings",
        "runs",
        "completed_reps",
        r6("mean_total_tokens").alias("mean_total_tokens"),
    )


# --- verdicts and corrections ------------------------------------------------------------------------------------


def _maps(spark, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "labels").select(
        F.floor(F.col("doc_id") / 10).alias("run_id"),
        (F.col("doc_id") % 10).cast("string").alias("f"),
        F.when(F.col("quality") == 1, "adopted").otherwise("rejected").alias("a"),
        F.when(F.col("toxic") == 1, "rejected").otherwise("adopted").alias("b"),
    )
    return v.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("f", "a"))).alias("a"),
        F.map_from_entries(F.collect_list(F.struct("f", "b"))).alias("b"),
    )


@query("SELECT CAST(doc_id // 10 AS BIGINT) AS run_id, round(avg(quality), 6) AS adoption FROM labels GROUP BY ALL")
def trap_adoption(spark, sf_dir):
    return _maps(spark, sf_dir).select(
        F.col("run_id").cast("bigint").alias("run_id"), r6(verdicts.trap_adoption(F.col("a"))).alias("adoption")
    )


@query("""SELECT CAST(doc_id // 10 AS BIGINT) AS run_id, count(*) FILTER (WHERE doc_id % 10 <> 3) AS shared, count(*) FILTER (WHERE doc_id % 10 <>
 3 AND (quality = 1) = (toxic = 0)) AS stable FROM labels GROUP BY ALL""")
def regrade_stability(spark, sf_dir):
    out = _maps(spark, sf_dir).select(
        F.col("run_id").cast("bigint").alias("run_id"),
        verdicts.regrade_stability(F.col("a"), F.col("b"), F.array(F.lit("3"))).alias("s"),
    )
    return out.select(
        "run_id", F.col("s.shared").cast("bigint").alias("shared"), F.col("s.stable").cast("bigint").alias("stable")
    )


@query("""SELECT CAST(doc_id // 10 AS BIGINT) AS run_id, round(avg(CASE WHEN doc_id % 10 = 4 THEN 0.25 ELSE quality END), 6) AS accuracy FROM
 labels GROUP BY ALL""")
def audited_accuracy(spark, sf_dir):
    scores = F.transform_values("a", lambda _, v: F.when(v == "adopted", 1.0).otherwise(0.0))
    fixed = verdicts.audited_scores(scores, F.create_map(F.lit("4"), F.lit(0.25), F.lit("99"), F.lit(0.0)))
    return _maps(spark, sf_dir).select(
        F.col("run_id").cast("bigint").alias("run_id"), r6(verdicts.mean_score(fixed)).alias("accuracy")
    )


@query("""SELECT p_partkey AS fact_id, CASE WHEN s_suppkey IS NOT NULL AND s_suppkey % 2 = 0 THEN 'fixed' ELSE p_name END AS statement, CASE WHEN
 s_suppkey IS NOT NULL AND s_suppkey % 2 = 1 THEN '0' ELSE p_type END AS value FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""")
def corrected_facts(spark, sf_dir):
    source = "struct<filing_uuid:string,chunk_id:string,permalink:string,exchange_document_id:string,document_id_absent_reason:string,quote:string,symbol:string>"
    none = {
        "unit": F.lit(None).cast("string"),
        "accept": F.lit(None).cast("array<string>"),
        "source": F.lit(None).cast(source),
    }
    facts = table(spark, sf_dir, "part").select(
        F.lit("q").alias("question_id"),
        F.col("p_partkey").alias("fact_id"),
        F.col("p_name").alias("statement"),
        F.col("p_type").alias("value"),
    ).withColumns(none)
    k = F.col("s_suppkey")
    fields = F.struct(
        F.when(k % 2 == 0, F.lit("fixed")).alias("statement"),
        F.when(k % 2 == 1, F.lit("0")).alias("value"),
        *[c.alias(n) for n, c in none.items()],
    )
    known = table(spark, sf_dir, "supplier").join(
        facts.select(F.col("fact_id").alias("s_suppkey")), "s_suppkey", "left_semi"
    )
    fix = known.select(F.lit("q").alias("question_id"), k.alias("fact_id"), fields.alias("fields"))
    return validation.apply_corrections(facts, fix).select("fact_id", "statement", "value")


@query("""SELECT doc_id AS fact_id, CASE WHEN doc_id % 5 = 0 THEN 'quote not in the passage' ELSE 'another permalink' END AS rule FROM documents
 WHERE (doc_id % 5 = 0 AND length(text) > 0) OR doc_id % 7 = 0 AND doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'another permalink' FROM
 documents WHERE doc_id % 5 = 0 AND length(text) > 0 AND doc_id % 7 = 0""")
def quote_checks(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    link = F.concat(F.lit("p"), i.cast("string"))
    passages = d.select(
        i.cast("string").alias("chunk_id"),
        "text",
        F.lit("f").alias("filing_uuid"),
        F.when(i % 7 == 0, F.lit("other")).otherwise(link).alias("permalink"),
        F.lit("x").alias("exchange_document_id"),
    )
    facts = d.select(
        i.alias("fact_id"),
        F.lit("sourced").alias("kind"),
        F.struct(
            i.cast("string").alias("chunk_id"),
            F.lit("f").alias("filing_uuid"),
            link.alias("permalink"),
            F.lit("x").alias("exchange_document_id"),
            F.when(i % 5 == 0, F.lit("☃ never there")).otherwise(F.substring("text", 3, 30)).alias("quote"),
        ).alias("source"),
    )
    return validation.verify_quotes(facts, passages).select(F.col("subject").cast("bigint").alias("fact_id"), "rule")


# --- work lists -----------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS item FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS batches, bool_or(o_orderstatus = 'F') AS ok FROM orders
 WHERE o_totalprice > 400000 GROUP BY ALL) ON o_custkey = c_custkey WHERE batches IS NULL OR (NOT ok AND batches < 2)""")
def needs_work(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("item")).agg(
        F.count(F.lit(1)).alias("batches"),
        F.when(F.bool_or(F.col("o_orderstatus") == "F"), "ok").otherwise("error").alias("status"),
    )
    return runs.needs_work(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item")), done, "item")


@query("""WITH b AS (SELECT l_orderkey AS batch, l_linenumber AS item, l_orderkey % 3 = 0 AS bad FROM lineitem), i AS (SELECT DISTINCT CAST(batch
 AS VARCHAR) || '-' || item AS item, bad FROM b) SELECT item, CASE WHEN bad THEN 'error' ELSE 'ok' END AS status, CASE WHEN bad THEN NULL
 ELSE 'L' END AS label FROM i""")
def fan_out(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch")).agg(
        F.collect_set(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        ).alias("items")
    )
    bad = F.col("batch") % 3 == 0
    rows = rows.select(
        "batch",
        "items",
        F.when(bad, F.lit("failed")).alias("error"),
        F.when(~bad, F.map_from_arrays("items", F.transform("items", lambda _: F.lit("L")))).alias("labels"),
    )
    prior = spark.createDataFrame([], "item string, status string, error string, label string, batches bigint")
    return runs.fan_out(rows, prior).select("item", "status", "label")


@query("""SELECT doc_id AS row_id, CASE WHEN doc_id % 11 = 0 THEN 'pending' WHEN doc_id % 7 = 0 THEN 'failed' WHEN quality = toxic THEN 'agree'
 ELSE 'disputed' END AS state FROM labels""")
def check_states(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(
        i.alias("row_id"),
        F.when(i % 11 != 0, F.when(i % 7 == 0, "error").otherwise("ok")).alias("status"),
        F.col("quality").alias("verdict"),
        F.col("toxic").alias("effective"),
    )
    return runs.partition_checks(rows).select("row_id", "state")


@query("""SELECT id, bin FROM (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'confirmed' ELSE 'contradicted' END AS bin, row_number() OVER
 (PARTITION BY quality ORDER BY sha256('8105:' || doc_id)) AS n FROM labels) WHERE n <= CASE bin WHEN 'contradicted' THEN 30 ELSE 10 END""")
def audit_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "confirmed").otherwise("contradicted").alias("bin")
    )
    return sampling.audit_sample(rows, "id").select("id", "bin")


@query("""SELECT conv_id, turn, 'T' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS label FROM conversations""")
def ordinal_labels(spark, sf_dir):
    return sampling.labels(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", ["turn"], "T")


@query("""SELECT event_id AS run_id, 'primary' AS name, value AS percent FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'five_hour',
 value / 10 * 100 FROM events WHERE event_id % 2 = 1""")
def window_percents(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    w = F.struct(
        F.struct(F.when(i % 2 == 0, v).alias("used_percent")).alias("primary"),
        F.struct(F.lit(None).cast("double").alias("used_percent")).alias("secondary"),
        F.when(i % 2 == 1, F.create_map(F.lit("five_hour"), v / 10)).alias("windows"),
    )
    rows = table(spark, sf_dir, "events").select(i.alias("run_id"), w.alias("w"))
    return rows.select("run_id", F.explode(extraction.window_percents(F.col("w"))).alias("x")).select("run_id", "x.*")
