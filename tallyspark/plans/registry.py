"""All queries over the driver tables, by name, and DuckDB SQL for the same result.

The tables stand in for run data: events are runs (event type: arm, user: question), labels are verdicts of two judges,
lineitem rows are model calls, pages are sources, conversations are logs. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import numbers, secrets, text
from tallyspark.operators import extraction, provenance, runs, sampling, sets, shards, stats, validation, verdicts
from tallyspark.sources import readers
from tallyspark.streaming import runs as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c if not isinstance(c, str) else F.col(c), 6)


#: SQL of `text.fold` for the characters at hand.
_FOLDED = r"trim(regexp_replace(replace(lower(strip_accents({c})), 'ß', 'ss'), '\s+', ' ', 'g'))"

# --- runs ---------------------------------------------------------------------------------------

RUNS = """runs AS (SELECT event_id AS run_id, CASE event_type WHEN 'view' THEN 'web' WHEN 'click' THEN 'archive' WHEN 'purchase' THEN 'both' ELSE
 event_type END AS arm,
  CASE WHEN user_id % 2 = 0 THEN 'rollout' ELSE 'stream' END AS agent, CASE WHEN user_id % 6 = 5 THEN 'control' ELSE 's' || (user_id % 6)
 END AS stratum, user_id AS question_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS total_tokens,
  CASE event_id % 11 WHEN 0 THEN 'invalid' WHEN 1 THEN 'infra_error' WHEN 2 THEN 'timeout' WHEN 3 THEN 'turn_limit' ELSE 'completed' END AS
 status, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 5 AS DOUBLE) / 4 END AS accuracy, CASE WHEN event_id % 9 = 0 THEN NULL
 ELSE CAST(event_id % 2 AS DOUBLE) END AS completion,
  event_id % 2 AS compactions, event_id % 3 AS truncations, event_id % 4 + 1 AS attempt, event_id % 3 AS repetition, ts FROM events)"""


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    arm = F.coalesce(
        F.try_element_at(
            F.create_map(*[F.lit(x) for x in ("view", "web", "click", "archive", "purchase", "both")]),
            F.col("event_type"),
        ),
        F.col("event_type"),
    )
    status = F.coalesce(
        F.try_element_at(
            F.create_map(
                *[F.lit(x) for kv in enumerate(("invalid", "infra_error", "timeout", "turn_limit")) for x in kv]
            ),
            (i % 11).cast("int"),
        ),
        F.lit("completed"),
    )
    return e.select(
        i.alias("run_id"), arm.alias("arm"), F.when(u % 2 == 0, "rollout").otherwise("stream").alias("agent"), F.when(u % 6 == 5, "control").otherwise(
            F.concat(F.lit("s"), (u % 6).cast("string"))
        ).alias("stratum"), u.alias("question_id"), F.when(i % 13 != 0, F.col("value")).alias("total_tokens"),
        status.alias("status"), F.when(
            i % 7 != 0, (i % 5).cast("double") / 4
        ).alias("accuracy"), F.when(
            i % 9 != 0, (i % 2).cast("double")
        ).alias("completion"), (i % 2).alias("compactions"), (i % 3).alias("truncations"), (i % 4 + 1).alias("attempt"), (i % 3).alias("repetition"), "ts",
    )


def _pairs(rows: DataFrame, value: str) -> DataFrame:
    return stats.paired_all(rows, value)


PAIRED = RUNS + """, means AS (SELECT agent, stratum, arm, question_id, avg(total_tokens) AS mean FROM runs WHERE total_tokens IS NOT NULL GROUP BY ALL),
 pairing(arm, baseline) AS (VALUES ('archive', 'web'), ('both', 'web'), ('both', 'archive')),
 pairs AS (SELECT a.agent, a.stratum, p.arm, p.baseline, a.question_id, a.mean AS a, b.mean AS b FROM pairing p JOIN means a ON a.arm =
 p.baseline JOIN means b ON b.arm = p.arm AND a.agent = b.agent AND a.stratum = b.stratum AND a.question_id = b.question_id)"""
KEYS = ["agent", "stratum", "arm", "baseline"]


@query(f"""WITH {RUNS} SELECT agent, stratum, arm, question_id, round(avg(total_tokens), 6) AS mean FROM runs WHERE total_tokens IS NOT NULL GROUP
 BY ALL""")
def question_means(spark, sf_dir):
    return stats.question_means(event_runs(spark, sf_dir), "total_tokens").withColumn("mean", r6("mean"))


@query(f"""WITH {PAIRED} SELECT agent, stratum, arm, baseline, round(sum(a) / sum(b), 6) AS token_ratio, count(*) AS n_questions FROM pairs GROUP BY
 ALL""")
def token_ratio(spark, sf_dir):
    return _pairs(event_runs(spark, sf_dir), "total_tokens").groupBy(*KEYS).agg(
        r6(stats.token_ratio()).alias("token_ratio"), F.count(F.lit(1)).alias("n_questions")
    )


@query(
    f"WITH {PAIRED.replace('total_tokens', 'accuracy')} SELECT agent, stratum, arm, baseline, round(avg(b - a), 6) AS difference FROM pairs GROUP BY ALL".replace(
        "CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS accuracy,", ""
    )
)
def mean_difference(spark, sf_dir):
    return _pairs(event_runs(spark, sf_dir), "accuracy").groupBy(*KEYS).agg(
        r6(stats.mean_difference()).alias("difference")
    )


@query(f"""WITH {PAIRED}, short AS (SELECT * FROM pairs WHERE a < 1.05 * b) SELECT s.agent, s.stratum, p.arm, p.baseline,
 array_to_string(list_sort(list(CAST(s.question_id AS VARCHAR))), ',') AS dropped
 FROM (SELECT DISTINCT agent, stratum, question_id FROM runs) s JOIN (SELECT DISTINCT agent, stratum, arm, baseline FROM short) p USING
 (agent, stratum) LEFT JOIN short q ON q.agent = s.agent AND q.stratum = s.stratum AND q.arm = p.arm AND q.baseline = p.baseline AND
 q.question_id = s.question_id WHERE q.question_id IS NULL GROUP BY ALL""")
def dropped_questions(spark, sf_dir):
    rows = event_runs(spark, sf_dir).withColumn("question_id", F.col("question_id").cast("string"))
    return stats.dropped(rows, _pairs(rows, "total_tokens").where("a < 1.05 * b")).select(
        *KEYS, F.array_join("dropped_questions", ",").alias("dropped")
    )


def mixed(x: str, out: str) -> str:
    """SQL of the 32-bit hash of column x as a chain of select items that ends in `out`."""
    return f"""xor({x}, {x} >> 16) AS {out}1, ({out}1 * 2246822507) % 4294967296 AS {out}2, xor({out}2, {out}2 >> 13) AS {out}3,
 ({out}3 * 3266489909) % 4294967296 AS {out}4, xor({out}4, {out}4 >> 16) AS {out}"""


#: SQL of all numbers drawn (draw, k, h), for as many places as the largest of `sizes` has.
HASHES = f"""draw_seeds AS (SELECT draw, h0 FROM (SELECT draw, CAST((8105 * 2654435769 + draw) % 4294967296 AS UBIGINT) AS x, {mixed("x", "h0")} FROM
 range({stats.RESAMPLES}) t(draw))),
 steps AS (SELECT unnest(range(CAST((SELECT max(n) FROM sizes) AS BIGINT))) AS k),
 hashes AS (SELECT draw, k, h FROM (SELECT draw, k, CAST((h0 + CAST(k * 2654435769 % 4294967296 AS UBIGINT)) % 4294967296 AS UBIGINT) AS y,
 {mixed("y", "h")} FROM draw_seeds, steps))"""


def draws_sql(cells: str, keys: str, value: str, order: str = "question_id") -> str:
    """SQL of the hashed bootstrap over `cells` with `keys`, as CTEs that end in `ends` and `whole`."""
    names = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"d.{k} = p.{k}" for k in names)
    dk = ", ".join(f"d.{k}" for k in names)
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS pos FROM {cells}), sizes AS (SELECT {keys}, count(*)
 AS n FROM placed GROUP BY ALL), {HASHES},
 drawn AS (SELECT {keys}, draw, CAST(h % CAST(n AS UBIGINT) AS BIGINT) AS pos FROM sizes JOIN hashes ON k < n),
 vals AS (SELECT {dk}, d.draw, {value} AS v FROM drawn d JOIN placed p ON {on} AND d.pos = p.pos GROUP BY {dk}, d.draw),
 ends AS (SELECT {keys}, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM vals WHERE v IS NOT NULL GROUP BY ALL),
 whole AS (SELECT {keys}, {value} AS estimate, count(*) AS n_questions FROM placed p GROUP BY ALL)"""


def _draws(cells: str, keys: str, value: str, order: str = "question_id") -> str:
    """SQL of every cell's estimate and interval of stats.RESAMPLES draws."""
    return draws_sql(cells, keys, value, order) + f"""
 SELECT {keys}, round(estimate, 6) AS estimate, round(low, 6) AS ci_low, round(high, 6) AS ci_high, n_questions FROM whole JOIN ends USING
 ({keys}) WHERE estimate IS NOT NULL"""


def _interval(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(
        *keys,
        r6("estimate").alias("estimate"),
        r6("ci_low").alias("ci_low"),
        r6("ci_high").alias("ci_high"),
        "n_questions",
    )


@query(f"WITH {PAIRED}, " + _draws("pairs", "agent, stratum, arm, baseline", "sum(a) / sum(b)"))
def token_ratio_interval(spark, sf_dir):
    return _interval(stats.bootstrap(_pairs(event_runs(spark, sf_dir), "total_tokens"), KEYS, "ratio"), KEYS)


@query(
    f"WITH {RUNS}, q AS (SELECT agent, arm, question_id, avg(accuracy) AS a FROM runs WHERE accuracy IS NOT NULL GROUP BY ALL), " + _draws("q", "agent, arm", "avg(p.a)").replace(
        "avg(p.a) AS estimate", "avg(a) AS estimate"
    )
)
def accuracy_interval(spark, sf_dir):
    rows = event_runs(spark, sf_dir).where("accuracy IS NOT NULL").groupBy(
        "agent", "arm", "question_id"
    ).agg(F.avg("accuracy").alias("a"))
    return _interval(stats.mean_interval(rows, ["agent", "arm"]), ["agent", "arm"])


@query(
    f"WITH {RUNS}, q AS (SELECT agent, arm, question_id, CAST(count(*) FILTER (WHERE status = 'timeout') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE status IN ('timeout', 'turn_limit')) AS DOUBLE) AS b FROM runs GROUP BY ALL), " + _draws(
        "q", "agent, arm", "sum(a) / nullif(sum(b), 0)"
    )
)
def timeout_share_interval(spark, sf_dir):
    s = F.col("status")
    rows = event_runs(spark, sf_dir).groupBy("agent", "arm", "question_id").agg(
        F.count_if(s == "timeout").cast("double").alias("a"),
        F.count_if(s.isin("timeout", "turn_limit")).cast("double").alias("b"),
    )
    return _interval(stats.ratio_interval(rows, ["agent", "arm"]), ["agent", "arm"])


@query(f"""WITH {RUNS}, q AS (SELECT agent, question_id, sum(accuracy) FILTER (WHERE arm = 'web') AS x0, sum(total_tokens) FILTER (WHERE arm =
 'web') AS y0, count(*) FILTER (WHERE arm = 'web') AS n0, sum(accuracy) FILTER (WHERE arm = 'archive') AS x1, sum(total_tokens) FILTER
 (WHERE arm = 'archive') AS y1, count(*) FILTER (WHERE arm = 'archive') AS n1
 FROM runs WHERE accuracy IS NOT NULL AND total_tokens IS NOT NULL GROUP BY ALL HAVING n0 > 0 AND n1 > 0), """ + _draws("q", "agent", "sum(x0) / sum(n0) - sum(x1) / sum(n1) - (sum(y0) / sum(n0) - sum(y1) / sum(n1))"))
def family_interaction(spark, sf_dir):
    rows = event_runs(spark, sf_dir).where("accuracy IS NOT NULL AND total_tokens IS NOT NULL").withColumns(
        {"x": F.col("accuracy"), "y": F.col("total_tokens")}
    )
    return _interval(stats.family_interaction(rows, "web", "archive", ["agent"], "arm"), ["agent"])


@query(f"""WITH {RUNS} SELECT agent, stratum, arm, count(*) AS runs, count(*) FILTER (WHERE completion IS NULL) AS unjudged, round(avg(completion),
 6) AS completion_rate, count(*) FILTER (WHERE status = 'timeout') AS timeouts, count(*) FILTER (WHERE status = 'turn_limit') AS
 turn_limits,
 CAST(sum(compactions) AS BIGINT) AS compactions, CAST(sum(truncations) AS BIGINT) AS truncations, count(*) FILTER (WHERE truncations > 0)
 AS runs_with_truncation FROM runs GROUP BY ALL""")
def completion_rates(spark, sf_dir):
    return stats.completion_rates(event_runs(spark, sf_dir)).withColumn("completion_rate", r6("completion_rate"))


@query(f"""WITH {RUNS}, kept AS (SELECT * FROM runs WHERE status NOT IN ('invalid', 'infra_error')), q AS (SELECT agent, stratum, arm, question_id,
 avg(total_tokens) t, avg(accuracy) a, avg(completion) c FROM kept GROUP BY ALL),
 c AS (SELECT agent, stratum, arm, count(DISTINCT question_id) AS questions, count(*) AS runs, count(*) FILTER (WHERE status = 'completed')
 AS completed FROM kept GROUP BY ALL), m AS (SELECT agent, stratum, arm, round(avg(t), 6) AS mean_total_tokens, round(avg(a), 6) AS
 mean_accuracy, round(avg(c), 6) AS mean_completion FROM q GROUP BY ALL),
 x AS (SELECT agent, stratum, arm, count(*) AS excluded_attempts FROM runs WHERE status IN ('invalid', 'infra_error') GROUP BY ALL)
 SELECT agent, stratum, arm, coalesce(questions, 0) AS questions, coalesce(runs, 0) AS runs, coalesce(completed, 0) AS completed,
 mean_total_tokens, mean_accuracy, mean_completion, coalesce(excluded_attempts, 0) AS excluded_attempts FROM c JOIN m USING (agent, stratum,
 arm) FULL JOIN x USING (agent, stratum, arm)""")
def cell_report(spark, sf_dir):
    rows = event_runs(spark, sf_dir)
    out = runs.cell_report(rows.where(~F.col("status").isin(*runs.EXCLUDED)), rows)
    return out.withColumns({c: r6(c) for c in ("mean_total_tokens", "mean_accuracy", "mean_completion")})


@query(f"""WITH {RUNS} SELECT agent, arm, CAST(round_even(avg(total_tokens), 0) AS BIGINT) AS mean_tokens FROM runs WHERE stratum = 'control' GROUP
 BY ALL""")
def control_overhead(spark, sf_dir):
    return runs.control_overhead(event_runs(spark, sf_dir))


RUN_KEY = "agent || '.' || arm || '.' || question_id || '.r' || repetition"


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "run_key",
        F.concat_ws(
            ".",
            "agent",
            "arm",
            F.col("question_id").cast("string"),
            F.concat(F.lit("r"), F.col("repetition").cast("string")),
        ),
    )


@query(f"""WITH {RUNS} SELECT {RUN_KEY} AS run_key, count(*) AS final_records, min(run_id) AS first_run FROM runs WHERE status NOT IN ('invalid',
 'infra_error') GROUP BY ALL HAVING count(*) > 1""")
def duplicate_cells(spark, sf_dir):
    return runs.duplicate_cells(_keyed(event_runs(spark, sf_dir))).select(
        "run_key", F.size("run_ids").cast("bigint").alias("final_records"), F.array_min("run_ids").alias("first_run")
    )


@query(f"""WITH {RUNS}, r AS (SELECT user_key AS run_key, status, attempt FROM (SELECT 'k' || (run_id % 4001) AS user_key, status, attempt FROM
 runs)), specs AS (SELECT DISTINCT run_key FROM r UNION SELECT 'k' || CAST(question_id + 1000000 AS VARCHAR) FROM runs),
 per AS (SELECT run_key, max(attempt) AS last, count(*) FILTER (WHERE status NOT IN ('invalid', 'infra_error')) AS finals, count(*) FILTER
 (WHERE status = 'invalid') AS invalids, min(attempt) FILTER (WHERE status = 'invalid') AS fi FROM r GROUP BY ALL),
 seq AS (SELECT r.run_key, count(*) AS later FROM r JOIN per USING (run_key) WHERE r.attempt > per.fi GROUP BY ALL), j AS (SELECT s.run_key,
 coalesce(last, 0) AS last, coalesce(finals, 0) AS finals, coalesce(invalids, 0) AS invalids, coalesce(later, 0) AS later FROM specs s LEFT
 JOIN per USING (run_key) LEFT JOIN seq USING (run_key)),
 st AS (SELECT *, CASE WHEN finals > 0 THEN 'done' WHEN invalids > 0 AND (invalids >= 2 OR later >= 3) THEN 'excluded' WHEN invalids > 0
 THEN 'pending' WHEN last >= 3 THEN 'excluded' ELSE 'pending' END AS state FROM j)
 SELECT run_key, state, CASE WHEN state = 'pending' THEN last + 1 ELSE 0 END AS start_attempt, CASE WHEN state = 'pending' THEN CASE WHEN
 invalids > 0 THEN 3 - later ELSE 3 - last END ELSE 0 END AS attempts_left FROM st""")
def resume_plan(spark, sf_dir):
    rows = event_runs(spark, sf_dir)
    recs = rows.select(
        F.concat(F.lit("k"), (F.col("run_id") % 4001).cast("string")).alias("run_key"), "status", "attempt"
    )
    specs = recs.select("run_key").union(
        rows.select(F.concat(F.lit("k"), (F.col("question_id") + 1000000).cast("string")))
    ).distinct()
    return runs.resume_plan(specs, recs, rerun_invalid=True).select(
        "run_key",
        "state",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("start_attempt", "attempts_left")],
    )


@query("""SELECT coalesce(r.event_id, e.event_id) AS run_id, CASE WHEN r.event_id IS NOT NULL THEN r.value * 2 ELSE e.value END AS value FROM
 events e LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') r ON e.event_id = r.event_id""")
def latest_record_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), "value", "event_type")
    newer = e.where("event_type = 'error'").withColumn("value", F.col("value") * 2)
    return runs.latest_records(e, newer).select("run_id", "value")


@query(f"""WITH {RUNS}, p AS (SELECT * FROM runs UNION ALL SELECT * REPLACE ('all_scored' AS stratum) FROM runs WHERE stratum <> 'control') SELECT
 agent, stratum, arm, count(*) AS runs, round(avg(total_tokens), 6) AS mean_tokens FROM p GROUP BY ALL""")
def pooled_cells(spark, sf_dir):
    return stats.pooled(event_runs(spark, sf_dir), F.col("stratum") != "control").groupBy("agent", "stratum", "arm").agg(
        F.count(F.lit(1)).alias("runs"), r6(F.avg("total_tokens")).alias("mean_tokens")
    )


@query("""SELECT o_orderkey AS run_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def interrupted_runs(spark, sf_dir):
    meta = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit(True).alias("dispatched"))
    return runs.interrupted(
        meta, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    ).select("run_id")


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'arm_isolation: a; b' END AS bad, CASE WHEN event_type = 'error' THEN
 'server_overloaded' END AS infra FROM events)
 SELECT v.event_id AS run_id, CASE WHEN bad IS NOT NULL THEN 'invalid' WHEN infra IS NOT NULL THEN 'infra_error' WHEN e.event_id % 5 = 0
 THEN 'timeout' WHEN e.event_id % 7 = 0 THEN 'turn_limit' WHEN e.event_id % 11 = 0 THEN 'incomplete' WHEN e.event_id % 13 = 1 THEN
 'incomplete' ELSE 'completed' END AS status,
 CASE WHEN bad IS NOT NULL THEN bad WHEN infra IS NOT NULL THEN infra WHEN e.event_id % 5 = 0 THEN 'wall time limit' WHEN e.event_id % 7 = 0
 THEN 'max turns reached' WHEN e.event_id % 11 = 0 THEN 'no_usage' WHEN e.event_id % 13 = 1 THEN 'exit 1' END AS status_reason FROM v JOIN
 events e USING (event_id)""")
def run_status(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    bad = F.when(i % 17 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    got = extraction.classify(
        bad,
        F.when(F.col("event_type") == "error", F.lit("server_overloaded")),
        i % 5 == 0,
        i % 7 == 0,
        F.when(i % 11 == 0, F.lit("no_usage")),
        F.when(i % 13 == 1, F.lit(1)),
        F.lit("x"),
    )
    return e.select(i.alias("run_id"), got.alias("s")).select("run_id", "s.*")


# --- cost ---------------------------------------------------------------------------------------

PRICES = [
    ("ECONOMY", 0, 2.0, 0.1, 2.5, 10.0, 30, 2.0),
    ("PROMO", 1, 4.0, 0.2, 5.0, 20.0, None, 1.0),
    ("ST", 2, 3.0, 0.3, 3.5, 15.0, 40, 1.5),
]
PRICE_COLUMNS = "name string, ord int, input double, cached_input double, cache_write double, output double, long_context_threshold int, long_context_multiplier double"


@query("""WITH prices(name, ord, i, c, w, o, t, m) AS (VALUES ('ECONOMY', 0, 2.0, 0.1, 2.5, 10.0, 30, 2.0), ('PROMO', 1, 4.0, 0.2, 5.0, 20.0, NULL,
 1.0), ('ST', 2, 3.0, 0.3, 3.5, 15.0, 40, 1.5)),
 priced AS (SELECT p_partkey, first(name ORDER BY CASE WHEN name = p_type THEN 0 ELSE 1 END, ord) AS name FROM part JOIN prices ON
 starts_with(p_type, name) GROUP BY ALL),
 calls AS (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS inp, CAST(l_linenumber AS DOUBLE) AS cached, 1.0 AS write, CAST(l_linenumber * 2
 AS DOUBLE) AS outp, p.* FROM lineitem JOIN priced x ON l_partkey = p_partkey JOIN prices p ON p.name = x.name)
 SELECT l_orderkey AS run_id, round(sum(((inp - cached - write) * i + cached * c + write * w + outp * o) / 1000000 * CASE WHEN inp > t THEN
 m ELSE 1 END) * 1000, 6) AS milli_usd FROM calls GROUP BY ALL""")
def run_cost(spark, sf_dir):
    prices = spark.createDataFrame(PRICES, PRICE_COLUMNS)
    part = runs.price_of(
        table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("model")), prices
    ).where("input IS NOT NULL")
    calls = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    price = F.struct(
        "input", "cached_input", "cache_write", "output", "long_context_threshold", "long_context_multiplier"
    )
    calls = calls.withColumn("p", price)
    cost = runs.call_cost(
        F.col("l_quantity").cast("double"),
        F.col("l_linenumber").cast("double"),
        F.lit(1.0),
        (F.col("l_linenumber") * 2).cast("double"),
        F.col("p"),
    )
    return calls.groupBy(F.col("l_orderkey").alias("run_id")).agg(r6(F.sum(cost) * 1000).alias("milli_usd"))


@query("""SELECT p_type AS model, count(*) AS runs, round(avg(p_size), 6) AS fresh, round(max(p_retailprice), 6) AS upper FROM part GROUP BY ALL""")
def token_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("model"),
        F.col("p_size").alias("fresh"),
        F.col("p_retailprice").alias("cached"),
        *[F.lit(0).alias(c) for c in ("write", "output", "searches", "calls")],
    )
    mean, top = runs.token_profile(rows, ["model"]), runs.upper_profile(rows, ["model"]).select(
        "model", F.col("cached").alias("upper")
    )
    return mean.join(top, "model").select("model", "runs", r6("fresh").alias("fresh"), r6("upper").alias("upper"))


# --- verdicts -------------------------------------------------------------------------------------

VERDICT_SQL = "v AS (SELECT doc_id % 97 AS run_id, doc_id AS fact_id, CASE WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS a, CASE WHEN toxic = 1 THEN 'correct' WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'incorrect' END AS b FROM labels)"


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = table(spark, sf_dir, "labels")
    return label.select(
        (F.col("doc_id") % 97).alias("run_id"),
        F.col("doc_id").alias("fact_id"),
        F.when(F.col("quality") == 1, "correct").otherwise("incorrect").alias("a"),
        F.when(F.col("toxic") == 1, "correct").when(
            F.col("doc_id") % 3 == 0, "missing"
        ).otherwise("incorrect").alias("b"),
    )


@query(f"""WITH {VERDICT_SQL} SELECT count(DISTINCT run_id) AS answers, count(*) AS facts, count(*) FILTER (WHERE a = b) AS agreed_facts,
 round(avg(CASE WHEN a = b THEN 1 ELSE 0 END), 4) AS agreement_share FROM v""")
def pass_agreement(spark, sf_dir):
    return verdicts.pass_agreement(_verdicts(spark, sf_dir))


@query(f"WITH {VERDICT_SQL} SELECT a, b, count(*) AS facts FROM v GROUP BY ALL")
def verdict_cross_table(spark, sf_dir):
    return verdicts.cross_table(_verdicts(spark, sf_dir))


@query(f"""WITH {VERDICT_SQL} SELECT fact_id // 10 AS run_id, round(avg(CASE WHEN a <> b THEN 0.5 WHEN a = 'correct' THEN 1.0 ELSE 0.0 END), 6) AS
 accuracy, count(*) FILTER (WHERE a <> b) AS disputed FROM v GROUP BY ALL""")
def fact_scores(spark, sf_dir):
    rows = _verdicts(spark, sf_dir).withColumn("run_id", F.floor(F.col("fact_id") / 10))
    maps = rows.groupBy("run_id").agg(
        *[F.map_from_entries(F.collect_list(F.struct(F.col("fact_id").cast("string"), c))).alias(c) for c in ("a", "b")]
    )
    merged = verdicts.merge_passes(F.col("a"), F.col("b"), F.lit(True), F.lit(True))
    return maps.select("run_id", merged.alias("m")).select(
        F.col("run_id").cast("bigint").alias("run_id"),
        r6("m.accuracy").alias("accuracy"),
        F.size("m.disputed").cast("bigint").alias("disputed"),
    )


@query(f"""WITH {VERDICT_SQL}, long AS (SELECT 'A' AS judge, run_id, a AS verdict FROM v UNION ALL SELECT 'B', run_id, b FROM v) SELECT judge,
 run_id % 2 AS family, count(DISTINCT run_id) AS runs, count(*) AS facts, round(avg(CASE WHEN verdict = 'correct' THEN 1 ELSE 0 END), 4) AS
 correct_rate, round(avg(CASE WHEN verdict = 'incorrect' THEN 1 ELSE 0 END), 4) AS incorrect_rate, round(avg(CASE WHEN verdict = 'missing'
 THEN 1 ELSE 0 END), 4) AS missing_rate FROM long GROUP BY ALL""")
def verdict_rates(spark, sf_dir):
    long = _verdicts(spark, sf_dir).select(
        "run_id",
        (F.col("run_id") % 2).alias("family"),
        F.explode(F.create_map(F.lit("A"), "a", F.lit("B"), "b")).alias("judge", "verdict"),
    )
    return verdicts.verdict_rates(long, ["judge", "family"])


@query(f"""WITH {VERDICT_SQL}, d AS (SELECT fact_id, 'disputed' AS selection FROM v WHERE a <> b), g AS (SELECT fact_id, row_number() OVER (ORDER BY
 sha256('8105:' || run_id || ':' || fact_id)) AS rn, count(*) OVER () AS n FROM v WHERE a = b)
 SELECT * FROM d UNION ALL SELECT fact_id, 'sample' FROM g WHERE rn <= round_even(n * 0.05, 0)""")
def audit_queue(spark, sf_dir):
    v = _verdicts(spark, sf_dir).withColumn("disputed", F.col("a") != F.col("b")).withColumn("verdict", F.col("b"))
    return verdicts.audit_queue(v.select("run_id", "fact_id", "verdict", "disputed")).select("fact_id", "selection")


@query("""WITH r AS (SELECT doc_id % 500 AS run_id, doc_id % 7 AS fact_id, CASE WHEN doc_id % 2 = 0 THEN 'owner' ELSE 'key_correction' END AS
 source, 'correct' AS verdict FROM labels), d AS (SELECT DISTINCT * FROM r)
 SELECT run_id, fact_id, source, row_number() OVER (PARTITION BY run_id, fact_id ORDER BY CASE source WHEN 'owner' THEN 1 ELSE 2 END) > 1 AS
 superseded FROM d""")
def audit_precedence(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(
        (i % 500).alias("run_id"),
        (i % 7).alias("fact_id"),
        F.when(i % 2 == 0, "owner").otherwise("key_correction").alias("source"),
        F.lit("correct").alias("verdict"),
    )
    return verdicts.audit_precedence(rows).select("run_id", "fact_id", "source", "superseded")


@query("""WITH r AS (SELECT event_type AS arm, user_id AS question_id, CAST(event_id % 2 AS DOUBLE) AS adoption, CASE WHEN event_id % 3 = 0 THEN
 NULL ELSE CAST(event_id % 4 AS DOUBLE) / 4 END AS accuracy, value AS total_tokens, (event_id % 5) * 1.0 / nullif(event_id % 7, 0) AS share
 FROM events),
 q AS (SELECT arm, question_id, avg(adoption) a, avg(accuracy) c, avg(total_tokens) t, avg(share) s, count(*) n FROM r GROUP BY ALL) SELECT
 arm, round(avg(a), 6) AS adoption, round(avg(c), 6) AS accuracy, round(avg(t), 6) AS total_tokens, round(avg(s), 6) AS share, CAST(sum(n)
 AS BIGINT) AS runs FROM q GROUP BY ALL""")
def contamination_summary(spark, sf_dir):
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("arm"),
        F.col("user_id").alias("question_id"),
        (i % 2).cast("double").alias("adoption"),
        F.when(i % 3 != 0, (i % 4).cast("double") / 4).alias("accuracy"),
        F.col("value").alias("total_tokens"),
        (i % 5).alias("filings"),
        (i % 7).alias("sources"),
    )
    out = verdicts.contamination_summary(rows)
    return out.withColumns({c: r6(c) for c in ("adoption", "accuracy", "total_tokens", "share")})


@query("""SELECT l_orderkey AS run_id, l_linenumber % 2 = 0 AS restated, count(*) AS rows, count(*) FILTER (WHERE o_orderkey IS NULL) AS unchecked
 FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey GROUP BY ALL""")
def checked_rows(spark, sf_dir):
    sample = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), "l_linenumber")
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("row_id"),
        F.lit("ok").alias("status"),
        F.lit("confirmed").alias("bin"),
        *[F.lit(None).cast("string").alias(c) for c in ("subtype", "merit", "restatement")],
    )
    rows = verdicts.checked_rows(sample, done)
    return rows.groupBy(F.col("row_id").alias("run_id"), (F.col("l_linenumber") % 2 == 0).alias("restated")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status").isNull()).alias("unchecked")
    )


# --- rates over grouping sets -----------------------------------------------------------------------


@query("""WITH d AS (SELECT source, lang, quality FROM documents JOIN labels USING (doc_id)), g AS (SELECT CASE WHEN grouping(source) = 1 THEN
 'all' ELSE source END AS category, CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS stratum, count(*) AS rows, count(*) FILTER
 (WHERE quality = 1) AS confirmed FROM d GROUP BY GROUPING SETS ((source, lang), (source), ()))
 SELECT category, stratum, rows, confirmed, round(confirmed / rows, 4) AS rate, round(greatest(0, ((confirmed / rows) + 3.841458881296 / (2
 * rows)) / (1 + 3.841458881296 / rows) - 1.959964 * sqrt((confirmed / rows) * (1 - (confirmed / rows)) / rows + 3.841458881296 / (4.0 *
 rows * rows)) / (1 + 3.841458881296 / rows)), 4) AS low,
 round(least(1, ((confirmed / rows) + 3.841458881296 / (2 * rows)) / (1 + 3.841458881296 / rows) + 1.959964 * sqrt((confirmed / rows) * (1 -
 (confirmed / rows)) / rows + 3.841458881296 / (4.0 * rows * rows)) / (1 + 3.841458881296 / rows)), 4) AS high FROM g""")
def rate_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(
        table(spark, sf_dir, "labels"), "doc_id"
    )
    found = sets.rate_rows(d, "source", "lang", {"confirmed": F.col("quality") == 1})
    names = {"confirmed_rate": "rate", "confirmed_low": "low", "confirmed_high": "high"}
    return found.withColumnsRenamed(names).select("category", "stratum", "rows", "confirmed", "rate", "low", "high")


@query("""
WITH d AS (
  SELECT source, lang, toxic, quality, doc_id % 4 AS merit FROM documents JOIN labels USING (doc_id)),
g AS (
  SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS category,
    CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS stratum, merit, count(*) AS n,
    count(*) FILTER (WHERE toxic = 0) AS checkable
  FROM d GROUP BY GROUPING SETS ((source, lang, merit), (source, merit), (merit)))
SELECT category, stratum, sum(checkable)::BIGINT AS checkable, round(sum(checkable) / sum(n), 4) AS checkable_share,
  string_agg(merit || ':' || n, ',' ORDER BY merit) AS merits
FROM g GROUP BY category, stratum
""")
def rate_histograms(spark, sf_dir):
    """Checkable share and a histogram of merits for each source and language, each source, and all labelled documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(
        table(spark, sf_dir, "labels"), "doc_id"
    ).withColumn("merit", F.col("doc_id") % 4)
    found = sets.rate_rows(d, "source", "lang", {}, F.col("toxic") == 0, ("merit",))
    pairs = F.transform(F.map_entries("merit"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string")))
    return found.select("category", "stratum", "checkable", "checkable_share", F.array_join(pairs, ",").alias("merits"))


@query("""SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS category, count(*) FILTER (WHERE quality = 1) AS confirmed, count(*)
 FILTER (WHERE quality = 0 AND toxic = 1) AS contradicted, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS unchecked FROM documents
 JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def extension_bins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    q, t = F.col("quality"), F.col("toxic")
    bins = {"confirmed": q == 1, "contradicted": (q == 0) & (t == 1), "unchecked": (q == 0) & (t == 0)}
    return sets.bin_counts(d, "lang", bins)


# --- hosts and provenance -----------------------------------------------------------------------------

HOST_SQL = r"h AS (SELECT page_id, url, coalesce(nullif(regexp_replace(split_part(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), ':', 1), '^www\.', ''), ''), 'unknown') AS host FROM pages), seeds(seed, category, rank) AS (VALUES ('example.com', 'issuer', 1), ('example.net', 'news', 5), ('blog.example.net', 'forum', 2)), c AS (SELECT page_id, host, coalesce(first(category ORDER BY rank), 'other') AS category FROM h LEFT JOIN seeds ON host = seed OR ends_with(host, '.' || seed) GROUP BY ALL)"
SEEDS = [("example.com", "issuer", 1), ("example.net", "news", 5), ("blog.example.net", "forum", 2)]


def _page_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn(
        "host", text.normalize_host(text.host_of(F.col("url")))
    )
    seeds = spark.createDataFrame(SEEDS, "seed string, category string, rank int")
    none = spark.createDataFrame([], "host string, category string, status string, reason string")
    return pages.join(provenance.host_categories(pages, seeds, none), "host")


@query(f"WITH {HOST_SQL} SELECT DISTINCT host, category FROM c")
def host_categories(spark, sf_dir):
    return _page_categories(spark, sf_dir).select("host", "category").distinct()


@query(f"""WITH {HOST_SQL} SELECT host, count(DISTINCT page_id % 20) AS runs, array_to_string(list_sort(list(DISTINCT CASE page_id % 3 WHEN 0 THEN
 'shown' WHEN 1 THEN 'opened' ELSE 'archive' END)), ',') AS kinds FROM h GROUP BY ALL""")
def host_inventory(spark, sf_dir):
    i = F.col("page_id")
    p = _page_categories(spark, sf_dir).select(
        (i % 20).alias("run_id"),
        i.alias("ord"),
        "host",
        F.when(i % 3 == 0, "shown").when(i % 3 == 1, "opened").otherwise("archive").alias("kind"),
        F.col("url").alias("title"),
        F.lit("").alias("snippet"),
        F.array().cast("array<string>").alias("companies"),
    )
    links = spark.createDataFrame([], "run_id bigint, url string, companies array<string>")
    return provenance.host_inventory(p, links).select("host", "runs", F.array_join("kinds", ",").alias("kinds"))


@query(f"""WITH {HOST_SQL}, s AS (SELECT DISTINCT page_id % 20 AS run_id, CASE page_id % 3 WHEN 0 THEN 'shown' WHEN 1 THEN 'opened' ELSE 'archive'
 END AS kind, host AS key, category FROM c)
 SELECT run_id, count(*) FILTER (WHERE kind = 'shown' AND category = 'issuer') AS shown_issuer, count(*) FILTER (WHERE kind = 'shown' AND
 category = 'news') AS shown_news, count(*) FILTER (WHERE kind <> 'shown' AND category = 'forum') AS opened_forum, count(*) FILTER (WHERE
 kind = 'archive') AS archive_sources,
 count(*) FILTER (WHERE kind = 'shown' AND category = 'forum') > 0 AND count(*) FILTER (WHERE kind <> 'shown' AND category = 'forum') = 0 AS
 forum_shown_only, count(*) FILTER (WHERE category = 'forum') > 0 AS forum_touched FROM s GROUP BY ALL""")
def exposure(spark, sf_dir):
    i = F.col("page_id")
    s = _page_categories(spark, sf_dir).select(
        (i % 20).alias("run_id"),
        F.when(i % 3 == 0, "shown").when(i % 3 == 1, "opened").otherwise("archive").alias("kind"),
        F.col("host").alias("key"),
        "category",
    )
    return provenance.run_exposure(s).select(
        "run_id", "shown_issuer", "shown_news", "opened_forum", "archive_sources", "forum_shown_only", "forum_touched"
    )


#: SQL of each reliance measure: what is counted, of what.
_MEASURES = {
    "fact_label_filing": ("label = 'filing'", "type = 'fact'"),
    "fact_label_secondary": ("label = 'secondary'", "type = 'fact'"),
    **{
        f"fact_label_secondary_{c}": (
            f"label = 'secondary' AND category = '{c}'", "type = 'fact'"
        ) for c in text.PRECEDENCE if c != "filing"
    },
    "fact_label_unattributed": ("label = 'unattributed'", "type = 'fact'"),
    "fact_citation_only": ("doc_id % 5 = 0", "type = 'fact'"),
    "fact_secondary_use": ("doc_id % 2 = 0", "type = 'fact'"),
    "primary_read_behind_secondary_use": ("doc_id % 3 = 0", "type = 'fact' AND doc_id % 2 = 0"),
    "verified_of_web_valued_claims": ("doc_id % 7 = 0", "type = 'fact' AND doc_id % 3 = 1"),
    "evaluative_absent_from_filing": ("doc_id % 11 = 0", "type = 'evaluative' AND doc_id % 8 <> 0"),
}


@query("""WITH c AS (SELECT doc_id, lang AS arm, doc_id % 40 AS question_id, CASE WHEN doc_id % 4 = 0 THEN 'evaluative' ELSE 'fact' END AS type,
 CASE WHEN quality = 1 THEN 'filing' WHEN toxic = 1 OR doc_id % 3 = 0 THEN 'secondary' ELSE 'unattributed' END AS label, CASE WHEN doc_id %
 2 = 0 THEN 'forum' ELSE 'news' END AS category FROM documents JOIN labels USING (doc_id)),
 q AS (SELECT lang AS arm, count(DISTINCT doc_id % 40) AS questions FROM documents GROUP BY ALL), m AS (""" + " UNION ALL ".join(f"SELECT arm, '{n}' AS measure, count(*) FILTER (WHERE ({den}) AND ({num})) AS a, count(*) FILTER (WHERE {den}) AS b FROM c GROUP BY arm" for n, (num, den) in _MEASURES.items()) + """), all_ AS (SELECT arm, measure, questions FROM q, (SELECT DISTINCT measure FROM m))
 SELECT arm, measure, CAST(coalesce(a, 0) AS DOUBLE) AS claims, CAST(coalesce(b, 0) AS DOUBLE) AS of_claims, questions FROM all_ LEFT JOIN m
 USING (arm, measure)""")
def reliance_shares(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("arm"), (F.col("doc_id") % 40).alias("question_id")
    )
    i = F.col("doc_id")
    label = F.when(F.col("quality") == 1, "filing").when(
        (F.col("toxic") == 1) | (i % 3 == 0), "secondary"
    ).otherwise("unattributed")
    flags = {
        "citation_only": i % 5 == 0,
        "secondary_use": i % 2 == 0,
        "primary_read": i % 3 == 0,
        "verified_by_archive": i % 7 == 0,
        "values_in_nonfiling_source": i % 3 == 1,
        "absent_from_filing": i % 11 == 0,
    }
    kinds = {
        "type": F.when(i % 4 == 0, "evaluative").otherwise("fact"),
        "label": label,
        "category": F.when(i % 2 == 0, "forum").otherwise("news"),
        "attributed_to": F.when(i % 8 == 0, "filer"),
    }
    c = d.join(table(spark, sf_dir, "labels"), "doc_id").withColumns(kinds | flags)
    rows = provenance.reliance_counts(d, c, ["arm"], measures=provenance.reliance_measures())
    return rows.groupBy("arm", "measure").agg(
        F.sum("a").alias("claims"), F.sum("b").alias("of_claims"), F.count(F.lit(1)).alias("questions")
    )


# --- text -------------------------------------------------------------------------------------------------


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(html, '\[([^\]]*)\]\((https?://[^)\s]+)\)', '\1 [link]', 'gi'),
 'https?://[^\s)\]>"''`]+', '[link]', 'gi')) AS digest FROM pages""")
def strip_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", F.md5(text.strip_links(F.col("html")).cast("binary")).alias("digest")
    )


@query(r"""SELECT doc_id, array_to_string(list_filter(['bearer', 'jwt', 'sk key', 'ak key', 'mst key', 'token query'], lambda k: CASE k WHEN
 'bearer' THEN regexp_matches(text, '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}') WHEN 'jwt' THEN regexp_matches(text,
 '\beyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]+') WHEN 'sk key' THEN regexp_matches(text, '\bsk-[A-Za-z0-9_-]{8,}')
 WHEN 'ak key' THEN regexp_matches(text, '\bak_[A-Za-z0-9_-]{8,}') WHEN 'mst key' THEN regexp_matches(text, '\bmst_[A-Za-z0-9_-]{8,}') ELSE
 regexp_matches(text, '(?i)\b(access_token|refresh_token|id_token)=[^&\s"''<>]+') END), ',') AS kinds FROM documents""")
def secret_findings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(secrets.quick_findings(F.col("text")), ",").alias("kinds")
    )


@query()
def scrubbed_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(secrets.scrub_free_text("text").cast("binary")).alias("scrubbed"),
        F.md5(secrets.mask_secrets("text").cast("binary")).alias("masked"),
    )


@query("""SELECT doc_id, CAST(contains(lower(text), 'idiot') AS INT) + CAST(contains(lower(text), 'token') AS INT) AS hits FROM documents""")
def marker_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(text.marker_hits(F.array("text"), ["idiot", "token"])).alias("hits")
    )


@query("""SELECT doc_id, contains(trim(regexp_replace(lower(translate(text, '|', ' ')), '\\s+', ' ', 'g')),
 trim(regexp_replace(lower(translate(substr(text, 11, 40), '|', ' ')), '\\s+', ' ', 'g'))) AS quoted FROM documents""")
def quote_in_passage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring("text", 11, 40).alias("quote"))
    return d.select(
        "doc_id", F.contains(text.quote_form(F.col("text")), text.quote_form(F.col("quote"))).alias("quoted")
    )


@query("""WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1001, 0) + 1, 7000)) AS pos FROM documents) SELECT doc_id, pos //
 7000 AS "window", md5(substr(text, pos + 1, 8000)) AS digest FROM w""")
def text_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(text.text_windows(F.col("text"))).alias("window", "w")
    )
    return d.select(
        "doc_id", F.col("window").cast("bigint").alias("window"), F.md5(F.col("w").cast("binary")).alias("digest")
    )


@query(r"""WITH k AS (SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS key FROM documents) SELECT key, min(doc_id) AS
 doc_id, count(*) AS occurrences FROM k GROUP BY ALL""")
def text_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(text.collapse(F.col("text")).cast("binary")).alias("h")
    )
    return sampling.dedupe(d, F.col("h"), ["doc_id"], keep=["doc_id"]).select("key", "doc_id", "occurrences")


@query("WITH w AS (SELECT doc_id, source, lang, text, unnest(range(0, greatest(length(text) - 1001, 0) + 1, 7000)) AS pos FROM documents), f AS (SELECT *, " + _FOLDED.format(c="substr(text, pos + 1, 8000)") + " AS t, " + _FOLDED.format(c="text") + """ AS whole FROM w)
 SELECT 'T' || substr(sha256(t), 1, 12) AS text_id, 'T' || substr(sha256(arg_min(whole, (source, doc_id, pos))), 1, 12) AS parent_text_id,
 CAST(arg_min(pos, (source, doc_id, pos)) // 7000 AS INTEGER) AS "window", count(DISTINCT source) AS runs FROM f WHERE t <> '' GROUP BY t""")
def text_pool(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.col("source").alias("run_id"),
        F.col("doc_id").alias("ord"),
        F.col("lang").alias("question_id"),
        F.array("source").alias("companies"),
        F.lit("forum").alias("category"),
        F.lit("h").alias("host"),
        F.lit("shown").alias("kind"),
        F.col("lang").alias("stratum"),
        "text",
    )
    return sampling.text_pool(d).select(
        "text_id", "parent_text_id", "window", F.size("run_ids").cast("bigint").alias("runs")
    )


@query(
    "WITH f AS (SELECT doc_id, " + _FOLDED.format(c="text") + " AS t FROM documents) SELECT doc_id, md5(t) AS folded, len(list_filter(regexp_extract_all(t, '[\\p{L}\\p{M}\\p{N}]+'), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(
        f"'{w}'" for w in text.STOP_WORDS
    ) + "], w))) AS content_words FROM f"
)
def folded_words(spark, sf_dir):
    folded = text.fold("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(folded.cast("binary")).alias("folded"),
        F.size(text.content_words(folded)).alias("content_words"),
    )



@query("""SELECT conv_id, turn, (CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'de') AS INT)) / 2 AS share FROM
 conversations""")
def control_scores(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.occurs_share(F.col("text"), F.array(F.lit("the"), F.lit("DE"))).alias("share")
    )


# --- samples and ordinals ------------------------------------------------------------------------------------


@query("""SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('8105:' || doc_id)) AS rank
 FROM documents) WHERE rank <= 5""")
def hash_topk_sample(spark, sf_dir):
    return sampling.hash_top_k(
        table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 5
    ).select("lang", "doc_id", F.col("rank").cast("bigint").alias("rank"))



@query("""WITH n AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 15 AS b FROM events) SELECT
 user_id, 'h-' || substr(sha256(string_agg(CAST(event_id AS VARCHAR), chr(10) ORDER BY CAST(event_id AS VARCHAR))), 1, 12) AS batch,
 count(*) AS items FROM n GROUP BY user_id, b""")
def batches(spark, sf_dir):
    return sampling.batches(
        table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 15, "h-"
    ).select("user_id", "batch", F.size("items").cast("bigint").alias("items"))


@query("""SELECT conv_id, turn, 'F' || row_number() OVER (PARTITION BY conv_id ORDER BY sha256('8105:' || conv_id || ':' || turn)) AS label FROM
 conversations""")
def shuffled_labels(spark, sf_dir):
    return sampling.shuffled_labels(
        table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", "F"
    )


@query("""WITH RECURSIVE z AS (SELECT conv_id, turn, octet_length(encode(text)) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS
 rn FROM conversations),
 f AS (SELECT conv_id, turn, size, rn, 0 AS shard, size AS used FROM z WHERE rn = 1 UNION ALL SELECT z.conv_id, z.turn, z.size, z.rn, CASE
 WHEN f.used > 0 AND f.used + z.size > 4000 THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.used > 0 AND f.used + z.size > 4000 THEN z.size
 ELSE f.used + z.size END FROM f JOIN z ON z.conv_id = f.conv_id AND z.rn = f.rn + 1)
 SELECT conv_id, turn, size, shard FROM f""")
def shard_pack(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").alias("size"))
    return shards.shard_rows(c, "conv_id", ["turn"], "size", 4000).select("conv_id", "turn", "size", "shard")


# --- ordered folds ---------------------------------------------------------------------------------------------


@query("""SELECT conv_id, arg_max(role, turn) AS last_role, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS answer, count(*) FILTER (WHERE
 role = 'user') AS user_turns FROM conversations GROUP BY ALL""")
def last_wins(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(
        F.max_by("role", "turn").alias("last_role"),
        extraction.last_by(F.col("text"), F.col("turn"), F.col("role") == "assistant").alias("answer"),
        F.count_if(F.col("role") == "user").alias("user_turns"),
    )


@query("""SELECT user_id, arg_min(value, event_id) AS first, min(value) AS least, arg_max(value, event_id) AS last, bool_or(event_type = 'error')
 AS failed FROM events GROUP BY ALL""")
def first_least_last(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(
        F.min_by("value", "event_id").alias("first"),
        F.min("value").alias("least"),
        F.max_by("value", "event_id").alias("last"),
        F.bool_or(F.col("event_type") == "error").alias("failed"),
    )


@query("""WITH l AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY ALL) SELECT user_id, round(sum(v), 6) AS total,
 count(*) AS messages FROM l GROUP BY ALL""")
def last_per_message_sum(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("v"))
    return last.groupBy("user_id").agg(r6(F.sum("v")).alias("total"), F.count(F.lit(1)).alias("messages"))


@query("""WITH r AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'usage_limit_exceeded' WHEN event_type =
 'error' THEN 'server_overloaded' END AS reason FROM events)
 SELECT user_id, coalesce(arg_min(reason, event_id) FILTER (WHERE reason = 'usage_limit_exceeded'), arg_min(reason, event_id) FILTER (WHERE
 reason IS NOT NULL)) AS reason FROM r GROUP BY ALL""")
def merged_reasons(spark, sf_dir):
    e, bad = table(spark, sf_dir, "events"), F.col("event_type") == "error"
    message = F.when(
        bad & (F.col("event_id") % 3 == 0), F.lit("usage limit hit")
    ).when(bad, F.lit("overloaded")).otherwise(F.lit(""))
    return e.withColumn("reason", extraction.error_reason(F.lit(""), message)).groupBy("user_id").agg(
        extraction.merge_reasons(F.col("reason"), F.struct("event_id")).alias("reason")
    )


@query("""SELECT user_id, event_id, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) > 100, false) AS moved FROM
 events""")
def moved_readings(spark, sf_dir):
    return sets.moved(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 100).select(
        "user_id", "event_id", "moved"
    )


@query("SELECT user_id, event_type AS tool, count(*) AS calls FROM events GROUP BY ALL")
def tool_counts(spark, sf_dir):
    maps = extraction.counts_map(
        table(spark, sf_dir, "events").select("user_id", "event_type"), "user_id", "event_type", "tools"
    )
    return maps.select("user_id", F.explode("tools").alias("tool", "calls"))


@query("""SELECT event_id % 50 AS path, event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props,
 '$.k') IS NOT NULL""")
def json_scan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 50).cast("string").alias("path"), F.struct("event_id", "props").alias("x")
    )
    files = e.groupBy("path").agg(F.array_sort(F.collect_list("x")).alias("l")).select(
        "path",
        F.array_join(
            F.transform(
                "l",
                lambda x: F.concat(
                    F.lit("  "),
                    F.substring(x["props"], F.lit(1), F.length(x["props"]) - 1),
                    F.lit(', "id": '),
                    x["event_id"].cast("string"),
                    F.lit("}\n\nnot json\n[1]"),
                ),
            ),
            "\n",
        ).alias("text"),
    )
    kept = readers.kept_lines(files, "path", "text")
    return kept.select(
        F.col("path").cast("bigint").alias("path"),
        F.get_json_object("raw", "$.id").cast("bigint").alias("id"),
        F.get_json_object("raw", "$.k").cast("bigint").alias("k"),
    ).where("k IS NOT NULL")


# --- constraints, sets, state --------------------------------------------------------------------------------


@query("""SELECT 'unknown customer' AS rule, count(*) AS violations FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey =
 o_custkey) HAVING count(*) > 0 UNION ALL SELECT 'unknown order', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE
 o_orderkey = l_orderkey) HAVING count(*) > 0
 UNION ALL SELECT 'large discount', count(*) FROM lineitem WHERE l_discount > 0.08 HAVING count(*) > 0 UNION ALL SELECT 'repeated line',
 count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) HAVING count(*) > 0 UNION ALL SELECT
 'negative balance', count(*) FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0""")
def validate_constraints(spark, sf_dir):
    orders, lines, customers = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer"))
    key = F.concat_ws(".", "l_orderkey", "l_linenumber")
    found = validation.union([
        validation.references(orders, "o_custkey", customers, "c_custkey", "unknown customer", "o_orderkey"),
        validation.references(lines, "l_orderkey", orders, "o_orderkey", "unknown order", "l_orderkey"),
        validation.where(lines, F.col("l_discount") > 0.08, "large discount", "l_orderkey"),
        validation.unique(lines.withColumn("line", key), "line", "repeated line"),
        validation.where(customers, F.col("c_acctbal") < 0, "negative balance", "c_custkey"),
    ])
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


@query("""WITH a AS (SELECT DISTINCT event_id % 997 AS user_id FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT event_id % 997 AS
 user_id FROM events WHERE event_type = 'click') SELECT 'both' AS side, count(*) AS users FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
 UNION ALL SELECT 'first only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT *
 FROM a UNION SELECT * FROM b)""")
def set_operations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 997).alias("user_id"))
    a, b = (e.where(F.col("event_type") == t).select("user_id").distinct() for t in ("view", "click"))
    key = ["user_id"]
    parts = {
        "both": sets.shared(a, b, key),
        "first only": sets.lacking(a, b, key),
        "either": sets.together(key, a, b),
    }
    counts = [df.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("users")) for name, df in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""
WITH a AS (SELECT DISTINCT event_id % 997 AS k FROM events WHERE event_type = 'view'),
b AS (SELECT DISTINCT event_id % 997 AS k FROM events WHERE event_type = 'click')
SELECT k, 'first' AS only FROM a WHERE k NOT IN (SELECT k FROM b)
UNION ALL SELECT k, 'second' FROM b WHERE k NOT IN (SELECT k FROM a)
""")
def key_differences(spark, sf_dir):
    """Keys that only views or only clicks have: where two sets are not equal."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 997).alias("k"))
    a, b = (e.where(F.col("event_type") == t) for t in ("view", "click"))
    return sets.differences(a, b, ["k"])


@query("""
SELECT o_custkey, array_to_string(list_sort(list_distinct(list(rule))), ',') AS violations
FROM (
  SELECT o_custkey, unnest(list_filter([
    CASE WHEN o_totalprice > 400000 THEN 'dear' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END,
    CASE WHEN o_orderkey % 7 = 0 THEN 'a seventh' END], lambda x: x IS NOT NULL)) AS rule
  FROM orders)
GROUP BY o_custkey
""")
def sorted_violations(spark, sf_dir):
    """The rules that any order of a customer breaks, sorted and told once."""
    rules = {
        "dear": F.col("o_totalprice") > 400000,
        "pending": F.col("o_orderstatus") == "P",
        "a seventh": F.col("o_orderkey") % 7 == 0,
    }
    found = sets.violations(table(spark, sf_dir, "orders"), "o_custkey", rules)
    return found.select("o_custkey", F.array_join("violations", ",").alias("violations"))


@query("""
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS times FROM events GROUP BY ALL
""")
def occurrence_order(spark, sf_dir):
    """Where each kind of event of a user comes up first and last."""
    return sets.occurrence_order(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id")


@query("""WITH r AS (SELECT user_id AS batch, ts AS t, event_id, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'usage_limit_exceeded'
 END AS reason FROM events), f AS (SELECT batch, min(t) AS stop FROM r WHERE reason IS NOT NULL GROUP BY ALL) SELECT batch, count(*) FILTER
 (WHERE stop IS NULL OR t <= stop) AS admitted, count(*) FILTER (WHERE t > stop) AS refused FROM r LEFT JOIN f USING (batch) GROUP BY ALL""")
def latched_stops(spark, sf_dir):
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("batch"),
        F.col("ts").alias("at"),
        F.when((F.col("event_type") == "error") & (i % 3 == 0), F.lit("usage_limit_exceeded")).alias("reason"),
    )
    return streaming.latch_batch(e).groupBy("batch").agg(
        F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused")
    )


@query("""SELECT user_id AS item, count(*) AS attempts, NOT bool_or(event_type = 'signup' AND value > 485) AND count(*) < 60 AS may_retry FROM
 events GROUP BY ALL""")
def retry_budget(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item"),
        F.when((F.col("event_type") == "signup") & (F.col("value") > 485), "ok").otherwise("error").alias("status"),
    )
    return streaming.budget(e, "item", 60).select("item", "attempts", "may_retry")


@query("SELECT user_id, event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTES")
def fresh_readings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    return streaming.fresh(e, now, at="ts").select("user_id", "event_id")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS
 opens FROM events), s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", count(*) AS events FROM s GROUP BY user_id, n""")
def user_sessions(spark, sf_dir):
    s = streaming.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "2 hours")
    return s.select(
        "user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events"
    )


@query("""SELECT DISTINCT * FROM (SELECT 'first' AS feed, ts AS "at", event_id AS run_id, 'a' AS reason FROM events WHERE event_type = 'error'
 UNION ALL SELECT 'first', ts, event_id, 'b' FROM events WHERE event_type = 'error' UNION ALL SELECT 'second', ts, event_id, 'c' FROM events
 WHERE value > 480)""")
def billing_warnings(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("ts").alias("at"), F.col("event_id").alias("run_id"), "event_type", "value"
    )
    first = e.where("event_type = 'error'").withColumn("reasons", F.array(F.lit("a"), F.lit("b")))
    return runs.billing_warnings(
        {"first": first, "second": e.where("value > 480").withColumn("reasons", F.array(F.lit("c")))}
    )


from . import checks, files, logs, more, records, streams  # noqa: E402, F401
