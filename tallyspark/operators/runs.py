"""Run records: merging, what is still to do, cells, costs and reports of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXCLUDED = ("invalid", "infra_error")
ATTEMPTS = 3
WEB_SEARCH_USD = 0.01


def latest_records(*feeds: DataFrame, key: str = "run_id") -> DataFrame:
    """Feeds in rising order of authority: for each key the row of the last feed that has it."""
    rows = None
    for rank, f in enumerate(feeds):
        part = f.withColumn("_rank", F.lit(rank))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    columns = [c for c in rows.columns if c not in (key, "_rank")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col("_rank")).alias("_row"))
    return last.select(key, "_row.*").select(*[c for c in rows.columns if c != "_rank"])


def interrupted(meta: DataFrame, records: DataFrame, key: str = "run_id") -> DataFrame:
    """Dispatched runs that left no record, as records of their own."""
    lost = meta.where("dispatched").join(records.select(key), key, "left_anti")
    return lost.withColumns({"status": F.lit("infra_error"), "status_reason": F.lit("interrupted")})


def undispatched(meta: DataFrame, records: DataFrame, key: str = "run_id") -> DataFrame:
    return meta.where("NOT dispatched").join(records.select(key), key, "left_anti")


def plan_cells(questions: DataFrame, arms: list[str], repetitions: int) -> DataFrame:
    """Repetition x question x arm in order of question; repetitions and arms are short lists, so nothing is crossed with data."""
    rep = F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition")
    return questions.select("*", rep).select(
        "*", F.posexplode(F.array(*map(F.lit, arms))).alias("arm_ord", "arm")
    ).orderBy("repetition", "q_ord", "arm_ord")


def resume_plan(specs: DataFrame, records: DataFrame, rerun_invalid: bool = False, key: str = "run_key") -> DataFrame:
    """State of each planned cell: done, pending (start_attempt, attempts_left) or excluded; `rerun` marks a second sequence.

    A final record ends a cell. Cells with infrastructure errors only go on up to three attempts. A cell whose records
    are invalid is done, unless one rerun sequence after the first invalid attempt is asked for.
    """
    bad = F.col("status") == "invalid"
    per = records.groupBy(key).agg(
        F.max("attempt").alias("last"),
        F.count_if(~F.col("status").isin(*EXCLUDED)).alias("finals"),
        F.count_if(bad).alias("invalids"),
        F.min(F.when(bad, F.col("attempt"))).alias("first_invalid"),
        F.collect_list("attempt").alias("attempts"),
    )
    c = specs.join(per, key, "left").withColumn("last", F.coalesce("last", F.lit(0)))
    later = F.size(F.filter("attempts", lambda a: a > F.col("first_invalid")))
    spent = (F.col("invalids") >= 2) | (later >= ATTEMPTS)
    has_bad = F.coalesce(F.col("invalids"), F.lit(0)) > 0
    state = (
        F.when(F.coalesce(F.col("finals"), F.lit(0)) > 0, "done")
        .when(has_bad & spent, "excluded")
        .when(has_bad, "pending" if rerun_invalid else "done")
        .when(F.col("last") >= ATTEMPTS, "excluded")
        .otherwise("pending")
    )
    out = c.withColumn("state", state)
    waits = F.col("state") == "pending"
    left = F.when(has_bad, ATTEMPTS - later).otherwise(ATTEMPTS - F.col("last"))
    return out.select(
        *specs.columns,
        "state",
        F.when(waits, F.col("last") + 1).alias("start_attempt"),
        F.when(waits, left).alias("attempts_left"),
        (waits & has_bad).alias("rerun"),
        ((F.col("state") == "excluded") & has_bad).alias("excluded_invalid"),
    )


def duplicate_cells(records: DataFrame, key: str = "run_key") -> DataFrame:
    """Cells with more than one final record, and the runs."""
    return records.where(~F.col("status").isin(*EXCLUDED)).groupBy(key).agg(
        F.array_sort(F.collect_list("run_id")).alias("run_ids")
    ).where(F.size("run_ids") > 1)


def analysis_rows(records: DataFrame, questions: DataFrame, scored: DataFrame) -> DataFrame:
    """The fact table: excluded and contaminated runs go; accuracy and completion under a rule; tokens of completed runs.

    A missing verdict is null, never 0; a run that did not complete has completion 0 and no tokens or accuracy.
    """
    kept = records.where(~F.col("status").isin(*EXCLUDED) & ~F.col("contaminated"))
    out = kept.join(
        questions.select("question_id", F.col("stratum").alias("_s")), "question_id", "left"
    ).join(scored, "run_id", "left")
    done = F.col("status") == "completed"
    return out.select(
        "run_id", "agent", F.coalesce("_s", "stratum").alias("stratum"), "arm", "question_id", "repetition", "status", "compactions", "truncations",
        F.when(
            done, F.col("usage.total")
        ).alias("total_tokens"), F.when(done, F.col("accuracy")).alias("accuracy"), F.when(done, F.col("complete")).otherwise(F.lit(0.0)).alias("completion"),
        F.when(~done, F.lit("not_completed")).when(
            F.col("accuracy").isNull(), F.lit("missing")
        ).otherwise(F.lit("ok")).alias("judge_status"),
    )


def completed(records: DataFrame, agent: str, scored_only: bool = False) -> DataFrame:
    out = records.where((F.col("status") == "completed") & ~F.col("contaminated") & (F.col("agent") == agent))
    return out.where("stratum <> 'control'") if scored_only else out


def cell_report(rows: DataFrame, records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Questions, runs, completed and excluded attempts per cell (either side may lack a cell) and means of question means."""
    keys = keys or ["agent", "stratum", "arm"]
    counts = rows.groupBy(*keys).agg(
        F.count_distinct("question_id").alias("questions"),
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "completed").alias("completed"),
    )
    per = rows.groupBy(*keys, "question_id").agg(
        *[F.avg(v).alias(v) for v in ("total_tokens", "accuracy", "completion")]
    )
    means = per.groupBy(*keys).agg(*[F.avg(v).alias(f"mean_{v}") for v in ("total_tokens", "accuracy", "completion")])
    out_ = records.where(F.col("status").isin(*EXCLUDED)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("excluded_attempts")
    )
    return counts.join(means, keys).join(out_, keys, "full").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("questions", "runs", "completed", "excluded_attempts")}
    )


def multi_period(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Per question, agent and arm: distinct key filings, runs, repetitions with tokens, and means; in order of filings."""
    filings = facts.where("source.filing_uuid IS NOT NULL").groupBy("question_id").agg(
        F.count_distinct("source.filing_uuid").alias("distinct_key_filings")
    )
    per = rows.where("stratum = 'multi_period'").groupBy("question_id", "agent", "arm").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count("total_tokens").alias("completed_reps"),
        F.avg("total_tokens").alias("mean_total_tokens"),
        F.avg("accuracy").alias("mean_accuracy"),
    )
    return per.join(filings, "question_id", "left").withColumn(
        "distinct_key_filings", F.coalesce("distinct_key_filings", F.lit(0))
    ).orderBy("distinct_key_filings", "question_id", "agent", "arm")


def control_overhead(rows: DataFrame) -> DataFrame:
    """Mean tokens of the control questions per agent and arm, halves to even."""
    return rows.where("stratum = 'control'").groupBy("agent", "arm").agg(
        F.bround(F.avg("total_tokens"), 0).cast("bigint").alias("mean_tokens")
    )


def report_rows(records: DataFrame, analysis: DataFrame, answers: DataFrame, logs: DataFrame) -> DataFrame:
    """One row a run with what the analysis, the answer file and the log manifest say about it."""
    return records.join(
        analysis.drop("agent", "arm", "stratum", "question_id", "repetition", "status"), "run_id", "left"
    ).join(answers, "run_id", "left").join(logs, "run_id", "left")


def comparison_rows(comparisons: DataFrame, metrics: list[str]) -> DataFrame:
    """Nested comparison -> long table: a row for each metric that is there."""
    rows = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("interval")) for m in metrics])
    ).alias("x")
    keep = [c for c in comparisons.columns if c not in metrics]
    return comparisons.select(*keep, rows).where("x.interval IS NOT NULL").select(*keep, "x.metric", "x.interval.*")


def shared_runs(bias: DataFrame, own: DataFrame) -> DataFrame:
    """Runs of another campaign on shared questions. No run may be in both."""
    both = bias.join(own.select("question_id").distinct(), "question_id", "left_semi")
    clash = bias.select("run_id").intersect(own.select("run_id")).limit(1).count()
    if clash:
        raise ValueError("the two campaigns share a run")
    return both


def price_of(models: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Each model with its price: the exact name, else the first listed name that it starts with.

    Prices (name, ord, ...) are a short list; prefixes of the model are exploded so that the join is an equi-join.
    """
    asked = models.select(model).distinct().withColumn(
        "name",
        F.explode(F.transform(F.sequence(F.lit(1), F.length(model)), lambda k: F.substring(F.col(model), F.lit(1), k))),
    )
    best = Window.partitionBy(model).orderBy(F.when(F.col("name") == F.col(model), 0).otherwise(1), "ord")
    found = asked.join(prices, "name").withColumn(
        "_n", F.row_number().over(best)
    ).where("_n = 1").drop("_n", "ord", "name")
    return models.join(found, model, "left")


def call_cost(inp: Column, cached: Column, write: Column, out: Column, price: Column) -> Column:
    """One call at its own price; above the threshold of input tokens the multiplier holds for the whole call."""
    z = lambda c: F.coalesce(c, F.lit(0))
    fresh = z(inp) - z(cached) - z(write)
    cost = (
        fresh * price["input"] + z(cached) * price["cached_input"] + z(write) * price["cache_write"] + z(out) * price["output"]
    ) / 1_000_000
    return F.when(z(inp) > price["long_context_threshold"], cost * price["long_context_multiplier"]).otherwise(cost)


def run_cost(
    agent: Column,
    usage: Column,
    calls: Column,
    searches: Column,
    client: Column,
    auth: Column,
    price: Column,
    model: Column,
) -> Column:
    """struct(cost_usd, cost_basis): the client's own figure first, else calls at their prices, else the total at the plain rate."""
    per_call = F.aggregate(
        calls,
        F.lit(0.0),
        lambda a, c: a + call_cost(
            c["input_tokens"], c["cached_input_tokens"], c["cache_write_input_tokens"], c["output_tokens"], price
        ),
    )
    write = F.coalesce(usage["cache_write_input"], F.lit(0))
    flat = (
        (
            usage["uncached_input"] - write
        ) * price["input"] + usage["cached_input"] * price["cached_input"] + write * price["cache_write"] + usage["output"] * price["output"]
    ) / 1_000_000
    tokens = F.when(F.size(calls) > 0, per_call).otherwise(flat)
    pair = lambda c, why: F.struct(F.round(c, 6).alias("cost_usd"), why.alias("cost_basis"))
    none = F.lit(None).cast("double")
    return (
        F.when(usage.isNull(), pair(none, F.lit("no usage")))
        .when(
            (agent == "stream") & client.isNotNull(),
            pair(
                client,
                F.when(
                    auth == "api_key", F.lit("client estimate, metered")
                ).otherwise(F.lit("client estimate, plan allowance")),
            ),
        )
        .when(price.isNull() | price["input"].isNull(), pair(none, F.concat(F.lit("no price for "), model)))
        .otherwise(
            pair(
                tokens + searches * WEB_SEARCH_USD,
                F.when(auth == "plan", F.lit("list price equivalent, plan allowance")).otherwise(F.lit("list price")),
            )
        )
    )


def billable_searches(agent: Column, actions: Column) -> Column:
    """Searches of the server where it tells them, else search actions."""
    own = F.try_element_at(actions, F.lit("server_searches"))
    return F.coalesce(F.when(agent == "stream", own), F.try_element_at(actions, F.lit("search")), F.lit(0))


PROFILE = ("fresh", "cached", "write", "output", "searches", "calls")


def token_profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in PROFILE], F.count(F.lit(1)).alias("runs"))


def profile_rows(records: DataFrame) -> DataFrame:
    """Completed records -> profile columns; `calls` sums the tool calls below a prefix but for an exclusion list."""
    kept = F.map_filter("tool_calls", lambda k, _: k.startswith("mcp:") & ~k.rlike(r"resource"))
    return records.where("status = 'completed' AND usage IS NOT NULL").select(
        "agent",
        "arm",
        "question_id",
        (F.col("usage.uncached_input") - F.col("usage.cache_write_input")).alias("fresh"),
        F.col("usage.cached_input").alias("cached"),
        F.col("usage.cache_write_input").alias("write"),
        F.col("usage.output").alias("output"),
        billable_searches(F.col("agent"), F.col("web_actions")).alias("searches"),
        F.aggregate(F.map_values(kept), F.lit(0).cast("bigint"), lambda a, v: a + v).alias("calls"),
    )


def scaled(profile: DataFrame, factor: Column) -> DataFrame:
    return profile.withColumns({c: F.col(c) * factor for c in PROFILE})


def upper_profile(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Field-wise maximum."""
    return profile.groupBy(*keys).agg(*[F.max(c).alias(c) for c in PROFILE])


def estimate(cells: DataFrame, measured: DataFrame, pilot: DataFrame, proxy: DataFrame, repetitions: int) -> DataFrame:
    """Runs to come times the first profile there is: measured, pilot, then the maximum over arms of a proxy."""
    keys = ["agent", "arm"]
    top = upper_profile(proxy, ["agent"])
    named = lambda d, p: d.select(
        *[c for c in d.columns if c not in PROFILE and c != "runs"], *[F.col(c).alias(f"{p}_{c}") for c in PROFILE]
    )
    out = cells.join(
        named(measured, "m"), keys, "left"
    ).join(named(pilot, "p"), keys, "left").join(named(top, "x"), "agent", "left")
    basis = F.when(
        F.col("m_fresh").isNotNull(), "measured"
    ).when(F.col("p_fresh").isNotNull(), "pilot").when(F.col("x_fresh").isNotNull(), "proxy")
    runs = F.col("questions") * repetitions
    return out.select(
        "agent",
        "arm",
        "questions",
        runs.alias("runs"),
        basis.alias("basis"),
        *[(F.coalesce(f"m_{c}", f"p_{c}", f"x_{c}") * runs).alias(c) for c in PROFILE],
    )


def billing_warnings(feeds: dict[str, DataFrame]) -> DataFrame:
    """Feeds of (at, run_id, reasons array) as one table, a row a reason; repeats of a closing reading go."""
    out = None
    for name, f in feeds.items():
        part = f.select(F.lit(name).alias("feed"), "at", "run_id", F.explode("reasons").alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(["at", "run_id", "reason"])


def needs_work(
    items: DataFrame, results: DataFrame, key: str, most_batches: int = 2, bound: str | None = None
) -> DataFrame:
    """Items without an output, with an error and attempts left, or (bound) with an output of another prompt."""
    r = results.select(
        key,
        F.col("status").alias("_status"),
        F.col("batches").alias("_batches"),
        *([F.col(bound).alias("_bound")] if bound else []),
    )
    out = items.join(r, key, "left")
    again = F.col("_status").isNull() | (
        (F.col("_status") != "ok") & (F.coalesce(F.col("_batches"), F.lit(0)) < most_batches)
    )
    if bound:
        again = again | (F.col("_bound") != F.col(bound))
    return out.where(again).drop("_status", "_batches", "_bound")


def finally_failed(results: DataFrame, most_batches: int = 2) -> DataFrame:
    return results.where((F.col("status") != "ok") & (F.col("batches") >= most_batches))


def fan_out(batches: DataFrame, prior: DataFrame, key: str = "item") -> DataFrame:
    """Batch replies (batch, items array, error, labels map) -> an item a row; attempts counted on; an error goes to every item; latest wins."""
    rows = batches.select("batch", "error", "labels", F.explode("items").alias(key))
    new = rows.join(prior.select(key, F.col("batches").alias("_b")), key, "left").select(
        key,
        F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"),
        "error",
        F.try_element_at("labels", F.col(key)).alias("label"),
        (F.coalesce("_b", F.lit(0)) + 1).alias("batches"),
    )
    return latest_records(prior, new, key=key).orderBy(key)


def partition_checks(rows: DataFrame) -> DataFrame:
    """A state for each checked row: agree, disputed, failed or pending."""
    state = F.when(F.col("status").isNull(), "pending").when(F.col("status") != "ok", "failed").when(
        F.col("verdict") == F.col("effective"), "agree"
    ).otherwise("disputed")
    return rows.withColumn("state", state)


def all_or_nothing(rows: DataFrame) -> DataFrame:
    """The rows, if none of them is pending; else none."""
    waiting = rows.where("state = 'pending'").limit(1).count()
    return rows.limit(0) if waiting else rows
