"""Verdicts of two judges: validity, merging, agreement, corrections by audits, and audit samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The verdicts and what they score.
VERDICTS = ("correct", "incorrect", "missing")
SCORES = {"correct": 1.0, "incorrect": 0.0, "missing": 0.0, "disputed": 0.5}
SAMPLE = 0.05


def score(verdict: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in SCORES.items():
        out = F.when(verdict == k, F.lit(v)).otherwise(out)
    return out


def valid_pass(stored: Column) -> Column:
    """Fact -> verdict of a stored pass without an error, with known verdicts only and a flag for completeness; else null."""
    v = stored["fact_verdicts"]
    ok = F.coalesce(F.nullif(stored["error"], F.lit("")), F.lit("")) == ""
    return F.when(
        ok & (F.size(v) > 0) & F.forall(
            F.map_values(v), lambda x: F.coalesce(x.isin(*VERDICTS), F.lit(False))
        ) & stored["complete"].isNotNull(),
        v,
    )


def merge_passes(first: Column, second: Column, complete_first: Column, complete_second: Column) -> Column:
    """struct(fact_verdicts, fact_scores, disputed, accuracy, complete, rule) of one or two valid passes.

    Two passes: equal verdicts stand, different ones are disputed and score a half; complete is 1, a half or 0. One pass
    scores alone.
    """
    both = F.map_zip_with(first, second, lambda _, a, b: F.when(a.eqNullSafe(b), a).otherwise(F.lit("disputed")))
    two = first.isNotNull() & second.isNotNull()
    verdicts = F.when(two, both).otherwise(F.coalesce(first, second))
    scores = F.transform_values(verdicts, lambda _, v: score(v))
    rule = F.when(two, F.lit("combined")).when(first.isNotNull(), F.lit("A")).when(second.isNotNull(), F.lit("B"))
    one = F.coalesce(F.when(first.isNotNull(), complete_first), complete_second).cast("double")
    whole = F.when(two, (complete_first.cast("double") + complete_second.cast("double")) / 2).otherwise(one)
    return F.when(
        rule.isNotNull(),
        F.struct(
            verdicts.alias("fact_verdicts"),
            scores.alias("fact_scores"),
            F.array_sort(F.map_keys(F.map_filter(verdicts, lambda _, v: v == "disputed"))).alias("disputed"),
            mean_score(scores).alias("accuracy"),
            whole.alias("complete"),
            rule.alias("rule"),
        ),
    )


def mean_score(scores: Column) -> Column:
    return F.when(
        F.size(scores) > 0,
        F.round(F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, v: a + v) / F.size(scores), 6),
    )


def scoring(judgements: DataFrame, primary: str = "combined") -> DataFrame:
    """run_id, verdicts, scores, accuracy and completion under a rule: both judges together, or the second alone."""
    if primary == "combined":
        ok = (F.col("status") == "ok") & (F.coalesce("rule", F.lit("combined")) == "combined")
        return judgements.where(ok).select(
            "run_id",
            F.col("fact_verdicts").alias("verdicts"),
            F.col("fact_scores").alias("scores"),
            "accuracy",
            "complete",
        )
    v = valid_pass(F.try_element_at("passes", F.lit(primary)))
    out = judgements.withColumn("verdicts", v).where("verdicts IS NOT NULL")
    scores = F.transform_values("verdicts", lambda _, x: score(x))
    return out.select(
        "run_id",
        "verdicts",
        scores.alias("scores"),
        mean_score(scores).alias("accuracy"),
        F.try_element_at("passes", F.lit(primary))["complete"].cast("double").alias("complete"),
    )


def single_judge(judgements: DataFrame, name: str) -> DataFrame:
    """run_id, accuracy and completion of one judge alone, whatever became of the other."""
    v = valid_pass(F.try_element_at("passes", F.lit(name)))
    out = judgements.withColumn("v", v).where("v IS NOT NULL")
    right = F.size(F.map_filter("v", lambda _, x: x == "correct"))
    return out.select(
        "run_id",
        F.round(right / F.size("v"), 6).alias("accuracy"),
        F.try_element_at("passes", F.lit(name))["complete"].cast("double").alias("complete"),
    )


def replace_passes(prior: Column, new: Column, requested: list[str]) -> Column:
    """Stored passes but for the requested ones, and the new ones."""
    return F.map_concat(F.map_filter(prior, lambda k, _: ~k.isin(*requested)), new)


def verdict_pairs(judgements: DataFrame, first: str = "A", second: str = "B") -> DataFrame:
    """run_id, fact_id, a, b over facts that both passes judged validly."""
    j = judgements.select(
        "run_id",
        valid_pass(F.try_element_at("passes", F.lit(first))).alias("x"),
        valid_pass(F.try_element_at("passes", F.lit(second))).alias("y"),
    )
    rows = j.where("x IS NOT NULL AND y IS NOT NULL").select("run_id", "y", F.explode("x").alias("fact_id", "a"))
    return rows.select(
        "run_id", "fact_id", "a", F.try_element_at("y", F.col("fact_id")).alias("b")
    ).where("b IS NOT NULL")


def cross_table(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return pairs.groupBy(*(keys or []), "a", "b").agg(F.count(F.lit(1)).alias("facts"))


def pass_agreement(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Answers, facts, facts with equal verdicts and their share."""
    equal = F.col("a") == F.col("b")
    return pairs.groupBy(*(keys or [])).agg(
        F.count_distinct("run_id").alias("answers"),
        F.count(F.lit(1)).alias("facts"),
        F.count_if(equal).alias("agreed_facts"),
        F.round(F.avg(equal.cast("int")), 4).alias("agreement_share"),
    )


def verdict_rates(long: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each verdict per judge and family of answers (long: keys, run_id, verdict)."""
    return long.groupBy(*keys).agg(
        F.count_distinct("run_id").alias("runs"),
        F.count(F.lit(1)).alias("facts"),
        *[F.round(F.avg((F.col("verdict") == v).cast("int")), 4).alias(f"{v}_rate") for v in VERDICTS],
    )


def audited_scores(scores: Column, corrections: Column) -> Column:
    """Scores with the audited facts replaced; facts that were not scored stay out."""
    return F.transform_values(scores, lambda k, v: F.coalesce(F.try_element_at(corrections, k), v))


def trap_adoption(verdicts: Column) -> Column:
    """Share of a question's traps that an answer adopted."""
    return F.when(F.size(verdicts) > 0, F.size(F.map_filter(verdicts, lambda _, v: v == "adopted")) / F.size(verdicts))


def regrade_stability(before: Column, after: Column, corrected: Column) -> Column:
    """struct(shared, stable): facts in both maps that were not corrected, and those with the same verdict."""
    both = F.map_filter(
        F.map_zip_with(
            before,
            after,
            lambda k, a, b: F.when(a.isNotNull() & b.isNotNull() & ~F.array_contains(corrected, k), a == b),
        ),
        lambda _, v: v.isNotNull(),
    )
    return F.struct(F.size(both).alias("shared"), F.size(F.map_filter(both, lambda _, v: v)).alias("stable"))


def audit_queue(facts: DataFrame, seed: int = 8105, share: float = SAMPLE) -> DataFrame:
    """Every disputed fact, and a seeded share of the others (run_id, fact_id, verdict, disputed).

    The sample is the first by a hash of seed, run and fact: the same on any engine and order. Ranks come from a window
    over the hash's leading digit and counts of the digits before, so no task sorts all facts.
    """
    agreed = facts.where("NOT disputed").withColumn(
        "_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), "run_id", "fact_id"), 256)
    )
    wanted = int(round(agreed.count() * share))
    kept = hash_first(agreed, "_h", wanted).drop("_h")
    return facts.where("disputed").withColumn("selection", F.lit("disputed")).unionByName(
        kept.withColumn("selection", F.lit("sample"))
    )


def hash_first(rows: DataFrame, digest: str, wanted: int) -> DataFrame:
    """The `wanted` rows with the least digests: whole digest prefixes first, a window only in the prefix at the border."""
    if wanted <= 0:
        return rows.limit(0)
    per = rows.groupBy(  # 4096 rows at most
        F.substring(digest, 1, 3).alias("p")
    ).agg(F.count(F.lit(1)).alias("n")).collect()
    left, border, whole = wanted, None, ""
    for r in sorted(per):
        if r.n > left:
            border = r.p
            break
        left -= r.n
        whole = r.p
    taken = rows.where(F.substring(digest, 1, 3) <= whole) if whole else rows.limit(0)
    if border is None or not left:
        return taken
    edge = rows.where(F.substring(digest, 1, 3) == border).orderBy(digest).limit(left)
    return taken.unionByName(edge)


def audit_precedence(rows: DataFrame, by: tuple[str, ...] = ("owner", "key_correction")) -> DataFrame:
    """One correction per run and fact: by source in order; conflicting verdicts of one source are an error, others superseded."""
    ranked = rows.withColumn("_rank", F.array_position(F.array(*map(F.lit, by)), F.col("source")))
    clash = ranked.groupBy("run_id", "fact_id", "_rank").agg(F.count_distinct("verdict").alias("n")).where("n > 1")
    bad = clash.limit(1).collect()
    if bad:
        raise ValueError(f"two verdicts of one source for {bad[0].run_id} {bad[0].fact_id}")
    first = Window.partitionBy("run_id", "fact_id").orderBy("_rank")
    return ranked.dropDuplicates(["run_id", "fact_id", "_rank"]).withColumn(
        "superseded", F.row_number().over(first) > 1
    ).drop("_rank")


def unknown_audits(audits: DataFrame, facts: DataFrame) -> DataFrame:
    """Audit rows for facts that no judgement has."""
    return audits.join(facts.select("run_id", "fact_id").distinct(), ["run_id", "fact_id"], "left_anti")


def audit_table(
    queue: DataFrame, records: DataFrame, questions: DataFrame, facts: DataFrame, pairs: DataFrame
) -> DataFrame:
    """Queue rows with the run, the question, the fact and both verdicts beside them."""
    return queue.join(records.select("run_id", "question_id", "agent"), "run_id").join(questions.select(F.col("id").alias("question_id"), "question"), "question_id").join(
        facts.select("question_id", "fact_id", "statement", "value", "unit"), ["question_id", "fact_id"]
    ).join(pairs, ["run_id", "fact_id"], "left")


def judge_replies(extraction: DataFrame) -> DataFrame:
    """Judge call logs, extracted like any log, as replies: text, usage, and why a reply may not be used.

    A judge may call no tool and load no server; a log without an answer or with a reason of its own is no reply.
    """
    tools = F.when(
        F.size("tool_calls") > 0,
        F.concat(F.lit("tools used: "), F.array_join(F.array_sort(F.map_keys("tool_calls")), ", ")),
    )
    servers = F.when(
        F.size("mcp_servers") > 0,
        F.concat(F.lit("servers loaded: "), F.array_join(F.array_sort(F.map_keys("mcp_servers")), ", ")),
    )
    none = F.when(F.trim("answer") == "", F.lit("no answer"))
    return extraction.select(
        "run_id",
        F.col("answer").alias("reply"),
        "usage",
        F.coalesce("infra_reason", tools, servers, "incomplete_reason", none).alias("error"),
    )


def checked_rows(sample: DataFrame, checks: DataFrame) -> DataFrame:
    """Sampled claims with their check results; a row without one has a null status."""
    return sample.join(checks.select("row_id", "status", "bin", "subtype", "merit", "restatement"), "row_id", "left")


def contamination_summary(rows: DataFrame, arm: str = "arm", question: str = "question_id") -> DataFrame:
    """Per arm: trap adoption, accuracy and tokens as means of question means, filing share of what was read, runs.

    Rows: one a run with adoption, accuracy, total_tokens, filings and sources (both counts).
    """
    share = F.col("filings") / F.nullif(F.col("sources"), F.lit(0))
    per = rows.withColumn("share", share).groupBy(arm, question).agg(
        *[F.avg(c).alias(c) for c in ("adoption", "accuracy", "total_tokens", "share")], F.count(F.lit(1)).alias("n")
    )
    return per.groupBy(arm).agg(
        *[F.avg(c).alias(c) for c in ("adoption", "accuracy", "total_tokens", "share")], F.sum("n").alias("runs")
    )
