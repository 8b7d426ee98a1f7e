"""The remaining operators, one small case each."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import extraction, provenance, runs, sampling, stats, validation, verdicts
from tallyspark.sources import readers, sinks


def test_side_logs(spark):
    base = spark.createDataFrame(
        [("r", {"a": "connected", "b": "connected"}, "server_overloaded", None)],
        "run_id string, mcp_servers map<string,string>, infra_reason string, incomplete_reason string",
    )
    out = [
        {"type": "mcp_startup_update", "server": "a", "status": {"state": "Ready"}},
        {"msg": {"type": "mcp_startup_complete", "failed": [{"server": "c"}]}},
        {"type": "turn.failed", "error": {"message": "context too long"}},
        {"type": "error", "message": "usage limit"},
    ]
    stdout = spark.createDataFrame(
        [("r", i, json.dumps(x)) for i, x in enumerate(out)], "run_id string, ord bigint, raw string"
    )
    stderr = spark.createDataFrame([("r", "MCP client for `b` failed to start")], "run_id string, text string")
    r = extraction.fold_side_logs(base, stdout, stderr).first()
    assert r.mcp_servers == {
        "a": "connected", "b": "failed", "c": "failed"
    } and r.infra_reason == "usage_limit_exceeded" and r.incomplete_reason.startswith("turn.failed: context")


def test_log_problem(spark):
    rows = spark.createDataFrame(
        [("a", True, 1), ("b", False, 1), ("c", True, None)], "run_id string, ended boolean, usage int"
    )
    assert {
        r.run_id: r.problem for r in extraction.log_problem(rows, "ended").collect()
    } == {"a": None, "b": "no end of the task in the log", "c": "no usage in the log"}


def test_run_record(spark):
    meta = spark.createDataFrame(
        [("r", "rollout", "web", "Q1", 2)],
        "run_id string, agent string, arm string, question_id string, repetition int",
    )
    ex = spark.createDataFrame([("r", "m")], "run_id string, model string")
    cost = spark.createDataFrame([("r", 1.5)], "run_id string, cost_usd double")
    hits = spark.createDataFrame([("r", ["x"])], "run_id string, hits array<string>")
    r = extraction.run_records(ex, meta, cost, hits).first()
    assert (r.run_key, r.model, r.cost_usd, r.contaminated) == ("rollout.web.Q1.r2", "m", 1.5, True)


def test_readings(spark):
    a = spark.createDataFrame([("x", 1, "old"), ("y", 5, "y")], "account string, observed_at int, reading string")
    b = spark.createDataFrame([("x", 3, "new")], a.schema)
    assert {r.account: r.reading for r in extraction.latest_reading(a, b).collect()} == {"x": "new", "y": "y"}
    row = spark.createDataFrame(
        [('{"email": "a@b", "n": 1, "in": {"userId": 5}}', ["guard: a; b", "note", "guard: a"])],
        "raw string, notes array<string>",
    )
    got = row.select(
        extraction.without_accounts(F.col("raw")).alias("raw"),
        extraction.guard_notes(F.col("notes"), "guard: ").alias("g"),
    ).first()
    assert json.loads(got.raw) == {"n": 1, "in": {}} and got.g == ["a", "b"]


def test_reading_problems(spark):
    kind = "r struct<primary:struct<used_percent:double,resets_at:bigint>,secondary:struct<used_percent:double,resets_at:bigint>,credits:struct<has_credits:boolean>>"
    rows = spark.createDataFrame([(((1.0, 5), (float("nan"), 5), None),), ((None, (1.0, None), (None,)),)], kind)
    got = [r.p for r in rows.select(validation.reading_problems(F.col("r")).alias("p")).collect()]
    assert got == [
        ["secondary: used percent is no number"],
        ["no primary window", "secondary: no reset time", "credits without a flag"],
    ]


def test_estimate(spark):
    cells = spark.createDataFrame(
        [("a", "web", 10), ("a", "both", 10), ("b", "web", 10)], "agent string, arm string, questions int"
    )
    kind = "agent string, arm string, " + ", ".join(f"{c} double" for c in runs.PROFILE)
    measured = spark.createDataFrame([("a", "web", *[1.0] * 6)], kind)
    pilot = spark.createDataFrame([("a", "both", *[2.0] * 6)], kind)
    proxy = spark.createDataFrame([("b", "x", *[3.0] * 6), ("b", "y", *[4.0] * 6)], kind)
    got = {(r.agent, r.arm): (r.basis, r.fresh) for r in runs.estimate(cells, measured, pilot, proxy, 3).collect()}
    assert got == {("a", "web"): ("measured", 30.0), ("a", "both"): ("pilot", 60.0), ("b", "web"): ("proxy", 120.0)}


def test_profile_rows_and_run_cost(spark):
    usage = "usage struct<total:bigint,input:bigint,cached_input:bigint,cache_write_input:bigint,uncached_input:bigint,output:bigint,reasoning:bigint>"
    rows = spark.createDataFrame(
        [
            (
                "rollout",
                "web",
                "Q",
                "completed",
                (0, 0, 1_000_000, 0, 1_000_000, 100_000, None),
                {"mcp:a.find": 2, "mcp:c.read_mcp_resource": 1, "shell": 9},
                {"search": 3},
            )
        ],
        f"agent string, arm string, question_id string, status string, {usage}, tool_calls map<string,bigint>, web_actions map<string,bigint>",
    )
    p = runs.profile_rows(rows).first()
    assert (p.fresh, p.cached, p.output, p.searches, p.calls) == (1_000_000, 1_000_000, 100_000, 3, 2)
    price = F.struct(
        F.lit(2.0).alias("input"),
        F.lit(0.1).alias("cached_input"),
        F.lit(2.5).alias("cache_write"),
        F.lit(10.0).alias("output"),
        F.lit(272_000).alias("long_context_threshold"),
        F.lit(2.0).alias("long_context_multiplier"),
    )
    calls = F.array().cast(
        "array<struct<input_tokens:bigint,cached_input_tokens:bigint,cache_write_input_tokens:bigint,output_tokens:bigint>>"
    )
    c = rows.select(
        runs.run_cost(
            F.col("agent"),
            F.col("usage"),
            calls,
            runs.billable_searches(F.col("agent"), F.col("web_actions")),
            F.lit(None).cast("double"),
            F.lit("plan"),
            price,
            F.lit("m"),
        ).alias("c")
    ).first().c
    assert c.cost_usd == pytest.approx(2.0 + 0.1 + 1.0 + 0.03) and "plan" in c.cost_basis
    none = rows.select(
        runs.run_cost(
            F.lit("stream"), F.col("usage"), calls, F.lit(0), F.lit(0.5), F.lit("api_key"), price, F.lit("m")
        ).alias("c")
    ).first().c
    assert none == (0.5, "client estimate, metered")


def test_campaign_overlap(spark):
    a = spark.createDataFrame([("1", "Q1"), ("2", "Q9")], "run_id string, question_id string")
    b = spark.createDataFrame([("3", "Q1")], a.schema)
    assert [r.run_id for r in runs.shared_runs(a, b).collect()] == ["1"]
    with pytest.raises(ValueError):
        runs.shared_runs(a, a)


def test_all_or_nothing(spark):
    rows = spark.createDataFrame([("agree",), ("pending",)], "state string")
    assert runs.all_or_nothing(rows).count() == 0 and runs.all_or_nothing(rows.where("state = 'agree'")).count() == 1


def test_analysis_rows(spark):
    rec = spark.createDataFrame(
        [
            ("a", "completed", False, (5,)),
            ("b", "timeout", False, (7,)),
            ("c", "invalid", False, (9,)),
            ("d", "completed", True, (9,)),
            ("e", "completed", False, (6,)),
        ],
        "run_id string, status string, contaminated boolean, usage struct<total:bigint>",
    )
    rec = rec.withColumns(
        {
            "agent": F.lit("x"),
            "arm": F.lit("web"),
            "question_id": F.lit("Q"),
            "stratum": F.lit("old"),
            "repetition": F.lit(1),
            "compactions": F.lit(0),
            "truncations": F.lit(0),
        }
    )
    q = spark.createDataFrame([("Q", "lookup")], "question_id string, stratum string")
    scored = spark.createDataFrame([("a", 0.5, 1.0)], "run_id string, accuracy double, complete double")
    got = {
        r.run_id: (
            r.total_tokens, r.accuracy, r.completion, r.judge_status, r.stratum
        ) for r in runs.analysis_rows(rec, q, scored).collect()
    }
    assert got == {
        "a": (5, 0.5, 1.0, "ok", "lookup"),
        "b": (None, None, 0.0, "not_completed", "lookup"),
        "e": (6, None, None, "missing", "lookup"),
    }


def judgements(spark):
    p = lambda v, c=True, e=None: ({}, v, c, e, 1)
    rows = [
        (
            "a",
            "ok",
            "combined",
            0.75,
            1.0,
            {"F": "correct"},
            {"F": 1.0},
            [],
            {"A": p({"F": "correct", "G": "missing"}), "B": p({"F": "correct", "G": "correct"})},
            1,
        ),
        (
            "b",
            "judge_error",
            None,
            None,
            None,
            {},
            {},
            [],
            {"A": p({"F": "odd"}), "B": p({"F": "incorrect"}, False)},
            1,
        ),
    ]
    return spark.createDataFrame(rows, readers.JUDGEMENT)


def test_scoring_rules(spark):
    j = judgements(spark)
    assert [(r.run_id, r.accuracy) for r in verdicts.scoring(j).collect()] == [("a", 0.75)]
    assert {
        r.run_id: (r.accuracy, r.complete) for r in verdicts.scoring(j, "B").collect()
    } == {"a": (1.0, 1.0), "b": (0.0, 0.0)}
    assert {r.run_id: r.accuracy for r in verdicts.single_judge(j, "A").collect()} == {"a": 0.5}
    pairs = verdicts.verdict_pairs(j)
    assert sorted((r.fact_id, r.a, r.b) for r in pairs.collect()) == [
        ("F", "correct", "correct"), ("G", "missing", "correct")
    ]
    assert readers.judgement_passes(j).count() == 4


def test_replace_passes(spark):
    row = spark.createDataFrame([({"A": "1", "B": "2"}, {"B": "3"})], "p map<string,string>, n map<string,string>")
    assert row.select(
        verdicts.replace_passes(F.col("p"), F.col("n"), ["B"]).alias("m")
    ).first().m == {"A": "1", "B": "3"}


def test_audit_table_and_unknown(spark):
    queue = spark.createDataFrame([("r", "F1", "disputed")], "run_id string, fact_id string, selection string")
    rec = spark.createDataFrame([("r", "Q1", "x")], "run_id string, question_id string, agent string")
    q = spark.createDataFrame([("Q1", "what?")], "id string, question string")
    facts = spark.createDataFrame(
        [("Q1", "F1", "s", "v", "u")], "question_id string, fact_id string, statement string, value string, unit string"
    )
    pairs = spark.createDataFrame(
        [("r", "F1", "correct", "missing")], "run_id string, fact_id string, a string, b string"
    )
    r = verdicts.audit_table(queue, rec, q, facts, pairs).first()
    assert (r.question, r.statement, r.a, r.b) == ("what?", "s", "correct", "missing")
    assert verdicts.unknown_audits(queue, facts.withColumn("run_id", F.lit("z"))).count() == 1


def fact_rows(spark, rows):
    base = "question_id string, fact_id string, kind string, value string, chunk string, parts array<string>, row string, category string, against string"
    f = spark.createDataFrame(rows, base)
    source = F.struct(F.lit("f").alias("filing_uuid"), F.col("chunk").alias("chunk_id"), F.lit("quote").alias("quote"))
    return f.select(
        "question_id",
        "fact_id",
        "kind",
        "value",
        source.alias("source"),
        F.col("parts").alias("computed_from"),
        F.lit("x+y").alias("formula"),
        F.lit("why").alias("absence_reason"),
        F.array(F.lit("t")).alias("absent_terms"),
        F.col("row").alias("crosscheck_row"),
        F.col("category").alias("source_category"),
        F.col("against").alias("contradicts"),
    )


def test_contamination_rules(spark):
    f = fact_rows(
        spark,
        [
            ("Q1", "F1", "sourced", "1", "c", None, None, None, None),
            ("Q1", "T1", "trap", "1 000", "c", None, "X1", "forum", "F1"),
            ("Q1", "T2", "trap", "7", "c", None, "X2", "forum", "F9"),
            ("Q1", "T3", "trap", "7", "c", None, "X9", "forum", "F1"),
        ],
    )
    q = spark.createDataFrame([("Q1", "trap"), ("Q2", "control")], "id string, role string")
    sample = spark.createDataFrame(
        [("X1", "forum", "1000"), ("X2", "aggregator", "8")], "row_id string, category string, value string"
    )
    checks = spark.createDataFrame([("X1", "contradicted"), ("X2", "confirmed")], "row_id string, bin string")
    got = {
        (r.rule, r.subject) for r in validation.validate_contamination(
            q, f, {"trap": 1, "control": 1}, sample, checks
        ).collect()
    }
    assert got == {
        ("trap of a row that is not contradicted", "T2"),
        ("trap of another category", "T2"),
        ("trap of another value", "T2"),
        ("trap that contradicts no fact", "T2"),
        ("trap without a check row", "T3"),
    }


def test_evidence_and_passages(spark):
    f = fact_rows(
        spark,
        [
            ("Q1", "F1", "sourced", "1", "c1", None, None, None, None),
            ("Q1", "F2", "absence", "1", None, None, None, None, None),
            ("Q1", "F3", "computed", "1", None, ["F2", "F1"], None, None, None),
        ],
    )
    passages = spark.createDataFrame([("c1", "whole passage")], "chunk_id string, text string")
    got = {r.fact_id: r.text for r in validation.evidence(f, passages).collect()}
    assert got == {"F1": "quote\nwhole passage", "F2": "why\nt", "F3": "x+y\nwhy\nt\nquote\nwhole passage"}
    fix = spark.createDataFrame(
        [("Q1", "F1", [("c7", "p", "q")], (("f", "c8"),))],
        "question_id string, fact_id string, also_stated array<struct<chunk_id:string,permalink:string,quote:string>>, fields struct<source:struct<filing_uuid:string,chunk_id:string>>",
    )
    assert sorted(r.chunk_id for r in validation.needed_passages(f, fix, passages).collect()) == ["c7", "c8"]


def test_stale_passes(spark):
    runs_ = spark.createDataFrame(
        [("a", "Q1", "completed"), ("b", "Q1", "completed"), ("c", "Q2", "completed")],
        "run_id string, question_id string, status string",
    )
    fix = spark.createDataFrame([("Q1", "F1")], "question_id string, fact_id string")
    j = judgements(spark).withColumn("corrections_digest", F.when(F.col("run_id") == "b", F.lit("now")))
    assert [r.run_id for r in validation.stale_passes(None, fix, runs_, j, "B", "now").collect()] == ["a"]


def test_small_validators(spark):
    assert validation.same_inputs("a", "a") is None and "changed" in validation.same_inputs("a", "b")
    rows = spark.createDataFrame(
        [("p", "r", "combined", "x"), ("p", "s", "B", " ")], "_path string, run_id string, rule string, verdict string"
    )
    assert [r.subject for r in validation.audit_rule(rows, "combined").collect()] == ["s"]
    assert [(r._path, r.filled) for r in validation.filled(rows, ["verdict"]).collect()] == [("p", 1)]
    assert rows.select(validation.prompt("Q: {q}?", q=F.col("run_id")).alias("t")).first().t == "Q: r?"


def test_exposure_shares_and_claims(spark):
    src = spark.createDataFrame(
        [
            ("r", "Q", "shown", "k1", "forum"),
            ("r", "Q", "shown", "k2", "news"),
            ("r", "Q", "archive", "k3", "filing"),
            ("r", "Q", "summary", "k4", "other"),
        ],
        "run_id string, question_id string, kind string, key string, category string",
    )
    e = provenance.run_exposure(src, ["run_id", "question_id"])
    r = e.first()
    assert (
        r.shown_forum, r.opened_filing, r.search_summaries, r.forum_shown_only, r.either_touched, r.aggregator_touched
    ) == (1, 1, 1, True, True, False)
    shares = {(x.kind, x.category): (x.a, x.b) for x in provenance.exposure_shares(e, ["run_id"]).collect()}
    assert shares["shown", "forum"] == (1.0, 2.0) and shares["opened", "filing"] == (1.0, 1.0)
    claims = spark.createDataFrame(
        [("r", 1, ["S1", "S2"], ["a", "a", "b"], "filing", "news")],
        "run_id string, claim_index int, sources array<string>, hosts array<string>, label string, numbers_only_label string",
    )
    links = spark.createDataFrame(
        [("r", "S1", "https://www.reddit.com/x"), ("r", "S9", "https://z.example")],
        "run_id string, token string, url string",
    )
    cats = spark.createDataFrame([("reddit.com", "forum")], "host string, category string")
    assert provenance.cited_categories(claims, links, cats).first().cited == ["forum"]
    assert provenance.claim_rows(claims).first().hosts == "a; b" and provenance.numbers_only(claims).first().label == "news"
    named = provenance.host_rows(
        spark.createDataFrame(
            [("f1.example", "r1", "shown", "filing"), ("f2.example", "r2", "opened", "filing")],
            "host string, run_id string, kind string, category string",
        ),
        r"^f\d",
    )
    assert [(x.host, x.runs, x.kinds) for x in named.collect()] == [("filing-source", 2, ["opened", "shown"])]


def test_inventory_examples(spark):
    src = spark.createDataFrame(
        [("r", i, "h", "shown", f"t{i // 2}", "", ["C"]) for i in range(10)],
        "run_id string, ord bigint, host string, kind string, title string, snippet string, companies array<string>",
    )
    links = spark.createDataFrame([("r2", "https://h", ["D"])], "run_id string, url string, companies array<string>")
    r = provenance.host_inventory(src, links).first()
    assert [
        x.title for x in r.examples
    ] == ["t0", "t1", "t2"] and r.runs == 2 and r.kinds == ["cited", "shown"] and r.companies == ["C", "D"]


def test_extension_and_text_sample(spark):
    rows = spark.createDataFrame(
        [(f"C{i:02d}", "a", "s", "reported_figure" if i % 2 else "other") for i in range(40)],
        "claim_id string, category string, stratum string, kind string",
    )
    first = sampling.stratified_sample(rows, ["category", "stratum"], "claim_id", 10)
    more = sampling.extension_sample(rows, first, ["category", "stratum"], "claim_id", 8, "reported_figure")
    got = more.collect()
    assert len(got) == 8 and {r.kind for r in got} == {"reported_figure"} and not {r.claim_id for r in got} & {
        r.claim_id for r in first.collect()
    } and min(r.row_id for r in got) == "E001"
    pool = rows.withColumnRenamed("claim_id", "text_id")
    assert sampling.text_sample(pool, 12, 5).count() == 12


def test_report_pieces(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", 60, 10), ("a", 30, 10), ("b", 20, 95), ("c", 5, 5)], "run_id string, size int, text_size int"
    )
    assert {r.run_id: r.shard for r in sinks.run_shards(rows, 100).collect()} == {"a": 0, "b": 1, "c": 1}
    assert sinks.markdown_table(
        spark.createDataFrame([("x|y", 1)], "a string, b int"), ["a", "b"], ["a"]
    ) == "| a | b |\n|---|---|\n| x\\|y | 1 |\n"
    sinks.json_document({"k": [1]}, str(tmp_path / "o" / "d.json"))
    assert json.loads((tmp_path / "o" / "d.json").read_text()) == {"k": [1]}
    ans = spark.createDataFrame(
        [("r", "see https://u@h.example/x token = abc", "a", "b")],
        "run_id string, text string, pointer string, canonical string",
    )
    r = sinks.canonical_answers(ans).first()
    assert r.text == "see <url:h.example> token = <redacted>" and r.mismatch
    flat = sinks.flat_intervals(
        spark.createDataFrame([("c", (1.0, 2))], "cell string, interval struct<estimate:double,n:int>")
    )
    assert flat.columns == ["cell", "estimate", "n"]
    sinks.append_rows(rows, str(tmp_path / "ledger"))
    sinks.append_rows(rows, str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "ledger")).count() == 8


def test_safe_prompt(spark):
    df = spark.createDataFrame([("at https://f.example/x",)], "t string")
    assert df.select(text.safe_prompt(F.col("t"), r"f\.example").alias("t")).first().t == "at <url:filing-source>"
    with pytest.raises(Exception, match="masked host"):
        spark.createDataFrame([("filing-source",)], "t string").select(
            text.safe_prompt(F.col("t"), "filing-source").alias("t")
        ).collect()


def test_small_text_functions(spark):
    df = spark.createDataFrame(
        [([f"c{i}" for i in range(23)], "2024-01-02T03:04:05Z", "inf", "4.5")],
        "c array<string>, t string, x string, y string",
    )
    r = df.select(
        text.companies_text(F.col("c")).alias("c"),
        text.parse_time(F.col("t")).alias("t"),
        text.finite(F.col("x")).alias("x"),
        text.finite(F.col("y")).alias("y"),
        text.masked_hosts_in(F.lit("A.example b a.EXAMPLE"), r"a\.example").alias("h"),
    ).first()
    assert r.c.endswith("c19 and 3 more") and str(r.t) == "2024-01-02 03:04:05" and r.x is None and r.y == 4.5 and r.h == ["a.example"]


def test_single_judge_grid(spark):
    rows = spark.createDataFrame(
        [("x", "s", a, q, 1.0, v, 1.0, v / 2, 1.0) for a, v in (("web", 0.5), ("archive", 1.0)) for q in ("A", "B")],
        "agent string, stratum string, arm string, question_id string, total_tokens double, a1 double, c1 double, a2 double, c2 double",
    )
    got = {
        (r.judge, r.metric): r.estimate for r in stats.single_judge_grid(
            rows, {"A": ("a1", "c1"), "B": ("a2", "c2")}, resamples=20
        ).where("arm = 'archive' AND baseline = 'web'").collect()
    }
    assert got["A", "accuracy_diff_arm_minus_baseline"] == 0.5 and got["B", "accuracy_diff_arm_minus_baseline"] == 0.25
