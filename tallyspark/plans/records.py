"""Queries of run records, claims, samples and prices over the driver tables, with SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.functions import numbers, text
from tallyspark.operators import provenance, runs, sampling, stats, validation, verdicts

from .files import _text
from .registry import HASHES, HOST_SQL, RUNS, _page_categories, draws_sql, event_runs, query, r6, table
from .scratch import new_folder


# --- the fact table -----------------------------------------------------------------------------------


def _records(spark, sf_dir: str):
    """Runs of events as records: a few contaminated, usage as a struct."""
    i = F.col("run_id")
    rows = event_runs(spark, sf_dir).withColumns(
        {"contaminated": i % 19 == 0, "usage": F.struct((i * 3).alias("total"))}
    )
    return rows.drop("total_tokens", "accuracy", "completion")


@query(f"""WITH {RUNS} SELECT run_id, agent, CASE WHEN question_id % 2 = 0 THEN 'q' || (question_id % 3) ELSE stratum END AS stratum, arm, status,
 CASE WHEN status = 'completed' THEN CAST(run_id * 3 AS DOUBLE) END AS total_tokens, CASE WHEN status = 'completed' AND run_id % 4 <> 0 THEN
 (run_id % 5) / 4.0 END AS accuracy, CASE WHEN status <> 'completed' THEN 0.0 WHEN run_id % 4 <> 0 THEN CAST(run_id % 2 AS DOUBLE) END AS
 completion,
 CASE WHEN status <> 'completed' THEN 'not_completed' WHEN run_id % 4 = 0 THEN 'missing' ELSE 'ok' END AS judge_status FROM runs WHERE
 status NOT IN ('invalid', 'infra_error') AND run_id % 19 <> 0""")
def analysis_rows(spark, sf_dir):
    """Excluded and contaminated runs go; a missing verdict is null, a run that did not complete has completion 0."""
    i, q = F.col("run_id"), F.col("question_id")
    records = _records(spark, sf_dir)
    questions = records.where(q % 2 == 0).select("question_id", _text("q", q % 3).alias("stratum")).distinct()
    scored = records.where(i % 4 != 0).select(
        "run_id", ((i % 5) / 4.0).alias("accuracy"), (i % 2).cast("double").alias("complete")
    )
    out = runs.analysis_rows(records, questions, scored)
    tokens = F.col("total_tokens").cast("double").alias("total_tokens")
    return out.select("run_id", "agent", "stratum", "arm", "status", tokens, "accuracy", "completion", "judge_status")


@query(f"""WITH {RUNS} SELECT run_id, question_id, repetition FROM runs WHERE status = 'completed' AND run_id % 19 <> 0 AND agent = 'rollout' AND
 stratum <> 'control'""")
def completed_runs(spark, sf_dir):
    return runs.completed(
        _records(spark, sf_dir), "rollout", scored_only=True
    ).select("run_id", "question_id", "repetition")


@query("""WITH a AS (SELECT l_orderkey, count(*) AS total_tokens FROM lineitem GROUP BY ALL) SELECT o_orderkey AS run_id, o_orderstatus AS status,
 CAST(total_tokens AS DOUBLE) AS total_tokens, CASE WHEN o_orderkey % 3 = 0 THEN 'answer ' || o_custkey END AS text, CASE WHEN o_orderkey %
 5 = 0 THEN CAST(o_orderkey * 2 AS DOUBLE) END AS bytes FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""")
def report_rows(spark, sf_dir):
    """A row a run with what the analysis, the answers and the manifest of logs say about it."""
    k, orders = F.col("run_id"), table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "run_id")
    records = orders.select("run_id", F.col("o_orderstatus").alias("status"))
    analysis = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.count(F.lit(1)).alias("total_tokens"), F.first("l_linestatus").alias("status")
    )
    answers = orders.where(k % 3 == 0).select("run_id", _text("answer ", F.col("o_custkey")).alias("text"))
    logs = orders.where(k % 5 == 0).select("run_id", (k * 2).alias("bytes"))
    return runs.report_rows(records, analysis, answers, logs).select(
        "run_id",
        "status",
        F.col("total_tokens").cast("double").alias("total_tokens"),
        "text",
        F.col("bytes").cast("double").alias("bytes"),
    )


@query("""SELECT o_orderkey AS run_id, o_custkey AS question_id FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey IN (SELECT o_custkey FROM orders
 WHERE o_orderkey % 2 = 1)""")
def shared_runs(spark, sf_dir):
    """Runs of one campaign on questions of another; no run is in both."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("question_id")
    )
    return runs.shared_runs(rows.where("run_id % 2 = 0"), rows.where("run_id % 2 = 1"))


@query(f"""WITH {RUNS}, r AS (SELECT run_id, question_id, status FROM runs), j AS (SELECT run_id FROM runs WHERE run_id % 3 <> 0 AND run_id % 4 <> 0
 AND run_id % 5 <> 0) SELECT run_id, question_id FROM r JOIN j USING (run_id) WHERE status = 'completed' AND question_id % 2 = 0""")
def stale_passes(spark, sf_dir):
    """Completed runs on corrected questions whose stored pass was made under other corrections."""
    i, records = F.col("run_id"), event_runs(spark, sf_dir)
    kept = F.struct(
        F.create_map(F.lit("F1"), F.lit("correct")).alias("fact_verdicts"),
        F.when(i % 4 == 0, F.lit("failed")).alias("error"),
        F.lit(True).alias("complete"),
    )
    judged = records.where(i % 3 != 0).select(
        "run_id",
        F.create_map(F.lit("B"), kept).alias("passes"),
        F.when(i % 5 == 0, F.lit("now")).when(i % 2 == 0, F.lit("before")).alias("corrections_digest"),
    )
    fixed = records.where("question_id % 2 = 0").select("question_id", F.lit("F1").alias("fact_id"))
    return validation.stale_passes(None, fixed, records, judged, "B", "now").select("run_id", "question_id")


# --- verdicts ---------------------------------------------------------------------------------------------


@query("""SELECT doc_id AS run_id, unnest(['A', 'B', 'C']) AS pass, unnest(['old A', 'new B', CASE WHEN quality = 1 THEN 'new C' ELSE 'old C' END])
 AS told FROM labels""")
def replaced_passes(spark, sf_dir):
    """Stored passes but for the requested ones, and the new ones."""
    lit = lambda *kv: F.create_map(*map(F.lit, kv))
    prior = lit("A", "old A", "B", "old B", "C", "old C")
    wide = verdicts.replace_passes(prior, lit("B", "new B", "C", "new C"), ["B", "C"])
    slim = verdicts.replace_passes(prior, lit("B", "new B"), ["B"])
    rows = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("run_id"), F.when(F.col("quality") == 1, wide).otherwise(slim).alias("m")
    )
    return rows.select("run_id", F.explode("m").alias("pass", "told"))


@query("""WITH q AS (SELECT l_orderkey AS run_id, l_partkey AS fact_id FROM lineitem WHERE l_quantity > 45 GROUP BY ALL) SELECT run_id, fact_id,
 o_custkey AS question_id, 'what ' || o_custkey AS question, p_name AS statement, CASE WHEN fact_id % 2 = 0 THEN 'correct' END AS a, CASE
 WHEN fact_id % 2 = 0 THEN 'missing' END AS b FROM q JOIN orders ON o_orderkey = run_id JOIN part ON p_partkey = fact_id""")
def audit_table(spark, sf_dir):
    """Queue rows with run, question and fact, and both verdicts beside them."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("fact_id"), "l_quantity"
    )
    queue = lines.where("l_quantity > 45").select("run_id", "fact_id", F.lit("disputed").alias("selection")).distinct()
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("question_id"), F.lit("x").alias("agent")
    )
    questions = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), _text("what ", F.col("c_custkey")).alias("question")
    )
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("fact_id"),
        F.col("p_name").alias("statement"),
        F.lit("v").alias("value"),
        F.lit("u").alias("unit"),
    )
    facts = lines.join(orders, "run_id").select("question_id", "fact_id").distinct().join(part, "fact_id")
    pairs = lines.where("fact_id % 2 = 0").select(
        "run_id", "fact_id", F.lit("correct").alias("a"), F.lit("missing").alias("b")
    ).distinct()
    return verdicts.audit_table(queue, orders, questions, facts, pairs).select(
        "run_id", "fact_id", "question_id", "question", "statement", "a", "b"
    )


# --- claims and sources --------------------------------------------------------------------------------------


@query("""SELECT l_orderkey AS run_id, l_linenumber AS claim_index, l_partkey, CASE WHEN l_returnflag = l_linestatus THEN l_returnflag ELSE
 l_returnflag || '; ' || l_linestatus END AS hosts, '' AS sources, CASE WHEN l_linenumber % 2 = 0 THEN 'news' ELSE 'filing' END AS label
 FROM lineitem""")
def claim_rows(spark, sf_dir):
    """Claims as report rows: lists joined, each entry once; the numbers-only rule in place of the first where it says more."""
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("claim_index"), "l_partkey", F.array(flag, line, flag).alias("hosts"),
        F.array().cast("array<string>").alias("sources"), F.lit("filing").alias("label"), F.when(
            F.col("l_linenumber") % 2 == 0, "news"
        ).alias("numbers_only_label"),
    )
    return provenance.numbers_only(provenance.claim_rows(rows)).select(
        "run_id", "claim_index", "l_partkey", "hosts", "sources", "label"
    )


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL), h AS (SELECT o_orderkey AS run_id, o_orderstatus AS s, n FROM
 orders LEFT JOIN n ON l_orderkey = o_orderkey)
 SELECT run_id, 'ok' AS state, n AS claims FROM h WHERE n IS NOT NULL AND s = 'F' AND run_id % 4 <> 0 UNION ALL SELECT run_id, 'missing', 0
 FROM h WHERE n IS NULL OR run_id % 4 = 0 UNION ALL SELECT run_id, 'failed', 0 FROM h WHERE n IS NOT NULL AND s <> 'F'""")
def claims_of_runs(spark, sf_dir):
    """Claims of runs that have both claims and sources, runs that lack one, runs whose claims failed."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.collect_list(
            F.struct(F.lit("fact").alias("type"), F.col("l_linenumber").cast("string").alias("text"))
        ).alias("claims")
    )
    docs = lines.join(orders, "run_id").select(
        "run_id", F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error").alias("status"), "claims"
    )
    ok, missing, failed = provenance.claims_of_runs(
        orders.select("run_id"), docs, orders.where("run_id % 4 <> 0").select("run_id")
    )
    zero = F.lit(0).cast("bigint").alias("claims")
    parts = [
        ok.groupBy("run_id").agg(F.count(F.lit(1)).alias("claims")).select(
            "run_id", F.lit("ok").alias("state"), "claims"
        )
    ]
    parts += [x.select("run_id", F.lit(n).alias("state"), zero) for n, x in (("missing", missing), ("failed", failed))]
    return validation.union(parts)


@query("""WITH f AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'quote ' || p_partkey || chr(10) || p_name WHEN 1 THEN 'why ' ||
 p_partkey || chr(10) || 'gone; lost' END AS own FROM part) SELECT a.k AS fact_id, CASE WHEN a.k % 3 = 2 THEN 'x/y' || chr(10) ||
 coalesce(b.own || chr(10), '') || c.own ELSE a.own END AS text FROM f a LEFT JOIN f b ON b.k = a.k - 2 LEFT JOIN f c ON c.k = a.k - 1""")
def evidence(spark, sf_dir):
    """What backs a fact: quote and passage, reason and terms, or the formula with the evidence of its parts in order."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    source = F.struct(
        F.when(k % 3 == 0, k.cast("string")).alias("chunk_id"), F.when(k % 3 == 0, _text("quote ", k)).alias("quote")
    )
    facts = part.select(
        F.lit("q").alias("question_id"), k.cast("string").alias("fact_id"), F.when(k % 3 == 0, "sourced").when(k % 3 == 1, "absence").otherwise("computed").alias("kind"), source.alias("source"),
        F.when(
            k % 3 == 1, _text("why ", k)
        ).otherwise(none).alias("absence_reason"), F.array(
            F.lit("gone"), F.lit("lost")
        ).alias("absent_terms"), F.lit("x/y").alias("formula"),
        F.when(k % 3 == 2, F.array((k - 2).cast("string"), (k - 1).cast("string"))).alias("computed_from"),
    )
    passages = part.select(k.cast("string").alias("chunk_id"), F.col("p_name").alias("text"))
    return validation.evidence(facts, passages).select(F.col("fact_id").cast("bigint").alias("fact_id"), "text")


@query("""WITH need AS (SELECT 'c' || p_partkey AS chunk_id FROM part WHERE p_partkey % 2 = 0 UNION SELECT 'd' || s_suppkey FROM supplier UNION
 SELECT 'e' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) SELECT chunk_id FROM need WHERE chunk_id NOT IN (SELECT 'c' || p_partkey
 FROM part WHERE p_partkey % 6 = 0)""")
def needed_passages(spark, sf_dir):
    """Passages that facts and corrections quote and the cache lacks, each once."""
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    facts = table(spark, sf_dir, "part").select(
        F.struct(F.when(p % 2 == 0, _text("c", p)).alias("chunk_id")).alias("source")
    )
    also = F.array(F.struct(_text("d", s).alias("chunk_id"), F.lit("p").alias("permalink"), F.lit("q").alias("quote")))
    fix = table(spark, sf_dir, "supplier").select(
        also.alias("also_stated"),
        F.struct(F.struct(F.when(s % 2 == 0, _text("e", s)).alias("chunk_id")).alias("source")).alias("fields"),
    )
    cached = table(spark, sf_dir, "part").where(p % 6 == 0).select(_text("c", p).alias("chunk_id"))
    return validation.needed_passages(facts.unionByName(facts), fix, cached)


@query("""SELECT doc_id AS run_id, doc_id % 2 = 1 AND doc_id % 5 <> 0 AS absent FROM documents""")
def absent_phrases(spark, sf_dir):
    """Claims whose words no single filing source holds: the first words of a text stand in it, invented ones don't."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    sources = docs.select(
        i.alias("run_id"), F.lit("archive").alias("kind"), F.lit("k").alias("key"), F.lit("filing").alias("category"), F.lit("").alias("title"), F.lit("").alias("snippet"), F.lit(0).alias("order"),
        F.array(F.struct(F.lit(1).alias("ord"), F.coalesce("text", F.lit("")).alias("text"))).alias("segments"),
    )
    first = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), r"\s+"), 1, 4), " ")
    claims = docs.select(
        i.alias("run_id"),
        F.lit(1).alias("claim_index"),
        F.when(i % 2 == 1, _text("qqqxxq zzzyyz", i)).otherwise(first).alias("phrase"),
        F.when(i % 5 == 0, "filer").alias("attributed_to"),
    )
    return provenance.absent_from_filing(claims, sources).select("run_id", F.col("absent_from_filing").alias("absent"))


@query(f"""WITH {HOST_SQL}, n AS (SELECT p.page_id % 20 AS run_id, p.page_id AS claim_index, c.category FROM pages p JOIN c ON c.page_id IN
 (p.page_id, p.page_id + 20)) SELECT run_id, claim_index, array_to_string(list_sort(list(DISTINCT category)), ',') AS cited FROM n GROUP BY
 ALL""")
def cited_categories(spark, sf_dir):
    """Categories of the hosts that a claim's tokens name."""
    i = F.col("page_id")
    pages = table(spark, sf_dir, "pages")
    claims = pages.select(
        (i % 20).alias("run_id"),
        i.alias("claim_index"),
        F.array(_text("S", i), _text("S", i + 20), F.lit("S?")).alias("sources"),
    )
    links = pages.select((i % 20).alias("run_id"), _text("S", i).alias("token"), "url")
    categories = _page_categories(spark, sf_dir).select("host", "category").distinct()
    return provenance.cited_categories(claims, links, categories).select(
        "run_id", "claim_index", F.array_join("cited", ",").alias("cited")
    )


_SHARES = f"""WITH {HOST_SQL}, s AS (SELECT DISTINCT page_id % 60 AS run_id, CASE page_id % 3 WHEN 0 THEN 'shown' ELSE 'opened' END AS kind, CASE
 page_id % 3 WHEN 0 THEN 's' WHEN 1 THEN 'o' ELSE 'a' END AS raw, host, category FROM c),
 runs AS (SELECT DISTINCT run_id FROM s), cats(category) AS (VALUES ('issuer'), ('news'), ('forum'), ('other')), kinds(kind) AS (VALUES
 ('shown'), ('opened')),
 q AS (SELECT r.run_id % 2 AS arm, r.run_id // 2 AS question_id, k.kind, t.category, CAST(count(s.host) FILTER (WHERE s.category =
 t.category) AS DOUBLE) AS a, CAST(count(s.host) AS DOUBLE) AS b FROM runs r, kinds k, cats t LEFT JOIN s ON s.run_id = r.run_id AND s.kind
 = k.kind GROUP BY ALL)"""


@query(
    _SHARES + ", " + draws_sql(
        "q", "arm, kind, category", "sum(p.a) / nullif(sum(p.b), 0)"
    ) + " SELECT arm, kind, category, round(estimate, 6) AS share, round(low, 6) AS ci_low, round(high, 6) AS ci_high FROM whole JOIN ends USING (arm, kind, category) WHERE estimate IS NOT NULL"
)
def exposure_shares(spark, sf_dir):
    """Share of each category among the sources that runs were shown and opened, with intervals over questions."""
    i = F.col("page_id")
    kind = F.when(i % 3 == 0, "shown").when(i % 3 == 1, "opened").otherwise("archive")
    sources = _page_categories(spark, sf_dir).select(
        (i % 60).alias("run_id"), kind.alias("kind"), F.col("host").alias("key"), "category"
    )
    exposure = provenance.run_exposure(sources).withColumns(
        {"arm": F.col("run_id") % 2, "question_id": F.floor(F.col("run_id") / 2)}
    )
    rows = provenance.exposure_shares(exposure, ["arm"]).where(
        F.col("category").isin("issuer", "news", "forum", "other")
    )
    keys = ["arm", "kind", "category"]
    out = stats.ratio_interval(rows, keys)
    return out.select(
        *keys, r6("estimate").alias("share"), r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high")
    )


@query(f"""WITH {HOST_SQL}, d AS (SELECT CASE WHEN regexp_matches(host, 'example\\.org$') THEN 'filing-source' ELSE host END AS host, page_id % 20
 AS run_id, CASE WHEN page_id % 2 = 0 THEN 'shown' ELSE 'opened' END AS kind, category FROM c) SELECT host, count(DISTINCT run_id) AS runs,
 array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, min(category) AS category FROM d GROUP BY ALL""")
def host_rows(spark, sf_dir):
    """One row a displayed host; all filing hosts are one."""
    i = F.col("page_id")
    rows = _page_categories(spark, sf_dir).select(
        "host", (i % 20).alias("run_id"), F.when(i % 2 == 0, "shown").otherwise("opened").alias("kind"), "category"
    )
    return provenance.host_rows(rows, r"example\.org$").select(
        "host", "runs", F.array_join("kinds", ",").alias("kinds"), "category"
    )


# --- costs ------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey % 3 AS agent, o_orderkey AS question_id, o_custkey * 10 - o_orderkey % 5 AS fresh, o_custkey AS cached, o_orderkey % 5
 AS write, 7 AS output, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 6 ELSE o_orderkey % 4 END AS searches, 2 + o_orderkey % 9 AS calls
 FROM orders WHERE o_orderstatus = 'F'""")
def profile_rows(spark, sf_dir):
    """Completed records as profiles: calls of governed tools but for resource listings, searches as the server tells them."""
    k, long = F.col("o_orderkey"), lambda c: c.cast("bigint")
    usage = F.struct(
        (F.col("o_custkey") * 10).alias("uncached_input"),
        F.col("o_custkey").alias("cached_input"),
        (k % 5).alias("cache_write_input"),
        long(F.lit(7)).alias("output"),
    )
    tools = F.create_map(
        F.lit("mcp:archive.find"),
        long(F.lit(2)),
        F.lit("mcp:archive.toc"),
        long(k % 9),
        F.lit("mcp:x.list_mcp_resources"),
        long(F.lit(50)),
        F.lit("shell"),
        long(F.lit(9)),
    )
    web = F.create_map(F.lit("search"), long(k % 4), F.lit("server_searches"), long(k % 6))
    rows = table(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, "stream").otherwise("rollout").alias("agent"),
        F.lit("web").alias("arm"),
        k.alias("question_id"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("timeout").alias("status"),
        usage.alias("usage"),
        tools.alias("tool_calls"),
        web.alias("web_actions"),
    )
    return runs.profile_rows(rows).select((F.col("question_id") % 3).alias("agent"), "question_id", *runs.PROFILE)


@query("""WITH c AS (SELECT o_custkey % 50 AS agent, o_orderkey % 4 AS arm, count(*) AS questions FROM orders GROUP BY ALL), m AS (SELECT l_suppkey
 % 50 AS agent, l_linenumber % 4 AS arm, avg(l_quantity) AS v FROM lineitem WHERE l_suppkey % 50 < 20 AND l_linenumber % 4 < 2 GROUP BY
 ALL), p AS (SELECT p_partkey % 50 AS agent, p_size % 4 AS arm, avg(p_size) AS v FROM part WHERE p_partkey % 50 < 30 GROUP BY ALL), x AS
 (SELECT s_suppkey % 50 AS agent, max(s_acctbal) AS v FROM supplier WHERE s_suppkey % 50 < 40 GROUP BY ALL)
 SELECT c.agent, c.arm, questions, questions * 3 AS runs, CASE WHEN m.v IS NOT NULL THEN 'measured' WHEN p.v IS NOT NULL THEN 'pilot' WHEN
 x.v IS NOT NULL THEN 'proxy' END AS basis, round(coalesce(m.v, p.v, x.v) * questions * 3, 6) AS fresh FROM c LEFT JOIN m USING (agent, arm)
 LEFT JOIN p USING (agent, arm) LEFT JOIN x ON x.agent = c.agent""")
def estimate(spark, sf_dir):
    """Runs to come times the first profile there is: measured, pilot, then the greatest of a proxy's arms."""
    cells = table(spark, sf_dir, "orders").groupBy(
        (F.col("o_custkey") % 50).alias("agent"), (F.col("o_orderkey") % 4).alias("arm")
    ).agg(F.count(F.lit(1)).alias("questions"))
    profile = lambda df, agent, arm, value: df.select(
        agent.alias("agent"), arm.cast("bigint").alias("arm"), *[value.cast("double").alias(c) for c in runs.PROFILE]
    )
    lines = profile(
        table(spark, sf_dir, "lineitem"), F.col("l_suppkey") % 50, F.col("l_linenumber") % 4, F.col("l_quantity")
    ).where("agent < 20 AND arm < 2")
    part = profile(
        table(spark, sf_dir, "part"), F.col("p_partkey") % 50, F.col("p_size") % 4, F.col("p_size")
    ).where("agent < 30")
    proxy = profile(
        table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 50, F.col("s_suppkey") % 3, F.col("s_acctbal")
    ).where("agent < 40")
    got = runs.estimate(
        cells, runs.token_profile(lines, ["agent", "arm"]), runs.token_profile(part, ["agent", "arm"]), proxy, 3
    )
    return got.select("agent", "arm", "questions", "runs", "basis", r6("fresh").alias("fresh"))


# --- samples --------------------------------------------------------------------------------------------------------


def allocated(rows: str, cells: list[str], total: int, floor: int, rounds: int = 6) -> str:
    """SQL of shares of `total` for the cells of `rows`, as CTEs that end in `shares` (cells, want)."""
    key = ", ".join(cells)
    out = [f"""sizes AS (SELECT {key}, count(*) AS n FROM {rows} GROUP BY ALL), whole_ AS (SELECT sum(n) AS mass, sum(least({floor}, n)) AS floors FROM
 sizes),
 a0 AS (SELECT {key}, n, {total} AS total, CASE WHEN floors <= {total} THEN {floor} ELSE 0 END AS fl, sum(n) OVER () AS mass FROM sizes,
 whole_), fixed0 AS (SELECT {key}, 0 AS want FROM sizes WHERE false)"""]
    for k in range(rounds):  # cells below their floor get it, the others share the rest anew
        out.append(f"""s{k} AS (SELECT *, total * n < least(fl, n) * mass AS short FROM a{k}), fixed{k + 1} AS (SELECT * FROM fixed{k} UNION ALL SELECT {key},
 least(fl, n) FROM s{k} WHERE short),
 a{k + 1} AS (SELECT {key}, n, total - coalesce((SELECT sum(least(fl, n)) FROM s{k} WHERE short), 0) AS total, fl, sum(n) OVER () AS mass
 FROM s{k} WHERE NOT short)""")
    out.append(f"""e AS (SELECT {key}, total, total * n // mass AS q, total * n % mass AS rest FROM a{rounds}), ranked AS (SELECT *, row_number() OVER
 (ORDER BY rest DESC, {key}) AS place, sum(q) OVER () AS given FROM e),
 shares AS (SELECT {key}, CASE WHEN (SELECT mass FROM whole_) <= {total} THEN n ELSE want END AS want FROM sizes JOIN (SELECT {key}, q +
 CASE WHEN place <= total - given THEN 1 ELSE 0 END AS want FROM ranked UNION ALL SELECT * FROM fixed{rounds}) USING ({key}))""")
    return ", ".join(out)


def drawn(rows: str, cells: list[str], ident: str, total: int, floor: int, seed: int, prefix: str) -> str:
    """SQL of the stratified sample of `rows`."""
    key = ", ".join(cells)
    return f"""{allocated(rows, cells, total, floor)}, picks AS (SELECT {key}, {ident}, row_number() OVER (PARTITION BY {key} ORDER BY sha256('{seed}:'
 || {ident})) AS nth FROM {rows}), taken AS (SELECT {key}, {ident} FROM picks JOIN shares USING ({key}) WHERE nth <= want)
 SELECT '{prefix}' || CASE WHEN rn < 1000 THEN lpad(CAST(rn AS VARCHAR), 3, '0') ELSE CAST(rn AS VARCHAR) END AS row_id, {ident}, {key} FROM
 (SELECT *, row_number() OVER (ORDER BY {key}, {ident}) AS rn FROM taken)"""


_CELLS = "d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, doc_id % 3 AS kind FROM documents)"


@query(f"WITH {_CELLS}, " + drawn("d", ["source", "lang"], "doc_id", 400, 10, 8105, "X"))
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(
        _cells(spark, sf_dir), ["source", "lang"], "doc_id", 400
    ).select("row_id", "doc_id", "source", "lang")


def _cells(spark, sf_dir: str):
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return table(spark, sf_dir, "documents").select(
        "doc_id", none("source"), none("lang"), (F.col("doc_id") % 3).alias("kind")
    )


@query(
    f"WITH {_CELLS}, p AS (SELECT doc_id AS text_id, source AS category, lang AS stratum FROM d), " + drawn(
        "p", ["category", "stratum"], "text_id", 1500, 60, 8105, "X"
    )
)
def text_sample(spark, sf_dir):
    pool = _cells(spark, sf_dir).select(
        F.col("doc_id").alias("text_id"), F.col("source").alias("category"), F.col("lang").alias("stratum")
    )
    return sampling.text_sample(pool).select("row_id", "text_id", "category", "stratum")


@query(
    f"WITH {_CELLS}, first_ AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('8105:' || doc_id)) AS n FROM d) WHERE n <= 100), left_ AS (SELECT * FROM d WHERE kind = 1 AND doc_id NOT IN (SELECT doc_id FROM first_)), " + drawn(
        "left_", ["source"], "doc_id", 150, 10, 8106, "E"
    )
)
def extension_sample(spark, sf_dir):
    """A second sample of one kind among what a first one left."""
    rows = _cells(spark, sf_dir).withColumn("kind", F.col("kind").cast("string"))
    first = sampling.hash_top_k(rows.withColumn("all", F.lit(1)), "all", "doc_id", 100)
    return sampling.extension_sample(rows, first, ["source"], "doc_id", 150, "1").select("row_id", "doc_id", "source")


@query(f"""
WITH {RUNS},
sizes AS (
  SELECT DISTINCT n FROM (SELECT count(DISTINCT question_id) AS n FROM runs GROUP BY agent, stratum, arm)),
{HASHES}
SELECT CAST(n AS INTEGER) AS n, CAST(draw AS INTEGER) AS draw,
  string_agg(CAST(h % CAST(n AS UBIGINT) AS VARCHAR), ',' ORDER BY k) AS places,
  CAST((SELECT count(*) FROM sizes) AS INTEGER) AS made_first, 0 AS made_again
FROM sizes JOIN hashes ON k < n GROUP BY n, draw
""")
def bootstrap_places(spark, sf_dir):
    """The index matrices for the numbers of questions that the cells of the runs have, kept as a table: asked for twice,
    made once."""
    cells = event_runs(spark, sf_dir).groupBy("agent", "stratum", "arm").agg(F.count_distinct("question_id").alias("n"))
    sizes = [r.n for r in cells.select("n").distinct().collect()]  # numbers of questions, not of runs
    home = new_folder(spark, "draws")
    _, first = stats.kept_draws(spark, sizes, home=home)
    found, again = stats.kept_draws(spark, sizes, home=home)
    return found.select(
        "n",
        "draw",
        F.array_join("idx", ",").alias("places"),
        F.lit(len(first)).alias("made_first"),
        F.lit(len(again)).alias("made_again"),
    )


@query(f"""
WITH {RUNS},
q AS (
  SELECT agent, arm, question_id, avg(total_tokens) AS a FROM runs WHERE total_tokens IS NOT NULL GROUP BY ALL),
{draws_sql("q", "agent, arm", "quantile_cont(a, 0.5)")}
SELECT agent, arm, round(estimate, 6) AS estimate, round(low, 6) AS ci_low, round(high, 6) AS ci_high, n_questions
FROM whole JOIN ends USING (agent, arm)
""")
def median_interval(spark, sf_dir):
    """Median of the questions' mean tokens, with the interval of all draws, from how often each draw takes a question."""
    rows = stats.question_means(event_runs(spark, sf_dir), "total_tokens", ["agent", "arm"])
    made = stats.bootstrap(rows.withColumnRenamed("mean", "a"), ["agent", "arm"], stats.Quantile("a", 0.5))
    return made.select("agent", "arm", r6("estimate").alias("estimate"), r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"), "n_questions")


@query("""WITH p AS (SELECT l_suppkey, list_sort(list(DISTINCT 'p' || l_partkey)) AS names FROM lineitem GROUP BY ALL) SELECT l_suppkey AS run_id,
 CASE WHEN len(names) > 20 THEN array_to_string(names[1:20], ', ') || ' and ' || (len(names) - 20) || ' more' ELSE array_to_string(names,
 ', ') END AS companies FROM p""")
def companies_text(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run_id")).agg(
        F.array_sort(F.collect_set(_text("p", F.col("l_partkey")))).alias("names")
    )
    return per.select("run_id", text.companies_text(F.col("names")).alias("companies"))


@query("""WITH k AS (SELECT p_partkey, lower(p_brand) || chr(31) || lower(p_type) || chr(31) || (p_size % 5) || 'm' || chr(31) || 'fy 2024' AS key
 FROM part) SELECT 'C' || substr(sha256(key), 1, 12) AS claim_id, min(p_partkey) AS text_id, count(*) AS occurrences FROM k GROUP BY key""")
def claim_dedup(spark, sf_dir):
    """Claims by their normal form: case, white space and spaces inside a value don't tell them apart."""
    k = F.col("p_partkey")
    value = F.when(k % 2 == 0, _text(F.col("p_size") % 5, " m")).otherwise(_text(F.col("p_size") % 5, "M"))
    period = F.when(k % 3 == 0, "FY  2024").otherwise("fy 2024")
    rows = table(spark, sf_dir, "part").select(
        k.alias("text_id"),
        F.lit(0).alias("claim_ord"),
        F.upper("p_brand").alias("company"),
        F.col("p_type").alias("metric"),
        value.alias("value"),
        period.alias("period"),
    )
    return sampling.dedupe_claims(rows).select("claim_id", "text_id", "occurrences")


# --- numbers ------------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey * 1000 + 100000 + l_linenumber AS n FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN n * 1.0 WHEN 1 THEN n + 0.25 WHEN 2 THEN n + 0.5 ELSE 2024 END AS value,
 CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS decimals, l_linenumber % 4 = 3 AS year FROM l""")
def number_parse(spark, sf_dir):
    """Numbers as people write them, in four styles, read back with their precision."""
    n = F.col("l_linenumber")
    whole = F.col("l_partkey") * 1000 + 100000 + n
    grouped = F.format_number(whole, 0)
    told = F.when(n % 4 == 0, _text("paid ", grouped, " to two")).when(n % 4 == 1, _text("about $", grouped, ".25 then")).when(
        n % 4 == 2, _text(F.replace(grouped, F.lit(","), F.lit(".")), ",5")
    ).otherwise("in 2024")
    rows = table(spark, sf_dir, "lineitem").withColumn("told", told).select(
        "l_orderkey", "l_linenumber", F.explode(numbers.numbers_in("told")).alias("n")
    )
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        F.col("n.value").cast("double").alias("value"),
        F.col("n.decimals").alias("decimals"),
        F.col("n.year").alias("year"),
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN o_totalprice WHEN 4 THEN 12.0 END AS number, CASE WHEN o_orderkey % 3 = 0 THEN
 epoch(o_orderdate) END AS seconds FROM orders""")
def parsed_values(spark, sf_dir):
    """Finite numbers and ISO times; anything else is null."""
    k = F.col("o_orderkey")
    number = F.when(k % 5 == 0, "inf").when(k % 5 == 1, "nan").when(k % 5 == 2, "n/a").when(
        k % 5 == 3, F.col("o_totalprice").cast("string")
    ).otherwise("12")
    when = F.col("o_orderdate").cast("timestamp")
    told = F.when(
        k % 3 == 0, F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ).when(k % 3 == 1, F.date_format(when, "yyyy-MM-dd HH:mm")).otherwise("soon")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.finite(number).alias("number"),
        F.unix_micros(text.parse_time(told)).cast("double").alias("us"),
    ).select("o_orderkey", "number", (F.col("us") / 1000000).alias("seconds"))


@query("""WITH c AS (SELECT p_partkey AS part, CAST(floor(p_retailprice / 10) AS BIGINT) AS t FROM part), m AS (SELECT l_partkey AS part,
 l_orderkey AS "order", l_extendedprice AS price, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem)
 SELECT DISTINCT part, "order", price FROM c JOIN m USING (part) WHERE c BETWEEN 10 * t - 5 AND 10 * t + 5 OR c BETWEEN (10 * t - 5) * 1000
 AND (10 * t + 5) * 1000 OR c BETWEEN (10 * t - 5) * 1000000 AND (10 * t + 5) * 1000000 OR c * 1000 BETWEEN 10 * t - 5 AND 10 * t + 5""")
def number_matches(spark, sf_dir):
    """Tenths of prices as claims, prices of line items of the same part as mentions: a band join on the mantissa."""
    claims = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"),
        F.floor(F.col("p_retailprice") / 10).cast("string").alias("digits"),
        F.lit(1).alias("decimals"),
    )
    price = F.col("l_extendedprice").cast("decimal(38,2)")
    mentions = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part"), price.alias("price"), F.col("l_orderkey").alias("order")
    ).withColumn("n", numbers.plain_number("price")).select(
        "part", "order", "price", F.col("n.digits").alias("m_digits"), F.col("n.decimals").alias("m_decimals")
    )
    return numbers.number_matches(
        claims, ["part"], "digits", "decimals", mentions, "m_digits", "m_decimals", ["part"]
    ).select("part", "order", F.col("price").cast("double").alias("price")).distinct()


@query("""
SELECT l_orderkey, l_linenumber,
  CASE l_linenumber % 3
    WHEN 0 THEN CAST(l_orderkey + 1 AS VARCHAR) || lpad(CAST(l_partkey AS VARCHAR), 24, '0')
    WHEN 1 THEN CAST(l_partkey AS VARCHAR) || '.' || lpad(CAST(l_orderkey AS VARCHAR), 21, '0')
    ELSE '0.' || lpad(CAST(l_partkey AS VARCHAR), 40, '0') END AS value,
  CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 21 ELSE 40 END AS decimals,
  CASE l_linenumber % 3
    WHEN 0 THEN length(rtrim(CAST(l_orderkey + 1 AS VARCHAR) || lpad(CAST(l_partkey AS VARCHAR), 24, '0'), '0'))
    WHEN 1 THEN length(ltrim(CAST(l_partkey AS VARCHAR) || lpad(CAST(l_orderkey AS VARCHAR), 21, '0'), '0'))
    ELSE length(ltrim(CAST(l_partkey AS VARCHAR), '0')) END AS significant
FROM lineitem
""")
def long_numbers(spark, sf_dir):
    """Numbers of 25 and more digits, or of 21 and 40 decimals, read from prose without loss."""
    n, order, part = F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_partkey").cast("string")
    told = F.when(n % 3 == 0, _text("paid ", (order + 1).cast("string"), F.lpad(part, 24, "0"), " kr")).when(
        n % 3 == 1, _text("or ", part, ",", F.lpad(order.cast("string"), 21, "0"), " of it")
    ).otherwise(_text("0.", F.lpad(part, 40, "0")))
    rows = table(spark, sf_dir, "lineitem").withColumn("told", told)
    found = rows.select("l_orderkey", "l_linenumber", F.explode(numbers.numbers_in("told")).alias("n"))
    return found.select("l_orderkey", "l_linenumber", "n.value", "n.decimals", "n.significant")


@query("""
WITH c AS (
  SELECT p_partkey AS part, CAST(p_partkey % 7 + 1 AS HUGEINT) * 100000000000000000000000 + p_partkey AS t FROM part),
m AS (
  SELECT l_partkey AS part, l_orderkey, l_linenumber,
    (CAST(l_partkey % 7 + 1 AS HUGEINT) * 100000000000000000000000 + l_partkey) * 10
      + (l_orderkey % 13 - 6) * CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 1000 END AS v
  FROM lineitem)
SELECT part, l_orderkey, l_linenumber FROM c JOIN m USING (part) WHERE v BETWEEN 10 * t - 5 AND 10 * t + 5
""")
def long_number_matches(spark, sf_dir):
    """Claims of 24 digits and mentions of 25 that differ in the last ones, millions of times smaller, met exactly."""
    huge = (F.col("part") % 7 + 1).cast("decimal(2,0)") * F.lit(Decimal(10**23))
    of = lambda key: (huge + F.col(key)).cast("decimal(30,0)")
    claims = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")).select(
        "part", of("part").cast("string").alias("digits"), F.lit(0).alias("decimals")
    )
    step = (F.col("l_orderkey") % 13 - 6) * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(1000)
    told = table(spark, sf_dir, "lineitem").withColumn("part", F.col("l_partkey"))
    mentions = told.select(
        "part",
        "l_orderkey",
        "l_linenumber",
        (of("part") * F.lit(10) + step).cast("decimal(38,0)").cast("string").alias("m_digits"),
        F.lit(7).alias("m_decimals"),
    )
    met = numbers.number_matches(claims, ["part"], "digits", "decimals", mentions, "m_digits", "m_decimals", ["part"])
    return met.select("part", "l_orderkey", "l_linenumber")


_MATCH = "({c} BETWEEN (t * 10 - 5) AND (t * 10 + 5) OR {c} BETWEEN (t * 10 - 5) * 1000 AND (t * 10 + 5) * 1000 OR {c} * 1000 BETWEEN (t * 10 - 5) AND (t * 10 + 5))"


@query(f"""WITH c AS (SELECT p_partkey AS part, CAST(floor(p_retailprice * 10) AS BIGINT) AS t FROM part), s AS (SELECT l_partkey AS part,
 l_orderkey AS ord, l_linenumber % 2 = 0 AS archive, CAST(floor(l_extendedprice * 100) AS BIGINT) AS c1, CAST(floor(l_extendedprice * 100 /
 l_quantity) AS BIGINT) AS c2 FROM lineitem),
 f AS (SELECT part, count(*) FILTER (WHERE archive) > 0 AS filed, min(ord) FILTER (WHERE NOT archive) AS web, max(ord) FILTER (WHERE
 archive) AS last FROM c JOIN s USING (part) WHERE {_MATCH.format(c='c1')} OR {_MATCH.format(c='c2')} GROUP BY part)
 SELECT CAST(part AS VARCHAR) AS run_id, CASE WHEN coalesce(filed, false) THEN 'filing' ELSE 'secondary' END AS label, CASE WHEN
 coalesce(filed, false) THEN 'filing' WHEN web IS NOT NULL THEN 'aggregator' ELSE 'news' END AS category, coalesce(filed, false) AS
 primary_read, web IS NOT NULL AS values_in_nonfiling_source, coalesce(last > web, false) AS verified_by_archive FROM c LEFT JOIN f USING
 (part)""")
def attribution(spark, sf_dir):
    """Claims about part prices, sources that list line items of the part: number bands, categories, order of sight."""
    cents = lambda c: F.concat(
        (c.cast("bigint") / 100).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((c.cast("bigint") % 100).cast("string"), 2, "0"),
    )
    tenths = F.floor(F.col("p_retailprice") * 10)
    value = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    claims = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("run_id"),
        F.lit(1).alias("claim_index"),
        F.array(value).alias("values"),
        F.array(F.lit("news")).alias("cited"),
    )
    line = F.concat_ws(
        " ",
        cents(F.floor(F.col("l_extendedprice") * 100)),
        cents(F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity"))),
    )
    kind = F.when(F.col("l_linenumber") % 2 == 0, "archive").otherwise("shown")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    src = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("run_id"), kind.alias("kind"), key.alias("key"), F.when(
            kind == "archive", "filing"
        ).otherwise("aggregator").alias("category"), F.lit("").alias("title"), F.lit("").alias("snippet"),
        F.col("l_orderkey").alias("order"), F.array(
            F.struct(F.col("l_orderkey").alias("ord"), line.alias("text"))
        ).alias("segments"),
    )
    return provenance.attribute_claims(claims, src).select(
        "run_id", "label", "category", "primary_read", "values_in_nonfiling_source", "verified_by_archive"
    )


@query("""
WITH d AS (
  SELECT doc_id, coalesce(lang, '?') AS run_id,
    trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g')) AS text
  FROM documents),
c AS (
  SELECT doc_id, run_id, regexp_extract(text, '^(?:[a-z]+ ){2}([a-z]+ [a-z]+ [a-z]+)', 1) AS entity FROM d),
f AS (
  SELECT c.doc_id, bool_or(s.doc_id % 3 = 0) AS filed, min(s.doc_id) FILTER (WHERE s.doc_id % 3 <> 0) AS web,
    max(s.doc_id) FILTER (WHERE s.doc_id % 3 = 0) AS last
  FROM c JOIN d s ON s.run_id = c.run_id AND c.entity <> '' AND contains(s.text, c.entity)
  GROUP BY c.doc_id)
SELECT c.run_id, CAST(c.doc_id AS INTEGER) AS claim_index,
  CASE WHEN entity = '' THEN 'unattributed' WHEN coalesce(filed, false) THEN 'filing' ELSE 'secondary' END AS label,
  entity <> '' AND coalesce(filed, false) AS primary_read, web IS NOT NULL AS values_in_nonfiling_source,
  coalesce(last > web, false) AS verified_by_archive
FROM c LEFT JOIN f ON f.doc_id = c.doc_id
""")
def entity_attribution(spark, sf_dir):
    """Three words of each document as a claim's named entity, sought in all documents of its language as sources.

    The attribution folds white space, so spaces stay as they are here: only what else stands between words is replaced.
    """
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.coalesce("lang", F.lit("?")).alias("run_id"),
        F.lower(F.coalesce("text", F.lit(""))).alias("text"),
    )
    words = "^[^a-z]*(?:[a-z]+[^a-z]+){2}([a-z]+[^a-z]+[a-z]+[^a-z]+[a-z]+)"
    entity = F.regexp_replace(F.regexp_extract("text", words, 1), "[^a-z]+", " ")
    claims = docs.select(
        "run_id",
        F.col("doc_id").cast("int").alias("claim_index"),
        F.array(entity).alias("values"),
        F.array().cast("array<string>").alias("cited"),
    )
    filed = F.col("doc_id") % 3 == 0
    src = docs.select(
        "run_id",
        F.when(filed, "archive").otherwise("shown").alias("kind"),
        F.col("doc_id").cast("string").alias("key"),
        F.when(filed, "filing").otherwise("aggregator").alias("category"),
        F.lit("").alias("title"),
        F.lit("").alias("snippet"),
        F.col("doc_id").alias("order"),
        F.array(
            F.struct(F.col("doc_id").alias("ord"), F.regexp_replace("text", "[^a-z ]+", " ").alias("text"))
        ).alias("segments"),
    )
    return provenance.attribute_claims(claims, src).select(
        "run_id", "claim_index", "label", "primary_read", "values_in_nonfiling_source", "verified_by_archive"
    )
