"""Queries of readers and writers: files are written from a whole table, read back and compared."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyspark.operators import verdicts
from tallyspark.sources import committed, readers, sinks

from .registry import query, table
from .scratch import new_folder


def _written(spark, name: str, files: DataFrame) -> str:
    """The folder that holds (path, text) as files."""
    folder = new_folder(spark, name)
    sinks.write_texts(files, folder).count()
    return folder


def _text(c, *parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in (c, *parts)])


# --- fingerprints of many files -----------------------------------------------------------------------


@query("""
WITH f AS (
  SELECT sha256('doc-' || doc_id) AS key, sha256(coalesce(text, '')) AS h FROM documents),
g AS (
  SELECT substr(key, 1, 2) AS grp, sha256(string_agg(key || ' ' || h, chr(10) ORDER BY key, h)) AS h FROM f GROUP BY ALL)
SELECT sha256(string_agg(grp || ' ' || h, chr(10) ORDER BY grp)) AS fingerprint FROM g
""")
def grouped_fingerprint(spark, sf_dir):
    """One hash of all documents, whatever their order: by 256 groups of labels."""
    files = table(spark, sf_dir, "documents").select(
        _text("doc-", F.col("doc_id")).alias("label"), F.coalesce("text", F.lit("")).cast("binary").alias("content")
    )
    return spark.createDataFrame([(sinks.grouped_fingerprint(files),)], "fingerprint string")


# --- logs in many splits ------------------------------------------------------------------------------


@query("""
SELECT user_id % 3 AS log, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS ord, event_id AS id
FROM events WHERE event_id % 5 <> 0
""")
def split_logs(spark, sf_dir):
    """Three logs of all events, read in splits of 64 KB by many tasks: blank lines, other values and broken objects are
    skipped, and the ordinals count what is kept."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("log"), "event_id", "event_type", "props")
    broken = F.when(i % 15 == 0, "").when(i % 15 == 5, "[1, 2]").otherwise(_text('{"id": ', i, ', "broken": '))
    good = _text('  {"id": ', i, ', "type": "', F.col("event_type"), '"}', " ")
    # an object and a number behind it, parted by a mark that ends a line but is no line feed
    line = F.when(i % 5 == 0, broken).when(i % 4 == 0, F.concat(good, F.lit("\u2028 17"))).otherwise(good)
    folder = new_folder(spark, "split-logs")
    rows = e.select("log", "event_id", line.alias("line")).repartition(3, "log").sortWithinPartitions("log", "event_id")
    rows.select("log", "line").write.partitionBy("log").text(folder)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        found = readers.json_lines(spark, folder)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    return found.select(
        F.regexp_extract("path", r"/log=(\d+)/", 1).cast("bigint").alias("log"),
        F.col("ord").cast("bigint").alias("ord"),
        F.get_json_object("raw", "$.id").cast("bigint").alias("id"),
    )


@query("""
SELECT 'part-' || l_partkey || '/lines.json' AS path,
  '{"part":' || l_partkey || ',"note":null,"lines":[' || string_agg('{"order":' || l_orderkey || ',"line":' || l_linenumber || '}',
    ',' ORDER BY l_orderkey, l_linenumber) || ']}' || chr(10) AS text,
  sha256('{"part":' || l_partkey || ',"note":null,"lines":[' || string_agg('{"order":' || l_orderkey || ',"line":' || l_linenumber || '}',
    ',' ORDER BY l_orderkey, l_linenumber) || ']}' || chr(10)) AS sha256
FROM lineitem GROUP BY l_partkey
""")
def json_documents(spark, sf_dir):
    """A JSON document for each part with its lines, written by tasks under one commit and read back, with the manifest."""
    line = F.struct(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    rows = rows.select(
        _text("part-", F.col("l_partkey"), "/lines.json").alias("path"),
        F.struct(F.col("l_partkey").alias("part"), F.lit(None).cast("string").alias("note"), "lines").alias("value"),
    )
    folder = new_folder(spark, "documents")
    sinks.json_documents(rows, "path", "value", folder)
    return committed.read_files(spark, folder).select("path", F.col("content").cast("string").alias("text"), "sha256")


# --- sources ----------------------------------------------------------------------------------------


@query("""SELECT 'r' || s_suppkey AS run_id, CASE WHEN s_suppkey % 3 = 0 THEN 'timeout' ELSE 'completed' END AS status, s_suppkey * 7 AS total,
 CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 5 ELSE 0 END AS paged_results, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS notes FROM
 supplier""")
def record_scan(spark, sf_dir):
    k = F.col("s_suppkey")
    status = F.when(k % 3 == 0, "timeout").otherwise("completed")
    record = F.struct(
        _text("r", k).alias("run_id"),
        status.alias("status"),
        F.struct((k * 7).alias("total")).alias("usage"),
        F.when(k % 2 == 0, k % 5).alias("paged_results"),
        F.when(k % 4 == 0, F.array(F.lit("a note"))).alias("notes"),
        F.lit(1).alias("a_field_that_nobody_knows"),
    )
    files = table(spark, sf_dir, "supplier").select(
        _text("runs/", k, "/record.json").alias("path"), F.to_json(record).alias("text")
    )
    other = files.select(F.replace("path", F.lit("record"), F.lit("other")).alias("path"), "text")
    rows = readers.run_records(spark, _written(spark, "records", files.unionByName(other)))
    return rows.select(
        "run_id",
        "status",
        F.col("usage.total").alias("total"),
        "paged_results",
        F.size("notes").cast("long").alias("notes"),
    )


@query("""SELECT 'r' || o_orderkey AS run_id, o_orderstatus AS status, 0 AS paged_results, o_totalprice AS cost_usd, 0 AS notes FROM orders""")
def ledger_scan(spark, sf_dir):
    folder, k = new_folder(spark, "ledger"), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        _text("r", k).alias("run_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("cost_usd"),
        F.lit("x").alias("odd_field"),
        (k % 2).alias("half"),
    )
    for half in (0, 1):  # two writers, one after the other
        sinks.append_rows(rows.where(F.col("half") == half).drop("half"), folder)
    return readers.ledger(spark, folder).select(
        "run_id", "status", "paged_results", "cost_usd", F.size("notes").cast("long").alias("notes")
    )


@query("""WITH s AS (SELECT s_suppkey AS k, unnest(['A', 'B']) AS pass FROM supplier) SELECT 'r' || k AS run_id, pass, CASE WHEN pass = 'A' AND k %
 3 = 0 OR pass = 'B' AND k % 4 = 0 OR pass = 'B' AND k % 5 = 0 THEN 0 ELSE 2 END AS valid_verdicts, pass = 'A' AND k % 3 = 0 AS failed FROM
 s""")
def judgement_scan(spark, sf_dir):
    """A pass with an error, with an unknown verdict or without a flag for completeness is not valid."""
    k = F.col("s_suppkey")
    made = lambda second, error, complete: F.struct(
        F.create_map(F.lit("f1"), F.lit("correct"), F.lit("f2"), second).alias("fact_verdicts"),
        complete.alias("complete"),
        error.alias("error"),
    )
    first = made(F.lit("missing"), F.when(k % 3 == 0, F.lit("timed out")), F.lit(True))
    second = made(
        F.when(k % 4 == 0, F.lit("odd")).otherwise(F.lit("incorrect")),
        F.lit(None).cast("string"),
        F.when(k % 5 != 0, F.lit(False)),
    )
    doc = F.struct(
        _text("r", k).alias("run_id"),
        F.lit("ok").alias("status"),
        F.create_map(F.lit("A"), first, F.lit("B"), second).alias("passes"),
    )
    files = table(spark, sf_dir, "supplier").select(
        _text(k, "/judgement.json").alias("path"), F.to_json(doc).alias("text")
    )
    passes = readers.judgement_passes(readers.judgements(spark, _written(spark, "judgements", files)))
    stored = F.struct("fact_verdicts", "complete", "error")
    valid = F.coalesce(F.size(verdicts.valid_pass(stored)), F.lit(0))
    return passes.select(
        "run_id",
        "pass",
        F.when(valid > 0, valid).otherwise(0).cast("long").alias("valid_verdicts"),
        F.col("error").isNotNull().alias("failed"),
    )


@query("""SELECT n_name AS question_id, 's' || (n_nationkey % 3) AS stratum, 'F' || s_suppkey AS fact_id, CASE s_suppkey % 3 WHEN 0 THEN 'sourced'
 WHEN 1 THEN 'absence' ELSE 'computed' END AS kind, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS f_ord FROM nation
 JOIN supplier ON s_nationkey = n_nationkey""")
def question_scan(spark, sf_dir):
    k = F.col("s_suppkey")
    kind = F.when(k % 3 == 0, "sourced").when(k % 3 == 1, "absence").otherwise("computed")
    fact = F.struct(k.alias("k"), _text("F", k).alias("id"), kind.alias("kind"))
    per = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.array_sort(F.collect_list(fact)).alias("facts")
    )
    nations = table(spark, sf_dir, "nation").join(per, "n_nationkey", "left")
    q = F.struct(
        F.col("n_name").alias("id"),
        _text("s", F.col("n_nationkey") % 3).alias("stratum"),
        F.lit("what?").alias("question"),
        "facts",
    )
    docs = nations.groupBy("n_regionkey").agg(
        F.to_json(F.struct(F.lit("main").alias("set"), F.collect_list(q).alias("questions"))).alias("text")
    )
    folder = _written(
        spark, "questions", docs.select(_text("set-", F.col("n_regionkey"), ".json").alias("path"), "text")
    )
    return readers.facts(readers.question_set(spark, folder)).select(
        "question_id", "stratum", "fact_id", "kind", F.col("f_ord").cast("long").alias("f_ord")
    )


@query("""SELECT 'run-' || s_suppkey AS run_id, 'f,' || (s_suppkey % 7) AS fact_id, 'first line' || chr(10) || 'says "' || s_name || '"' AS verdict
 FROM supplier""")
def audit_scan(spark, sf_dir):
    """Rows as CSV shards of at most 2,000 bytes, written and read back: commas, quotes and line ends inside cells."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        _text("run-", k).alias("run_id"),
        _text("f,", k % 7).alias("fact_id"),
        _text("first line\nsays \"", F.col("s_name"), "\"").alias("verdict"),
    )
    columns = ["run_id", "fact_id", "verdict"]
    shards = sinks.csv_shards(rows, columns, ["run_id", "fact_id"], 2000)
    folder = _written(
        spark, "audits", shards.select(F.format_string("audit-queue-%05d.csv", "shard").alias("path"), "text")
    )
    return readers.audit_rows(spark, [folder], columns).select(*columns)


@query("""WITH p AS (SELECT l_orderkey AS run_id, CASE l_linenumber % 3 WHEN 0 THEN 'h/sessions/rollout-' || l_linenumber || '.jsonl' WHEN 1 THEN
 'h/' || l_linenumber || '/rollout.jsonl' ELSE 'h/notes.txt' END AS path FROM lineitem),
 r AS (SELECT run_id, path, CASE WHEN path LIKE 'h/sessions/rollout-%' THEN 0 WHEN path LIKE '%/rollout.jsonl' THEN 1 END AS rank FROM p)
 SELECT run_id, arg_max(path, (9 - rank) || path) AS path FROM r WHERE rank IS NOT NULL GROUP BY run_id""")
def log_choice(spark, sf_dir):
    n = F.col("l_linenumber")
    path = F.when(
        n % 3 == 0, _text("h/sessions/rollout-", n, ".jsonl")
    ).when(n % 3 == 1, _text("h/", n, "/rollout.jsonl")).otherwise("h/notes.txt")
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), path.alias("path"))
    return readers.pick_log(files, [r"^h/sessions/rollout-", r"/rollout\.jsonl$"]).select("run_id", "path")


@query("""SELECT n_name AS host, r_name AS category, CASE WHEN n_nationkey % 4 = 0 THEN 'error' ELSE 'ok' END AS status, 'n' || n_nationkey AS
 reason FROM nation JOIN region ON n_regionkey = r_regionkey""")
def host_dimension(spark, sf_dir):
    k = F.col("n_nationkey")
    named = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    value = F.struct(
        F.col("r_name").alias("category"),
        F.when(k % 4 == 0, "error").otherwise("ok").alias("status"),
        _text("n", k).alias("reason"),
    )
    doc = named.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", value)))).alias("text"))
    return readers.host_table(spark, _written(spark, "hosts", doc.select(F.lit("hosts.json").alias("path"), "text")))


@query("""SELECT 'r' || s_suppkey AS run_id, CASE WHEN s_suppkey % 3 = 1 THEN 'complete' ELSE 'missing' END AS state, CASE WHEN s_suppkey % 3 = 1
 THEN s_suppkey % 4 ELSE 0 END AS sources FROM supplier""")
def source_documents(spark, sf_dir):
    """A third of the runs has a complete document, a third an incomplete one, a third none."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    source = F.transform(
        F.slice(F.array(*map(F.lit, range(1, 4))), 1, (k % 4).cast("int")),
        lambda i: F.struct(F.lit("shown").alias("kind"), i.cast("string").alias("key")),
    )
    doc = F.struct(_text("r", k).alias("run_id"), (k % 3 == 1).alias("complete"), source.alias("sources"))
    files = s.where(k % 3 != 2).select(_text("sources/", k, ".json").alias("path"), F.to_json(doc).alias("text"))
    done = readers.complete_sources(spark, _written(spark, "sources", files))
    lost = readers.missing(s.select(_text("r", k).alias("run_id")), done)
    return done.select("run_id", F.lit("complete").alias("state"), F.size("sources").cast("long").alias("sources")).unionByName(
        lost.select("run_id", F.lit("missing").alias("state"), F.lit(0).cast("long").alias("sources"))
    )


@query("""SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'B' ELSE 'combined' END AS rule, count(*) AS documents, CAST(sum(s_suppkey % 3) AS BIGINT) AS
 rows FROM supplier GROUP BY ALL""")
def earlier_results(spark, sf_dir):
    """Results from before there was a choice of judge have no rule of their own."""
    k = F.col("s_suppkey")
    rows = F.transform(
        F.slice(F.array(F.lit("x"), F.lit("y")), 1, (k % 3).cast("int")), lambda v: F.create_map(F.lit("cell"), v)
    )
    doc = F.struct(F.when(k % 2 == 0, F.lit("B")).alias("primary_judge"), rows.alias("rows"))
    files = table(spark, sf_dir, "supplier").select(_text(k, ".json").alias("path"), F.to_json(doc).alias("text"))
    got = readers.analysis(spark, _written(spark, "results", files))
    return got.groupBy(F.col("primary_judge").alias("rule")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.size("rows")).alias("rows")
    )


@query("""SELECT r_name AS "set", n_name AS question_id, 'F' || n_nationkey AS fact_id, CASE WHEN n_nationkey % 2 = 0 THEN 'v' || n_nationkey END
 AS value, CASE WHEN n_nationkey % 2 = 1 THEN 's' || n_nationkey END AS statement FROM nation JOIN region ON n_regionkey = r_regionkey""")
def correction_scan(spark, sf_dir):
    k = F.col("n_nationkey")
    fields = F.struct(
        F.when(k % 2 == 1, _text("s", k)).alias("statement"), F.when(k % 2 == 0, _text("v", k)).alias("value")
    )
    fix = F.struct(
        F.col("n_name").alias("question_id"),
        _text("F", k).alias("fact_id"),
        fields.alias("fields"),
        F.lit("why").alias("reason"),
    )
    named = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    docs = named.groupBy("r_name").agg(
        F.to_json(F.struct(F.first("r_name").alias("set"), F.collect_list(fix).alias("corrections"))).alias("text")
    )
    got = readers.corrections(
        spark, _written(spark, "corrections", docs.select(_text(F.col("r_name"), ".json").alias("path"), "text"))
    )
    return got.select(
        "set",
        "question_id",
        "fact_id",
        F.col("fields.value").alias("value"),
        F.col("fields.statement").alias("statement"),
    )


# --- sinks ------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT o_orderkey || ',' || CASE WHEN o_totalprice > 200000 THEN 'true' ELSE 'false' END || ',' || CASE WHEN o_orderkey % 4 =
 0 THEN '' ELSE CAST(o_orderkey % 1000 AS VARCHAR) || CASE o_orderkey % 4 WHEN 1 THEN '.5' WHEN 2 THEN '.25' ELSE '' END END || ',"a, ""' ||
 o_orderstatus || '""' || '","{""k"":' || (o_orderkey % 3) || ',""m"":[1]}"' AS line FROM orders)
 SELECT line, 1 AS files FROM l UNION ALL SELECT 'id,large,number,text,nested', 3""")
def csv_files(spark, sf_dir):
    """Three CSV files of all orders, read back as lines; the head line stands in each."""
    k = F.col("o_orderkey")
    number = F.when(
        k % 4 != 0, (k % 1000).cast("double") + F.when(k % 4 == 1, 0.5).when(k % 4 == 2, 0.25).otherwise(0.0)
    )
    nested = F.struct(F.array(F.lit(1)).alias("m"), (k % 3).alias("k"))
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"),
        (F.col("o_totalprice") > 200000).alias("large"),
        number.alias("number"),
        _text("a, \"", F.col("o_orderstatus"), "\"").alias("text"),
        nested.alias("nested"),
    )
    folder = new_folder(spark, "csv")
    sinks.write_csv(rows, ["id", "large", "number", "text", "nested"], ["id"], folder, files=3)
    return spark.read.text(folder).groupBy(F.col("value").alias("line")).agg(
        F.count(F.lit(1)).cast("int").alias("files")
    )


_FOLD = """{name} AS (SELECT g, rn, a, b, 0 AS shard, a AS ua, b AS ub FROM {rows} WHERE rn = 1 UNION ALL
 SELECT r.g, r.rn, r.a, r.b, CASE WHEN s.ua > 0 AND (s.ua + r.a > {limit} OR s.ub + r.b > {limit}) THEN s.shard + 1 ELSE s.shard END,
 CASE WHEN s.ua > 0 AND (s.ua + r.a > {limit} OR s.ub + r.b > {limit}) THEN r.a ELSE s.ua + r.a END, CASE WHEN s.ua > 0 AND (s.ua + r.a >
 {limit} OR s.ub + r.b > {limit}) THEN r.b ELSE s.ub + r.b END
 FROM {name} s JOIN {rows} r ON r.g = s.g AND r.rn = s.rn + 1)"""


def folded(name: str, rows: str, limit: int) -> str:
    """SQL of the greedy fold over `rows` (g, rn from 1, counters a and b) as a recursive table with `shard`."""
    return _FOLD.format(name=name, rows=rows, limit=limit)


@query(f"""WITH RECURSIVE l AS (SELECT 0 AS g, row_number() OVER (ORDER BY s_suppkey) AS rn, s_suppkey || ',' || s_name || ',' || (s_suppkey % 7) AS
 line FROM supplier), z AS (SELECT g, rn, line, octet_length(encode(line)) + 1 AS a, 0 AS b FROM l), {folded("f", "z", 700 - 11)}
 SELECT shard, 'k,name,rest' || chr(10) || string_agg(line || chr(10), '' ORDER BY f.rn) AS text FROM f JOIN z USING (rn) GROUP BY shard""")
def csv_shard_files(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("k"), F.col("s_name").alias("name"), (k % 7).alias("rest"))
    return sinks.csv_shards(rows, ["k", "name", "rest"], ["k"], 700)


@query(f"""WITH RECURSIVE r AS (SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS a, CAST(sum(l_orderkey % 13) AS BIGINT) AS b FROM lineitem
 GROUP BY ALL), z AS (SELECT 0 AS g, row_number() OVER (ORDER BY l_suppkey) AS rn, l_suppkey, a, b FROM r), {folded("f", "z", 9000)}
 SELECT l_suppkey AS run_id, shard FROM f JOIN z USING (rn)""")
def run_shards(spark, sf_dir):
    """Whole runs in shards on two counters."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("run_id"),
        F.col("l_linenumber").alias("size"),
        (F.col("l_orderkey") % 13).alias("text_size"),
    )
    return sinks.run_shards(rows, 9000)


@F.pandas_udf(StringType())
def _unzipped(data: pd.Series) -> pd.Series:
    return data.map(lambda x: gzip.decompress(bytes(x)).decode())


@query("""WITH l AS (SELECT s_suppkey AS k, 'b' || s_suppkey || repeat('a', CASE WHEN s_suppkey % 7 = 0 THEN 5000 ELSE 10 END) AS t FROM supplier)
 SELECT 'log-' || k AS path, '{"password": "<redacted>", "t": "' || CASE WHEN length(t) > 4000 THEN substr(t, 1, 4000) ||
 '[clipped: original ' || length(t) || ' chars, sha256 ' || sha256(t) || ']' ELSE t END || '"}' || chr(10) ||
 '{"deep": {"api_key": "<redacted>", "n": ' || k || '}}' || chr(10) AS text, CASE WHEN length(t) > 4000 THEN 1 ELSE 0 END AS clipped FROM
 l""")
def scrubbed_logs(spark, sf_dir):
    """Logs with secrets masked and long strings clipped, as gzip; unzipped again for the comparison."""
    k = F.col("s_suppkey")
    t = F.concat(_text("b", k), F.repeat(F.lit("a"), F.when(k % 7 == 0, 5000).otherwise(10)))
    line = _text('{"password": "p', k, '", "t": "', t, '"}\nno json\n{"deep": {"api_key": "', k, '", "n": ', k, "}}")
    files = table(spark, sf_dir, "supplier").select(
        _text("log-", k).alias("path"), line.cast("binary").alias("content")
    )
    logs = sinks.scrubbed_logs(files)
    return logs.select("path", _unzipped("data").alias("text"), "clipped")


@query(r"""SELECT page_id AS run_id, 'see <url:' || regexp_extract(url, '^https?://([^/:?#]+)', 1) || '> token = <redacted>' AS text, page_id % 3 =
 0 AS mismatch FROM pages""")
def canonical_answers(spark, sf_dir):
    i = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(
        i.alias("run_id"),
        _text("see ", F.col("url"), " token = abc", i).alias("text"),
        F.when(i % 3 == 0, "a").otherwise("b").alias("pointer"),
        F.lit("b").alias("canonical"),
    )
    return sinks.canonical_answers(rows)


@query("""SELECT '| ' || s_suppkey || ' | a\\|b ' || s_name || ' |  |' AS line, s_acctbal AS estimate, CAST(s_suppkey % 9 AS BIGINT) AS n FROM
 supplier""")
def report_lines(spark, sf_dir):
    """Rows as lines of a Markdown table, beside an interval laid flat."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        k.alias("k"),
        _text("a|b\n", F.col("s_name")).alias("name"),
        F.lit(None).cast("string").alias("empty"),
        F.struct(F.col("s_acctbal").alias("estimate"), (k % 9).alias("n")).alias("interval"),
    )
    flat = sinks.flat_intervals(rows)
    return flat.select(sinks.markdown_lines(flat, ["k", "name", "empty"]).alias("line"), "estimate", "n")


@query("""WITH f AS (SELECT n_name AS label, encode(n_name || n_regionkey) AS content FROM nation UNION ALL SELECT 'lost', NULL), p AS (SELECT
 label, encode(label) || encode(chr(0)) || CASE WHEN content IS NULL THEN encode('absent') ELSE unhex(sha256(content)) END AS b FROM f)
 SELECT sha256(list_reduce(list(b ORDER BY label), lambda x, y: x || y)) AS fingerprint, true AS bound, true AS changed FROM p""")
def fingerprints(spark, sf_dir):
    """One hash of labelled contents, the same in any order; what is bound to it notices a change."""
    from tallyspark.operators.validation import same_inputs

    files = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("label"),
        F.concat("n_name", F.col("n_regionkey").cast("string")).cast("binary").alias("content"),
    )
    files = files.unionByName(spark.createDataFrame([("lost", None)], files.schema))
    now, again = sinks.fingerprint(files), sinks.fingerprint(files.orderBy(F.col("label").desc()))
    other = sinks.fingerprint(files.withColumn("content", F.concat("content", F.lit("x").cast("binary"))))
    return spark.createDataFrame(
        [(now, same_inputs(again, now) is None, same_inputs(other, now) is not None)],
        "fingerprint string, bound boolean, changed boolean",
    )
