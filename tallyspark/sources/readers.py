"""Readers. Every one returns a DataFrame with a fixed schema; unknown fields are dropped, missing ones are null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.plans.scratch import stash

#: Everything that Python's line splitting takes for the end of a line.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"

USAGE = "struct<total:bigint,input:bigint,cached_input:bigint,cache_write_input:bigint,uncached_input:bigint,output:bigint,reasoning:bigint>"
PLAN_WINDOW = (
    "struct<source:string,limit_id:string,plan_type:string,primary:struct<used_percent:double,window_minutes:bigint,resets_at:bigint>,"
    "secondary:struct<used_percent:double,window_minutes:bigint,resets_at:bigint>,credits:struct<has_credits:boolean,unlimited:boolean,balance:string,balance_first:string,balance_min:string>,"
    "rate_limit_reached_type:string,rate_limit_reached_seen:string,status:string,rate_limit_type:string,windows:map<string,double>,window_resets:map<string,bigint>,resets_at:bigint,"
    "is_using_overage:boolean,overage_status:string,overage_disabled_reason:string,rejected_seen:boolean>"
)
RUN_RECORD = (
    "run_id string, run_key string, agent string, arm string, question_id string, stratum string, repetition bigint, attempt bigint, model string, effort string, service_tier string, auth_mode string, billing_mode string, status string, status_reason string, "
    f"usage {USAGE}, model_calls bigint, tool_calls map<string,bigint>, web_actions map<string,bigint>, compactions bigint, truncations bigint, turn_limit boolean, timeout boolean, wall_s double, cost_usd double, cost_basis string, mcp_loaded boolean, contaminated boolean, started_at string, "
    f"cli_version string, num_turns bigint, answer_file string, truncated_calls array<struct<call_id:string,tool:string,original_tokens:bigint>>, paged_results bigint, notes array<string>, plan_window {PLAN_WINDOW}, account_dir string"
)
FACT = "struct<id:string,kind:string,statement:string,value:string,unit:string,accept:array<string>,source:struct<filing_uuid:string,chunk_id:string,permalink:string,exchange_document_id:string,document_id_absent_reason:string,quote:string,symbol:string>,absent_terms:array<string>,absence_reason:string,formula:string,computed_from:array<string>,crosscheck_row:string,source_category:string,contradicts:string>"
QUESTION_SET = f"set string, questions array<struct<id:string,stratum:string,question:string,role:string,tags:array<string>,companies:array<string>,facts:array<{FACT}>>>"
PASS = "struct<verdicts:map<string,string>,fact_verdicts:map<string,string>,complete:boolean,error:string,attempts:bigint>"
JUDGEMENT = f"run_id string, status string, rule string, accuracy double, complete double, fact_verdicts map<string,string>, fact_scores map<string,double>, disputed array<string>, passes map<string,{PASS}>, batches bigint"
SOURCE = "struct<kind:string,key:string,url:string,host:string,title:string,snippet:string,refs:array<string>,order:bigint,segments:array<array<string>>,filing_id:string,action:string>"
SOURCES_DOC = f"run_id string, agent string, arm string, question_id string, stratum string, companies array<string>, sources array<{SOURCE}>, answer_links map<string,string>, complete boolean"
CORRECTIONS = "set string, corrections array<struct<question_id:string,fact_id:string,fields:struct<statement:string,value:string,unit:string,accept:array<string>,source:struct<filing_uuid:string,chunk_id:string,permalink:string,exchange_document_id:string,document_id_absent_reason:string,quote:string,symbol:string>>,reason:string,also_stated:array<struct<chunk_id:string,permalink:string,quote:string>>>>"
ANALYSIS = "primary_judge string, rows array<map<string,string>>, comparisons array<map<string,string>>"


def json_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, ord, raw): the objects of JSON-lines files.

    Blank lines, lines that do not parse and values that are no objects are skipped; ord counts the lines that are
    kept, from 0, and stands for event time everywhere.

    Files are read in splits, a log of any size by many tasks. A line's place is the start of its split, its number in
    the split and, where other marks than line feeds end lines, its number in that; the kept lines are written once with
    it, and a line's ord is its rank in the split plus the kept lines of the splits before, a running sum over one row a
    split. So this runs a job at once.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
        F.posexplode(F.split("value", LINE_END)).alias("pos", "line"),
    )
    kept = stash(_objects(lines), "lines")
    sizes = kept.groupBy("path", "_split").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("path", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("path", "_split").orderBy("_at", "pos")) - 1
    ranked = kept.withColumn("_rank", rank).join(sizes, ["path", "_split"])
    return ranked.select("path", (F.col("_before") + F.col("_rank")).alias("ord"), "raw")


def _objects(lines: DataFrame) -> DataFrame:
    """Lines without white space at their ends as `raw`, those that are JSON objects."""
    raw = F.trim(F.regexp_replace("line", r"^(?U)\s+|(?U)\s+$", ""))
    return lines.withColumn("raw", raw).drop("line").where(
        F.col("raw").startswith("{") & F.expr(
            "try_parse_json(raw) IS NOT NULL OR get_json_object(raw, '$') IS NOT NULL"
        )
    )


def kept_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """The same of logs that are values of a column; a log is one group of the window."""
    lines = files.select(F.col(key).alias("path"), F.posexplode(F.split(text, LINE_END)).alias("pos", "line"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1
    return _objects(lines).select("path", place.alias("ord"), "raw")


def documents(spark: SparkSession, path: str, schema: str, name: str | None = None) -> DataFrame:
    """One JSON object a file, with the file it came from."""
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
    if name:
        reader = reader.option("pathGlobFilter", name)
    return reader.json(path).select("*", F.col("_metadata.file_path").alias("_path"))


def run_records(spark: SparkSession, path: str) -> DataFrame:
    """All `record.json` below a folder."""
    return with_defaults(documents(spark, path, RUN_RECORD, "record.json"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """An append-only ledger, one record a line."""
    return with_defaults(spark.read.schema(RUN_RECORD).json(path))


def with_defaults(records: DataFrame) -> DataFrame:
    """Fields that older records lack: empty lists and zero counts."""
    empty = {
        "truncated_calls": "array<struct<call_id:string,tool:string,original_tokens:bigint>>", "notes": "array<string>"
    }
    out = records.withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in empty.items()})
    return out.withColumn("paged_results", F.coalesce("paged_results", F.lit(0).cast("bigint")))


def judgements(spark: SparkSession, path: str) -> DataFrame:
    return documents(spark, path, JUDGEMENT, "judgement.json")


def judgement_passes(docs: DataFrame) -> DataFrame:
    """run_id, pass, and the fields of the stored pass."""
    return docs.select(
        "run_id", F.explode(F.map_entries("passes")).alias("p")
    ).select("run_id", F.col("p.key").alias("pass"), "p.value.*")


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """One row a question, facts nested. Fails on a document without a list of questions."""
    docs = documents(spark, path, QUESTION_SET)
    listed = F.coalesce("questions", F.raise_error(F.lit("a question set needs a list of questions")))
    return docs.select(F.col("set"), F.posexplode(listed).alias("q_ord", "q")).select("set", "q_ord", "q.*")


def facts(questions: DataFrame) -> DataFrame:
    """One row a fact: question_id, stratum, f_ord and the fields of the fact."""
    return questions.select(
        F.col("id").alias("question_id"), "stratum", F.posexplode("facts").alias("f_ord", "f")
    ).select("question_id", "stratum", "f_ord", F.col("f.id").alias("fact_id"), "f.*").drop("id")


def audit_rows(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Hand-edited CSV shards (quoted, several lines in a cell): all columns as text, and the ordinal in the file."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option(
        "pathGlobFilter", "audit-queue-*.csv"
    )
    rows = reader.csv(sorted(set(paths))).select(
        "*", F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_at")
    )
    return rows.withColumn("_row", F.row_number().over(Window.partitionBy("_path").orderBy("_at"))).drop("_at")


def pick_log(files: DataFrame, patterns: list[str], run: str = "run_id", path: str = "path") -> DataFrame:
    """The file of each run that the earliest pattern finds (the last by name among several)."""
    rank = F.coalesce(*[F.when(F.col(path).rlike(p), F.lit(i)) for i, p in enumerate(patterns)])
    best = Window.partitionBy(run).orderBy("_rank", F.col(path).desc())
    return files.withColumn("_rank", rank).where("_rank IS NOT NULL").withColumn(
        "_n", F.row_number().over(best)
    ).where("_n = 1").drop("_rank", "_n")


def host_table(spark: SparkSession, path: str) -> DataFrame:
    """A document host -> {category, status, reason} as a dimension: host, category, status, reason."""
    raw = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "map<string,struct<category:string,status:string,reason:string>>").alias("m")
    )
    return raw.select(F.explode("m").alias("host", "v")).select("host", "v.*")


def complete_sources(spark: SparkSession, path: str) -> DataFrame:
    return documents(spark, path, SOURCES_DOC).where("complete")


def missing(wanted: DataFrame, present: DataFrame, key: str = "run_id") -> DataFrame:
    return wanted.join(present.select(key).distinct(), key, "left_anti")


def analysis(spark: SparkSession, path: str) -> DataFrame:
    """An earlier result; results from before there was a choice of judge are `combined`."""
    return documents(spark, path, ANALYSIS).withColumn("primary_judge", F.coalesce("primary_judge", F.lit("combined")))


def corrections(spark: SparkSession, path: str) -> DataFrame:
    return documents(spark, path, CORRECTIONS).select("set", F.inline("corrections"))


def raw_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, content, bytes and sha256 of whole files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select(
        "path", "content", F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )
