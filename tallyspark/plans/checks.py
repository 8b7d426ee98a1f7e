"""Queries of text functions, secrets, validators and streams over whole tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import secrets, text
from tallyspark.operators import validation
from tallyspark.sources import sinks
from tallyspark.streaming import runs as streaming

from .files import _text
from .registry import query, table
from .scratch import new_folder

# --- links and prompts --------------------------------------------------------------------------------


@query("""SELECT page_id, 'see p' || page_id || ' [S1] and [S1] also [S2] ' || CASE WHEN page_id % 2 = 0 THEN 'q [S3]' ELSE '' END AS text, CASE
 WHEN page_id % 2 = 0 THEN url || ' https://m.example/' || page_id || ' http://z.example/' || (page_id % 3) ELSE url || ' http://z.example/'
 || (page_id % 3) END AS links FROM pages WHERE page_id % 2 = 1
 UNION ALL SELECT page_id, 'see p' || page_id || ' [S1] and [S1] also [S3] q [S2]', url || ' https://m.example/' || page_id ||
 ' http://z.example/' || (page_id % 3) FROM pages WHERE page_id % 2 = 0""")
def numbered_links(spark, sf_dir):
    """Each distinct address as [S1], [S2], ...: Markdown links first, marks at their ends gone."""
    i, url = F.col("page_id"), F.col("url")
    told = _text(
        "see [p",
        i,
        "](",
        url,
        ") and ",
        url,
        ". also http://z.example/",
        i % 3,
        ", ",
        F.when(i % 2 == 0, _text("[q](https://m.example/", i, ")")).otherwise(""),
    )
    told = F.regexp_replace(told, r", $", " ")
    rows = table(spark, sf_dir, "pages").select(
        "page_id", text.numbered_links(F.regexp_replace(told, r"(\d), ", "$1 ")).alias("n")
    )
    names = F.transform(
        F.sequence(F.lit(1), F.size("n.links")),
        lambda k: F.try_element_at("n.links", F.concat(F.lit("S"), k.cast("string"))),
    )
    return rows.select("page_id", "n.text", F.array_join(names, " ").alias("links"))


@query(r"""SELECT page_id, 'Page ' || page_id || ': <url:' || regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '(?i)example\.org',
 'filing-source', 'g') || '>' AS prompt FROM pages""")
def safe_prompts(spark, sf_dir):
    """Prompts from a template with links redacted; a masked host that is left would stop the query."""
    page = validation.prompt("Page {page}: {url}", page=F.col("page_id"), url=F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", text.safe_prompt(page, r"example\.org").alias("prompt"))


@query(r"""WITH r AS (SELECT page_id, regexp_replace(regexp_replace(html, '\[([^\]]*)\]\(https?://(?:[^)\s/@]*@)?([^)\s/:?#]+)[^)\s]*\)',
 '[\1](<url:\2>)', 'gi'), 'https?://(?:[^\s/)\]>"''`@]*@)?([^\s/:?#)\]>"''`]+)[^\s)\]>"''`]*', '<url:\1>', 'gi') AS redacted,
 regexp_replace(regexp_replace(html, '\[([^\]]*)\]\((https?://[^)\s]+)\)', '\1 [link]', 'gi'), 'https?://[^\s)\]>"''`]+', '[link]', 'gi') AS
 plain FROM pages),
 b AS (SELECT page_id, regexp_replace(redacted, 'example\.org', 'filing-source', 'gi') AS redacted, regexp_replace(regexp_replace(plain,
 '<url:[^>]*>', '[link]', 'g'), '\b(?:[a-z0-9-]+\.)+(?:com|org|net|gov|io|ca|tr|co|info|us)(?:/[^\s)\]]*)?', '[site]', 'gi') AS blind FROM
 r)
 SELECT page_id, md5(redacted) AS redacted,
 md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(blind, '\b(?:tools|functions)\.\w+',
 '[tool]', 'gi'), '\b\w+__\w+\b', '[tool]', 'gi'), '\bpermalink(s)?\b', 'link', 'gi'),
 '\b(?:read_passage|read_section|companies_search|companies_get|search_filings|read_filing_section|find_in_filing|list_filings|toc)\b',
 '[tool]', 'gi'), '\b(?:WebSearch|WebFetch|web[_ ]search|web[_ ]fetch)\b', '[tool]', 'gi'), '\bexchange_document_id\b', 'document id',
 'gi')) AS blind FROM b""")
def redacted_and_blind(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id",
        F.md5(text.redact_links(F.col("html"), r"example\.org").cast("binary")).alias("redacted"),
        F.md5(text.blind(F.col("html")).cast("binary")).alias("blind"),
    )


# --- secrets ------------------------------------------------------------------------------------------------

#: Texts that hold secrets of eight kinds, by remainder of the customer's key.
_CASES = """c AS (SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 0 THEN '{"user": "n", "password": "p' || c_custkey || '"}' WHEN 1 THEN
 'note api_key = abc' || c_custkey WHEN 2 THEN 'Authorization: Basic dXNlcjpwYXNz' WHEN 3 THEN 'nothing here' WHEN 4 THEN 'mail a' ||
 c_custkey || '@b.example now' WHEN 5 THEN 'see {"token": "t"} end' WHEN 6 THEN 'use Bearer tok' || c_custkey || 'a1b2c3 now' ELSE
 'session = s' || c_custkey END AS t FROM customer)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    told = (
        F.when(
            k % 8 == 0, _text('{"user": "n", "password": "p', k, '"}')
        ).when(k % 8 == 1, _text("note api_key = abc", k)).when(
            k % 8 == 2, "Authorization: Basic dXNlcjpwYXNz"
        ).when(k % 8 == 3, "nothing here")
        .when(k % 8 == 4, _text("mail a", k, "@b.example now")).when(k % 8 == 5, 'see {"token": "t"} end').when(
            k % 8 == 6, _text("use Bearer tok", k, "a1b2c3 now")
        ).otherwise(_text("session = s", k))
    )
    return table(spark, sf_dir, "customer").select(k.alias("k"), told.alias("t"))


@query(f"""WITH {_CASES} SELECT k, CASE k % 8 WHEN 0 THEN '{{"user": "n", "password": "<redacted>"}}' WHEN 1 THEN 'note api_key = <redacted>' WHEN 2
 THEN 'Authorization: <redacted>' WHEN 5 THEN 'see {{"token": "<redacted>"}} end' WHEN 6 THEN 'use Bearer <redacted> now' ELSE t END AS
 scrubbed,
 CASE k % 8 WHEN 0 THEN '{{"user": "n", "password": "<redacted>"}}' WHEN 1 THEN 'note api_key = <redacted>' WHEN 2 THEN
 'Authorization: <redacted>' WHEN 4 THEN 'mail <email> now' WHEN 5 THEN 'see {{"token": "<redacted>"}} end' WHEN 6 THEN
 'use Bearer <redacted> now' WHEN 7 THEN 'session = <redacted>' ELSE t END AS masked FROM c""")
def masked_text(spark, sf_dir):
    """Credentials scrubbed from prose, and everything masked, under both policies."""
    return _cases(spark, sf_dir).select(
        "k", secrets.scrub_free_text("t").alias("scrubbed"), secrets.mask_secrets("t").alias("masked")
    )


@query(f"""WITH {_CASES} SELECT k, CASE k % 8 WHEN 0 THEN '$<json>.password' WHEN 1 THEN '$<api_key=>' WHEN 2 THEN
 '$<Authorization header> $<Authorization=>' WHEN 5 THEN '$<<json>.token> $<token=>' WHEN 7 THEN '$<session=>' ELSE '' END AS paths, CASE k
 % 8 WHEN 6 THEN 'bearer' ELSE '' END AS shapes, 'p' || k || 'x' AS form FROM c""")
def secret_paths(spark, sf_dir):
    """Paths of unmasked secrets through JSON, prose and JSON in prose; token shapes; key names in one form."""
    key = secrets.normalize_key(_text("P_", F.col("k"), "-X"))
    return _cases(spark, sf_dir).select(
        "k",
        F.array_join(secrets.secret_paths("t"), " ").alias("paths"),
        F.array_join(secrets.quick_findings(F.col("t")), " ").alias("shapes"),
        key.alias("form"),
    )


@query(f"""WITH {_CASES}, p AS (SELECT k, t, unnest(['full', 'credential']) AS policy FROM c), f AS (SELECT k, policy, CASE k % 8 WHEN 0 THEN
 ['0 <json>.password', '27 password='] WHEN 1 THEN ['15 api_key='] WHEN 2 THEN ['0 Authorization header', '15 Authorization='] WHEN 5 THEN
 ['4 <json>.token', '15 token='] WHEN 7 THEN CASE WHEN policy = 'full' THEN ['10 session='] ELSE [] END ELSE [] END AS found FROM p), u AS
 (SELECT k, policy, unnest(found) AS x FROM f)
 SELECT k, policy, CAST(split_part(x, ' ', 1) AS INTEGER) AS "at", substr(x, strpos(x, ' ') + 1) AS what FROM u""")
def secret_table(spark, sf_dir):
    """The table function: a row for each unmasked secret, under both policies."""
    rows = _cases(spark, sf_dir).withColumn("policy", F.explode(F.array(F.lit("full"), F.lit("credential"))))
    found = rows.lateralJoin(secrets.SecretFindings(F.col("t").outer(), F.col("policy").outer()))
    return found.select("k", "policy", "at", "what")


@query(f"""WITH {_CASES}, f AS (SELECT unnest(CASE k % 8 WHEN 0 THEN ['$<json>.password'] WHEN 1 THEN ['$<api_key=>'] WHEN 2 THEN
 ['$<Authorization header>', '$<Authorization=>'] WHEN 3 THEN CASE WHEN k % 16 = 3 THEN ['source host'] ELSE [] END WHEN 4 THEN ['email']
 WHEN 5 THEN ['$<<json>.token>', '$<token=>'] WHEN 6 THEN ['bearer'] ELSE ['too large', '$<session=>'] END) AS what FROM c) SELECT what,
 count(*) AS files FROM f GROUP BY ALL""")
def output_gate(spark, sf_dir):
    """What may not be published: size, hosts, emails, token shapes, unmasked values."""
    k = F.col("k")
    long = F.when(k % 8 == 7, F.concat("t", F.repeat(F.lit(" pad"), 300))).when(
        k % 16 == 3, F.concat("t", F.lit(" at files.example.org"))
    ).otherwise(F.col("t"))
    files = _cases(spark, sf_dir).select(k.cast("string").alias("path"), long.alias("text"))
    return sinks.check_outputs(files, r"example\.org", limit=1000).groupBy("what").agg(F.count(F.lit(1)).alias("files"))


#: Secrets planted in documents: (as it stands, as prose is scrubbed, with everything masked), in parts of plain text, `v`
#: a value of 10 to 29 characters that differs by document, `b` a login in base64, and `opening` and `closing` some nesting.
_PLANTS = (
    (["api_key = ", "v"], ["api_key = <redacted>"], ["api_key = <redacted>"]),
    (["Authorization: Bearer ", "v"], ["Authorization: <redacted>"], ["Authorization: <redacted>"]),
    (["opening", '{"token": "', "v", '"}', "closing"],) + (["opening", '{"token": "<redacted>"}', "closing"],) * 2,
    (
        ['{"note": "{\\"password\\": \\"', "v", '\\"}"}'],
        ['{"note": "{\\"password\\": \\"<redacted>\\"}"}'],
        ['{"note": "{\\"password\\": \\"', "v", '\\"}"}'],
    ),
    (["mail ", "v", "@b.example"], ["mail ", "v", "@b.example"], ["mail <email>"]),
    (["key sk-", "v", " was"],) + (["key <redacted-key> was"],) * 2,
    (["jwt eyJ", "v", ".", "v", ".", "v", " was"],) + (["jwt <redacted-jwt> was"],) * 2,
    (["use Bearer ", "v", " now"],) + (["use Bearer <redacted> now"],) * 2,
    (["proxy-authorization = Basic ", "b"],) + (["proxy-authorization = <redacted>"],) * 2,
    (['session = "', "v", ' and more"'], ['session = "', "v", ' and more"'], ['session = "<redacted>"']),
    (["'client-secret' : 'a\\'", "v", "'; x"],) + (["'client-secret' : '<redacted>'; x"],) * 2,
    (["{ open, password=", "v", "; }"],) + (["{ open, password=<redacted>; }"],) * 2,
)
_PARTS = ("v", "b", "opening", "closing")


def _plant_sql(kind: str, form: int) -> str:
    told = lambda parts: " || ".join(p if p in _PARTS else "'" + p.replace("'", "''") + "'" for p in parts)
    cases = " ".join(f"WHEN {k} THEN {told(x[form])}" for k, x in enumerate(_PLANTS))
    return f"CASE {kind} {cases} END"


@query(f"""
WITH t AS (
  SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g')) AS c,
    'v1' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8 + CAST(doc_id % 20 AS INT)) AS v,
    doc_id % {len(_PLANTS)} AS k1, doc_id // {len(_PLANTS)} % {len(_PLANTS)} AS k2,
    repeat('{{"a": ', CAST(doc_id % 5 AS INT)) AS opening, repeat('}}', CAST(doc_id % 5 AS INT)) AS closing
  FROM documents),
p AS (
  SELECT *, CAST(doc_id * 7919 % (length(c) + 1) AS INT) AS place, to_base64(CAST('user:' || v AS BLOB)) AS b FROM t)
SELECT doc_id,
  md5(substr(c, 1, place) || chr(10) || ({_plant_sql("k1", 1)}) || chr(10) || substr(c, place + 1) || chr(10)
    || ({_plant_sql("k2", 1)})) AS scrubbed,
  md5(substr(c, 1, place) || chr(10) || ({_plant_sql("k1", 2)}) || chr(10) || substr(c, place + 1) || chr(10)
    || ({_plant_sql("k2", 2)})) AS masked
FROM p
""")
def planted_secrets(spark, sf_dir):
    """Whole documents with two secrets of twelve kinds each, at varying places, lengths and depths of nesting."""
    many = len(_PLANTS)
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " ")).alias("c"),
        F.concat(F.lit("v1"), F.expr("substr(md5(cast(doc_id AS string)), 1, 8 + cast(doc_id % 20 AS int))")).alias("v"),
        (F.col("doc_id") % many).alias("k1"),
        (F.floor(F.col("doc_id") / many) % many).alias("k2"),
        F.expr("repeat('{\"a\": ', cast(doc_id % 5 AS int))").alias("opening"),
        F.expr("repeat('}', cast(doc_id % 5 AS int))").alias("closing"),
    )
    docs = docs.withColumn("place", F.expr("cast(doc_id * 7919 % (length(c) + 1) AS int)")).withColumn(
        "b", F.base64(F.concat(F.lit("user:"), "v"))
    )
    told = lambda parts: F.concat(*[F.col(p) if p in _PARTS else F.lit(p) for p in parts])
    plant = lambda kind: F.coalesce(*[F.when(F.col(kind) == k, told(x[0])) for k, x in enumerate(_PLANTS)])
    whole = F.concat_ws("\n", F.expr("substr(c, 1, place)"), plant("k1"), F.expr("substr(c, place + 1)"), plant("k2"))
    return docs.select("doc_id", whole.alias("t")).select(
        "doc_id",
        F.md5(secrets.scrub_free_text("t").cast("binary")).alias("scrubbed"),
        F.md5(secrets.mask_secrets("t").cast("binary")).alias("masked"),
    )


# --- validators -------------------------------------------------------------------------------------------------

_UUID = "00000000-0000-0000-0000-"
_LINK = r"^https://p\.example/([^/]+)/([^/]+)$"


def _uuid(c) -> F.Column:
    return F.concat(F.lit(_UUID), F.lpad(c.cast("string"), 12, "0"))


@query("""WITH p AS (SELECT p_partkey AS k FROM part), s AS (SELECT s_suppkey AS k FROM supplier), r AS (
 SELECT 'questions of a stratum' AS rule, (SELECT count(DISTINCT k % 3) FROM s) AS n UNION ALL SELECT 'empty question', count(*) FILTER
 (WHERE k % 10 = 1) FROM s UNION ALL SELECT 'no facts', count(*) FILTER (WHERE k % 10 = 2) FROM s
 UNION ALL SELECT 'unknown kind of fact', count(*) FILTER (WHERE k % 7 = 6) FROM p UNION ALL SELECT 'statement and value required', count(*)
 FILTER (WHERE k % 50 = 3 OR k % 50 = 4) FROM p UNION ALL SELECT 'control fact outside the controls', count(*) FILTER (WHERE k % 7 = 5 AND k
 % 3 <> 0) FROM p UNION ALL SELECT 'other fact among the controls', count(*) FILTER (WHERE k % 7 <> 5 AND k % 3 = 0) FROM p
 UNION ALL SELECT 'absence without a reason', count(*) FILTER (WHERE k % 7 = 4 AND k % 2 = 0) FROM p UNION ALL SELECT
 'absence without terms', count(*) FILTER (WHERE k % 7 = 4 AND k % 5 = 0) FROM p UNION ALL SELECT 'absence without a filing', count(*)
 FILTER (WHERE k % 7 = 4 AND k % 11 = 0) FROM p UNION ALL SELECT 'computed without formula or parts', count(*) FILTER (WHERE k % 7 = 3 AND k
 % 2 = 0) FROM p
 UNION ALL SELECT 'computed from an unknown fact', count(*) FILTER (WHERE k % 7 = 3) FROM p
 UNION ALL SELECT 'filing is not a UUID', count(*) FILTER (WHERE k % 7 < 3 AND k % 11 = 0) FROM p UNION ALL SELECT
 'not a passage permalink', count(*) FILTER (WHERE k % 7 < 3 AND k % 13 = 0) FROM p UNION ALL SELECT 'permalink of another passage',
 count(*) FILTER (WHERE k % 7 < 3 AND k % 13 <> 0 AND (k % 11 = 0 OR k % 17 = 0)) FROM p
 UNION ALL SELECT 'document id or the reason for its absence', count(*) FILTER (WHERE k % 7 < 3 AND k % 19 = 0) FROM p UNION ALL SELECT
 'quote missing', count(*) FILTER (WHERE k % 7 < 3 AND k % 23 = 0) FROM p UNION ALL SELECT 'duplicate fact id', count(*) FILTER (WHERE k %
 100 = 0) FROM p UNION ALL SELECT 'duplicate question id', count(*) FILTER (WHERE k % 40 = 0) FROM s)
 SELECT rule, n AS violations FROM r WHERE n > 0""")
def question_rules(spark, sf_dir):
    """All rules of a question set, over facts that break them by remainder of their key."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    stratum = lambda c: F.when(c % 3 == 0, "control").otherwise(_text("s", c % 3))
    kind = F.when(k % 7 < 3, "sourced").when(k % 7 == 3, "computed").when(k % 7 == 4, "absence").when(k % 7 == 5, "control").otherwise("odd")
    filing = F.when(k % 11 == 0, "x").otherwise(_uuid(k))
    link = F.when(k % 13 == 0, "nowhere").otherwise(
        F.concat(
            F.lit("https://p.example/"), _uuid(k), F.lit("/"), F.when(k % 17 == 0, "other").otherwise(_uuid(k + 1))
        )
    )
    source = F.struct(
        filing.alias("filing_uuid"),
        _uuid(k + 1).alias("chunk_id"),
        link.alias("permalink"),
        F.when(k % 19 != 0, "d").alias("exchange_document_id"),
        F.lit(None).cast("string").alias("document_id_absent_reason"),
        F.when(k % 23 == 0, " ").otherwise("quote").alias("quote"),
    )
    facts = table(spark, sf_dir, "part").select(
        k.cast("string").alias("question_id"), k.cast("string").alias("fact_id"), stratum(k).alias("stratum"), kind.alias("kind"), F.when(k % 50 == 3, " ").otherwise("s").alias("statement"), F.when(k % 50 != 4, "v").alias("value"), source.alias("source"),
        F.when(k % 2 == 1, "why").alias("absence_reason"), F.when(k % 5 != 0, F.array(F.lit("t"))).alias("absent_terms"), F.when(k % 2 == 1, "x").alias("formula"), F.when(
            k % 7 == 3, F.array(F.lit("no such fact"))
        ).alias("computed_from"), (k % 100 == 0).alias("twice"),
    )
    # the second copy of a fact is of a kind and content that breaks no other rule
    again = facts.where("twice").withColumns(
        {
            "kind": F.when(F.col("stratum") == "control", "control").otherwise("trap"),
            "statement": F.lit("s"),
            "value": F.lit("v"),
            "computed_from": F.lit(None).cast("array<string>"),
        }
    )
    facts = facts.unionByName(again).drop("twice")
    questions = table(spark, sf_dir, "supplier").select(
        s.cast("string").alias("id"),
        stratum(s).alias("stratum"),
        F.when(s % 10 == 1, " ").otherwise("what?").alias("question"),
        F.when(s % 10 != 2, F.array(F.lit(1))).alias("facts"),
    )
    questions = questions.unionByName(questions.where("id % 40 = 0"))
    found = validation.validate_questions(questions, facts, {"control": -1, "s1": -1, "s2": -1}, _LINK)
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


@query("""WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 4 = 0), r AS (SELECT 'trap without a check row' AS rule, count(*) FILTER
 (WHERE k % 24 = 0) AS n FROM p UNION ALL SELECT 'trap of a row that is not contradicted', count(*) FILTER (WHERE k % 24 <> 0 AND k % 5 = 0)
 FROM p UNION ALL SELECT 'trap of another category', count(*) FILTER (WHERE k % 7 = 0) FROM p UNION ALL SELECT 'trap of another value',
 count(*) FILTER (WHERE k % 9 = 0) FROM p
 UNION ALL SELECT 'trap that contradicts no fact', count(*) FILTER (WHERE k % 20 = 0) FROM p UNION ALL SELECT 'questions of a role', 2 UNION
 ALL SELECT 'duplicate question id', (SELECT count(*) FROM supplier WHERE s_suppkey % 50 = 0)) SELECT rule, n AS violations FROM r WHERE n >
 0""")
def contamination_rules(spark, sf_dir):
    """Traps bound to contradicted check rows of the same category and value, and to a fact of their question."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    part, none = table(spark, sf_dir, "part"), F.lit(None).cast("string")
    trap = k % 4 == 0
    question = F.floor(k / 4).cast("string").alias("question_id")
    facts = part.select(
        question,
        k.cast("string").alias("fact_id"),
        F.when(trap, "trap").otherwise("sourced").alias("kind"),
        F.when(trap, _text("1 00", k)).otherwise("1").alias("value"),
        F.when(trap, _text("X", k)).otherwise(none).alias("crosscheck_row"),
        F.lit("forum").alias("source_category"),
        F.when(trap, k.cast("string")).alias("contradicts"),
    )
    facts = facts.withColumn(
        "contradicts", F.when(F.col("fact_id") % 20 == 0, "none such").otherwise(F.col("contradicts"))
    )
    sample = part.select(
        _text("X", k).alias("row_id"),
        F.when(k % 7 == 0, "news").otherwise("forum").alias("category"),
        F.when(k % 9 == 0, "2").otherwise(_text("100", k)).alias("value"),
    )
    checks = part.where(k % 24 != 0).select(
        _text("X", k).alias("row_id"), F.when(k % 5 == 0, "confirmed").otherwise("contradicted").alias("bin")
    )
    questions = table(spark, sf_dir, "supplier").select(
        s.cast("string").alias("id"), F.when(s % 2 == 0, "trap").otherwise("control").alias("role")
    )
    questions = questions.unionByName(questions.where("id % 50 = 0"))
    found = validation.validate_contamination(questions, facts, {"trap": -1, "control": -1}, sample, checks)
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


@query("""SELECT 'audit of another rule' AS what, 's' || s_suppkey AS subject, 0 AS filled FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT
 'human input', 'shard ' || (s_suppkey % 10), CAST(sum(CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 6 = 0 THEN 1
 ELSE 0 END) AS BIGINT) FROM supplier GROUP BY s_suppkey % 10 HAVING sum(CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey
 % 6 = 0 THEN 1 ELSE 0 END) > 0""")
def audit_rules(spark, sf_dir):
    """Audit rows of another rule, and shards with human input, which no export may replace."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        _text("s", k).alias("run_id"),
        F.when(k % 3 == 0, "B").when(k % 3 == 1, "combined").alias("rule"),
        _text("shard ", k % 10).alias("_path"),
        F.when(k % 4 == 0, "correct").otherwise(" ").alias("verdict"),
        F.when(k % 6 == 0, "a note").alias("note"),
    )
    other = validation.audit_rule(rows, "combined").select(
        F.lit("audit of another rule").alias("what"), "subject", F.lit(0).cast("bigint").alias("filled")
    )
    human = validation.filled(rows, ["verdict", "note"]).select(
        F.lit("human input").alias("what"),
        F.col("_path").alias("subject"),
        F.col("filled").cast("bigint").alias("filled"),
    )
    return other.unionByName(human)


@query("""SELECT o_orderkey AS k, array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'no primary window' WHEN o_orderkey % 3 = 0 THEN
 'primary: used percent is no number' WHEN o_orderkey % 5 = 0 THEN 'primary: no reset time' END, CASE WHEN o_orderkey % 7 = 0 THEN
 'secondary: used percent is no number' END, CASE WHEN o_orderkey % 4 = 1 THEN 'credits without a flag' END], lambda x: x IS NOT NULL),
 '; ') AS problems FROM orders""")
def reading_problems(spark, sf_dir):
    """Why plan readings are not complete."""
    k = F.col("o_orderkey")
    window = lambda used, resets: F.struct(
        used.cast("double").alias("used_percent"), resets.cast("bigint").alias("resets_at")
    )
    primary = F.when(k % 2 != 0, window(F.when(k % 3 == 0, F.lit(float("nan"))).otherwise(5.0), F.when(k % 5 != 0, k)))
    secondary = window(F.when(k % 7 == 0, F.lit(float("inf"))).otherwise(1.0), k)
    credits = F.when(
        k % 4 == 1, F.struct(F.lit(None).cast("boolean").alias("has_credits"))
    ).when(k % 4 == 2, F.struct(F.lit(True).alias("has_credits")))
    reading = F.struct(primary.alias("primary"), secondary.alias("secondary"), credits.alias("credits"))
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), F.array_join(validation.reading_problems(reading), "; ").alias("problems")
    )


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 1 THEN 'no list of items' WHEN 2 THEN 'an item twice' WHEN 3 THEN
 'items differ from what was asked' WHEN 4 THEN 'a value that is not listed' END AS error, CASE WHEN o_orderkey % 6 IN (0, 5) THEN 2 ELSE 0
 END AS items FROM orders""")
def parsed_replies(spark, sf_dir):
    """Model replies under a closed contract: fenced or bare, every label once, known values only; all or nothing."""
    k = F.col("o_orderkey")
    item = lambda ident, value: _text('{"id": "', ident, '", "v": "', value, '"}')
    a, b = item(_text("a", k), F.lit("x")), item(_text("b", k), F.lit("y"))
    body = lambda *items: F.concat(F.lit('{"items": ['), F.concat_ws(", ", *items), F.lit("]}"))
    reply = (
        F.when(
            k % 6 == 0, _text("```json\n", body(b, a), "\n```")
        ).when(k % 6 == 1, "I can't say.").when(k % 6 == 2, body(a, b, a)).when(k % 6 == 3, body(a))
        .when(k % 6 == 4, body(a, item(_text("b", k), F.lit("z")))).otherwise(body(a, b))
    )
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), reply.alias("reply"))
    out = validation.parse_replies(
        rows,
        "struct<id:string,v:string>",
        F.array(_text("a", F.col("k")), _text("b", F.col("k"))),
        enums={"v": ("x", "y")},
    )
    return out.select("k", "error", F.coalesce(F.when(F.size("items") > 0, F.size("items")), F.lit(0)).alias("items"))


# --- streams ------------------------------------------------------------------------------------------------------


def _parts(spark: SparkSession, sf_dir: str, name: str, parts: list[DataFrame], step) -> None:
    """Write JSON files part by part into one folder; after each, `step(folder)`."""
    folder = new_folder(spark, name)
    for part in parts:
        part.write.mode("append").json(folder)
        step(folder)


@query("""SELECT event_id AS run_id, CASE WHEN event_type IN ('error', 'view') THEN value * 2 ELSE value END AS value FROM events""")
def streamed_ledger(spark, sf_dir):
    """An append-only ledger as a stream: a record that comes again replaces the one before, bucket by bucket."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), "event_type", "value")
    first = e.where("event_type <> 'error'").select("run_id", "value")
    second = e.where("event_type IN ('error', 'view')").select("run_id", (F.col("value") * 2).alias("value"))
    kept, mark = new_folder(spark, "ledger-table"), new_folder(spark, "ledger-mark")
    _parts(
        spark,
        sf_dir,
        "ledger-in",
        [first, second],
        lambda folder: streaming.keep_latest(
            streaming.record_stream(spark, folder, "run_id bigint, value double"), kept, mark
        ).awaitTermination(),
    )
    return streaming.current(spark, kept).select("run_id", "value")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def incremental_scan(spark, sf_dir):
    """Files taken by one run of a stream are not taken by the next."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    out, mark = new_folder(spark, "scan-out"), new_folder(spark, "scan-mark")

    def step(folder):
        rows = streaming.record_stream(spark, folder, "event_id bigint, event_type string")
        rows.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", mark
        ).trigger(availableNow=True).start().awaitTermination()

    _parts(spark, sf_dir, "scan-in", [e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")], step)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS run_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 1)""")
def unfinished_runs(spark, sf_dir):
    """Dispatched runs of a stream that the table of records lacks."""
    out, mark = new_folder(spark, "runs-out"), new_folder(spark, "runs-mark")
    records = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("run_id"))

    def step(folder):
        rows = streaming.unfinished(streaming.record_stream(spark, folder, "run_id bigint"), records)
        rows.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", mark
        ).trigger(availableNow=True).start().awaitTermination()

    _parts(spark, sf_dir, "runs-in", [table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))], step)
    return spark.read.parquet(out).select("run_id")
