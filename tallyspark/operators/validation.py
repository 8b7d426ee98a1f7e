"""Constraint checks: each rule is a query that yields violations; a set passes if their union is empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import bare_value, quote_form

UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
KINDS = ("sourced", "absence", "computed", "control", "trap")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def violation(rows: DataFrame, rule: str, subject: Column, detail: Column) -> DataFrame:
    return rows.select(
        F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail")
    )


def unique(rows: DataFrame, key: str, rule: str) -> DataFrame:
    dup = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return violation(dup, rule, F.col(key), F.col("n"))


def counts(rows: DataFrame, key: str, expected: dict[str, int], rule: str) -> DataFrame:
    """Values of a key whose number differs from what is expected, values that are missing or unknown among them."""
    spark = rows.sparkSession
    want = spark.createDataFrame(list(expected.items()), "k string, want int")
    have = rows.groupBy(F.col(key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("have"))
    both = want.join(have, "k", "full").where("want IS NULL OR coalesce(have, 0) <> want")
    return violation(
        both,
        rule,
        F.col("k"),
        F.concat_ws(" of ", F.coalesce("have", F.lit(0)).cast("string"), F.coalesce("want", F.lit(0)).cast("string")),
    )


def references(rows: DataFrame, key: str, parents: DataFrame, parent_key: str, rule: str, subject: str) -> DataFrame:
    lost = rows.where(F.col(key).isNotNull()).join(
        parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti"
    )
    return violation(lost, rule, F.col(subject), F.col(key))


def where(rows: DataFrame, bad: Column, rule: str, subject: str, detail: Column | None = None) -> DataFrame:
    return violation(
        rows.where(F.coalesce(bad, F.lit(False))), rule, F.col(subject), F.lit("") if detail is None else detail
    )


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def source_rules(facts: DataFrame, permalink: str) -> list[DataFrame]:
    """Rules for facts with a source. `permalink` is a pattern with the filing and the chunk as groups 1 and 2."""
    s = F.col("source")
    f = facts.where("kind = 'sourced'")
    link = F.coalesce(s["permalink"], F.lit(""))
    filing, chunk = F.coalesce(s["filing_uuid"], F.lit("")), F.coalesce(s["chunk_id"], F.lit(""))
    return [
        where(f, s.isNull(), "sourced fact without source", "fact_id"),
        where(f, s.isNotNull() & ~filing.rlike(UUID), "filing is not a UUID", "fact_id"),
        where(f, s.isNotNull() & ~chunk.rlike(UUID), "chunk is not a UUID", "fact_id"),
        where(f, s.isNotNull() & ~link.rlike(permalink), "not a passage permalink", "fact_id"),
        where(
            f,
            link.rlike(permalink) & (
                (F.regexp_extract(link, permalink, 1) != filing) | (F.regexp_extract(link, permalink, 2) != chunk)
            ),
            "permalink of another passage",
            "fact_id",
        ),
        where(
            f,
            s.isNotNull() & blank(s["exchange_document_id"]) & blank(s["document_id_absent_reason"]),
            "document id or the reason for its absence",
            "fact_id",
        ),
        where(f, s.isNotNull() & blank(s["quote"]), "quote missing", "fact_id"),
    ]


def validate_questions(
    questions: DataFrame,
    facts: DataFrame,
    strata: dict[str, int],
    permalink: str,
    min_tagged: int = 0,
    tag: str = "non_us",
    reach: tuple[int, int] = (20, 40),
) -> DataFrame:
    """All violations of a question set: numbers per stratum, unique ids, rules of each kind of fact, closed
    dependencies, and the number of distinct filings of `reach` questions."""
    spark = questions.sparkSession
    control = F.col("stratum") == "control"
    rules = [
        unique(questions, "id", "duplicate question id"),
        counts(questions, "stratum", strata, "questions of a stratum"),
        where(questions, blank(F.col("question")), "empty question", "id"),
        where(questions, F.coalesce(F.size("facts"), F.lit(0)) <= 0, "no facts", "id"),
        where(
            facts,
            ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)),
            "unknown kind of fact",
            "fact_id",
            F.col("kind"),
        ),
        where(facts, blank(F.col("statement")) | F.col("value").isNull(), "statement and value required", "fact_id"),
        where(facts, (F.col("kind") == "control") & ~control, "control fact outside the controls", "fact_id"),
        where(facts, (F.col("kind") != "control") & control, "other fact among the controls", "fact_id"),
        where(
            facts,
            (F.col("kind") == "absence") & ~F.coalesce(F.col("source.filing_uuid"), F.lit("")).rlike(UUID),
            "absence without a filing",
            "fact_id",
        ),
        where(
            facts, (F.col("kind") == "absence") & blank(F.col("absence_reason")), "absence without a reason", "fact_id"
        ),
        where(
            facts,
            (F.col("kind") == "absence") & (F.coalesce(F.size("absent_terms"), F.lit(0)) <= 0),
            "absence without terms",
            "fact_id",
        ),
        where(
            facts,
            (F.col("kind") == "computed") & (
                blank(F.col("formula")) | (F.coalesce(F.size("computed_from"), F.lit(0)) <= 0)
            ),
            "computed without formula or parts",
            "fact_id",
        ),
        *source_rules(facts, permalink),
    ]
    twice = facts.groupBy("question_id", "fact_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rules.append(violation(twice, "duplicate fact id", F.col("fact_id"), F.col("n")))
    parts = facts.select("question_id", "fact_id", F.explode("computed_from").alias("part"))
    rules.append(
        violation(
            parts.join(
                facts.select("question_id", F.col("fact_id").alias("part")).distinct(),
                ["question_id", "part"],
                "left_anti",
            ),
            "computed from an unknown fact",
            F.col("fact_id"),
            F.col("part"),
        )
    )
    filings = facts.where("stratum = 'reach'").groupBy("question_id").agg(
        F.count_distinct(F.when(F.col("source.filing_uuid").rlike(UUID), F.col("source.filing_uuid"))).alias("n")
    ).where((F.col("n") < reach[0]) | (F.col("n") > reach[1]))
    rules.append(violation(filings, "filings of a reach question", F.col("question_id"), F.col("n")))
    if min_tagged:
        have = questions.agg(
            F.count_if(F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), tag)).alias("n")
        ).where(F.col("n") < min_tagged)
        rules.append(violation(have, f"questions tagged {tag}", F.lit("set"), F.col("n")))
    del spark
    return union(rules)


def validate_contamination(
    questions: DataFrame, facts: DataFrame, roles: dict[str, int], sample: DataFrame, checks: DataFrame
) -> DataFrame:
    """The set with traps: numbers per role, traps bound to contradicted check rows of the same category and value,
    and contradicting facts in the same question."""
    traps = facts.where("kind = 'trap'")
    rows = sample.join(checks.select("row_id", "bin"), "row_id", "left")
    met = traps.join(
        rows.select(F.col("row_id").alias("crosscheck_row"), "bin", "category", F.col("value").alias("told")),
        "crosscheck_row",
        "left",
    )
    targets = facts.select("question_id", F.col("fact_id").alias("contradicts"), F.lit(True).alias("is_there"))
    return union([
        counts(questions, "role", roles, "questions of a role"),
        unique(questions, "id", "duplicate question id"),
        where(met, F.col("bin").isNull(), "trap without a check row", "fact_id", F.col("crosscheck_row")),
        where(met, F.col("bin") != "contradicted", "trap of a row that is not contradicted", "fact_id", F.col("bin")),
        where(
            met, F.col("category") != F.col("source_category"), "trap of another category", "fact_id", F.col("category")
        ),
        where(
            met.withColumns({"a": bare_value("value"), "b": bare_value("told")}),
            F.col("a") != F.col("b"),
            "trap of another value",
            "fact_id",
            F.col("told"),
        ),
        where(
            traps.join(targets, ["question_id", "contradicts"], "left"),
            F.col("is_there").isNull(),
            "trap that contradicts no fact",
            "fact_id",
            F.col("contradicts"),
        ),
    ])


def verify_quotes(facts: DataFrame, passages: DataFrame) -> DataFrame:
    """Facts whose quote does not stand in their passage, or whose ids differ (passages: chunk_id, text, filing_uuid,
    permalink, exchange_document_id)."""
    s = F.col("source")
    p = passages.select(
        F.col("chunk_id").alias("_chunk"),
        F.col("text").alias("_text"),
        F.col("filing_uuid").alias("_filing"),
        F.col("permalink").alias("_link"),
        F.col("exchange_document_id").alias("_doc"),
    )
    f = facts.where("kind = 'sourced'").withColumn("_chunk", s["chunk_id"]).join(p, "_chunk", "left")
    return union([
        where(f, F.col("_text").isNull(), "passage unknown", "fact_id", F.col("_chunk")),
        where(
            f, ~F.contains(quote_form(F.col("_text")), quote_form(s["quote"])), "quote not in the passage", "fact_id"
        ),
        where(f, F.col("_filing") != s["filing_uuid"], "passage of another filing", "fact_id"),
        where(f, F.col("_link") != s["permalink"], "another permalink", "fact_id"),
        where(f, F.col("_doc") != s["exchange_document_id"], "another document id", "fact_id"),
    ])


def needed_passages(facts: DataFrame, corrections: DataFrame, cached: DataFrame) -> DataFrame:
    """Distinct passages that facts and corrections quote and the cache lacks."""
    a = facts.select(F.col("source.chunk_id").alias("chunk_id"))
    b = corrections.select(F.explode("also_stated.chunk_id").alias("chunk_id")).unionByName(
        corrections.select(F.col("fields.source.chunk_id").alias("chunk_id"))
    )
    return a.unionByName(b).where("chunk_id IS NOT NULL").distinct().join(
        cached.select("chunk_id"), "chunk_id", "left_anti"
    )


CORRECTABLE = ("statement", "value", "unit", "accept", "source")


def apply_corrections(facts: DataFrame, corrections: DataFrame) -> DataFrame:
    """Facts with the fields that a correction names replaced; all or nothing: any bad correction stops it.

    Bad: a fact that does not exist, two corrections for one fact, a correction that changes nothing.
    """
    key = ["question_id", "fact_id"]
    changed = F.greatest(*[F.col(f"fields.{c}").isNotNull().cast("int") for c in CORRECTABLE])
    bad = union([
        violation(
            corrections.join(facts.select(*key), key, "left_anti"),
            "correction of an unknown fact",
            F.col("fact_id"),
            F.col("question_id"),
        ),
        violation(
            corrections.groupBy(*key).count().where("count > 1"),
            "two corrections of a fact",
            F.col("fact_id"),
            F.col("count"),
        ),
        where(corrections, changed == 0, "correction without a field", "fact_id"),
    ]).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].rule}: {bad[0].subject}")
    over = corrections.select(*key, F.col("fields").alias("_c"))
    return facts.join(over, key, "left").withColumns({c: F.coalesce(f"_c.{c}", c) for c in CORRECTABLE}).drop("_c")


def stale_passes(
    facts: DataFrame, corrections: DataFrame, runs: DataFrame, judgements: DataFrame, name: str, digest: str
) -> DataFrame:
    """Completed runs on corrected questions whose stored pass was made under another set of corrections."""
    touched = corrections.select("question_id").distinct()
    stored = judgements.select(
        "run_id", F.try_element_at("passes", F.lit(name)).alias("p"), F.col("corrections_digest")
    ).where("p IS NOT NULL AND p.error IS NULL")
    return runs.where("status = 'completed'").join(touched, "question_id", "left_semi").join(stored, "run_id").where(
        F.coalesce("corrections_digest", F.lit("")) != digest
    )


def evidence(facts: DataFrame, passages: DataFrame) -> DataFrame:
    """question_id, fact_id, text: what backs a fact. Computed facts take the evidence of their parts."""
    own = facts.join(
        passages.select(F.col("chunk_id").alias("_c"), F.col("text").alias("_t")),
        F.col("source.chunk_id") == F.col("_c"),
        "left",
    )
    kind = F.col("kind")
    text = F.when(kind == "sourced", F.concat_ws("\n", F.col("source.quote"), F.col("_t"))).when(
        kind == "absence", F.concat_ws("\n", F.col("absence_reason"), F.array_join("absent_terms", "; "))
    )
    own = own.select("question_id", "fact_id", "kind", "computed_from", "formula", text.alias("text"))
    parts = own.where("kind = 'computed'").select("question_id", "fact_id", "formula", F.posexplode("computed_from").alias("at", "part")).join(
        own.select("question_id", F.col("fact_id").alias("part"), F.col("text").alias("part_text")),
        ["question_id", "part"],
        "left",
    )
    whole = parts.groupBy("question_id", "fact_id").agg(
        F.concat_ws(
            "\n",
            F.first("formula"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("at", "part_text"))), lambda x: x["part_text"]), "\n"
            ),
        ).alias("text")
    )
    return own.where("kind <> 'computed'").select("question_id", "fact_id", "text").unionByName(whole)


def reading_problems(r: Column) -> Column:
    """Why a plan reading is not complete: types and finiteness of its windows."""
    def bad(name: str) -> Column:
        used = r[name]["used_percent"]
        return F.when(r[name].isNull(), F.lit(f"no {name} window")).when(
            used.isNull() | F.isnan(used) | (F.abs(used) == float("inf")), F.lit(f"{name}: used percent is no number")
        ).when(r[name]["resets_at"].isNull(), F.lit(f"{name}: no reset time"))

    return F.array_compact(
        F.array(
            bad("primary"),
            bad("secondary"),
            F.when(r["credits"].isNotNull() & r["credits"]["has_credits"].isNull(), F.lit("credits without a flag")),
        )
    )


def parse_replies(
    replies: DataFrame,
    schema: str,
    labels: Column,
    label: str = "id",
    raw: str = "reply",
    items: str = "items",
    enums: dict[str, tuple] | None = None,
) -> DataFrame:
    """Model replies (JSON, fenced or not) under a closed contract: `error` null and `items` if all of it holds, else neither.

    Every label exactly once, no others; enumerated fields hold known values. `schema` is the type of an item.
    """
    bare = F.trim(F.regexp_replace(F.trim(raw), r"^`+[a-z]*\s*|\s*`+$", ""))
    out = replies.withColumn(
        "_r", F.from_json(bare, f"{items} array<{schema}>", {"mode": "PERMISSIVE"})
    ).withColumn("_i", F.col(f"_r.{items}"))
    ids = F.array_sort(F.transform("_i", lambda x: x[label]))
    bad_enum = F.lit(False)
    for field, known in (enums or {}).items():
        bad_enum = bad_enum | F.coalesce(F.exists("_i", _outside(field, known)), F.lit(False))
    error = F.when(F.col("_i").isNull(), "no list of items").when(F.size(F.array_distinct(ids)) != F.size(ids), "an item twice").when(
        ~F.coalesce(ids == F.array_sort(labels), F.lit(False)), "items differ from what was asked"
    ).when(bad_enum, "a value that is not listed")
    return out.withColumn("error", error).withColumn(
        items, F.when(F.col("error").isNull(), F.col("_i"))
    ).drop("_r", "_i")


def _outside(field: str, known: tuple):
    return lambda x: ~F.coalesce(x[field].isin(*known), F.lit(False))


def same_inputs(stored: str, now: str) -> str | None:
    """Why an analysis is not of the present inputs; None if it is."""
    return None if stored == now else f"inputs changed since the analysis: {stored[:12]} then, {now[:12]} now"


def audit_rule(rows: DataFrame, primary: str) -> DataFrame:
    """Audit rows made under another rule than the one asked for."""
    return violation(
        rows.where(F.coalesce("rule", F.lit("combined")) != primary),
        "audit of another rule",
        F.col("run_id"),
        F.col("rule"),
    )


def filled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Shards that hold human input, which no export may replace: path and filled cells."""
    marks = sum(
        (F.when(~blank(F.col(c)), 1).otherwise(0) for c in columns[1:]),
        F.when(~blank(F.col(columns[0])), 1).otherwise(0),
    )
    return rows.groupBy("_path").agg(F.sum(marks).alias("filled")).where("filled > 0")


def prompt(template: str, **parts: Column) -> Column:
    """Prompt text from named columns: `{name}` in the template."""
    out, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [F.lit(head), parts[name].cast("string")]
    return F.concat(*out, F.lit(rest))
