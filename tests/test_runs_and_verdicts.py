"""Run states, costs, verdicts, samples and validators."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyspark.operators import runs, sampling, shards, validation, verdicts


def test_resume_plan(spark):
    records = [
        ("a", "completed", 1),
        ("b", "infra_error", 1),
        ("b", "infra_error", 2),
        ("c", "infra_error", 1),
        ("c", "infra_error", 2),
        ("c", "infra_error", 3),
        ("d", "invalid", 1),
        ("e", "invalid", 1),
        ("e", "invalid", 2),
    ]
    rec = spark.createDataFrame(records, "run_key string, status string, attempt int")
    specs = spark.createDataFrame([(k,) for k in "abcdef"], "run_key string")
    plain = {r.run_key: (r.state, r.start_attempt) for r in runs.resume_plan(specs, rec).collect()}
    assert plain == {
        "a": ("done", None),
        "b": ("pending", 3),
        "c": ("excluded", None),
        "d": ("done", None),
        "e": ("excluded", None),
        "f": ("pending", 1),
    }
    again = {
        r.run_key: (
            r.state, r.start_attempt, r.attempts_left, r.rerun
        ) for r in runs.resume_plan(specs, rec, True).collect()
    }
    assert again["d"] == ("pending", 2, 3, True) and again["f"] == ("pending", 1, 3, False)


def test_latest_records(spark):
    a = spark.createDataFrame([("1", "old"), ("2", "old")], "run_id string, v string")
    b = spark.createDataFrame([("2", "new"), ("3", "new")], "run_id string, v string")
    assert {r.run_id: r.v for r in runs.latest_records(a, b).collect()} == {"1": "old", "2": "new", "3": "new"}


def test_cost(spark):
    price = F.struct(
        F.lit(2.0).alias("input"),
        F.lit(0.1).alias("cached_input"),
        F.lit(2.5).alias("cache_write"),
        F.lit(10.0).alias("output"),
        F.lit(272_000).alias("long_context_threshold"),
        F.lit(2.0).alias("long_context_multiplier"),
    )
    one = lambda i, c, w, o: spark.range(1).select(
        runs.call_cost(F.lit(i), F.lit(c), F.lit(w), F.lit(o), price).alias("x")
    ).first().x
    assert one(200_000, 100_000, 0, 10_000) == pytest.approx(0.2 + 0.01 + 0.1)
    assert one(300_000, 0, 0, 0) == pytest.approx(1.2)


def test_price_prefix(spark):
    prices = spark.createDataFrame([("m-1", 0, 1.0), ("m", 1, 2.0)], "name string, ord int, input double")
    models = spark.createDataFrame([("m-1",), ("m-1-x",), ("m-2",), ("z",)], "model string")
    assert {
        r.model: r.input for r in runs.price_of(models, prices).collect()
    } == {"m-1": 1.0, "m-1-x": 1.0, "m-2": 2.0, "z": None}


def test_merge_passes(spark):
    a, b = {"F1": "correct", "F2": "correct"}, {"F1": "correct", "F2": "missing"}
    rows = spark.createDataFrame(
        [(a, b, True, False), (None, b, None, True)], "a map<string,string>, b map<string,string>, x boolean, y boolean"
    )
    got = [
        r.m for r in rows.select(
            verdicts.merge_passes(F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("m")
        ).collect()
    ]
    assert got[0].fact_scores == {"F1": 1.0, "F2": 0.5} and got[0].accuracy == 0.75 and got[0].complete == 0.5 and got[0].disputed == ["F2"]
    assert got[1].rule == "B" and got[1].accuracy == 0.5 and got[1].complete == 1.0


def test_valid_pass(spark):
    kind = "p struct<fact_verdicts:map<string,string>,complete:boolean,error:string>"
    rows = spark.createDataFrame(
        [
            (({"F": "correct"}, True, None),),
            (({"F": "odd"}, True, None),),
            (({"F": "correct"}, None, None),),
            (({"F": "correct"}, True, "x"),),
        ],
        kind,
    )
    assert [
        r.v is not None for r in rows.select(verdicts.valid_pass(F.col("p")).alias("v")).collect()
    ] == [True, False, False, False]


def test_audit_precedence(spark):
    rows = spark.createDataFrame(
        [("r", "f", "key_correction", "correct"), ("r", "f", "owner", "missing")],
        "run_id string, fact_id string, source string, verdict string",
    )
    assert {
        r.source: r.superseded for r in verdicts.audit_precedence(rows).collect()
    } == {"owner": False, "key_correction": True}
    clash = rows.unionByName(spark.createDataFrame([("r", "f", "owner", "correct")], rows.schema))
    with pytest.raises(ValueError):
        verdicts.audit_precedence(clash)


def test_hash_first_takes_the_least(spark):
    rows = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    every = sorted(r.h for r in rows.collect())
    for n in (0, 1, 17, 700, 3000):
        assert sorted(r.h for r in verdicts.hash_first(rows, "h", n).collect()) == every[:n]


def test_allocate():
    sizes = {("a",): 500, ("b",): 300, ("c",): 5, ("d",): 50, ("e",): 12}
    got = sampling.allocate(sizes, 400, 10)
    assert sum(got.values()) == 400 and got["c",] == 5 and got["e",] == 10 and all(got[k] <= sizes[k] for k in got)
    assert sampling.allocate({"x": 100, "y": 100}, 50, 10) == {"x": 25, "y": 25}
    assert sampling.allocate({"x": 3}, 50, 10) == {"x": 3}


@pytest.mark.parametrize("parity", [False, True])
def test_stratified_sample_ignores_row_order(spark, parity):
    rows = spark.createDataFrame(
        [(f"C{i:03d}", "a" if i % 3 else "b", "s") for i in range(200)],
        "claim_id string, category string, stratum string",
    )
    take = lambda d: [
        (r.row_id, r.claim_id) for r in sampling.stratified_sample(
            d, ["category", "stratum"], "claim_id", 60, parity=parity
        ).orderBy("row_id").collect()
    ]
    got = take(rows)
    assert len(got) == 60 and got[0][0] == "X001" and got == take(rows.orderBy(F.col("claim_id").desc()))


def folded(sizes, limit):
    """Shards by a plain fold; the first counter tells whether one has begun."""
    out, shard, used = [], 0, [0] * len(sizes[0])
    for row in sizes:
        if used[0] > 0 and any(u + x > limit for u, x in zip(used, row, strict=True)):
            shard, used = shard + 1, [0] * len(row)
        used = [u + x for u, x in zip(used, row, strict=True)]
        out.append(shard)
    return out


@pytest.mark.parametrize("block", [100_000, 7, 1])
def test_greedy_shards(spark, monkeypatch, block):
    rng = random.Random(block)
    monkeypatch.setattr(shards, "BLOCK_ROWS", block)
    cases = {
        "a": ([400, 300, 400, 1500, 10], 1000),
        "b": ([0, 0, 2000, 0, 5, 996], 1000),
        "c": ([rng.choice([0, 1, 5, 400, 900, 1200]) for _ in range(90)], 1000),
        None: ([3, 998], 1000),
    }
    rows = [(g, i, x) for g, (sizes, _) in cases.items() for i, x in enumerate(sizes)]
    got = shards.greedy_shards(
        spark.createDataFrame(rows, "g string, i int, x int"), ["g"], ["i"], ["x"], 1000
    ).collect()
    for g, (sizes, limit) in cases.items():
        assert [
            r.shard for r in sorted((r for r in got if r.g == g), key=lambda r: r.i)
        ] == folded([[x] for x in sizes], limit), g
    two = [(i, rng.choice([0, 10, 300]), rng.choice([0, 20, 600])) for i in range(120)]
    got = shards.greedy_shards(
        spark.createDataFrame(two, "i int, x int, y int"), [], ["i"], ["x", "y"], 1000
    ).orderBy("i").collect()
    assert [r.shard for r in got] == folded([r[1:] for r in two], 1000)


def test_batches(spark):
    got = sampling.batches(spark.range(7).select(F.lit("g").alias("g"), "id"), "g", "id", 3, "h-").collect()
    assert sorted(len(r["items"]) for r in got) == [1, 3, 3] and all(len(r.batch) == 14 for r in got)


def test_text_pool(spark):
    rows = spark.createDataFrame(
        [
            ("r2", 0, "q2", ["C2"], "forum", "h", "shown", "s", "Same  TEXT"),
            ("r1", 0, "q1", ["C1"], "forum", "h", "shown", "t", "same text"),
        ],
        "run_id string, ord int, question_id string, companies array<string>, category string, host string, kind string, stratum string, text string",
    )
    got = sampling.text_pool(rows).first()
    assert got.stratum == "t" and got.run_ids == ["r1", "r2"] and got.companies == ["C1", "C2"]


def test_dedupe_claims(spark):
    rows = spark.createDataFrame(
        [("T2", 0, "ACME", "Sales", "1 000", "2024"), ("T1", 1, "acme", "sales", "1000", "2024")],
        "text_id string, claim_ord int, company string, metric string, value string, period string",
    )
    got = sampling.dedupe_claims(rows).collect()
    assert len(got) == 1 and got[0].text_id == "T1" and got[0].occurrences == 2


UUID_A, UUID_B = "0" * 8 + "-0000-0000-0000-" + "a" * 12, "0" * 8 + "-0000-0000-0000-" + "b" * 12
LINK = r"^https://p\.example/([^/]+)/([^/]+)$"


def questions(spark, **change):
    fact = {
        "id": "F1",
        "kind": "sourced",
        "statement": "s",
        "value": "1",
        "filing": UUID_A,
        "chunk": UUID_B,
        "link": f"https://p.example/{UUID_A}/{UUID_B}",
        "quote": "q",
        "parts": None,
    } | change
    source = Row(
        filing_uuid=fact["filing"],
        chunk_id=fact["chunk"],
        permalink=fact["link"],
        exchange_document_id="x",
        document_id_absent_reason=None,
        quote=fact["quote"],
        symbol="S",
    )
    from tallyspark.sources.readers import FACT, facts

    made = spark.createDataFrame(
        [
            (
                "Q1",
                "lookup",
                "what?",
                [],
                [
                    (
                        fact["id"],
                        fact["kind"],
                        fact["statement"],
                        fact["value"],
                        "",
                        [],
                        tuple(source),
                        [],
                        None,
                        "f",
                        fact["parts"],
                        None,
                        None,
                        None,
                    )
                ],
            )
        ],
        f"id string, stratum string, question string, tags array<string>, facts array<{FACT}>",
    )
    return made, facts(made)


@pytest.mark.parametrize(
    "change, rule",
    [
        ({}, None),
        ({"quote": " "}, "quote missing"),
        ({"filing": "x"}, "filing is not a UUID"),
        ({"link": "y"}, "not a passage permalink"),
        ({"link": f"https://p.example/{UUID_B}/{UUID_B}"}, "permalink of another passage"),
        ({"kind": "odd"}, "unknown kind of fact"),
        ({"kind": "computed", "parts": ["F9"]}, "computed from an unknown fact"),
        ({"kind": "control"}, "control fact outside the controls"),
        ({"statement": ""}, "statement and value required"),
    ],
)
def test_question_rules(spark, change, rule):
    q, f = questions(spark, **change)
    found = {r.rule for r in validation.validate_questions(q, f, {"lookup": 1}, LINK).collect()}
    assert (rule in found) if rule else not found


def test_quotes(spark):
    _, f = questions(spark, quote="Net  “Sales” |")
    passages = spark.createDataFrame(
        [(UUID_B, 'the net "sales" were', UUID_A, f"https://p.example/{UUID_A}/{UUID_B}", "x")],
        "chunk_id string, text string, filing_uuid string, permalink string, exchange_document_id string",
    )
    assert validation.verify_quotes(f, passages).count() == 0
    assert {
        r.rule for r in validation.verify_quotes(f, passages.withColumn("text", F.lit("other"))).collect()
    } == {"quote not in the passage"}


def test_corrections(spark):
    _, f = questions(spark)
    kind = "question_id string, fact_id string, fields struct<statement:string,value:string,unit:string,accept:array<string>,source:struct<filing_uuid:string,chunk_id:string,permalink:string,exchange_document_id:string,document_id_absent_reason:string,quote:string,symbol:string>>"
    fix = spark.createDataFrame([("Q1", "F1", (None, "2", None, None, None))], kind)
    r = validation.apply_corrections(f, fix).first()
    assert r.value == "2" and r.statement == "s"
    for bad in ([("Q1", "F2", (None, "2", None, None, None))], [("Q1", "F1", (None, None, None, None, None))]):
        with pytest.raises(ValueError):
            validation.apply_corrections(f, spark.createDataFrame(bad, kind))


def test_replies(spark):
    rows = spark.createDataFrame(
        [
            ('```json\n{"items": [{"id": "a", "v": "x"}]}\n```',),
            ('{"items": [{"id": "b", "v": "x"}]}',),
            ("nope",),
            ('{"items": [{"id": "a", "v": "z"}]}',),
        ],
        "reply string",
    )
    got = validation.parse_replies(
        rows, "struct<id:string,v:string>", F.array(F.lit("a")), enums={"v": ("x", "y")}
    ).collect()
    assert [r.error for r in got] == [
        None, "items differ from what was asked", "no list of items", "a value that is not listed"
    ]
