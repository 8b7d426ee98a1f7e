"""The functions under SQL names, and run data as temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.functions import numbers, secrets, text
from tallyspark.sources import readers

FUNCTIONS = {
    "fold": text.fold,
    "json_strings": text.json_strings,
    "scrub_free_text": secrets.scrub_free_text,
    "mask_secrets": secrets.mask_secrets,
    "secret_paths": secrets.secret_paths,
}


def register(spark: SparkSession) -> None:
    """All functions, and the table function `secret_findings(text, policy)`."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    for name, (parameters, body) in numbers.SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body}")
    spark.udtf.register("secret_findings", secrets.SecretFindings)


def views(
    spark: SparkSession,
    records: str | None = None,
    questions: str | None = None,
    judgements: str | None = None,
    logs: str | None = None,
) -> dict[str, DataFrame]:
    """Views `runs`, `questions`, `facts`, `judgements`, `passes` and `log_lines` over whichever paths are given."""
    out: dict[str, DataFrame] = {}
    if records:
        out["runs"] = readers.run_records(spark, records)
    if questions:
        out["questions"] = readers.question_set(spark, questions)
        out["facts"] = readers.facts(out["questions"])
    if judgements:
        out["judgements"] = readers.judgements(spark, judgements)
        out["passes"] = readers.judgement_passes(out["judgements"])
    if logs:
        out["log_lines"] = readers.json_lines(spark, logs)
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out
