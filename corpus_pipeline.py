"""A training-data pipeline: language, toxicity, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of documents; the last returns one row per token sequence. Stages hold no state besides their input, so a stage
can be run again from the Parquet that the one before it left.

What goes: texts that are null or have no letter (language; the network's choice among languages removes nothing), texts
scored toxic (toxicity), all but one row of each group of near duplicates (the one with the smallest doc_id stays), texts
that hold a benchmark item.

Cases: null and empty texts go in the first stage; a null doc_id counts as greater than any other and is otherwise a row
like all; rows that share a doc_id are told apart; texts of any length are read whole; an empty table passes through all
stages; columns of any name are kept as they are, whatever a stage calls its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import new_folder, remainder, stash
from tallyspark.llm.decontam import without_items
from tallyspark.llm.jaccard import near_duplicates
from tallyspark.llm.langid import fit_language, identify
from tallyspark.llm.packing import pack
from tallyspark.llm.toxicity import fit_toxicity, score_toxicity


def _apart(docs: DataFrame) -> DataFrame:
    """The whole row as one column, and the text beside it, so that no column name meets another."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a letter stay. Only `und` is rejected: no prediction or score removes a text in any language."""
    learn = docs.select("doc_id", "text", "lang", (~remainder("doc_id", 5, 0)).alias("learn"))
    model, classes = fit_language(learn, "learn")
    if not classes:  # no language to learn: all texts would be `und`
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return identify(_apart(docs), model, classes).where("lang_pred <> 'und'").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are not scored toxic stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~remainder("doc_id", 5, 0))
    model = fit_toxicity(docs, labels)
    return score_toxicity(_apart(docs), model).where("predicted = 0").select("row.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the smallest doc_id, and of rows that share it the first.

    Rows go by their place in the input, written once with them, so that rows that share a doc_id, or have none, are rows
    of their own.
    """
    place = F.monotonically_increasing_id().alias("place")
    rows = stash(docs.select(F.struct(*docs.columns).alias("row"), place), "places").select(
        "row", "row.text", "row.doc_id", "place"
    )
    groups = near_duplicates(rows.select("place", "text"), id_col="place").select(
        F.col("doc_id").alias("place"), "component_id"
    )
    by_id = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")
    first = rows.select("place", "doc_id").join(groups, "place").groupBy("component_id").agg(
        F.min(by_id).alias("best")
    ).select("best.place")
    return rows.join(first, "place", "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a benchmark item stay."""
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in length buckets and token-budget batches."""
    return pack(docs)


STAGES = [
    ("language ID", language),
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicate),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Two stages learn models and one finds components: SQL can't express them; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{k}")
    return docs
