"""Training-corpus pipeline over ``documents``: toxicity, quality rules, near-duplicates, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns what the next one reads. All but the last return the columns of
``documents``. A stage's result is written as Parquet and read again before the next stage starts.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import bin_packing, mixing, near_dedup, quality, toxicity
from textlake.llm.common import prepare, table, write_table
from textlake.llm.records import default_tokenizer
from textlake.session import drop_tables, noting_tables

#: tables that the stages wrote for themselves and that may go once a stage's result has been written
_spent: list[str] = []


def stage(work):
    """A stage that first deletes the tables earlier stages wrote for themselves: what it is given has been written and read
    again, so nothing needs them any more. Tables that ``docs`` still reads stay."""
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _spent[:] = drop_tables(spark, _spent, keep=docs)
        with noting_tables() as written:
            out = work(spark, docs, sf_dir)
        _spent.extend(written)
        return out

    return run_stage


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5. The score is a function of the text, so it is computed beside the row."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    net = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score_rows(docs, net).where("score < 0.5").select(*COLUMNS)


@stage
def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    return quality.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


@stage
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8 or more): that with the smallest id.

    Rows are told apart by a written row number, so repeated ids and null ids (last in a group) are rows like others.
    """
    docs = write_table(docs.select(F.monotonically_increasing_id().alias("_row"), *COLUMNS), "numbered")
    groups = near_dedup.near_duplicates(docs.select(F.col("_row").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "_row"))
    kept = groups.join(docs.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first.alias("first"))
    return docs.join(kept.select("first._row"), "_row", "left_semi").select(*COLUMNS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = mixing.mix(docs.select(*COLUMNS), carry=COLUMNS)
    return mixing.materialise(mixed).select(*COLUMNS)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 4,096 tokens."""
    return bin_packing.pack_documents(docs.select("doc_id", "text"), default_tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", apply_quality_rules), ("near_dedup", keep_one_of_each),
          ("mixing", mix_sources), ("packing", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = write_table(work(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
