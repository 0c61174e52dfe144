"""The corpus pipeline: toxic documents go, repeated lines go, near-duplicates go, benchmark text goes, sources are mixed.

Stages read the columns of documents and return them, and leave others out, whatever their names. Rows with null ids or texts stay
unless a stage's rule takes them; repeated rows are taken or kept alike; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partledger.llm.common import WORD, n_words, small, table, written
from partledger.llm.decontam import scan_for_items
from partledger.llm.linededup import dedup_lines
from partledger.llm.minhash import near_duplicates
from partledger.llm.mixing import mix_sources, typical_word_weight
from partledger.llm.toxicity import held_out, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    return score_toxicity(docs, table(spark, sf_dir, "labels").filter(~held_out()), keep=COLUMNS).filter("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand elsewhere go; so do documents that had words and have none left. n_chars follows the text."""
    cleaned = dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_exact") + F.col("n_near") > 0) & ~F.col("text").rlike(WORD)
    length = F.when(F.col("n_exact") + F.col("n_near") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", length).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest doc_id."""
    going = written(near_duplicates(docs).filter("not kept and doc_id is not null").select("doc_id").distinct(), "going")
    return docs.join(small(going), "doc_id", "left_anti").select(*COLUMNS)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return scan_for_items(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).filter("not contaminated").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes and how many of their words, repeats counted."""
    return mix_sources(docs, n_words(F.col("text")), F.coalesce(typical_word_weight(F.col("text")), F.lit(0.5))).filter("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_text),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


#: SQL expresses neither the nearest examples nor the signatures; tests hold the stages against brute force.
ORACLE_SQL = None
