"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and gives the next one its documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precinct.blocks.shared import materialize
from precinct.llm.common import table
from precinct.llm.decontaminate import remove_contaminated
from precinct.llm.lines import dedup_lines
from precinct.llm.ngrams import keep_one_of_each
from precinct.llm.packing import pack
from precinct.llm.toxicity import drop_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that had words and has none left goes too. n_chars follows the text."""
    kept = dedup_lines(docs, "__removed").filter("__removed is null or text rlike '\\\\S'").drop("__removed")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a passage of the benchmark occurs go."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and slot."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Toxicity is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return reduce(lambda d, stage: materialize(stage[1](spark, d, sf_dir), stage[0]), STAGES, docs)
