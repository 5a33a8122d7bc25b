"""A training-data pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's docs. All but the last return the columns of documents;
a column of docs that is named as an operator's result (such as kept) holds that result.
Rows are judged by their text, so rows with equal or null ids are judged apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontamination, line_dedup, mixing, quality, simhash
from gleaner.llm.common import discard, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null or empty text has fewer than 50 words and goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trusted = quality.trusted_sample(docs, labels, "doc_id", quality.TRUSTED)
    return quality.judge(docs, trusted).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; one that loses all its words goes.

    n_chars follows the text. Null and blank texts lose nothing and stay.
    """
    out = line_dedup.dedup_lines(docs, line_words=line_dedup.LONG_LINE).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x00-\x20]"))
    return out.withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest doc_id (null is the largest), or of equal ids any one row.

    All texts without words, null ones among them, are one group.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with the benchmark's items; a null text has no words and stays."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontamination.decontaminate(docs, items)
    return out.where(~F.col("contaminated")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in the mix of sources; a null source is a source of its own."""
    return mixing.mix(docs.select("doc_id", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mixture),
]

#: Log-likelihood ratios and SimHash are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = []
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        discard(*written)  # what the stage before left has been read for the last time
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
