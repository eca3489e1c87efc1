"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage works on all rows that the one before kept. All but the last return the columns of documents, further columns too, whatever their names.
A null text counts as empty everywhere; null and repeated identifiers are rows like others, told apart by their texts; an empty table goes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import exact_dedup, packing, quality, secrets, similar
from factloom.llm.chunks import tokenizer_path
from factloom.llm.common import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from the labelled rows among them outside the held-out fold.

    Empty and null texts have a score like others. Without labelled rows every document has the score 0.5 and stays.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, null last; of rows that repeat identifier and text, one. Empty and null texts are equal."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, the row with the smallest doc_id stays, null last.

    Texts without words are near each other; ties between rows of one identifier go by the text's digest.
    """
    return similar.drop_similar(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Covers secrets in texts; n_chars follows. All rows stay, null texts as they are."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, one a sequence. An empty or null text is the end id alone; repeated rows are packed each time."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("secrets", secrets_stage), ("packing", packing_stage)]
#: SQL can't express the classifier's fit or the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
