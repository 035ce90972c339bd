"""A training corpus from raw documents: each stage reads what the one before it wrote.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, further ones too,
whatever they are called. An empty table gives an empty one, and null ids, languages, sources and sizes are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meetlake.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from meetlake.llm.common import shared_dir, table
from meetlake.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; repeated rows are judged alike, and a null or empty text is no evidence and stays (unless nearly all labels are toxic)."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; null is an empty text, a null id stays only among null ids, and of rows that repeat id and text one stays."""
    return exact_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity of at least 0.8 by word shingles), the document with the smallest id; texts without words are like no other and stay."""
    return near_dedup.keep(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one without words is taken no time, and a null source is a source, the last. Repeated rows share their copies."""
    return mixing.draw(docs, mixing.label_weights(table(spark, sf_dir, "labels")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null or empty text is the end token alone, and repeated rows and null ids are packed each."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Scores and hashes of the stages have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
