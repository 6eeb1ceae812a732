"""Corpus pipeline: quality, line dedup, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.

Nulls, empty and repeated rows: a null or empty text is rejected by the first stage; a null doc_id is an id
like others, but its rows are linked with no near-duplicates; rows with one doc_id stay or go together;
an empty table gives an empty result; columns that documents lack are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hertzlake.llm import linededup, minhash, packing, pii, quality
from hertzlake.llm.common import Scratch, if_small
from hertzlake.llm.queries import WORD_BPE, _tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, where they are scored."""
    return quality.good_documents(docs.select(*COLUMNS))


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go from each; documents stay, also those left empty."""
    return _counted(linededup.dedup_documents(docs.select(*COLUMNS)))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays; the ids of the others meet the texts."""
    others = minhash.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(if_small(Scratch(spark).stored(others, "near-duplicates")), "doc_id", "left_anti").select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by marks of their kind."""
    return _counted(pii.redacted_documents(docs.select(*COLUMNS)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences."""
    return packing.pack(docs, _tokenizer(WORD_BPE))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_common_lines),
    ("minhash near-dedup", one_of_near_duplicates),
    ("pii", without_personal_data),
    ("best-fit packing", packed),
]

#: The classifier and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = scratch.stored(docs, name.replace(" ", "-"))
            scratch.clear(docs)
    return docs
