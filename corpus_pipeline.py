"""A corpus pipeline: language ID, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's documents.  All but the last return the columns of
``documents``.  Every stage takes null, empty and very long texts, null and repeated
doc_ids, an empty table and further columns of any name; what it does with them is said at
the operator that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm._shared import materialize
from vellum.llm._tokens import vocabulary
from vellum.llm.language import keep_identified
from vellum.llm.mixing import mixed_documents
from vellum.llm.packing import pack_documents
from vellum.llm.secrets import redact_secrets
from vellum.llm.similar import drop_similar


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those in no learned language, go."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays.

    Two documents link if the Jaccard similarity of their five-word shingles is 0.8 or more.
    SimHashes find the candidates, which at 0.8 are about 0.94 of such pairs and more above.
    """
    return drop_similar(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret in them is replaced by ``[secret]``."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weight; a document appears as often as the mix takes it."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its ids and its place in a sequence of 2048 tokens.

    ``row_id`` tells the repeats of a document apart.  Workers that later run other stages do
    not keep what was encoded here.
    """
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048, keep=False)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: The language and near-duplicate stages have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
