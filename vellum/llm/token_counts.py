"""Token counts through a digest cache.

A count is stored under two digests: of the normalised content and of the tokenizer's
version (its vocabulary file).  Documents are joined to the stored counts; what is missing
is made distinct by digest, encoded once, and appended to the cache, from which the result
is then read.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, utf8_size, work_path
from ._tokens import encoder, vocabulary

#: Misses that are broadcast, at some 250 bytes each in memory: 25 MB.
FEW = 100_000
CACHE = "content string, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of a vocabulary file: another file, or another edition of it, is another version."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def normalised(text: Column) -> Column:
    """The content whose tokens are counted.

    Null counts as empty.  A byte-level vocabulary tells case, white space and composed
    forms apart, so nothing else may be changed without changing counts.
    """
    return F.coalesce(text, F.lit(""))


def stored_counts(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows, one per key; an empty table if nothing has been stored there."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)
    return rows.groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def append_misses(docs: DataFrame, contents: DataFrame, cache: str, vocabulary_path: str) -> None:
    """Encode each distinct content of ``docs`` that the cache lacks, and append its count.

    ``contents`` has the documents' digests.  Misses are found among digests alone; texts move
    only where one is missing.  Few misses (up to ``FEW``, a bounded broadcast) pick their
    texts out before these are made distinct, many after it: the rows are the same.
    """
    version = tokenizer_version(vocabulary_path)
    known = stored_counts(docs.sparkSession, cache).where(F.col("tokenizer") == version).select("content")
    missing = materialize(contents.select("content").distinct().join(known, "content", "left_anti"), "missing")
    n = missing.count()
    texts = docs.select(normalised(F.col("text")).alias("text"), digest(F.col("text")).alias("content"))
    if n <= FEW:
        texts = texts.join(F.broadcast(missing), "content", "left_semi")
    texts = texts.groupBy("content").agg(F.first("text").alias("text"))
    if n > FEW:
        texts = texts.join(missing, "content", "left_semi")

    def run(batches):
        import pyarrow as pa

        code = encoder(vocabulary_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                counts = [len(ids) // 4 for ids in code.encode(some.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([version] * len(counts)), pa.array(counts, pa.int64())],
                    names=["content", "tokenizer", "n_tokens"],
                )

    texts.select("content", "text").mapInArrow(run, CACHE).write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, vocabulary_path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; the cache at ``cache`` grows.

    Counts are those of the tokenizers library without added special tokens.  A second call
    with the same contents encodes nothing and moves no text; another vocabulary file, or
    another edition of it, has counts of its own.  Defined cases: null and empty texts have 0
    tokens; repeated rows and equal texts are encoded once and all get the count; very long
    texts are encoded whole; an empty table gives an empty result; columns other than doc_id
    and text are not used.
    """
    rows = materialize(docs.select("doc_id", utf8_size(F.col("text")).alias("n_bytes"), digest(F.col("text")).alias("content")), "contents")
    append_misses(docs, rows, cache, vocabulary_path)
    counts = stored_counts(docs.sparkSession, cache).where(F.col("tokenizer") == tokenizer_version(vocabulary_path))
    return rows.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with a cache of its own, so that every call does the whole work."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, work_path(spark, "token-counts"), vocabulary("byte_bpe_50k.json"))


SQL: dict[str, str] = {}
QUERIES = {"op5_token_counts": op5_token_counts}
