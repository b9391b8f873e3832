"""The library's own tables: a shared folder, and blocks that are replaced book by book."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name below the one that the session names in ``spark.checkpoint.dir``.

    Where that is unset a session on one machine gets a temporary folder; a cluster, whose
    executors would each write to their own disk, an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def save_blocks(blocks: DataFrame, path: str) -> None:
    """Write blocks below ``path``, one partition per book; books that are there are replaced whole.

    Rows are dealt by book and part of it before they are written, so a large book is several
    files and a small one a single file.
    """
    out = blocks.repartition("book_id", F.pmod(F.floor(F.col("page_id") / 65_536), F.lit(64)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("book_id", F.col("book_id").cast("long"))


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written in the shared folder and read again, for what is used more than once."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Parts of the stored revisions, by hash of their block.
REVISION_PARTS = 64
REVISIONS = "id long, block_id string, sentence_ordinal int, sentence string, revision long, part int"


def append_revisions(batch: DataFrame, path: str) -> None:
    """Append summaries ``id, block_id, sentence_ordinal, sentence`` with their revision.

    Revisions are counted by arrival (id) for each block and sentence (null: the whole block),
    and go on from what is stored.  Only parts of the store that the batch falls into are read.
    """
    spark, target = batch.sparkSession, ["block_id", "sentence_ordinal"]
    part = F.pmod(F.xxhash64("block_id"), F.lit(REVISION_PARTS)).cast("int")
    new = staged(batch.select("id", "block_id", F.col("sentence_ordinal").cast("int").alias("sentence_ordinal"), "sentence", part.alias("part")), "revisions")
    try:
        there = spark.read.schema(REVISIONS).parquet(path).where(F.col("part").isin([r[0] for r in new.select("part").distinct().collect()]))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        there = spark.createDataFrame([], REVISIONS)
    last = there.groupBy(*target).agg(F.max("revision").alias("last")).withColumnsRenamed({c: f"_{c}" for c in target})
    same = (F.col("block_id") == F.col("_block_id")) & F.col("sentence_ordinal").eqNullSafe(F.col("_sentence_ordinal"))
    nth = F.row_number().over(Window.partitionBy(*target).orderBy("id"))
    told = new.withColumn("nth", nth).join(last, same, "left").withColumn("revision", (F.coalesce("last", F.lit(0)) + F.col("nth")).cast("long"))
    told = staged(told.select("id", "block_id", "sentence_ordinal", "sentence", "revision", "part"), "revised")
    told.repartition("part").write.mode("append").partitionBy("part").parquet(path)
