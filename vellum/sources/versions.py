"""A library of tables by book whose changes show in one step.

Rows lie below ``data/<relation>/folder=<change>/book_id=<book>``.  A version lists, in one
file, the folder in which each relation has each book.  A change writes the books that it
touches into a folder of its own, then the next version's file: that file's appearance is the
one visible step.  A reader keeps to the version that it opened.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of a version that are broadcast: about 50 MB.
FEW_ENTRIES = 500_000
ENTRIES = "relation string, book_id long, folder string"


def latest(spark: SparkSession, root: str) -> int:
    """The number of the newest version, 0 for a library without one."""
    try:
        return spark.read.parquet(f"{root}/versions").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return 0


def entries(spark: SparkSession, root: str, version: int) -> DataFrame:
    if not version:
        return spark.createDataFrame([], ENTRIES)
    return spark.read.schema(ENTRIES).parquet(f"{root}/versions/version={version}")


def read(spark: SparkSession, root: str, relation: str, version: int | None = None) -> DataFrame:
    """A relation as a version has it, by default the newest; other folders and books are not read."""
    own = entries(spark, root, latest(spark, root) if version is None else version).where(F.col("relation") == relation).drop("relation")
    own = F.broadcast(own) if own.count() <= FEW_ENTRIES else own
    rows = spark.read.parquet(f"{root}/data/{relation}").withColumn("book_id", F.col("book_id").cast("long"))
    return rows.join(own, ["folder", "book_id"], "left_semi").drop("folder")


def stage(tables: dict[str, DataFrame], root: str) -> str:
    """Write rows, which have a ``book_id``, into a folder that no version lists yet."""
    folder = f"change-{uuid.uuid4().hex}"
    for relation, rows in tables.items():
        # a large book is several files, a small one a single file
        dealt = rows.repartition("book_id", F.pmod(F.xxhash64(rows.columns[0]), F.lit(16)))
        dealt.write.partitionBy("book_id").parquet(f"{root}/data/{relation}/folder={folder}")
    return folder


def publish(spark: SparkSession, root: str, version: int, folder: str, relations: list[str], books: DataFrame) -> int:
    """The version after ``version``: of the books, these relations are what ``folder`` holds.

    The version is one file, written under another name and then renamed.  It fails if the
    next version is there already: another change came first, and this one must start again.
    """
    touched = books.select("book_id").distinct()
    new = touched.select(F.explode(F.array(*map(F.lit, relations))).alias("relation"), "book_id", F.lit(folder).alias("folder"))
    old = entries(spark, root, version).join(new.select("relation", "book_id"), ["relation", "book_id"], "left_anti")
    listed = old.select("relation", "book_id", "folder").unionByName(new)
    listed.coalesce(1).write.mode("errorifexists").parquet(f"{root}/versions/version={version + 1}")
    return version + 1


def create(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """The first version of a library."""
    folder = stage(tables, root)
    books = None
    for rows in tables.values():
        own = rows.select("book_id").distinct()
        books = own if books is None else books.unionAll(own)
    return publish(spark, root, 0, folder, list(tables), books)


def stage_pages(spark: SparkSession, root: str, version: int, blocks: DataFrame, pages: DataFrame) -> tuple[str, DataFrame]:
    """Stage new blocks in the place of those of ``pages``, without what hung on the old ones.

    ``pages`` has ``book_id, page_id``, ``blocks`` the new rows of these.  Returns the folder
    and the books that it holds.
    """
    books = pages.select("book_id").distinct()
    page = pages.select("page_id").distinct()
    own = {r: read(spark, root, r, version).join(books, "book_id", "left_semi") for r in ("blocks", "summaries", "critiques")}
    gone = own["blocks"].join(page, "page_id", "left_semi").select(F.col("id").alias("block_id"))
    notes = own["summaries"].join(gone, "block_id", "left_anti")
    lost = own["summaries"].join(gone, "block_id", "left_semi").select(F.col("id").alias("summary_id"))
    kept = own["blocks"].join(page, "page_id", "left_anti").unionByName(blocks.select(*own["blocks"].columns))
    return stage({"blocks": kept, "summaries": notes, "critiques": own["critiques"].join(lost, "summary_id", "left_anti")}, root), books


def replace_pages(spark: SparkSession, root: str, blocks: DataFrame, pages: DataFrame) -> int:
    """Blocks of pages replaced, their summaries and critiques dropped, as one version."""
    version = latest(spark, root)
    folder, books = stage_pages(spark, root, version, blocks, pages)
    return publish(spark, root, version, folder, ["blocks", "summaries", "critiques"], books)
