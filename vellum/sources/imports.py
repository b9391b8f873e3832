"""Pages that are added to a stored table unless their book has them already."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .library import staged

STORED = "id long, book_id long, page_no long, image_hash string, range string"


def digest_range(digest):
    """The range of a hexadecimal digest: its first two digits."""
    return F.substring(digest, 1, 2)


def stored_pages(new: DataFrame, path: str) -> DataFrame:
    """The stored pages in the ranges that new ones fall into; at most 256 names reach the driver."""
    spark = new.sparkSession
    ranges = [r[0] for r in new.select(digest_range(F.col("image_hash"))).distinct().collect()]
    try:
        return spark.read.schema(STORED).parquet(path).where(F.col("range").isin(ranges))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


def add_pages(new: DataFrame, path: str) -> DataFrame:
    """Add pages ``id, book_id, page_no, image_hash``; says of each which page it repeats.

    Returns ``id, book_id, image_hash, existing_id, existing_no, added``.  A page whose picture
    its book has already is refused, with the stored page's id and number; of several new ones
    the least id is added and the others repeat it.  Stored pages are kept by ranges of the
    digest, and only ranges that new pages fall into are read.
    """
    new = staged(new.select("id", "book_id", "page_no", "image_hash"), "new-pages")
    there = stored_pages(new, path).groupBy("book_id", "image_hash").agg(F.min(F.struct("id", "page_no")).alias("there"))
    first = new.groupBy("book_id", "image_hash").agg(F.min(F.struct("id", "page_no")).alias("first"))
    known = first.join(there, ["book_id", "image_hash"], "left")
    other = F.when(F.col("there").isNotNull(), F.col("there")).when(F.col("id") != F.col("first.id"), F.col("first"))
    told = new.join(known, ["book_id", "image_hash"]).withColumn("other", other)
    told = staged(told.select("id", "book_id", "page_no", "image_hash", F.col("other.id").alias("existing_id"), F.col("other.page_no").alias("existing_no"), F.col("other").isNull().alias("added")), "told")
    fresh = told.where("added").select("id", "book_id", "page_no", "image_hash", digest_range(F.col("image_hash")).alias("range"))
    fresh.repartition("range").write.mode("append").partitionBy("range").parquet(path)
    return told.drop("page_no")
