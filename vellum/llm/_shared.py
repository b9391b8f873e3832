"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_path(spark: SparkSession, tag: str) -> str:
    """A new folder name below the cluster's shared folder.

    The folder is the one the session names in ``spark.checkpoint.dir``.  Where that is unset
    a session on one machine gets a temporary one; on a cluster, whose executors would each
    write to their own disk, this fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage with a table that every executor can reread, so a lost executor
    costs one task and not the steps before.
    """
    path = work_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that are broadcast: about 30 MB in a task.
FEW_ROWS = 500_000


def small_side(df: DataFrame) -> DataFrame:
    """A narrow written table, marked for a broadcast if it has at most ``FEW_ROWS`` rows."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, so that extra columns cannot clash."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column name of ``df`` starts with, for temporary columns."""
    prefix = "_t"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def quoted(name: str) -> str:
    """A column's name as ``F.col`` takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def own_columns(df: DataFrame, *without: str) -> list[Column]:
    """All columns of ``df`` but those of these names, which new columns will replace."""
    out = {w.lower() for w in without}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in out]


def packed(df: DataFrame, *beside: str, without: tuple[str, ...] = ()) -> DataFrame:
    """``row``, a struct of all columns of any names, and the columns ``beside`` on their own."""
    return df.select(F.struct(*own_columns(df, *without)).alias("row"), *[F.col(quoted(c)) for c in beside])


def unpacked(df: DataFrame) -> list[Column]:
    """The columns that ``row`` holds."""
    return [F.col("row")[c].alias(c) for c in df.schema["row"].dataType.names]


def utf8_size(text: Column) -> Column:
    """Bytes of the text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the text's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


#: The most ranges that ids are dealt into: this bounds what the driver and a broadcast hold.
MAX_RANGES = 4096


def id_ranges(docs: DataFrame, rows: int) -> DataFrame:
    """``range, doc_id, h, text`` of all documents; ranges follow ``doc_id, h`` (null first).

    A range holds about ``rows`` documents, or more where that would make over ``MAX_RANGES``
    of them; ``h`` is a hash of the text (null: empty).  Only the cut points reach the driver.
    Any cuts give right results; how good they are decides only how even the ranges are.  A
    doc_id (or null) that fills several ranges by itself is dealt into as many by ``h``, so
    only documents that are equal in both stay together whatever their number.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    total, known = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    rows = max(rows, -(-total // MAX_RANGES))
    null_parts, parts = max(1, -(-(total - known) // rows)), -(-known // rows)
    cuts: list[int] = []
    if parts > 1:
        cuts = sorted(int(c) for c in docs.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts))
    share = lambda n: F.least(F.floor((F.col("h") / float(1 << 64) + 0.5) * n), n - 1).cast("int")
    single = sorted(set(cuts))
    bucket = "bucket"
    if single:
        from pyspark.ml.feature import Bucketizer

        docs = docs.withColumn("value", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)))
        docs = Bucketizer(splits=[float("-inf"), *map(float, single), float("inf")], inputCol="value", outputCol=bucket).transform(docs)
    else:
        docs = docs.withColumn(bucket, F.lit(0))
    place = F.col(bucket).cast("int") + null_parts
    hot = {c: cuts.count(c) for c in single if cuts.count(c) > 1} if len(single) < len(cuts) else {}
    if hot:
        # a hot id has that many ranges for itself; later ones follow
        extra = np.cumsum([0, *[hot.get(c, 0) for c in single]])
        own = F.element_at(F.create_map(*[F.lit(x) for c, n in hot.items() for x in (c, n)]), F.col("doc_id"))
        before = F.get(F.lit([0, *extra[:-1].tolist()]), F.col(bucket).cast("int"))
        after = F.get(F.lit([0, *extra[1:].tolist()]), F.col(bucket).cast("int"))
        place = place + F.when(own.isNotNull(), before + share(own)).otherwise(after)
    place = F.when(F.col("doc_id").isNull(), share(F.lit(null_parts))).otherwise(place)
    return docs.select(place.cast("int").alias("range"), "doc_id", "h", "text")


def join_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Union of the groups that the links ``left[i]``-``right[i]`` join.

    ``labels`` holds a group's least index for each item; the result does so again.
    """
    while True:
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return labels
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


def whole_runs(batches, column: str, rows: int):
    """Cut a stream of Arrow batches that is sorted by ``column`` into tables of whole runs.

    Each table ends where the value of ``column`` changes and has at least ``rows`` rows,
    but for the last one.  Only the runs of one table and one batch are held at a time.
    """
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        value = table[column].to_numpy()
        done = 0
        for cut in np.flatnonzero(value[1:] != value[:-1]) + 1:
            if cut - done >= rows:
                yield table.slice(done, cut - done)
                done = int(cut)
        held = table.slice(done).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
