"""The vocabulary as a running table: the incremental form of the batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
CHANGES = "book_id long, word string, lemma string, count long, sentence string, first_id long"


def read_events(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """The events of a folder as a stream, one file at a time."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1).parquet(folder)


def running_vocabulary(events: DataFrame) -> DataFrame:
    """Counts per book and word with the lemma and sentence of the first lookup, as upserts.

    An event that comes twice counts once and none is too late: the ids that were seen, and a
    row for each word, are kept as keyed state without a horizon, as the lookups themselves
    are.  In update mode a batch gives only the words that it changed.
    """
    once = events.dropDuplicates(["event_id"])
    lemma = F.concat(F.lit("lemma-"), F.col("event_id") % 5)
    first = F.min(F.struct(F.col("event_id").alias("first_id"), lemma.alias("lemma"), F.col("props").alias("sentence"))).alias("first")
    words = once.groupBy(F.col("user_id").alias("book_id"), F.lower("event_type").alias("word")).agg(F.count(F.lit(1)).alias("count"), first)
    return words.select("book_id", "word", "first.lemma", "count", "first.sentence", "first.first_id")


def follow(events: DataFrame, folder: str) -> None:
    """Take in what has come since the last call, and write each batch's changed words below ``folder``.

    A batch that runs again after a failure overwrites its own file and no other.
    """

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    stream = running_vocabulary(events).writeStream.outputMode("update").foreachBatch(keep)
    # state on disk: it grows with the events
    state = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    conf = events.sparkSession.conf
    before = conf.get(state[0], None)
    conf.set(*state)
    try:
        stream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(state[0], before) if before else conf.unset(state[0])


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The table as it stands: of each word the row that its last batch left."""
    rows = spark.read.schema(f"{CHANGES}, batch long").option("basePath", f"{folder}/changes").parquet(f"{folder}/changes/batch=*")
    last = rows.groupBy("book_id", "word").agg(F.max(F.struct("batch", "lemma", "count", "sentence", "first_id")).alias("x"))
    return last.select("book_id", "word", "x.lemma", "x.count", "x.sentence", "x.first_id")


def replay(spark: SparkSession, events: DataFrame, folder: str) -> DataFrame:
    """Run the stream over events that come in four files, every tenth twice, the oldest last."""
    for k in (3, 2, 1, 0):
        own = events.where((F.col("event_id") % 4 == k) | ((F.col("event_id") % 10 == 0) & F.lit(k == 1)))
        own.select(*EVENTS.names).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    follow(read_events(spark, f"{folder}/events"), folder)
    return current(spark, folder)
