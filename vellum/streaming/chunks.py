"""Response streams that come in chunks: lines are put together across micro-batches.

A chunk may end anywhere, inside a line or inside a character.  Keyed state holds what has
come of the next line, and chunks that overtook others; complete lines go on as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "id long, seq long, chunk binary"
LINES = "id long, n long, line string"
#: The next chunk and line, the bytes of an open line, and chunks that came too early.
STATE = "seq long, n long, held binary, early_seq array<long>, early array<binary>"


def _take(key, frames: Iterator, state):
    """Add a batch's chunks of one stream, and give the lines that are now complete."""
    import pandas as pd

    seq, n, held, early_seq, early = state.get if state.exists else (0, 0, b"", [], [])
    waiting = dict(zip(early_seq, early, strict=True))
    for frame in frames:
        waiting |= {int(s): bytes(c) for s, c in zip(frame["seq"], frame["chunk"], strict=True) if s >= seq}
    parts = [bytes(held)]
    while seq in waiting:
        parts.append(bytes(waiting.pop(seq)))
        seq += 1
    *lines, held = b"".join(parts).split(b"\n")
    state.update((seq, n + len(lines), held, list(waiting), list(waiting.values())))
    if lines:
        yield pd.DataFrame({"id": key[0], "n": range(n, n + len(lines)), "line": [x.decode(errors="replace") for x in lines]})


def lines_of_chunks(chunks: DataFrame) -> DataFrame:
    """``id, n, line`` from a stream of ``id, seq, chunk``; ``seq`` counts a body's chunks from 0.

    A chunk that comes twice counts once; a line that no line end closes is not given.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    return chunks.groupBy("id").applyInPandasWithState(_take, LINES, STATE, "append", GroupStateTimeout.NoTimeout)


def follow(chunks: DataFrame, folder: str) -> None:
    """Take in the chunks that have come since the last call; the file sink commits each batch once."""
    stream = lines_of_chunks(chunks).writeStream.format("parquet").option("path", f"{folder}/lines").outputMode("append")
    stream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def read_chunks(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """The chunks of a folder as a stream, so many files at a time."""
    return spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", files).parquet(folder)


def cut_bodies(bodies: DataFrame, size: int) -> DataFrame:
    """``id, seq, chunk``: bodies cut into chunks of ``size`` bytes."""
    raw = bodies.select("id", F.col("body").cast("binary").alias("raw"))
    rows = raw.select("id", "raw", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("raw") - 1) / size))).alias("seq"))
    return rows.select("id", F.col("seq").cast("long").alias("seq"), F.substring(F.col("raw"), (F.col("seq") * size + 1).cast("int"), F.lit(size)).alias("chunk"))


def text_of_lines(lines: DataFrame) -> DataFrame:
    """``id, text`` of the streams whose lines these are, up to the one that says it is done."""
    from ..operators.ingest import answers

    whole = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("x"))
    return whole.select("id", answers(F.transform("x", lambda x: x["line"])).alias("text"))
