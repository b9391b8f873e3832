"""Token-id output as directly addressable codes.

Ids are split into 8-bit chunks.  Level 0 holds every id's lowest chunk, level 1 the next
chunk of the ids that need one, and so on; a bitmap per level says which ids go on, and a
rank directory counts the set bits before each 512-bit block.  Any token is then found by
one lookup per level, and any stretch of tokens by reading just its own stretch per level.

Layout of a code (little-endian): ``DAC1``, levels u32, ids u64; per level: chunks u64, the
chunks, and, for all but the last level, the bitmap (padded to whole 512-bit blocks) and
one u32 of the directory per block.  A file set of such codes has a directory of its own
(``segment_starts``), so any token of all documents is found by its global position.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import id_ranges, work_path
from ._tokens import encoder, vocabulary

MAGIC = b"DAC1"
RANK_BITS = 512


def pack_codes(ids: np.ndarray) -> bytes:
    """Ids (unsigned, below 2**32) as directly addressable codes."""
    levels, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        more = rest > 0xFF
        chunks = (rest & np.uint32(0xFF)).astype(np.uint8)
        if not more.any():
            levels.append(len(chunks).to_bytes(8, "little") + chunks.tobytes())
            break
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (RANK_BITS // 8), np.uint8)])
        ones = np.bitwise_count(bitmap.view("<u8")).reshape(-1, RANK_BITS // 64).sum(axis=1, dtype=np.int64)
        directory = (np.cumsum(ones) - ones).astype("<u4")
        levels.append(len(chunks).to_bytes(8, "little") + chunks.tobytes() + bitmap.tobytes() + directory.tobytes())
        rest = rest[more] >> np.uint32(8)
    return MAGIC + len(levels).to_bytes(4, "little") + len(ids).to_bytes(8, "little") + b"".join(levels)


class Codes:
    """Random access to packed ids; nothing is decoded that is not asked for."""

    def __init__(self, packed: bytes):
        if packed[:4] != MAGIC:
            raise ValueError("not directly addressable codes")
        n_levels = int.from_bytes(packed[4:8], "little")
        self.n = int.from_bytes(packed[8:16], "little")
        self.levels, at = [], 16
        for level in range(n_levels):
            n = int.from_bytes(packed[at : at + 8], "little")
            chunks = np.frombuffer(packed, np.uint8, n, at + 8)
            at += 8 + n
            if level == n_levels - 1:
                self.levels.append((chunks, None, None))
                break
            blocks = -(-n // RANK_BITS)
            bitmap = np.frombuffer(packed, np.uint8, blocks * RANK_BITS // 8, at)
            at += len(bitmap)
            self.levels.append((chunks, bitmap, np.frombuffer(packed, "<u4", blocks, at)))
            at += 4 * blocks

    def _rank(self, level: int, i: int) -> int:
        """Set bits of a level's bitmap before position ``i``."""
        _, bitmap, directory = self.levels[level]
        block = i // RANK_BITS
        if block == len(directory):
            block -= 1
        lo = block * RANK_BITS // 8
        full, odd = divmod(i, 8)
        ones = int(directory[block]) + int(np.bitwise_count(bitmap[lo:full]).sum(dtype=np.int64))
        return ones + (int(bitmap[full] & ((1 << odd) - 1)).bit_count() if odd else 0)

    def token(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if bitmap is None or not bitmap[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """The ids at positions ``lo`` to ``hi``, end exclusive."""
        parts = []
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            own = chunks[lo:hi].astype("<u4")
            if bitmap is None or lo == hi:
                parts.append((own, None))
                break
            bits = np.unpackbits(bitmap[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo].view(bool)
            parts.append((own, bits))
            lo = self._rank(level, lo)
            hi = lo + int(np.count_nonzero(bits))
        value = parts[-1][0]
        for own, bits in parts[-2::-1]:
            own[bits] |= value << np.uint32(8)
            value = own
        return value


def write_token_ids(
    docs: DataFrame, path: str, vocabulary_path: str, end_id: int, range_rows: int = 4000, segment_ids: int = 1 << 16
) -> None:
    """Encode whole texts and write their ids, in ascending doc_id order, below ``path``.

    The documents are dealt once into ranges of doc_id and sorted inside.  Each row of the
    Parquet container is a segment: ``range, segment, before`` (ids of the range before it),
    ``size``, ``doc_ids``, ``lengths`` and ``codes``, the directly addressable codes of all its
    ids; a document is never split, so a segment ends with the document that fills it.  The
    container is neither compressed nor dictionary-coded and has pages of single segments,
    so that a token costs the reading of its segment and no decoding.  Defined cases: null
    text is empty and has only the end id; null doc_ids come first; documents of one doc_id
    follow the hash of their text; repeated rows stay, next to each other; very long texts
    are encoded whole and make a segment; an empty table writes an empty container; columns
    other than doc_id and text are not used.
    """
    dealt = id_ranges(docs, range_rows).repartition("range").sortWithinPartitions("range", "doc_id", "h", "text").select("range", "doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa

        code = encoder(vocabulary_path)
        at, segment, before, held, size = None, 0, 0, [], 0

        def flush():
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([at], pa.int32()),
                    pa.array([segment], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([[d for d, _ in held]], pa.list_(pa.int64())),
                    pa.array([[len(x) // 4 for _, x in held]], pa.list_(pa.int64())),
                    pa.array([pack_codes(ids)], pa.binary()),
                ],
                names=["range", "segment", "before", "size", "doc_ids", "lengths", "codes"],
            )

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                ids = code.encode(some.column(2).to_pylist())
                for place, doc, own in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), ids, strict=True):
                    if held and (place != at or size >= segment_ids):
                        yield flush()
                        segment, before = (segment + 1, before + size) if place == at else (0, 0)
                        held, size = [], 0
                    at = place
                    held.append((doc, own + end))
                    size += len(own) // 4 + 1
        if held:
            yield flush()

    out = dealt.mapInArrow(run, SEGMENT).write.option("compression", "none").option("parquet.enable.dictionary", "false")
    out.option("parquet.page.row.count.limit", 1).option("parquet.page.size.row.check.min", 1).parquet(path)


SEGMENT = "range int, segment int, before long, size long, doc_ids array<long>, lengths array<long>, codes binary"


def _offsets(segments: DataFrame) -> DataFrame:
    """Ids before each range: one row per range, and the ranges are bounded."""
    totals = segments.groupBy("range").agg(F.sum("size").alias("size"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """The directory of a container: ``range, segment, start, size`` of every segment; reads no ids."""
    segments = spark.read.schema(SEGMENT).parquet(path).select("range", "segment", "before", "size")
    return segments.join(_offsets(segments), "range").select("range", "segment", (F.col("offset") + F.col("before")).alias("start"), "size")


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The id at one position of all ids; reads the directory and one segment."""
    place = segment_starts(spark, path).where((F.col("start") <= position) & (position < F.col("start") + F.col("size"))).first()
    if place is None:
        raise IndexError(position)
    return Codes(one_segment(spark, path, place["range"], place["segment"]).first()["codes"]).token(position - place["start"])


def one_segment(spark: SparkSession, path: str, range_: int, segment: int) -> DataFrame:
    """A segment's codes; the filter reaches the pages of the container."""
    rows = spark.read.schema(SEGMENT).parquet(path)
    return rows.where((F.col("range") == range_) & (F.col("segment") == segment)).select("codes")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, grid: int = 1 << 16) -> DataFrame:
    """``position, token`` for a table of positions (column ``position``); others than stored ones are left out.

    Positions meet the segments on cells of a grid, an equi-join; no segment is decoded.
    """
    cell = lambda x: F.floor(x / grid)
    starts = segment_starts(spark, path).withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("start") + F.col("size") - 1))))
    asked = positions.select("position", cell(F.col("position")).alias("cell"))
    inside = (F.col("start") <= F.col("position")) & (F.col("position") < F.col("start") + F.col("size"))
    found = asked.join(starts, "cell").where(inside).select("range", "segment", "position", (F.col("position") - F.col("start")).alias("inside"))
    segments = spark.read.schema(SEGMENT).parquet(path).select("range", "segment", "codes")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            position, inside, packed = (batch.column(i) for i in range(3))
            ids = [Codes(code).token(i) for code, i in zip(packed.to_pylist(), inside.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([position, pa.array(ids, pa.int64())], names=["position", "token"])

    return found.join(segments, ["range", "segment"]).select("position", "inside", "codes").mapInArrow(run, "position long, token long")


def read_token_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` (little-endian u32).

    ``start`` is the number of ids of all documents before; every document's ids are read
    from its own stretch of the codes.
    """
    segments = spark.read.schema(SEGMENT).parquet(path)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for place, first, docs, lengths, packed in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                codes, stops = Codes(packed), np.cumsum(lengths).tolist()
                found = [codes.tokens(hi - n, hi).tobytes() for hi, n in zip(stops, lengths, strict=True)]
                for lo in range(0, len(docs), 1000):
                    part = slice(lo, lo + 1000)
                    own = found[part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([place] * len(own), pa.int32()),
                            pa.array(docs[part], pa.int64()),
                            pa.array([first + hi - n for hi, n in zip(stops[part], lengths[part], strict=True)], pa.int64()),
                            pa.array(lengths[part], pa.int64()),
                            pa.array([zlib.crc32(x) for x in own], pa.int64()),
                            *([pa.array(own, pa.binary())] if ids else []),
                        ],
                        names=["range", "doc_id", "inside", "n_tokens", "ids_crc32", *(["ids"] if ids else [])],
                    )

    schema = "range int, doc_id long, inside long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else "")
    rows = segments.select("range", "before", "doc_ids", "lengths", "codes").mapInArrow(run, schema)
    return rows.join(_offsets(segments), "range").select(
        "doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else [])
    )


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = work_path(spark, "token-ids")
    write_token_ids(docs, path, vocabulary("word_bpe_49k.json"), end_id=2)
    return read_token_ids(spark, path, ids=False)


SQL: dict[str, str] = {}
QUERIES = {"op9_token_ids": op9_token_ids}
