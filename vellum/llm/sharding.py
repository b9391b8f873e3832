"""Sharding by histogram sort (after Solomonik and Kale 2010).

Documents are ordered by a 128-bit key: the hash of the text, so that equal texts stand
together, then the hash of the doc_id, so that a large group of copies can still be cut, and
last a number that tells repeated rows apart, so that these can be cut too.  Rounds count the exact bytes below candidate boundaries: every task adds up its
rows between the probes, only these sums reach the driver, and each interval that holds a
wanted cut gets new probes between the least and the greatest key in it.  When every
splitter meets the tolerance, the documents are exchanged once and sorted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import free_prefix, materialize, own_columns, text_crc32, utf8_size

#: Bytes of one sorted block; a shard is cut into blocks so that no task sorts a whole shard.
BLOCK_BYTES = 128 << 20
#: Bounds of what the driver and each task hold: blocks are larger where there would be more of
#: them, and a round asks fewer probes for each open cut and goes on for more rounds.
MAX_BLOCKS, MAX_PROBES = 8192, 1 << 16
PROBES = 32
#: Low bits of the key that tell repeated rows apart.
REPEAT_BITS = 20
_HALF = 1 << 63


def _whole(hi: int, lo: int) -> int:
    """The 128-bit number whose order is that of the signed pair."""
    return (hi + _HALF) << 64 | (lo + _HALF)


def _pair(key: int) -> tuple[int, int]:
    return (key >> 64) - _HALF, (key & (2 * _HALF - 1)) - _HALF


def _place(hi: np.ndarray, lo: np.ndarray, probes: list[int]) -> np.ndarray:
    """Number of probes at or below each key: an exact search over two 64-bit halves."""
    if not probes:
        return np.zeros(len(hi), np.int32)
    pairs = [_pair(p) for p in probes]
    highs, lows = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    found, right = np.searchsorted(highs, hi, side="left"), np.searchsorted(highs, hi, side="right")
    tied = np.flatnonzero(right > found)
    # keys whose upper half is a probe's: one search for each such half, not for each key
    order = tied[np.argsort(found[tied], kind="stable")]
    starts = np.flatnonzero(np.r_[True, found[order][1:] != found[order][:-1]]) if len(order) else []
    for own in np.split(order, starts[1:]) if len(order) else []:
        a, b = int(found[own[0]]), int(right[own[0]])
        found[own] = a + np.searchsorted(lows[a:b], lo[own], side="right")
    return found.astype(np.int32)


def _histogram(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int]]:
    """Per interval between probes: bytes, least key and greatest key.  Empty ones are absent."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, size = (batch.column(i).to_numpy() for i in range(3))
            order = np.lexsort((lo, hi))
            hi, lo, size = hi[order], lo[order], size[order]
            at = _place(hi, lo, probes)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            last = np.r_[first[1:], len(at)] - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (at[first], np.add.reduceat(size, first), hi[first], lo[first], hi[last], lo[last])],
                names=["at", "size", "hi0", "lo0", "hi1", "lo1"],
            )

    parts = keys.select("hi", "lo", "size").mapInArrow(run, "at int, size long, hi0 long, lo0 long, hi1 long, lo1 long")
    rows = parts.groupBy("at").agg(
        F.sum("size").alias("size"),
        F.min(F.struct("hi0", "lo0")).alias("a"),
        F.max(F.struct("hi1", "lo1")).alias("b"),
    )
    return {r["at"]: (r["size"], _whole(*r["a"]), _whole(*r["b"])) for r in rows.collect()}


def find_splitters(keys: DataFrame, targets: list[float], tolerances: list[float]) -> tuple[list[int], list[int]]:
    """Keys that cut the sorted rows at the wanted byte counts, and the exact bytes below them.

    ``keys`` has ``hi, lo, size``.  A cut is settled when the bytes below it are within its
    tolerance, or when only one key is left in its interval and the nearer side is taken.
    The bits that tell repeated rows apart take part only inside a run of these, so other
    cuts do not depend on them.
    """
    cuts: dict[int, tuple[int, int]] = {}
    probes: list[int] = []
    while len(cuts) < len(targets):
        found = _histogram(keys, probes)
        if not found:
            return [], []
        edges, below = [], 0
        spans = []
        for at in range(len(probes) + 1):
            size, least, greatest = found.get(at, (0, 0, 0))
            spans.append((below, size, least, greatest))
            below += size
            edges.append(below)
        new: set[int] = set()
        each = min(PROBES, max(4, MAX_PROBES // (2 * (len(targets) - len(cuts)))))
        for i, target in enumerate(targets):
            if i in cuts:
                continue
            at = int(np.searchsorted(edges, target, side="left"))
            under, size, least, greatest = spans[at]
            unit = 1 << REPEAT_BITS if least >> REPEAT_BITS < greatest >> REPEAT_BITS else 1
            first, last = least - least % unit, greatest - greatest % unit + unit
            # the interval's own ends are exact cuts: below its least key, or after its greatest
            best = min(((under, first), (under + size, last)), key=lambda c: abs(c[0] - target))
            if abs(best[0] - target) <= tolerances[i] or least == greatest:
                cuts[i] = (best[1], best[0])
                continue
            share = (target - under) / size
            width = (last - first) // unit
            new |= {first, min(last, (1 << 128) - 1)}
            # evenly over the interval, and closer around where the target would lie
            for j in range(1, each):
                new.add(first + unit * max(1, width * j // each))
                near = int(width * share) + (j - each // 2) * max(1, width // each**2)
                if 0 < near < width:
                    new.add(first + unit * near)
        probes = sorted(new)
    return [cuts[i][0] for i in range(len(targets))], [cuts[i][1] for i in range(len(targets))]


def histogram_shards(docs: DataFrame, n_shards: int = 24, tolerance: float = 1e-3, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with ``size``, ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0).

    Shards hold near equal bytes: each boundary is within ``tolerance`` of a shard's mean, or
    as near as whole documents allow.  Slots follow the key, so equal texts stand together.
    All columns of ``docs`` stay, whatever their names, but for older ones of these three.
    Defined cases: null text counts 8 bytes, an empty one too; rows with equal doc_id and text
    follow each other and are cut like any others (which of them stands where depends on how
    the input is stored, and is of no consequence but for further columns); null doc_ids are
    one doc_id; very long texts count whole and may unbalance shards by their size; an empty
    table gives an empty result; fewer documents than shards leave shards empty.
    """
    p = free_prefix(docs)
    hi, lo, at, row, rank, before = (f"{p}{c}" for c in ("hi", "lo", "at", "row", "rank", "before"))
    repeat = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << REPEAT_BITS) - 1))
    keyed = docs.select(
        F.struct(*own_columns(docs, "size", "shard", "slot")).alias(row),
        (utf8_size(F.col("text")) + 8).alias("size"),
        F.xxhash64("text").alias(hi),
        F.xxhash64("doc_id", F.lit(1)).bitwiseAND(F.lit(-(1 << REPEAT_BITS))).bitwiseOR(repeat).alias(lo),
    )
    keyed = materialize(keyed, "shard-rows")
    keys = keyed.select(F.col(hi).alias("hi"), F.col(lo).alias("lo"), "size")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    inner = max(1, min(-(-total // (n_shards * block_bytes)), MAX_BLOCKS // n_shards))
    blocks = n_shards * inner
    share = total / blocks
    targets = [share * i for i in range(1, blocks)]
    tolerances = [tolerance * share * inner if i % inner == 0 else share / 4 for i in range(1, blocks)]
    cuts, _ = find_splitters(keys, targets, tolerances)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (hi, lo))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(_place(*own, cuts))], names=[*batch.schema.names, at]
            )

    placed = keyed.mapInArrow(run, T.StructType([*keyed.schema.fields, T.StructField(at, T.IntegerType())]))
    # rows per block, from the keys alone: a slot is the rows before the block and the rank in it
    counted = keyed.select(hi, lo).mapInArrow(run, f"{hi} long, {lo} long, {at} int")
    counts = counted.groupBy(at).agg(F.count(F.lit(1)).alias("rows"))
    shard = (F.col(at) / inner).cast("int")
    earlier = Window.partitionBy(shard).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(at, F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy(at).orderBy(hi, lo)
    ranked = placed.withColumn(rank, F.row_number().over(inside) - 1).join(offsets, at)
    return ranked.select(
        *[F.col(row)[c].alias(c) for c in keyed.schema[row].dataType.names],
        "size",
        shard.alias("shard"),
        (F.col(rank) + F.col(before)).cast("long").alias("slot"),
    )


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return histogram_shards(docs).select(
        "doc_id",
        "size",
        text_crc32(F.col("text")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


SQL: dict[str, str] = {}
QUERIES = {"op1_histogram_shards": op1_histogram_shards}
