"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are dealt by exact bands: of ``radius + k`` bands at least k are equal in any two
fingerprints within the radius, so links can only lie inside the buckets of k bands; k is
the least number that makes buckets of evenly spread fingerprints fit a block.  Inside a
bucket fingerprints are stored vertically, one plane of packed bits per bit position, and a
query's distances to 64 fingerprints per machine word are summed plane by plane in
carry-save counters.  A block of queries is left as soon as all its distances exceed the
radius.  Buckets above ``BLOCK`` fingerprints are dealt in pairs of sub-blocks, so that no
task ever holds a whole hot bucket (its work grows with the square of the fingerprints that
share a band), and every task reports a spanning forest of its links and never the pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._components import components
from ._shared import join_labels, materialize, whole_runs

BITS = 64
BLOCK = 4096
QUERIES_AT_ONCE = 256


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit number; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = len(words)
    body = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(n - size + 1, 1)].tolist()
    stops = ends[size - 1 :].tolist() or [len(body)]
    h = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(starts), 1 << 15):
        hashes = np.array([h(body[a:b], 42) for a, b in zip(starts[lo : lo + (1 << 15)], stops[lo : lo + (1 << 15)], strict=True)], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(starts))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, text: str, out: str, size: int = 3) -> DataFrame:
    """Adds the fingerprint of column ``text`` as long column ``out``; other columns stay."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = pa.array([fingerprint(t, size) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


def sliced_links(prints: np.ndarray, radius: int) -> np.ndarray:
    """Groups of fingerprints linked within the radius: least index of each.

    ``prints`` are unsigned 64-bit numbers, or rows of them for longer fingerprints.
    """
    n = len(prints)
    labels = np.arange(n)
    if n < 2:
        return labels
    words = -(-n // 64)
    raw = prints.astype(">u8").view(np.uint8).reshape(n, -1)
    bits = np.zeros((words * 64, 8 * raw.shape[1]), np.uint8)
    bits[:n] = np.unpackbits(raw, axis=1)
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    digits = max(radius.bit_length(), 1)
    for lo in range(0, n, QUERIES_AT_ONCE):
        asked = np.arange(lo, min(lo + QUERIES_AT_ONCE, n))
        first = lo // 64
        flip = np.where(bits[asked] > 0, full, np.uint64(0))
        lane = np.arange(first * 64, words * 64)
        skip = (lane[None, :] <= asked[:, None]) | (lane[None, :] >= n)
        over = np.ascontiguousarray(np.packbits(skip, axis=1, bitorder="little")).view("<u8")
        counters = [np.zeros_like(over) for _ in range(digits)]
        for j in range(bits.shape[1]):
            carry = planes[j, first:][None, :] ^ flip[:, j][:, None]
            for b in range(digits):
                counters[b], carry = counters[b] ^ carry, counters[b] & carry
            over |= carry
            if j % 8 == 7:
                alive = ~(over | _exceeds(counters, radius))
                some = alive.any(axis=1)
                if not some.any():
                    break
                if some.mean() < 0.75:
                    asked, flip, over, alive = asked[some], flip[some], over[some], alive[some]
                    counters = [c[some] for c in counters]
        else:
            near = np.unpackbits(np.ascontiguousarray(alive).view(np.uint8), axis=1, bitorder="little")
            query, other = np.nonzero(near)
            labels = join_labels(labels, asked[query], other + first * 64)
    return labels


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is above the radius."""
    above, level = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for b in range(len(counters) - 1, -1, -1):
        if radius >> b & 1:
            level &= counters[b]
        else:
            above |= level & counters[b]
            level &= ~counters[b]
    return above


def fingerprint_links(prints: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """Links ``u, v`` between distinct fingerprints (column ``fp``) that join all groups.

    The links are spanning forests of the near pairs found in each block: two fingerprints
    are connected by them exactly if a chain of pairs within the radius connects them.
    """
    n = prints.count()
    equal = next(k for k in range(1, BITS) if n >> (k * (BITS // (radius + k))) <= block or k + radius >= BITS // 2)
    n_bands = radius + equal
    cuts = [BITS * i // n_bands for i in range(n_bands + 1)]
    bands = [F.shiftrightunsigned(F.shiftleft("fp", a), BITS - (b - a)) for a, b in itertools.pairwise(cuts)]
    keys = F.array(
        *[F.xxhash64(F.lit(i), *[bands[k] for k in own]) for i, own in enumerate(itertools.combinations(range(n_bands), equal))]
    )
    dealt = prints.select("fp", F.explode(keys).alias("g"))
    sizes = dealt.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    part = F.pmod(F.xxhash64("fp"), parts).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), parts - 1), lambda x: F.struct(F.least(x, part).alias("a"), F.greatest(x, part).alias("b"))
    )
    rows = dealt.join(sizes, "g").select("fp", "g", F.explode(others).alias("o"))
    rows = rows.select("fp", F.xxhash64("g", "o.a", "o.b").alias("g"))

    def run(batches):
        import pyarrow as pa

        for table in whole_runs(batches, "g", block):
            own = np.unique(table["fp"].to_numpy().view(np.uint64))
            labels = sliced_links(own, radius)
            tied = np.flatnonzero(labels != np.arange(len(own)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[tied].view(np.int64)), pa.array(own[labels[tied]].view(np.int64))], names=["u", "v"]
            )

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long")


def group_fingerprints(prints: DataFrame, least: Column, radius: int = 2) -> DataFrame:
    """``fp, least`` for each distinct fingerprint: the minimum of ``least`` over its group."""
    classes = materialize(prints.groupBy("fp").agg(F.min(least).alias("own")), "classes")
    tied = components(fingerprint_links(classes.select("fp"), radius))
    labelled = classes.join(tied, classes["fp"] == tied["v"], "left").select(
        "fp", "own", F.coalesce("component", "fp").alias("label")
    )
    groups = labelled.groupBy("label").agg(F.min("own").alias("least"))
    return labelled.join(groups, "label").select("fp", "least")


def simhash_groups(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint`` is 16 hexadecimal digits; ``component_id`` is the least doc_id that links
    within the radius reach.  Defined cases: null, empty and wordless texts have fingerprint
    zero and link like any other; repeated rows and equal texts are one class; a null doc_id
    is never a component's label unless it is all there is; very long texts count whole; an
    empty table gives an empty result; columns other than doc_id and text are not used.
    """
    prints = with_fingerprints(docs.select("doc_id", "text"), "text", "fp", size).select("doc_id", "fp")
    prints = materialize(prints, "prints")
    groups = group_fingerprints(prints, F.col("doc_id"), radius)
    return prints.join(groups, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least").alias("component_id"),
    )


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op8_simhash_dedup": op8_simhash_dedup}
