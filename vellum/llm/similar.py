"""Near-duplicates: SimHash finds candidates at a wide radius, exact similarity decides.

Texts with one set of word shingles are a class.  Each class gets a 128-bit SimHash of its
set, and bands deal the fingerprints: each of several tables takes some of the bits as a key,
and two sets with the wanted Jaccard similarity agree in a table's bits with a known chance,
from which the number of tables follows.  Inside a bucket fingerprints are compared by
bit-sliced planes, and those within the radius are joined to clusters of candidates: first
through a few tables, then through the others, which report only what joins two clusters.
Every cluster is then compared with its shingle sets, and only sets with the wanted similarity
link.  Buckets and clusters above ``BLOCK`` are dealt in pairs of sub-blocks; tasks report
spanning forests of their links and never the pairs.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._components import components
from ._shared import join_labels, materialize, own_columns, small_side, whole_runs
from .simhash import sliced_links

BITS = 128
BLOCK = 4096
#: Shingles of one sub-block's sets.
BLOCK_SHINGLES = 1 << 22
STRIP = 512
#: Tables of the first round; a large group of copies is one cluster after it.
FIRST_TABLES = 8
#: One of so many classes is counted to find hot buckets; the counts decide only how these are dealt.
SAMPLE = 16


@dataclass(frozen=True)
class Search:
    """The candidate search: of the pairs with just the least similarity it finds ``recall`` squared, of closer ones more.

    Sets of one size with Jaccard similarity j have a cosine of 2j / (1 + j), and each bit of
    their SimHashes differs with the chance of the angle over pi, independently.  The radius
    lets a share of ``recall`` through.  The tables are as many as the rest takes, counted
    over all numbers of bits in which two SimHashes differ: pairs that differ in more bits
    meet in fewer tables.  The keys do not depend on the corpus: whether a pair is found
    depends on its two sets alone.
    """

    least: float = 0.8
    size: int = 5
    recall: float = 0.97
    #: Bits of a table's key.  Longer keys make smaller buckets and more tables, at the same recall.
    bits: int = 16

    @property
    def differ(self) -> float:
        """The chance of one bit to differ at the least similarity."""
        return math.acos(2 * self.least / (1 + self.least)) / math.pi

    @property
    def radius(self) -> int:
        share = 0.0
        for d in range(BITS + 1):
            share += math.comb(BITS, d) * self.differ**d * (1 - self.differ) ** (BITS - d)
            if share >= self.recall:
                return d
        return BITS

    def found(self, tables: int) -> float:
        """The share of the pairs with just the least similarity that so many tables and the radius let through."""
        share = 0.0
        for d in range(self.radius + 1):
            chance = math.comb(BITS, d) * self.differ**d * (1 - self.differ) ** (BITS - d)
            meets = math.comb(BITS - d, self.bits) / math.comb(BITS, self.bits)
            share += chance * (1 - (1 - meets) ** tables)
        return share

    def tables(self) -> np.ndarray:
        """The bits of each table's key: (tables, bits)."""
        count = next(n for n in itertools.count(1) if self.found(n) >= self.recall**2)
        rng = np.random.default_rng(17)
        return np.stack([rng.permutation(BITS)[: self.bits] for _ in range(count)])

    def alike(self, n_a, n_b, shared):
        """Whether sets of these sizes with so many shared members have the least similarity."""
        return shared * (1 + self.least) >= self.least * (n_a + n_b) - 1e-6


def shingle_hashes(text: str | None, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of a text: sorted 64-bit hashes, and 128-bit hashes as (n, 16) bytes."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros((0, 16), np.uint8)
    n = len(words)
    body = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(n - size + 1, 1)].tolist()
    stops = ends[size - 1 :].tolist() or [len(body)]
    h = xxhash.xxh3_128_digest
    raw = np.frombuffer(b"".join([h(body[a:b]) for a, b in zip(starts, stops, strict=True)]), np.uint8).reshape(-1, 16)
    found, first = np.unique(raw[:, 8:].copy().view("<i8").ravel(), return_index=True)
    return found, raw[first]


def set_print(hashes: np.ndarray) -> tuple[int, int]:
    """SimHash of a set of 128-bit hashes, as two signed 64-bit numbers; zero for the empty set."""
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[lo : lo + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return tuple(np.packbits(2 * counts > len(hashes)).view(">i8").tolist())


def with_prints(docs: DataFrame, text: str, size: int) -> DataFrame:
    """Adds ``key`` (digest of the shingle set), ``n`` (its size), and the SimHash ``hi, lo``."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            keys, sizes, prints = [], [], []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                own, hashes = shingle_hashes(t, size)
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                prints.append(set_print(hashes))
            hi, lo = zip(*prints, strict=True) if prints else ((), ())
            added = [pa.array(keys, pa.binary()), *[pa.array(x, pa.int64()) for x in (sizes, hi, lo)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "key", "n", "hi", "lo"])

    added = [T.StructField("key", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("n", "hi", "lo")]]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def bucket_links(key: np.ndarray, prints: np.ndarray, label: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of labels that join all prints of equal ``key`` within the radius; keys are sorted.

    Buckets that fill a machine word are compared by bit slices, lesser ones side by side.
    """
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, n in zip(starts[sizes >= 64].tolist(), sizes[sizes >= 64].tolist(), strict=True):
        groups = sliced_links(prints[at : at + n], radius)
        tied = np.flatnonzero(groups != np.arange(n))
        left.append(label[tied + at])
        right.append(label[groups[tied] + at])
    few = np.flatnonzero(np.repeat(sizes < 64, sizes))
    for shift in range(1, 64):
        a, b = few[:-shift], few[shift:]
        same = key[a] == key[b]
        if not same.any():
            break
        same &= label[a] != label[b]
        a, b = a[same], b[same]
        near = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64) <= radius
        left.append(label[a[near]])
        right.append(label[b[near]])
    pairs = np.c_[np.concatenate(left), np.concatenate(right)]
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    return pairs[:, 0], pairs[:, 1]


def candidate_links(prints: DataFrame, tables: np.ndarray, radius: int, block: int = BLOCK) -> DataFrame:
    """Links ``u, v`` that join all labels whose SimHashes meet in a bucket within the radius.

    ``prints`` has ``rid, hi, lo`` and the ``label`` of the cluster that each is in so far.
    """

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                label, hi, lo = (some.column(i).to_numpy() for i in range(3))
                bits = np.unpackbits(np.c_[hi, lo].astype(">i8").view(np.uint8), axis=1)
                values = (bits[:, tables].astype(np.int64) << np.arange(tables.shape[1])).sum(axis=2)
                g = values * len(tables) + np.arange(len(tables))
                spread = lambda x: pa.array(np.repeat(x, len(tables)))
                yield pa.RecordBatch.from_arrays([pa.array(g.ravel()), spread(label), spread(hi), spread(lo)], names=["g", "label", "hi", "lo"])

    made = "g long, label long, hi long, lo long"
    dealt = prints.select("label", "hi", "lo").mapInArrow(deal, made)
    some = prints.where(F.pmod(F.xxhash64("rid"), F.lit(SAMPLE)) == 0).select("label", "hi", "lo")
    hot = some.mapInArrow(deal, made).groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") * SAMPLE > block)
    hot = materialize(hot.select("g", F.ceil(F.col("m") * SAMPLE / block).cast("int").alias("parts")), "hot-buckets")
    rows = dealt
    if hot.head():
        rows = dealt.join(hot, "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        part = F.pmod(F.xxhash64("hi", "lo"), F.col("parts")).cast("int")
        others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, part).alias("a"), F.greatest(x, part).alias("b")))
        cold = rows.where("parts = 1").select(F.xxhash64("g").alias("g"), "label", "hi", "lo")
        split = rows.where("parts > 1").select("g", "label", "hi", "lo", F.explode(others).alias("o"))
        rows = cold.unionAll(split.select(F.xxhash64("g", "o.a", "o.b").alias("g"), "label", "hi", "lo"))

    def run(batches):
        import pyarrow as pa

        for table in whole_runs(batches, "g", block):
            prints = np.c_[table["hi"].to_numpy(), table["lo"].to_numpy()].view(np.uint64)
            a, b = bucket_links(table["g"].to_numpy(), prints, table["label"].to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long")


def candidate_clusters(prints: DataFrame, how: Search, block: int = BLOCK) -> DataFrame:
    """``rid, cluster`` of all that are in a cluster of candidates with another one."""
    tables = how.tables()
    first = components(candidate_links(prints.withColumn("label", F.col("rid")), tables[:FIRST_TABLES], how.radius, block)).withColumnRenamed("v", "rid")
    labelled = prints.join(first, "rid", "left").select("rid", "hi", "lo", F.coalesce("component", "rid").alias("label"))
    labelled = materialize(labelled, "labelled")
    more = components(candidate_links(labelled, tables[FIRST_TABLES:], how.radius, block)) if len(tables) > FIRST_TABLES else None
    if more is None:
        out = labelled.select("rid", F.col("label").alias("cluster"))
    else:
        out = labelled.join(more, labelled["label"] == more["v"], "left").select("rid", F.coalesce("component", "label").alias("cluster"))
    # the others of a cluster tell which of its heads have company
    others = out.where("rid <> cluster")
    return materialize(others.unionByName(others.select(F.col("cluster").alias("rid"), "cluster").distinct()), "clusters")


def block_links(sets: list[np.ndarray], how: Search) -> np.ndarray:
    """Groups of sets linked by the least similarity or more: least index of each."""
    n = np.array([len(s) for s in sets])
    labels = np.arange(len(sets))
    owner = np.repeat(labels, n)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = df[token] > 1
    owner, token = owner[many], np.unique(token[many], return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    width = int(token[-1]) + 1 if len(token) else 0
    cuts = np.searchsorted(token, np.arange(0, width + STRIP, STRIP))
    for lo in range(0, len(sets), STRIP):
        hi = min(lo + STRIP, len(sets))
        shared = np.zeros((hi - lo, len(sets) - lo), np.float32)
        for k in range(len(cuts) - 1):
            o, t = owner[cuts[k] : cuts[k + 1]], token[cuts[k] : cuts[k + 1]] - k * STRIP
            o, t = o[o >= lo] - lo, t[o >= lo]
            has = np.zeros((len(sets) - lo, int(t.max(initial=0)) + 1), np.float32)
            has[o, t] = 1
            shared += has[: hi - lo] @ has.T
        a, b = np.nonzero(how.alike(n[lo:hi, None], n[None, lo:], shared))
        labels = join_labels(labels, a + lo, b + lo)
    return labels


def verified_links(members: DataFrame, how: Search, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links ``u, v`` that join the groups of sets with the least similarity inside each cluster.

    ``members`` has ``cluster, rid, n, body``: the number of shingles and a text with them.
    """
    members = materialize(members.select("cluster", "rid", "n", "body"), "members")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"))
    parts = F.ceil(F.greatest(F.col("m") / block, F.col("all") / shingles)).cast("int")
    sizes = sizes.select("cluster", F.greatest(F.least(parts, F.col("m").cast("int")), F.lit(1)).alias("parts"))
    part = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, part).alias("a"), F.greatest(x, part).alias("b")))
    rows = members.join(sizes, "cluster").select("rid", "body", "cluster", F.explode(others).alias("o"))
    rows = rows.select("rid", "body", F.xxhash64("cluster", "o.a", "o.b").alias("g"))

    def run(batches):
        import pyarrow as pa

        for table in whole_runs(batches, "g", 1):
            rid = table["rid"].to_numpy()
            labels = block_links([shingle_hashes(t, how.size)[0] for t in table["body"].to_pylist()], how)
            tied = np.flatnonzero(labels != np.arange(len(rid)))
            yield pa.RecordBatch.from_arrays([pa.array(rid[tied]), pa.array(rid[labels[tied]])], names=["u", "v"])

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long")


def group_sets(keyed: DataFrame, least: Column, how: Search) -> DataFrame:
    """``key, least`` for each distinct shingle set: the minimum of ``least`` over its group."""
    classes = keyed.groupBy("key").agg(F.min(least).alias("own"), F.min(F.struct("rid", "n", "hi", "lo")).alias("x"))
    classes = materialize(classes.select("key", "own", "x.*"), "classes")
    clusters = candidate_clusters(classes.where("n > 0").select("rid", "hi", "lo"), how)
    members = keyed.select("rid", "n", "body").join(small_side(clusters), "rid")
    links = components(verified_links(members, how)).withColumnRenamed("v", "rid")
    labelled = classes.join(links, "rid", "left").select("key", "own", F.coalesce("component", "rid").alias("label"))
    groups = labelled.groupBy("label").agg(F.min("own").alias("least"))
    return labelled.join(groups, "label").select("key", "least")


def drop_similar(docs: DataFrame, how: Search | None = None) -> DataFrame:
    """One document of each group linked by the least similarity or more; same columns.

    The one with the least doc_id stays (nulls last, then repeated rows in any order: they
    are equal in what counts).  Nothing is dropped without a chain of verified links.
    Defined cases: null, empty and wordless texts have the empty set and are one class; a
    text with fewer words than a shingle is one shingle; very long texts count whole; an
    empty table gives an empty result; other columns may have any names.
    """
    how = how or Search()
    keyed = docs.select(F.struct(*own_columns(docs)).alias("row"), F.col("text").alias("body"))
    keyed = with_prints(keyed, "body", how.size).select("row", "key", "n", "hi", "lo", F.monotonically_increasing_id().alias("rid"))
    keyed = materialize(keyed, "keyed").withColumn("body", F.col("row.text"))
    order = F.struct(F.col("row.doc_id").isNull().alias("a"), F.col("row.doc_id").alias("b"), F.col("rid").alias("rid"))
    groups = group_sets(keyed, order, how).select("key", F.col("least.rid").alias("first"))
    # the rows that go are few or many; those that stay need not move in the first case
    gone = materialize(keyed.select("key", "rid").join(groups, "key").where("rid <> first").select("rid"), "dropped")
    return keyed.join(small_side(gone), "rid", "left_anti").select("row.*")
