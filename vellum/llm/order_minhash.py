"""Document fingerprints by Order MinHash (Marcais et al. 2019).

A text's k-mers are runs of ``k`` characters, each with the number of its earlier
occurrences, so that repeats count.  Each of the signature's hash functions selects the
``tuple_size`` least numbered k-mers, puts them back in text order, and hashes their tuple.
Two texts agree in an entry only if they share these k-mers in the same order, which makes
the share of equal entries follow the edit distance and not just the overlap.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import free_name, id_ranges, packed, quoted, unpacked

#: K-mers that are hashed at a time.
STRETCH = 1024
#: Least k-mers of so many stretches are held before they are sifted.
HELD = 256


@dataclass(frozen=True)
class OrderMinHash:
    """Parameters of a fingerprint of ``size`` entries of 8 hexadecimal digits.

    A hash function orders the k-mers by 32 bits; of equal ones the earlier is the lesser.
    """

    k: int = 8
    tuple_size: int = 2
    size: int = 64
    seed: int = 11

    @functools.cached_property
    def _mixers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per hash function a mask and an odd factor, and room for one stretch of k-mers."""
        flip, times = np.random.default_rng(self.seed).integers(0, 2**32, (2, self.size, 1), dtype=np.uint32)
        return flip, times | np.uint32(1), np.empty((self.size, STRETCH), np.uint32)

    def _kmers(self, text: str) -> np.ndarray:
        """Hashes of the occurrence-numbered k-mers, in text order."""
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        n = len(codes) - min(self.k, len(codes)) + 1 if len(codes) else 0
        base = codes[:n].copy()
        for j in range(1, min(self.k, len(codes))):
            base *= np.uint64(0x9FB21C651E98DF25)
            base += codes[j : n + j]
        base ^= base >> np.uint64(32)
        base *= np.uint64(0xD6E8FEB86659FD93)
        # one sort of hash and place together numbers the occurrences
        low = np.uint64(max(n, 1).bit_length())
        ordered = np.sort(base >> low << low | np.arange(n, dtype=np.uint64))
        place = (ordered & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        value = ordered >> low
        run = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if n else np.zeros(0, np.int64)
        nth = np.empty(n, np.uint64)
        nth[place] = np.arange(n) - np.repeat(run, np.diff(np.r_[run, n]))
        mixed = base + nth * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        return mixed ^ (mixed >> np.uint64(32))

    def _least(self, kmers: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and places of the least k-mers from ``lo`` to ``hi`` under each hash function, in text order where equal."""
        flip, times, room = self._mixers
        top, row = np.iinfo(np.uint32).max, np.arange(self.size)
        values, places = [np.zeros((self.size, 0), np.uint32)], [np.zeros((self.size, 0), np.int64)]
        for at in range(lo, hi, STRETCH):
            part = room[:, : min(STRETCH, hi - at)]
            np.bitwise_xor(kmers[at : at + part.shape[1]].astype(np.uint32)[None], flip, out=part)
            np.multiply(part, times, out=part)
            for again in range(min(self.tuple_size, part.shape[1])):
                if again:
                    part[row, spot] = top
                spot = part.argmin(axis=1)
                values.append(part[row, spot][:, None])
                places.append((spot + at)[:, None])
            if len(values) > HELD:
                found = self._lesser(np.concatenate(values, axis=1), np.concatenate(places, axis=1))
                values, places = [found[0]], [found[1]]
        return np.concatenate(values, axis=1), np.concatenate(places, axis=1)

    def _lesser(self, values: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``tuple_size`` least of each row; of equal ones the first."""
        order = np.argsort(values, axis=1, kind="stable")[:, : self.tuple_size]
        return np.take_along_axis(values, order, axis=1), np.take_along_axis(places, order, axis=1)

    def _entries(self, kmers: np.ndarray, *least: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The signature of k-mers whose least ones are among those of these stretches."""
        if not len(kmers):
            return np.zeros(0, np.uint32)
        _, where = self._lesser(*[np.concatenate(x, axis=1) for x in zip(*least, strict=True)])
        chosen = kmers[np.sort(where, axis=1)]
        out = np.full(self.size, np.uint64(chosen.shape[1]))
        for j in range(chosen.shape[1]):
            out = (out ^ chosen[:, j]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(29)
        return (out >> np.uint64(16)).astype(np.uint32)

    def signature(self, text: str | None) -> np.ndarray:
        """``size`` unsigned 32-bit entries; none for a null or empty text."""
        kmers = self._kmers(text or "")
        return self._entries(kmers, self._least(kmers, 0, len(kmers)))

    def begun(self, text: str, alike: int) -> tuple[np.ndarray, tuple]:
        """A text's signature, and what ``resumed`` takes of its first ``alike`` characters."""
        kmers = self._kmers(text)
        common = max(alike - self.k + 1, 0)
        first = self._least(kmers, 0, common)
        return self._entries(kmers, first, self._least(kmers, common, len(kmers))), (common, first)

    def resumed(self, text: str, start: tuple) -> np.ndarray:
        """The signature of a text that begins with the characters that ``start`` stands for."""
        common, first = start
        kmers = self._kmers(text)
        return self._entries(kmers, first, self._least(kmers, common, len(kmers)))


def spelled(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries; two empty texts are alike, an empty and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float(np.mean(a == b))


def fingerprint_texts(docs: DataFrame, text: str = "text", out: str = "fingerprint", how: OrderMinHash | None = None) -> DataFrame:
    """Adds the fingerprint of a text column as ``out``; all other columns stay.

    Defined cases: null and empty texts have an empty fingerprint; a text shorter than a
    k-mer is one; very long texts and unbroken ones are taken whole; an older column of the
    name ``out`` is replaced; equal texts have equal fingerprints; an empty table gives an
    empty result.
    """
    how = how or OrderMinHash()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spelled(how.signature(t)) for t in texts], pa.string())], names=["row", "made"])

    source = free_name(docs, "own text")
    rows = packed(docs.withColumn(source, F.col(quoted(text))), source, without=(source, out))
    found = rows.mapInArrow(run, rows.select("row").schema.add("made", "string"))
    return found.select(*unpacked(rows), F.col("made").alias(out))


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def kept_chars(text: str) -> int:
    """How many of a text's first code points an edit leaves."""
    return len(text) - len(text) // 2


def edited_text(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the next text's first."""
    return text[: kept_chars(text)] + following[: len(text) // 2]


def compare_with_edit(docs: DataFrame, how: OrderMinHash | None = None, range_rows: int = 4000) -> DataFrame:
    """Fingerprints of each text and of its edit with the next document's start.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.  The next document follows by ascending doc_id (null first), then hash of
    the text; the last is followed by the first, a single one by itself.  Documents are dealt
    once into ranges of doc_id; each range also gets the first document of the next range, so
    a task streams its sorted rows with one document in hand.  Defined cases: null text is
    empty; empty text has an empty fingerprint; repeated rows follow each other; very long
    texts are taken whole; an empty table gives an empty result; columns other than doc_id
    and text are not used.  The half that a text shares with its edit is hashed once.
    """
    how = how or OrderMinHash()
    spark = docs.sparkSession
    dealt = id_ranges(docs, range_rows)
    # the first document of each range: its doc_id and hash, then the least text with these
    first_ids = dealt.groupBy("range").agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("head")
    )
    starts = sorted(first_ids.select("range", "head.doc_id", "head.h").collect(), key=lambda r: r["range"])
    if not starts:
        return spark.createDataFrame([], COMPARED)
    before = spark.createDataFrame(
        [(r["range"], r["doc_id"], r["h"], starts[i - 1]["range"]) for i, r in enumerate(starts)], "at int, head_id long, head_h long, previous int"
    )
    heads = (
        # bounded: one row of four numbers per range, and ranges are bounded
        dealt.join(F.broadcast(before), (F.col("range") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h")))
        .groupBy("previous")
        .agg(F.min("text").alias("text"))
        .select(F.col("previous").alias("range"), F.lit(1).alias("closing"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("h"), "text")
    )
    rows = dealt.select("range", F.lit(0).alias("closing"), "doc_id", "h", "text").unionAll(heads)
    rows = rows.repartition("range").sortWithinPartitions("range", "closing", "doc_id", "h", "text").select("range", "closing", "doc_id", "text")

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = None
        for batch in batches:
            out = []
            for closing, doc, text in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                own, start = how.begun(text, kept_chars(text))
                if held:
                    edit = edited_text(held[1], text)
                    print_ = how.resumed(edit, held[3])
                    out.append(
                        (
                            held[0],
                            len(held[1]),
                            hashlib.sha256(edit.encode()).hexdigest(),
                            spelled(held[2]),
                            spelled(print_),
                            likeness(held[2], print_),
                            likeness(held[2], own),
                        )
                    )
                held = None if closing else (doc, text, own, start)
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, COMPARED)


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op4_order_minhash": op4_order_minhash}
