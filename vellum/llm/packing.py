"""Best-fit packing of documents into fixed-length sequences.

Only the number of pieces of each length, at most ``capacity`` numbers, decides the packing.
On that instance Martello-Toth dominance fixes small sets that are at least as good as any
other set with the same longest piece: an exact complement, a piece that nothing fits
beside, or the longest fitting partner where no two partners could fill the gap better.
What is left is packed best-fit decreasing, sequences of equal free space together.  Every
piece then finds its sequence from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize
from ._tokens import encoder, vocabulary

#: Pieces of one part of a length class: ranking never meets a whole class in one task.
PART = 8192


class _Instance:
    """Counts of pieces by length, and the placements made so far."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = [0] * (capacity + 1)
        for size, n in counts.items():
            self.left[size] = n
        self.rank = [0] * (capacity + 1)
        self.sequences = 0
        #: (length, first rank, pieces per sequence, first sequence, offset)
        self.placed: list[tuple[int, int, int, int, int]] = []

    def place(self, size: int, sequences: int, each: int, first: int, offset: int) -> None:
        self.placed.append((size, self.rank[size], each, first, offset))
        self.rank[size] += sequences * each
        self.left[size] -= sequences * each

    def new(self, sequences: int) -> int:
        first, self.sequences = self.sequences, self.sequences + sequences
        return first

    def fix(self, sizes: list[int], sequences: int) -> None:
        first, offset = self.new(sequences), 0
        for size in sizes:
            self.place(size, sequences, 1, first, offset)
            offset += size


def _least(left: list[int], n: int) -> list[int]:
    """The lengths of the ``n`` shortest pieces."""
    found: list[int] = []
    for size, count in enumerate(left):
        if count:
            found += [size] * min(count, n - len(found))
            if len(found) == n:
                break
    return found


def _best_pair(left: list[int], room: int) -> int:
    """The greatest sum of two pieces that is at most ``room``; 0 if there is none."""
    sizes = [s for s in range(1, room) if left[s]]
    best, lo, hi = 0, 0, len(sizes) - 1
    while lo <= hi:
        total = sizes[lo] + sizes[hi]
        if total > room or (lo == hi and left[sizes[lo]] < 2):
            hi -= 1
            continue
        best = max(best, total)
        lo += 1
    return best


def _reduce(x: _Instance) -> None:
    """Fix every set that dominates all others with the same piece, until none is left."""
    changed = True
    while changed:
        changed = False
        for size in range(x.capacity, 0, -1):
            while x.left[size]:
                room = x.capacity - size
                x.left[size] -= 1  # the piece itself is no partner
                short = _least(x.left, 3)
                partner = next((s for s in range(room, 0, -1) if x.left[s]), 0)
                two, three = sum(short[:2]), sum(short)
                lone = not partner
                exact = partner == room
                single = partner and (len(short) < 2 or two > room)
                double = partner and not single and (len(short) < 3 or three > room) and partner >= _best_pair(x.left, room)
                x.left[size] += 1
                if lone:
                    x.fix([size], x.left[size] if not short or short[0] > room else 1)
                elif exact or single or double:
                    n = x.left[size] // 2 if partner == size else min(x.left[size], x.left[partner])
                    x.fix([size, partner], n)
                else:
                    break
                changed = True


def _best_fit(x: _Instance) -> None:
    """Best-fit decreasing; sequences with equal free space are handled as one group."""
    free: list[list[tuple[int, int]]] = [[] for _ in range(x.capacity + 1)]
    for size in range(x.capacity, 0, -1):
        for room in range(size, x.capacity + 1):
            if not x.left[size]:
                break
            groups, free[room] = free[room], []
            for first, n in groups:
                each = room // size
                full = min(n, x.left[size] // each)
                if full:
                    x.place(size, full, each, first, x.capacity - room)
                    free[room - each * size].append((first, full))
                if full < n and x.left[size] and x.left[size] < each:
                    some = x.left[size]
                    x.place(size, 1, some, first + full, x.capacity - room)
                    free[room - some * size].append((first + full, 1))
                    full += 1
                if full < n:
                    free[room].append((first + full, n - full))
        if x.left[size]:
            each = x.capacity // size
            full, some = divmod(x.left[size], each)
            if full:
                first = x.new(full)
                x.place(size, full, each, first, 0)
                free[x.capacity - each * size].append((first, full))
            if some:
                first = x.new(1)
                x.place(size, 1, some, first, 0)
                free[x.capacity - some * size].append((first, 1))


def plan_sequences(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Placements for ``counts`` pieces of each length, and the number of sequences.

    Rows: length, first rank, pieces per sequence, first sequence, offset; sorted.
    """
    x = _Instance(counts, capacity)
    _reduce(x)
    _best_fit(x)
    return np.array(sorted(x.placed), dtype=np.int64).reshape(-1, 5), x.sequences


def narrowed(ids: bytes) -> bytes:
    """Two bytes for each of the ids, of four bytes, if all fit."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if wide.max(initial=0) < 1 << 16 else ids


def widened(ids, length: np.ndarray):
    """An Arrow column of narrowed ids with four bytes for each; ``length`` has their numbers."""
    import pyarrow as pa

    some = ids.cast(pa.binary())
    ends = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1]
    if (np.diff(ends) == 2 * length).all():
        data = np.frombuffer(some.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u2").astype("<u4")
        wide = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((ends - ends[0]) * 2), pa.py_buffer(data)])
    else:
        wide = pa.array(
            [x if len(x) == 4 * n else np.frombuffer(x, "<u2").astype("<u4").tobytes() for x, n in zip(some.to_pylist(), length, strict=True)],
            pa.binary(),
        )
    return wide.cast(ids.type)


def cut_documents(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int, ids: bool, keep: bool = True) -> DataFrame:
    """``row_id, doc_id, piece, start, length, ids_crc32`` (and ``ids``): the encoded pieces.

    ``ids`` are on their way here: two bytes each where all of a piece fit, else four.
    ``widened`` gives them four again.  Without ``keep`` the encoder's chunks are dropped
    after each task.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa

        code = encoder(vocabulary_path)
        try:
            yield from pieces(code, batches)
        finally:
            if not keep:
                code.forget()
                pa.default_memory_pool().release_unused()

    def pieces(code, batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                rows = []
                for doc, at, own in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), code.encode(some.column(1).to_pylist()), strict=True):
                    own += end
                    n = len(own) // 4
                    starts = [0, *range(n % capacity or capacity, n, capacity)]
                    for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        part = own[4 * a : 4 * b]
                        rows.append((at, doc, piece, a, b - a, zlib.crc32(part), narrowed(part) if ids else None))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["row_id", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                use = 7 if ids else 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns[:use], kinds[:use], strict=True)], names=names[:use]
                )

    schema = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else "")
    return docs.select("doc_id", "text", "row_id").mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, vocabulary_path: str, end_id: int = 0, capacity: int = 2048, ids: bool = True, keep: bool = True
) -> DataFrame:
    """Every piece with its place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, row_id``.

    With ``ids`` the pieces carry their ids as little-endian unsigned 32-bit numbers: ordered
    by ``sequence_id, offset`` they are the sequences.  ``row_id`` tells the rows of ``docs``
    apart, also where a doc_id repeats.  Without ``keep`` a worker, which Spark uses again for
    other stages, holds no encoded chunks beyond a task: less memory for more time.  A document longer than ``capacity`` is cut into
    pieces of ``capacity`` of which the first may be shorter.  Only the counts per length (at
    most ``capacity`` rows) reach the driver.  Defined cases: null and empty texts are a piece
    with only the end id; repeated rows and null doc_ids are pieces of their own, dealt like
    any others; very long texts are encoded and cut whole; an empty table gives an empty
    result; columns other than doc_id and text are not used.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_id"))
    pieces = materialize(cut_documents(rows, vocabulary_path, end_id, capacity, ids, keep), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, _ = plan_sequences(counts, capacity)

    # at most capacity entries
    parts = F.create_map(*[F.lit(x) for size, n in sorted(counts.items()) for x in (size, -(-n // PART))]) if counts else F.create_map(F.lit(0), F.lit(1))
    part = F.pmod(F.xxhash64("row_id", "piece"), F.element_at(parts, F.col("length").cast("int"))).cast("int")
    pieces = pieces.withColumn("part", part)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("length", "part").orderBy("row_id", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["length", "part"])
    ranked = ranked.withColumn("rank", (F.col("rank") + F.col("ahead")).cast("long")).drop("part", "ahead")
    keys = plan[:, 0] << 48 | plan[:, 1]

    def run(batches):
        import pyarrow as pa

        some = max(1, min(1000, (1 << 28) // capacity))
        for batch in (b.slice(lo, some) for b in batches for lo in range(0, b.num_rows, some)):
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            turn = rank - row[:, 1]
            kept = [i for i, n in enumerate(batch.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[widened(batch.column(i), length) if batch.schema.names[i] == "ids" else batch.column(i) for i in kept],
                    pa.array(row[:, 3] + turn // row[:, 2]),
                    pa.array(row[:, 4] + turn % row[:, 2] * length),
                ],
                names=[*[batch.schema.names[i] for i in kept], "sequence_id", "offset"],
            )

    rest = ranked.drop("rank").schema
    placed = ranked.mapInArrow(run, rest.add("sequence_id", "long").add("offset", "long"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else []), "sequence_id", "offset", "row_id"]
    return placed.select(*names)


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


SQL: dict[str, str] = {}
QUERIES = {"op10_pack_sequences": op10_pack_sequences}
