"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated by a fixed random orthogonal matrix and split into ``BLOCKS``
blocks of coordinates.  Cosine >= c is squared distance <= 2 - 2c, so in at least one block
the squared distance is at most that block's proportional share.  Each block is range-joined
under this share, on two levels that use one bound:

* A block's space is cut into the Voronoi cells of pivots, one for each ``CELL`` vectors,
  fitted on a bounded sample.  Every vector has a home cell, and visits each cell of higher
  number whose bounding half-space its ball reaches; (block, cell) is an equi-join key.
* Inside a task the same is done with finer cells of the task's own vectors, so that most
  pairs of a coarse cell are never compared.

What is compared and lies within the block's share is a candidate.  A pair found in several
blocks belongs to the first one, so the union of candidates needs no pair table; it is then
verified by the exact cosine.  Every task reports link counts per vector and a spanning
forest, never the pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components
from ._shared import join_labels, materialize, quoted, whole_runs

BLOCKS = 4
#: Vectors of one coarse cell that are compared in one task; larger cells are dealt in pairs of parts.
CELL = 32_768
#: Bounds of the fit: pivots per block, and vectors of the sample per pivot.
MAX_PIVOTS = 4096
PER_PIVOT = 16
#: Vectors of one fine cell, and the most fine cells of a task.
FINE, MAX_FINE = 64, 1024
TILE = 16_384
SEED = 7


def rotation(dim: int) -> np.ndarray:
    """The fixed orthogonal matrix for a dimension."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision; rows must be finite and not zero."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * x[:, j]
    return x / np.sqrt(total)[:, None]


def rotate(x: np.ndarray) -> np.ndarray:
    """Rotated rows; each value depends on its own row alone, bit for bit."""
    turn, z = rotation(x.shape[1]), np.zeros_like(x)
    for j in range(x.shape[1]):
        z += x[:, j : j + 1] * turn[j]
    return z


def block_edges(dim: int) -> list[int]:
    blocks = min(BLOCKS, dim)
    return [dim * b // blocks for b in range(blocks + 1)]


def _shares(dim: int, cosine: float) -> list[float]:
    edges = block_edges(dim)
    whole = max(2 - 2 * cosine, 0.0)
    return [whole * (hi - lo) / dim * (1 + 1e-9) + 1e-12 for lo, hi in zip(edges, edges[1:], strict=False)]


def _stack(column, dim: int) -> np.ndarray:
    """A (rows, dim) array from an Arrow column of lists of equal length without nulls."""
    values = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def valid_vector(vector: Column) -> Column:
    """The vector, or null if it links with nothing: null, empty, zero, or with a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite & F.exists(vector, lambda x: x != 0), vector)


def fit_pivots(sample: np.ndarray, n: int, rounds: int = 3) -> np.ndarray:
    """``n`` centres of the sample's rows: spread rows of it, moved to their cells' means."""
    pivots = sample[np.linspace(0, len(sample) - 1, n).astype(np.int64)]
    for _ in range(rounds if n > 1 else 0):
        home = np.concatenate([_distances(part, pivots).argmin(axis=1) for part in np.array_split(sample, -(-len(sample) // 4096))])
        order = np.argsort(home, kind="stable")
        filled, first = np.unique(home[order], return_index=True)
        pivots = pivots.copy()
        pivots[filled] = np.add.reduceat(sample[order], first, axis=0) / np.diff(np.r_[first, len(home)])[:, None]
    return pivots


def _distances(z: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Squared distances (rows, pivots)."""
    return (z * z).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (z @ pivots.T)


def homes_and_visits(z: np.ndarray, pivots: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest pivot, and which pivots' cells its ball of squared radius ``share`` reaches.

    A row of cell j is no nearer to pivot h than to pivot j.  If it is within the radius of
    a row at home with h, that row's distance to the bisector of h and j is at most the
    radius, which is the bound that is tested.  The own cell is always reached.
    """
    apart = np.sqrt(np.maximum(_distances(pivots, pivots), 0))
    far = _distances(z, pivots)
    home = far.argmin(axis=1)
    row = np.arange(len(z))
    reach = far - far[row, home][:, None] <= 2 * np.sqrt(share) * apart[home] + 1e-6
    reach[row, home] = True
    return home, reach


def _pivots(classes: DataFrame, cosine: float, cell: int) -> dict[int, list[np.ndarray]]:
    """Pivots per block for each dimension with more than ``cell`` vectors, from a bounded sample."""
    found: dict[int, list[np.ndarray]] = {}
    for row in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).orderBy("dim").collect():
        dim, n = row["dim"], min(MAX_PIVOTS, -(-row["n"] // cell))
        draw = F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) / float(1 << 30)
        some = classes.where(F.col("dim") == dim).where(draw <= 2 * n * PER_PIVOT / row["n"])
        taken = some.orderBy(F.xxhash64("vec")).limit(n * PER_PIVOT).select("vec").toArrow()
        if taken.num_rows < n:
            continue
        z, edges = rotate(unit(_stack(taken["vec"], dim))), block_edges(dim)
        found[dim] = [fit_pivots(z[:, lo:hi], n) for lo, hi in zip(edges, edges[1:], strict=False)]
    return found


def _cells(classes: DataFrame, cosine: float, pivots: dict[int, list[np.ndarray]]) -> DataFrame:
    """Each vector once per block at home and once per higher cell that its ball reaches."""

    def deal(vec, cid, n, dim):
        import pyarrow as pa

        z = rotate(unit(_stack(vec, dim)))
        edges, shares = block_edges(dim), _shares(dim, cosine)
        for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            if dim in pivots:
                home, reach = homes_and_visits(z[:, lo:hi], pivots[dim][b], shares[b])
                reach &= np.arange(reach.shape[1])[None, :] >= home[:, None]
                row, code = np.nonzero(reach)
                here = code == home[row]
            else:
                row, code, here = np.arange(len(z)), np.zeros(len(z), np.int64), np.ones(len(z), bool)
            yield pa.RecordBatch.from_arrays(
                [
                    vec.take(pa.array(row)),
                    pa.array(cid[row]),
                    pa.array(n[row]),
                    pa.array(np.full(len(row), dim, np.int32)),
                    pa.array(np.full(len(row), b, np.int32)),
                    pa.array(code),
                    pa.array(here),
                ],
                names=["vec", "cid", "n", "dim", "b", "cell", "home"],
            )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                for lo in range(0, own.num_rows, 2048):
                    part = own.slice(lo, 2048)
                    yield from deal(part.column(0), part.column(1).to_numpy(), part.column(2).to_numpy(), int(dim))

    kind = classes.schema["vec"].dataType.simpleString()
    return classes.select("vec", "cid", "n", "dim").mapInArrow(
        run, f"vec {kind}, cid long, n long, dim int, b int, cell long, home boolean"
    )


def _owned(zp, zh, edges, shares, b) -> np.ndarray:
    """Pairs whose first block within its share is ``b``."""
    own = np.ones(len(zp), bool)
    for k in range(b + 1):
        total = np.zeros(len(zp))
        for j in range(edges[k], edges[k + 1]):
            gap = zp[:, j] - zh[:, j]
            total += gap * gap
        own &= (total <= shares[k]) if k == b else (total > shares[k])
    return own


def _cell_links(vec, cid, n, host, probe, home, dim: int, b: int, cosine: float):
    """Link counts and groups inside one coarse cell: arrays (ids, counts, least linked id).

    ``host`` rows are compared with ``probe`` rows; two rows that are both at home, and so
    meet from both sides, are compared from the one with the lesser id.
    """
    ids, slot = np.unique(cid, return_inverse=True)
    count, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
    raw = _stack(vec, dim)
    edges, shares = block_edges(dim), _shares(dim, cosine)
    own = slice(edges[b], edges[b + 1])
    hosts, probes = np.flatnonzero(host), np.flatnonzero(probe)
    # hosts by fine cell
    x = unit(raw[hosts])
    z = rotate(x)
    k = min(MAX_FINE, max(1, len(hosts) // FINE))
    spread = np.argsort(cid[hosts] * np.int64(0x9E3779B97F4A7C15 - (1 << 64)), kind="stable")[: k * PER_PIVOT]
    pivots = fit_pivots(z[spread, own], k, rounds=2)
    fine = np.concatenate([_distances(z[lo : lo + TILE, own], pivots).argmin(axis=1) for lo in range(0, len(hosts), TILE)] or [np.zeros(0, np.int64)])
    order = np.argsort(fine, kind="stable")
    hosts, x, z, fine = hosts[order], x[order], z[order], fine[order]
    cuts = np.searchsorted(fine, np.arange(k + 1))
    zh = z[:, own].astype(np.float32)
    table = np.c_[-2 * zh, (zh * zh).sum(axis=1), np.ones(len(zh), np.float32)].astype(np.float32)
    for p0 in range(0, len(probes), TILE):
        p = probes[p0 : p0 + TILE]
        xp = unit(raw[p])
        zp = rotate(xp)
        _, reach = homes_and_visits(zp[:, own], pivots, shares[b])
        zs = zp[:, own].astype(np.float32)
        asked = np.c_[zs, np.ones(len(zs), np.float32), (zs * zs).sum(axis=1)].astype(np.float32)
        for c in range(k):
            lo, hi = cuts[c], cuts[c + 1]
            visiting = np.flatnonzero(reach[:, c]) if hi > lo else ()
            if not len(visiting):
                continue
            step = max(1, (1 << 22) // (hi - lo))
            for v0 in range(0, len(visiting), step):
                who = visiting[v0 : v0 + step]
                spots = np.flatnonzero(asked[who] @ table[lo:hi].T <= shares[b] + 1e-5)
                i, j = who[spots // (hi - lo)], lo + spots % (hi - lo)
                fit = (~home[p[i]] | (cid[p[i]] < cid[hosts[j]])) & (cid[p[i]] != cid[hosts[j]])
                i, j = i[fit], j[fit]
                for at in range(0, len(i), 65_536):
                    ia, ja = i[at : at + 65_536], j[at : at + 65_536]
                    mine = _owned(zp[ia], z[ja], edges, shares, b)
                    ia, ja = ia[mine], ja[mine]
                    near = np.einsum("ij,ij->i", xp[ia], x[ja]) >= cosine
                    a, h = p[ia[near]], hosts[ja[near]]
                    np.add.at(count, slot[a], n[h])
                    np.add.at(count, slot[h], n[a])
                    labels = join_labels(labels, slot[a], slot[h])
    return ids, count, labels


def vector_links(classes: DataFrame, cosine: float, cell: int = CELL) -> DataFrame:
    """``kind, a, b, n`` from distinct vectors ``cid, vec, dim, n``.

    Kind 0: vector class ``a`` has ``n`` links counted with the multiplicity of the classes
    at their other ends; kind 1: a link ``a``-``b`` of the spanning forests.
    """
    dealt = _cells(classes, cosine, _pivots(classes, cosine, cell))
    sizes = dealt.groupBy("dim", "b", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / (2 * cell)).cast("int").alias("n_home"),
        F.ceil(F.count(F.lit(1)) / (4 * cell)).cast("int").alias("n_all"),
    ).where("n_home > 0")
    rows = dealt.join(sizes, ["dim", "b", "cell"])
    at = lambda parts: F.pmod(F.xxhash64("cid"), parts).cast("int")
    place = lambda host, probe, i, j: F.struct(F.lit(host).alias("host"), F.lit(probe).alias("probe"), i.alias("i"), j.alias("j"))
    whole = F.array(F.struct(F.col("home").alias("host"), F.lit(True).alias("probe"), F.lit(0).alias("i"), F.lit(0).alias("j")))
    as_host = F.transform(F.sequence(F.lit(0), F.col("n_all") - 1), lambda x: place(True, False, at(F.col("n_home")), x))
    as_probe = F.transform(F.sequence(F.lit(0), F.col("n_home") - 1), lambda x: place(False, True, x, at(F.col("n_all"))))
    places = F.when((F.col("n_home") == 1) & (F.col("n_all") == 1), whole).when(F.col("home"), F.concat(as_host, as_probe)).otherwise(as_probe)
    rows = rows.withColumn("o", F.explode(places)).select(
        "vec", "cid", "n", "dim", "b", "home", "o.host", "o.probe", F.xxhash64("dim", "b", "cell", "o.i", "o.j").alias("g")
    )

    def run(batches):
        import pyarrow as pa

        for table in whole_runs(batches, "g", 1):
            dims, blocks = table["dim"].to_numpy(), table["b"].to_numpy()
            for dim, b in {(int(d), int(k)) for d, k in zip(dims, blocks, strict=True)}:
                own = table.filter(pa.array((dims == dim) & (blocks == b)))
                ids, count, labels = _cell_links(
                    own["vec"], *[own[c].to_numpy() for c in ("cid", "n", "host", "probe", "home")], dim, b, cosine
                )
                hit = np.flatnonzero(count)
                tied = np.flatnonzero(labels != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[np.zeros(len(hit), np.int32), np.ones(len(tied), np.int32)]),
                        pa.array(np.r_[ids[hit], ids[tied]]),
                        pa.array(np.r_[np.zeros(len(hit), np.int64), ids[labels[tied]]]),
                        pa.array(np.r_[count[hit], np.zeros(len(tied), np.int64)]),
                    ],
                    names=["kind", "a", "b", "n"],
                )

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "kind int, a long, b long, n long")


def embedding_groups(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, cell: int = CELL) -> DataFrame:
    """``<key>, n_links, component_id, kept`` for every row of ``vectors``.

    Rows link if their cosine in double precision is at least ``cosine`` (0 < cosine <= 1);
    ``n_links`` counts the other rows linked directly, ``component_id`` is the least key that
    links reach, the row itself included, and ``kept`` tells if that is the row's own key.
    Equal vectors are one class with a multiplicity, so copies are never paired.  Defined
    cases: vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do vectors of different lengths; repeated rows link with each other;
    a cosine of exactly the limit links; null keys count in n_links and are never a
    component's label; an empty table gives an empty result; other columns are not used, and
    a text column of any length is never read.
    """
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    whole = F.col(quoted(vector)) if kind in ("float", "double") else F.col(quoted(vector)).cast("array<double>")
    rows = vectors.select(F.col(quoted(key)).alias("vec_id"), valid_vector(whole).alias("vec"))
    classes = rows.where("vec is not null").groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    classes = materialize(
        classes.select("vec", "n", "least", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("cid")), "vector-classes"
    )
    links = materialize(vector_links(classes.select("vec", "n", "dim", "cid"), cosine, cell), "vector-links")
    counts = links.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("more"))
    tied = components(links.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    labelled = (
        classes.select("vec", "cid", "n", "least")
        .join(counts, "cid", "left")
        .join(tied.withColumnRenamed("v", "cid"), "cid", "left")
        .select("vec", "least", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("label"))
    )
    heads = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    known = labelled.join(heads, "label").select("vec", "n_links", "component_id")
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    done = rows.where("vec is not null").join(known, "vec").select("vec_id", "n_links", "component_id").unionAll(alone)
    return done.select(
        F.col("vec_id").alias(key),
        F.col("n_links").cast("long").alias("n_links"),
        "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = {
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id)::BIGINT AS n_links,
  min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id""",
}
QUERIES = {"op2_embedding_dedup": op2_embedding_dedup}
