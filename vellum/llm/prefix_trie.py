"""The trie of conversation prefixes, as succinct level-order tries.

A node is a distinct sequence of first turns.  Nodes whose subtrees hold few rows are cut off
as shards; several of these together become one level-order trie: a LOUDS bit vector (for
each node, level by level, a one per child and a zero) with arrays of labels and values.
Subtree sums go up it in reverse breadth-first order.  The heavy upper levels are merged
apart, as grouped rows: every node's own value lies with its smallest member, each member adds
up what lies with it from there downwards, and a node's subtree sum is the sum over its members.

A prefix is known by its depth and the exclusive or of a 128-bit hash of each turn at its
place, so that prefixes of one conversation are made wherever its turns lie.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, whole_runs

#: Rows below a node from which on it belongs to the upper levels.
HEAVY = 1024
#: Rows that one level-order trie is built from, at least.
CHUNK = 1 << 16
#: Depths of one stretch of a conversation, which no task exceeds.
STRETCH = 1 << 16
#: Parts into which the rows that meet one heavy node are dealt.
SPREAD = 32
NODES = (
    "depth long, top boolean, label_a long, label_b long, above_a long, above_b long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
#: One row per level-order trie: its bit vector (first the root above all shards) and its nodes by level.
TRIES = f"louds binary, nodes array<struct<{', '.join(':'.join(c.split()) for c in NODES.split(', '))}>>"
NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- turns and their prefixes --------------------------------------------------------------


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns sorted, and for each conversation and range of the sort what comes before.

    Turns ``part, conv_id, at, label, size`` follow turn (null first), role, and the hash of
    both texts; ``at`` rises in a part.  Stretches ``part, conv_id, first, before, own`` give
    the least ``at``, the earlier turns and all turns.  Equal turns are told apart by chance,
    so a range never has to hold all of them.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    label = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), label.alias("label"),
        F.octet_length(text).cast("long").alias("size"), F.rand(7).alias("chance"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "label", "chance"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = materialize(rows.select("conv_id", "at", "label", "size"), "turns").withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("part", "conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = parts.select(
        "part", "conv_id", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("conv_id")).alias("own")
    )
    return rows, materialize(stretches, "stretches")


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Every conversation with its first turns taken from the first of its family.

    Conversation c takes the first h turns of conversation c - c % family, and its own turns
    after its first h; h is the CRC-32 of its decimal id modulo ``most``.  Returns ``part,
    conv_id, length, depth, label, size``: one row per turn, and one of depth 0 for each.
    """
    turns, stretches = ordered_turns(conversations)
    heads = stretches.where((F.col("conv_id") % family == 0) & (F.col("before") < most))
    place = F.col("at") - F.col("first") + F.col("before") + 1
    heads = turns.join(heads, ["part", "conv_id"]).select(F.col("conv_id").alias("family"), place.alias("depth"), "label", "size").where(F.col("depth") < most)
    heads = heads.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("depth", "label", "size"))).alias("head"))  # fewer than ``most`` of each
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = stretches.withColumns({"h": taken, "family": F.col("conv_id") - F.col("conv_id") % family}).join(heads, "family", "left")
    own = own.withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<depth:bigint,label:binary,size:bigint>>")), F.lit(1), F.col("h").cast("int")))
    own = own.withColumn("length", F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    own = materialize(own.select("part", "conv_id", "first", "before", "h", "length", "head"), "spliced")
    root = F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("label"), F.lit(0).cast("long").alias("size")))
    # a conversation's root and the turns that it takes over are a part of their own
    firsts = own.where("before = 0").select(F.lit(-1).cast("long").alias("part"), "conv_id", "length", F.inline(F.concat(root, "head")))
    rest = turns.join(own, ["part", "conv_id"]).where(place > F.col("h"))
    return firsts.unionByName(rest.select("part", "conv_id", "length", (place - F.col("h") + F.size("head")).alias("depth"), "label", "size"))


def prefix_rows(turns: DataFrame) -> DataFrame:
    """Adds the keys of each turn's prefix, ``a, b``, and of the prefix above it.

    Takes ``part, conv_id, length, depth, label, size``; a part is a stretch of one
    conversation that a task can hold.  Keys are summed inside parts, then over parts.
    """
    lane = lambda *c: F.when(F.col("depth") > 0, F.xxhash64(*c)).otherwise(F.lit(0).cast("long"))
    rows = turns.select("part", "conv_id", "length", "depth", "size", lane("depth", "label").alias("xa"), lane("label", F.lit(1), "depth").alias("xb"))
    rows = materialize(rows, "hashed")
    sums = rows.groupBy("part", "conv_id").agg(F.bit_xor("xa").alias("sa"), F.bit_xor("xb").alias("sb"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", "conv_id", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("sa", "sb")])
    inside = Window.partitionBy("part", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"a": F.bit_xor("xa").over(inside), "b": F.bit_xor("xb").over(inside)}).join(sums, ["part", "conv_id"])
    key = {c: F.col(c).bitwiseXOR(F.col(f"s{c}")) for c in ("a", "b")}
    above = {c: F.when(F.col("depth") > 0, key[c].bitwiseXOR(F.col(f"x{c}"))) for c in key}
    return rows.select("part", "conv_id", "length", "depth", "size", *[key[c].alias(c) for c in key], *[above[c].alias(f"above_{c}") for c in key])


# --- shards --------------------------------------------------------------------------------


def spread_join(rows: DataFrame, side: DataFrame, on: dict[str, str], by: str, how: str) -> DataFrame:
    """Join rows, of which many may meet one row of ``side``: these are dealt into ``SPREAD`` parts.

    ``on`` gives the column of ``rows`` for each key of ``side``; the keys of ``side`` go.
    """
    side = side.select("*", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_part"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int"))
    keys = [rows[r].eqNullSafe(side[s]) for s, r in on.items()]
    return rows.join(side, [rows["_own"] == side["_part"], *keys], how).drop(*[side[s] for s in on], "_own", "_part")


def cut_shards(rows: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Adds ``top``, the node (depth, a, b) whose shard a row belongs to; null above the shards.

    Looked at are the depths 0, 1, 2, 4, ... and all multiples of ``STRETCH``.  A
    conversation's shard starts at the first of these at which no more than ``heavy`` rows lie
    in the subtree, wherever its turns lie.
    """
    depth = F.col("depth")
    looked = rows.where((depth.bitwiseAND(depth - 1) == 0) | (depth % STRETCH == 0))
    laden = looked.groupBy("depth", "a", "b").agg(F.sum(F.col("length") - depth + 1).alias("below")).where(F.col("below") > heavy)
    laden = laden.select(F.col("depth").alias("at"), F.col("a").alias("ka"), F.col("b").alias("kb"), F.lit(True).alias("laden"))
    seen = spread_join(looked, laden, {"at": "depth", "ka": "a", "kb": "b"}, "conv_id", "left")
    tops = seen.groupBy("conv_id").agg(F.min(F.when(F.col("laden").isNull(), F.struct("depth", "a", "b"))).alias("top"))
    parts = rows.select("part", "conv_id").distinct().join(tops, "conv_id")
    return rows.join(parts, ["part", "conv_id"]).withColumn("top", F.when(F.col("depth") >= F.col("top.depth"), F.col("top")))


def louds(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bit vector of a level-order trie, and each node's number of children.

    ``parent`` has the number of each node's parent, 0 for the root above all, which is not
    itself listed; nodes are numbered from 1 by level, and brothers follow each other.
    """
    children = np.bincount(parent, minlength=len(parent) + 1)
    bits = np.ones(2 * len(parent) + 1, np.uint8)
    bits[np.cumsum(children) + np.arange(len(children))] = 0
    return bits, children


def parents(bits: np.ndarray) -> np.ndarray:
    """Each node's parent, read from the bit vector: the zeros before the node's one."""
    return np.flatnonzero(bits) - np.arange(int(bits.sum()))


def _level_order(level: np.ndarray, above: np.ndarray, keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, list[int]]:
    """Numbers from 0 by level, parent and key; and where each level starts."""
    by_level = np.argsort(level, kind="stable")
    starts = np.searchsorted(level[by_level], np.arange(int(level[by_level[-1]]) + 2)).tolist()
    number = np.empty(len(level), np.int64)
    for lo, hi in zip(starts, starts[1:], strict=False):
        own = by_level[lo:hi]
        parent = number[above[own]] if lo else np.zeros(len(own), np.int64)
        number[own[np.lexsort((*(k[own] for k in keys), parent))]] = np.arange(lo, hi)
    return number, starts


def build_trie(rows) -> tuple[bytes, dict[str, np.ndarray]]:
    """A level-order trie of whole shards, from an Arrow table sorted by shard, conversation and depth."""
    col = {c: rows[c].to_numpy() for c in ("top_depth", "conv_id", "length", "depth", "size", "a", "b")}
    conv, depth, a, b = (col[c] for c in ("conv_id", "depth", "a", "b"))
    order = np.lexsort((conv, b, a, depth))
    fresh = np.r_[True, (np.diff(depth[order]) != 0) | (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)]
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(fresh) - 1
    head = order[fresh]  # each node's row of its smallest member
    level = (depth - col["top_depth"])[head]
    number, starts = _level_order(level, np.where(level > 0, node[head - 1], 0), (b[head], a[head]))
    head = head[np.argsort(number)]
    at = number[node]
    bits, children = louds(np.where(level[np.argsort(number)] > 0, at[head - 1] + 1, 0))
    above, n_children = parents(bits), children[1:]
    members = np.bincount(at, minlength=len(head))
    leaves, saved = (n_children == 0).astype(np.int64), (members - 1) * col["size"][head]
    for lo, hi in reversed(list(zip(starts[1:], starts[2:], strict=False))):
        for sums in (leaves, saved):
            np.add.at(sums, above[lo:hi] - 1, sums[lo:hi])
    ends = np.full(len(head), NO_ENDS, object)
    last = np.flatnonzero(depth == col["length"])
    last = last[np.lexsort((conv[last], at[last]))]
    for own in np.split(last, np.flatnonzero(np.diff(at[last])) + 1) if len(last) else []:
        ends[at[own[0]]] = hashlib.sha256(",".join(map(str, conv[own].tolist())).encode()).hexdigest()
    top = above == 0
    up = {c: rows[f"above_{c}"].fill_null(0).to_numpy()[head] for c in "ab"}
    nodes = {
        "depth": depth[head], "top": top, "label_a": a[head] ^ up["a"], "label_b": b[head] ^ up["b"], "above_a": up["a"], "above_b": up["b"],
        "conv_id": conv[head], "parent_conv_id": np.where(top, 0, conv[head][np.maximum(above - 1, 0)]),
        "n_convs": members, "n_children": n_children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends,
    }
    return np.packbits(bits).tobytes(), nodes


def shard_tries(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The shards' level-order tries, one row of ``TRIES`` for each run of whole shards.

    Hashes deal the shards to tasks; a task holds one run of them at a time.
    """
    rows = rows.where("top IS NOT NULL").select(
        F.col("top.a").alias("shard"), F.col("top.b").alias("shard_b"), F.col("top.depth").alias("top_depth"),
        "conv_id", "length", "depth", "size", "a", "b", "above_a", "above_b",
    )
    rows = rows.repartition("shard").sortWithinPartitions("shard", "shard_b", "top_depth", "conv_id", "depth")

    def run(batches):
        import pyarrow as pa

        for table in whole_runs(batches, "shard", chunk):
            bits, nodes = build_trie(table)
            alone = {"above_a": ~nodes["top"], "above_b": ~nodes["top"], "parent_conv_id": nodes["top"]}
            flat = pa.StructArray.from_arrays([pa.array(v, mask=alone.get(c)) for c, v in nodes.items()], names=list(nodes))
            whole = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array([bits], pa.binary()), whole], names=["louds", "nodes"])

    return rows.mapInArrow(run, TRIES)


# --- upper levels --------------------------------------------------------------------------


def _ends(rows: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256`` of nodes at which conversations end.

    A digest takes its ids one after the other: they stream through in order, and only the
    digest's state is held.
    """
    rows = rows.where("depth = length").select("depth", "a", "b", "conv_id")
    rows = rows.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "conv_id")

    def run(batches):
        import pyarrow as pa

        def told(key, state):
            return pa.RecordBatch.from_pylist([dict(zip(("depth", "a", "b"), key, strict=True), ends_sha256=state.hexdigest())])

        key, state = None, None
        for batch in batches:
            for *own, conv in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if own == key:
                    state.update(f",{conv}".encode())
                    continue
                if key is not None:
                    yield told(key, state)
                key, state = own, hashlib.sha256(str(conv).encode())
        if key is not None:
            yield told(key, state)

    return rows.mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def _from_here_down(rows: DataFrame, values: DataFrame) -> DataFrame:
    """``depth, a, b, leaves, saved``: for each row what lies with its conversation from its depth on.

    Sums are taken inside stretches of a conversation, and over its later stretches.
    """
    zero = F.lit(0).cast("long")
    both = rows.select("conv_id", "depth", "a", "b", zero.alias("leaves"), zero.alias("saved"), F.lit(True).alias("asked"))
    both = both.unionByName(values.select("conv_id", "depth", zero.alias("a"), zero.alias("b"), "leaves", "saved", F.lit(False).alias("asked")))
    both = both.withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    whole = values.groupBy("conv_id", F.floor(F.col("depth") / STRETCH).alias("stretch")).agg(*[F.sum(c).alias(c) for c in ("leaves", "saved")])
    later = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    # a stretch without a value has later ones too
    whole = rows.select("conv_id", F.floor(F.col("depth") / STRETCH).alias("stretch")).distinct().join(whole, ["conv_id", "stretch"], "full")
    whole = whole.select("conv_id", "stretch", *[F.coalesce(F.sum(c).over(later), zero).alias(f"later_{c}") for c in ("leaves", "saved")])
    inside = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({c: F.sum(c).over(inside) for c in ("leaves", "saved")}).where("asked").join(whole, ["conv_id", "stretch"])
    return both.select("depth", "a", "b", *[(F.col(c) + F.col(f"later_{c}")).alias(c) for c in ("leaves", "saved")])


def merge_upper(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes above the shards, and the shards' top nodes with the parents they lack.

    ``rows`` are those above the shards; ``tops`` has the columns of ``NODES``.
    """
    node = ["depth", "a", "b"]
    own = rows.groupBy(*node).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"),
        F.max("above_a").alias("above_a"), F.max("above_b").alias("above_b"),
    )
    own = materialize(own, "upper")
    above = lambda df: df.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("above_a").alias("a"), F.col("above_b").alias("b"))
    children = above(own).unionByName(above(tops)).groupBy(*node).agg(F.count(F.lit(1)).alias("n_children"))
    own = own.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    values = own.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    values = values.unionByName(tops.select("conv_id", "depth", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    sums = _from_here_down(rows, values).groupBy(*node).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    found = own.join(sums, node).join(_ends(rows), node, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    shown = ["depth", "conv_id", "above_a", "above_b", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    both = found.select(*shown).unionByName(tops.select(*shown)).withColumn("up", F.col("depth") - 1)
    parent = own.select(F.col("depth").alias("pd"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    return spread_join(both, parent, {"pd": "up", "pa": "above_a", "pb": "above_b"}, "conv_id", "left")


#: The columns of a node in the order of the contract.
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(turns: DataFrame, heavy: int = HEAVY, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """All nodes of the trie, ``COLUMNS``, and the stored level-order tries of its shards.

    Takes ``part, conv_id, length, depth, label, size`` as ``rebuilt`` gives them: a row per
    turn and one of depth 0 per conversation.
    """
    rows = materialize(cut_shards(prefix_rows(turns), heavy), "prefixes")
    tries = materialize(shard_tries(rows, chunk), "tries")
    nodes = tries.select(F.inline("nodes"))
    upper = merge_upper(rows.where("top IS NULL"), nodes.where("top"))
    return nodes.where("NOT top").select(*COLUMNS).unionByName(upper.select(*COLUMNS)), tries


def conversation_trie(conversations: DataFrame, heavy: int = HEAVY, chunk: int = CHUNK) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations.

    Per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root),
    ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` of the subtree, and
    ``ends_sha256`` of the ids that end there.  Defined cases: null role or text is empty; a
    null turn comes first; turns of equal number follow role, then a hash of role and text, and
    repeated rows are turns of their own; a null conv_id names no conversation, its rows are
    left out; very long texts count whole; a conversation left without turns ends at the root;
    further columns are not used; an empty table has no node.
    """
    return prefix_trie(rebuilt(conversations), heavy, chunk)[0]


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, length(s) + 1), lambda i: [ord(s[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
  lambda v, x: CASE WHEN xor(v, x) & 1 = 1 THEN xor(xor(v, x) >> 1, 3988292384) ELSE xor(v, x) >> 1 END), 4294967295)"""
_SQL = f"""WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, c::VARCHAR AS s, list({{'role': role, 'text': text}} ORDER BY n) AS t FROM o GROUP BY c), h AS (SELECT c, t, {_CRC} % 9 AS h FROM l),
w AS (SELECT h.c, list_concat(coalesce(f.t, [])[1:h.h], h.t[h.h + 1:]) AS t FROM h LEFT JOIN l AS f ON f.c = h.c - h.c % 5),
m AS (SELECT c, d, t[1:d] AS p, len(t) = d AS ended FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM w)),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256,
  (count(*) - 1) * coalesce(strlen(p[d].text), 0) AS saved FROM m GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS q, count(*) AS n_children FROM n WHERE d > 0 GROUP BY q),
r AS (SELECT v.p, sum(u.saved)::BIGINT AS saved_tokens, count(*) FILTER (k.q IS NULL) AS n_leaves FROM n AS v JOIN n AS u ON u.d >= v.d AND u.p[1:v.d] = v.p LEFT JOIN k ON k.q = u.p GROUP BY v.p)
SELECT n.conv_id, n.d AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, r.n_leaves, r.saved_tokens, n.ends_sha256
FROM n JOIN r ON r.p = n.p LEFT JOIN k ON k.q = n.p LEFT JOIN n AS a ON n.d > 0 AND a.p = n.p[1:n.d - 1]"""
SQL = {"op12_prefix_trie": _SQL}
QUERIES = {"op12_prefix_trie": op12_prefix_trie}
