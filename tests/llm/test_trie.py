"""The prefix trie against a plain one, with every level heavy, none, and some."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from vellum.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, label string, size string"


def naive(rows):
    """Node rows by the contract, from ``(conv_id, turn, role, text)``."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            order = (turn is not None, turn or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest())
            own[c].append((order, role, text))
    own = {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted(
        (
            cs[0], len(node), members[node[:-1]][0] if node else None, len(cs), len(children[node]), leaves[node], saved[node],
            hashlib.sha256(",".join(str(c) for c in cs if whole[c] == node).encode()).hexdigest(),
        )
        for node, cs in members.items()
    )


def random_rows(seed, convs=40, longest=14):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(60), convs):
        rows += [(c, t if t or rng.random() < 0.7 else None, rng.choice(["user", "user", None]), rng.choice(["a", "é b", "", None])) for t in range(rng.randrange(1, longest))]
    rows += [rows[0], rows[0], (None, 1, "user", "left out"), (61, None, None, None), (62, 5, "", ""), (9**17 + 4, 1, "user", "a")]
    rows += [(63, t % 7, "user", "same") for t in range(300)]
    return rows


def found(frame):
    return sorted(tuple(r[c] for c in trie.COLUMNS) for r in frame.collect())


@pytest.mark.parametrize("seed, heavy, chunk", [(1, 4096, 1), (2, 60, 50), (3, 8, 1 << 16), (4, 0, 1)])
def test_trie_is_the_plain_one(spark, seed, heavy, chunk):
    rows = random_rows(seed)
    data = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    assert found(trie.conversation_trie(data, heavy, chunk)) == naive(rows)


def test_stretches_of_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 8)
    rows = [(c, t, "user", f"{t % 3}") for c in (5, 6, 7) for t in range(60 + c)]
    data = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    assert found(trie.conversation_trie(data, 40)) == naive(rows)


def test_empty_table(spark):
    assert found(trie.conversation_trie(spark.createDataFrame([], SCHEMA))) == []


def test_query(spark, sf_dir):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert found(trie.op12_prefix_trie(spark, sf_dir)) == naive(rows)


def test_stored_tries_hold_their_nodes(spark):
    rows = random_rows(5)
    data = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    _, tries = trie.prefix_trie(trie.rebuilt(data), 30, 40)
    for r in tries.collect():
        n = len(r.nodes)
        bits = np.unpackbits(np.frombuffer(r.louds, np.uint8))[: 2 * n + 1]
        above = trie.parents(bits)
        assert len(above) == n and [x.top for x in r.nodes] == (above == 0).tolist()
        assert np.bincount(above, minlength=n + 1)[1:].tolist() == [x.n_children for x in r.nodes]
        for x, p in zip(r.nodes, above.tolist(), strict=True):
            if p:
                assert (x.parent_conv_id, x.depth) == (r.nodes[p - 1].conv_id, r.nodes[p - 1].depth + 1)
