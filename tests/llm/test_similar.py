"""Near-duplicates by SimHash candidates and exact similarity, against brute force over all pairs."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from vellum.llm import similar

from . import odd
from .test_sets import least_reachable


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def linked_pairs(rows):
    sets = [shingles(t) for _, t in rows]
    near = np.eye(len(rows), dtype=bool)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            near[i, j] = near[j, i] = a == b or 5 * len(a & b) >= 4 * len(a | b)
    return near


def groups(near, ids):
    return least_reachable(near, np.array(ids))


def edited(n_texts, copies, seed, most=8):
    """Texts of 60 to 200 words and copies of them with 0 to ``most`` words changed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    out = []
    for _ in range(n_texts):
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, most)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
    rng.shuffle(out)
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def check(spark, rows):
    """Found groups only join what brute force joins, and hold nearly all linked pairs."""
    near, ids = linked_pairs(rows), [i for i, _ in rows]
    want = dict(zip(ids, groups(near, ids).tolist(), strict=True))
    docs = frame(spark, rows)
    keyed = similar.with_prints(docs.withColumnRenamed("text", "body"), "body", 5).withColumn("rid", similar.F.col("doc_id"))
    found = keyed.join(similar.group_sets(keyed, similar.F.col("rid"), similar.Search()), "key")
    label = {r.doc_id: r.least for r in found.select("doc_id", "least").collect()}
    assert all(want[a] == want[b] for a, b in label.items())
    i, j = np.nonzero(np.triu(near, 1))
    caught = np.mean([label[ids[a]] == label[ids[b]] for a, b in zip(i, j, strict=True)])
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == set(label.values()) >= set(want.values())
    return caught


def test_stage_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert check(spark, rows) >= 0.9


def test_recall_on_documents():
    """Of all linked pairs of different sets at sf0.1, in groups of any size, the search lets nearly all through."""
    how, sets = similar.Search(), {}
    for text in pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist():
        own, hashes = similar.shingle_hashes(text)
        if len(own):
            sets[own.tobytes()] = own, hashes
    sets = list(sets.values())
    size = np.array([len(own) for own, _ in sets])
    _, shingle, df = np.unique(np.concatenate([own for own, _ in sets]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(size)), size)
    postings = np.split(owner[np.argsort(shingle, kind="stable")], np.cumsum(df)[:-1])
    alike = []
    for i, own in enumerate(np.split(shingle, np.cumsum(size)[:-1])):
        with_others = own[df[own] > 1]
        if len(with_others):
            shared = np.bincount(np.concatenate([postings[s] for s in with_others]), minlength=len(size))
            near = how.alike(size[i], size, shared)
            alike += [(i, j) for j in np.flatnonzero(near) if j > i]
    bits = {i: np.unpackbits(np.array(similar.set_print(sets[i][1]), ">i8").view(np.uint8)) for i in {i for pair in alike for i in pair}}
    tables = how.tables()
    hits = [(bits[a] != bits[b]).sum() <= how.radius and (bits[a][tables] == bits[b][tables]).all(axis=1).any() for a, b in alike]
    # copies of a text count once
    assert len(hits) > 40 and np.mean(hits) >= 0.9


@pytest.mark.parametrize("n_texts, copies", [(100, 5), (2, 150)])
def test_edited_copies(spark, n_texts, copies):
    assert check(spark, edited(n_texts, copies, seed=n_texts)) >= 0.95


def test_recall_at_the_least_similarity():
    """Of pairs with a similarity of exactly 0.8, radius and tables let nine in ten through."""
    how, rng = similar.Search(), np.random.default_rng(8)
    tables, hits = how.tables(), []
    for _ in range(600):
        base = rng.integers(0, 256, (340, 16), dtype=np.uint8)
        a, b = (np.unpackbits(np.array(similar.set_print(x), ">i8").view(np.uint8)) for x in (base[:-34], base[34:]))
        assert how.alike(306, 306, 272) and not how.alike(306, 306, 271)
        hits.append((a != b).sum() <= how.radius and bool((a[tables] == b[tables]).all(axis=1).any()))
    assert np.mean(hits) >= 0.9


def test_blocks_of_hot_buckets_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(similar, "STRIP", 16)
    rows = edited(2, 90, seed=5)
    ids = [i for i, _ in rows]
    how, want = similar.Search(), groups(linked_pairs(rows), ids).tolist()
    assert similar.block_links([similar.shingle_hashes(t)[0] for _, t in rows], how).tolist() == want
    members = spark.createDataFrame([(1, i, len(shingles(t)), t) for i, t in rows], "cluster long, rid long, n long, body string")
    for kw in ({"block": 16}, {"shingles": 2000}, {}):
        near = np.eye(len(rows), dtype=bool)
        for u, v in similar.verified_links(members, how, **kw).collect():
            near[u, v] = near[v, u] = True
        assert groups(near, ids).tolist() == want
    prints = similar.with_prints(members.select("rid", "body"), "body", 5)
    joined = []
    for block in (16, 4096):
        near = np.eye(len(rows), dtype=bool)
        for u, v in similar.candidate_links(prints.withColumn("label", similar.F.col("rid")), how.tables(), how.radius, block).collect():
            near[u, v] = near[v, u] = True
        joined.append(groups(near, ids).tolist())
        # two rounds join the same
        found = dict(similar.candidate_clusters(prints, how, block).collect())
        near = np.array([[found.get(i, i) == found.get(j, j) for j in ids] for i in ids])
        joined.append(groups(near, ids).tolist())
    assert joined[0] == joined[1] == joined[2] == joined[3]


def test_bucket_links():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (12, 2), dtype=np.uint64)
    prints = base[rng.integers(0, 12, 400)] ^ (np.uint64(1) << rng.integers(0, 63, (400, 2)).astype(np.uint64))
    key = np.sort(rng.integers(0, 30, 400) % 7 * rng.integers(0, 4, 400))
    near = (np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= 3) & (key[:, None] == key[None])
    got = np.eye(400, dtype=bool)
    a, b = similar.bucket_links(key, prints, np.arange(400), 3)
    got[a, b] = got[b, a] = True
    assert least_reachable(got, np.arange(400)).tolist() == least_reachable(near, np.arange(400)).tolist()


def test_odd_rows(spark):
    rows = similar.drop_similar(odd.table(spark)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "2", "None", "6", "7", "8", "10", "11", "12"])
    assert similar.drop_similar(odd.empty(spark)).count() == 0
    odd.check_clashing(similar.drop_similar(odd.clashing(spark)))
