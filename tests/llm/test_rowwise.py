import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import order_minhash, sharding, token_counts
from vellum.llm._tokens import vocabulary

from . import odd
from .test_tokens_out import library_ids, texts


def check_shards(rows, docs, n, near):
    want = Counter((d, len((t or "").encode()) + 8) for d, t in docs)
    assert Counter((r.doc_id, r.size) for r in rows) == want
    sizes = [0] * n
    slots: dict = {}
    for r in rows:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes) - min(sizes) <= near


def test_shards_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = list(texts(spark, sf_dir).items())
    most = max(len(t.encode()) for _, t in own) + 8
    for blocks in (1 << 30, 3000):
        rows = sharding.histogram_shards(docs, 5, block_bytes=blocks).collect()
        check_shards(rows, own, 5, 2 * most)
        assert set(docs.columns) < set(rows[0].asDict())


def test_shards_cut_a_large_group_of_copies(spark):
    rows = [(i, "one text for all" if i % 3 else f"text {i} " + "x" * (i % 50), "en", "a", 0, "") for i in range(6000)]
    got = sharding.histogram_shards(odd.table(spark, rows), 24).select("doc_id", "size", "shard", "slot").collect()
    check_shards(got, [r[:2] for r in rows], 24, 200)
    again = sharding.histogram_shards(odd.table(spark, rows[::-1]), 24).select("doc_id", "size", "shard", "slot").collect()
    assert sorted(got) == sorted(again)


def test_shards_cut_repeated_rows(spark):
    # two thirds of the rows are one row, and are cut like any others
    rows = [(5, "one row", "en", "a", 7, "")] * 4000 + [(i, f"text {i}", "en", "a", 0, "") for i in range(1998)]
    got = sharding.histogram_shards(odd.table(spark, rows), 4).select("doc_id", "size", "shard", "slot").collect()
    check_shards(got, [r[:2] for r in rows], 4, 300)
    assert len({r.shard for r in got if r.doc_id == 5}) >= 3


def test_shards_bound_what_the_driver_holds(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_BLOCKS", 12)
    monkeypatch.setattr(sharding, "MAX_PROBES", 64)
    rows = [(i, f"text {i % 700}", "en", "a", 0, "") for i in range(3000)]
    got = sharding.histogram_shards(odd.table(spark, rows), 6, block_bytes=100).collect()
    check_shards(got, [r[:2] for r in rows], 6, 200)
    odd.check_clashing(sharding.histogram_shards(odd.clashing(spark), 3), ("shard", "slot"))


def test_place():
    rng = np.random.default_rng(0)
    hi, lo = rng.integers(-3, 3, 500), rng.integers(-5, 5, 500)
    probes = sorted({sharding._whole(int(a), int(b)) for a, b in zip(rng.integers(-3, 3, 40), rng.integers(-5, 5, 40), strict=True)})
    want = [sum(p <= sharding._whole(int(a), int(b)) for p in probes) for a, b in zip(hi, lo, strict=True)]
    assert sharding._place(hi, lo, probes).tolist() == want


def test_shards_odd_rows(spark):
    rows = sharding.histogram_shards(odd.table(spark), 3).collect()
    check_shards(rows, [r[:2] for r in odd.ROWS], 3, 400_000)
    assert sharding.histogram_shards(odd.empty(spark), 3).count() == 0


def naive_signature(how, text):
    kmers = how._kmers(text)
    flip, times, _ = how._mixers
    out = []
    for f, t in zip(flip[:, 0].tolist(), times[:, 0].tolist(), strict=True):
        ranked = sorted(range(len(kmers)), key=lambda i: ((int(kmers[i]) & 0xFFFFFFFF ^ f) * t & 0xFFFFFFFF))
        h = min(how.tuple_size, len(kmers))
        for i in sorted(ranked[: how.tuple_size]):
            h = (h ^ int(kmers[i])) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        out.append(h >> 16 & 0xFFFFFFFF)
    return out


def test_signature_is_the_definition():
    rng = random.Random(2)
    how = order_minhash.OrderMinHash(size=16)
    for n in (1, 3, 5, 6, 7, 40, 1500, 2600):
        text = "".join(rng.choice("abé日") for _ in range(n))
        assert how.signature(text).tolist() == naive_signature(how, text)
    # occurrence numbers keep repeated k-mers apart; order matters
    a, b = "a b c d e f g h " * 20, "i j k l m n o p " * 20
    assert how._kmers(a).size == len(set(how._kmers(a).tolist()))
    assert order_minhash.likeness(how.signature(a + b), how.signature(b + a)) < 0.9
    near = [order_minhash.likeness(how.signature(a + b), how.signature(x)) for x in (a + b, a + b + " q", b)]
    assert near[0] == 1 and near[0] >= near[1] >= near[2]
    # the likeness follows the edit distance in unspaced text and one long word too
    word = odd.LONG_TOKEN[:5000]
    likes = [order_minhash.likeness(how.signature(word), how.signature(x)) for x in (word[:2500] + "#" + word[2501:], "#" + word, word[::-1])]
    assert likes[0] > 0.9 and likes[1] > 0.9 and likes[2] == 0


def check_edits(spark, rows, docs):
    how = order_minhash.OrderMinHash()
    h = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in docs], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1] or ""]))
    want = []
    for i, (doc, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        own, changed, follow = how.signature(text), how.signature(edit), how.signature(after)
        want.append((doc, len(text), hashlib.sha256(edit.encode()).hexdigest(), order_minhash.spelled(own), order_minhash.spelled(changed), order_minhash.likeness(own, changed), order_minhash.likeness(own, follow)))
    assert Counter(tuple(r) for r in rows) == Counter(want)


def test_edits(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_edits(spark, order_minhash.compare_with_edit(docs, range_rows=13).collect(), list(texts(spark, sf_dir).items()))
    check_edits(spark, order_minhash.compare_with_edit(odd.table(spark), range_rows=2).collect(), [r[:2] for r in odd.ROWS])
    one = [odd.ROWS[0]]
    check_edits(spark, order_minhash.compare_with_edit(odd.table(spark, one)).collect(), [r[:2] for r in one])
    assert order_minhash.compare_with_edit(odd.empty(spark)).count() == 0
    kept = order_minhash.fingerprint_texts(odd.table(spark).withColumn("fingerprint", F.lit(1)))
    assert {len(r.fingerprint) for r in kept.collect()} == {0, 512}
    odd.check_clashing(order_minhash.fingerprint_texts(odd.clashing(spark)), ("fingerprint",))


def test_token_counts(spark, sf_dir, tmp_path, monkeypatch):
    path, cache = vocabulary("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    for docs, own in (
        (spark.read.parquet(f"{sf_dir}/documents.parquet"), list(texts(spark, sf_dir).items())),
        (odd.table(spark), [r[:2] for r in odd.ROWS]),
    ):
        rows = token_counts.count_tokens(docs, cache, path).collect()
        want = []
        for doc, text in own:
            n = len(library_ids("byte_bpe_50k.json", text))
            want.append((doc, len((text or "").encode()), n, n > 1024))
        assert Counter(tuple(r) for r in rows) == Counter(want)
    before = spark.read.parquet(cache).count()
    again = token_counts.count_tokens(docs, cache, path).collect()
    assert spark.read.parquet(cache).count() == before and Counter(again) == Counter(rows)
    # another tokenizer version has counts of its own, and the old ones stay
    other = token_counts.count_tokens(docs, cache, vocabulary("word_bpe_49k.json")).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in other) == Counter((d, len(library_ids("word_bpe_49k.json", x))) for d, x in own)
    assert spark.read.parquet(cache).groupBy("tokenizer").count().count() == 2
    # many misses take the other way
    monkeypatch.setattr(token_counts, "FEW", 3)
    assert Counter(token_counts.count_tokens(docs, f"file://{tmp_path}/many", path).collect()) == Counter(rows)
    assert token_counts.count_tokens(odd.empty(spark), cache, path).count() == 0
    assert token_counts.count_tokens(odd.empty(spark), f"file://{tmp_path}/new", path).count() == 0


def test_crc(spark):
    rows = odd.table(spark).select("text", sharding.text_crc32(F.col("text")).alias("c")).collect()
    assert all(r.c == zlib.crc32((r.text or "").encode()) for r in rows)
    assert np.uint32(rows[0].c) == rows[0].c


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 300, 1023, 1024, 1031, 1032, 5000])
@pytest.mark.parametrize("alike", [0, 1, 8, 150, 1031, 3000])
def test_a_common_start_changes_no_signature(size, alike):
    how = order_minhash.OrderMinHash(size=16, tuple_size=3)
    letters = np.random.default_rng(size).choice(list("abé "), 10_000)
    text, other = "".join(letters[:size]), "".join(letters[5000:])
    alike = min(alike, size)
    own, start = how.begun(text, alike)
    assert own.tolist() == how.signature(text).tolist()
    for edit in (text[:alike] + other[:900], text[:alike]):
        assert how.resumed(edit, start).tolist() == how.signature(edit).tolist()


def test_the_least_kmers_are_those_of_a_full_sort():
    how = order_minhash.OrderMinHash(size=8)
    text = "".join(np.random.default_rng(3).choice(list("abc"), 300 * order_minhash.STRETCH))
    kmers = how._kmers(text)
    flip, times, _ = how._mixers
    _, places = how._lesser(*how._least(kmers, 0, len(kmers)))
    for f in range(how.size):
        numbers = (kmers.astype(np.uint32) ^ flip[f]) * times[f]
        assert places[f].tolist() == np.argsort(numbers, kind="stable")[: how.tuple_size].tolist()
