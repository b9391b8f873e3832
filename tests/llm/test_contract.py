"""The registered queries over the smallest tables, each column against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from vellum.llm import direct_codes, embeddings, language, mixing, order_minhash, packing, secrets, sharding, simhash, token_counts

from .test_rowwise import check_edits
from .test_sets import all_paths, base_spans, check_mix, entropy_spans, hamming, least_reachable, naive_print
from .test_tokens_out import check_pieces, library_ids


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def by_id(frame, docs, columns):
    rows = {r.doc_id: r for r in frame.collect()}
    assert rows.keys() == docs.keys() and set(columns.split()) <= set(frame.columns)
    return rows


def test_op1(spark, sf_dir, docs):
    frame = sharding.op1_histogram_shards(spark, sf_dir)
    rows = by_id(frame, docs, "doc_id size text_crc32 law shard slot grown_shard")
    bytes_, slots = Counter(), {}
    for i, r in rows.items():
        raw = (docs[i].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        bytes_[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, most = sum(bytes_.values()) / 24, max(r.size for r in rows.values())
    assert all(abs(bytes_[s] - mean) <= most for s in range(24))


def test_op2(spark, sf_dir):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    good = [i for i, v in sorted(vectors.items()) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = embeddings.unit(np.array([vectors[i] for i in good]))
    near = np.einsum("ij,kj->ik", x, x) >= 0.95
    links = dict(zip(good, (near.sum(axis=1) - 1).tolist(), strict=True))
    heads = dict(zip(good, least_reachable(near, np.array(good)).tolist(), strict=True))
    for r in embeddings.op2_embedding_dedup(spark, sf_dir).collect():
        head = heads.get(r.vec_id, r.vec_id)
        assert (r.n_links, r.component_id, r.kept) == (links.get(r.vec_id, 0), head, head == r.vec_id)


def test_op3(spark, sf_dir, docs):
    rows = by_id(secrets.op3_secret_scan(spark, sf_dir), docs, "n_assign n_access n_hex base_sha256 spans")
    text_of = lambda spans: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    for i, r in rows.items():
        text = docs[i].text or ""
        base = base_spans(text)
        kinds = Counter(k for _, k, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds[0], kinds[1], kinds[2])
        assert r.base_sha256 == hashlib.sha256(text_of(base).encode()).hexdigest()
        assert r.spans == text_of(base + entropy_spans(text, secrets.EntropyScan()))


def test_op4(spark, sf_dir, docs):
    rows = order_minhash.op4_order_minhash(spark, sf_dir).collect()
    check_edits(spark, rows, [(i, r.text) for i, r in docs.items()])
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_op5(spark, sf_dir, docs):
    for i, r in by_id(token_counts.op5_token_counts(spark, sf_dir), docs, "n_bytes n_tokens over_limit").items():
        n = len(library_ids("byte_bpe_50k.json", docs[i].text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((docs[i].text or "").encode()), n, n > 1024)


def naive_unary(model, word):
    """Sum of the weights of a word's features, each made on its own."""
    marked, buckets = f"^{word}$", len(model.weights) - len(model.lexicon) - 1
    runs = [(i, marked[i : i + n]) for n in (2, 3, 4, 5) for i in range(len(marked) - n + 1)]
    kept = [x for i, x in runs if len(x) < 4 or i == 0 or i + len(x) == len(marked)]
    total, mask = model.weights[buckets + 1 + model.lexicon[word]] if word in model.lexicon else model.weights[buckets], 2**64 - 1
    for x in kept:
        h = ord(x[0]) + 0x9E37
        for c in x[1:]:
            h = (h * 0x9FB21C651E98DF25 + ord(c)) & mask
        h = (h ^ h >> 29) * 0xD6E8FEB86659FD93 & mask
        total = total + model.weights[(h >> 40) % buckets]
    return total


def test_op6(spark, sf_dir, docs):
    rows = by_id(language.op6_language_crf(spark, sf_dir), docs, "held_out lang_pred score")
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    part = [i for i, r in rows.items() if r.held_out and docs[i].lang]
    assert np.mean([rows[i].lang_pred == docs[i].lang for i in part]) > 0.9
    # predictions by the definition: every path of labels is weighed
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(language.training_sample(source, language.Settings()), language.Settings())
    short = [" ".join(language.words_of(r.text)[k : k + 6]) for k, r in enumerate(docs.values()) if r.text and len(language.words_of(r.text)) > k + 6][:12]
    short.append(" ".join(x.split()[0] for x in short[:5]))
    for text, (label, score) in zip(short, language.Labeller(model).label(short), strict=True):
        scores = np.stack([naive_unary(model, w) for w in language.words_of(text)]).astype(np.float64)
        mean = all_paths(scores, model.transitions.astype(np.float64), model.first.astype(np.float64)).mean(axis=0)
        assert label == model.labels[int(mean.argmax())] and score == pytest.approx(mean.max(), abs=1e-3)


def test_op7(spark, sf_dir, docs):
    frame = mixing.op7_mix_sources(spark, sf_dir)
    by_id(frame, docs, "size source_size target taken")
    source = spark.createDataFrame([(i, r.source) for i, r in docs.items()], "doc_id long, source string")
    check_mix(frame.join(source, "doc_id").collect(), [(i, r.text, r.source) for i, r in docs.items()])


def test_op8(spark, sf_dir, docs):
    rows = by_id(simhash.op8_simhash_dedup(spark, sf_dir), docs, "fingerprint component_id")
    ids = sorted(docs)
    prints = [naive_print(docs[i].text) for i in ids]
    assert [rows[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    assert [rows[i].component_id for i in ids] == least_reachable(hamming(prints) <= 2, np.array(ids)).tolist()


def test_op9(spark, sf_dir, docs):
    rows, at = by_id(direct_codes.op9_token_ids(spark, sf_dir), docs, "start n_tokens ids_crc32"), 0
    for i in sorted(docs):
        ids = np.array([*library_ids("word_bpe_49k.json", docs[i].text), 2], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op10(spark, sf_dir, docs):
    rows = packing.op10_pack_sequences(spark, sf_dir).collect()
    check_pieces(rows, [(i, r.text) for i, r in docs.items()], 2048)
