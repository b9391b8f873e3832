import functools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from vellum.llm import direct_codes, packing
from vellum.llm._tokens import ChunkEncoder, vocabulary

from . import odd


def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def library_ids(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunk_encoder_is_the_library(spark, sf_dir, name):
    own = [t for _, t in sorted(texts(spark, sf_dir).items())]
    strange = [
        "", None, " a", "a  b", "a\nb", "a\n\nb", "a <|endoftext|> b<|endoftext|>", "x y z", "é é İ", "it's don't we'll",
        "\t a", "a\r\nb", "a \n b", "12 345 x9y", "日本語 テキスト", " ", "\n", "’s “q” …", "A\nThe b", "\x1cq z", "_a_ b_c",
        "a., b.! c's. 3.5, d2,. É.", "á b", " x y", "q .", ". , q", "\0 \0x",
    ]
    for kept in (1_000_000, 50):
        code = ChunkEncoder(vocabulary(name), kept)
        for text, got in zip(own + strange, code.encode(own + strange), strict=True):
            want = code.library.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(got, "<u4").tolist() == want, text


@pytest.mark.parametrize("top", [1, 255, 256, 70_000, 2**32 - 1])
def test_codes_round_trip_and_random_access(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 7, 8, 511, 512, 513, 5000):
        ids = np.minimum(rng.zipf(1.3, n), top).astype(np.uint32)
        codes = direct_codes.Codes(direct_codes.pack_codes(ids))
        assert codes.n == n
        assert codes.tokens(0, n).tolist() == ids.tolist()
        for _ in range(30 if n else 0):
            i, j = sorted(rng.integers(0, n + 1, 2).tolist())
            assert codes.tokens(i, j).tolist() == ids[i:j].tolist()
            k = int(rng.integers(0, n))
            assert codes.token(k) == ids[k]


def check_ids(spark, docs, rows, tmp_path, **kw):
    path = f"file://{tmp_path}/ids"
    direct_codes.write_token_ids(docs, path, vocabulary("word_bpe_49k.json"), 2, **kw)
    got = sorted(direct_codes.read_token_ids(spark, path).collect(), key=lambda r: r.start)
    h = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1] or ""]))
    assert [r.doc_id for r in got] == [r[0] for r in want]
    at = 0
    for r, (_, text) in zip(got, want, strict=True):
        ids = np.array([*library_ids("word_bpe_49k.json", text), 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(r.ids) == ids.tobytes()
        at += len(ids)
    return path, np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in got])


def scanned_rows(df):
    """Rows that the scan of an executed plan has given out."""
    df._jdf.collect()
    plan, seen = df._jdf.queryExecution().executedPlan(), []
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        seen.append(leaves.apply(i).metrics().apply("numOutputRows").value())
    return sum(seen)


def test_token_ids_odd_rows(spark, tmp_path):
    check_ids(spark, odd.table(spark), [r[:2] for r in odd.ROWS], tmp_path, range_rows=3, segment_ids=50)


def test_token_ids_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path, ids = check_ids(spark, docs, list(texts(spark, sf_dir).items()), tmp_path, range_rows=17, segment_ids=3000)
    rng = np.random.default_rng(6)
    asked = [0, len(ids) - 1, *rng.integers(0, len(ids), 60).tolist()]
    assert [direct_codes.token_at(spark, path, i) for i in asked[:4]] == ids[asked[:4]].tolist()
    with pytest.raises(IndexError):
        direct_codes.token_at(spark, path, len(ids))
    for grid in (100, 1 << 16):
        got = direct_codes.tokens_at(spark, path, spark.createDataFrame([(i,) for i in [*asked, len(ids) + 5]], "position long"), grid)
        assert Counter(map(tuple, got.collect())) == Counter((i, int(ids[i])) for i in asked)
    # a token costs its own segment, not the container
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    n = spark.read.parquet(path).count()
    place = direct_codes.segment_starts(spark, path).orderBy("start").collect()[n // 2]
    assert scanned_rows(direct_codes.one_segment(spark, path, place["range"], place.segment)) < n / 4
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_token_ids_of_a_hot_doc_id(spark, tmp_path):
    # a third of the rows have one doc_id, a third none
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i}") for i in range(240)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from vellum.llm._shared import id_ranges

    sizes = [r["count"] for r in id_ranges(frame, 10).groupBy("range").count().collect()]
    assert max(sizes) <= 30 and len(sizes) >= 16
    check_ids(spark, frame, rows, tmp_path, range_rows=10)


def test_token_ids_empty(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    direct_codes.write_token_ids(odd.empty(spark), path, vocabulary("word_bpe_49k.json"), 2)
    assert direct_codes.read_token_ids(spark, path).count() == 0


def check_plan(counts, capacity):
    plan, n = packing.plan_sequences(dict(counts), capacity)
    filled: dict[int, list] = {}
    for size, count in counts.items():
        own = plan[plan[:, 0] == size]
        for rank in range(count):
            _, lo, each, first, offset = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
            t = rank - lo
            filled.setdefault(int(first + t // each), []).append((int(offset + t % each * size), size))
    assert len(filled) == n
    for pieces in filled.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= capacity
    return n


def naive_best_fit(sizes, capacity):
    free: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits)[1]] -= s
        else:
            free.append(capacity - s)
    return len(free)


def least_sequences(sizes, capacity):
    """The optimum, by trying every place for the next piece."""
    best = [naive_best_fit(sizes, capacity)]
    order = sorted(sizes, reverse=True)

    def go(i, free):
        if len(free) >= best[0]:
            return
        if i == len(order):
            best[0] = len(free)
            return
        for k in {f: k for k, f in enumerate(free) if f >= order[i]}.values():
            free[k] -= order[i]
            go(i + 1, free)
            free[k] += order[i]
        go(i + 1, [*free, capacity - order[i]])

    go(0, [])
    return best[0]


def test_plan_is_valid_and_near_the_optimum():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 20, 37])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        n = check_plan(Counter(sizes), capacity)
        assert n <= least_sequences(sizes, capacity) + (len(sizes) > 6)
    for _ in range(20):
        sizes = [min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(2000)]
        assert check_plan(Counter(sizes), 2048) <= naive_best_fit(sizes, 2048)


def test_reduction_fixes_only_what_an_optimum_allows():
    rng = random.Random(5)
    for _ in range(200):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        x = packing._Instance(dict(Counter(sizes)), 20)
        packing._reduce(x)
        rest = [s for s, n in enumerate(x.left) for _ in range(n)]
        assert x.sequences + (least_sequences(rest, 20) if rest else 0) == least_sequences(sizes, 20)


def check_pieces(rows, docs, capacity):
    want = Counter()
    for doc, text in docs:
        ids = [*library_ids("byte_bpe_50k.json", text), 0]
        n = len(ids)
        starts = [0, *range(n % capacity or capacity, n, capacity)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled: dict = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return filled


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pack_documents(spark, sf_dir, capacity):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), capacity=capacity).collect()
    filled = check_pieces(rows, list(texts(spark, sf_dir).items()), capacity)
    assert len(filled) <= naive_best_fit([r.length for r in rows], capacity)
    assert all(len(r.ids) == 4 * r.length for r in rows)


def test_pack_odd_rows(spark):
    rows = packing.pack_documents(odd.table(spark), vocabulary("byte_bpe_50k.json"), ids=False).collect()
    check_pieces(rows, [r[:2] for r in odd.ROWS], 2048)
    assert len({(r.row_id, r.piece) for r in rows}) == len(rows)


def test_pack_splits_a_hot_length(spark, monkeypatch):
    # every piece has one length; parts follow the count, and the ids make up the sequences
    monkeypatch.setattr(packing, "PART", 16)
    docs = spark.createDataFrame([(None, "one text for all")] * 300, "doc_id long, text string").repartition(4)
    rows = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), capacity=64).collect()
    check_pieces(rows, [(None, "one text for all")] * 300, 64)
    own = np.array([*library_ids("byte_bpe_50k.json", "one text for all"), 0], "<u4").tobytes()
    assert all(bytes(r.ids) == own for r in rows)


def test_pack_empty(spark):
    assert packing.pack_documents(odd.empty(spark), vocabulary("byte_bpe_50k.json")).count() == 0
