"""Fill-in-middle and prefix-table encoding against plain ones."""

import hashlib
import re
from array import array

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.llm import fill_middle as fim
from vellum.llm import prefix_bpe as bpe
from vellum.llm._tokens import vocabulary

from . import odd

sha = lambda b: hashlib.sha256(b).hexdigest()


def naive_fill(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}".encode())[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = fim.op11_fill_middle(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        n, form, p, m, out = naive_fill(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (n, form, p, m, sha(out.encode()))
        assert r.restored_sha256 == sha((texts[r.doc_id] or "").encode())


def test_fill_middle_of_odd_rows(spark):
    rows = [*odd.ROWS, *[(i, t, None, None, 0, "x") for i, t in enumerate(["a😀b 😀😀", "<P> in it", "<<P", "<S", "x<", "a\n\r\nb", "<M>", "é日a"] * 8, 100)]]
    for row in fim.fill_middle(odd.table(spark, rows)).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect():
        assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == naive_fill(row.doc_id, row.text)
        assert row.again == (row.text or "")
    assert fim.fill_middle(odd.empty(spark)).count() == 0
    odd.check_clashing(fim.fill_middle(odd.clashing(spark)), ("n",))


@pytest.mark.parametrize("units, pattern", [(fim.WORDS, "[A-Za-z]+|[^A-Za-z]"), (fim.LINES, "[^\n]*\n|[^\n]+"), (fim.CHARACTERS, "(?s:.)")])
def test_boundaries_are_those_of_the_grammar(spark, units, pattern):
    texts = ["", "a", "ab cd", "\n\na\nb", "😀a😀😀", "a  b\n", " x", "é日本 naïve\r\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", units.split(F.col("t")).alias("u")).collect()
    for r in got:
        assert r.u == re.findall(pattern, r.t), r.t


PATTERN = __import__("public_tokenizers").PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.Ranks.load(vocabulary("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})


STRANGE = ["", None, " a", "a  b", "a\nb", "a\n\nb", "<|endoftext|>", "it's don't we'll 'rex", "\t a", "a \n b", "日本語 テキスト", "\x1cq z", "3.5, d2,. É.", "á b", "x" * 3000, " " * 50 + "a", "😀" * 40]


def test_prefix_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bpe.op13_prefix_bpe(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(array("I", ids).tobytes()), sha(texts[r.doc_id].encode()))


@pytest.mark.parametrize("kept", [1_000_000, 20])
def test_encoder_is_the_library(library, kept):
    code = bpe.PrefixEncoder(vocabulary("byte_bpe_50k.tiktoken"), PATTERN, kept)
    texts = [*STRANGE, *[r[1] for r in odd.ROWS], *STRANGE]
    for text, ids in zip(texts, code.encode(texts), strict=True):
        assert ids == array("I", library.encode_ordinary(text or "")).tobytes(), text
        assert bpe.decode(ids, vocabulary("byte_bpe_50k.tiktoken")) == (text or "").encode()


def test_another_pattern_and_vocabulary():
    path, pattern = vocabulary("byte_bpe_multi_50k.tiktoken"), r"\p{L}+|[^\p{L}]"
    code = bpe.PrefixEncoder(path, pattern)
    library = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=code.ranks.ranks, special_tokens={})
    for text in filter(None, STRANGE):
        assert code.encode([text])[0] == array("I", library.encode_ordinary(text)).tobytes(), text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 400), st.integers(0, 9)), max_size=8), st.binary(max_size=300))
def test_a_table_that_is_edited_is_the_new_one(ranks, edits, data):
    data = bytes(b"abce e"[x % 6] if x < 240 else x for x in data)
    table = bpe.PrefixTable(ranks, data)
    for new, start, length in edits:
        start = min(start, len(data))
        stop = min(start + length, len(data))
        data = data[:start] + new + data[stop:]
        made = table.replace(start, stop, new)
        assert table.last == bpe.PrefixTable(ranks, data).last and made <= len(data) - start
        assert table.ids(start) == bpe.PrefixTable(ranks, data[:start]).ids()


def test_edits_near_the_start_of_a_long_piece_stay_near(ranks):
    table = bpe.PrefixTable(ranks, b"abcdefghij" * 2000)
    assert table.replace(100, 103, b"zzzzz") < 1000
    assert table.last == bpe.PrefixTable(ranks, bytes(table.data)).last


TEXT = st.text(alphabet=list("abcdE  \n\t'’trelv123,.é日😀\x1c\x85"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(st.tuples(TEXT, st.integers(0, 80), st.integers(0, 9)), max_size=6))
def test_an_edited_text_is_encoded_as_the_new_one(ranks, library, text, edits):
    held = bpe.EncodedText(ranks, PATTERN, text)
    for new, start, length in edits:
        start = min(start, len(text))
        stop = min(start + length, len(text))
        text = text[:start] + new + text[stop:]
        held.replace(start, stop, new)
        assert (held.text, held.ids()) == (text, library.encode_ordinary(text))
    held.append(" and more")
    assert held.ids() == library.encode_ordinary(text + " and more")


def test_encoding_odd_rows(spark, library):
    path = vocabulary("byte_bpe_50k.tiktoken")
    both = bpe.decode_ids(bpe.encode_texts(odd.table(spark), path, PATTERN), path).collect()
    assert len(both) == len(odd.ROWS)
    for r in both:
        assert bytes(r.ids) == array("I", library.encode_ordinary(r.text or "")).tobytes() and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode_texts(odd.empty(spark), path, PATTERN).count() == 0
    odd.check_clashing(bpe.encode_texts(odd.clashing(spark), path, PATTERN))
