"""What the token encoders hold, and what they leave to the library's slower ways."""

import random
import string
from array import array

import pytest
import tiktoken

from vellum.llm import prefix_bpe as bpe
from vellum.llm._tokens import ChunkEncoder, vocabulary

PATTERN = __import__("public_tokenizers").PATTERN


def drawn_words(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefgéñü", k=rng.randint(3, 9))) for _ in range(n)]


def test_prefix_encoder_holds_no_more_than_it_says():
    words, kept = drawn_words(6000), 2000
    code = bpe.PrefixEncoder(vocabulary("byte_bpe_50k.tiktoken"), PATTERN, kept)
    code.ranks.kept = 500
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=code.ranks.ranks, special_tokens={})
    for lo in range(0, len(words), 100):
        # a text of chunks, one of matches (two spaces), and one without any white space
        texts = [" ".join(words[lo : lo + 100]), "  ".join(words[lo : lo + 100]), "-".join(words[lo : lo + 100])]
        for text, ids in zip(texts, code.encode(texts), strict=True):
            assert ids == array("I", library.encode_ordinary(text)).tobytes()
        held = [*code.held, *code.older]
        assert len(held) <= kept and max(map(len, held)) <= 101
        assert len(code.ranks.steps) <= 500 and len(code.ranks.verdicts) <= 500
        sizes = {k: len(v) for k, v in vars(code).items() if isinstance(v, dict)}
        assert sum(sizes.values()) <= kept, sizes


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_go_to_the_model_alone_and_once(name, monkeypatch):
    code = ChunkEncoder(vocabulary(name), 2000)
    words, passed = drawn_words(3000, 2), []
    inner = ChunkEncoder._encode
    monkeypatch.setattr(ChunkEncoder, "_encode", lambda self, texts, whole=False: passed.extend(texts) or inner(self, texts, whole))
    for lo in range(0, len(words), 100):
        # " common" comes in each text, so it is taken over whenever the store is full
        text = "x common " + " ".join(w + random.Random(lo).choice(["", ",", "***", ".&&&"]) for w in words[lo : lo + 100])
        assert code.encode([text])[0] == array("I", code.library.encode(text, add_special_tokens=False).ids).tobytes()
        assert len(code.held) + len(code.older) <= 2000
    assert all(not any(c.isalnum() for c in t) for t in passed)
    made = []
    monkeypatch.setattr(ChunkEncoder, "_encode_chunks", lambda self, chunks: made.extend(chunks) or [b"\0\0\0\0"] * len(chunks))
    code.encode(["y common"])
    assert "common" not in made


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_closing_marks(name):
    code = ChunkEncoder(vocabulary(name))
    rng = random.Random(3)
    cores = ["a", "it's", "É", "don", "x9", "3", "q-r", "'s", "_", "(a", "“b", "b”", "A’s", "\\n"]
    ends = ["", *string.punctuation.replace("<", ""), "'s", "'", "''", "%%%", ",***", ".'", "'.", "!'s"]
    texts = [rng.choice(" \n").join(rng.choice(cores) + rng.choice(ends) for _ in range(8)) for _ in range(400)]
    for text, ids in zip(texts, code.encode(texts), strict=True):
        assert ids == array("I", code.library.encode(text, add_special_tokens=False).ids).tobytes(), text


def test_ids_travel_in_two_bytes_where_they_fit():
    import numpy as np
    import pyarrow as pa

    from vellum.llm import packing

    ids = [[1, 65535], [0], [7, 8, 9], [65536, 5], [1 << 31]]
    wide = [np.array(x, "<u4").tobytes() for x in ids]
    narrow = [packing.narrowed(x) for x in wide]
    assert [len(x) for x in narrow] == [4, 2, 6, 8, 4]
    column, length = pa.array(narrow, pa.binary()), np.array([len(x) for x in ids])
    for lo, hi in ((0, 5), (0, 3), (1, 3), (2, 5), (3, 5), (2, 2)):
        got = packing.widened(column.slice(lo, hi - lo), length[lo:hi])
        assert got.to_pylist() == wide[lo:hi] and got.type == pa.binary()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_word_is_held_once_whatever_closes_it(name):
    code = ChunkEncoder(vocabulary(name))
    text = "x word word, word. élan élan!*** word&&& word"
    assert code.encode([text, text])[1] == array("I", code.library.encode(text, add_special_tokens=False).ids).tobytes()
    assert sorted(c.strip("\0") for c in code.held) == ["word", "x", "élan"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_one_batch_of_more_chunks_than_are_held(name):
    code, words = ChunkEncoder(vocabulary(name), 200), drawn_words(3000, 4)
    texts = [" ".join(words[lo : lo + 1000]) for lo in (0, 1000, 2000, 0)]
    for some in (texts[:3], texts[3:]):
        for text, ids in zip(some, code.encode(some), strict=True):
            assert ids == array("I", code.library.encode(text, add_special_tokens=False).ids).tobytes()
        assert len(code.held) <= 100 and len(code.older) <= 100


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_white_space_and_signs_at_any_place(name):
    code, rng = ChunkEncoder(vocabulary(name)), random.Random(5)
    signs = ["a", "B,", "É.", " ", "\n", "\0", "<", "|", "<|", "ß", "×", "ÿ", "“", "’", "\t", "\x1f", "\x7f", "\xa0", "日", "1", "'s", "_"]
    texts = ["", None, " ", "\n", *("".join(rng.choices(signs, k=rng.randint(1, 7))) for _ in range(3000))]
    for text, ids in zip(texts, code.encode(texts), strict=True):
        assert ids == array("I", code.library.encode(text or "", add_special_tokens=False).ids).tobytes(), repr(text)
