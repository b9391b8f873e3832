"""Exact token ids at speed: the tokenizers library, asked once per distinct chunk.

The pre-tokenizers of the two vocabularies used here never let a token cross a single
space or newline that stands between two visible characters.  A text made only of such
white space and of common Latin characters is therefore the concatenation of its chunks'
tokens, and a chunk that was seen before need not be encoded again.  Every other text, and
every text that might hold a special token's string, is encoded whole by the library.
"""

from __future__ import annotations

import os
import string
from array import array
from collections.abc import Callable
from operator import attrgetter

import numpy as np

#: What sends a text to the library whole (for Arrow's regular expressions).
_WHOLE = "[^\n -~À-ÖØ-öø-ÿ‘’“”–—…]|<[|]|\\A[ \n]|[ \n]\\z|\\A\\z"
_LOOSE = "|[ \n][ \n]"

#: A chunk whose closing marks are tokens of their own, without these.
_CORE = "[0-9A-Za-zÀ-ÖØ-öø-ÿ]\\z"

#: Characters of a chunk that is held: longer ones are made anew in each batch.
LONG = 100

#: Characters of the texts, but for the last of them, that are encoded together.
TOGETHER = 4_000_000

_encoders: dict = {}


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


def _gaps(found: list) -> list[int]:
    """The places that hold None."""
    return [i for i, x in enumerate(found) if x is None]


def _listed(strings) -> list[str]:
    """An Arrow column of strings as a list; several times as fast as to_pylist."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def _strung(pieces: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces, of the given sizes, that ``order`` names, one after another, and their ends."""
    begin, n = np.cumsum(size) - size, size[order]
    ends = np.cumsum(n)
    total = int(ends[-1])
    kind = np.int32 if max(total, len(pieces)) < 1 << 31 else np.int64
    # number k of the output stands as far behind its piece's start as among the pieces
    place = np.repeat((begin[order] - (ends - n)).astype(kind), n)
    place += np.arange(total, dtype=kind)
    return pieces[place], ends


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``kept`` bounds the number of chunks held in a worker's memory.  Beyond half of it the store
    becomes the older one, from which chunks that come again are taken over, and the older one
    before it is dropped: this costs time but changes no result.
    """

    def __init__(self, path: str, kept: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        pre = str(self.library.pre_tokenizer)
        if "ByteLevel" not in pre:
            raise ValueError("only byte-level vocabularies can be encoded by chunks")
        #: white space belongs to the following token, as opposed to being dropped
        self.spaced = "Split" not in pre
        #: a normaliser that only lower-cases common characters is applied to whole texts instead
        self.lower = self.library.normalizer is not None
        self.plain = self.library
        if self.lower:
            if "Lowercase" not in str(self.library.normalizer):
                raise ValueError("only a lower-casing normaliser can be applied ahead")
            self.plain = Tokenizer.from_file(path)
            self.plain.no_truncation()
            self.plain.no_padding()
            self.plain.normalizer = normalizers.Sequence([])
        self.kept = kept
        self.forget()

    def forget(self) -> None:
        """Drop all chunks held; this changes no result."""
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str], whole: bool = False) -> list[bytes]:
        done = (self.library if whole else self.plain).encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in done]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks.  One that is a word, with or without the space before it, is one
        piece to the pre-tokenizer, so it goes to the library's model right away."""
        merged, one, space = self.plain.model.tokenize, attrgetter("id"), _LETTERS[32] if self.spaced else ""
        words, others = [], []
        for chunk in chunks:
            word, before = (chunk, space) if chunk[0] != "\0" or not self.spaced else (chunk[1:], "")
            if word.isalpha():
                words.append(before + (word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)))
            else:
                words.append(None)
                others.append(self._spell(chunk))
        out = [None if word is None else array("I", map(one, merged(word))).tobytes() for word in words]
        for i, ids in zip(_gaps(out), self._encode(others), strict=True):
            out[i] = ids
        return out

    def _chunked(self, texts) -> np.ndarray:
        """Which texts of an Arrow column are put together from chunks; the others are encoded whole."""
        import pyarrow.compute as pc

        return ~pc.match_substring_regex(texts, _WHOLE + _LOOSE if self.spaced else _WHOLE).to_numpy(zero_copy_only=False)

    def _split(self, texts):
        """The chunks of each text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.lower:
            texts = pc.utf8_lower(texts)
        if not self.spaced:
            return pc.ascii_split_whitespace(texts)
        # a chunk after a newline carries it; the text's first chunk is marked by NUL
        first, nothing = pa.scalar("\0", texts.type), pa.scalar("", texts.type)
        return pc.split_pattern(pc.binary_join_element_wise(first, pc.replace_substring(texts, "\n", " \n"), nothing), " ")

    def _spell(self, chunk: str) -> str:
        if not self.spaced or chunk[0] == "\n":
            return chunk
        return chunk[1:] if chunk[0] == "\0" else " " + chunk

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text (null: empty), as bytes; results are those of the library."""
        out: list[bytes] = []
        some, size = [], 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size >= TOGETHER:
                out += self._encode_some(some)
                some, size = [], 0
        return out + self._encode_some(some)

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa

        if not texts:
            return []
        column = pa.array(texts, pa.large_string())
        chunked = self._chunked(column)
        joined = iter(self._joined(column.filter(pa.array(chunked))))
        whole = iter(self._encode([t for t, c in zip(texts, chunked, strict=True) if not c], whole=True))
        return [next(joined if c else whole) for c in chunked.tolist()]

    def _joined(self, texts) -> list[bytes]:
        """The ids of texts of chunks, put together from those of the distinct chunks."""
        if not len(texts):
            return []
        lists = self._split(texts)
        chunks = lists.values.dictionary_encode()
        pieces, size = self._pieces(chunks.dictionary)
        found, ends = _strung(pieces, size, chunks.indices.to_numpy())
        found = found.tobytes()
        cuts = (4 * np.concatenate([[0], ends])[lists.offsets.to_numpy()]).tolist()
        return [found[a:b] for a, b in zip(cuts, cuts[1:])]

    def _pieces(self, chunks) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks, one after another, and how many each has.

        Closing marks after a letter or digit are tokens of their own, so these chunks are
        looked up without them."""
        import pyarrow.compute as pc

        bare = pc.ascii_rtrim(chunks, string.punctuation)
        core = pc.if_else(pc.match_substring_regex(bare, _CORE), bare, chunks)
        marks = (pc.binary_length(chunks).to_numpy() - pc.binary_length(core).to_numpy()).astype(np.int64)
        closed = marks.nonzero()[0]
        tails = [c[-n:] for c, n in zip(_listed(chunks.take(closed)), marks[closed].tolist(), strict=True)]
        core = core.dictionary_encode()
        ids = self._ids_of(_listed(core.dictionary))
        tail = dict.fromkeys(tails)
        order = np.full((len(chunks), 2), len(ids))
        order[:, 0] = core.indices.to_numpy()
        place = {t: len(ids) + 1 + i for i, t in enumerate(tail)}
        order[closed, 1] = np.fromiter(map(place.__getitem__, tails), np.int64, len(tails))
        ids = [*ids, b"", *self._encode(list(tail))]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pieces, _ = _strung(np.frombuffer(b"".join(ids), "<u4"), size, order.ravel())
        return pieces, size[order].sum(axis=1)

    def _ids_of(self, chunks: list[str], made: Callable[[list[str]], list[bytes]] | None = None) -> list[bytes]:
        """The ids of distinct chunks; those that no store has are ``made`` together."""
        found = list(map(self.held.get, chunks))
        gaps = _gaps(found)
        if not gaps:
            return found
        half = self.kept // 2
        if len(self.held) + len(gaps) > half:
            self.older, self.held = self.held, {}
        lacking = []
        for i in gaps:
            ids = found[i] = self.older.get(chunks[i])
            if ids is None:
                lacking.append(i)
            elif len(self.held) < half:
                self.held[chunks[i]] = ids
        for i, ids in zip(lacking, (made or self._encode_chunks)([chunks[i] for i in lacking]), strict=True):
            found[i] = ids
            if len(chunks[i]) <= LONG and len(self.held) < half:
                self.held[chunks[i]] = ids
        return found


def encoder(path: str) -> ChunkEncoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
