"""Exact byte-pair encoding by dynamic programming over prefixes.

Of all tokens that end a byte prefix exactly one is the last of that prefix's encoding: the
one that may follow the last token of what stands before it.  A table of these last tokens,
one for each prefix, holds every prefix's encoding at once.  Bytes that are appended only add
entries, and an edit redoes only the entries near it.

A text is first matched by the vocabulary's pattern, and each match has a table of its own.
"""

from __future__ import annotations

import base64
import bisect
import functools
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import free_name, packed, quoted, unpacked
from ._tokens import ChunkEncoder, vocabulary


#: Above any rank.
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a vocabulary file with their ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}


class Ranks:
    """A vocabulary of byte strings with their merge ranks.

    Every token but single bytes was made by one last merge of two others, of lower rank.
    ``kept`` bounds the pairs of tokens whose verdict is remembered, and the steps between states.
    """

    def __init__(self, ranks: dict[bytes, int], kept: int = 300_000):
        self.ranks, self.kept = ranks, kept
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: a state is the longest end of what was read that starts a token; 0 is the empty one
        self.state_of: dict[bytes, int] = {b"": 0}
        for word in ranks:
            for k in range(len(word), 0, -1):
                if word[:k] in self.state_of:
                    break
                self.state_of[word[:k]] = len(self.state_of)
        self.read_as = list(self.state_of)
        self.steps: dict[int, int] = {}
        self.endings: list[list[tuple[int, int]] | None] = [None] * len(self.read_as)
        self.halves: dict[int, tuple[bytes, bytes] | None] = {}
        self.verdicts: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Ranks:
        return cls(read_ranks(path))

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte."""
        key = state << 8 | byte
        after = self.steps.get(key)
        if after is None:
            read = self.read_as[state] + bytes([byte])
            start = next(i for i in range(len(read) + 1) if read[i:] in self.state_of)
            if len(self.steps) >= self.kept:
                self.steps = {}
            after = self.steps[key] = self.state_of[read[start:]]
            if self.endings[after] is None:
                tails = [read[i:] for i in range(start, len(read))]
                self.endings[after] = [(self.ranks[x], len(x)) for x in tails if x in self.ranks]
        return after

    def last_tokens(self, data: bytes, last: list[int], state: int = 0, place: int = 0) -> Iterator[int]:
        """Add to ``last`` the last token of each prefix of ``data`` that it lacks.

        ``state`` is that of the bytes before ``place``.  Yields each new prefix's last place.
        """
        known, steps, endings, verdicts = len(last), self.steps, self.endings, self.verdicts
        for place in range(place, len(data)):
            after = steps.get(state << 8 | data[place])
            state = self.step(state, data[place]) if after is None else after
            if place < known:
                continue
            for token, size in endings[state]:
                if size > place:
                    break
                verdict = verdicts.get(last[place - size] << 32 | token)
                if self.follows(last[place - size], token) if verdict is None else verdict:
                    break
            else:
                raise ValueError("no token of the vocabulary ends this prefix")
            last.append(token)
            yield place

    def _merge(self, parts: list[bytes]) -> bool:
        """Merge the adjacent pair of least rank, the first of equals; False if none can be."""
        rank, at = min(((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(NEVER, 0))
        if rank < NEVER:
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return rank < NEVER

    def halves_of(self, word: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge made a token; None for a single byte."""
        token = self.ranks[word]
        if token not in self.halves:
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 2 and self._merge(parts):
                pass
            if len(parts) > 2 or self.ranks.get(b"".join(parts)) != token:
                raise ValueError(f"no merges lead to token {token}")
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def follows(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left`` in an encoding?

        Their merges are undone along the border between them, those of highest rank first.
        The border holds unless what then meets there would have merged before the merge that
        was just undone; of equal ranks the one further left comes first.
        """
        pair = left << 32 | right
        verdict = self.verdicts.get(pair)
        if verdict is None:
            if len(self.verdicts) >= self.kept:
                self.verdicts = {}
            verdict = self.verdicts[pair] = self._border_holds(self.bytes_of[left], self.bytes_of[right])
        return verdict

    def _border_holds(self, a: bytes, b: bytes) -> bool:
        rank_of = self.ranks
        within_a = within_b = NEVER  # the ranks of the merges undone last
        while True:
            across = rank_of.get(a + b, NEVER)
            # inside the left token an equal rank comes first, inside the right one it comes later
            if across < within_a and across <= within_b and across < NEVER:
                return False
            of_a, of_b = self.halves_of(a), self.halves_of(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or (of_a is not None and rank_of[a] > rank_of[b]):
                within_a, a = rank_of[a], of_a[1]
            else:
                within_b, b = rank_of[b], of_b[0]


class PrefixTable:
    """The last token of every prefix of a byte string that is encoded as one piece."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, bytearray(), []
        self.append(data)

    def _extend(self) -> Iterator[int]:
        """Make the entries that are still missing, one after the other."""
        start = max(0, len(self.last) - self.ranks.longest)
        return self.ranks.last_tokens(self.data, self.last, 0, start)

    def append(self, data: bytes) -> None:
        """More bytes at the end: no entry changes, one is added for each byte."""
        self.data += data
        for _ in self._extend():
            pass

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in the place of some bytes; returns how many entries were made anew.

        Entries before the edit stay.  Behind it they are made anew until as many in a row
        as the longest token has bytes are what they were, since no later one looks further
        back; the rest is taken over.
        """
        moved = len(data) - (stop - start)
        old, self.data[start:stop] = self.last, data
        self.last = old[:start]
        alike = 0
        for place in self._extend():
            settled = place >= start + len(data)
            alike = alike + 1 if settled and old[place - moved] == self.last[-1] else 0
            if alike == self.ranks.longest:
                break
        made = len(self.last) - start
        self.last += old[start + made - moved :]
        return made

    def ids(self, stop: int | None = None) -> list[int]:
        """The encoding of the whole, or of its first ``stop`` bytes, read from its end."""
        at, found = len(self.last) if stop is None else stop, []
        while at:
            found.append(self.last[at - 1])
            at -= len(self.ranks.bytes_of[found[-1]])
        return found[::-1]


class EncodedText:
    """A text that stays encoded while it grows or is edited.

    A match of the pattern depends on its own characters and on two behind it, so matches that
    end before these are kept, and matching goes on from there until it meets an old start.
    Matches that stay have their tables; one that grew or changed takes its table along.
    """

    def __init__(self, ranks: Ranks, pattern: str, text: str = ""):
        import regex

        self.ranks, self.matcher, self.text = ranks, regex.compile(pattern), text
        self.starts, self.tables = self._match(0, len(text) + 1)

    def _match(self, at: int, stop: int) -> tuple[list[int], list[PrefixTable]]:
        found = list(self.matcher.finditer(self.text, at)) if at < stop else []
        return [m.start() for m in found], [PrefixTable(self.ranks, m.group().encode()) for m in found]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` in the place of the characters from ``start`` to ``stop``."""
        ends = [*self.starts[1:], len(self.text)]
        first = max(0, bisect.bisect_right(ends, start - 2)) if self.starts else 0
        at = self.starts[first] if first < len(self.starts) else (ends[-1] if self.starts else 0)
        before, moved, old = self.text, len(new) - (stop - start), dict(zip(self.starts, self.tables, strict=True))
        self.text = before[:start] + new + before[stop:]
        starts, tables = self.starts[:first], self.tables[:first]
        for m in self.matcher.finditer(self.text, at):
            if m.start() >= start + len(new) and m.start() - moved in old:
                behind = bisect.bisect_left(self.starts, m.start() - moved)
                starts += [s + moved for s in self.starts[behind:]]
                tables += self.tables[behind:]
                break
            starts.append(m.start())
            tables.append(self._table(m, old.get(m.start()) if m.start() < start else None))
        self.starts, self.tables = starts, tables

    def _table(self, match, held: PrefixTable | None) -> PrefixTable:
        """The table of a match; one that starts where an old one did is made from that."""
        data = match.group().encode()
        if held is None:
            return PrefixTable(self.ranks, data)
        n, k = min(len(held.data), len(data)), 0
        while k < n and held.data[k] == data[k]:
            k += 1
        held.replace(k, len(held.data), data[k:])
        return held

    def ids(self) -> list[int]:
        return [i for t in self.tables for i in t.ids()]


class PrefixEncoder(ChunkEncoder):
    """Encodes texts as the library of the vocabulary does.

    The new matches of a batch are encoded in their order as bytes, and each takes over the
    entries of the prefix that it shares with the one before it.  ``kept`` bounds the chunks
    between white space, and the matches of other texts, that are held.
    """

    def __init__(self, path: str, pattern: str, kept: int = 500_000):
        import public_tokenizers
        import regex

        self.matcher = regex.compile(pattern)
        self.ranks = Ranks.load(path)
        self.spaced, self.lower = True, False
        self.kept, self.older, self.held = kept, {}, {}
        #: only of this pattern it is known that no match crosses a chunk's border
        self.chunked = pattern == public_tokenizers.PATTERN

    def _chunked(self, texts) -> np.ndarray:
        return super()._chunked(texts) if self.chunked else np.zeros(len(texts), bool)

    def _match_ids(self, matches: set[str]) -> dict[str, bytes]:
        """The ids of each match, from the last tokens of its prefixes."""
        ranks, bytes_of = self.ranks, self.ranks.bytes_of
        steps, endings, verdicts = ranks.steps, ranks.endings, ranks.verdicts
        found, before, last, states = {}, b"", [], [0]
        for data, match in sorted((m.encode(), m) for m in matches):
            n, place = min(len(before), len(data)), 0
            while place < n and before[place] == data[place]:
                place += 1
            del last[place:], states[place + 1 :]
            state = states[place]
            for place in range(place, len(data)):
                after = steps.get(state << 8 | data[place])
                state = ranks.step(state, data[place]) if after is None else after
                for token, size in endings[state]:
                    if size > place:
                        break
                    left = last[place - size]
                    verdict = verdicts.get(left << 32 | token)
                    if ranks.follows(left, token) if verdict is None else verdict:
                        break
                else:
                    raise ValueError("no token of the vocabulary ends this prefix")
                last.append(token)
                states.append(state)
            at, ids = len(data), array("I")
            while at:
                ids.append(last[at - 1])
                at -= len(bytes_of[ids[-1]])
            ids.reverse()
            found[match], before = ids.tobytes(), data
        return found

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        return self._encode([self._spell(c) for c in chunks])

    def _encode(self, texts: list[str], whole: bool = False) -> list[bytes]:
        if whole:
            return [self._of_matches(self.matcher.findall(t)) for t in texts]
        # a chunk that is one match needs no matching
        split = [[t] if t[1:].isalpha() and t[0] == " " else self.matcher.findall(t) for t in texts]
        ids = self._match_ids({m for s in split for m in s})
        return [ids[s[0]] if len(s) == 1 else b"".join(map(ids.__getitem__, s)) for s in split]

    def _of_matches(self, matches: list[str]) -> bytes:
        """The ids of a whole text; its matches are held beside the chunks, marked by another sign."""
        kinds = list(dict.fromkeys(matches))
        ids = dict(zip(kinds, self._ids_of(["\1" + m for m in kinds], self._matches_new), strict=True))
        return b"".join(map(ids.__getitem__, matches))

    def _matches_new(self, marked: list[str]) -> list[bytes]:
        ids = self._match_ids({m[1:] for m in marked})
        return [ids[m[1:]] for m in marked]


@functools.cache
def encoder(path: str, pattern: str) -> PrefixEncoder:
    """This process's encoder for a vocabulary file."""
    return PrefixEncoder(path, pattern)


@functools.cache
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each token of a vocabulary file, for this process."""
    return {token: word for word, token in read_ranks(path).items()}


def decode(ids: bytes, path: str) -> bytes:
    """The bytes that little-endian unsigned 32-bit ids stand for."""
    code = array("I")
    code.frombytes(ids)
    return b"".join(map(token_bytes(path).__getitem__, code))


def _texts_through(docs: DataFrame, kinds: dict[str, str], made, text: str = "text") -> DataFrame:
    """All columns but those of ``kinds``, and these, made from each batch of texts."""
    source = free_name(docs, "own text")
    rows = packed(docs.withColumn(source, F.col(quoted(text))), source, without=(source, *kinds))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                columns = made(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], names=["row", *kinds])

    schema = rows.select("row").schema
    for name, kind in kinds.items():
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema).select(*unpacked(rows), *kinds)


def encode_texts(docs: DataFrame, path: str, pattern: str, back: bool = False) -> DataFrame:
    """Adds ``ids``, the tokens of ``text`` as little-endian unsigned 32-bit integers.

    With ``back`` it also adds ``decoded``, the bytes that the ids give again, in one pass.

    Every match of ``pattern`` is encoded by itself, without special tokens.  Rows are encoded
    where they stand, without a shuffle.  Defined cases: null and empty texts have no ids;
    repeated rows and equal texts have equal ids; very long and unbroken texts are encoded
    whole, in time linear in their length; strings of special tokens are ordinary text; an
    older column ``ids`` is replaced, others stay; an empty table gives an empty result.
    """

    def made(texts):
        import pyarrow as pa

        ids = encoder(path, pattern).encode(texts)
        return [pa.array(x, pa.binary()) for x in (ids, [decode(i, path) for i in ids])[: 1 + back]]

    return _texts_through(docs, {"ids": "binary", **({"decoded": "binary"} if back else {})}, made)


def decode_ids(docs: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the bytes that ``ids`` stand for (null: none); all other columns stay."""

    def made(ids):
        import pyarrow as pa

        return [pa.array([decode(i or b"", path) for i in ids], pa.binary())]

    return _texts_through(docs, {"decoded": "binary"}, made, "ids")


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions: the ids of all texts, and the bytes that these give again."""
    import public_tokenizers

    path, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_texts(docs, path, pattern, back=True).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


SQL: dict[str, str] = {}
QUERIES = {"op13_prefix_bpe": op13_prefix_bpe}
