"""Language identification by a linear-chain conditional random field.

Every word of a text gets a label.  A word's features are its affixes, its character
n-grams (hashed) and, for words of the learned lexicon, the word itself; transitions
between labels are learned with them, from training sequences that splice runs of words of
different languages as code-switched text does.  Forward-backward gives each word's label
probabilities, and a document's language is the label with the largest mean probability.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import free_name, materialize, own_columns, packed, quoted, unpacked

UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """Documented bounds of the model; they do not grow with the corpus.

    ``per_language`` distinct texts of each label are gathered for fitting, chosen by a hash of
    the text; ``lexicon`` words are kept per label.
    """

    per_language: int = 300
    buckets: int = 1 << 16
    lexicon: int = 2000
    sequence: int = 24
    sequences: int = 20_000
    batch: int = 500
    epochs: int = 3
    rate: float = 0.3
    seed: int = 5


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters (and letter-like numerals)."""
    return _WORD.findall((text or "").lower())


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def word_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, one after the other, and where each word's features start.

    Of ``^word$``: all runs of 2 and 3 characters, and the first and last runs of 4 and 5,
    so that the marks make affixes of 1 to 4 letters.
    """
    marked = [f"^{w}$" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(codes))  # characters from here to the word's end
    found, who = [], []
    rolled = codes + np.uint64(0x9E37)
    for n in (2, 3, 4, 5):
        rolled = rolled[:-1] * np.uint64(0x9FB21C651E98DF25) + codes[n - 1 :] if len(rolled) > 1 else rolled[:0]
        fits = left[: len(rolled)] >= n
        if n > 3:
            at = np.arange(len(rolled))
            fits &= (at == starts[owner[: len(rolled)]]) | (left[: len(rolled)] == n)
        value = rolled[fits]
        value = value ^ (value >> np.uint64(29))
        found.append((value * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)) % np.uint64(buckets))
        who.append(owner[: len(rolled)][fits])
    who_all = np.concatenate(who)
    order = np.argsort(who_all, kind="stable")
    features = np.concatenate(found)[order].astype(np.int64)
    return features, np.searchsorted(who_all[order], np.arange(len(words)))


@dataclass
class Model:
    """Weights of a fitted field: ``labels``, feature and lexicon weights, transitions."""

    labels: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    transitions: np.ndarray
    first: np.ndarray

    def unary(self, words: list[str]) -> np.ndarray:
        """Scores (words, labels) before transitions."""
        buckets = len(self.weights) - len(self.lexicon) - 1
        features, starts = word_features(words, buckets)
        scores = np.add.reduceat(self.weights[features], starts, axis=0)
        rows = np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))
        return (scores + self.weights[buckets + 1 + rows]).astype(np.float32)


def forward_backward(types: np.ndarray, lengths: np.ndarray, scores: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Label probabilities (time, text, label) of texts given by rows of ``scores``.

    ``types`` is (time, text) and texts are sorted by falling length; places beyond a text's
    end hold zeros.
    """
    steps, texts = types.shape
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    move, begin = np.exp(transitions - transitions.max()), np.exp(first - first.max())
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    alpha = np.zeros((steps, texts, scores.shape[1]), emit.dtype)
    state = begin[None, :] * emit[types[0]]
    alpha[0] = state / state.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        k = active[t]
        state = (alpha[t - 1, :k] @ move) * emit[types[t, :k]]
        alpha[t, :k] = state / state.sum(axis=1, keepdims=True)
    beta = np.ones((texts, scores.shape[1]), emit.dtype)
    for t in range(steps - 2, -1, -1):
        k = active[t + 1]
        back = (emit[types[t + 1, :k]] * beta[:k]) @ move.T
        beta[:k] = back / back.sum(axis=1, keepdims=True)
        now = alpha[t, : active[t]] * beta[: active[t]]
        alpha[t, : active[t]] = now / now.sum(axis=1, keepdims=True)
    return alpha


def fit(samples: list[tuple[str, str]], how: Settings) -> Model | None:
    """Fit a field to (text, label) pairs; None without any word."""
    rng = np.random.default_rng(how.seed)
    labels = sorted({label for _, label in samples})
    texts = [([w for w in words_of(text) if has_letter(w)], labels.index(label)) for text, label in sorted(samples)]
    texts = [x for x in texts if x[0]]
    if not texts:
        return None
    labels = [labels[i] for i in sorted({y for _, y in texts})]
    renumber = {y: i for i, y in enumerate(sorted({y for _, y in texts}))}
    by_label: list[Counter] = [Counter() for _ in labels]
    for words, y in texts:
        by_label[renumber[y]].update(words)
    lexicon: dict[str, int] = {}
    for counts in by_label:
        for word, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: how.lexicon]:
            if n > 2:
                lexicon.setdefault(word, len(lexicon))
    names = {w: i for i, w in enumerate(sorted({w for words, _ in texts for w in words}))}
    vocabulary = list(names)
    features, starts = word_features(vocabulary, how.buckets)
    stops = np.r_[starts[1:], len(features)]
    entry = np.array([how.buckets + 1 + lexicon.get(w, -1) for w in vocabulary])
    streams: list[list[np.ndarray]] = [[] for _ in labels]
    for words, y in texts:
        streams[renumber[y]].append(np.array([names[w] for w in words]))

    n_labels, length = len(labels), how.sequence
    types = np.zeros((how.sequences, length), np.int64)
    marks = np.zeros((how.sequences, length), np.int64)
    for s in range(how.sequences):
        at, y = 0, int(rng.integers(n_labels))
        while at < length:
            text = streams[y][int(rng.integers(len(streams[y])))]
            n = min(int(rng.integers(3, length)), length - at, len(text))
            lo = int(rng.integers(len(text) - n + 1))
            types[s, at : at + n], marks[s, at : at + n] = text[lo : lo + n], y
            at += n
            if rng.random() < 0.5:
                y = int(rng.integers(n_labels))

    weights = np.zeros((how.buckets + 1 + len(lexicon), n_labels))
    moves, first = np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    squares = [np.full(x.shape, 1e-2) for x in (weights, moves, first)]
    lengths = np.full(how.batch, length)
    for _ in range(how.epochs):
        for own in np.array_split(rng.permutation(how.sequences), max(1, how.sequences // how.batch)):
            used, slot = np.unique(types[own], return_inverse=True)
            slot = slot.reshape(len(own), length)
            sizes = stops[used] - starts[used]
            spots = np.repeat(starts[used] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            flat, holder = features[spots], np.repeat(np.arange(len(used)), sizes)
            scores = np.add.reduceat(weights[flat], np.r_[0, np.cumsum(sizes)[:-1]], axis=0) + weights[entry[used]]
            gamma = forward_backward(slot.T, lengths[: len(own)], scores, moves, first)
            truth = np.eye(n_labels)[marks[own]]
            miss = truth - gamma.transpose(1, 0, 2)
            per_type = np.stack([np.bincount(slot.ravel(), miss[:, :, y].ravel(), len(used)) for y in range(n_labels)], axis=1)
            grad = np.stack([np.bincount(flat, per_type[holder, y], len(weights)) for y in range(n_labels)], axis=1)
            np.add.at(grad, entry[used], per_type)
            expected = _pair_counts(slot, scores, moves, first)
            seen = np.zeros_like(moves)
            np.add.at(seen, (marks[own][:, :-1].ravel(), marks[own][:, 1:].ravel()), 1)
            for value, step, square in zip((weights, moves, first), (grad, seen - expected, miss[:, 0].sum(axis=0)), squares, strict=True):
                step = step / len(own) - 1e-6 * value
                square += step * step
                value += how.rate * step / np.sqrt(square)
    return Model(labels, weights.astype(np.float32), lexicon, moves.astype(np.float32), first.astype(np.float32))


def _pair_counts(slot: np.ndarray, scores: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Expected transitions over all sequences, from forward and backward states."""
    emit, move = np.exp(scores - scores.max(axis=1, keepdims=True)), np.exp(moves - moves.max())
    length = slot.shape[1]
    ahead = [np.exp(first - first.max()) * emit[slot[:, 0]]]
    for t in range(1, length):
        state = (ahead[-1] / ahead[-1].sum(axis=1, keepdims=True)) @ move * emit[slot[:, t]]
        ahead.append(state)
    beta, total = np.ones_like(ahead[-1]), np.zeros_like(move)
    for t in range(length - 1, 0, -1):
        after = emit[slot[:, t]] * beta
        pair = ahead[t - 1][:, :, None] * move[None] * after[:, None, :]
        total += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta = after @ move.T
        beta /= beta.sum(axis=1, keepdims=True)
    return total


class Labeller:
    """Labels whole texts with a model; keeps the scores of the words it has met."""

    def __init__(self, model: Model, kept: int = 300_000, room: int = 400_000):
        self.model, self.kept, self.room = model, kept, room
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.used = 0
        self.scores = np.zeros((1024, len(self.model.labels)), np.float32)

    def _types(self, split: list[list[str]]) -> list[np.ndarray]:
        if len(self.ids) > self.kept:
            self._forget()
        new = [w for w in set().union(*split) if w not in self.ids]
        good = [w for w in new if has_letter(w)]
        self.ids.update(dict.fromkeys(new, -1))
        if good:
            at = self.used
            while len(self.scores) < at + len(good):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[at : at + len(good)] = self.model.unary(good)
            self.ids.update(zip(good, range(at, at + len(good)), strict=True))
            self.used = at + len(good)
        get = self.ids.__getitem__
        found = [np.fromiter(map(get, words), np.int64, len(words)) for words in split]
        return [x[x >= 0] for x in found]

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(label, score) of each text; ``und`` and 0 where there is no letter."""
        return [found[:2] for found in self.label_surely(texts)]

    def label_surely(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """As ``label``, and the mean over a text's words of their largest label probability."""
        types = self._types([words_of(t) for t in texts])
        out = [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        order = sorted((i for i in range(len(texts)) if len(types[i])), key=lambda i: -len(types[i]))
        at = 0
        while at < len(order):
            n = max(1, self.room // len(types[order[at]]))
            own, at = order[at : at + n], at + n
            lengths = np.array([len(types[i]) for i in own])
            table = np.zeros((lengths[0], len(own)), np.int64)
            for j, i in enumerate(own):
                table[: len(types[i]), j] = types[i]
            m = self.model
            gamma = forward_backward(table, lengths, self.scores, m.transitions, m.first)
            mean = gamma.sum(axis=0, dtype=np.float64) / lengths[:, None]
            best = mean.argmax(axis=1)
            sure = gamma.max(axis=2).sum(axis=0, dtype=np.float64) / lengths
            for j, i in enumerate(own):
                out[i] = (m.labels[best[j]], min(1.0, float(mean[j, best[j]])), min(1.0, float(sure[j])))
        return out


def held_out(doc_id: Column) -> Column:
    """The fixed split: crc32 of the doc_id as text, modulo 4, is 2.  A null doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, how: Settings) -> list[tuple[str, str]]:
    """Distinct labelled texts outside the held-out part, at most ``per_language`` of each label.

    A text with several labels has its commonest one, of equally common ones the first by
    code point.
    """
    own = docs.select("text", F.col("lang").cast("string").alias("lang"), "doc_id").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    own = own.where(~held_out(F.col("doc_id")))
    own = own.select("text", "lang", F.xxhash64("text", F.lit(how.seed)).alias("h"), F.xxhash64(F.lit(how.seed), "text").alias("k"))
    rows = own.groupBy("h", "k", "lang").agg(F.count(F.lit(1)).alias("n"))
    texts = rows.groupBy("h", "k").agg(F.min(F.struct(-F.col("n"), "lang")).getField("lang").alias("lang"))
    texts = materialize(texts, "labelled")
    counts = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, 2.0 * how.per_language / n)))])
    draw = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    some = texts.withColumn("draw", draw).where(F.col("draw") <= F.element_at(share, F.col("lang")))
    first = Window.partitionBy("lang").orderBy("draw", "h", "k")
    drawn = some.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= how.per_language).select("h", "k", "lang")
    # bounded: per_language keys of each label
    found = own.drop("lang").join(F.broadcast(drawn), ["h", "k"]).groupBy("h", "k", "lang").agg(F.first("text").alias("text"))
    return [(r["text"], r["lang"]) for r in found.select("text", "lang").collect()]


def identify_languages(
    docs: DataFrame, how: Settings | None = None, out: str = "lang_pred", score: str = "lang_score", sure: str | None = None
) -> DataFrame:
    """Adds ``out`` (a learned label or ``und``) and ``score`` (0 to 1); other columns stay.

    With a name in ``sure`` also the mean over the words of their largest label probability.

    Defined cases: null texts and texts without a letter are ``und`` with score 0, as is
    everything when there is nothing to learn from; equal texts get equal predictions; ties
    go to the first label by code point; very long texts and unbroken words are labelled
    whole; older columns of these names are replaced; an empty table gives an empty result.
    """
    how = how or Settings()
    spark = docs.sparkSession
    model = fit(training_sample(docs, how), how)
    numbers = [score] if sure is None else [score, sure]
    if model is None:
        docs = docs.select(*own_columns(docs, out, *numbers))
        return docs.withColumn(out, F.lit(UNDETERMINED)).withColumns({c: F.lit(0.0) for c in numbers})
    # bounded: buckets + lexicon rows of one float per label, a few MB
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        labeller = Labeller(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                found = labeller.label_surely(some.column(at).to_pylist())
                values = [pa.array([x[k] for x in found], pa.float64()) for k in range(1, len(numbers) + 1)]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array([x[0] for x in found], pa.string()), *values],
                    names=[*some.schema.names, out, *numbers],
                )

    rows = packed(docs, "text", without=(out, *numbers))
    added = [T.StructField(out, T.StringType()), *[T.StructField(c, T.DoubleType()) for c in numbers]]
    found = rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))
    return found.select(*unpacked(rows), *[F.col(quoted(c)) for c in (out, *numbers)])


def keep_identified(docs: DataFrame, how: Settings | None = None, least: float = 0.4) -> DataFrame:
    """The documents whose words' languages are determined with at least this mean probability.

    A text of several languages stays when each word's is clear; same columns.  Defined cases:
    null texts and texts without a letter go; very long texts are judged whole; repeated rows
    stay or go together; an empty table gives an empty result.
    """
    found = identify_languages(docs, how, *[free_name(docs, c) for c in ("_lang", "_lang_score", "_lang_sure")])
    lang, _, sure = found.columns[-3:]
    return found.where((F.col(lang) != UNDETERMINED) & (F.col(sure) >= least)).select(*own_columns(docs))


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify_languages(docs).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


SQL: dict[str, str] = {}
QUERIES = {"op6_language_crf": op6_language_crf}
