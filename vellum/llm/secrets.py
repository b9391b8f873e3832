"""Secret scans over whole texts, in DataFrame functions only.

Three fixed patterns give the base spans.  Beside them, every long run of key-like
characters is a candidate, cut at the tokens of the allow-list.  A window slides over it, one
character in and one out per step; the counts of these two change the sum of c*log2(c) from
which the window's Shannon entropy follows.  Windows at or above the
threshold of the candidate's character class are joined into spans of kind ``entropy``.

All steps are linear in the text: positions are summed in groups, and a candidate is walked
in stretches that overlap by a window less one, so no step copies what came before it.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import free_name, own_columns, quoted

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Matches whose positions are summed together, and characters of a stretch.
GROUP, STRETCH = 256, 128
#: Characters of the pieces from which a redacted text is put together.
PIECE = 1024
MARK = "[secret]"


@dataclass(frozen=True)
class EntropyScan:
    """Parameters of the sliding window.

    A run is ``window`` or more key-like characters.  Where an allowed token lies in it, the
    run is cut, so that only the windows that overlap the token are suppressed; what is left
    is a candidate unless it is an allowed value as a whole.  Each class of candidates has
    its alphabet's threshold in bits per character; the first class that fits holds.
    """

    window: int = 20
    run: str = "[A-Za-z0-9+/_-]"
    classes: tuple[tuple[str, float], ...] = (
        (r"^[0-9]+$", 3.2),
        (r"^[0-9a-fA-F]+$", 3.0),
        (r"^[A-Za-z]+$", 4.1),
        (r"^[A-Za-z0-9]+$", 3.7),
        (r"", 3.8),
    )
    allow_tokens: str = r"(?i:example|placeholder|changeme|dummy)|0123456789|abcdefghij|ABCDEFGHIJ"
    #: names and paths without a digit, and UUIDs
    allow: tuple[str, ...] = field(
        default=(r"^(?=.*[+/_-])[A-Za-z+/_-]+$", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    )
    allow_values: tuple[str, ...] = ()


_FOUND = "array<struct<v:string,s:int,e:int>>"
_SPANS = "array<struct<s:int,kind:int,e:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _groups(rows: Column, n: int) -> Column:
    """An array cut into arrays of ``n``."""
    return F.transform(F.sequence(F.lit(0), F.size(rows) - 1, F.lit(n)), lambda k: F.slice(rows, k + 1, n))


def _located(text: Column, pattern: str) -> Column:
    """The matches of a pattern with their code point positions, as ``_FOUND``.

    The pieces between the matches come from ``split``; a match starts where the pieces and
    matches before it end.  Ends are summed within groups, then over the groups.
    """

    def step(state, x):
        s = state["pos"] + x["gap"]
        e = s + F.length(x["v"])
        return F.struct(e.alias("pos"), F.concat(state["found"], F.array(F.struct(x["v"].alias("v"), s.alias("s"), e.alias("e")))).alias("found"))

    def placed(local):
        zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
        before = F.aggregate(
            local, zero, lambda a, x: F.struct((a["sum"] + x["pos"]).alias("sum"), F.concat(a["all"], F.array(a["sum"])).alias("all"))
        )["all"]
        move = lambda x, by: F.transform(
            x["found"], lambda f: F.struct(f["v"].alias("v"), (f["s"] + by).alias("s"), (f["e"] + by).alias("e"))
        )
        return F.flatten(F.zip_with(local, before, move))

    def positions(matches):
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        pairs = F.zip_with(matches, gaps, lambda v, gap: F.struct(v.alias("v"), F.length(gap).alias("gap")))
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(_FOUND).alias("found"))
        local = lambda rows: F.transform(_groups(rows, GROUP), lambda g: F.aggregate(g, start, step))
        return _let(_let(pairs, local), placed)

    none = F.array().cast(_FOUND)
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, positions(m)).otherwise(none))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e"))).cast(_SPANS)


def _hot_ends(codes: Column, start: Column, bits: Column, w: int) -> Column:
    """Ends of the windows of one stretch whose entropy reaches the threshold.

    A step takes one character in and, once the window is full, one out.  Both counts are
    those in the ``w - 1`` characters that stay, and change the sum of c*log2(c) by what a
    table of gains says.  ``start`` is the position of the first character.
    """
    clog = [c * math.log2(c) if c > 1 else 0.0 for c in range(w + 1)]
    gains = F.array(*[F.lit(b - a) for a, b in itertools.pairwise(clog)])
    zero = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("hot"))

    def gain(i, at):
        """What one more of the character at ``at`` adds to the characters that stay at step ``i``."""
        first = F.greatest(i - w + 1, F.lit(1))
        stay = F.slice(codes, first, i - first)
        return F.get(gains, i - first - F.size(F.array_remove(stay, F.get(codes, at))))

    def step(state, i):
        total = state["sum"] + gain(i, i - 1) - F.when(i > w, gain(i, i - w - 1)).otherwise(0.0)
        # the sums of floating point numbers may miss a tie by a little
        hot = (i >= w) & (math.log2(w) - total / w >= bits - 1e-9)
        return F.struct(total.alias("sum"), F.when(hot, F.concat(state["hot"], F.array(start + i))).otherwise(state["hot"]).alias("hot"))

    return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step)["hot"]


def _entropy_spans(value: Column, offset: Column, scan: EntropyScan) -> Column:
    """Spans of the windows of one candidate whose entropy reaches the threshold."""
    w = scan.window
    *some, (_, last) = scan.classes
    bits = F.lit(last)
    for pattern, own in reversed(some):
        bits = F.when(value.rlike(pattern), F.lit(own)).otherwise(bits)

    def ends(chunks, bits):
        def stretch(chunk, k):
            carried = F.when(k > 0, F.right(F.get(chunks, k - 1), F.lit(w - 1))).otherwise(F.lit(""))
            piece = F.concat(carried, chunk)
            codes = F.transform(F.split(piece, ""), F.ascii)
            return _let(codes, lambda c: _hot_ends(c, offset + k * STRETCH - F.when(k > 0, w - 1).otherwise(0), bits, w))

        return F.flatten(F.transform(chunks, stretch))

    def joined(at):
        first = F.filter(at, lambda x, k: F.coalesce(x - F.get(at, k - 1) > w, F.lit(True)))
        final = F.filter(at, lambda x, k: F.coalesce(F.get(at, k + 1) - x > w, F.lit(True)))
        return F.zip_with(first, final, lambda a, b: F.struct((a - w).alias("s"), F.lit(3).alias("kind"), b.alias("e")))

    # candidates are ASCII
    chunks = F.regexp_extract_all(value, F.lit(f".{{1,{STRETCH}}}"), F.lit(0))
    return _let(_let(F.struct(chunks.alias("c"), bits.alias("b")), lambda x: _let(x["c"], lambda c: ends(c, x["b"]))), joined)


def secret_spans(text: Column, scan: EntropyScan | None = None) -> Column:
    """All spans of a text that is not null: ``array<struct<s, kind, e>>``, sorted."""
    scan = scan or EntropyScan()
    long_value = lambda x: F.length(F.regexp_extract(x["v"], "^(?:" + ASSIGN + ")$", 2)) >= 6
    base = F.concat(_spans(F.filter(_located(text, ASSIGN), long_value), 0), _spans(_located(text, ACCESS), 1), _spans(_located(text, HEX), 2))

    allowed = lambda v: F.lit(False) if not scan.allow_values else v.isin(*scan.allow_values)

    def candidates(run):
        # a piece between tokens, or a token, which is too short to hold a window or equals none of its classes
        piece = f"{scan.allow_tokens}|(?:(?!{scan.allow_tokens}){scan.run})+"
        pieces = F.when(run["v"].rlike(scan.allow_tokens), _located(run["v"], piece)).otherwise(
            F.array(F.struct(run["v"].alias("v"), F.lit(0).alias("s"), F.length(run["v"]).alias("e")))
        )

        def counts(x):
            ok = (F.length(x["v"]) >= scan.window) & ~allowed(x["v"]) & ~x["v"].rlike(f"^(?:{scan.allow_tokens})$")
            for pattern in scan.allow:
                ok = ok & ~x["v"].rlike(pattern)
            return ok

        return F.flatten(F.transform(F.filter(pieces, counts), lambda x: _entropy_spans(x["v"], run["s"] + x["s"], scan)))

    runs = _located(text, f"{scan.run}{{{scan.window},}}")
    return F.array_sort(F.concat(base, F.flatten(F.transform(runs, candidates)).cast(_SPANS)))


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", scan: EntropyScan | None = None) -> DataFrame:
    """Adds ``out``: an array of ``struct<s:int, kind:int, e:int>`` of all spans, sorted.

    ``kind`` counts in ``KINDS``; positions are code points, the end is exclusive; base
    spans cover the whole match of their pattern.  All other columns stay as they are,
    whatever their names; an older column of the name ``out`` is replaced.  Defined cases:
    null or empty text has no span; repeated rows give equal spans; an empty table gives an
    empty result; very long texts, candidates and numbers of matches take linear time.
    """
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    return docs.select(*own_columns(docs, out), secret_spans(body, scan).alias(out))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def _redacted(text: Column, spans: Column) -> Column:
    """The text with what the spans cover replaced by ``MARK``; touching spans are one."""

    def gaps(group, reached):
        # the clean stretch before each span that starts beyond all earlier ones
        def step(state, x):
            fresh = (x["s"] > state["pos"]) | (state["pos"] == 0)
            gap = F.array(F.struct(state["pos"].alias("a"), x["s"].alias("b")))
            return F.struct(F.greatest(state["pos"], x["e"]).alias("pos"), F.when(fresh, F.concat(state["gaps"], gap)).otherwise(state["gaps"]).alias("gaps"))

        return F.aggregate(group, F.struct(reached.alias("pos"), F.array().cast("array<struct<a:int,b:int>>").alias("gaps")), step)["gaps"]

    def clean(groups):
        zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("all"))
        far = F.aggregate(
            groups,
            zero,
            lambda a, g: F.struct(F.greatest(a["pos"], F.array_max(F.transform(g, lambda x: x["e"]))).alias("pos"), F.concat(a["all"], F.array(a["pos"])).alias("all")),
        )
        tail = lambda f: F.array(F.struct(f["pos"].alias("a"), F.length(text).alias("b")))
        return _let(far, lambda f: F.concat(F.flatten(F.zip_with(groups, f["all"], gaps)), tail(f)))

    def cut(pieces, x):
        first = F.floor(x["a"] / PIECE).cast("int")
        some = F.array_join(F.slice(pieces, first + 1, F.floor(x["b"] / PIECE).cast("int") - first + 1), "")
        return F.substring(some, x["a"] - first * PIECE + 1, x["b"] - x["a"])

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    kept = lambda own: F.transform(_let(_groups(spans, GROUP), clean), lambda x: cut(own, x))
    return F.array_join(_let(pieces, kept), MARK)


def redact_secrets(docs: DataFrame, scan: EntropyScan | None = None) -> DataFrame:
    """The documents with every secret replaced by ``[secret]``; same columns.

    Overlapping and touching spans are one; ``n_chars``, where there is one, follows the
    text.  Defined cases as in ``find_secrets``: null and empty texts and texts without a
    secret stay as they are.
    """
    spans, new = free_name(docs, "_spans"), free_name(docs, "_new")
    df = find_secrets(docs, out=spans, scan=scan)
    hit = F.size(spans) > 0
    df = df.withColumn(new, F.when(hit, _redacted(F.col("text"), F.col(spans))).otherwise(F.col("text")))

    def column(name):
        if name == "text":
            return F.col(new).alias(name)
        if name == "n_chars":
            return F.when(hit, F.length(new)).otherwise(F.col(name)).cast(docs.schema[name].dataType).alias(name)
        return F.col(quoted(name))

    return df.select(*[column(c) for c in docs.columns])


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs).select("doc_id", "secrets")
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"] < 3)
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("secrets")).alias("spans"),
    )


SQL: dict[str, str] = {}
QUERIES = {"op3_secret_scan": op3_secret_scan}
