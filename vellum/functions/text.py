"""Text rules as Column expressions.

White space and letters are Unicode throughout; lengths are code points unless a rule says
bytes.  Every function stays in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# --- fixed values: lists that must equal the data model's -------------------------------
HEADING_OPENERS = ["chapter", "book", "part", "section", "appendix", "preface", "introduction", "volume", "article", "canto"]
CHAPTER_WORDS = ["chapter", "canto", "act", "letter", "epistle", "lecture"]
PART_WORDS = ["book", "part", "volume"]
STANDALONE = ["introduction", "preface", "prologue", "epilogue", "foreword", "afterword", "conclusion", "appendix", "postscript", "contents"]
MINOR_WORDS = ["a", "an", "the", "of", "in", "on", "for", "and", "or", "to", "from", "by", "with", "at", "as", "but", "nor", "into", "upon", "per"]
RUNNING_WORDS = ["ch", "chap", "chapter", "bk", "book", "sec", "vol"]
STRUCTURAL_MARKERS = ["chapter", "ch.", "book", "part", "section", "sec.", "vol.", "volume"]
ABBREVIATIONS = ["mr.", "mrs.", "ms.", "dr.", "st.", "prof.", "e.g.", "i.e.", "etc.", "vs.", "jr.", "sr.", "rev.", "cf.", "viz.", "ibid."]
COMMENTARY = [
    "no complete transcription",
    "the continuation is missing",
    "cut off before it can be",
    "unable to transcribe",
    "the transcription is incomplete",
    "no transcription can be",
    "i cannot provide",
    "i'm unable to",
    "as an ai",
    "no text is visible",
    "the image is too blurry",
    "appears to be a scan",
]
TRAILING_META = [
    "transcription",
    "transcribed",
    "the image",
    "this image",
    "the instructions",
    "no additional text",
    "text is present",
    "the page content",
    "as requested",
]
LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("æ", "ae"), ("Æ", "Ae"), ("œ", "oe"), ("Œ", "Oe"), ("ẞ", "Ss")]
HYPHENS = "-‐­‑"
SENTENCE_ENDS = ".!?\"”’"
GENERIC_QUESTION = "Read the paragraph again. What is the one thing it is trying to tell you?"
SHARED_RUN = 6
# -----------------------------------------------------------------------------------------

_NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]"


#: All characters that Unicode calls white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Trimmed, with every run of white space as one space; most texts are so already."""
    loose = r"(?U)\s\s|[^\S ]"
    return let(trim(c), lambda t: F.when(t.rlike(loose), F.regexp_replace(t, r"(?U)\s+", " ")).otherwise(t))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def core(c: Column) -> Column:
    """Without what is neither letter nor number at either end."""
    return F.regexp_replace(c, f"^{_NOT_ALNUM}+|{_NOT_ALNUM}+$", "")


def _any_of(c: Column, parts: list[str]) -> Column:
    return let(c, lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(p)) for p in parts]))


def is_furniture(line: Column) -> Column:
    """Rules, and lines of up to 12 characters that are a page number.

    Prose is told from both by its first characters.
    """
    t = F.btrim(trim(line), F.lit("[]"))
    bare = F.regexp_replace(t, r"(?U)\s+", "")
    rule = (F.octet_length(t) >= 3) & t.rlike(r"^[-_*]+$")
    number = (F.length(t) <= 12) & (bare.rlike("^[0-9]+$") | F.lower(bare).rlike("^[ivxlcdm]+$"))
    return line.rlike(r"(?U)^[\s\[\]]*+[-_*0-9ivxlcdmIVXLCDM\s]*+[\[\]\s]*+$") & (rule | number)


def is_all_caps(c: Column) -> Column:
    return c.rlike(r"\p{IsAlphabetic}") & ~c.rlike(r"\p{IsLowercase}")


def is_title_case(text: Column) -> Column:
    t = trim(text)
    cores = F.transform(words(t), lambda w, i: F.when((i > 0) & F.lower(core(w)).isin(MINOR_WORDS), "").otherwise(core(w)))
    carrying = F.filter(cores, lambda w: w != "")
    return (
        (F.length(t) <= 80)
        & word_count(t).between(2, 10)
        & (F.size(carrying) >= 2)
        & F.forall(carrying, lambda w: w.rlike(r"^\p{IsUppercase}"))
    )


def looks_like_heading(text: Column) -> Column:
    short = r"(?U)^\S++(?:\s++\S++){0,11}+$"  # at most 12 words
    words_of = lambda t: F.filter(F.split(t, r"(?U)\s+", 14), lambda w: w != "")
    return let(trim(text), lambda t: F.when(t.rlike(short), let(words_of(t), lambda w: _heading_like(t, w))).otherwise(False))


def _heading_like(t: Column, w: Column) -> Column:
    """Of a trimmed text and its first words, at most 14."""
    n, first = F.size(w), F.lower(core(F.try_element_at(w, F.lit(1))))
    return (
        F.when((t == "") | (n > 12), False)
        .when(t.rlike(r"^(§|Sec\.|SEC\.)"), True)
        .when(first.isin(HEADING_OPENERS) & (n <= 6), True)
        .when(is_all_caps(t) & (n <= 8), True)
        .when((n <= 8) & ~t.rlike("[.!?,;:]$") & t.rlike(r"^\p{IsUppercase}"), True)
        .otherwise(is_title_case(t))
    )


def line_kind(line: Column) -> Column:
    t = trim(line)
    return F.when(t.startswith("#") & t.rlike("^#{1,4} "), "heading").when(t.startswith("> "), "quote").otherwise("paragraph")


def line_content(line: Column) -> Column:
    t = trim(line)
    return F.when(t.startswith("#") | t.startswith(">"), trim(F.regexp_replace(t, "^(#{1,4}|>) ", ""))).otherwise(t)


def _end(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def ends_mid_sentence(text: Column) -> Column:
    t = _end(text)
    return (t != "") & ~t.rlike(f"[{SENTENCE_ENDS}]$")


def starts_mid_sentence(text: Column) -> Column:
    return text.rlike(r"^\P{IsAlphabetic}*\p{IsLowercase}")


def _normal(text: Column) -> Column:
    return F.lower(trim(F.regexp_replace(trim(text), "[.:—-]+$", "")))


def is_numeral(token: Column) -> Column:
    t = core(token)
    return t.rlike("^([0-9]+|[ivxlcdmIVXLCDM]+)$")


def is_running_head(text: Column) -> Column:
    rest = F.slice(words(F.lower(text)), 2, 1_000_000)
    return text.rlike(r"[\[\]]") | F.exists(rest, lambda w: core(w).isin(RUNNING_WORDS))


def heading_level(text: Column) -> Column:
    """part, chapter, section, topic or minor."""
    return let(_normal(text), lambda t: let(words(t), lambda w: _level(text, t, w)))


def _level(text: Column, t: Column, w: Column) -> Column:
    """Of a heading, its normal form and the words of that."""
    n, head = F.size(w), F.get(w, F.lit(0))
    return let(
        core(head),
        lambda first: F.when(t == "", "minor")
        .when(first.isin(PART_WORDS) & (n <= 4), "part")
        .when(first.isin(STANDALONE) & (n <= 3), "part")
        .when(first.isin(CHAPTER_WORDS) & (n <= 4), "chapter")
        .when(t.startswith("§") | first.isin("sec", "section"), "section")
        .when((n == 1) & is_numeral(head), "chapter")
        .when(is_title_case(text) & ~is_all_caps(text) & ~is_running_head(text), "topic")
        .otherwise("minor"),
    )


def is_bare_marker(text: Column) -> Column:
    def judged(w):
        n, one, two = F.size(w), F.get(w, F.lit(0)), F.get(w, F.lit(1))
        return (
            F.when(n == 1, is_numeral(one) | one.isin(STANDALONE))
            .when(n == 2, core(one).isin(CHAPTER_WORDS + PART_WORDS) & is_numeral(two))
            .otherwise(False)
        )

    return let(words(_normal(text)), judged)


def roman_value(text: Column) -> Column:
    """Additive and subtractive reading of a roman numeral, 1 to 3999, else null."""
    low = F.lower(text)
    worth = F.array(*[F.lit(v) for v in (1, 5, 10, 50, 100, 500, 1000)])
    letters = F.filter(F.split(low, ""), lambda c: c != "")
    values = F.transform(letters, lambda c: F.element_at(worth, F.greatest(F.lit(1), _position(c))))
    total = F.aggregate(
        F.zip_with(values, F.concat(F.slice(values, 2, 1_000_000), F.array(F.lit(0))), lambda a, b: F.when(a < b, -a).otherwise(a)),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return F.when(low.rlike("^[ivxlcdm]+$") & total.between(1, 3999), total)


def _position(c: Column) -> Column:
    return F.call_function("locate", c, F.lit("ivxlcdm"))


def number_on_line(line: Column) -> Column:
    """The page number that a line is, or null: 1 to 2999, or a roman numeral."""
    t = F.regexp_replace(trim(line), r"(?U)^[\[\]\-.\s]+|[\[\]\-.\s]+$", "")
    number = t.cast("string").rlike(r"^\+?[0-9]+$")
    value = F.regexp_replace(t, r"^\+", "").try_cast("long")
    return F.when(
        (t != "") & (F.length(t) <= 8), F.when(number, F.when(value.between(1, 2999), value)).otherwise(roman_value(t))
    )


def folio_reply(reply: Column) -> Column:
    t = trim(reply)
    return F.when((t == "") | (F.lower(t) == "none") | (word_count(t) > 2), None).otherwise(number_on_line(t))


def without_structural_numerals(line: Column) -> Column:
    """Empty for a line that names a chapter, book, part, section or volume."""
    return F.when(_any_of(F.lower(line), STRUCTURAL_MARKERS), "").otherwise(line)


def is_commentary(text: Column) -> Column:
    return (F.length(text) <= 300) & _any_of(F.lower(text), COMMENTARY)


def is_trailing_meta(text: Column) -> Column:
    return (F.length(text) <= 300) & _any_of(F.lower(text), TRAILING_META)


def furniture_key(text: Column) -> Column:
    t = F.lower(F.regexp_replace(trim(text), r"(?U)^[§#0-9.\s]+", ""))
    return squeeze(F.regexp_replace(t, r"(?U)[^\p{IsAlphabetic}\p{N}\s]", ""))


def preview(text: Column, limit: int = 70) -> Column:
    """The text on one line: whole words up to ``limit``, then an ellipsis."""
    clean = squeeze(text)
    cut = F.regexp_extract(F.concat(clean, F.lit(" ")), f"^(.{{1,{limit}}}) ", 1)
    return F.when(F.length(clean) <= limit, clean).otherwise(
        F.concat(F.when(cut == "", F.substring(clean, 1, limit)).otherwise(cut), F.lit("…"))
    )


def sentences(text: Column) -> Column:
    """Sentences of a paragraph, closed by a mark before a word that opens a new one.

    The places where sentences close are listed, and the words are cut there.
    """

    def closes(w, x, i):
        opener = F.coalesce(F.get(w, i + 1).rlike(r'^[^\p{IsAlphabetic}\p{N}"“]*[\p{IsUppercase}0-9"“]'), F.lit(False))
        return x.rlike("[.!?]$") & ~F.lower(x).isin(ABBREVIATIONS) & opener

    def cut(w):
        ends = F.filter(F.transform(w, lambda x, i: F.when((i == F.size(w) - 1) | closes(w, x, i), i)), lambda i: i.isNotNull())
        first = lambda e, k: F.coalesce(F.get(e, k - 1) + 1, F.lit(0))
        return let(ends, lambda e: F.transform(e, lambda x, k: F.array_join(F.slice(w, first(e, k) + 1, x - first(e, k) + 1), " ")))

    return let(words(text), cut)


def expand_ligatures(text: Column) -> Column:
    for mark, plain in LIGATURES:
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def normalise(text: Column, level: str = "full") -> Column:
    """off: as it is; light: ligatures; full: ligatures and the long s."""
    if level == "off":
        return text
    out = expand_ligatures(text)
    return F.replace(out, F.lit("ſ"), F.lit("s")) if level == "full" else out


def join_hyphenated(left: Column, right: Column) -> Column:
    """Close a word that a line break split, without a lexicon.

    The halves merge if the second starts in lower case, else they keep a hyphen; with
    punctuation between them, or without letters, they are only put side by side.
    """
    body = F.regexp_replace(left, f"[{HYPHENS}]+$", "")
    opener = r"(?U)^(\p{IsAlphabetic})"
    head = F.regexp_replace(right, r"(?U)^\s+", "")
    clean = body.rlike(r"\p{IsAlphabetic}$") & head.rlike(opener)
    merge = head.rlike(r"^\p{IsLowercase}")
    return F.when(clean, F.concat(body, F.when(merge, "").otherwise("-"), head)).otherwise(F.concat(body, right))


def stitch(tail: Column, head: Column) -> Column:
    """Join the end of one page to the start of the next; an empty side is left out."""
    t, h = _end(tail), F.regexp_replace(head, r"(?U)^\s+", "")
    return (
        F.when(t == "", h).when(h == "", t).when(t.rlike(f"[{HYPHENS}]$"), join_hyphenated(t, h)).otherwise(F.concat(t, F.lit(" "), h))
    )


def scrub_question(question: Column, paragraph: Column) -> Column:
    """The generic question if the question quotes six words of the paragraph in a row."""
    return F.when(shares_run(question, paragraph) | (trim(question) == ""), GENERIC_QUESTION).otherwise(trim(question))


def plain_words(text: Column) -> Column:
    """Words in lower case without marks at either end; what is only marks is no word.

    The marks of all words go in one pass over the text.
    """
    mark = r"[^\p{IsAlphabetic}\p{N}\s]+"
    bare = F.regexp_replace(text, rf"(?U)(?<=\s|^){mark}|{mark}(?=\s|$)", "")
    return F.filter(F.split(F.lower(bare), r"(?U)\s+"), lambda w: w != "")


def runs(w: Column, n: int = SHARED_RUN) -> Column:
    """All runs of ``n`` words, space-joined; empty if there are fewer words.

    The words are zipped with themselves, moved on by 1 to n - 1: an outer array inside a
    lambda would be made again for each element.
    """
    moved = F.arrays_zip(*[F.slice(w, k + 1, 1 << 30) for k in range(n)])
    full = F.filter(moved, lambda x: x[str(n - 1)].isNotNull())
    return F.transform(full, lambda x: F.concat_ws(" ", *[x[str(k)] for k in range(n)]))


def run_hashes(w: Column, n: int = SHARED_RUN) -> Column:
    """A 64-bit hash of each run of ``n`` words, in order."""

    def hashed(h):
        at = F.sequence(F.lit(0), F.size(h) - n)
        return F.when(F.size(h) >= n, F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(w, lambda x: F.xxhash64(x)), hashed)


def shares_run(question: Column, paragraph: Column) -> Column:
    q, p = plain_words(question), plain_words(paragraph)
    return (F.size(q) > SHARED_RUN) & F.arrays_overlap(runs(q), runs(p))


def strip_code_fence(text: Column) -> Column:
    t = trim(text)
    rest = F.regexp_replace(t, r"^```[^\n]*\n", "")
    rest = F.when(t.rlike(r"^```[^\n]*\n"), rest).otherwise(F.regexp_replace(t, "^```", ""))
    return F.when(t.startswith("```"), trim(F.regexp_replace(_end(rest), "```$", ""))).otherwise(t)


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("...")))


def host(text: Column, default: str) -> Column:
    t = F.regexp_replace(trim(text), "/+$", "")
    return F.when(t == "", default).when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit("http://"), t))


def surface(word: Column) -> Column:
    """A word without the marks around it, in lower case; empty without letter or digit."""
    t = F.regexp_replace(trim(word), r"^[^\p{IsAlphabetic}\p{N}'-]+|[^\p{IsAlphabetic}\p{N}'-]+$", "")
    return F.when(t.rlike(r"[\p{IsAlphabetic}\p{N}]"), F.lower(t)).otherwise("")


def lemma_candidates(word: Column) -> Column:
    """Possible base forms of a regularly inflected word, likeliest first."""

    def stem(suffix: str, add: str = "") -> Column:
        return F.when(word.endswith(suffix), F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(add)))

    def undoubled(suffix: str) -> Column:
        s = stem(suffix)
        return F.when(s.rlike(r"(\p{IsAlphabetic})\1$") & ~s.rlike("[aeiou]$"), F.substring(s, F.lit(1), F.length(s) - 1))

    found = F.array(
        stem("ies", "y"), stem("es"), stem("s"), stem("ied", "y"), stem("ed"), stem("ed", "e"), undoubled("ed"),
        stem("ing"), stem("ing", "e"), undoubled("ing"), stem("est"), stem("est", "e"), stem("er"), stem("er", "e"),
        stem("ly"), stem("eth"), stem("eth", "e"),
    )
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (F.octet_length(x) >= 2)))
