"""A full-text index with word stems (Porter 1980), and searches for phrases in it."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, part_of
from ..sources.library import staged
from .lexicon import FEW_WORDS

# --- fixed values: the endings of the stemmer's steps -------------------------------------
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
#: Words beyond these lengths are their own stems.
SHORTEST, LONGEST = 3, 64
#: Tokens of a text that are looked through together.
STRETCH = 64
# -----------------------------------------------------------------------------------------

#: Runs of consonants and of vowels; y is a vowel after a consonant.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"


def _measured(stem: Column, least: int) -> Column:
    """Has the stem at least so many vowel runs that a consonant run follows?"""
    return stem.rlike(f"^({_C})?({_V}{_C}){{{least}}}")


def _voiced(stem: Column) -> Column:
    return stem.rlike(f"^({_C})?[aeiouy]")


def _closed(stem: Column) -> Column:
    """Is it consonants, one vowel and one consonant other than w, x and y?"""
    return stem.rlike(f"^{_C}[aeiouy][^aeiouwxy]$")


def _mapped(word: Column, endings: dict[str, str]) -> Column:
    """The longest ending replaced, if the stem before it has a measure above 0."""
    pattern = f"^(.+?)({'|'.join(endings)})$"
    to = F.create_map(*[F.lit(x) for pair in endings.items() for x in pair])

    def told(x):
        return F.when((x["end"] != "") & _measured(x["stem"], 1), F.concat(x["stem"], to[x["end"]])).otherwise(x["word"])

    return let(F.struct(word.alias("word"), F.regexp_extract(word, pattern, 1).alias("stem"), F.regexp_extract(word, pattern, 2).alias("end")), told)


def _past(word: Column) -> Column:
    """Endings of the past and of the participle."""

    def told(x):
        word, stem = x["word"], x["stem"]
        mended = (
            F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
            .when(stem.rlike(r"([^aeiouylsz])\1$"), F.substring(stem, F.lit(1), F.length(stem) - 1))
            .when(_closed(stem), F.concat(stem, F.lit("e")))
            .otherwise(stem)
        )
        double = F.regexp_extract(word, "^(.+?)eed$", 1)
        return F.when(word.rlike("^.+eed$"), F.when(_measured(double, 1), F.regexp_replace(word, "d$", "")).otherwise(word)).when((stem != "") & _voiced(stem), mended).otherwise(word)

    return let(F.struct(word.alias("word"), F.regexp_extract(word, "^(.+?)(ed|ing)$", 1).alias("stem")), told)


def _dropped(word: Column) -> Column:
    """Endings that go where the stem has a measure above 1."""
    plain, ion = f"^(.+?)({'|'.join(STEP_4)})$", "^(.+?[st])ion$"

    def told(x):
        stem = F.when(x["plain"] != "", x["plain"]).otherwise(x["ion"])
        return F.when((stem != "") & _measured(stem, 2), stem).otherwise(x["word"])

    return let(F.struct(word.alias("word"), F.regexp_extract(word, plain, 1).alias("plain"), F.regexp_extract(word, ion, 1).alias("ion")), told)


def _silent(word: Column) -> Column:
    """A last e, and the second of two l."""

    def told(x):
        gone = x["word"].endswith("e") & (_measured(x["stem"], 2) | (_measured(x["stem"], 1) & ~_closed(x["stem"])))
        return F.when(gone, x["stem"]).otherwise(x["word"])

    short = let(F.struct(word.alias("word"), F.regexp_replace(word, "e$", "").alias("stem")), told)
    return let(short, lambda w: F.when(w.endswith("ll") & _measured(w, 2), F.regexp_replace(w, "l$", "")).otherwise(w))


def stem(word: Column) -> Column:
    """The stem of a word in lower case."""

    def told(w):
        out = F.regexp_replace(w, "^y", "Y")  # at the start it is a consonant
        out = F.regexp_replace(F.regexp_replace(out, "^(.+?)(ss|i)es$", "$1$2"), "^(.+?[^s])s$", "$1")
        out = let(out, _past)
        out = let(out, lambda x: F.when(x.rlike("^.+y$") & _voiced(F.regexp_replace(x, "y$", "")), F.regexp_replace(x, "y$", "i")).otherwise(x))
        for step in (lambda x: _mapped(x, STEP_2), lambda x: _mapped(x, STEP_3), _dropped, _silent):
            out = let(out, step)
        return F.when(F.octet_length(w).between(SHORTEST, LONGEST) & w.rlike("^[a-z]+$"), F.regexp_replace(out, "^Y", "y")).otherwise(w)

    return let(word, told)


def _plain_letters() -> tuple[str, str]:
    """Latin letters with one or more marks, and what they are without."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def tokens(text: Column) -> Column:
    """Runs of letters and numbers in lower case, Latin ones without their marks."""
    return F.filter(F.split(F.translate(F.lower(text), *_plain_letters()), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(texts: DataFrame, *key: str) -> DataFrame:
    """``key, position, stem`` of every word of ``text``; each distinct word is stemmed once."""
    rows = texts.select(*key, F.posexplode(tokens(F.col("text"))).alias("position", "token"))
    stems = rows.select("token").distinct().select("token", stem(F.col("token")).alias("stem"))
    return rows.join(stems, "token").select(*key, "position", "stem")


def phrase_hits(index: DataFrame, phrases: DataFrame, *key: str) -> DataFrame:
    """``phrase_id, key, hits``: how often each phrase ``phrase_id, text`` stands in the indexed texts.

    Words match by stem.  A posting of the phrase's n-th word counts for the place n words
    before it; a place at which all words of the phrase meet is a hit.
    """
    asked = postings(phrases, "phrase_id").withColumnRenamed("position", "nth")
    # where the phrases have few words, common ones do not meet in one task
    asked = F.broadcast(asked) if asked.count() <= FEW_WORDS else asked
    size = asked.groupBy("phrase_id").agg(F.count(F.lit(1)).alias("size"))
    places = index.join(asked, "stem").groupBy("phrase_id", *key, (F.col("position") - F.col("nth")).alias("place")).agg(F.count(F.lit(1)).alias("met"))
    return places.join(size, "phrase_id").where("met = size").groupBy("phrase_id", *key).agg(F.count(F.lit(1)).alias("hits"))


def phrase_hits_in(texts: DataFrame, phrases: DataFrame, *key: str) -> DataFrame:
    """``phrase_hits`` of texts that are not indexed.

    Of every phrase the word that is rarest in the texts is looked for; where it stands, the words
    around it are held against all forms that the texts have of the phrase's words.  So nothing but
    the texts' distinct tokens and the hits move; with more than ``FEW_WORDS`` such forms the texts
    are indexed.
    """
    asked = staged(postings(phrases, "phrase_id"), "asked")
    stems = asked.select("stem").distinct()
    stems = F.broadcast(stems) if asked.count() <= FEW_WORDS else stems
    words = texts.select(F.explode_outer(tokens(F.col("text"))).alias("token")).where("token IS NOT NULL").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # written first, else the semi-join goes below the grouping and every occurrence is stemmed
    forms = staged(staged(words, "tokens").withColumn("stem", stem(F.col("token"))).join(stems, "stem", "left_semi"), "forms")
    parts = asked.join(forms.groupBy("stem").agg(F.collect_list("token").alias("forms"), F.sum("n").alias("n")), "stem", "left")
    whole = parts.groupBy("phrase_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("position").alias("nth"), "forms"))).alias("parts"),
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("position").alias("nth"), "forms")).alias("rarest"),
    )
    # a phrase with a word that no text has stands nowhere
    sought = whole.where("rarest.n > 0").select("phrase_id", F.col("rarest.nth").alias("nth"), F.transform("parts", lambda x: x["forms"]).alias("parts"), F.explode("rarest.forms").alias("token"))
    sought = staged(sought, "sought")
    forms_held = sought.agg(F.coalesce(F.sum(F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + F.size(x))), F.lit(0))).first()[0]
    if forms_held > FEW_WORDS:
        return phrase_hits(postings(texts, *key), phrases, *key)
    # a word is held with the tokens of its stretch, not of its text
    most = asked.groupBy("phrase_id").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    stretch = max(STRETCH, 4 * most)
    cut = let(tokens(F.col("text")), lambda x: F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(stretch)), lambda k: part_of(x, k, F.least(k + stretch + most - 1, F.size(x))))))
    own = texts.select(*key, F.explode_outer(cut).alias("_tokens"))
    places = own.select(*key, "_tokens", F.posexplode("_tokens").alias("position", "token")).join(F.broadcast(sought), "token")
    first, size = F.col("position") - F.col("nth"), F.size("parts")
    near = places.where((first >= 0) & (first < stretch) & (first + size <= F.size("_tokens")))
    # cut out before the words are compared, which is slower and would hold whole stretches (what is not deterministic is not moved)
    around = F.when(F.monotonically_increasing_id() >= 0, F.slice("_tokens", first + 1, size))
    met = near.select(*key, "phrase_id", "parts", around.alias("around")).where(F.forall(F.zip_with("parts", "around", F.array_contains), lambda x: x))
    return met.groupBy("phrase_id", *key).agg(F.count(F.lit(1)).alias("hits"))
