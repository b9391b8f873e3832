"""Broken words by the lexicon against the rule applied one line after the other."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as t
from vellum.operators import broken_words, lexicon, segment


def affixes(token):
    at = [i for i, c in enumerate(token) if c.isalpha()]
    return (token[: at[0]], token[at[0] : at[-1] + 1], token[at[-1] + 1 :]) if at else (token, "", "")


def joined(left, right, lexicon):
    core = left.rstrip(t.HYPHENS)
    head = core[: re.search(r"\S*$", core).start()]
    end = re.match(r"\S*", right).end()
    (before, a, behind), (ahead, b, rest) = affixes(core[len(head) :]), affixes(right[:end])
    if not a or not b or behind or ahead:
        return core + right
    low, high = a.lower(), b.lower()
    keep = low + high not in lexicon and (f"{low}-{high}" in lexicon or {low, high} <= lexicon)
    return head + before + a + ("-" if keep else "") + b + rest + right[end:]


def block(lines, lexicon):
    text = lines[0]
    for line in lines[1:]:
        text = joined(text, line, lexicon) if text[-1] in t.HYPHENS else f"{text} {line}"
    return " ".join(text.split())


LEXICON = {"under", "understand", "well-known", "self", "and", "known", "the", "unde", "un-der", "a", "ab", "aba", "b-a", "abab", "stand", "well", "un"}


def random_pages(seed, n=400):
    rng = random.Random(seed)
    parts = ["un", "der", "st", "and", "a", "b", "well", "known", "self", "ſ", "é", "12", "the", "x."]

    def line():
        word, kind = rng.choice(parts), rng.random()
        word = word.title() if rng.random() < 0.2 else word
        if kind < 0.55:
            return word + rng.choice(["-", "-", "‐", "--"])
        if kind < 0.8:
            return rng.choice([f"word {word}-", "-", "word -"])
        return rng.choice([f"{word}, more text", word, f'"{word}-', f"({word}", f"{word}.-"])

    return [[line() for _ in range(rng.randrange(1, 9))] for _ in range(n)]


@pytest.mark.parametrize("seed, branches", [(1, 32), (2, 1)])
def test_chains_are_decided_as_one_after_the_other(spark, monkeypatch, seed, branches):
    monkeypatch.setattr(broken_words, "BRANCHES", branches)
    pages = [*random_pages(seed), ["a-"] * 3000 + ["b"], ["1-"] * 300 + ["b-", "a"], ["un-", "der-", "stand"], ["well-", "known"]]
    data = spark.createDataFrame([(i, [("paragraph", x)]) for i, x in enumerate(pages)], "id long, parts array<struct<kind:string,lines:array<string>>>")
    data = data.withColumn("parts", F.transform("parts", lambda b: F.struct(b["kind"].alias("kind"), segment.kept_lines(b["lines"]).alias("lines"))))
    lexicon = spark.createDataFrame([(w,) for w in LEXICON], "headword string")
    kept = {r.id: {h.i for h in r.hyphens} for r in broken_words.kept_hyphens(data, lexicon).collect()}
    told = data.select("id", F.col("parts")[0]["lines"].alias("lines")).collect()
    assert len(told) == len(pages)
    for r in told:
        text = ""
        for i, line in enumerate(r.lines):
            last, broken = i == len(r.lines) - 1, line[-1] in t.HYPHENS
            text += line if last else line.rstrip(t.HYPHENS) + "-" * (i in kept.get(r.id, ())) if broken else line + " "
        assert " ".join(text.split()) == block(pages[r.id], LEXICON), pages[r.id][:20]


def test_pages_by_the_lexicon(spark):
    raw = "The un-\nder-\nstand of it all is a well-\nknown matter, as they say\n\n# Head-\nline of a self-\nMade man, who is here"
    lexicon = spark.createDataFrame([(w,) for w in LEXICON | {"made"}], "headword string")
    pages = spark.createDataFrame([(1, "T", raw), (2, "T", None), (3, "T", "no-\nthing here is known to anybody at all.")], "id long, title string, raw string")
    got = {r.id: [(b.kind, b.text) for b in r.blocks] for r in broken_words.lexicon_blocks(pages, lexicon).collect()}
    assert got == {
        1: [("paragraph", "The understand of it all is a well-known matter, as they say"), ("heading", "Head-"), ("paragraph", "line of a self-Made man, who is here")],
        2: [],
        3: [("paragraph", "nothing here is known to anybody at all.")],
    }


def test_only_full_spelling_moves(spark):
    rows = [(f"{i}:1", "ﬁrﬅ of ſome", level, i) for i, level in enumerate(["off", "light", "full"] * 5)]
    rows = spark.createDataFrame(rows, "id string, text_raw string, level string, other int")
    got = lexicon.normalise_by_level(rows, spark.createDataFrame([("some",), ("first",)], "headword string"))
    assert got.columns == ["id", "text_raw", "level", "other", "text_norm"]
    want = {"off": "ﬁrﬅ of ſome", "light": "first of ſome", "full": "first of some"}
    told = got.collect()
    assert len(told) == 15 and all(r.text_norm == want[r.level] and r.id == f"{r.other}:1" for r in told)
    plain = got._jdf.queryExecution().optimizedPlan().children().apply(0).toString()
    assert "Join" not in plain and "Repartition" not in plain
