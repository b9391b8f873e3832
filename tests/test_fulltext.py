"""Stems against a list and the rules by letters; phrases against brute force."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from vellum.operators import fulltext
from vellum.plans import words

STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled",
    "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss",
    "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc",
    "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust",
    "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "is": "is", "naïve": "naïve", "generalizations": "gener", "oscillators": "oscil", "at": "at", "days": "dai", "sayings": "sai",
}


class Letters:
    """The rules with consonants told letter by letter."""

    def __init__(self, w):
        self.w = w

    def consonant(self, i):
        return self.w[i] not in "aeiou" and not (self.w[i] == "y" and i > 0 and self.consonant(i - 1))

    def measure(self):
        return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", "".join("c" if self.consonant(i) else "v" for i in range(len(self.w))))))

    def voiced(self):
        return any(not self.consonant(i) for i in range(len(self.w)))

    def closed(self):
        n = len(self.w)
        return n > 2 and self.consonant(n - 3) and not self.consonant(n - 2) and self.consonant(n - 1) and self.w[-1] not in "wxy"

    def doubled(self):
        return len(self.w) > 1 and self.w[-1] == self.w[-2] and self.consonant(len(self.w) - 1)


def by_letters(w):
    if not 3 <= len(w) <= 64 or not re.fullmatch("[a-z]+", w):
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end) and len(w) > len(end):
            w = w[: -len(end)] + to
            break
    if w.endswith("eed") and len(w) > 3:
        w = w[:-1] if Letters(w[:-3]).measure() else w
    elif (m := re.fullmatch("(.+?)(ed|ing)", w)) and Letters(m[1]).voiced():
        s = Letters(m[1])
        w = m[1] + "e" if m[1].endswith(("at", "bl", "iz")) else m[1][:-1] if s.doubled() and m[1][-1] not in "lsz" else m[1] + "e" if s.measure() == 1 and s.closed() else m[1]
    if w.endswith("y") and Letters(w[:-1]).voiced():
        w = w[:-1] + "i"
    for step in (fulltext.STEP_2, fulltext.STEP_3):
        end = max((e for e in step if w.endswith(e) and len(w) > len(e)), key=len, default=None)
        if end and Letters(w[: -len(end)]).measure():
            w = w[: -len(end)] + step[end]
    end = max((e for e in (*fulltext.STEP_4, "ion") if w.endswith(e) and len(w) > len(e)), key=len, default="")
    if end and (end != "ion" or w[-4] in "st") and Letters(w[: -len(end)]).measure() > 1:
        w = w[: -len(end)]
    if w.endswith("e"):
        s = Letters(w[:-1])
        w = w[:-1] if s.measure() > 1 or (s.measure() == 1 and not s.closed()) else w
    return w[:-1] if w.endswith("ll") and Letters(w).measure() > 1 else w


def test_stems(spark, sf_dir):
    rng = random.Random(2)
    ends = [*fulltext.STEP_2, *fulltext.STEP_3, *fulltext.STEP_4, "ion", "ed", "ing", "s", "ies", "eed", "y", "e", "ll", ""]
    made = {"".join(rng.choices("abcdeiolrstuvy", k=rng.randrange(1, 6))) + rng.choice(ends) + rng.choice(["", "", "s", "ed"]) for _ in range(3000)}
    made = sorted(STEMS.keys() | {w for w in made if "yy" not in w})
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in made], "w string").select("w", fulltext.stem(F.col("w")).alias("s")).collect()}
    assert {w: got[w] for w in STEMS} == STEMS
    assert {w: (got[w], by_letters(w)) for w in made if got[w] != by_letters(w)} == {}


STEMMED: dict = {}


def brute(texts, phrases):
    """Hits by phrase and text, at every place of every text."""
    def stems(text):
        plain = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
        return [STEMMED.setdefault(w, by_letters(w)) for w in re.findall(r"[^\W_]+", plain)]

    out, asked = {}, [(p, stems(phrase)) for p, phrase in phrases]
    for i, text in texts:
        own = stems(text)
        for p, words in asked:
            hits = sum(own[k] == words[0] and own[k : k + len(words)] == words for k in range(len(own)))
            out |= {(p, i): hits} if hits else {}
    return out


def test_query(spark, sf_dir):
    read = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]
    got = {(r.phrase_id, r.doc_id): r.hits for r in words.phrase_hits(spark, sf_dir).collect()}
    assert got == brute(read("documents", "doc_id"), [(i, " ".join(text.split()[:3])) for i, text in read("benchmark", "item_id")]) != {}


def test_phrases(spark, sf_dir):
    texts = [(1, "The running of naïve dogs; dogs ran. Running of naive dog"), (2, "dogs run, of course"), (3, ""), (4, None), (5, "of of of of")]
    texts += [(100 + r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    phrases = [(1, "run of naive dogs"), (2, "dogs"), (3, "of of"), (4, "nowhere at all"), (5, "Dogs; run")]
    phrases += [(10 + k, " ".join(t.split()[k : k + 3])) for k, (_, t) in enumerate(texts[5:15])]
    want = brute(texts, phrases)
    index = fulltext.postings(spark.createDataFrame(texts, "id long, text string"), "id")
    got = fulltext.phrase_hits(index, spark.createDataFrame(phrases, "phrase_id long, text string"), "id").collect()
    assert {(r.phrase_id, r.id): r.hits for r in got} == want


def test_phrases_without_an_index(spark, monkeypatch):
    rng = random.Random(4)
    texts = [(1, "The running of naïve dogs; dogs ran. Running of naive dog"), (2, "dogs run, of course"), (3, ""), (4, None), (5, "of of of of"), (None, "a dog runs of")]
    texts += [(10 + k, " ".join(rng.choices(["run", "runs", "running", "of", "dog", "Dogs", "the", "day", "days"], k=rng.randrange(1, 60)))) for k in range(200)]
    phrases = [(1, "run of naive dogs"), (2, "dogs"), (3, "of of"), (4, "nowhere at all"), (5, "Dogs; run"), (6, "run run runs dog"), (7, ""), (8, "days of the day"), (9, "of the nowhere")]
    want = brute(texts, [x for x in phrases if x[1]])
    assert {p for p, _ in want} >= {1, 2, 3, 5, 6}
    own = spark.createDataFrame(texts, "id long, text string")
    asked = spark.createDataFrame(phrases, "phrase_id long, text string")
    for few in (500_000, 2):
        monkeypatch.setattr(fulltext, "FEW_WORDS", few)
        got = fulltext.phrase_hits_in(own, asked, "id").collect()
        assert {(r.phrase_id, r.id): r.hits for r in got} == want, few


def test_only_distinct_tokens_and_hits_move(spark, sf_dir):
    """The query's plan over all documents has no exchange but that of the hits."""
    plan = words.phrase_hits(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 1
