"""Literal rows for behaviour that the tables do not show, as VALUES that Spark and DuckDB read alike."""

from __future__ import annotations


def values(rows: list[tuple], alias: str, columns: str) -> str:
    def lit(v) -> str:
        if v is None:
            return "NULL"
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS {alias}({columns}))"


LINES = [
    "[4]", "- 12 -", "xiv", "XIV.", "civil", "mild", "I", "---", "***", "__", "12000", "1913", "+7", "0", "[Ch. I. — METHOD",
    "CHAPTER I.", "ON METHOD.", "BOOK II", "PART FIRST", "INTRODUCTION.", "§ 1. Theology a Science.", "Sec. 3 of the act",
    "Necessity for System in Theology.", "# Title of it", "#### deep title", "##### five", "> a quoted line", ">not quoted",
    "and mutual relation", "It ends here.", "It breaks off and", "“He said so.”", "A Tale of Two Cities", "The 7 Wonders of Old",
    "VOLUME THE SECOND OF THE WORK", "Letter IV", "Epistle 12 to the town", "Preface to the third edition", "iiii", "mcmxciv", "MMMM",
    "NONE", "2", "page two of three", "", " ", "   ", "Contents", "…", "12.", "See vol. iii for more", "A Vol of Verse, Book Two",
    "one two three four five six seven eight nine ten eleven twelve thirteen", "Éloge", "ÉTÉ", "THIS IS A LINE OF NINE WORDS SET IN CAPS",
]

PAGES = [
    (900000001, "Systematic Theology", "SYSTEMATIC THEOLOGY\n\nCHAPTER I.\nON METHOD.\n\nThe first paragraph of the page runs over more than one printed line and it ends with a split un-\nderstanding of the matter.\n\n§ 1. Theology a Science.\n\n> A quoted remark\n> over two lines.\n\n47\n\n1. Theology a Science."),
    (900000002, "Other", "One paragraph that is long enough to be counted as a repetition.\nshort one.\nOne paragraph that is long enough to be counted as a repetition.\nshort one.\n---\nThe text is cut off before it can be fully transcribed."),
    (900000003, "Other", "A page whose end was not the author's own work, as one may see.\n\nThe transcription follows the instructions exactly.\n\nNo additional text is present."),
    (900000004, "Other", "# Marked Heading\nprose under it that goes on\nand on until it stops.\n\nthe semi-\nFinal state of things\n\nthe ﬁrſt æther of the 12-\n34 series"),
    (900000005, "Other", "RUNNING HEAD\n\nSome text of the page that is here.\n\nfoot line\n\n12"),
    (900000006, "Other", "RUNNING HEAD\n\nMore text of another page that is here.\n\nfoot line\n\nxiii"),
    (900000007, "Other", "   \n\n"),
    # more blocks than any small span of ids holds, and hyphens that stand alone
    (900000008, "Other", "\n\n".join(f"block number {i} of a long page." for i in range(1500)) + "\n\nthe un-\n-\nDer line\n--\nhere and\n-\n\n-\nafter it"),
]

HEADINGS = [
    (1, 1, "CHAPTER I.", None), (1, 2, "ON METHOD.", None), (1, 3, "§ 1. Theology a Science.", None), (1, 4, "Necessity for System in Theology.", None),
    (2, 1, "BOOK II", None), (2, 2, "INTRODUCTION.", None), (2, 3, "Of the Nature of Things", None), (3, 1, "Declared Heading", "Declared Heading"),
    (3, 2, "XIV", None), (3, 3, "A title with more than eight words in it is not taken.", None), (4, 1, "PART FIRST", None), (4, 2, "CHAPTER 2", None), (4, 3, "RUNNING HEAD", None),
    (5, 1, "plain", None), (6, 1, "CHAPTER III.", None), (6, 2, "CHAPTER IV.", None), (6, 3, "The Last Topic", None),
]

FACING = [
    (1, 10, "a:left", 2), (1, 11, "a:right", 1), (1, 12, "b:left", 7), (1, 13, "b:right", 20), (1, 14, "z:left", 8), (1, 15, "c:left", None), (1, 16, "c:right", 31),
    (1, 17, "d:left", 44), (1, 18, "d:right", None), (1, 19, "e:left", 50), (1, 20, "e:right", 51), (2, 21, "a:left", None), (2, 22, "a:right", None),
    (2, 23, "f:left", 2999), (2, 24, "f:right", 1), (2, 25, "g:left", 1), (2, 26, "g:right", 1), (2, 27, None, 3),
]

RUNS = [
    (1, "Genesis", 1, "9:1 First unit."), (1, "Genesis", 2, "9:2 Second unit. 10:1 fused into it 10:2 and more"), (1, "Genesis", 3, "a paragraph that follows"),
    (1, "Genesis", 4, "11:1 Third chapter here"), (2, None, 1, "at 10:30 the train left"), (2, None, 2, "no reference"), (2, None, 3, "none here"),
    *[(3, "Prose", i, f"Paragraph number {i} of the run.") for i in range(1, 21)], (4, None, 1, "x:1 not a chapter"), (4, None, 2, "3:4 one"), (4, None, 3, "3:5 two"),
]

DICT = [
    ("Nice", "a.", 0, "Foolish; silly. [Obs.]"), ("Nice", "a.", 1, "Pleasing;  agreeable. [Colloq.]"), ("Shew", "v.", 0, "See Show."), ("Show", "v.", 0, "To exhibit."),
    ("Public", "a.", 0, "Open to all. [R.]"), ("Public", "a.", 1, " "), ("City", "n.", 0, "A large town. [Law]"), ("Stop", "v.", 0, "To close. [Poetic]"), ("Make", "v.", 0, "To form."),
    ("Run", "v.", 0, "To go fast. [Slang] [Prov. Eng.]"), ("Auncient", "a.", 0, "Same as Ancient. [Archaic]"), ("Ancient", "a.", 0, "Old."), ("Empty", "a.", 0, " "),
    ("Well-known", "a.", 0, "Familiar."), ("Shall", "v.", 0, "To owe. [Obs]"), ("himself", "pron.", 0, "Reflexive."), ("Understand", "v.", 0, "To grasp."), ("Under", "p.", 0, "Below."), ("Stand", "v.", 0, "To be upright."), ("Be", "v.", 0, "To exist."), ("Self", "n.", 0, "Same as self."),
]

SURFACES = ["Nice,", "publick", "cities", "stopped", "making", "\"running\"", "shew", "Empty", "...", "well-known", "was", "nicest", "shalt", "don't", "understands", "zzz", "  City. "]
BREAKS = [("the un-", "derstand of"), ("a well-", "known man"), ("the under-", "stand"), ("no vowels xq-", "zt here"), ("end.-", "Next"), ("ten 12-", "34"), ("a semi-", "Final"), ("plain", "words"), ("soft­", "ware")]
LONG_S = ["fhall", "himfelf", "Fhall", "fun", "fff", "felf", "ftand", "offs", "FHALL", "fffff"]
HOSTS = ["", "  ", "192.168.1.50:11434", "http://a.example/", "https://b.example//", " c.example "]
FENCES = ["```json\n{\"a\": 1}\n```", "```\nplain\n```", "no fence", "``` inline```", "  ```x\ny  "]
RUBRIC = [(v, a, b, c, p) for v in ("on_target", "partial", "off_target") for a in (0, 1) for b in (0, 1) for c in (0, 1) for p in ("none", "too_vague", "detail_not_point", "wrong_focus", "incomplete")]
SOURCES = ["https://a.example/x", "HTTP://B.example", "book.EPUB", "scan.pdf", "photo.heic", "ftp://x/y.pdf", "noext", "a.epub.txt"]
SIZES = [(3200, 2400), (100, 50), (1600, 1600), (1601, 1), (4000, 3), (1, 9000), (0, 10), (2000, 1333)]
