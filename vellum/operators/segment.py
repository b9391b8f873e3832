"""Pages to typed blocks.  Every step works inside a page's row: no shuffle, no Python.

No step copies what it has made so far: the lines are typed, the places where a block begins
or ends are listed, and blocks are cut out between these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.arrays import first_of_equals, let

BLOCKS = "array<struct<kind:string,text:string>>"


def block_id(page: Column, ordinal: Column) -> Column:
    """A block's id: its page's and its place there, ``page:ordinal``, whatever size either has."""
    return F.concat(page.cast("string"), F.lit(":"), ordinal.cast("string"))


def page_of(block: Column) -> Column:
    """The page that a block's id names, as text."""
    return F.regexp_replace(block, ":[0-9]+$", "")


def ordinal_of(block: Column) -> Column:
    return F.regexp_extract(block, ":([0-9]+)$", 1).cast("long")


def lines_of(raw: Column) -> Column:
    """Lines without their line ends; a final line end opens no further line."""
    return F.transform(F.split(raw, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))


def trimmed_lines(raw: Column) -> Column:
    return F.transform(F.split(raw, "\n"), t.trim)


def is_prewrapped(lines: Column) -> Column:
    """Does each trimmed line hold a whole paragraph?  One line above 120 characters says so, or
    four fifths of three or more lines closing a sentence."""

    def judged(kept):
        long = F.exists(kept, lambda x: F.length(x) > 120)
        closed = F.size(F.filter(kept, lambda x: x.rlike(f"[{t.SENTENCE_ENDS}]$")))
        return (F.size(kept) > 0) & (long | ((F.size(kept) >= 3) & (closed * 100 >= F.size(kept) * 80)))

    return let(F.filter(lines, lambda x: (x != "") & ~t.is_furniture(x)), judged)


def kept_lines(own: Column) -> Column:
    """Without lines that are all hyphens: they say nothing but at the end of a block."""
    bare = f"^[{t.HYPHENS}]+$"
    return let(own, lambda x: F.filter(x, lambda line, i: (i == F.size(x) - 1) | ~line.rlike(bare)))


def is_broken(line: Column, following: Column) -> Column:
    """Does a word go on in the following line of the block?"""
    return following.isNotNull() & line.rlike(f"[{t.HYPHENS}]$")


def without_hyphens(line: Column) -> Column:
    return F.regexp_replace(line, f"[{t.HYPHENS}]+$", "")


def _by_case(kept: Column, i: Column) -> Column:
    """Without a lexicon: the halves of a clean break keep a hyphen unless the second starts small."""
    clean = without_hyphens(F.get(kept, i)).rlike(r"\p{IsAlphabetic}$") & F.get(kept, i + 1).rlike(r"^\p{IsAlphabetic}")
    return clean & ~F.get(kept, i + 1).rlike(r"^\p{IsLowercase}")


def join_kept(kept: Column, hyphen=_by_case) -> Column:
    """Lines of a block as one run of prose; ``hyphen(kept, i)`` tells where a broken word keeps its hyphen."""

    def joined(own):
        def piece(x, i):
            closed = F.concat(without_hyphens(x), F.when(hyphen(own, i), "-").otherwise(""))
            return F.when(F.get(own, i + 1).isNull(), x).when(is_broken(x, F.get(own, i + 1)), closed).otherwise(F.concat(x, F.lit(" ")))

        return F.array_join(F.transform(own, piece), "")

    return t.squeeze(F.when(F.size(kept) == 1, F.get(kept, F.lit(0))).otherwise(let(kept, joined)))


def join_lines(lines: Column) -> Column:
    """The trimmed lines of a block as one run of prose, with split words closed by their case.

    The hyphens before a line's end fall away with it.  What two lines are joined by depends
    on these two alone.
    """
    return F.when(F.size(lines) == 1, t.squeeze(F.get(lines, F.lit(0)))).otherwise(join_kept(kept_lines(lines)))


def line_blocks(lines: Column, prewrapped: Column) -> Column:
    """Blocks of a page's trimmed lines, in order: an array of kind and lines.

    Blank and furniture lines close a block, a marked heading stands alone, a change of kind
    opens a block, and on a prewrapped page every line is one.
    """

    def typed(x):
        ends = (x == "") | t.is_furniture(x)
        marked = x.startswith("#") | x.startswith(">")
        plain = F.struct(F.when(ends, "break").otherwise("paragraph").alias("kind"), x.alias("line"))
        content = t.line_content(x)
        other = F.struct(F.when(ends, "break").when(content == "", "skip").otherwise(t.line_kind(x)).alias("kind"), content.alias("line"))
        return F.when(marked, other).otherwise(plain)

    def cut(rows, wrapped):
        def edge(x, i):
            before = F.get(rows, i - 1)["kind"]
            return (x["kind"] == "break") | (x["kind"] == "heading") | wrapped | before.isNull() | (before != x["kind"])

        def blocks(edges):
            own = F.transform(
                edges, lambda at, k: F.struct(F.get(rows, at)["kind"].alias("kind"), F.slice(rows, at + 1, F.coalesce(F.get(edges, k + 1), F.size(rows)) - at).alias("rows"))
            )
            own = F.filter(own, lambda b: b["kind"] != "break")
            return F.transform(own, lambda b: F.struct(b["kind"].alias("kind"), F.transform(b["rows"], lambda x: x["line"]).alias("lines")))

        places = F.filter(F.transform(rows, lambda x, i: F.when(edge(x, i), i)), lambda i: i.isNotNull())
        return let(places, blocks)

    rows = F.filter(F.transform(lines, typed), lambda x: x["kind"] != "skip")
    return let(F.struct(rows.alias("rows"), prewrapped.alias("wrapped")), lambda x: let(x["rows"], lambda r: cut(r, x["wrapped"])))


def _judged(joined: Column) -> Column:
    """Blocks of kind and text, without empty ones; headings without a mark show on the whole block."""
    return F.transform(
        F.filter(joined, lambda b: b["text"] != ""),
        lambda b: F.struct(
            F.when((b["kind"] == "paragraph") & t.looks_like_heading(b["text"]), "heading").otherwise(b["kind"]).alias("kind"),
            b["text"].alias("text"),
        ),
    )


def segment(lines: Column, prewrapped: Column) -> Column:
    """Blocks of a page's trimmed lines, in order: an array of kind and text."""
    return _judged(F.transform(line_blocks(lines, prewrapped), lambda b: F.struct(b["kind"].alias("kind"), join_lines(b["lines"]).alias("text"))))


def drop_repeats(pages: DataFrame, blocks: str) -> DataFrame:
    """Of blocks of 40 or more characters that repeat in a page, the first stays."""
    return pages.withColumn(blocks, first_of_equals(F.col(blocks), lambda b: F.when(F.length(b["text"]) >= 40, F.lower(b["text"]))))


def drop_commentary(pages: DataFrame, blocks: str) -> DataFrame:
    """Without remarks on the transcription: known phrases anywhere, and a closing run of them."""
    df = pages.withColumn(blocks, F.filter(blocks, lambda b: ~t.is_commentary(b["text"])))
    last = F.array_max(F.transform(blocks, lambda b, i: F.when(t.is_trailing_meta(b["text"]), 0).otherwise(i + 1)))
    return df.withColumn(blocks, F.slice(blocks, F.lit(1), F.coalesce(last, F.lit(0))))


def drop_page_furniture(pages: DataFrame, blocks: str, title: str) -> DataFrame:
    """Without a first block that repeats the title and a short last one that echoes another."""

    def headed(x):
        first = F.get(x["blocks"], F.lit(0))["text"]
        return F.coalesce((x["key"] != "") & (t.furniture_key(first) == x["key"]), F.lit(False))

    def less(own):
        last = F.get(own, F.size(own) - 1)["text"]
        others = F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0)))
        echoed = lambda key: (key != "") & F.exists(others, lambda b: t.furniture_key(b["text"]) == key)
        return F.when((F.size(own) >= 2) & (F.length(last) <= 60) & let(t.furniture_key(last), echoed), others).otherwise(own)

    body = let(
        F.struct(F.col(blocks).alias("blocks"), t.furniture_key(F.col(title)).alias("key")),
        lambda x: F.when(headed(x), F.slice(x["blocks"], F.lit(2), F.size(x["blocks"]))).otherwise(x["blocks"]),
    )
    return pages.withColumn(blocks, let(body, less))


def _tidied(pages: DataFrame, title: str) -> DataFrame:
    """Without repeats, commentary and page furniture, in this order."""
    return pages.transform(drop_repeats, "blocks").transform(drop_commentary, "blocks").transform(drop_page_furniture, "blocks", title)


def _with_lines(pages: DataFrame, raw: str) -> tuple[DataFrame, Column, Column]:
    df = pages.withColumn("_lines", trimmed_lines(F.coalesce(F.col(raw), F.lit(""))))
    return df, F.col("_lines"), F.coalesce(is_prewrapped(F.col("_lines")), F.lit(False))


def page_blocks(pages: DataFrame, raw: str = "raw", title: str = "title") -> DataFrame:
    """Adds ``blocks``: segmented, without repeats, commentary and page furniture."""
    df, lines, prewrapped = _with_lines(pages, raw)
    return _tidied(df.withColumn("blocks", segment(lines, prewrapped)).drop("_lines"), title)


def page_lines(pages: DataFrame, raw: str = "raw") -> DataFrame:
    """``parts`` in the place of the raw text: the page's blocks with the lines that count."""
    df, lines, prewrapped = _with_lines(pages, raw)
    parts = F.transform(line_blocks(lines, prewrapped), lambda b: F.struct(b["kind"].alias("kind"), kept_lines(b["lines"]).alias("lines")))
    return df.withColumn("parts", parts).drop("_lines", raw)


def blocks_of_lines(pages: DataFrame, title: str = "title") -> DataFrame:
    """Adds ``blocks`` to pages with ``parts`` and ``hyphens``, in the place of both.

    ``hyphens`` lists the breaks that keep theirs: block and line, from 0 (null: none do).
    """

    def joined(x):
        def block(b, k):
            own = F.transform(F.filter(x["hyphens"], lambda h: h["b"] == k), lambda h: h["i"])
            text = let(own, lambda o: join_kept(b["lines"], lambda _, i: F.array_contains(o, i)))
            return F.struct(b["kind"].alias("kind"), text.alias("text"))

        return F.transform(x["parts"], block)

    hyphens = F.coalesce("hyphens", F.array().cast("array<struct<b:int,i:int>>"))
    both = F.struct(F.col("parts").alias("parts"), hyphens.alias("hyphens"))
    return _tidied(pages.withColumn("blocks", _judged(let(both, joined))).drop("parts", "hyphens"), title)


def block_rows(pages: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """One row per block: ``id, page_id, book_id, ordinal, kind, text_raw, text_norm``, and columns ``beside``."""
    numbered = F.transform("blocks", lambda b, i: F.struct((i + 1).cast("long").alias("ordinal"), b["kind"].alias("kind"), b["text"].alias("text_raw")))
    rows = pages.select(F.col("id").alias("page_id"), "book_id", *beside, F.inline(numbered))
    return rows.select(
        block_id(F.col("page_id"), F.col("ordinal")).alias("id"),
        "page_id",
        "book_id",
        "ordinal",
        "kind",
        "text_raw",
        t.normalise(F.col("text_raw")).alias("text_norm"),
        *beside,
    )


def drop_running_heads(blocks: DataFrame, least: int) -> DataFrame:
    """Blocks ``page_id, book_id, ordinal, text`` without running heads and feet.

    A first (last) block of up to 8 words goes if ``least`` pages of its book begin (end) with
    the same line.  Counts are taken before anything is removed; they are grouped by book and
    line and joined back, so no book is ever in one task.
    """
    line = F.lower("text")
    edges = blocks.groupBy("book_id", "page_id").agg(
        F.min_by(line, "ordinal").alias("_first"),
        F.max_by(line, "ordinal").alias("_last"),
        F.min("ordinal").alias("_lo"),
        F.max("ordinal").alias("_hi"),
    )
    for name in ("_first", "_last"):
        often = edges.groupBy("book_id", name).agg(F.count(F.lit(1)).alias(f"{name}_n"))
        often = often.where((F.col(f"{name}_n") >= least) & (t.word_count(F.col(name)) <= 8))
        edges = edges.join(often, ["book_id", name], "left")
    gone = (F.col("_first_n").isNotNull() & (F.col("ordinal") == F.col("_lo"))) | (
        F.col("_last_n").isNotNull() & (F.col("ordinal") == F.col("_hi"))
    )
    edges = edges.select("page_id", "_lo", "_hi", "_first_n", "_last_n")
    return blocks.join(edges, "page_id").where(~gone).select(*blocks.columns)
