"""Outline, spans, page numbers and paragraphs that cross pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.arrays import let
from .segment import lines_of


def fold_titles(headings: DataFrame) -> DataFrame:
    """Headings ``page_id, ordinal, text, level`` with titles folded into bare markers.

    A part or chapter marker absorbs the topic or minor heading of up to 8 words right after
    it on its page.  An absorbed heading never absorbs, so one look at the neighbours is exact.
    """
    w = Window.partitionBy("page_id").orderBy("ordinal")
    marker = F.col("level").isin("part", "chapter") & t.is_bare_marker(F.col("text"))
    takes = marker & F.coalesce(F.col("_next_level").isin("minor", "topic") & (t.word_count(F.col("_next")) <= 8), F.lit(False))
    df = headings.withColumns({"_next": F.lead("text").over(w), "_next_level": F.lead("level").over(w)}).withColumn("_takes", takes)
    df = df.withColumn("_gone", F.coalesce(F.lag("_takes").over(w), F.lit(False))).where(~F.col("_gone"))
    text = F.when(F.col("_takes"), F.concat(F.regexp_replace("text", r"(?U)\s+$", ""), F.lit(" "), t.trim(F.col("_next")))).otherwise(F.col("text"))
    return df.withColumn("text", text).drop("_next", "_next_level", "_takes", "_gone")


def declared_level(text: Column, source_ref: Column) -> Column:
    """A heading that its source declares is a chapter at least."""
    told = F.coalesce(t.trim(source_ref) == t.trim(text), F.lit(False))
    return let(t.heading_level(text), lambda level: F.when(told & level.isin("section", "topic", "minor"), "chapter").otherwise(level))


def fold_array(headings: Column) -> Column:
    """As ``fold_titles``, for a page's headings in one array of ``struct<text, level>``."""

    def marked(own):
        def one(x, i):
            after = F.get(own, i + 1)
            small = F.coalesce(after["level"].isin("minor", "topic") & (t.word_count(after["text"]) <= 8), F.lit(False))
            takes = x["level"].isin("part", "chapter") & t.is_bare_marker(x["text"]) & small
            return F.struct(x["level"].alias("level"), x["text"].alias("text"), takes.alias("takes"), after["text"].alias("next"))

        return F.transform(own, one)

    def folded(own):
        left = F.filter(own, lambda x, i: ~F.coalesce(F.get(own, i - 1)["takes"], F.lit(False)))
        title = lambda x: F.concat(F.regexp_replace(x["text"], r"(?U)\s+$", ""), F.lit(" "), t.trim(x["next"]))
        return F.transform(left, lambda x: F.struct(x["level"].alias("level"), F.when(x["takes"], title(x)).otherwise(x["text"]).alias("text")))

    return let(let(headings, marked), folded)


#: Pages of a book whose spans one task carries on.
STRETCH = 1024


def carry_spans(pages: DataFrame, by: str = "book_id", order: str = "nth") -> DataFrame:
    """Part, chapter and section of each page, carried until replaced; a chapter clears the section.

    A book is cut into stretches of pages.  What a stretch leaves open is carried over the
    few rows that stand for stretches, and joined back: no book is ever in one task.
    """
    df = pages.withColumn("_s", F.floor(F.col(order) / STRETCH))
    w = Window.partitionBy(by, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_c", F.count("chapter").over(w))
    inside = Window.partitionBy(by, "_s", "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c, over: F.last(c, ignorenulls=True).over(over)
    opens = F.coalesce("part", "chapter", "section").isNotNull().cast("int")
    df = df.select(
        by, order, "page_id", "_s", "_c", last("part", w).alias("part"), last("chapter", w).alias("chapter"),
        last("section", inside).alias("section"), F.sum(opens).over(w).alias("span"),
    )
    end = df.groupBy(by, "_s").agg(F.max(F.struct(order, "part", "chapter", "section", "span", "_c")).alias("x")).select(by, "_s", "x.*")
    over = Window.partitionBy(by).orderBy("_s")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    # stretches since the last chapter, itself included, share a number
    end = end.withColumn("_k", F.sum((F.col("_c") > 0).cast("int")).over(over))
    since = Window.partitionBy(by, "_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    end = end.withColumn("_open", last("section", since))
    carried = end.select(
        by, "_s", last("part", before).alias("_part"), last("chapter", before).alias("_chapter"), F.lag("_open").over(over).alias("_section"),
        F.coalesce(F.sum("span").over(before), F.lit(0)).alias("_span"),
    )
    return df.join(carried, [by, "_s"]).select(
        by,
        order,
        "page_id",
        F.coalesce("part", "_part").alias("part"),
        F.coalesce("chapter", "_chapter").alias("chapter"),
        F.when(F.col("_c") > 0, F.col("section")).otherwise(F.coalesce("section", "_section")).alias("section"),
        (F.col("span") + F.col("_span")).alias("span"),
    )


def ranked(rows: DataFrame, by: str, coarse: list[Column], fine: list, out: str) -> DataFrame:
    """Adds ``out``: each row's place from 1 in its group ``by``, ordered by ``coarse``, then ``fine``.

    Rows are ranked within equal coarse values; the counts of these are summed over the few
    rows that stand for them.  So the coarse values, not the group, bound what a task sorts.
    Coarse values must not be null.
    """
    names = [f"_o{i}" for i in range(len(coarse))]
    rows = rows.withColumns(dict(zip(names, coarse, strict=True)))
    counts = rows.groupBy(by, *names).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(by, *names, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(by, *names).orderBy(*fine)
    placed = rows.withColumn("_nth", F.row_number().over(inside)).join(counts, [by, *names])
    return placed.withColumn(out, F.col("_nth") + F.col("_before")).drop("_nth", "_before", *names)


#: A number that no page has: pages without one come last.
_LAST = 1 << 62


def place_keys() -> list[Column]:
    """Page number, and for the pages of one number stretches of import time."""
    return [F.coalesce("page_no", F.lit(_LAST)), F.floor(F.col("created_at") / 4096)]


def reading_order(pages: DataFrame) -> DataFrame:
    """Adds ``nth``: the page's place in its book by page number (unread last), import and id."""
    return ranked(pages, "book_id", place_keys(), ["created_at", "id"], "nth")


def adjacent_pages(pages: DataFrame) -> DataFrame:
    """``id, previous_id, next_id``: the nearest page of a strictly other place.

    Pages share a place if they have the same number, or no number and the same import
    second; the next is the first page of the following place, the previous the last of the
    one before.
    """
    number, time = F.coalesce("page_no", F.lit(_LAST)), F.when(F.col("page_no").isNull(), F.col("created_at")).otherwise(0)
    own = pages.withColumns({"_number": number, "_time": time})
    one = F.struct("created_at", "id")
    places = own.groupBy("book_id", "_number", "_time").agg(F.min(one).alias("_min"), F.max(one).alias("_max"))
    places = ranked(places, "book_id", [F.col("_number"), F.floor(F.col("_time") / 4096)], ["_time"], "_k")
    after = places.select("book_id", (F.col("_k") - 1).alias("_k"), F.col("_min.id").alias("next_id"))
    before = places.select("book_id", (F.col("_k") + 1).alias("_k"), F.col("_max.id").alias("previous_id"))
    near = places.join(after, ["book_id", "_k"], "left").join(before, ["book_id", "_k"], "left")
    return own.join(near, ["book_id", "_number", "_time"]).select("id", "previous_id", "next_id")


def edge_paragraphs(blocks: DataFrame) -> DataFrame:
    """First and last paragraph of each page."""
    one = F.struct("ordinal", "id", "text_norm")
    return blocks.where("kind = 'paragraph'").groupBy("page_id").agg(F.min(one).alias("first"), F.max(one).alias("last"))


def paragraph_contexts(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Each paragraph with the parts that the pages before and after hold.

    Only a page's first paragraph looks back and only its last looks on, one page each way.
    """
    edges = edge_paragraphs(blocks)
    near = adjacent_pages(pages)
    prev = edges.select(F.col("page_id").alias("previous_id"), F.col("last.text_norm").alias("_tail"))
    nxt = edges.select(F.col("page_id").alias("next_id"), F.col("first.text_norm").alias("_head"))
    df = (
        blocks.where("kind = 'paragraph'")
        .join(edges.select("page_id", F.col("first.id").alias("_first"), F.col("last.id").alias("_last")), "page_id")
        .join(near.withColumnRenamed("id", "page_id"), "page_id")
        .join(prev, "previous_id", "left")
        .join(nxt, "next_id", "left")
    )
    text = F.col("text_norm")
    no = F.lit(False)
    back = F.coalesce(t.starts_mid_sentence(text) & (F.col("id") == F.col("_first")) & t.ends_mid_sentence(F.col("_tail")), no)
    open_ = t.ends_mid_sentence(text) & (F.col("id") == F.col("_last"))
    on = F.coalesce(open_ & t.starts_mid_sentence(F.col("_head")), no)
    df = df.withColumns({"_back": back, "_on": on, "_open": open_})
    whole = F.when(F.col("_back"), t.stitch(F.col("_tail"), text)).otherwise(text)
    df = df.withColumn("_whole", whole)
    return df.select(
        "id",
        "page_id",
        F.when(F.col("_on"), t.stitch(F.col("_whole"), F.col("_head"))).otherwise(F.col("_whole")).alias("text"),
        F.when(F.col("_back"), F.col("previous_id")).alias("continued_from_page"),
        F.when(F.col("_on"), F.col("next_id")).alias("continues_on_page"),
        (F.col("_back") | F.col("_on")).alias("spans_pages"),
        (F.col("_open") & F.col("next_id").isNull()).alias("incomplete"),
    )


def detect_folio(raw: Column) -> Column:
    """The page number among the last three lines, upwards, then the first three."""
    lines = F.filter(F.transform(lines_of(raw), t.trim), lambda x: x != "")
    margin = F.concat(F.slice(F.reverse(lines), 1, 3), F.slice(lines, 1, 3))
    found = F.filter(F.transform(margin, t.number_on_line), lambda x: x.isNotNull())
    return F.try_element_at(found, F.lit(1))


def folio_cascade(pages: DataFrame) -> DataFrame:
    """``id, page_no, source, pass`` from ``id, raw`` and the replies ``told`` (text) and ``seen`` (image).

    A reply counts only where the passes before it found nothing.
    """
    own = pages.select("id", detect_folio(F.col("raw")).alias("n"), t.folio_reply(F.col("told")).alias("told"), t.folio_reply(F.col("seen")).alias("seen"))
    found = F.coalesce("n", "told", "seen")
    which = F.when(F.col("n").isNotNull(), 1).when(F.col("told").isNotNull(), 2).when(F.col("seen").isNotNull(), 3)
    return own.select("id", found.alias("page_no"), F.when(found.isNull(), "unknown").otherwise("detected").alias("source"), which.alias("pass"))


def margin_excerpt(raw: Column) -> Column:
    """Six lines from each end, without structural numerals; the whole of a short page."""
    lines = F.transform(lines_of(raw), t.without_structural_numerals)
    short = F.array_join(lines, "\n")
    long = F.concat_ws("\n…\n", F.array_join(F.slice(lines, 1, 6), "\n"), F.array_join(F.slice(lines, -6, 6), "\n"))
    return F.when(F.size(lines) <= 12, short).otherwise(long)


def reconcile_facing(spreads: DataFrame, used: DataFrame) -> DataFrame:
    """Numbers of facing pages ``book_id, stamp, left_no, right_no``; ``used`` holds other pages' numbers.

    One known number gives the other; consecutive ones stand; else the reading whose two
    numbers are less used elsewhere wins, the left one on a tie.
    """
    # per book and number: whether a half without a stamp has it, and the first and last stamp that do
    marks = used.groupBy("book_id", F.col("page_no").alias("_n")).agg(
        F.max(F.col("stamp").isNull()).alias("_bare"), F.min("stamp").alias("_lo"), F.max("stamp").alias("_hi")
    )
    df = spreads
    for name, n in (("l0", F.col("left_no")), ("l1", F.col("left_no") + 1), ("r0", F.col("right_no") - 1), ("r1", F.col("right_no"))):
        # the spread's own halves do not count as elsewhere
        other = F.col("_bare") | (F.col("_lo") != F.col("stamp")) | (F.col("_hi") != F.col("stamp"))
        df = df.withColumn("_n", n).join(marks, ["book_id", "_n"], "left")
        df = df.withColumn(f"_{name}", F.coalesce(other, F.lit(False)).cast("int")).drop("_n", "_bare", "_lo", "_hi")
    fit = lambda n: n.between(1, 2999)
    score = lambda a, b, x, y: F.when(fit(a) & fit(b), 2 - F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).otherwise(-1)
    lo, ro = F.col("left_no"), F.col("right_no")
    left = score(lo, lo + 1, F.col("_l0"), F.col("_l1"))
    right = score(ro - 1, ro, F.col("_r0"), F.col("_r1"))
    none = lo.isNull() & ro.isNull()
    new_left = (
        F.when(none, None).when(ro.isNull(), lo).when(lo.isNull(), F.when(fit(ro - 1), ro - 1)).when(ro == lo + 1, lo)
        .when(right > left, ro - 1).when(left >= 0, lo)
    )
    new_right = (
        F.when(none, None).when(ro.isNull(), F.when(fit(lo + 1), lo + 1)).when(lo.isNull(), ro).when(ro == lo + 1, ro)
        .when(right > left, ro).when(left >= 0, lo + 1)
    )
    return df.select("book_id", "stamp", new_left.alias("left_no"), new_right.alias("right_no"))
