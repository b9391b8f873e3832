"""Paragraph runs to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.arrays import let
from . import broken_words

PER_PAGE = 8
REFERENCED = 0.6
_REFERENCE = "^[0-9]+:[0-9]+$"


def source_kind(place: Column) -> Column:
    low = F.lower(place)
    return F.when(low.rlike("^https?://"), "web").when(low.endswith(".epub"), "epub").when(low.endswith(".pdf"), "pdf").otherwise("photo")


def leading_chapter(text: Column) -> Column:
    """The chapter of a leading ``chapter:verse``, else null."""
    return F.regexp_extract(F.try_element_at(t.words(text), F.lit(1)), r"^\+?([0-9]+):[0-9]+$", 1).try_cast("long")


def split_units(text: Column) -> Column:
    """Numbered units that one paragraph runs together, cut before each further reference."""
    marked = F.transform(t.words(text), lambda w, i: F.when((i > 0) & w.rlike(_REFERENCE), F.concat(F.lit("\u0001"), w)).otherwise(w))
    return F.transform(F.split(F.array_join(marked, " "), "\u0001"), t.trim)


#: Paragraphs of a run that one task puts in order.
STRETCH = 1 << 16


def paginate(runs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``run_id, page, label, k, text`` from paragraphs ``run_id, label, ordinal, paragraph``.

    A run whose paragraphs mostly open with a reference is cut into units and gets a page per
    chapter; any other gets a page per eight paragraphs.  The first page carries the label.
    A run is put in order by stretches of its ordinals: what a stretch needs of the earlier
    ones, the units before it, the chapter that is open and the pages that were begun, is
    carried over the few rows that stand for stretches.  ``runs`` is read twice.
    """
    key = ["run_id", "s"]
    rows = runs.withColumn("s", F.floor(F.col("ordinal") / stretch))
    run, earlier = Window.partitionBy("run_id"), Window.partitionBy("run_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    told = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count(leading_chapter(F.col("paragraph"))).alias("c"))
    share = F.sum("c").over(run).cast("float") >= F.sum("n").over(run).cast("float") * F.lit(REFERENCED).cast("float")
    df = rows.join(told.select(*key, share.alias("by_reference"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), key)
    inside = Window.partitionBy(*key).orderBy("ordinal")
    plain = df.where(~F.col("by_reference")).withColumn("k", F.row_number().over(inside) - 1 + F.col("before"))
    plain = plain.select("run_id", "label", (F.floor(F.col("k") / PER_PAGE) + 1).alias("page"), F.col("k").cast("long").alias("k"), F.col("paragraph").alias("text"))

    units = df.where("by_reference").select(*key, "label", "ordinal", F.posexplode(split_units(F.col("paragraph"))).alias("u", "text"))
    inside = Window.partitionBy(*key).orderBy("ordinal", "u")
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("chapter", leading_chapter(F.col("text")))
    units = units.withColumns({"i": F.row_number().over(inside), "open": F.last("chapter", ignorenulls=True).over(past)})
    turn = F.coalesce((F.col("chapter") != F.col("open")).cast("int"), F.lit(0))
    units = units.withColumns({"turn": turn, "first": F.first("chapter", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    ends = units.groupBy(*key).agg(
        F.max("i").alias("n"), F.sum("turn").alias("turns"), F.max_by("first", "i").alias("first"),
        F.max_by("chapter", F.when(F.col("chapter").isNotNull(), F.col("i"))).alias("last"),
    )
    carried = ends.withColumn("carry", F.last("last", ignorenulls=True).over(earlier))
    # a stretch's first chapter may begin a page that only the chapter before the stretch tells
    begun = F.coalesce((F.col("first") != F.col("carry")).cast("int"), F.lit(0))
    carried = carried.select(
        *key, "carry", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.sum(F.col("turns") + begun).over(earlier), F.lit(0)).alias("pages")
    )
    units = units.join(carried, key)
    page = F.col("pages") + F.sum("turn").over(inside) + F.coalesce((F.col("first") != F.col("carry")).cast("int"), F.lit(0)) + 1
    units = units.select("run_id", "label", page.alias("page"), (F.col("i") - 1 + F.col("before")).cast("long").alias("k"), "text")
    both = plain.unionByName(units)
    return both.select("run_id", "page", F.when(F.col("page") == 1, F.col("label")).alias("label"), "k", "text")


def pdf_pages(pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, ordinal, text`` from ``doc_id, page_index, text``.

    A document of which fewer than half the pages have 40 letters has no text layer and gives
    nothing.  Paragraphs stand between blank lines; blank pages are left out and keep numbers.
    """
    letters = F.regexp_count("text", F.lit(r"\p{IsAlphabetic}"))
    real = pages.groupBy("doc_id").agg(F.avg((letters >= 40).cast("int")).alias("share")).where("share >= 0.5")
    df = pages.join(real, "doc_id", "left_semi")
    parts = F.filter(F.transform(F.split("text", r"\n[ \t]*\n"), t.squeeze), lambda x: F.regexp_count(x, F.lit(r"\p{IsAlphabetic}")) >= 3)
    return df.select("doc_id", (F.col("page_index") + 1).alias("page_no"), F.posexplode(parts).alias("ordinal", "text"))


def answers(lines: Column) -> Column:
    """Text of a response stream's lines, one JSON object each, up to the one that is ``done``.

    Lines that are not JSON are skipped.
    """
    read = F.transform(lines, lambda x: F.from_json(x, "response string, done boolean"))

    def told(own):
        done = F.array_position(F.transform(own, lambda x: F.coalesce(x["done"], F.lit(False))), True)
        kept = F.when(done > 0, F.slice(own, F.lit(1), done.cast("int"))).otherwise(own)
        return F.array_join(F.transform(kept, lambda x: F.coalesce(x["response"], F.lit(""))), "")

    return let(F.filter(read, lambda x: x["response"].isNotNull() | x["done"].isNotNull()), told)


def stream_text(transcripts: DataFrame) -> DataFrame:
    """``id, text`` of captured response streams ``id, body``; a line that no line end closes does not count."""
    lines = let(F.split("body", "\n"), lambda x: F.slice(x, F.lit(1), F.size(x) - 1))
    return transcripts.select("id", answers(lines).alias("text"))


def fit_within(width: Column, height: Column, edge: int = 1600) -> Column:
    """Size with the longest edge at most ``edge``, never enlarged, at least 1."""
    longest = F.greatest(width, height)
    scaled = lambda x: F.greatest(F.round(x.cast("double") * edge / longest).cast("long"), F.lit(1)).cast("long")
    small = longest <= edge
    return F.struct(F.when(small, width.cast("long")).otherwise(scaled(width)).alias("w"), F.when(small, height.cast("long")).otherwise(scaled(height)).alias("h"))


def import_pages(paged: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Blocks of imported pages from ``id, book_id, title, era, label, k, text``: one row per paragraph.

    A page's paragraphs are joined by blank lines and read as a transcription is.
    """
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n\n")
    pages = paged.groupBy("id", "book_id", "title", "era").agg(F.max("label").alias("label"), whole.alias("raw"))
    return broken_words.imported(pages, lexicon, "label")


def first_of_source(documents: DataFrame, source: str, key: str) -> DataFrame:
    """Documents without later ones of the same source: an import that is there is refused."""
    first = documents.groupBy(source).agg(F.min(key).alias(key))
    return documents.join(first, [source, key], "left_semi")
