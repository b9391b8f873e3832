"""Relational queries over the library: reading order, revisions, vocabulary, edits, deletes."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import cascade, segment, structure
from ..sources import imports, library, versions
from ..streaming import vocabulary as vocabulary_stream
from . import duck
from .reading import _NTH
from .relations import BL, LK, PG, SM, blocks, lookups, pages, summaries, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _pages(spark, sf_dir):
    return pages(spark, sf_dir).drop("raw")


@query("SELECT source AS title, regexp_extract(source, '([0-9]+)$', 1)::BIGINT AS id, row_number() OVER (ORDER BY max(doc_id) DESC) AS nth FROM documents GROUP BY source")
def books_by_update(spark, sf_dir):
    """Books, last touched first; one row per book reaches the sort."""
    docs = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("title")).agg(F.max("doc_id").alias("at"))
    return docs.select("title", F.regexp_extract("title", "([0-9]+)$", 1).cast("long").alias("id"), F.row_number().over(Window.orderBy(F.desc("at"))).cast("long").alias("nth"))


@query(f"WITH {PG}, {_NTH} SELECT id, book_id, page_no, nth FROM ro")
def reading_order(spark, sf_dir):
    return structure.reading_order(_pages(spark, sf_dir)).select("id", "book_id", "page_no", F.col("nth").cast("long").alias("nth"))


@query(f"WITH {PG}, {_NTH} SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM ro WINDOW w AS (PARTITION BY book_id ORDER BY nth)")
def page_turns(spark, sf_dir):
    own = structure.reading_order(_pages(spark, sf_dir)).select("id", "book_id", "nth")
    moved = lambda by, name: own.select("book_id", (F.col("nth") + by).alias("nth"), F.col("id").alias(name))
    near = own.join(moved(1, "previous_id"), ["book_id", "nth"], "left").join(moved(-1, "next_id"), ["book_id", "nth"], "left")
    return near.select("id", "previous_id", "next_id")


@query(f"WITH {PG}, {BL} SELECT page_id, arg_min(id, ordinal) AS first_id, arg_max(id, ordinal) AS last_id FROM bl WHERE kind = 'paragraph' GROUP BY page_id")
def edge_paragraphs(spark, sf_dir):
    return structure.edge_paragraphs(blocks(spark, sf_dir)).select("page_id", F.col("first.id").alias("first_id"), F.col("last.id").alias("last_id"))


@query(f"WITH {SM} SELECT block_id, max(revision) AS revision, arg_max(sentence, revision) AS sentence FROM sm WHERE sentence_ordinal IS NULL GROUP BY block_id")
def latest_summary(spark, sf_dir):
    own = summaries(spark, sf_dir).where("sentence_ordinal IS NULL")
    return own.groupBy("block_id").agg(F.max("revision").alias("revision"), F.max_by("sentence", "revision").alias("sentence"))


@query(
    f"""WITH {SM} SELECT block_id, sentence_ordinal, sentence FROM sm s WHERE sentence_ordinal IS NOT NULL AND revision =
  (SELECT max(revision) FROM sm x WHERE x.block_id = s.block_id AND x.sentence_ordinal IS NOT DISTINCT FROM s.sentence_ordinal)"""
)
def sentence_notes(spark, sf_dir):
    own = summaries(spark, sf_dir).where("sentence_ordinal IS NOT NULL")
    return own.groupBy("block_id", "sentence_ordinal").agg(F.max_by("sentence", "revision").alias("sentence"))


@query(
    f"""WITH {PG}, {BL}, {SM} SELECT p.book_id, p.page_no, b.ordinal, b.id AS block_id, s.sentence,
  row_number() OVER (PARTITION BY p.book_id ORDER BY p.page_no IS NULL, p.page_no, p.created_at, b.ordinal, b.id) AS nth
  FROM bl b JOIN pg p ON p.id = b.page_id JOIN sm s ON s.block_id = b.id
  WHERE s.sentence_ordinal IS NULL AND s.revision = (SELECT max(revision) FROM sm x WHERE x.block_id = b.id AND x.sentence_ordinal IS NULL)"""
)
def summary_spine(spark, sf_dir):
    """The latest summaries in reading order; block id breaks ties."""
    last = latest_summary(spark, sf_dir).withColumnRenamed("block_id", "id")
    own = blocks(spark, sf_dir).select("id", "page_id", "ordinal").join(last, "id")
    own = own.join(_pages(spark, sf_dir).select(F.col("id").alias("page_id"), "book_id", "page_no", "created_at"), "page_id")
    own = structure.ranked(own, "book_id", structure.place_keys(), ["created_at", "ordinal", "id"], "nth")
    return own.select("book_id", "page_no", "ordinal", F.col("id").alias("block_id"), "sentence", F.col("nth").cast("long").alias("nth"))


@query(
    f"""WITH {PG}, {BL}, {SM}, {LK} SELECT p.book_id, count(DISTINCT p.id) AS n_pages, count(DISTINCT CASE WHEN b.kind = 'paragraph' THEN b.id END) AS n_paragraphs, count(DISTINCT s.block_id) AS n_summarised,
  coalesce((SELECT count(DISTINCT lower(word)) FROM lk WHERE lk.book_id = p.book_id), 0) AS n_words
  FROM pg p LEFT JOIN bl b ON b.page_id = p.id LEFT JOIN sm s ON s.block_id = b.id AND s.sentence_ordinal IS NULL GROUP BY p.book_id"""
)
def book_stats(spark, sf_dir):
    """Pages, paragraphs, summarised blocks and vocabulary of each book; revisions count once."""
    own = blocks(spark, sf_dir).select("id", "book_id", "kind")
    done = summaries(spark, sf_dir).where("sentence_ordinal IS NULL").select(F.col("block_id").alias("id")).distinct().withColumn("s", F.lit(1))
    para = own.join(done, "id", "left").groupBy("book_id").agg(F.count_if(F.col("kind") == "paragraph").alias("n_paragraphs"), F.count("s").alias("n_summarised"))
    words = lookups(spark, sf_dir).groupBy("book_id").agg(F.countDistinct(F.lower("word")).alias("n_words"))
    every = _pages(spark, sf_dir).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_pages"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(para, "book_id", "left").join(words, "book_id", "left").select("book_id", "n_pages", zero("n_paragraphs"), zero("n_summarised"), zero("n_words"))


@query(f"WITH {SM} SELECT id, block_id, sentence_ordinal, row_number() OVER (PARTITION BY block_id, sentence_ordinal ORDER BY id) AS revision FROM sm")
def next_revisions(spark, sf_dir):
    """Append-only revisions: numbered by arrival per block and (null-safe) sentence."""
    w = Window.partitionBy("block_id", "sentence_ordinal").orderBy("id")
    return summaries(spark, sf_dir).select("id", "block_id", "sentence_ordinal", F.row_number().over(w).cast("long").alias("revision"))


@query(f"WITH {SM} SELECT id, block_id, sentence_ordinal, row_number() OVER (PARTITION BY block_id, sentence_ordinal ORDER BY id) AS revision FROM sm")
def appended_revisions(spark, sf_dir):
    """The same from three batches, each of which goes on from what is stored."""
    path, own = library.shared_folder(spark, "revisions"), summaries(spark, sf_dir)
    for k in range(3):
        library.append_revisions(own.where((F.col("id") % 100) / 3 >= k).where((F.col("id") % 100) / 3 < (k + 1 if k < 2 else 100)), path)
    return spark.read.schema(library.REVISIONS).parquet(path).select("id", "block_id", F.col("sentence_ordinal").cast("long").alias("sentence_ordinal"), "revision")


@query(
    f"""WITH {LK}, v AS (SELECT book_id, lower(word) AS word, count(*) AS count, min(id) AS first_id, arg_min(lemma, id) AS lemma FROM lk GROUP BY ALL)
SELECT v.book_id, v.word, v.lemma, v.count, lk.sentence, row_number() OVER (PARTITION BY v.book_id ORDER BY v.count DESC, v.word) AS nth FROM v LEFT JOIN lk ON lk.id = v.first_id"""
)
def vocabulary(spark, sf_dir):
    """Words looked up, with the first lookup's lemma and sentence, most frequent first."""
    own = lookups(spark, sf_dir).withColumn("word", F.lower("word"))
    v = own.groupBy("book_id", "word").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("id", "lemma", "sentence")).alias("first"))
    v = structure.ranked(v, "book_id", [-F.col("count"), F.substring("word", 1, 2)], ["word"], "nth")
    return v.select("book_id", "word", F.col("first.lemma").alias("lemma"), "count", F.col("first.sentence").alias("sentence"), F.col("nth").cast("long").alias("nth"))


@query("SELECT event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def settings(spark, sf_dir):
    """Last write wins per key."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.max_by("value", "event_id").alias("value"))


_DEFAULTS = "(SELECT * FROM (VALUES ('click', 'c'), ('view', 'v'), ('theme', 'dark')) AS v(key, fallback))"


@query(f"SELECT d.key, coalesce(s.value::BIGINT::VARCHAR, d.fallback) AS value FROM {_DEFAULTS} d LEFT JOIN (SELECT event_type AS key, floor(arg_max(value, event_id)) AS value FROM events GROUP BY event_type) s ON s.key = d.key")
def settings_over_defaults(spark, sf_dir):
    own = settings(spark, sf_dir).select("key", F.floor("value").cast("string").alias("value"))
    return spark.sql(f"SELECT * FROM {_DEFAULTS}").join(own, "key", "left").select("key", F.coalesce("value", "fallback").alias("value"))


@query(f"WITH {PG} SELECT id, book_id, page_no FROM pg p WHERE page_no IS NOT NULL AND EXISTS (SELECT 1 FROM pg q WHERE q.book_id = p.book_id AND q.page_no = p.page_no AND q.id <> p.id)")
def clashing_pages(spark, sf_dir):
    own = _pages(spark, sf_dir).where("page_no IS NOT NULL")
    often = own.groupBy("book_id", "page_no").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return own.join(often, ["book_id", "page_no"], "left_semi").select("id", "book_id", "page_no")


@query(
    f"""WITH {PG}, {_NTH}, r AS (SELECT DISTINCT book_id, book_id * 3 AS last_page_id FROM pg)
SELECT r.book_id, coalesce(p.id, f.id) AS page_id FROM r LEFT JOIN pg p ON p.id = r.last_page_id AND p.book_id = r.book_id LEFT JOIN ro f ON f.book_id = r.book_id AND f.nth = 1"""
)
def resume_pages(spark, sf_dir):
    """The remembered page if the book still has it, else the first in reading order."""
    own = _pages(spark, sf_dir)
    first = own.groupBy("book_id").agg(F.min_by("id", F.struct(F.col("page_no").isNull(), "page_no", "created_at", "id")).alias("first_id"))
    told = first.select("book_id", "first_id", (F.col("book_id") * 3).alias("id"))
    return told.join(own.select("id", "book_id").withColumn("ok", F.lit(1)), ["book_id", "id"], "left").select("book_id", F.when(F.col("ok") == 1, F.col("id")).otherwise(F.col("first_id")).alias("page_id"))


@query(
    f"""WITH {PG}, {BL}, {SM}, gp AS (SELECT id FROM pg WHERE book_id % 4 <> 1), gb AS (SELECT bl.id FROM bl JOIN gp ON gp.id = bl.page_id), gs AS (SELECT sm.id FROM sm JOIN gb ON gb.id = sm.block_id)
SELECT 'pages' AS relation, id::VARCHAR AS id FROM gp UNION ALL SELECT 'blocks', id FROM gb UNION ALL SELECT 'summaries', id::VARCHAR FROM gs"""
)
def cascade_delete(spark, sf_dir):
    """What is left of pages, blocks and summaries when every fourth book is deleted."""
    own = _pages(spark, sf_dir)
    gone = own.where("book_id % 4 = 1").select("book_id").distinct()
    left = own.join(gone, "book_id", "left_anti")
    kept = blocks(spark, sf_dir).select("id", "page_id").join(left.select(F.col("id").alias("page_id")), "page_id", "left_semi")
    kept = library.staged(kept, "blocks")
    notes = summaries(spark, sf_dir).select("id", "block_id").join(kept.select(F.col("id").alias("block_id")), "block_id", "left_semi")
    parts = [("pages", left), ("blocks", kept), ("summaries", notes)]
    out = [df.select(F.lit(name).alias("relation"), F.col("id").cast("string").alias("id")) for name, df in parts]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query(f"WITH {LK}, {PG}, {BL} SELECT lk.id, CASE WHEN b.id IS NOT NULL THEN lk.id || ':1' END AS block_id FROM lk LEFT JOIN bl b ON b.id = lk.id || ':1' AND b.kind <> 'quote'")
def lookups_set_null(spark, sf_dir):
    """Lookups whose block is gone keep their row and lose the reference."""
    live = blocks(spark, sf_dir).where("kind <> 'quote'").select(F.col("id").alias("block_id")).withColumn("ok", F.lit(1))
    own = lookups(spark, sf_dir).select("id", segment.block_id(F.col("id"), F.lit(1)).alias("block_id"))
    return own.join(live, "block_id", "left").select("id", F.when(F.col("ok") == 1, F.col("block_id")).alias("block_id"))


#: the library's relations, and what is deleted from them
_LIB = """bk AS (SELECT DISTINCT book_id AS id, book_id * 3 AS last_page_id FROM pg), cr AS (SELECT id, id AS summary_id FROM sm WHERE id % 2 = 0),
ru AS (SELECT id AS id, book_id FROM pg WHERE id % 11 = 0), lo AS (SELECT id, book_id, id || ':1' AS block_id FROM lk), vo AS (SELECT min(id) AS id, book_id, min(id) AS first_lookup_id FROM lk GROUP BY book_id, lower(word))"""
_GONE = """gk AS (SELECT id FROM bk WHERE id % 4 = 1), gp AS (SELECT id FROM pg WHERE id % 7 = 3 OR book_id IN (FROM gk)),
gb AS (SELECT id FROM bl WHERE (ordinal = 2 AND page_id % 5 = 0) OR page_id IN (FROM gp)), gs AS (SELECT id FROM sm WHERE block_id IN (FROM gb)), gl AS (SELECT id FROM lo WHERE id % 13 = 1 OR book_id IN (FROM gk))"""


@query(
    f"""WITH {PG}, {BL}, {SM}, {LK}, {_LIB}, {_GONE}
SELECT 'books' AS relation, id::VARCHAR AS id, CASE WHEN last_page_id NOT IN (FROM gp) THEN last_page_id::VARCHAR END AS refers FROM bk WHERE id NOT IN (FROM gk)
UNION ALL SELECT 'pages', id::VARCHAR, book_id::VARCHAR FROM pg WHERE id NOT IN (FROM gp) UNION ALL SELECT 'blocks', id, page_id::VARCHAR FROM bl WHERE id NOT IN (FROM gb)
UNION ALL SELECT 'summaries', id::VARCHAR, block_id FROM sm WHERE id NOT IN (FROM gs) UNION ALL SELECT 'critiques', id::VARCHAR, summary_id::VARCHAR FROM cr WHERE summary_id NOT IN (FROM gs)
UNION ALL SELECT 'rollups', id::VARCHAR, book_id::VARCHAR FROM ru WHERE book_id NOT IN (FROM gk)
UNION ALL SELECT 'lookups', id::VARCHAR, CASE WHEN block_id NOT IN (FROM gb) THEN block_id END FROM lo WHERE id NOT IN (FROM gl)
UNION ALL SELECT 'vocab', id::VARCHAR, CASE WHEN first_lookup_id NOT IN (FROM gl) THEN first_lookup_id::VARCHAR END FROM vo WHERE book_id NOT IN (FROM gk)"""
)
def cascade_graph(spark, sf_dir):
    """All relations without some books, pages, blocks and lookups and what hangs on these, by the declared keys."""
    own, words, notes = library.staged(_pages(spark, sf_dir), "pages"), lookups(spark, sf_dir), summaries(spark, sf_dir)
    own_blocks = library.staged(blocks(spark, sf_dir).select("id", "page_id", "ordinal"), "blocks")
    tables = {
        "books": own.select(F.col("book_id").alias("id"), (F.col("book_id") * 3).alias("last_page_id")).distinct(), "pages": own.select("id", "book_id"),
        "blocks": own_blocks, "summaries": notes.select("id", "block_id"), "critiques": notes.where("id % 2 = 0").select("id", F.col("id").alias("summary_id")),
        "rollups": own.where("id % 11 = 0").select("id", "book_id"), "lookups": words.select("id", "book_id", segment.block_id(F.col("id"), F.lit(1)).alias("block_id")),
        "vocab": words.groupBy("book_id", F.lower("word")).agg(F.min("id").alias("id")).select("id", "book_id", F.col("id").alias("first_lookup_id")),
    }
    gone = {
        "books": tables["books"].where("id % 4 = 1"), "pages": tables["pages"].where("id % 7 = 3"),
        "blocks": own_blocks.where("ordinal = 2 AND page_id % 5 = 0"), "lookups": tables["lookups"].where("id % 13 = 1"),
    }
    shown = {"books": "last_page_id", "pages": "book_id", "blocks": "page_id", "summaries": "block_id", "critiques": "summary_id", "rollups": "book_id", "lookups": "block_id", "vocab": "first_lookup_id"}
    left = cascade.delete(tables, gone)
    out = [left[name].select(F.lit(name).alias("relation"), F.col("id").cast("string").alias("id"), F.col(c).cast("string").alias("refers")) for name, c in shown.items()]
    return functools.reduce(DataFrame.unionAll, out)


_HASHED = "SELECT id, book_id, page_no, sha256(raw) AS image_hash FROM pg WHERE id < 900000000"


@query(
    f"""WITH {PG}, h AS ({_HASHED}), a AS (SELECT * FROM h WHERE id % 2 = 0), b AS (SELECT * FROM h WHERE id % 2 = 1),
t AS (SELECT book_id, image_hash, min(id) AS id, arg_min([page_no], id)[1] AS page_no FROM a GROUP BY book_id, image_hash), f AS (SELECT book_id, image_hash, min(id) AS id, arg_min([page_no], id)[1] AS page_no FROM b GROUP BY book_id, image_hash)
SELECT b.id, b.book_id, b.image_hash, coalesce(t.id, CASE WHEN f.id <> b.id THEN f.id END) AS existing_id, CASE WHEN t.id IS NOT NULL THEN t.page_no WHEN f.id <> b.id THEN f.page_no END AS existing_no, t.id IS NULL AND f.id = b.id AS added
FROM b JOIN f USING (book_id, image_hash) LEFT JOIN t USING (book_id, image_hash)"""
)
def checked_imports(spark, sf_dir):
    """What a second import of pages is told: added, or the stored or new page that it repeats.

    Even documents are imported first; the text stands for the picture.
    """
    path = library.shared_folder(spark, "imports")
    own = pages(spark, sf_dir).where("id < 900000000").select("id", "book_id", "page_no", F.sha2(F.col("raw").cast("binary"), 256).alias("image_hash"))
    imports.add_pages(own.where("id % 2 = 0"), path)
    return imports.add_pages(own.where("id % 2 = 1"), path)


@query(
    f"""WITH {PG}, {BL}, {SM}, p AS (SELECT id, book_id, book_id % 3 = 0 AS early, book_id % 3 = 0 AND id % 2 = 0 AS again FROM pg),
v1 AS (SELECT bl.id, page_id, text_raw, again FROM bl JOIN p ON p.id = bl.page_id WHERE NOT early UNION ALL SELECT id || ':1', id, 'an earlier reading of this page.', again FROM p WHERE early),
s1 AS (SELECT sm.id, sentence FROM sm JOIN v1 ON v1.id = sm.block_id WHERE NOT again)
SELECT 'blocks' AS relation, id, text_raw AS text FROM v1 WHERE NOT again UNION ALL SELECT 'blocks', bl.id, text_raw FROM bl JOIN p ON p.id = bl.page_id WHERE again
UNION ALL SELECT 'summaries', id::VARCHAR, sentence FROM s1 UNION ALL SELECT 'critiques', id::VARCHAR, 'partial' FROM s1"""
)
def replaced_pages(spark, sf_dir):
    """Blocks, summaries and critiques after every other page of every third book was segmented again."""
    root, own = library.shared_folder(spark, "library"), pages(spark, sf_dir)
    early = F.when(F.col("book_id") % 3 == 0, F.lit("an earlier reading of this page.")).otherwise(F.col("raw"))
    first = library.staged(segment.block_rows(segment.page_blocks(own.withColumn("raw", early))), "blocks")
    notes = summaries(spark, sf_dir).select("id", "block_id", "sentence").join(first.select(F.col("id").alias("block_id"), "book_id"), "block_id")
    critiques = notes.select("id", F.col("id").alias("summary_id"), F.lit("partial").alias("verdict"), "book_id")
    versions.create(spark, root, {"blocks": first, "summaries": notes.select("id", "block_id", "sentence", "book_id"), "critiques": critiques})
    again = own.where("book_id % 3 = 0 AND id % 2 = 0")
    versions.replace_pages(spark, root, segment.block_rows(segment.page_blocks(again)), again.select("book_id", F.col("id").alias("page_id")))
    shown = {"blocks": "text_raw", "summaries": "sentence", "critiques": "verdict"}
    out = [versions.read(spark, root, r).select(F.lit(r).alias("relation"), F.col("id").cast("string").alias("id"), F.col(c).alias("text")) for r, c in shown.items()]
    return functools.reduce(DataFrame.unionAll, out)


_EDITS = "(SELECT block_id, arg_max(sentence, revision) AS text FROM sm WHERE sentence_ordinal IS NULL GROUP BY block_id)"


@query(f"WITH {PG}, {BL}, {SM} SELECT bl.id, text_raw, coalesce(e.text, text_norm) AS text_norm, e.text IS NOT NULL AS user_edited FROM bl LEFT JOIN {_EDITS} e ON e.block_id = bl.id")
def edited_blocks(spark, sf_dir):
    """Edits overlay the reading text and leave the raw text as it was."""
    edits = latest_summary(spark, sf_dir).select(F.col("block_id").alias("id"), F.col("sentence").alias("text"))
    own = blocks(spark, sf_dir).select("id", "text_raw", "text_norm").join(edits, "id", "left")
    return own.select("id", "text_raw", F.coalesce("text", "text_norm").alias("text_norm"), F.col("text").isNotNull().alias("user_edited"))


@query(f"WITH {SM} SELECT id, 'on_target' AS verdict, length(sentence) > 100 AS covers_subject FROM sm WHERE {duck.trim('sentence')} <> '' AND sentence_ordinal IS NOT NULL")
def saved_notes(spark, sf_dir):
    """Notes that are not blank, appended with their verdict."""
    own = summaries(spark, sf_dir).where((t.trim(F.col("sentence")) != "") & F.col("sentence_ordinal").isNotNull())
    return own.select("id", F.lit("on_target").alias("verdict"), (F.length("sentence") > 100).alias("covers_subject"))


@query(
    f"""WITH {PG}, {BL}, {SM}, x AS (SELECT bl.page_id, count(*) AS paragraphs, count(s.block_id) AS summarised FROM bl LEFT JOIN (SELECT DISTINCT block_id FROM sm WHERE sentence_ordinal IS NULL) s ON s.block_id = bl.id WHERE kind = 'paragraph' GROUP BY 1)
SELECT pg.book_id, sum(paragraphs)::BIGINT AS paragraphs, sum(summarised)::BIGINT AS summarised, sum(summarised)::DOUBLE / sum(paragraphs)::DOUBLE AS ratio FROM x JOIN pg ON pg.id = x.page_id GROUP BY pg.book_id"""
)
def progress(spark, sf_dir):
    own = blocks(spark, sf_dir).where("kind = 'paragraph'").select("id", "book_id")
    done = summaries(spark, sf_dir).where("sentence_ordinal IS NULL").select(F.col("block_id").alias("id")).distinct().withColumn("s", F.lit(1))
    out = own.join(done, "id", "left").groupBy("book_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.count("s").alias("summarised"))
    return out.withColumn("ratio", F.try_divide(F.col("summarised").cast("double"), F.col("paragraphs")))


@query("SELECT doc_id AS id, source AS book, sha256(text) AS image_hash FROM documents QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1")
def distinct_images(spark, sf_dir):
    """The first page of each content digest in a book: duplicate imports are refused."""
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("book"), F.sha2(F.col("text").cast("binary"), 256).alias("image_hash"))
    return own.groupBy("book", "image_hash").agg(F.min("id").alias("id")).select("id", "book", "image_hash")


@query(f"WITH {PG} SELECT id FROM pg WHERE page_no IS NULL AND id IN (SELECT doc_id FROM labels)")
def pages_needing_numbers(spark, sf_dir):
    return _pages(spark, sf_dir).where("page_no IS NULL").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").select("id")


@query(f"WITH {PG}, d AS (SELECT id, book_id, CASE WHEN id % 9 = 0 THEN 'part ' || id END AS label FROM pg), r AS (SELECT *, count(label) OVER (PARTITION BY book_id ORDER BY id) AS g FROM d) SELECT book_id, g, max(label) AS label, count(*) AS n_pages FROM r GROUP BY book_id, g")
def division_page_counts(spark, sf_dir):
    """Pages per division: one without a label belongs to the last label before it."""
    label = F.when(F.col("id") % 9 == 0, F.concat(F.lit("part "), F.col("id")))
    own = _pages(spark, sf_dir).select("id", "book_id", label.alias("label")).withColumn("s", F.floor(F.col("id") / 4096))
    # labels are counted within stretches of ids, and over the stretches: no book is in one task
    inside = Window.partitionBy("book_id", "s").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("book_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy("book_id", "s").agg(F.count("label").alias("n")).select("book_id", "s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = own.withColumn("g", F.count("label").over(inside)).join(counts, ["book_id", "s"]).withColumn("g", F.col("g") + F.col("before"))
    return own.groupBy("book_id", "g").agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("n_pages"))


@query(f"WITH {SM} SELECT block_id, count(*) FILTER (sentence_ordinal IS NOT NULL) AS notes, sum({duck.count('sentence')})::BIGINT AS words FROM sm GROUP BY block_id")
def note_progress(spark, sf_dir):
    return summaries(spark, sf_dir).groupBy("block_id").agg(
        F.count_if(F.col("sentence_ordinal").isNotNull()).alias("notes"), F.sum(t.word_count(F.col("sentence"))).alias("words")
    )


@query("SELECT user_id AS book_id, lower(event_type) AS word, 'lemma-' || (min(event_id) % 5) AS lemma, count(DISTINCT event_id) AS count, arg_min(props, event_id) AS sentence, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def streamed_vocabulary(spark, sf_dir):
    """The vocabulary that a stream over the events ends with, in batches with repeats and the oldest last."""
    return vocabulary_stream.replay(spark, table(spark, sf_dir, "events"), library.shared_folder(spark, "stream"))


@query(f"WITH {PG}, {BL} SELECT bl.id, page_id, book_id, ordinal, kind, text_raw, text_norm FROM bl JOIN pg ON pg.id = bl.page_id")
def saved_blocks(spark, sf_dir):
    """Blocks written book by book; every third book is segmented again and replaces what was there."""
    path = library.shared_folder(spark, "blocks")
    own = pages(spark, sf_dir)
    early = F.when(F.col("book_id") % 3 == 0, F.lit("an earlier reading of this page.")).otherwise(F.col("raw"))
    library.save_blocks(segment.block_rows(segment.page_blocks(own.withColumn("raw", early))), path)
    library.save_blocks(segment.block_rows(segment.page_blocks(own.where("book_id % 3 = 0"))), path)
    return library.read_blocks(spark, path).select("id", "page_id", "book_id", "ordinal", "kind", "text_raw", "text_norm")


_ASKED = "(SELECT doc_id AS id FROM labels UNION SELECT -1 - doc_id FROM labels WHERE doc_id % 5 = 0)"


@query(f"WITH {PG} SELECT a.id, pg.book_id, pg.title, pg.id IS NOT NULL AS found FROM {_ASKED} a LEFT JOIN pg ON pg.id = a.id")
def page_lookup(spark, sf_dir):
    """Pages by id; an id that no page has says so."""
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    ids = ids.unionAll(ids.where("id % 5 = 0").select((-1 - F.col("id")).alias("id"))).distinct()
    own = _pages(spark, sf_dir).select("id", "book_id", "title").withColumn("_ok", F.lit(True))
    return ids.join(own, "id", "left").select("id", "book_id", "title", F.coalesce("_ok", F.lit(False)).alias("found"))


_FIELDS = ["page_no", "ocr_status", "last_page_id", "source_ref"]
_LOG = f"(SELECT event_id, user_id % 97 AS id, [{str(_FIELDS)[1:-1]}][1 + event_id % 4] AS field, CASE WHEN event_id % 11 <> 0 THEN props END AS value FROM events)"


@query(
    f"""WITH {PG}, lg AS {_LOG}, la AS (SELECT id, field, arg_max([value], event_id)[1] AS value FROM lg GROUP BY id, field)
SELECT pg.id, pg.book_id, {', '.join(f"max(value) FILTER (field = '{f}') AS {f}" for f in _FIELDS)}, {', '.join(f"count(*) FILTER (field = '{f}') > 0 AS set_{f}" for f in _FIELDS)}
FROM pg JOIN la ON la.id = pg.id GROUP BY pg.id, pg.book_id"""
)
def updated_pages(spark, sf_dir):
    """Pages with the last value that each of their fields was set to; a field can be set to nothing."""
    field = F.element_at(F.array(*[F.lit(f) for f in _FIELDS]), (F.col("event_id") % 4 + 1).cast("int"))
    value = F.when(F.col("event_id") % 11 != 0, F.col("props"))
    log = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 97).alias("id"), field.alias("field"), value.alias("value"))
    last = log.groupBy("id").agg(*[F.max(F.when(F.col("field") == f, F.struct("event_id", "value"))).alias(f) for f in _FIELDS])
    own = _pages(spark, sf_dir).select("id", "book_id").join(last, "id")
    return own.select("id", "book_id", *[F.col(f)["value"].alias(f) for f in _FIELDS], *[F.col(f).isNotNull().alias(f"set_{f}") for f in _FIELDS])


@query(
    f"""WITH {PG}, {BL}, {SM}, e AS (SELECT block_id, arg_max(sentence, revision) AS text, max(revision) AS rev FROM sm GROUP BY block_id)
SELECT bl.id, text_raw, coalesce(e.text, text_norm) AS text_norm, CASE WHEN e.rev % 3 = 0 THEN 'heading' WHEN e.rev % 3 = 1 THEN 'quote' ELSE bl.kind END AS kind, e.rev IS NOT NULL AS user_edited FROM bl LEFT JOIN e ON e.block_id = bl.id"""
)
def edited_kinds(spark, sf_dir):
    """Edits of a block's text and kind; the raw text stays as it was read."""
    edits = summaries(spark, sf_dir).groupBy(F.col("block_id").alias("id")).agg(F.max_by("sentence", "revision").alias("text"), F.max("revision").alias("rev"))
    own = blocks(spark, sf_dir).select("id", "text_raw", "text_norm", "kind").join(edits, "id", "left")
    kind = F.when(F.col("rev") % 3 == 0, "heading").when(F.col("rev") % 3 == 1, "quote").otherwise(F.col("kind"))
    return own.select("id", "text_raw", F.coalesce("text", "text_norm").alias("text_norm"), kind.alias("kind"), F.col("rev").isNotNull().alias("user_edited"))
