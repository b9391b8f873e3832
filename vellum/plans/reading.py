"""Queries over pages and their blocks: segmentation and recovered structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.arrays import let
from ..operators import segment, structure
from ..sources import library
from . import duck, fixtures
from .relations import BL, PG, SM, blocks, pages, summaries, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


FX_LINES = fixtures.values([(x,) for x in fixtures.LINES], "v", "line")
_LINES_SQL = f"(SELECT DISTINCT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT line FROM {FX_LINES}))"


def _lines(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return own.unionAll(spark.sql(f"SELECT line FROM {FX_LINES}")).distinct()


def _rules(names: list[str]):
    x = F.col("line")
    return ["line", *[getattr(t, n)(x).alias(n) for n in names]]


def _rules_sql(names: list[str]) -> str:
    return f"SELECT line, {', '.join(f'{getattr(duck, n)("line")} AS {n}' for n in names)} FROM {_LINES_SQL}"


_LINE_RULES = ["is_furniture", "is_all_caps", "looks_like_heading", "line_kind", "line_content", "ends_mid_sentence", "starts_mid_sentence"]
_HEADING_RULES = ["heading_level", "is_title_case", "is_running_head", "is_bare_marker"]
_FOLIO_RULES = ["roman_value", "number_on_line", "folio_reply", "without_structural_numerals"]


@query(_rules_sql(_LINE_RULES))
def line_rules(spark, sf_dir):
    return _lines(spark, sf_dir).select(*_rules(_LINE_RULES))


@query(_rules_sql(_HEADING_RULES))
def heading_rules(spark, sf_dir):
    return _lines(spark, sf_dir).select(*_rules(_HEADING_RULES))


@query(_rules_sql(_FOLIO_RULES))
def folio_rules(spark, sf_dir):
    return _lines(spark, sf_dir).select(*_rules(_FOLIO_RULES))


@query(f"WITH {PG}, {BL.split(',' + chr(10) + 'fl AS')[0]} SELECT pg.id, coalesce(wrapped, false) AS prewrapped FROM pg LEFT JOIN md ON md.id = pg.id")
def line_modes(spark, sf_dir):
    return pages(spark, sf_dir).select("id", segment.is_prewrapped(segment.trimmed_lines(F.col("raw"))).alias("prewrapped"))


@query(f"WITH {PG}, {BL} SELECT id AS page_id, row_number() OVER (PARTITION BY id ORDER BY b) AS ordinal, kind, text FROM sg")
def segment_blocks(spark, sf_dir):
    rows = pages(spark, sf_dir).select("id", segment.trimmed_lines(F.col("raw")).alias("l"))
    rows = rows.select("id", F.posexplode(segment.segment(F.col("l"), segment.is_prewrapped(F.col("l")))).alias("pos", "b"))
    return rows.select(F.col("id").alias("page_id"), (F.col("pos") + 1).cast("long").alias("ordinal"), "b.kind", "b.text")


@query(f"WITH {PG}, {BL} SELECT id, page_id, ordinal, kind, text_raw, text_norm FROM bl")
def page_blocks(spark, sf_dir):
    return blocks(spark, sf_dir).drop("book_id")


# --- structure --------------------------------------------------------------------------
FX_HEADINGS = fixtures.values(fixtures.HEADINGS, "v", "page_id, ordinal, text, source_ref")
FX_FACING = fixtures.values(fixtures.FACING, "v", "book_id, id, source_ref, page_no")

#: headings of all pages, and literal ones on pages beyond these
_HEADS = f"""(SELECT page_id, ordinal, text_norm AS text, source_ref FROM bl JOIN pg ON pg.id = bl.page_id WHERE kind = 'heading'
  UNION ALL SELECT page_id + 910000000, ordinal, text, source_ref FROM {FX_HEADINGS})"""
#: facing pages: two documents are a spread
_FACES = f"""(SELECT book_id, id, (id // 2) || CASE WHEN id % 2 = 0 THEN ':left' ELSE ':right' END AS source_ref, page_no FROM pg WHERE id < 900000000
  UNION ALL SELECT book_id + 980, id + 910000000, source_ref, page_no FROM {FX_FACING})"""
_LEVEL = f"CASE WHEN coalesce({duck.trim('source_ref')} = {duck.trim('text')}, false) AND {duck.heading_level('text')} IN ('section', 'topic', 'minor') THEN 'chapter' ELSE {duck.heading_level('text')} END"


def _fold_sql(source: str) -> str:
    return f"""hl AS (SELECT page_id, ordinal, text, {_LEVEL} AS level FROM {source}),
nx AS (SELECT *, lead(text) OVER w AS next_text, lead(level) OVER w AS next_level FROM hl WINDOW w AS (PARTITION BY page_id ORDER BY ordinal)),
tk AS (SELECT *, level IN ('part', 'chapter') AND {duck.is_bare_marker('text')} AND coalesce(next_level IN ('minor', 'topic') AND {duck.count('next_text')} <= 8, false) AS takes FROM nx),
fo AS (SELECT page_id, ordinal, level, CASE WHEN takes THEN rtrim(text) || ' ' || {duck.trim('next_text')} ELSE text END AS text FROM tk
  QUALIFY NOT coalesce(lag(takes) OVER (PARTITION BY page_id ORDER BY ordinal), false))"""


def _heads(spark, sf_dir):
    """``page_id, ordinal, text, level`` of the headings of all pages and the literal ones."""
    own = blocks(spark, sf_dir).where("kind = 'heading'").select("page_id", "ordinal", F.col("text_norm").alias("text"))
    own = own.join(pages(spark, sf_dir).select(F.col("id").alias("page_id"), "source_ref"), "page_id")
    extra = spark.sql(f"SELECT CAST(page_id + 910000000 AS BIGINT) AS page_id, CAST(ordinal AS BIGINT) AS ordinal, text, source_ref FROM {FX_HEADINGS}")
    rows = own.unionByName(extra)
    return rows.withColumn("level", structure.declared_level(F.col("text"), F.col("source_ref"))).drop("source_ref")


@query(f"WITH {PG}, {BL}, {_fold_sql(_HEADS)} SELECT page_id::BIGINT AS page_id, ordinal::BIGINT AS ordinal, level, text FROM fo")
def folded_headings(spark, sf_dir):
    return structure.fold_titles(_heads(spark, sf_dir))


_NTH = "ro AS (SELECT id, book_id, page_no, created_at, row_number() OVER (PARTITION BY book_id ORDER BY page_no NULLS LAST, created_at, id) AS nth FROM pg)"


@query(
    f"""WITH {PG}, {BL}, {SM}, {_NTH}, {_fold_sql("(SELECT page_id, ordinal, text_norm AS text, source_ref FROM bl JOIN pg ON pg.id = bl.page_id WHERE kind = 'heading')")},
hd AS (SELECT page_id, string_agg(level || ': ' || text, ' | ' ORDER BY ordinal) AS headings FROM fo GROUP BY page_id),
pa AS (SELECT page_id, count(*) AS paragraphs, count(s.block_id) AS summarised, arg_min(text_norm, ordinal) AS first_text
  FROM bl LEFT JOIN (SELECT DISTINCT block_id FROM sm WHERE sentence_ordinal IS NULL) s ON s.block_id = bl.id WHERE kind = 'paragraph' GROUP BY page_id)
SELECT ro.id AS page_id, ro.book_id, ro.page_no, ro.nth, coalesce(headings, '') AS headings, {duck.preview('first_text')} AS preview,
  coalesce(paragraphs, 0) AS paragraphs, coalesce(summarised, 0) AS summarised FROM ro LEFT JOIN hd ON hd.page_id = ro.id LEFT JOIN pa ON pa.page_id = ro.id"""
)
def book_outline(spark, sf_dir):
    """Per page in reading order: folded headings, a preview, paragraphs and how many are summarised.

    Pages are segmented once, and all but the order is done in a page's row: the summarised
    places of a page come to it as one set.
    """
    done = summaries(spark, sf_dir).where("sentence_ordinal IS NULL")
    done = done.groupBy(segment.page_of(F.col("block_id")).cast("long").alias("id")).agg(F.collect_set(segment.ordinal_of(F.col("block_id")).cast("int")).alias("done"))
    own = segment.page_blocks(pages(spark, sf_dir)).drop("raw")
    numbered = F.transform("blocks", lambda b, i: F.struct(b["kind"].alias("kind"), b["text"].alias("text"), (i + 1).alias("ordinal")))
    own = own.withColumn("blocks", numbered).join(done, "id", "left")
    para = F.filter("blocks", lambda b: b["kind"] == "paragraph")
    level = lambda x, told: F.struct(structure.declared_level(x, told).alias("level"), x.alias("text"))
    texts = F.transform(F.filter("blocks", lambda b: b["kind"] == "heading"), lambda b: t.normalise(b["text"]))
    heads = let(F.struct(texts.alias("x"), F.col("source_ref").alias("told")), lambda s: F.transform(s["x"], lambda x: level(x, s["told"])))
    own = own.select(
        F.col("id"), "book_id", "page_no", "created_at", heads.alias("heads"), F.size(para).cast("long").alias("paragraphs"),
        F.size(F.filter(para, lambda b: F.array_contains("done", b["ordinal"]))).cast("long").alias("summarised"),
        t.preview(t.normalise(F.get(para, F.lit(0))["text"])).alias("preview"),
    )
    lines = F.transform(structure.fold_array(F.col("heads")), lambda x: F.concat(x["level"], F.lit(": "), x["text"]))
    return structure.reading_order(own).select(
        F.col("id").alias("page_id"), "book_id", "page_no", F.col("nth").cast("long").alias("nth"), F.array_join(lines, " | ").alias("headings"),
        "preview", "paragraphs", F.greatest("summarised", F.lit(0)).alias("summarised"),
    )


def _spans_sql(pick: str) -> str:
    one = lambda level: f"{pick}(text, ordinal) FILTER (level = '{level}') AS {level}"
    w = "(PARTITION BY book_id ORDER BY nth)"
    return f"""WITH {PG}, {BL}, {_NTH}, {_fold_sql(_HEADS)},
pgs AS (SELECT book_id, id AS page_id, nth FROM ro UNION ALL SELECT DISTINCT 980, page_id + 910000000, page_id FROM {FX_HEADINGS}),
ph AS (SELECT pgs.*, h.* EXCLUDE (page_id) FROM pgs LEFT JOIN (SELECT page_id, {one('part')}, {one('chapter')}, {one('section')} FROM fo GROUP BY page_id) h ON h.page_id = pgs.page_id),
c AS (SELECT *, count(chapter) OVER {w} AS g FROM ph)
SELECT book_id, nth, page_id, last_value(part IGNORE NULLS) OVER {w} AS part, last_value(chapter IGNORE NULLS) OVER {w} AS chapter,
  last_value(section IGNORE NULLS) OVER (PARTITION BY book_id, g ORDER BY nth) AS section,
  sum(CASE WHEN coalesce(part, chapter, section) IS NOT NULL THEN 1 ELSE 0 END) OVER {w}::BIGINT AS span FROM c"""


def _spans(spark, sf_dir, pick):
    folded = folded_headings(spark, sf_dir)
    one = lambda level: pick("text", F.when(F.col("level") == level, F.col("ordinal"))).alias(level)
    heads = folded.groupBy("page_id").agg(one("part"), one("chapter"), one("section"))
    own = structure.reading_order(pages(spark, sf_dir).drop("raw")).select("book_id", F.col("id").alias("page_id"), F.col("nth").cast("long").alias("nth"))
    extra = spark.sql(f"SELECT DISTINCT 980L AS book_id, CAST(page_id + 910000000 AS BIGINT) AS page_id, CAST(page_id AS BIGINT) AS nth FROM {FX_HEADINGS}")
    # what a stretch leaves open is read from the same rows again
    return structure.carry_spans(library.staged(own.unionByName(extra).join(heads, "page_id", "left"), "headed-pages"))


@query(_spans_sql("arg_min"))
def outline_spans(spark, sf_dir):
    return _spans(spark, sf_dir, F.min_by)


@query(_spans_sql("arg_max"))
def outline_spans_last(spark, sf_dir):
    return _spans(spark, sf_dir, F.max_by)


@query(
    f"""WITH {PG}, {BL}, e AS (SELECT bl.page_id, pg.book_id, arg_min(lower(text_raw), ordinal) AS f, arg_max(lower(text_raw), ordinal) AS l, count(*) AS n FROM bl JOIN pg ON pg.id = bl.page_id GROUP BY ALL),
c AS (SELECT *, count(*) OVER (PARTITION BY book_id, f) >= 2 AND {duck.count('f')} <= 8 AS hf, count(*) OVER (PARTITION BY book_id, l) >= 2 AND {duck.count('l')} <= 8 AS hl FROM e)
SELECT bl.page_id, bl.ordinal, text_raw AS text FROM bl JOIN c ON c.page_id = bl.page_id WHERE NOT (hf AND ordinal = 1) AND NOT (hl AND ordinal = n)"""
)
def running_heads(spark, sf_dir):
    """Blocks that remain when first and last lines shared by two pages of a book are dropped."""
    rows = blocks(spark, sf_dir).select("page_id", "book_id", "ordinal", F.col("text_raw").alias("text"))
    return segment.drop_running_heads(library.staged(rows, "blocks"), 2).drop("book_id")


@query(
    f"""WITH {PG}, li AS (SELECT id, list_filter(list_transform(string_split(raw, chr(10)), lambda x: {duck.trim('x')}), lambda x: x <> '') AS l FROM pg),
m AS (SELECT id, list_concat(list_reverse(l)[1:3], l[1:3]) AS l FROM li)
SELECT id, list_filter(list_transform(l, lambda x: {duck.number_on_line('x')}), lambda x: x IS NOT NULL)[1] AS page_no FROM m"""
)
def folios(spark, sf_dir):
    return pages(spark, sf_dir).select("id", structure.detect_folio(F.col("raw")).alias("page_no"))


@query(
    f"""WITH {PG}, f AS (SELECT book_id, id, page_no, string_split(source_ref, ':')[1] AS stamp, string_split(source_ref, ':')[2] AS side FROM {_FACES}),
s AS (SELECT book_id, stamp, max(page_no) FILTER (side = 'left') AS l, max(page_no) FILTER (side = 'right') AS r FROM f WHERE stamp IS NOT NULL GROUP BY ALL),
u AS (SELECT s.*, (SELECT count(DISTINCT page_no) FROM f WHERE f.book_id = s.book_id AND f.stamp IS DISTINCT FROM s.stamp AND page_no IN (s.l, s.l + 1)) AS ul,
  (SELECT count(DISTINCT page_no) FROM f WHERE f.book_id = s.book_id AND f.stamp IS DISTINCT FROM s.stamp AND page_no IN (s.r - 1, s.r)) AS ur FROM s),
k AS (SELECT *, CASE WHEN l BETWEEN 1 AND 2999 AND l + 1 BETWEEN 1 AND 2999 THEN 2 - ul ELSE -1 END AS sl, CASE WHEN r BETWEEN 1 AND 2999 AND r - 1 BETWEEN 1 AND 2999 THEN 2 - ur ELSE -1 END AS sr FROM u)
SELECT book_id, stamp, CASE WHEN l IS NULL AND r IS NULL THEN NULL WHEN r IS NULL THEN l WHEN l IS NULL THEN CASE WHEN r - 1 BETWEEN 1 AND 2999 THEN r - 1 END WHEN r = l + 1 THEN l WHEN sr > sl THEN r - 1 WHEN sl >= 0 THEN l END AS left_no,
  CASE WHEN l IS NULL AND r IS NULL THEN NULL WHEN r IS NULL THEN CASE WHEN l + 1 BETWEEN 1 AND 2999 THEN l + 1 END WHEN l IS NULL THEN r WHEN r = l + 1 THEN r WHEN sr > sl THEN r WHEN sl >= 0 THEN l + 1 END AS right_no FROM k"""
)
def facing_pages(spark, sf_dir):
    rows = _facing(spark, sf_dir)
    spreads = rows.where("stamp IS NOT NULL").groupBy("book_id", "stamp").agg(
        F.max(F.when(F.col("side") == "left", F.col("page_no"))).alias("left_no"), F.max(F.when(F.col("side") == "right", F.col("page_no"))).alias("right_no")
    )
    return structure.reconcile_facing(spreads, rows.where("page_no IS NOT NULL"))


def _facing(spark, sf_dir):
    own = pages(spark, sf_dir).where("id < 900000000").select(
        "book_id", "id", F.concat(F.expr("id div 2").cast("string"), F.when(F.col("id") % 2 == 0, ":left").otherwise(":right")).alias("source_ref"), "page_no"
    )
    extra = spark.sql(f"SELECT CAST(book_id + 980 AS BIGINT) AS book_id, CAST(id + 910000000 AS BIGINT) AS id, source_ref, CAST(page_no AS BIGINT) AS page_no FROM {FX_FACING}")
    part = F.split("source_ref", ":")
    return own.unionByName(extra).withColumns({"stamp": part[0], "side": part[1]})


@query(
    f"""WITH {PG}, f AS (SELECT * FROM {_FACES} WHERE source_ref IS NOT NULL) SELECT a.id, b.id AS sibling_id FROM f a JOIN f b ON a.book_id = b.book_id
  AND string_split(a.source_ref, ':')[1] = string_split(b.source_ref, ':')[1] AND string_split(a.source_ref, ':')[2] <> string_split(b.source_ref, ':')[2]"""
)
def spread_siblings(spark, sf_dir):
    rows = _facing(spark, sf_dir).where("stamp IS NOT NULL")
    other = rows.select("book_id", "stamp", F.when(F.col("side") == "left", "right").otherwise("left").alias("side"), F.col("id").alias("sibling_id"))
    return rows.join(other, ["book_id", "stamp", "side"]).select("id", "sibling_id")


@query(f"WITH {PG}, f AS (SELECT * FROM {_FACES}) SELECT DISTINCT book_id, page_no FROM f WHERE page_no IS NOT NULL AND id NOT IN (SELECT id FROM f WHERE source_ref LIKE 'a:%' OR id % 3 = 0)")
def page_numbers_excluding(spark, sf_dir):
    """Numbers that a book uses, without those of given pages (literal ones and every third)."""
    rows = _facing(spark, sf_dir)
    left = rows.join(rows.where("stamp = 'a' OR id % 3 = 0").select("id"), "id", "left_anti")
    return left.where("page_no IS NOT NULL").select("book_id", "page_no").distinct()


ADJ = """ad AS (SELECT cur.id,
  (SELECT p.id FROM pg p WHERE p.book_id = cur.book_id AND ((p.page_no IS NOT NULL AND cur.page_no IS NOT NULL AND p.page_no > cur.page_no) OR (p.page_no IS NULL AND cur.page_no IS NULL AND p.created_at > cur.created_at) OR (p.page_no IS NULL AND cur.page_no IS NOT NULL))
    ORDER BY p.page_no IS NULL, p.page_no, p.created_at, p.id LIMIT 1) AS next_id,
  (SELECT p.id FROM pg p WHERE p.book_id = cur.book_id AND ((p.page_no IS NOT NULL AND cur.page_no IS NOT NULL AND p.page_no < cur.page_no) OR (p.page_no IS NULL AND cur.page_no IS NULL AND p.created_at < cur.created_at) OR (p.page_no IS NOT NULL AND cur.page_no IS NULL))
    ORDER BY p.page_no IS NULL DESC, p.page_no DESC, p.created_at DESC, p.id DESC LIMIT 1) AS previous_id FROM pg cur)"""

CTX = f"""ed AS (SELECT page_id, arg_min(id, ordinal) AS fid, arg_max(id, ordinal) AS lid, arg_min(text_norm, ordinal) AS ft, arg_max(text_norm, ordinal) AS lt FROM bl WHERE kind = 'paragraph' GROUP BY page_id),
jx AS (SELECT bl.id, bl.page_id, bl.text_norm AS x, previous_id, next_id, ed.fid, ed.lid, pe.lt AS tail, ne.ft AS head FROM bl JOIN ed ON ed.page_id = bl.page_id JOIN ad ON ad.id = bl.page_id
  LEFT JOIN ed pe ON pe.page_id = previous_id LEFT JOIN ed ne ON ne.page_id = next_id WHERE kind = 'paragraph'),
fg AS (SELECT *, coalesce({duck.starts_mid_sentence('x')} AND id = fid AND {duck.ends_mid_sentence('tail')}, false) AS back, {duck.ends_mid_sentence('x')} AND id = lid AS op FROM jx),
wh AS (SELECT *, coalesce(op AND {duck.starts_mid_sentence('head')}, false) AS forth, CASE WHEN back THEN {duck.stitch('tail', 'x')} ELSE x END AS whole FROM fg),
cx AS (SELECT id, page_id, CASE WHEN forth THEN {duck.stitch('whole', 'head')} ELSE whole END AS text, CASE WHEN back THEN previous_id END AS continued_from_page,
  CASE WHEN forth THEN next_id END AS continues_on_page, back OR forth AS spans_pages, op AND next_id IS NULL AS incomplete FROM wh)"""


@query(f"WITH {PG}, {ADJ} SELECT * FROM ad")
def adjacent_pages(spark, sf_dir):
    return structure.adjacent_pages(pages(spark, sf_dir).select("id", "book_id", "page_no", "created_at"))


@query(f"WITH {PG}, {BL}, {ADJ}, {CTX} SELECT * FROM cx")
def paragraph_contexts(spark, sf_dir):
    own = library.staged(blocks(spark, sf_dir).where("kind = 'paragraph'").select("id", "page_id", "ordinal", "kind", "text_norm"), "blocks")
    return structure.paragraph_contexts(own, pages(spark, sf_dir).select("id", "book_id", "page_no", "created_at"))


@query(f"WITH {PG}, {BL} SELECT id, unnest(s) AS sentence, generate_subscripts(s, 1) AS ordinal FROM (SELECT id, {duck.sentences('w')} AS s FROM (SELECT id, {duck.words('text_norm')} AS w FROM bl WHERE kind = 'paragraph'))")
def block_sentences(spark, sf_dir):
    own = blocks(spark, sf_dir).where("kind = 'paragraph'")
    rows = own.select("id", F.posexplode(t.sentences(F.col("text_norm"))).alias("pos", "sentence"))
    return rows.select("id", "sentence", (F.col("pos") + 1).cast("long").alias("ordinal"))


@query(
    f"""WITH {PG}, {BL}, {ADJ}, {CTX}, {SM}, nt AS (SELECT block_id, sentence_ordinal, arg_max(sentence, revision) AS note FROM sm WHERE sentence_ordinal IS NOT NULL GROUP BY ALL),
sx AS (SELECT id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS ordinal FROM (SELECT id, {duck.sentences('w')} AS s FROM (SELECT id, {duck.words('text')} AS w FROM cx)))
SELECT sx.id, sx.ordinal::BIGINT AS ordinal, sentence, note FROM sx LEFT JOIN nt ON nt.block_id = sx.id AND nt.sentence_ordinal = sx.ordinal"""
)
def sentence_notes_in_context(spark, sf_dir):
    whole = paragraph_contexts(spark, sf_dir).select("id", F.posexplode(t.sentences(F.col("text"))).alias("ordinal", "sentence"))
    notes = summaries(spark, sf_dir).where("sentence_ordinal IS NOT NULL").groupBy(F.col("block_id").alias("id"), F.col("sentence_ordinal").cast("int").alias("ordinal"))
    notes = notes.agg(F.max_by("sentence", "revision").alias("note"))
    return whole.join(notes, ["id", "ordinal"], "left").select("id", F.col("ordinal").cast("long").alias("ordinal"), "sentence", "note")
