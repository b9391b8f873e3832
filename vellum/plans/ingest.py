"""Queries over sources: web pages, paragraph runs, captured streams, sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import ingest, structure
from ..sources import epub, html, images, library
from ..streaming import chunks
from . import drawn, duck, fixtures
from .relations import ERAS, PG, lexicon, pages, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_FX_SOURCES = fixtures.values([(x,) for x in fixtures.SOURCES], "v", "place")
FX_SOURCES = f"(SELECT place FROM {_FX_SOURCES} UNION ALL SELECT url FROM pages UNION ALL SELECT source || ['.pdf', '.EPUB', '.jpg'][1 + doc_id % 3] FROM documents)"


@query(f"SELECT place, CASE WHEN regexp_matches(lower(place), '^https?://') THEN 'web' WHEN ends_with(lower(place), '.epub') THEN 'epub' WHEN ends_with(lower(place), '.pdf') THEN 'pdf' ELSE 'photo' END AS kind FROM {FX_SOURCES}")
def source_kinds(spark, sf_dir):
    ending = F.element_at(F.array(F.lit(".pdf"), F.lit(".EPUB"), F.lit(".jpg")), (F.col("doc_id") % 3 + 1).cast("int"))
    own = table(spark, sf_dir, "pages").select(F.col("url").alias("place")).unionAll(table(spark, sf_dir, "documents").select(F.concat("source", ending).alias("place")))
    return own.unionAll(spark.sql(f"SELECT * FROM {_FX_SOURCES}")).select("place", ingest.source_kind(F.col("place")).alias("kind"))


@query()
def web_paragraphs(spark, sf_dir):
    """Reading text of the web pages; tests hold it against literal pages."""
    return html.web_paragraphs(table(spark, sf_dir, "pages"))


def _web_runs(pages):
    """The pages' paragraphs as runs; they are parsed once and written, since runs are read twice."""
    rows = html.web_paragraphs(pages).select(F.col("page_id").alias("run_id"), F.col("title").alias("label"), "ordinal", F.col("text").alias("paragraph"))
    return library.staged(rows, "paragraphs")


@query()
def web_pages_paginated(spark, sf_dir):
    """Web pages as pages of eight paragraphs."""
    return ingest.paginate(_web_runs(table(spark, sf_dir, "pages")))


@query(rf"SELECT page_id, length(html) AS size, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs, coalesce(list_max(list_transform(regexp_extract_all(html, '<p>([^<]*)', 1), lambda x: length(x))), 0) AS longest, len(regexp_extract_all(html, '<a ')) > 20 AND len(regexp_extract_all(html, '<a ')) > 0.5 * len(regexp_extract_all(html, '<p>')) AS navigation FROM pages")
def page_shape(spark, sf_dir):
    """Links and paragraphs of a page, its longest plain paragraph, and whether it looks like navigation."""
    longest = F.array_max(F.transform(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1)), F.length))
    links, paras = F.regexp_count("html", F.lit("<a ")), F.regexp_count("html", F.lit("<p>"))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.length("html").alias("size"), links.alias("links"), paras.alias("paragraphs"), F.coalesce(longest, F.lit(0)).cast("long").alias("longest"), ((links > 20) & (links > 0.5 * paras)).alias("navigation")
    )


@query(rf"SELECT line, CASE WHEN len(regexp_extract_all({duck.squeeze('line')}, '\p{{L}}')) >= 3 THEN {duck.squeeze('line')} END AS cleaned FROM (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents)")
def cleaned_paragraphs(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    one = t.squeeze(F.col("line"))
    return own.select("line", F.when(F.regexp_count(one, F.lit(r"\p{IsAlphabetic}")) >= 3, one).alias("cleaned"))


#: paragraph runs: conversations, some of whose turns open with a reference, and literal ones
_FX_RUNS = fixtures.values(fixtures.RUNS, "v", "run_id, label, ordinal, paragraph")
FX_RUNS = f"""(SELECT run_id, label, ordinal, paragraph FROM {_FX_RUNS} UNION ALL
  SELECT 1000000 + conv_id, CASE WHEN conv_id % 2 = 0 THEN role END, turn, CASE WHEN conv_id % 3 = 0 THEN (turn // 3 + 1) || ':' || (turn + 1) || ' ' || text ELSE text END FROM conversations)"""
_CH = r"try_cast(nullif(regexp_extract({x}, '^\+?([0-9]+):[0-9]+([\s\p{{Z}}]|$)', 1), '') AS BIGINT)"


@query(
    rf"""WITH r AS (SELECT run_id, label, ordinal::BIGINT AS ordinal, paragraph FROM {FX_RUNS}),
s AS (SELECT run_id, count({_CH.format(x=duck.trim('paragraph'))})::FLOAT >= count(*)::FLOAT * 0.6::FLOAT AS ref FROM r GROUP BY run_id),
p AS (SELECT run_id, label, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) - 1 AS k, paragraph AS text FROM r JOIN s USING (run_id) WHERE NOT ref),
u AS (SELECT run_id, label, ordinal, unnest(string_split(m, chr(1))) AS x, generate_subscripts(string_split(m, chr(1)), 1) AS i FROM (
  SELECT *, array_to_string(list_transform({duck.words('paragraph')}, lambda w, i: CASE WHEN i > 1 AND regexp_matches(w, '^[0-9]+:[0-9]+$') THEN chr(1) || w ELSE w END), ' ') AS m FROM r JOIN s USING (run_id) WHERE ref)),
c AS (SELECT run_id, label, {duck.trim('x')} AS text, row_number() OVER w - 1 AS k, {_CH.format(x=duck.trim('x'))} AS chapter, last_value({_CH.format(x=duck.trim('x'))} IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ordinal, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM u WINDOW w AS (PARTITION BY run_id ORDER BY ordinal, i)),
b AS (SELECT run_id, label, k // 8 + 1 AS page, k, text FROM p UNION ALL SELECT run_id, label, sum(CASE WHEN chapter <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY k)::BIGINT + 1, k, text FROM c)
SELECT run_id, page, CASE WHEN page = 1 THEN label END AS label, k, text FROM b"""
)
def paginated_runs(spark, sf_dir):
    mark = F.concat((F.expr("turn div 3") + 1).cast("string"), F.lit(":"), (F.col("turn") + 1).cast("string"), F.lit(" "), F.col("text"))
    own = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") + 1_000_000).cast("long").alias("run_id"), F.when(F.col("conv_id") % 2 == 0, F.col("role")).alias("label"),
        F.col("turn").cast("long").alias("ordinal"), F.when(F.col("conv_id") % 3 == 0, mark).otherwise(F.col("text")).alias("paragraph"),
    )
    extra = spark.sql(f"SELECT CAST(run_id AS BIGINT) AS run_id, label, CAST(ordinal AS BIGINT) AS ordinal, paragraph FROM {_FX_RUNS}")
    return ingest.paginate(own.unionByName(extra))


@query(
    rf"""WITH p AS (SELECT conv_id AS doc_id, turn AS page_index, text FROM conversations), r AS (SELECT doc_id FROM p GROUP BY doc_id HAVING avg(CASE WHEN len(regexp_extract_all(text, '\p{{L}}')) >= 40 THEN 1 ELSE 0 END) >= 0.5),
l AS (SELECT doc_id, page_index + 1 AS page_no, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: {duck.squeeze('x')}), lambda x: len(regexp_extract_all(x, '\p{{L}}')) >= 3) AS l FROM p WHERE doc_id IN (SELECT doc_id FROM r))
SELECT doc_id, page_no, unnest(l) AS text, (generate_subscripts(l, 1) - 1)::INT AS ordinal FROM l"""
)
def pdf_pages(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"), "text")
    return ingest.pdf_pages(own)


FX_STREAMS = fixtures.values([(1, '{"response": "He", "done": false}\nnot json\n{"response": "llo", "done": true}\n{"response": " lost", "done": false}'), (2, '{"response": "a"}\n\n{"response": "b"}'), (3, "broken")], "v", "id, body")


_STREAMS = "SELECT * FROM (VALUES (1, 'Hello'), (2, 'a'), (3, '')) AS v(id, text) UNION ALL SELECT 1000 + conv_id * 100 + turn, text || ' end' FROM conversations"


def _streams(spark, sf_dir):
    line = lambda text, done: F.to_json(F.struct(text.alias("response"), F.lit(done).alias("done")))
    body = F.concat_ws("\n", line(F.col("text"), False), F.lit("{broken"), line(F.lit(" end"), True), line(F.lit(" lost"), False))
    own = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn") + 1000).cast("int").alias("id"), body.alias("body"))
    return own.unionByName(spark.sql(f"SELECT * FROM {FX_STREAMS}"))


@query(_STREAMS)
def stream_texts(spark, sf_dir):
    """Texts of captured streams: literal ones, and every turn as a stream of three answers of which the last is lost."""
    return ingest.stream_text(_streams(spark, sf_dir))


@query(_STREAMS)
def chunked_streams(spark, sf_dir):
    """The same from bodies that come in chunks of 61 bytes over three micro-batches, later chunks first."""
    bodies, folder = _streams(spark, sf_dir), library.shared_folder(spark, "chunks")
    cut = chunks.cut_bodies(bodies, 61)
    for k in (2, 0, 1):
        cut.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    chunks.follow(chunks.read_chunks(spark, f"{folder}/in"), folder)
    texts = chunks.text_of_lines(spark.read.schema(chunks.LINES).parquet(f"{folder}/lines"))
    return bodies.select("id").join(texts, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))


_FX_SIZES = fixtures.values(fixtures.SIZES, "v", "w, h")
FX_SIZES = f"(SELECT w::BIGINT AS w, h::BIGINT AS h FROM {_FX_SIZES} UNION ALL SELECT event_id % 5003, event_id * 7 % 3001 + 1 FROM events)"


@query(f"SELECT w, h, CASE WHEN greatest(w, h) <= 1600 THEN w ELSE greatest(round(w::DOUBLE * 1600 / greatest(w, h))::BIGINT, 1) END::BIGINT AS new_w, CASE WHEN greatest(w, h) <= 1600 THEN h ELSE greatest(round(h::DOUBLE * 1600 / greatest(w, h))::BIGINT, 1) END::BIGINT AS new_h FROM {FX_SIZES}")
def fitted_sizes(spark, sf_dir):
    size = ingest.fit_within(F.col("w"), F.col("h"))
    own = table(spark, sf_dir, "events").select((F.col("event_id") % 5003).alias("w"), (F.col("event_id") * 7 % 3001 + 1).alias("h"))
    return own.unionAll(spark.sql(f"SELECT CAST(w AS BIGINT), CAST(h AS BIGINT) FROM {_FX_SIZES}")).select("w", "h", size["w"].alias("new_w"), size["h"].alias("new_h"))


@query(
    f"""WITH {PG}, l AS (SELECT id, list_transform(string_split(raw, chr(10)), lambda x: {duck.without_structural_numerals('x')}) AS l FROM pg)
SELECT id, CASE WHEN len(l) <= 12 THEN array_to_string(l, chr(10)) ELSE array_to_string(l[1:6], chr(10)) || chr(10) || '…' || chr(10) || array_to_string(l[len(l) - 5:], chr(10)) END AS excerpt FROM l"""
)
def margin_excerpts(spark, sf_dir):
    """What a number reader gets to see of a page: its first and last six lines."""
    return pages(spark, sf_dir).select("id", structure.margin_excerpt(F.col("raw")).alias("excerpt"))


_TOLD = "CASE WHEN id % 2 = 0 THEN coalesce(page_no::VARCHAR, 'none') ELSE 'page two of it' END"
_SEEN = "CASE WHEN id % 4 = 1 THEN '- ' || (id % 90 + 1) || ' -' WHEN id % 4 = 3 THEN 'NONE' END"


@query(
    f"""WITH {PG}, li AS (SELECT id, {_TOLD} AS told, {_SEEN} AS seen, list_filter(list_transform(string_split(raw, chr(10)), lambda x: {duck.trim('x')}), lambda x: x <> '') AS l FROM pg),
m AS (SELECT id, told, seen, list_filter(list_transform(list_concat(list_reverse(l)[1:3], l[1:3]), lambda x: {duck.number_on_line('x')}), lambda x: x IS NOT NULL)[1] AS n FROM li),
f AS (SELECT id, n, {duck.folio_reply('told')} AS told, {duck.folio_reply('seen')} AS seen FROM m)
SELECT id, coalesce(n, told, seen) AS page_no, CASE WHEN coalesce(n, told, seen) IS NULL THEN 'unknown' ELSE 'detected' END AS source, CASE WHEN n IS NOT NULL THEN 1 WHEN told IS NOT NULL THEN 2 WHEN seen IS NOT NULL THEN 3 END AS pass FROM f"""
)
def folio_cascade(spark, sf_dir):
    """A page's number by the margins, else by the text model's reply, else by the image model's."""
    told = F.when(F.col("id") % 2 == 0, F.coalesce(F.col("page_no").cast("string"), F.lit("none"))).otherwise("page two of it")
    seen = F.when(F.col("id") % 4 == 1, F.concat(F.lit("- "), (F.col("id") % 90 + 1).cast("string"), F.lit(" -"))).when(F.col("id") % 4 == 3, "NONE")
    return structure.folio_cascade(pages(spark, sf_dir).select("id", "raw", told.alias("told"), seen.alias("seen")))


@query()
def imported_blocks(spark, sf_dir):
    """Web pages as imported documents: first of each address, cut into pages, read with the lexicon, labelled.

    Every page is a book whose era its number gives.
    """
    fresh = ingest.first_of_source(table(spark, sf_dir, "pages"), "url", "page_id")
    runs = _web_runs(fresh)
    titles = runs.groupBy("run_id").agg(F.max("label").alias("title"))
    paged = ingest.paginate(runs).join(titles, "run_id")
    era = F.element_at(F.array(*map(F.lit, ERAS)), (F.col("run_id") % 4 + 1).cast("int"))
    page = F.concat(F.col("run_id").cast("string"), F.lit("/"), F.col("page").cast("string"))
    own = paged.select(page.alias("id"), F.col("run_id").alias("book_id"), "title", era.alias("era"), "label", "k", "text")
    return ingest.import_pages(own, lexicon(spark, sf_dir))


@query()
def epub_pages(spark, sf_dir):
    """Pages of books: every web page bound as a book with contents, and an item that is missing."""
    return epub.book_pages(drawn.bind(table(spark, sf_dir, "pages")))


@query()
def page_images(spark, sf_dir):
    """Pictures of whole texts, stored by all orientation tags, some taken sideways or as a spread: turned upright, split, fitted."""
    return images.upright_drawn(table(spark, sf_dir, "documents").select("doc_id", "text"), drawn.pictures, edge=800)


#: first bytes that are put before the texts
HEADS = [
    "", "FFD8FFE0", "89504E470D0A1A0A", "474946383961", "474946383861", "5249464600000000574542", "524946460000000057454250", "4D4D002A", "49492A00", "424D", "5030", "5031",
    "00000018667479706865696D", "000000186674797068657673", "000000186674797069736F6D", "000000186674797061766966", "00000018667479706D696631", "66747970",
]


@query(
    f"""WITH h AS (SELECT doc_id, left([{', '.join(f"'{h}'" for h in HEADS)}][1 + doc_id % {len(HEADS)}] || hex(encode(left(coalesce(text, ''), 12))), 24) AS x FROM documents)
SELECT doc_id, CASE WHEN x[9:16] = '66747970' AND x[17:24] IN ('68656963', '68656978', '6865696D', '68656973', '68657663', '68657678', '6865766D', '68657673', '6D696631', '6D736631') THEN 'heic'
  WHEN starts_with(x, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(x, 'FFD8FF') THEN 'jpeg' WHEN x[1:12] IN ('474946383961', '474946383761') THEN 'gif'
  WHEN x[1:8] = '52494646' AND x[17:24] = '57454250' THEN 'webp' WHEN x[1:8] IN ('4D4D002A', '49492A00') THEN 'tiff' WHEN starts_with(x, '44445320') THEN 'dds'
  WHEN starts_with(x, '424D') THEN 'bmp' WHEN starts_with(x, '00000100') THEN 'ico' WHEN starts_with(x, '233F52414449414E4345') THEN 'hdr'
  WHEN x[1:4] = '0000' AND x[9:24] = '6674797061766966' THEN 'avif' WHEN starts_with(x, '762F3101') THEN 'exr' WHEN starts_with(x, '716F6966') THEN 'qoi'
  WHEN starts_with(x, '6661726266656C64') THEN 'farbfeld' WHEN x[1:3] = '503' AND x[4] BETWEEN '1' AND '7' THEN 'pnm' ELSE 'unknown' END AS kind FROM h"""
)
def image_kinds(spark, sf_dir):
    """Kinds of files by their first bytes: the texts behind the heads of pictures and of what only looks like one."""
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("doc_id") % len(HEADS) + 1).cast("int"))
    content = F.unhex(F.concat(head, F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))))
    return table(spark, sf_dir, "documents").select("doc_id", images.sniff(content).alias("kind"))


@query()
def web_page_shapes(spark, sf_dir):
    """Reading paragraphs of every web page, their size, the longest and the first, and whether it looks like navigation."""
    return html.page_shapes(table(spark, sf_dir, "pages"))
