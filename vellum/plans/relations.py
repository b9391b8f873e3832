"""The library's relations over the given tables, for Spark and as SQL with the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import segment
from . import duck, fixtures

FX_PAGES = fixtures.values(fixtures.PAGES, "v", "id, title, raw")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, book_id, title, page_no, created_at, raw, source_ref`` of documents and the literal pages.

    Some pages have their first line as the heading that their source declares.
    """
    docs = table(spark, sf_dir, "documents")
    own = docs.select(
        F.col("doc_id").alias("id"),
        F.regexp_extract("source", "([0-9]+)$", 1).cast("long").alias("book_id"),
        F.col("source").alias("title"),
        F.when(F.col("doc_id") % 7 != 0, F.expr("(doc_id div 20) % 40 + 1")).alias("page_no"),
        F.expr("doc_id div 3").alias("created_at"),
        F.col("text").alias("raw"),
    )
    extra = spark.sql(
        f"SELECT CAST(id AS BIGINT) AS id, 99L AS book_id, title, CAST(NULL AS BIGINT) AS page_no, CAST(id AS BIGINT) AS created_at, raw FROM {FX_PAGES}"
    )
    first = F.regexp_replace(F.split("raw", "\n")[0], "^# ", "")
    return own.unionByName(extra).withColumn("source_ref", F.when(F.col("id") % 5 != 1, first))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.block_rows(segment.page_blocks(pages(spark, sf_dir)))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns are summaries of a block, user turns notes on one of its sentences."""
    turns = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return turns.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        segment.block_id(F.col("conv_id"), F.col("conv_id") % 3 + 1).alias("block_id"),
        F.when(F.col("role") == "user", F.col("turn") % 3).alias("sentence_ordinal"),
        F.col("text").alias("sentence"),
        F.col("turn").alias("revision"),
    )


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("book_id"), F.initcap("event_type").alias("word"),
        F.concat(F.lit("lemma-"), F.col("event_id") % 5).alias("lemma"), F.col("props").alias("sentence"),
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct alphabetic words of the benchmark texts and the dictionary's headwords."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(t.plain_words(F.col("text"))).alias("headword"))
    words = words.where(F.col("headword").rlike(r"^\p{IsAlphabetic}{2,}$"))
    extra = spark.sql(f"SELECT lower(word) AS headword FROM {fixtures.values(fixtures.DICT, 'v', 'word, pos, n, gloss')}")
    return words.unionAll(extra).distinct()


#: The same relations as common table expressions.
PG = f"""pg AS (SELECT *, CASE WHEN id % 5 <> 1 THEN regexp_replace(string_split(raw, chr(10))[1], '^# ', '') END AS source_ref FROM (
  SELECT doc_id AS id, regexp_extract(source, '([0-9]+)$', 1)::BIGINT AS book_id, source AS title,
    CASE WHEN doc_id % 7 <> 0 THEN (doc_id // 20) % 40 + 1 END AS page_no, doc_id // 3 AS created_at, text AS raw FROM documents
  UNION ALL SELECT id::BIGINT, 99, title, NULL, id::BIGINT, raw FROM {FX_PAGES}))"""

_LINE = f"""ln AS (
  SELECT id, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS n FROM pg),
tl AS (SELECT id, n, {duck.trim('line')} AS x FROM ln),
ty AS (SELECT id, n, x, CASE WHEN x = '' OR {duck.is_furniture('x')} THEN 'break' WHEN {duck.line_content('x')} = '' THEN 'skip' ELSE {duck.line_kind('x')} END AS kind,
    {duck.line_content('x')} AS content FROM tl),
md AS (SELECT id, max(length(x)) > 120 OR (count(*) >= 3 AND count(*) FILTER (regexp_matches(x, '[.!?"”’]$')) * 100 >= count(*) * 80) AS wrapped
  FROM tl WHERE x <> '' AND NOT {duck.is_furniture('x')} GROUP BY id)"""

_CUT = """fl AS (SELECT ty.*, coalesce(wrapped, false) AS wrapped, lag(kind) OVER (PARTITION BY ty.id ORDER BY n) AS prev FROM ty LEFT JOIN md ON md.id = ty.id WHERE kind <> 'skip'),
nu AS (SELECT *, sum(CASE WHEN kind = 'break' THEN 0 WHEN kind = 'heading' OR wrapped OR prev IS NULL OR prev <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS b FROM fl)"""

_JOINED = f"""jo AS (SELECT id, b, any_value(kind) AS kind, {duck.squeeze(f"list_reduce(list(content ORDER BY n), lambda l, r: CASE WHEN regexp_matches(l, '[-‐­‑]$') THEN {duck.join_hyphenated('l', 'r')} ELSE l || ' ' || r END)")} AS text
  FROM nu WHERE kind <> 'break' GROUP BY id, b)"""

_TIDIED = f"""sg AS (SELECT id, b, CASE WHEN kind = 'paragraph' AND {duck.looks_like_heading('text')} THEN 'heading' ELSE kind END AS kind, text FROM jo WHERE text <> ''),
dd AS (SELECT * FROM sg QUALIFY length(text) < 40 OR row_number() OVER (PARTITION BY id, lower(text) ORDER BY b) = 1),
cm AS (SELECT * FROM (SELECT * FROM dd WHERE NOT {duck.is_commentary('text')})
  QUALIFY max(CASE WHEN {duck.is_trailing_meta('text')} THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) = 1),
ky AS (SELECT cm.*, {duck.furniture_key('text')} AS key, {duck.furniture_key('title')} AS tkey, row_number() OVER (PARTITION BY cm.id ORDER BY b) AS r FROM cm JOIN pg ON pg.id = cm.id),
f1 AS (SELECT * FROM ky WHERE NOT (r = 1 AND tkey <> '' AND key = tkey)),
f2 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY b DESC) AS back, count(*) OVER (PARTITION BY id) AS many,
    count(*) OVER (PARTITION BY id, key) AS same FROM f1),
pb AS (SELECT * FROM f2 WHERE NOT (back = 1 AND many >= 2 AND length(text) <= 60 AND key <> '' AND same > 1)),
bl AS (SELECT id || ':' || row_number() OVER (PARTITION BY id ORDER BY b) AS id, id AS page_id, row_number() OVER (PARTITION BY id ORDER BY b) AS ordinal, kind,
    text AS text_raw, {duck.normalise('text')} AS text_norm FROM pb)"""

BL = f"{_LINE}, {_CUT}, {_JOINED}, {_TIDIED}"


#: Eras by book, for books whose pages are read with the lexicon.
ERAS = ["modern", "early_20c", "victorian", "early_modern"]
_MEASURE = "([^\n]{50}[^ \n]*) "
_LONG, _MIDDLE = "([a-zé]{3})([a-zé]{3})([a-zé]{3,})", "([a-zé]{4})([a-zé]{4})"


def old_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as an old print has them: with their book's ``era``, short lines, words broken at their ends, some twice.

    The oldest books have an f for every s.
    """
    own = pages(spark, sf_dir).withColumn("era", F.element_at(F.array(*map(F.lit, ERAS)), (F.col("book_id") % 4 + 1).cast("int")))
    broken = F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", _MEASURE, "$1\n"), _LONG, "$1-\n$2-\n$3"), _MIDDLE, "$1-\n$2")
    return own.withColumn("raw", F.when(F.col("era") == "early_modern", F.replace(broken, F.lit("s"), F.lit("f"))).otherwise(broken))


def _chain_sql() -> str:
    """Blocks whose broken words the lexicon decides, one break after the other."""
    hyphens, space = t.HYPHENS, duck.WS
    inside = "[^\\s\\p{Z}]"
    word = lambda x: f"CASE WHEN regexp_matches({x}, '\\p{{L}}$') THEN lower(regexp_extract({x}, '(\\p{{L}}.*)$', 1)) ELSE '' END"
    after = lambda x: f"lower(regexp_extract({x}, '^(\\p{{L}}(?:.*\\p{{L}})?)', 1))"
    kept = "c.a <> '' AND c.b <> '' AND m.headword IS NULL AND (h.headword IS NOT NULL OR (x.headword IS NOT NULL AND y.headword IS NOT NULL))"
    words = lambda c: f"LEFT JOIN lex m ON m.headword = {c}.a || {c}.b LEFT JOIN lex h ON h.headword = {c}.a || '-' || {c}.b LEFT JOIN lex x ON x.headword = {c}.a LEFT JOIN lex y ON y.headword = {c}.b"
    return f"""kl AS (SELECT *, row_number() OVER (PARTITION BY id, b ORDER BY n DESC) = 1 AS final FROM nu WHERE kind <> 'break'),
kp AS (SELECT id, b, kind, content, row_number() OVER (PARTITION BY id, b ORDER BY n) AS i FROM kl WHERE final OR NOT regexp_matches(content, '^[{hyphens}]+$')),
ju AS (SELECT *, lead(content) OVER w AS nxt, regexp_matches(content, '[{hyphens}]$') AND lead(content) OVER w IS NOT NULL AS broken FROM kp WINDOW w AS (PARTITION BY id, b ORDER BY i)),
jn AS (SELECT *, regexp_replace(content, '[{hyphens}]+$', '') AS body, broken AND coalesce(lag(broken) OVER w, false) AND NOT regexp_matches(content, '{space}') AS goes_on FROM ju WINDOW w AS (PARTITION BY id, b ORDER BY i)),
ch AS (SELECT id, b AS blk, i, lft, {word('lft')} AS a, {after('rgt')} AS b FROM (SELECT *, regexp_extract(body, '({inside}*)$', 1) AS lft, regexp_extract(nxt, '^({inside}*)', 1) AS rgt FROM jn WHERE broken AND NOT goes_on)
  UNION ALL SELECT id, blk, i, lft, {word('lft')}, {after('rgt')} FROM (
    SELECT j.id, c.blk, j.i, c.lft || CASE WHEN {kept} THEN '-' ELSE '' END || j.body AS lft, regexp_extract(j.nxt, '^({inside}*)', 1) AS rgt
    FROM ch c JOIN jn j ON j.id = c.id AND j.b = c.blk AND j.i = c.i + 1 AND j.goes_on {words('c')})),
dc AS (SELECT c.id, c.blk, c.i, {kept} AS keep FROM ch c {words('c')}),
jo AS (SELECT j.id, j.b, any_value(kind) AS kind, {duck.squeeze("string_agg(CASE WHEN nxt IS NULL THEN content WHEN broken THEN body || CASE WHEN keep THEN '-' ELSE '' END ELSE content || ' ' END, '' ORDER BY j.i)")} AS text
  FROM jn j LEFT JOIN dc ON dc.id = j.id AND dc.blk = j.b AND dc.i = j.i GROUP BY j.id, j.b)"""


SM = f"""sm AS (SELECT conv_id * 100 + turn AS id, conv_id || ':' || (1 + conv_id % 3) AS block_id, CASE WHEN role = 'user' THEN turn % 3 END AS sentence_ordinal,
  text AS sentence, turn AS revision FROM conversations WHERE role <> 'system')"""

LK = """lk AS (SELECT event_id AS id, user_id AS book_id, upper(event_type[1]) || event_type[2:] AS word, 'lemma-' || (event_id % 5) AS lemma, props AS sentence FROM events)"""

LEX = rf"""lex AS (SELECT DISTINCT w AS headword FROM (SELECT unnest({duck.plain_words('text')}) AS w FROM benchmark) WHERE regexp_matches(w, '^\p{{L}}{{2,}}$')
  UNION SELECT lower(word) FROM {fixtures.values(fixtures.DICT, 'v', 'word, pos, n, gloss')})"""


_BROKEN = f"regexp_replace(regexp_replace(regexp_replace(raw, '{_MEASURE}', '\\1' || chr(10), 'g'), '{_LONG}', '\\1-' || chr(10) || '\\2-' || chr(10) || '\\3', 'g'), '{_MIDDLE}', '\\1-' || chr(10) || '\\2', 'g')"
#: Old pages, and their blocks by the lexicon.
OLD = f"""{PG.replace('pg AS (', 'p0 AS (', 1)},
p1 AS (SELECT *, [{str(ERAS)[1:-1]}][1 + book_id % 4] AS era FROM p0), pg AS (SELECT * REPLACE (CASE WHEN era = 'early_modern' THEN replace({_BROKEN}, 's', 'f') ELSE {_BROKEN} END AS raw) FROM p1)"""
BL_LEX = f"{_LINE}, {_CUT}, {_chain_sql()}, {_TIDIED}"
