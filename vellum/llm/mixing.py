"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key.  Within its source the documents are range-sorted by
that key: the key's leading digits name one of ``RANGES`` ranges, and a window sorts each
(source, range).  Token counts are summed per range, the ranges' sums are summed over the
few rows of the range table, and so each document knows how many words stand before it in
its source although no task ever holds a whole source.  A source is then taken as many whole
times as its budget holds, and the rest of the budget is cut exactly at that prefix sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import free_name, free_prefix, materialize, own_columns

#: Key ranges per source: three hexadecimal digits of the key.
RANGES = 16**3
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """Budgets per source from ``source, source_size``: adds ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all
    sizes; a target stops at ``most`` times its source's size and the excess is shared again
    by weight.  The fixed point is found in one sort: with sources by rising size for their
    weight, the first k stop at their cap, and k is the least number for which the level of
    the others (what is left over their weights) is under the next source's cap.  Sources
    without words get 0.  The table has one row per source, never one per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")))
    tight = Window.orderBy(F.col("source_size") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
    levelled = ranked.withColumn("_level", level.cast("double"))
    fits = F.col("_level") * F.col("_weight") <= most * F.col("source_size")
    first = F.min(F.when(fits, F.struct((F.col("source_size") / F.col("_weight")).alias("a"), F.col("_level").alias("l")))).over(everything)
    held = levelled.withColumn("_first", first)
    return held.select(
        "source",
        "source_size",
        F.least(
            F.col("_first.l") * F.col("_weight"), (most * F.col("source_size")).cast("double")
        ).alias("target"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, most: int = 3, seed: str = "mix") -> DataFrame:
    """How many words of each document the mix takes.

    Returns all columns of ``docs`` except ``text`` (a clash loses against the new column),
    and ``size, source_size, target, taken``: whole passes over the source times the size,
    and in the last pass the words before the exact budget (one document per source may be
    cut inside).  The key is a digest of doc_id, text and ``seed``: reruns agree.  Texts are
    read once; what follows works on a table without them.
    Defined cases: null text has size 0; null sources are one source; repeated rows share a
    key and stand side by side; rows of size 0 take 0; an empty table gives an empty result;
    very long texts are counted whole, and their words may be cut like any other's; other
    columns may have any names.
    """
    new = ("size", "source_size", "target", "taken")
    p = free_prefix(docs)
    key, source, size = f"{p}key", f"{p}source", f"{p}size"
    digest = F.md5(
        F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-"))).cast("binary")
    )
    rows = docs.select(
        *own_columns(docs, *new, "text", "source"), F.col("source").alias(source), word_count(F.col("text")).alias(size), digest.alias(key)
    )
    rows = materialize(rows, "mix-rows")
    named = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))  # null is a source of its own
    place, span, before = f"{p}place", f"{p}span", f"{p}before"
    rows = rows.withColumn(place, named).withColumn(span, F.substring(key, 1, 3))

    ranges = rows.groupBy(place, span).agg(F.sum(size).alias("sum"), F.first(source).alias("source"))
    earlier = Window.partitionBy(place).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(place, span, F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
    totals = ranges.groupBy(place).agg(F.first("source").alias("source"), F.sum("sum").alias("source_size"))
    targets = source_targets(totals.select("source", "source_size"), weights, most)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias(place), "source_size", "target")
    budget = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    plan = offsets.join(targets, place).select(
        place,
        span,
        F.struct(F.col("source_size").cast("long").alias("source_size"), "target", "offset", passes.alias("passes"), (budget - passes * F.col("source_size")).alias("rest")).alias(f"{p}plan"),
    )
    inside = Window.partitionBy(place, span).orderBy(key, size).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn(before, F.coalesce(F.sum(size).over(inside), F.lit(0)))
    found = lambda c: F.col(f"{p}plan.{c}")
    last = F.least(F.col(size), F.greatest(F.lit(0), found("rest") - F.col(before) - found("offset")))
    return summed.join(plan, [place, span]).select(
        *own_columns(docs, *new, "text", "source"),
        F.col(source).alias("source"),
        F.col(size).alias("size"),
        found("source_size").alias("source_size"),
        found("target").alias("target"),
        (found("passes") * F.col(size) + last).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself, with the columns of ``docs``: documents repeated as often as taken.

    A document whose last pass is cut inside keeps its first words there, joined by spaces;
    ``n_chars``, where there is one, follows the text.  Defined cases as in ``mix``;
    documents that the mix does not reach, those without a word among them, do not appear.
    """
    row = free_name(docs, "_row")
    whole = F.struct(*own_columns(docs))
    plan = mix(docs.select("doc_id", "text", "source", whole.alias(row)), weights, most, seed)
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    full = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    copies = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), full), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>"))
    )
    rows = plan.select(F.col(row).alias("row"), F.explode(copies).alias("cut"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)), 1, F.col("cut").cast("int")), " ")
    out = rows.withColumn("body", F.when(F.col("cut") < 0, F.col("row.text")).otherwise(cut))

    def column(name):
        if name == "text":
            return F.col("body").alias(name)
        own = F.col("row")[name]
        if name == "n_chars":
            return F.when(F.col("cut") < 0, own).otherwise(F.length("body")).cast(docs.schema[name].dataType).alias(name)
        return own.alias(name)

    return out.select(*[column(c) for c in docs.columns])


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op7_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(md5(text), '-')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
     / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM w),
f AS (SELECT arg_min(level, source_size / weight) AS level FROM l WHERE level * weight <= 3 * source_size),
t AS (SELECT l.source, l.source_size, least(f.level * l.weight, (3 * l.source_size)::DOUBLE) AS target FROM l, f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
   + least(size, greatest(0, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - ahead)))::BIGINT AS taken
FROM p""",
}
QUERIES = {"op7_mix_sources": op7_mix_sources}
