"""Fill-in-middle transformation by lookaround splitting.

A unit grammar says which neighbouring characters belong to one unit.  It becomes one
zero-width regular expression that matches between any other two characters, so splitting
there loses nothing: the pieces are the units.  A text is cut after two of its units and its
three parts are put in an order in which the middle comes last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import free_prefix, own_columns

#: What marks the prefix, suffix and middle of a transformed text.
MARKS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Units:
    """A grammar of units: neighbouring characters of each pair of classes are never parted."""

    joined: tuple[tuple[str, str], ...]

    def boundary(self) -> str:
        """A zero-width pattern that matches between two units, and at neither end of a text."""
        return "(?s)(?<=.)(?=.)" + "".join(f"(?!(?<={a})(?={b}))" for a, b in self.joined)

    def split(self, text: Column) -> Column:
        """The units of a text, which together are the text; an empty one has none."""
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, self.boundary(), -1))


#: Runs of letters, and every other character by itself.
WORDS = Units((("[A-Za-z]", "[A-Za-z]"),))
#: Lines with their line ends.
LINES = Units((("[^\\n]", "."),))
CHARACTERS = Units(())


@dataclass(frozen=True)
class FillMiddle:
    """Of 100 texts ``plain`` stay as they are; of 100 others ``suffix_first`` are in the order SPM."""

    units: Units = WORDS
    plain: int = 10
    suffix_first: int = 20


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed one was made from."""
    parts = F.split(output, "|".join(MARKS), -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def fill_middle(docs: DataFrame, how: FillMiddle | None = None) -> DataFrame:
    """Adds ``n, form, prefix_chars, middle_chars, output`` to all columns of ``docs``.

    ``n`` counts units, ``form`` is plain, psm or spm, and the lengths are in code points (null
    for plain).  All choices follow from a hash of the doc_id (null: of the empty string), so
    reruns agree.  Defined cases: a null text is empty, and an empty one is plain; so is one
    that holds a mark; very long texts are cut whole, unbroken ones as one unit; repeated rows
    and equal ids are transformed alike; older columns of the five names are replaced, others
    stay; an empty table gives an empty result.
    """
    how = how or FillMiddle()
    p = free_prefix(docs)
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    text, units, h, lo, hi = (f"{p}{c}" for c in ("text", "units", "h", "lo", "hi"))
    row = f"{p}row"
    df = docs.select(
        F.struct(*own_columns(docs, *new)).alias(row),
        F.coalesce(F.col("text"), F.lit("")).alias(text),
        F.transform(F.array(*[F.substring(digest, 1 + 8 * i, 8) for i in range(4)]), lambda x: F.conv(x, 16, 10).cast("long")).alias(h),
    )
    df = df.withColumn(units, how.units.split(F.col(text))).withColumn("n", F.size(units).cast("long"))
    at = [F.col(h)[i] % (F.col("n") + 1) for i in (0, 1)]
    kept = (F.col(text) == "") | F.col(text).rlike("|".join(MARKS)) | (F.col(h)[2] % 100 >= 100 - how.plain)
    form = F.when(kept, "plain").when(F.col(h)[3] % 100 < how.suffix_first, "spm").otherwise("psm")
    df = df.withColumns({lo: F.least(*at).cast("int"), hi: F.greatest(*at).cast("int"), "form": form})
    part = lambda start, stop: F.array_join(F.slice(units, start + 1, stop - start), "")
    parts = F.struct(
        part(F.lit(0), F.col(lo)).alias("prefix"), part(F.col(lo), F.col(hi)).alias("middle"), part(F.col(hi), F.col("n").cast("int")).alias("suffix")
    )
    cut = f"{p}cut"
    df = df.withColumn(cut, F.when(F.col("form") != "plain", parts))
    prefix, middle, suffix = (F.col(cut)[c] for c in ("prefix", "middle", "suffix"))
    pre, suf, mid = map(F.lit, MARKS)
    psm, spm = F.concat(pre, prefix, suf, suffix, mid, middle), F.concat(suf, suffix, pre, prefix, mid, middle)
    return df.select(
        *[F.col(row)[c].alias(c) for c in df.schema[row].dataType.names],
        "n",
        "form",
        F.length(prefix).cast("long").alias("prefix_chars"),
        F.length(middle).cast("long").alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col(text)).alias("output"),
    )


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f),
o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END AS out FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(out) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""
SQL = {"op11_fill_middle": _SQL}
QUERIES = {"op11_fill_middle": op11_fill_middle}
