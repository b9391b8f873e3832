"""Streams over several batches, checked inserts, versions and cascades."""

import json
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from vellum.operators import cascade, ingest
from vellum.sources import imports, versions
from vellum.streaming import chunks, vocabulary


def test_vocabulary_over_batches_with_late_and_repeated_events(spark, tmp_path):
    rng, at = random.Random(3), datetime(2024, 6, 1)
    rows = [(i, at + timedelta(days=rng.randrange(-400, 400)), rng.randrange(3), rng.choice(["View", "click", "CLICK"]), 1.0, f"p{i}") for i in range(60)]
    batches = [rows[30:45], [], rows[40:60] + rows[30:32], rows[:30] + rows[50:52], rows[:5]]
    done = []
    for k, batch in enumerate(batches):
        done += batch
        spark.createDataFrame(batch, vocabulary.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        vocabulary.follow(vocabulary.read_events(spark, f"{tmp_path}/events"), str(tmp_path / "out"))
        once = {r[0]: r for r in done}
        count = Counter((r[2], r[3].lower()) for r in once.values())
        first = {w: min(i for i, r in once.items() if (r[2], r[3].lower()) == w) for w in count}
        got = {(r.book_id, r.word): (r["count"], r.first_id, r.lemma, r.sentence) for r in vocabulary.current(spark, str(tmp_path / "out")).collect()}
        assert got == {w: (n, first[w], f"lemma-{first[w] % 5}", f"p{first[w]}") for w, n in count.items()}
    # the last batch brought nothing new, so it changed no word
    sizes = {r.batch: r.n for r in spark.read.parquet(str(tmp_path / "out/changes")).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(sizes, default=0) < len(batches) and sum(sizes.values()) < 6 * len(batches)


def test_any_cut_of_the_bodies_gives_their_text(spark, tmp_path):
    rng = random.Random(5)
    texts = ["Hello ", "wörld 日本語 😀", "", "a\nb", "end"]
    bodies = {
        1: "\n".join(json.dumps({"response": t, "done": t == "end"}, ensure_ascii=False) for t in texts) + "\n" + json.dumps({"response": "lost", "done": False}) + "\n",
        2: '{"response": "x"}\r\n\nnot json\n{"response": "é"}\n{"response": "open"}',
        3: "no line end", 4: '{"done": true}\n', 5: '{"response": "' + "é" * 400 + '"}\n',
    }
    pieces = []
    for i, body in bodies.items():
        raw, at, seq = body.encode(), 0, 0
        while at < len(raw):
            size = rng.choice([1, 2, 3, 17, 100])
            pieces.append((i, seq, bytearray(raw[at : at + size])))
            at, seq = at + size, seq + 1
    rng.shuffle(pieces)
    pieces += rng.sample(pieces, 10)
    for k in range(4):
        spark.createDataFrame(pieces[k::4], chunks.CHUNKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        chunks.follow(chunks.read_chunks(spark, f"{tmp_path}/in"), str(tmp_path))
    lines = spark.read.schema(chunks.LINES).parquet(f"{tmp_path}/lines")
    got = {r.id: r.text for r in chunks.text_of_lines(lines).collect()}
    whole = spark.createDataFrame(list(bodies.items()), "id long, body string")
    assert {i: got.get(i, "") for i in bodies} == {r.id: r.text for r in ingest.stream_text(whole).collect()}
    assert got[1] == "".join(texts) and got[2] == "xé" and got[5] == "é" * 400


def test_a_second_import_reads_only_the_ranges_it_touches(spark, tmp_path, capsys):
    path, kind = f"{tmp_path}/pages", "id long, book_id long, page_no long, image_hash string"
    first = [(i, i % 2, i if i % 3 else None, f"{i % 16:x}{i % 7:x}{i:04}") for i in range(100)]
    assert all(r.added for r in imports.add_pages(spark.createDataFrame(first, kind), path).collect())
    same = first[20][3]
    new = [(200, 0, 7, same), (201, 1, 8, same), (202, 1, 9, same), (203, 0, 1, "ff" + "0" * 4), (204, 0, 2, "ff" + "0" * 4)]
    frame = spark.createDataFrame(new, kind)
    imports.stored_pages(frame, path).explain("formatted")
    assert re.search(rf"PartitionFilters: \[.*range#\d+ IN \(({same[:2]},ff|ff,{same[:2]})\)", capsys.readouterr().out)
    told = {r.id: (r.existing_id, r.existing_no, r.added) for r in imports.add_pages(frame, path).collect()}
    assert told == {200: (20, 20, False), 201: (None, None, True), 202: (201, 8, False), 203: (None, None, True), 204: (203, 1, False)}
    assert not any(r.added for r in imports.add_pages(frame, path).collect())
    assert spark.read.parquet(path).count() == 102


def library(spark, root):
    blocks = [(f"{p}:{k}", p, k, f"old {p} {k}", p % 2) for p in range(6) for k in (1, 2)]
    notes = [(i, b[0], b[4]) for i, b in enumerate(blocks)]
    tables = {
        "blocks": spark.createDataFrame(blocks, "id string, page_id long, ordinal long, text string, book_id long"),
        "summaries": spark.createDataFrame(notes, "id long, block_id string, book_id long"),
        "critiques": spark.createDataFrame([(100 + i, i, b) for i, _, b in notes], "id long, summary_id long, book_id long"),
    }
    versions.create(spark, root, tables)


def seen(spark, root, version=None):
    return {r: sorted((x.id, x.text if r == "blocks" else "") for x in versions.read(spark, root, r, version).collect()) for r in ("blocks", "summaries", "critiques")}


def test_a_reader_sees_the_old_or_the_new_library(spark, tmp_path):
    root = str(tmp_path / "lib")
    assert versions.latest(spark, root) == 0
    library(spark, root)
    before = seen(spark, root)
    opened = versions.read(spark, root, "blocks")
    pages = spark.createDataFrame([(2, 0), (3, 1)], "page_id long, book_id long")
    fresh = spark.createDataFrame([("2:1", 2, 1, "new", 0)], "id string, page_id long, ordinal long, text string, book_id long")
    folder, books = versions.stage_pages(spark, root, 1, fresh, pages)
    # everything is written, nothing shows
    assert versions.latest(spark, root) == 1 and seen(spark, root) == before
    versions.publish(spark, root, 1, folder, ["blocks", "summaries", "critiques"], books)
    after = seen(spark, root)
    assert [x for x in after["blocks"] if x[0][0] in "23"] == [("2:1", "new")] and len(after["blocks"]) == 9
    assert [x[0] for x in after["summaries"]] == [0, 1, 2, 3, 8, 9, 10, 11] and [x[0] - 100 for x in after["critiques"]] == [0, 1, 2, 3, 8, 9, 10, 11]
    # who opened the old version keeps it, and a change that started from it fails
    assert sorted((r.id, r.text) for r in opened.collect()) == before["blocks"] and seen(spark, root, 1) == before
    with pytest.raises(AnalysisException):
        versions.publish(spark, root, 1, folder, ["blocks"], books)
    # a later change writes only the books that it touches
    versions.replace_pages(spark, root, fresh.where("false"), spark.createDataFrame([(5, 1)], "page_id long, book_id long"))
    assert {x for x in after["blocks"] if x[0][0] != "5"} == set(seen(spark, root)["blocks"])
    touched = spark.read.parquet(f"{root}/versions/version=3").where("relation = 'blocks'").collect()
    assert {r.book_id: r.folder == folder for r in touched} == {0: True, 1: False}


def test_cascades_follow_their_keys(spark):
    own = lambda rows, kind: spark.createDataFrame(rows, kind)
    tables = {
        "b": own([(1, 10), (2, 20), (3, None)], "id long, page long"), "p": own([(10, 1), (20, 2), (30, None)], "id long, book long"),
        "x": own([(5, 10, 20), (6, 20, 10), (7, None, 99)], "id long, page long, other long"),
    }
    keys = [cascade.Key("b", "page", "p", "set null"), cascade.Key("p", "book", "b"), cascade.Key("x", "page", "p"), cascade.Key("x", "other", "p", "set null")]
    got = {t: sorted(map(tuple, df.collect()), key=str) for t, df in cascade.delete(tables, {"b": own([(1,)], "id long"), "p": own([(99,)], "id long")}, keys).items()}
    assert got == {"b": [(2, 20), (3, None)], "p": [(20, 2), (30, None)], "x": [(6, 20, None), (7, None, None)]}
    with pytest.raises(ValueError):
        cascade.delete(tables, {}, [cascade.Key("b", "page", "p"), cascade.Key("p", "book", "b")])
    assert {k.parent for k in cascade.KEYS if k.action == "set null"} == {"pages", "blocks", "lookups"}
