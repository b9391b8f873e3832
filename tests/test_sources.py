import io
import json
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import ingest, lexicon
from vellum.operators.ingest import split_units
from vellum.plans import drawn
from vellum.plans import ingest as ingest_plans
from vellum.sources import epub, html, images, library

PAGE = """<html><head><title>Site name</title><style>p {x}</style></head><body><nav><p>Not this one</p></nav>
<article><h1>The Heading</h1><p>First <b>bold</b> paragraph<br>goes on<p>Second paragraph &amp; more</p>
<ul><li><a href=x>only a link here</a></li><li>A real item <a href=y>x</a></li></ul><div class="ad"><script>var p = "<p>no</p>"</script></div>
<aside><p>Aside text is left out</p></aside><blockquote><p>Inner quote wins</p></blockquote><p>1 2</p></article><footer><p>Footer text</p></footer></body></html>"""


def test_html():
    assert html.title(PAGE) == "The Heading"
    assert html.paragraphs(PAGE) == [
        ("The Heading", True),
        ("First bold paragraphgoes on", False),
        ("Second paragraph & more", False),
        ("A real item x", False),
        ("Inner quote wins", False),
    ]
    small = "<article><p>Only one</p></article><main><p>Main one</p><p>Main two</p></main>"
    assert [t for t, _ in html.paragraphs(small)] == ["Main one", "Main two"]
    assert [t for t, _ in html.paragraphs("<div id=content><p>aaa</p><p>bbb</p></div><p>ccc</p>")] == ["aaa", "bbb"]
    assert html.paragraphs("<p>alone</p>") == [] and html.paragraphs("") == []
    assert html.paragraphs('<p id="c1">Text one</p><p id="c2">Text two</p>', {"c1": "Part A", "c2": "Part B"}) == [
        ("Part A", True), ("Text one", False), ("Part B", True), ("Text two", False),
    ]


def book() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr(
            "o/p.opf",
            '<package><manifest><item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="a.html"/><item id="b" href="b.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
        )
        z.writestr("o/t.ncx", '<ncx><navMap><navPoint><navLabel><text>Part I</text></navLabel><content src="a.html#x"/><navPoint><navLabel><text>Chapter 2</text></navLabel><content src="b.html#y"/></navPoint></navPoint></navMap></ncx>')
        z.writestr("o/a.html", '<body><p id="x">Opening text here</p><p>More of the text</p></body>')
        z.writestr("o/b.html", '<body><p>Still the first part</p><p id="y">The second chapter</p></body>')
    return out.getvalue()


def test_epub(spark):
    frame = spark.createDataFrame([("a.epub", bytearray(book())), ("broken.epub", bytearray(b"no zip"))], "path string, content binary")
    rows = sorted(epub.book_paragraphs(frame).collect(), key=lambda r: r.ordinal)
    assert [(r.division, r.label, r.text) for r in rows] == [
        (1, "Part I", "Opening text here"), (1, "Part I", "More of the text"), (1, "Part I", "Still the first part"), (2, "Chapter 2", "The second chapter"),
    ]


def test_split_units_loses_nothing(spark):
    texts = ["3:4 one 3:5 two 10:1", "no refs at 3:45pm", "1:1", ""]
    frame = spark.createDataFrame([(x,) for x in texts], "x string").select("x", split_units(F.col("x")).alias("u"))
    assert all(" ".join(r.u).split() == r.x.split() for r in frame.collect())


def typeset(h=900, w=700):
    page = np.full((h, w, 3), 240, np.uint8)
    rng = np.random.default_rng(0)
    for top in range(60, h - 60, 22):
        left = 50
        while left < w - 90:
            size = int(rng.integers(10, 60))
            page[top : top + 10, left : left + size] = 30
            left += size + int(rng.integers(4, 14))
    return page


def test_images(spark):
    page = typeset()
    assert not images.is_sideways(page) and images.is_sideways(np.rot90(page, -1))
    assert images.turn_upright(np.rot90(page, -1)).shape == page.shape
    assert not images.is_sideways(np.full((400, 300), 128, np.uint8))
    spread = np.full((400, 800), 230, np.uint8)
    spread[:, 398:402] = 60
    assert images.gutter(spread) in range(398, 402) and [p.shape[0] for p in images.split_spread(spread)] == [400, 400]
    assert images.gutter(spread[:, :450]) is None and images.gutter(np.full((400, 800), 230, np.uint8)) is None
    heads = [b"\xff\xd8\xff\xe0xxxxxxxxxx", b"\x89PNG\r\n\x1a\nxxxxxx", b"\0\0\0\x18ftypheicxxxx", b"plain text here"]
    frame = spark.createDataFrame([(bytearray(x),) for x in heads], "c binary").select(images.sniff(F.col("c")).alias("k"))
    assert sorted(r.k for r in frame.collect()) == sorted(["jpeg", "png", "heic", "unknown"])


def test_fold_against_the_pages_beside_it():
    dark_edges = np.full((400, 800), 230, np.uint8)
    dark_edges[:, 398:402] = 170
    assert images.gutter(dark_edges) in range(398, 402)
    dark_edges[:, :70] = dark_edges[:, 730:] = 20  # the table beside the book does not count
    assert images.gutter(dark_edges) in range(398, 402)
    dark_edges[:, 300:380] = 175  # dark columns apart from the fold count as well
    assert images.gutter(dark_edges) is None


def test_drawn_pages_of_nothing(spark):
    got = images.upright_pages(drawn.typeset_pages(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string"))).collect()
    assert sorted((r.id or 0, r.part) for r in got) and {r.id for r in got} == {None, 1}


def test_json_array_in_parallel(spark, tmp_path):
    rng = random.Random(4)
    texts = ["plain", "a } in, it", '},{"word": "no"', 'quote " and \\', "[{}]", "é 😀 }", "", "{{{", 'end\\"}', "line\nend }"]
    rows = [{"word": rng.choice(texts) + str(i), "pos": rng.choice([None, "n."]), "definitions": rng.choices(texts, k=i % 4), "more": {"deep": [{"x": "}"}]}} for i in range(500)]
    for k, shown in enumerate((json.dumps(rows), json.dumps(rows, indent=2, ensure_ascii=False), "\ufeff" + json.dumps(rows[:1]), "[]")):
        (tmp_path / f"{k}.json").write_text(shown)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        for k, own in enumerate((rows, rows, rows[:1], [])):
            frame = lexicon.json_objects(spark, f"file://{tmp_path}/{k}.json")
            assert k > 1 or spark.read.option("lineSep", "}").text(f"file://{tmp_path}/{k}.json").rdd.getNumPartitions() > 10
            assert [(r.place, json.loads(r.object)) for r in sorted(frame.collect())] == list(enumerate(own))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def paged(runs):
    """Pages by the rule applied to one paragraph after the other."""
    out = []
    for run, own in runs.items():
        units = [u for x in own for u in re.sub(r" (?=[0-9]+:[0-9]+( |$))", "\0", " ".join(x.split())).split("\0")]
        lead = lambda x: (m := re.match(r"([0-9]+):[0-9]+( |$)", x)) and int(m[1])
        if sum(bool(lead(" ".join(x.split()))) for x in own) >= 0.6 * len(own):
            page, chapter = 1, None
            for k, x in enumerate(units):
                now = lead(x)
                page += now is not None and chapter is not None and now != chapter
                chapter = now if now is not None else chapter
                out.append((run, page, k, x))
        else:
            out += [(run, k // 8 + 1, k, x) for k, x in enumerate(own)]
    return sorted(out)


@pytest.mark.parametrize("stretch", [1, 3, 1000])
def test_runs_by_stretches(spark, stretch):
    rng = random.Random(stretch)
    runs = {r: [rng.choice(["plain text", f"{rng.randrange(1, 4)}:1 unit", f"{rng.randrange(1, 4)}:2 a {rng.randrange(1, 4)}:3 b", "2:5"]) for _ in range(rng.randrange(1, 30))] for r in range(40)}
    rows = [(r, "L", i, x) for r, own in runs.items() for i, x in enumerate(own)]
    got = ingest.paginate(spark.createDataFrame(rows, "run_id long, label string, ordinal long, paragraph string"), stretch).collect()
    assert sorted((r.run_id, r.page, r.k, r.text) for r in got) == paged(runs)
    assert all((r.label == "L") == (r.page == 1) for r in got)


def test_one_run_of_a_million_paragraphs(spark):
    rows = spark.range(1_000_000).select(F.lit(1).alias("run_id"), F.lit("L").alias("label"), F.col("id").alias("ordinal"), F.concat(F.floor(F.col("id") / 1000), F.lit(":"), F.col("id") % 1000, F.lit(" x")).alias("paragraph"))
    for by, n in ((rows, 1000), (rows.withColumn("paragraph", F.lit("x")), 125_000)):
        out = ingest.paginate(by)
        assert out.agg(F.count(F.lit(1)), F.max("page"), F.max("k"), F.sum(F.col("k")), F.countDistinct("page")).first()[:] == (1_000_000, n, 999_999, 499_999_500_000, n)


def test_deep_and_wide_html():
    deep = "<div>" * 20_000 + "<p>First deep paragraph</p><p>Second deep paragraph</p>" + "</div>" * 20_000
    assert [x for x, _ in html.paragraphs(deep)] == ["First deep paragraph", "Second deep paragraph"]
    assert html.title("<article>" * 5000 + "<h1>The deep heading</h1>") == "The deep heading"
    wide = "<ul>" + "<li>an item of the list</b></i>" * 20_000 + "</ul>"
    assert len(html.paragraphs(wide)) == 20_000


def test_epub_navigation_and_missing_items():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        z.writestr(
            "p.opf",
            '<package><manifest><item id="n" href="nav.xhtml" properties="nav"/><item id="t" href="t.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="a.html"/><item id="gone" href="gone.html"/><item id="b" href="b.html"/></manifest>'
            '<spine><itemref idref="gone"/><itemref idref="a"/><itemref idref="unknown"/><itemref idref="b"/></spine></package>',
        )
        z.writestr("t.ncx", "<ncx broken")
        z.writestr("nav.xhtml", '<nav epub:type="landmarks"><a href="a.html">Not this</a></nav><nav epub:type="toc"><ol><li><a href="a.html">One</a><ol><li><a href="b.html#q">Two</a></li></ol></li></ol></nav>')
        z.writestr("a.html", "<p>The first text</p><p>More of that text</p>")
        z.writestr("b.html", '<p>Goes on here</p><p id="q">The second text</p>')
    assert epub.spine(out.getvalue()) == [
        ("One", True), ("The first text", False), ("More of that text", False), ("Goes on here", False), ("Two", True), ("The second text", False),
    ]


def test_epub_query_is_the_pages_text(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got: dict = {}
    for r in ingest_plans.epub_pages(spark, sf_dir).orderBy("run_id", "page", "k").collect():
        got.setdefault(int(r.run_id.split(".")[0]), []).append(r.text)
    want = {i: sorted(x for x, head in html.paragraphs(page or "") if not head) for i, page in pages.items()}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}


def test_import_driver(spark):
    rows = [
        ("1/1", 5, "The Title", "early_modern", "Chapter One of fome", 0, "The Title"), ("1/1", 5, "The Title", "early_modern", "Chapter One of fome", 1, "A fhort paragraph of the page un-\nder-\nftand well-\nknown ﬁre that is long enough."),
        ("2/1", 5, "The Title", "modern", None, 0, "12"), ("3/1", 5, "The Title", "modern", None, 0, "Another ﬁne page with words,\nand they end here."), ("4/1", 5, "The Title", "victorian", None, 0, "A ﬁne ſet of\nfhort words here."),
    ]
    frame = spark.createDataFrame(rows, "id string, book_id long, title string, era string, label string, k long, text string")
    words = spark.createDataFrame([(w,) for w in ("short", "understand", "well-known", "some", "underftand")], "headword string")
    got = ingest.import_pages(frame, words).orderBy("id").collect()
    assert [(r.id, r.page_id, r.ordinal, r.kind, r.text_raw, r.text_norm) for r in got] == [
        ("1/1:1", "1/1", 1, "heading", "Chapter One of fome", "Chapter One of fome"),
        ("1/1:2", "1/1", 2, "paragraph", "A fhort paragraph of the page underftand well-known ﬁre that is long enough.", "A short paragraph of the page underftand well-known fire that is long enough."),
        ("3/1:1", "3/1", 1, "paragraph", "Another ﬁne page with words, and they end here.", "Another ﬁne page with words, and they end here."),
        ("4/1:1", "4/1", 1, "paragraph", "A ﬁne ſet of fhort words here.", "A fine ſet of fhort words here."),
    ]
    docs = spark.createDataFrame([(3, "u"), (1, "u"), (2, "v")], "page_id long, url string")
    assert sorted(r.page_id for r in ingest.first_of_source(docs, "url", "page_id").collect()) == [1, 2]


def test_imported_blocks(spark, sf_dir, tmp_path):
    got = ingest_plans.imported_blocks(spark, sf_dir).collect()
    assert len({r.id for r in got}) == len(got) > 0 and {r.ordinal for r in got if r.kind == "heading"} >= {1}
    # the same with ids of any size: only the ids differ
    far = 9_000_000_000_000_000_000
    spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("page_id", F.col("page_id") + far).write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("benchmark",):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    again = ingest_plans.imported_blocks(spark, str(tmp_path)).collect()
    assert sorted((r.book_id, r.page_id, r.id, r.text_raw, r.text_norm) for r in got) == sorted(
        (r.book_id - far, *[x.replace(str(r.book_id), str(r.book_id - far), 1) for x in (r.page_id, r.id)], r.text_raw, r.text_norm) for r in again
    )


def test_dictionary_json(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([
        {"word": " Shew ", "pos": "v.", "definitions": ["See Show.", " "]}, {"word": "Shew", "pos": "n.", "definitions": ["See Sight."]}, {"word": "Show", "pos": None, "definitions": ["To exhibit. [Colloq.]"]},
        {"word": "Sight", "definitions": []}, {"word": "  ", "definitions": ["x"]}, {"word": "Nice", "definitions": ["Foolish. [Obs.]"]}, {"word": "Have", "definitions": ["To hold."]}, {"word": "Public", "definitions": ["Open."]}, {"word": "Run", "definitions": ["To go."]},
    ]))
    senses = lexicon.entries(lexicon.read_entries(spark, f"file://{tmp_path}/d.json"))
    assert senses.where("gloss <> ''").count() == 7
    # of two references of one word the first in the file wins, whichever lemma comes first
    assert {(r.variant, r.lemma) for r in lexicon.variants(senses).where("variant = 'shew'").collect()} == {("shew", "show")}
    assert all(r.found for r in lexicon.probes(senses).collect())
    assert not any(r.found for r in lexicon.probes(senses.where("headword = 'sight'")).collect())


def test_exif_and_fit():
    page = np.arange(12, dtype=np.uint8).reshape(3, 4)
    seen = {o: images.exif_upright(page, o) for o in range(1, 9)}
    assert [seen[o].shape for o in range(1, 9)] == [(3, 4)] * 4 + [(4, 3)] * 4
    assert (seen[2] == page[:, ::-1]).all() and (seen[3] == page[::-1, ::-1]).all() and (seen[4] == page[::-1]).all() and (seen[5] == page.T).all()
    assert (seen[6] == np.rot90(page, -1)).all() and (seen[7] == page[::-1, ::-1].T).all() and (seen[8] == np.rot90(page)).all()
    assert (images.exif_upright(page, 99) == page).all() and (images.exif_upright(page, None) == page).all()
    wide = np.full((10, 4000), 7, np.uint8)
    assert images.fitted(wide).shape == (4, 1600) and (images.fitted(wide) == 7).all() and images.fitted(page) is page


def drawn_by_letters(text, width=480, lines=40):
    """The drawn pages letter by letter."""
    pages, row, at = [np.full((20 * lines + 80, width + 80), 240, np.uint8)], 0, 0
    for c in text:
        size = 3 + ord(c) * 7 % 8
        if at + size > width:
            row, at = row + 1, 0
            if row == lines:
                pages, row = [*pages, np.full_like(pages[0], 240)], 0
        if not c.isspace():
            pages[-1][40 + 20 * row : 50 + 20 * row, 40 + at : 38 + at + size] = 30
        at += size
    return pages


def test_drawn_pages_are_the_whole_text():
    rng = random.Random(3)
    for n in (0, 1, 500, 20_000):
        text = "".join(rng.choice("ab cé\n😀d.") for _ in range(n))
        want = drawn_by_letters(text)
        assert len(want) > 1 or n < 20_000
        assert all((a == b).all() for a, b in zip(drawn.typeset(text), want, strict=True))


def test_stored_by_each_orientation():
    page = np.arange(12, dtype=np.uint8).reshape(3, 4)
    for tag in range(1, 9):
        assert (images.exif_upright(drawn.exif_stored(page, tag), tag) == page).all()


def test_page_images(spark, sf_dir):
    got = {}
    for r in ingest_plans.page_images(spark, sf_dir).collect():
        got.setdefault((r.id, r.page), []).append(r)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(got) == sorted((i, k) for i, x in texts.items() for k, _ in enumerate(drawn_by_letters(x or "")))
    # pages that are full, or nearly
    full = [(i, k) for i, k in got if len(texts[i] or "") > 900 and (i, k + 1) in got] + [(i, 0) for i, x in texts.items() if x and len(x) > 900]
    assert full and all(got[key][0].sideways == (key[0] % 3 == 0) for key in full)
    assert all(len(got[i, k]) == (2 if i % 5 == 0 else 1) for i, k in full)
    # upright pages are taller than wide and fitted
    assert all((r.height, r.width) == (800, 509) for i, k in full if i % 5 for r in got[i, k])


def test_pictures_stay_where_they_are_drawn(spark, sf_dir):
    plan = ingest_plans.page_images(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "binary" not in plan


def test_upright_drawn_as_stored(spark):
    docs = spark.createDataFrame([(i, "ab cé\n😀d. " * n) for i, n in [(0, 0), (3, 400), (5, 400), (15, 600), (7, 900), (None, 5)]] + [(2, None)], "doc_id long, text string")
    stored = images.upright_pages(drawn.typeset_pages(docs), edge=300).collect()
    told = images.upright_drawn(docs, drawn.pictures, edge=300).collect()
    assert sorted(map(tuple, told), key=str) == sorted((tuple(r)[:-1] for r in stored), key=str)
    assert all(len(r.pixels) == r.height * r.width for r in stored)


def test_fitted_means_of_any_picture():
    rng = np.random.default_rng(1)
    for k in range(60):
        shape = (*rng.integers(1, 90, 2), *([3] if k % 4 == 0 else []))
        page = rng.integers(0, 256, shape).astype(np.uint8)
        page = np.rot90(page, k % 4)[:: -1 if k % 5 == 0 else 1]
        edge = int(rng.integers(1, 100))
        (h, w), longest = page.shape[:2], max(page.shape[:2])
        size = [n if longest <= edge else max(int(n * edge / longest + 0.5), 1) for n in (h, w)]
        cells = [[*(np.arange(m) * n // m), n] for n, m in zip((h, w), size)]
        got = images.fitted(page, edge)
        assert got.shape[:2] == tuple(size) and got.dtype == np.uint8
        for a in range(size[0]):
            for b in range(size[1]):
                mean = page[cells[0][a] : cells[0][a + 1], cells[1][b] : cells[1][b + 1]].reshape(-1, *page.shape[2:]).astype(int).mean(axis=0)
                assert (got[a, b] == np.rint(mean)).all()


def test_profiles_and_periods():
    rng = np.random.default_rng(2)
    for page in (rng.integers(0, 256, (1500, 1300)).astype(np.uint8), rng.integers(0, 2, (90, 200)).astype(np.uint8) * 255, np.full((60, 60), 7, np.uint8)):
        mid = page[int(len(page) * 0.19) : len(page) - int(len(page) * 0.19), int(page.shape[1] * 0.19) : page.shape[1] - int(page.shape[1] * 0.19)].astype(float)
        if len(page) < 1000:
            assert all(np.allclose(a, b) for a, b in zip(images.variance_profiles(page), (mid.var(axis=1), mid.var(axis=0))))
    for n in (48, 49, 200, 700, 1000):
        profile = rng.random(n)
        step = np.diff(profile) - np.diff(profile).mean()
        want = max(float(step[:-k] @ step[k:]) / float(step @ step) for k in range(max(n // 50, 4), n // 4))
        assert abs(images.periodicity(profile) - max(want, 0)) < 1e-9


def test_web_page_shapes(spark, sf_dir):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<nav>" + "<a href=x>y</a>" * 30 + "</nav><p>One short text.</p><p>Another, the longest of them.</p>"), (4, "u", "<p>é One.</p><p>Two of it.</p>" + "<a >" * 20)]
    many = "".join(f"<p>Paragraph {i} with words.</p>" for i in range(60))
    rows += [(5, "u", many + "<a >x</a>" * 30), (6, "u", many + "<a >x</a>" * 31)]
    literal = spark.createDataFrame(rows, "page_id long, url string, html string")
    for frame in (literal, spark.read.parquet(f"{sf_dir}/pages.parquet")):
        source = {r.page_id: r.html or "" for r in frame.collect()}
        found = {r.page_id: r for r in html.page_shapes(frame).collect()}
        assert found.keys() == source.keys()
        for i, page in source.items():
            texts, links = [x for x, _ in html.paragraphs(page)], page.count("<a ")
            want = (i, len(texts), sum(len(x.encode()) for x in texts), max(map(len, texts), default=0), links, texts[0][:110] if texts else None)
            assert tuple(found[i]) == (*want, links > 20 and links > 0.5 * len(texts))
    assert [r.navigation for r in html.page_shapes(literal).orderBy("page_id").collect()] == [False, False, True, False, False, True]


def test_shared_folder_is_asked_for(spark):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: None)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(ValueError):
        library.shared_folder(Cluster, "x")
