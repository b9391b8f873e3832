"""Input that the given tables do not hold, made from them by Spark: pictures of texts, and books of web pages."""

from __future__ import annotations

import io
import zipfile

import numpy as np
from pyspark.sql import DataFrame

from ..sources import images

LINES = 40


def exif_stored(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """The picture that is seen as ``pixels`` by this orientation tag."""
    turned = np.rot90(pixels, -images.TURNS.get(orientation, 0))
    return turned[:, ::-1] if orientation in images.MIRRORED else turned


#: Which characters are white space; none is beyond the ideographic space.
SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def typeset(text: str, width: int = 480, lines: int = LINES):
    """The whole text as drawn pages: a dark bar for each letter, as wide as the letter's code says.

    A line holds what fits into ``width``; an empty text is one empty page.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = 3 + codes * 7 % 8
    ends = np.cumsum(sizes)
    # a bar and the gap after it; white space leaves the bar out
    shape = np.c_[sizes - 2, np.full(len(sizes), 2)]
    tone = np.full(shape.shape, 240, np.uint8)
    tone[:, 0][~SPACE[np.minimum(codes, len(SPACE) - 1)]] = 30
    at = 0
    while True:
        strips, cuts = np.full((lines, width + 80), 240, np.uint8), [at]
        while len(cuts) <= lines and cuts[-1] < len(sizes):
            cuts.append(int(ends.searchsorted((ends[cuts[-1] - 1] if cuts[-1] else 0) + width, "right")))
        bars = np.repeat(tone[at : cuts[-1]].ravel(), shape[at : cuts[-1]].ravel())
        places = np.r_[0, ends[np.array(cuts[1:], int) - 1] - (ends[at - 1] if at else 0)].tolist()
        for row, (lo, hi) in enumerate(zip(places, places[1:])):
            strips[row, 40 : 40 + hi - lo] = bars[lo:hi]
        page = np.full((20 * lines + 80, width + 80), 240, np.uint8)
        page[40 : 40 + 20 * lines].reshape(lines, 20, width + 80)[:, :10] = strips[:, None]
        at = cuts[-1]
        yield page
        if at == len(sizes):
            return


def pictures(i: int | None, text: str | None):
    """``id, page, orientation, pixels`` of a document's pages: of every third on its side, of every fifth two beside a fold.

    Every picture is stored as one of the eight orientation tags says.  A null id counts as 0, a null
    text is an empty page.
    """
    number = i or 0
    for k, page in enumerate(typeset(text or "")):
        if number % 5 == 0:
            page = np.concatenate([page, np.full((len(page), 6), 60, np.uint8), page], axis=1)
        if number % 3 == 0:
            page = np.rot90(page, -1)
        tag = (number + k) % 8 + 1
        yield i, k, tag, exif_stored(page, tag)


def typeset_pages(docs: DataFrame, together: int = 16) -> DataFrame:
    """All ``pictures`` of documents as ``images.PIXELS``; ``together`` of them are held at a time."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), *[pa.int32()] * 4, pa.binary()]
        names = ["id", "page", "height", "width", "orientation", "pixels"]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            rows: list = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for own, k, tag, page in pictures(i, text.as_py()):
                    rows.append((own, k, *page.shape, tag, page.tobytes()))
                    if len(rows) == together:
                        yield made(rows)
                        rows = []
            if rows:
                yield made(rows)

    return docs.select("doc_id", "text").mapInArrow(run, images.PIXELS)


def bound(page_id: int, page: str) -> bytes:
    """A book of one page, with a navigation document and a spine that also names a missing file."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        items = '<item id="n" href="nav.xhtml" properties="nav"/><item id="x" href="gone.xhtml"/><item id="a" href="a%20b.xhtml"/>'
        z.writestr("o/p.opf", f'<package><manifest>{items}</manifest><spine><itemref idref="x"/><itemref idref="a"/><itemref idref="none"/></spine></package>')
        z.writestr("o/nav.xhtml", f'<html><body><nav epub:type="toc"><ol><li><a href="a%20b.xhtml">Page {page_id}</a></li></ol></nav></body></html>')
        z.writestr("o/a b.xhtml", page)
    return out.getvalue()


def bind(pages: DataFrame) -> DataFrame:
    """``path, content``: each of ``page_id, html`` as a book."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{i}.epub" for i, _ in rows]), pa.array([bound(i, page or "") for i, page in rows], pa.binary())], names=["path", "content"]
            )

    return pages.select("page_id", "html").mapInArrow(run, "path string, content binary")
