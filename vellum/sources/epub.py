"""Books in zip containers: the contents' labels, and the spine as one run of text."""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from urllib.parse import unquote
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest
from . import library
from .html import contents_links, paragraphs, squeeze


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def _all(root, name: str):
    return [x for x in root.iter() if _local(x.tag) == name]


def _join(base: str, href: str) -> str:
    return posixpath.normpath(posixpath.join(base, unquote(href)))


def _labels(book: zipfile.ZipFile, package: str, root) -> dict[tuple[str, str], str]:
    """(file, fragment) -> label of every entry of the contents, at any depth.

    The older contents file comes first, then the navigation document; a broken or missing
    one gives nothing.
    """
    base = posixpath.dirname(package)
    found: dict[tuple[str, str], str] = {}

    def add(path: str, target: str, text: str) -> None:
        file, _, fragment = target.partition("#")
        if text:
            found.setdefault((_join(posixpath.dirname(path), file) if file else path, fragment), text)

    items = _all(root, "item")
    for item in (x for x in items if x.get("media-type") == "application/x-dtbncx+xml"):
        path = _join(base, item.get("href", ""))
        try:
            points = _all(ElementTree.fromstring(book.read(path)), "navPoint")
        except (KeyError, ElementTree.ParseError):
            continue
        for point in points:
            text = next((squeeze("".join(x.itertext())) for x in point if _local(x.tag) == "navLabel"), "")
            add(path, next((x.get("src", "") for x in point if _local(x.tag) == "content"), ""), text)
    for item in (x for x in items if "nav" in (x.get("properties") or "").split()):
        path = _join(base, item.get("href", ""))
        try:
            page = book.read(path).decode("utf-8", "replace")
        except KeyError:
            continue
        for target, text in contents_links(page):
            add(path, target, text)
    return found


def spine(content: bytes) -> list[tuple[str, bool]]:
    """(text, is heading) of a whole book in spine order.

    A container that cannot be opened gives nothing; an item that is missing or unreadable is
    skipped, and the rest of the book stays.
    """
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        package = next(x.get("full-path") for x in _all(ElementTree.fromstring(book.read("META-INF/container.xml")), "rootfile"))
        root = ElementTree.fromstring(book.read(package))
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
        return []
    labels = _labels(book, package, root)
    files = {x.get("id"): _join(posixpath.dirname(package), x.get("href", "")) for x in _all(root, "item")}
    found: list[tuple[str, bool]] = []
    for ref in _all(root, "itemref"):
        path = files.get(ref.get("idref"))
        try:
            page = book.read(path or "").decode("utf-8", "replace")
        except (KeyError, zipfile.BadZipFile, zlib.error):
            continue
        if label := labels.get((path, "")):
            found.append((label, True))
        anchors = {fragment: text for (file, fragment), text in labels.items() if file == path and fragment}
        found += [x for x in paragraphs(page, anchors) if not (x[1] and found and x == found[-1])]
    return found


def book_paragraphs(files: DataFrame) -> DataFrame:
    """``path, division, label, ordinal, text`` from binary files ``path, content``.

    A heading opens a division and is its label; file boundaries open nothing.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                division, label, ordinal = 0, None, 0
                for text, heading in spine(content or b""):
                    if heading:
                        division, label = division + 1, text
                        continue
                    ordinal += 1
                    rows.append((path, division, label, ordinal, text))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["path", "division", "label", "ordinal", "text"],
                )

    return files.select(F.col("path"), F.col("content")).mapInArrow(run, "path string, division long, label string, ordinal long, text string")


def book_pages(files: DataFrame) -> DataFrame:
    """``run_id, page, label, k, text``: the books' divisions cut into pages; ``run_id`` is path and division.

    Files are read once: their paragraphs are written, since runs are read twice.
    """
    rows = book_paragraphs(files)
    runs = rows.select(F.concat_ws("#", "path", F.col("division").cast("string")).alias("run_id"), "label", "ordinal", F.col("text").alias("paragraph"))
    return ingest.paginate(library.staged(runs, "paragraphs"))
