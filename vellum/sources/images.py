"""Image geometry on decoded pixels: orientation by periodicity, and the gutter of a spread."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROFILE = 1000


# --- fixed values ------------------------------------------------------------------------
HEIF_BRANDS = ["heic", "heix", "heim", "heis", "hevc", "hevx", "hevm", "hevs", "mif1", "msf1"]
#: Kind and first bytes in hexadecimal; a dot stands for any digit.
MAGIC = [
    ("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("gif", "474946383961"), ("gif", "474946383761"), ("webp", "52494646........57454250"),
    ("tiff", "4D4D002A"), ("tiff", "49492A00"), ("dds", "44445320"), ("bmp", "424D"), ("ico", "00000100"), ("hdr", "233F52414449414E4345"),
    ("avif", "0000....6674797061766966"), ("exr", "762F3101"), ("qoi", "716F6966"), ("farbfeld", "6661726266656C64"), ("pnm", "503[1-7]"),
]
# -----------------------------------------------------------------------------------------


def sniff(content: Column) -> Column:
    """Kind of an image by its first bytes, ``unknown`` for others, null for null."""
    head = F.hex(F.substring(content, 1, 12))
    brands = "|".join(b.encode().hex().upper() for b in HEIF_BRANDS)
    kind = F.when(content.isNotNull() & head.rlike(f"^.{{8}}66747970({brands})"), "heic")
    for name, magic in MAGIC:
        kind = kind.when(head.rlike(f"^{magic}"), name)
    return kind.when(content.isNotNull(), "unknown")


def grey(pixels: np.ndarray) -> np.ndarray:
    """Height x width (x 3) to brightness."""
    return pixels.astype(np.float32) if pixels.ndim == 2 else pixels.astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)


def variance_profiles(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variance of each row and column of the central 62 %, sampled to at most 1000 lines."""
    h, w = pixels.shape[:2]
    mid = pixels[int(h * 0.19) : h - int(h * 0.19), int(w * 0.19) : w - int(w * 0.19)]
    for axis in (0, 1):
        if (n := mid.shape[axis]) > PROFILE:
            mid = mid.take(np.linspace(0, n - 1, PROFILE).astype(int), axis)
    if pixels.ndim > 2 or pixels.dtype != np.uint8:
        g = grey(mid)
        return g.var(axis=1), g.var(axis=0)
    # around 128 the sums of at most 1000 squares are below 2^24, so they are exact in any order
    g = mid.astype(np.float32, order="K")
    g -= 128
    squares = g * g

    def var(total, square, n):
        total = total.astype(np.float64)
        return (square * float(n) - total * total) / (n * n)

    across, down = np.ones(mid.shape[1], np.float32), np.ones(mid.shape[0], np.float32)
    return var(g @ across, squares @ across, max(len(across), 1)), var(down @ g, down @ squares, max(len(down), 1))


def periodicity(profile: np.ndarray) -> float:
    """Best normalised autocorrelation of the profile's changes at lags of a line's height."""
    n = len(profile)
    if n < 48:
        return 0.0
    step = np.diff(profile)
    step = step - step.mean()
    power = float(step @ step)
    if power <= 0:
        return 0.0
    low = max(n // 50, 4)
    # all lags at once, with room so that the ends don't meet
    found = np.fft.rfft(step, 1 << (n + n // 4).bit_length())
    lags = np.fft.irfft(found.real**2 + found.imag**2)[low : max(n // 4, low + 1)]
    return max(0.0, float(lags.max()) / power)


def is_sideways(pixels: np.ndarray) -> bool:
    """Do the columns repeat like lines of text, and the rows less?"""
    rows, cols = variance_profiles(pixels)
    if rows.mean() < 16:
        return False
    across = periodicity(cols)
    return across >= 0.08 and across > 1.35 * periodicity(rows)


def turn_upright(pixels: np.ndarray) -> np.ndarray:
    return np.rot90(pixels) if is_sideways(pixels) else pixels


def gutter(pixels: np.ndarray) -> int | None:
    """The column of a spread's fold: the darkest of the middle third, if it is darker than the
    pages beside it and few columns there are."""
    h, w = pixels.shape[:2]
    if w < 1.25 * h:
        return None
    columns = grey(pixels[h // 4 : h - h // 4]).mean(axis=0)
    lo, hi = w * 35 // 100, w * 65 // 100
    pages = np.r_[columns[w // 10 : w * 3 // 10], columns[w * 7 // 10 : w * 9 // 10]]
    if hi <= lo or not len(pages):
        return None
    dark = columns[lo:hi] < 0.8 * pages.mean()
    return lo + int(columns[lo:hi].argmin()) if 0 < dark.sum() <= 0.1 * w else None


def split_spread(pixels: np.ndarray) -> list[np.ndarray]:
    """The two pages of a spread without the fold, or the picture itself."""
    at = gutter(pixels)
    if at is None:
        return [pixels]
    trim = max(pixels.shape[1] // 100, 2)
    return [pixels[:, : max(at - trim, 1)], pixels[:, min(at + trim, pixels.shape[1] - 1) :]]


#: Orientation tags whose pictures are mirrored, and the quarter turns that follow.
MIRRORED, TURNS = (2, 4, 5, 7), {3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}


def exif_upright(pixels: np.ndarray, orientation: int | None) -> np.ndarray:
    """The picture as its orientation tag (1 to 8) says it is to be seen; other tags change nothing."""
    if orientation in MIRRORED:
        pixels = pixels[:, ::-1]
    return np.rot90(pixels, TURNS.get(orientation or 1, 0))


def _summed(values: np.ndarray, cuts: np.ndarray, counts: np.ndarray, axis: int, kind: type) -> np.ndarray:
    """Sums of the stretches that begin at ``cuts`` along an axis."""
    of = (lambda x, at: x[at]) if axis == 0 else (lambda x, at: x[:, at])
    out = of(values, cuts).astype(kind)
    for k in range(1, int(counts.max())):
        more = slice(None) if (counts > k).all() else np.flatnonzero(counts > k)
        if axis == 0:
            out[more] += values[cuts[more] + k]
        else:
            out[:, more] += values[:, cuts[more] + k]
    return out


def fitted(pixels: np.ndarray, edge: int = 1600) -> np.ndarray:
    """The picture with its longest edge at most ``edge``: means of the pixels that fall together."""
    h, w = pixels.shape[:2]
    longest = max(h, w)
    if longest <= edge:
        return pixels
    if pixels.ndim == 2 and pixels.strides[0] < pixels.strides[1]:
        return fitted(pixels.T, edge).T
    cells = []
    for n in (h, w):
        m = max(int(n * edge / longest + 0.5), 1)
        cuts = np.arange(m) * n // m
        cells.append((cuts, np.diff(np.r_[cuts, n])))
    (rows, down), (columns, across) = cells
    # sums of so few bytes, and which side of a half their mean is on, are exact in 24 bits
    kind = np.float32 if pixels.dtype == np.uint8 and int(down.max()) * int(across.max()) <= 1024 else np.float64
    # a pixel that stands alone is its own mean
    out = pixels[rows][:, columns]
    r, c = np.flatnonzero(down > 1), np.flatnonzero(across > 1)
    if len(r):
        mean = _summed(_summed(pixels, rows[r], down[r], 0, kind), columns, across, 1, kind)
        mean /= (down[r][:, None] * across).astype(kind).reshape(*mean.shape[:2], *[1] * (pixels.ndim - 2))
        out[r] = np.rint(mean, out=mean)
    if len(c) and len(r) < len(rows):
        mean = _summed(_summed(pixels, columns[c], across[c], 1, kind), rows, down, 0, kind)
        mean /= (down[:, None] * across[c]).astype(kind).reshape(*mean.shape[:2], *[1] * (pixels.ndim - 2))
        out[:, c] = np.rint(mean, out=mean)
    return out


PIXELS = "id long, page int, height int, width int, orientation int, pixels binary"
UPRIGHT = "id long, page int, part int, sideways boolean, height int, width int, pixels binary"


def _uprighted(pictures, edge: int, pixels: bool, together: int):
    """Batches of ``UPRIGHT``, without the pixels where these are not asked for, from ``id, page, orientation, pixels``; one picture is held at a time."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
    names = ["id", "page", "part", "sideways", "height", "width", "pixels"]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)], names=names[: len(rows[0])])

    rows: list = []
    for i, page, tag, raw in pictures:
        seen = exif_upright(raw, tag)
        side = is_sideways(seen)
        for part, x in enumerate(split_spread(np.rot90(seen) if side else seen)):
            x = fitted(x, edge)
            rows.append((i, page, part, side, *x.shape, *([np.ascontiguousarray(x).tobytes()] if pixels else [])))
        if len(rows) >= together:
            yield made(rows)
            rows = []
    if rows:
        yield made(rows)


def upright_pages(pictures: DataFrame, edge: int = 1600) -> DataFrame:
    """``id, page, part, sideways, height, width, pixels``: pictures by their tag and their lines upright, split, fitted.

    ``pictures`` are grey ``PIXELS``; one picture is held at a time.
    """

    def stored(batches):
        for batch in batches:
            ids, pages, heights, widths, tags = (batch.column(k).to_pylist() for k in range(5))
            for i, page, h, w, tag, raw in zip(ids, pages, heights, widths, tags, batch.column(5), strict=True):
                yield i, page, tag, np.frombuffer(raw.as_buffer(), np.uint8).reshape(h, w)

    own = pictures.select("id", "page", "height", "width", "orientation", "pixels")
    return own.mapInArrow(lambda batches: _uprighted(stored(batches), edge, True, 1), UPRIGHT)


def upright_drawn(rows: DataFrame, draw, edge: int = 1600) -> DataFrame:
    """As ``upright_pages`` without the pixels, of the pictures ``id, page, orientation, pixels`` that ``draw`` makes of a row's values.

    Every picture is worked on where it is drawn and let go, so none moves between Python and Spark.
    """

    def drawn(batches):
        for batch in batches:
            for values in zip(*batch.columns, strict=True):
                yield from draw(*(v.as_py() for v in values))

    return rows.mapInArrow(lambda batches: _uprighted(drawn(batches), edge, False, 1024), UPRIGHT.rsplit(",", 1)[0])
