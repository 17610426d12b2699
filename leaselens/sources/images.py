"""Images as columns: PNG and portable pixmaps decoded in numpy, pages cleaned, cells found; other formats need a provider."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pixels as px

#: Pixels of an image at most, as a few bytes may declare any size: a setting, as what fits depends on the executors.
MOST_PIXELS = 1 << 26
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _png(data: bytes, most: int) -> np.ndarray:
    at, idat, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + size
    if head is None:
        raise ValueError("a PNG file without a header")
    width, height, depth, kind, _, _, interlaced = head
    if depth != 8 or interlaced or kind not in _CHANNELS:
        raise ValueError("only PNG files of 8 bits a channel that aren't interlaced")
    if width * height > most:
        raise ValueError(f"{width} x {height} pixels are more than {most}")
    step = _CHANNELS[kind]
    row = width * step
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(idat), (row + 1) * height), np.uint8)
    if len(raw) != (row + 1) * height:
        raise ValueError("the data ends early")
    lines, out, before = raw.reshape(height, row + 1), np.zeros((height, row), np.uint8), np.zeros(row, np.uint8)
    for y in range(height):
        before = out[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:], before, step)
    x = out.reshape(height, width, step)
    if kind == 3:
        return palette[x[..., 0]]
    return np.repeat(x[..., :1], 3, 2) if step < 3 else x[..., :3].copy()


def _unfiltered(how: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of a PNG file without its filter; those that look to the left go pixel by pixel."""
    if how == 0:
        return line
    if how == 2:
        return line + above
    if how == 1:
        return np.cumsum(line.reshape(-1, step), 0, dtype=np.uint8).ravel()
    out, up = line.tolist(), above.tolist()
    for i in range(len(out)):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if how == 3:
            guess = left + up[i] >> 1
        else:
            p = left + up[i] - corner
            a, b, c = abs(p - left), abs(p - up[i]), abs(p - corner)
            guess = left if a <= b and a <= c else up[i] if b <= c else corner
        out[i] = out[i] + guess & 255
    return np.array(out, np.uint8)


def _pixmap(data: bytes, most: int) -> np.ndarray:
    words, at = [], 2
    while len(words) < 3:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        words.append(int(data[at:end]))
        at = end
    width, height, top = words
    if top != 255 or width * height > most:
        raise ValueError("only pixmaps of 8 bits, and of no more pixels than fit")
    step = 3 if data[1:2] == b"6" else 1
    x = np.frombuffer(data, np.uint8, width * height * step, at + 1).reshape(height, width, step)
    return x.copy() if step == 3 else np.repeat(x, 3, 2)


def decode(data: bytes, most: int = MOST_PIXELS) -> np.ndarray:
    """height x width x 3 of a PNG, PGM or PPM file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data, most)
    if data[:2] in (b"P5", b"P6"):
        return _pixmap(data, most)
    raise ValueError("neither PNG nor a portable pixmap")


def read(path: str) -> np.ndarray:
    """A file's pixels; any name that the system knows will do."""
    with open(path, "rb") as f:
        return decode(f.read())


def grey(rgb: np.ndarray) -> np.ndarray:
    return np.round(rgb @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def clean(rgb: np.ndarray) -> np.ndarray:
    """Grey, without red stamps, straightened, with even contrast."""
    return px.equalised(px.deskewed(grey(px.without_red_stamp(rgb))))


def _each(df: DataFrame, key: str, content: str, most: int, make: Callable[[np.ndarray], list[tuple]], schema: str, none: tuple) -> DataFrame:
    """key and the rows that make gives for each image, with error; one image at a time."""
    kind, names = df.schema[key].dataType.simpleString(), [p.split()[0] for p in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(b.column(1)):
                error, rows = None, [none]
                if data.is_valid:
                    try:
                        rows = make(decode(data.as_py(), most))
                    except (ValueError, IndexError, TypeError, MemoryError, struct.error, zlib.error) as e:
                        error = f"{e}" or "damaged"
                cells = [pa.array([r[k] for r in rows], pa.binary() if names[k] == "pixels" else pa.int32()) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(rows), pa.int64())), *cells, pa.array([error] * len(rows), pa.string())], [key, *names, "error"])

    return df.select(key, content).mapInArrow(run, f"`{key}` {kind}, {schema}, error string")


def decoded(df: DataFrame, key: str, content: str, most: int = MOST_PIXELS) -> DataFrame:
    """key, width, height, pixels (bytes of red, green, blue), error; null pixels and an error for what can't be decoded, null both for null."""
    return _each(df, key, content, most, lambda x: [(x.shape[1], x.shape[0], x.tobytes())], "width int, height int, pixels binary", (None, None, None))


def cleaned(df: DataFrame, key: str, content: str, most: int = MOST_PIXELS) -> DataFrame:
    """key, width, height, pixels (grey bytes), error of pages that clean() has prepared for reading."""

    def make(x: np.ndarray) -> list[tuple]:
        y = clean(x)
        return [(y.shape[1], y.shape[0], y.tobytes())]

    return _each(df, key, content, most, make, "width int, height int, pixels binary", (None, None, None))


def cells(df: DataFrame, key: str, content: str, most: int = MOST_PIXELS) -> DataFrame:
    """key, x, y, w, h of the table cells of each page; pages without any, or that can't be decoded, have none."""
    found = _each(df, key, content, most, lambda x: px.table_cells(grey(px.without_red_stamp(x))), "x int, y int, w int, h int", (None,) * 4)
    return found.where(F.col("x").isNotNull()).drop("error")
