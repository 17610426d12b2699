"""Lossless WebP media columns: a decoder to pixel arrays, and a small encoder for tests and synthetic media.

The decoder reads the whole bitstream of RFC 9649: prefix codes (simple and
normal, and groups of them by a meta image), back-references with their two-dimensional
short distances, the colour cache, and the inverse predictor, cross-colour, subtract-green
and palette transforms. Pixels are ARGB integers.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


def _near() -> list[tuple[int, int]]:
    """The 120 short distances as (left, up): by distance, then nearness to the column; above the pixel or to its left."""
    places = "01 10 11 -11 02 20 12 -12 21 -21 22 -22 03 30 13 -13 31 -31 23 -23 32 -32 04 40 14 -14 41 -41 33 -33 24 -24 42 -42 05 34 -34 43 -43 50 15 -15 51 -51 25 -25 52 -52 44 -44 35 -35 53 -53 06 60 16 -16 61 -61 26 -26 62 -62 45 -45 54 -54 36 -36 63 -63 07 70 17 -17 55 -55 71 -71 46 -46 64 -64 27 -27 72 -72 37 -37 73 -73 56 -56 65 -65 80 47 -47 74 -74 81 82 66 -66 83 57 -57 75 -75 84 67 -67 76 -76 85 77 -77 86 87"
    return [(int(p[:-1]), int(p[-1])) for p in places.split()]


NEAR = _near()
_NEAR = np.array(NEAR, np.int64)


class Bits:
    """Bits of a byte string, the lowest of each byte first; zeros after its end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        return out

    def ended(self) -> bool:
        """Whether more bits were taken than there are."""
        return self.at > 8 * len(self.data)


class Code:
    """A canonical prefix code, as tables over the next width bits: symbol and length; none are read for a code of one symbol."""

    def __init__(self, lengths: list[int]) -> None:
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        if len(used) < 2:
            self.width, self.symbol, self.length = 0, np.array([used[0][1] if used else 0], np.int32), np.zeros(1, np.int32)
            return
        self.width = max(n for n, _ in used)
        if sum(1 << (self.width - n) for n, _ in used) != 1 << self.width:
            raise ValueError("an incomplete prefix code")
        self.symbol, self.length = np.zeros(1 << self.width, np.int32), np.zeros(1 << self.width, np.int32)
        code, last = 0, used[0][0]
        for n, symbol in used:
            code <<= n - last
            last = n
            back = int(f"{code:0{n}b}"[::-1], 2)
            self.symbol[back :: 1 << n], self.length[back :: 1 << n] = symbol, n
            code += 1

    def read(self, bits: Bits) -> int:
        k = bits.peek(self.width)
        bits.at += int(self.length[k])
        return int(self.symbol[k])


def read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):  # one or two symbols
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    of_lengths = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        of_lengths[k] = bits.read(3)
    code, left = Code(of_lengths), size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, last = 0, 8
    while at < size and left:
        left -= 1
        k = code.read(bits)
        if k < 16:
            lengths[at] = k
            at += 1
            last = k or last
        else:
            n = 3 + bits.read(2) if k == 16 else 3 + bits.read(3) if k == 17 else 11 + bits.read(7)
            if at + n > size:
                raise ValueError("code lengths run over")
            lengths[at : at + n] = [last if k == 16 else 0] * n
            at += n
    return Code(lengths)


#: Bits of a stretch of data that is parsed at once, and the most bits that one pixel or copy takes.
STRETCH, LONGEST = 1 << 17, 128
#: Of an image of fewer pixels, predictions are undone one by one.
FEW_PIXELS = 1 << 12


def _numbers(words: np.ndarray, at: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances from their prefixes and the extra bits at these places, and the places after them."""
    extra = np.maximum(prefix - 2, 0) >> 1
    value = (words[at >> 3] >> (at & 7).astype(np.uint64)).astype(np.int64) & ((1 << extra) - 1)
    return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + value) + 1, at + extra


class Stretch:
    """What a group of five prefix codes reads from each bit of a stretch: symbols and where the next pixel or copy begins."""

    def __init__(self, words: np.ndarray, bits: int, codes: list[Code]) -> None:
        self.words, self.codes, self.last = words, codes, bits - 1
        shifted = np.empty((len(words), 8), np.uint32)
        for k in range(8):
            shifted[:, k] = words >> np.uint64(k) & np.uint64(0xFFFF)
        self.window = window = shifted.ravel()[:bits].astype(np.int32)
        green, red, blue, alpha, distance = codes
        here = np.arange(bits, dtype=np.int32)
        k = window & ((1 << green.width) - 1)
        at = here + green.length[k]
        end = np.minimum(at, self.last)
        for code in (red, blue, alpha):
            if code.width:
                end += code.length[window & ((1 << code.width) - 1)][end]
                np.minimum(end, self.last, out=end)
        pixels = None
        if (green.symbol >= 256).any():
            s = green.symbol[k]
            end = np.where(s >= 280, at, end)
            own = np.flatnonzero((s >= 256) & (s < 280))
            if len(own):
                pixels = np.ones(bits, np.int64)
                pixels[own], after = _numbers(words, np.minimum(at[own], self.last), s[own].astype(np.int64) - 256)
                prefix, after = self._read(distance, np.minimum(after, self.last))
                end[own] = _numbers(words, np.minimum(after, self.last), prefix.astype(np.int64))[1]
        self.next, self.pixels = memoryview(end), None if pixels is None else memoryview(pixels)

    def _read(self, code: Code, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(at, self.last)
        k = self.window[at] & ((1 << code.width) - 1)
        return code.symbol[k], at + code.length[k]

    def ops(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """At these bits: kind (0 a pixel, 1 a copy, 2 a place in the cache), value (ARGB, length or place) and distance."""
        green, red, blue, alpha, distance = self.codes
        s, at = self._read(green, starts)
        r, to = self._read(red, at)
        b, to = self._read(blue, to)
        a, _ = self._read(alpha, to)
        kind = np.where(s < 256, 0, np.where(s < 280, 1, 2)).astype(np.int8)
        value, far = a.astype(np.int64) << 24 | r.astype(np.int64) << 16 | s.astype(np.int64) << 8 | b, np.zeros(len(starts), np.int64)
        value[kind == 2] = s[kind == 2] - 280
        own = np.flatnonzero(kind == 1)
        if len(own):
            value[own], at = _numbers(self.words, at[own], s[own].astype(np.int64) - 256)
            prefix, at = self._read(distance, at)
            far[own] = _numbers(self.words, np.minimum(at, self.last), prefix.astype(np.int64))[0]
        return kind, value, far


def _parse(bits: Bits, total: int, codes: list[list[Code]], group_of: Callable[[int], int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kind, value and distance of the pixels and copies that make up total pixels.

    All bits of a stretch are looked up at once, as if a pixel began at each; then the chain of those
    that do is followed.
    """
    found: list[tuple] = []
    n = 0
    while n < total:
        if bits.ended():
            raise ValueError("the data ends early")
        first = bits.at >> 3
        raw = np.frombuffer(bits.data[first : first + (STRETCH + LONGEST >> 3) + 16], np.uint8)
        data = np.zeros(len(raw) + 24, np.uint64)
        data[: len(raw)] = raw
        words = data[:-7].copy()
        for k in range(1, 7):
            words |= data[k : len(data) - 7 + k] << np.uint64(8 * k)
        size = min(8 * (len(words) - 1), STRETCH + LONGEST)
        # few pixels need few bits: a pixel takes 60 at most
        size = min(size, (bits.at & 7) + 64 * (total - n) + LONGEST)
        stop = min(size - LONGEST, STRETCH)
        made: dict[int, Stretch] = {}
        p, end = bits.at & 7, 8 * len(raw)
        runs: list[tuple[int, list[int]]] = []
        while n < total and p < stop and p <= end:
            g = group_of(n) if group_of else 0
            if g not in made:
                made[g] = Stretch(words, size, codes[g])
            if not runs or runs[-1][0] != g:
                runs.append((g, []))
            mine, own, nexts = made[g], runs[-1][1], made[g].next
            pixels = mine.pixels
            if group_of is None and pixels is None:
                begin = len(own)
                while p < stop:
                    own.append(p)
                    p = nexts[p]
                    if len(own) - begin == total - n:
                        break
                n += len(own) - begin
            elif group_of is None:
                while n < total and p < stop:
                    own.append(p)
                    n += pixels[p]
                    p = nexts[p]
            else:
                own.append(p)
                n += 1 if pixels is None else pixels[p]
                p = nexts[p]
        for g, starts in runs:
            found.append(made[g].ops(np.array(starts, np.int64)))
        bits.at = 8 * first + p
        if p > end:
            raise ValueError("the data ends early")
    kind, value, far = (np.concatenate(x) for x in zip(*found))
    return kind, value, far


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image: colour cache, groups of five prefix codes (of main images, by block), pixels."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of more than 11 bits")
    group_of, groups = None, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        columns = (width + (1 << block) - 1) >> block
        meta = (read_pixels(bits, columns, (height + (1 << block) - 1) >> block, False) >> 8 & 0xFFFF).astype(int).tolist()
        groups = max(meta) + 1
        group_of = (lambda n: meta[(n // width >> block) * columns + (n % width >> block)]) if groups > 1 else None
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(bits, s) for s in sizes] for _ in range(groups)]
    total = width * height
    kind, value, far = _parse(bits, total, codes, group_of)
    size = np.where(kind == 1, value, 1)
    at = np.cumsum(size) - size
    if at[-1] + size[-1] != total:
        raise ValueError("a copy runs over the image")
    own = np.flatnonzero(kind == 1)
    if len(own):
        near = far[own] <= 120
        left, up = _NEAR[np.minimum(far[own], 120) - 1].T
        far[own] = np.where(near, np.maximum(1, left + up * width), far[own] - 120)
        if (far[own] > at[own]).any():
            raise ValueError("a back-reference out of the image")
    if cache_bits and (kind == 2).any():
        return _with_cache(kind, value, far, total, cache_bits)
    out = np.zeros(total, np.uint32)
    plain = kind == 0
    out[at[plain]] = value[plain]
    for p, n, d in zip(at[own].tolist(), value[own].tolist(), far[own].tolist()):
        if d >= n:
            out[p : p + n] = out[p - d : p - d + n]
        else:
            out[p : p + n] = np.resize(out[p - d : p], n)
    return out


def _with_cache(kind: np.ndarray, value: np.ndarray, far: np.ndarray, total: int, cache_bits: int) -> np.ndarray:
    """Pixels of an image that uses its colour cache, one after the other."""
    out: list[int] = []
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    for k, v, d in zip(kind.tolist(), value.tolist(), far.tolist()):
        if k == 1:
            new = (out[-d:] * (v // d + 1))[:v]
            out += new
            for p in new:
                cache[(HASH * p & 0xFFFFFFFF) >> shift] = p
        else:
            p = v if k == 0 else cache[v]
            out.append(p)
            cache[(HASH * p & 0xFFFFFFFF) >> shift] = p
    return np.array(out, np.uint32)


def _parts(x: np.ndarray) -> np.ndarray:
    """Alpha, red, green and blue of pixels, as signed numbers."""
    x = np.asarray(x, np.uint32)
    return np.stack([x >> 24, x >> 16 & 255, x >> 8 & 255, x & 255], -1).astype(np.int64)


def _joined(p: np.ndarray) -> np.ndarray:
    p = p & 255
    return (p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]).astype(np.uint32)


def predicted(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Predictions of pixels (rows of four channels) from their neighbours to the left, above, above right and above left."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return ((left + right >> 1) + top) >> 1
    if mode == 6:
        return left + corner >> 1
    if mode == 7:
        return left + top >> 1
    if mode == 8:
        return corner + top >> 1
    if mode == 9:
        return top + right >> 1
    if mode == 10:
        return ((left + corner >> 1) + (top + right >> 1)) >> 1
    if mode == 11:
        nearer = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = left + top >> 1
        half = mean - corner
        return np.clip(mean + (half + (half < 0) >> 1), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0]), left.shape)


def predictor(x: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray, inverse: bool) -> np.ndarray:
    """Adds each pixel's prediction, or (forward) takes it off.

    The first row is predicted from the left, the first column from above. Pixels whose
    column plus twice their row is equal don't need each other: they are undone together, or, in a small image, one by one.
    """
    given = _parts(x)
    columns = (width + (1 << bits) - 1) >> bits
    kinds = np.asarray(modes).astype(np.int64) >> 8 & 15
    done = given.copy()
    if inverse:
        done[0, 0] += 255
        done[:width] = np.cumsum(done[:width], 0) & 255
        done[::width] = np.cumsum(done[::width], 0) & 255
    at = np.arange(width * height).reshape(height, width)[1:, 1:].ravel()
    row, column = np.divmod(at, width)
    kind = kinds[(row >> bits) * columns + (column >> bits)]

    def guess(mode: int, i: np.ndarray) -> np.ndarray:
        return predicted(mode, done[i - 1], done[i - width], done[i - width + 1], done[i - width - 1])

    if not inverse:
        out = given.copy()
        out[0, 0] -= 255
        out[1:width] -= given[: width - 1]
        out[width::width] -= given[:-width:width]
        for mode in np.unique(kind).tolist():
            i = at[kind == mode]
            out[i] -= guess(mode, i)
        return _joined(out)
    if width * height < FEW_PIXELS:
        _undo_one_by_one(done, width, at.tolist(), kind.tolist())
        return _joined(done)
    order = np.lexsort((kind, column + 2 * row))
    at, kind, wave = at[order], kind[order], (column + 2 * row)[order]
    cut = np.flatnonzero(np.concatenate([[True], (wave[1:] != wave[:-1]) | (kind[1:] != kind[:-1]), [True]])) if len(at) else np.zeros(1, np.int64)
    for mode, lo, hi in zip(kind[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist()):
        i = at[lo:hi]
        done[i] = (done[i] + guess(mode, i)) & 255
    return _joined(done)


def _undo_one_by_one(done: np.ndarray, width: int, at: list[int], kind: list[int]) -> None:
    """Undoes the predictions of pixels in order, on plain numbers."""
    planes = done.T.tolist()
    for i, mode in zip(at, kind):
        if mode == 11:
            away = [abs(p[i - width] - p[i - width - 1]) - abs(p[i - 1] - p[i - width - 1]) for p in planes]
            mode = 1 if sum(away) < 0 else 2
        for c, p in enumerate(planes):
            left, top, corner = p[i - 1], p[i - width], p[i - width - 1]
            if mode == 1:
                g = left
            elif mode == 2:
                g = top
            elif mode == 3:
                g = p[i - width + 1]
            elif mode == 4:
                g = corner
            elif mode == 5:
                g = ((left + p[i - width + 1] >> 1) + top) >> 1
            elif mode == 6:
                g = left + corner >> 1
            elif mode == 7:
                g = left + top >> 1
            elif mode == 8:
                g = corner + top >> 1
            elif mode == 9:
                g = top + p[i - width + 1] >> 1
            elif mode == 10:
                g = ((left + corner >> 1) + (top + p[i - width + 1] >> 1)) >> 1
            elif mode == 12:
                g = min(max(left + top - corner, 0), 255)
            elif mode == 13:
                mean = left + top >> 1
                g = min(max(mean + int((mean - corner) / 2), 0), 255)
            else:
                g = 255 if c == 0 else 0
            p[i] = p[i] + g & 255
    done[:] = np.array(planes).T


def cross_colour(x: np.ndarray, width: int, height: int, bits: int, elements: np.ndarray, inverse: bool) -> np.ndarray:
    """Adds to red and blue what green and red say of them, or (forward) takes it off."""
    p = _parts(x)
    row, column = np.divmod(np.arange(width * height), width)
    e = np.asarray(elements, np.uint32)[(row >> bits) * ((width + (1 << bits) - 1) >> bits) + (column >> bits)]
    signed = lambda v: (np.asarray(v, np.int64) & 255 ^ 128) - 128
    delta = lambda t, c: signed(t) * signed(c) >> 5
    sign = 1 if inverse else -1
    red = p[:, 1] + sign * delta(e, p[:, 2])
    blue = p[:, 3] + sign * delta(e >> 8, p[:, 2]) + sign * delta(e >> 16, red if inverse else p[:, 1])
    return _joined(np.column_stack([p[:, 0], red, p[:, 2], blue]))


def subtract_green(x: np.ndarray, inverse: bool) -> np.ndarray:
    p = _parts(x)
    green = p[:, 2] if inverse else -p[:, 2]
    return _joined(np.column_stack([p[:, 0], p[:, 1] + green, p[:, 2], p[:, 3] + green]))


def palette_bits(colours: int) -> int:
    """log2 of the pixels in a byte."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unpack_palette(x: np.ndarray, width: int, height: int, colours: np.ndarray) -> np.ndarray:
    """Pixels of indexes; an index beyond the colours is transparent black."""
    bits = palette_bits(len(colours))
    packed = (np.asarray(x, np.uint32) >> 8 & 255).reshape(height, -1)
    column = np.arange(width)
    each = 8 >> bits
    index = packed[:, column >> bits] >> ((column & ((1 << bits) - 1)) * each).astype(np.uint32) & np.uint32((1 << each) - 1)
    return np.append(colours, np.zeros(256, np.uint32))[index].ravel().astype(np.uint32)


def chunk(data: bytes) -> bytes:
    """The VP8L chunk of a WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack("<I", data[at + 4 : at + 8])[0]
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no lossless image")


def decode(data: bytes, most: int = 1 << 28) -> tuple[int, int, np.ndarray]:
    """Width, height and ARGB pixels (uint32, row by row) of a lossless WebP file of no more than so many pixels."""
    body = chunk(data)
    if body[:1] != b"\x2f":
        raise ValueError("not a lossless image")
    bits = Bits(body[1:])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    if width * height > most:
        raise ValueError(f"{width} x {height} pixels are more than {most}")
    bits.read(1)  # whether alpha is used: a hint
    if bits.read(3):
        raise ValueError("an unknown version")
    undo: list[Callable[[np.ndarray], np.ndarray]] = []
    seen: set[int] = set()
    inner = width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            blocks = read_pixels(bits, (inner + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size, False)
            f = predictor if kind == PREDICTOR else cross_colour
            undo.append(lambda x, f=f, w=inner, b=size, e=blocks: f(x, w, height, b, e, True))
        elif kind == SUBTRACT_GREEN:
            undo.append(lambda x: subtract_green(x, True))
        else:
            n = bits.read(8) + 1
            colours = _joined(np.cumsum(_parts(read_pixels(bits, n, 1, False)), 0))
            undo.append(lambda x, w=inner, c=colours: unpack_palette(x, w, height, c))
            inner = (inner + (1 << palette_bits(n)) - 1) >> palette_bits(n)
    x = read_pixels(bits, inner, height, True)
    for f in reversed(undo):
        x = f(x)
    return width, height, x


class Writer:
    def __init__(self) -> None:
        self.value, self.have, self.out = 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.have
        self.have += n
        if self.have >= 512:
            self.out += (self.value & ((1 << 512) - 1)).to_bytes(64, "little")
            self.value >>= 512
            self.have -= 512

    def bytes(self) -> bytes:
        return bytes(self.out) + self.value.to_bytes((self.have + 7) // 8, "little")


def _depths(counts: list[int], most: int) -> list[int]:
    """Lengths of a prefix code for symbols of these counts; counts are levelled until none is longer than most."""
    used = [(c, s) for s, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) < 2:
        for _, s in used:
            out[s] = 1
        return out
    while True:
        heap = [(c, i, [s]) for i, (c, s) in enumerate(used)]
        heapq.heapify(heap)
        depth, k = dict.fromkeys((s for _, s in used), 0), len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            k += 1
            heapq.heappush(heap, (a[0] + b[0], k, a[2] + b[2]))
        if max(depth.values()) <= most:
            for s, n in depth.items():
                out[s] = n
            return out
        used = [((c + 1) // 2, s) for c, s in used]


def _codes(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (its code with the first bit lowest, length)."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) < 2:
        return {s: (0, 0) for _, s in used}
    out, code, last = {}, 0, used[0][0]
    for n, s in used:
        code <<= n - last
        last = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return out


def _write_code(w: Writer, counts: list[int]) -> dict[int, tuple[int, int]]:
    used = [s for s, c in enumerate(counts) if c]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.put(1, 1), w.put(len(used) - 1, 1)
        w.put(int(used[0] > 1), 1), w.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return _codes([int(s in used) for s in range(len(counts))])
    lengths = _depths(counts, 15)
    items, i = [], 0  # (symbol, extra, its bits)
    while i < len(lengths):
        run = 1
        while i + run < len(lengths) and lengths[i + run] == lengths[i]:
            run += 1
        if lengths[i] == 0 and run >= 3:
            run = min(run, 138)
            items.append((18, run - 11, 7) if run >= 11 else (17, run - 3, 3))
        elif lengths[i] and run >= 4:
            run = min(run, 7)
            items += [(lengths[i], 0, 0), (16, run - 4, 2)]
        else:
            run = 1
            items.append((lengths[i], 0, 0))
        i += run
    of = [0] * 19
    for s, _, _ in items:
        of[s] += 1
    of_lengths = _depths(of, 7)
    w.put(0, 1), w.put(15, 4)
    for k in LENGTH_ORDER:
        w.put(of_lengths[k], 3)
    w.put(0, 1)
    own = _codes(of_lengths)
    for s, extra, n in items:
        w.put(*own[s]), w.put(extra, n)
    return _codes(lengths)


def _prefix(n: int) -> tuple[int, int, int]:
    """Prefix, extra value and its bits of a length or distance from 1."""
    n -= 1
    if n < 4:
        return n, 0, 0
    high = n.bit_length() - 1
    second = n >> (high - 1) & 1
    return 2 * high + second, n & ((1 << (high - 1)) - 1), high - 1


def _write_pixels(w: Writer, x: list[int], width: int, main: bool, cache_bits: int = 0, references: bool = False, block: int = 0) -> None:
    """An entropy-coded image; with block, rows of blocks take turns at two groups of prefix codes."""
    shift, cache = 32 - cache_bits, [None] * (1 << cache_bits)
    ops, seen, i = [], {}, 0
    while i < len(x):
        op = None
        if references and i + 3 <= len(x):
            key = tuple(x[i : i + 3])
            j = seen.get(key)
            seen[key] = i
            if j is not None:
                n = 3
                while i + n < len(x) and n < 4096 and x[j + n] == x[i + n]:
                    n += 1
                op = ("copy", n, i - j)
        at = (HASH * x[i] & 0xFFFFFFFF) >> shift if cache_bits else 0
        if op is None:
            op = ("cache", at) if cache_bits and cache[at] == x[i] else ("pixel", x[i])
        n = op[1] if op[0] == "copy" else 1
        ops.append((i, op))
        if cache_bits:
            for p in x[i : i + n]:
                cache[(HASH * p & 0xFFFFFFFF) >> shift] = p
        i += n
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups = 1
    if main:
        w.put(int(block > 0), 1)
        if block:
            w.put(block - 2, 3)
            columns, rows = (width + (1 << block) - 1) >> block, (len(x) // width + (1 << block) - 1) >> block
            groups = min(rows, 2)
            _write_pixels(w, [(b // columns % 2) << 8 for b in range(columns * rows)], columns, False)
    nearest = {max(1, a + b * width): k + 1 for k, (a, b) in reversed(list(enumerate(NEAR)))}
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[[0] * s for s in sizes] for _ in range(groups)]
    out: list[tuple[int, list[tuple]]] = []
    for i, op in ops:
        g = (i // width >> block) % groups
        if op[0] == "pixel":
            p = op[1]
            parts = [(0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)]
        elif op[0] == "cache":
            parts = [(0, 280 + op[1], 0, 0)]
        else:
            a, b = _prefix(op[1]), _prefix(nearest.get(op[2], op[2] + 120))
            parts = [(0, 256 + a[0], a[1], a[2]), (4, b[0], b[1], b[2])]
        out.append((g, parts))
        for k, s, _, _ in parts:
            counts[g][k][s] += 1
    codes = [[_write_code(w, c) for c in group] for group in counts]
    for g, parts in out:
        for k, s, extra, n in parts:
            w.put(*codes[g][k][s]), w.put(extra, n)


@dataclass(frozen=True)
class Options:
    """What an encoded image uses; palette needs 256 colours at most."""

    predictor: int | None = None
    cross_colour: int | None = None
    subtract_green: bool = False
    palette: bool = False
    cache_bits: int = 0
    references: bool = False
    block: int = 0
    size_bits: int = 2


def encode(x: np.ndarray, width: int, height: int, o: Options = Options()) -> bytes:
    """A lossless WebP file of ARGB pixels."""
    x = np.asarray(x, np.uint32)
    w = Writer()
    w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
    inner = width
    if o.palette:
        colours = np.unique(x)
        w.put(1, 1), w.put(PALETTE, 2), w.put(len(colours) - 1, 8)
        parts = _parts(colours)
        _write_pixels(w, _joined(np.diff(parts, axis=0, prepend=0)).tolist(), len(colours), False)
        bits = palette_bits(len(colours))
        index = np.searchsorted(colours, x).reshape(height, width)
        inner = (width + (1 << bits) - 1) >> bits
        index = np.pad(index, ((0, 0), (0, inner * (1 << bits) - width))).reshape(height, inner, 1 << bits)
        packed = (index << (np.arange(1 << bits) * (8 >> bits))).sum(2)
        x = (0xFF000000 | packed.ravel() << 8).astype(np.uint32)
    blocks = ((inner + (1 << o.size_bits) - 1) >> o.size_bits) * ((height + (1 << o.size_bits) - 1) >> o.size_bits)
    if o.predictor is not None:
        modes = ((np.arange(blocks) + o.predictor) % 14 << 8).astype(np.uint32)
        w.put(1, 1), w.put(PREDICTOR, 2), w.put(o.size_bits - 2, 3)
        _write_pixels(w, modes.tolist(), (inner + (1 << o.size_bits) - 1) >> o.size_bits, False)
        x = predictor(x, inner, height, o.size_bits, modes, False)
    if o.cross_colour is not None:
        elements = (np.arange(blocks, dtype=np.uint32) * np.uint32(0x010307) + np.uint32(o.cross_colour)) & np.uint32(0xFFFFFF)
        w.put(1, 1), w.put(CROSS_COLOUR, 2), w.put(o.size_bits - 2, 3)
        _write_pixels(w, elements.tolist(), (inner + (1 << o.size_bits) - 1) >> o.size_bits, False)
        x = cross_colour(x, inner, height, o.size_bits, elements, False)
    if o.subtract_green:
        w.put(1, 1), w.put(SUBTRACT_GREEN, 2)
        x = subtract_green(x, False)
    w.put(0, 1)
    _write_pixels(w, x.tolist(), inner, True, o.cache_bits, o.references, o.block)
    body = b"\x2f" + w.bytes()
    padded = body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + padded


#: The ways in which synthetic media are encoded, by turns.
WAYS = (
    Options(cache_bits=4, references=True), Options(predictor=0, subtract_green=True), Options(cross_colour=0x2040E0, block=2),
    Options(palette=True, predictor=5), Options(predictor=11, cross_colour=0x7F8001, subtract_green=True, cache_bits=1, references=True),
)


#: Pixels of a batch of decoded images, and of one image at most (its row then has 256 MB).
BATCH_PIXELS, MOST_PIXELS = 1 << 20, 1 << 26


def decode_column(df: DataFrame, key: str, media: str, most: int = MOST_PIXELS) -> DataFrame:
    """key, width, height, pixels (array of ARGB, as signed 32-bit numbers), error for each row's file.

    A null, damaged or other file has null width, height and pixels, and error says
    why (null for a null file and for a good one). So has an animation, whose frames aren't one image, and an image
    of more than most pixels, as a few bytes may declare any size: a setting, as what fits depends on the executors. Batches are given on by their
    pixels, not by their files. Repeated rows and null keys come out one by
    one; other columns don't matter. An empty table gives no rows.
    """
    small_batches(df.sparkSession)

    def batch(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        w, h, x, error = zip(*rows)
        ends = np.cumsum([0, *(0 if p is None else len(p) for p in x)]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int32), *(p.view(np.int32) for p in x if p is not None)])
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([p is None for p in x]))
        return pa.RecordBatch.from_arrays([keys, pa.array(w, pa.int32()), pa.array(h, pa.int32()), lists, pa.array(error, pa.string())], [key, "width", "height", "pixels", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            first = held = 0
            for i, data in enumerate(b.column(1)):
                try:
                    out.append((None, None, None, None) if not data.is_valid else (*decode(data.as_py(), most), None))
                except (ValueError, IndexError, OverflowError, MemoryError, struct.error) as e:
                    out.append((None, None, None, f"{e}" or "damaged"))
                held += 0 if out[-1][2] is None else len(out[-1][2])
                if held >= BATCH_PIXELS or i + 1 == b.num_rows:
                    yield batch(b.column(0).slice(first, len(out)), out)
                    out, first, held = [], i + 1, 0

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, media).mapInArrow(run, f"`{key}` {kind}, width int, height int, pixels array<int>, error string")


def vector_media(vectors: DataFrame, columns: int = 8) -> DataFrame:
    """vec_id, image: each vector as a WebP file whose pixels are the bits of its floats, in rows of that many.

    The tables hold no image files; this makes media whose pixels are known. A null or empty vector has a null image.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                files = []
                for i, v in zip(b.column(0).slice(lo, 256).to_pylist(), b.column(1).slice(lo, 256).to_pylist()):
                    x = np.array([0 if f is None else f for f in v or ()], np.float32).view(np.uint32)
                    height = -(-len(x) // columns)
                    files.append(encode(np.pad(x, (0, height * columns - len(x))), columns, height, WAYS[(i or 0) % len(WAYS)]) if len(x) else None)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 256), pa.array(files, pa.binary())], ["vec_id", "image"])

    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, "vec_id bigint, image binary")


def op5_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_column(vector_media(table(spark, sf_dir, "embeddings")), "vec_id", "image")


QUERIES = {"op5_lossless_webp": op5_lossless_webp}
#: The bits of each float by arithmetic: sign, exponent and fraction.
SQL = {
    "op5_lossless_webp": """
WITH v AS (SELECT vec_id, embedding, len(embedding) AS n, CAST(ceil(len(embedding) / 8) AS INT) AS height FROM embeddings),
f AS (SELECT vec_id, list_transform(list_concat(embedding, list_transform(range(0, height * 8 - n), lambda i: 0)), lambda x: {'x': abs(coalesce(x, 0)::DOUBLE), 's': coalesce(x, 0) < 0}) AS f, height FROM v WHERE n > 0),
e AS (SELECT vec_id, height, list_transform(f, lambda y: {'x': y.x, 's': y.s, 'e': CASE WHEN y.x < pow(2, -126) THEN -127 ELSE floor(log2(y.x)) - CASE WHEN pow(2, floor(log2(y.x))) > y.x THEN 1 ELSE 0 END END}) AS f FROM f)
SELECT v.vec_id, CASE WHEN f IS NULL THEN NULL ELSE 8 END AS width, e.height, list_transform(f, lambda y: CAST(CASE WHEN y.s THEN -2147483648 ELSE 0 END + (y.e + 127) * 8388608
         + CASE WHEN y.e = -127 THEN y.x * pow(2, 149) ELSE (y.x / pow(2, y.e) - 1) * 8388608 END AS INT)) AS pixels, NULL::VARCHAR AS error FROM v LEFT JOIN e USING (vec_id)
"""
}
