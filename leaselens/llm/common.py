"""Shared parts of the corpus operators: Spark helpers and vectorised text hashing.

A *word* is everywhere a maximal run of bytes other than ASCII white space
(space, tab, line feed, vertical tab, form feed, carriage return).
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^ \t\n\x0B\f\r]+"
U64 = np.uint64
SLICE_BYTES = 2 << 20
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


#: Bytes of an Arrow batch between Spark and Python: each task holds several copies of one.
ARROW_BYTES = 4 << 20


_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that long texts don't make large ones.

    Every operator calls it for the session of its input. The bound is the session's, as Spark has no other, and is
    taken when a plan runs; a session with a tighter one keeps it.
    """
    bound = spark.conf.get(_BATCH_SETTING).rstrip("b")
    if not bound.isdigit() or int(bound) > ARROW_BYTES:
        spark.conf.set(_BATCH_SETTING, str(ARROW_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """df, a scan, dealt to all cores where it has fewer splits than there are; it is small then."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    The cluster names it in spark.checkpoint.dir; a folder of our own is set
    only where the setting is absent on a local master, as in tests; elsewhere that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="leaselens-"))
    return sc.getCheckpointDir()


def give_back() -> None:
    """Returns memory that the process has freed to the system: Python workers stay for a while after a task, beside those of the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """A function from batches to batches that gives memory back at its end."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to shared_folder()."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, one for each of names."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null and for blank text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


#: Small sides of joins are broadcast up to that many rows; beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, computed once, to be broadcast if it has at most BROADCAST_ROWS rows."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def page_ids(url: Column) -> Column:
    """The document that a page's address names: the number that ends its path; null if there is none, or none that a bigint holds."""
    return F.nullif(F.regexp_extract(url, r"/([0-9]+)(?:\.html|/)?(?:[?#].*)?$", 1), F.lit("")).try_cast("bigint")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a Bloom filter: at least that many for each id, and at most that many in all (32 MB).
BLOOM_RATE, BLOOM_BITS = 16, 1 << 28


class Bloom:
    """A Bloom filter of the ids of a one-column table, to spare other rows a shuffle.

    Its size follows the number of ids up to BLOOM_BITS; beyond, it lets more rows pass
    and stays right, as what passes is joined. Slices of it are made apart, so that the driver gets
    each bit once.
    """

    SLICE = 20

    def __init__(self, ids: DataFrame) -> None:
        n = ids.count()
        self.bits = min(BLOOM_BITS, max(1 << 10, 1 << int(BLOOM_RATE * max(n, 1) - 1).bit_length()))
        places = ids.select(F.explode(F.array(*self._places(F.col(ids.columns[0])))).alias("place"))
        parts = places.groupBy(F.shiftright("place", self.SLICE).alias("part")).applyInArrow(self._slice, "part bigint, bits binary").collect()
        flat = np.zeros((self.bits + 7) // 8, np.uint8)
        for r in parts:
            at = r["part"] << (self.SLICE - 3)
            flat[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)[: len(flat) - at]
        self.flat = ids.sparkSession.sparkContext.broadcast(flat)

    def _places(self, id_: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(k), id_), F.lit(self.bits)).cast("bigint") for k in (3, 5)]

    @staticmethod
    def _slice(rows: pa.Table) -> pa.Table:
        place = np.unique(rows["place"].to_numpy())
        some = np.zeros(1 << Bloom.SLICE, np.uint8)
        some[place & ((1 << Bloom.SLICE) - 1)] = 1
        return pa.table({"part": [int(place[0]) >> Bloom.SLICE], "bits": pa.array([np.packbits(some, bitorder="little").tobytes()], pa.binary())})

    def may_hold(self, id_: Column) -> Column:
        """False only for ids that aren't among those of the filter; false for null."""
        flat = self.flat

        @F.arrow_udf("boolean")
        def test(a: pa.Array, b: pa.Array) -> pa.Array:
            held = np.ones(len(a), bool)
            for x in (a, b):
                p = x.to_numpy(zero_copy_only=False).astype(np.int64)
                held &= (flat.value[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
            return pa.array(held)

        return id_.isNotNull() & test(*self._places(id_))


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64."""
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd hash base and of its inverse, modulo 2^64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INV)):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def strings(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array without nulls (a null becomes empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.cast(pa.large_string()).fill_null("")


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array and the offsets of its rows, from 0."""
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(array: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about that many bytes, each with its first row; a longer text is a run alone."""
    _, at = raw(array)
    lo, n = 0, len(array)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, array.slice(lo, hi - lo)
        lo = hi


@dataclass
class Words:
    """The words of some texts in order: hash, row, first byte and end within the text; bounds of rows."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray


def words(array: pa.Array) -> Words:
    """Every word of every row of a large_string array without nulls.

    Hashes are polynomial, modulo 2^64, by prefix sums over pieces that end
    between words, and then mixed; memory beyond the words themselves is
    bounded by the piece, not by the longest text.
    """
    data, at = raw(array)
    n, lo = len(data), 0
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while lo < n:
        hi = min(n, lo + CHUNK_BYTES)
        if hi < n:
            back = np.flatnonzero(_SPACE[data[lo:hi]])
            if len(back):
                hi = lo + int(back[-1]) + 1
            else:  # a word longer than a piece
                while hi < n and not _SPACE[data[hi]]:
                    hi += 1
        space = _SPACE[data[lo:hi]]
        first, last = ~space, ~space
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        edges = at[np.searchsorted(at, lo) : np.searchsorted(at, hi, "right")] - lo
        inside = edges[(edges > 0) & (edges < hi - lo)]
        first[inside] |= ~space[inside]
        last[inside - 1] |= ~space[inside - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum(_BYTE[data[lo:hi]] * up[:-1], out=sums[1:])
        parts.append((mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64)), s + lo, e + lo))
        lo = hi
    h, s, e = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    row = np.searchsorted(at, s, "right") - 1
    return Words(h, row, s - at[row], e - at[row], np.searchsorted(row, np.arange(len(array) + 1)))


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams, with repeats, and bounds of rows; a row of 1 to n-1 words is one n-gram."""
    count = np.diff(w.bounds)
    total = len(w.hash)
    if not total:
        return np.zeros(0, U64), np.zeros(len(count) + 1, np.int64)
    up, _ = powers(n + 1)
    h = np.zeros(total, U64)
    for j in range(min(n, total)):
        h[: total - j] += w.hash[j:] * up[j]
    whole = np.arange(total) + n <= w.bounds[w.row + 1]
    short = (count > 0) & (count < n)
    if short.any():
        at = w.bounds[:-1][short]
        for j in range(n):
            has = count[short] > j
            if j == 0:
                h[at] = 0
            h[at[has]] += w.hash[at[has] + j] * up[j]
        whole[at] = True
    return mix(h[whole]), np.concatenate([[0], np.cumsum(np.where(short, 1, np.maximum(count - n + 1, 0)))])


def sorted_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in order, and their bounds."""
    values = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    keep[starts] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]
