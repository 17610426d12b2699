"""Suffix-array dedup of passages of MIN_WORDS words or more that documents share.

Anchors bring equal passages together: of every MIN_WORDS consecutive words, the
first k-gram of least hash is one, so equal windows have equal anchors. Only
windows whose anchor occurs in several documents go on. Where they meet, their
suffixes are sorted by merging runs; two suffixes are compared by a binary search
for their common extension over prefix polynomial hashes, in a number of steps
that is logarithmic in their length. Neighbours with a common extension of
MIN_WORDS are equal windows, which is then verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, mix, partitions, powers, slices, strings, table, words

MIN_WORDS = 50
ANCHOR_WORDS = 25
ROWS = 20_000


def prefix_hashes(h: np.ndarray) -> np.ndarray:
    """Sums of h[i] base^i before each place, modulo 2^64."""
    out = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(len(h) + 1)[0][: len(h)], out=out[1:])
    return out


def anchors(w, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: row, first and last window, place and k-gram hash of the anchor; places count within rows."""
    n, width = len(w.hash), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, np.zeros(0, U64)
    sums = prefix_hashes(w.hash)
    g = mix((sums[k:] - sums[:-k]) * powers(n + 1)[1][: n - k + 1])
    least, span = np.arange(len(g)), 1
    while span < width:
        step = min(span, width - span)
        a, b = least[: len(least) - step], least[step:]
        least, span = np.where(g[b] < g[a], b, a), span + step
    start = np.flatnonzero(np.arange(n - length + 1) + length <= w.bounds[w.row[: n - length + 1] + 1])
    if not len(start):
        return none, none, none, none, np.zeros(0, U64)
    at, row = least[start], w.row[start]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    end = np.append(new[1:], len(start)) - 1
    base = w.bounds[row[new]]
    return row[new], start[new] - base, start[end] - base, at[new] - base, g[at[new]]


def _anchor_rows(length: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, part in slices(strings(b.column(1))):
                row, _, _, _, g = anchors(words(part), length, k)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), b.column(0).slice(lo, len(part)).take(pa.array(row))], ["anchor", "doc_id"])

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups of a partition that is sorted by its first column."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            b = batch.slice(lo, rows)
            held.append(b)
            count += b.num_rows
            if count < rows or held[0].column(0)[0] == b.column(0)[-1]:
                continue
            x = pa.Table.from_batches(held).combine_chunks()
            key = x.column(0).to_numpy()
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
            yield x.slice(0, cut).combine_chunks()
            held = x.slice(cut).to_batches()
            count = len(x) - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _in_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (anchor, doc_id) sorted so, each once, those whose anchor is in two documents or more."""
    for x in whole_groups(batches, 500_000):
        a, d = x.column(0).to_numpy(), x.column(1).to_numpy()
        once = np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
        a, d = a[once], d[once]
        same = a[1:] == a[:-1]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        yield pa.RecordBatch.from_arrays([pa.array(a[many]), pa.array(d[many])], ["anchor", "doc_id"])


def _fragments(length: int, k: int) -> Callable:
    """Rows (anchor, doc_id, start, lead, windows, words) of each run of windows: lead words before the anchor, all words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, part in slices(strings(b.column(1))):
                texts = [b" ".join(x.as_py().encode().split()) for x in part]
                w = words(strings(pa.array(texts, pa.binary()).cast(pa.string())))
                row, first, last, at, g = anchors(w, length, k)
                out = []
                for i, mine in enumerate(b.column(2).slice(lo, len(part))):
                    a, z = np.searchsorted(row, [i, i + 1])
                    out.append(a + np.flatnonzero(np.isin(g[a:z].view(np.int64), mine.values.to_numpy())))
                sel = np.concatenate(out) if out else np.zeros(0, np.int64)
                base = w.bounds[row[sel]]
                s, e = w.start[base + first[sel]].tolist(), w.end[base + last[sel] + length - 1].tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(g[sel].view(np.int64)), b.column(0).slice(lo, len(part)).take(pa.array(row[sel])), pa.array(first[sel]), pa.array((at - first)[sel].astype(np.int32)),
                    pa.array((last - first)[sel].astype(np.int32) + 1), pa.array([texts[r][p:q] for r, p, q in zip(row[sel].tolist(), s, e)], pa.binary()).cast(pa.string()),
                ], ["anchor", "doc_id", "start", "lead", "windows", "words"])

    return run


class Suffixes:
    """Suffixes of a sequence of hashed words: places and the words that follow each."""

    def __init__(self, h: np.ndarray) -> None:
        self.h = h
        self.sums = prefix_hashes(h)
        self.down = powers(len(h) + 1)[1]

    def extension(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The number of words, up to most, that suffixes x and y have in common: a binary search over prefix hashes."""
        lo, hi = np.zeros(len(x), np.int64), most.copy()
        dx, dy, sx, sy = self.down[x], self.down[y], self.sums[x], self.sums[y]
        for _ in range(int(most.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = (self.sums[x + mid] - sx) * dx == (self.sums[y + mid] - sy) * dy
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix x of nx words comes before y of ny, or is equal where that counts."""
        most = np.minimum(nx, ny)
        ext = self.extension(x, y, most)
        ended = ext >= most
        at = np.where(ended, 0, ext)
        return np.where(ended, (nx < ny) | (or_equal & (nx == ny)), self.h[x + at] < self.h[y + at])

    def sort(self, place: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The order of suffixes within each group (equal numbers side by side): a stable mergesort, all its merges of a width at once."""
        order = np.arange(len(place))
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(group)))
        begin, count = np.repeat(first, count), np.repeat(count, count)
        width = 1
        while True:
            active = np.flatnonzero(count > width)
            if not len(active):
                return order
            base, n = begin[active], count[active]
            at = active - base
            run = at // width
            left = run % 2 == 0
            pair = (run - run % 2) * width
            other = np.where(left, pair + width, pair)
            lo = np.zeros(len(active), np.int64)
            hi = np.clip(n - other, 0, width)
            mine = order[active]
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) >> 1
                theirs = order[base[open_] + other[open_] + mid]
                me = mine[open_]
                before = self.less(place[theirs], place[me], size[theirs], size[me], ~left[open_])
                lo[open_], hi[open_] = np.where(before, mid + 1, lo[open_]), np.where(before, hi[open_], mid)
            to = base + pair + (at - run * width) + lo
            order = order.copy()
            order[to] = mine
            width *= 2


def equal_windows(x: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of fragments in whole groups of an anchor: fragment and place of each window, and its class; equal windows share a class."""
    part = strings(x["words"])
    w = words(part)
    windows = x["windows"].to_numpy().astype(np.int64)
    frag = np.repeat(np.arange(len(x)), windows)
    j = np.arange(len(frag)) - np.repeat(np.cumsum(windows) - windows, windows)
    key = x["anchor"].to_numpy()
    anchor = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))[frag]
    shift = x["lead"].to_numpy()[frag] - j + 2 * length
    by = np.lexsort((frag, shift, anchor))
    frag, j, group = frag[by], j[by], (anchor * (4 * length) + shift)[by]
    place, size = w.bounds[frag] + j, np.diff(w.bounds)[frag] - j
    s = Suffixes(w.hash)
    order = s.sort(place, size, group)
    frag, j, place, size = frag[order], j[order], place[order], size[order]
    same = np.zeros(len(frag), bool)
    near = np.flatnonzero(group[1:] == group[:-1])
    same[near + 1] = s.extension(place[near], place[near + 1], np.minimum(size[near], size[near + 1])) >= length
    return frag, j, _verify(part, w, frag, place, same, length)


def _verify(part: pa.Array, w, frag: np.ndarray, place: np.ndarray, same: np.ndarray, length: int) -> np.ndarray:
    """Classes of neighbours that are the same; each pair of fragments is compared byte by byte over all that they are to share."""
    y = np.flatnonzero(same)
    if len(y):
        a, b = frag[y - 1], frag[y]
        order = np.lexsort((place[y], b, a))
        a, b, y = a[order], b[order], y[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        last = np.append(new[1:], len(y)) - 1
        texts = [t.as_py().encode() for t in part]
        for lo, hi, p, q, u, v in zip(new.tolist(), last.tolist(), (place[y - 1])[new].tolist(), (place[y - 1])[last].tolist(), place[y][new].tolist(), place[y][last].tolist()):
            f, g = texts[a[lo]], texts[b[lo]]
            if f[w.start[p] : w.end[q + length - 1]] != g[w.start[u] : w.end[v + length - 1]]:
                for i in y[lo : hi + 1].tolist():
                    p, u = place[i - 1], place[i]
                    same[i] = f[w.start[p] : w.end[p + length - 1]] == g[w.start[u] : w.end[u + length - 1]]
    return np.cumsum(~same)


def _spans(length: int) -> Callable:
    """Rows (doc_id, duplicate, start, end, first_doc_id) of windows that several documents have, joined within a fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in whole_groups(batches, ROWS):
            frag, j, kind = equal_windows(x, length)
            doc = x["doc_id"].to_numpy()[frag]
            start = x["start"].to_numpy()[frag] + j
            order = np.lexsort((start, doc, kind))
            frag, doc, start, kind = frag[order], doc[order], start[order], kind[order]
            first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
            count = np.diff(np.append(first, len(kind)))
            lead, last = np.repeat(first, count), np.repeat(first + count - 1, count)
            several = doc[lead] != doc[last]
            dup = (doc != doc[lead]) | (start != start[lead])
            frag, doc, start, dup, of = frag[several], doc[several], start[several], dup[several], doc[lead][several]
            order = np.lexsort((start, of, dup, frag))
            frag, doc, start, dup, of = frag[order], doc[order], start[order], dup[order], of[order]
            if len(doc):
                new = np.flatnonzero(np.concatenate([[True], (frag[1:] != frag[:-1]) | (dup[1:] != dup[:-1]) | (of[1:] != of[:-1]) | (start[1:] > start[:-1] + 1)]))
                end = start[np.append(new[1:], len(doc)) - 1] + length
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (doc[new], dup[new], start[new], end, of[new])], ["doc_id", "duplicate", "start", "end", "first_doc_id"])

    return run


def repeated_passages(docs: DataFrame, length: int = MIN_WORDS, k: int = ANCHOR_WORDS) -> DataFrame:
    """doc_id, duplicate, start_word, n_words, first_doc_id: passages made of windows of length words that two documents or more have.

    Of equal windows, the one of the least (doc_id, place) is the first, the others
    are duplicates; overlapping or touching windows of a document that are alike
    in this make one passage. first_doc_id is the least document that has the
    first of any of its windows. Words are compared byte by byte, white space between them
    doesn't matter, and places count words from 0. A repeat within one document
    only is no finding. Rows without doc_id or text, and texts of fewer words, have
    none; rows that repeat a doc_id are one document. Whole texts are searched,
    however long. An empty table gives no rows.
    """
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = partitions(docs)
    rows = own.mapInArrow(_anchor_rows(length, k), "anchor bigint, doc_id bigint").repartition(parts, "anchor").sortWithinPartitions("anchor", "doc_id")
    shared = rows.mapInArrow(_in_several, "anchor bigint, doc_id bigint").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    fragments = own.join(shared, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_fragments(length, k), "anchor bigint, doc_id bigint, start bigint, lead int, windows int, words string")
    spans = fragments.repartition(parts, "anchor").sortWithinPartitions("anchor", "doc_id", "start").mapInArrow(_spans(length), "doc_id bigint, duplicate boolean, start bigint, end bigint, first_doc_id bigint")
    mine = Window.partitionBy("doc_id", "duplicate").orderBy("start", "end")
    x = spans.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(mine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    x = x.withColumn("island", F.sum("new").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.groupBy("doc_id", "duplicate", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end"), F.min("first_doc_id").alias("first_doc_id"))
    return x.select("doc_id", "duplicate", "start_word", (F.col("end") - F.col("start_word")).alias("n_words"), "first_doc_id")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
SQL = {
    "op7_suffix_dedup": """
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM w WHERE len(w) >= 50),
k AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS k FROM p),
s AS (SELECT k FROM k GROUP BY k HAVING min(doc_id) <> max(doc_id)),
f AS (SELECT k.*, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS duplicate, min(doc_id) OVER (PARTITION BY k) AS first_doc FROM k SEMI JOIN s USING (k)),
n AS (SELECT *, CASE WHEN i > lag(i) OVER o + 50 THEN 1 ELSE 0 END AS new FROM f WINDOW o AS (PARTITION BY doc_id, duplicate ORDER BY i)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, duplicate ORDER BY i) AS island FROM n)
SELECT doc_id, duplicate, CAST(min(i) AS BIGINT) AS start_word, CAST(max(i) - min(i) + 50 AS BIGINT) AS n_words, min(first_doc) AS first_doc_id
FROM g GROUP BY doc_id, duplicate, island
"""
}
