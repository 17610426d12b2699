"""Line dedup that can be undone: sharded cuckoo filters backed by exact reference counts.

The exact table counts, for each line (by a 128-bit hash), the places that refer
to it. Each shard of it has a cuckoo filter of the lines with a count above
zero. An insertion asks the filters first: a line that its filter doesn't hold
is new and needs no look at the exact table; only the others are joined
with it. A deletion lowers counts and takes lines that reach zero out
of the filters, so that a later insertion finds them new again. A ledger holds which
documents, by id and a hash of the text, are inserted: each counts once, however often it is
inserted, and only what is there can be deleted. Versions of the
state are written side by side; a lost executor never leaves half a version.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Bloom, checkpointed, fresh, give_back, mix, small_batches, table

#: Parts in which the query inserts its documents.
INCREMENTS = 2
#: Lines of a shard; there are new shards when it holds twice as many.
SHARD_LINES = 250_000
SLOTS = 4
KICKS = 500
FILTER_SCHEMA = "shard int, buckets bigint, slots binary"
COUNTED_SCHEMA = "h1 bigint, h2 bigint, refs bigint, first_doc bigint, first_line int, first_text bigint"
REFS_SCHEMA, LEDGER_SCHEMA = "h1 bigint, h2 bigint, refs bigint", "doc_id bigint, text_hash bigint"


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints in buckets of four; arrays of 64-bit hashes in and out.

    Equal fingerprints may be there several times, so that deletion is exact
    for what was inserted. A filter that fills up is rebuilt twice as large.
    """

    def __init__(self, buckets: int, slots: np.ndarray | None = None) -> None:
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots.reshape(buckets, SLOTS)

    @classmethod
    def sized(cls, items: int) -> Cuckoo:
        return cls(1 << max(2, int(np.ceil(np.log2(max(items, 1) / (SLOTS * 0.8))))))

    def _of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (h >> U64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (h & U64(self.buckets - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(U64)) & U64(self.buckets - 1)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        mark, a, b = self._of(h)
        return (self.slots[a] == mark[:, None]).any(1) | (self.slots[b] == mark[:, None]).any(1)

    def _put(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Puts what fits, at most one into a bucket; True where it did."""
        done = np.zeros(len(bucket), bool)
        _, lead = np.unique(bucket, return_index=True)
        free = self.slots[bucket[lead]] == 0
        ok = free.any(1)
        lead, slot = lead[ok], free[ok].argmax(1)
        self.slots[bucket[lead], slot] = mark[lead]
        done[lead] = True
        return done

    def add(self, h: np.ndarray) -> bool:
        """False if some didn't fit; the filter is then to be rebuilt from the exact table."""
        mark, a, b = self._of(h)
        for turn in range(2 * SLOTS):
            done = self._put(a if turn % 2 == 0 else b, mark)
            mark, a, b = mark[~done], a[~done], b[~done]
        bucket, left = b, mark
        for kick in range(KICKS):
            if not len(left):
                return True
            done = self._put(bucket, left)
            bucket, left = bucket[~done], left[~done]
            if not len(left):
                return True
            _, lead = np.unique(bucket, return_index=True)  # one eviction in a bucket at a time
            slot = (kick + bucket[lead]) % SLOTS
            out = self.slots[bucket[lead], slot].copy()
            self.slots[bucket[lead], slot] = left[lead]
            left[lead] = out
            bucket[lead] = self._other(bucket[lead], out)
        return False

    def remove(self, h: np.ndarray) -> None:
        """Takes out one fingerprint for each hash; all of them must have been inserted."""
        mark, *buckets = self._of(h)
        left = np.arange(len(mark))
        for bucket in buckets:
            missing = [left[:0]]
            while len(left):
                _, lead = np.unique(bucket[left], return_index=True)  # one fingerprint of a bucket at a time
                at = left[lead]
                hit = self.slots[bucket[at]] == mark[at, None]
                found = hit.any(1)
                self.slots[bucket[at[found]], hit[found].argmax(1)] = 0
                missing.append(at[~found])
                left = np.delete(left, lead)
            left = np.concatenate(missing)

    @classmethod
    def build(cls, h: np.ndarray, items: int | None = None) -> Cuckoo:
        made = cls.sized(items or len(h))
        while not made.add(h):
            made = cls(made.buckets * 2)
        return made


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text of rows that have both."""
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def _lines(texts: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, and both hashes of each line; blank lines are left out."""
    own = texts.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    own = own.where(F.trim(F.col("line")) != "")
    return own.select("doc_id", "text_hash", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(97), "line").alias("h2"))


def _counted(lines: DataFrame) -> DataFrame:
    """Each line's places and the first of them."""
    once = lines.groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.min(F.struct("doc_id", "line_no", "text_hash")).alias("first"))
    return once.select("h1", "h2", "refs", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"), F.col("first.text_hash").alias("first_text"))


def _hashes(rows: pa.Table) -> np.ndarray:
    return mix(rows["h2"].to_numpy().astype(np.int64).view(U64))


def _filter_of(rows: pa.Table) -> Cuckoo | None:
    return Cuckoo(rows["buckets"][0].as_py(), np.frombuffer(rows["slots"][0].as_py(), np.uint16).copy()) if len(rows) else None


def _probe(left: pa.Table, right: pa.Table) -> pa.Table:
    """Lines of a shard with known: whether its filter may hold them."""
    held = _filter_of(right)
    known = held.has(_hashes(left)) if held and len(left) else np.zeros(len(left), bool)
    give_back()
    return left.drop_columns(["shard"]).append_column("known", pa.array(known))


def _renew(left: pa.Table, right: pa.Table) -> pa.Table:
    """A shard's filter after its changes: change 1 enters a line, -1 takes it out, 0 is a line that stays."""
    change, h = left["change"].to_numpy(), _hashes(left)
    shard = (left if len(left) else right)["shard"][0].as_py()
    held = _filter_of(right)
    if held:
        held.remove(h[change < 0])
    if not held or not held.add(h[change > 0]):
        held = Cuckoo.build(h[change >= 0])
    give_back()
    return pa.table({"shard": pa.array([shard], pa.int32()), "buckets": pa.array([held.buckets], pa.int64()), "slots": pa.array([held.slots.tobytes()], pa.binary())})


class LineIndex:
    """The documents inserted so far: refs(h1, h2, refs) of their lines, filters(shard, buckets, slots), ledger(doc_id, text_hash).

    A shard holds about SHARD_LINES lines; when there are twice as many, the filters are built again in more shards.
    """

    def __init__(self, refs: DataFrame, filters: DataFrame, ledger: DataFrame, shards: int) -> None:
        self.refs, self.filters, self.ledger, self.shards = refs, filters, ledger, shards

    @classmethod
    def empty(cls, spark: SparkSession) -> LineIndex:
        return cls(*(spark.createDataFrame([], s) for s in (REFS_SCHEMA, FILTER_SCHEMA, LEDGER_SCHEMA)), 0)

    def save(self, path: str) -> None:
        self.refs.write.parquet(f"{path}/refs")
        self.ledger.write.parquet(f"{path}/ledger")
        self.filters.withColumn("shards", F.lit(self.shards)).write.parquet(f"{path}/filters")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineIndex:
        filters = spark.read.parquet(f"{path}/filters")
        return cls(spark.read.parquet(f"{path}/refs"), filters.drop("shards"), spark.read.parquet(f"{path}/ledger"), filters.agg(F.max("shards")).first()[0] or 0)

    def _shard(self) -> Column:
        return F.pmod("h1", F.lit(self.shards)).cast("int").alias("shard")

    def resharded(self, shards: int) -> LineIndex:
        """The same lines in another number of shards; the filters are built again from the exact table."""
        new = LineIndex(self.refs, self.filters, self.ledger, shards)
        rows = self.refs.select(new._shard(), "h2", F.lit(1).alias("change"))
        none = self.filters.where(F.lit(False)).groupBy("shard")
        new.filters = rows.groupBy("shard").cogroup(none).applyInArrow(_renew, FILTER_SCHEMA)
        return new

    def _once(self, docs: DataFrame, held: bool) -> tuple[DataFrame, DataFrame]:
        """Texts of docs, each document once, that the ledger holds or (held False) doesn't; and their ids.

        Only rows that may repeat or be in the ledger are shuffled.
        """
        small_batches(docs.sparkSession)
        texts, key = _texts(docs), ["doc_id", "text_hash"]
        ids = checkpointed(texts.groupBy(*key).agg(F.count("*").alias("n")))
        known = checkpointed(ids.join(self.ledger, key, "left_semi").select(*key)) if self.shards else self.ledger
        if held:
            few = texts.where(Bloom(known.select("doc_id")).may_hold(F.col("doc_id"))).dropDuplicates(key)
            return few.join(known, key, "left_semi"), known
        odd = checkpointed(ids.where("n > 1").select(*key).union(known).select("doc_id"))
        new = ids.select(*key).join(known, key, "left_anti") if self.shards else ids.select(*key)
        if odd.isEmpty():
            return texts, new
        (maybe,) = fresh(texts, "line_maybe")
        marked = texts.withColumn(maybe, Bloom(odd).may_hold(F.col("doc_id")))
        few = marked.where(F.col(maybe)).dropDuplicates(key).join(known, key, "left_anti")
        return marked.where(~F.col(maybe)).unionByName(few).drop(maybe), new

    def insert(self, docs: DataFrame, last: bool = False) -> tuple[DataFrame, LineIndex | None]:
        """dropped(doc_id, text_hash, line_no) and the index afterwards.

        A line of the new documents is dropped if an earlier insertion holds
        it, or if it isn't at its first place, by doc_id, line number and text hash, among
        the new ones. Documents that are in the index already are passed over: nothing of them is
        dropped or counted. After the last insertion of a job, there is no index.
        """
        texts, ids = self._once(docs, False)
        lines = checkpointed(_lines(texts))
        state = checkpointed(_counted(lines))
        if self.shards:
            probed = checkpointed(state.select("*", self._shard()).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_probe, f"{COUNTED_SCHEMA}, known boolean"))
            old = probed.where("known").select("h1", "h2").join(self.refs.select("h1", "h2"), ["h1", "h2"], "left_semi").withColumn("old", F.lit(True))
            state = checkpointed(probed.drop("known").join(old, ["h1", "h2"], "left"))
        else:
            state = state.withColumn("old", F.lit(None).cast("boolean"))
        doubtful = state.where("refs > 1 or old").drop("refs")
        other = "old or doc_id <> first_doc or line_no <> first_line or text_hash <> first_text"
        dropped = lines.join(doubtful, ["h1", "h2"]).where(other).select("doc_id", "text_hash", "line_no")
        return dropped, None if last else self._changed(state.select("h1", "h2", "refs"), self.ledger.union(ids))

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index without these documents. Those that it doesn't hold, with these texts, are passed over."""
        texts, ids = self._once(docs, True)
        return self._changed(_counted(_lines(texts)).select("h1", "h2", (-F.col("refs")).alias("refs")), self.ledger.join(ids, ["doc_id", "text_hash"], "left_anti"))

    def _changed(self, delta: DataFrame, ledger: DataFrame) -> LineIndex:
        zero = F.lit(0).cast("bigint")
        both = self.refs.select("h1", "h2", zero.alias("d"), "refs").unionByName(delta.select("h1", "h2", F.col("refs").alias("d"), zero.alias("refs")))
        after = both.groupBy("h1", "h2").agg(F.sum("refs").alias("before"), (F.sum("refs") + F.sum("d")).alias("refs"))
        after = checkpointed(after.withColumn("change", (F.col("refs") > 0).cast("int") - (F.col("before") > 0).cast("int")).where("refs <> 0 or before > 0"))
        lines, least = after.agg(F.count("*"), F.min("refs")).first()
        if (least or 0) < 0:
            raise ValueError("a line would be referred to by less than no documents; the index isn't that of its ledger")
        want = max(1, -(-lines // SHARD_LINES))
        new = LineIndex(after.where("refs > 0").select("h1", "h2", "refs"), self.filters, checkpointed(ledger), self.shards or want)
        if want >= 2 * new.shards:
            return new.resharded(want)
        new.filters = after.select(new._shard(), "h2", "change").groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_renew, FILTER_SCHEMA)
        return new


def strip_lines(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs with dropped lines taken out of text; a document that loses all its lines goes.

    n_chars, where there is one, becomes the length of the new text. Texts that
    lose nothing stay as they are, as do rows without doc_id or text.
    """
    key, mark, gone, left = fresh(docs, "line_doc", "line_text", "line_gone", "line_left")
    by = dropped.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(mark)).agg(F.collect_list("line_no").alias(gone))
    x = docs.join(by, (F.col("doc_id") == F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(mark)), "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col(gone), i))
    x = x.withColumn(left, F.when(F.col(gone).isNotNull() & F.col("text").isNotNull(), F.array_join(kept, "\n")))
    x = x.where(F.col(left).isNull() | (F.trim(F.translate(F.col(left), "\n", " ")) != ""))
    new = {"text": F.coalesce(F.col(left), F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(left).isNotNull(), F.length(F.col(left)).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return x.withColumns(new).select(docs.columns)


def dedup_lines(docs: DataFrame, increments: int = INCREMENTS) -> DataFrame:
    """docs without lines that came before; all columns stay.

    Documents are inserted in increments, by the remainder of doc_id; a line
    came before if it is in an earlier increment, or in its own at a smaller
    (doc_id, line number). Lines are parted by line feeds and compared as they
    are. Blank lines are never duplicates. Rows without doc_id or text pass and
    count for nothing. Rows that repeat a doc_id and a text are one document and share a fate; rows
    of one doc_id and different texts are different documents. An empty text stays; a text that
    had lines and loses them all goes with its row. An empty table stays empty.
    """
    index, dropped = LineIndex.empty(docs.sparkSession), None
    for i in range(increments):
        new, index = index.insert(docs.where(F.pmod("doc_id", F.lit(increments)) == i), last=i == increments - 1)
        dropped = new if dropped is None else dropped.unionByName(new)
    return strip_lines(docs, dropped)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars")


def line_dedup_reinserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, dropped_lines: every fifth document is deleted from an index of all documents, twice, and inserted again; of those, the lines that aren't new."""
    docs = table(spark, sf_dir, "documents")
    some = docs.where("doc_id % 5 = 0")
    index = LineIndex.empty(spark).insert(docs)[1].insert(docs.where("doc_id % 3 = 0"))[1].delete(some).delete(some)
    dropped, _ = index.insert(some, last=True)
    return dropped.groupBy("doc_id").agg(F.count("*").alias("dropped_lines"))


QUERIES = {"op6_line_dedup": op6_line_dedup, "line_dedup_reinserted": line_dedup_reinserted}
SQL = {
    "op6_line_dedup": """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT *, trim(line, ' ') = '' OR row_number() OVER (PARTITION BY line ORDER BY doc_id % 2, doc_id, i) = 1 AS keep FROM l),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keep) AS text, bool_and(keep) AS whole FROM k GROUP BY doc_id)
SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_chars FROM t WHERE whole OR trim(replace(text, chr(10), ' '), ' ') <> ''
""",
    "line_dedup_reinserted": """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS again FROM l WHERE doc_id % 5 = 0 AND trim(line, ' ') <> '')
SELECT doc_id, count(*) AS dropped_lines FROM k WHERE again OR line IN (SELECT line FROM l WHERE doc_id % 5 <> 0) GROUP BY doc_id
""",
}
