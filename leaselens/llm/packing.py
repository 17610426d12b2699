"""Packing documents into windows by the sum-of-squares rule.

An online packer keeps, for each fill level h, the number N(h) of partially
filled windows. A piece of s tokens goes to the level h (or a new window)
for which the sum of N(h)^2 afterwards is least. Documents are dealt to
shards by hash, each shard packs its own windows in hash order, and the number
of shards follows the tokens and the rows, so no shard grows with the data.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table
from .mixing import doc_hash
from .token_counts import broadcast_ranks, counted_sql, token_count

#: Tokens of a window, and about how many tokens and rows a shard packs.
WINDOW = 2048
SHARD_TOKENS, SHARD_ROWS = 8_000_000, 200_000
SEED = "pack-1"
SCHEMA = "doc_id bigint, piece bigint, tokens bigint, shard int, window_id bigint, window_start int"


class Packer:
    """Sum-of-squares packing of pieces below the capacity; place() gives a window and the fill it had."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1)  # N(h); 0 at 0 and at the capacity
        self.open = np.zeros(capacity + 1)  # N(h), -inf where no window can be taken
        self.open[1:] = -np.inf
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.windows = 0

    def new(self) -> int:
        self.windows += 1
        return self.windows - 1

    def place(self, size: int) -> tuple[int, int]:
        """The change of the sum is 2 (N(h+s) - N(h)) + 2; 1 less for a new or a filled window. Ties take the fullest."""
        top = self.capacity - size
        cost = self.count[size:] - self.open[: top + 1]
        cost[0] -= 0.5
        cost[top] -= 0.5
        level = top - int(np.argmin(cost[::-1]))
        if level:
            window = self.at[level].pop()
            self.count[level] -= 1
            self.open[level] = self.count[level] or -np.inf
        else:
            window = self.new()
        to = level + size
        if to < self.capacity:
            self.at[to].append(window)
            self.count[to] += 1
            self.open[to] = self.count[to]
        return window, level


def pack_shard(sizes: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Pieces of documents in order: a long document fills whole windows, its rest is placed."""
    packer, out = Packer(capacity), []
    for i, size in enumerate(sizes.tolist()):
        for piece in range(size // capacity):
            out.append((i, piece, capacity, packer.new(), 0))
        if rest := size % capacity:
            out.append((i, size // capacity, rest, *packer.place(rest)))
        elif not size:
            out.append((i, 0, 0, -1, -1))
    x = np.array(out, np.int64).reshape(-1, 5)
    return {"row": x[:, 0], "piece": x[:, 1], "tokens": x[:, 2], "window_id": x[:, 3], "window_start": x[:, 4]}


def pack(docs: DataFrame, tokens: Column | None = None, capacity: int = WINDOW, shard_tokens: int = SHARD_TOKENS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, piece, tokens, shard, window_id, window_start: where each piece of each document goes.

    tokens defaults to the byte-pair tokens of the text, as op1 counts them. A window is (shard, window_id);
    its pieces lie side by side and never exceed the capacity. A document of
    more than a window is cut into full windows and a rest. One of no tokens (an
    empty or null text) is in no window: a row of 0 tokens with null window_id
    and window_start. Repeated rows are packed once each; rows without doc_id are
    packed like others, and dealt to shards one by one. An empty table gives no rows.
    """
    tokens = token_count(F.col("text"), broadcast_ranks(docs.sparkSession)) if tokens is None else tokens
    size, id_ = F.greatest(F.coalesce(tokens.cast("bigint"), F.lit(0)), F.lit(0)), F.col("doc_id").cast("bigint")
    order = F.when(id_.isNotNull(), doc_hash(id_, SEED)).otherwise(doc_hash(F.monotonically_increasing_id(), SEED))
    slim = checkpointed(docs.select(id_.alias("doc_id"), size.alias("n"), order.alias("h")))
    total, rows = slim.agg(F.sum("n"), F.count("*")).first()
    shards = max(1, math.ceil((total or 0) / shard_tokens), math.ceil(rows / shard_rows))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("n", "ascending")])
        x = pack_shard(rows["n"].to_numpy(), capacity)
        none = x["window_id"] < 0
        return pa.table({
            "doc_id": rows["doc_id"].take(pa.array(x["row"])), "piece": x["piece"], "tokens": x["tokens"], "shard": pa.array(np.full(len(none), key[0].as_py(), np.int32)),
            "window_id": pa.array(x["window_id"], mask=none), "window_start": pa.array(x["window_start"].astype(np.int32), mask=none),
        })

    return slim.groupBy(F.pmod("h", F.lit(shards)).cast("int").alias("shard")).applyInArrow(run, SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
#: A recursion places one document of every shard at a time; open_ holds level and window of what is partially filled, the last one to come at the end.
SQL = {
    "op4_packing": counted_sql("documents")
    + """,
n AS (SELECT doc_id, coalesce(n_tokens, 0) AS n, ('0x' || substr(md5('pack-1' || doc_id), 1, 15))::BIGINT AS h FROM counted),
m AS (SELECT *, h % (SELECT greatest(1, ceil(sum(n) / 8000000), ceil(count(*) / 200000))::BIGINT FROM n) AS shard FROM n),
d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, n) AS i FROM m),
p(shard, i, doc_id, n, first_, level, window_, open_, next_) AS (
  SELECT DISTINCT shard, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::STRUCT(l BIGINT, w BIGINT)[], 0::BIGINT FROM d
  UNION ALL
  SELECT shard, i, doc_id, n, first_, level, window_,
    CASE WHEN rest = 0 THEN open_ ELSE list_concat(list_filter(open_, lambda o: o.w <> window_), CASE WHEN level + rest < 2048 THEN [{'l': level + rest, 'w': window_}] ELSE [] END) END,
    next_ + n // 2048 + CASE WHEN rest > 0 AND level = 0 THEN 1 ELSE 0 END
  FROM (SELECT *, CASE WHEN level = 0 THEN next_ + n // 2048 ELSE list_filter(open_, lambda o: o.l = level)[-1].w END AS window_
    FROM (SELECT *, next_ AS first_, -(list_min(list_transform(list_append(list_distinct(list_filter(list_transform(open_, lambda o: o.l), lambda l: l + rest <= 2048)), 0),
        lambda l: {'cost': len(list_filter(open_, lambda o: o.l = l + rest)) - len(list_filter(open_, lambda o: o.l = l))
                           - CASE WHEN l = 0 THEN 0.5 ELSE 0 END - CASE WHEN l + rest = 2048 THEN 0.5 ELSE 0 END, 'l': -l})).l) AS level
      FROM (SELECT d.shard, d.i, d.doc_id, d.n, d.n % 2048 AS rest, p.open_, p.next_ FROM p JOIN d ON d.shard = p.shard AND d.i = p.i + 1)))
),
o AS (SELECT * FROM p WHERE i > 0)
SELECT doc_id, piece, CAST(2048 AS BIGINT) AS tokens, CAST(shard AS INT) AS shard, first_ + piece AS window_id, CAST(0 AS INT) AS window_start
FROM (SELECT *, unnest(range(0, n // 2048)) AS piece FROM o)
UNION ALL SELECT doc_id, n // 2048, n % 2048, CAST(shard AS INT), window_, CAST(level AS INT) FROM o WHERE n % 2048 > 0
UNION ALL SELECT doc_id, 0, 0, CAST(shard AS INT), NULL, NULL FROM o WHERE n = 0
""",
}
