"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 60-bit hash of its id. A source's part of a budget is the
set of its documents whose hash is at most a threshold: the largest for which
their tokens stay within the source's quota. Thresholds of nested budgets are
found from histograms of tokens by source and hash bucket; only the bucket that
holds a boundary is refined, twice by 12 bits and then by the hash itself, and
documents are filtered by comparing hashes, never by sorting them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpointed, fresh, small, table
from .token_counts import broadcast_ranks, counted_sql, token_count

#: Nested budgets as parts of all tokens, ascending.
BUDGETS = (0.25, 0.5, 0.9)
#: A source's weight is its share of the tokens to this power: large sources are held back.
TEMPERATURE = 0.7
SEED = "mix-1"
STEP = 12


def doc_hash(doc_id: Column, seed: str = SEED) -> Column:
    """60 bits of an MD5 of the seed and the id; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("bigint")


def _quotas(totals: DataFrame, budgets: tuple[float, ...], weights: DataFrame | None) -> DataFrame:
    """source, level, quota: each budget shared by weight, no source above its tokens.

    A source whose share exceeds its tokens gives all it has and the others share
    the rest by weight: with sources in order of tokens over weight, the
    first k are full, for the least k at which the next one's share fits.
    """
    everything = Window.partitionBy("level")
    upto = everything.orderBy("ratio", F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    own = totals if weights is None else totals.join(weights, totals["source"].eqNullSafe(weights["source"]), "left").select(totals["source"], "tokens", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    if weights is None:
        own = own.withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(TEMPERATURE)))
    levels = own.where("weight > 0 and tokens > 0").withColumn("level", F.explode(F.array(*(F.lit(i) for i in range(1, len(budgets) + 1)))))
    share = F.element_at(F.array(*(F.lit(float(b)) for b in budgets)), F.col("level"))
    x = levels.withColumn("ratio", F.col("tokens") / F.col("weight")).withColumn("budget", F.floor(F.sum("tokens").over(everything) * share))
    x = x.withColumn("before_tokens", F.coalesce(F.sum("tokens").over(upto), F.lit(0))).withColumn("before_weight", F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    x = x.withColumn("rate", (F.col("budget") - F.col("before_tokens")) / (F.sum("weight").over(everything) - F.col("before_weight")))
    x = x.withColumn("level_rate", F.min(F.when(F.col("rate") <= F.col("ratio"), F.struct("ratio", F.col("source"), "rate"))).over(everything)["rate"])
    quota = F.when(F.col("level_rate").isNull(), F.col("tokens")).otherwise(F.least(F.col("tokens"), F.floor(F.round(F.col("level_rate") * F.col("weight"), 3))))
    return x.select("source", "level", quota.cast("bigint").alias("quota"))


def thresholds(slim: DataFrame, budgets: tuple[float, ...] = BUDGETS, weights: DataFrame | None = None) -> DataFrame:
    """source, level, bound: documents with hash <= bound are in that budget; -1 takes none."""
    h, top = F.col("h"), 60
    hist = checkpointed(slim.groupBy("source", F.shiftright("h", top - STEP).alias("bucket")).agg(F.sum("tokens").alias("tokens")))
    need = checkpointed(_quotas(hist.groupBy("source").agg(F.sum("tokens").alias("tokens")), budgets, weights))
    order = Window.partitionBy("source", "level").orderBy("bucket")
    found = []
    # one row a boundary: the bucket at which a source's running tokens pass its quota, and what is left of the quota before it
    for shift in (top - STEP, top - 2 * STEP, 0):
        lines = hist.withColumnRenamed("source", "of") if shift == top - STEP else hist.withColumnsRenamed({"source": "of", "level": "of_level"})
        on = F.col("of").eqNullSafe(F.col("source")) & (F.lit(True) if shift == top - STEP else F.col("of_level") == F.col("level"))
        x = lines.join(need, on).withColumn("upto", F.sum("tokens").over(order))
        passed = x.where("upto > quota")
        least = passed.groupBy("source", "level").agg(F.min_by(F.struct("bucket", "tokens", "upto", "quota"), "bucket").alias("b"))
        ends = need.alias("n").join(least.alias("l"), F.col("n.source").eqNullSafe(F.col("l.source")) & (F.col("n.level") == F.col("l.level")), "left").select("n.*", "b")
        ends = checkpointed(ends)
        found.append(ends.where("b is null").select("source", "level", (F.lit((1 << top) - 1) if shift == top - STEP else F.col("high")).cast("bigint").alias("bound")))
        if shift == 0:
            found.append(ends.where("b is not null").select("source", "level", (F.col("b.bucket") - 1).alias("bound")))
            break
        need = ends.where("b is not null").select(
            "source", "level", (F.col("b.quota") - F.col("b.upto") + F.col("b.tokens")).alias("quota"), F.col("b.bucket").alias("at"),
            (F.shiftleft(F.col("b.bucket") + 1, shift) - 1).alias("high"),
        )
        finer = max(0, shift - STEP) if shift == top - STEP else 0
        at = small(need.select(F.col("source").alias("of"), "level", "at"))
        inside = slim.join(at, F.col("of").eqNullSafe(F.col("source")) & (F.shiftright(h, shift) == F.col("at")))
        hist = inside.groupBy("source", "level", F.shiftright("h", finer).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
    return found[0].union(found[1]).union(found[2]).union(found[3])


def _slim(docs: DataFrame, tokens: Column | None) -> DataFrame:
    tokens = token_count(F.col("text"), broadcast_ranks(docs.sparkSession)) if tokens is None else tokens
    tokens = F.coalesce(tokens.cast("bigint"), F.lit(0))
    return checkpointed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), doc_hash(F.col("doc_id")).alias("h"), tokens.alias("tokens")))


def _bounds(slim: DataFrame, budgets: tuple[float, ...], weights: DataFrame | None) -> DataFrame:
    """of, bounds: a source's thresholds in order of level."""
    rows = thresholds(slim, budgets, weights).withColumnRenamed("source", "of")
    return small(rows.groupBy("of").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "bound"))), lambda x: x["bound"]).alias("bounds")))


def mix_levels(docs: DataFrame, budgets: tuple[float, ...] = BUDGETS, weights: DataFrame | None = None, tokens: Column | None = None) -> DataFrame:
    """doc_id, source, tokens, level: the documents of the largest budget; level is the least budget that holds one.

    weights(source, weight) gives target weights, 1 for other sources; without
    it a source weighs its tokens to the power TEMPERATURE. tokens defaults to the
    byte-pair tokens of the text, as op1 counts them; null counts as 0.
    A document is in or out by its id's hash, so repeated rows of an id go
    together, and equal hashes never part. Documents without a source form a
    source of their own; a null id hashes like an empty string. A source
    without tokens has no quota, and its documents aren't in the result;
    in others, documents of 0 tokens (null or empty text) are there if
    their hash is. An empty table gives no rows.
    """
    slim = _slim(docs, tokens)
    bounds = _bounds(slim, budgets, weights)
    level = F.size(F.filter("bounds", lambda b: b < F.col("h"))) + 1
    return slim.join(bounds, F.col("of").eqNullSafe(F.col("source"))).withColumn("level", level).where(F.col("level") <= len(budgets)).select("doc_id", "source", "tokens", "level")


def mix(docs: DataFrame, budgets: tuple[float, ...] = BUDGETS, weights: DataFrame | None = None, tokens: Column | None = None) -> DataFrame:
    """The rows of docs in the largest budget, with all their columns; rules as for mix_levels()."""
    of, bounds, h = fresh(docs, "mix_of", "mix_bounds", "mix_hash")
    found = _bounds(_slim(docs, tokens), budgets, weights)
    found = found.select(F.col("of").alias(of), F.element_at("bounds", -1).alias(bounds))
    return docs.withColumn(h, doc_hash(F.col("doc_id"))).join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, F.col(of).eqNullSafe(F.col("source").cast("string"))).where(F.col(h) <= F.col(bounds)).select(docs.columns)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_levels(table(spark, sf_dir, "documents"))


QUERIES = {"op2_source_mixing": op2_source_mixing}
SQL = {
    "op2_source_mixing": counted_sql("documents")
    + """,
d AS (SELECT doc_id, source, ('0x' || substr(md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h, coalesce(n_tokens, 0) AS tokens FROM counted),
s AS (SELECT source, sum(tokens)::BIGINT AS total, pow(sum(tokens)::DOUBLE, 0.7) AS weight FROM d GROUP BY source HAVING sum(tokens) > 0),
l AS (SELECT s.*, level, total / weight AS ratio, floor(sum(total) OVER (PARTITION BY level) * share) AS budget
      FROM s, (VALUES (1, 0.25::DOUBLE), (2, 0.5::DOUBLE), (3, 0.9::DOUBLE)) b(level, share)),
r AS (SELECT *, (budget - coalesce(sum(total) OVER p, 0)) / (sum(weight) OVER (PARTITION BY level) - coalesce(sum(weight) OVER p, 0)) AS rate
      FROM l WINDOW p AS (PARTITION BY level ORDER BY ratio, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT level, arg_min(rate, ratio) AS level_rate FROM r WHERE rate <= ratio GROUP BY level),
q AS (SELECT r.source, r.level, CASE WHEN level_rate IS NULL THEN total ELSE least(total, floor(round(level_rate * weight, 3))) END AS quota FROM r LEFT JOIN m USING (level)),
c AS (SELECT d.*, sum(tokens) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d)
SELECT c.doc_id, c.source, c.tokens, CAST(min(q.level) AS INT) AS level FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source AND c.upto <= q.quota
GROUP BY c.doc_id, c.source, c.tokens, c.h
"""
}
