"""Vector search and what follows it: filters, top-k, context budgets; extensions: BM25, rank fusion, measures.

Functions named in EXTENSIONS implement what the published description only announces; their details are ours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import dot
from ..sources import providers

EXTENSIONS = ("bm25", "fuse_ranks", "article_boost", "domain_penalty", "dedup_prefix", "long_documents", "citations", "ranking_measures", "expand_queries", "search_collections", "annotated", "answer_measures", "reranked")
#: Queries are taken in blocks of about that many, each of which the driver broadcasts as one matrix.
QUERY_ROWS = 10_000


def normalised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vectors with unit, of length 1: computed once, so that a score is one product. Null for null and zero vectors."""
    length = F.sqrt(dot(F.col(column), F.col(column)))
    return vectors.withColumn("unit", F.when(length > 0, F.transform(column, lambda v: v.cast("double") / length)))


def with_metadata(vectors: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Vectors whose metadata have all these values."""
    for key, value in filters.items():
        vectors = vectors.where(F.try_element_at("metadata", F.lit(key)) == value)
    return vectors


def _best_of_batches(queries: np.ndarray, k: int, threshold: float | None, group: bool) -> Callable:
    """Of rows (embedding, id, [group], extra...), the k best of each query (and group) in each batch, by one matrix product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(b.column(0).value_lengths().fill_null(-1))
            rows = np.flatnonzero(sizes == queries.shape[1])
            if not len(rows):
                continue
            flat = b.column(0).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, queries.shape[1])
            length = np.sqrt((flat * flat).sum(1))
            fine = length > 0
            rows, unit = rows[fine], flat[fine] / length[fine, None]
            scores = np.round(unit @ queries.T, 9)
            ids = np.asarray(b.column(1).take(pa.array(rows)).to_pylist(), object)
            kinds = np.unique(np.asarray(b.column(2).take(pa.array(rows)).to_pylist(), object).astype(str), return_inverse=True)[1] if group else np.zeros(len(rows), int)
            picks, of = [], []
            for kind in range(kinds.max(initial=-1) + 1):
                mine = np.flatnonzero(kinds == kind)
                part = scores[mine]
                least = np.partition(part, len(mine) - k, axis=0)[len(mine) - k] if len(mine) > k else np.full(len(queries), -np.inf)
                if threshold is not None:
                    least = np.maximum(least, threshold)
                for q in range(len(queries)):
                    near = mine[part[:, q] >= least[q]]
                    near = near[sorted(range(len(near)), key=lambda i: (-scores[near[i], q], ids[near[i]]))[:k]]
                    picks.append(near), of.append(np.full(len(near), q))
            at, q = (np.concatenate(x) if x else np.zeros(0, int) for x in (picks, of))
            take = pa.array(rows[at])
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(scores[at, q]), *(b.column(i).take(take) for i in range(1, b.num_columns))], ["q", "score", *b.schema.names[1:]])

    return run


def _scored(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None, columns: list[str], group: bool) -> DataFrame:
    """query_id, score and columns: candidates that hold the k best of each query (and group)."""
    v = vectors.select("embedding", *columns)
    kind = ", ".join(["q int", "score double", *(f"`{c}` {v.schema[c].dataType.simpleString()}" for c in columns)])
    blocks, parts, at = -(-queries.count() // QUERY_ROWS), [], F.xxhash64("query_id")
    id_type = queries.schema["query_id"].dataType
    for block in range(blocks):
        rows = [r for r in queries.where(F.pmod(at, F.lit(blocks)) == block).select("query_id", "embedding").collect() if r["embedding"]]
        by: dict[int, list] = {}
        for r in rows:
            x = np.array([np.nan if e is None else e for e in r["embedding"]], np.float64)
            if (size := np.sqrt((x * x).sum())) > 0:
                by.setdefault(len(x), []).append((r["query_id"], x / size))
        for own in by.values():
            names = vectors.sparkSession.createDataFrame([(i, q) for i, (q, _) in enumerate(own)], f"q int, query_id {id_type.simpleString()}")
            found = v.mapInArrow(_best_of_batches(np.stack([u for _, u in own]), k, threshold, group), kind)
            parts.append(found.join(F.broadcast(names), "q").select("query_id", "score", *columns))
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"query_id {id_type.simpleString()}, " + kind.split(", ", 1)[1])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """query_id, id, score, rank and extra columns: the k vectors nearest each query by cosine, smaller ids first on ties.

    vectors(id, embedding, ...), queries(query_id, embedding). The score has 9 places and is computed before it is compared; threshold is inclusive.
    One pass over the vectors for each block of queries: a batch gives its k best by a matrix product, and only those are
    shuffled. Null, zero and other-sized vectors are near nothing.
    """
    scored = _scored(vectors, queries, k, threshold, ["id", *extra], False)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "score", *extra, "rank")


def search_one(vectors: DataFrame, query: list[float], k: int, threshold: float | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """id, score and extra columns of the k vectors nearest one query, without a shuffle of the vectors: each partition gives its k best."""
    size = sum(x * x for x in query) ** 0.5
    unit = F.array(*(F.lit(x / size) for x in query))
    scored = normalised(vectors).where("unit is not null").select("id", F.round(dot(F.col("unit"), unit), 9).alias("score"), *extra)
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), "id").limit(k)


def search_collections(vectors: DataFrame, queries: DataFrame, k: int, collection: str = "collection") -> DataFrame:
    """The k best of each collection for each query."""
    scored = _scored(vectors, queries, k, None, ["id", collection], True)
    best = Window.partitionBy("query_id", collection).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", collection, "id", "score", "rank")


def context(parts: DataFrame, group: str, order: str, text: str = "text", most: int = 2000, least: int = 100, header: Column | None = None) -> DataFrame:
    """group, no, part: what fits in most characters, in order. The first part that doesn't fit is cut, if more than least characters are left, and ends it."""
    by = Window.partitionBy(group).orderBy(order)
    head = F.concat(F.lit("["), F.row_number().over(by).cast("string"), F.lit("]\n")) if header is None else header
    x = parts.withColumn("no", F.row_number().over(by)).withColumn("head", head).withColumn("size", (F.length("head") + F.length(text)).cast("bigint"))
    x = x.withColumn("before", F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # sizes are positive, so those before the first that doesn't fit all fit
    fits, left = F.col("before") + F.col("size") <= most, most - F.col("before")
    first_over = ~fits & (left >= 0)
    cut = F.concat("head", F.left(F.col(text), (left - F.length("head") - 3).cast("int")), F.lit("..."))
    out = F.when(fits, F.concat("head", text)).when(first_over & (left > least), cut)
    return x.select(group, "no", out.alias("part")).where("part is not null")


def context_text(parts: DataFrame, group: str) -> DataFrame:
    """group, context: parts joined by blank lines."""
    by = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("no", "part"))).alias("p"))
    return by.select(group, F.array_join(F.transform("p", lambda v: v["part"]), "\n\n").alias("context"))


def cached(entries: DataFrame, most: int = 100) -> DataFrame:
    """The entries that a first-in-first-out cache of that size still has; hits don't matter."""
    return entries.orderBy(F.desc("inserted")).limit(most)


def collection_stats(documents: DataFrame) -> DataFrame:
    return documents.groupBy("document_type").agg(F.count("*").alias("documents"))


def _bm25(tf: DataFrame, total: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    x = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(total))  # at most a row a query word, and one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return x.groupBy("doc_id").agg(F.round(F.sum(one), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


_SPACED = r"[^ \t\n\r]+"


def bm25(docs: DataFrame, query: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, score: the k best documents for query words, lower-cased words between blanks, by one pass over all texts; only texts that hold a query word are parted into words."""
    low = F.lower("text")
    total = docs.agg(F.count("*").alias("docs"), F.avg(F.coalesce(F.regexp_count("text", F.lit(_SPACED)), F.lit(0))).alias("mean"))
    some = F.lit(False)
    for word in query:
        some = some | F.contains(low, F.lit(word))
    x = docs.where(some).select("doc_id", F.regexp_extract_all(low, F.lit(_SPACED), F.lit(0)).alias("w"))
    x = x.select("doc_id", F.size("w").alias("n"), F.explode("w").alias("term")).where(F.col("term").isin(query))
    return _bm25(x.groupBy("doc_id", "n", "term").agg(F.count("*").alias("tf")), total, k, k1, b)


def write_postings(docs: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings (term, doc_id, n, tf) in folders by a hash of the term, and the corpus totals: made once, read by bm25_of_postings()."""
    words = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(_SPACED), F.lit(0)).alias("w"))
    docs.agg(F.count("*").alias("docs"), F.avg(F.coalesce(F.regexp_count("text", F.lit(_SPACED)), F.lit(0))).alias("mean")).write.mode("overwrite").parquet(f"{path}/total")
    x = words.select("doc_id", F.size("w").alias("n"), F.explode("w").alias("term")).groupBy("doc_id", "n", "term").agg(F.count("*").alias("tf"))
    x = x.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    x.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def bm25_of_postings(spark: SparkSession, path: str, query: list[str], k: int, buckets: int = 64, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """bm25() from written postings: of their folders and row groups, only those that may hold a query word are read."""
    mine = spark.range(1).select(*(F.pmod(F.xxhash64(F.lit(w)), F.lit(buckets)).cast("int").alias(f"b{i}") for i, w in enumerate(query))).first()
    tf = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(sorted(set(mine)))).where(F.col("term").isin(query)).drop("bucket")
    return _bm25(tf, spark.read.parquet(f"{path}/total"), k, k1, b)


def fuse_ranks(*ranked: DataFrame, constant: int = 60) -> DataFrame:
    """query_id, id, score: reciprocal rank fusion of rankings(query_id, id, rank)."""
    out = ranked[0].select("query_id", "id", "rank")
    for r in ranked[1:]:
        out = out.unionByName(r.select("query_id", "id", "rank"))
    return out.groupBy("query_id", "id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("score"))


def article_boost(score: Column, text: Column, article: Column, boost: float = 4.0) -> Column:
    """More for a text that has the article which the query names."""
    return score + F.when((article != "") & F.contains(text, article), boost).otherwise(0.0)


def domain_penalty(score: Column, domain: Column, wanted: Column, penalty: float = 5.0) -> Column:
    return score - F.when((wanted != "general") & (domain != wanted), penalty).otherwise(0.0)


def dedup_prefix(docs: DataFrame, order: Column, n: int = 100) -> DataFrame:
    """The first document, by order, of each beginning of n characters; documents without text are all kept."""
    one = Window.partitionBy(F.left(F.col("text"), F.lit(n))).orderBy(order)
    own = docs.where("text is not null").withColumn("_first", F.row_number().over(one)).where("_first = 1").drop("_first")
    return own.unionByName(docs.where("text is null"))


def long_documents(docs: DataFrame, least: int = 400) -> DataFrame:
    """Those that are worth compressing."""
    return docs.where(F.length("text") >= least)


def expand_queries(queries: DataFrame, variants: Column) -> DataFrame:
    """query_id, variant_no, query: the query itself as variant 0, then a provider's array of variants."""
    return queries.select("query_id", F.posexplode(F.concat(F.array("query"), F.coalesce(variants, F.array().cast("array<string>")))).alias("variant_no", "query"))


_ARTICLE = r"제\p{Nd}+조"
UNVERIFIED = "(미검증)"
#: What an answer that declines has.
REFUSAL = "수 없습니다|수 없다|모릅니다|확인되지 않"


def _articles(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_ARTICLE), F.lit(0)))


def citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, citation, verified: the articles (제N조) that answers name, and whether the sources have them."""
    named = answers.select("answer_id", F.explode(_articles(F.col("text"))).alias("citation"))
    have = sources.select(F.explode(_articles(F.col("text"))).alias("citation")).distinct().withColumn("there", F.lit(True))
    return named.join(have, "citation", "left").select("answer_id", "citation", F.coalesce("there", F.lit(False)).alias("verified"))


def annotated(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers with a mark behind each article that no source has."""
    wrong = citations(answers, sources).where("not verified").groupBy("answer_id").agg(F.collect_list("citation").alias("_wrong"))
    marked = F.aggregate("_wrong", F.col("text"), lambda t, c: F.replace(t, c, F.concat(c, F.lit(UNVERIFIED))))
    return answers.join(wrong, "answer_id", "left").withColumn("text", F.coalesce(marked, F.col("text"))).drop("_wrong")


def answer_measures(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers, citation_rate (answers that cite), verified_rate (citations that a source has), refusal_rate."""
    by = citations(answers, sources).agg(F.countDistinct("answer_id").alias("citing"), F.round(F.avg(F.col("verified").cast("double")), 6).alias("verified_rate"))
    x = answers.agg(F.count("*").alias("answers"), F.round(F.avg(F.coalesce(F.regexp_like("text", F.lit(REFUSAL)), F.lit(False)).cast("double")), 6).alias("refusal_rate")).crossJoin(F.broadcast(by))
    return x.select("answers", F.round(F.try_divide(F.col("citing"), F.col("answers")), 6).alias("citation_rate"), "verified_rate", "refusal_rate")


def word_overlap() -> Callable[[], providers.Call]:
    """A stand-in for a cross-encoder: how many words of a question, given first on a line of its own, its text has."""

    def make() -> providers.Call:
        def score(v: object) -> str:
            query, _, text = str(v).partition("\n")
            return str(len(set(query.split()) & set(text.split())))

        return score

    return make


def reranked(candidates: DataFrame, encoder: Callable[[], providers.Call], k: int) -> DataFrame:
    """query_id, id, score, rank: candidates(query_id, id, query, text, domain) by a cross-encoder that sees question and text with the domain before each; a failed call scores 0."""
    tag = F.concat(F.lit("["), "domain", F.lit("] "))
    pair = candidates.select(F.to_json(F.struct("query_id", "id")).alias("key"), F.concat(tag, "query", F.lit("\n"), tag, "text").alias("pair"))
    out = providers.call(pair, "key", "pair", encoder).select(F.from_json("key", candidates.select("query_id", "id").schema).alias("k"), F.coalesce(F.col("output").try_cast("double"), F.lit(0.0)).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.select("k.*", "score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def ranking_measures(ranked: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    """hit_at_k, mrr over the queries of ranked(query_id, id, rank) with relevant(query_id, id)."""
    first = ranked.join(relevant, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    x = ranked.select("query_id").distinct().join(first, "query_id", "left")
    return x.agg(F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 6).alias("hit_at_k"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
