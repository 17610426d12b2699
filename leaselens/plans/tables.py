"""Queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import jobs, layout, privacy, rules, search
from ..sources import files


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one, of fewer splits than cores, is dealt to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in WIDE and df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


#: Tables whose rows are dear to work on.
WIDE = ("documents", "pages", "embeddings", "conversations")


def _holds(rule: rules.Rule) -> str:
    some = ["(" + " OR ".join(f"contains(text, '{w}')" for w in g) + ")" for g in rule.groups]
    return "(" + " AND ".join(some + [f"NOT contains(text, '{w}')" for w in rule.without]) + ")"


_RULES = rules.DOCUMENT_RULES
_POINTS = {kind: " + ".join(f"CASE WHEN {_holds(r)} THEN {p(r)} ELSE 0 END" for r in _RULES) for kind, p in (("api", lambda r: rules.API_POINTS[r.kind]), ("worker", lambda r: rules.worker_points(r.kind, r.weight_class)))}


def rule_scores(spark: SparkSession, d: str) -> DataFrame:
    x = rules.rule_counts(_read(spark, d, "documents").select("doc_id", "text"), _RULES, "doc_id")
    return x.select("doc_id", *(F.array_join(k, ",").alias(k) for k in rules.API_POINTS), "api_score", "worker_score")


def rule_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.findings(_read(spark, d, "documents"), _RULES, "doc_id").groupBy("kind", "name", "weight_class").agg(F.count("*").alias("n"))


def worker_scores(spark: SparkSession, d: str) -> DataFrame:
    return rules.scores_of(rules.findings(_read(spark, d, "documents"), _RULES, "doc_id"), "doc_id")


def level_summary(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("l_returnflag") == "R", "Risk").when(F.col("l_returnflag") == "A", "Caution").otherwise("Safe")
    return rules.level_summary(_read(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), level.alias("risk_level")))


def phone_extract(spark: SparkSession, d: str) -> DataFrame:
    x = _read(spark, d, "documents").select("doc_id", tx.extract_phone(F.col("text")).alias("phone")).where("phone is not null")
    return x.select("doc_id", "phone", tx.format_phone_a(F.col("phone")).alias("phone_a"), tx.format_phone_b(F.col("phone")).alias("phone_b"))


def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents, numbered, with the section that a license line opens: a running sum, as articles open theirs."""
    x = _read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    opens = F.contains("line", F.lit("icense")).cast("int")
    return x.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.sum(opens).over(Window.partitionBy("doc_id").orderBy("pos")).alias("section"), F.length("line").cast("bigint").alias("n_chars"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    x = _read(spark, d, "embeddings")
    return x.select(F.col("vec_id").alias("id"), "embedding", "label", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings").where("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    x = search.search(_vectors(spark, d), _asked(spark, d), 4, extra=("label",))
    return x.select("query_id", "id", F.round("score", 6).alias("score"), "label", F.col("rank").cast("bigint").alias("rank"))


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    x = search.search(search.with_metadata(_vectors(spark, d), {"label": "3"}), _asked(spark, d), 5, threshold=0.1)
    return x.select("query_id", "id", F.round("score", 6).alias("score"))


def vector_topk_one(spark: SparkSession, d: str) -> DataFrame:
    own = _read(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]
    return search.search_one(_vectors(spark, d), own, 4, extra=("label",)).withColumn("score", F.round("score", 6))


def vector_topk_collections(spark: SparkSession, d: str) -> DataFrame:
    x = search.search_collections(_vectors(spark, d).withColumn("collection", F.col("label")), _asked(spark, d), 2)
    return x.select("query_id", "collection", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _rankings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    near = search.search(_vectors(spark, d), _asked(spark, d), 10)
    even = search.search(_vectors(spark, d).where("id % 2 = 0"), _asked(spark, d), 10)
    return near, even


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return search.fuse_ranks(*_rankings(spark, d))


def hit_at_3_mrr(spark: SparkSession, d: str) -> DataFrame:
    ranked = _rankings(spark, d)[0].where("id <> query_id")
    labels = _read(spark, d, "embeddings")
    q = labels.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), "label")
    return search.ranking_measures(ranked, q.join(labels.select(F.col("vec_id").alias("id"), "label"), "label").select("query_id", "id"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"), "value", "props")


def job_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest(_events(spark, d))


def job_counts(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest(_events(spark, d)).groupBy("status").agg(F.count("*").alias("jobs"), F.sum("events").alias("events"))


def jobs_alive(spark: SparkSession, d: str) -> DataFrame:
    x = _events(spark, d)
    now = x.agg(F.max("updated_at").alias("now"))
    return jobs.alive(jobs.latest(x).crossJoin(F.broadcast(now)), F.col("now")).select("job_id", "status", "updated_at")


def props_json(spark: SparkSession, d: str) -> DataFrame:
    k = tx.json_path(F.col("props"), "k").try_cast("bigint")
    return _read(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


def session_context(spark: SparkSession, d: str) -> DataFrame:
    return search.context(_read(spark, d, "conversations"), "conv_id", "turn").withColumn("no", F.col("no").cast("bigint"))


def dedup_prefix100(spark: SparkSession, d: str) -> DataFrame:
    return search.dedup_prefix(_read(spark, d, "documents"), F.col("doc_id")).select("doc_id", "source")


def payment_sum_check(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose lines don't add up to their price, as instalments must to a deposit."""
    x = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")), 2).cast("double").alias("lines"))
    o = _read(spark, d, "orders").join(x, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    bad = (F.col("o_totalprice") > 0) & (F.coalesce("lines", F.lit(0.0)) > 0) & (F.abs(F.col("lines") - F.col("o_totalprice")) > 0.005)
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.count_if(bad).alias("mismatches"))


def queue_order(spark: SparkSession, d: str) -> DataFrame:
    x = _read(spark, d, "orders")
    x = x.select(F.col("o_orderkey").alias("job_id"), F.greatest(F.lit(1), F.lit(4) - F.left("o_orderpriority", F.lit(1)).cast("int")).alias("priority"), F.col("o_orderdate").alias("arrived"))
    return jobs.queue_order(x).select("job_id", F.col("priority").cast("bigint").alias("priority"), F.col("place").cast("bigint").alias("place"))


def latency(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latency(_read(spark, d, "events"), "value", "event_type")


def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return jobs.histogram(_read(spark, d, "events"), "value", 5.0)


def pii_counts(spark: SparkSession, d: str) -> DataFrame:
    x = privacy.pii_counts(_read(spark, d, "documents"))
    return x.select("doc_id", *(F.col(n).cast("bigint").alias(n) for n, _ in privacy.PII))


def pii_masked(spark: SparkSession, d: str) -> DataFrame:
    x = _read(spark, d, "documents").select("doc_id", "text", privacy.masked(F.col("text")).alias("masked"))
    return x.where("masked <> text").select("doc_id", "masked")


def checksums(spark: SparkSession, d: str) -> DataFrame:
    x = _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return privacy.checksums(x)


def bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(_read(spark, d, "documents"), ["licensed", "apache", "version"], 25)


def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Boxes made of orders: a page a customer group, places by key."""
    x = _read(spark, d, "orders").select(
        (F.col("o_custkey") % 40).alias("doc_id"), F.col("o_orderkey").alias("pos"),
        (F.col("o_orderkey") * 37 % 900).alias("x"), (F.col("o_custkey") * 53 % 1100).alias("y"), (40 + F.col("o_orderkey") % 60).alias("w"), (30 + F.col("o_custkey") % 50).alias("h"),
    )
    return layout.overlapping_pairs(x, places=6).select("doc_id", "a", "b", "iou")


def rows_json(spark: SparkSession, d: str) -> DataFrame:
    x = _read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return files.as_json(x, "n_nationkey")


def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.collection_stats(_read(spark, d, "documents").withColumn("document_type", F.col("lang")))


def long_documents(spark: SparkSession, d: str) -> DataFrame:
    return search.long_documents(_read(spark, d, "documents")).select("doc_id")


def cancelled_jobs(spark: SparkSession, d: str) -> DataFrame:
    x = jobs.latest(_events(spark, d)).withColumn("status", F.when(F.col("job_id") % 3 == 0, "QUEUED").otherwise(F.col("status")))
    return jobs.cancelled(x.select("job_id", "status"), x.where("job_id % 2 = 0").select("job_id"))


def upserted_jobs(spark: SparkSession, d: str) -> DataFrame:
    table = _read(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_mktsegment").alias("status"))
    return jobs.upserted(table, jobs.latest(_events(spark, d)).select("job_id", "status"))


QUERIES = {f.__name__: f for f in (rule_scores, rule_findings, worker_scores, level_summary, phone_extract, html_to_text, line_numbers, vector_topk, vector_topk_filtered, vector_topk_one, vector_topk_collections, rrf_fusion, hit_at_3_mrr, job_latest_state, job_counts, jobs_alive, props_json, session_context, dedup_prefix100, payment_sum_check, queue_order, latency, latency_histogram, pii_counts, pii_masked, checksums, bm25, box_overlaps, rows_json, collection_stats, long_documents, cancelled_jobs, upserted_jobs)}

_FOUND = "SELECT doc_id, kind, name, weight_class FROM documents, (VALUES " + ", ".join(f"({i}, '{r.kind}', '{r.name}', '{r.weight_class}')" for i, r in enumerate(_RULES)) + ") r(i, kind, name, weight_class) WHERE CASE i " + " ".join(f"WHEN {i} THEN {_holds(r)}" for i, r in enumerate(_RULES)) + " END"
_NAMES = ", ".join("concat_ws(',', " + ", ".join(f"CASE WHEN {_holds(r)} THEN '{r.name}' END" for r in _RULES if r.kind == k) + f") AS {k}" for k in rules.API_POINTS)
_P = tx.PHONE.replace("'", "''")
_COS = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_SCORED = f"SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, round({_COS}, 9) AS score FROM embeddings v, embeddings q WHERE q.vec_id < 20"
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_SCORED})"
_TOP10 = f"SELECT * FROM ({_RANKED}) WHERE rank <= 10"
_EVEN10 = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_SCORED}) WHERE id % 2 = 0) WHERE rank <= 10"
_LATEST = "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated_at, count(*) AS events FROM events GROUP BY user_id"
_MASKED = "text"
for _, _pattern in privacy.PII:
    _MASKED = f"regexp_replace({_MASKED}, '{_pattern}', '{privacy.MASK}', 'g')"
SQL = {
    "rule_scores": f"SELECT doc_id, {_NAMES}, CAST(least({_POINTS['api']}, 100) AS DOUBLE) AS api_score, CAST(least({_POINTS['worker']}, 100) AS DOUBLE) AS worker_score FROM documents",
    "rule_findings": f"SELECT kind, name, weight_class, count(*) AS n FROM ({_FOUND}) GROUP BY ALL",
    "worker_scores": f"""SELECT doc_id, CAST(least(sum(CASE kind WHEN 'fraud' THEN 15 WHEN 'missing' THEN 10 ELSE 25 END), 100) AS DOUBLE) AS api_score,
  CAST(least(sum(CASE WHEN kind = 'illegal' THEN 25 ELSE CASE weight_class WHEN 'high' THEN 30 WHEN 'medium' THEN 15 WHEN 'critical' THEN 20 WHEN 'important' THEN 10 ELSE 5 END END), 100) AS DOUBLE) AS worker_score
  FROM ({_FOUND}) GROUP BY doc_id""",
    "level_summary": """SELECT l_orderkey AS task_id, count(*) AS total_clauses, count(*) FILTER (l_returnflag = 'R') AS risk_count, count(*) FILTER (l_returnflag = 'A') AS caution_count,
  count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS safety_count, round_even(count(*) FILTER (l_returnflag = 'R') / count(*) * 100, 1) AS risk_percentage FROM lineitem GROUP BY l_orderkey""",
    "phone_extract": f"""WITH p AS (SELECT doc_id, regexp_extract(text, '{_P}', 1) || '-' || regexp_extract(text, '{_P}', 2) || '-' || regexp_extract(text, '{_P}', 3) AS phone
  FROM documents WHERE regexp_matches(text, '{_P}')), d AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS n FROM p)
  SELECT doc_id, phone, CASE length(n) WHEN 11 THEN n[1:3] || '-' || n[4:7] || '-' || n[8:11] WHEN 10 THEN n[1:3] || '-' || n[4:6] || '-' || n[7:10] ELSE phone END AS phone_a,
  CASE WHEN length(n) >= 10 THEN n[1:3] || '-' || n[4:7] || '-' || n[8:11] ELSE phone END AS phone_b FROM d""",
    "html_to_text": r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'), ' ') AS text FROM pages""",
    "line_numbers": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
  SELECT doc_id, pos, CAST(sum(contains(line, 'icense')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS section, length(line) AS n_chars FROM l""",
    "vector_topk": f"SELECT query_id, id, round(score, 6) AS score, label, rank FROM ({_RANKED}) WHERE rank <= 4",
    "vector_topk_filtered": f"SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM ({_SCORED}) WHERE label = 3 AND score >= 0.1) WHERE r <= 5",
    "vector_topk_one": f"SELECT id, round(score, 6) AS score, label FROM ({_SCORED}) s WHERE s.query_id = 0 ORDER BY s.score DESC, id LIMIT 4",
    "vector_topk_collections": f"SELECT query_id, label AS collection, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS rank FROM ({_SCORED})) WHERE rank <= 2",
    "rrf_fusion": f"SELECT query_id, id, round(sum(1 / (60 + rank)), 9) AS score FROM ({_TOP10} UNION ALL {_EVEN10}) GROUP BY ALL",
    "hit_at_3_mrr": f"""WITH r AS (SELECT t.query_id, min(t.rank) FILTER (WHERE t.label = q.label) AS first FROM ({_TOP10}) t JOIN embeddings q ON q.vec_id = t.query_id WHERE t.id <> t.query_id GROUP BY t.query_id)
  SELECT round(avg(coalesce((first <= 3)::INT, 0)), 6) AS hit_at_k, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM r""",
    "job_latest_state": _LATEST,
    "job_counts": f"SELECT status, count(*) AS jobs, CAST(sum(events) AS BIGINT) AS events FROM ({_LATEST}) GROUP BY status",
    "jobs_alive": f"SELECT job_id, status, updated_at FROM ({_LATEST}) WHERE updated_at > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
    "props_json": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "session_context": """WITH h AS (SELECT conv_id, turn, text, row_number() OVER w AS no, '[' || row_number() OVER w || ']' || chr(10) AS head FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  s AS (SELECT *, length(head) + length(text) AS size, coalesce(sum(length(head) + length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h),
  p AS (SELECT conv_id, no, CASE WHEN before + size <= 2000 THEN head || text WHEN before <= 2000 AND 2000 - before > 100 THEN head || left(text, CAST(2000 - before - length(head) - 3 AS BIGINT)) || '...' END AS part FROM s)
  SELECT * FROM p WHERE part IS NOT NULL""",
    "dedup_prefix100": "SELECT doc_id, source FROM documents QUALIFY text IS NULL OR row_number() OVER (PARTITION BY left(text, 100) ORDER BY doc_id) = 1",
    "payment_sum_check": """WITH x AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS lines FROM lineitem GROUP BY l_orderkey)
  SELECT o_orderpriority, count(*) AS orders, count(*) FILTER (o_totalprice > 0 AND coalesce(lines, 0) > 0 AND abs(lines - o_totalprice) > 0.005) AS mismatches FROM orders LEFT JOIN x ON o_orderkey = l_orderkey GROUP BY o_orderpriority""",
    "queue_order": "WITH q AS (SELECT o_orderkey AS job_id, CAST(greatest(1, 4 - CAST(left(o_orderpriority, 1) AS INT)) AS BIGINT) AS priority, o_orderdate FROM orders) SELECT job_id, priority, row_number() OVER (ORDER BY priority DESC, o_orderdate, job_id) AS place FROM q",
    "latency": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
    "latency_histogram": "SELECT CAST(floor(value / 5) AS BIGINT) AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1",
    "pii_counts": "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p in privacy.PII) + " FROM documents",
    "pii_masked": f"SELECT * FROM (SELECT doc_id, {_MASKED} AS masked, text FROM documents) WHERE masked <> text".replace("SELECT * FROM (SELECT", "SELECT doc_id, masked FROM (SELECT", 1),
    "checksums": "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256 FROM documents",
    "bm25": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda v: v <> '') AS w FROM documents),
  n AS (SELECT doc_id, len(w) AS n, w FROM w), g AS (SELECT count(*) AS docs, avg(n) AS mean FROM n),
  t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM n) WHERE term IN ('licensed', 'apache', 'version') GROUP BY ALL),
  f AS (SELECT term, count(*) AS df FROM t GROUP BY term)
  SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM t JOIN f USING (term), g GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 25""",
    "box_overlaps": """WITH b AS (SELECT o_custkey % 40 AS doc_id, o_orderkey AS pos, o_orderkey * 37 % 900 AS x, o_custkey * 53 % 1100 AS y, 40 + o_orderkey % 60 AS w, 30 + o_custkey % 50 AS h FROM orders),
  p AS (SELECT a.doc_id, a.pos AS a, b.pos AS b, (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) AS dx, (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS dy, a.w * a.h + b.w * b.h AS area FROM b a JOIN b b ON a.doc_id = b.doc_id AND a.pos < b.pos)
  SELECT doc_id, a, b, round(dx * dy / (area - dx * dy), 6) AS iou FROM p WHERE dx > 0 AND dy > 0 AND dx * dy / (area - dx * dy) > 0.5""",
    "rows_json": """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation""",
    "collection_stats": "SELECT lang AS document_type, count(*) AS documents FROM documents GROUP BY lang",
    "long_documents": "SELECT doc_id FROM documents WHERE length(text) >= 400",
    "cancelled_jobs": f"SELECT job_id, CASE WHEN job_id % 3 = 0 THEN CASE WHEN job_id % 2 = 0 THEN 'CANCELLED' ELSE 'QUEUED' END ELSE status END AS status FROM ({_LATEST})",
    "upserted_jobs": f"SELECT c_custkey AS job_id, coalesce(l.status, c_mktsegment) AS status FROM customer LEFT JOIN ({_LATEST}) l ON c_custkey = l.job_id",
}
