"""Host-level quality rules: failure rates by domain, shrunk by an empirical beta prior.

Each document is tried by the RULES. Failures are counted by domain and rule, and
for failing any rule; a domain's rate is shrunk towards the mean of all domains' rates by a beta
prior, whose strength comes from their variance beyond what sampling explains.
A domain whose shrunk rate of any rule, or of failing one at all, passes HOST_LIMIT is rejected, and
its verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, checkpointed, page_ids, small_batches, table

HOST_LIMIT = 0.6
MIN_STRENGTH, MAX_STRENGTH = 1.0, 10_000.0
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = ("few_words", "symbols", "exclaims", "digits", "shouting", "repetitive")
#: Domains of more than that part of all rows are joined by broadcast; there are at most as many as its inverse.
HOT_SHARE = 1e-4


def _holds(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def rule_failures(text: Column, words: Column) -> list[Column]:
    """Whether a text fails each of RULES, as 0 or 1; words is the array of its words.

    Characters are held against the text's length and not its words, so that scripts without spaces aren't misjudged.
    """
    n, size = F.size(words), F.length(text)
    return [
        F.when(c, 1).otherwise(0).alias(name)
        for name, c in zip(
            RULES,
            (
                (n < 5) & (size < 100),
                30 * _holds(text, "#$%&*|~^<>{}=\\") > size,
                30 * _holds(text, "!?") > size,
                3 * _holds(text, "0123456789") > size,
                2 * _holds(text, UPPER) > size,
                (n >= 50) & (10 * F.size(F.array_distinct(words)) < n),
            ),
        )
    ]


def page_domains(pages: DataFrame) -> DataFrame:
    """doc_id, domain: of the documents that pages link to by the number that ends their address; a row for each of its domains."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^(?:www|m)\.", "")
    return pages.select(page_ids(F.col("url")).alias("doc_id"), host.alias("domain")).where("doc_id is not null and domain <> ''").distinct()


def host_verdicts(judged: DataFrame) -> DataFrame:
    """domain, n, host_rate (its highest shrunk rate), host_rejected, from rows of domain and RULES."""
    tried = (*RULES, "any_rule")
    counts = judged.withColumn("any_rule", F.greatest(*RULES)).groupBy("domain").agg(F.count("*").alias("n"), *(F.sum(r).alias(r) for r in tried))
    long = checkpointed(counts.select("domain", "n", F.posexplode(F.array(*tried)).alias("rule", "failed")))
    rate = F.col("failed") / F.col("n")
    prior = long.groupBy("rule").agg(F.avg(rate).alias("mean"), (F.var_pop(rate)).alias("var"), F.avg(1 / F.col("n")).alias("inverse"))
    noise = F.col("mean") * (1 - F.col("mean"))
    excess = F.col("var") - noise * F.col("inverse")
    strength = F.when(excess > 1e-12, F.least(F.greatest(noise / excess - 1, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH))).otherwise(MAX_STRENGTH)
    prior = prior.select("rule", "mean", strength.alias("strength"))
    shrunk = (F.col("failed") + F.col("strength") * F.col("mean")) / (F.col("n") + F.col("strength"))
    by = long.join(F.broadcast(prior), "rule").groupBy("domain").agg(F.first("n").alias("n"), F.round(F.max(shrunk), 6).alias("host_rate"))
    return by.select("domain", "n", "host_rate", (F.col("host_rate") > HOST_LIMIT).alias("host_rejected"))


def _with_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """rows joined with verdicts on domain: by broadcast, or, of many domains, by broadcast of the hot ones and a shuffle of the rest."""
    verdicts = checkpointed(verdicts)
    if verdicts.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(verdicts.drop("n")), "domain")
    limit = HOT_SHARE * verdicts.agg(F.sum("n")).first()[0]
    hot, rest = (F.broadcast(verdicts.where(F.col("n") > limit).drop("n")), verdicts.where(F.col("n") <= limit).drop("n"))
    return rows.join(hot, "domain").unionByName(rows.join(hot.select("domain"), "domain", "left_anti").join(rest, "domain"))


def judge(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, domain, failures, host_rate, host_rejected, keep: a row for each row of docs that has a doc_id.

    A document's domains are those of its pages; without a page it is its source,
    written source:NAME (NAME empty for null). Each of them is charged with its
    failures, and the one of the greatest host_rate (of equal ones, the least) gives its domain and
    verdict: it is rejected if any of them is. failures counts the rules that it
    fails; keep means that it fails none and no host of it is rejected. A null text is
    judged like an empty one (few_words). Rows that repeat a doc_id count, and come
    out, one by one. Several pages of a document on a domain count once; pages of no
    document, and null or odd addresses, count for nothing. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"))
    own = own.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).select("doc_id", "source", *rule_failures(F.col("text"), F.col("words")))
    of = page_domains(pages).groupBy("doc_id").agg(F.collect_set("domain").alias("domains"))
    own = own.join(of, "doc_id", "left").withColumn("domains", F.coalesce("domains", F.array(F.concat(F.lit("source:"), F.coalesce("source", F.lit("")))))).withColumn("row", F.monotonically_increasing_id())
    judged = checkpointed(own.select("row", "doc_id", F.explode("domains").alias("domain"), *RULES))
    failures = sum((F.col(r) for r in RULES[1:]), F.col(RULES[0]))
    x = _with_verdicts(judged.select("row", "doc_id", "domain", failures.cast("int").alias("failures")), host_verdicts(judged))
    worst = F.min_by(F.struct("domain", "host_rate", "host_rejected"), F.struct(-F.col("host_rate"), "domain")).alias("of")
    x = x.groupBy("row", "doc_id", "failures").agg(worst).select("doc_id", "failures", "of.*")
    return x.select("doc_id", "domain", "failures", "host_rate", "host_rejected", ((F.col("failures") == 0) & ~F.col("host_rejected")).alias("keep"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


QUERIES = {"op8_quality_rules": op8_quality_rules}
SQL = {
    "op8_quality_rules": """
WITH p AS (SELECT DISTINCT doc_id, domain FROM (
    SELECT TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)(?:\\.html|/)?(?:[?#].*)?$', 1), '') AS BIGINT) AS doc_id,
           regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^(?:www|m)\\.', '') AS domain FROM pages)
  WHERE doc_id IS NOT NULL AND domain <> ''),
t AS (SELECT row_number() OVER () AS row_no, doc_id, source, coalesce(text, '') AS t, length(coalesce(text, '')) AS size, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w
      FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT row_no, doc_id, source, [(len(w) < 5 AND size < 100)::INT, (30 * (size - length(translate(t, '#$%&*|~^<>{}=\\', ''))) > size)::INT, (30 * (size - length(translate(t, '!?', ''))) > size)::INT,
        (3 * (size - length(translate(t, '0123456789', ''))) > size)::INT, (2 * (size - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > size)::INT,
        (len(w) >= 50 AND 10 * len(list_distinct(w)) < len(w))::INT] AS f FROM t),
d AS (SELECT r.*, coalesce(p.domain, 'source:' || coalesce(source, '')) AS domain FROM r LEFT JOIN p USING (doc_id)),
l AS (SELECT domain, rule, count(*)::DOUBLE AS n, sum(CASE WHEN rule = 7 THEN list_max(f) ELSE f[rule] END)::DOUBLE AS failed FROM d, range(1, 8) x(rule) GROUP BY domain, rule),
m AS (SELECT rule, avg(failed / n) AS mean, var_pop(failed / n) AS var, avg(1 / n) AS inverse FROM l GROUP BY rule),
s AS (SELECT rule, mean, CASE WHEN var - mean * (1 - mean) * inverse > 1e-12 THEN least(greatest(mean * (1 - mean) / (var - mean * (1 - mean) * inverse) - 1, 1), 10000) ELSE 10000 END AS strength FROM m),
h AS (SELECT domain, round(max((failed + strength * mean) / (n + strength)), 6) AS host_rate FROM l JOIN s USING (rule) GROUP BY domain),
v AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY host_rate DESC, domain) AS place FROM d JOIN h USING (domain))
SELECT doc_id, domain, CAST(list_sum(f) AS INT) AS failures, host_rate, host_rate > 0.6 AS host_rejected, list_sum(f) = 0 AND host_rate <= 0.6 AS keep FROM v WHERE place = 1
"""
}
