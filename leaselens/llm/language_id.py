"""Language identification by Bayesian fusion of text and web evidence.

The text's likelihood is that of its byte pairs, with counts by language over
all labelled documents. A document's pages add the languages that their markup
declares, the suffixes of their addresses, and their hosts' priors. The probabilities of
declarations and suffixes given a language, and host priors, are grouped counts of
the texts' own best languages, of which a document's own is taken off where it is judged; a host's
prior is smoothed towards its site's (the host without its first label), and that towards the prior of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, page_ids, raw, slices, small, small_batches, strings, table

#: Added to each byte pair's count; documents' worth of the parent prior; added to each count of a declaration or suffix.
SMOOTH, PRIOR_WEIGHT, EVIDENCE_SMOOTH = 0.5, 20.0, 1.0
#: Byte pairs overlap and repeat, so n of them weigh like n to this power.
EFFECTIVE = 0.5
#: Languages whose counts a worker holds before it gives them away, at half a megabyte each.
HELD = 64
_LOWER = np.arange(256, dtype=np.uint16)
_LOWER[ord("A") : ord("Z") + 1] += 32


def byte_pairs(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of neighbouring bytes (A to Z as a to z) of texts, first places and numbers of them by text."""
    data, at = raw(part)
    low = _LOWER[data]
    pairs = low[:-1] * np.uint16(256) + low[1:] if len(low) > 1 else np.zeros(0, np.uint16)
    return pairs, at[:-1], np.maximum(np.diff(at) - 1, 0)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, pair, n), of a whole partition unless it has more than HELD languages."""
    total: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, count in total.items():
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(count[some])], ["lang", "pair", "n"])
        total.clear()

    for b in batches:
        langs = np.array(b.column(1).to_pylist(), object)
        for lo, part in slices(strings(b.column(0))):
            pairs, at, n = byte_pairs(part)
            mine = langs[lo : lo + len(part)]
            for lang in sorted(set(mine.tolist())):
                if len(total) >= HELD and lang not in total:
                    yield from flush()
                count = total.setdefault(lang, np.zeros(65536, np.int64))
                inside = np.zeros(len(pairs) + 1, np.int32)
                on = (mine == lang) & (n > 0)
                np.add.at(inside, at[on], 1)
                np.add.at(inside, (at + n)[on], -1)
                count += np.bincount(pairs[np.cumsum(inside[:-1]) > 0], minlength=65536)
    yield from flush()


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log probability of each byte pair in each; from all rows with text and lang. Half a megabyte a language."""
    own = docs.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = own.mapInArrow(_count_rows, "lang string, pair int, n bigint").groupBy("lang", "pair").agg(F.sum("n").alias("n")).toArrow()
    lang = np.array(rows["lang"].to_pylist(), object)
    names = sorted(set(lang.tolist()))
    counts = np.zeros((len(names), 65536))
    for i, name in enumerate(names):
        counts[i, rows["pair"].to_numpy()[lang == name]] = rows["n"].to_numpy()[lang == name]
    return names, np.log((counts + SMOOTH) / (counts + SMOOTH).sum(1, keepdims=True)) if names else counts


def log_likelihoods(array: pa.Array, model: np.ndarray) -> np.ndarray:
    """A row of log likelihoods, one for each language, for each text; 0 for texts of less than two bytes."""
    out = [np.zeros((0, len(model)))]
    for _, part in slices(array):
        pairs, at, n = byte_pairs(part)
        x, some = np.zeros((len(part), len(model))), n > 0
        if some.any():
            # between a text's last pair and the next text's first lies one pair that is of neither
            edges = np.column_stack([at[some], at[some] + n[some]]).ravel()
            for i, logs in enumerate(model):
                values = np.append(logs[pairs], 0.0)
                x[some, i] = np.add.reduceat(values, edges, dtype=np.float64)[::2]
        out.append(x * np.maximum(n, 1)[:, None] ** (EFFECTIVE - 1))
    return np.concatenate(out)


def _likelihood_rows(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = log_likelihoods(strings(b.column(1)), model.value)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "ll"])

    return run


def page_evidence(pages: DataFrame) -> DataFrame:
    """doc_id, declared, suffix, host, site: distinct rows of the pages that link to documents by the number that ends their address."""
    low = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    none = lambda c: F.nullif(c, F.lit(""))
    x = pages.select(
        page_ids(F.col("url")).alias("doc_id"), none(F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))).alias("declared"),
        none(F.regexp_extract(low, r"\.([a-z]+)$", 1)).alias("suffix"), none(low).alias("host"),
    ).where("doc_id is not null").distinct()
    return x.withColumn("site", F.coalesce(none(F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1)), F.col("host")))


def _best(scores: Column) -> Column:
    """The first place, from 1, of the greatest score."""
    return F.array_position(scores, F.array_max(scores))


def identify(docs: DataFrame, pages: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """doc_id, lang, p, text_lang, declared, suffix, host: the likeliest language of each row of docs that has a doc_id.

    model is that of fit(docs) unless given. p is the posterior probability, rounded to
    6 places; equal ones go to the first language in alphabetical order. text_lang is the best by
    the text alone, null without text. All pages of a document count: each distinct declaration and suffix
    is evidence, of several hosts the mean of their priors' logarithms; declared, suffix and host list them in
    order, parted by commas. A document without a page has null evidence, which
    counts for nothing; so does an unknown declaration, which has equal probability
    in all languages. Null, empty and one-byte texts are judged by their pages and the prior. Rows that
    repeat a doc_id come out one by one. Without any labelled text, lang and p are null. An
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    names, logs = fit(docs) if model is None else model
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    evidence = page_evidence(pages)
    listed = evidence.groupBy("doc_id").agg(*(F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ","), F.lit("")).alias(c) for c in ("declared", "suffix", "host")))
    if not names:
        null = F.lit(None).cast("string")
        return own.join(listed, "doc_id", "left").select("doc_id", null.alias("lang"), F.lit(None).cast("double").alias("p"), null.alias("text_lang"), "declared", "suffix", "host")
    k = len(names)
    lls = own.mapInArrow(_likelihood_rows(docs.sparkSession.sparkContext.broadcast(logs)), "doc_id bigint, ll array<double>")
    x = lls.withColumn("best", F.when(F.exists("ll", lambda v: v != 0), _best(F.col("ll"))).otherwise(0).cast("int")).withColumn("row", F.monotonically_increasing_id())
    x = checkpointed(x)
    # each piece of evidence of a row once: kind h is a host, d a declaration, s a suffix
    piece = lambda kind, key, site: F.struct(F.lit(kind).alias("kind"), key.alias("key"), site.alias("site"))
    none = F.lit(None).cast("string")
    of = F.explode(F.array(piece("h", F.col("host"), F.col("site")), piece("d", F.col("declared"), none), piece("s", F.col("suffix"), none))).alias("e")
    found = checkpointed(x.select("row", "doc_id", "best").join(evidence, "doc_id").select("row", "best", of).select("row", "best", "e.*").where("key is not null").distinct())
    counts = lambda df, *by: df.where("best > 0").groupBy(*by).agg(F.array(*(F.count_if(F.col("best") == i + 1) for i in range(k))).alias("n"))
    numbers = lambda v: F.array(*(F.lit(float(i)) for i in v))
    total = numbers(counts(x).first()["n"])
    by_key = checkpointed(counts(found, "kind", "key"))
    kinds = {r["kind"]: (r["kinds"] + 1, [r[f"n{i}"] for i in range(k)]) for r in by_key.groupBy("kind").agg(F.count("*").alias("kinds"), *(F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(k))).collect()}
    by_site = counts(found.where("kind = 'h'").select("row", "best", "site").distinct(), "site").withColumnRenamed("n", "site_n")
    mine = F.array(*((F.col("best") == i + 1).cast("double") for i in range(k)))
    known = (F.col("best") > 0).cast("double")
    whole = lambda n: F.aggregate(n, F.lit(0.0), lambda a, v: a + v)
    others = lambda n: F.zip_with(F.coalesce(n, numbers([0] * k)), mine, lambda v, o: v - o)
    prior = F.transform(others(total), lambda v: (v + 1) / (whole(total) - known + k))

    def smoothed(n: Column, parent: Column) -> Column:
        return F.zip_with(n, parent, lambda v, p: (v + F.lit(PRIOR_WEIGHT) * p) / (whole(n) + F.lit(PRIOR_WEIGHT)))

    def given(kind: str) -> Column:
        """Log probabilities of a value given each language; values that no other text has share what is left equally."""
        several, of_all = kinds.get(kind, (1, [0] * k))
        return F.zip_with(others(F.col("n").cast("array<double>")), others(numbers(of_all)), lambda v, t: F.log((v + F.lit(EVIDENCE_SMOOTH)) / (t + F.lit(EVIDENCE_SMOOTH * several))))

    joined = found.join(small(by_key), ["kind", "key"], "left").join(small(by_site), "site", "left")
    host = smoothed(others(F.col("n").cast("array<double>")), smoothed(others(F.col("site_n").cast("array<double>")), prior))
    value = F.when(F.col("kind") == "h", F.transform(host, lambda v: F.log(v))).when(F.col("kind") == "d", given("d")).otherwise(given("s"))
    hosted = F.col("kind") == "h"
    joined = joined.select("row", "kind", value.alias("v"))
    sums = joined.groupBy("row").agg(F.array(*(F.avg(F.when(hosted, F.col("v")[i])) for i in range(k))).alias("host_log"), F.array(*(F.coalesce(F.sum(F.when(~hosted, F.col("v")[i])), F.lit(0.0)) for i in range(k))).alias("page_log"))
    x = x.join(sums, "row", "left").join(listed, "doc_id", "left")
    flat = F.transform(prior, lambda v: F.log(v))
    score = F.zip_with(F.col("ll"), F.when(F.col("host_log")[0].isNotNull(), F.col("host_log")).otherwise(flat), lambda a, b: a + b)
    x = x.withColumn("score", F.zip_with(score, F.coalesce("page_log", numbers([0] * k)), lambda a, b: a + b))
    top = F.array_max("score")
    p = 1 / F.aggregate(F.transform("score", lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
    name = F.array(*(F.lit(n) for n in names))
    return x.select("doc_id", F.element_at(name, _best(F.col("score")).cast("int")).alias("lang"), F.round(p, 6).alias("p"), F.get(name, F.col("best") - 1).alias("text_lang"), "declared", "suffix", "host")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


QUERIES = {"op3_language_id": op3_language_id}
SQL = {
    "op3_language_id": """
WITH t AS (SELECT row_number() OVER () AS row_no, doc_id, lang, hex(encode(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS h FROM documents),
b AS (SELECT row_no, lang, doc_id, substr(h, 2 * i - 1, 4) AS pair, count(*)::DOUBLE AS c FROM (SELECT *, unnest(range(1, len(h) // 2)) AS i FROM t WHERE len(h) >= 4) GROUP BY ALL),
names AS (SELECT DISTINCT lang FROM b WHERE lang IS NOT NULL),
n AS (SELECT lang, pair, sum(c) AS c FROM b WHERE lang IS NOT NULL GROUP BY lang, pair),
z AS (SELECT lang, sum(c) + 0.5 * 65536 AS z FROM n GROUP BY lang),
ll AS (SELECT row_no, z.lang, sum(b.c * ln((coalesce(n.c, 0) + 0.5) / z)) / sqrt(sum(b.c)) AS ll FROM b CROSS JOIN z LEFT JOIN n ON n.lang = z.lang AND n.pair = b.pair WHERE doc_id IS NOT NULL GROUP BY row_no, z.lang),
x AS (SELECT t.row_no, t.doc_id, best FROM t LEFT JOIN (SELECT row_no, arg_max(lang, (ll, -ord)) AS best FROM (SELECT *, dense_rank() OVER (ORDER BY lang) AS ord FROM ll) GROUP BY row_no) USING (row_no) WHERE doc_id IS NOT NULL),
pages_ AS (SELECT TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)(?:\\.html|/)?(?:[?#].*)?$', 1), '') AS BIGINT) AS doc_id, nullif(lower(regexp_extract(html, '(?i)<html\\b[^>]*?\\slang\\s*=\\s*["'']?([a-z]{2,3})', 1)), '') AS declared,
             lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS low FROM pages),
e AS (SELECT DISTINCT doc_id, declared, nullif(regexp_extract(low, '\\.([a-z]+)$', 1), '') AS suffix, nullif(low, '') AS host, coalesce(nullif(regexp_extract(low, '^[^.]+\\.(.+\\..+)$', 1), ''), nullif(low, '')) AS site FROM pages_ WHERE doc_id IS NOT NULL),
f AS (SELECT DISTINCT row_no, best, kind, key, site FROM (SELECT row_no, best, unnest([{'kind': 'h', 'key': host, 'site': site}, {'kind': 'd', 'key': declared, 'site': NULL}, {'kind': 's', 'key': suffix, 'site': NULL}], recursive := true) FROM x JOIN e USING (doc_id)) WHERE key IS NOT NULL),
a AS (SELECT lang, count(best)::DOUBLE AS n FROM names LEFT JOIN x ON best = lang GROUP BY lang),
kn AS (SELECT kind, key, lang, count_if(best = lang)::DOUBLE AS n FROM f, names WHERE best IS NOT NULL GROUP BY kind, key, lang),
sn AS (SELECT site, lang, count_if(best = lang)::DOUBLE AS n FROM (SELECT DISTINCT row_no, best, site FROM f WHERE kind = 'h'), names WHERE best IS NOT NULL GROUP BY site, lang),
kt AS (SELECT kind, lang, sum(n) AS n, count(*) + 1 AS several FROM kn GROUP BY kind, lang),
pr AS (SELECT row_no, doc_id, best, lang, (n - own + 1) / (sum(n - own) OVER (PARTITION BY row_no) + count(*) OVER (PARTITION BY row_no)) AS prior, own FROM (SELECT x.*, a.*, coalesce((best = lang)::INT, 0) AS own FROM x, a)),
v1 AS (SELECT f.*, lang, prior, own, coalesce(sn.n, 0) - own AS sn, coalesce(kn.n, 0) - own AS kn FROM f JOIN pr USING (row_no) LEFT JOIN sn USING (site, lang) LEFT JOIN kn USING (kind, key, lang)),
v2 AS (SELECT *, (sn + 20 * prior) / (sum(sn) OVER w + 20) AS site_prior FROM v1 WINDOW w AS (PARTITION BY row_no, kind, key)),
v3 AS (SELECT v2.row_no, v2.lang, kind, CASE WHEN kind = 'h' THEN ln((kn + 20 * site_prior) / (sum(kn) OVER w + 20)) ELSE ln((kn + 1) / (coalesce(kt.n, 0) - own + coalesce(several, 1))) END AS v FROM v2 LEFT JOIN kt USING (kind, lang) WINDOW w AS (PARTITION BY v2.row_no, kind, key)),
s AS (SELECT pr.row_no, pr.doc_id, best, pr.lang, coalesce(ll, 0) + coalesce(host_log, ln(prior)) + coalesce(page_log, 0) AS score
      FROM pr LEFT JOIN ll USING (row_no, lang) LEFT JOIN (SELECT row_no, lang, avg(v) FILTER (kind = 'h') AS host_log, sum(v) FILTER (kind <> 'h') AS page_log FROM v3 GROUP BY row_no, lang) USING (row_no, lang)),
l AS (SELECT doc_id, nullif(array_to_string(list_sort(list(DISTINCT declared)), ','), '') AS declared, nullif(array_to_string(list_sort(list(DISTINCT suffix)), ','), '') AS suffix, nullif(array_to_string(list_sort(list(DISTINCT host)), ','), '') AS host FROM e GROUP BY doc_id),
r AS (SELECT *, score - max(score) OVER w AS d, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, lang) AS place FROM s WINDOW w AS (PARTITION BY row_no))
SELECT r.doc_id, max(CASE WHEN place = 1 THEN lang END) AS lang, round(1 / sum(exp(d)), 6) AS p, any_value(best) AS text_lang, any_value(declared) AS declared, any_value(suffix) AS suffix, any_value(host) AS host
FROM r LEFT JOIN l USING (doc_id) GROUP BY row_no, r.doc_id
"""
}
