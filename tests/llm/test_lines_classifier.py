import random

import numpy as np
import pyarrow as pa
from helpers import words

from leaselens.llm import line_dedup, quality_classifier
from leaselens.llm.common import strings


def _text_hash(text):
    """Spark's xxhash64 of a text, which parts rows of one id."""
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute_lines(rows, increments=2, several=False):
    seen, out = {}, {}
    texts = {(i, t) for i, t in rows if i is not None and t is not None}
    for part in range(increments):
        places = sorted((i, k, _text_hash(t), line) for i, t in texts if i % increments == part for k, line in enumerate(t.split("\n")))
        for i, k, h, line in places:
            if line.strip(" "):
                seen.setdefault(line, (i, k, h))
    for i, t in texts:
        kept = []
        for k, line in enumerate(t.split("\n")):
            if line.strip(" ") and seen[line] != (i, k, _text_hash(t)):
                continue
            kept.append(line)
        new = "\n".join(kept)
        if len(kept) == len(t.split("\n")) or new.replace("\n", " ").strip(" "):
            out.setdefault(i, []).append(new)
    return {i: sorted(v) if several else v[0] for i, v in out.items()}


def test_lines_match_brute_force(docs_of):
    r = random.Random(1)
    pool = [words(k, r.randint(1, 6)) for k in range(120)] + ["", "  "]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 8)))) for i in range(300)]
    got = line_dedup.dedup_lines(docs_of(rows))
    assert {g.doc_id: g.text for g in got.collect()} == brute_lines(rows)
    assert all(g.n_chars == len(g.text) for g in got.collect())


def test_line_edges(edges, edge_rows, none):
    assert line_dedup.dedup_lines(none).count() == 0
    got = line_dedup.dedup_lines(edges)
    assert got.columns == edges.columns
    rows = got.collect()
    ids = [r.doc_id for r in rows]
    # the even ids come first: 2 and 12 have the text of 1, 6 that of 7
    assert ids.count(None) == 2 and ids.count(1) == 0 and 2 in ids and 12 not in ids and 7 not in ids
    assert {3, 4, 5, 6, 8, 9, 10, 11} <= set(ids)
    assert next(r.text for r in rows if r.doc_id == 8) == next(e[1] for e in edge_rows if e[0] == 8)


def test_rows_of_one_id_lose_nothing(docs_of):
    """Different texts under one id are different documents; equal ones are one."""
    r = random.Random(8)
    pool = [words(k, r.randint(1, 6)) for k in range(60)]
    rows = [(3, "dup line"), (4, "unique A0\nunique A1"), (4, "fresh B0\ndup line"), (4, "fresh B0\ndup line")]
    rows += [(r.randint(10, 40), "\n".join(r.choice(pool) for _ in range(r.randint(1, 5)))) for _ in range(120)]
    got: dict = {}
    for g in line_dedup.dedup_lines(docs_of(rows)).collect():
        got.setdefault(g.doc_id, set()).add(g.text)
    assert got == {i: set(v) for i, v in brute_lines(rows, several=True).items()}
    assert got[4] == {"unique A0\nunique A1", "fresh B0\ndup line"}


def test_index_counts_each_document_once(spark, docs_of):
    """Inserting or deleting again, or what isn't there, changes nothing."""
    first = docs_of([(1, "a\nb"), (2, "b\nc"), (1, "a\nb"), (1, "x\nb")])
    index = line_dedup.LineIndex.empty(spark).insert(first)[1]
    refs = {tuple(r) for r in index.refs.collect()}
    assert sorted(r[2] for r in refs) == [1, 1, 1, 3] and index.ledger.count() == 3
    dropped, again = index.insert(first)
    assert dropped.count() == 0 and {tuple(r) for r in again.refs.collect()} == refs
    one = docs_of([(1, "a\nb"), (1, "a\nb"), (9, "c"), (2, "other text")])
    less = index.delete(one).delete(one)
    assert sorted(r.refs for r in less.refs.collect()) == [1, 1, 2]
    assert {(r.doc_id, r.line_no) for r in less.insert(docs_of([(7, "a\nb\nc")]))[0].collect()} == {(7, 1), (7, 2)}


def test_index_grows_new_shards(spark, docs_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 20)
    index = line_dedup.LineIndex.empty(spark).insert(docs_of([(1, words(1, 20).replace(" ", "\n"))]))[1]
    assert index.shards == 1
    index = index.insert(docs_of([(2, words(2, 150).replace(" ", "\n"))]))[1]
    assert index.shards > 4
    index = index.delete(docs_of([(1, words(1, 20).replace(" ", "\n"))]))
    gone = [line for line in words(1, 20).split() if line not in words(2, 150).split()]
    assert index.insert(docs_of([(3, "\n".join(dict.fromkeys(gone)))]))[0].count() == 0
    assert index.insert(docs_of([(4, "\n".join(dict.fromkeys(words(2, 150).split())))]))[0].count() == len(set(words(2, 150).split()))


def test_insert_and_delete_are_inverse(spark, docs_of, tmp_path):
    first, second = docs_of([(1, "a\nb\nc"), (2, "b\nd")]), docs_of([(3, "c\nd\ne"), (4, "e\nf")])
    dropped, index = line_dedup.LineIndex.empty(spark).insert(first)
    assert {(r.doc_id, r.line_no) for r in dropped.collect()} == {(2, 0)}
    before = {tuple(r) for r in index.refs.collect()}
    dropped, more = index.insert(second)
    assert {(r.doc_id, r.line_no) for r in dropped.collect()} == {(3, 0), (3, 1), (4, 0)}
    more.save(str(tmp_path / "v2"))
    more = line_dedup.LineIndex.load(spark, str(tmp_path / "v2"))
    less = more.delete(second)
    assert {tuple(r) for r in less.refs.collect()} == before
    again, _ = less.insert(second)
    assert {(r.doc_id, r.line_no) for r in again.collect()} == {(3, 0), (3, 1), (4, 0)}
    gone = less.delete(first)
    assert gone.refs.count() == 0
    fresh, _ = gone.insert(second)
    assert {(r.doc_id, r.line_no) for r in fresh.collect()} == {(4, 0)}
    wide = more.resharded(5)
    assert {(r.doc_id, r.line_no) for r in wide.insert(docs_of([(9, "a\nz")]))[0].collect()} == {(9, 0)}
    assert wide.filters.count() <= 5


def test_cuckoo_filter_holds_and_forgets():
    r = np.random.default_rng(0)
    h = r.integers(0, 2**63, 30_000).astype(np.uint64)
    f = line_dedup.Cuckoo.build(h[:20_000])
    assert f.has(h[:20_000]).all()
    assert f.has(h[20_000:]).mean() < 0.01
    f.remove(h[:15_000])
    assert f.has(h[15_000:20_000]).all() and f.has(h[:15_000]).mean() < 0.01
    assert f.add(h[20_000:]) and f.has(h[15_000:]).all()


def test_features_count_junk():
    rows = ["", "AB cd!! cd!! x|y 12", "go go go stop"]
    x = quality_classifier.features(strings(pa.array(rows)))
    assert (x[0] == 0).all()
    by = dict(zip(quality_classifier.FEATURES, x[1]))
    assert by["upper"] == 2 / 8 and by["exclaims"] == 4 / 5 and by["pipes"] == 1 / 5 and by["repeats"] == 1 / 5
    assert x[2][quality_classifier.FEATURES.index("repeats")] == 2 / 4


def test_pairwise_fit_matches_gradient_descent():
    r = np.random.default_rng(1)
    good, poor = r.normal(1, 1, (40, 9)), r.normal(0, 1, (30, 9))
    m = quality_classifier.fit_pairs(good, poor, ridge=0.05)
    mean, scale, w = np.array(m.mean), np.array(m.scale), np.zeros(9)
    g, p = (good - mean) / scale, (poor - mean) / scale
    pairs = [(i, (k * 7919 + 3) % 30) for k, i in enumerate(np.repeat(np.arange(40), 5))] + [(k % 40, k) for k in range(30)]
    d = np.array([g[i] - p[j] for i, j in pairs])
    for _ in range(20_000):
        w += 0.1 * ((d / (1 + np.exp(d @ w))[:, None]).mean(0) - 0.05 * w)
    assert np.allclose(w, m.weights, atol=1e-4)


def junk(seed):
    r = random.Random(seed)
    w = words(seed, 40).split()
    return r.choice([" ".join(x.upper() + "!!" for x in w), " | ".join(w), " ".join(x for x in w for _ in range(9)), " ".join(x + "###" for x in w)])


def test_classifier_on_held_out_rows(spark, docs_of):
    rows = [(i, junk(i) if i % 7 == 0 else words(i, 60).capitalize() + ".") for i in range(700)]
    labels = spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(0, 700, 2)] + [(None, 1, 0), (5000, 0, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    docs = docs_of(rows)
    got = {r.doc_id: r.keep for r in quality_classifier.classify(docs, labels).collect()}
    held = [i for i in got if i % 2]
    assert np.mean([got[i] == (i % 7 > 0) for i in held]) > 0.98
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_threshold_bears_wrong_labels(spark, docs_of):
    """Of the good labels 3 % are on junk, of the poor ones 5 % on good texts: the threshold still parts the texts."""
    rows = [(i, junk(i) if i % 7 == 0 else words(i, 60).capitalize() + ".") for i in range(1400)]
    wrong = random.Random(3)
    labels = spark.createDataFrame([(i, int((i % 7 > 0) != (wrong.random() < (0.2 if i % 7 == 0 else 0.008))), 0) for i in range(1400)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality_classifier.classify(docs_of(rows), labels).collect()}
    assert np.mean([got[i] for i in got if i % 7]) > 0.98 and np.mean([not got[i] for i in got if i % 7 == 0]) > 0.95


def test_threshold_is_a_quantile_of_the_good(spark):
    rows = [(float(s), 1) for s in range(100, 200)] + [(float(s), 0) for s in range(0, 103)]
    x = spark.createDataFrame(rows, "score double, quality int")
    assert quality_classifier.quantile_threshold(x) == 102.5 or 99 < quality_classifier.quantile_threshold(x) <= 103
    assert quality_classifier.quantile_threshold(x, 0.0) <= 100
    assert quality_classifier.quantile_threshold(x.where("quality = 1")) is None


def test_classifier_edges(spark, edges, none):
    schema = "doc_id bigint, quality int, toxic int"
    no_labels = spark.createDataFrame([], schema)
    assert quality_classifier.classify(none, no_labels).count() == 0
    assert quality_classifier.keep_good(edges, no_labels).count() == edges.count()
    one_class = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], schema)
    rows = quality_classifier.classify(edges, one_class).collect()
    assert all(r.keep and r.score == 0 for r in rows) and [r.doc_id for r in rows].count(1) == 2 and len(rows) == 12
    both = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (9, 0, 0)], schema)
    kept = [r.doc_id for r in quality_classifier.keep_good(edges, both).collect()]
    assert 9 not in kept and kept.count(1) == 2 and 3 in kept and None in kept
