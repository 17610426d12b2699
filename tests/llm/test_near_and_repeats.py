import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from helpers import words
from hypothesis import given, settings
from hypothesis import strategies as st

from leaselens.llm import common, ngram_join, suffix_dedup

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def gram_set(text, n):
    w = text.encode().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_pairs(rows, n=2, t=0.75):
    sets = {(i, x): gram_set(x, n) for i, x in rows if i is not None and x}
    out = set()
    for (i, x), a in sets.items():
        for (j, y), b in sets.items():
            if i < j and a and b and len(a & b) / len(a | b) >= t:
                out.add((i, j, round(len(a & b) / len(a | b), 6)))
    return out


def edited(text, share, r):
    return " ".join(words(r.randint(0, 10**9), 1) if r.random() < share else w for w in text.split())


def copies(seed, groups=25, alone=40):
    r = random.Random(seed)
    shared = [words(1000 + k, 12) for k in range(4)]
    rows = [(i, words(i, r.randint(1, 80))) for i in range(alone)]
    for g in range(groups):
        base = "\n".join([*r.sample(shared, 2), words(5000 + g, r.randint(2, 90))])
        rows += [(len(rows) + k, edited(base, r.choice([0, 0.01, 0.03, 0.06, 0.1]), r)) for k in range(r.choice([2, 2, 3, 9]))]
    return rows


@pytest.mark.parametrize("n,t", [(2, 0.75), (1, 0.6), (3, 0.5)])
def test_join_matches_brute_force(docs_of, n, t):
    rows = copies(n)
    got = ngram_join.similar_pairs(docs_of(rows), n, t).collect()
    assert len(got) == len(set(got))
    assert {tuple(g) for g in got} == brute_pairs(rows, n, t)


def test_frequent_ngrams_keep_the_join_exact(docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY_LEAST", 2)
    rows = copies(9)
    assert {tuple(g) for g in ngram_join.similar_pairs(docs_of(rows)).collect()} == brute_pairs(rows)


def brute_classes(rows):
    sets = [(i, set(g)) for i, g in {(i, frozenset(gram_set(x, 2))) for i, x in rows if i is not None and x and gram_set(x, 2)}]
    pairs = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[k + 1 :] if i != j and len(a & b) / len(a | b) >= 0.75]
    root, before = {i: i for i, _ in rows if i is not None}, None
    while root != before:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return {(i, v, sum(i in p for p in pairs)) for i, v in root.items()}


def test_classes_have_a_row_for_each_document(edges, edge_rows, docs_of, none):
    """Copies, near copies, chains, several texts of a doc_id, and documents like no other: as many rows as documents, and no link lost."""
    assert ngram_join.similar_classes(none).count() == 0
    base, other = words(79, 60), words(80, 60)
    rows = copies(12, 8, 10) + [(i, base) for i in range(900, 930)] + [(i, base + " tail") for i in range(930, 935)]
    rows += [(950, base), (950, base + " end"), (950, other), (951, other), (952, None)]
    for docs, own in ((edges, [r[:2] for r in edge_rows]), (docs_of(rows), rows)):
        got = [tuple(g) for g in ngram_join.similar_classes(docs).collect()]
        assert len(got) == len({i for i, _ in own if i is not None}) and set(got) == brute_classes(own)
    assert {(900, 900, 36), (951, 900, 1), (952, 952, 0)} <= set(got)


def test_keep_one_of_each_group(docs_of):
    rows = copies(4)
    root = {i: i for i, _ in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b, _ in brute_pairs(rows):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    docs = docs_of(rows)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(k.doc_id for k in kept.collect()) == sorted(i for i in root if find(i) == i)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 105), (105, 102), (7, 7)]
    got = {tuple(r) for r in ngram_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 1) for i in range(2, 41)} | {(102, 100), (105, 100)}


def test_join_edges(edges, edge_rows, none):
    assert ngram_join.similar_pairs(none).count() == 0 and ngram_join.keep_one(none).count() == 0
    assert {tuple(g) for g in ngram_join.similar_pairs(edges).collect()} == brute_pairs([r[:2] for r in edge_rows])
    ids = [r.doc_id for r in ngram_join.keep_one(edges).collect()]
    assert ids.count(1) == 2 and 2 not in ids and 12 not in ids and 6 in ids and 7 not in ids
    assert {3, 4, 5, 8, 9, 10, 11} <= set(ids) and ids.count(None) == 2


def test_large_group_of_near_copies(docs_of):
    r = random.Random(0)
    base = words(77, 150)
    rows = [(i, edited(base, 0.01, r)) for i in range(150)] + [(i, base) for i in range(150, 260)]
    assert {tuple(g) for g in ngram_join.similar_pairs(docs_of(rows)).collect()} == brute_pairs(rows)


def test_chunks_of_a_large_group_of_copies(docs_of, monkeypatch):
    """Groups of more copies than a chunk holds, near ones of each other."""
    monkeypatch.setattr(ngram_join, "CHUNK", 7)
    a, b = words(5, 40), words(5, 40) + " tail"
    rows = [(i, a if i % 3 else b) for i in range(60)] + [(i, words(i, 20)) for i in range(60, 70)]
    got = [tuple(g) for g in ngram_join.similar_pairs(docs_of(rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)
    assert {r.doc_id for r in ngram_join.keep_one(docs_of(rows)).collect()} == {0, *range(60, 70)}


def test_colliding_signatures_are_told_apart(docs_of, monkeypatch):
    """With signatures of two bits nearly all sets collide; the second hash keeps them apart."""
    whole = ngram_join._signature
    monkeypatch.setattr(ngram_join, "_signature", lambda v, b, seed: whole(v, b, seed) & np.uint64(3) if seed == 0x5851F42D4C957F2D else whole(v, b, seed))
    rows = copies(11, 6, 10)
    w = common.words(common.strings(pa.array([t for _, t in rows])))
    values, bounds, sig = ngram_join.sets_of(w, 2)
    assert len(set(sig.tolist())) <= 4
    apart = ngram_join._apart(sig, values, bounds, np.unique(sig))
    assert len(set(apart.tolist())) == len({frozenset(gram_set(t, 2)) for _, t in rows})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té　", max_size=40), max_size=6), st.integers(1, 4))
def test_words_and_ngrams(texts, n):
    w = common.words(common.strings(pa.array(texts, pa.string())))
    assert np.diff(w.bounds).tolist() == [len(t.encode().split()) for t in texts]
    flat = [x for t in texts for x in t.encode().split()]
    assert len(set(zip(flat, w.hash.tolist()))) == len(set(flat)) == len(set(w.hash.tolist()))
    sets, bounds = common.sorted_sets(*common.grams(w, n))
    assert np.diff(bounds).tolist() == [len(gram_set(t, n)) for t in texts]


def test_words_of_a_long_word(monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 16)
    texts = ["a" * 100 + " b", "b " * 30, "", "x" * 15 + " y", "a" * 100]
    w = common.words(common.strings(pa.array(texts)))
    assert np.diff(w.bounds).tolist() == [2, 30, 0, 2, 1]
    assert w.hash[0] == w.hash[-1] and w.hash[1] == w.hash[2] and (w.end - w.start).tolist()[0] == 100


def brute_passages(rows, length):
    at = {}
    for i, t in {(i, t) for i, t in rows if i is not None and t}:
        w = t.encode().split()
        for k in range(len(w) - length + 1):
            at.setdefault(tuple(w[k : k + length]), set()).add((i, k))
    places = {}
    for found in at.values():
        first = min(found)
        if len({i for i, _ in found}) > 1:
            for i, k in found:
                places.setdefault((i, (i, k) != first), {})[k] = min(first[0], places.get((i, (i, k) != first), {}).get(k, first[0]))
    out = set()
    for (i, dup), ks in places.items():
        run = []
        for k in [*sorted(ks), None]:
            if run and (k is None or k > run[-1] + length):
                out.add((i, dup, run[0], run[-1] - run[0] + length, min(ks[v] for v in run)))
                run = []
            run.append(k)
    return out


def test_passages_match_brute_force(docs_of):
    r = random.Random(2)
    pool = [words(k, r.randint(5, 40)) for k in range(30)]
    rows = [(i, r.choice([" ", "\n", " \t "]).join([words(900 + i, r.randint(0, 9)), *(r.choice(pool) for _ in range(r.randint(1, 5)))])) for i in range(120)]
    rows += [(200, "w " * 90), (201, "w " * 70 + "v"), (202, "u v " * 60), (203, "u v " * 40)]
    got = suffix_dedup.repeated_passages(docs_of(rows), 20, 8).collect()
    assert {tuple(g) for g in got} == brute_passages(rows, 20) and len(got) > 50


def test_passage_edges(edges, edge_rows, none):
    assert suffix_dedup.repeated_passages(none).count() == 0
    got = {tuple(g) for g in suffix_dedup.repeated_passages(edges).collect()}
    assert got == brute_passages([r[:2] for r in edge_rows], 50)
    assert (2, True, 0, 80, 1) in got and (12, True, 0, 80, 1) in got and (1, False, 0, 80, 1) in got


def test_mergesort_sorts_suffixes():
    r = np.random.default_rng(0)
    h = r.integers(0, 3, 400).astype(np.uint64)
    s = suffix_dedup.Suffixes(h)
    place = r.integers(0, 380, 300)
    size = np.minimum(r.integers(1, 21, 300), 400 - place)
    group = np.sort(r.integers(0, 9, 300))
    order = s.sort(place, size, group)
    key = lambda i: (group[i], h[place[i] : place[i] + size[i]].tolist(), i)
    assert order.tolist() == sorted(range(300), key=key)
    ext = s.extension(place[:-1], place[1:], np.minimum(size[:-1], size[1:]))
    for x, y, m, e in zip(place[:-1], place[1:], np.minimum(size[:-1], size[1:]), ext):
        want = next((k for k in range(m) if h[x + k] != h[y + k]), m)
        assert e == want


def test_collisions_are_verified():
    rows = pa.table({"anchor": [1, 1, 1], "doc_id": [1, 2, 3], "start": [0, 0, 0], "lead": pa.array([0] * 3, pa.int32()), "windows": pa.array([1] * 3, pa.int32()), "words": ["a b c", "a b c", "a b d"]})
    real = suffix_dedup.words
    try:
        def colliding(part):
            w = real(part)
            w.hash[:] = 5
            return w

        suffix_dedup.words = colliding
        frag, _, kind = suffix_dedup.equal_windows(rows, 3)
    finally:
        suffix_dedup.words = real
    by = dict(zip(frag.tolist(), kind.tolist()))
    assert by[0] == by[1] != by[2]


def test_pairs_of_many_sets_are_met_in_bounded_memory():
    """40 tokens that the same 600 sets have: 7 million meetings, as of a large group of near copies, are counted in small batches and little memory."""
    code = """
import resource, numpy as np, pyarrow as pa
from leaselens.llm import ngram_join
sig = np.arange(600)
lists = [np.column_stack([sig, np.full(600, 200 << 26 | 4 << 13 | 1)]).tobytes()] * 40
rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(40, np.int64)), pa.array(np.arange(40)), pa.array(lists, pa.binary()), pa.array(np.zeros(40, np.int64))], ["leader", "token", "list", "part"])
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before, met, batches = peak(), 0, []
for b in ngram_join._pairs(0.75)(iter([rows])):
    met += sum(b["n"].to_pylist())
    batches.append(len(b))
print(met == 40 * 600 * 599 // 2, sum(batches) < 2 * 600 * 599 // 2, max(batches) <= 100_000, peak() - before < 200)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["True"] * 4, done.stdout + done.stderr


def test_a_home_of_many_sets_is_cut_into_cells(docs_of, monkeypatch):
    """A group of near copies that share one least token: no bucket gets more of it than its bounds, and no pair is lost."""
    monkeypatch.setattr(ngram_join, "VERIFY_BYTES", 40_000)
    monkeypatch.setattr(ngram_join, "VERIFY_PAIRS", 200)
    monkeypatch.setattr(ngram_join, "SETS_BYTES", 4000)
    r = random.Random(3)
    base = words(78, 120)
    rows = [(i, edited(base, 0.01, r)) for i in range(120)] + [(i, words(i, 30)) for i in range(200, 230)]
    join = ngram_join.Join(docs_of(rows), 2, 0.75)
    cells = {r["bucket"]: r["count"] for r in join._cells().groupBy("bucket").count().collect()}
    assert sum(cells.values()) == join.candidates.count() > 1000 and max(cells.values()) < 1000
    assert {tuple(g) for g in join.doc_pairs().collect()} == brute_pairs(rows)


def test_large_groups_are_verified_by_blocks(docs_of, monkeypatch):
    """What long lists join gives no candidates, and blocks lose no link: copies, two near groups, and documents of several texts."""
    monkeypatch.setattr(ngram_join, "LONG", 20)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 50)
    monkeypatch.setattr(ngram_join, "COLUMNS", 16)
    monkeypatch.setattr(ngram_join, "DENSE_PAIRS", 300)
    r = random.Random(5)
    bases = [words(78, 90), words(79, 70)]
    rows = [(i, edited(bases[i % 2], r.choice([0, 0.01, 0.03, 0.08]), r)) for i in range(160)] + [(i, words(i, 30)) for i in range(200, 220)]
    rows += [(3, edited(bases[0], 0.02, r)), (3, edited(bases[0], 0.02, r)), (5, edited(bases[0], 0.01, r)), (7, words(7, 40))]
    join = ngram_join.Join(docs_of(rows), 2, 0.75)
    assert join.blocks.count() > 80 and join.candidates.count() < 400
    assert {tuple(g) for g in join.doc_pairs().collect()} == brute_pairs(rows)
    assert {tuple(g) for g in join.classes(docs_of(rows)).collect()} == brute_classes(rows)
    kept = {i for i, v, _ in brute_classes(rows) if i == v}
    assert {g.doc_id for g in ngram_join.keep_one(docs_of(rows)).collect()} == kept
    monkeypatch.setattr(ngram_join, "SPREAD", 0)
    loose = ngram_join.Join(docs_of(rows), 2, 0.75)
    assert loose.candidates.count() > 1000 and {tuple(g) for g in loose.classes(docs_of(rows)).collect()} == brute_classes(rows)
