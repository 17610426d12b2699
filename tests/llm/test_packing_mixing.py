import collections
import random

import numpy as np
from helpers import words

from pyspark.sql import functions as F

from leaselens.llm import mixing, packing, token_counts
from leaselens.llm.common import word_count



def by_words():
    return word_count(F.col("text"))


def token_number(text):
    with open(token_counts.VOCABULARY, "rb") as f:
        return len(token_counts.encoding(f.read()).encode_ordinary(text or ""))


def test_packer_minimises_the_sum_of_squares():
    r, capacity = random.Random(3), 24
    packer = packing.Packer(capacity)
    fills: dict[int, int] = {}

    def squares(f):
        return sum(n * n for n in collections.Counter(v for v in f.values() if v < capacity).values())

    for _ in range(400):
        size = r.randint(1, capacity - 1)
        best = min([squares({**fills, w: v + size}) for w, v in fills.items() if v + size <= capacity] + [squares({**fills, -1: size})])
        window, level = packer.place(size)
        assert fills.get(window, 0) == level
        fills[window] = level + size
        assert fills[window] <= capacity and squares(fills) == best


def test_pack_covers_each_token_once(spark, edges, edge_rows):
    rows = packing.pack(edges, by_words(), capacity=64, shard_tokens=5000).collect()
    assert sum(r.tokens for r in rows) == sum(len((t or "").encode().split()) for t in (e[1] for e in edge_rows))
    spans = collections.defaultdict(list)
    for r in rows:
        if r.window_id is None:
            assert r.tokens == 0
        else:
            spans[r.shard, r.window_id].append((r.window_start, r.window_start + r.tokens))
    for parts in spans.values():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] <= 64 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert len({r.shard for r in rows}) > 1
    count = collections.Counter(r.doc_id for r in rows)
    assert count[1] == 4 and count[3] == count[4] == count[5] == 1  # both rows of 80 words, and rows without tokens
    whole = [r.tokens for r in rows if r.doc_id == 8]
    assert whole.count(64) == len(whole) - 1


def test_pack_nothing(none):
    assert packing.pack(none).count() == 0


def test_rows_without_tokens_or_id_fill_no_shard(spark):
    """Empty rows and rows without an id are dealt to shards like others."""
    docs = spark.range(3000).select(F.when(F.col("id") >= 2000, F.col("id")).alias("doc_id"), F.when(F.col("id") < 1000, "one two three").otherwise("").alias("text"))
    rows = packing.pack(docs, by_words(), shard_rows=300).collect()
    by = collections.Counter(r.shard for r in rows)
    assert len(rows) == 3000 and len(by) == 10 and max(by.values()) < 600


KOREAN = "임대차계약서보증금" * 1300


def test_unspaced_text_counts_in_tokens(docs_of):
    """More than 100 KB of Korean without a space is one word, and some 39,000 tokens in mixing and packing."""
    n = token_number(KOREAN)
    assert len(KOREAN) > 10_000 and n > 10 * packing.WINDOW
    docs = docs_of([(i, KOREAN if i == 0 else words(i, 30), "ko", "a" if i < 3 else "b") for i in range(40)])
    rows = packing.pack(docs).collect()
    own = [r for r in rows if r.doc_id == 0]
    assert sum(r.tokens for r in own) == n and max(r.tokens for r in own) == packing.WINDOW and len(own) == -(-n // packing.WINDOW)
    assert next(r.tokens for r in mixing.mix_levels(docs, (1.0,)).collect() if r.doc_id == 0) == n


def test_pack_fills_windows():
    sizes = np.random.default_rng(0).integers(1, 300, 5000)
    x = packing.pack_shard(sizes, 2048)
    assert sizes.sum() / ((x["window_id"].max() + 1) * 2048) > 0.98


def brute_levels(rows, budgets, weights, count=token_number):
    """Sorts each source by hash, as the histograms don't."""
    import hashlib

    docs = [(i, s, int(hashlib.md5(("mix-1" + ("" if i is None else str(i))).encode()).hexdigest()[:15], 16), count(t)) for i, t, s in rows]
    total = collections.Counter()
    for _, s, _, n in docs:
        total[s] += n
    weight = {s: weights.get(s, 1.0) if weights else n**0.7 for s, n in total.items() if n}
    out = {}
    for level, budget in enumerate(budgets, 1):
        rate, left, open_ = 0.0, float(int(sum(total.values()) * budget)), dict(weight)
        while open_:
            rate = left / sum(open_.values())
            full = [s for s in open_ if rate * open_[s] > total[s]]
            if not full:
                break
            for s in full:
                left -= total[s]
                del open_[s]
        for s in weight:
            quota = min(total[s], int(round(rate * weight[s], 3))) if s in open_ else total[s]
            used = 0
            mine = sorted((h, n, i) for i, t, h, n in docs if t == s)
            for h in sorted({h for h, _, _ in mine}):
                used += sum(n for g, n, _ in mine if g == h)
                if used > quota:
                    break
                for g, _, i in mine:
                    if g == h:
                        out.setdefault((i, s), level)
    return out


def test_mix_levels_match_sorting(docs_of, spark):
    r = random.Random(5)
    rows = [(i, words(i, r.randint(0, 60)), r.choice(["big"] * 6 + ["mid"] * 2 + ["small", None])) for i in range(400)] + [(7, "x y", "big")] * 3 + [(None, "p q r", "mid"), (900, None, "mid")]
    docs = docs_of([(i, t, "en", s) for i, t, s in rows])
    for weights in (None, {"big": 0.5, "small": 4.0}):
        w = spark.createDataFrame(list(weights.items()), "source string, weight double") if weights else None
        got = mixing.mix_levels(docs, (0.2, 0.5, 0.95), w).collect()
        assert {(g.doc_id, g.source): g.level for g in got} == brute_levels(rows, (0.2, 0.5, 0.95), weights or {})
    kept = mixing.mix(docs, (0.5,))
    assert kept.columns == docs.columns
    assert {(k.doc_id, k.source) for k in kept.collect()} == set(brute_levels(rows, (0.5,), None))


def test_mix_edges(edges, none):
    assert mixing.mix_levels(none).count() == 0 and mixing.mix(none).count() == 0
    everything = mixing.mix(edges, (1.0,))
    assert everything.count() == edges.count()
    assert mixing.mix_levels(edges, (0.3, 1.0)).count() == edges.count()


def test_packing_query_counts_tokens(spark, docs_of, tmp_path):
    """A long text without white space is one word, and many windows of tokens."""
    code = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20_000))
    rows = [(1, code), (2, words(2, 1500)), (3, None), (4, ""), (5, KOREAN)]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    with open(token_counts.VOCABULARY, "rb") as f:
        encoder = token_counts.encoding(f.read())
    got = collections.Counter()
    for r in packing.op4_packing(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.tokens
        assert r.tokens <= packing.WINDOW
    assert got == {i: len(encoder.encode_ordinary(t or "")) for i, t in rows} and min(got[1], got[2]) > packing.WINDOW


def test_mix_takes_a_token_column(docs_of):
    docs = docs_of([(i, words(i, 5), "en", "a" if i % 2 else "b") for i in range(200)])
    tokens = F.when(F.col("source") == "a", 30).otherwise(F.when(F.col("doc_id") > 3, 1))
    weights = docs.sparkSession.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    rows = mixing.mix_levels(docs, (0.5,), weights, tokens).collect()
    assert {r.tokens for r in rows if r.source == "a"} == {30} and {r.tokens for r in rows if r.source == "b"} == {0, 1}
    assert sum(r.source == "b" for r in rows) == 100 and 45 <= sum(r.source == "a" for r in rows) <= 48
    assert {r.doc_id for r in mixing.mix(docs, (0.5,), weights, tokens).collect()} == {r.doc_id for r in rows}
