import os
import random
import shutil
import subprocess
import sys

import corpus_pipeline
from helpers import words

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_keep_their_contract(spark, tmp_path):
    """Each stage against a brute-force version of it on what its predecessor kept."""
    from test_lines_classifier import brute_lines, junk
    from test_near_and_repeats import brute_pairs, edited
    from test_packing_mixing import brute_levels, token_number

    r = random.Random(7)
    rows, labels = [], []
    for i in range(260):
        if i % 6 == 0:
            rows.append((i, junk(i)))
        elif i % 11 == 0:
            rows.append((i, edited(rows[i - 1][1], 0.01, r) if (i - 1) % 6 else words(i, 50)))
        else:
            rows.append((i, "\n".join([words(i, r.randint(20, 60)), words(9000 + i % 4, 7)])))
        labels.append((i, int(i % 6 > 0), 0))
    rows += [(1000, None), (1001, ""), (None, words(5, 30)), (2, rows[2][1])]
    full = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "source mixing", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == docs.columns
        kept.append(out.collect())
        docs = out
    pairs = lambda rows: [(x.doc_id, x.text) for x in rows]
    first = {x.doc_id for x in kept[0]}
    assert not any(i in first for i in range(0, 260, 6)) and {i for i in range(260) if i % 6} <= first and {1000, 1001, None} <= first
    assert {x.doc_id: x.text for x in kept[1] if x.doc_id is not None and x.text is not None} == brute_lines(pairs(kept[0]))
    near = brute_pairs(pairs(kept[1]))
    root = {i: i for i, _ in pairs(kept[1])}
    for _ in range(9):
        for a, b, _ in near:
            root[a] = root[b] = min(root[a], root[b])
    assert {x.doc_id for x in kept[2]} == {i for i, v in root.items() if i == v}
    mixed = brute_levels([(x.doc_id, x.text, x.source) for x in kept[2]], (corpus_pipeline.MIX_BUDGET,), None)
    assert {(x.doc_id, x.source) for x in kept[3]} == set(mixed)
    assert sum(x.tokens for x in kept[4]) == sum(token_number(x.text) for x in kept[3])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.select("doc_id", "piece", "tokens").collect())) == sorted(str(x) for x in docs.select("doc_id", "piece", "tokens").collect())


def test_unspaced_text_goes_through_the_stages_in_tokens(spark, docs_of):
    """More than 100 KB of Korean without a space, and a label for its like: kept whole, mixed and packed as its tokens."""
    from test_lines_classifier import junk
    from test_packing_mixing import KOREAN, token_number

    text = KOREAN * 4
    docs = docs_of([(1, text), *((i, junk(i) if i % 5 == 0 else KOREAN[i : i * 9] if i % 5 == 1 else words(i, 60)) for i in range(2, 120))])
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(2, 120)], "doc_id bigint, quality int")
    kept = corpus_pipeline.quality_classifier.keep_good(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {1} | {i for i in range(2, 120) if i % 5}
    for stage in (corpus_pipeline.lines, corpus_pipeline.near_duplicates):
        kept = stage(spark, kept, "")
    assert next(r.text for r in kept.collect() if r.doc_id == 1) == text
    packed = [r.tokens for r in corpus_pipeline.windows(spark, kept.where("doc_id = 1"), "").collect()]
    assert len(text.encode()) > 100_000 and sum(packed) == token_number(text) and max(packed) == 2048


def test_merged_sentences_are_near_duplicates(spark, docs_of):
    """A copy whose sentences were merged ('eran. Nd,' became 'eran nd,'): of less than 0.75 in raw words."""
    from test_near_and_repeats import gram_set

    raw = words(1, 120).split()
    base = " ".join(f"{w}." if k % 12 == 11 else w.title() if k % 12 == 0 else w for k, w in enumerate(raw)) + " -- \u00bbEnde\u00ab"
    edited = " ".join(raw) + " -- ende"
    a, b = gram_set(base, 2), gram_set(edited, 2)
    assert 0.5 < len(a & b) / len(a | b) < 0.75
    rows = [(1, base), (2, edited), (3, words(3, 120)), (4, "!!! ??"), (5, "!!! ??"), (6, "... --")]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs_of(rows), "").collect()) == [1, 3, 4, 6]


def test_pipeline_of_nothing(spark, tmp_path):

    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_rest_stands_alone(tmp_path):
    """Without this subpackage and the pipeline, the entry imports and has the other queries."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rule_scores' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql(); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert "fine" in done.stdout, done.stderr
