import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from helpers import words  # noqa: E402

#: Columns whose names the operators use for themselves.
CLASHING = ("h", "n", "x", "score", "keep", "tokens", "level", "sig", "size", "bucket", "buckets", "line_no", "gone", "domain", "best", "ll", "row", "anchor", "quality_score", "mix_hash", "line_doc", "__near_id")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, partitions=3):
        """rows of (doc_id, text[, lang[, source]])"""
        full = [(*r, *(("en", "s")[len(r) - 2 :]), None if r[1] is None else len(r[1]), *("clash" for _ in CLASHING)) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, a very long one, repeated rows, equal texts."""
    long = " ".join(words(1, 500) for _ in range(60)) + "\n" + words(2, 9000)
    return [
        (1, words(10, 80)), (1, words(10, 80)), (2, words(10, 80)), (3, None), (None, words(11, 60)), (None, None), (4, ""), (5, "   \n \t\n"),
        (6, "a"), (7, "a"), (8, long), (9, "wordwithoutend" * 20000), (10, words(12, 3)), (11, "é ü　ß \U0001f600 x"), (12, words(10, 80), None, None),
    ]


@pytest.fixture(scope="session")
def edges(docs_of, edge_rows):
    return docs_of(edge_rows)


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of([], 1)
