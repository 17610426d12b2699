"""Quality classifier: Bradley-Terry pairwise ranking with a score-quantile threshold.

A document's score is a linear function of features of its whole text. The
weights come from preference pairs (a labelled good document over a labelled
poor one): the logistic loss of feature differences, minimised by Newton steps.
The rejection threshold is a score quantile of the good labelled documents, at most
GOOD_BOUND: the one that parts all labelled documents best. Features of the corpus are made once, where
it is scored; the fit reads the labelled documents only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bloom, checkpointed, fresh, give_back, raw, slices, small_batches, strings, table, tidy, words

FEATURES = ("upper", "symbols", "pipes", "exclaims", "digits", "repeats", "word_bytes", "stops", "log_words")
#: Rows of each class that the fit may use, taken in hash order of doc_id; the only bound in this module.
SAMPLE_PER_CLASS = 4000
PAIRS_PER_GOOD = 5
#: The greatest part of the good labelled documents that may be rejected.
GOOD_BOUND = 0.05
BINS = 1000
#: A text counts as words of that many bytes at most, so that scripts without spaces aren't one word.
LONG_WORD = 12

_KINDS = np.zeros((7, 256), np.float32)
_KINDS[0, ord("A") : ord("Z") + 1] = 1
_KINDS[1, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 1
_KINDS[2, ord("|")] = 1
_KINDS[3, ord("!")] = 1
_KINDS[4, ord("0") : ord("9") + 1] = 1
_KINDS[5, [ord(c) for c in ".,"]] = 1
_KINDS[6, [*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = 1


def features(array: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text of a large_string array; zeros for an empty one."""
    out = [np.zeros((0, len(FEATURES)))]
    for _, part in slices(array):
        data, at = raw(part)
        w = words(part)
        n, size = np.diff(w.bounds), np.diff(at)
        counts = np.zeros((len(part), len(_KINDS)))
        some = size > 0
        if some.any():
            for k, kind in enumerate(_KINDS):
                counts[some, k] = np.add.reduceat(kind[data], at[:-1][some], dtype=np.float64)
        same = np.zeros(len(w.hash) + 1)
        if len(w.hash):
            same[2:] = np.cumsum((w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1]))
        length = np.zeros(len(w.hash) + 1)
        np.cumsum(w.end - w.start, out=length[1:])
        per = np.maximum(np.maximum(n, size / LONG_WORD), 1)
        repeats = np.where(n > 1, same[w.bounds[1:]] - same[np.minimum(w.bounds[:-1] + 1, w.bounds[1:])], 0)
        x = np.column_stack([
            counts[:, 0] / np.maximum(counts[:, 6], 1), counts[:, 1] / per, counts[:, 2] / per, counts[:, 3] / per, counts[:, 4] / np.maximum(size, 1),
            repeats / per, (length[w.bounds[1:]] - length[w.bounds[:-1]]) / per / 10, counts[:, 5] / per, np.log1p(np.where(n > 0, per, 0)) / 10,
        ])
        out.append(np.where(n[:, None] > 0, x, 0.0))
    return np.concatenate(out)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = features(strings(b.column(1)))
        flat = pa.array(x.ravel())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES), flat)], ["doc_id", "x"])


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and x, the FEATURES of its text; rows without doc_id or text have none."""
    own = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    return own.mapInArrow(tidy(_feature_rows), "doc_id bigint, x array<double>")


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    threshold: float | None
    low: tuple[float, ...] | None = None
    high: tuple[float, ...] | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores to 1/BINS, so that their histogram is exact. A feature beyond all rows of the fit counts like the nearest of theirs."""
        if self.low is not None:
            x = np.clip(x, self.low, self.high)
        s = (x - np.array(self.mean)) / np.array(self.scale) @ np.array(self.weights)
        return np.round(np.clip(s, -1e6, 1e6) * BINS) / BINS


def fit_pairs(good: np.ndarray, poor: np.ndarray, per_good: int = PAIRS_PER_GOOD, ridge: float = 1e-2, steps: int = 25) -> Model:
    """Weights that minimise the logistic loss of score differences over pairs of rows.

    Each good row meets per_good poor ones in a fixed rotation, and each poor
    row meets a good one. Without rows of both classes all weights are 0.
    """
    d = good.shape[1]
    if not len(good) or not len(poor):
        return Model((0.0,) * d, (0.0,) * d, (1.0,) * d, None)
    both = np.concatenate([good, poor])
    mean, scale = both.mean(0), np.maximum(both.std(0), 1e-6)
    g, p = (good - mean) / scale, (poor - mean) / scale
    i = np.concatenate([np.repeat(np.arange(len(g)), per_good), np.arange(len(p)) % len(g)])
    j = np.concatenate([(np.arange(len(g) * per_good) * 7919 + 3) % len(p), np.arange(len(p))])
    diff, w = g[i] - p[j], np.zeros(d)
    for _ in range(steps):
        prob = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = -(diff * prob[:, None]).mean(0) + ridge * w
        hess = (diff * (prob * (1 - prob))[:, None]).T @ diff / len(diff) + ridge * np.eye(d)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return Model(tuple(w), tuple(mean), tuple(scale), None, tuple(both.min(0)), tuple(both.max(0)))


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """quality, score of rows of quality and x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], ["quality", "score"])

    return rows.select(F.col("quality").cast("int"), "x").mapInArrow(run, "quality int, score double")


def quantile_threshold(labelled: DataFrame, bound: float = GOOD_BOUND) -> float | None:
    """The score below which documents are rejected, from rows (score, quality); None rejects none.

    From the exact histogram of all scores: of the quantiles of the good up to bound, the one
    of the greatest share of poor ones rejected less that of good ones; of equally good ones, the middle of the widest gap
    between scores. With the histogram's bins, what the driver gets is bounded by the range of scores.
    """
    hist = labelled.groupBy("score").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("poor")).toArrow()
    order = np.argsort(hist["score"].to_numpy())
    score, good, poor = (hist[c].to_numpy()[order].astype(float) for c in ("score", "good", "poor"))
    if not good.sum() or not poor.sum():
        return None
    # a threshold between the scores i - 1 and i
    lost, caught = (np.concatenate([[0.0], np.cumsum(x)[:-1]]) / x.sum() for x in (good, poor))
    gain = np.where(lost <= bound, caught - lost, -1.0)
    gap = np.diff(score, prepend=score[0])
    i = max(range(len(score)), key=lambda k: (round(gain[k], 12), gap[k]))
    return float(score[i] - gap[i] / 2)


def clean_labels(labels: DataFrame) -> DataFrame:
    """One row for each labelled doc_id: the lowest quality that its rows give; null labels don't count."""
    return labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_CLASS) -> Model:
    """A model from docs and labels(doc_id, quality); only texts that may be labelled are read on."""
    small_batches(docs.sparkSession)
    clean = checkpointed(clean_labels(labels))
    rows = feature_table(docs.where(Bloom(clean.select("doc_id")).may_hold(F.col("doc_id").cast("bigint"))))
    labelled = checkpointed(rows.join(clean, "doc_id"))
    data = {}
    for quality in (1, 0):
        own = labelled.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
        data[quality] = np.array([r["x"] for r in own]).reshape(-1, len(FEATURES))
    model = fit_pairs(data[1], data[0])
    return replace(model, threshold=quantile_threshold(_scored(labelled, model)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, keep: the verdict on each document that has a doc_id and a text.

    keep is score >= threshold. Empty texts score like any other; repeated rows
    get equal verdicts, one row each; ties with the threshold are kept. With
    no labels, or labels of one class only, all scores are 0 and all rows kept.
    Rows without doc_id or text aren't in the result. Other columns of the
    inputs don't matter.
    """
    model = fit(docs, labels)
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), score_column(model, F.col("text")).alias("score"))
    return own.withColumn("keep", F.lit(True) if model.threshold is None else F.col("score") >= model.threshold)


def score_column(model: Model, text: Column) -> Column:
    """The score of a text; null for null."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        out = pa.array(model.scores(features(strings(column))), mask=np.asarray(column.is_null()))
        give_back()
        return out

    return score(text)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns.

    Rows without text or doc_id can't be judged by score and label: a null text
    is kept, a text without doc_id is judged by its score.
    """
    model = fit(docs, labels)
    if model.threshold is None:
        return docs
    (score,) = fresh(docs, "quality_score")
    return docs.withColumn(score, score_column(model, F.col("text"))).where(F.col(score).isNull() | (F.col(score) >= model.threshold)).drop(score)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
SQL: dict[str, str] = {}
