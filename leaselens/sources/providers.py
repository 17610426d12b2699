"""External models behind one interface, with offline stand-ins.

A provider maps rows of (key, input) to (key, output, error) in batches on the
executors: OCR engines, document parsers, language models, embeddings. It is built
once in each partition. Errors are values, so that a failed call costs a row and not a job.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Call = Callable[[object], str]


@dataclass
class Registry:
    """Factories of providers by name; a fallback takes over where a name isn't there."""

    factories: dict[str, Callable[[], Call]] = field(default_factory=dict)

    def add(self, name: str, factory: Callable[[], Call]) -> None:
        self.factories[name] = factory

    def get(self, name: str, fallback: str | None = None) -> Callable[[], Call]:
        if name in self.factories:
            return self.factories[name]
        if fallback is None:
            raise KeyError(f"no provider {name}; there are {sorted(self.factories)}")
        return self.factories[fallback]


def call(df: DataFrame, key: str, value: str, factory: Callable[[], Call], retries: int = 0) -> DataFrame:
    """key, output, error for each row: what the provider makes of value; null values aren't sent."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = factory()
        for b in batches:
            outputs, errors = [], []
            for v in b.column(1).to_pylist():
                out, error = None, None
                for _ in range(retries + 1 if v is not None else 0):
                    try:
                        out, error = provider(v), None
                        break
                    except Exception as e:  # whatever a model's client raises becomes the row's error
                        error = f"{type(e).__name__}: {e}"
                outputs.append(out)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(outputs, pa.string()), pa.array(errors, pa.string())], [key, "output", "error"])

    return df.select(key, value).mapInArrow(run, f"`{key}` {kind}, output string, error string")


def with_retry_of_poor(df: DataFrame, key: str, value: str, first: Callable[[], Call], second: Callable[[], Call], confidence: Callable[[Column], Column], least: float = 0.6) -> DataFrame:
    """call(), and a second provider for rows whose confidence is below least only; the better answer is kept."""
    one = call(df, key, value, first).withColumn("confidence", F.coalesce(confidence(F.col("output")), F.lit(0.0)))
    poor = df.join(one.where(F.col("confidence") < least).select(key), key, "left_semi")
    two = call(poor, key, value, second).select(key, F.col("output").alias("again"), F.coalesce(confidence(F.col("output")), F.lit(0.0)).alias("again_confidence"))
    x, better = one.join(two, key, "left"), F.coalesce(F.col("again_confidence") > F.col("confidence"), F.lit(False))
    return x.select(key, F.when(better, F.col("again")).otherwise(F.col("output")).alias("output"), F.when(better, F.col("again_confidence")).otherwise(F.col("confidence")).alias("confidence"))


def stored(answers: dict[str, str]) -> Callable[[], Call]:
    """Answers by the SHA-256 of the input, or by the input itself: for tests and replays."""

    def make() -> Call:
        def answer(v: object) -> str:
            raw = v if isinstance(v, bytes) else str(v).encode()
            found = answers.get(hashlib.sha256(raw).hexdigest(), answers.get(str(v)))
            if found is None:
                raise LookupError("no stored answer")
            return found

        return answer

    return make


def hashed_embedding(size: int = 64) -> Callable[[], Call]:
    """A stand-in for an embedding model: signed counts of hashed words, as JSON."""

    def make() -> Call:
        def embed(v: object) -> str:
            out = [0.0] * size
            for w in str(v).lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[h % size] += 1 if h >> 63 else -1
            return json.dumps(out)

        return embed

    return make


def embedding(output: Column) -> Column:
    return F.from_json(output, "array<float>")


ANALYSIS = "struct<total_clauses: int, risk_summary: map<string, int>, overall_risk_score: double, recommendations: array<string>>"


def analysis(output: Column) -> Column:
    """A model's analysis; the default one where it failed."""
    empty = F.struct(
        F.lit(0).alias("total_clauses"), F.create_map(*(F.lit(v) for k in ("Risk", "Caution", "Safety") for v in (k, 0))).alias("risk_summary"),
        F.lit(0.0).alias("overall_risk_score"), F.array(F.lit("분석 중 오류가 발생했습니다.")).alias("recommendations"),
    )
    made = F.from_json(output, ANALYSIS)
    return F.when(made["total_clauses"].isNotNull(), made).otherwise(empty)


ENGINE_CONFIDENCE = {"trocr": 0.95, "api": 0.95}


def prompt_lines(regions: DataFrame) -> DataFrame:
    """doc_id, prompt: regions in reading order, each as [n] text."""
    from pyspark.sql import Window

    x = regions.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("y", "x", "pos")))
    by = x.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("r"))
    return by.select("doc_id", F.array_join(F.transform("r", lambda v: F.concat(F.lit("["), v["n"].cast("string"), F.lit("] "), v["text"])), "\n").alias("prompt"))


def rescaled(regions: DataFrame, scale: float) -> DataFrame:
    """Boxes found on an enlarged page, on the page itself."""
    return regions.withColumns({c: (F.col(c) / scale).cast("int") for c in ("x", "y", "w", "h")})
