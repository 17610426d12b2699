"""Extensions: masking of personal data, integrity of media. The categories' expressions are ours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import RESIDENT_ID

MASK = "●●●●"
PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("card", r"\b[0-9]{4}[- ][0-9]{4}[- ][0-9]{4}[- ][0-9]{4}\b"), ("resident_id", RESIDENT_ID),
    ("account", r"\b[0-9]{3,6}-[0-9]{2,6}-[0-9]{5,8}\b"), ("phone", r"\b0[0-9]{1,2}[-. ][0-9]{3,4}[-. ][0-9]{4}\b"), ("passport", r"\b[MSRGD][0-9]{8}\b"),
    ("business_no", r"\b[0-9]{3}-[0-9]{2}-[0-9]{5}\b"), ("license_no", r"\b[0-9]{2}-[0-9]{2}-[0-9]{6}-[0-9]{2}\b"), ("ip", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
)


def _may_hold(text: Column, name: str) -> Column:
    """A cheap test that a text must pass to hold a category: an @, or a digit beside what parts numbers."""
    if name == "email":
        return F.contains(text, F.lit("@"))
    return F.regexp_like(text, F.lit(r"[MSRGD][0-9]{8}" if name == "passport" else r"\p{Nd}[\s.\-－−]"))


def masked(text: Column) -> Column:
    done, some = text, F.lit(False)
    for name, pattern in PII:
        done, some = F.regexp_replace(done, pattern, MASK), some | _may_hold(text, name)
    return F.when(some, done).otherwise(text)


def pii_counts(docs: DataFrame, id_: str = "doc_id") -> DataFrame:
    """id and the number of each category's finds in the text."""
    text = F.col("text")
    return docs.select(id_, *(F.when(_may_hold(text, name), F.regexp_count(text, F.lit(p))).otherwise(0).alias(name) for name, p in PII))


def masked_boxes(words: DataFrame) -> DataFrame:
    """The words that hold personal data, with their boxes."""
    return words.where(F.regexp_like("text", F.lit("|".join(f"(?:{p})" for _, p in PII))))


def checksums(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"))
