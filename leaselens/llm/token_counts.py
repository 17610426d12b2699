"""Token counts: byte-level BPE in an Arrow function that returns lengths only.

Texts are encoded in batches of about BATCH_BYTES of UTF-8. A text of more than
PIECE_BYTES is cut only where no token can lie across, which changes no count:
before a white space that follows another character, as the vocabulary's pattern never
takes a white space into a token after one; and between two characters whose
meeting bytes are side by side in no token of the vocabulary, as no merge joins them.
The second kind cuts texts without white space: other scripts, encoded data.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, small_batches, table

#: A file of ranks: a token in base64 and its rank on each line.
VOCABULARY = os.environ.get("LEASELENS_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BATCH_BYTES = 1 << 20
PIECE_BYTES = 1 << 16
_encoders: dict[int, object] = {}
_apart: dict[int, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_QUOTE = ord("'")


def encoding(ranks: bytes):
    """The tokenizer of a file of ranks; built once in a process."""
    import tiktoken

    key = hash(ranks)
    if key not in _encoders:
        pairs = (line.split() for line in ranks.splitlines() if line)
        tokens = {base64.b64decode(a): int(b) for a, b in pairs}
        encoder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=tokens, special_tokens={})
        apart = np.ones((256, 256), bool)
        for t in tokens:
            x = np.frombuffer(t, np.uint8)
            apart[x[:-1], x[1:]] = False
        _encoders[key], _apart[id(encoder)] = encoder, apart
    return _encoders[key]


def _before(x: np.ndarray, n: int) -> np.ndarray:
    """The byte n places before each; 0 at the start."""
    out = np.zeros_like(x)
    out[n:] = x[:-n]
    return out


def cuts(data: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places before which a UTF-8 text may be cut.

    Between characters of no white space, a cut also keeps away from apostrophes, which
    start tokens of letters. Characters that may be white space beyond ASCII are told by their first bytes.
    """
    if len(data) < 2:
        return np.zeros(0, np.int64)
    one, two, three = (_before(data, k) for k in (1, 2, 3))
    wide = (three == 0xE1) & (two == 0x9A) | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80)
    blank = _SPACE[one] | (two == 0xC2) | wide
    free = apart[one, data] & (data != _QUOTE) & (one != _QUOTE) & (two != _QUOTE)
    ok = ((data & 0xC0) != 0x80) & ~blank & (_SPACE[data] | free)
    ok[0] = False
    return np.flatnonzero(ok)


def pieces(text: str, most: int = PIECE_BYTES, apart: np.ndarray | None = None) -> Iterator[tuple[str, int]]:
    """A text in parts of about that many bytes whose tokens together are the text's, and their sizes; without apart, cut before white space only."""
    raw = text.encode()
    if len(raw) <= most:
        yield text, len(raw)
        return
    at, lo = cuts(np.frombuffer(raw, np.uint8), np.zeros((256, 256), bool) if apart is None else apart), 0
    while len(raw) - lo > most:
        k = int(np.searchsorted(at, lo + most))
        if k == len(at):
            break
        yield raw[lo : at[k]].decode(), int(at[k]) - lo
        lo = int(at[k])
    yield raw[lo:].decode(), len(raw) - lo


def lengths(encoder, texts: list[str | None], batch: int = BATCH_BYTES, piece: int = PIECE_BYTES) -> np.ndarray:
    """Tokens of each text; 0 for None."""
    out = np.zeros(len(texts), np.int64)
    rows: list[int] = []
    parts: list[str] = []
    held = 0

    def flush() -> None:
        nonlocal held
        # arrays, of which only the lengths stay: lists of the tokens would take ten times the memory
        np.add.at(out, rows, [len(encoder.encode_to_numpy(x, disallowed_special=())) for x in parts])
        rows.clear(), parts.clear()
        held = 0

    for i, text in enumerate(texts):
        for part, size in pieces(text, piece, _apart.get(id(encoder))) if text else ():
            rows.append(i), parts.append(part)
            held += size
            if held >= batch:
                flush()
    if parts:
        flush()
    return out


def token_count(text: Column, ranks: Broadcast) -> Column:
    """The number of tokens of a text; null for null."""

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoding(ranks.value)
        for batch in batches:
            yield pa.array(lengths(encoder, batch.to_pylist()), mask=np.asarray(batch.is_null()))
        # a worker outlives its task: it is not to hold the vocabulary beside what the next stage needs
        del encoder
        _encoders.clear(), _apart.clear()
        give_back()

    return count(text)


def broadcast_ranks(spark: SparkSession, vocabulary: str = VOCABULARY) -> Broadcast:
    """The file of ranks, read by the driver; its size doesn't depend on the data."""
    small_batches(spark)
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens for each row of docs, in one pass without a shuffle.

    Whole texts are counted, however long. A null text has null tokens, an
    empty one 0; rows are taken one by one, so that repeated and null doc_ids
    make no difference. An empty table gives no rows. The file of ranks is
    read by the driver and broadcast: its size doesn't depend on the data.
    """
    return docs.select("doc_id", token_count(F.col("text"), broadcast_ranks(docs.sparkSession, vocabulary)).alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op1_token_counts": op1_token_counts}


def counted_sql(rows: str, vocabulary: str = VOCABULARY) -> str:
    """The head of a WITH clause that ends with counted: all columns of rows, and n_tokens of their text.

    Byte-pair encoding in DuckDB's SQL: the pattern parts texts into words (a white space before another character
    is parted from those before it by U+E000, for want of lookahead), and a recursion joins the pair of least
    rank of each distinct word until none is in the file of ranks.
    """
    space, other = r"[\t-\r\x{85}\p{Z}]", r"[^\t-\r\x{85}\p{Z}]"
    pattern = rf"''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^\t-\r\x{{85}}\p{{Z}}\p{{L}}\p{{N}}\x{{E000}}]+|{space}+"
    return rf"""
WITH RECURSIVE ranks AS (SELECT hex(from_base64(t)) AS t, r FROM read_csv('{vocabulary}', columns={{'t': 'VARCHAR', 'r': 'INT'}}, delim=' ', header=false, quote='', escape='')),
src AS MATERIALIZED (SELECT *, row_number() OVER () AS row_no FROM {rows}),
pre AS MATERIALIZED (SELECT row_no, unnest(regexp_extract_all(regexp_replace(text, '({space}+)({space}{other})', '\1' || chr(57344) || '\2', 'g'), '{pattern}')) AS w FROM src),
bpe(w, parts, more) AS (
  SELECT w, CASE WHEN whole THEN [h] ELSE list_transform(range(1, len(h) // 2 + 1), lambda i: substr(h, 2 * i - 1, 2)) END, NOT whole
  FROM (SELECT w, hex(encode(w)) AS h, EXISTS (SELECT 1 FROM ranks WHERE t = hex(encode(w))) AS whole FROM (SELECT DISTINCT w FROM pre))
  UNION ALL
  SELECT w, list_concat(parts[:i - 1], [parts[i] || parts[i + 1]], parts[i + 2:]), true
  FROM (SELECT w, any_value(parts) AS parts, arg_min(i, r * 1000000::BIGINT + i) AS i
        FROM (SELECT w, parts, unnest(range(1, len(parts))) AS i FROM bpe WHERE more) JOIN ranks ON t = parts[i] || parts[i + 1] GROUP BY w)),
held AS (SELECT w, min(len(parts)) AS n FROM bpe GROUP BY w),
counted AS MATERIALIZED (SELECT src.*, CASE WHEN text IS NULL THEN NULL ELSE coalesce(n, 0)::BIGINT END AS n_tokens
                         FROM src LEFT JOIN (SELECT row_no, sum(n) AS n FROM pre JOIN held USING (w) GROUP BY row_no) USING (row_no))"""


SQL = {"op1_token_counts": counted_sql("documents") + " SELECT doc_id, n_tokens FROM counted"}
