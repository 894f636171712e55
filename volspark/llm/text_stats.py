"""Exact counts over whole texts, one pass per document, as an Arrow UDF."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
    "n_upper", "n_digits", "n_bars", "n_marks", "n_stops", "longest_word", "most_common", "n_upper_words",
)
SCHEMA = T.StructType([T.StructField(s, T.LongType()) for s in STATS])
_TYPE = pa.struct([(s, pa.int64()) for s in STATS])

_CONT = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, the first finding included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found, n, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def measure(text: bytes | None) -> tuple[int, ...]:
    """The counts in the order of STATS; words are runs without ASCII white space (null: none)."""
    b = text or b""
    words = b.split()
    without = lambda chars: len(b) - len(b.translate(None, chars))
    lines = [x for x in b.split(b"\n") if x.strip()]
    common = Counter(words)
    chars = sum(map(len, words)) - without(_CONT)
    return (
        len(words), chars, without(b"#*$%&|<>"), len(lines) - len(set(lines)), repeated_words(words), len(lines),
        len(common), without(_UPPER), without(b"0123456789"), b.count(b"|"), b.count(b"!"), without(b".?"),
        max(map(len, words), default=0), max(common.values(), default=0), sum(map(bytes.isupper, words)),
    )


def rows(texts: pa.Array) -> list[tuple[int, ...]]:
    col = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    return [measure(x.as_py()) for x in col]


@F.arrow_udf(SCHEMA)
def _stats(texts: pa.Array) -> pa.Array:
    cols = list(zip(*rows(texts))) or [()] * len(STATS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields=list(_TYPE))


def stats(text: str = "text") -> Column:
    """The struct of STATS of a text column. It is marked as not deterministic so that Spark runs it once
    for all expressions that read its fields, instead of once in each."""
    return _stats.asNondeterministic()(F.col(f"`{text}`"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, y of at most ``most`` labelled documents: those of least hash of the id.

    Rows with crc32(id as text) mod 4 = 2 are held out. Repeated labels of a document count as their
    least; null labels, null ids and labels without a document take no part. The sample is bounded by
    the parameter, so its ids are broadcast; rows of one id count as that of the least text, so only
    the sample's texts are shuffled.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    ids = ids.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    ids = ids.groupBy("doc_id").agg(F.min(label).alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
