"""Importance resampling towards a target: hashed n-gram counts of corpus and target give each bucket a gain,
documents are drawn by their mean gain and a Gumbel draw of their own.

Words are found by an Aho-Corasick automaton over a dictionary of words between delimiters; each entry
carries the CRC and length of its word, and the CRC of a longer n-gram is composed from those of its words.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, has_columns, materialize, partitions, small, text_slices

#: A-Z become lower-case; ASCII characters but digits and letters become delimiters.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Words in a worker's dictionary, bytes of a word in it, and bytes of text that are scanned at a time.
MOST_WORDS, MOST_BYTES, BLOCK = 50_000, 255, 1 << 18
_LOW = np.uint64(0xFFFFFFFF)
SCORED = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])
COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in ("bucket", "n")])


class Dictionary:
    """Words that this worker has met, with (crc, bytes) payloads.

    It holds ``most`` words or fewer and only saves work: a word that it lacks gets its payload from its
    bytes. The automaton is made again whenever new words make up a quarter of it.
    """

    def __init__(self, most: int = MOST_WORDS):
        self.most, self.held, self.new = most, 0, {}
        self.table = np.zeros(0, np.uint64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)

    def _learn(self) -> None:
        if self.held >= self.most or len(self.new) <= 256 + self.held // 4:
            return
        self.grow()

    def grow(self) -> None:
        for i, word in enumerate(self.new, self.held):
            self.automaton.add_word(f" {word} ", i)
        self.automaton.make_automaton()
        self.table = np.r_[self.table, np.array(list(self.new.values()), np.uint64)]
        self.held, self.new = len(self.table), {}

    def _packed(self, word: str) -> int:
        """crc, bytes (32 bits each) of a word that the automaton doesn't know."""
        found = self.new.get(word)
        if found is None:
            raw = word.encode("utf-8", "surrogateescape")
            found = zlib.crc32(raw) | len(raw) << 40 | len(word) << 32
            if len(raw) > MOST_BYTES:
                return zlib.crc32(raw) | len(raw) << 40
            if self.held + len(self.new) < self.most:
                self.new[word] = found
        return found

    def _block(self, plain: bytes) -> np.ndarray:
        text = f" {plain.decode('utf-8', 'surrogateescape')} "
        known = list(self.automaton.iter(text)) if self.held else []
        end, entry = (np.array(x, np.int64) for x in (zip(*known) if known else ((), ())))
        packed = self.table[entry]
        start = end - 1 - (packed >> np.uint64(32) & np.uint64(255)).astype(np.int64)
        before, after = np.r_[0, end], np.r_[start, len(text) - 1]
        where, values = [], []
        for i in np.flatnonzero(after > before).tolist():  # text between known words
            more = [self._packed(w) for w in text[before[i] : after[i]].split(" ") if w]
            values += more
            where += [i] * len(more)
        return np.insert(packed, where, np.array(values, np.uint64)) if where else packed

    def payloads(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """CRC and bytes of each word of a whole text, in order."""
        plain, first, out = (text or b"").translate(_PLAIN), 0, [np.zeros(0, np.uint64)]
        while first < len(plain):
            last = len(plain) if len(plain) - first <= BLOCK else plain.find(b" ", first + BLOCK)
            last = len(plain) if last < 0 else last
            out.append(self._block(plain[first:last]))
            first = last
            self._learn()
        packed = np.concatenate(out)
        return packed & _LOW, packed >> np.uint64(40)


_worker: dict[int, Dictionary] = {}


def _dictionary(most: int) -> Dictionary:
    """The dictionary of this worker process, kept from task to task."""
    return _worker.setdefault(most, Dictionary(most))


def _zeros(n_bytes: int) -> np.ndarray:
    """How ``n_bytes`` zero bytes change a CRC, as four tables for its bytes."""
    if n_bytes not in _moved:
        one = [zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)]  # a step of the register by one byte
        step = np.array([one, *[[b << 8 * (k - 1) for b in range(256)] for k in (1, 2, 3)]], np.uint64)
        total = np.array([[b << 8 * k for b in range(256)] for k in range(4)], np.uint64)
        left = n_bytes
        while left:
            if left & 1:
                total = _through(step, total)
            step, left = _through(step, step), left >> 1
        if len(_moved) > 1024:
            _moved.clear()
        _moved[n_bytes] = total
    return _moved[n_bytes]


_moved: dict[int, np.ndarray] = {}


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for k in range(4):
        out ^= tables[k][(crc >> np.uint64(8 * k)) & np.uint64(255)]
    return out


def composed(left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray) -> np.ndarray:
    """CRCs of texts put together from their parts' CRCs and the right parts' lengths."""
    out = right.copy()
    for n in np.unique(right_bytes):
        at = right_bytes == n
        out[at] ^= _through(_zeros(int(n)), left[at])
    return out


def features(text: bytes | None, most: int, buckets: int, words: Dictionary) -> tuple[int, np.ndarray]:
    """How many words a text has, and the buckets of its runs of 1 to ``most`` words, joined by one space."""
    crc, size = words.payloads(text)
    out, gram = [crc], crc
    if most > 1:
        spaced = composed(np.full(len(crc), zlib.crc32(b" "), np.uint64), crc, size)
    for n in range(2, min(most, len(crc)) + 1):
        gram = composed(gram[:-1], spaced[n - 1 :], size[n - 1 :] + np.uint64(1))
        out.append(gram)
    return len(crc), (np.concatenate(out) % np.uint64(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, most: int = 1, buckets: int = 10_000, words: int = MOST_WORDS) -> DataFrame:
    """(bucket, n) over all features of all whole texts; each task sends one row a bucket at most."""
    wanted = arrow_schema(COUNTS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros(buckets, np.int64), _dictionary(words)
        for batch in batches:
            for _, part in text_slices(batch, "text"):
                for t in part:
                    total += np.bincount(features(t, most, buckets, own)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], schema=wanted)

    return has_columns(docs, "text").mapInArrow(each, COUNTS).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Per bucket the floored 1000 ln of its share in the target over that in the corpus, both smoothed by one."""
    s, t = (np.zeros(buckets, np.int64) for _ in range(2))
    for count, rows in ((s, corpus), (t, target)):
        for bucket, n in rows.select("bucket", "n").collect():  # ``buckets`` rows at most
            count[bucket] = n
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(((y + 1.0) * all_s) / ((x + 1.0) * all_t))) for x, y in zip(s.tolist(), t.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """The id's own draw, in thousandths; a null id is that of an empty name."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, most: int = 1, seed: int = 2024, words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain; no features: 0) and score of every row."""
    wanted = arrow_schema(SCORED)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _dictionary(words)
        for batch in batches:
            ids, rows = batch.column(0).cast(pa.int64()).to_pylist(), []
            for first, part in text_slices(batch, "text"):
                for i, t in zip(ids[first : first + len(part)], part):
                    n, bucket = features(t, most, len(gain), own)
                    weight = int(gain[bucket].sum()) // max(1, len(bucket))
                    rows.append((i, n, len(bucket), weight, weight + gumbel(i, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, schema=wanted)

    return has_columns(docs, "doc_id", "text").mapInArrow(each, SCORED)


def draw(scored: DataFrame, percent: int = 10, least_words: int = 20) -> DataFrame:
    """``scored`` with rank: 1, 2, ... for the floor(percent * N / 100) highest scores of the N rows with
    ``least_words`` words or more (ties to the smaller doc_id), null for others.

    Scores are whole numbers within some ten thousand of 0, so their histogram is small; it says below
    which score nothing is drawn. Rows above are sorted over ranges, and a row's rank is its place in
    its range after the rows of the ranges before.
    """
    spark, asked = scored.sparkSession, F.col("n_words") >= least_words
    hist = scored.where(asked).groupBy("score").count().toPandas().sort_values("score", ascending=False)
    quota = percent * int(hist["count"].sum()) // 100
    if not quota:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    least = int(hist["score"].to_numpy()[np.searchsorted(hist["count"].cumsum().to_numpy(), quota)])
    high = asked & (F.col("score") >= least)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_words"), F.col("weight")]
    rows = scored.where(high).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumn("place", F.monotonically_increasing_id()), "drawn")
    piece = F.shiftright("place", 33)
    before = rows.groupBy(piece.alias("piece")).agg(F.count("*").alias("n"))  # a row for each partition
    before = before.select("piece", (F.sum("n").over(Window.orderBy("piece")) - F.col("n")).alias("before"))
    rows = rows.withColumn("piece", piece).join(small(materialize(before, "before")), "piece")
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    rows = rows.withColumn("rank", F.when(rank <= quota, rank)).select(*scored.columns, "rank")
    return rows.unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``, drawn towards ``target``.

    Null, empty and wordless texts have no features, weight 0, and are drawn only if ``least_words``
    is 0; equal scores go to the smaller id, a null id last; repeated rows are drawn each by itself, with
    one score; of an empty target every bucket counts as one; other columns take no part; an empty
    table gives no rows.
    """
    gain = gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets), buckets)
    return draw(materialize(score(docs, gain, most, seed), "scored"), percent, least_words)
