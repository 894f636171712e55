"""Quality classifier: histogram gradient-boosted trees over document statistics, held as flat arrays
that numpy traverses for all rows and trees at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name
from .text_stats import STATS, labelled_sample, rows


def features(counts: np.ndarray) -> np.ndarray:
    """Rates and logarithms of the counts of text_stats (columns in the order of STATS)."""
    c = {s: counts[:, i].astype(np.float64) for i, s in enumerate(STATS)}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words, np.log1p(c["n_lines"]), c["n_distinct_words"] / words, c["n_upper"] / chars,
        c["n_digits"] / chars, c["n_bars"] / words, c["n_marks"] / words, c["n_stops"] / words,
        np.log1p(c["longest_word"]), c["most_common"] / words, c["n_upper_words"] / words, words / lines,
    ], axis=1) if len(counts) else np.zeros((0, 16))


@dataclass
class Trees:
    """Complete binary trees of one depth. Node k of tree t sends x to 2k + 1 + (x[feature] > threshold);
    an unsplit node has threshold infinity."""

    depth: int
    start: float
    feature: np.ndarray  # trees x (2^depth - 1), int
    threshold: np.ndarray  # trees x (2^depth - 1)
    value: np.ndarray  # trees x 2^depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        out = np.full(len(x), self.start)
        t = np.arange(len(self.feature))[None, :]
        for i in range(0, len(x) if len(self.feature) else 0, 2048):
            part = x[i : i + 2048]
            r, at = np.arange(len(part))[:, None], np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (part[r, self.feature[t, at]] > self.threshold[t, at])
            out[i : i + 2048] += self.value[t, at - (2**self.depth - 1)].sum(1)
        return 1 / (1 + np.exp(-out))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64,
    least: float = 5.0, l2: float = 1.0,
) -> Trees:
    """Boost logistic loss on binned features; a split needs a hessian sum of ``least`` on each side.
    No rows, or rows of one label, give trees that only hold the (smoothed) base rate."""
    n, d = x.shape
    base = (y.sum() + 1) / (n + 2)
    start = float(np.log(base / (1 - base)))
    inner, leaves = 2**depth - 1, 2**depth
    if not n or y.min() == y.max():
        return Trees(depth, start, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    cuts = np.full((d, bins), np.inf)
    for j, e in enumerate(edges):
        cuts[j, : len(e)] = e
    feature, threshold, value = [], [], []
    margin = np.full(n, start)
    offset = np.arange(d)[None, :] * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        f, th = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            k, first = 2**level, 2**level - 1
            slot = ((node - first)[:, None] * (d * bins) + offset + b).ravel()
            hist = [np.bincount(slot, np.repeat(v, d), k * d * bins).reshape(k, d, bins).cumsum(2) for v in (g, h)]
            gl, hl = hist
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least) | ~np.isfinite(cuts)[None]] = 0
            flat = gain.reshape(k, -1)
            pick = flat.argmax(1)
            for i in np.flatnonzero(flat[np.arange(k), pick] > 1e-9):
                f[first + i], th[first + i] = pick[i] // bins, cuts[pick[i] // bins, pick[i] % bins]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > th[node])
        leaf = node - inner
        v = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        margin += v[leaf]
        feature.append(f)
        threshold.append(th)
        value.append(v)
    return Trees(depth, start, np.array(feature), np.array(threshold), np.array(value))


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, **options: float) -> Trees:
    """Fit on at most ``most`` labelled documents (a bound, whatever the corpus); statistics are made
    by Spark, the trees grow on the driver. Held-out rows, language, source and id are no inputs."""
    sample = labelled_sample(docs, labels, "quality", most)
    raw = sample.select("doc_id", "y", _counts("text").alias("c")).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    if raw.empty:
        return fit_trees(np.zeros((0, 16)), np.zeros(0), **options)
    return fit_trees(features(np.array(raw["c"].tolist())), raw["y"].to_numpy().astype(np.float64), **options)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _counts(texts: pa.Array) -> pa.Array:
    return pa.array(rows(texts), pa.list_(pa.int64()))


def score(trees: Trees, text: str = "text") -> Column:
    """The probability of label 1 of a text column; null and empty texts are scored like others."""

    @F.arrow_udf(T.DoubleType())
    def apply(texts: pa.Array) -> pa.Array:
        counts = np.array(rows(texts), np.int64).reshape(-1, len(STATS))
        return pa.array(trees.score(features(counts)))

    return apply(F.col(f"`{text}`"))


def classify(docs: DataFrame, trees: Trees, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; repeated rows score alike, null ids pass
    through (held_out false), an empty table gives no rows."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), score(trees).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, trees: Trees, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with their columns, of score ``threshold`` or more; no row is shuffled."""
    own = free_name(docs, "__p")
    return docs.withColumn(own, score(trees)).where(F.col(own) >= threshold).drop(own)
