"""Periodic runs of words: a branching-tandem test over the LCP intervals of suffix, LCP and inverse arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_schema, has_columns, text_slices

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
Words = list[bytes]


def suffix_levels(w: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until no two are equal.

    ``w`` holds small numbers; its last one, like the last of each text in it, stands nowhere else, so
    equal ranks never reach beyond a text. The last level is the inverse suffix array.
    """
    n = len(w)
    count = np.bincount(w)
    rank = (np.cumsum(count) - count)[w]
    levels, todo, k = [rank], np.flatnonzero(count[w] > 1), 1
    while len(todo):
        key = rank[todo] * n + rank[np.minimum(todo + k, n - 1)]
        order = np.argsort(key, kind="stable")
        todo, key = todo[order], key[order]
        old, at = rank[todo], np.arange(len(todo))
        first = lambda x: np.maximum.accumulate(np.where(np.r_[True, x[1:] != x[:-1]], at, 0))
        group = first(key)
        rank = rank.copy()
        rank[todo] = old + group - first(old)
        todo = todo[np.bincount(group, minlength=len(todo))[group] > 1]
        levels.append(rank)
        k *= 2
    return levels


def boundaries(levels: list[np.ndarray], level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array, the places t where suffixes t-1 and t share 2^level words or more, and how many."""
    rank = levels[-1]
    sa = np.empty(len(rank), np.int64)
    sa[rank] = np.arange(len(rank))
    if level >= len(levels):
        return sa, np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = levels[level][sa]
    t = np.flatnonzero(x[1:] == x[:-1]) + 1
    i, j, depth = sa[t - 1], sa[t], np.zeros(len(t), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][i + depth] == levels[k][j + depth]
        depth += same.astype(np.int64) << k
    return sa, t, depth


def _children(t: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Rows first, size, depth, left, right (suffix-array places): each LCP interval's children but one largest."""
    out: list[tuple[int, int, int, int, int]] = []
    stack: list[tuple[int, int, list[int]]] = []  # open intervals: depth, left, first places of their children

    def close(end: int) -> None:
        d, left, firsts = stack.pop()
        ends = [*firsts[1:], end]
        sizes = [e - f for f, e in zip(firsts, ends)]
        largest = sizes.index(max(sizes))
        out.extend((f, s, d, left, end - 1) for c, (f, s) in enumerate(zip(firsts, sizes)) if c != largest)

    last = -2
    for x, d in zip(t.tolist(), depth.tolist()):
        if x != last + 1:
            while stack:
                close(last + 1)
        left = x - 1
        while stack and stack[-1][0] > d:
            left = stack[-1][1]
            close(x)
        if stack and stack[-1][0] == d:
            stack[-1][2].append(x)
        else:
            stack.append((d, left, [left, x]))
        last = x
    while stack:
        close(last + 1)
    return np.array(out, np.int64).reshape(-1, 5).T


def branching_squares(w: np.ndarray, least: int) -> np.ndarray:
    """Rows end, period: squares of ``period`` words twice that the next word doesn't carry on.

    A suffix i of an interval of depth d starts such a square if i + d is in the interval too, in another
    child. It is enough to look at all children but a largest, forwards and backwards. Every run of
    ``least`` words or more has a square of more than a quarter of its length, so shallower
    intervals needn't be looked at.
    """
    levels = suffix_levels(w)
    sa, t, depth = boundaries(levels, (least // 4 + 1).bit_length() - 1)
    first, size, d, left, right = _children(t, depth)
    row = np.repeat(np.arange(len(size)), size)
    i = sa[first[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)]
    first, size, d, left, right = first[row], size[row], d[row], left[row], right[row]
    found = []
    for other, start in ((i + d, i), (i - d, i - d)):
        place = levels[-1][np.maximum(other, 0)]
        hit = (other >= 0) & (left <= place) & (place <= right) & ((place < first) | (place >= first + size))
        found.append(np.stack([start[hit] + 2 * d[hit] - 1, d[hit]]))
    return np.unique(np.concatenate(found, axis=1), axis=1)


def _carried_left(w: np.ndarray, start: int, period: int) -> int:
    """How far left of ``start`` words stay equal to those ``period`` words later."""
    at, block = start, 16
    while at > 0:
        block = min(block, at)
        differ = np.flatnonzero(w[at - block : at] != w[at - block + period : at + period])
        if len(differ):
            return at - block + int(differ[-1]) + 1
        at, block = at - block, block * 2
    return at


def _least_period(w: np.ndarray, start: int, end: int, period: int) -> int:
    """The smallest period of w[start : end + 1]; it divides any period of half the length or less."""
    small = [p for p in range(1, int(period**0.5) + 1) if period % p == 0]
    for p in [*small, *[period // p for p in reversed(small)]]:
        if (w[start : end + 1 - p] == w[start + p : end + 1]).all():
            return p
    return period


def find_runs(w: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least max(least, 2 periods) in ``w``, ordered.

    The squares that end a run (all multiples of its period) share their last word. The shortest one is
    rotated left as far as words repeat; its multiples within the run are the run's own.
    """
    runs = set()
    end, period = branching_squares(w, least)
    for group in np.split(np.arange(len(end)), np.flatnonzero(np.diff(end)) + 1):
        d = period[group]
        while len(d):
            e = int(end[group[0]])
            start = _carried_left(w, e - 2 * int(d[0]) + 1, int(d[0]))
            p = _least_period(w, start, e, int(d[0]))
            if e - start + 1 >= least:
                runs.add((start, e - start + 1, p))
            d = d[1:][(d[1:] % p != 0) | (2 * d[1:] > e - start + 1)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[Words], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """The runs of each text; the texts go through one suffix array, with numbers of their own for the
    words of each, so nothing that several texts share is compared."""
    numbers, starts, at = [], [], 0
    base = 0
    for words in texts:
        own: dict[bytes, int] = {}
        one = [own.setdefault(x, len(own)) for x in words]
        one.append(len(own))
        numbers.append(np.array(one, np.int64) + base)
        base += len(own) + 1
        starts.append(at)
        at += len(one)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return out
    where = np.array(starts, np.int64)
    for start, length, period in find_runs(np.concatenate(numbers), least):
        i = int(np.searchsorted(where, start, "right")) - 1
        out[i].append((start - starts[i], length, period))
    return out


def collapse(words: Words, runs: list[tuple[int, int, int]]) -> Words:
    """``words`` without those that some run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    dropped = np.cumsum(step[:-1]) > 0
    return [x for x, gone in zip(words, dropped.tolist()) if not gone]


def detect(docs: DataFrame, least: int = 12, change: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed text of every row.

    Words are runs without ASCII white space of the whole text; ``change`` may give other words for a
    row's id and words. Null, empty and wordless texts have no words, no runs and an empty collapsed
    text; repeated rows and null ids each keep their row; other columns take no part; an empty table
    gives no rows. A task holds about 1 MB of texts at a time, or one longer text whole: about 150 bytes
    for each of its words and doubling of its longest repetition.
    """
    wanted = arrow_schema(FOUND)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for first, part in text_slices(batch, "text"):
                own = ids.slice(first, len(part))
                texts = [(t or b"").split() for t in part]
                if change:
                    texts = [change(i, x) for i, x in zip(own.to_pylist(), texts)]
                runs = runs_of_texts(texts, least)
                size = np.cumsum([0, *map(len, runs)])
                flat = np.array([r for x in runs for r in x], np.int64).reshape(-1, 3)
                spans = pa.StructArray.from_arrays([pa.array(c) for c in flat.T.copy()], fields=list(wanted.field("runs").type.value_type))
                kept = [b" ".join(collapse(x, r)) for x, r in zip(texts, runs)]
                cols = [
                    own, pa.array([len(x) for x in texts], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(size, pa.int32()), spans, type=wanted.field("runs").type), pa.array(kept, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(cols, schema=wanted)

    return has_columns(docs, "doc_id", "text").mapInArrow(each, FOUND)
