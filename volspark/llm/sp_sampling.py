"""SentencePiece encoding, decoding, and sampling of segmentations without replacement.

A text's lattice has an edge for every piece; a segmentation's probability is the normalised product
of its pieces' weights. Gumbel top-k: each segmentation's log-probability is perturbed by Gumbel noise
and the k largest are k draws without replacement. They are found by A*: a partition of the
segmentations has as its priority the exact maximum of its perturbed members, drawn top-down, so
only partitions that hold a sample are ever opened.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_schema, has_columns, text_slices

SPACE = "▁"
#: Odd 64-bit multipliers of the splitmix64 generator, also used for substring hashes.
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Lattices:
    """Lattices of the units (a run of spaces and the word behind it; no piece goes beyond) of all
    texts seen, as flat arrays over nodes (a unit's positions) and edges.

    Weights are Zipf-Mandelbrot in a piece's merge rank, raised to ``alpha``; a character without a
    piece is one edge of byte pieces. At most ``most`` units are held; then the arrays start afresh.
    """

    def __init__(self, path: str, alpha: float = 1.0, most: int = 400_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most, self.alpha = most, alpha
        self.piece: dict[str, tuple[int, float]] = {}
        for i in range(self.sp.get_piece_size()):
            if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i)):
                s = self.sp.id_to_piece(i)
                self.piece[s] = (i, -alpha * math.log(2.7 + max(0.0, -self.sp.get_score(i))))
        # For each length, the pieces' prefixes in a hash table: see _table.
        self.prefix: list[tuple[np.ndarray, ...]] = []
        for n in range(1, max(map(len, self.piece)) + 1):
            some = sorted({x[:n] for x in self.piece if len(x) >= n})
            found = [self.piece.get(x, (-1, 0.0)) for x in some]
            h = np.zeros(len(some), np.uint64)
            codes = np.array([[ord(c) for c in x] for x in some], np.uint64)
            for j in range(n):
                h = h * _C[0] + codes[:, j] + np.uint64(1)
            self.prefix.append(_table(h, np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found])))
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.low = -alpha * math.log(1e6)
        self.clear()

    def clear(self) -> None:
        self.unit: dict[str, int] = {}
        self.n_nodes = self.n_edges = 0
        self._first = np.zeros(1 << 16, np.int32)  # of a node: its first edge; one more entry ends the last
        self._share = np.zeros(1 << 16, np.uint32)  # of an edge: the largest 32-bit draw that takes it or one before it
        self._next = np.zeros(1 << 16, np.int32)  # of an edge: the first edge behind it, -1 at the unit's end
        self._logp = np.zeros(1 << 16)
        self._to = np.zeros(1 << 16, np.int32)
        self._ids = np.zeros(1 << 16, np.int32)
        self.long: list[list[int]] = []  # several byte pieces of an edge, whose id is -1 - the place here

    def arrays(self) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """first, (share, next), logp, to."""
        n = self.n_edges
        return self._first[: self.n_nodes + 1], (self._share[:n], self._next[:n]), self._logp[:n], self._to[:n]

    def ids(self) -> np.ndarray:
        return self._ids[: self.n_edges]

    def _grow(self, name: str, size: int) -> None:
        old = getattr(self, name)
        if size > len(old):
            new = np.zeros(max(size, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def add(self, units: list[str]) -> None:
        """Lattices of new units. A unit has a node for each position, the last without edges. Edges are
        found for all positions at once, one length after another; backward sums likewise, one
        distance from the end after another."""
        if not units:
            return
        base, edge = self.n_nodes, self.n_edges
        text = "".join(units)
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        lengths = np.array([len(u) for u in units], np.int64)
        ends = np.cumsum(lengths)
        whose = np.repeat(np.arange(len(units)), lengths)
        end = ends[whose]
        alive, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        plain = np.zeros(len(codes), bool)
        got: list[tuple[np.ndarray, ...]] = []
        for n, table in enumerate(self.prefix, 1):
            inside = alive + n <= end[alive]
            alive, h = alive[inside], h[inside]
            if not len(alive):
                break
            h = h * _C[0] + codes[alive + n - 1] + np.uint64(1)
            at = _find(h, table)
            hit = at >= 0
            alive, h, at = alive[hit], h[hit], at[hit]
            ids, weights = table[2], table[3]
            whole = ids[at] >= 0
            if n == 1:
                plain[alive[whole]] = True
            got.append((alive[whole], np.full(int(whole.sum()), n), ids[at[whole]], weights[at[whole]]))
        bare = np.flatnonzero(~plain)
        raws = [[self.bytes[b] for b in text[i].encode("utf-8", "replace")] for i in bare.tolist()]
        got.append((bare, np.ones(len(bare), np.int64), np.array([r[0] for r in raws], np.int64), self.low * np.array([len(r) for r in raws], np.float64)))
        start, step, e_ids, w = (np.concatenate(c) for c in zip(*got))
        order = np.argsort(start * 64 - step, kind="stable")  # of a node, longer pieces first
        start, step, e_ids, w = start[order], step[order], e_ids[order], w[order]
        if len(bare):
            where = np.flatnonzero(order >= len(order) - len(bare))
            for x, k in zip(where.tolist(), (order[where] - (len(order) - len(bare))).tolist()):
                if len(raws[k]) > 1:
                    e_ids[x] = -1 - len(self.long)
                    self.long.append(raws[k])
        e_node = start + whose[start]
        e_to = e_node + step
        firsts = ends - lengths + np.arange(len(units))
        self.unit.update(zip(units, (firsts + base).tolist()))
        at = base + len(codes) + len(units)
        node = e_node
        size = lengths + 1
        total = at - base
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        left = np.repeat(begin + size - 1, size) - np.arange(total)  # positions to the unit's end
        level = left[e_node]
        if len(level) and level.max() < 1 << 16:
            level = level.astype(np.uint16)  # sorted by radix
        order = np.argsort(level, kind="stable")
        level = level[order]
        back = np.zeros(total)
        for d in range(1, int(level[-1]) + 1 if len(level) else 0):
            a, b = np.searchsorted(level, [d, d + 1])
            if a < b:
                o = order[a:b]
                own = e_node[o]
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                back[own[starts]] = np.logaddexp.reduceat(w[o] + back[e_to[o]], starts)
        lp = np.minimum(w + back[e_to] - back[e_node], 0.0)
        first = np.searchsorted(e_node, np.arange(total + 1))
        share = np.exp(lp)
        fan = np.diff(first)
        for j in range(1, int(fan.max()) if total else 0):
            own = first[:-1][fan > j] + j
            share[own] += share[own - 1]
        share[first[1:][fan > 0] - 1] = 1.0
        draw = np.maximum(np.ceil(np.minimum(share, 1.0) * 2.0**32) - 1, 0).astype(np.uint32)
        behind = np.where(np.append(fan, 0)[e_to] > 0, first[e_to] + edge, -1)
        for name, new, n in (("_share", draw, edge), ("_next", behind, edge), ("_logp", lp, edge), ("_to", e_to + base, edge), ("_ids", e_ids, edge), ("_first", first + edge, base)):
            self._grow(name, n + len(new) + 1)
            getattr(self, name)[n : n + len(new)] = new
        self.n_nodes, self.n_edges = at, edge + len(node)

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        s = self.sp.normalize(text)
        if s[:1] == SPACE and s[-1:] != SPACE and 2 * SPACE not in s and "\0" not in s:
            return s.replace(SPACE, "\0" + SPACE).split("\0")[1:]
        return _UNITS.findall(s)


def _table(h: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bucket starts, hashes, ids, weights): entries by the top bits of a mixed hash, about one a bucket."""
    bits = np.uint64(64 - max(1, int(len(h) - 1).bit_length() + 1))
    key = (h * _C[1]) >> bits
    order = np.argsort(key, kind="stable")
    starts = np.searchsorted(key[order], np.arange((1 << int(64 - bits)) + 1, dtype=np.uint64))
    return starts, h[order], ids[order], weights[order], bits


def _find(h: np.ndarray, table: tuple[np.ndarray, ...]) -> np.ndarray:
    """The place of each hash in the table, -1 where it has none."""
    starts, hashes, _, _, bits = table
    key = ((h * _C[1]) >> bits).astype(np.int64)
    at, end = starts[key], starts[key + 1]
    out = np.full(len(h), -1, np.int64)
    who = np.flatnonzero(at < end)
    at, end = at[who], end[who]
    while len(who):
        same = hashes[at] == h[who]
        out[who[same]] = at[same]
        at += 1
        more = ~same & (at < end)
        who, at, end = who[more], at[more], end[more]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def _stream(key: np.ndarray, *numbers: np.ndarray | int) -> np.ndarray:
    """Independent 64-bit streams named by a row's key and numbers."""
    for n in numbers:
        key = _mix(key + _C[0] * (np.atleast_1d(n).astype(np.uint64) + np.uint64(1)))
    return key


def _uniform(stream: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((stream >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _walk(nodes: np.ndarray, streams: np.ndarray, lat: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Draw a path from each node to its unit's end, all at once: (edges, how many of each start), in order."""
    first, (share, behind), *_ = lat
    e = first[nodes]
    who = np.flatnonzero(e < first[nodes + 1])
    e, s = e[who], streams[who]
    found = []
    taken = np.zeros(len(nodes), np.int64)
    step = 0
    while len(e):
        u = ((_stream(s, step) if step else s) >> np.uint64(32)).astype(np.uint32)
        more = np.flatnonzero(share[e] < u)
        while len(more):  # likely edges come first, so few rows stay
            e[more] += 1
            more = more[share[e[more]] < u[more]]
        found.append((who, e))
        taken[who] += 1
        e = behind[e]
        open_ = e >= 0
        who, s, e = who[open_], s[open_], e[open_]
        step += 1
    starts = np.cumsum(taken) - taken
    out = np.zeros(int(taken.sum()), np.int32)
    for i, (who, e) in enumerate(found):
        out[starts[who] + i] = e
    return out, taken


def _truncated(mu: np.ndarray, bound: np.ndarray | float, streams: np.ndarray) -> np.ndarray:
    """Gumbel variables of location ``mu``, each given that it is at most ``bound``."""
    with np.errstate(all="ignore"):
        # mu - log(exp(mu - bound) + E), in logarithms
        return mu - np.logaddexp(mu - bound, np.log(-np.log(_uniform(streams))))


#: No draw of _truncated exceeds its location by more: -log(-log(u)) of the largest u below 1.
_REACH = 37.5


def _partings(lp: np.ndarray, cut: np.ndarray, before: np.ndarray, bound: np.ndarray, streams: np.ndarray, want: int) -> list[list[tuple[float, int, float]]]:
    """For each text the ``want`` best (perturbed value, step, log-probability before it) of the
    segmentations that leave its path at a step. ``lp``: the steps of all paths; text n has cut[n] to
    cut[n + 1] and ``before[n]`` ahead of them.

    Steps that have no other way are passed over. The log-probability before a step falls along a
    path, so once it is more than _REACH under the least of the ``want`` best, no later step can be
    among them; of most paths no more than 128 steps are looked at.
    """
    free = np.flatnonzero(lp < -1e-15)
    whose = np.searchsorted(free, cut)
    local = free - np.repeat(cut[:-1], np.diff(whose))
    lp = lp[free]
    out: list[list[tuple[float, int, float]]] = [[] for _ in before]
    size = np.diff(whose)
    left, width = np.flatnonzero(size), 128
    while len(left):
        n = np.minimum(size[left], width)
        column = np.arange(int(n.max()))
        inside = column < n[:, None]
        at = np.minimum(whose[left][:, None] + column, len(lp) - 1)
        w = np.where(inside, lp[at], 0.0)
        sums = np.cumsum(np.concatenate([before[left][:, None], w], axis=1), axis=1)
        with np.errstate(divide="ignore"):
            mu = sums[:, :-1] + np.log(-np.expm1(w))
        g = _truncated(mu, bound[left][:, None], _stream(streams[left][:, None], local[at]))
        g[~inside] = -np.inf
        best = np.argpartition(-g, want - 1, axis=1)[:, :want] if g.shape[1] > want else np.broadcast_to(column, g.shape)
        row = np.arange(len(left))[:, None]
        value = g[row, best]
        least = value.min(axis=1) if g.shape[1] >= want else np.full(len(left), -np.inf)
        done = (size[left] <= width) | (sums[:, -1] + _REACH < least)
        for n_, vs, bs, ps in zip(left[done].tolist(), value[done].tolist(), local[at[row, best]][done].tolist(), sums[row, best][done].tolist()):
            out[n_] = [x for x in zip(vs, bs, ps) if x[0] > -math.inf]
        left, width = left[~done], 4 * width
    return out


def sample_many(starts: list[np.ndarray], keys: np.ndarray, lat: tuple, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text: (edges, log-probability, perturbed log-probability) of its k largest, falling, and
    the perturbed value alone of the next.

    ``starts``: first nodes of the text's units. Round r opens the best partition of every text: a
    partition holds the segmentations that share a path's steps before i and avoid some edges there.
    Texts go through a round together, but each draws from its own streams.
    """
    first, _, logp, to = lat
    heaps: list[list] = [[] for _ in starts]
    out: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in starts]
    keys = keys.astype(np.uint64)
    serial = iter(range(1 << 62))
    bound = -np.log(-np.log(_uniform(_stream(keys, 0, 0))))
    who, heads, before = list(range(len(starts))), [None] * len(starts), np.zeros(len(starts))
    nodes, unit = list(starts), np.zeros(len(starts), np.int64)
    for r in range(k):
        if not who:
            break
        # Walk the open ends of all texts; ``heads`` are the edges before, ``unit`` the first open unit.
        size = np.array([len(x) for x in nodes], np.int64)
        ends = np.cumsum(size)
        number = np.arange(int(ends[-1])) + np.repeat(unit - (ends - size), size)
        mine = keys[who]
        e, taken = _walk(np.concatenate(nodes), _stream(np.repeat(_stream(mine, r, 1), size), number), lat)
        cut = np.concatenate([[0], np.cumsum(taken)])[np.concatenate([[0], ends])]
        lp = logp[e]
        total = np.add.reduceat(np.append(lp, 0.0), cut[:-1]) if len(cut) > 1 else np.zeros(0)
        total = before + np.where(np.diff(cut) > 0, total, 0.0)
        best = _partings(lp, cut, before, bound, _stream(mine, r, 2), k - r)
        for n, (i, head) in enumerate(zip(who, heads)):
            path = e[cut[n] : cut[n + 1]]
            ahead = 0
            if head is not None:
                path, ahead = np.concatenate([head, path]), len(head)
            out[i].append((path, float(total[n]), float(bound[n])))
            for g, step, prior in best[n]:
                heapq.heappush(heaps[i], (-g, next(serial), path, ahead + step, prior, (int(path[ahead + step]),)))
        if r == k - 1:
            break
        # Open the best partition of each text.
        draws, again = (_uniform(_stream(keys, r, 3, x)).tolist() for x in (0, 1))
        who, heads, nodes, rest, news, bounds = [], [], [], [], [], []
        for i, heap in enumerate(heaps):
            if not heap:
                continue
            g0, _, old, at, prior, shut = heapq.heappop(heap)
            done = to[old[:at]]
            closed = first[done] == first[done + 1]
            u = int(np.count_nonzero(closed))
            node = int(starts[i][u] if not at or closed[-1] else done[-1])
            edges = range(int(first[node]), int(first[node + 1]))
            p = [(x, math.exp(logp[x])) for x in edges if x not in shut]
            draw = draws[i] * sum(x for _, x in p)
            pick = p[-1][0]
            for x, q in p:
                draw -= q
                if draw < 0:
                    pick = x
                    break
            shut = (*shut, pick)
            left = sum(q for x, q in p if x != pick)
            head = np.append(old[:at], np.int32(pick))
            if len(shut) < len(edges) and left > 1e-15:
                mu = prior + math.log(left)
                x, y = mu + g0, math.log(-math.log(again[i]))
                g = mu - max(x, y) - math.log1p(math.exp(-abs(x - y)))
                heapq.heappush(heap, (-g, next(serial), head, at, prior, shut))
            who.append(i)
            heads.append(head)
            rest.append(prior + float(logp[pick]))
            nodes.append(np.concatenate([to[pick : pick + 1], starts[i][u + 1 :]]))
            news.append(u)
            bounds.append(-g0)
        before, unit, bound = np.array(rest), np.array(news, np.int64), np.array(bounds)
    for some, heap in zip(out, heaps):
        if heap and len(some) == k:
            some.append((np.zeros(0, np.int64), math.nan, -heap[0][0]))
    return out


def inclusion(logp: float, threshold: float) -> float:
    """Probability that a segmentation is among the k, given the (k + 1)-th perturbed value."""
    return -math.expm1(-math.exp(min(logp - threshold, 700.0)))


_held: dict[tuple[str, float], Lattices] = {}


def _lattices(path: str, alpha: float) -> Lattices:
    if (path, alpha) not in _held:
        _held[path, alpha] = Lattices(path, alpha)
    return _held[path, alpha]


def sample_texts(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text (piece ids, log-probability, perturbed value, inclusion score) of up to k distinct
    segmentations; ``keys``: 64-bit keys that name the draws."""
    units = [lattices.units(t) for t in texts]
    if len(lattices.unit) > lattices.most:
        lattices.clear()
    known, flat = lattices.unit, list(chain.from_iterable(units))
    nodes = np.fromiter(map(known.get, flat, repeat(-1)), np.int32, len(flat))
    if len(new := np.flatnonzero(nodes < 0)):
        unseen = [flat[i] for i in new.tolist()]
        lattices.add(list(dict.fromkeys(unseen)))
        nodes[new] = np.fromiter(map(known.__getitem__, unseen), np.int32, len(unseen))
    starts = np.split(nodes, np.cumsum([len(us) for us in units])[:-1])
    ids, out = lattices.ids(), []
    for found in sample_many(starts, keys, lattices.arrays(), k):
        last = found[k][2] if len(found) > k else -math.inf
        rows = []
        for edges, lp, g in found[:k]:
            pieces = ids[edges]
            if len(pieces) and pieces.min() < 0:
                pieces = np.array([x for p in pieces.tolist() for x in (lattices.long[-1 - p] if p < 0 else (p,))], np.int32)
            rows.append((pieces, lp, g, 1.0 if last == -math.inf else inclusion(lp, last)))
        out.append(rows)
    return out


def row_key(seed: int, doc_id: int | None, text: bytes | None) -> int:
    """The key of a row's draws: of the seed and the doc_id, or of the text where that is null."""
    own = f"null {zlib.crc32(text or b'')}" if doc_id is None else str(doc_id)
    return xxhash.xxh64_intdigest(own, seed)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


SAMPLES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("sample", T.IntegerType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("logp", T.DoubleType()),
    T.StructField("perturbed", T.DoubleType()), T.StructField("inclusion", T.DoubleType()),
])


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids: the library's own segmentation of each whole text (null: empty)."""
    path = model or default_path()
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    wanted = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _lattices(path, 1.0).sp
        for batch in batches:
            for first, texts in text_slices(batch, "text"):
                ids = sp.encode([(t or b"").decode("utf-8", "replace") for t in texts], num_threads=1)
                keys = batch.column(0).slice(first, len(texts)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32()))], schema=wanted)

    return has_columns(docs, "doc_id", "text").mapInArrow(run, out)


def decode(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of rows of (doc_id, ids); null ids give an empty text."""
    path = model or default_path()
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    wanted = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _lattices(path, 1.0).sp
        for batch in batches:
            texts = [sp.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], schema=wanted)

    return tokens.select("doc_id", "ids").mapInArrow(run, out)


def sample_segmentations(docs: DataFrame, k: int = 3, seed: int = 0, alpha: float = 1.0, model: str | None = None) -> DataFrame:
    """SAMPLES: up to ``k`` distinct segmentations of every whole text, in falling perturbed value.

    Draws are seeded by (seed, doc_id), so any task, and a retry, gives the same; a null doc_id is
    seeded by the text. Null and empty texts have one empty segmentation; a text with fewer than k
    gives all it has, with inclusion score 1; repeated rows give equal draws; an empty table gives
    no rows.
    """
    path = model or default_path()
    wanted = arrow_schema(SAMPLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _lattices(path, alpha)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, texts in text_slices(batch, "text"):
                own = keys[first : first + len(texts)]
                seeds = np.array([row_key(seed, d, t) for d, t in zip(own, texts)], np.uint64)
                found = sample_texts(lattices, [(t or b"").decode("utf-8", "replace") for t in texts], seeds, k)
                rows = [(key, i + 1, *row) for key, some in zip(own, found) for i, row in enumerate(some)]
                key, number, ids, *rest = zip(*rows)
                ends = np.cumsum([0, *map(len, ids)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32, copy=False)))
                cols = [pa.array(key, pa.int64()), pa.array(number, pa.int32()), ids.cast(wanted.field("ids").type), *[pa.array(c, pa.float64()) for c in rest]]
                yield pa.RecordBatch.from_arrays(cols, schema=wanted)

    return has_columns(docs, "doc_id", "text").mapInArrow(run, SAMPLES)
