"""Elias-Fano coding of non-decreasing integers, with a sampled select structure.

n values below a universe u take about 2 + log2(u / n) bits each: the low ``l`` bits are packed, the
high bits stand as gaps in a bit vector with one set bit for each value. Every ``STEP``-th set bit's
position is kept in 32 bits (the vector has about 3 n bits), so ``select`` reads a bounded stretch of it.
"""

from __future__ import annotations

import numpy as np

STEP = 256


def encode(values: np.ndarray, universe: int) -> dict:
    """{n, l, low, high, samples} for sorted values in [0, universe]; bytes for the three arrays."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    l = max(0, int(universe // n).bit_length() - 1) if n else 0
    low = np.zeros((n, l), np.uint8)
    for b in range(l):
        low[:, b] = (v >> np.uint64(b)) & np.uint64(1)
    at = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
    if n and int(at[-1]) >> 32:
        raise ValueError("a sequence's bit vector must be shorter than 2^32 bits")
    bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    bits[at] = 1
    return {
        "n": n, "l": l, "low": np.packbits(low.ravel(), bitorder="little").tobytes(),
        "high": np.packbits(bits, bitorder="little").tobytes(), "samples": at[::STEP].astype("<u4").tobytes(),
    }


def decode(ef: dict) -> np.ndarray:
    """All values, as int64."""
    n, l = ef["n"], ef["l"]
    at = np.flatnonzero(np.unpackbits(np.frombuffer(ef["high"], np.uint8), bitorder="little"))[:n]
    high = (at - np.arange(n)).astype(np.uint64) << np.uint64(l)
    low = np.unpackbits(np.frombuffer(ef["low"], np.uint8), bitorder="little", count=n * l).reshape(n, l)
    for b in range(l):
        high |= low[:, b].astype(np.uint64) << np.uint64(b)
    return high.astype(np.int64)


def select(ef: dict, i: int) -> int:
    """The i-th value alone (from 0): start at its sample and scan at most to the next."""
    return int(select_many(ef, np.array([i], np.int64))[0])


def select_many(ef: dict, wanted: np.ndarray) -> np.ndarray:
    """The values at ``wanted`` places (ascending), as int64: of the bit vector only stretches between samples that
    hold one are read, of the low bits only those of the places."""
    i = np.asarray(wanted, np.int64)
    n, l = ef["n"], ef["l"]
    if len(i) and not (0 <= i[0] and i[-1] < n):
        raise IndexError(int(i[0] if i[0] < 0 else i[-1]))
    samples = np.frombuffer(ef["samples"], "<u4")
    at = np.empty(len(i), np.int64)
    block = i // STEP
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(i) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(i)]):
        k = int(block[a])
        begin = int(samples[k])
        end = int(samples[k + 1]) + 1 if k + 1 < len(samples) else len(ef["high"]) * 8
        raw = np.frombuffer(ef["high"], np.uint8, offset=begin // 8, count=-(-end // 8) - begin // 8)
        ones = np.flatnonzero(np.unpackbits(raw, bitorder="little")[begin % 8 :])
        at[a:b] = begin + ones[i[a:b] - k * STEP]
    out = (at - i) << l
    low = np.frombuffer(ef["low"], np.uint8)
    for b in range(l):
        bit = i * l + b
        out |= (low[bit >> 3].astype(np.int64) >> (bit & 7) & 1) << b
    return out
