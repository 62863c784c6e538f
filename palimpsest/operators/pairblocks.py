"""Trims and gates of read pairs for many reads at a time.

Reads of one batch stand in a byte matrix, padded with zeros, with where each begins and ends; a trim
moves these, a test is a comparison of matrices. The same rules as columns, one read at a time, are in
`palimpsest.operators.merge`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

A, C, G, T, N = (ord(b) for b in "ACGTN")
WINDOW = 20


def coded(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


class Block:
    """Reads (an array of str) as a matrix, with start and stop of what is left of each."""

    def __init__(self, texts: np.ndarray):
        self.texts = texts
        self.stop = np.fromiter(map(len, texts), np.int64, len(texts))
        self.width = max(int(self.stop.max(initial=0)), 1)
        self.base = np.array(texts.tolist(), f"S{self.width}").view(np.uint8).reshape(len(texts), self.width) if len(texts) else np.zeros((0, self.width), np.uint8)
        self.start = np.zeros(len(texts), np.int64)

    @property
    def size(self) -> np.ndarray:
        return self.stop - self.start

    def window(self, first: np.ndarray | int, k: int, rows: np.ndarray | None = None) -> np.ndarray:
        """k bases from `first` on (counted from each start); zeros beyond the end."""
        rows = np.arange(len(self.base)) if rows is None else rows
        first = first if isinstance(first, np.ndarray) else np.full(len(rows), first)
        at = self.start[rows, None] + first[:, None] + np.arange(k)
        return np.where((at >= 0) & (at < self.stop[rows, None]), self.base[rows[:, None], np.clip(at, 0, self.width - 1)], 0)

    def cut(self, other: list[str]) -> list[str]:
        """What is left of each of `other` (the reads or their qualities)."""
        return [x[a:b] for x, a, b in zip(other, self.start.tolist(), self.stop.tolist(), strict=True)]

    def keep(self, start: np.ndarray, stop: np.ndarray, least: int, changed: np.ndarray) -> None:
        """Where changed, reads are start to stop, or empty where that is shorter than `least`."""
        short = changed & (stop - start < least)
        self.start = np.where(changed, start, self.start)
        self.stop = np.where(changed, np.where(short, start, stop), self.stop)


def cut_front(b: Block, adapter: str, min_length: int, whole: bool = False) -> None:
    size = len(adapter) if whole else min(12, len(adapter))
    if not size or (whole and size < 12):
        return
    k, want = min(12, size), coded(adapter)
    fits = (b.size >= max(size, min_length)) & ((b.window(0, k) != want[:k]).sum(axis=1) <= 1)
    if whole:
        fits &= (b.window(0, size) != want[:size]).sum(axis=1) <= 0.1 * size
    b.keep(b.start + size, b.stop, min_length, fits)


def cut_back(b: Block, adapter: str, min_length: int) -> None:
    k, want, n = len(adapter), coded(adapter), b.size
    found = np.full(len(n), -1)
    for t in range(k + 5, 5, -1):  # bases behind the place, most first
        rows = np.flatnonzero((found < 0) & (n >= max(t, 6, min_length)))
        size = min(k, t)
        fits = (b.window(n[rows] - t, size, rows) != want[:size]).sum(axis=1) * 10 <= size
        found[rows[fits]] = n[rows[fits]] - t
    b.keep(b.start, b.start + found, min_length, found >= 0)


def find_tolerant(b: Block, adapter: str, most: int, anchor: int = 12) -> np.ndarray:
    """First place of untrimmed reads where the adapter's first bases fit, or -1."""
    want = coded(adapter[:anchor])
    if b.width < len(want) or not len(b.base):
        return np.full(len(b.base), -1)
    n = b.width - len(want) + 1
    misses = np.zeros((len(b.base), n), np.uint8)
    for j, x in enumerate(want):
        misses += b.base[:, j : j + n] != x
    fits = (misses <= most) & (np.arange(n) <= (b.stop - len(want))[:, None])
    return np.where(fits.any(axis=1), fits.argmax(axis=1), -1)


def clip_mate(b: Block, own: str, back_of_other: str, universal: str, linker: str, min_length: int, poly_g: int) -> None:
    """An untrimmed mate without read-through, then linker and adapters at its front, then a run of G."""
    for x in (own, universal):
        at = find_tolerant(b, x, 2)
        b.stop = np.where(at >= 0, np.minimum(b.stop, at), b.stop)
    cut_front(b, linker, min_length, whole=True)
    for x in (back_of_other, own, universal):
        cut_front(b, x, min_length)
    if poly_g > 0 and len(b.base):
        other = (b.base != G) & (np.arange(b.width) < b.stop[:, None]) & (np.arange(b.width) >= b.start[:, None])
        after = np.where(other.any(axis=1), b.width - other[:, ::-1].argmax(axis=1), b.start)
        run = (b.stop - after >= poly_g) & (after - b.start >= min_length)
        b.stop = np.where(run, after, b.stop)


def _composition(b: Block) -> np.ndarray:
    """Running counts of A, C, G and T of what is left: reads x places x 4."""
    s = b.window(0, max(int(b.size.max(initial=0)), 1))
    return np.concatenate([np.zeros((len(s), 1, 4), np.int32), np.cumsum(s[:, :, None] == np.array([A, C, G, T], np.uint8), axis=1, dtype=np.int32)], axis=1)


def _bits(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        p = counts / np.asarray(total)[..., None]
        return -np.where(counts > 0, p * np.log2(p), 0.0).sum(axis=-1)


def entropy(b: Block) -> np.ndarray:
    """Bits per base; NaN of empty reads."""
    return np.where(b.size > 0, _bits(_composition(b)[:, -1], np.maximum(b.size, 1)), np.nan)


def worst_window(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Least entropy and greatest dominance over windows of 20; NaN of shorter reads."""
    low, high = np.full(len(b.base), np.nan), np.full(len(b.base), np.nan)
    total = _composition(b)
    if total.shape[1] > WINDOW:
        counts = total[:, WINDOW:] - total[:, :-WINDOW]
        inside = np.arange(counts.shape[1]) <= (b.size - WINDOW)[:, None]
        some = inside.any(axis=1)
        low = np.where(some, np.where(inside, _bits(counts, WINDOW), np.inf).min(axis=1), np.nan)
        high = np.where(some, np.where(inside, counts.max(axis=2), -1).max(axis=1) / WINDOW, np.nan)
    return low, high


def worst_windows(seq: Column | str) -> Column:
    """seq.worst_window (windows of 20) as a struct, for many reads at a time: each window's composition comes
    from running counts, where the expression counts every window's letters anew."""

    @F.pandas_udf("entropy double, dominance double")
    def run(reads: pd.Series) -> pd.DataFrame:
        texts = np.array([(x or "").encode("latin-1", "replace") for x in reads] + [None], object)[:-1]
        step = max(1, (1 << 20) // max(1, max(map(len, texts), default=1)))  # about 20 MB of counts at once
        parts = [worst_window(Block(texts[i : i + step])) for i in range(0, len(texts), step)]
        low, high = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0), np.empty(0))
        return pd.DataFrame({"entropy": low, "dominance": high}).astype(object).where(~np.isnan(np.stack([low, high], axis=1)), None)

    return run(seq)


def homopolymer(b: Block) -> np.ndarray:
    """Nearly one base in a window of 20, or in a shorter whole; an empty read counts as such."""
    low, high = worst_window(b)
    whole = _composition(b)[:, -1]
    short = (b.size < WINDOW) & ((whole.max(axis=1) / np.maximum(b.size, 1) >= 0.90) | (_bits(whole, np.maximum(b.size, 1)) < 0.40))
    return short | ((b.size >= WINDOW) & ((high >= 0.90) | (low < 0.40)))


def _edits(rows: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each row (all of one length) the least number of edits to any part of text that may begin
    anywhere at the given costs."""
    places = np.arange(len(text) + 1)
    cost = np.tile(start, (len(rows), 1))
    for i in range(rows.shape[1]):
        step = np.empty_like(cost)
        step[:, 0] = cost[:, 0] + 1
        step[:, 1:] = np.minimum(cost[:, 1:] + 1, cost[:, :-1] + (rows[:, i, None] != text))
        cost = np.minimum.accumulate(step - places, axis=1) + places
    return cost.min(axis=1)


def technical(b: Block, adapters: list[str]) -> np.ndarray:
    """Pieces of an adapter (either strand) as a whole: 11 bases in common at the begin, middle or end,
    and an eighth of edits and one."""
    n, out = b.size, np.zeros(len(b.base), bool)
    long = np.flatnonzero((n >= 12) & (n <= 2 * max(map(len, adapters), default=0) + 2))
    seeds = [b.window(at, 11, long) for at in (np.zeros(len(long), np.int64), (n[long] - 11) // 2, n[long] - 11)]
    for x in adapters:
        text = coded(x)
        if len(text) < 11:
            continue
        grams = {text[i : i + 11].tobytes() for i in range(len(text) - 10)}
        held = np.zeros(len(long), bool)
        for s in seeds:
            held |= np.fromiter((r.tobytes() in grams for r in s), bool, len(s))
        near = long[held & ~out[long] & (n[long] <= len(x) + 1 + n[long] // 8)]
        for size in np.unique(n[near]):
            rows = near[n[near] == size]
            out[rows] = _edits(b.window(0, int(size), rows), text, np.zeros(len(text) + 1, np.int64)) <= 1 + size // 8
    return out


def dimer(b: Block, adapter: str) -> np.ndarray:
    """Mates that begin with the adapter: 12 bases of it within four of both begins (two misses), or its
    first six bases there and its first 20 within two edits."""
    n, want, out = b.size, coded(adapter), np.zeros(len(b.base), bool)
    for i in range(4):
        front = b.window(i, 12)
        for j in range(max(0, min(4, len(adapter) - 11))):
            out |= (n >= i + 12) & ((front != want[j : j + 12]).sum(axis=1) <= 2)
    k = min(20, len(adapter))
    seed = np.zeros(len(out), bool)
    for i in range(4):
        seed |= (b.window(i, 6) == want[:6]).all(axis=1) if len(want) >= 6 else False
    rows = np.flatnonzero(seed & (n >= 20) & ~out)
    if len(rows):
        # The adapter against parts of the read that begin in its first six places: costs as rows, places of the read as columns.
        front = b.window(0, 5 + k + 2, rows)
        places = np.arange(front.shape[1] + 1)
        cost = np.tile(np.maximum(places - 5, 0), (len(rows), 1))
        for x in want[:k]:
            step = np.empty_like(cost)
            step[:, 0] = cost[:, 0] + 1
            step[:, 1:] = np.minimum(cost[:, 1:] + 1, cost[:, :-1] + (front != x))
            cost = np.minimum.accumulate(step - places, axis=1) + places
        out[rows] = np.where(places <= n[rows, None], cost, k).min(axis=1) <= 2
    return out


def passes(b: Block, min_length: int, max_length: int, max_n_rate: float, min_entropy: float, gate: tuple[float, float]) -> np.ndarray:
    n = b.size
    inside = (np.arange(b.width) >= b.start[:, None]) & (np.arange(b.width) < b.stop[:, None])
    good = (n >= min_length) & (((b.base == N) & inside).sum(axis=1) <= max_n_rate * n)
    if max_length:
        good &= n <= max_length
    if min_entropy:
        good &= entropy(b) >= min_entropy
    if gate != (0.0, 1.0):
        low, high = worst_window(b)
        good &= (n < WINDOW) | ((low >= gate[0]) & (high <= gate[1]))
    return good
