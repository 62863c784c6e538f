"""Array kernels over blocks of texts.

A block is the UTF-8 bytes of several texts end to end with their offsets, so one numpy call
serves hundreds of documents. Hashes are 64-bit polynomial rolling hashes over a random byte
table (a substring's hash comes from two prefix sums) followed by a finaliser; two different
strings of natural text agree with probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one block holds, unless a single text is longer.
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n pseudorandom 64-bit words that depend on salt only."""
    with np.errstate(over="ignore"):
        return mix((np.arange(n, dtype=np.uint64) + np.uint64(salt * 1_000_003 + 1)) * _BASE)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Roller:
    """Rolling hashes of substrings; keeps its power tables between blocks."""

    def __init__(self, salt: int = 0, base: int = 0xF1357AEA2E62A9C5):
        self.table = seeds(256, salt)
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.empty(0, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            self.up, self.down = powers(self.base, size), powers(self.inverse, size)

    def prefix_of(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums from which spans() takes hashes of ranges of values (64-bit words)."""
        self.grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def prefix(self, data: np.ndarray) -> np.ndarray:
        return self.prefix_of(self.table[data])

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.down[starts])

    def grams(self, prefix: np.ndarray, n: int) -> np.ndarray:
        """The hash of every range of n values."""
        m = len(prefix) - n
        if m <= 0:
            return np.empty(0, np.uint64)
        return mix((prefix[n:] - prefix[:-n]) * self.down[:m])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Block:
    """Bytes and offsets of some texts; null texts are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def edges(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of True that stay in one text; the text of each."""
        n = len(inside)
        if not n:
            none = np.empty(0, np.int64)
            return none, none, none
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (~before | first[:-1]))
        ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        return starts, ends, np.repeat(np.arange(len(self)), np.diff(np.searchsorted(starts, self.offsets)))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of bytes other than blank and 0x09 to 0x0D: starts, ends, text of each."""
        return self.edges(~_SPACE[self.data])

    def char_starts(self) -> np.ndarray:
        """True at each byte that begins a code point."""
        return (self.data & 0xC0) != 0x80


def as_block(texts: pa.Array | pa.ChunkedArray) -> Block:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays([x.cast(pa.large_string()) for x in texts.chunks])
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return Block(np.empty(0, np.uint8), np.zeros(1, np.int64))
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32, count=texts.offset + len(texts) + 1)[texts.offset :].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return Block(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, Block]]:
    """Blocks of at most about limit bytes (one text at least), with the row each begins at."""
    whole = as_block(texts)
    at, n = 0, len(whole)
    while at < n:
        to = max(at + 1, int(np.searchsorted(whole.offsets, whole.offsets[at] + limit, "right")) - 1)
        lo, hi = whole.offsets[at], whole.offsets[to]
        yield at, Block(whole.data[lo:hi], whole.offsets[at : to + 1] - lo)
        at = to


def present_twice(values: np.ndarray) -> np.ndarray:
    """True where a value occurs two times or more."""
    if len(values) < 2:
        return np.zeros(len(values), bool)
    ordered = np.sort(values)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    return member(values, again)


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """True where a value is in ordered, which is sorted."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def totals(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sums by owner as 64-bit integers."""
    if weights is None:
        return np.bincount(owner, minlength=n).astype(np.int64)
    return np.bincount(owner, weights=weights, minlength=n).round().astype(np.int64)
