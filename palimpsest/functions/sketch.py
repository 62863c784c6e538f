"""Open syncmers of many sequences at a time: what seq.syncmers says, without a lambda for every place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from palimpsest.functions.derived import flat
from palimpsest.functions.seq import BASES, COMPLEMENTS

_TURN = np.arange(256, dtype=np.uint8)
_TURN[np.frombuffer(BASES.encode(), np.uint8)] = np.frombuffer(COMPLEMENTS.encode(), np.uint8)
_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def xxhash64(rows: np.ndarray, seed: int = 42) -> np.ndarray:
    """functions.xxhash64 of rows of bytes, all of one length below 32."""
    n, at = rows.shape[-1], 0
    number = lambda a, b: sum((rows[..., i].astype(np.uint64) << np.uint64(8 * (i - a)) for i in range(a, b)), np.uint64(0))
    h = np.full(rows.shape[:-1], seed + int(_P[4]) + n, np.uint64)
    while at + 8 <= n:
        h = _rotated(h ^ _rotated(number(at, at + 8) * _P[1], 31) * _P[0], 27) * _P[0] + _P[3]
        at += 8
    if at + 4 <= n:
        h = _rotated(h ^ number(at, at + 4) * _P[0], 23) * _P[1] + _P[2]
        at += 4
    for i in range(at, n):
        h = _rotated(h ^ rows[..., i].astype(np.uint64) * _P[4], 11) * _P[0]
    h = (h ^ h >> np.uint64(33)) * _P[1]
    h = (h ^ h >> np.uint64(29)) * _P[2]
    return (h ^ h >> np.uint64(32)).view(np.int64)


def _sketches(s: np.ndarray, k: int, m: int, offset: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of letters (one length, k at least): hashes, least first, and how many of them count."""
    windows = lambda x, size: np.lib.stride_tricks.sliding_window_view(x, size, axis=1)
    back = _TURN[s[:, ::-1]]
    forth, rear = windows(s, k), windows(back, k)[:, ::-1]  # of each place, both strands
    apart = forth != rear
    place = apart.argmax(axis=2)[..., None]
    upright = (~apart.any(axis=2)) | (np.take_along_axis(forth, place, 2) < np.take_along_axis(rear, place, 2))[..., 0]
    least = [windows(xxhash64(windows(x, m)), k - m + 1).argmin(axis=2) for x in (s, back)]
    kept = np.where(upright, least[0], least[1][:, ::-1]) == offset
    row, at = np.nonzero(kept)
    hashes = np.full(kept.shape, np.iinfo(np.int64).max)
    hashes[row, at] = xxhash64(np.where(upright[row, at, None], forth[row, at], rear[row, at]))
    return np.sort(hashes, axis=1)[:, :most], np.minimum(kept.sum(axis=1), most)


def syncmer_hashes(s: Column | str, short: tuple[int, int, int, int], long: tuple[int, int, int, int], below: int) -> Column:
    """The hashes of seq.syncmers(s, k, m, offset, most), by the first setting for strings shorter than `below` and by the
    second for others. Sequences are ASCII; null has none."""

    @F.arrow_udf(ArrayType(LongType()))
    def run(seq: pa.Array) -> pa.Array:
        data, ends = flat(seq)
        sizes = np.diff(ends)
        counts, found = np.zeros(len(seq), np.int64), []
        for n in np.unique(sizes):
            k, m, offset, most = short if n < below else long
            rows = np.flatnonzero(sizes == n)
            step = max(1, (1 << 19) // max(1, int(n) * k))
            for some in (rows[i : i + step] for i in range(0, len(rows) if n >= k else 0, step)):
                hashes, counts[some] = _sketches(data[ends[some][:, None] + np.arange(n)], k, m, offset, most)
                held = np.arange(hashes.shape[1]) < counts[some][:, None]
                found.append((np.broadcast_to(some[:, None], held.shape)[held], hashes[held]))
        owner, values = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        values = values[np.argsort(owner, kind="stable")]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values))

    return run(F.col(s) if isinstance(s, str) else s)
