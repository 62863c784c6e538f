"""Overlap merging of read pairs.

Overlaps are searched for many pairs at a time: pairs of equal lengths stand in byte matrices, and
each possible overlap is one comparison of slices. A pair takes the first form that fits: an adapter
behind the insert, shorter and shorter, then mates whose beginnings agree, then mates whose ends overlap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import seq as S
from palimpsest.operators import pairblocks as P
from palimpsest.operators.pairblocks import Block
from palimpsest.operators.tables import written

# The usual adapters of paired libraries.
ADAPTER1, ADAPTER2 = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"
# What follows the insert in every read-through, whatever the library's own adapters are.
UNIVERSAL = "AGATCGGAAGAG"
HEAD = "header string, ord bigint, seq1 string, qual1 string, seq2 string, qual2 string, phase int, overlap int, seq string, qual string"


@dataclass(frozen=True)
class Options:
    min_overlap: int = 11
    max_mm_rate: float = 0.08
    min_length: int = 16
    max_length: int = 0
    adapter1: str = ADAPTER1
    adapter2: str = ADAPTER2
    extra_adapters: tuple[str, ...] = ()
    linker: str = ""
    max_n_rate: float = 1.0
    min_entropy: float = 0.0
    poly_g: int = 10
    clip_5p: int = 0
    skip_terminal: int = 0
    #: Least entropy and greatest dominance of the worst window of each unmerged mate (complexity_gates).
    gates: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 1.0), (0.0, 1.0))


def matrix(texts: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("latin-1"), np.uint8).reshape(len(texts), width)


def strings(rows: np.ndarray) -> np.ndarray:
    return rows.view(f"S{rows.shape[1]}").ravel().astype(str) if rows.shape[1] else np.full(len(rows), "")


_COMPLEMENT = np.full(256, ord("N"), np.uint8)
for _a, _b in zip("ACGT", "TGCA", strict=True):
    _COMPLEMENT[ord(_a)] = ord(_b)


def reverse_complement(s: str) -> str:
    return _COMPLEMENT[np.frombuffer(s.encode(), np.uint8)][::-1].tobytes().decode()


def find_anchor(rows: np.ndarray, adapter: str, first: int, most: int, size: int = 12) -> np.ndarray:
    """First place from `first` on where the adapter's first `size` bases fit with `most` misses, or -1."""
    want = np.frombuffer(adapter[:size].encode(), np.uint8)
    n = rows.shape[1] - len(want) - first + 1
    if not len(want) or n <= 0:
        return np.full(len(rows), -1)
    windows = np.lib.stride_tricks.sliding_window_view(rows[:, first:], len(want), axis=1)
    fits = (windows != want).sum(axis=2) <= most
    return np.where(fits.any(axis=1), fits.argmax(axis=1) + first, -1)


def overlaps(a: np.ndarray, qa: np.ndarray, b: np.ndarray, qb: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase (-1: none), overlap, and where in b it begins; b is the reverse complement of mate 2.

    0 an adapter of 12 bases in either mate, 1 an extra adapter, 2 an adapter of 8 or 6 bases, 3 one
    of five bases or fewer at the end of mate 1, 4 the mates' beginnings agree, 5 the end of mate 1
    agrees with the beginning of b. From 1 to 4 misses weigh by the lower quality of the calls."""
    n, la, lb = len(a), a.shape[1], b.shape[1]
    phase, size, start = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    longest, skip = min(la, lb), o.skip_terminal

    def differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x != y) & (x != ord("N")) & (y != ord("N"))

    def settle(form: int, rows: np.ndarray, ov: np.ndarray, at: np.ndarray) -> None:
        phase[rows], size[rows], start[rows] = form, ov[rows], at[rows]

    def insert_fits(ov: np.ndarray, rate: float) -> np.ndarray:
        """Whether a[:ov] agrees with the last ov bases of b."""
        out = np.zeros(n, bool)
        for k in np.unique(ov[(ov >= o.min_overlap) & (ov <= longest) & (phase < 0)]):
            r = np.flatnonzero((ov == k) & (phase < 0))
            x, y = slice(skip, k), slice(lb - k + skip, lb)
            w = differ(a[r, x], b[r, y]) * np.minimum(qa[r, x], qb[r, y]) / 30.0
            out[r] = w.sum(axis=1) / max(1, k - skip) <= rate
        return out

    p1 = find_anchor(a, o.adapter1, o.min_overlap, 2)
    p2 = find_anchor(b, reverse_complement(o.adapter2[:12]), 0, 2)
    ov2 = np.where(p2 >= 0, lb - p2 - 12, -1)
    one, two = p1 >= o.min_overlap, ov2 >= o.min_overlap
    ov = np.where(one & two, np.where(np.abs(p1 - ov2) <= 2, p1, np.minimum(p1, ov2)), np.where(one, p1, ov2))
    settle(0, (one | two) & (ov <= lb), ov, lb - ov)
    for extra in o.extra_adapters:
        ov = find_anchor(a, extra, o.min_overlap, 2)
        settle(1, insert_fits(ov, o.max_mm_rate), ov, lb - ov)
    for k, most, share in ((8, 1, 1.0), (6, 0, 0.6)):
        ov = find_anchor(a, o.adapter1, o.min_overlap, most, k)
        settle(2, insert_fits(ov, o.max_mm_rate * share), ov, lb - ov)
    ov = np.full(n, -1)
    for t in range(1, min(5, len(o.adapter1), max(0, la - o.min_overlap)) + 1):  # the longest tail wins
        ov[(a[:, la - t :] == np.frombuffer(o.adapter1[:t].encode(), np.uint8)).all(axis=1)] = la - t
    settle(3, insert_fits(ov, o.max_mm_rate * 0.5), ov, lb - ov)

    todo = np.flatnonzero(phase < 0)
    if len(todo):
        w = differ(a[todo, :longest], b[todo, :longest]) * np.minimum(qa[todo, :longest], qb[todo, :longest]) / 30.0
        w[:, :skip] = 0
        total, rate = np.cumsum(w, axis=1), max(o.max_mm_rate, 0.10)
        best, grace, open_ = np.full(len(todo), -1), np.zeros(len(todo), int), np.ones(len(todo), bool)
        for k in range(o.min_overlap, longest + 1):
            fits = total[:, k - 1] / (k - skip) <= rate if k > skip else np.ones(len(todo), bool)
            best[open_ & fits] = k
            grace = np.where(fits, 0, grace + (best >= 0))
            open_ &= grace < 4
        size[todo[best >= 0]], phase[todo[best >= 0]] = best[best >= 0], 4
    todo = np.flatnonzero(phase < 0)
    if len(todo):
        best, open_ = np.full(len(todo), -1), np.ones(len(todo), bool)
        for k in range(o.min_overlap, longest + 1):
            misses = differ(a[todo, la - k :], b[todo, :k]).sum(axis=1)
            fits = misses / k <= o.max_mm_rate
            open_ &= fits | ~((best >= 0) & (misses - (best * o.max_mm_rate).astype(int) >= 3))
            best[open_ & fits] = k
        size[todo[best >= 0]], phase[todo[best >= 0]] = best[best >= 0], 5
    return phase, size, start


def consensus(b1: np.ndarray, q1: np.ndarray, b2: np.ndarray, q2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n1, n2 = b1 == ord("N"), b2 == ord("N")
    same = (b1 == b2) | n2
    base = np.where(same, b1, np.where(n1 | (q2 > q1), b2, b1))
    q = np.where(same, np.minimum(q1 + q2, 60), np.where(n1, q2, np.maximum(np.abs(q1 - q2), 1)))
    return base, q


def _overlapped(whole: pd.DataFrame, o: Options) -> Iterator[pd.DataFrame]:
    """Frames of pairs of equal lengths, with phase, overlap, seq and qual."""
    whole = whole.fillna({c: "" for c in ("seq1", "qual1", "seq2", "qual2")})
    if o.clip_5p:
        long = whole["seq1"].str.len() > o.clip_5p
        for c in ("seq1", "qual1"):
            whole[c] = whole[c].where(~long, whole[c].str.slice(o.clip_5p))
    for (la, lb), rows in whole.groupby([whole["seq1"].str.len(), whole["seq2"].str.len()]):
        a, qa = matrix(rows["seq1"], la), matrix(rows["qual1"], la).astype(np.int64) - 33
        b, qb = _COMPLEMENT[matrix(rows["seq2"], lb)][:, ::-1], (matrix(rows["qual2"], lb).astype(np.int64) - 33)[:, ::-1]
        phase, size, start = overlaps(a, qa, b, qb, o) if min(la, lb) >= o.min_overlap else (np.full(len(rows), -1), np.zeros(len(rows), int), np.zeros(len(rows), int))
        merged, calls = np.full(len(rows), None, object), np.full(len(rows), None, object)
        found = phase >= 0
        for tail, k, at in set(zip((phase[found] == 5).tolist(), size[found].tolist(), start[found].tolist(), strict=True)):
            r = np.flatnonzero(found & ((phase == 5) == tail) & (size == k) & (start == at))
            x = slice(la - k, la) if tail else slice(0, k)
            base, q = consensus(a[r, x], qa[r, x], b[r, at : at + k], qb[r, at : at + k])
            if tail:
                base, q = np.concatenate([a[r, : la - k], base, b[r, k:]], axis=1), np.concatenate([qa[r, : la - k], q, qb[r, k:]], axis=1)
            merged[r], calls[r] = strings(np.ascontiguousarray(base)), strings((q + 33).astype(np.uint8))
        yield rows.assign(phase=phase.astype(np.int32), overlap=size.astype(np.int32), seq=merged, qual=calls)


def overlapped(pairs: DataFrame, options: Options = Options()) -> DataFrame:
    """pairs with phase, overlap, and the merged seq and qual before any trimming (null without an
    overlap). Pairs of equal lengths stand in byte matrices; each form of overlap is found, and each
    consensus made, for all of them at once. Null mates count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            yield from _overlapped(whole, options)

    return pairs.select("header", "ord", "seq1", "qual1", "seq2", "qual2").mapInPandas(run, HEAD)


def let(value: Column, then) -> Column:
    """then(value), with value worked out once however often then names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def cut_front(pair: Column, adapter: str, options: Options, whole: bool = False) -> Column:
    """pair (s, q) without an adapter of 12 bases at its front (one miss), or with whole=True without a
    construct that fits to its end (a tenth of misses). What would be too short is emptied."""
    size = len(adapter) if whole else min(12, len(adapter))
    return pair if not size or (whole and size < 12) else let(pair, lambda p: _cut_front(p, adapter, size, options, whole))


def _cut_front(pair: Column, adapter: str, size: int, options: Options, whole: bool) -> Column:
    s = pair["s"]
    fits = (F.length(s) >= max(size, options.min_length)) & (S.hamming(S.part(s, 1, min(12, size)), F.lit(adapter[: min(12, size)])) <= 1)
    if whole:
        fits &= S.hamming(S.part(s, 1, size), F.lit(adapter)) <= 0.1 * size
    rest = F.struct(F.substr(s, F.lit(size + 1)).alias("s"), F.substr(pair["q"], F.lit(size + 1)).alias("q"))
    none = F.struct(F.lit("").alias("s"), F.lit("").alias("q"))
    return F.when(fits, F.when(F.length(s) - size < options.min_length, none).otherwise(rest)).otherwise(pair)


def cut_back(pair: Column, adapter: str, options: Options) -> Column:
    """pair without an adapter at its end: six bases or more of it, a tenth of misses."""
    return let(pair, lambda p: _cut_back(p, adapter, options))


def _cut_back(pair: Column, adapter: str, options: Options) -> Column:
    s, n, k = pair["s"], F.length(pair["s"]), len(adapter)
    size = lambda i: F.least(F.lit(k), n - i)
    # A bounded edit distance, which is compiled and never above the mismatches, settles nearly all places first.
    near = lambda a, b, most: (F.levenshtein(a, b, most) >= 0) & (S.hamming(a, b) * 10 <= F.length(b))
    fits = lambda i: near(s.substr(i + 1, size(i)), F.left(F.lit(adapter), size(i)), k // 10)
    starts = F.when(n >= max(6, options.min_length), F.filter(F.sequence(F.greatest(F.lit(0), n - k - 5), n - 6), fits)).otherwise(F.array().cast("array<int>"))
    cut = lambda at: F.when(at.isNull(), pair).when(at < options.min_length, F.struct(F.lit("").alias("s"), F.lit("").alias("q"))).otherwise(F.struct(F.left(s, at).alias("s"), F.left(pair["q"], at).alias("q")))
    return let(F.get(starts, F.lit(0)), cut)


def clipped(pair: Column, own: str, other: str, options: Options) -> Column:
    """An unmerged mate without read-through (its own adapter or the universal one, wherever), then
    without linker and adapters at its front, then without a run of G at its end."""

    def without_read_through(p: Column) -> Column:
        found = [F.nullif(S.find_tolerant(p["s"], x, 2), F.lit(-1)) for x in (own, UNIVERSAL)]
        return let(F.coalesce(F.least(*found), F.length(p["s"])), lambda at: F.struct(F.left(p["s"], at).alias("s"), F.left(p["q"], at).alias("q")))

    def without_run(p: Column) -> Column:
        short = F.length(S.trim_run(p["s"], "G", options.poly_g))
        return let(F.when(short >= options.min_length, short).otherwise(F.length(p["s"])), lambda n: F.struct(F.left(p["s"], n).alias("s"), F.left(p["q"], n).alias("q")))

    pair = cut_front(let(pair, without_read_through), options.linker, options, whole=True)
    for x in (reverse_complement(other[:12]), own, UNIVERSAL):
        pair = cut_front(pair, x, options)
    return let(pair, without_run) if options.poly_g > 0 else pair


def homopolymer(s: Column | str) -> Column:
    """True for reads with a window of 20 (or, shorter, a whole) of nearly one base."""
    s = S.col(s)
    w = P.worst_windows(s)
    whole = (S.dominance(s) >= 0.90) | (S.entropy(s) < 0.40)
    return F.coalesce(F.when(F.length(s) < 20, whole).otherwise((w["dominance"] >= 0.90) | (w["entropy"] < 0.40)), F.lit(False))


def edits_within(pattern: Column, text: str, most: Column) -> Column:
    """True if some part of text is within `most` edits of pattern."""
    n = F.length(pattern)
    starts = F.sequence(F.lit(1), F.lit(len(text)))
    sizes = F.sequence(F.greatest(F.lit(1), n - most), n + most)
    return F.exists(starts, lambda i: F.exists(sizes, lambda k: F.levenshtein(pattern, F.lit(text).substr(i, k)) <= most))


def technical(s: Column | str, adapters: tuple[str, ...]) -> Column:
    """True for reads that are a piece of an adapter as a whole: they share 11 bases with it at their
    begin, middle or end, and fit into it with an eighth of edits and one."""
    s, out = S.col(s), F.lit(False)
    n = F.length(s)
    for text in adapters:
        for x in (text, reverse_complement(text)):
            seed = F.lit(False)
            for at in (F.lit(1), F.floor((n - 11) / 2).cast("int") + 1, n - 10):
                seed |= F.instr(F.lit(x), s.substr(at, F.lit(11))) > 0
            near = F.when((n >= 12) & (n <= len(x) + 1 + F.floor(n / 8)) & seed, edits_within(s, x, (1 + F.floor(n / 8)).cast("int")))
            out |= F.coalesce(near, F.lit(False))
    return out


def dimer(s: Column | str, adapter: str) -> Column:
    """True for mates that begin with the adapter: 12 bases of it within four bases of both begins (two
    misses), or its first six bases there and its first 20 within two edits."""
    s = S.col(s)
    rigid = F.lit(False)
    for i in range(4):
        for j in range(max(0, min(4, len(adapter) - 11))):
            rigid |= (F.length(s) >= i + 12) & (S.hamming(S.part(s, i + 1, 12), F.lit(adapter[j : j + 12])) <= 2)
    k = min(20, len(adapter))
    seed = F.instr(F.left(s, F.lit(9)), F.lit(adapter[:6])).between(1, 4)
    ends = F.exists(F.sequence(F.lit(1), F.lit(6)), lambda i: F.exists(F.sequence(F.lit(k - 2), F.lit(k + 2)), lambda n: F.levenshtein(s.substr(i, n), F.lit(adapter[:k])) <= 2))
    return rigid | ((F.length(s) >= 20) & seed & F.coalesce(F.when(seed, ends), F.lit(False)))


def passes(s: Column, options: Options, gate: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Length, share of N, entropy, and the gate on the worst window."""
    n = F.length(s)
    good = (n >= options.min_length) & (S.base_count(s, "N") <= options.max_n_rate * n)
    if options.max_length:
        good &= n <= options.max_length
    if options.min_entropy:
        good &= S.entropy(s) >= options.min_entropy
    if gate != (0.0, 1.0):
        w = S.worst_window(s)
        good &= F.coalesce((w["entropy"] >= gate[0]) & (w["dominance"] <= gate[1]), F.lit(True))
    return F.coalesce(good, F.lit(False))


ROUTED = "header string, ord bigint, route string, phase int, overlap int, seq string, qual string, seq1 string, qual1 string, seq2 string, qual2 string"


def _routed(rows: pd.DataFrame, o: Options) -> pd.DataFrame:
    """Pairs with overlaps, trimmed, tested and given their routes, all of them at once."""
    rows, blocks, ok, junk = rows.reset_index(drop=True), [], [], np.ones(len(rows), bool)
    for i, own, other in ((1, o.adapter1, o.adapter2), (2, o.adapter2, o.adapter1)):
        mate = Block(rows[f"seq{i}"].to_numpy())
        junk &= P.homopolymer(mate)
        P.clip_mate(mate, own, reverse_complement(other[:12]), UNIVERSAL, o.linker, o.min_length, o.poly_g)
        blocks.append(mate)
        ok.append(P.passes(mate, o.min_length, o.max_length, o.max_n_rate, o.min_entropy, o.gates[i - 1]) & ~P.dimer(mate, own))
    phase = rows["phase"].to_numpy()
    some = np.flatnonzero(phase >= 0)
    bad, good = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    seq, qual = np.full(len(rows), None, object), np.full(len(rows), None, object)
    if len(some):
        whole = Block(rows["seq"].to_numpy()[some])
        if o.linker:
            held = whole.start.copy(), whole.stop.copy()
            P.cut_front(whole, o.linker, o.min_length, whole=True)
            tail = phase[some] == 5
            whole.start, whole.stop = np.where(tail, held[0], whole.start), np.where(tail, held[1], whole.stop)
        P.cut_front(whole, reverse_complement(o.adapter2[:12]), o.min_length)
        P.cut_back(whole, o.adapter1, o.min_length)
        bad[some] = P.technical(whole, [y for x in (o.adapter1, o.adapter2) for y in (x, reverse_complement(x))]) | P.homopolymer(whole)
        good[some] = P.passes(whole, o.min_length, o.max_length, o.max_n_rate, o.min_entropy, (0.0, 1.0))
        seq[some], qual[some] = whole.cut(whole.texts.tolist()), whole.cut(rows["qual"].to_numpy()[some].tolist())
    route = np.select([junk | bad, good, ok[0] & ok[1], ok[0] | ok[1]], ["dropped", "merged", "unmerged", "orphan"], "dropped")
    is_merged, left = route == "merged", (route == "unmerged") | (route == "orphan")
    out = {"header": rows["header"], "ord": rows["ord"], "route": route, "phase": np.where(is_merged, phase, -1).astype(np.int32), "overlap": rows["overlap"], "seq": np.where(is_merged, seq, None), "qual": np.where(is_merged, qual, None)}
    for i, mate in enumerate(blocks):
        for name in ("seq", "qual"):
            cut = np.empty(len(rows), object)
            cut[:] = mate.cut(rows[f"{name}{i + 1}"].tolist())
            out[f"{name}{i + 1}"] = np.where(left & ok[i], cut, None)
    return pd.DataFrame(out)


def merge_pairs(pairs: DataFrame, options: Options = Options()) -> DataFrame:
    """Pairs (ord, header, seq1, qual1, seq2, qual2) with route: merged (seq, qual), unmerged (both
    mates after clipping), orphan (one mate passes), dropped. A merged read is trimmed; if it is a
    piece of an adapter or one base it is dropped, if it fails the other gates its mates count as
    unmerged. Pairs of two homopolymers are dropped. Null mates count as empty. Overlaps, trims and
    tests are one pass over matrices of reads; no pair is looked at alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            found = list(_overlapped(whole, options))
            if found:
                yield _routed(pd.concat(found), options)

    return pairs.select("header", "ord", "seq1", "qual1", "seq2", "qual2").mapInPandas(run, ROUTED).withColumn("header", S.clean_name("header"))


def merge_report(merged: DataFrame) -> DataFrame:
    """One row of JSON: pairs, and by route and phase how many, their mean length and total bases."""
    per = merged.groupBy("route", "phase").agg(F.count("*").alias("pairs"), F.sum(F.coalesce(F.length("seq"), F.lit(0))).alias("bases"))
    total = F.aggregate(F.collect_list("pairs"), F.lit(0).cast("long"), lambda a, x: a + x)
    return per.agg(F.to_json(F.struct(total.alias("pairs"), F.sort_array(F.collect_list(F.struct("route", "phase", "pairs", "bases"))).alias("routes"))).alias("report"))  # a few dozen rows


def complexity_gates(inserts: DataFrame, least: int = 500) -> tuple[float, float]:
    """The 1st percentile of entropy and the 99th of dominance of the worst windows of merged inserts
    (column seq), by sorted index; (0, 1) where there are fewer than `least`."""
    windows = inserts.filter(F.length("seq") >= 20).select(P.worst_windows("seq").alias("w"))
    rows = windows.select(F.round("w.entropy", 6).alias("e"), F.round("w.dominance", 6).alias("d"))
    held = written(rows.groupBy("e", "d").agg(F.count("*").alias("k")), "gates")  # few values: compositions of 20 bases
    n = held.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]

    def at(c: str, share: float) -> float | None:
        upto = held.groupBy(c).agg(F.sum("k").alias("k")).withColumn("to", F.sum("k").over(Window.orderBy(c)))
        return None if n < least else float(upto.filter(F.col("to") > round(share * (n - 1))).agg(F.min(c)).first()[0])

    low, high = at("e", 0.01), at("d", 0.99)
    return (0.0, 1.0) if low is None else (low, high)


def udg(mismatches: DataFrame) -> DataFrame:
    """(five, three, call, skip_terminal) from (slot, misses, bases) by place: 0 to 3 the 5' end, 8 to 19 the
    inside, 20 to 23 the 3' end. An end is damaged if its rate exceeds the inside's by 1.96 pooled
    standard errors; half: only the 5' end, full: neither, none: both, or the 3' end alone."""
    pool = lambda lo, hi: (F.sum(F.when(F.col("slot").between(lo, hi - 1), F.col("misses")).otherwise(0)), F.sum(F.when(F.col("slot").between(lo, hi - 1), F.col("bases")).otherwise(0)))
    sums = mismatches.agg(*(x.alias(f"{c}{k}") for k, (lo, hi) in (("5", (0, 4)), ("3", (20, 24)), ("i", (8, 20))) for c, x in zip("mn", pool(lo, hi), strict=True)))
    rate = lambda k: F.when(F.col(f"n{k}") > 0, F.col(f"m{k}") / F.col(f"n{k}")).otherwise(0.0)
    var = lambda k: F.when(F.col(f"n{k}") > 0, rate(k) * (1 - rate(k)) / F.col(f"n{k}")).otherwise(1.0)
    above = lambda k: (rate(k) - rate("i")) - 1.96 * F.sqrt(var(k) + var("i")) > 0
    call = F.when(above("5") & ~above("3"), "half").when(~above("5") & ~above("3"), "full").otherwise("none")
    return sums.select(above("5").alias("five"), above("3").alias("three"), call.alias("call"), F.when(call == "full", 0).otherwise(4).alias("skip_terminal"))


def end_mismatches(calls: DataFrame) -> DataFrame:
    """(slot, misses, bases) over overlaps (left, right): slots 0 to 19 from the 5' end, 20 to 23 the last four."""
    n = F.length("left")
    at = calls.filter(n >= 24).select("left", "right", n.alias("n"), F.explode(F.concat(F.sequence(F.lit(0), F.lit(19)), F.sequence(F.lit(20), F.lit(23)))).alias("slot"))
    place = F.when(F.col("slot") < 20, F.col("slot") + 1).otherwise(F.col("n") - 23 + F.col("slot"))
    x, y = S.part(F.col("left"), place, 1), S.part(F.col("right"), place, 1)
    return at.groupBy("slot").agg(F.count_if((x != y) & (x != "N") & (y != "N")).alias("misses"), F.count_if((x != "N") & (y != "N")).alias("bases"))


def resolve_library(declared: str | None, panel: str | None, geometry: str, sure: float, strict: bool = False) -> tuple[str, str | None]:
    """The library type by what is declared, else by the panel, else by geometry; a warning (an error
    if strict) where geometry contradicts with a confidence of 0.8 or more."""
    kind = declared or panel or geometry
    if kind == geometry or sure < 0.80:
        return kind, None
    said = f"library is taken as {kind}, but the reads look {geometry} (confidence {sure:.2f})"
    if strict:
        raise ValueError(said)
    return kind, said


def interior_g(pairs: DataFrame) -> DataFrame:
    """One row: bases and G in the inner third of both mates."""
    inner = lambda c: S.part(F.col(c), F.floor(F.length(c) / 3).cast("int") + 1, (F.floor(2 * F.length(c) / 3) - F.floor(F.length(c) / 3)).cast("int"))
    each = pairs.select(F.concat(inner("seq1"), inner("seq2")).alias("x"))
    return each.agg(F.sum(F.length("x")).alias("bases"), F.sum(S.base_count("x", "G")).alias("g"))


#: Upper ends of the length bins of substitution tables.
LENGTH_ENDS = (30, 40, 50, 60, 80)


def substitution_tensor(overlapped: DataFrame, most: int = 30, by_length: bool = False) -> DataFrame:
    """(strand, pos, b1, b2, n) over overlaps (left, right: the aligned calls of the two mates),
    from each end, and over all places (pos null); with by_length also by len_bin, the bin of the
    overlap's length. Calls of N are left out."""
    if by_length:
        bins = F.lit(0)
        for end in LENGTH_ENDS:
            bins = bins + F.when(F.length("left") > end, 1).otherwise(0)
        parts = overlapped.withColumn("len_bin", bins)
        return _tensor(parts, most, ["len_bin"])
    return _tensor(overlapped, most, [])


def _tensor(overlapped: DataFrame, most: int, more: list[str]) -> DataFrame:
    # Counted once by place and length of the overlap, a table whose size does not depend on the pairs; what is told
    # from both ends and over all places comes from it.
    at = overlapped.select("left", "right", *more, F.length("left").alias("_n"), F.posexplode(F.sequence(F.lit(1), F.length("left"))).alias("i", "p")).select(*more, "_n", "i", F.col("left").substr(F.col("p"), F.lit(1)).alias("b1"), F.col("right").substr(F.col("p"), F.lit(1)).alias("b2"))
    cells = at.filter((F.col("b1") != "N") & (F.col("b2") != "N")).groupBy(*more, "_n", "i", "b1", "b2").agg(F.count("*").alias("k"))
    j = F.col("_n") - 1 - F.col("i")
    side = lambda strand, pos: F.struct(F.lit(strand).alias("strand"), pos.cast("int").alias("pos"))
    rows = cells.select(F.inline(F.array(side("fwd", F.col("i")), side("rev", j), side("all", F.lit(None)))), *more, "b1", "b2", "k").filter(F.col("pos").isNull() | (F.col("pos") < most))
    return rows.groupBy("strand", "pos", *more, "b1", "b2").agg(F.sum("k").alias("n"))


def polyg_threshold(share_g: float) -> int:
    """The least run of G that chance makes at the 3' end less than once in 1,000 reads."""
    if not 0 < share_g < 1:
        return 4
    return max(4, math.ceil(math.log(1e-3) / math.log(share_g)))


def geometry(agreement: float, votes: int = 0, single_share: float = 0.5) -> tuple[str, float]:
    """ss or ds with a confidence, from the agreement of 5' 4-mers, which splint votes override."""
    kind, sure = ("ss", 1 - agreement / 0.3) if agreement < 0.3 else ("ds", (agreement - 0.3) / 0.7)
    if votes >= 100 and (single_share >= 0.6 or single_share <= 0.4):
        return ("ss", max(sure, single_share)) if single_share >= 0.6 else ("ds", max(sure, 1 - single_share))
    return kind, sure


def constructs(tails: DataFrame, least: int = 100, most: int = 6, size: int = 48) -> DataFrame:
    """(seed, reads, construct): sequences that follow inserts (column tail): groups by first 10-mer with at least
    `least` reads, the `most` largest, and the majority base of each place as long as half of the group's
    reads reach it and 60 % of those agree."""
    each = tails.filter(F.col("tail").rlike("^[ACGT]{10}")).select(S.part(F.col("tail"), 1, 10).alias("seed"), F.left("tail", F.lit(size)).alias("tail"))
    top = each.groupBy("seed").agg(F.count("*").alias("reads")).filter(F.col("reads") >= least).orderBy(F.desc("reads"), "seed").limit(most)
    calls = each.join(F.broadcast(top), "seed").select("seed", "reads", F.posexplode(F.split("tail", "")).alias("pos", "base"))  # `most` rows
    counted = calls.filter(F.col("base").isin(*"ACGT")).groupBy("seed", "reads", "pos", "base").agg(F.count("*").alias("n"))
    best = counted.groupBy("seed", "reads", "pos").agg(F.max_by("base", F.struct("n", "base")).alias("base"), F.max("n").alias("n"), F.sum("n").alias("cover"))
    line = best.groupBy("seed", "reads").agg(F.sort_array(F.collect_list(F.struct("pos", "base", (F.col("n") / F.col("cover")).alias("share"), "cover"))).alias("line"))
    stop = F.expr("coalesce(array_position(transform(line, (x, i) -> x.pos <> i or x.share < 0.6 or 2 * x.cover < reads), true), 0)")
    text = F.expr("array_join(transform(line, x -> x.base), '')")
    return line.select("seed", "reads", F.when(stop > 0, F.left(text, (stop - 1).cast("int"))).otherwise(text).alias("construct"))
