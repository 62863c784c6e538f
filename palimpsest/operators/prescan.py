"""What a library is, learned from the head of its pairs: adapters, linker, strandedness, treatment,
and the gates and limits that follow; the result is the options of the merge.

One pass finds the inserts of the first pairs (by ordinal); all that is learned are aggregates over
what it keeps of them, and a second pass over the same pairs extends the linker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import seq as S
from palimpsest.operators import merge
from palimpsest.operators.merge import _COMPLEMENT, UNIVERSAL, Options, find_anchor, matrix, reverse_complement, strings
from palimpsest.operators.tables import head, written

# Pairs of the head, greatest share of misses of a loose overlap, the core of single-stranded splints and what is
# before it in double-stranded libraries, pairs that a construct needs, share of pairs that a linker needs, longest linker.
FIRST, LOOSE, SPLINT, STEM, LEAST, LINKER_SHARE, LINKER_SIZE = 100_000, 0.15, "GGAAGAGCGTCG", "AGATC", 100, 0.05, 45

_FOUND = "ord bigint, seq1 string, seq2 string, overlap int, agrees boolean, left string, right string, insert2 string, tail1 string, tail2 string, stem string"


@dataclass(frozen=True)
class Library:
    """What was learned, and the options that it makes."""

    kind: str
    confidence: float
    treatment: str
    inserts: int
    adapters: tuple[str, ...]
    linker: str
    options: Options


def _overlap(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each insert (-1: none found) and where it begins in b, the reverse complement of mate 2: the
    universal adapter in mate 1, or mates whose beginnings agree, or mate 1's beginning and b's end."""
    n, la, lb = len(a), a.shape[1], b.shape[1]
    size, start, longest = np.full(n, -1), np.zeros(n, np.int64), min(la, lb)
    at = find_anchor(a, UNIVERSAL, least, 2)
    here = (at >= least) & (at <= lb)
    size[here], start[here] = at[here], lb - at[here]
    differ = lambda x, y: (x != y) & (x != ord("N")) & (y != ord("N"))
    todo = np.flatnonzero(size < 0)
    misses = np.cumsum(differ(a[todo, :longest], b[todo, :longest]), axis=1)
    best, grace, on = np.full(len(todo), -1), np.zeros(len(todo), int), np.ones(len(todo), bool)
    for k in range(least, longest + 1):
        fits = misses[:, k - 1] <= LOOSE * k
        best[on & fits] = k
        grace = np.where(fits, 0, grace + (best >= 0))
        on &= grace < 4
    size[todo[best >= 0]] = best[best >= 0]
    todo = np.flatnonzero(size < 0)
    for k in range(longest, least - 1, -1):
        if not len(todo):
            break
        fits = differ(a[todo, :k], b[todo, lb - k :]).sum(axis=1) <= LOOSE / 3 * k
        size[todo[fits]], start[todo[fits]] = k, lb - k
        todo = todo[~fits]
    return size, start


def inserts(pairs: DataFrame, min_overlap: int = 11) -> DataFrame:
    """What each pair shows: the size of its insert (null: none found), whether the mates agree in its first four
    bases, their aligned calls, what follows the insert in either mate, and whether a splint core in mate 1 has
    the stem before it (ds), clearly not (ss), or tells nothing (null)."""

    # Names of another module are imported one by one: a module that a task's function names goes with it whole.
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            whole = whole.fillna({"seq1": "", "seq2": ""})
            for (la, lb), rows in whole.groupby([whole["seq1"].str.len(), whole["seq2"].str.len()]):
                a, b = matrix(rows["seq1"], la), _COMPLEMENT[matrix(rows["seq2"], lb)][:, ::-1]
                size, start = _overlap(a, b, min_overlap) if min(la, lb) >= min_overlap else (np.full(len(rows), -1), np.zeros(len(rows), int))
                core = find_anchor(a, SPLINT, 0, 1) if la >= len(SPLINT) else np.full(len(rows), -1)
                stem = np.full(len(rows), None, object)
                for at in np.unique(core[core >= len(STEM)]):
                    r = np.flatnonzero(core == at)
                    off = (a[r, at - len(STEM) : at] != np.frombuffer(STEM.encode(), np.uint8)).sum(axis=1)
                    stem[r] = np.select([off <= 1, off >= 3], ["ds", "ss"], None)
                one, two, back = rows["seq1"].tolist(), rows["seq2"].tolist(), strings(np.ascontiguousarray(b)).tolist()
                some = [None if k < 0 else (int(k), int(s)) for k, s in zip(size, start, strict=True)]
                of = lambda f: [None if x is None else f(i, *x) for i, x in enumerate(some)]  # noqa: E731, B023
                yield pd.DataFrame({
                    "ord": rows["ord"].to_numpy(), "seq1": one, "seq2": two, "overlap": pd.array([None if x is None else x[0] for x in some], "Int32"),
                    "agrees": of(lambda i, k, s: one[i][: min(4, k)] == back[i][s : s + min(4, k)]), "left": of(lambda i, k, s: one[i][: min(k, lb - s)]), "right": of(lambda i, k, s: back[i][s : s + k]),  # noqa: B023
                    "insert2": of(lambda i, k, s: two[i][:k]), "tail1": of(lambda i, k, s: one[i][k:]), "tail2": of(lambda i, k, s: two[i][k:]), "stem": stem,  # noqa: B023
                })

    return pairs.select("ord", "seq1", "seq2").mapInPandas(run, _FOUND)


def learned_adapters(found: DataFrame, tail: str) -> list[str]:
    """Constructs of 12 bases and more behind inserts, most frequent first."""
    rows = merge.constructs(found.select(F.col(tail).alias("tail"))).collect()  # six rows at most
    return [r.construct for r in sorted(rows, key=lambda r: (-r.reads, r.seed)) if len(r.construct) >= 12]


def learned_linker(found: DataFrame, known: list[str]) -> str:
    """What a twentieth or more of the mates 1 of overlapping pairs begin with, unless it is an adapter: the
    commonest 12 bases, extended by the majority of all mates that begin with them (one miss) up to the universal
    adapter, or else as long as the majority is nearer to that of the 12 bases than to that of the inside."""
    begins = found.filter(F.col("overlap").isNotNull() & (F.length("seq1") >= 12)).groupBy(F.left("seq1", F.lit(12)).alias("seed")).agg(F.count("*").alias("n"))
    top = begins.agg(F.max(F.struct("n", "seed")).alias("top"), F.sum("n").alias("all")).select("top.n", "top.seed", "all").first()
    if top.n is None or top.n < LINKER_SHARE * top["all"] or any(top.seed[:8] == x[:8] for x in known if x):
        return ""
    near = found.filter((F.length("seq1") >= 12) & (S.hamming(F.left("seq1", F.lit(12)), F.lit(top.seed)) <= 1))
    bases = near.select(F.posexplode(F.split(F.left("seq1", F.lit(LINKER_SIZE)), "")).alias("pos", "base")).filter(F.col("base").isin(*"ACGT")).groupBy("pos", "base").agg(F.count("*").alias("n"))
    held = np.zeros((LINKER_SIZE, 4))
    for r in bases.collect():  # four rows a place
        held[r.pos, "ACGT".index(r.base)] = r.n
    total = held.sum(axis=1)
    text = "".join("ACGT"[held[j].argmax()] if total[j] else "N" for j in range(LINKER_SIZE))
    major = np.where(total > 0, held.max(axis=1) / np.maximum(total, 1), 0.0)
    at = int(find_anchor(np.frombuffer(text.encode(), np.uint8)[None, :], UNIVERSAL, 12, 2)[0])
    if at >= 12:
        return text[:at]
    inside = major[30:][major[30:] > 0]
    least = (major[:12].mean() + (inside.mean() if len(inside) else 0.30)) / 2
    end = 12
    while end < LINKER_SIZE and major[end] >= least:
        end += 1
    return text[:end]


def learn(pairs: DataFrame, options: Options = Options(), first: int = FIRST, declared: str | None = None) -> Library:
    """The library of pairs (ord, seq1, seq2) from its first pairs by ordinal, and options with what was learned in
    place of what they hold. Adapters that fewer than 100 pairs show stay as they are; a linker is only
    kept for single-stranded libraries; without any insert everything stays."""
    found = written(inserts(head(pairs, "ord", first), options.min_overlap), "prescan")
    has = found.filter(F.col("overlap").isNotNull())
    row = has.agg(F.count("*").alias("n"), F.avg(F.col("agrees").cast("int")).alias("agree"), F.count_if(F.col("stem") == "ss").alias("ss"), F.count_if(F.col("stem").isNotNull()).alias("votes")).first()
    if not row.n:
        return Library(declared or "ds", 0.0, "none", 0, (), "", options)
    looks, sure = merge.geometry(row.agree, row.votes, row.ss / row.votes if row.votes else 0.5)
    kind, _ = merge.resolve_library(declared, None, looks, sure)
    one, two = learned_adapters(found, "tail1"), learned_adapters(found, "tail2")
    adapter1, adapter2 = one[0] if one else options.adapter1, two[0] if two else options.adapter2
    call = merge.udg(merge.end_mismatches(has.select("left", "right"))).first()
    linker = learned_linker(found, [adapter1, adapter2, reverse_complement(adapter2[:12]), UNIVERSAL, reverse_complement(UNIVERSAL)]) if kind == "ss" else ""
    g = merge.interior_g(found.filter((F.length("seq1") > 0) & (F.length("seq2") > 0))).first()
    gates = merge.complexity_gates(has.select(F.left("seq1", F.col("overlap")).alias("seq"))), merge.complexity_gates(has.select(F.col("insert2").alias("seq")))
    extra = (*options.extra_adapters, *one[1:], *((SPLINT,) if kind == "ss" else ()))
    out = replace(options, adapter1=adapter1, adapter2=adapter2, extra_adapters=tuple(dict.fromkeys(extra)), linker=linker, skip_terminal=call.skip_terminal, gates=gates, poly_g=merge.polyg_threshold(g.g / g.bases if g.bases else 0.0))
    return Library(kind, sure, call.call, row.n, tuple(one), linker, out)


def learn_and_merge(pairs: DataFrame, options: Options = Options(), first: int = FIRST, declared: str | None = None) -> tuple[DataFrame, Library]:
    """merge_pairs with the options that the head of the pairs teaches."""
    library = learn(pairs, options, first, declared)
    return merge.merge_pairs(pairs, library.options), library
