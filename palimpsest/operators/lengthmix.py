"""Length bins that the lengths themselves suggest, the fit of each bin, and a mixture of damaged and
undamaged reads over cells of length and GC content.

Spark makes tables whose size does not depend on the reads: a row for each length, each bin and place,
or each cell and pattern of end bases. The mixtures are fitted to those tables by EM, each pass in
closed form.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import seq as S
from palimpsest.operators.damage import LEAST_CELL, POSITIONS, Profile, fit_decay, llr
from palimpsest.operators.profile import floor, length_bin

# Lengths that count, parts at most, reads that a bin's fit needs.
SHORTEST, LONGEST, MOST_PARTS, LEAST_READS = 30, 500, 5, 10_000


def length_counts(reads: DataFrame) -> DataFrame:
    """(size, n): reads of 30 bases and more by length; longer ones than 500 count as 500."""
    return floor(reads, SHORTEST).groupBy(F.least(F.length("seq"), F.lit(LONGEST)).alias("size")).agg(F.count("*").alias("n"))


def normal_parts(x: np.ndarray, weights: np.ndarray, k: int, passes: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Shares, means, deviations and log likelihood of k normal parts of weighted values, by EM from
    quantiles. No deviation falls below half the mean step between values."""
    total = weights.sum()
    least = 0.5 * (x[-1] - x[0]) / max(len(x) - 1, 1) if len(x) > 1 else 1e-3
    at = np.searchsorted(np.cumsum(weights) / total, (np.arange(k) + 0.5) / k)
    mean, dev, share = x[np.minimum(at, len(x) - 1)].astype(float), np.full(k, max(np.sqrt(np.average((x - np.average(x, weights=weights)) ** 2, weights=weights)) / k, least)), np.full(k, 1 / k)
    mean = mean + 1e-6 * np.arange(k)
    last = -math.inf
    for _ in range(passes):
        log = np.log(share) - np.log(dev) - 0.5 * ((x[:, None] - mean) / dev) ** 2 - 0.5 * math.log(2 * math.pi)
        top = log.max(axis=1, keepdims=True)
        whole = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        likelihood = float(weights @ whole)
        part = np.exp(log - whole[:, None]) * weights[:, None]
        size = np.maximum(part.sum(axis=0), 1e-12)
        share, mean = size / total, (part * x[:, None]).sum(axis=0) / size
        dev = np.maximum(np.sqrt((part * (x[:, None] - mean) ** 2).sum(axis=0) / size), least)
        if likelihood - last < 1e-9 * abs(likelihood):
            break
        last = likelihood
    order = np.argsort(mean)
    return share[order], mean[order], dev[order], likelihood


def auto_edges(counts: DataFrame, most: int = MOST_PARTS) -> list[int]:
    """Upper ends (as `profile.length_bin` takes them) of the bins that the lengths suggest: normal parts of
    log lengths, as many as the Bayesian criterion prefers among those whose neighbours' means lie one
    joint deviation apart or more and that hold a hundredth of the reads each. A bin ends at the last length
    where its part is likelier than the next. No edges: one part."""
    rows = sorted((r["size"], r.n) for r in counts.collect())  # a row for each length
    if len(rows) < 2:
        return []
    sizes, weights = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    x, best, edges = np.log(sizes), math.inf, []
    for k in range(1, most + 1):
        share, mean, dev, likelihood = normal_parts(x, weights, k)
        apart = (np.diff(mean) >= np.sqrt((dev[1:] ** 2 + dev[:-1] ** 2) / 2)).all()
        criterion = (3 * k - 1) * math.log(weights.sum()) - 2 * likelihood
        if criterion >= best or not apart or share.min() < 0.01:
            continue
        best, edges = criterion, []
        for i in range(k - 1):
            between = np.arange(math.ceil(math.exp(mean[i])), math.floor(math.exp(mean[i + 1])) + 1)
            log = lambda j, xs=np.log(between), share=share, mean=mean, dev=dev: np.log(share[j]) - np.log(dev[j]) - 0.5 * ((xs - mean[j]) / dev[j]) ** 2
            nearer = between[log(i) >= log(i + 1)]
            edges.append(int(nearer[-1]) if len(nearer) else int(math.exp(mean[i])))
    return sorted(set(edges))


def bin_ends(reads: DataFrame, edges: list[int], single: bool = False) -> DataFrame:
    """(bin, pos, t5, c5, t3, c3, n): hits and references at each place from either end, by length bin."""
    n = F.length("seq")
    at = floor(reads, SHORTEST).select("seq", length_bin(edges).alias("bin"), F.explode(F.sequence(F.lit(0), F.least(F.lit(POSITIONS), n) - 1)).alias("pos"))
    five, three = S.part(F.col("seq"), F.col("pos") + 1, 1), S.part(F.col("seq"), n - F.col("pos"), 1)
    hit, ref = ("T", "C") if single else ("A", "G")
    return at.groupBy("bin", "pos").agg(F.count_if(five == "T").alias("t5"), F.count_if(five == "C").alias("c5"), F.count_if(three == hit).alias("t3"), F.count_if(three == ref).alias("c3"), F.count("*").alias("n"))


def fit_bins(ends: DataFrame, edges: list[int], least: int = LEAST_READS) -> list[dict]:
    """bin, low, high, n, status and d5, l5, d3, l3 of each length bin: the decay of damage from either end.
    The background is the mean share over the last five places. Bins of fewer reads than `least` have
    status insufficient_reads and no fit. ends has at most 15 rows a bin."""
    held: dict[int, dict[int, tuple]] = {}
    for r in ends.collect():
        held.setdefault(r.bin, {})[r.pos] = (r.t5, r.c5, r.t3, r.c3, r.n)
    out = []
    for b in range(len(edges) + 1):
        low, high = edges[b - 1] + 1 if b else SHORTEST, edges[b] if b < len(edges) else None
        rows = held.get(b, {})
        n = rows[0][4] if 0 in rows else 0
        row = {"bin": b, "low": low, "high": high, "n": n, "status": "insufficient_reads", "d5": None, "l5": None, "d3": None, "l3": None}
        if n >= least:
            table = np.array([rows.get(p, (0,) * 5) for p in range(POSITIONS)], float)
            row["status"] = "fit"
            for end, i in ((5, 0), (3, 2)):
                trials = table[:, i] + table[:, i + 1]
                share = np.where(trials > 0, table[:, i] / np.maximum(trials, 1), 0.0)
                base = float(np.average(share[-5:], weights=trials[-5:])) if trials[-5:].sum() >= LEAST_CELL else float(np.average(share, weights=np.maximum(trials, 1e-9)))
                row[f"d{end}"], row[f"l{end}"] = fit_decay(share, trials, base)
        out.append(row)
    return out


#: The columns of strata, the finest first to be summed over.
STRATA = ("bin", "end", "pos", "damaged", "cpg")


def strata(reads: DataFrame, profile: Profile, edges: list[int], threshold: float = 0.0) -> DataFrame:
    """(bin, end, pos, damaged, cpg, level, a, c, g, t, n): bases at each place from either end by length bin, by
    whether the profile calls the read damaged, and by whether the base stands in a CpG (at the 5' end a G
    follows; at the 3' end a C precedes, or in single-stranded libraries a G follows), in one aggregate. level 0
    has all of these, 1 is summed over cpg, 3 over damaged too, 19 over length bins as well (the bits of what is
    summed over, which is null)."""
    n, s = F.length("seq"), F.col("seq")
    rows = floor(reads, SHORTEST).select("seq", length_bin(edges).alias("bin"), (llr("seq", profile) >= threshold).alias("damaged"), F.explode(F.sequence(F.lit(0), F.least(F.lit(POSITIONS), n) - 1)).alias("pos"))
    at = lambda place: S.part(s, place, 1)
    five, last = F.col("pos") + 1, n - F.col("pos")
    beside = at(last + 1) == "G" if profile.single else (last > 1) & (at(F.greatest(last - 1, F.lit(1))) == "C")
    ends = F.array(F.struct(F.lit(5).alias("end"), at(five).alias("x"), (at(five + 1) == "G").alias("cpg")), F.struct(F.lit(3).alias("end"), at(last).alias("x"), beside.alias("cpg")))
    each = rows.select("bin", "pos", "damaged", F.inline(ends))
    sets = [[*STRATA], [*STRATA[:4]], [*STRATA[:3]], ["end", "pos"]]
    counts = [F.count_if(F.col("x") == b).alias(b.lower()) for b in "ACGT"]
    return each.groupingSets([[F.col(c) for c in x] for x in sets], *(F.col(c) for c in STRATA)).agg(F.grouping_id().cast("int").alias("level"), *counts, F.count("*").alias("n")).select(*STRATA, "level", "a", "c", "g", "t", "n")


# ---- Length x GC

#: Places whose bases tell damaged reads: the two outermost of either end.
SITES, GC_BINS, INNER = ((5, 0), (5, 1), (3, 0), (3, 1)), 10, 10


def length_gc_cells(reads: DataFrame, edges: list[int], single: bool = False, gc_bins: int = GC_BINS) -> DataFrame:
    """(bin, gc, code, n, t, c, a, g): reads by length bin, GC content and the bases at SITES (1 hit, 0
    reference, . other), with the sums of T, C, A and G inside them. GC content and sums leave out ten
    bases at either end, so that damage does not move a read to another cell."""
    n, s = F.length("seq"), F.col("seq")
    inner = S.part(s, INNER + 1, n - 2 * INNER)
    count = {b: S.base_count(inner, b) for b in "TCAG"}
    gc = F.least(F.lit(gc_bins - 1), F.floor((count["G"] + count["C"]) * gc_bins / (n - 2 * INNER)).cast("int"))
    three = ("TCAGN", "10...") if single else ("AGTCN", "10...")
    sites = [F.translate(S.part(s, F.lit(p + 1) if end == 5 else n - p, 1), *(("TCAGN", "10...") if end == 5 else three)) for end, p in SITES]
    rows = floor(reads, SHORTEST).select(length_bin(edges).alias("bin"), gc.alias("gc"), F.concat(*sites).alias("code"), *(count[b].alias(b.lower()) for b in "TCAG"))
    return rows.groupBy("bin", "gc", "code").agg(F.count("*").alias("n"), *(F.sum(x).alias(x) for x in "tcag"))


@dataclass(frozen=True)
class Mixture:
    """d: the changed share of reference bases of damaged reads at each of SITES. pi: the share of damaged
    reads; population: d of the first 5' place over all reads. cells: (bin, gc, reads, share of damaged
    reads). likelihoods: one for each pass, never falling."""

    d: tuple[float, ...]
    pi: float
    population: float
    converged: bool
    separated: bool
    cells: list[tuple[int, int, int, float]] = field(default_factory=list)
    likelihoods: list[float] = field(default_factory=list)


def fit_mixture(cells: DataFrame, single: bool = False, passes: int = 2_000, least: int = LEAST_CELL) -> Mixture | None:
    """Two kinds of reads in each cell of length and GC. In an undamaged read each of SITES is a hit (of hits
    and references) with the chance b that the inside of the cell's reads has; in a damaged one a reference
    is changed with the chance d of the site, the same in all cells, so that a hit has b + (1 - b) d.
    Sites are independent within a kind, and their going together tells the kinds apart. The sum of
    n log(w P(code | damaged) + (1 - w) P(code | undamaged)) is raised by EM, each pass in closed form:
    the cells' shares w by the posteriors, d by the expected changes among expected references. Cells
    with fewer than `least` bases of a kind inside are left out; None if none is left. The table has
    at most 81 rows a cell. separated: the kinds differ (d of 0.05 and more at some site, pi between
    0.01 and 0.99, and more likely than one kind by 10 log units)."""
    rows = [r.asDict() for r in cells.collect()]
    sums: dict[tuple[int, int], np.ndarray] = {}
    for r in rows:
        key = (r["bin"], r["gc"])
        sums[key] = sums.get(key, np.zeros(4)) + [r["t"], r["c"], r["a"], r["g"]]
    hits3 = (0, 1) if single else (2, 3)
    good = sorted(k for k, v in sums.items() if v[0] + v[1] >= least and v[hits3[0]] + v[hits3[1]] >= least)
    if not good:
        return None
    place = {k: i for i, k in enumerate(good)}
    kept = [r for r in rows if (r["bin"], r["gc"]) in place]
    cell, n = np.array([place[r["bin"], r["gc"]] for r in kept]), np.array([r["n"] for r in kept], float)
    codes = np.array([[{"1": 1, "0": 0}.get(x, -1) for x in r["code"]] for r in kept])
    table = np.array([sums[k] for k in good])
    ratio = lambda i, j: np.clip((table[:, i] + 0.5) / (table[:, i] + table[:, j] + 1), 1e-4, 1 - 1e-4)
    base = np.stack([ratio(0, 1) if end == 5 else ratio(*hits3) for end, _ in SITES], axis=1)[cell]
    hit, ref = codes == 1, codes == 0
    size = np.bincount(cell, weights=n)
    log0 = np.where(hit, np.log(base), np.where(ref, np.log1p(-base), 0.0)).sum(axis=1)
    d, w, told, converged = np.full(len(SITES), 0.3), np.full(len(good), 0.3), [], False
    for _ in range(passes):
        damaged = base + (1 - base) * d
        log1 = np.where(hit, np.log(damaged), np.where(ref, np.log1p(-damaged), 0.0)).sum(axis=1)
        one, zero = np.log(w[cell]) + log1, np.log1p(-w[cell]) + log0
        whole = np.logaddexp(one, zero)
        told.append(float(n @ whole))
        if len(told) > 1 and told[-1] - told[-2] < 1e-10 * abs(told[-1]):
            converged = True
            break
        post = n * np.exp(one - whole)
        w = np.clip(np.bincount(cell, weights=post) / size, 1e-9, 1 - 1e-9)
        changed = (post[:, None] * hit * (1 - base) * d / damaged).sum(axis=0)
        references = changed + (post[:, None] * ref).sum(axis=0)
        d = np.clip(changed / np.maximum(references, 1e-12), 1e-9, 1 - 1e-9)
    pi = float(w @ size / size.sum())
    separated = bool(d.max() >= 0.05 and 0.01 < pi < 0.99 and told[-1] - float(n @ log0) >= 10)
    return Mixture(tuple(map(float, d)), pi, float(pi * d[0]), converged, separated, [(*k, int(size[i]), float(w[i])) for k, i in place.items()], told)
