"""Damage tables, fits and per-read damage scores.

Tables are plain aggregates over reads; fits take those tables, whose size does not depend on the
number of reads, to numpy on the driver. Estimators follow their documented formulas.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import seq as S

#: Positions of the terminal tables, reads a cell needs, the window that gives the background.
POSITIONS, LEAST_CELL, BACKGROUND = 15, 100, 50


@dataclass(frozen=True)
class Profile:
    d5: float = 0.0
    l5: float = 0.5
    d3: float = 0.0
    l3: float = 0.5
    bg5: float = 0.02
    bg3: float = 0.02
    single: bool = False
    mask: tuple[bool, ...] = field(default_factory=tuple)

    @property
    def enabled(self) -> bool:
        return self.d5 > 0.02 or self.d3 > 0.02


def terminal_counts(reads: DataFrame, positions: int = POSITIONS) -> DataFrame:
    """(pos, t5, c5, a3, g3, n): bases at each place from the 5' end (T, C) and the 3' end (A, G)."""
    n = F.length("seq")
    at = reads.select("seq", F.explode(F.sequence(F.lit(0), F.least(F.lit(positions), n) - 1)).alias("pos"))
    five, three = S.part(F.col("seq"), F.col("pos") + 1, 1), S.part(F.col("seq"), n - F.col("pos"), 1)
    return at.groupBy("pos").agg(F.count_if(five == "T").alias("t5"), F.count_if(five == "C").alias("c5"), F.count_if(three == "A").alias("a3"), F.count_if(three == "G").alias("g3"), F.count("*").alias("n"))


def hexamers(reads: DataFrame) -> DataFrame:
    """(place, hexamer, n): first and last six bases, and those from the middle, of reads of at least 12 (18)."""
    n = F.length("seq")
    places = F.array(F.struct(F.lit("five").alias("place"), S.part(F.col("seq"), 1, 6).alias("hexamer")), F.struct(F.lit("three").alias("place"), S.part(F.col("seq"), n - 5, 6).alias("hexamer")), F.struct(F.lit("inner").alias("place"), F.when(n >= 18, S.part(F.col("seq"), F.floor(n / 2).cast("int") - 2, 6)).alias("hexamer")))
    return reads.filter(n >= 12).select(F.inline(places)).filter(F.col("hexamer").isNotNull()).groupBy("place", "hexamer").agg(F.count("*").alias("n"))


def enriched_stubs(counts: DataFrame, log2_least: float = 3.0, least: int = 50, most: int = 10) -> DataFrame:
    """Terminal hexamers whose share is at least 2**log2_least times that inside reads: up to most
    of them at each end."""
    total = counts.groupBy("place").agg(F.sum("n").alias("total"))
    share = counts.join(F.broadcast(total), "place").withColumn("share", F.col("n") / F.col("total"))  # three rows
    inner = share.filter("place = 'inner'").select("hexamer", F.col("share").alias("inside"))
    floor = total.filter("place = 'inner'").select((0.5 / F.col("total")).alias("floor"))
    ends = share.filter("place <> 'inner'").join(inner, "hexamer", "left").crossJoin(F.broadcast(floor))  # one row
    ratio = F.log2(F.col("share") / F.greatest(F.coalesce("inside", F.lit(0.0)), F.col("floor")))
    good = ends.withColumn("log2_ratio", ratio).filter((F.col("log2_ratio") >= log2_least) & (F.col("n") >= least))
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("log2_ratio"), "hexamer"))
    return good.withColumn("_r", rank).filter(F.col("_r") <= most).select("place", "hexamer", "n", "log2_ratio")


def length_histogram(reads: DataFrame, bins: int = 20) -> DataFrame:
    return reads.groupBy(S.log_length_bin(F.length("seq"), bins).alias("bin")).agg(F.count("*").alias("n"), F.min(F.length("seq")).alias("low"), F.max(F.length("seq")).alias("high"))


def joint_cells(reads: DataFrame) -> DataFrame:
    """(bin, u5, u3, v5, v3, n): whether both ends look damaged (T first, A last) and whether a
    place further in does, by length bin."""
    n = F.length("seq")
    s = F.col("seq")
    flag = lambda x: F.when(x, 1).otherwise(0)
    cells = reads.filter(n >= 30).select(S.log_length_bin(n, 5).alias("bin"), flag(S.part(s, 1, 1) == "T").alias("u5"), flag(S.part(s, n, 1) == "A").alias("u3"), flag(S.part(s, 12, 1) == "T").alias("v5"), flag(S.part(s, n - 11, 1) == "A").alias("v3"))
    return cells.groupBy("bin", "u5", "u3", "v5", "v3").agg(F.count("*").alias("n"))


def joint_codes(reads: DataFrame, size: int = 6) -> DataFrame:
    """(bin, channel, five, three, n): reads by length bin and by which of the first and last `size` places
    look damaged, as strings of 0 and 1 from the ends inward: 2**(2 size) cells. Channel ds has T at the
    5' and A at the 3' end, ss has T at both."""
    n, s = F.length("seq"), F.col("seq")
    five = F.translate(S.part(s, 1, size), "TACGN", "10000")
    back = F.reverse(S.part(s, n - size + 1, size))
    channels = F.array(F.struct(F.lit("ds").alias("channel"), F.translate(back, "ATCGN", "10000").alias("three")), F.struct(F.lit("ss").alias("channel"), F.translate(back, "TACGN", "10000").alias("three")))
    each = reads.filter(n >= 30).select(S.log_length_bin(n, 5).alias("bin"), five.alias("five"), F.inline(channels))
    return each.groupBy("bin", "channel", "five", "three").agg(F.count("*").alias("n"))


def covariance_contrast(cells: DataFrame) -> DataFrame:
    """By bin: Cov(U5, U3) - Cov(V5, V3), its standard error, z, and the odds ratio of the ends.
    Damage hits both ends of one molecule, so the contrast is positive in ancient libraries."""
    mean = lambda x: F.sum(x * F.col("n")) / F.sum("n")
    u5, u3, v5, v3 = (F.col(c) for c in ("u5", "u3", "v5", "v3"))
    sums = cells.groupBy("bin").agg(F.sum("n").alias("n"), mean(u5).alias("a"), mean(u3).alias("b"), mean(u5 * u3).alias("ab"), mean(v5).alias("c"), mean(v3).alias("d"), mean(v5 * v3).alias("cd"))
    cov_u, cov_v = F.col("ab") - F.col("a") * F.col("b"), F.col("cd") - F.col("c") * F.col("d")
    spread = lambda p, q: p * (1 - p) * q * (1 - q)
    se = F.sqrt((spread(F.col("a"), F.col("b")) + spread(F.col("c"), F.col("d"))) / F.col("n"))
    odds = (F.col("ab") + 1e-9) * (1 - F.col("a") - F.col("b") + F.col("ab") + 1e-9) / ((F.col("a") - F.col("ab") + 1e-9) * (F.col("b") - F.col("ab") + 1e-9))
    return sums.select("bin", "n", (cov_u - cov_v).alias("contrast"), se.alias("se"), F.when(se > 0, (cov_u - cov_v) / se).alias("z"), odds.alias("odds_ratio"))


def background(reads: DataFrame, window: int = BACKGROUND) -> tuple[float, float]:
    """T of T and C, and A of A and G, over the middle of reads (places from 15 to window)."""
    middle = S.part(F.col("seq"), POSITIONS + 1, window - POSITIONS)
    t, c, a, g = (F.sum(S.base_count(middle, b)) for b in "TCAG")
    row = reads.agg((t / F.nullif(t + c, F.lit(0))).alias("x"), (a / F.nullif(a + g, F.lit(0))).alias("y")).first()
    return float(row.x or 0.0), float(row.y or 0.0)


def fit_decay(shares: np.ndarray, weights: np.ndarray, base: float) -> tuple[float, float]:
    """(d, lambda) of base + (1 - base) d exp(-lambda p): a weighted line through the logs of the
    excess at places 1 to 9, lambda kept in [0.05, 0.5]; d is also bounded by the first place."""
    p = np.arange(len(shares))
    excess = (shares - base) / max(1 - base, 1e-9)
    use = (p >= 1) & (p <= 9) & (excess > 1e-4) & (weights >= LEAST_CELL)
    if use.sum() < 3:
        return max(0.0, float(excess[0]) if weights[0] >= LEAST_CELL else 0.0), 0.5
    x, y, w = p[use], np.log(excess[use]), weights[use] * excess[use]
    mx, my = np.average(x, weights=w), np.average(y, weights=w)
    slope = np.sum(w * (x - mx) * (y - my)) / max(np.sum(w * (x - mx) ** 2), 1e-12)
    rate = float(np.clip(-slope, 0.05, 0.5))
    return float(np.clip(math.exp(my + rate * mx), 0.0, 1.0)), rate


def mask_of(excess5: np.ndarray, excess3: np.ndarray, threshold: float = 0.05) -> tuple[bool, ...]:
    """Places whose excess at either end is above threshold; single gaps are filled."""
    mask = np.maximum(excess5, excess3) > threshold
    for i in range(1, len(mask) - 1):
        if mask[i - 1] and mask[i + 1]:
            mask[i] = True
    return tuple(bool(x) for x in mask)


def fit_profile(reads: DataFrame, threshold: float = 0.05, single: bool = False) -> Profile:
    """A damage profile from the terminal tables of all reads."""
    table = terminal_counts(reads).orderBy("pos").toPandas()  # POSITIONS rows
    if not len(table):
        return Profile(single=single)
    bg5, bg3 = background(reads)
    n5, n3 = (table["t5"] + table["c5"]).to_numpy(float), (table["a3"] + table["g3"]).to_numpy(float)
    s5, s3 = table["t5"].to_numpy(float) / np.maximum(n5, 1), table["a3"].to_numpy(float) / np.maximum(n3, 1)
    d5, l5 = fit_decay(s5, n5, bg5)
    d3, l3 = fit_decay(s3, n3, bg3)
    excess = [np.where(n >= LEAST_CELL, (s - b) / max(1 - b, 1e-9), 0.0) for s, n, b in ((s5, n5, bg5), (s3, n3, bg3))]
    return Profile(d5, l5, d3, l3, bg5, bg3, single, mask_of(*excess, threshold))


def llr(s: Column | str, profile: Profile, places: int = 5) -> Column:
    """Log likelihood ratio of damaged against undamaged over the terminal places of a read: 5' T
    or C, and 3' A or G (T or C in single-stranded libraries)."""
    s, total = S.col(s), F.lit(0.0)
    n = F.length(s)
    for d, rate, bg, three in ((profile.d5, profile.l5, profile.bg5, False), (profile.d3, profile.l3, profile.bg3, True)):
        hit, ref = ("A", "G") if three and not profile.single else ("T", "C")
        bg = min(max(bg, 1e-4), 1 - 1e-4)
        for p in range(places):
            gain = d * math.exp(-rate * p)
            if gain < 1e-4:
                break
            pd = min(bg + (1 - bg) * gain, 1 - 1e-9)
            base = S.part(s, n - p if three else p + 1, 1)
            inside = n > p
            total = total + F.when(inside & (base == hit), math.log(pd / bg)).when(inside & (base == ref), math.log((1 - pd) / (1 - bg))).otherwise(0.0)
    return total


def split_reads(reads: DataFrame, profile: Profile, threshold: float = 0.0) -> DataFrame:
    """reads with llr and route, damaged or undamaged."""
    scored = reads.withColumn("llr", llr("seq", profile))
    return scored.withColumn("route", F.when(F.col("llr") >= threshold, "damaged").otherwise("undamaged"))


def score_histogram(scored: DataFrame) -> DataFrame:
    """Counts of llr in 20,001 bins over [-100, 100]."""
    bin_ = F.floor((F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.col("llr"))) + 100) * 100).cast("int")
    return scored.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def tail_cut(histogram: DataFrame, share: float) -> DataFrame:
    """The highest bin from which on upwards at least share of all reads lie."""
    upper = histogram.withColumn("tail", F.sum("n").over(Window.orderBy(F.desc("bin"))))  # 20,001 rows at most
    total = histogram.agg(F.sum("n").alias("total"))
    return upper.crossJoin(F.broadcast(total)).filter(F.col("tail") >= share * F.col("total")).agg(F.max("bin").alias("bin")).select("bin", (F.col("bin") / 100.0 - 100).alias("cut"))


def weighted_fraction(scored: DataFrame, prior: float) -> DataFrame:
    """Expected share of damaged reads: the mean posterior of llr under a prior share."""
    w = 1 / (1 + F.exp(-(F.col("llr") + math.log(prior / (1 - prior)))))
    return scored.agg(F.count("*").alias("n"), F.avg(w).alias("fraction"), F.sum(w * F.when(S.part(F.col("seq"), 1, 1) == "T", 1).otherwise(0)).alias("damaged_t"))


def stratified(reads: DataFrame, bins: int = 5) -> DataFrame:
    """(bin, pos, t, c, cpg_t, cpg_c, n): 5' bases by length bin and place, and before a G."""
    n = F.length("seq")
    at = reads.select("seq", S.log_length_bin(n, bins).alias("bin"), F.explode(F.sequence(F.lit(0), F.least(F.lit(POSITIONS), n) - 1)).alias("pos"))
    base, after = S.part(F.col("seq"), F.col("pos") + 1, 1), S.part(F.col("seq"), F.col("pos") + 2, 1)
    return at.groupBy("bin", "pos").agg(F.count_if(base == "T").alias("t"), F.count_if(base == "C").alias("c"), F.count_if((base == "T") & (after == "G")).alias("cpg_t"), F.count_if((base == "C") & (after == "G")).alias("cpg_c"), F.count("*").alias("n"))


def signatures(reads: DataFrame, size: int = 10) -> DataFrame:
    """(five, three, n): terminal bases as hit, reference or other, by joint code."""
    n = F.length("seq")
    five = F.translate(S.part(F.col("seq"), 1, size), "TCAGN", "10...")
    three = F.translate(F.reverse(S.part(F.col("seq"), n - size + 1, size)), "AGTCN", "10...")
    return reads.filter(n >= 2 * size).groupBy(five.alias("five"), three.alias("three")).agg(F.count("*").alias("n"))


def oxidation(reads: DataFrame, gc_bins: int = 10) -> DataFrame:
    """By GC bin: T, G, C, A inside reads and D = T/(T+G) - A/(A+C) where both have 500 or more."""
    n = F.length("seq")
    inner = S.part(F.col("seq"), 11, n - 20)
    gc = F.least(F.lit(gc_bins - 1), F.floor((S.base_count("seq", "G") + S.base_count("seq", "C")) * gc_bins / n).cast("int"))
    sums = reads.filter(n > 20).groupBy(gc.alias("gc")).agg(*[F.sum(S.base_count(inner, b)).alias(b.lower()) for b in "TGCA"])
    enough = (F.col("t") + F.col("g") >= 500) & (F.col("a") + F.col("c") >= 500)
    return sums.withColumn("d", F.when(enough, F.col("t") / (F.col("t") + F.col("g")) - F.col("a") / (F.col("a") + F.col("c"))))


def library_type(table, bg5: float, bg3: float) -> str:
    """ds, ss or none by the BIC of binomial models of the 5' C>T and 3' G>A and C>T excess at the
    first place. table: (hits, trials) of ct5, ga3, ct3."""
    base = {"ct5": bg5, "ga3": bg3, "ct3": bg5}
    n = sum(t for _, t in table.values())

    def fit(free: set[str]) -> float:
        total = 0.0
        for name, (hits, trials) in table.items():
            p = min(max(max(hits / max(trials, 1), base[name]) if name in free else base[name], 1e-9), 1 - 1e-9)
            total += hits * math.log(p) + (trials - hits) * math.log(1 - p)
        return -2 * total + len(free) * math.log(max(n, 2))

    return min((("none", set()), ("ds", {"ct5", "ga3"}), ("ss", {"ct5", "ct3"})), key=lambda m: fit(m[1]))[0]
