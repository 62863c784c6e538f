"""Oxidised guanine inside damaged reads: G read as T, where deamination cannot reach.

Each read has a chance of being damaged, from the first ten bases of its 5' end; double-stranded reads
are turned so that the likelier end comes first. The share of T among T and G in the middle third is
compared between damaged and undamaged reads, each read counting for both by its chance, within bins
of GC content. Sums and products of the weighted counts give the difference and its error, so that one
pass over the reads is enough. The same difference for A among A and C, which oxidation of this strand
does not change, is the control.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import seq as S
from palimpsest.operators.damage import Profile
from palimpsest.operators.profile import floor

# Places that weigh a read, bins of GC content, bases that a bin needs, least z of a finding.
PLACES, GC_BINS, LEAST_BASES, LEAST_Z = 10, 10, 500, 3.0
#: What is counted: the changed base, and its total with the base that it comes from.
CHANNELS = {"oxo": ("T", "G"), "control": ("A", "C")}
#: Sums over reads with chance q of being damaged, t changed bases of m: of q t, q m, (1-q) t, (1-q) m, and of their products.
FIRST = ("qt", "qm", "ut", "um")
SECOND = [(a, b) for i, a in enumerate(FIRST) for b in FIRST[i:]]


def chance(s: Column, profile: Profile, pi: float, places: int = PLACES) -> Column:
    """The chance that a read is damaged, from T and C among its first bases, with pi before they are seen."""
    total = F.lit(math.log(pi / (1 - pi)))
    for p in range(places):
        hit = min(max(profile.bg5 + (1 - profile.bg5) * profile.d5 * math.exp(-profile.l5 * p), 1e-6), 1 - 1e-6)
        base = S.part(s, p + 1, 1)
        total = total + F.when(base == "T", math.log(hit / profile.bg5)).when(base == "C", math.log((1 - hit) / (1 - profile.bg5))).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def oxidation_moments(reads: DataFrame, profile: Profile, pi: float, gc_bins: int = GC_BINS) -> DataFrame:
    """(gc, channel, reads, and sums by name): over reads of 30 bases and more by bin of GC content. oxo counts T
    of T and G, control A of A and C, in the middle third of the read as it is turned. GC content is that of
    the bases between that third and the ten at either end (none: -1), so that neither kind of damage moves
    a read to another bin."""
    n = F.length("seq")
    rows = floor(reads).select(F.upper("seq").alias("seq"))
    side = F.greatest(F.lit(0), F.floor(n / 3).cast("int") - PLACES)
    between = F.concat(S.part(F.col("seq"), PLACES + 1, side), S.part(F.col("seq"), n - PLACES - side + 1, side))
    gc = F.when(side > 0, F.least(F.lit(gc_bins - 1), F.floor((S.base_count(between, "G") + S.base_count(between, "C")) * gc_bins / (2 * side)).cast("int"))).otherwise(-1)
    rows = rows.withColumns({"gc": gc, "q": chance(F.col("seq"), profile, pi), "_turned": F.lit(False), "_third": S.part(F.col("seq"), F.floor(n / 3).cast("int") + 1, (n - 2 * F.floor(n / 3)).cast("int"))})
    if not profile.single:
        back = chance(S.revcomp(F.right("seq", F.lit(PLACES))), profile, pi)
        rows = rows.withColumn("_back", back).withColumn("_turned", F.col("_back") > F.col("q")).withColumn("q", F.greatest("q", "_back"))
    turn = str.maketrans("ACGT", "TGCA")
    count = lambda b: F.when(F.col("_turned"), S.base_count("_third", b.translate(turn))).otherwise(S.base_count("_third", b))
    each = F.array(*(F.struct(F.lit(name).alias("channel"), count(a).alias("t"), (count(a) + count(b)).alias("m")) for name, (a, b) in CHANNELS.items()))
    held = rows.select("gc", "q", F.inline(each)).filter("m > 0")
    q, u = F.col("q"), 1 - F.col("q")
    of = {"qt": q * F.col("t"), "qm": q * F.col("m"), "ut": u * F.col("t"), "um": u * F.col("m")}
    return held.groupBy("gc", "channel").agg(F.count("*").alias("reads"), *(F.sum(of[a]).alias(a) for a in FIRST), *(F.sum(of[a] * of[b]).alias(f"{a}_{b}") for a, b in SECOND))


@dataclass(frozen=True)
class Oxidation:
    """The difference between damaged and undamaged reads, its error and z, of a channel."""

    channel: str
    difference: float | None
    se: float | None
    z: float | None
    detected: bool


def oxidation_test(moments: DataFrame, least: int = LEAST_BASES, least_z: float = LEAST_Z) -> dict[str, Oxidation]:
    """Each channel's difference qt / qm - ut / um, bins weighted by their bases of damaged reads, with the error
    that the reads' spread gives. Bins with fewer than `least` weighted bases of either kind are left out; a
    channel without any has no difference. oxo is only detected where the control stays silent."""
    rows = moments.collect()  # two channels a bin
    out = {}
    for name in CHANNELS:
        parts = []
        for r in rows:
            if r.channel != name or min(r.qm, r.um) < least:
                continue
            one, two = r.qt / r.qm, r.ut / r.um
            # What a read adds to the difference: (qt - one qm) / QM - (ut - two um) / UM.
            load = np.array([1 / r.qm, -one / r.qm, -1 / r.um, two / r.um])
            square = np.array([[r[f"{a}_{b}"] if (a, b) in SECOND else r[f"{b}_{a}"] for b in FIRST] for a in FIRST])
            parts.append((r.qm, one - two, float(load @ square @ load)))
        if not parts:
            out[name] = Oxidation(name, None, None, None, False)
            continue
        weight = np.array([w for w, *_ in parts]) / sum(w for w, *_ in parts)
        difference = float(weight @ np.array([d for _, d, _ in parts]))
        se = math.sqrt(float(weight**2 @ np.array([v for *_, v in parts])))
        z = difference / se if se > 0 else 0.0
        out[name] = Oxidation(name, difference, se, z, z >= least_z)
    if out["control"].detected and out["oxo"].detected:
        o = out["oxo"]
        out["oxo"] = Oxidation("oxo", o.difference, o.se, o.z, False)
    return out
