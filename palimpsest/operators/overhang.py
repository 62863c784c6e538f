"""The share of damaged molecules, from how damage at the two ends of a read goes together.

Damage hits single-stranded overhangs. A damaged molecule has an overhang at each end, whose lengths are
geometric and independent, and a base in it is changed at a constant rate. Marks of two places then
covary: across ends by pi (1 - pi) b5 b3 s5^(p+1) s3^(q+1), and at one end (places 0 and p) by
pi b^2 s^(p+1) (1 - pi s), where pi is the share of damaged molecules, s the chance that an overhang
goes on and b the rate. The same covariances inside reads, taken off, remove composition. Reads become
a table of 4,096 cells for each length bin and channel; all else is reckoned from that table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import seq as S
from palimpsest.operators.profile import floor

# Places from an end, lower ends of the length bins after the first, reads that a bin needs.
PLACES, BIN_STARTS, LEAST_READS = (0, 3, 6), (50, 70, 90, 120), 50_000
#: Bits of a cell: marks at the 5' end, at the 3' end, and inside the read from a quarter of either end.
BITS = [f"{side}{p}" for side in ("u5_", "u3_", "v5_", "v3_") for p in PLACES]
#: The differenced covariances: two marks at the ends, and the two inside that stand for them.
PAIRS = {
    "cross_00": ("u5_0", "u3_0", "v5_0", "v3_0"), "cross_30": ("u5_3", "u3_0", "v5_3", "v3_0"), "cross_03": ("u5_0", "u3_3", "v5_0", "v3_3"),
    "five_3": ("u5_0", "u5_3", "v5_0", "v5_3"), "five_6": ("u5_0", "u5_6", "v5_0", "v5_6"), "three_3": ("u3_0", "u3_3", "v3_0", "v3_3"), "three_6": ("u3_0", "u3_6", "v3_0", "v3_6"),
}


def overhang_cells(reads: DataFrame) -> DataFrame:
    """(bin, channel, code, n): reads of 30 bases and more by length bin, channel and the marks of BITS (the
    first is the lowest bit of code). A mark is T at the 5' end; at the 3' end A in channel ds, T in ss."""
    n, s = F.length("seq"), F.upper("seq")
    quarter = F.floor(n / 4).cast("int")
    at = lambda place, base: (S.part(s, place, 1) == base).cast("int")
    from5 = [at(first + p, "T") for first in (F.lit(1), quarter + 1) for p in PLACES]
    from3 = lambda base: [at(last - p, base) for last in (n, n - quarter) for p in PLACES]
    code = lambda three: sum((b * (1 << i) for i, b in enumerate([*from5[:3], *three[:3], *from5[3:], *three[3:]])), F.lit(0))
    bin_ = sum(((n >= x).cast("int") for x in BIN_STARTS), F.lit(0))
    each = F.array(*(F.struct(F.lit(c).alias("channel"), code(from3(b)).alias("code")) for c, b in (("ds", "A"), ("ss", "T"))))
    return floor(reads).select(bin_.alias("bin"), F.inline(each)).groupBy("bin", "channel", "code").agg(F.count("*").alias("n"))


def _bit(name: str) -> Column:
    return F.shiftright(F.col("code"), BITS.index(name)).bitwiseAND(F.lit(1))


def overhang_covariances(cells: DataFrame) -> DataFrame:
    """bin, channel, n and the seven differenced covariances of each bin and channel."""
    mean = lambda x: F.sum(x * F.col("n")) / F.sum("n")
    cov = lambda x, y: mean(_bit(x) * _bit(y)) - mean(_bit(x)) * mean(_bit(y))
    return cells.groupBy("bin", "channel").agg(F.sum("n").alias("n"), *((cov(a, b) - cov(c, d)).alias(name) for name, (a, b, c, d) in PAIRS.items()))


@dataclass(frozen=True)
class Overhang:
    """What the cells of one channel say. reason is empty if pi is identified; else pi is null, and solved
    holds what the equation gave. term5 and term3 are the changed shares of the outermost bases."""

    bin: int | None = None
    n: int = 0
    reason: str = ""
    pi: float | None = None
    solved: float | None = None
    se: float | None = None
    solved_far: float | None = None
    se_between: float | None = None
    s5: float | None = None
    s3: float | None = None
    rate5: float | None = None
    rate3: float | None = None
    term5: float | None = None
    term3: float | None = None


def _slope(pi: float, s5: float, s3: float) -> float:
    return s5 / (1 - pi * s5) + s3 / (1 - pi * s3) - 2 / (1 - pi)


def _share(log_k: float, s5: float, s3: float) -> float:
    """pi in (0, 1/2) of (1 - pi)^2 / ((1 - pi s5)(1 - pi s3)) = K by Newton's method."""
    pi = 0.2
    for _ in range(60):
        off = 2 * math.log1p(-pi) - math.log1p(-pi * s5) - math.log1p(-pi * s3) - log_k
        before, pi = pi, min(max(pi - off / _slope(pi, s5, s3), 1e-5), 0.4999)
        if abs(pi - before) < 1e-10:
            break
    return pi


def fit_overhang(cells: DataFrame, channel: str = "ds", least: int = LEAST_READS) -> Overhang:
    """The estimate from the shortest length bin with enough reads. pi is identified if all differenced
    covariances are positive, pi and the rates are within their ranges, the overhangs seen across ends and at
    one end agree within three standard errors, and near and far places give the same pi within two.
    The table has 4,096 cells a bin."""
    rows = cells.filter(F.col("channel") == channel).select("bin", "code", "n").collect()
    size = {b: sum(r.n for r in rows if r.bin == b) for b in {r.bin for r in rows}}
    enough = [b for b in sorted(size) if size[b] >= least]
    if not enough:
        return Overhang(reason="no_bin")
    chosen = [r for r in rows if r.bin == enough[0]]
    codes, weights = np.array([r.code for r in chosen]), np.array([r.n for r in chosen], float)
    n = int(weights.sum())
    marks = (codes[:, None] >> np.arange(len(BITS)) & 1).astype(float)
    off = marks - weights @ marks / n
    side = lambda k: off[:, [BITS.index(p[k]) for p in PAIRS.values()]]
    products = side(0) * side(1) - side(2) * side(3)
    found = weights @ products / n
    if not (found > 0).all():
        return Overhang(enough[0], n, "nonpos_dcov")
    of = dict(zip(PAIRS, np.log(found), strict=True))
    influence = (products - found) / found
    axis = list(PAIRS)

    def error(combination: dict[str, float]) -> np.ndarray:
        """What each cell adds to the error of a sum of logs."""
        return influence @ np.array([combination.get(k, 0.0) for k in axis])

    spread = lambda per_cell: math.sqrt(float(weights @ per_cell**2)) / n
    total = lambda combination: sum(w * of[k] for k, w in combination.items())
    third = 1 / 3
    cross5, cross3 = {"cross_30": third, "cross_00": -third}, {"cross_03": third, "cross_00": -third}
    apart5 = {**cross5, "five_6": -third, "five_3": third}
    apart3 = {**cross3, "three_6": -third, "three_3": third}
    near = {"cross_00": 2 * third, "cross_30": 2 * third, "cross_03": 2 * third, "five_3": -1.0, "three_3": -1.0}
    far = {"cross_00": -4 * third, "cross_30": 5 * third, "cross_03": 5 * third, "five_6": -1.0, "three_6": -1.0}
    s5, s3 = math.exp(total(cross5)), math.exp(total(cross3))
    pi, pi_far = _share(total(near), s5, s3), _share(total(far), s5, s3)
    e_near, e_far = error(near) / _slope(pi, s5, s3), error(far) / _slope(pi_far, s5, s3)
    se, between = spread(e_near), spread(e_near - e_far)
    rate = lambda name, s: math.sqrt(math.exp(of[name]) / s**4 / (pi * (1 - pi * s))) if pi * s < 1 else math.inf
    rate5, rate3 = rate("five_3", s5), rate("three_3", s3)
    tests = [
        ("pi_out_of_range", 1e-4 < pi < 0.4999),
        ("beta_out_of_range", 0 < rate5 <= 1 and 0 < rate3 <= 1),
        ("overhang_s5_mismatch", abs(total(apart5)) <= 3 * spread(error(apart5))),
        ("overhang_s3_mismatch", abs(total(apart3)) <= 3 * spread(error(apart3))),
        ("pi_spacing_discordant", abs(pi - pi_far) <= 2 * between),
    ]
    reason = next((name for name, good in tests if not good), "")
    return Overhang(enough[0], n, reason, None if reason else pi, pi, se, pi_far, between, s5, s3, rate5, rate3, s5 * rate5, s3 * rate3)
