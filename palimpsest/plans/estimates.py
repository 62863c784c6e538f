"""Registered queries of the overhang estimator and of length bins and mixtures.

Fits have no SQL; the tables that they see have, and tests recover planted parameters from them."""

from __future__ import annotations

import math
from dataclasses import asdict

from pyspark.sql import functions as F

from palimpsest.functions.derived import reads
from palimpsest.operators import lengthmix, overhang, oxidation
from palimpsest.plans.base import DAMAGE, R, query

# ---- Overhangs


def _marks(three: str) -> str:
    """Marks of both ends, then inside, in the order of overhang.BITS."""
    five = lambda start: [f"(substr(seq, {start} + {p}, 1) = 'T')::INT" for p in overhang.PLACES]
    back = lambda last: [f"(substr(seq, {last} - {p}, 1) = '{three}')::INT" for p in overhang.PLACES]
    marks = [*five("1"), *back("length(seq)"), *five("(length(seq) // 4 + 1)"), *back("(length(seq) - length(seq) // 4)")]
    return ", ".join(f"{m} AS {name}" for m, name in zip(marks, overhang.BITS, strict=True))


_OVERHANG = f"{R}, m AS ({' UNION ALL '.join(f'''SELECT CASE WHEN length(seq) < 50 THEN 0 WHEN length(seq) < 70 THEN 1 WHEN length(seq) < 90 THEN 2 WHEN length(seq) < 120 THEN 3 ELSE 4 END AS bin, '{channel}' AS channel, {_marks(base)} FROM reads''' for channel, base in (('ds', 'A'), ('ss', 'T')))})"


@query(f"{_OVERHANG} SELECT bin, channel, ({' + '.join(f'{name} * {1 << i}' for i, name in enumerate(overhang.BITS))})::INT AS code, count(*) AS n FROM m GROUP BY ALL")
def overhang_cells(spark, sf_dir):
    return overhang.overhang_cells(reads(spark, sf_dir))


@query(f"{_OVERHANG} SELECT bin, channel, count(*) AS n, {', '.join(f'round(covar_pop({a}, {b}) - covar_pop({c}, {d}), 9) AS {name}' for name, (a, b, c, d) in overhang.PAIRS.items())} FROM m GROUP BY ALL")
def overhang_covariances(spark, sf_dir):
    found = overhang.overhang_covariances(overhang.overhang_cells(reads(spark, sf_dir)))
    return found.select("bin", "channel", "n", *(F.round(name, 9).alias(name) for name in overhang.PAIRS))


@query()
def overhang_fit(spark, sf_dir):
    """The estimate of each channel. These reads hold no damage, so that pi is null and reason says why."""
    cells = overhang.overhang_cells(reads(spark, sf_dir)).persist()
    rows = [(c, *asdict(overhang.fit_overhang(cells, c, least=1_000)).values()) for c in ("ds", "ss")]
    cells.unpersist()
    return spark.createDataFrame(rows, "channel string, bin int, n bigint, reason string, pi double, solved double, se double, solved_far double, se_between double, s5 double, s3 double, rate5 double, rate3 double, term5 double, term3 double")


# ---- Lengths


def cut_reads(spark, sf_dir):
    """Reads of two kinds of lengths: those of even ordinal keep 30 to 39 bases, the others all that they have."""
    return reads(spark, sf_dir).withColumn("seq", F.when(F.col("ord") % 2 == 0, F.left("seq", (30 + F.floor(F.col("ord") / 2) % 10).cast("int"))).otherwise(F.col("seq")))


_CUT = f"{R}, cut AS (SELECT ord, CASE WHEN ord % 2 = 0 THEN left(seq, (30 + (ord // 2) % 10)::INT) ELSE seq END AS seq FROM reads)"


@query(f"{_CUT} SELECT least(length(seq), 500)::INT AS size, count(*) AS n FROM cut GROUP BY 1")
def length_counts(spark, sf_dir):
    return lengthmix.length_counts(cut_reads(spark, sf_dir))


EDGES = [39, 50]
_BIN = "CASE WHEN length(seq) <= 39 THEN 0 WHEN length(seq) <= 50 THEN 1 ELSE 2 END"


@query(f"""{_CUT}, p AS (SELECT {_BIN} AS bin, pos::INT AS pos, substr(seq, pos + 1, 1) AS f, substr(seq, length(seq) - pos, 1) AS b FROM (SELECT seq, unnest(range(0, 15)) AS pos FROM cut))
SELECT bin, pos, count(*) FILTER (f = 'T') AS t5, count(*) FILTER (f = 'C') AS c5, count(*) FILTER (b = 'A') AS t3, count(*) FILTER (b = 'G') AS c3, count(*) AS n FROM p GROUP BY 1, 2""")
def length_bin_ends(spark, sf_dir):
    return lengthmix.bin_ends(cut_reads(spark, sf_dir), EDGES)


@query()
def auto_length_bins(spark, sf_dir):
    """Bins that the lengths suggest, each with its fit."""
    rows = cut_reads(spark, sf_dir)
    edges = lengthmix.auto_edges(lengthmix.length_counts(rows))
    return spark.createDataFrame(lengthmix.fit_bins(lengthmix.bin_ends(rows, edges), edges, least=1_000), "bin int, low int, high int, n bigint, status string, d5 double, l5 double, d3 double, l3 double")


_INNER = "substr(seq, 11, length(seq) - 20)"


@query(f"""{_CUT}, i AS (SELECT {_BIN} AS bin, seq, {", ".join(f"length({_INNER}) - length(replace({_INNER}, '{b}', '')) AS {b.lower()}" for b in "TCAG")} FROM cut)
SELECT bin, least(9, (c + g) * 10 // (length(seq) - 20))::INT AS gc, translate(left(seq, 2), 'TCAG', '10..') || translate(reverse(right(seq, 2)), 'AGTC', '10..') AS code, count(*) AS n, {", ".join(f"sum({b})::BIGINT AS {b}" for b in "tcag")} FROM i GROUP BY ALL""")
def length_gc_cells(spark, sf_dir):
    return lengthmix.length_gc_cells(cut_reads(spark, sf_dir), EDGES)


@query()
def length_gc_mixture(spark, sf_dir):
    """Shares of damaged reads by cell of length and GC, with what all cells share."""
    m = lengthmix.fit_mixture(lengthmix.length_gc_cells(cut_reads(spark, sf_dir), EDGES))
    rows = [] if m is None else [(*c, *m.d, m.pi, m.population, m.converged, m.separated) for c in m.cells]
    return spark.createDataFrame(rows, "bin int, gc int, reads bigint, share double, d5_0 double, d5_1 double, d3_0 double, d3_1 double, pi double, population double, converged boolean, separated boolean")


# ---- Oxidation

PI = 0.3


def _chance(x: str) -> str:
    terms = [f"({math.log(PI / (1 - PI))!r})"]
    for p in range(oxidation.PLACES):
        hit = DAMAGE.bg5 + (1 - DAMAGE.bg5) * DAMAGE.d5 * math.exp(-DAMAGE.l5 * p)
        terms.append(f"CASE substr({x}, {p + 1}, 1) WHEN 'T' THEN {math.log(hit / DAMAGE.bg5)!r} WHEN 'C' THEN {math.log((1 - hit) / (1 - DAMAGE.bg5))!r} ELSE 0 END")
    return f"1 / (1 + exp(-({' + '.join(terms)})))"


_NAMED = [*((a, a) for a in oxidation.FIRST), *((f"{a}_{b}", f"{a} * {b}") for a, b in oxidation.SECOND)]


@query(f"""{R}, v AS (SELECT seq, greatest(0, length(seq) // 3 - 10) AS side FROM reads), w AS (SELECT seq, CASE WHEN side > 0 THEN least(9, length(regexp_replace(substr(seq, 11, side) || substr(seq, length(seq) - 9 - side, side), '[AT]', '', 'g')) * 10 // (2 * side))::INT ELSE -1 END AS gc, {_chance("seq")} AS f, {_chance("translate(reverse(right(seq, 10)), 'ACGT', 'TGCA')")} AS b, substr(seq, length(seq) // 3 + 1, length(seq) - 2 * (length(seq) // 3)) AS third FROM v),
o AS (SELECT gc, greatest(f, b) AS q, CASE WHEN b > f THEN translate(third, 'ACGT', 'TGCA') ELSE third END AS x FROM w),
c AS ({" UNION ALL ".join(f"SELECT gc, '{name}' AS channel, q, length(regexp_replace(x, '[^{a}]', '', 'g')) AS t, length(regexp_replace(x, '[^{a}{b}]', '', 'g')) AS m FROM o" for name, (a, b) in oxidation.CHANNELS.items())}),
s AS (SELECT gc, channel, q * t AS qt, q * m AS qm, (1 - q) * t AS ut, (1 - q) * m AS um FROM c WHERE m > 0)
SELECT gc, channel, count(*) AS reads, {", ".join(f"round(sum({x}), 4) AS {name}" for name, x in _NAMED)} FROM s GROUP BY ALL""")
def oxidation_moments(spark, sf_dir):
    found = oxidation.oxidation_moments(reads(spark, sf_dir), DAMAGE, PI)
    return found.select("gc", "channel", "reads", *(F.round(name, 4).alias(name) for name, _ in _NAMED))


@query()
def oxidation_test(spark, sf_dir):
    """The difference of each channel between damaged and undamaged reads."""
    found = oxidation.oxidation_test(oxidation.oxidation_moments(reads(spark, sf_dir), DAMAGE, PI))
    return spark.createDataFrame([tuple(asdict(x).values()) for x in found.values()], "channel string, difference double, se double, z double, detected boolean")
