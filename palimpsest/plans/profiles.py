"""Registered queries of damage profiles and of models by length bin."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from palimpsest.functions.derived import reads
from palimpsest.operators import damage, lengthmix, profile, split
from palimpsest.operators.tables import written
from palimpsest.plans.base import DAMAGE, R, query

MASKED = damage.Profile(0.20, 0.35, 0.20, 0.35, 0.25, 0.25, mask=(True, True, False))
_ENDS = f"{R}, p AS (SELECT pos, substr(seq, pos + 1, 1) AS f, substr(seq, length(seq) - pos, 1) AS b FROM (SELECT seq, unnest(range(0, 15)) AS pos FROM reads)), c AS (SELECT pos::INT AS pos, {', '.join(f'''count(*) FILTER ({x} = '{y}') AS {y.lower()}{e}''' for x, e, ys in (('f', 5, 'TCG'), ('b', 3, 'AGTC')) for y in ys)}, count(*) AS n FROM p GROUP BY 1)"


@query(f"{_ENDS} SELECT * FROM c")
def end_counts(spark, sf_dir):
    return profile.end_counts(reads(spark, sf_dir))


def _share(hit: str, ref: str) -> str:
    return f"CASE WHEN {hit} + {ref} >= 100 THEN {hit} / ({hit} + {ref}) ELSE -1 END"


def _rows(single: bool) -> str:
    hit, ref = ("t3", "c3") if single else ("a3", "g3")
    return f"SELECT pos, '5prime' AS end5, {_share('t5', 'c5')} AS freq5, '3prime' AS end3, {_share(hit, ref)} AS freq3, {_share('t5', 'g5')} AS freq5_gt, (pos < 2)::INT AS mask, t5 + c5 AS cov5, {hit} + {ref} AS cov3, t5 + g5 AS cov5_gt FROM c"


@query(f"{_ENDS} {_rows(False)}")
def profile_table(spark, sf_dir):
    return profile.profile_table(profile.end_counts(reads(spark, sf_dir)), MASKED)


@query(f"{_ENDS} {_rows(True)}")
def profile_table_single(spark, sf_dir):
    single = damage.Profile(0.2, 0.35, 0.2, 0.35, 0.25, 0.25, True, (True, True))
    return profile.profile_table(profile.end_counts(reads(spark, sf_dir)), single)


@query()
def profile_json(spark, sf_dir):
    return profile.profile_json(profile_table(spark, sf_dir), MASKED, "full")


EDGES = [40, 50, 59]
_LENGTH_BIN = "CASE WHEN length(seq) <= 40 THEN 0 WHEN length(seq) <= 50 THEN 1 WHEN length(seq) <= 59 THEN 2 ELSE 3 END"


def _llr() -> str:
    terms = []
    for p in range(5):
        pd = 0.25 + 0.75 * 0.20 * math.exp(-0.35 * p)
        for base, hit, ref in ((f"substr(seq, {p + 1}, 1)", "T", "C"), (f"substr(seq, length(seq) - {p}, 1)", "A", "G")):
            terms.append(f"CASE {base} WHEN '{hit}' THEN {math.log(pd / 0.25)!r} WHEN '{ref}' THEN {math.log((1 - pd) / 0.75)!r} ELSE 0 END")
    return " + ".join(terms)


_BINNED = f"""{R}, r AS (SELECT ord, seq, {_LENGTH_BIN} AS bin, {_llr()} >= 0.05 AS d FROM reads),
b AS (SELECT bin, pos, d, 5 AS "end", translate(substr(seq, pos + 1, 1), 'TCAG', 'hrxx') AS x FROM (SELECT *, unnest(range(0, 15)) AS pos FROM r) UNION ALL SELECT bin, pos, d, 3, translate(substr(seq, length(seq) - pos, 1), 'AGTC', 'hrxx') FROM (SELECT *, unnest(range(0, 15)) AS pos FROM r)),
k AS (SELECT bin, pos::INT AS pos, "end", count(*) FILTER (x = 'h') AS t, count(*) FILTER (x = 'r') AS c, count(*) FILTER (x = 'h' AND d) AS td, count(*) FILTER (x = 'r' AND d) AS cd, count(*) AS n, count(*) FILTER (d) AS nd FROM b GROUP BY ALL)"""
_LODS = f"""{_BINNED}, s AS (SELECT *, td / (td + cd) AS pd0, (t / (t + c) - nd / n * (td / (td + cd))) / (1 - nd / n) AS pu0, t + c >= 100 AND td + cd >= 100 AND nd < n AS good FROM k),
m AS (SELECT bin, pos, "end", CASE WHEN good THEN ln(greatest(1e-4, least(1 - 1e-4, pd0)) / greatest(1e-4, least(1 - 1e-4, pu0))) ELSE 0 END AS lod_hit, CASE WHEN good THEN ln((1 - greatest(1e-4, least(1 - 1e-4, pd0))) / (1 - greatest(1e-4, least(1 - 1e-4, pu0)))) ELSE 0 END AS lod_ref FROM s)"""


def counted(spark, sf_dir):
    return profile.bin_counts(reads(spark, sf_dir), DAMAGE, EDGES, 0.05)


@query(f"{_BINNED} SELECT * FROM k")
def length_bin_counts(spark, sf_dir):
    return counted(spark, sf_dir)


@query(f'{_LODS} SELECT bin, pos, "end", round(lod_hit, 6) AS lod_hit, round(lod_ref, 6) AS lod_ref FROM m')
def lod_model(spark, sf_dir):
    return profile.lod_model(counted(spark, sf_dir)).withColumn("lod_hit", F.round("lod_hit", 6)).withColumn("lod_ref", F.round("lod_ref", 6))


@query(f"""{_LODS}, e AS (SELECT ord, bin, pos, 5 AS "end", substr(seq, pos + 1, 1) AS y, 'T' AS h, 'C' AS f FROM (SELECT *, unnest(range(0, 15)) AS pos FROM r) UNION ALL SELECT ord, bin, pos, 3, substr(seq, length(seq) - pos, 1), 'A', 'G' FROM (SELECT *, unnest(range(0, 15)) AS pos FROM r))
SELECT ord, round(sum(CASE WHEN y = h THEN lod_hit WHEN y = f THEN lod_ref ELSE 0 END), 6) AS score FROM e JOIN m ON m.bin = e.bin AND m.pos = e.pos AND m."end" = e."end" GROUP BY ord""")
def lod_scores(spark, sf_dir):
    model = written(profile.lod_model(counted(spark, sf_dir)), "lods")
    return profile.lod_scores(reads(spark, sf_dir), model, EDGES).withColumn("score", F.round("score", 6))


_SCORES = f"""{_LODS}, e AS (SELECT ord, bin, pos, 5 AS "end", substr(seq, pos + 1, 1) AS y, 'T' AS h, 'C' AS f FROM (SELECT *, unnest(range(0, 15)) AS pos FROM r) UNION ALL SELECT ord, bin, pos, 3, substr(seq, length(seq) - pos, 1), 'A', 'G' FROM (SELECT *, unnest(range(0, 15)) AS pos FROM r)),
scores AS (SELECT ord, round(sum(CASE WHEN y = h THEN lod_hit WHEN y = f THEN lod_ref ELSE 0 END), 6) AS score FROM e JOIN m ON m.bin = e.bin AND m.pos = e.pos AND m."end" = e."end" GROUP BY ord)"""
SHARES = {"detected": 0.3, "low_abundance": 0.02, "abstain": 0.0}


def _split(spark, sf_dir, state: str):
    """All reads, scored by the model of their length bin and cut as the state asks."""
    rows = reads(spark, sf_dir).select("ord", "seq")
    return split.split(rows, split.plan_of(rows, DAMAGE, EDGES, state, SHARES[state], threshold=0.05)).select("ord", "score", "route")


_ROUTE = "SELECT ord, score, CASE WHEN score >= {cut} THEN 'damaged' ELSE 'undamaged' END AS route FROM scores"


@query(f"{_SCORES} {_ROUTE.format(cut=-math.log(0.3 / 0.7))}")
def split_detected(spark, sf_dir):
    return _split(spark, sf_dir, "detected")


@query(f"{_SCORES}, h AS (SELECT floor((score + 100) * 100)::INT AS bin, count(*) AS n FROM scores GROUP BY 1), t AS (SELECT bin, sum(n) OVER (ORDER BY bin DESC) AS tail, (SELECT sum(n) FROM h) AS total FROM h) {_ROUTE.format(cut='(SELECT max(bin) / 100.0 - 100 FROM t WHERE tail >= 0.02 * total)')}")
def split_low_abundance(spark, sf_dir):
    return _split(spark, sf_dir, "low_abundance")


@query(f"{_SCORES} SELECT ord, score, 'undamaged' AS route FROM scores")
def split_abstain(spark, sf_dir):
    return _split(spark, sf_dir, "abstain")


@query()
def split_planned(spark, sf_dir):
    """The split by what the reads themselves say: profile, bins, share and state are estimated."""
    rows = reads(spark, sf_dir).select("ord", "seq")
    return split.split(rows, split.plan_split(rows)).select("ord", "score", "route")


@query(f"{R}, o AS (SELECT length(seq) AS x, row_number() OVER (ORDER BY length(seq)) - 1 AS i, count(*) OVER () AS n FROM reads) SELECT DISTINCT x::INT AS edge FROM o, range(1, 5) t(k) WHERE i = round(k / 5 * (n - 1))")
def length_edges(spark, sf_dir):
    found = profile.length_edges(reads(spark, sf_dir))
    return spark.createDataFrame([(x,) for x in found], "edge int")


@query(f"{R}, p AS (SELECT {_LENGTH_BIN} AS bin, pos, substr(seq, pos + 1, 1) AS y FROM (SELECT seq, unnest(range(0, 15)) AS pos FROM reads)), c AS (SELECT bin, pos, count(*) FILTER (y = 'T') AS t, count(*) FILTER (y = 'C') AS c, count(*) FILTER (y = 'G') AS g, count(*) AS n FROM p GROUP BY ALL) SELECT bin, round(max(t / (t + c)) FILTER (pos < 2) - sum(t) FILTER (pos >= 5) / sum(t + c) FILTER (pos >= 5), 9) AS d, round(avg(g / n) FILTER (pos >= 5) - max(g / n) FILTER (pos = 0), 9) AS depletion FROM c GROUP BY bin HAVING max(n) FILTER (pos = 0) >= 100 UNION ALL SELECT bin, NULL, NULL FROM c GROUP BY bin HAVING max(n) FILTER (pos = 0) < 100")
def length_bin_damage(spark, sf_dir):
    rows = reads(spark, sf_dir).select("seq", profile.length_bin(EDGES).alias("bin"), F.explode(F.sequence(F.lit(0), F.lit(14))).alias("pos"))
    y = F.col("seq").substr(F.col("pos") + 1, F.lit(1))
    counts = rows.groupBy("bin", "pos").agg(*(F.count_if(y == b).alias(b.lower()) for b in "TCG"), F.count("*").alias("n"))
    return profile.depletion(counts).withColumn("d", F.round("d", 9)).withColumn("depletion", F.round("depletion", 9))


@query()
def hexamer_confound(spark, sf_dir):
    return profile.hexamer_confound(damage.hexamers(reads(spark, sf_dir)), 1)


@query(f"""{R}, r AS (SELECT seq, {_LENGTH_BIN} AS bin, {_llr()} >= 0.05 AS damaged FROM reads), p AS (SELECT bin, damaged, pos::INT AS pos, seq, length(seq) - pos AS last FROM (SELECT *, unnest(range(0, 15)) AS pos FROM r)),
e AS (SELECT bin, 5 AS "end", pos, damaged, substr(seq, pos + 2, 1) = 'G' AS cpg, substr(seq, pos + 1, 1) AS x FROM p UNION ALL SELECT bin, 3, pos, damaged, substr(seq, last - 1, 1) = 'C', substr(seq, last, 1) FROM p)
SELECT bin, "end", pos, damaged, cpg, GROUPING(bin, "end", pos, damaged, cpg)::INT AS level, {", ".join(f"count(*) FILTER (x = '{b}') AS {b.lower()}" for b in "ACGT")}, count(*) AS n FROM e GROUP BY GROUPING SETS ((bin, "end", pos, damaged, cpg), (bin, "end", pos, damaged), (bin, "end", pos), ("end", pos))""")
def damage_strata(spark, sf_dir):
    """Both ends, composition, damaged reads and CpG by length bin and place, in one aggregate."""
    return lengthmix.strata(reads(spark, sf_dir), DAMAGE, EDGES, 0.05)
