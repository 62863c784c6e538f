"""Registered queries of read pairs: overlaps, substitutions, gates and trims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import seq as S
from palimpsest.functions.derived import quality, reads
from palimpsest.operators import merge, prescan
from palimpsest.plans.base import R, query

#: The second mate's copy of an insert differs in one base in a third of the pairs, and has an N in a
#: seventh; mates have 35 to 49 bases, so that they overlap by 10 to 38.
_WORN = f"""{R}, whole AS (SELECT ord, seq AS x, (35 + ord % 15)::INT AS m FROM reads WHERE length(seq) = 60),
once AS (SELECT *, CASE WHEN ord % 3 = 0 THEN left(x, (24 + ord % 12)::INT) || translate(substr(x, (25 + ord % 12)::INT, 1), 'ACGT', 'GTAC') || substr(x, (26 + ord % 12)::INT) ELSE x END AS y0 FROM whole),
pairs AS (SELECT ord, x, m, CASE WHEN ord % 7 = 0 THEN left(y0, 29) || 'N' || substr(y0, 31) ELSE y0 END AS y FROM once),
calls AS (SELECT substr(x, 61 - m, 2 * m - 60) AS l, substr(y, 61 - m, 2 * m - 60) AS r FROM pairs)"""


def mates(spark, sf_dir) -> DataFrame:
    full = reads(spark, sf_dir).filter(F.length("seq") == 60).withColumn("qual", quality())
    at = (25 + F.col("ord") % 12).cast("int")
    y = F.when(F.col("ord") % 3 == 0, F.overlay("seq", F.translate(F.col("seq").substr(at, F.lit(1)), "ACGT", "GTAC"), at, F.lit(1))).otherwise(F.col("seq"))
    full = full.withColumn("y", y).withColumn("y", F.when(F.col("ord") % 7 == 0, F.overlay("y", F.lit("N"), F.lit(30), F.lit(1))).otherwise(F.col("y"))).withColumn("m", (35 + F.col("ord") % 15).cast("int"))
    return full.select("ord", "m", F.concat(F.lit("@read_"), F.col("ord"), F.lit("/1")).alias("header"), F.left("seq", F.col("m")).alias("seq1"), F.left("qual", F.col("m")).alias("qual1"), F.left(S.revcomp("y"), F.col("m")).alias("seq2"), F.left(F.reverse("qual"), F.col("m")).alias("qual2"))


def calls(spark, sf_dir) -> DataFrame:
    k = 2 * F.col("m") - 60
    return mates(spark, sf_dir).select(F.substr("seq1", 61 - F.col("m"), k).alias("left"), F.left(S.revcomp("seq2"), k).alias("right"))


_EACH = "e AS (SELECT l, r, length(l) AS k, unnest(range(1, length(l) + 1)) AS i FROM calls), a AS (SELECT i - 1 AS f, k - i AS b, k, substr(l, i, 1) AS b1, substr(r, i, 1) AS b2 FROM e WHERE substr(l, i, 1) <> 'N' AND substr(r, i, 1) <> 'N')"


@query(f"{_WORN}, {_EACH} SELECT 'fwd' AS strand, f::INT AS pos, b1, b2, count(*) AS n FROM a WHERE f < 30 GROUP BY ALL UNION ALL SELECT 'rev', b::INT, b1, b2, count(*) FROM a WHERE b < 30 GROUP BY ALL UNION ALL SELECT 'all', NULL, b1, b2, count(*) FROM a GROUP BY ALL")
def overlap_subst(spark, sf_dir):
    return merge.substitution_tensor(calls(spark, sf_dir))


_BIN = "(k > 30)::INT + (k > 40)::INT + (k > 50)::INT + (k > 60)::INT + (k > 80)::INT AS len_bin"


@query(f"{_WORN}, {_EACH}, z AS (SELECT *, {_BIN} FROM a) SELECT 'fwd' AS strand, f::INT AS pos, len_bin, b1, b2, count(*) AS n FROM z WHERE f < 30 GROUP BY ALL UNION ALL SELECT 'rev', b::INT, len_bin, b1, b2, count(*) FROM z WHERE b < 30 GROUP BY ALL UNION ALL SELECT 'all', NULL, len_bin, b1, b2, count(*) FROM z GROUP BY ALL")
def subst_by_length(spark, sf_dir):
    return merge.substitution_tensor(calls(spark, sf_dir), by_length=True)


_SLOTS = f"{_WORN}, s AS (SELECT slot, CASE WHEN slot < 20 THEN slot + 1 ELSE length(l) - 23 + slot END AS o, l, r FROM calls, range(0, 24) t(slot) WHERE length(l) >= 24), d AS (SELECT slot, count(*) FILTER (substr(l, o, 1) <> substr(r, o, 1) AND substr(l, o, 1) <> 'N' AND substr(r, o, 1) <> 'N') AS misses, count(*) FILTER (substr(l, o, 1) <> 'N' AND substr(r, o, 1) <> 'N') AS bases FROM s GROUP BY slot)"


@query(f"{_SLOTS} SELECT slot::INT AS slot, misses, bases FROM d")
def end_mismatches(spark, sf_dir):
    return merge.end_mismatches(calls(spark, sf_dir))


@query(f"""{_SLOTS}, p AS (SELECT part, sum(misses) AS m, sum(bases) AS n FROM (SELECT CASE WHEN slot < 4 THEN 'five' WHEN slot >= 20 THEN 'three' WHEN slot >= 8 THEN 'in' END AS part, misses, bases FROM d) WHERE part IS NOT NULL GROUP BY 1),
q AS (SELECT part, m / n AS p, (m / n) * (1 - m / n) / n AS v FROM p),
w AS (SELECT (SELECT p FROM q WHERE part = 'five') - i.p - 1.96 * sqrt((SELECT v FROM q WHERE part = 'five') + i.v) > 0 AS five, (SELECT p FROM q WHERE part = 'three') - i.p - 1.96 * sqrt((SELECT v FROM q WHERE part = 'three') + i.v) > 0 AS three FROM q i WHERE part = 'in')
SELECT five, three, CASE WHEN five AND NOT three THEN 'half' WHEN NOT five AND NOT three THEN 'full' ELSE 'none' END AS call, CASE WHEN NOT five AND NOT three THEN 0 ELSE 4 END AS skip_terminal FROM w""")
def udg_call(spark, sf_dir):
    return merge.udg(merge.end_mismatches(calls(spark, sf_dir)))


@query(f"{_WORN}, t AS (SELECT left(x, m) AS a, translate(reverse(y), 'ACGTN', 'TGCAN') AS c, m FROM pairs), u AS (SELECT substr(a, m // 3 + 1, 2 * m // 3 - m // 3) || substr(left(c, m), m // 3 + 1, 2 * m // 3 - m // 3) AS z FROM t) SELECT sum(length(z))::BIGINT AS bases, sum(length(z) - length(replace(z, 'G', '')))::BIGINT AS g, greatest(4, ceil(ln(1e-3) / ln(sum(length(z) - length(replace(z, 'G', ''))) / sum(length(z)))))::INT AS least_run FROM u")
def polyg_run(spark, sf_dir):
    found = merge.interior_g(mates(spark, sf_dir))
    share = F.col("g") / F.col("bases")
    return found.withColumn("least_run", F.greatest(F.lit(4), F.ceil(F.log(F.lit(1e-3)) / F.log(share))).cast("int"))


def _entropy(x: str) -> str:
    c = lambda b: f"(length({x}) - length(replace({x}, '{b}', '')))"
    return "(0.0 " + " ".join(f"- CASE WHEN {c(b)} > 0 THEN {c(b)}::DOUBLE / length({x}) * log2({c(b)}::DOUBLE / length({x})) ELSE 0 END" for b in "ACGT") + ")"


def _dominance(x: str) -> str:
    return "greatest(" + ", ".join(f"length({x}) - length(replace({x}, '{b}', ''))" for b in "ACGT") + f")::DOUBLE / length({x})"


_WINDOWS = f"v AS (SELECT ord, substr(seq, i, 20) AS w FROM (SELECT ord, seq, unnest(range(1, length(seq) - 18)) AS i FROM t)), worst AS (SELECT ord, round(min({_entropy('w')}), 6) AS e, round(max({_dominance('w')}), 6) AS d FROM v GROUP BY ord)"


@query(f"{R}, t AS (SELECT ord, seq FROM reads), {_WINDOWS}, o AS (SELECT e, d, row_number() OVER (ORDER BY e) - 1 AS i, row_number() OVER (ORDER BY d) - 1 AS j, count(*) OVER () AS n FROM worst) SELECT min(e) FILTER (i = round(0.01 * (n - 1))) AS entropy, min(d) FILTER (j = round(0.99 * (n - 1))) AS dominance FROM o")
def complexity_gates(spark, sf_dir):
    low, high = merge.complexity_gates(reads(spark, sf_dir))
    return spark.createDataFrame([(low, high)], "entropy double, dominance double")


_RUNS = "CASE WHEN ord % 11 = 0 THEN repeat('A', 24) || left(seq, 10) WHEN ord % 13 = 0 THEN repeat('T', 15) ELSE seq END"


@query(f"{R}, t AS (SELECT ord, {_RUNS} AS seq FROM reads), {_WINDOWS} SELECT t.ord, CASE WHEN length(seq) < 20 THEN {_dominance('seq')} >= 0.9 OR {_entropy('seq')} < 0.4 ELSE d >= 0.9 OR e < 0.4 END AS homopolymer FROM t LEFT JOIN worst USING (ord)")
def homopolymers(spark, sf_dir):
    o = F.col("ord")
    s = F.when(o % 11 == 0, F.concat(F.lit("A" * 24), F.left("seq", F.lit(10)))).when(o % 13 == 0, F.lit("T" * 15)).otherwise(F.col("seq"))
    return reads(spark, sf_dir).select("ord", s.alias("seq")).select("ord", merge.homopolymer("seq").alias("homopolymer"))


@query(f"{R}, t AS (SELECT ord, seq || left('{merge.ADAPTER1}', (ord % 20)::INT) AS s FROM reads), c AS (SELECT ord, s, list_filter(range(greatest(0, length(s) - {len(merge.ADAPTER1)} - 5), length(s) - 5), lambda i: hamming(substr(s, i + 1, least({len(merge.ADAPTER1)}, length(s) - i)), left('{merge.ADAPTER1}', least({len(merge.ADAPTER1)}, length(s) - i)::INT)) * 10 <= least({len(merge.ADAPTER1)}, length(s) - i)) AS o FROM t) SELECT ord, CASE WHEN len(o) = 0 THEN s WHEN o[1] < 16 THEN '' ELSE left(s, o[1]::INT) END AS seq FROM c")
def cut_adapter_back(spark, sf_dir):
    s = F.concat("seq", F.left(F.lit(merge.ADAPTER1), (F.col("ord") % 20).cast("int")))
    return reads(spark, sf_dir).select("ord", merge.cut_back(F.struct(s.alias("s"), s.alias("q")), merge.ADAPTER1, merge.Options())["s"].alias("seq"))


_FRONT = "CASE WHEN ord % 5 = 0 THEN 'AGATCGGTAGAG' || seq ELSE seq END"


@query(f"{R}, t AS (SELECT ord, {_FRONT} AS s FROM reads) SELECT ord, CASE WHEN hamming(left(s, 12), '{merge.UNIVERSAL}') > 1 THEN s WHEN length(s) - 12 < 16 THEN '' ELSE substr(s, 13) END AS seq FROM t")
def cut_adapter_front(spark, sf_dir):
    s = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("AGATCGGTAGAG"), "seq")).otherwise(F.col("seq"))
    return reads(spark, sf_dir).select("ord", merge.cut_front(F.struct(s.alias("s"), s.alias("q")), merge.UNIVERSAL, merge.Options())["s"].alias("seq"))


_PIECE = f"CASE WHEN ord % 9 = 0 THEN substr('{merge.ADAPTER1}', (1 + ord % 8)::INT, 20) WHEN ord % 9 = 1 THEN left('{merge.ADAPTER2}', 12) || 'T' || substr('{merge.ADAPTER2}', 13, 8) ELSE seq END"


def _technical(s: str) -> str:
    out = []
    for x in (y for a in (merge.ADAPTER1, merge.ADAPTER2) for y in (a, merge.reverse_complement(a))):
        seed = " OR ".join(f"contains('{x}', substr({s}, {at}, 11))" for at in ("1", f"(length({s}) - 11) // 2 + 1", f"length({s}) - 10"))
        near = f"len(list_filter(flatten([[substr('{x}', i, k) for k in range(greatest(1, length({s}) - 1 - length({s}) // 8), length({s}) + 2 + length({s}) // 8)] for i in range(1, {len(x) + 1})]), lambda y: levenshtein(y, {s}) <= 1 + length({s}) // 8)) > 0"
        out.append(f"(CASE WHEN length({s}) >= 12 AND length({s}) <= {len(x)} + 1 + length({s}) // 8 AND ({seed}) THEN {near} ELSE false END)")
    return " OR ".join(out)


@query(f"{R}, t AS (SELECT ord, {_PIECE} AS s FROM reads) SELECT ord, {_technical('s')} AS technical FROM t")
def technical_reads(spark, sf_dir):
    o, a, b = F.col("ord"), F.lit(merge.ADAPTER1), merge.ADAPTER2
    s = F.when(o % 9 == 0, F.substr(a, (1 + o % 8).cast("int"), F.lit(20))).when(o % 9 == 1, F.lit(b[:12] + "T" + b[12:20])).otherwise(F.col("seq"))
    return reads(spark, sf_dir).select("ord", s.alias("s")).select("ord", merge.technical("s", (merge.ADAPTER1, merge.ADAPTER2)).alias("technical"))


_DIMER = f"CASE WHEN ord % 8 = 0 THEN substr('{merge.ADAPTER1}', (1 + ord % 3)::INT, 25) WHEN ord % 8 = 1 THEN left('{merge.ADAPTER1}', 8) || 'C' || substr('{merge.ADAPTER1}', 9, 20) ELSE seq END"


@query(f"""{R}, t AS (SELECT ord, {_DIMER} AS s FROM reads) SELECT ord, {' OR '.join(f"(length(s) >= {i + 12} AND hamming(rpad(substr(s, {i + 1}, 12), 12, '-'), '{merge.ADAPTER1[j : j + 12]}') <= 2)" for i in range(4) for j in range(4))} OR (CASE WHEN length(s) >= 20 AND instr(left(s, 9), '{merge.ADAPTER1[:6]}') BETWEEN 1 AND 4 THEN len(list_filter(flatten([[substr(s, i, n) for n in range(18, 23)] for i in range(1, 7)]), lambda y: levenshtein(y, '{merge.ADAPTER1[:20]}') <= 2)) > 0 ELSE false END) AS dimer FROM t""")
def adapter_dimers(spark, sf_dir):
    o, a = F.col("ord"), merge.ADAPTER1
    s = F.when(o % 8 == 0, F.substr(F.lit(a), (1 + o % 3).cast("int"), F.lit(25))).when(o % 8 == 1, F.lit(a[:8] + "C" + a[8:28])).otherwise(F.col("seq"))
    return reads(spark, sf_dir).select("ord", s.alias("s")).select("ord", merge.dimer("s", a).alias("dimer"))


@query()
def merge_overlap(spark, sf_dir):
    return merge.merge_pairs(mates(spark, sf_dir))


@query()
def merge_report(spark, sf_dir):
    return merge.merge_report(merge.merge_pairs(mates(spark, sf_dir)))


#: Adapters of a library that is not the usual one.
OWN1, OWN2 = "CTGTCTCTTATACACATCTCCGAGCCCACGAGAC", "CTGTCTCTTATACACATCTGACGCTGCCGACGA"


def through(spark, sf_dir) -> DataFrame:
    """Pairs of 50 bases over inserts of 25 to 55, which read on into adapters of their own."""
    full = reads(spark, sf_dir).filter(F.length("seq") == 60).withColumn("x", F.left("seq", (25 + F.col("ord") % 31).cast("int")))
    one, two = F.left(F.concat("x", F.lit(OWN1)), F.lit(50)), F.left(F.concat(S.revcomp("x"), F.lit(OWN2)), F.lit(50))
    rows = full.select("ord", F.concat(F.lit("@read_"), F.col("ord"), F.lit("/1")).alias("header"), one.alias("seq1"), two.alias("seq2"))
    return rows.select("ord", "header", "seq1", F.repeat(F.lit("I"), F.length("seq1")).alias("qual1"), "seq2", F.repeat(F.lit("I"), F.length("seq2")).alias("qual2"))


@query(f"""{R}, t AS (SELECT ord, left(seq, (25 + ord % 31)::INT) AS x FROM reads WHERE length(seq) = 60), p AS (SELECT ord, substr(left(x || '{OWN1}', 50), length(x) + 1) AS tail FROM t),
g AS (SELECT left(tail, 10) AS seed, count(*) AS reads FROM p WHERE length(tail) >= 10 GROUP BY 1)
SELECT seed, reads, left('{OWN1}', (SELECT max(k) FROM (SELECT length(tail) AS k, count(*) OVER (ORDER BY length(tail) DESC RANGE UNBOUNDED PRECEDING) AS cover FROM p WHERE length(tail) >= 10) WHERE 2 * cover >= reads)::INT) AS construct FROM g WHERE reads >= 100""")
def library_constructs(spark, sf_dir):
    """What follows the inserts of pairs that read through, learned from what the inserts leave."""
    x = (25 + F.col("ord") % 31).cast("int")
    return merge.constructs(through(spark, sf_dir).select(F.substr("seq1", x + 1).alias("tail")))


@query()
def merge_learned(spark, sf_dir):
    """The merge with what the first 20,000 pairs by ordinal teach of their library."""
    return prescan.learn_and_merge(through(spark, sf_dir), first=20_000)[0]
