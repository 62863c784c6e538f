"""Registered queries of the read operators, each with SQL that says the same in another way."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import seq as S
from palimpsest.functions.derived import QUALITY_SQL, quality, rc_sql, reads
from palimpsest.operators import damage, dedup, graph, pairblocks, sorting
from palimpsest.operators.tables import global_rank, shared_folder, written
from palimpsest.sources import fastq
from palimpsest.plans.base import CANON, DAMAGE, ORACLES, QUERIES, RC, R, query

__all__ = ["ORACLES", "QUERIES"]

# ---- Deduplication


@query(f"{R} SELECT {CANON} AS canon, count(*) AS n, sum((seq <= {RC})::INT)::BIGINT AS fwd_n, min(ord) AS rep_ord FROM reads GROUP BY 1")
def dedup_exact(spark, sf_dir):
    return dedup.deduplicate(reads(spark, sf_dir)).select("canon", "n", "fwd_n", "rep_ord")


@query(f"{R} SELECT seq AS canon, count(*) AS n, min(ord) AS rep_ord FROM reads GROUP BY 1")
def dedup_no_revcomp(spark, sf_dir):
    return dedup.deduplicate(reads(spark, sf_dir), both_strands=False).select("canon", "n", "rep_ord")


def _mask_sql(x: str) -> str:
    return f"translate(substr({x}, 1, 2), 'CT', '11') || substr({x}, 3, length({x}) - 4) || translate(right({x}, 2), 'GA', '22')"


_SCORE = "+".join(f"(substr(seq, {p + 1}, 1) = 'T')::INT + (substr(seq, length(seq) - {p}, 1) = 'A')::INT" for p in (0, 1))


@query(f"""{R}, k AS (SELECT ord, seq, least({_mask_sql("seq")}, {_mask_sql(RC)}) AS canon, {_SCORE} AS score FROM reads),
b AS (SELECT canon, ord, row_number() OVER (PARTITION BY canon ORDER BY score DESC, ord) AS nth, count(*) OVER (PARTITION BY canon) AS n, min(ord) OVER (PARTITION BY canon) AS first_ord, score FROM k)
SELECT canon, n, first_ord, ord AS rep_ord, score::INT AS dmg_score FROM b WHERE nth = 1""")
def dedup_masked_manual(spark, sf_dir):
    return dedup.deduplicate(reads(spark, sf_dir), five=2, three=2).select("canon", "n", "first_ord", "rep_ord", "dmg_score")


def pairs_ext(spark, sf_dir):
    full = reads(spark, sf_dir).filter(F.length("seq") == 60)
    return full.select("ord", F.substring("seq", 11, 40).alias("ext"), F.left("seq", (40 + F.col("ord") % 21).cast("int")).alias("non"))


_PAIRS = f"{R}, pairs AS (SELECT ord, substr(seq, 11, 40) AS ext, 40 + ord % 21 AS non_len FROM reads WHERE length(seq) = 60), g AS (SELECT ord, least(ext, {rc_sql('ext')}) AS canon, non_len FROM pairs), w AS (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY non_len DESC, ord) AS nth, count(*) OVER (PARTITION BY canon) AS pair_count FROM g)"


@query(f"{_PAIRS} SELECT canon, pair_count, ord AS rep_ord, non_len::INT AS non_len FROM w WHERE nth = 1")
def dedup_pairs_longest(spark, sf_dir):
    return dedup.deduplicate_pairs(pairs_ext(spark, sf_dir)).select("canon", "pair_count", "rep_ord", "non_len")


@query(f"{_PAIRS} SELECT md5(canon) AS hash, 40 AS ext_len, pair_count, non_len::INT AS non_len FROM w WHERE nth = 1")
def pairs_tsv(spark, sf_dir):
    found = dedup.deduplicate_pairs(pairs_ext(spark, sf_dir))
    return found.select(F.md5("canon").alias("hash"), F.length("canon").alias("ext_len"), "pair_count", "non_len")


@query(f"{R} SELECT md5({CANON}) AS hash, length(seq)::INT AS seq_len, count(*) AS count FROM reads GROUP BY {CANON}, length(seq)")
def cluster_tsv(spark, sf_dir):
    return dedup.cluster_table(dedup.deduplicate(reads(spark, sf_dir)))


@query(f"""{R}, a AS (SELECT ord, 'read_' || ord AS id FROM reads), b AS (SELECT ord, CASE WHEN ord % 7 = 0 THEN 'other_' || ord ELSE 'read_' || ord END AS id FROM reads WHERE ord % 11 <> 0)
SELECT count(*) FILTER (a.ord IS NOT NULL AND b.ord IS NOT NULL) AS n_pairs, count(*) FILTER (b.ord IS NULL) AS left_only, count(*) FILTER (a.ord IS NULL) AS right_only, count(*) FILTER (a.id <> b.id) AS id_mismatch FROM a FULL JOIN b ON a.ord = b.ord""")
def pairs_id_mismatch(spark, sf_dir):
    """The second stream lacks some mates and names others differently; the report counts both."""
    left = reads(spark, sf_dir).withColumn("read_id", F.concat(F.lit("read_"), F.col("ord")))
    other = left.withColumn("read_id", F.when(F.col("ord") % 7 == 0, F.concat(F.lit("other_"), F.col("ord"))).otherwise(F.col("read_id"))).withColumn("_gone", F.col("ord") % 11 == 0)
    return dedup.lockstep_report(dedup.lockstep(left, other.filter("not _gone")))


@query(f"{R} SELECT count(*) FILTER (length(seq) < 40) AS short, count(*) FILTER (length(seq) > 59) AS long, count(*) FILTER (length(seq) BETWEEN 40 AND 59) AS kept FROM reads")
def length_gate_counts(spark, sf_dir):
    n = F.length("seq")
    return reads(spark, sf_dir).agg(F.count_if(n < 40).alias("short"), F.count_if(n > 59).alias("long"), F.count_if((n >= 40) & (n <= 59)).alias("kept"))


@query(f"{R}, f AS (SELECT seq, min(ord) AS ord FROM reads GROUP BY 1), p AS (SELECT seq, count(*) AS n FROM reads GROUP BY 1 HAVING count(*) > 1) SELECT r.ord, CASE WHEN r.ord = f.ord THEN coalesce(p.n, 1) ELSE 1 END AS weight FROM reads r JOIN f USING (seq) LEFT JOIN p USING (seq)")
def prior_counts(spark, sf_dir):
    rows = reads(spark, sf_dir)
    prior = rows.groupBy("seq").agg(F.count("*").alias("n_members"))
    return dedup.with_prior_counts(rows, prior).select("ord", "weight")


# ---- Order and set operations


def named(spark, sf_dir):
    return reads(spark, sf_dir).select("ord", F.concat(F.when(F.col("ord") % 3 == 0, "read_").otherwise("r"), F.when(F.col("ord") % 5 == 0, "").otherwise((F.col("ord") % 1000).cast("string"))).alias("read_id"))


_NAMED = f"{R}, named AS (SELECT ord, CASE WHEN ord % 3 = 0 THEN 'read_' ELSE 'r' END || CASE WHEN ord % 5 = 0 THEN '' ELSE (ord % 1000)::VARCHAR END AS read_id FROM reads)"


@query(f"{_NAMED} SELECT ord, read_id, row_number() OVER (ORDER BY read_id, ord) AS rank FROM named")
def sort_lex(spark, sf_dir):
    return global_rank(named(spark, sf_dir), *sorting.lexical())


@query(f"{_NAMED} SELECT ord, read_id, row_number() OVER (ORDER BY regexp_replace(read_id, '[0-9]+$', ''), regexp_extract(read_id, '[0-9]+$') <> '', try_cast(regexp_extract(read_id, '[0-9]+$') AS HUGEINT) NULLS FIRST, ord) AS rank FROM named")
def sort_natural(spark, sf_dir):
    return global_rank(named(spark, sf_dir), *sorting.natural())


@query(f"{R}, lanes AS (SELECT 0::BIGINT << 60 | ord AS ord, seq FROM reads UNION ALL SELECT 1::BIGINT << 60 | ord, {RC} FROM reads) SELECT {CANON} AS canon, count(*) AS n, min(ord) AS first_ord FROM lanes GROUP BY 1")
def union_lanes(spark, sf_dir):
    one = reads(spark, sf_dir).select("ord", "seq")
    two = one.select((F.col("ord") + F.lit(1 << 60)).alias("ord"), S.revcomp("seq").alias("seq"))
    return dedup.deduplicate(one.unionByName(two)).select("canon", "n", "first_ord")


# ---- Scalar functions


@query(f"{R} SELECT ord, {RC} AS rc, seq <= {RC} AS forward, reverse({QUALITY_SQL}) AS rc_qual FROM reads")
def revcomp(spark, sf_dir):
    rows = reads(spark, sf_dir)
    return rows.select("ord", S.revcomp("seq").alias("rc"), S.is_forward("seq").alias("forward"), F.reverse(quality()).alias("rc_qual"))


def _count_sql(b: str, x: str = "seq") -> str:
    return f"(length({x}) - length(replace({x}, '{b}', '')))"


def _entropy_sql(x: str = "seq") -> str:
    return "(0.0 " + " ".join(f"- CASE WHEN {_count_sql(b, x)} > 0 THEN {_count_sql(b, x)}::DOUBLE / length({x}) * log2({_count_sql(b, x)}::DOUBLE / length({x})) ELSE 0 END" for b in "ACGT") + ")"


def _dominance_sql(x: str = "seq") -> str:
    return f"greatest({', '.join(_count_sql(b, x) for b in 'ACGT')})::DOUBLE / length({x})"


@query(f"{R} SELECT ord, round({_entropy_sql()}, 6) AS entropy, round({_dominance_sql()}, 6) AS dominance, (({_count_sql('G')} + {_count_sql('C')})::DOUBLE / length(seq)) AS gc FROM reads")
def gc_entropy(spark, sf_dir):
    gc = (S.base_count("seq", "G") + S.base_count("seq", "C")) / F.length("seq")
    return reads(spark, sf_dir).select("ord", F.round(S.entropy("seq"), 6).alias("entropy"), F.round(S.dominance("seq"), 6).alias("dominance"), gc.alias("gc"))


@query(f"{R}, w AS (SELECT ord, substr(seq, i, 20) AS win FROM (SELECT ord, seq, unnest(range(1, length(seq) - 18)) AS i FROM reads)) SELECT ord, round(min({_entropy_sql('win')}), 6) AS entropy, round(max({_dominance_sql('win')}), 6) AS dominance FROM w GROUP BY ord")
def worst_window(spark, sf_dir):
    found = reads(spark, sf_dir).select("ord", pairblocks.worst_windows("seq").alias("w"))
    return found.select("ord", F.round("w.entropy", 6).alias("entropy"), F.round("w.dominance", 6).alias("dominance"))


@query(f"{R} SELECT ord, len(list_distinct([substr(seq, i, 4) for i in range(1, length(seq) - 2)]))::INT AS kmers4, len(list_distinct([substr(seq, i, 2) for i in range(1, length(seq))]))::INT AS dimers FROM reads")
def complexity(spark, sf_dir):
    return reads(spark, sf_dir).select("ord", S.distinct_kmers("seq", 4).alias("kmers4"), S.distinct_kmers("seq", 2).alias("dimers"))


@query(f"{R} SELECT {{'head': left(seq, 12), 'tail': right(seq, 12), 'size': length(seq)}}::VARCHAR AS bundle, count(*) AS n, count(DISTINCT {CANON}) AS clusters FROM reads GROUP BY left(seq, 12), right(seq, 12), length(seq)")
def bundle_keys(spark, sf_dir):
    rows = reads(spark, sf_dir).select(S.bundle("seq").alias("b"), S.canonical("seq").alias("canon"))
    text = F.concat(F.lit("{'head': "), F.col("b.head"), F.lit(", 'tail': "), F.col("b.tail"), F.lit(", 'size': "), F.col("b.size"), F.lit("}"))
    return rows.groupBy("b").agg(F.count("*").alias("n"), F.count_distinct("canon").alias("clusters")).select(text.alias("bundle"), "n", "clusters")


@query(f"{R}, t AS (SELECT ord, seq, sum((q)::INT) AS total FROM (SELECT ord, seq, unnest([ascii(x) - 33 for x in string_split({QUALITY_SQL}, '')]) AS q FROM reads) GROUP BY ord, seq) SELECT (total // 100)::BIGINT AS bin, count(*) AS n, round(sum(ln(pow(10, -(greatest(1, least(60, total % 70))) / 10.0) / 3)), 3) AS log_error FROM t GROUP BY 1")
def phred_errors(spark, sf_dir):
    q = F.aggregate(F.transform(F.split(quality(), ""), lambda x: F.ascii(x) - 33), F.lit(0), lambda a, x: a + F.when(x >= 0, x).otherwise(0))
    rows = reads(spark, sf_dir).select(q.alias("total"))
    return rows.groupBy(F.expr("total div 100").alias("bin")).agg(F.count("*").alias("n"), F.round(F.sum(S.log_error_third(S.phred(F.char(33 + F.col("total") % 70)))), 3).alias("log_error"))


@query(f"""{R}, p AS (SELECT a.seq AS a, b.seq AS b FROM reads a JOIN reads b ON b.ord = a.ord + 1 WHERE length(a.seq) = length(b.seq)) SELECT a, b, hamming(a, b)::INT AS h, least(3, levenshtein(a, b))::INT AS edits FROM p GROUP BY a, b""")
def neighbour_distances(spark, sf_dir):
    """Each read of a document against the next one of its length."""
    rows = reads(spark, sf_dir)
    nxt = rows.select((F.col("ord") - 1).alias("ord"), F.col("seq").alias("b"))
    pairs = rows.select("ord", F.col("seq").alias("a")).join(nxt, "ord").filter(F.length("a") == F.length("b")).select("a", "b").distinct()
    edits = F.levenshtein("a", "b", 2)
    return pairs.select("a", "b", S.hamming("a", "b").alias("h"), F.when(edits < 0, 3).otherwise(edits).alias("edits"))


@query(f"{R}, q AS (SELECT ord, length(seq) AS n, seq FROM reads) SELECT ord, substr(seq, 1, n // 4) AS a, substr(seq, n // 4 + 1, n * 2 // 4 - n // 4) AS b, substr(seq, n * 2 // 4 + 1, n * 3 // 4 - n * 2 // 4) AS c, substr(seq, n * 3 // 4 + 1) AS d FROM q")
def four_parts(spark, sf_dir):
    return reads(spark, sf_dir).select("ord", *[x.alias(n) for x, n in zip(S.quarters("seq"), "abcd", strict=True)])


_ADAPTER = "AGATCGGAAGAGC"


@query(f"{R}, t AS (SELECT ord, CASE ord % 6 WHEN 0 THEN seq ELSE seq || left('{_ADAPTER}', (ord % 6)::INT) END AS seq FROM reads) SELECT ord, CASE {' '.join(f'''WHEN right(seq, {t}) = '{_ADAPTER[:t]}' THEN {t}''' for t in range(5, 0, -1))} ELSE 0 END AS tail FROM t")
def adapter_tails(spark, sf_dir):
    cut = F.concat("seq", F.left(F.lit(_ADAPTER), (F.col("ord") % 6).cast("int")))
    return reads(spark, sf_dir).select("ord", S.adapter_tail(cut, _ADAPTER).alias("tail"))


@query(f"{R}, t AS (SELECT ord, CASE WHEN ord % 7 = 0 THEN seq || repeat('G', 12) ELSE seq END AS seq FROM reads) SELECT ord, regexp_replace(seq, 'G{{10,}}$', '') AS seq FROM t")
def polyg_trim(spark, sf_dir):
    cut = F.when(F.col("ord") % 7 == 0, F.concat("seq", F.lit("G" * 12))).otherwise(F.col("seq"))
    return reads(spark, sf_dir).select("ord", S.trim_run(cut).alias("seq"))


@query(f"{R}, t AS (SELECT ord, CASE WHEN ord % 10 = 0 THEN 'CTCTTC' || seq || repeat('TTTCCC', 2) ELSE seq END AS seq FROM reads) SELECT ord, regexp_replace(regexp_replace(seq, '^CTCTTC', ''), '(TTTCCC)+$', '') AS seq FROM t")
def stub_clip(spark, sf_dir):
    cut = F.when(F.col("ord") % 10 == 0, F.concat(F.lit("CTCTTC"), "seq", F.lit("TTTCCC" * 2))).otherwise(F.col("seq"))
    return reads(spark, sf_dir).select("ord", S.clip_stubs(cut, ["CTCTTC"], ["TTTCCC"]).alias("seq"))


@query(f"{R}, t AS (SELECT ord, CASE WHEN ord % 10 = 0 THEN 'CTCTTC' || seq ELSE seq END AS seq FROM reads) SELECT count(*) AS n, avg((starts_with(seq, 'CTCTTC'))::INT) AS five, avg((ends_with(seq, 'TTTCCC'))::INT) AS three FROM t")
def stub_fraction(spark, sf_dir):
    cut = F.when(F.col("ord") % 10 == 0, F.concat(F.lit("CTCTTC"), "seq")).otherwise(F.col("seq"))
    return reads(spark, sf_dir).select(cut.alias("seq")).agg(F.count("*").alias("n"), F.avg(F.startswith("seq", F.lit("CTCTTC")).cast("int")).alias("five"), F.avg(F.endswith("seq", F.lit("TTTCCC")).cast("int")).alias("three"))


@query(f"{R} SELECT ord, ord % 100 AS k, round((p + 3.8416 / 200 - 1.96 * sqrt((p * (1 - p) + 3.8416 / 400) / 100)) / 1.038416, 6) AS lower FROM (SELECT ord, (ord % 100) / 100.0 AS p FROM reads)")
def wilson_bounds(spark, sf_dir):
    k = F.col("ord") % 100
    return reads(spark, sf_dir).select("ord", k.alias("k"), F.round(S.wilson_lower(k, F.lit(100.0)), 6).alias("lower"))


_AT = " + ".join(f"length(seq) * 0 + CASE WHEN substr(seq, {p + 1}, 1) IN ('C', 'T') THEN round(greatest(0.2 * exp(-0.35 * {p}), 0.2 * exp(-0.35 * (length(seq) - 1 - {p}))), 9) ELSE 0 END" for p in range(5))


@query(f"{R} SELECT length(seq)::INT AS size, count(*) AS n, round(sum({_AT}), 3) AS damage FROM reads GROUP BY 1")
def damage_weights(spark, sf_dir):
    n = F.length("seq")
    total = sum((F.when(S.part(F.col("seq"), p + 1, 1).isin("C", "T"), F.round(S.damage_probability(F.lit(p), n, 0.2, 0.35, 0.2, 0.35), 9)).otherwise(0.0) for p in range(5)), F.lit(0.0))
    return reads(spark, sf_dir).select(n.alias("size"), total.alias("d")).groupBy("size").agg(F.count("*").alias("n"), F.round(F.sum("d"), 3).alias("damage"))


# ---- Count tables


@query(f"""{R}, k AS (SELECT substr(seq, i, 17) AS kmer, CASE WHEN i > 1 THEN substr(seq, i - 1, 1) END AS before, nullif(substr(seq, i + 17, 1), '') AS after FROM (SELECT seq, unnest(range(1, length(seq) - 15)) AS i FROM reads)),
g AS (SELECT *, {rc_sql('kmer')} AS rc, translate(before, 'ACGT', 'TGCA') AS back FROM k WHERE len(list_distinct([substr(kmer, j, 2) for j in range(1, 17)])) >= 3),
o AS (SELECT least(kmer, rc) AS canon, CASE WHEN kmer <= rc THEN after ELSE back END AS f, CASE WHEN kmer <= rc THEN back ELSE after END AS r FROM g)
SELECT canon, {', '.join(f"least(255, count(*) FILTER ({c} = '{b}'))::INT AS {c}_{b}" for c in 'fr' for b in 'ACGT')} FROM o GROUP BY canon""")
def kmer_edges(spark, sf_dir):
    return graph.kmer_edges(reads(spark, sf_dir))


@query(f"{R} SELECT 'five' AS place, left(seq, 6) AS hexamer, count(*) AS n FROM reads GROUP BY ALL UNION ALL SELECT 'three', right(seq, 6), count(*) FROM reads GROUP BY ALL UNION ALL SELECT 'inner', substr(seq, length(seq) // 2 - 2, 6), count(*) FROM reads GROUP BY ALL")
def hexamer_counts(spark, sf_dir):
    return damage.hexamers(reads(spark, sf_dir))


@query(f"{R}, p AS (SELECT pos, substr(seq, pos + 1, 1) AS five, substr(seq, length(seq) - pos, 1) AS three FROM (SELECT seq, unnest(range(0, 15)) AS pos FROM reads)) SELECT pos::INT AS pos, count(*) FILTER (five = 'T') AS t5, count(*) FILTER (five = 'C') AS c5, count(*) FILTER (three = 'A') AS a3, count(*) FILTER (three = 'G') AS g3, count(*) AS n FROM p GROUP BY 1")
def terminal_counts(spark, sf_dir):
    return damage.terminal_counts(reads(spark, sf_dir))


@query(f"{R} SELECT greatest(0, least(19, floor((ln(length(seq)) - ln(30.0)) / ((ln(501.0) - ln(30.0)) / 20))))::INT AS bin, count(*) AS n, min(length(seq))::INT AS low, max(length(seq))::INT AS high FROM reads GROUP BY 1")
def length_hist(spark, sf_dir):
    return damage.length_histogram(reads(spark, sf_dir))


_CELLS = f"{R}, cells AS (SELECT greatest(0, least(4, floor((ln(length(seq)) - ln(30.0)) / ((ln(501.0) - ln(30.0)) / 5))))::INT AS bin, (left(seq, 1) = 'T')::INT AS u5, (right(seq, 1) = 'A')::INT AS u3, (substr(seq, 12, 1) = 'T')::INT AS v5, (substr(seq, length(seq) - 11, 1) = 'A')::INT AS v3 FROM reads)"


@query(f"{_CELLS} SELECT bin, u5, u3, v5, v3, count(*) AS n FROM cells GROUP BY ALL")
def joint_end_cells(spark, sf_dir):
    return damage.joint_cells(reads(spark, sf_dir))


@query(f"{_CELLS} SELECT bin, count(*) AS n, round(covar_pop(u5, u3) - covar_pop(v5, v3), 9) AS contrast, round(sqrt((avg(u5) * (1 - avg(u5)) * avg(u3) * (1 - avg(u3)) + avg(v5) * (1 - avg(v5)) * avg(v3) * (1 - avg(v3))) / count(*)), 9) AS se FROM cells GROUP BY bin")
def cov_contrast(spark, sf_dir):
    found = damage.covariance_contrast(damage.joint_cells(reads(spark, sf_dir)))
    return found.select("bin", "n", F.round("contrast", 9).alias("contrast"), F.round("se", 9).alias("se"))


@query(f"{R}, p AS (SELECT greatest(0, least(4, floor((ln(length(seq)) - ln(30.0)) / ((ln(501.0) - ln(30.0)) / 5))))::INT AS bin, pos, substr(seq, pos + 1, 1) AS b, substr(seq, pos + 2, 1) AS a FROM (SELECT seq, unnest(range(0, 15)) AS pos FROM reads)) SELECT bin, pos::INT AS pos, count(*) FILTER (b = 'T') AS t, count(*) FILTER (b = 'C') AS c, count(*) FILTER (b = 'T' AND a = 'G') AS cpg_t, count(*) FILTER (b = 'C' AND a = 'G') AS cpg_c, count(*) AS n FROM p GROUP BY 1, 2")
def length_strata(spark, sf_dir):
    return damage.stratified(reads(spark, sf_dir))


@query(f"{R} SELECT translate(left(seq, 10), 'TCAG', '10..') AS five, translate(reverse(right(seq, 10)), 'AGTC', '10..') AS three, count(*) AS n FROM reads WHERE length(seq) >= 20 GROUP BY ALL")
def end_signatures(spark, sf_dir):
    return damage.signatures(reads(spark, sf_dir))


@query(f"{R}, i AS (SELECT least(9, floor(({_count_sql('G')} + {_count_sql('C')}) * 10 / length(seq)))::INT AS gc, substr(seq, 11, length(seq) - 20) AS x FROM reads), s AS (SELECT gc, {', '.join(f'sum({_count_sql(b, chr(120))})::BIGINT AS {b.lower()}' for b in 'TGCA')} FROM i GROUP BY gc) SELECT gc, t, g, c, a, CASE WHEN t + g >= 500 AND a + c >= 500 THEN round(t / (t + g) - a / (a + c), 9) END AS d FROM s")
def oxidation_bins(spark, sf_dir):
    return damage.oxidation(reads(spark, sf_dir)).withColumn("d", F.round("d", 9))


@query(f"{R} SELECT count(*) AS n, avg(length(seq)) AS mean, min(length(seq))::INT AS low, max(length(seq))::INT AS high, avg((length(seq) < 60)::INT) AS short_share FROM reads")
def length_stats(spark, sf_dir):
    n = F.length("seq")
    return reads(spark, sf_dir).agg(F.count("*").alias("n"), F.avg(n).alias("mean"), F.min(n).alias("low"), F.max(n).alias("high"), F.avg((n < 60).cast("int")).alias("short_share"))


_VALUES = f"{R}, v AS (SELECT doc_id, count(*) AS x FROM reads GROUP BY 1), o AS (SELECT x, row_number() OVER (ORDER BY x, doc_id) - 1 AS i, count(*) OVER () AS n FROM v)"


@query(f"{_VALUES} SELECT min(x) FILTER (i = round(0.01 * (n - 1))) AS low, min(x) FILTER (i = round(0.99 * (n - 1))) AS high, min(x) FILTER (i = n // 2) AS median, min(x) FILTER (i = least(n - 1, floor(0.99 * n))) AS p99 FROM o")
def index_quantiles(spark, sf_dir):
    """Quantiles by sorted index, not interpolated, from the counts of distinct values."""
    values = reads(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("x")).groupBy("x").agg(F.count("*").alias("c"))
    upto = values.withColumn("to", F.sum("c").over(Window.orderBy("x")))  # a row for each distinct value
    n = values.agg(F.sum("c").alias("n"))
    at = lambda i: F.min(F.when(F.col("to") > i, F.col("x")))
    m = F.col("n")
    return upto.crossJoin(F.broadcast(n)).agg(at(F.round(0.01 * (m - 1))).alias("low"), at(F.round(0.99 * (m - 1))).alias("high"), at(F.floor(m / 2)).alias("median"), at(F.least(m - 1, F.floor(0.99 * m))).alias("p99"))


@query(f"{_VALUES}, m AS (SELECT min(x) FILTER (i = n // 2) AS median FROM o), d AS (SELECT abs(x - median) AS y FROM v, m), e AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS i, count(*) OVER () AS n FROM d) SELECT (SELECT median FROM m) AS median, round(1.4826 * min(y) FILTER (i = n // 2), 6) AS mad FROM e")
def robust_spread(spark, sf_dir):
    values = reads(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("x"))

    def upper_median(rows: DataFrame, c: str) -> DataFrame:
        counted = rows.groupBy(c).agg(F.count("*").alias("k"))
        upto = counted.withColumn("to", F.sum("k").over(Window.orderBy(c)))
        return upto.crossJoin(F.broadcast(counted.agg(F.sum("k").alias("n")))).filter(F.col("to") > F.floor(F.col("n") / 2)).agg(F.min(c).alias("m"))

    middle = upper_median(values, "x")
    off = values.crossJoin(F.broadcast(middle)).select(F.abs(F.col("x") - F.col("m")).alias("y"))
    return middle.select(F.col("m").alias("median")).crossJoin(F.broadcast(upper_median(off, "y").select(F.round(1.4826 * F.col("m"), 6).alias("mad"))))


@query(f"{R}, k AS (SELECT left(seq, 12) AS kmer, count(*) AS n FROM reads GROUP BY 1) SELECT kmer, n, n * 20 >= (SELECT count(*) FROM reads) AS linker FROM k ORDER BY n DESC, kmer DESC LIMIT 1")
def top_kmer(spark, sf_dir):
    counts = reads(spark, sf_dir).groupBy(F.left("seq", F.lit(12)).alias("kmer")).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("kmer", F.struct("n", "kmer")).alias("kmer"), F.max("n").alias("n"), F.sum("n").alias("t")).select("kmer", "n", (F.col("n") * 20 >= F.col("t")).alias("linker"))


@query(f"{R}, c AS (SELECT doc_id, p, substr(seq, p, 1) AS b, count(*) AS n FROM (SELECT doc_id, seq, unnest(range(1, length(seq) + 1)) AS p FROM reads) GROUP BY ALL), m AS (SELECT doc_id, p, arg_max(b, n * 256 + ascii(b)) AS b FROM c GROUP BY ALL) SELECT doc_id, string_agg(b, '' ORDER BY p) AS consensus FROM m GROUP BY 1")
def majority_consensus(spark, sf_dir):
    """The most frequent base of each place over the reads of a document."""
    calls = reads(spark, sf_dir).select("doc_id", F.posexplode(F.split("seq", "")).alias("p", "b")).filter("b <> ''").groupBy("doc_id", "p", "b").agg(F.count("*").alias("n"))
    best = calls.groupBy("doc_id", "p").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "b"))), lambda x: x["b"]), "")
    return best.groupBy("doc_id").agg(line.alias("consensus"))


@query(f"{R}, c AS (SELECT {CANON} AS canon, count(*) AS n FROM reads GROUP BY 1) SELECT sum(n)::BIGINT AS total, count(*) AS uniques, round(log2(sum(n) / count(*)), 6) AS d_eff FROM c")
def duplication(spark, sf_dir):
    found = dedup.deduplicate(reads(spark, sf_dir)).agg(F.sum("n").alias("total"), F.count("*").alias("uniques"))
    return found.select("total", "uniques", F.round(F.log2(F.col("total") / F.col("uniques")), 6).alias("d_eff"))


# ---- Damage scores


def _llr_sql() -> str:
    terms = []
    for end in (5, 3):
        for p in range(5):
            pd = 0.25 + 0.75 * 0.20 * math.exp(-0.35 * p)
            base = f"substr(seq, {p + 1}, 1)" if end == 5 else f"substr(seq, length(seq) - {p}, 1)"
            hit, ref = ("T", "C") if end == 5 else ("A", "G")
            terms.append(f"CASE {base} WHEN '{hit}' THEN {math.log(pd / 0.25)!r} WHEN '{ref}' THEN {math.log((1 - pd) / 0.75)!r} ELSE 0 END")
    return " + ".join(terms)


_LLR = f"{R}, scored AS (SELECT ord, seq, {_llr_sql()} AS llr FROM reads)"


@query(f"{_LLR} SELECT ord, round(llr, 6) AS llr, CASE WHEN llr >= 0.1 THEN 'damaged' ELSE 'undamaged' END AS route FROM scored")
def llr_split(spark, sf_dir):
    return damage.split_reads(reads(spark, sf_dir), DAMAGE, 0.1).select("ord", F.round("llr", 6).alias("llr"), "route")


@query(f"{_LLR}, h AS (SELECT floor((llr + 0.0051 + 100) * 100)::INT AS bin, count(*) AS n FROM scored GROUP BY 1), t AS (SELECT bin, sum(n) OVER (ORDER BY bin DESC) AS tail, (SELECT sum(n) FROM h) AS total FROM h) SELECT max(bin) AS bin FROM t WHERE tail >= 0.2 * total")
def tail_quantile(spark, sf_dir):
    scored = reads(spark, sf_dir).withColumn("llr", damage.llr("seq", DAMAGE) + 0.0051)
    return damage.tail_cut(damage.score_histogram(scored), 0.2).select("bin")


@query(f"{_LLR} SELECT count(*) AS n, round(avg(1 / (1 + exp(-(llr + {math.log(0.3 / 0.7)!r})))), 6) AS fraction FROM scored")
def posterior_fraction(spark, sf_dir):
    scored = damage.split_reads(reads(spark, sf_dir), DAMAGE)
    return damage.weighted_fraction(scored, 0.3).select("n", F.round("fraction", 6).alias("fraction"))


# ---- Pairs and graph


@query()
def extend_walk(spark, sf_dir):
    rows = reads(spark, sf_dir).select("ord", "seq")
    return graph.extend(rows, written(graph.kmer_edges(rows), "graph"), spend=True).select("ord", "left", "right", F.length("extended").alias("size"))


@query()
def damage_profile(spark, sf_dir):
    """The fitted profile of all reads in one row."""
    p = damage.fit_profile(reads(spark, sf_dir))
    return spark.createDataFrame([(p.d5, p.l5, p.d3, p.l3, p.bg5, p.bg3, list(p.mask))], "d5 double, l5 double, d3 double, l3 double, bg5 double, bg3 double, mask array<boolean>")


@query()
def stub_detection(spark, sf_dir):
    stubbed = reads(spark, sf_dir).withColumn("seq", F.when(F.col("ord") % 10 == 0, F.concat(F.lit("CTCTTC"), "seq")).otherwise(F.col("seq")))
    return damage.enriched_stubs(damage.hexamers(stubbed))


# ---- More scalar functions


_NEXT_READ = f"{R}, p AS (SELECT DISTINCT a.seq AS a, b.seq AS b FROM reads a JOIN reads b ON b.ord = a.ord + 1 WHERE length(a.seq) = length(b.seq))"


def neighbours(spark, sf_dir):
    rows = reads(spark, sf_dir)
    nxt = rows.select((F.col("ord") - 1).alias("ord"), F.col("seq").alias("b"))
    return rows.select("ord", F.col("seq").alias("a")).join(nxt, "ord").filter(F.length("a") == F.length("b")).select("a", "b").distinct()


@query(f"{_NEXT_READ}, m AS (SELECT a, b, list_filter(range(0, length(a)), lambda i: substr(a, i + 1, 1) <> substr(b, i + 1, 1)) AS o FROM p) SELECT a, b, least(length(a) * 0 + hamming(a, b), 9)::INT AS capped, CASE WHEN len(o) <= 40 THEN array_to_string([i::VARCHAR || substr(a, i + 1, 1) || substr(b, i + 1, 1) for i in o], ',') END AS changes FROM m")
def first_mismatches(spark, sf_dir):
    changes = F.array_join(F.transform(S.first_mismatches("a", "b", 40), lambda m: F.concat(m["pos"].cast("string"), m["a"], m["b"])), ",")
    return neighbours(spark, sf_dir).select("a", "b", S.hamming_capped("a", "b", 8).alias("capped"), changes.alias("changes"))


@query(f"{R} SELECT ord, least(40, length(seq))::INT AS five, least(35, length(seq) - least(40, length(seq)))::INT AS three FROM reads")
def zone_sizes(spark, sf_dir):
    five, three = S.zones("seq", 40, 35)
    return reads(spark, sf_dir).select("ord", five.alias("five"), three.alias("three"))


@query(f"{R}, k AS (SELECT ord, length(seq) AS n, length(seq) - length(replace(seq, 'G', '')) AS k FROM reads) SELECT ord, round(2 * ((CASE WHEN k > 0 THEN k * ln(k / n / 0.25) ELSE 0 END) + (CASE WHEN n - k > 0 THEN (n - k) * ln((1 - k / n) / 0.75) ELSE 0 END)), 6) AS lrt FROM k")
def binomial_lrt(spark, sf_dir):
    return reads(spark, sf_dir).select("ord", F.round(S.binomial_lrt(S.base_count("seq", "G"), F.length("seq"), 0.25), 6).alias("lrt"))


@query(f"{R}, c AS (SELECT ord, left(seq, 1) AS b1, CASE WHEN ord % 5 = 0 THEN 'N' ELSE right(seq, 1) END AS b2, (ord % 37 + 2)::INT AS q1, (ord % 31 + 2)::INT AS q2 FROM reads) SELECT ord, CASE WHEN b1 = b2 OR b2 = 'N' THEN b1 WHEN q1 >= q2 THEN b1 ELSE b2 END AS base, CASE WHEN b1 = b2 OR b2 = 'N' THEN least(q1 + q2, 60) ELSE greatest(abs(q1 - q2), 1) END AS q FROM c")
def consensus_calls(spark, sf_dir):
    o = F.col("ord")
    b2 = F.when(o % 5 == 0, "N").otherwise(F.right("seq", F.lit(1)))
    found = S.agreed(F.left("seq", F.lit(1)), (o % 37 + 2).cast("int"), b2, (o % 31 + 2).cast("int"))
    return reads(spark, sf_dir).select("ord", found["base"].alias("base"), found["q"].alias("q"))


@query(f"{R} SELECT ord, length(seq)::INT AS size FROM reads WHERE ord < 50 * 1048576 AND length(seq) BETWEEN 40 AND 59")
def gated_head(spark, sf_dir):
    """Reads of the first fifty documents by ordinal whose length is within bounds."""
    return dedup.length_gate(dedup.head(reads(spark, sf_dir), 50 << 20), 40, 59).select("ord", F.length("seq").alias("size"))


@query(f"{R}, c AS (SELECT greatest(0, least(4, floor((ln(length(seq)) - ln(30.0)) / ((ln(501.0) - ln(30.0)) / 5))))::INT AS bin, translate(left(seq, 6), 'TACGN', '10000') AS five, reverse(right(seq, 6)) AS back FROM reads) SELECT bin, 'ds' AS channel, five, translate(back, 'ATCGN', '10000') AS three, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT bin, 'ss', five, translate(back, 'TACGN', '10000'), count(*) FROM c GROUP BY ALL")
def joint_codes(spark, sf_dir):
    return damage.joint_codes(reads(spark, sf_dir))


# ---- Files


def named_reads(spark, sf_dir):
    return reads(spark, sf_dir).select("ord", F.concat(F.lit("@read_"), "ord").alias("header"), "seq", F.lit("+").alias("plus"), quality().alias("qual"))


def filed(spark, rows: DataFrame, ending: str = "") -> DataFrame:
    """rows, written as FASTQ to the shared folder and read back."""
    folder = f"{shared_folder(spark)}/fastq-{uuid.uuid4().hex}{ending}"
    fastq.write_fastq(rows, folder)
    return fastq.read_fastq(spark, *fastq.parts_of(spark, folder))


_FILED = f"{R} SELECT 'read_' || ord AS read_id, seq, {QUALITY_SQL} AS qual, row_number() OVER (ORDER BY ord) AS rank FROM reads"


@query(_FILED)
def fastq_plain(spark, sf_dir):
    return global_rank(filed(spark, named_reads(spark, sf_dir)), F.col("ord")).select("read_id", "seq", "qual", "rank")


@query(_FILED)
def fastq_gzip(spark, sf_dir):
    return global_rank(filed(spark, named_reads(spark, sf_dir), ".fq.gz"), F.col("ord")).select("read_id", "seq", "qual", "rank")


@query(f"{R} SELECT '@read_' || ord AS header, seq AS seq1, {RC} AS seq2 FROM reads")
def fastq_pairs(spark, sf_dir):
    """Mates by position in two streams of one order."""
    first = named_reads(spark, sf_dir)
    other = first.withColumn("seq", S.revcomp("seq"))
    return fastq.paired(filed(spark, first), filed(spark, other)).select("header", "seq1", "seq2")


from palimpsest.plans import correction, estimates, pairs, profiles  # noqa: E402, F401
