"""Registered queries of error correction and of the cluster store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import seq as S
from palimpsest.functions.derived import quality, rc_sql, reads
from palimpsest.functions.sketch import syncmer_hashes
from palimpsest.operators import dedup, errors, indels, store
from palimpsest.operators.damage import Profile
from palimpsest.operators.tables import written
from palimpsest.plans.base import CANON, CLUSTERS, R, clusters, kept, molecules, query, with_qualities

_THIRDS = "unnest([{'t': 1, 'k': substr(s, 1, size // 3)}, {'t': 2, 'k': substr(s, size // 3 + 1, size // 3)}, {'t': 3, 'k': substr(s, 2 * (size // 3) + 1)}]) AS key"
_DAMAGED = "((m.a || m.b IN ('CT', 'TC') AND m.pos < 5) OR (m.a || m.b IN ('GA', 'AG') AND m.pos >= size - 5))"
_EDGES = f"""{CLUSTERS},
fit AS (SELECT canon, n, length(canon) AS size FROM clusters),
turned AS (SELECT canon AS child, n AS n_child, size, 0 AS turned, canon AS s FROM fit UNION ALL SELECT canon, n, size, 1, {rc_sql('canon')} FROM fit),
thirds AS (SELECT *, {_THIRDS} FROM turned),
homes AS (SELECT canon AS parent, n AS n_parent, size, {_THIRDS.replace('substr(s,', 'substr(canon,')} FROM fit),
met AS (SELECT DISTINCT parent, child, n_parent, n_child, turned, s FROM thirds JOIN homes USING (size, key) WHERE n_parent > n_child OR (n_parent = n_child AND parent < child)),
near AS (SELECT met.*, CASE WHEN turned = 1 THEN reverse(qual) ELSE qual END AS cq, hamming(parent, s) AS h, list_filter(range(1, length(s) + 1), lambda i: substr(parent, i, 1) <> substr(s, i, 1)) AS places FROM met JOIN clusters ON canon = child WHERE hamming(parent, s) BETWEEN 1 AND 2),
mm AS MATERIALIZED (SELECT *, [{{'pos': i - 1, 'a': substr(parent, i, 1), 'b': substr(s, i, 1), 'q': ascii(substr(cq, i::INT, 1)) - 33}} for i in places] AS mm, length(parent) AS size FROM near),
good AS (SELECT *, row_number() OVER (PARTITION BY parent, child ORDER BY h, turned) AS nth FROM mm WHERE (h = 1 AND mm[1].a || mm[1].b IN ('AT', 'TA', 'CG', 'GC'))
  OR (h = 2 AND n_child <= 2 AND len(list_filter(mm, lambda m: {_DAMAGED})) = 0)),
edges AS MATERIALIZED (SELECT parent, child, n_parent, n_child, h::INT AS h, mm, size FROM good WHERE nth = 1)"""
_SINGLES = f"""{_EDGES},
alone AS (SELECT *, row_number() OVER (PARTITION BY parent, child ORDER BY turned) AS nth FROM mm WHERE h = 1),
singles AS (SELECT parent, child, n_parent, n_child, size, mm[1] AS m FROM alone WHERE nth = 1 AND len(list_filter(mm, lambda m: {_DAMAGED})) = 0)"""


def found_clusters(spark, sf_dir) -> DataFrame:
    return with_qualities(kept(spark, sf_dir, "clusters", lambda: molecules(spark, sf_dir)))


def found_pairs(spark, sf_dir) -> DataFrame:
    return kept(spark, sf_dir, "close-pairs", lambda: errors.close_pairs(found_clusters(spark, sf_dir)), table=True)


def tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Clusters and candidate edges, kept as tables."""
    held = found_clusters(spark, sf_dir)
    return held, kept(spark, sf_dir, "edges", lambda: errors.candidate_edges(held, pairs=found_pairs(spark, sf_dir)))


def found_absorbed(spark, sf_dir) -> DataFrame:
    held, found = tables(spark, sf_dir)
    return kept(spark, sf_dir, "absorbed", lambda: errors.absorbed(held, found), table=True)


def edges(spark, sf_dir) -> DataFrame:
    return tables(spark, sf_dir)[1]


first = lambda c: F.get("mm", F.lit(0))[c]


@query(f"{_EDGES} SELECT parent, child, n_parent, n_child, mm[1].pos::INT AS pos, mm[1].b AS alt, mm[1].q AS q FROM edges WHERE h = 1")
def hamming1_edges(spark, sf_dir):
    return edges(spark, sf_dir).filter("h = 1").select("parent", "child", "n_parent", "n_child", first("pos").alias("pos"), first("b").alias("alt"), first("q").alias("q"))


@query(f"{_EDGES} SELECT parent, child, n_parent, n_child, mm[1].pos::INT AS pos, mm[2].pos::INT AS pos2 FROM edges WHERE h = 2")
def hamming2_edges(spark, sf_dir):
    return edges(spark, sf_dir).filter("h = 2").select("parent", "child", "n_parent", "n_child", first("pos").alias("pos"), F.get("mm", F.lit(1))["pos"].alias("pos2"))


@query(f"{_EDGES} SELECT parent, child, h FROM edges")
def split_hot_parts(spark, sf_dir):
    """The same edges where every part key of more than two clusters is split by finer keys."""
    return errors.candidate_edges(found_clusters(spark, sf_dir), errors.Rules(hot_parts=2)).select("parent", "child", "h")


_QUARTERS = f"{CLUSTERS}, q AS (SELECT canon, length(canon) AS n FROM clusters), p AS (SELECT canon, n, [substr(canon, 1, n // 4), substr(canon, n // 4 + 1, n * 2 // 4 - n // 4), substr(canon, n * 2 // 4 + 1, n * 3 // 4 - n * 2 // 4), substr(canon, n * 3 // 4 + 1)] AS x FROM q)"
_TAGS = "(VALUES (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)) t(i, j)"


@query(f"{_QUARTERS} SELECT tag, n::INT AS size, count(DISTINCT canon) AS clusters, count(DISTINCT p || '-' || q) AS keys FROM (SELECT canon, n, 10 * (i - 1) + j - 1 AS tag, x[i] AS p, x[j] AS q FROM p, {_TAGS}) GROUP BY 1, 2")
def pair_keys(spark, sf_dir):
    # A cluster has one key of a tag: clusters are the rows of a tag, and keys are counted by grouping them, once.
    keyed = errors.part_keys(clusters(spark, sf_dir).select("canon"), F.col("canon"))
    keys = keyed.groupBy("tag", "size", "p", "q").agg(F.count("*").alias("n"))
    return keys.groupBy("tag", "size").agg(F.sum("n").alias("clusters"), F.count("*").alias("keys"))


@query(f"{_QUARTERS}, k AS (SELECT n::INT AS size, 10 * (i - 1) + j - 1 AS tag, x[i] AS p, x[j] AS q, canon FROM p, {_TAGS}), b AS (SELECT size, tag, p, q, count(*) AS n, min(canon) AS c FROM k GROUP BY ALL HAVING count(*) > 3) SELECT size, tag, p, q, n, len(list_distinct([substr(c, i, 4) for i in range(1, size - 2)])) / (size - 3) < 0.5 AS repetitive FROM b")
def bucket_cap_report(spark, sf_dir):
    """What a cap of three clusters a part key would leave out."""
    return errors.over_cap(clusters(spark, sf_dir), errors.Rules(bucket_cap=3))


@query(f"{_EDGES}, e AS (SELECT parent, n_child, unnest(mm) AS m FROM edges) SELECT parent, m.pos::INT AS pos, m.b AS alt, sum(n_child)::BIGINT AS reads FROM e GROUP BY ALL")
def signature_counts(spark, sf_dir):
    return errors.signatures(edges(spark, sf_dir))


@query(f"{_EDGES}, e AS (SELECT parent, size, unnest(mm) AS m FROM edges) SELECT m.pos::INT AS pos, m.b AS alt, count(DISTINCT left(parent, 12) || right(parent, 12) || size) AS bundles FROM e GROUP BY ALL")
def cross_bundle(spark, sf_dir):
    return errors.recurrence(edges(spark, sf_dir))


@query(f"{_SINGLES}, k AS (SELECT count(*) FILTER (m.a || m.b IN ('AG', 'GA', 'CT', 'TC')) AS transitions, count(*) FILTER (m.a || m.b NOT IN ('AG', 'GA', 'CT', 'TC')) AS transversions FROM singles) SELECT transitions, transversions, round(CASE WHEN transversions > 0 THEN transitions / transversions WHEN transitions > 0 THEN 'inf'::DOUBLE ELSE 0 END, 9) AS kappa FROM k")
def kappa_ratio(spark, sf_dir):
    found = errors.kappa(found_pairs(spark, sf_dir))
    return found.withColumn("kappa", F.round("kappa", 9))


_BUNDLE = "(left(canon, 12), right(canon, 12), length(canon))"
_BINS = f"""{_EDGES},
seats AS (SELECT {_BUNDLE} AS b, count(*) AS seats FROM clusters GROUP BY 1),
occ_of AS (SELECT canon, n, CASE WHEN seats <= 1 THEN 0 WHEN seats <= 3 THEN 1 WHEN seats <= 7 THEN 2 WHEN seats <= 15 THEN 3 WHEN seats <= 63 THEN 4 ELSE 5 END AS occ FROM clusters JOIN seats ON b = {_BUNDLE}),
each AS (SELECT parent, child, (left(parent, 12), right(parent, 12), size) AS b, size, unnest(mm) AS m FROM edges),
binned AS MATERIALIZED (SELECT parent, child, b, m.q AS q, occ, {_DAMAGED}::INT AS dmg, CASE m.a || m.b WHEN 'CT' THEN 'C>T' WHEN 'GA' THEN 'C>T' WHEN 'CA' THEN 'C>A' WHEN 'GT' THEN 'C>A' WHEN 'CG' THEN 'C>G' WHEN 'GC' THEN 'C>G' WHEN 'TA' THEN 'T>A' WHEN 'AT' THEN 'T>A' WHEN 'TC' THEN 'T>C' WHEN 'AG' THEN 'T>C' ELSE 'T>G' END AS class,
  CASE WHEN least(m.pos, size - 1 - m.pos) <= 2 THEN 0 WHEN least(m.pos, size - 1 - m.pos) <= 5 THEN 1 WHEN least(m.pos, size - 1 - m.pos) <= 10 THEN 2 ELSE 3 END AS dist FROM each JOIN occ_of ON canon = parent),
total AS (SELECT count(DISTINCT b) AS total FROM binned),
model AS MATERIALIZED (SELECT class, dist, occ, dmg, n, total, greatest(1e-6, (n + 1)::DOUBLE / (total + 1 + greatest(9999, 100 * total))) AS p_real FROM (SELECT class, dist, occ, dmg, count(DISTINCT b) AS n FROM binned GROUP BY ALL), total)"""


@query(f"{_BINS} SELECT class, dist, occ, dmg, n, total, round(p_real, 9) AS p_real FROM model")
def model_bins(spark, sf_dir):
    held, found = tables(spark, sf_dir)
    return errors.model_bins(found, held).withColumn("p_real", F.round("p_real", 9))


_SCORED = f"""{_BINS},
terms AS MATERIALIZED (SELECT b.parent, b.child, o.occ, 3.0 + sum(ln(pow(10, -greatest(1, least(60, b.q)) / 10.0) / 3) - ln(coalesce(m.p_real, greatest(1e-6, 1::DOUBLE / (t.total + 1 + greatest(9999, 100 * t.total)))))) AS term
  FROM binned b CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) o(occ) CROSS JOIN total t LEFT JOIN model m ON m.class = b.class AND m.dist = b.dist AND m.dmg = b.dmg AND m.occ = o.occ GROUP BY ALL),
sig AS (SELECT parent, m.pos AS pos, m.b AS alt, sum(n_child) AS reads, any_value(n_parent) AS n FROM (SELECT parent, n_parent, n_child, unnest(mm) AS m FROM edges) GROUP BY ALL),
adj AS (SELECT parent, CASE WHEN n < 4 OR share >= 0.2 THEN 0 WHEN share > 0.1 THEN -1.5 * (share - 0.1) / (0.2 - 0.1) WHEN k >= 3 THEN 0.3 ELSE 0 END AS adjust FROM (SELECT parent, any_value(n) AS n, max(reads) / sum(reads) AS share, count(*) AS k FROM sig GROUP BY 1))"""


@query(f"{_SCORED} SELECT parent, child, round(adjust, 9) AS adjust, round(term + h * ln((n_parent + 1) / (n_child + 1)) + adjust, 6) AS score FROM edges JOIN adj USING (parent) JOIN occ_of ON canon = parent JOIN terms USING (parent, child, occ)")
def edge_scores(spark, sf_dir):
    held, found = tables(spark, sf_dir)
    return errors.edge_scores(found, held).select("parent", "child", F.round("adjust", 9).alias("adjust"), F.round("score", 6).alias("score"))


_SUPPORT = "met_sig AS (SELECT e.parent, e.child, max(reads) AS reads, max(e.m.q) AS q FROM (SELECT parent, child, unnest(mm) AS m FROM edges) e JOIN sig s ON s.parent = e.parent AND s.pos = e.m.pos AND s.alt = e.m.b GROUP BY ALL)"
_VETOED = f"{_SCORED}, {_SUPPORT}, kept AS MATERIALIZED (SELECT e.* FROM edges e JOIN met_sig s USING (parent, child) WHERE s.reads < 2 AND s.q < 25)"


@query(f"{_VETOED} SELECT parent, child, h FROM kept")
def vetoes(spark, sf_dir):
    return errors.vetoed(edges(spark, sf_dir)).select("parent", "child", "h")


@query(f"{_SCORED}, {_SUPPORT} SELECT parent, child, h FROM edges JOIN met_sig USING (parent, child) WHERE reads < 0.2 * (CASE WHEN n_parent < 10 THEN 1.75 ELSE 1 END) * n_parent")
def legacy_vetoes(spark, sf_dir):
    return errors.legacy_kept(edges(spark, sf_dir)).select("parent", "child", "h")


@query(f"""{_SINGLES}, ts AS (SELECT * FROM singles WHERE m.a || m.b IN ('AG', 'GA', 'CT', 'TC')),
sup AS (SELECT parent, m.pos AS pos, m.b AS alt, sum(n_child) AS reads FROM ts GROUP BY ALL),
rec AS (SELECT m.pos AS pos, m.b AS alt, count(DISTINCT left(parent, 12) || right(parent, 12) || size) AS bundles FROM ts GROUP BY ALL),
w AS (SELECT ts.*, least(reads, n_parent) / n_parent AS p, reads, bundles, fwd_n, n_child * ln(0.1 / 0.5) + n_parent * ln(0.9 / 0.5) AS lrt FROM ts JOIN sup ON sup.parent = ts.parent AND sup.pos = m.pos AND sup.alt = m.b JOIN rec ON rec.pos = m.pos AND rec.alt = m.b JOIN clusters ON canon = child)
SELECT parent, child, n_parent, n_child, m.pos::INT AS pos, m.b AS alt, round(lrt, 6) AS lrt, (lrt > ln(10) OR n_parent > 30 * n_child) AND NOT (reads >= 2 AND (p + 3.8416 / (2 * n_parent) - 1.96 * sqrt(p * (1 - p) / n_parent + 3.8416 / (4 * n_parent * n_parent))) / (1 + 3.8416 / n_parent) >= 0.1) AND bundles < 2 AND NOT (fwd_n > 0 AND fwd_n < n_child AND n_child >= 3) AND m.q < 25 AS absorb FROM w""")
def transition_lrt(spark, sf_dir):
    return errors.transition_edges(found_pairs(spark, sf_dir), found_clusters(spark, sf_dir)).withColumn("lrt", F.round("lrt", 6))


ROUNDS = 5
_TOP = "arg_min({'root': root, 'n_root': n_root, 'occ': occ, 'parent': parent, 'score': score}, (-n_parent, parent, pos, alt)) FILTER (score > 0)"
_NEXT = "".join(
    f""",
d{i} AS MATERIALIZED (SELECT child, any_value(n_child) AS n_child, {_TOP} AS via FROM (SELECT o.*, f.root, f.n_root, f.occ, term + k * ln((f.n_root + 1) / (o.n_child + 1)) + adjust AS score FROM open_ o LEFT JOIN f{i - 1} f ON f.v = o.parent LEFT JOIN terms t ON t.parent = o.parent AND t.child = o.child AND t.occ = f.occ) GROUP BY child HAVING count(*) FILTER (root IS NULL) = 0),
f{i} AS MATERIALIZED (SELECT * FROM f0 UNION ALL SELECT child, coalesce(via.root, child), coalesce(via.n_root, n_child), coalesce(via.occ, occ_of.occ) FROM d{i} JOIN occ_of ON canon = child)"""
    for i in range(1, ROUNDS + 1)
)
_ROOTS = f"""{_VETOED},
open_ AS MATERIALIZED (SELECT kept.parent, kept.child, n_parent, n_child, h AS k, mm[1].pos AS pos, mm[1].b AS alt, adjust FROM kept JOIN adj USING (parent)),
f0 AS MATERIALIZED (SELECT canon AS v, canon AS root, n AS n_root, occ FROM occ_of WHERE canon NOT IN (SELECT child FROM open_)){_NEXT},
roots AS MATERIALIZED (SELECT child, via.root AS root, via.parent AS parent, via.score AS score FROM d{ROUNDS} WHERE via IS NOT NULL)"""


@query(f"{_ROOTS} SELECT child, root, parent, round(score, 6) AS score FROM roots")
def ascent(spark, sf_dir):
    return found_absorbed(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"{_ROOTS} SELECT canon, n FROM clusters WHERE canon NOT IN (SELECT child FROM roots)")
def survivors_anti(spark, sf_dir):
    return dedup.survivors(found_clusters(spark, sf_dir), found_absorbed(spark, sf_dir).select(F.col("child").alias("canon"))).select("canon", "n")


@query(f"{_ROOTS} SELECT coalesce(root, canon) AS canon, sum(n)::BIGINT AS n, count(*) AS members FROM clusters LEFT JOIN roots ON canon = child GROUP BY 1")
def mass_roll_up(spark, sf_dir):
    return errors.roll_up(found_clusters(spark, sf_dir), found_absorbed(spark, sf_dir)).select("canon", "n", "members")


def genealogy(spark, sf_dir) -> DataFrame:
    held, found = tables(spark, sf_dir)
    return kept(spark, sf_dir, "store", lambda: store.genealogy(held, found_absorbed(spark, sf_dir), found), table=True)


_CLUSTERED = f"{_ROOTS}, c AS (SELECT coalesce(root, canon) AS root, sum(n)::BIGINT AS n_members, min(first_ord) AS cluster_id, count(*) - 1 AS n_edges FROM clusters LEFT JOIN roots ON canon = child GROUP BY 1)"


@query(f"{_CLUSTERED} SELECT cluster_id, n_members, n_edges, length(root)::INT AS parent_len FROM c ORDER BY n_members DESC, cluster_id LIMIT 10")
def top_members(spark, sf_dir):
    return store.top(genealogy(spark, sf_dir))


@query(f"{_CLUSTERED}, h AS (SELECT canon, cluster_id FROM clusters LEFT JOIN roots ON canon = child JOIN c ON c.root = coalesce(roots.root, canon)) SELECT ord, coalesce(cluster_id, -1) AS cluster_id FROM reads LEFT JOIN h ON canon = {CANON}")
def member_of(spark, sf_dir):
    return store.member_of(genealogy(spark, sf_dir), reads(spark, sf_dir))


@query(f"{_CLUSTERED}, h AS (SELECT canon, cluster_id FROM clusters LEFT JOIN roots ON canon = child JOIN c ON c.root = coalesce(roots.root, canon)) SELECT cluster_id, 'read_' || ord AS member_id FROM reads JOIN h ON canon = {CANON}")
def member_dump(spark, sf_dir):
    named = reads(spark, sf_dir).withColumn("read_id", F.concat(F.lit("read_"), F.col("ord")))
    return store.members(genealogy(spark, sf_dir), named)


@query(f"{_CLUSTERED} SELECT left(root, 16) || right(root, 16) || length(root) AS bundle, count(*) AS clusters, sum(n_members)::BIGINT AS members FROM c GROUP BY 1 HAVING count(*) >= 2")
def view_bundles(spark, sf_dir):
    return store.bundles(genealogy(spark, sf_dir)).select(F.concat("bundle.head", "bundle.tail", "bundle.size").alias("bundle"), "clusters", "members")


@query(f"{_CLUSTERED} SELECT count(*) AS clusters, sum(n_members)::BIGINT AS members, sum(n_edges)::BIGINT AS edges FROM c")
def store_header(spark, sf_dir):
    return store.header(genealogy(spark, sf_dir))


def _dots(node: str) -> str:
    return f"list_aggregate([CASE WHEN substr(root, i, 1) = substr({node}, i, 1) THEN '.' ELSE substr({node}, i, 1) END for i in range(1, length(root) + 1)], 'string_agg', '')"


#: A node stands as it is nearer to its root: the ascent takes few steps of one or two substitutions.
_GRID = f"{_CLUSTERED}, g AS (SELECT cluster_id, c.root, canon AS node, CASE WHEN hamming(c.root, canon) <= hamming(c.root, {rc_sql('canon')}) THEN canon ELSE {rc_sql('canon')} END AS t FROM clusters LEFT JOIN roots ON canon = child JOIN c ON c.root = coalesce(roots.root, canon))"


@query(f"{_GRID} SELECT cluster_id, node, {_dots('t')} AS line FROM g")
def cluster_grid(spark, sf_dir):
    return store.grid(genealogy(spark, sf_dir), nearer=True)


_BUSIEST = "(SELECT h || t || z FROM (SELECT left(root, 16) AS h, right(root, 16) AS t, length(root) AS z, count(*) AS k FROM c GROUP BY ALL ORDER BY k DESC, h, t, z LIMIT 1))"


@query(f"{_GRID} SELECT cluster_id, node, {_dots('t')} AS line FROM g WHERE left(root, 16) || right(root, 16) || length(root) = {_BUSIEST}")
def bundle_grid(spark, sf_dir):
    """The grids of the bundle with most clusters."""
    held = genealogy(spark, sf_dir)
    b = store.bundles(held, least=1).orderBy(F.desc("clusters"), "bundle").first()["bundle"]
    return store.bundle_grid(held, b["head"], b["tail"], b["size"], nearer=True)


@query(f"{_CLUSTERED}, one AS (SELECT root, cluster_id FROM c ORDER BY n_edges DESC, cluster_id LIMIT 1) SELECT r.parent, r.child AS node, n AS n_reads, round(score, 6) AS score FROM roots r JOIN one USING (root) JOIN clusters ON canon = r.child")
def cluster_tree(spark, sf_dir):
    """The edges of the cluster with most of them."""
    held = genealogy(spark, sf_dir)
    one = store.top(held, "n_edges", 1).first()["cluster_id"]
    return store.tree(held, one).select("parent", "node", "n_reads", F.round("score", 6).alias("score"))


@query(f"{_ROOTS}, e AS (SELECT r.child, unnest(mm) AS m, n_child FROM roots r JOIN edges USING (parent, child)) SELECT m.pos::INT AS pos, m.a AS from_base, m.b AS to_base, count(*) AS edges, sum(n_child)::BIGINT AS reads FROM e GROUP BY ALL")
def store_steps(spark, sf_dir):
    """Edges of one substitution each, counted by what they change."""
    return store.steps(genealogy(spark, sf_dir)).groupBy("pos", "from_base", "to_base").agg(F.count("*").alias("edges"), F.sum("n_reads").alias("reads"))


@query(f"{CLUSTERS} SELECT canon, n, count(*) OVER (PARTITION BY left(canon, 12), right(canon, 12), length(canon)) AS occupancy FROM clusters")
def bundle_occupancy(spark, sf_dir):
    return errors.occupancy(written(clusters(spark, sf_dir).select("canon", "n"), "clusters")).select("canon", "n", "occupancy")


#: Reads in many copies, one of which is deaminated in the twelve bases after the bundle's own.
_DEAM = f"{R}, d AS (SELECT ord * 100 + k AS ord, CASE WHEN k = 39 THEN left(seq, 12) || translate(substr(seq, 13, 12), 'C', 'T') || substr(seq, 25) ELSE seq END AS seq FROM (SELECT ord, seq, unnest(range(0, 40)) AS k FROM reads WHERE length(seq) = 60 AND ord % 5 = 0))"
DEAM = errors.Rules(profile=Profile(0.4, 0.12, 0.4, 0.12), deam_most=8, deam_veto=False)


def deaminated_reads(spark, sf_dir) -> DataFrame:
    full = reads(spark, sf_dir).filter((F.length("seq") == 60) & (F.col("ord") % 5 == 0)).select("ord", "seq", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k"))
    worn = F.when(F.col("k") == 39, F.concat(F.left("seq", F.lit(12)), F.translate(F.substring("seq", 13, 12), "C", "T"), F.substring("seq", 25, 60))).otherwise(F.col("seq"))
    return full.select((F.col("ord") * 100 + F.col("k")).alias("ord"), worn.alias("seq"))


def _likely(p: str, n: str) -> str:
    return f"greatest(0.4 * exp(-0.12 * {p}), 0.4 * exp(-0.12 * ({n} - 1 - {p}))) >= 0.01"


@query(f"{_DEAM}, c AS (SELECT {CANON} AS canon, count(*) AS n FROM d GROUP BY 1) SELECT canon, list_aggregate([CASE WHEN {_likely('(i - 1)', 'length(canon)')} THEN translate(substr(canon, i, 1), CASE WHEN i - 1 < length(canon) // 2 THEN 'T' ELSE 'A' END, CASE WHEN i - 1 < length(canon) // 2 THEN 'C' ELSE 'G' END) ELSE substr(canon, i, 1) END for i in range(1, length(canon) + 1)], 'string_agg', '') AS key FROM c")
def deaminated_keys(spark, sf_dir):
    found = dedup.deduplicate(deaminated_reads(spark, sf_dir))
    return found.select("canon", errors.deaminated(F.col("canon"), DEAM).alias("key"))


@query(f"""{_DEAM}, c AS MATERIALIZED (SELECT {CANON} AS canon, count(*) AS n FROM d GROUP BY 1),
p AS (SELECT a.canon AS root, b.canon AS child, a.n AS n_root, b.n AS n_child, list_filter(range(0, length(a.canon)), lambda i: substr(a.canon, i + 1, 1) <> substr(b.canon, i + 1, 1)) AS mm FROM c a JOIN c b ON left(a.canon, 12) = left(b.canon, 12) AND right(a.canon, 12) = right(b.canon, 12) AND length(a.canon) = length(b.canon) AND a.n >= 5 * b.n),
q AS (SELECT *, n_child * ln(0.1 / 0.5) + n_root * ln(0.9 / 0.5) + (len(mm) - 1) * ln(0.1 / 0.5) AS lrt FROM p WHERE len(mm) BETWEEN 3 AND 8 AND len(list_filter(mm, lambda i: NOT ({_likely("i", "length(root)")}) OR (substr(root, i + 1, 1) || substr(child, i + 1, 1)) NOT IN (CASE WHEN i < length(root) // 2 THEN 'CT' ELSE 'GA' END, CASE WHEN i < length(root) // 2 THEN 'TC' ELSE 'AG' END))) = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY n_root DESC, root) AS nth FROM q WHERE lrt > ln(10) AND root NOT IN (SELECT child FROM q WHERE lrt > ln(10)))
SELECT child, root, len(mm)::INT AS h, round(lrt, 6) AS lrt FROM r WHERE nth = 1""")
def deaminated_merge(spark, sf_dir):
    """Clusters merged over three to eight deaminated places. In a whole corpus nearly every base recurs
    at its place in some other bundle, so that veto is tested on a small table."""
    found = written(dedup.deduplicate(deaminated_reads(spark, sf_dir)), "clusters")
    if not errors.merges_deaminated(found, DEAM):
        raise ValueError("the profile does not reach far enough into the reads")
    return errors.merge_deaminated(found, DEAM).withColumn("lrt", F.round("lrt", 6))


_VARIED = f"{R}, varied AS (SELECT seq FROM reads UNION ALL SELECT left(seq, 29) || substr(seq, 31) FROM reads WHERE ord % 3 = 0 AND length(seq) = 60), clusters AS (SELECT {CANON} AS canon, count(*) AS n FROM varied GROUP BY 1), k AS (SELECT canon, n, (left(canon, 12), right(canon, 12)) AS b FROM clusters)"


def varied(spark, sf_dir, with_quality: bool = False):
    """Reads, and a third of them once more with one base taken out."""
    rows = reads(spark, sf_dir).select("ord", "seq")
    shorter = rows.filter((F.col("ord") % 3 == 0) & (F.length("seq") == 60)).select((F.col("ord") + (1 << 60)).alias("ord"), F.concat(F.left("seq", F.lit(29)), F.substring("seq", 31, 60)).alias("seq"))
    whole = rows.union(shorter)
    return dedup.deduplicate(whole.withColumn("qual", quality()), quality="qual") if with_quality else dedup.deduplicate(whole)


@query(f"{_VARIED}, p AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, canon) AS nth FROM k) SELECT p.canon AS parent, c.canon AS child, p.n AS n_parent, c.n AS n_child FROM p JOIN k c ON c.b = p.b AND abs(length(c.canon) - length(p.canon)) = 1 WHERE nth <= 32 AND (p.n > c.n OR (p.n = c.n AND p.canon < c.canon)) AND levenshtein(p.canon, c.canon) = 1")
def adjacent_lengths(spark, sf_dir):
    return errors.adjacent_lengths(varied(spark, sf_dir))


@query(f"{_VARIED}, o AS (SELECT *, count(*) OVER (PARTITION BY b) AS occ FROM k), m AS (SELECT p.canon AS parent, c.canon AS child, p.n AS n_parent, c.n AS n_child, levenshtein(p.canon, c.canon) AS edits FROM o p JOIN o c ON p.b = c.b WHERE p.occ >= 2 AND p.occ < 50 AND (p.n > c.n OR (p.n = c.n AND p.canon < c.canon)) AND abs(length(c.canon) - length(p.canon)) <= 2), r AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY edits, n_parent DESC, parent) AS nth FROM m WHERE edits BETWEEN 1 AND 2) SELECT parent, child, n_parent, n_child, edits::INT AS edits FROM r WHERE nth = 1")
def indel_rescue(spark, sf_dir):
    return errors.rescue_indels(varied(spark, sf_dir))


_CLOSE = f"{_VARIED}, o AS (SELECT *, count(*) OVER (PARTITION BY b) AS occ FROM k), m AS (SELECT p.canon AS parent, c.canon AS child, levenshtein(p.canon, c.canon) AS edits, length(c.canon) - length(p.canon) AS d FROM o p JOIN o c ON p.b = c.b WHERE p.occ >= 2 AND p.occ < 50 AND (p.n > c.n OR (p.n = c.n AND p.canon < c.canon)) AND abs(length(c.canon) - length(p.canon)) <= 2), h AS (SELECT *, CASE WHEN d <> 0 THEN edits - abs(d) WHEN hamming(parent, rpad(child, length(parent)::INT, '-')) = edits THEN edits ELSE 0 END AS n_sub FROM m WHERE edits BETWEEN 1 AND 2)"


@query(f"{_CLOSE} SELECT parent, child, edits::INT AS edits, n_sub::INT AS n_sub, ((edits - n_sub + d) // 2)::INT AS n_ins, ((edits - n_sub - d) // 2)::INT AS n_del FROM h")
def edit_scripts(spark, sf_dir):
    """What turns each parent into a close child of its bundle, by kind of edit."""
    found = indels.edit_scripts(errors.moderate_pairs(varied(spark, sf_dir), near=True).select("parent", "child")).filter("edits > 0")
    count = lambda kind: F.size(F.filter("script", lambda x: x["kind"] == kind)).alias(f"n_{kind}")
    return found.select("parent", "child", "edits", count("sub"), count("ins"), count("del"))


@query()
def scored_rescue(spark, sf_dir):
    """The best parent by score of each cluster that a few edits part from it, with the model of the substitutions
    of all candidate edges."""
    held, found = tables(spark, sf_dir)
    rows, bins = written(varied(spark, sf_dir, with_quality=True), "varied"), errors.model_bins(found, held)
    return indels.rescue_scored(rows, bins).withColumn("score", F.round("score", 6))


@query()
def sketch_pairs(spark, sf_dir):
    """Pairs of molecules of one bundle whose open syncmers share two hashes or more, the best 32 of each."""
    sketch = syncmer_hashes("canon", (11, 7, 2, 8), (13, 7, 3, 16), 75)
    rows = varied(spark, sf_dir).select(F.col("canon").alias("id"), S.bundle("canon", 12, False).alias("bundle"), sketch.alias("hashes"))
    return errors.sketch_hits(rows)
