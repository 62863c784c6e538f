"""Absorption of PCR and sequencing errors: candidate edges, their evidence, and the ascent."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.functions import seq as S
from palimpsest.functions.derived import flat, strings_of
from palimpsest.operators import closepairs
from palimpsest.operators import sketches as sketched
from palimpsest.operators.closepairs import HALVES, PAIRS
from palimpsest.operators.damage import Profile
from palimpsest.operators.tables import dropped, salt, spread_join, written


@dataclass(frozen=True)
class Rules:
    """Limits of error correction. Names say what the value bounds."""

    least_interior: int = 20
    snp_share: float = 0.20
    snp_least: int = 1
    low_cover: int = 10
    low_cover_factor: float = 1.75
    h2_most_count: int = 2
    bucket_cap: int = 0
    cap_only_repetitive: bool = False
    repetitive: float = 0.5
    hot_parts: int = 1024
    margin: int = 5
    log_prior: float = 3.0
    sure_quality: int = 25
    protect_transversions: bool = False
    five: int = 0
    three: int = 0
    profile: Profile = Profile()
    # Transitions inside reads, tested by counts alone.
    lrt_f0: float = 0.10
    lrt_f1: float = 0.50
    lrt_odds: float = 10.0
    hard_ratio: float = 30.0
    kappa_least: float = 2.0
    wilson_least: float = 0.10
    strand_least: int = 3
    # Many deaminated places at once.
    deam_least: float = 0.01
    deam_places: int = 3
    deam_mass: float = 0.1
    deam_most: int = 5
    deam_ratio: float = 5.0
    deam_veto: bool = True




def ranked_above(parent_n: Column, parent: Column, child_n: Column, child: Column) -> Column:
    return (parent_n > child_n) | ((parent_n == child_n) & (parent < child))


def part_keys(clusters: DataFrame, interior: Column) -> DataFrame:
    """Six rows for each row: a tag and the two of four parts of its interior that it names. Two
    interiors within two substitutions of each other agree in one of the six."""
    parts = S.quarters(interior)
    keys = F.array(*[F.struct(F.lit(10 * i + j).alias("tag"), parts[i].alias("p"), parts[j].alias("q"), *(parts[k].alias(c) for k, c in zip([k for k in range(4) if k not in (i, j)], "rs", strict=True))) for i, j in PAIRS])
    return clusters.withColumn("_key", F.explode(keys)).select("*", F.length(interior).alias("size"), "_key.*").drop("_key")


KEY = ["size", "tag", "p", "q"]


def routed(fit: DataFrame, rules: Rules, fine: bool = False) -> DataFrame:
    """(key, ref) of clusters (id, canon): numbers, hashes of the part keys; ref is twice the id, plus one where
    the key reads the turned cluster. Numbers only route: whoever meets by them is compared base by base. With
    fine, also the hashes of the halves of the two other parts."""
    each = fit if "n" in fit.columns else fit.withColumn("n", F.lit(0).cast("long"))
    return closepairs.keyed(each, rules.five, rules.three, _both_ways(rules), fine).select("key", "ref", *(HALVES if fine else []))


def _both_ways(rules: Rules) -> bool:
    """Whether a key may stand for both strands: not where the interior is off the middle, or where the parent's own keys decide."""
    return rules.five == rules.three and not rules.bucket_cap


#: Bases that a word of 62 bits holds, and words of the first 62 bases.
WORD, WORDS = 31, 2


def packed(s: Column, word: int) -> Column:
    """The bases of s (ACGT only) that the word holds, two bits each; 0 where s ends before it."""
    return F.coalesce(F.conv(F.translate(S.part(s, WORD * word + 1, WORD), "ACGT", "0123"), 4, 10).cast("long"), F.lit(0).cast("long"))


def differing(a: Column, b: Column) -> Column:
    """The number of bases in which two words differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(int("01" * WORD, 2))))


def _number(size: Column, tag: int | Column, p: Column, q: Column) -> Column:
    return F.xxhash64(size, F.lit(tag) if isinstance(tag, int) else tag, p, q)


def finer(keyed: DataFrame, hot: DataFrame) -> DataFrame:
    """hot (key, ref, and more) with six finer keys for each row, by the halves that keyed (key, ref, halves) has. Interiors
    that agree in two parts and differ in two places agree in a third part, or in a half of each other part."""
    kinds = [("r", "r0", "r1"), ("s", "s0", "s1"), *((f"{i}{j}", f"r{i}", f"s{j}") for i in (0, 1) for j in (0, 1))]
    inside = hot.join(keyed, ["key", "ref"])
    return inside.select(F.explode(F.array(*[F.xxhash64("key", F.lit(k), x, y) for k, x, y in kinds])).alias("_finer"), *hot.columns).drop("key").withColumnRenamed("_finer", "key")


def interior(seq: Column, rules: Rules) -> Column:
    if not (rules.five or rules.three):
        return seq
    return S.part(seq, rules.five + 1, F.length(seq) - rules.five - rules.three)


def eligible(clusters: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Clusters of ACGT only whose interior is long enough."""
    return clusters.filter(~F.col("canon").rlike("[^ACGT]") & (F.length("canon") - rules.five - rules.three >= rules.least_interior))


def buckets(clusters: DataFrame, rules: Rules = Rules(), least: int = 2) -> DataFrame:
    """(size, tag, p, q, n, repetitive) of the keys that `least` clusters share; repetitive if fewer
    than half of the 4-mers of the least interior are distinct. Numbers travel for all keys, and sequences only
    for those whose number so many share: other keys of a number make it more, never less."""
    fit = written(eligible(clusters, rules).select("canon").withColumn("id", F.monotonically_increasing_id()), "numbered")
    inner = interior(F.col("canon"), rules)
    number = _number(F.col("size"), F.col("tag"), F.col("p"), F.col("q")).alias("key")
    shared = part_keys(fit, inner).select("id", "tag", number).withColumn("_n", F.count("*").over(Window.partitionBy("key"))).filter(F.col("_n") >= least)
    tags = shared.groupBy("id").agg(F.collect_set("tag").alias("_tags"))  # six at most
    met = part_keys(fit.join(tags, "id"), inner).filter(F.array_contains("_tags", F.col("tag")))
    grouped = met.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(inner).alias("_i")).filter(F.col("n") >= least)
    return grouped.withColumn("repetitive", S.distinct_kmers("_i", 4) / (F.length("_i") - 3) < rules.repetitive).drop("_i")


def over_cap(clusters: DataFrame, rules: Rules) -> DataFrame:
    """The buckets that the cap leaves out, with n, the rows lost by it: a report of what is dropped."""
    over = buckets(clusters, rules, max(2, rules.bucket_cap + 1))
    return over.filter("repetitive") if rules.cap_only_repetitive else over


def close_pairs(clusters: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All pairs (parent, child, n_parent, n_child, oriented, turned, mm, h) of clusters (canon, n) of
    one length with one or two substitutions in the interior, the parent of higher count (equal:
    lesser canon), as a table. oriented is the child's sequence as it aligns; twin, whether the pair
    is close in both directions. Rows meet by part keys, each with its bases as words
    (palimpsest.operators.closepairs); keys that very many rows share are split by finer ones. Nothing but sequences and counts travels."""
    fit = eligible(clusters, rules).select("canon", "n", F.shiftright(F.xxhash64("canon"), 2).alias("id"))
    mirrored, once = _both_ways(rules), not rules.bucket_cap
    if rules.bucket_cap:
        rows = closepairs.keyed(fit, rules.five, rules.three, mirrored)
        over = part_keys(fit, interior(F.col("canon"), rules)).join(over_cap(clusters, rules).select(*KEY), KEY)
        place = F.create_map(*(F.lit(x) for t, (i, j) in enumerate(PAIRS) for x in (10 * i + j, t)))
        over = over.select((F.col("id") * 2).alias("ref"), place[F.col("tag")].alias("_t"))
        rows = rows.withColumn("_t", F.shiftright("meta", 1).bitwiseAND(7)).join(over, ["ref", "_t"], "left_anti")
        found = closepairs.met(rows.select(*closepairs.KEYED_NAMES), rules.five, rules.three, mirrored, rules.hot_parts, once)
    else:
        bits = max(5, math.ceil(math.log2(max(1, 6 * fit.count()) / closepairs.BUCKET)))
        found = closepairs.met_dealt(closepairs.dealt(fit, rules.five, rules.three, mirrored, bits), 1 << bits, rules.five, rules.three, mirrored, rules.hot_parts)
        found = found.withColumn("ref", F.shiftleft(F.shiftright(F.xxhash64("child"), 2), 1) + F.col("ref"))
    told = written(found, "candidates")
    pairs = told.filter("parent IS NOT NULL").drop(*closepairs.KEYED_NAMES)
    hot = told.filter("key IS NOT NULL").select(*closepairs.KEYED_NAMES)
    if not hot.isEmpty():
        met_hot = hot.select(F.shiftright("ref", 1).alias("id")).distinct()  # keys are made anew of these clusters only
        split = finer(routed(fit.join(met_hot, "id", "left_semi"), rules, fine=True), hot).select(*closepairs.KEYED_NAMES)
        more = closepairs.met(split, rules.five, rules.three, mirrored, None, once).drop(*closepairs.KEYED_NAMES)
        pairs = pairs.unionByName(written(more.dropDuplicates(["parent", "child", "turned"]), "hot-candidates"))
    return pairs if once else pairs.dropDuplicates(["parent", "child", "turned"])


def _damaged(m: Column, size: Column, rules: Rules) -> Column:
    return S.terminal_damage(m["a"], m["b"], m["pos"] - rules.five, size - rules.five - rules.three, rules.margin, rules.profile.single)


def _best(pairs: DataFrame) -> DataFrame:
    """Of pairs that are close in both directions the better one; only those, if pairs say which they are, are compared."""
    first = F.row_number().over(Window.partitionBy("parent", "child").orderBy("h", "turned"))
    best = lambda p: p.withColumn("_r", first).filter("_r = 1").drop("_r")
    if "twin" not in pairs.columns:
        return best(pairs)
    return pairs.filter("NOT twin").unionByName(best(pairs.filter("twin"))).drop("twin")


def candidate_edges(clusters: DataFrame, rules: Rules = Rules(), pairs: DataFrame | None = None) -> DataFrame:
    """Of the close pairs those that may be errors, one orientation each: one substitution counts if
    it is A-T or C-G; two if the child is rare and neither looks like terminal damage. If clusters
    has qualities (qual), each mismatch of mm has the child's (q), or else 0."""
    pairs = close_pairs(clusters, rules) if pairs is None else pairs
    size = F.length("parent")
    damaged = F.exists("mm", lambda m: _damaged(m, size, rules))
    one = (F.col("h") == 1) & S.complement_pair(F.get("mm", F.lit(0))["a"], F.get("mm", F.lit(0))["b"])
    two = (F.col("h") == 2) & (F.col("n_child") <= rules.h2_most_count) & ~damaged
    return with_quality(_best(pairs.filter(one | two)), clusters)


def with_quality(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    field = lambda m, q: F.struct(m["pos"].alias("pos"), m["a"].alias("a"), m["b"].alias("b"), q.cast("int").alias("q"))
    if "qual" not in clusters.columns:
        return edges.withColumn("mm", F.transform("mm", lambda m: field(m, F.lit(0))))
    own = clusters.select(F.col("canon").alias("child"), F.col("qual").alias("_q"))
    line = F.when(F.col("turned") == 1, F.reverse("_q")).otherwise(F.col("_q"))
    return edges.join(own, "child").withColumn("mm", F.transform("mm", lambda m: field(m, F.ascii(line.substr(m["pos"] + 1, F.lit(1))) - 33))).drop("_q")


def signatures(edges: DataFrame) -> DataFrame:
    """How many child reads support each (parent, pos, alt)."""
    each = edges.select("parent", "n_child", F.explode("mm").alias("m"))
    return each.groupBy("parent", F.col("m.pos").alias("pos"), F.col("m.b").alias("alt")).agg(F.sum("n_child").alias("reads"))


def recurrence(edges: DataFrame, end: int = 12) -> DataFrame:
    """In how many bundles each (pos, alt) is seen."""
    head = S.bundle("parent", end)
    each = edges.select(head.alias("bundle"), F.explode("mm").alias("m"))
    return each.groupBy(F.col("m.pos").alias("pos"), F.col("m.b").alias("alt")).agg(F.count_distinct("bundle").alias("bundles"))


def interior_singles(pairs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Close pairs of one substitution that is no terminal damage, one orientation each."""
    size, m = F.length("parent"), F.get("mm", F.lit(0))
    return _best(pairs.filter("h = 1")).filter(~_damaged(m, size, rules))


def kappa(pairs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row: transitions, transversions and their ratio among single substitutions inside reads;
    infinite without transversions, 0 without either."""
    m = F.get("mm", F.lit(0))
    ab = F.concat(m["a"], m["b"])
    ts = F.count_if(ab.isin("AG", "GA", "CT", "TC"))
    tv = F.count_if(~ab.isin("AG", "GA", "CT", "TC"))
    ratio = F.when(tv > 0, ts / tv).when(ts > 0, F.lit(math.inf)).otherwise(0.0)
    return interior_singles(pairs, rules).agg(ts.alias("transitions"), tv.alias("transversions"), ratio.alias("kappa"))


def seats(clusters: DataFrame, end: int = 12, rules: Rules = Rules()) -> DataFrame:
    """(bundle, occupancy): the number of eligible clusters of each bundle."""
    return eligible(clusters, rules).groupBy(S.bundle("canon", end).alias("bundle")).agg(F.count("*").alias("occupancy"))


def occupancy(clusters: DataFrame, end: int = 12, rules: Rules = Rules()) -> DataFrame:
    """clusters with bundle and the number of eligible clusters in it (1 if there is none). A bundle
    of very many clusters is spread."""
    keyed = clusters.withColumn("bundle", S.bundle("canon", end))
    return spread_join(keyed, seats(clusters, end, rules), "bundle", "canon", "left").withColumn("occupancy", F.coalesce("occupancy", F.lit(1).cast("long")))


def placed(edges: DataFrame, seated: DataFrame, end: int = 12) -> DataFrame:
    """edges with occ, the bin of their parent's bundle; those whose parent has no seat go."""
    keyed = spread_join(edges.withColumn("bundle", S.bundle("parent", end)), seated, "bundle", "child")
    return keyed.withColumn("occ", S.occupancy_bin(F.col("occupancy"))).drop("bundle", "occupancy")


def _binned(edges: DataFrame, clusters: DataFrame, end: int, rules: Rules) -> DataFrame:
    """A row for each mismatch of each edge, with what its bin depends on."""
    size = F.length("parent")
    each = edges.withColumn("bundle", S.bundle("parent", end)).select("bundle", "occ", size.alias("size"), F.explode("mm").alias("m"))
    m = F.col("m")
    return each.select("bundle", "occ", S.substitution_class(m["a"], m["b"]).alias("class"), S.distance_bin(m["pos"], F.col("size")).alias("dist"), F.when(_damaged(m, F.col("size"), rules), 1).otherwise(0).alias("dmg"))


def model_bins(edges: DataFrame, clusters: DataFrame, end: int = 12, rules: Rules = Rules(), seated: DataFrame | None = None) -> DataFrame:
    """How often real variants of a kind recur: by (class, distance bin, occupancy bin, damage bin) the
    number of bundles with one, and p_real = (n + 1) / (N + 1 + max(9999, 100 N)), at least 1e-6. seated is
    seats() where it is held already; edges that are placed() need neither."""
    if "occ" not in edges.columns:
        edges = placed(edges, seats(clusters, end, rules) if seated is None else seated, end)
    binned = _binned(edges, clusters, end, rules)
    cells = binned.groupBy("class", "dist", "occ", "dmg").agg(F.count_distinct("bundle").alias("n"))
    total = binned.agg(F.count_distinct("bundle").alias("total"))
    return cells.crossJoin(F.broadcast(total)).withColumn("p_real", _p_real(F.col("n"), F.col("total")))  # one row


def _p_real(n: Column, total: Column) -> Column:
    return F.greatest(F.lit(1e-6), (n + 1) / (total + 1 + F.greatest(F.lit(9999), 100 * total)))


OCCUPANCIES = len(S.OCCUPANCY_ENDS) + 1


def edge_terms(edges: DataFrame, clusters: DataFrame, bins: DataFrame, end: int = 12, rules: Rules = Rules()) -> DataFrame:
    """Edges with terms: for each occupancy bin that the absorbing cluster's bundle may have, the log
    odds that the child is an error of it, by the qualities and the recurrence of its mismatches."""
    bin_ = lambda kind, dist, dmg: F.concat_ws(":", kind, dist.cast("string"), dmg.cast("string"))
    cells = bins.groupBy("class", "dist", "dmg").agg(*(F.max(F.when(F.col("occ") == o, F.col("p_real"))).alias(f"p{o}") for o in range(OCCUPANCIES)), F.max("total").alias("total"))
    entry = F.struct(bin_(F.col("class"), F.col("dist"), F.col("dmg")).alias("k"), F.array(*(f"p{o}" for o in range(OCCUPANCIES))).alias("p"))
    grid = cells.agg(F.map_from_entries(F.collect_list(entry)).alias("_grid"), F.coalesce(F.max("total"), F.lit(0)).alias("_total"))  # at most 48 cells in one row
    size = F.length("parent")
    damaged = lambda m: F.when(_damaged(m, size, rules), 1).otherwise(0)
    lift = lambda m, p: p
    if rules.profile.enabled:
        d = rules.profile
        chance = lambda m: S.damage_probability(m["pos"], size, d.d5, d.l5, d.d3, d.l3)
        lift = lambda m, p: F.when(damaged(m) == 1, p + chance(m) * (1 - p)).otherwise(p)
    rare = _p_real(F.lit(0), F.col("_total"))
    # What a mismatch adds is told once, from the edge's own row: nothing is exploded, grouped and joined back.
    known = F.transform("mm", lambda m: F.struct(S.log_error_third(F.greatest(F.lit(1), F.least(F.lit(60), m["q"]))).alias("error"), F.try_element_at("_grid", bin_(S.substitution_class(m["a"], m["b"]), S.distance_bin(m["pos"], size), damaged(m))).alias("p"), m.alias("m")))
    term = lambda o: F.aggregate("_known", F.lit(rules.log_prior), lambda so_far, x: so_far + x["error"] - F.log(lift(x["m"], F.coalesce(F.get(x["p"], F.lit(o)), rare))))
    return edges.crossJoin(F.broadcast(grid)).withColumn("_known", known).withColumn("terms", F.array(*(term(o) for o in range(OCCUPANCIES)))).drop("_known", "_grid", "_total")


def _adjust(n: Column, w: Column, m: Column, k: Column, rules: Rules) -> Column:
    """What the spread of a parent's signatures adds to the scores of its edges: many places with few reads each look
    like errors, one place with a tenth or more does not. n: the parent's reads, w: those of all signatures, m: of the
    greatest, k: their number."""
    share = m / w
    return F.when((n < 4) | (share >= rules.snp_share), 0.0).when(share > 0.10, -1.5 * (share - 0.10) / (rules.snp_share - 0.10)).when(k >= 3, 0.3).otherwise(0.0)


def dispersion(edges: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(parent, adjust) of each parent."""
    each = signatures(edges).groupBy("parent").agg(F.sum("reads").alias("w"), F.max("reads").alias("m"), F.count("*").alias("k"))
    n = edges.groupBy("parent").agg(F.first("n_parent").alias("n"))
    return each.join(n, "parent").select("parent", _adjust(F.col("n"), F.col("w"), F.col("m"), F.col("k"), rules).alias("adjust"))


def with_signatures(edges: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Edges with support (for each mismatch the reads of all children of the parent that have it) and adjust. All of a
    parent's edges meet once, with all that they carry: within two substitutions of a read of n bases there are
    no more than 9 n (n - 1) / 2 + 3 n sequences a direction, so that no parent has more edges, however large the table."""
    each = edges.repartition("parent").select("*", F.posexplode("mm").alias("_i", "_m")).withColumns({"_pos": F.col("_m.pos"), "_alt": F.col("_m.b")})
    sign, parent, pair = Window.partitionBy("parent", "_pos", "_alt"), Window.partitionBy("parent"), Window.partitionBy("parent", "child")
    each = each.withColumns({"_reads": F.sum("n_child").over(sign), "_nth": F.row_number().over(sign.orderBy("child", "_i"))})
    each = each.withColumns({"_w": F.sum("n_child").over(parent), "_m_": F.max("_reads").over(parent), "_k": F.count_if(F.col("_nth") == 1).over(parent)})
    each = each.withColumn("_list", F.collect_list(F.struct("_i", "_reads")).over(pair)).filter("_i = 0")  # two at most
    told = each.withColumn("support", F.transform(F.sort_array("_list"), lambda x: x["_reads"])).withColumn("adjust", _adjust(F.col("n_parent"), F.col("_w"), F.col("_m_"), F.col("_k"), rules))
    return told.select(*edges.columns, "support", "adjust")


def edge_scores(edges: DataFrame, clusters: DataFrame, rules: Rules = Rules(), end: int = 12, seated: DataFrame | None = None) -> DataFrame:
    """Edges with terms, support, adjust, occ (of the parent) and score: terms for the parent itself, plus
    mismatches times log((n_parent + 1) / (n_child + 1)), plus adjust. Errors are rarer than what
    they are errors of; the score is above 0 where the odds favour an error."""
    held = edges
    if "occ" not in edges.columns:
        held = written(placed(edges, seats(clusters, end, rules) if seated is None else seated, end), "placed-edges")
    bins = written(model_bins(held, clusters, end, rules), "bins")
    scored = with_signatures(edge_terms(held, clusters, bins, end, rules), rules)
    return scored.withColumn("score", total_score(F.col("n_parent"), F.col("occ")))


def total_score(n_root: Column, occ: Column) -> Column:
    return F.get("terms", occ) + F.size("mm") * F.log((n_root + 1) / (F.col("n_child") + 1)) + F.col("adjust")


def with_support(edges: DataFrame) -> DataFrame:
    """Edges with support: for each mismatch the reads of all children of the parent that have it."""
    return edges if "support" in edges.columns else with_signatures(edges).drop("adjust")


def vetoed(edges: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Edges that may absorb: no mismatch that two reads or more (or snp_least) support, none of a
    quality that is sure, and no transversion pair if those are protected. Terminal damage (one
    substitution, where the profile has damage) is exempt from the first two."""
    size, m = F.length("parent"), F.get("mm", F.lit(0))
    exempt = (F.col("h") == 1) & _damaged(m, size, rules) & F.lit(rules.profile.enabled)
    seen = F.exists("support", lambda x: x >= max(rules.snp_least, 2))
    sure = F.exists("mm", lambda x: x["q"] >= rules.sure_quality)
    kept = with_support(edges).filter(exempt | ~(seen | sure)).drop("support")
    if rules.protect_transversions:
        kept = kept.filter(~F.exists("mm", lambda x: ~S.damage_pair(x["a"], x["b"])))
    return kept


def legacy_kept(edges: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Edges that may absorb by the older rule: no mismatch that a share of the parent's reads supports,
    a larger share where the parent has few."""
    share = rules.snp_share * F.when(F.col("n_parent") < rules.low_cover, rules.low_cover_factor).otherwise(1.0)
    least = F.when(F.col("n_parent") > F.col("n_child"), 1).otherwise(rules.snp_least)
    return with_support(edges).filter(~F.exists("support", lambda x: (x >= least) & (x >= share * F.col("n_parent")))).drop("support")


def transition_edges(pairs: DataFrame, clusters: DataFrame, rules: Rules = Rules(), end: int = 12) -> DataFrame:
    """Close pairs whose one substitution is a transition inside the read, with lrt (the log odds of an
    error against a variant by the counts alone) and absorb. Against it speak: support by a share
    of reads (Wilson's lower bound), two bundles with the same change, a child seen from both
    strands, and a sure quality. Only of use where kappa is kappa_least or more."""
    m = F.get("mm", F.lit(0))
    found = with_quality(interior_singles(pairs, rules).filter(F.concat(m["a"], m["b"]).isin("AG", "GA", "CT", "TC")), clusters)
    bundles = recurrence(found, end)
    strands = clusters.select(F.col("canon").alias("child"), F.col("fwd_n").alias("_f"))
    rows = with_support(found).join(strands, "child").withColumn("pos", m["pos"]).withColumn("alt", m["b"]).join(F.broadcast(bundles), ["pos", "alt"])  # places times bases at most
    x, n, p = F.col("n_child"), F.col("n_parent") + F.col("n_child"), F.col("n_parent")
    lrt = x * math.log(rules.lrt_f0 / rules.lrt_f1) + (n - x) * math.log((1 - rules.lrt_f0) / (1 - rules.lrt_f1))
    reads = F.get("support", F.lit(0))
    wilson = (reads >= 2) & (S.wilson_lower(F.least(reads, p), p.cast("double")) >= rules.wilson_least)
    both = (F.col("_f") > 0) & (F.col("_f") < x) & (x >= rules.strand_least)
    hard = p > rules.hard_ratio * x
    good = ((lrt > math.log(rules.lrt_odds)) | hard) & ~wilson & (F.col("bundles") < 2) & ~both & (m["q"] < rules.sure_quality)
    return rows.select("parent", "child", "n_parent", "n_child", "pos", "alt", lrt.alias("lrt"), good.alias("absorb"))


def ascend(edges: DataFrame, clusters: DataFrame, rules: Rules = Rules(), end: int = 12, seated: DataFrame | None = None) -> DataFrame:
    """(child, root, parent, score) of each absorbed cluster. edges have terms and adjust (edge_scores)
    and passed the vetoes.

    Edges are tried by falling parent count, then parent, place, base and child; a child goes with
    the first whose score is above 0, to the cluster that holds the parent by then, whose count and
    bundle the score is taken with. A cluster's fate is settled once those of all its parents are:
    each round joins the open edges with the fates known, and is a table."""
    seated = seats(clusters, end, rules) if seated is None else seated
    edges = edges if "occ" in edges.columns else placed(edges, seated, end)
    flat = edges.select("parent", "child", "n_parent", "n_child", "terms", "adjust", F.col("occ").alias("occ_parent"), "mm", F.get("mm", F.lit(0))["pos"].alias("pos"), F.get("mm", F.lit(0))["b"].alias("alt"))
    flat = spread_join(flat.withColumn("bundle", S.bundle("child", end)), seated, "bundle", "parent", "left").drop("bundle")
    todo = written(flat.withColumn("occ_child", S.occupancy_bin(F.coalesce("occupancy", F.lit(1).cast("long")))).drop("occupancy"), "open-edges")
    tops = todo.groupBy(F.col("parent").alias("v")).agg(F.first("n_parent").alias("n_root"), F.first("occ_parent").alias("occ"))
    tops = tops.join(todo.select(F.col("child").alias("v")).distinct(), "v", "left_anti")
    todo = todo.drop("occ_parent")
    fates = [written(tops.select("v", F.col("v").alias("root"), "n_root", "occ"), "fates")]
    settled: list[DataFrame] = []
    while todo.limit(1).count():
        told = fates[0]
        for more in fates[1:]:
            told = told.unionByName(more)
        met = spread_join(todo, told.withColumnRenamed("v", "parent"), "parent", "child", "left")
        score = total_score(F.col("n_root"), F.col("occ"))
        met = met.withColumn("score", score)
        order = F.struct(-F.col("n_parent"), "parent", "pos", "alt")
        first = F.min_by(F.when(F.col("score") > 0, F.struct("root", "n_root", "occ", "parent", "score")), F.when(F.col("score") > 0, order))
        done = met.groupBy("child").agg(F.count_if(F.col("root").isNull()).alias("open"), first.alias("by"), F.first("n_child").alias("n_child"), F.first("occ_child").alias("occ_child")).filter("open = 0")
        done = written(done.select("child", "by", F.coalesce("by.root", "child").alias("root"), F.coalesce("by.n_root", "n_child").alias("n_root"), F.coalesce("by.occ", "occ_child").alias("occ")), "settled")
        settled.append(done.filter("by IS NOT NULL").select("child", "root", "by.parent", "by.score"))
        fates.append(done.select(F.col("child").alias("v"), "root", "n_root", "occ"))
        last, todo = todo, written(todo.join(done.select("child"), "child", "left_anti"), "open-edges")
        dropped(last)
    if not settled:
        return todo.select("child", F.col("parent").alias("root"), "parent", F.lit(0.0).alias("score"))
    dropped(todo, fates[0])
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def absorbed(clusters: DataFrame, edges: DataFrame, rules: Rules = Rules(), end: int = 12) -> DataFrame:
    """ascend over the scored candidate edges that pass the vetoes, on tables that go when their work is done."""
    seated = written(seats(clusters, end, rules), "seats")
    held = written(placed(edges, seated, end), "placed-edges")
    found = ascend(vetoed(edge_scores(held, clusters, rules, end, seated), rules), clusters, rules, end, seated)
    dropped(seated, held)
    return found


def roll_up(clusters: DataFrame, gone: DataFrame) -> DataFrame:
    """Surviving clusters with the reads of those that they absorbed. If clusters has rep_ord and
    dmg_score, the representative is that of the most damaged of them, the survivor's own first."""
    to = clusters.join(gone.select("child", "root", "parent"), clusters["canon"] == gone["child"], "left").withColumn("_to", F.coalesce("root", "canon"))
    more = []
    if {"rep_ord", "dmg_score"} <= set(clusters.columns):
        rank = F.struct(-F.col("dmg_score"), F.col("child").isNotNull(), "canon")
        more = [F.min_by("rep_ord", rank).alias("rep_ord"), F.max("dmg_score").alias("dmg_score")]
    return to.groupBy(F.col("_to").alias("canon")).agg(F.sum("n").alias("n"), F.count("*").alias("members"), *more)


def deaminated(s: Column, rules: Rules) -> Column:
    """s with the bases that damage makes set back wherever damage is likely: T to C in the 5' half, A
    to G in the 3' half (both in both in single-stranded libraries); all bases of a batch at once. Sequences are ASCII."""
    d = rules.profile

    @F.arrow_udf(StringType())
    def run(seq: pa.Array) -> pa.Array:
        data, ends = flat(seq)
        n = np.repeat(np.diff(ends), np.diff(ends))
        at = np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends))
        likely = np.maximum(d.d5 * np.exp(-d.l5 * at), d.d3 * np.exp(-d.l3 * (n - 1 - at))) >= rules.deam_least
        likely &= (at >= rules.five) & (at < n - rules.three)
        first = at < n // 2
        out = np.where(likely & (first | d.single) & (data == ord("T")), ord("C"), data)
        out = np.where(likely & (~first | d.single) & (data == ord("A")), ord("G"), out).astype(np.uint8)
        return pc.if_else(seq.is_valid(), strings_of(out, ends), pa.scalar(None, pa.string()))

    return run(s)


def merges_deaminated(clusters: DataFrame, rules: Rules) -> bool:
    """Whether damage reaches far enough into reads of the median length (upper) for merge_deaminated."""
    counts = clusters.groupBy(F.length("canon").alias("size")).agg(F.count("*").alias("k")).orderBy("size").collect()  # a row a length
    total, upto = sum(r.k for r in counts), 0
    for r in counts:
        upto += r.k
        if upto > total // 2:
            d = rules.profile
            chances = [max(d.d5 * math.exp(-d.l5 * p), d.d3 * math.exp(-d.l3 * (r["size"] - 1 - p))) for p in range(rules.five, r["size"] - rules.three)]
            likely = [x for x in chances if x > rules.deam_least]
            return d.enabled and len(likely) >= rules.deam_places and sum(likely) >= rules.deam_mass
    return False


def merge_deaminated(clusters: DataFrame, rules: Rules, end: int = 12) -> DataFrame:
    """(child, root, h, lrt): clusters that differ from a more frequent one of their bundle in three to
    deam_most places, all of them likely damage. They meet by bundle and by the interior with
    damage set back; the parent has deam_ratio times the reads, no change may recur in another
    bundle, and the counts must favour an error, more so the more places differ. A child goes to its
    first parent by falling count that is not absorbed itself."""
    d = rules.profile
    fit = eligible(clusters, rules).select("canon", "n", S.bundle("canon", end).alias("bundle"))
    n = F.length("canon")
    places = fit.select("bundle", F.explode(F.transform(F.sequence(F.lit(rules.five + 1), n - rules.three), lambda i: F.struct((i - 1).alias("pos"), F.col("canon").substr(i, F.lit(1)).alias("alt"), S.damage_probability(i - 1, n, d.d5, d.l5, d.d3, d.l3).alias("p")))).alias("x")).filter(F.col("x.p") >= rules.deam_least)
    common = places.filter(F.lit(rules.deam_veto)).groupBy("x.pos", "x.alt").agg(F.count_distinct("bundle").alias("b")).filter("b >= 2").select(F.concat_ws(":", "pos", "alt").alias("k"))
    recurring = sorted(r.k for r in common.collect())  # places of a read times four
    keyed = fit.withColumn("key", deaminated(F.col("canon"), rules))
    parents = keyed.select("bundle", "key", F.col("canon").alias("parent"), F.col("n").alias("n_parent"))
    met = spread_join(keyed.select("bundle", "key", F.col("canon").alias("child"), F.col("n").alias("n_child")), parents, ["bundle", "key"], "child").filter(F.col("n_parent") >= rules.deam_ratio * F.col("n_child"))
    size = F.length("parent")
    met = met.withColumn("mm", S.mismatches("parent", "child")).withColumn("h", F.size("mm")).filter(F.col("h").between(3, rules.deam_most))
    ct, ga = (lambda m: F.concat(m["a"], m["b"]).isin("CT", "TC")), (lambda m: F.concat(m["a"], m["b"]).isin("GA", "AG"))
    way = lambda m: (ct(m) | ga(m)) if d.single else F.when(m["pos"] < F.floor(size / 2), ct(m)).otherwise(ga(m))
    fine = F.forall("mm", lambda m: way(m) & (S.damage_probability(m["pos"], size, d.d5, d.l5, d.d3, d.l3) >= rules.deam_least))
    again = F.exists("mm", lambda m: F.concat_ws(":", m["pos"].cast("string"), m["b"]).isin(recurring)) if recurring else F.lit(False)
    x, p = F.col("n_child"), F.col("n_parent")
    lrt = x * math.log(rules.lrt_f0 / rules.lrt_f1) + p * math.log((1 - rules.lrt_f0) / (1 - rules.lrt_f1)) + (F.col("h") - 1) * math.log(rules.lrt_f0 / rules.lrt_f1)
    todo = written(met.filter(fine & ~again).withColumn("lrt", lrt).filter(F.col("lrt") > math.log(rules.lrt_odds)).select("parent", "child", "n_parent", "h", "lrt"), "deaminated")
    out = todo.select("child", F.col("parent").alias("root"), "h", "lrt").limit(0)
    while todo.limit(1).count():
        # Children of clusters that are nobody's child: those edges count, and no other of theirs does.
        tops = todo.select("parent").distinct().join(todo.select(F.col("child").alias("parent")).distinct(), "parent", "left_anti")
        best = todo.join(tops, "parent").groupBy("child").agg(F.min_by(F.struct("parent", "h", "lrt"), F.struct(-F.col("n_parent"), "parent")).alias("by"))
        # A higher-ranked parent whose fate is open still comes first.
        better = todo.join(tops, "parent", "left_anti").groupBy("child").agg(F.min(F.struct((-F.col("n_parent")).alias("n"), "parent")).alias("ahead"))
        got = best.join(better, "child", "left").join(todo.select("child", F.col("parent").alias("_p"), (-F.col("n_parent")).alias("_n")), "child").filter(F.col("_p") == F.col("by.parent")).filter(F.col("ahead").isNull() | (F.struct(F.col("_n").alias("n"), F.col("_p").alias("parent")) < F.col("ahead")))
        got = written(got.select("child", F.col("by.parent").alias("root"), "by.h", "by.lrt"), "deaminated")
        out = out.unionByName(got)
        gone = got.select("child").distinct()
        todo = written(todo.join(gone, "child", "left_anti").join(gone.withColumnRenamed("child", "parent"), "parent", "left_anti"), "deaminated")
        if got.limit(1).count() == 0:
            break
    return out


def adjacent_lengths(clusters: DataFrame, top: int = 32, end: int = 12) -> DataFrame:
    """Edges between clusters of one bundle (length left out) whose lengths differ by one base
    that, taken out of the longer, gives the shorter; parents are the top ones of their bundle. A bundle
    of very many clusters is ranked in parts first, and its children are spread."""
    rows = clusters.select("canon", "n", F.length("canon").alias("size"), S.bundle("canon", end, False).alias("bundle"))
    rank = lambda *by: F.row_number().over(Window.partitionBy("bundle", *by).orderBy(F.desc("n"), "canon"))
    first = rows.withColumn("_part", salt("canon")).withColumn("_r", rank("_part")).filter(F.col("_r") <= top)
    parents = first.withColumn("_r", rank()).filter(F.col("_r") <= top).select("bundle", F.col("canon").alias("parent"), F.col("n").alias("n_parent"), F.col("size").alias("size_parent"))
    children = rows.select("bundle", F.col("canon").alias("child"), F.col("n").alias("n_child"), F.col("size").alias("size_child"))
    met = spread_join(children, parents, "bundle", "child").filter((F.abs(F.col("size_parent") - F.col("size_child")) == 1) & ranked_above(F.col("n_parent"), F.col("parent"), F.col("n_child"), F.col("child")))
    longer, shorter = F.when(F.col("size_parent") > F.col("size_child"), F.col("parent")).otherwise(F.col("child")), F.when(F.col("size_parent") > F.col("size_child"), F.col("child")).otherwise(F.col("parent"))
    # Lengths differ by one: one edit is a deletion, and a bounded edit distance is compiled.
    return met.filter(S.within_edits(longer, shorter, 1)).select("parent", "child", "n_parent", "n_child")


def moderate_pairs(clusters: DataFrame, low: int = 2, hot: int = 50, edits: int = 2, end: int = 12, keep: tuple[str, ...] = (), near: bool = False) -> DataFrame:
    """(parent, child, n_parent, n_child, and what to keep of the child): clusters of one bundle (length left
    out) of low to hot - 1 clusters whose lengths differ by at most so many bases, the parent of higher
    rank. Bundles are counted first, so that none beyond the bound is ever gathered. With near, only pairs that
    so many edits part: a bounded edit distance, which is compiled, tells most others."""
    rows = clusters.select("canon", "n", *keep, S.bundle("canon", end, False).alias("bundle"))
    counts = rows.groupBy("bundle").agg(F.count("*").alias("_o")).filter((F.col("_o") >= low) & (F.col("_o") < hot)).select("bundle")
    rows = spread_join(rows, counts, "bundle", "canon")
    left = rows.select("bundle", F.col("canon").alias("parent"), F.col("n").alias("n_parent"))
    right = rows.select("bundle", F.col("canon").alias("child"), F.col("n").alias("n_child"), *keep)
    met = left.join(right, "bundle").filter(ranked_above(F.col("n_parent"), F.col("parent"), F.col("n_child"), F.col("child")) & (F.abs(F.length("parent") - F.length("child")) <= edits)).drop("bundle")
    return met.filter(S.within_edits("parent", "child", edits)) if near else met


def _segments(parts: int, edits: int) -> list[tuple[int, int, int]]:
    """(segment, shift, difference of lengths) under which a child may hold a segment of its parent: of edits + 1
    segments one has no edit, with as many before it at most as there are segments before, and as many
    behind it at most as there are behind. They say how far it is shifted from either end."""
    return [(i, s, d) for i in range(parts) for d in range(-edits, edits + 1) for s in range(-i, i + 1) if abs(s - d) <= edits - i]


def crowded_pairs(clusters: DataFrame, hot: int = 50, edits: int = 2, end: int = 12, keep: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of moderate_pairs(near=True) in bundles of `hot` clusters or more: all that so many edits part,
    however large the bundle. A parent is known by each of edits + 1 segments of what lies between its ends, a child
    by all strings that such a segment may be in it; only clusters that share one are compared."""
    rows = clusters.select("canon", "n", *keep, S.bundle("canon", end, False).alias("bundle"))
    counts = rows.groupBy("bundle").agg(F.count("*").alias("_o")).filter(F.col("_o") >= hot).select("bundle")
    rows = spread_join(rows, counts, "bundle", "canon")
    parts, size = edits + 1, F.length("canon")

    def key(i: int, shift: int, longer: int) -> Column:
        of = size - longer  # the parent's length
        cut = F.when(of >= 2 * end + edits, end).otherwise(0)  # where parent and child surely share whole ends
        place = lambda k: cut + F.floor((of - 2 * cut) * k / parts).cast("int")
        start, stop = place(i) + shift, place(i + 1) + shift
        inside = (of > 0) & (start >= 0) & (stop <= size)
        return F.when(inside, F.xxhash64("bundle", of, F.lit(i), S.part(F.col("canon"), start + 1, stop - start)))

    left = rows.select("bundle", F.col("canon").alias("parent"), F.col("n").alias("n_parent"), F.explode(F.array(*(key(i, 0, 0) for i in range(parts)))).alias("_key"))
    right = rows.select(F.col("bundle").alias("_b"), F.col("canon").alias("child"), F.col("n").alias("n_child"), *keep, F.explode(F.array_distinct(F.array(*(key(*x) for x in _segments(parts, edits))))).alias("_key"))
    met = spread_join(right.filter("_key IS NOT NULL"), left, "_key", "child")
    met = met.filter((F.col("bundle") == F.col("_b")) & ranked_above(F.col("n_parent"), F.col("parent"), F.col("n_child"), F.col("child")) & (F.abs(F.length("parent") - F.length("child")) <= edits))
    return met.filter(S.within_edits("parent", "child", edits)).dropDuplicates(["parent", "child"]).select("parent", "n_parent", "child", "n_child", *keep)


def rescue_indels(clusters: DataFrame, low: int = 2, hot: int = 50, edits: int = 2, end: int = 12) -> DataFrame:
    """The best parent of each cluster within a bundle of moderate size and a few edits."""
    near = moderate_pairs(clusters, low, hot, edits, end).withColumn("edits", F.levenshtein("parent", "child", edits)).filter("edits between 1 and 2")
    best = near.groupBy("child").agg(F.min_by(F.struct("parent", "n_parent", "n_child", "edits"), F.struct("edits", -F.col("n_parent"), "parent")).alias("x"))
    return best.select("x.parent", "child", "x.n_parent", "x.n_child", "x.edits")


def sketch_hits(sketches: DataFrame, least: int = 2, top: int = 32, most: int = sketched.MOST) -> DataFrame:
    """(a, b, hits): pairs of rows (id, bundle, hashes) of one bundle that share `least` hashes or more;
    of each b its `top` a's by hits. Rows of a bundle meet once, with all their hashes; those of bundles of more than
    `most` rows meet by bundle and hash, as numbers, spread over many tasks."""
    told = written(sketched.met(sketches, least, top, most), "sketch-pairs")
    few = told.filter("a IS NOT NULL").select("a", "b", "hits")
    many = told.filter("_b IS NOT NULL").select("id", "_b", "_c", "hashes")
    if many.isEmpty():
        return few
    many = written(many.withColumn("_i", F.monotonically_increasing_id()), "hot-sketches")
    each = many.select("_i", "_b", "_c", F.explode("hashes").alias("h"))
    met = spread_join(each.withColumnRenamed("_i", "x"), each.withColumnRenamed("_i", "y"), ["_b", "_c", "h"], "x").filter("x < y")
    hits = met.groupBy("x", "y").agg(F.count("*").alias("hits")).filter(F.col("hits") >= least)
    name = lambda c: many.select(F.col("_i").alias(c), F.col("id").alias(f"_{c}"))
    hits = spread_join(spread_join(hits, name("x"), "x", "y"), name("y"), "y", "x").select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "hits")
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("hits"), "a"))
    return few.unionByName(hits.withColumn("_r", rank).filter(F.col("_r") <= top).drop("_r"))
