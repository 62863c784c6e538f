"""Damage profiles as tables, models by length bin, and what a split takes from them.

Tables are aggregates over all reads; what is fitted sees only the tables."""

from __future__ import annotations

import json
import math
from dataclasses import asdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import seq as S
from palimpsest.operators.damage import LEAST_CELL, POSITIONS, Profile, hexamers, llr
from palimpsest.operators.tables import head, written

#: Reads shorter than this are no evidence of damage.
FLOOR = 30


def floor(reads: DataFrame, least: int = FLOOR) -> DataFrame:
    return reads.filter(F.length("seq") >= least)


def end_counts(reads: DataFrame, positions: int = POSITIONS) -> DataFrame:
    """(pos, t5, c5, g5, a3, g3, t3, c3, n): bases at each place from both ends, one row a place."""
    n = F.length("seq")
    at = reads.select("seq", F.explode(F.sequence(F.lit(0), F.least(F.lit(positions), n) - 1)).alias("pos"))
    five, three = S.part(F.col("seq"), F.col("pos") + 1, 1), S.part(F.col("seq"), n - F.col("pos"), 1)
    sums = [F.count_if(x == b).alias(f"{b.lower()}{end}") for x, end, bases in ((five, 5, "TCG"), (three, 3, "AGTC")) for b in bases]
    return at.groupBy("pos").agg(*sums, F.count("*").alias("n"))


def _share(hit: Column, ref: Column) -> Column:
    """hit of hit and ref, or -1 where both together are fewer than a cell needs."""
    return F.when(hit + ref >= LEAST_CELL, hit / F.nullif(hit + ref, F.lit(0))).otherwise(-1.0)


def profile_table(counts: DataFrame, profile: Profile) -> DataFrame:
    """pos, end5, freq5, end3, freq3, freq5_gt, mask, cov5, cov3, cov5_gt of each place: T of T and C at
    the 5' end, A of A and G at the 3' end (T of T and C in single-stranded libraries), T of T and G."""
    c = F.col
    hit, ref = (c("t3"), c("c3")) if profile.single else (c("a3"), c("g3"))
    mask = F.get(F.array(*map(F.lit, profile.mask)), c("pos")) if profile.mask else F.lit(False)
    return counts.select("pos", F.lit("5prime").alias("end5"), _share(c("t5"), c("c5")).alias("freq5"), F.lit("3prime").alias("end3"), _share(hit, ref).alias("freq3"), _share(c("t5"), c("g5")).alias("freq5_gt"), F.coalesce(mask, F.lit(False)).cast("int").alias("mask"), (c("t5") + c("c5")).alias("cov5"), (hit + ref).alias("cov3"), (c("t5") + c("g5")).alias("cov5_gt"))


def write_tsv(table: DataFrame, path: str, order: str, gzip: bool = False) -> None:
    """One tab-separated text with a header, in order (for tables of bounded size); gzip by name or flag."""
    table.orderBy(order).coalesce(1).write.option("sep", "\t").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def write_cluster_tsv(table: DataFrame, path: str) -> None:
    """A cluster table as tab-separated text with gzip, in as many files as it has partitions."""
    table.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def write_jsonl(table: DataFrame, path: str) -> None:
    """A count table as one JSON object a line."""
    table.write.json(path)


def profile_json(table: DataFrame, profile: Profile, level: str = "summary") -> DataFrame:
    """One row, json: the fitted profile; with level standard or full its places, with full their counts."""
    own = F.struct(*(F.lit(v).alias(k) for k, v in asdict(profile).items() if k != "mask"), F.array(*map(F.lit, profile.mask)).cast("array<boolean>").alias("mask"))
    shown = {"summary": [], "standard": ["pos", "freq5", "freq3", "mask"], "full": ["pos", "freq5", "freq3", "freq5_gt", "mask", "cov5", "cov3", "cov5_gt"]}[level]
    places = F.sort_array(F.collect_list(F.struct(*shown))) if shown else F.lit(None)  # a row a place
    return table.agg(F.to_json(F.struct(own.alias("profile"), places.alias("places"))).alias("json"))


def mask_from_model(profile: Profile, threshold: float = 0.05, positions: int = 32) -> tuple[bool, ...]:
    """Places where the fitted excess of either end is above threshold."""
    return tuple(max(profile.d5 * math.exp(-profile.l5 * p), profile.d3 * math.exp(-profile.l3 * p)) > threshold for p in range(positions))


def digest(reads: DataFrame, first: int = 200_000) -> str:
    """What names an input: its first reads by ordinal, whatever their order of arrival."""
    found = head(reads, "ord", first).agg(F.bit_xor(S.digest("ord", "seq")).alias("d"), F.count("*").alias("n")).first()
    return f"{(found.d or 0) & (2**64 - 1):016x}-{found.n}"


def save_model(spark: SparkSession, path: str, profile: Profile, of: str, pi: float = -1.0, lods: DataFrame | None = None, subst: DataFrame | None = None) -> None:
    """The profile as JSON with the digest of its input and the share of damaged reads (-1: unknown), and
    beside it as Parquet the model by length bin and the substitution table, where there are such."""
    line = json.dumps({"schema": "damage_model_v1", "digest": of, "pi": pi, "profile": asdict(profile)})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/model")
    for name, table in (("lods", lods), ("substitutions", subst)):
        if table is not None:
            table.write.parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, of: str | None = None, override: bool = False) -> tuple[Profile, float]:
    """What save_model wrote. If `of` is given, a model of another input is an error unless overridden."""
    held = json.loads(spark.read.text(f"{path}/model").first()[0])
    if held["schema"] != "damage_model_v1":
        raise ValueError("not a damage model")
    if of is not None and held["digest"] != of and not override:
        raise ValueError("the model was fitted on another input")
    own = held["profile"]
    return Profile(**{**own, "mask": tuple(own["mask"])}), held["pi"]


def length_edges(reads: DataFrame, bins: int = 5) -> list[int]:
    """Upper ends of length bins of about equal numbers of reads: quantiles by sorted index."""
    counted = reads.groupBy(F.length("seq").alias("x")).agg(F.count("*").alias("k")).orderBy("x").collect()  # a row a length
    total, upto, out, at = sum(r.k for r in counted), 0, [], 1
    for r in counted:
        upto += r.k
        while at < bins and upto > round(at / bins * (total - 1)):
            out.append(r.x)
            at += 1
    return sorted(set(out))


def length_bin(edges: list[int], size: Column | None = None) -> Column:
    """The first bin whose upper end is not below the length; the last for longer reads."""
    n = F.length("seq") if size is None else size
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(n <= edges[i], i).otherwise(out)
    return out


def bin_counts(reads: DataFrame, profile: Profile, edges: list[int], threshold: float = 0.0) -> DataFrame:
    """(bin, pos, end, t, c, td, cd, n, nd): hits and references at each place from each end, of all reads of a
    length bin and of those that the profile calls damaged; n and nd count reads."""
    n = F.length("seq")
    rows = floor(reads).select("seq", length_bin(edges).alias("bin"), (llr("seq", profile) >= threshold).alias("d"))
    at = rows.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(POSITIONS), n) - 1)).alias("pos"))
    ends = F.array(F.struct(F.lit(5).alias("end"), F.translate(S.part(F.col("seq"), F.col("pos") + 1, 1), "TC", "hr").alias("x")), F.struct(F.lit(3).alias("end"), F.translate(S.part(F.col("seq"), n - F.col("pos"), 1), "TC" if profile.single else "AG", "hr").alias("x")))
    each = at.select("bin", "pos", "d", F.inline(ends))
    return each.groupBy("bin", "pos", "end").agg(F.count_if(F.col("x") == "h").alias("t"), F.count_if(F.col("x") == "r").alias("c"), F.count_if((F.col("x") == "h") & F.col("d")).alias("td"), F.count_if((F.col("x") == "r") & F.col("d")).alias("cd"), F.count("*").alias("n"), F.count_if("d").alias("nd"))


def lod_model(counts: DataFrame) -> DataFrame:
    """(bin, pos, end, lod_hit, lod_ref): log odds of a damaged against an undamaged read by one base. The
    undamaged share is what is left of the whole: (pb - pi pd) / (1 - pi), kept in [1e-4, 1 - 1e-4].
    Cells with too few observations, and bins without undamaged reads, have none (0)."""
    c = F.col
    keep = lambda x: F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), x))
    pi = c("nd") / c("n")
    pb, pd = c("t") / F.nullif(c("t") + c("c"), F.lit(0)), c("td") / F.nullif(c("td") + c("cd"), F.lit(0))
    pu, pd = keep((pb - pi * pd) / F.nullif(1 - pi, F.lit(0.0))), keep(pd)
    good = (c("t") + c("c") >= LEAST_CELL) & (c("td") + c("cd") >= LEAST_CELL) & (c("nd") < c("n"))
    return counts.select("bin", "pos", "end", F.when(good, F.log(pd / pu)).otherwise(0.0).alias("lod_hit"), F.when(good, F.log((1 - pd) / (1 - pu))).otherwise(0.0).alias("lod_ref"))


def lod_scores(reads: DataFrame, model: DataFrame, edges: list[int], single: bool = False, keep: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(ord, or other columns to keep, and score): the summed log odds of a read's terminal bases by the model of its length bin. The
    model is a few hundred rows, turned to arrays by place and broadcast; reads are not exploded."""
    line = lambda e, k: F.transform(F.sort_array(F.collect_list(F.when(F.col("end") == e, F.struct("pos", k)))), lambda x: x[k]).alias(f"{k}{e}")
    by = model.groupBy("bin").agg(*(line(e, k) for e in (5, 3) for k in ("lod_hit", "lod_ref")))
    met = reads.withColumn("_bin", length_bin(edges)).join(F.broadcast(by.withColumnRenamed("bin", "_bin")), "_bin", "left")
    n, total = F.length("seq"), F.lit(0.0)
    for p in range(POSITIONS):
        for e, hit, ref in ((5, "T", "C"), (3, "T" if single else "A", "C" if single else "G")):
            x = S.part(F.col("seq"), F.lit(p + 1) if e == 5 else n - p, 1)
            got = F.when((n > p) & (x == hit), F.get(f"lod_hit{e}", F.lit(p))).when((n > p) & (x == ref), F.get(f"lod_ref{e}", F.lit(p)))
            total = total + F.coalesce(got, F.lit(0.0))
    return met.select(*keep, total.alias("score"))


def split_threshold(base: float, state: str, pi: float, cut: float | None = None) -> float:
    """The score from which on a read is damaged. detected: base less the prior log odds; low_abundance: the
    cut that the share pi of all reads reaches (damage.tail_cut); else none reaches it."""
    if state == "detected":
        return base - math.log(pi / (1 - pi))
    if state == "low_abundance":
        if cut is None:
            raise ValueError("low abundance takes the cut of the score histogram")
        return cut
    return math.inf


def dedup_threshold(base: float, d5: float, ancient: float = 0.3) -> float:
    """base less the log odds of the damaged share that d5 speaks of, kept in [0.01, 0.99]."""
    share = min(max(d5 / ancient, 0.01), 0.99)
    return base - math.log(share / (1 - share))


def scan(reads: DataFrame, fit, first: int) -> Profile:
    """fit over the first reads by ordinal; over all reads if that leaves open whether there is damage
    although the 5' end shows some."""
    p = fit(head(reads, "ord", first))
    return fit(reads) if p.d5 > 0.02 and not (p.mask and p.mask[0]) else p


def decay_by_grid(rates: np.ndarray, counts: np.ndarray) -> tuple[float, float, float]:
    """(d, lambda, background) of background + d exp(-lambda p) by least squares weighted by counts, over 101
    values of lambda in [0.05, 3]. (-1, -1, -1) with fewer than three places, without a fit inside [0, 1],
    or where damage is spent (below a tenth) at the first place observed."""
    none, p = (-1.0, -1.0, -1.0), np.flatnonzero(counts > 0)
    if len(p) < 3:
        return none
    w, y, best, out = counts[p].astype(float), rates[p], math.inf, none
    for rate in np.linspace(0.05, 3.0, 101):
        e = np.exp(-rate * p)
        m = np.array([[w.sum(), (w * e).sum()], [(w * e).sum(), (w * e * e).sum()]])
        if abs(np.linalg.det(m)) < 1e-15:
            continue
        background, d = np.linalg.solve(m, [(w * y).sum(), (w * e * y).sum()])
        error = float((w * (y - background - d * e) ** 2).sum())
        if 0 <= d <= 1 and 0 <= background <= 1 and error < best:
            best, out = error, (float(d), float(rate), float(background))
    return none if out == none or (p[0] > 0 and math.exp(-out[1] * p[0]) < 0.10) else out


def depletion(counts: DataFrame) -> DataFrame:
    """(bin, d, depletion) from (bin, pos, t, c, g, n): damage as the larger share of T at the first two places
    over that inside (places 5 on), and how much rarer G is at the first place than inside. Bins with
    fewer reads than a cell needs have none."""
    share = F.col("t") / F.nullif(F.col("t") + F.col("c"), F.lit(0))
    inside = F.col("pos") >= 5
    sums = counts.groupBy("bin").agg(F.max(F.when(F.col("pos") == 0, F.col("n"))).alias("reads"), F.max(F.when(F.col("pos") < 2, share)).alias("end"), (F.sum(F.when(inside, F.col("t"))) / F.nullif(F.sum(F.when(inside, F.col("t") + F.col("c"))), F.lit(0))).alias("bg"), F.avg(F.when(inside, F.col("g") / F.col("n"))).alias("g"), F.max(F.when(F.col("pos") == 0, F.col("g") / F.col("n"))).alias("g0"))
    enough = F.col("reads") >= LEAST_CELL
    return sums.select("bin", F.when(enough, F.col("end") - F.col("bg")).alias("d"), F.when(enough, F.col("g") - F.col("g0")).alias("depletion"))


def hexamer_confound(counts: DataFrame, fit_offset: int, most: int = 5) -> DataFrame:
    """One row (rc_overlap, consistent, confounded) from damage.hexamers: whether the 3' end's most enriched
    hexamers look like an artefact: none is the complement of a 5' one, fewer than half end in A as
    damage would have it, and the 3' fit begins further in."""
    total = counts.groupBy("place").agg(F.sum("n").alias("total"))
    share = counts.join(F.broadcast(total), "place").withColumn("s", (F.col("n") + 0.5) / F.col("total"))  # three rows
    inner = share.filter("place = 'inner'").select("hexamer", F.col("s").alias("i"))
    ends = share.filter("place <> 'inner'").join(inner, "hexamer", "left").withColumn("up", F.col("s") / F.coalesce("i", F.lit(1e-9)))
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("up"), "hexamer"))  # 4,096 a place
    top = ends.withColumn("_r", rank).filter(F.col("_r") <= most)
    three, five = top.filter("place = 'three'"), top.filter("place = 'five'").select(S.revcomp("hexamer").alias("_h"))
    both = three.join(five, three["hexamer"] == five["_h"], "left")
    found = both.agg(F.count("_h").alias("rc_overlap"), F.avg(F.endswith("hexamer", F.lit("A")).cast("int")).alias("consistent"))
    return found.withColumn("confounded", (F.col("rc_overlap") == 0) & (F.col("consistent") < 0.5) & F.lit(fit_offset >= 1))


def clip_policy(reads: DataFrame, fit, policy: str = "report", least: int = 100_000) -> dict:
    """The profile of reads, and by policy off, report (stubs are named) or refit (fitted again without
    them); warns where reads are few."""
    from palimpsest.operators.damage import enriched_stubs

    n = reads.count()
    out = {"profile": fit(reads), "reads": n, "warning": f"{n} reads are few" if n < least else None, "stubs": []}
    if policy == "off":
        return out
    found = enriched_stubs(written(hexamers(reads), "hexamers")).collect()  # ten an end at most
    out["stubs"] = sorted((r.place, r.hexamer) for r in found)
    if policy == "refit" and found:
        ends = [[r.hexamer for r in found if r.place == place] for place in ("five", "three")]
        out["profile"] = fit(reads.withColumn("seq", S.clip_stubs("seq", *ends)))
    return out


def consensus_damage(counts: DataFrame) -> DataFrame:
    """(bin, call) from (bin, d) in order of length: pass where damage does not rise with length beyond its
    noise, warn where it does once, fail where no bin has damage."""
    order = Window.orderBy("bin")  # a row a length bin
    rows = counts.withColumn("_up", F.col("d") > F.lag("d").over(order) + 0.01)
    each = rows.agg(F.max("d").alias("most"), F.count_if("_up").alias("ups"))
    return each.select("most", "ups", F.when(F.coalesce("most", F.lit(0.0)) < 0.01, "fail").when(F.col("ups") > 0, "warn").otherwise("pass").alias("call"))
