"""Splitting reads into damaged and undamaged, from detection to routes.

A plan is made first: the profile (from the head of the reads, and from all of them if that leaves
damage open), length bins, the model by bin, the share of damaged reads and how sure it is. The state
says how to cut the scores: by posterior where damage is detected, by yield where it is rare, not at
all where nothing is identified. A saved plan is taken instead, if it was made of the same input.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import damage, lengthmix, profile
from palimpsest.operators.damage import Profile
from palimpsest.operators.tables import written

#: States, from the surest on; the least share of damaged reads that counts as detected.
STATES, LEAST_PI = ("detected", "low_abundance", "abstain"), 0.05


@dataclass(frozen=True)
class SplitPlan:
    """model: (bin, pos, end, lod_hit, lod_ref), a few hundred rows; None where scores are those of the profile."""

    profile: Profile
    edges: tuple[int, ...]
    model: DataFrame | None
    state: str
    pi: float
    of: str = ""


def state_of(found: Profile, pi: float, separated: bool) -> str:
    """detected, low_abundance (the kinds of reads are told apart, but few are damaged), or abstain."""
    if not found.enabled or not separated or not 0 < pi < 1:
        return "abstain"
    return "detected" if pi >= LEAST_PI else "low_abundance"


def plan_split(reads: DataFrame, first: int = 1_000_000, edges: list[int] | None = None, threshold: float = 0.0, single: bool = False, state: str | None = None, pi: float | None = None) -> SplitPlan:
    """The plan for reads (ord, seq). state and pi are estimated from a mixture over length and GC unless given;
    edges from the lengths. Tables of counts are all that comes to the driver."""
    found = profile.scan(reads, lambda rows: damage.fit_profile(rows, single=single), first)
    chosen = lengthmix.auto_edges(lengthmix.length_counts(reads)) if edges is None else edges
    if state is None or pi is None:
        mixture = lengthmix.fit_mixture(lengthmix.length_gc_cells(reads, chosen, single), single)
        share, apart = (0.0, False) if mixture is None else (mixture.pi, mixture.separated)
        pi = share if pi is None else pi
        state = state_of(found, pi, apart) if state is None else state
    return plan_of(reads, found, chosen, state, pi, threshold)


def plan_of(reads: DataFrame, found: Profile, edges: list[int], state: str, pi: float, threshold: float = 0.0) -> SplitPlan:
    """A plan with a given profile, bins, state and share; the model by length bin is counted from reads."""
    if state not in STATES:
        raise ValueError(f"state is one of {', '.join(STATES)}")
    model = written(profile.lod_model(profile.bin_counts(reads, found, edges, threshold)), "lods") if found.enabled else None
    return SplitPlan(found, tuple(edges), model, state, pi, profile.digest(reads))


def save_plan(spark: SparkSession, path: str, plan: SplitPlan) -> None:
    profile.save_model(spark, path, plan.profile, plan.of, plan.pi, lods=plan.model)
    line = json.dumps({"schema": "split_plan_v1", "edges": plan.edges, "state": plan.state})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/plan")


def load_plan(spark: SparkSession, path: str, reads: DataFrame | None = None, override: bool = False) -> SplitPlan:
    """What save_plan wrote; with reads, a plan of another input is an error unless overridden."""
    of = None if reads is None else profile.digest(reads)
    found, pi = profile.load_model(spark, path, of, override)
    held = json.loads(spark.read.text(f"{path}/plan").first()[0])
    if held["schema"] != "split_plan_v1":
        raise ValueError("not a split plan")
    model = spark.read.parquet(f"{path}/lods") if found.enabled else None
    return SplitPlan(found, tuple(held["edges"]), model, held["state"], pi, of or "")


def split(reads: DataFrame, plan: SplitPlan, base: float = 0.0, least: int = 0, most: int = 0) -> DataFrame:
    """reads (of a length from least to most, 0: any) with score, to six places, and route. detected: damaged from a
    score of base less the prior log odds on; low_abundance: the highest cut (in steps of 0.01) from which on
    the share pi of all reads lies; abstain: none is damaged. Nulls of seq score 0."""
    n = F.length("seq")
    rows = reads.filter((n >= least) | n.isNull()) if least else reads
    rows = rows.filter((n <= most) | n.isNull()) if most else rows
    if plan.model is None:
        scored = rows.withColumn("score", F.round(F.coalesce(damage.llr("seq", plan.profile), F.lit(0.0)), 6))
    else:
        points = profile.lod_scores(rows, plan.model, list(plan.edges), plan.profile.single, keep=tuple(rows.columns))
        scored = points.withColumn("score", F.round("score", 6))
    cut = None
    if plan.state == "low_abundance":
        found = damage.tail_cut(damage.score_histogram(scored.withColumnRenamed("score", "llr")), plan.pi).first()
        cut = math.inf if found.cut is None else float(found.cut)
    edge = profile.split_threshold(base, plan.state, plan.pi, cut)
    damaged = F.lit(False) if edge == math.inf else F.col("score") >= edge
    return scored.withColumn("route", F.when(damaged, "damaged").otherwise("undamaged"))
