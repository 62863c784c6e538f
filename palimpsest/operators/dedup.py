"""Exact deduplication of reads and of read pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import seq as S


def length_gate(reads: DataFrame, least: int = 16, most: int = 0) -> DataFrame:
    """Reads whose length is within bounds; most = 0 is no bound."""
    n = F.length("seq")
    return reads.filter((n >= least) & (n <= most)) if most else reads.filter(n >= least)


def head(reads: DataFrame, n: int) -> DataFrame:
    """The first n reads by ordinal, whatever the order of rows."""
    return reads.filter(F.col("ord") < n)


def deduplicate(reads: DataFrame, both_strands: bool = True, five: int = 0, three: int = 0, single: bool = False, quality: str | None = None, strand: bool = False) -> DataFrame:
    """A row for each molecule: canon, n, fwd_n, rep_ord, dmg_score, first_ord, seq, qual if a
    column of qualities is named, and first_fwd, whether the first read is its own canonical form, if
    strand is set.

    Reads (ord, seq) are one molecule if their canonical forms are equal once the bases of the
    masked ends are. seq is the first read's, in its canonical orientation; rep_ord is the first of
    the reads with the greatest damage score; qual goes with seq. The count combines before the
    shuffle."""
    key = S.masked_canonical("seq", five, three, single) if five or three else S.canonical("seq", both_strands)
    forward = S.is_forward("seq") if both_strands else F.lit(True)
    score = S.damage_score("seq", list(range(max(five, three))))
    rows = reads.select("ord", key.alias("canon"), forward.alias("fwd"), score.alias("score"), S.canonical("seq", both_strands).alias("oriented"), *([F.when(forward, F.col(quality)).otherwise(F.reverse(quality)).alias("_q")] if quality else []))
    more = [F.min_by("fwd", "ord").alias("first_fwd")] if strand else []
    more += [F.min_by("_q", "ord").alias("qual")] if quality else []
    if not (five or three):  # all reads of a molecule are one sequence and score alike: numbers only are aggregated
        found = rows.groupBy("canon").agg(F.count("*").alias("n"), F.sum(F.col("fwd").cast("long")).alias("fwd_n"), F.min("ord").alias("first_ord"), F.max("score").alias("dmg_score"), *more)
        return found.select("canon", "n", "fwd_n", F.col("first_ord").alias("rep_ord"), "dmg_score", "first_ord", F.col("canon").alias("seq"), *(["first_fwd"] if strand else []), *(["qual"] if quality else []))
    return rows.groupBy("canon").agg(
        F.count("*").alias("n"), F.sum(F.col("fwd").cast("long")).alias("fwd_n"), F.min_by("ord", F.struct((-F.col("score")).alias("s"), "ord")).alias("rep_ord"),
        F.max("score").alias("dmg_score"), F.min("ord").alias("first_ord"), F.min_by("oriented", "ord").alias("seq"), *more,
    )


def cluster_table(clusters: DataFrame) -> DataFrame:
    return clusters.select(F.md5("canon").alias("hash"), F.length("canon").alias("seq_len"), F.col("n").alias("count"))


def lockstep(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs by position, with both IDs; a side that is missing has null."""
    l, r = left.select("ord", F.col("read_id").alias("left_id"), F.col("seq").alias("left_seq")), right.select("ord", F.col("read_id").alias("right_id"), F.col("seq").alias("right_seq"))
    return l.join(r, "ord", "full")


def lockstep_report(pairs: DataFrame) -> DataFrame:
    """One row: pairs, rows of one side only, pairs whose IDs differ."""
    both = F.col("left_seq").isNotNull() & F.col("right_seq").isNotNull()
    return pairs.agg(F.count_if(both).alias("n_pairs"), F.count_if(F.col("right_seq").isNull()).alias("left_only"), F.count_if(F.col("left_seq").isNull()).alias("right_only"), F.count_if(both & (F.col("left_id") != F.col("right_id"))).alias("id_mismatch"))


def require_lockstep(pairs: DataFrame, allow_id_mismatch: bool = False) -> DataFrame:
    """pairs, or an error if the streams differ in length or (unless allowed) in IDs."""
    found = lockstep_report(pairs).first()
    if found.left_only or found.right_only:
        raise ValueError(f"streams of unequal length: {found.left_only} and {found.right_only} reads without a mate")
    if found.id_mismatch and not allow_id_mismatch:
        raise ValueError(f"{found.id_mismatch} pairs whose IDs differ")
    return pairs


def deduplicate_pairs(pairs: DataFrame, both_strands: bool = True) -> DataFrame:
    """Pairs (ord, ext, non) by the canonical form of ext: pair_count and the pair with the longest
    non, the earliest of equals."""
    rows = pairs.select("ord", S.canonical("ext", both_strands).alias("canon"), F.length("non").alias("non_len"))
    best = F.struct((-F.col("non_len")).alias("l"), "ord")
    return rows.groupBy("canon").agg(F.count("*").alias("pair_count"), F.min_by("ord", best).alias("rep_ord"), F.max("non_len").alias("non_len"))


def with_prior_counts(reads: DataFrame, prior: DataFrame) -> DataFrame:
    """reads with the number of reads (prior: seq, n_members) that the first occurrence of a
    sequence stands for; 1 if there is no more."""
    first = reads.groupBy("seq").agg(F.min("ord").alias("_first"))
    known = prior.filter("n_members > 1").groupBy("seq").agg(F.max("n_members").alias("_n"))
    joined = reads.join(first, "seq").join(known, "seq", "left")
    return joined.withColumn("weight", F.when(F.col("ord") == F.col("_first"), F.coalesce("_n", F.lit(1))).otherwise(F.lit(1)).cast("long")).drop("_first", "_n")


def survivors(clusters: DataFrame, absorbed: DataFrame, key: str = "canon") -> DataFrame:
    return clusters.join(absorbed.select(key), key, "left_anti")
