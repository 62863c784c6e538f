"""Synthetic damaged reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate(spark: SparkSession, n: int = 1_000_000, size: int = 60, gc: float = 0.45, damaged: float = 0.70, d5: float = 0.18, l5: float = 0.35, d3: float = 0.18, l3: float = 0.35, background: float = 0.001, quality: int = 40, seed: int = 1) -> DataFrame:
    """n reads (ord, header, seq, qual, label): independent bases by GC share; in damaged reads C
    turns to T from the 5' end and G to A from the 3' end, by exponential decay, and a background
    of both everywhere. Draws are hashes of (seed, read, place), so any partitioning gives the
    same reads."""
    unit = lambda salt, *c: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *c), F.lit(1 << 30)) / float(1 << 30)
    rows = spark.range(n).withColumnRenamed("id", "ord").withColumn("hit", unit(0, F.col("ord")) < damaged)

    def base(p):
        u = unit(1, F.col("ord"), p)
        drawn = F.when(u < gc / 2, "G").when(u < gc, "C").when(u < gc + (1 - gc) / 2, "A").otherwise("T")
        c2t = F.when(F.col("hit"), d5 * F.exp(-l5 * p)).otherwise(0.0) + background
        g2a = F.when(F.col("hit"), d3 * F.exp(-l3 * (size - 1 - p))).otherwise(0.0) + background
        v = unit(2, F.col("ord"), p)
        return F.when((drawn == "C") & (v < c2t), "T").when((drawn == "G") & (v < g2a), "A").otherwise(drawn)

    seq = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), base), "")
    label = F.when(F.col("hit"), "damaged").otherwise("undamaged")
    return rows.select("ord", F.concat(F.lit("@SYN:"), F.col("ord").cast("string"), F.lit(":"), label).alias("header"), seq.alias("seq"), F.repeat(F.lit(chr(33 + quality)), F.lit(size)).alias("qual"), label.alias("label"))
