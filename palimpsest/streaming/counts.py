"""Count tables and exact deduplication over streams of reads.

All count tables are sums, so a stream's table is the sum of its batches' tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions import seq as S


def accumulate(stream: DataFrame, table: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write table(batch) of each batch to path/batch=N. A batch that is replayed after a failure
    overwrites its own folder, so each counts once; total() sums them."""

    def put(batch: DataFrame, n: int) -> None:
        table(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total(spark, path: str, keys: list[str]) -> DataFrame:
    parts = spark.read.parquet(path).drop("batch")
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in keys])


def first_seen(stream: DataFrame, time: str = "ts", delay: str = "1 hour", both_strands: bool = True) -> DataFrame:
    """Reads whose molecule has not been seen within delay; state is dropped behind the watermark."""
    return stream.withColumn("canon", S.canonical("seq", both_strands)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["canon"])
