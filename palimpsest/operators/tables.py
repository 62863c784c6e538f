"""Small helpers that several operators share."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where that is unset, one under /tmp if
    they are one process; on a cluster it is an error, since executors would not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or "/tmp/palimpsest-checkpoints").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a compressed Parquet table in the shared folder: lineage ends there, and executors may be lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    released(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Spark removes the files of a shuffle once the driver, Python's part and the JVM, has collected what led to it, which may be
    long after the last use. Here is where that is over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Remove tables that written() made and that nothing will read any more."""
    for df in tables:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt by key over the cores if it has fewer splits than there are cores (a table of one row
    group is one split)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


#: Tasks among which the rows of one key are spread where a key may hold a large share of all rows.
SALTS = 256


def salt(*by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str], by: str, how: str = "inner") -> DataFrame:
    """left joined to right (one row a key) on key, of which left may have very many rows: they are
    spread by the hash of column by, and right's row goes to each place where there are some. No
    row is copied that has no partner."""
    keys = [key] if isinstance(key, str) else key
    salted = left.withColumn("_salt", salt(by))
    told = salted.select(*keys, "_salt").distinct().join(right, keys)
    return salted.join(told, [*keys, "_salt"], how).drop("_salt")


def head(df: DataFrame, by: str, n: int) -> DataFrame:
    """The first n rows by a number, whose gaps do not matter: an approximate quantile (to a ten-thousandth of
    all rows) says where to cut, and only what is below it is ordered."""
    total = df.count()
    if total <= n:
        return df
    accuracy = 10_000
    cut = df.agg(F.percentile_approx(by, min(1.0, n / total + 2 / accuracy), accuracy)).first()[0]
    below = df.filter(F.col(by) <= cut)
    return (below if below.count() >= n else df).orderBy(by).limit(n)


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with the row number (from 1) in a total order, without a task that holds all rows: rows
    are dealt by ranges, numbered in each, and shifted by what the ranges before hold."""
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    local = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    sizes = ranged.groupBy("_range").count()  # a row for each range
    before = sizes.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    return local.join(before, "_range").withColumn(name, F.col("_row") + F.col("_before")).drop("_range", "_row", "_before")
