"""Mixing sources to target weights by blocks.

The words of each source, its documents in a pseudorandom order, form one stream that is packed
into blocks of a fixed number of words. Each output shard draws the number of slots it gives to
each source from a multinomial over what the sources are still owed, so shards vary while the
totals come out as planned. A source's slots are numbered through all shards; slot j is mapped
through the source's pseudorandom index permutation of epoch j // blocks, and block contents are
joined by (source, block). Only identifiers and sizes are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.textblocks import blocks, totals

#: Words in a block, slots in an output shard, most passes over a source.
BLOCK_WORDS, SHARD_SLOTS, MAX_EPOCHS = 64, 256, 3
WEIGHTS = (5.0, 2.0, 1.0)
#: The plan for the sources is made on the driver; more sources than this are refused.
MAX_SOURCES = 100_000
#: Parts that prefix sums over a source are split into.
PARTS = 1024


def plan(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = MAX_EPOCHS) -> dict[str | None, float]:
    """Targets in words: sources by code point (null last) weigh as weights repeat and share the
    sum of all sizes; no target is above most times its source, the rest is shared again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), list(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """index (below n) under the pseudorandom permutation of range(n) that key names: a Feistel
    network on the next power of four, walked until it lands below n."""
    with np.errstate(over="ignore"):
        n = n.astype(np.uint64)
        half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
        mask = (np.uint64(1) << half) - np.uint64(1)
        out, todo = index.astype(np.uint64), np.arange(len(index))
        while len(todo):
            left, right, m, k = out[todo] >> half[todo], out[todo] & mask[todo], mask[todo], key[todo]
            for i in range(4):
                f = (right + k + np.uint64(i)) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
            out[todo] = (left << half[todo]) | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def shard_counts(owed: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial counts of one shard, by what the sources are owed; what a draw takes beyond
    that is drawn anew from the others."""
    counts, left = np.zeros_like(owed), min(slots, int(owed.sum()))
    while left:
        open_ = owed - counts
        counts += np.minimum(rng.multinomial(left, open_ / open_.sum()), open_)
        left = min(slots, int(owed.sum())) - int(counts.sum())
    return counts


def sized(docs: DataFrame, text: str, keys: tuple[str, ...]) -> DataFrame:
    """keys and size, the number of words of each text."""
    rows = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), "size bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in blocks(batch.column(len(keys))):
                size = totals(block.words()[2], len(block))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(block)) for i in range(len(keys))), pa.array(size)], names=[*keys, "size"])

    return rows.mapInArrow(run, schema)


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(documents, slots).

    documents has a row for each input row: doc_id, source, size, source_size, target, taken, and
    draws: how often the mix takes each piece of the document that lies in one block, as an array
    of (from, to, times) in words. slots has a row for each slot of the output: shard, source,
    epoch, block. Rows with null or repeated doc_id, null source or null text are ordinary rows
    (size 0 without words; such rows are never taken). Reruns give the same rows; an empty table
    gives empty tables."""
    spark = docs.sparkSession
    rows = sized(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")), "text", ("doc_id", "source"))
    # A row's place in its source: by hash, then (for rows that agree in it) by id.
    rows = rows.withColumn("_place", F.xxhash64("doc_id", "size", F.lit(seed))).withColumn("_part", F.pmod(F.shiftrightunsigned("_place", 7), F.lit(PARTS)).cast("int"))
    parts = rows.groupBy("source", "_part").agg(F.sum("size").alias("_n"))
    # At most MAX_SOURCES x PARTS sums, whatever the number of rows.
    sums = parts.toPandas()
    sums = sums.assign(source=sums["source"].astype(object).where(sums["source"].notna(), None)).sort_values(["_part"], kind="stable")
    sizes: dict[str | None, int] = {}
    before = []
    for s, n in zip(sums["source"], sums["_n"], strict=True):
        before.append(sizes.get(s, 0))
        sizes[s] = sizes.get(s, 0) + int(n)
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"{len(sizes)} sources; the plan takes {MAX_SOURCES} at most")
    target = plan(sizes, weights)
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    number = np.array([-(-sizes[s] // block_words) for s in names], np.int64)
    quota = np.array([min(MAX_EPOCHS * b, round(target[s] / sizes[s] * b)) if b else 0 for s, b in zip(names, number, strict=True)], np.int64)

    # What each shard group is owed, then each shard of a group: a draw from the rest each time.
    shards = -(-int(quota.sum()) // shard_slots)
    groups = max(1, min(shards, 256))
    rng, owed, first, grants = np.random.default_rng(seed), quota.copy(), np.zeros_like(quota), []
    for g in range(groups if shards else 0):
        span = (shards * (g + 1)) // groups - (shards * g) // groups
        got = shard_counts(owed, span * shard_slots, rng)
        grants.append((g, (shards * g) // groups, span, got.tolist(), first.tolist()))
        owed, first = owed - got, first + got
    label = {i: s for i, s in enumerate(names)}
    per_source = spark.createDataFrame([(i, s, sizes[s], float(target[s]), int(number[i])) for i, s in label.items()], "_s int, source string, source_size bigint, target double, _blocks bigint")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, shard, span, got, start in batch.itertuples(index=False):
                got, start = np.array(got, np.int64), np.array(start, np.int64)
                rng = np.random.default_rng([seed, int(g)])
                for k in range(span):
                    n = shard_counts(got, shard_slots, rng)
                    who = np.repeat(np.arange(len(n)), n)
                    j = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + start[who]
                    epoch = j // number[who]
                    key = (who.astype(np.uint64) << np.uint64(20)) + epoch.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed)
                    yield pd.DataFrame({"shard": shard + k, "_s": who.astype(np.int32), "epoch": epoch.astype(np.int32), "block": permuted(j % number[who], number[who], key)})
                    got, start = got - n, start + n

    shape = "g int, shard bigint, span bigint, got array<bigint>, start array<bigint>"
    granted = spark.createDataFrame(grants, shape).repartition(max(1, min(groups, 2 * spark.sparkContext.defaultParallelism)), "g")
    slots = granted.mapInPandas(draw, "shard bigint, _s int, epoch int, block bigint")

    # Where each document begins in its source's stream.
    at = spark.createDataFrame([(s, int(p), b) for s, p, b in zip(sums["source"], sums["_part"], before, strict=True)], "source string, _part int, _before bigint")
    rows = rows.join(at.withColumnRenamed("source", "_src").withColumnRenamed("_part", "_p"), F.col("source").eqNullSafe(F.col("_src")) & (F.col("_part") == F.col("_p")))
    rows = rows.join(F.broadcast(per_source.withColumnRenamed("source", "_src2")), F.col("source").eqNullSafe(F.col("_src2")))
    order = Window.partitionBy("_s", "_part").orderBy("_place", F.col("doc_id").asc_nulls_last(), "size")
    rows = rows.withColumn("_end", F.col("_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_row", F.row_number().over(order))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "_s", "_part", "_row", (F.col("_end") - F.col("size")).alias("_from"), "_end")
    pieces = rows.withColumn("block", F.explode_outer(F.expr(f"if(size > 0, sequence(_from div {block_words}, (_end - 1) div {block_words}), null)")))
    times = slots.groupBy("_s", "block").agg(F.count("*").alias("times"))
    begin = F.greatest(F.col("block") * block_words, F.col("_from")) - F.col("_from")
    end = F.least((F.col("block") + 1) * block_words, F.col("_end")) - F.col("_from")
    drawn = pieces.join(times.hint("merge"), ["_s", "block"], "left").withColumn("_cut", F.when(F.col("times").isNotNull(), F.struct(begin.alias("from"), end.alias("to"), "times")))
    documents = drawn.groupBy("_s", "_part", "_row", "doc_id", "source", "size", "source_size", "target").agg(F.coalesce(F.sum((end - begin) * F.col("times")), F.lit(0)).cast("long").alias("taken"), F.sort_array(F.collect_list("_cut")).alias("draws"))
    documents = documents.select("doc_id", "source", "size", "source_size", "target", "taken", "draws")
    return documents, slots.join(F.broadcast(per_source.select("_s", "source")), "_s").select("shard", "source", "epoch", "block")


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs as the mix takes them: a row for each time a part of a document is taken, with the text
    cut to the words taken that time. Words that follow each other in the document keep what stands
    between them; parts that do not are joined by a newline. Documents never taken are left out."""
    columns = docs.columns
    keyed = docs.withColumn("_key", F.xxhash64(F.col(doc_id), F.col(text), F.col(source)))
    plan_of = mix_sources(keyed.withColumn("_id", F.col("_key")), text, source, "_id", **options)[0].select(F.col("doc_id").alias("_key"), "draws", F.row_number().over(Window.partitionBy("doc_id").orderBy("draws")).alias("_nth"))
    keyed = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0))))
    rows = keyed.join(plan_of.filter("size(draws) > 0"), ["_key", "_nth"]).select(*columns, F.expr("transform(draws, x -> array(x.from, x.to, x.times))").alias("_draws"))
    kept, place = rows.schema[: len(columns)], columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in blocks(batch.column(place)):
                starts, ends, owner = block.words()
                first = np.searchsorted(owner, np.arange(len(block)))
                who, texts = [], []
                for i, draws in enumerate(batch.column(len(columns)).slice(at, len(block)).to_pylist()):
                    for t in range(1, max(d[2] for d in draws) + 1):
                        runs: list[list[int]] = []
                        for a, b, times in draws:
                            if times >= t and runs and runs[-1][1] == a:
                                runs[-1][1] = b
                            elif times >= t:
                                runs.append([a, b])
                        who.append(at + i)
                        texts.append(b"\n".join(block.data[starts[first[i] + a] : ends[first[i] + b - 1]].tobytes() for a, b in runs).decode())
                taken = batch.select(list(range(len(columns)))).take(pa.array(who, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if j == place else c for j, c in enumerate(taken.columns)], names=columns)

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept))
