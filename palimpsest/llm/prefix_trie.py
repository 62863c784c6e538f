"""The trie of all conversations' prefixes, built level by level.

A turn is a digest of role and text and a number of words; equal sequences of turns are one path with
a count before the trie is built. Level by level, live paths are grouped by (node, next turn) and the
group's smallest conversation names the new node; a node that holds a single path needs no further
levels, since below it there is but a chain. Then the levels are joined from the deepest up, which
rolls leaves and savings up into each parent. There are as many levels as the longest prefix that two
different sequences share. A node that a third of all paths pass is grouped with partial sums, and
the paths that go on from it are spread (`tables.spread_join`).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from palimpsest.llm.exchange import shared_folder, written
from palimpsest.operators.tables import spread_join

WORD = r"[^\x20\x09-\x0D]+"
#: Conversation ids that share all but so many low bits are hashed as one piece of text.
ID_BITS = 12


def sequences(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, keys (a digest for each turn) and words (running sums), one row for each conversation.

    Turns are ordered by turn (null first), then role, then text; null roles and texts are empty;
    repeated rows are turns of their own; rows without a conversation are left out."""
    rows = conversations.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_text")
    key = F.substring(F.sha2(F.concat(F.octet_length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256), 1, 32)
    placed = rows.select("conv_id", key.alias("key"), F.row_number().over(order).alias("place"), F.sum(F.regexp_count("_text", F.lit(WORD))).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("words"))
    turns = F.array_sort(F.collect_list(F.struct("place", "key", "words")))
    return placed.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.words").alias("words"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """convs (conv_id, keys, words), where each conversation c begins with the first h turns of c - c % 20
    (all if it has fewer, none if it is absent) in place of its own first h; h = crc32(c) % 4."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(4)).cast("int")
    heads = convs.filter(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("_base"), F.slice("keys", 1, 3).alias("_keys"), F.slice("words", 1, 3).alias("_words"))
    rows = convs.withColumn("_h", h).withColumn("_base", F.col("conv_id") - F.col("conv_id") % 20).join(heads, "_base", "left")
    rows = rows.withColumn("_k", F.least("_h", F.coalesce(F.size(F.coalesce("_keys", F.array())), F.lit(0))))
    none = lambda of, kind: F.coalesce(F.col(of), F.array().cast(f"array<{kind}>"))
    first = lambda of, kind: F.slice(none(of, kind), F.lit(1), F.col("_k"))
    last = lambda of: F.slice(of, F.col("_h") + 1, F.greatest(F.size(of) - F.col("_h"), F.lit(0)))
    sum_at = lambda of, n: F.coalesce(F.get(of, n - 1), F.lit(0))
    shift = sum_at(none("_words", "bigint"), F.col("_k")) - sum_at(F.col("words"), F.col("_h"))
    words = F.concat(first("_words", "bigint"), F.transform(last("words"), lambda x: x + shift))
    return rows.select("conv_id", F.concat(first("_keys", "string"), last("keys")).alias("keys"), words.alias("words"))


def id_hashes(members: DataFrame, key: str) -> DataFrame:
    """key and ends_sha256: the hash of each key's conv_ids, ascending and comma-joined. Ids are joined
    in pieces of 4,096 at most; a key's pieces stream through its hash in order, one at a time."""
    pieces = members.groupBy(key, F.shiftright("conv_id", ID_BITS).alias("_piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("_ids"))
    ordered = pieces.repartition(key).sortWithinPartitions(key, "_piece").select(key, "_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, done = None, None, ([], [])
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k == last:
                    digest.update(b",")
                else:
                    if digest is not None:
                        done[0].append(last), done[1].append(digest.hexdigest())
                    last, digest = k, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.string()), pa.array(done[1], pa.string())], names=[key, "ends_sha256"])
            done = ([], [])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=[key, "ends_sha256"])

    return ordered.mapInArrow(run, f"{key} string, ends_sha256 string")


class _Levels:
    """Tables by depth, in one folder for each kind, so that all depths are read as one table."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.schema = spark, f"{shared_folder(spark).rstrip('/')}/trie-{uuid.uuid4().hex}", {}

    def keep(self, kind: str, depth: int, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{kind}/depth={depth}")
        self.schema[kind] = df.schema
        return self.at(kind, depth)

    def at(self, kind: str, depth: int) -> DataFrame:
        return self.spark.read.schema(self.schema[kind]).parquet(f"{self.folder}/{kind}/depth={depth}")

    def all(self, kind: str) -> DataFrame:
        whole = StructType([*self.schema[kind].fields, StructField("depth", LongType())])
        return self.spark.read.schema(whole).parquet(f"{self.folder}/{kind}")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row for each node of the trie over convs (conv_id, keys, words; conv_id unique): conv_id (the
    smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (of the
    subtree), saved_tokens (of the subtree: words of a node's last turn once for each member but one)
    and ends_sha256 (of the ids of the members that end there).

    Conversations without turns are members of the root; without any conversation there is no node."""
    spark = convs.sparkSession
    convs = written(convs.withColumn("seq", F.sha2(F.array_join("keys", ""), 256)), "trie-conversations")
    ends = id_hashes(convs.select("seq", "conv_id"), "seq")
    paths = convs.groupBy("seq").agg(F.min("conv_id").alias("path"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("words").alias("words"))
    paths = written(paths.withColumn("size", F.size("keys").cast("long")), "trie-paths")
    levels = _Levels(spark)
    top = paths.agg(F.min("path").alias("conv_id"), F.sum("n").alias("n_convs"), F.count("*").alias("n_paths")).filter("n_paths > 0")
    level = levels.keep("level", 0, top.select("conv_id", F.lit(None).cast("long").alias("parent"), "n_convs", "n_paths", F.lit(0).cast("long").alias("words")))
    if not (root := level.first()):
        return spark.createDataFrame([], _NODE)
    live = levels.keep("live", 0, paths.filter(F.lit(root.n_paths > 1)).withColumn("node", F.lit(root.conv_id)))
    depth = 0
    while not live.isEmpty():
        depth += 1
        level, live = _descend(levels, live, depth)
    for at in range(depth, -1, -1):
        _ascend(levels, paths, at, deepest=at == depth)
    chained = _chains(levels.all("done").filter("n_paths = 1"), paths)
    nodes = levels.all("done").select(*_COLUMNS).unionByName(chained.select(*_COLUMNS))
    # Where paths end: at nodes of several paths, or at the end of a chain.
    stops = levels.all("live").filter("size = depth").select("depth", F.col("node").alias("conv_id"), "seq")
    alone = levels.all("done").filter("n_paths = 1").select(F.col("conv_id").alias("path")).distinct().join(paths, "path").select(F.col("size").alias("depth"), F.col("path").alias("conv_id"), "seq")
    told = stops.unionByName(alone).join(ends, "seq").drop("seq")
    return nodes.join(told, ["depth", "conv_id"], "left").select(*_COLUMNS, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_NODE = ", ".join(f"{c} bigint" for c in _COLUMNS) + ", ends_sha256 string"


def _at(array: str, place: Column | int) -> Column:
    """The running sum up to a place (from 1; 0 before it)."""
    place = F.lit(place) if isinstance(place, int) else place
    return F.coalesce(F.get(array, (place - 1).cast("int")), F.lit(0))


def _descend(levels: _Levels, live: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of a depth from the live paths above it, and the paths that stay live."""
    on = live.filter(F.col("size") >= depth).withColumn("key", F.get("keys", F.lit(depth - 1)))
    said = _at("words", depth) - _at("words", depth - 1)
    grouped = on.groupBy("node", "key").agg(F.min("path").alias("conv_id"), F.sum("n").alias("n_convs"), F.count("*").alias("n_paths"), F.min(said).alias("words"))
    level = levels.keep("level", depth, grouped.select("conv_id", F.col("node").alias("parent"), "n_convs", "n_paths", "words", "key"))
    shared = level.filter("n_paths > 1").select(F.col("parent").alias("node"), "key", F.col("conv_id").alias("next"))
    return level, levels.keep("live", depth, spread_join(on, shared, ["node", "key"], by="path").drop("node", "key").withColumnRenamed("next", "node").select(live.columns))


def _ascend(levels: _Levels, paths: DataFrame, depth: int, deepest: bool) -> None:
    """The nodes of a depth with what is below them: chains, or the sums of the depth beneath."""
    level = levels.at("level", depth).select("conv_id", F.col("parent").alias("parent_conv_id"), "n_convs", "n_paths", ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    whole = lambda df: df.select("conv_id", "parent_conv_id", "n_convs", "n_paths", "n_children", "n_leaves", "saved_tokens")
    tail = paths.select(F.col("path").alias("conv_id"), "size", (F.col("n") - 1).alias("_again"), (_at("words", F.col("size")) - _at("words", depth)).alias("_left"))
    one = level.filter("n_paths = 1").join(tail, "conv_id")
    one = one.select("*", (F.col("size") > depth).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), (F.col("own") + F.col("_again") * F.col("_left")).alias("saved_tokens"))
    done = whole(one)
    if not deepest:
        below = levels.at("done", depth + 1).groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("_saved"))
        done = done.unionByName(whole(level.filter("n_paths > 1").join(below, "conv_id").withColumn("saved_tokens", F.col("own") + F.col("_saved"))))
    levels.keep("done", depth, done)


def _chains(alone: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes below nodes that a single path passes."""
    rows = alone.select(F.col("conv_id").alias("path"), F.col("depth").alias("_from")).join(paths, "path").filter(F.col("size") > F.col("_from"))
    left = F.get("words", (F.col("size") - 1).cast("int")) - F.coalesce(F.get("words", (F.col("depth") - 2).cast("int")), F.lit(0))
    return rows.withColumn("depth", F.explode(F.sequence(F.col("_from") + 1, F.col("size")))).select(
        F.col("path").alias("conv_id"), "depth", F.col("path").alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.col("depth") < F.col("size")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * left).alias("saved_tokens"),
    )
