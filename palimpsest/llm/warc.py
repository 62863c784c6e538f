"""Merkle fixity audit of WARC replicas.

Records are hashed where they lie; ordered offset ranges, each with its start, length and digest,
make trees of bounded fan-out, one for each archive. Two replicas are compared from the roots down: only children of nodes that
differ are joined at the next level, so an intact archive costs one comparison and a damaged one a
path to each damaged record. Only digests are shuffled, never records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.exchange import written

#: Children of a node; records with consecutive ids in an archive; least depth of a tree.
FANOUT, ARCHIVE_RECORDS, DEPTH = 16, 1024, 3


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A response record as text; null parts are empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def manifest(pages: DataFrame, archive_records: int = ARCHIVE_RECORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """archive, seq, record_offset, record_length, page_id, digest of each page's record, and keep.

    Pages whose ids lie in one range of archive_records ids share an archive, in order of id (equal
    ids: of digest). Pages without an id are dealt by their digest into 4,096 archives with
    negative numbers. Repeated rows are records each; an empty table has no archives. keep must not
    name a column of the result."""
    whole = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(whole, 256).alias("digest"), F.octet_length(whole).cast("long").alias("record_length"), *keep)
    rows = rows.withColumn("archive", F.coalesce(F.floor(F.col("page_id") / archive_records), -1 - F.pmod(F.xxhash64("digest"), F.lit(4096))))
    order = Window.partitionBy("archive").orderBy("page_id", "digest", *keep)
    return rows.select("archive", (F.row_number().over(order) - 1).cast("long").alias("seq"), (F.sum("record_length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("record_length")).alias("record_offset"), "record_length", "page_id", "digest", *keep)


def leaves(records: DataFrame) -> DataFrame:
    """Nodes (archive, idx, start, size, digest) of records (archive, seq, record_offset, record_length, digest)."""
    return records.select("archive", F.col("seq").alias("idx"), F.col("record_offset").alias("start"), F.col("record_length").alias("size"), "digest")


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One level up: of each run of fanout nodes the range that they cover and the digest of their
    places, ranges and digests in order."""
    line = F.concat_ws(":", *(F.col(c).cast("string") for c in ("idx", "start", "size", "digest")))
    child = F.sort_array(F.collect_list(F.struct("idx", line.alias("line"))))  # fanout at most
    above = nodes.groupBy("archive", F.expr(f"idx div {fanout}").alias("up")).agg(F.min("start").alias("start"), F.sum("size").alias("size"), F.sha2(F.array_join(F.transform(child, lambda x: x["line"]), "\n"), 256).alias("digest"))
    return above.withColumnRenamed("up", "idx")


def tree(nodes: DataFrame, depth: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves to the roots, each a table, so that comparing reads what it visits."""
    levels = [written(nodes, "leaves")]
    for _ in range(depth):
        levels.append(written(parents(levels[-1], fanout), "nodes"))
    return levels


def audit(primary: list[DataFrame], replica: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """archive, idx, status (changed, missing, extra) of each leaf in which the trees differ. Nodes
    are compared by range and digest; below a node that agrees nothing is read again."""
    differing = None
    for a, b in zip(reversed(primary), reversed(replica), strict=True):
        left = a.select("archive", "idx", F.struct("start", "size", "digest").alias("a"))
        right = b.select("archive", "idx", F.struct("start", "size", "digest").alias("b"))
        if differing is not None:
            left, right = (x.withColumn("up", F.expr(f"idx div {fanout}")).join(differing, ["archive", "up"], "left_semi").drop("up") for x in (left, right))
        found = left.join(right, ["archive", "idx"], "full").filter("NOT a <=> b")
        differing = found.select("archive", F.col("idx").alias("up"))
    return found.select("archive", "idx", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed").alias("status"))


def audit_replica(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """What a replica's records (archive, seq, record_offset, record_length, digest: the places under
    which they were stored, and what is there now) differ in from the primary's manifest: the
    record's place and length, status, the digest that its lowest range must have, and the root.
    A record that the manifest lacks has null for what the manifest knows. An intact or empty replica
    of an intact or empty primary gives no rows."""
    held = written(primary, "manifest")
    other = written(leaves(replica), "replica")
    most = max(held.agg(F.max("seq")).first()[0] or 0, other.agg(F.max("idx")).first()[0] or 0)
    depth = DEPTH
    while fanout**depth <= most:
        depth += 1
    a, b = tree(leaves(held), depth, fanout), tree(other, depth, fanout)
    found = audit(a, b, fanout).withColumn("up", F.expr(f"idx div {fanout}"))
    ranges = a[1].select("archive", F.col("idx").alias("up"), F.col("digest").alias("range_sha256"))
    roots = a[-1].select("archive", F.col("digest").alias("root_sha256"))
    placed = held.select("archive", F.col("seq").alias("idx"), "record_offset", "record_length", "page_id")
    return found.join(placed, ["archive", "idx"], "left").join(ranges, ["archive", "up"], "left").join(roots, "archive", "left").select("archive", F.col("idx").alias("seq"), "record_offset", "record_length", "page_id", "status", "range_sha256", "root_sha256")
