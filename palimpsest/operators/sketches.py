"""Pairs of rows of one bundle whose sketches share hashes, for many bundles at a time.

Rows of a bundle meet as neighbours, each with all its hashes; pairs, hits and ranks come from matrices of the
bundles of a block, without a join. Bundles of very many rows are told apart, for who deals them over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows that are gathered at once, rows of a bundle that is compared here, and the sum of squares of bundles that are compared at once.
ROWS, MOST, AREA = 1 << 14, 512, 1 << 19
KEYS = ["_b", "_c"]


def met(sketches: DataFrame, least: int, top: int, most: int = MOST) -> DataFrame:
    """(a, b, hits) of the rows (id, bundle, hashes) of bundles of `most` rows at most, and (id, _b, _c, hashes) of all
    others; _b and _c number the bundle."""
    kind = sketches.schema["id"].dataType.simpleString()
    rows = sketches.select("id", F.xxhash64("bundle").alias("_b"), F.xxhash64(F.lit(1), "bundle").alias("_c"), F.array_distinct("hashes").alias("hashes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held, enough, hot = 0, ROWS, None
        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            if held < enough:
                continue
            table = pa.Table.from_batches(waiting)
            b, c = (table[k].to_numpy() for k in KEYS)
            last, key = int(((b == b[-1]) & (c == c[-1])).argmax()), (b[-1], c[-1])
            if held - last > most or key == hot:
                yield from _block(table, least, top, most, hot)
                waiting, held, hot = [], 0, key
            else:
                yield from _block(table.slice(0, last), least, top, most, hot)
                waiting, held = table.slice(last).to_batches(), held - last
            enough = max(ROWS, 2 * held)
        if held:
            yield from _block(pa.Table.from_batches(waiting), least, top, most, hot)

    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "id").mapInArrow(run, f"a {kind}, b {kind}, hits long, id {kind}, _b long, _c long, hashes array<long>")


def _filled(columns: dict[str, pa.Array], id_: pa.DataType) -> pa.RecordBatch:
    types = {"a": id_, "b": id_, "hits": pa.int64(), "id": id_, "_b": pa.int64(), "_c": pa.int64(), "hashes": pa.list_(pa.int64())}
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, t) for c, t in types.items()], names=list(types))


def _block(table: pa.Table, least: int, top: int, most: int, hot: tuple | None) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    b, c = (table[k].to_numpy() for k in KEYS)
    starts = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (c[1:] != c[:-1])))
    sizes = np.diff(np.append(starts, len(b)))
    over = sizes > most
    if hot is not None:
        over |= (b[starts] == hot[0]) & (c[starts] == hot[1])
    id_ = table.schema.field("id").type
    if over.any():
        for x in table.filter(pa.array(np.repeat(over, sizes))).combine_chunks().to_batches():
            yield _filled({n: x.column(n) for n in ("id", *KEYS, "hashes")}, id_)
    fine = table.filter(pa.array(np.repeat((sizes > 1) & ~over, sizes))).combine_chunks()
    sizes = sizes[(sizes > 1) & ~over]
    if not len(sizes):
        return
    at = np.append(0, np.cumsum(sizes))
    area = np.cumsum(sizes.astype(np.int64) ** 2) // AREA
    for of in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(area)) + 1):
        first, last = at[of[0]], at[of[-1] + 1]
        yield from _told(fine.slice(first, last - first).combine_chunks().to_batches()[0], sizes[of], least, top, id_)


def _told(rows: pa.RecordBatch, sizes: np.ndarray, least: int, top: int, id_: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of whole bundles, by id in each."""
    n = rows.num_rows
    lists = rows.column("hashes")
    owner = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    hashes, group = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)[owner]
    order = np.lexsort((owner, hashes, group))
    owner, hashes, group = owner[order], hashes[order], group[order]
    begins = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (group[1:] != group[:-1]))) if len(owner) else np.zeros(0, int)
    runs = np.diff(np.append(begins, len(owner)))
    left = np.repeat(runs, runs) - (np.arange(len(owner)) - np.repeat(begins, runs))  # rows of the run from this one on
    found, d, some = [], 1, np.flatnonzero(left > 1)
    while len(some):
        found.append(owner[some] * n + owner[some + d])
        d += 1
        some = some[left[some] > d]
    if not found:
        return
    pairs, hits = np.unique(np.concatenate(found), return_counts=True)
    pairs, hits = pairs[hits >= least], hits[hits >= least]
    i, j = pairs // n, pairs % n
    order = np.lexsort((i, -hits, j))
    i, j, hits = i[order], j[order], hits[order]
    firsts = np.flatnonzero(np.append(True, j[1:] != j[:-1])) if len(j) else np.zeros(0, int)
    keep = np.arange(len(j)) - np.repeat(firsts, np.diff(np.append(firsts, len(j)))) < top
    ids = rows.column("id")
    yield _filled({"a": ids.take(pa.array(i[keep])), "b": ids.take(pa.array(j[keep])), "hits": pa.array(hits[keep].astype(np.int64))}, id_)
