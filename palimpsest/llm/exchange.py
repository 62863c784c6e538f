"""Questions about all documents, asked and answered in blobs.

Documents are dealt into chunks of a bounded number of bytes. A chunk sends each key it holds once
(a word, a shingle, a text segment, as a 64-bit hash) to the bucket that owns the key's range, and
the bucket answers every chunk that asked. A key that a third of all documents hold so reaches its
bucket once from each chunk, not once from each document, and what travels is arrays of numbers.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import tables

#: Bytes of text in a chunk, on average.
CHUNK_BYTES = 4 << 20


def chunked(docs: DataFrame, text: str, key: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """docs with the column _chunk, and the number of chunks, which grows with the bytes of text."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64)).first()[0] or 0
    n = max(1, -(-int(total) // chunk_bytes))
    return docs.withColumn("_chunk", F.pmod(F.xxhash64(key, text), F.lit(n)).cast("int")), n


def cuts(ordered: np.ndarray, n: int) -> np.ndarray:
    """Where n equal ranges of 64-bit keys begin and end in ordered."""
    if n == 1:
        return np.array([0, len(ordered)])
    edges = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(ordered, edges), [len(ordered)]])


def buckets(chunks: int) -> int:
    """Buckets for so many chunks: fewer, so that a chunk's blobs stay large and their number small."""
    return max(min(chunks, 64), -(-chunks // 8))


def placed(ordered: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where n equal ranges of sorted 64-bit keys begin and end, and each key's place (32 bits) in its range."""
    edges = np.array([-((-i << 64) // n) for i in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(ordered, edges), [len(ordered)]]).astype(np.int64), ((ordered * np.uint64(n)) >> np.uint64(32)).astype(np.uint32)


def pack(values: np.ndarray) -> bytes:
    """Bytes by significance, so that the zeros of small numbers compress."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpack(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def blobs(column: pa.ChunkedArray) -> list[bytes]:
    return [x.as_py() for x in column]


def released() -> None:
    """Give back what Arrow and the allocator keep of freed memory, before the next group's is
    taken and where a task ends: workers are used again, and idle ones count too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 512) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by key (integers): groups are gathered until they
    have about `rows` rows, so that many small ones cost one call; a group is never split."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        at = 0
        while at < len(keys):
            if count < rows:
                to = min(len(keys), at + rows - count)
                held.append(batch.slice(at, to - at))
                count, at, last = count + to - at, to, keys[to - 1]
            else:  # to the end of the group that is open
                to = at + int(np.argmax(np.append(keys[at:] != last, True)))
                if to > at:
                    held.append(batch.slice(at, to - at))
                at = to
                if at < len(keys):
                    yield pa.Table.from_batches(held)
                    held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


def small_batches(spark) -> None:
    """Bound the Arrow batches of this session: rows hold whole texts, and the defaults (10,000
    rows, 64 MB) take several copies of that in the JVM and in each Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_folder(spark) -> str:
    """spark.checkpoint.dir of the session; where that is unset, as in tests, one under /tmp, and on a
    cluster an error."""
    return tables.shared_folder(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a compressed Parquet table in the shared checkpoint folder."""
    import uuid

    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
