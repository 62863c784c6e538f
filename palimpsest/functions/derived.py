"""Reads derived from whole documents: the letters of a text, written as bases, in pieces of 60."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from palimpsest.operators.tables import spread

# Letters to bases.
LETTERS, AS_BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
READ, LEAST, PER_DOCUMENT = 60, 30, 1 << 20
_BASE_OF = np.zeros(256, np.uint8)
_BASE_OF[np.frombuffer(LETTERS.encode(), np.uint8)] = np.frombuffer(AS_BASES.encode(), np.uint8)


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, one string after the other, and where each begins and the last ends. Null is empty."""
    whole = pa.concat_arrays([strings.fill_null("").cast(pa.large_string())])
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return held, ends - ends[0]


def strings_of(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The string array of ASCII bytes and ends that flat() gives."""
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


@F.arrow_udf(ArrayType(StringType()))
def _pieces(text: pa.Array) -> pa.Array:
    """The a-z of each lower-case text as bases, in pieces of READ; the letters of a batch are taken at once. Bytes of
    other characters of UTF-8 are no letters."""
    data, ends = flat(text)
    bases = _BASE_OF[data]
    kept = bases > 0
    ends = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[ends]
    sizes = np.diff(ends)
    counts = (sizes + READ - 1) // READ
    first = np.concatenate([[0], np.cumsum(counts)])
    k = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    cuts = np.append(np.repeat(ends[:-1], counts) + k * READ, ends[-1])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), strings_of(bases[kept], cuts))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, doc_id, seq: every piece of at least 30 bases of every document. A text is cut once, and
    a table of fewer splits than cores is dealt over the cores before."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    pieces = docs.select("doc_id", _pieces(F.lower("text")).alias("pieces")).select("doc_id", F.posexplode("pieces").alias("k", "seq"))
    return pieces.select((F.col("doc_id") * PER_DOCUMENT + F.col("k")).alias("ord"), "doc_id", "seq").filter(F.length("seq") >= LEAST)


READS_SQL = f"""
reads AS (SELECT doc_id * {PER_DOCUMENT} + k AS ord, doc_id, substr(bases, k * {READ} + 1, {READ}) AS seq
  FROM (SELECT doc_id, bases, unnest(range(0, (length(bases) - 1) // {READ} + 1)) AS k
    FROM (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{AS_BASES}') AS bases FROM documents) WHERE length(bases) >= {LEAST})
  WHERE length(substr(bases, k * {READ} + 1, {READ})) >= {LEAST})"""


def rc_sql(x: str) -> str:
    return f"translate(reverse({x}), 'ACGT', 'TGCA')"


@F.arrow_udf(StringType())
def _qualities(seq: pa.Array, phase: pa.Array) -> pa.Array:
    data, ends = flat(seq)
    sizes = np.diff(ends)
    place = np.arange(len(data), dtype=np.int32) - np.repeat(ends[:-1].astype(np.int32), sizes)
    marks = data * np.int32(7) + place * np.int32(3) + np.repeat(phase.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32), sizes)
    return strings_of((marks % 41 + 33).astype(np.uint8), ends)


def quality(seq: Column | str = "seq", ord_: Column | str = "ord") -> Column:
    """A quality string that depends on base, place and read, for all bases of a batch at once. Sequences are ASCII."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    ord_ = F.col(ord_) if isinstance(ord_, str) else ord_
    return _qualities(seq, F.pmod(ord_ + 3, F.lit(41)).cast("int"))


QUALITY_SQL = "array_to_string([chr((33 + (ascii(substr(seq, i, 1)) * 7 + i * 3 + ord) % 41)::INT) for i in range(1, length(seq) + 1)], '')"


def mutated(reads: DataFrame) -> DataFrame:
    """reads (rid, seq, qual) with copies, single transversions and transitions of low quality,
    terminal damage and reverse complements."""
    full = reads.filter(F.length("seq") == READ)
    pick = F.col("ord") % 4
    at = (30 + F.col("ord") % 5).cast("int")
    other = F.translate(F.col("seq").substr(at, F.lit(1)), "ACGT", "TGCA")
    row = lambda k, s: F.struct(F.lit(k).alias("k"), s.alias("seq"))
    seq = F.col("seq")
    copies = F.when(pick == 0, F.array(row(1, seq), row(2, seq), row(3, seq), row(7, F.overlay(seq, other, at, F.lit(1)))))
    turn = F.translate(F.col("seq").substr(at, F.lit(1)), "ACGT", "GTAC")
    copies = copies.when(pick == 3, F.array(row(1, seq), row(2, seq), row(3, seq), row(6, F.overlay(seq, turn, at, F.lit(1)))))
    copies = copies.when(pick == 1, F.array(row(8, F.regexp_replace(seq, "^C", "T")))).otherwise(F.array(row(9, F.translate(F.reverse(seq), "ACGT", "TGCA"))))
    every = F.concat(F.array(row(0, seq)), copies)
    rows = full.select("ord", F.explode(every).alias("r")).select((F.col("ord") * 10 + F.col("r.k")).alias("rid"), "r.seq")
    return rows.select("rid", "seq", mutated_quality("seq", "rid").alias("qual"))


def mutated_quality(seq: Column | str, rid: Column | str) -> Column:
    """The quality string of a read that mutated() gives, by its sequence and number: poor at the base that
    the copies 6 and 7 have changed."""
    rid = F.col(rid) if isinstance(rid, str) else rid
    at = (30 + F.floor(rid / 10) % 5).cast("int")
    qual = quality(seq, rid)
    return F.when((rid % 10).isin(6, 7), F.overlay(qual, F.lit("0"), at, F.lit(1))).otherwise(qual)


MUTATED_SQL = f"""{READS_SQL},
whole AS (SELECT ord, seq, 30 + ord % 5 AS place FROM reads WHERE length(seq) = {READ}),
copied AS (SELECT ord * 10 AS ord, seq, 0 AS k, place FROM whole
  UNION ALL SELECT ord * 10 + k, seq, k, place FROM whole, (VALUES (1), (2), (3)) t(k) WHERE ord % 4 IN (0, 3)
  UNION ALL SELECT ord * 10 + 6, substr(seq, 1, (place - 1)::INT) || translate(substr(seq, place::INT, 1), 'ACGT', 'GTAC') || substr(seq, (place + 1)::INT), 6, place FROM whole WHERE ord % 4 = 3
  UNION ALL SELECT ord * 10 + 7, substr(seq, 1, (place - 1)::INT) || translate(substr(seq, place::INT, 1), 'ACGT', 'TGCA') || substr(seq, (place + 1)::INT), 7, place FROM whole WHERE ord % 4 = 0
  UNION ALL SELECT ord * 10 + 8, regexp_replace(seq, '^C', 'T'), 8, place FROM whole WHERE ord % 4 = 1
  UNION ALL SELECT ord * 10 + 9, {rc_sql('seq')}, 9, place FROM whole WHERE ord % 4 = 2),
quals AS (SELECT *, {QUALITY_SQL} AS q FROM copied),
mutated AS (SELECT ord AS rid, seq, CASE WHEN k IN (6, 7) THEN substr(q, 1, (place - 1)::INT) || '0' || substr(q, (place + 1)::INT) ELSE q END AS qual FROM quals)"""
