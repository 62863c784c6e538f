"""Stable sorts by read ID."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.seq import col


def lexical(read_id: Column | str = "read_id", ord_: Column | str = "ord") -> list[Column]:
    """Byte order; equal IDs keep their input order."""
    return [col(read_id).asc(), col(ord_).asc()]


def natural(read_id: Column | str = "read_id", ord_: Column | str = "ord") -> list[Column]:
    """By what stands before a trailing number, IDs without one first, then by the number."""
    x = col(read_id)
    digits = F.regexp_extract(x, r"(\d+)$", 1)
    return [F.regexp_replace(x, r"\d+$", "").asc(), (digits != "").asc(), F.when(digits != "", digits.cast("decimal(38,0)")).asc_nulls_first(), col(ord_).asc()]


def sort_reads(reads: DataFrame, by_number: bool = False) -> DataFrame:
    return reads.orderBy(*(natural() if by_number else lexical()))
