"""Quality rules by repetition coverage.

Rolling hashes of several word n-gram lengths mark the words that stand in an n-gram found twice
or more in the same text, and the lines that repeat an earlier one; the share of a text's
characters under those marks decides. All of it is array work on blocks of texts in an Arrow map:
no shuffle, and memory is bounded by a block (or one text, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textblocks import Block, Roller, blocks, member, mix, present_twice, totals

#: Share of a text's word characters that may lie in duplicated n-grams of each length.
NGRAM_LIMITS = {5: 0.25, 8: 0.20, 12: 0.15}
#: Share of a text's word characters that may lie in lines equal to an earlier one.
LINE_LIMIT = 0.30
MIN_WORDS, REPEAT_PERCENT, BASE_NGRAM = 10, 20, 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def covered(ids: np.ndarray, lengths: list[int], roller: Roller, owner: np.ndarray) -> dict[int, np.ndarray]:
    """For each length, True at the words inside an n-gram that its text holds twice or more.

    A long n-gram can only repeat where the shorter one at the same place does, so each length
    looks at the survivors of the one before."""
    prefix, n = roller.prefix_of(ids), len(ids)
    at, out = np.arange(n), {}
    for k in sorted(lengths):
        at = at[at <= n - k]
        at = at[owner[at] == owner[at + k - 1]]
        keys = mix(roller.spans(prefix, at, at + k) + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = at[present_twice(keys)]
        marks = np.zeros(n + 1, np.int32)
        marks[at] += 1
        np.subtract.at(marks, at + k, 1)
        out[k] = np.cumsum(marks[:-1]) > 0
    return out


def measure(block: Block, roller: Roller, words: Roller, lengths: list[int]) -> dict[str, np.ndarray]:
    n, data = len(block), block.data
    starts, ends, owner = block.words()
    chars_to = np.concatenate([[0], np.cumsum(block.char_starts(), dtype=np.int64)])
    chars = chars_to[ends] - chars_to[starts]
    prefix = roller.prefix(data)
    symbols = np.flatnonzero(_SYMBOL[data])
    out = {"n_words": totals(owner, n), "word_chars": totals(owner, n, chars), "n_symbols": np.diff(np.searchsorted(symbols, block.offsets))}
    marks = covered(roller.spans(prefix, starts, ends), sorted({BASE_NGRAM, *lengths}), words, owner)
    out["n_repeat_words"] = totals(owner, n, marks[BASE_NGRAM])
    for k in lengths:
        out[f"cover_{k}"] = totals(owner, n, chars * marks[k])
    # Lines: what lies between newlines, whole, if it holds a word.
    line_starts, line_ends, line_owner = block.edges(data != 0x0A)
    first_word = np.searchsorted(starts, line_starts)
    last_word = np.searchsorted(starts, line_ends)
    some = last_word > first_word
    line_starts, line_ends, line_owner = line_starts[some], line_ends[some], line_owner[some]
    keys = mix(roller.spans(prefix, line_starts, line_ends) + line_owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    later = np.ones(len(keys), bool)
    later[np.unique(keys, return_index=True)[1]] = False
    word_chars_to = np.concatenate([[0], np.cumsum(chars)])
    line_chars = word_chars_to[last_word[some]] - word_chars_to[first_word[some]]
    out["n_dup_lines"] = totals(line_owner, n, later)
    out["cover_lines"] = totals(line_owner, n, line_chars * later)
    return out


def repetition_coverage(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """One row for each document: keys, the counts, the share of characters covered by duplicated
    n-grams of each length (cover_N) and by repeated lines (cover_lines), and verdict, which is
    true if all shares are within their limits.

    Null and empty texts have counts and shares of 0 and a true verdict. Repeated rows are judged
    one by one, keys may be null, other columns are not read. Keys must not be named like results."""
    limits = dict(NGRAM_LIMITS if limits is None else limits)
    lengths = sorted(limits)
    fields = [*_FIELDS, *(f"cover_{k}" for k in lengths), "cover_lines"]
    rows = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), *(f"{x} bigint" for x in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_roller, word_roller = Roller(1), Roller(2, base=0xD1342543DE82EF95)
        for batch in batches:
            for at, block in blocks(batch.column(len(keys))):
                got = measure(block, byte_roller, word_roller, lengths)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(block)) for i in range(len(keys))), *(pa.array(got[x].astype(np.int64)) for x in fields)], names=[*keys, *fields])

    found = rows.mapInArrow(run, schema)
    share = lambda c: F.col(c) / F.greatest(F.col("word_chars"), F.lit(1))
    verdict = share("cover_lines") <= line_limit
    for k, most in limits.items():
        verdict = verdict & (share(f"cover_{k}") <= most)
    return found.select(*keys, *_FIELDS, *(share(f"cover_{k}").alias(f"cover_{k}") for k in lengths), share("cover_lines").alias("cover_lines"), verdict.alias("verdict"))
