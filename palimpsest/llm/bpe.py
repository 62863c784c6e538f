"""Byte-level BPE by merge replay over the corpus vocabulary, and decoding.

Words (matches of the split pattern) are counted over the whole corpus. The vocabulary, the most
frequent words up to a fixed number, is dealt into shards; a shard lays the symbols of all its words
end to end, and keeps an inverted index from the pairs to be merged (under the token that they make)
to the positions where they stand. Ranks are taken in order, each applied to all words at once; only
the pairs that touch a merged position are looked up again. So every merge is replayed once for the
corpus, whatever the number of documents. The ids of the vocabulary, of bounded size, are broadcast
and joined back to the texts; words that are rarer than all of them are replayed by slices of the
corpus, in the same way, where they occur.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.exchange import released, written

#: Bytes of text whose rare words are replayed together, and most of them remembered between slices.
SLICE_BYTES, CACHE_WORDS = 4 << 20, 200_000
#: Words of the corpus vocabulary at most, bytes of the longest, and words of a shard.
VOCABULARY, LONGEST, SHARD = 1 << 17, 64, 1 << 14


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: base64 token and rank on each line. Read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Every (left id, right id) whose joined bytes are a token, as sorted keys, and that token."""
    keys, ids = [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                ids.append(rank)
    order = np.argsort(np.array(keys, np.int64))
    return np.array(keys, np.int64)[order], np.array(ids, np.int64)[order]


class MergeReplay:
    NONE = np.int64(1) << 40

    def __init__(self, ranks: dict[bytes, int], pairs: tuple[np.ndarray, np.ndarray] | None = None):
        self.ranks = ranks
        self.keys, self.ids = pairs or pair_table(ranks)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), self.NONE)
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ids[at], self.NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers."""
        whole = [self.ranks.get(w) for w in words]
        rest = [w for w, r in zip(words, whole, strict=True) if r is None]
        done = iter(self._merge(rest)) if rest else iter(())
        return [next(done) if r is None else r.to_bytes(4, "little") for r in whole]

    def _merge(self, words: list[bytes]) -> list[bytes]:
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbols)
        ends = np.cumsum([len(w) for w in words])
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[np.concatenate([[0], ends[:-1]])[np.diff(np.concatenate([[0], ends])) > 0]] = -1
        # The rank of the pair that begins at each position, and the index from rank to positions.
        rank = np.full(n, self.NONE)
        at = np.flatnonzero(after >= 0)
        rank[at] = self.lookup(symbols[at], symbols[after[at]])
        order = np.argsort(rank, kind="stable")
        order = order[: np.searchsorted(rank[order], self.NONE)]
        values, first = np.unique(rank[order], return_index=True)
        index: dict[int, list] = {int(v): [p] for v, p in zip(values, np.split(order, first[1:]), strict=True)} if len(values) else {}
        queue = list(index)
        heapq.heapify(queue)
        alive = np.ones(n, bool)
        while queue:
            r = heapq.heappop(queue)
            found = index.pop(r)
            head = found[0] if isinstance(found[0], np.ndarray) else np.empty(0, np.int64)
            tail = found[1:] if isinstance(found[0], np.ndarray) else found
            at = np.concatenate([head, np.array(tail, np.int64)]) if tail else head
            at = at[rank[at] == r]
            if tail:
                at = np.unique(at)
            if not len(at):
                continue
            # Of pairs that overlap in a run, the first, third, ... are merged.
            if len(at) > 1:
                clash = after[at[:-1]] == at[1:]
                if clash.any():
                    place = np.arange(len(at))
                    begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~clash]), place, 0))
                    at = at[(place - begin) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            symbols[at] = r
            alive[gone] = False
            rank[gone] = self.NONE
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            left = before[at]
            touched = np.concatenate([at, left[left >= 0]])
            follow = after[touched]
            new = np.where(follow >= 0, self.lookup(symbols[touched], symbols[follow]), self.NONE)
            rank[touched] = new
            live = new < self.NONE
            for value, place in zip(new[live].tolist(), touched[live].tolist(), strict=True):
                held = index.get(value)
                if held is None:
                    index[value] = [place]
                    heapq.heappush(queue, value)
                else:
                    held.append(place)
        kept = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])]
        ids = symbols[alive].astype("<u4").tobytes()
        return [ids[4 * a : 4 * b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]


def encode_slice(texts: list[str], split, model: MergeReplay, known: dict[str, bytes], cache: dict[str, bytes]) -> list[bytes]:
    words = [split(t) for t in texts]
    new = list(set().union(*words).difference(known, cache))
    cache.update(zip(new, model.replay([w.encode() for w in new]), strict=True))
    find, rare = known.get, cache.__getitem__
    return [b"".join([find(x) or rare(x) for x in w]) for w in words]


def vocabulary(rows: DataFrame, pattern: str, most: int = VOCABULARY) -> DataFrame:
    """(word, n) of the most frequent words of all texts (column _text), at most `most` of them: all words
    more frequent than the first count at which there would be more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, tally, size = regex.compile(pattern).findall, Counter(), 0

        def told() -> pa.RecordBatch:
            short = [(w, n) for w, n in tally.items() if len(w) <= LONGEST and len(w.encode()) <= LONGEST]
            out = pa.RecordBatch.from_arrays([pa.array([w for w, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], names=["word", "n"])
            tally.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                raw = text.as_py()
                tally.update(split(raw))
                size += len(raw)
                if size >= SLICE_BYTES:
                    yield told()
                    size = 0
        yield told()
        released()

    counts = written(rows.select("_text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "bpe-words")
    sizes = counts.groupBy("n").agg(F.count("*").alias("k")).toPandas().sort_values("n", ascending=False)  # few: twice the root of the words at most
    fits = sizes["n"].to_numpy()[sizes["k"].cumsum().to_numpy() <= most]
    return counts.filter(F.col("n") >= int(fits[-1])) if len(fits) else counts.limit(0)


def replayed(words: DataFrame, shared, shard: int = SHARD) -> dict[str, bytes]:
    """The ids of each word (column word): a shard of the vocabulary is one replay."""
    n = max(1, -(-words.count() // shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = [w for batch in batches for w in batch.column(0).to_pylist()]
        if each:
            ids = MergeReplay(*shared.value).replay([w.encode() for w in each])
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.string()), pa.array(ids, pa.binary())], names=["word", "ids"])

    found = words.select("word").repartition(n, "word").mapInArrow(run, "word string, ids binary").toArrow()  # VOCABULARY words at most
    return dict(zip(found["word"].to_pylist(), found["ids"].to_pylist(), strict=True))


def _fields(df: DataFrame, columns: tuple[str, ...]) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), slice_bytes: int = SLICE_BYTES, most: int = VOCABULARY) -> DataFrame:
    """keys and ids: the token ids of each whole text as little-endian 32-bit integers, as the
    rank file's own library gives them without special tokens. A null text counts as empty and
    has no ids. Repeated rows, null keys and other columns do no harm; keys must not be named ids."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pair_table(ranks)))  # bounded by the vocabulary
    rows = docs.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    common = docs.sparkSession.sparkContext.broadcast(replayed(vocabulary(rows, pattern, most), shared))  # VOCABULARY words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        model, split, known, cache = MergeReplay(*shared.value), regex.compile(pattern).findall, common.value, {}
        held: list[pa.RecordBatch] = []

        def coded() -> Iterator[pa.RecordBatch]:
            ids, at = encode_slice([t for p in held for t in p.column(len(keys)).to_pylist()], split, model, known, cache), 0
            for p in held:
                yield pa.RecordBatch.from_arrays([*p.columns[: len(keys)], pa.array(ids[at : at + p.num_rows], pa.binary())], names=[*keys, "ids"])
                at += p.num_rows
            held.clear()
            if len(cache) > CACHE_WORDS:
                cache.clear()
            del ids
            released()

        size = 0
        for part in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
            held.append(part)
            size += part.column(len(keys)).nbytes
            if size >= slice_bytes:
                yield from coded()
                size = 0
        if held:
            yield from coded()
        cache.clear()
        released()

    return rows.mapInArrow(run, ", ".join([*_fields(docs, keys), "ids binary"]))


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and decoded: the bytes that the ids stand for; null ids give null. An id without a
    token is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    rows = encoded.select(*keep, F.col(ids).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: dict[int, bytes] = {i: t for t, i in shared.value.items()}
        back = lambda x: None if x is None else b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist()))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array([back(x.as_py()) for x in part.column(len(keep))], pa.binary())], names=[*keep, "decoded"])
        tokens.clear()
        released()

    return rows.mapInArrow(run, ", ".join([*_fields(encoded, keep), "decoded binary"]))


