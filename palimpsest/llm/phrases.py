"""Collocations: phrases of two to four words, from suffix automata of shards.

Texts are cut into shards of a bounded number of bytes, where they are read; a shard of one language is
a stream of word numbers and its words. Counting goes in two rounds, so that only what can be frequent
travels whole. First each shard asks, by hashes, which of its words and word pairs occur often enough
in all shards together; what lies between rare pairs goes. Of the runs that stay a shard builds its
generalised suffix automaton, bounded in depth: states are sets of strings with the same end places,
with their number, and a suffix link to the state of the next shorter strings. Its strings of three
and four words are asked about likewise, and the frequent ones are counted by their words. Hashes
drop what is rare and decide nothing else: all counts are of words, exactly.

A phrase whose longer phrase is nearly as frequent is subsumed by it. Counts never rise along suffix
links (the first word dropped) or back along transitions (the last word dropped), so it is enough to
look one word further.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.exchange import pack, placed, released, unpack, written
from palimpsest.llm.textblocks import Block, Roller, mix, seeds
from palimpsest.operators.tables import spread_join

#: Bytes of text of a shard, unless a single piece is longer, and bytes of all languages that a task holds back.
SHARD_BYTES, HELD_BYTES = 8 << 20, 32 << 20
#: Least count of a candidate, most words, share of a phrase's count from which a longer one subsumes it, and phrases kept of each language.
MIN_COUNT, MOST_WORDS, SUBSUMED, TOP = 30, 4, 80, 2000
#: Phrases of shards that a task adds up before it sends them.
COMBINED = 1_000_000
#: Scores are this times a / (l + r).
SCALE = 2_000_000
#: Parts of a language that are ranked apart before their best are ranked together.
PARTS = 64

_STOP, _BLANK, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK[[0x20, 0x09]] = True
_LOWER[ord("A") : ord("Z") + 1] += 32

_SHARD = "shard bigint, lang string, n_words bigint, stream binary, words array<string>, totals binary"


def _small(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes, so that shards stay small where they are shuffled, too."""
    raw = pack(numbers.astype(np.uint32))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _numbers(small: bytes) -> np.ndarray:
    return unpack(pa.decompress(small[8:], int.from_bytes(small[:8], "little"), codec="zstd", asbytes=True), np.uint32).astype(np.int64)


def _shard(shard: int, lang: str, n_words: int, stream: np.ndarray, words: pa.Array, totals: np.ndarray) -> pa.RecordBatch:
    """stream: word numbers from 1, 0 between pieces; totals: how often each word occurs in the shard."""
    columns = [pa.array([shard], pa.int64()), pa.array([lang], pa.string()), pa.array([n_words], pa.int64()), pa.array([_small(stream)], pa.binary())]
    columns += [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), pa.array([_small(totals)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "n_words", "stream", "words", "totals"])


def tokenized(data: np.ndarray) -> tuple[int, np.ndarray, pa.Array, np.ndarray]:
    """Words of lower-cased bytes as a stream of numbers with 0 between pieces, the words, and their counts."""
    data = _LOWER[data]
    stop = _STOP[data]
    starts, ends, _ = Block(data, np.array([0, len(data)], np.int64)).edges(~(stop | _BLANK[data]))
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    letters = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    at = np.cumsum(stop, dtype=np.int64)[starts] if len(starts) else np.empty(0, np.int64)
    breaks = np.flatnonzero(np.diff(at)) + 1
    return len(ids), np.insert(ids, breaks, 0), coded.dictionary, np.bincount(ids, minlength=len(coded.dictionary) + 1)[1:]


def slices(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """data in parts of about limit bytes, cut behind stops only."""
    at = 0
    while at < len(data):
        to = at + limit
        if to < len(data):
            later = np.flatnonzero(_STOP[data[to - 1 : to - 1 + limit]])
            while not len(later) and to + limit < len(data):
                to += limit
                later = np.flatnonzero(_STOP[data[to - 1 : to - 1 + limit]])
            to = to + int(later[0]) if len(later) else len(data)
        yield data[at:to]
        at = to


def shards(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Shards of the texts, one row each, cut where the texts are read: nothing is shuffled."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, sizes, k = TaskContext.get().partitionId() << 32, {}, {}, 0

        def flushed(name: str) -> Iterator[pa.RecordBatch]:
            nonlocal k
            whole = np.frombuffer(b"".join(held.pop(name)), np.uint8)
            for data in slices(whole, SHARD_BYTES if len(whole) > 2 * SHARD_BYTES else len(whole)):
                n, stream, words, totals = tokenized(data)
                if n:
                    yield _shard(base + k, name, n, stream, words, totals)
                    k += 1
            del sizes[name]
            released()

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = value.as_buffer().to_pybytes()
                held.setdefault(name, []).extend((raw, b"\n"))
                sizes[name] = sizes.get(name, 0) + len(raw) + 1
                if sizes[name] >= SHARD_BYTES:
                    yield from flushed(name)
                elif sum(sizes.values()) >= HELD_BYTES:
                    yield from flushed(max(sizes, key=sizes.get))
        for name in list(held):
            yield from flushed(name)

    return rows.mapInArrow(run, _SHARD)


class Automaton:
    """The generalised suffix automaton of the pieces of a stream, up to a depth in words.

    Places are ordered by the words that end there, read backwards; the nodes of that order's tree are
    the strings, and strings with the same end places are one state. For each state: the words of its
    longest and shortest strings, the number of its end places, one of them, and its suffix link (the
    state of the strings one word shorter than its shortest; -1: none)."""

    def __init__(self, stream: np.ndarray, depth: int):
        stream = stream.astype(np.int64)
        self.stream, n = stream, len(stream)
        before = np.arange(n) - np.maximum.accumulate(np.where(stream == 0, np.arange(n), -1)) if n else np.empty(0, np.int64)
        held = np.minimum(before, depth)
        at = np.flatnonzero(stream)
        back = [np.where(held[at] > j, stream[np.maximum(at - j, 0)], 0) for j in range(depth)]
        back += [np.zeros(len(at), np.int64)] * (depth % 2)
        keys = [(back[j] << 32) | back[j + 1] for j in range(0, len(back), 2)]
        order = np.lexsort(keys[::-1])
        at, back = at[order], [x[order] for x in back[:depth]]
        state = np.full(len(at), -1)  # of the node that a row is in, one word shorter
        count = np.zeros(len(at), np.int64)
        self.longest, self.shortest, self.count, self.end, self.link = (np.empty(0, np.int64) for _ in range(5))
        fresh = np.zeros(len(at), bool)
        fresh[:1] = True
        for k in range(depth):
            fresh[1:] |= back[k][1:] != back[k][:-1]
            first = np.flatnonzero(fresh)
            sizes = np.diff(np.append(first, len(at)))
            there = back[k][first] > 0
            same = there & (state[first] >= 0) & (count[first] == sizes)
            new = there & ~same
            self.longest[state[first[same]]] = k + 1
            names = np.where(same, state[first], -1)
            names[new] = len(self.count) + np.arange(int(new.sum()))
            add = lambda old, more: np.concatenate([old, more]).astype(np.int64)
            rows = first[new]
            self.longest, self.shortest = add(self.longest, np.full(len(rows), k + 1)), add(self.shortest, np.full(len(rows), k + 1))
            self.count, self.end, self.link = add(self.count, sizes[new]), add(self.end, at[rows]), add(self.link, state[rows])
            state, count = np.repeat(names, sizes), np.repeat(sizes, sizes)

    def strings(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length, an end place and count of every string of at least so many words."""
        low = np.maximum(self.shortest, least)
        some = np.flatnonzero(self.longest >= low)
        each = np.repeat(some, (self.longest - low + 1)[some])
        nth = np.arange(len(each)) - np.repeat(np.cumsum((self.longest - low + 1)[some]) - (self.longest - low + 1)[some], (self.longest - low + 1)[some])
        return low[each] + nth, self.end[each], self.count[each]


def _word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    """A hash of each word of a language; number 0 is none."""
    data = words.cast(pa.large_string())
    _, where, raw = data.buffers()
    offsets = np.frombuffer(where, np.int64, count=data.offset + len(data) + 1)[data.offset :]
    roller = Roller(3)
    raw = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    hashes = roller.spans(roller.prefix(raw), offsets[:-1], offsets[1:])
    return np.concatenate([np.zeros(1, np.uint64), mix(hashes ^ seeds(1, zlib.crc32(lang.encode())))])


def _string_hashes(stream: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ends), np.uint64)
    for j in range(int(lengths.max(initial=0)) - 1, -1, -1):
        on = lengths > j
        out[on] = mix(out[on] * np.uint64(0xF1357AEA2E62A9C5) + hashes[stream[ends[on] - j]] + lengths[on].astype(np.uint64))
    return out


def _pairs(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of word pairs (of the first word), the distinct pairs, which of them each is, and counts."""
    at = np.flatnonzero((stream[:-1] > 0) & (stream[1:] > 0))
    return at, *np.unique((stream[at] << 32) | stream[at + 1], return_inverse=True, return_counts=True)


def _first_keys(stream: np.ndarray, words: pa.Array, totals: np.ndarray, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of a shard's words and pairs."""
    hashes = _word_hashes(words, lang)
    _, pairs, _, counts = _pairs(stream)
    both = mix(hashes[pairs >> 32] * np.uint64(0xD6E8FEB86659FD93) + hashes[pairs & 0xFFFFFFFF])
    return np.concatenate([hashes[1:], both]), np.concatenate([totals, counts])


def _long_keys(stream: np.ndarray, words: pa.Array, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the automaton's strings of three words and more."""
    lengths, ends, counts = Automaton(stream, MOST_WORDS).strings(3)
    return _string_hashes(stream, _word_hashes(words, lang), lengths, ends), counts


def _each(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """Shards of Arrow batches: shard, lang, n_words, stream, words, totals, and more columns as they are."""
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda c, i=i, batch=batch: batch.column(batch.schema.get_field_index(c))[i]
            yield get("shard").as_py(), get("lang").as_py(), get("n_words").as_py(), _numbers(get("stream").as_py()), get("words").values, _numbers(get("totals").as_py()), *(get(c).as_py() for c in more)
        released()


def frequent(asking: DataFrame, keys_of, n: int, least: int) -> DataFrame:
    """shard and bits: for each shard, which of its keys (in the order of their hashes) have `least`
    occurrences or more in all shards. keys_of gives hashes and counts of a shard. A shard sends each
    key once, 32 bits and a count up to `least`, to the bucket of its range; two keys that share a
    place count together, so that a rare key may pass, and no frequent one fails."""
    kind = np.min_scalar_type(least).type
    buckets = max(min(n, 64), -(-n // 4))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, *row in _each(batches):
            hashes, counts = keys_of(*row)
            order = np.argsort(hashes, kind="stable")
            edges, places = placed(hashes[order], buckets)
            counts = np.minimum(counts[order], least).astype(kind)
            to = np.flatnonzero(np.diff(edges))
            part = lambda x: pa.array([pack(x[edges[b] : edges[b + 1]]) for b in to], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.full(len(to), shard), pa.int64()), part(places), part(counts)], names=["bucket", "shard", "places", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        places = [unpack(x.as_py(), np.uint32) for x in table.column("places")]
        _, which = np.unique(np.concatenate(places), return_inverse=True)
        sums = np.bincount(which, weights=np.concatenate([unpack(x.as_py(), kind) for x in table.column("counts")]))
        often = np.split((sums >= least)[which], np.cumsum([len(x) for x in places])[:-1])
        out = pa.table([table.column("shard"), table.column("bucket"), pa.array([len(x) for x in often], pa.int32()), pa.array([np.packbits(x).tobytes() for x in often], pa.binary())], names=["shard", "bucket", "n", "bits"])
        released()
        return out

    asked = asking.mapInArrow(ask, "bucket int, shard bigint, places binary, counts binary")
    told = asked.groupBy("bucket").applyInArrow(answer, "shard bigint, bucket int, n int, bits binary")
    return told.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "bits"))).alias("answers"))


def _known(hashes: np.ndarray, answers: list[dict] | None) -> np.ndarray:
    """The bits of a shard's keys, in the order of its keys."""
    bits = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]).astype(bool) for a in answers or []]
    out = np.zeros(len(hashes), bool)
    out[np.argsort(hashes, kind="stable")] = np.concatenate(bits) if bits else False
    return out


def runs(told: DataFrame) -> DataFrame:
    """Shards with only their frequent words and the runs of frequent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, lang, n, stream, words, totals, answers in _each(batches, "answers"):
            known = _known(_first_keys(stream, words, totals, lang)[0], answers)
            keep = np.flatnonzero(known[: len(words)])
            at, _, which, _ = _pairs(stream)
            joined = np.zeros(len(stream) + 1, bool)  # True at a word that goes with the one before it
            joined[at[known[len(words) :][which]] + 1] = True
            inside = joined[:-1] | joined[1:]
            left = np.insert(stream[inside], np.flatnonzero(~joined[:-1][inside]), 0)
            number = np.zeros(len(words) + 1, np.int64)
            number[keep + 1] = np.arange(1, len(keep) + 1)
            if len(keep):
                yield _shard(shard, lang, n, number[left], words.take(pa.array(keep)), totals[keep])

    return told.mapInArrow(run, _SHARD)


def counted(told: DataFrame, n: int, least: int) -> DataFrame:
    """lang, phrase, size and n: the frequent strings of all shards with their counts. A task adds up what its
    shards have and sends it in parts, one for each bucket of phrases, which the bucket adds up in turn."""
    buckets = max(min(n, 64), -(-n // 4))

    def of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for _, lang, _, stream, words, totals, answers in _each(batches, "answers"):
            lengths, ends, counts = Automaton(stream, MOST_WORDS).strings(2)
            long = np.flatnonzero(lengths > 2)
            often = lengths == 2
            often[long] = _known(_string_hashes(stream, _word_hashes(words, lang), lengths[long], ends[long]), answers)
            yield _told(lang, words, 1, totals)
            for k in range(2, MOST_WORDS + 1):
                some = np.flatnonzero(often & (lengths == k))
                if len(some):
                    parts = [words.take(pa.array(stream[ends[some] - j] - 1)) for j in range(k - 1, -1, -1)]
                    yield _told(lang, pc.binary_join_element_wise(*parts, " "), k, counts[some])

    def dealt(tables: list[pa.Table]) -> pa.RecordBatch:
        whole = _summed(tables)
        to = (_word_hashes(whole.column("phrase").combine_chunks(), "")[1:] % np.uint64(buckets)).astype(np.int64)
        whole, edges = whole.take(pa.array(np.argsort(to, kind="stable"))), np.searchsorted(np.sort(to), np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(edges))
        parts = [_packed(whole.slice(edges[i], edges[i + 1] - edges[i])) for i in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(parts, pa.binary())], names=["bucket", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in of_shards(batches):
            held.append(table)
            size += table.num_rows
            if size >= COMBINED:
                yield dealt(held)
                held, size = [], 0
                released()
        if held:
            yield dealt(held)

    def total(table: pa.Table) -> pa.Table:
        whole = _summed([pa.ipc.open_stream(x.as_py()).read_all() for x in table.column("counts")])
        return whole.filter(pc.greater_equal(whole.column("n"), least))

    return told.mapInArrow(run, "bucket int, counts binary").groupBy("bucket").applyInArrow(total, "lang string, phrase string, size int, n bigint")


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(table)
    return out.getvalue().to_pybytes()


def _summed(tables: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(tables).group_by(["lang", "phrase", "size"]).aggregate([("n", "sum")])
    return found.rename_columns(["lang", "phrase", "size", "n"]).combine_chunks()


def _told(lang: str, phrases: pa.Array, size: int, counts: np.ndarray) -> pa.Table:
    return pa.table({"lang": pa.array([lang] * len(phrases), pa.string()), "phrase": phrases.cast(pa.string()), "size": pa.array(np.full(len(phrases), size, np.int32)), "n": pa.array(counts.astype(np.int64))})


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n): every phrase of one to four words that occurs min_count times or more in
    the pieces of its language's texts; and (lang, n): the words of each language.

    Words are lower-cased (A-Z), pieces end at `.,;:!?` and line ends. Null texts are empty, null
    languages are `und`, repeated rows count again, other columns are not read; empty tables give no rows."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    first = written(shards(rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows, "text", "lang"), "phrase-shards")
    n = max(first.count(), 1)
    told = first.join(frequent(first, lambda lang, _, stream, words, totals: _first_keys(stream, words, totals, lang), n, min_count), "shard")
    second = written(runs(told), "phrase-runs")
    answers = frequent(second, lambda lang, _, stream, words, __: _long_keys(stream, words, lang), n, min_count)
    found = counted(second.join(answers, "shard", "left"), n, min_count)
    return written(found, "phrase-counts"), first.groupBy("lang").agg(F.sum("n_words").alias("n"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the `top` phrases of each language by their score, then
    a, then the phrase. a is the phrase's count, l and r those of the parts of its weakest cut, and the
    score floor(2,000,000 a / (l + r)), reckoned with whole decimals. Phrases of which a longer one
    (frequent, kept or not) has 80 % of the occurrences are left out."""
    counts, words = phrase_counts(docs, text, lang, min_count)
    # One word further: along suffix links back, the first word is dropped; along transitions, the last.
    link, source = F.expr("substring(phrase, instr(phrase, ' ') + 1)"), F.expr("substring_index(phrase, ' ', size - 1)")
    longer = counts.filter("size > 2").select("lang", F.explode(F.array(link, source)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = counts.filter("size > 1").join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer").cast("decimal(20,0)") < SUBSUMED * F.col("n").cast("decimal(20,0)"), F.lit(True)))
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")})
    of = lambda part, n: counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    cuts = spread_join(spread_join(cuts, of("first", "l"), ["lang", "first"], by="phrase"), of("rest", "r"), ["lang", "rest"], by="phrase")
    score = F.expr(f"(CAST(a AS DECIMAL(20,0)) * {SCALE}) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))").cast("long")
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = weakest.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_nth") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
