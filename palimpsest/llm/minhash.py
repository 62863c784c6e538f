"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles, weight = count x damped idf, with document
frequencies over the whole corpus from a blob exchange. Each consistent sample of two texts agrees
with the probability of their weighted Jaccard similarity; samples make bands. The texts of a band
meet at its most central one, so that the bands of a group of near copies make one family with one
hub. A family of bounded size is compared pair by pair, exactly, in one task, as products of
blocks of its shingle matrix. Larger families are dealt into blocks with the hub in each; what is
then not yet in the hub's class is compared with all the rest, block by block. Tasks return no
more links than they have texts. Classes are the connected components of the links, found by
joins. Exact copies are folded into one text before candidates are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.exchange import chunked, pack, released, unpack, whole_groups, written
from palimpsest.llm.textblocks import Block, Roller, blocks, mix, seeds, totals
from palimpsest.operators.tables import spread_join

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 10, 3
#: How much rarer shingles outweigh common ones: weights lie between 1 and 1 + IDF. A full idf
#: would tear a large group of near copies apart, whose shared shingles are common by itself.
IDF = 0.25
#: Texts of a family in one task; columns of a block of its shingle matrix.
GROUP, COLUMNS = 512, 4096
#: Bytes of text in a chunk, on average.
CHUNK = 2 << 20
#: Bits of the filter that keeps texts without candidates out of shuffles (16 MB at any input).
FILTER_BITS = 1 << 27

#: Rows of one key that are light work for one task.
SMALL = 100_000

_TABLE = 1 << 16


def shingles(block: Block, byte_roller: Roller, word_roller: Roller, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (key, text, count), by text and key. A text of one to k - 1
    words has one shingle of all its words."""
    starts, ends, owner = block.words()
    ids = byte_roller.spans(byte_roller.prefix(block.data), starts, ends)
    count = totals(owner, len(block))
    prefix = word_roller.prefix_of(ids)
    at = np.arange(max(0, len(ids) - k + 1))
    at = at[owner[at] == owner[at + k - 1]] if len(at) else at
    keys, who = word_roller.spans(prefix, at, at + k), owner[at]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(owner, short)
        keys = np.concatenate([keys, word_roller.spans(prefix, first, first + count[short])])
        who = np.concatenate([who, short])
    order = np.lexsort((keys, who))
    keys, who = keys[order], who[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])
    first = np.flatnonzero(new)
    return keys[first], who[first], np.diff(np.append(first, len(keys)))


class Sampler:
    """Consistent weighted samples: the random variables of a shingle come from tables that its
    hash indexes, another index for each sample."""

    def __init__(self, n: int):
        rng = np.random.default_rng(20)
        self.r = rng.gamma(2.0, 1.0, _TABLE).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, _TABLE)).astype(np.float32)
        self.beta = rng.uniform(0.0, 1.0, _TABLE).astype(np.float32)
        self.odd = seeds(n, 21) | np.uint64(1)

    def sample(self, keys: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One 32-bit value for each sample (columns) and text (rows); first: where each text,
        none of them empty, begins among keys."""
        logs, size = np.log(weights).astype(np.float32), np.diff(np.append(first, len(keys)))
        out = np.empty((len(first), len(self.odd)), np.uint32)
        for d, odd in enumerate(self.odd):
            at = ((keys * odd) >> np.uint64(48)).astype(np.int64)
            r, beta = self.r[at], self.beta[at]
            t = np.floor(logs / r + beta)
            a = self.log_c[at] - r * (t - beta + np.float32(1))
            least = np.minimum.reduceat(a, first)
            hit = np.flatnonzero(a == np.repeat(least, size))
            hit = hit[np.searchsorted(hit, first)]
            out[:, d] = (mix(keys[hit] + t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + odd) >> np.uint64(32)).astype(np.uint32)
        return out


def idf_code(frequency: np.ndarray, documents: int) -> np.ndarray:
    """Damped idf in 256 steps: 255 for one document, 0 for all."""
    share = 1 - np.log(frequency) / max(np.log(max(documents, 2)), 1e-9)
    return np.clip(np.round(255 * share), 0, 255).astype(np.uint8)


def weighed(count: np.ndarray, code: np.ndarray) -> np.ndarray:
    return count * (1.0 + IDF * code / 255.0)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets (sorted keys, weights)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    both = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(both / max(a[1].sum() + b[1].sum() - both, 1e-12))


_SIGNED = "_h binary, ids array<bigint>, bands array<bigint>, idf binary"


def signatures(rows: DataFrame) -> DataFrame:
    """For each chunk and distinct text of it (rows: _id, _h, _text): the documents that have it,
    its bands and idf codes by shingle."""
    dealt, n = chunked(rows, "_text", "_id", CHUNK)
    documents = rows.select("_id").count()

    def distinct(table: pa.Table) -> tuple[list[bytes], list[list[int | None]], pa.Array]:
        ids: dict[bytes, list] = {}
        where = []
        for i, (doc, h) in enumerate(zip(table["_id"].to_pylist(), table["_h"].to_pylist(), strict=True)):
            if h not in ids:
                ids[h] = []
                where.append(i)
            ids[h].append(doc)
        return list(ids), list(ids.values()), table["_text"].take(pa.array(where, pa.int64()))

    def chunk_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one, two, found = Roller(1), Roller(2, base=0xD1342543DE82EF95), []
        for at, block in blocks(texts):
            keys, who, count = shingles(block, one, two)
            found.append((keys, who + at, count))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def places(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the n ranges of sorted keys are cut, and each key's place in its range (32 bits)."""
        edges = np.array([-((-i << 64) // n) for i in range(1, n)], np.uint64)
        return np.concatenate([[0], np.searchsorted(every, edges), [len(every)]]).astype(np.int64), ((every * np.uint64(n)) >> np.uint64(32)).astype(np.uint32)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        released()
        _, ids, texts = distinct(table)
        keys, who, _ = chunk_shingles(texts)
        copies = np.array([len(x) for x in ids])
        every, back = np.unique(keys, return_inverse=True)
        count = np.bincount(back, copies[who], len(every)).astype(np.int64)
        at, place = places(every)
        some = np.flatnonzero(np.diff(at))
        return pa.table({"bucket": pa.array(some.astype(np.int32)), "chunk": pa.array(np.full(len(some), key[0].as_py(), np.int32)), "k": pa.array([place[at[b] : at[b + 1]].tobytes() for b in some], pa.binary()), "c": pa.array([pack(count[at[b] : at[b + 1]]) for b in some], pa.binary())})

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        released()
        keys = [np.frombuffer(x.as_py(), np.uint32) for x in table["k"]]
        counts = np.concatenate([unpack(x.as_py(), np.int64) for x in table["c"]])
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        code = idf_code(np.maximum(1, np.bincount(back, counts)), documents)[back]
        replies = np.split(code, np.cumsum([len(x) for x in keys])[:-1])
        return pa.table({"_chunk": table["chunk"], "bucket": pa.array(np.full(len(keys), key[0].as_py(), np.int32)), "c": pa.array([x.tobytes() for x in replies], pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        released()
        hashes, ids, texts = distinct(left)
        keys, who, count = chunk_shingles(texts)
        every = np.unique(keys)
        right = right.sort_by("bucket")
        code = np.frombuffer(b"".join(x.as_py() for x in right["c"]), np.uint8)[np.searchsorted(every, keys)] if len(every) else np.empty(0, np.uint8)
        sampler, mixer = Sampler(BANDS * ROWS), seeds(BANDS, 22)
        first = np.searchsorted(who, np.arange(len(hashes) + 1))
        some = np.flatnonzero(np.diff(first))
        bands: list[list[int]] = [[] for _ in hashes]
        step = max(1, int(400_000 // max(1, len(keys) / max(1, len(some)))))
        for a in range(0, len(some), step):
            part = some[a : a + step]
            lo, hi = first[part[0]], first[part[-1] + 1]
            got = sampler.sample(keys[lo:hi], weighed(count[lo:hi], code[lo:hi]), first[part] - lo)
            band = mixer[None, :].repeat(len(part), 0)
            for j in range(ROWS):
                band = mix(band + got[:, j::ROWS].astype(np.uint64))
            for i, b in zip(part, band.view(np.int64).tolist(), strict=True):
                bands[i] = b
        codes = [code[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.table([pa.array(hashes, pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64())), pa.array(codes, pa.binary())], names=[x.split()[0] for x in _SIGNED.split(", ")])

    asked = dealt.groupBy("_chunk").applyInArrow(ask, "bucket int, chunk int, k binary, c binary")
    answered = asked.groupBy("bucket").applyInArrow(answer, "_chunk int, bucket int, c binary")
    return dealt.groupBy("_chunk").cogroup(answered.groupBy("_chunk")).applyInArrow(finish, _SIGNED)


def similar_links(sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]], old: np.ndarray, similar: float) -> list[tuple[int, int]]:
    """Links that span the classes of some weighted sets (sorted keys, counts, weights of one).

    Every pair but those of two old members is compared exactly: a shingle that stands n times is n
    elements of one weight, so the common weight of all pairs is a sum of matrix products over the
    elements that two sets or more hold. Pairs that rounding could move are worked out alone."""
    n = len(sets)
    size = [int(c.sum()) for _, c, _ in sets]
    who = np.repeat(np.arange(n), size)
    if not len(who):
        return []
    key = np.concatenate([np.repeat(k, c) for k, c, _ in sets])
    first = np.concatenate([np.repeat(np.cumsum(c) - c, c) for _, c, _ in sets])
    level = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) - first
    weight = np.concatenate([np.repeat(w, c) for _, c, w in sets])
    total = np.bincount(who, weight, n)
    _, element, held = np.unique(mix(key + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_inverse=True, return_counts=True)
    shared = held[element] > 1
    element, who, weight = element[shared], who[shared], weight[shared]
    order = np.argsort(element, kind="stable")
    column = np.cumsum(np.diff(element[order], prepend=-1) > 0) - 1
    who, weight = who[order], weight[order]
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(np.searchsorted(column, lo), np.searchsorted(column, lo + COLUMNS))
        block = np.zeros((n, COLUMNS), np.float32)
        block[who[part], column[part] - lo] = np.sqrt(weight[part])
        both += block @ block.T
    found = both / np.maximum(total[:, None] + total[None, :] - both, 1e-12)
    a, b = np.nonzero(np.triu(found >= similar - 1e-3, 1))
    open_ = ~(old[a] & old[b])
    a, b = a[open_], b[open_]
    root, links = list(range(n)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(i), top(j)
        if x != y and (found[i, j] > similar + 1e-3 or similarity((sets[i][0], sets[i][1] * sets[i][2]), (sets[j][0], sets[j][1] * sets[j][2])) >= similar - 1e-9):
            root[y] = x
            links.append((i, j))
    return links


def compared(tasks: DataFrame, rows: DataFrame, signed: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) of text hashes within each task; tasks: _task (any columns in a struct), _h,
    old. Texts are fetched once for all tasks, through a filter of fixed size."""
    spark = tasks.sparkSession
    wanted = tasks.select("_h").distinct()
    shared = spark.sparkContext.broadcast(_filter(wanted))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = _bit_of(batch.column(0).to_pylist())
            yield batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1))

    some = rows.select("_h", "_text").mapInArrow(near, "_h binary, _text string").groupBy("_h").agg(F.first("_text").alias("_text"))
    codes = signed.select("_h", "idf").join(wanted, "_h", "left_semi").groupBy("_h").agg(F.first("idf").alias("idf"))
    dealt = tasks.join(some.join(codes, "_h"), "_h").withColumn("_key", F.xxhash64("_task"))
    dealt = dealt.select("_key", "_h", "old", "_text", "idf").repartition("_key").sortWithinPartitions("_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Roller(1), Roller(2, base=0xD1342543DE82EF95)
        for table in whole_groups(batches, "_key"):
            released()
            keys, hashes = table["_key"].to_numpy(), table["_h"].to_pylist()
            codes, old, sets = table["idf"].to_pylist(), table["old"].to_numpy().astype(bool), []
            for at, block in blocks(table["_text"]):
                shingle, who, count = shingles(block, one, two)
                first = np.searchsorted(who, np.arange(len(block) + 1))
                for i in range(len(block)):
                    s = slice(first[i], first[i + 1])
                    sets.append((shingle[s], count[s], weighed(1, np.frombuffer(codes[at + i], np.uint8))))
            ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            left, right, at = [], [], 0
            for end in ends:
                for i, j in similar_links(sets[at:end], old[at:end], similar):
                    left.append(hashes[at + i])
                    right.append(hashes[at + j])
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])
        sets = table = None
        released()

    return dealt.mapInArrow(run, "a binary, b binary")


def _bit_of(hashes: list[bytes]) -> np.ndarray:
    return (np.frombuffer(b"".join(hashes), np.uint64)[::2] % np.uint64(FILTER_BITS)).astype(np.int64)


def _filter(wanted: DataFrame) -> np.ndarray:
    """A bit for each hash; as many bytes for any input."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bit_of(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["w", "v"])

    found = wanted.mapInArrow(place, "w bigint, v bigint").groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
    words = np.zeros(FILTER_BITS >> 6, np.uint64)
    words[found["w"].to_numpy(np.int64)] = found["v"].to_numpy(np.int64).view(np.uint64)
    return words.view(np.uint8)


def components(links: DataFrame) -> DataFrame:
    """(v, label): the least text hash of the component of each text that has a link. Labels move
    along links and then to the label of the label, until none changes; each round is written to
    the shared folder. Where there are more links than SMALL, the rows of a text with very many links
    or of a label of very many texts are spread; fewer rows are light work for one task."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "v"), "labels")
    many = both.count() > SMALL
    met = spread_join if many else lambda left, right, key, by, how="inner": left.join(right, key, how)
    while True:
        near = met(both, labels.withColumnRenamed("v", "b"), "b", "a").groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels["v"] == near["a"]).select("v", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("_label"))
        moved = written(met(moved, jump, "label", "v", "left").select("v", "was", F.least("label", "_label").alias("label")), "labels")
        labels = moved.select("v", "label")
        if moved.filter("was <> label").limit(1).count() == 0:
            return labels


def families(signed: DataFrame) -> DataFrame:
    """(a, b): each text b that shares a band with hub a, the text of that band whose bands hold
    the most texts (of equals the least hash). Near copies that were changed least hold most."""
    bands = signed.select("_h", F.posexplode("bands").alias("band", "key")).distinct()
    full = bands.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    held = spread_join(bands, full, ["band", "key"], "_h")
    central = held.groupBy("_h").agg(F.sum("n").alias("near"))
    placed = held.join(central, "_h")
    hubs = placed.groupBy("band", "key").agg(F.min_by("_h", F.struct(-F.col("near"), "_h")).alias("a"))
    return spread_join(placed, hubs, ["band", "key"], "_h").filter("_h <> a").select("a", F.col("_h").alias("b")).distinct()


def _first_tasks(stars: DataFrame) -> DataFrame:
    """A task for each family, or for each part of a large one, with the hub in each."""
    parts = stars.groupBy("a").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("_of"))
    members = spread_join(stars, parts, "a", "b").select("a", F.pmod(F.xxhash64("b"), F.col("_of")).cast("int").alias("_part"), F.col("b").alias("_h"))
    hubs = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_part"), F.col("a").alias("_h"))
    return members.union(hubs).select(F.struct("a", "_part").alias("_task"), "_h", F.lit(False).alias("old"))


def _second_tasks(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """For families that the first tasks split: blocks of the members outside the hub's class
    against each other and against blocks of its class."""
    large = stars.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("a")
    mark = lambda c, to: labels.select(F.col("v").alias(c), F.col("label").alias(to))
    hubs = large.join(mark("a", "_la"), "a", "left")
    known = spread_join(stars, hubs, "a", "b").join(mark("b", "_lb"), "b", "left").select("a", "b", F.coalesce(F.col("_lb") == F.col("_la"), F.lit(False)).alias("old"))
    known = written(known, "large-families")
    blocks_of = known.groupBy("a").agg(F.ceil(F.count_if(~F.col("old")) / F.lit(GROUP)).cast("int").alias("_o"), F.ceil(F.count_if("old") / F.lit(GROUP)).cast("int").alias("_c"))
    placed = spread_join(known, blocks_of.filter("_o > 0"), "a", "b")
    mine = F.pmod(F.xxhash64("b", F.lit(1)), F.when(F.col("old"), F.col("_c")).otherwise(F.col("_o"))).cast("int")
    pair = lambda i, kind, j: F.struct(i.cast("int").alias("i"), F.lit(kind).alias("kind"), j.cast("int").alias("j"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    with_open = F.transform(upto(F.col("_o")), lambda j: pair(F.least(mine, j), "open", F.greatest(mine, j)))
    with_old = F.transform(upto(F.col("_c")), lambda j: pair(mine, "old", j))
    as_old = F.transform(upto(F.col("_o")), lambda i: pair(i, "old", mine))
    spread = placed.select("a", "old", F.col("b").alias("_h"), F.explode(F.when(F.col("old"), as_old).otherwise(F.concat(with_open, with_old))).alias("_at"))
    return spread.select(F.struct("a", "_at").alias("_task"), "_h", "old")


def _members(rows: DataFrame, similar: float) -> DataFrame:
    """_h, ids (of the documents of one chunk that have the text) and _class (a text hash) of all rows (_id, _h, _text)."""
    signed = written(signatures(rows), "signatures")
    stars = written(families(signed), "stars")
    links = written(compared(_first_tasks(stars), rows, signed, similar), "links")
    labels = components(links)
    second = written(_second_tasks(stars, labels), "tasks")
    if second.limit(1).count():
        labels = components(links.union(written(compared(second, rows, signed, similar), "links")))
    return signed.select("_h", "ids").join(labels, F.col("_h") == labels["v"], "left").select("_h", "ids", F.coalesce("label", "_h").alias("_class"))


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).withColumn("_h", F.unhex(F.md5("_text")))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of its class, for each row.

    Texts are near-duplicates if the weighted Jaccard similarity of their shingles is at least
    similar; classes close this over chains. Equal texts are in one class; null texts count as
    empty, and texts without a word are near only to their equals. Null doc_ids are ordinary rows
    (class_id is null only if all of a class are null). Repeated rows come out repeated."""
    members = _members(_rows(docs, text, doc_id), similar)
    classes = members.groupBy("_class").agg(F.min(F.array_min("ids")).alias("class_id"))
    return spread_join(members, classes, "_class", "_h").select(F.explode("ids").alias("doc_id"), "class_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each class: that with the smallest doc_id (null last; for equal ids,
    the smallest text hash). Rows that are alone in their class stay where they are; only the
    others, found by a filter of fixed size, are shuffled."""
    spark, columns = docs.sparkSession, docs.columns
    members = written(_members(_rows(docs, text, doc_id), similar), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_h").alias("h"))).alias("first")
    classes = members.select("_class", "_h", F.explode("ids").alias("doc_id")).groupBy("_class").agg(F.count("*").alias("n"), first)
    shared = spark.sparkContext.broadcast(_filter(spread_join(members, classes.filter("n > 1").select("_class"), "_class", "_h").select("_h")))
    hashed = docs.withColumn("_h", F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))

    def side(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = _bit_of(batch.column(batch.num_columns - 1).to_pylist())
                yield batch.filter(pa.array(((shared.value[at >> 3] >> (at & 7)) & 1 == 1) == inside))

        return hashed.mapInArrow(run, hashed.schema)

    chosen = classes.select(F.col("first.id").alias("_cid"), F.col("first.h").alias("_ch"))
    crowd = side(True)
    crowd = crowd.join(chosen, (crowd["_h"] == chosen["_ch"]) & F.col(doc_id).cast("long").eqNullSafe(chosen["_cid"]), "left_semi").dropDuplicates(["_h"])
    return side(False).select(*columns).unionByName(crowd.select(*columns))
