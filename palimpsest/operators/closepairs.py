"""Close pairs of sequences, for many rows at a time.

Each row is routed by hashes of two of its four parts, and carries itself in two bits a base. Rows of one key
meet as neighbours in key order, so that pairs are compared as words, without a join; what is close enough is
told there with its mismatches. Sequences are ACGT only.

Where the interior begins and ends alike on both strands, a part and its reverse complement have one key, the
lesser of both, so that a row needs no keys for the other strand: it says by its flag in which way the key reads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.functions.derived import flat, strings_of

PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
#: The place in PAIRS of the same two parts as the other strand counts them.
MIRRORED = np.array([PAIRS.index((3 - j, 3 - i)) for i, j in PAIRS])
HALVES = ["r0", "r1", "s0", "s1"]
PAIR = "parent string, child string, n_parent long, n_child long, oriented string, turned int, mm array<struct<pos:int,a:string,b:string>>, h int, twin boolean"
KEYED = "key long, ref long, n long, meta int, code binary"

# Rows that are compared, and pairs that are told, at once; bases in a word; the low bit of each base.
ROWS, TOLD, WORD, LOW = 1 << 16, 1 << 15, 32, np.uint64(0x5555555555555555)
_LETTERS = np.frombuffer(b"ACGT", np.uint8)
_CODE = np.zeros(256, np.uint8)
_CODE[_LETTERS] = range(4)
_CODES = np.array([[b >> 2 * k & 3 for k in range(4)] for b in range(256)], np.uint8)
_MULTIPLIERS = np.random.default_rng(60).integers(0, 1 << 63, 1 << 12, np.uint64) * np.uint64(2) + np.uint64(1)


def _multipliers(n: int) -> np.ndarray:
    return np.resize(_MULTIPLIERS, n) + np.arange(n, dtype=np.uint64) // np.uint64(len(_MULTIPLIERS)) * np.uint64(2)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def turned(codes: np.ndarray) -> np.ndarray:
    return 3 - codes[:, ::-1]


def cuts(n: int, mirrored: bool) -> list[tuple[int, int]]:
    """The four parts of n places. Mirrored ones are the same from both ends, which leaves a middle place out: it
    can spoil no part."""
    if mirrored:
        return [(0, n // 4), (n // 4, n // 2), (n - n // 2, n - n // 4), (n - n // 4, n)]
    return [(n * i // 4, n * (i + 1) // 4) for i in range(4)]


def words_of(codes: np.ndarray) -> np.ndarray:
    """Codes as words of 32 bases."""
    n = codes.shape[1]
    whole = np.zeros((len(codes), -(-n // WORD) * WORD), np.uint8)
    whole[:, :n] = codes
    return np.ascontiguousarray(whole[:, 0::4] | whole[:, 1::4] << 2 | whole[:, 2::4] << 4 | whole[:, 3::4] << 6).view(np.uint64)


def codes_of(words: np.ndarray, n: int) -> np.ndarray:
    return _CODES[words.view(np.uint8)].reshape(len(words), -1)[:, :n]


def _by_size(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for n in np.unique(sizes):
        yield int(n), np.flatnonzero(sizes == n)


def keyed(fit: DataFrame, five: int, three: int, mirrored: bool, fine: bool = False) -> DataFrame:
    """Rows (KEYED) for the keys of fit (id, canon, n): six each, or twelve, those of both strands, if not mirrored. ref is
    twice the id, plus one where the key reads the other strand; code is the sequence as the key reads it; meta has
    its size, the place in PAIRS, and whether the key reads both strands. With fine, also hashes of the halves of
    the two other parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat(batch.column("canon"))
            ids, counts = (batch.column(c).to_numpy() for c in ("id", "n"))
            for size, rows in _by_size(np.diff(ends)):
                upright = _CODE[data[ends[rows][:, None] + np.arange(size)]]
                strands = [_strand(x, five, three, mirrored, fine) for x in (upright, turned(upright))]
                words = [words_of(upright), words_of(turned(upright))]
                for t in range(len(PAIRS)):
                    seen = [strands[0][0][t], strands[1][0][MIRRORED[t] if mirrored else t]]
                    both = seen[0] == seen[1] if mirrored else np.ones(len(rows), bool)
                    for o in (0, 1):
                        own = np.flatnonzero(both | (seen[o] < seen[1 - o]))
                        place = MIRRORED[t] if o and mirrored else t
                        meta = size << 4 | place << 1 | both[own]
                        code = np.ascontiguousarray(words[o][own])
                        width = code.shape[1] * 8
                        columns = [pa.array(seen[o][own].view(np.int64)), pa.array(ids[rows[own]] * 2 + o), pa.array(counts[rows[own]]), pa.array(meta.astype(np.int32))]
                        columns.append(pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.arange(0, width * len(own) + 1, width, dtype=np.int32)), pa.py_buffer(code)]))
                        yield pa.RecordBatch.from_arrays(columns + [pa.array(h[own].view(np.int64)) for h in (strands[o][1][place] if fine else [])], [*KEYED_NAMES, *(HALVES if fine else [])])

    return fit.select("id", "canon", "n").mapInArrow(run, KEYED + "".join(f", {h} long" for h in (HALVES if fine else [])))


KEYED_NAMES = [c.split()[0] for c in KEYED.split(", ")]


def _strand(codes: np.ndarray, five: int, three: int, mirrored: bool, fine: bool) -> tuple[list, list]:
    """The six keys of each row, and of each key the hashes of halves."""
    n = codes.shape[1] - five - three
    inner = codes[:, five : five + n].astype(np.uint64)
    many = _multipliers(n)
    part = lambda a, b: inner[:, a:b] @ many[: b - a]
    places = cuts(n, mirrored)
    parts = [_mixed(part(a, b) + np.uint64(1)) for a, b in places]
    salts = np.random.default_rng(n).integers(0, 1 << 63, len(PAIRS), np.uint64)
    keys = [_mixed(parts[i] * np.uint64(0x9E3779B97F4A7C15) + parts[j] + salts[t]) for t, (i, j) in enumerate(PAIRS)]
    if not fine:
        return keys, []
    halves = [(part(a, (a + b) // 2), part((a + b) // 2, b)) for a, b in places]
    return keys, [[h for k in range(4) if k not in two for h in halves[k]] for two in PAIRS]


#: Rows of a bucket, sequences whose rows are dealt to buckets at once, and rows that a task gathers before keys that very many rows share go.
BUCKET, CHUNK, GATHERED = 1 << 18, 1 << 16, 1 << 20


def _blob(size: int, meta: np.ndarray, n: np.ndarray, words: np.ndarray) -> bytes:
    """Rows of one size, byte by byte: bytes of one place stand together."""
    code = words.view(np.uint8).reshape(len(words), -1)[:, : -(-size // 4)]
    planes = meta.astype(np.uint8).tobytes() + n.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() + code.T.tobytes()
    return np.array([len(meta), size], np.uint32).tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def _rows_of(blob: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    rows, size = (int(x) for x in np.frombuffer(blob[:8], np.uint32))
    width = -(-size // 4)
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=rows * (9 + width), codec="zstd", asbytes=True), np.uint8).reshape(-1, rows)
    code = np.zeros((rows, -(-size // WORD) * 8), np.uint8)
    code[:, :width] = planes[9:].T
    return size, planes[0], np.ascontiguousarray(planes[1:9].T).view(np.int64).ravel(), code.view(np.uint64)


def dealt(fit: DataFrame, five: int, three: int, mirrored: bool, bits: int) -> DataFrame:
    """(bucket, data): the rows that keyed() gives of fit (canon, n), as blobs for the bucket that their key falls into. Keys do not
    travel, since a sequence and the place of its two parts say them again, nor do ids."""

    def told(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        buckets, blobs = [], []
        for size, parts in held.items():
            key, meta, n, words = (np.concatenate(x) for x in zip(*parts, strict=True))
            bucket = (key >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, meta, n, words = bucket[order], meta[order], n[order], words[order]
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            buckets.append(bucket[cuts[:-1]])
            blobs += [_blob(size, meta[a:b], n[a:b], words[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.record_batch([pa.array(np.concatenate(buckets), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = {}, 0
        for batch in batches:
            data, ends = flat(batch.column(0))
            counts = batch.column(1).to_numpy()
            for size, rows in _by_size(np.diff(ends)):
                upright = _CODE[data[ends[rows][:, None] + np.arange(size)]]
                codes = (upright, turned(upright))
                keys, words = [_strand(x, five, three, mirrored, False)[0] for x in codes], [words_of(x) for x in codes]
                for t in range(len(PAIRS)):
                    seen = [keys[0][t], keys[1][MIRRORED[t] if mirrored else t]]
                    both = seen[0] == seen[1] if mirrored else np.ones(len(rows), bool)
                    for o in (0, 1):
                        own = np.flatnonzero(both | (seen[o] < seen[1 - o]))
                        if len(own):
                            place = MIRRORED[t] if o and mirrored else t
                            held.setdefault(size, []).append((seen[o][own], (place << 2 | both[own] << 1 | o).astype(np.uint8), counts[rows[own]], words[o][own]))
            count += batch.num_rows
            if count >= CHUNK:
                yield from told(held)
                held, count = {}, 0
        if held:
            yield from told(held)

    return fit.select("canon", "n").mapInArrow(run, "bucket int, data binary")


def _keyed_rows(blobs: list[bytes], five: int, three: int, mirrored: bool) -> pa.Table:
    """Rows (KEYED, but ref is only whether the key reads the other strand) of blobs, by key."""
    tables = []
    for blob in blobs:
        size, flags, n, words = _rows_of(blob)
        keys, place = _strand(codes_of(words, size), five, three, mirrored, False)[0], flags >> 2
        key = np.choose(place, keys)
        width = words.shape[1] * 8
        code = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.arange(0, width * len(n) + 1, width, dtype=np.int32)), pa.py_buffer(words)])
        meta = size << 4 | place.astype(np.int32) << 1 | flags >> 1 & 1
        tables.append(pa.table([pa.array(key.view(np.int64)), pa.array((flags & 1).astype(np.int64)), pa.array(n), pa.array(meta.astype(np.int32)), code], names=KEYED_NAMES))
    return pa.concat_tables(tables)


def _with_names(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows left for finer keys, with the sequence that they are rows of as child."""
    if batch.column("key").null_count:
        return batch
    size, flag, names = batch.column("meta").to_numpy() >> 4, batch.column("ref").to_numpy(), np.empty(batch.num_rows, object)
    blobs = batch.column("code").to_pylist()
    for n, rows in _by_size(size):
        read = codes_of(np.frombuffer(b"".join(blobs[i] for i in rows), np.uint64).reshape(len(rows), -1), n)
        upright = np.where(flag[rows, None] == 1, turned(read), read)
        names[rows] = strings_of(_LETTERS[upright].reshape(-1), np.arange(len(rows) + 1) * n).to_pylist()
    return batch.set_column(batch.schema.get_field_index("child"), "child", pa.array(names, pa.string()))


def met_dealt(blobs: DataFrame, buckets: int, five: int, three: int, mirrored: bool, most: int) -> DataFrame:
    """PAIR and KEYED as met(once=True) gives them, of the blobs of dealt(): the rows of a bucket are put in key order and compared.
    Rows of keys that more than `most` share go as they come where a bucket has very many, with the sequence as child."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, waiting, held, hot = None, [], None, set()

        def gathered() -> pa.Table:
            nonlocal waiting, held
            more = [_keyed_rows(waiting, five, three, mirrored)] if waiting else []
            held, waiting = pa.concat_tables([*([] if held is None else [held]), *more]), []
            return held

        def without_hot() -> Iterator[pa.RecordBatch]:
            nonlocal held
            key = gathered()["key"].to_numpy()
            values, back, count = np.unique(key, return_inverse=True, return_counts=True)
            over = count > most
            if hot:
                over |= np.isin(values, np.fromiter(hot, np.int64))
            hot.update(values[over].tolist())
            for b in held.filter(pa.array(over[back])).combine_chunks().to_batches():
                yield _with_names(_filled({c: b.column(c) for c in KEYED_NAMES}))
            held = held.filter(pa.array(~over[back])).combine_chunks()

        def ended() -> Iterator[pa.RecordBatch]:
            yield from without_hot()
            order = np.argsort(held["key"].to_numpy(), kind="stable")
            yield from _block(held.take(pa.array(order)), five, three, mirrored, None, True, None)

        count, enough = 0, GATHERED
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != bucket:
                    if waiting or held is not None:
                        yield from ended()
                    bucket, waiting, held, hot, count, enough = b, [], None, set(), 0, GATHERED
                waiting.append(blob.as_py())
                count += int.from_bytes(waiting[-1][:4], "little")
                if count >= enough:
                    yield from without_hot()
                    count, enough = len(held), max(GATHERED, 2 * len(held))
        if waiting or held is not None:
            yield from ended()

    return blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, f"{PAIR}, {KEYED}")


def met(rows: DataFrame, five: int, three: int, mirrored: bool, most: int | None, once: bool) -> DataFrame:
    """PAIR and KEYED: close pairs of the rows that share a key, and the rows of keys that more than `most` rows share,
    which are left for finer keys. Rows come by key; a run of one key is all that a task holds. With once, a
    pair of several common keys is told by the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held, enough, hot = 0, ROWS, None
        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            if held < enough:
                continue
            table = pa.Table.from_batches(waiting)
            key = table["key"].to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if most is not None and (held - last > most or key[-1] == hot):
                yield from _block(table, five, three, mirrored, most, once, hot)
                waiting, held, hot = [], 0, key[-1]
            else:
                yield from _block(table.slice(0, last), five, three, mirrored, most, once, hot)
                waiting, held = table.slice(last).to_batches(), held - last
            enough = max(ROWS, 2 * held)
        if held:
            yield from _block(pa.Table.from_batches(waiting), five, three, mirrored, most, once, hot)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"{PAIR}, {KEYED}")


def _types() -> pa.Schema:
    mm = pa.list_(pa.struct([("pos", pa.int32()), ("a", pa.string()), ("b", pa.string())]))
    pair = [("parent", pa.string()), ("child", pa.string()), ("n_parent", pa.int64()), ("n_child", pa.int64()), ("oriented", pa.string()), ("turned", pa.int32()), ("mm", mm), ("h", pa.int32()), ("twin", pa.bool_())]
    return pa.schema(pair + [("key", pa.int64()), ("ref", pa.int64()), ("n", pa.int64()), ("meta", pa.int32()), ("code", pa.binary())])


def _filled(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in _types()], schema=_types())


def _block(table: pa.Table, five: int, three: int, mirrored: bool, most: int | None, once: bool, hot: int | None) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    key = table["key"].to_numpy()
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    left = np.repeat(sizes, sizes) - (np.arange(len(key)) - np.repeat(starts, sizes))  # rows of the run from this one on
    if most is not None:
        over = sizes > most
        if hot is not None:
            over |= key[starts] == hot
        over = np.repeat(over, sizes)
        if over.any():
            for b in table.filter(pa.array(over)).select(KEYED_NAMES).combine_chunks().to_batches():
                yield _filled({c: b.column(c) for c in KEYED_NAMES})
            left[over] = 0
    at = np.flatnonzero(left > 1)
    if not len(at):
        return
    meta, ref, n = (table[c].to_numpy() for c in ("meta", "ref", "n"))
    code = pa.concat_arrays(table["code"].chunks).cast(pa.large_binary())
    ends = np.frombuffer(code.buffers()[1], np.int64)[code.offset : code.offset + len(code) + 1]
    data = np.frombuffer(code.buffers()[2], np.uint8)
    size, width = meta >> 4, np.diff(ends) // 8
    words = np.zeros((len(key), int(width.max())), np.uint64)
    for w, rows in _by_size(width):
        words[rows, :w] = data[ends[rows][:, None] + np.arange(8 * w)].view(np.uint64)
    inside = None
    if five or three:
        inside = np.zeros_like(words)
        for s, rows in _by_size(size):
            inside[rows, : -(-s // WORD)] = words_of(np.repeat((np.arange(s) >= five) & (np.arange(s) < s - three), 1)[None].astype(np.uint8))
    found, held, d = [], 0, 1
    while len(at):
        for some in (at[i : i + ROWS] for i in range(0, len(at), ROWS)):
            x = words[some] ^ words[some + d]
            x = (x | x >> np.uint64(1)) & (LOW if inside is None else inside[some])
            h = np.bitwise_count(x).sum(axis=1, dtype=np.int32)
            near = some[(h > 0) & (h <= 2) & (size[some] == size[some + d])]
            found.append((near, near + d))
            held += len(near)
            if held >= TOLD:
                yield from _told(found, words, meta, ref, n, five, three, mirrored, once)
                found, held = [], 0
        d += 1
        at = at[left[at] > d]
    if held:
        yield from _told(found, words, meta, ref, n, five, three, mirrored, once)


def _told(found: list, words: np.ndarray, meta: np.ndarray, ref: np.ndarray, n: np.ndarray, five: int, three: int, mirrored: bool, once: bool) -> Iterator[pa.RecordBatch]:
    """The pairs (rows a, rows b) with their mismatches; those of the first key only, if once."""
    every = [np.concatenate(x) for x in zip(*found, strict=True)]
    for size, some in _by_size(meta[every[0]] >> 4):
        a, b = every[0][some], every[1][some]
        as_read = [codes_of(np.ascontiguousarray(words[x, : -(-size // WORD)]), size) for x in (a, b)]
        flags = [(ref[x] & 1).astype(bool) for x in (a, b)]
        upright = [np.where(f[:, None], turned(x), x) for f, x in zip(flags, as_read, strict=True)]
        apart = upright[0] != upright[1]
        place, rows = apart.argmax(axis=1), np.arange(len(a))
        first = (n[a] > n[b]) | ((n[a] == n[b]) & (upright[0][rows, place] < upright[1][rows, place]))
        flag = np.where(first, *flags)
        keep = apart.any(axis=1) & ~((meta[a] & 1).astype(bool) & flag)
        either = lambda x, y: np.where(first[:, None] if x.ndim > 1 else first, x, y)  # noqa: B023, E731
        parent, child, turn = either(*upright), either(*upright[::-1]), flags[0] != flags[1]
        aligned = np.where(turn[:, None], turned(child), child)
        inner = slice(five, size - three)
        differ = parent[:, inner] != aligned[:, inner]
        h = differ.sum(axis=1)
        keep &= (h > 0) & (h <= 2)
        if once:
            whole = [~differ[:, x:y].any(axis=1) for x, y in cuts(differ.shape[1], mirrored)]
            tag = meta[a] >> 1 & 7
            tag = np.where(flag, MIRRORED[tag], tag) if mirrored else tag
            keep &= np.array([whole[i] & whole[j] for i, j in PAIRS]).argmax(axis=0) == tag
        twin = (parent[:, inner] != turned(aligned)[:, inner]).sum(axis=1) <= 2
        row, pos = np.nonzero(differ[keep])
        old, new = parent[keep][row, pos + five], aligned[keep][row, pos + five]
        letters = lambda x: strings_of(_LETTERS[np.ascontiguousarray(x)].reshape(-1), np.arange(len(x) + 1) * (x.shape[1] if x.ndim > 1 else 1))
        mm = pa.StructArray.from_arrays([pa.array((pos + five).astype(np.int32)), letters(old), letters(new)], ["pos", "a", "b"])
        ends = np.append(0, np.cumsum(h[keep])).astype(np.int32)
        yield _filled({
            "parent": letters(parent[keep]), "child": letters(child[keep]), "n_parent": pa.array(np.where(first, n[a], n[b])[keep]), "n_child": pa.array(np.where(first, n[b], n[a])[keep]), "oriented": letters(aligned[keep]),
            "turned": pa.array(turn[keep].astype(np.int32)), "mm": pa.ListArray.from_arrays(pa.array(ends), mm), "h": pa.array(h[keep].astype(np.int32)), "twin": pa.array(twin[keep]),
        })
