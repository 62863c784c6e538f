"""Removal of repeated passages by maximal repeats of an enhanced suffix array.

Every window of `length` bytes has one anchor, the least hash of its short substrings, so equal
windows have equal anchors wherever they stand. The windows of a text that share an anchor
make a segment. A blob exchange finds the anchors that stand in several documents; hashes route,
and decide nothing. The bytes of the segments with such anchors, each distinct one of a chunk once,
meet in the bucket of their anchor. There they are sorted: equal segments become one leaf with all
its occurrences, and the suffixes of the distinct segments form an enhanced suffix array. A stack
scan of its common-prefix lengths lists the interval tree, and the intervals whose left extensions
differ are the maximal repeats, each with all its occurrences. What a document with a smaller id
holds is removed from all the others.

An anchor with more distinct segments than HOT (the edge of a passage that very many documents
hold has another neighbourhood in each) would make one large group. Its segments are taken apart
into their windows, which are routed by their own hashes: windows that differ go different ways.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.exchange import buckets, chunked, pack, placed, released, unpack
from palimpsest.llm.textblocks import Block, Roller, blocks, mix

#: Bytes of a repeat, and of the substrings among which its anchor is chosen.
LENGTH, ANCHOR = 50, 20
#: Bytes of text in a chunk, on average, and of a block of it, whose arrays a core's cache holds.
CHUNK, BLOCK = 2 << 20, 1 << 17
#: Suffixes that one array holds, unless a single anchor has more; distinct segments of an anchor
#: beyond which it is taken apart into windows.
SLICE, HOT = 32_768, 16_384

_LOW = np.uint64(4095)
_LAST = np.iinfo(np.int64).max
_CODEC = "zstd"


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of a least value (but for its low bits) in each window of width values, fewer than 4,096.
    A value carries its place in its low bits, so that one minimum finds both."""
    if len(values) < width:
        return np.empty(0, np.int64)
    places, have = np.arange(len(values), dtype=np.uint64), 1
    best = (values | _LOW) - _LOW + (places & _LOW)
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[step:], best[:-step])
        have += step
    places = places[: len(best)]
    return (places + ((best - places) & _LOW)).astype(np.int64)


def segments(block: Block, roller: Roller, length: int, anchor: int) -> dict[str, np.ndarray]:
    """doc, start (in the doc), size, and the hashes of anchor and whole of each segment of a block.
    Least hashes crowd at the low end, so the anchor's is mixed once more to spread over the buckets."""
    none = {k: np.empty(0, np.int64) for k in ("doc", "start", "size")} | {k: np.empty(0, np.uint64) for k in ("anchor", "whole")}
    n = len(block.data)
    if n < length:
        return none
    prefix = roller.prefix(block.data)
    hashes = roller.grams(prefix, anchor)
    at = least_places(hashes, length - anchor + 1)
    long = block.sizes >= length
    marks = np.zeros(n + 1, np.int8)
    marks[block.offsets[:-1][long]] += 1
    marks[block.offsets[1:][long] - length + 1] -= 1
    valid = np.cumsum(marks[: len(at)], dtype=np.int8) > 0
    if not valid.any():
        return none
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(valid & change)
    ends = np.zeros(len(at), bool)
    ends[:-1] = change[1:] | ~valid[1:]
    ends[-1] = True
    last = np.flatnonzero(valid & ends)
    place = at[first]
    doc = np.searchsorted(block.offsets, first, "right") - 1
    whole = roller.spans(prefix, first, last + length) + (place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return {"doc": doc, "start": first - block.offsets[doc], "size": last + length - first, "anchor": mix(hashes[place] | _LOW), "whole": mix(whole) >> np.uint64(24)}


def repeat_groups(texts: np.ndarray, sizes: np.ndarray, before: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """Maximal repeats of at least length bytes among suffixes: (bytes, places of all occurrences).

    texts has a suffix in each row (zeros after its size); before is the byte to its left, or a
    value of its own (below 0) where the text begins. Suffixes are sorted, the common-prefix array
    is scanned with a stack, and an interval is a maximal repeat if its members do not all extend
    to the left by one byte."""
    n, width = texts.shape
    order = np.argsort(np.ascontiguousarray(texts).view(f"S{width}").ravel(), kind="stable")
    sizes, before, rows = sizes[order], before[order], texts[order]
    same = rows[1:] == rows[:-1]
    common = np.where(same.all(axis=1), width, same.argmin(axis=1)) if n > 1 else np.empty(0, np.int64)
    common = np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))
    out: list[tuple[int, np.ndarray]] = []
    stack: list[tuple[int, int]] = []  # common length and left end of the open intervals
    # changes[i]: neighbours before i + 1 whose left bytes differ, so that diversity of an interval is one difference.
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    common = np.append(common, 0)
    for i in np.flatnonzero((common >= length) | np.concatenate([[False], common[:-1] >= length])).tolist():
        left, here = i, int(common[i])
        while stack and stack[-1][0] > here:
            size, left = stack.pop()
            if changes[i] != changes[left] or before[left] < 0:
                out.append((size, order[left : i + 1]))
        if here >= length and (not stack or stack[-1][0] < here):
            stack.append((here, left))
    return out


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges as the fewest that cover the same bytes, by document and place."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # Documents are laid out far enough apart that one running maximum serves all.
    span = np.int64(1) << 40
    reach = np.maximum.accumulate(doc * span + end)
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] * span + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], start[first], np.append(reach[first[1:] - 1], reach[-1]) - doc[first] * span


def matrix(data: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The bytes of ranges of data in rows, zeros after their sizes."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, width)[begin]
    out[np.arange(width) >= size[:, None]] = 0
    return out


def folded(data: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges sorted by their bytes and folded: the place of one of each kind, the kind of each."""
    rows = np.concatenate([matrix(data, begin, size, width), size[:, None].astype(np.uint8)], axis=1)
    _, first, kind = np.unique(rows.view(f"S{width + 1}").ravel(), return_index=True, return_inverse=True)
    return first, kind


def expanded(counts: np.ndarray) -> np.ndarray:
    """0 to count - 1 for each count, end to end."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def maximal_repeats(data: np.ndarray, begin: np.ndarray, size: np.ndarray, group: np.ndarray, least: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset, bytes) of what some distinct segments share with one whose least document is
    smaller: the intervals of the suffix arrays of all segments of a group, as many groups at a time
    as a slice holds."""
    order = np.argsort(group, kind="stable")
    begin, size, group = begin[order], size[order], group[order]
    count = size - length + 1
    upto = np.cumsum(count)
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)) if len(group) else np.empty(0, np.int64)
    alone = np.zeros(len(group), bool)
    alone[ends[np.diff(ends, prepend=0) == 1] - 1] = True
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < len(group):
        done = upto[lo - 1] if lo else 0
        hi = int(ends[min(np.searchsorted(ends, max(lo + 1, np.searchsorted(upto, done + SLICE, "right")), "left"), len(ends) - 1)])
        which = lo + np.flatnonzero(~alone[lo:hi])  # the tree of a lone segment is its leaf
        of = np.repeat(which, count[which])
        off = expanded(count[which])
        if len(of):
            texts = matrix(data, begin[of] + off, size[of] - off, width)
            before = np.where(off > 0, data[begin[of] + off - 1].astype(np.int64), -1 - np.arange(len(of)))
            for common, who in repeat_groups(texts, size[of] - off, before, length):
                held = least[order[of[who]]]
                later = held > held.min()
                if later.any():
                    out.append((order[of[who[later]]], off[who[later]], np.full(int(later.sum()), common)))
        lo = hi
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """_id (doc_id as long), keep, n_bytes, n_removed, n_spans and kept (binary) of each document.

    Each byte is removed that a string of `length` bytes covers which also starts in a document
    with a smaller doc_id; all strings are judged on the input. A null text is empty. Equal doc_ids
    are not smaller than each other, null ids come after all others. Repeated rows, texts shorter
    than length and empty tables are ordinary. keep must not name a column of the result."""
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), *keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    dealt, n_chunks = chunked(rows, "_text", "_id", CHUNK)
    n, width, hot = buckets(n_chunks), 2 * length - anchor, HOT

    def in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.sort_by([("_id", "ascending"), ("_text", "ascending")])
        return table, table["_id"].fill_null(_LAST).to_numpy()

    def parts(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The segments of a chunk, with begin (their place in all its bytes), and those bytes."""
        roller, found, held, base = Roller(8), [], [], 0
        for at, block in blocks(table["_text"], BLOCK):
            got = segments(block, roller, length, anchor)
            got["begin"] = block.offsets[got["doc"]] + got["start"] + base
            got["doc"] = got["doc"] + at
            found.append(got)
            held.append(block.data)
            base += len(block.data)
        return {k: np.concatenate([f[k] for f in found]) for k in found[0]}, np.concatenate(held)

    def of_anchors(s: dict[str, np.ndarray], by: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted anchors, that of each segment, and how many values of s[by] each anchor has."""
        every, back = np.unique(s["anchor"], return_inverse=True)
        order = np.lexsort((s[by], back))
        new = np.ones(len(order), bool)
        new[1:] = (back[order][1:] != back[order][:-1]) | (s[by][order][1:] != s[by][order][:-1])
        return every, back, np.bincount(back[order[new]], minlength=len(every))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        released()
        s, _ = parts(in_order(table)[0])
        every, _, kinds = of_anchors(s, "whole")
        at, place = placed(every, n)
        some, kinds = np.flatnonzero(np.diff(at)), np.minimum(kinds, 65_535).astype(np.uint16)
        blob = lambda x: pa.array([pack(x[at[b] : at[b + 1]]) for b in some], pa.binary())
        return pa.table({"bucket": pa.array(some.astype(np.int32)), "chunk": pa.array(np.full(len(some), key[0].as_py(), np.int32)), "p": blob(place), "c": blob(kinds)})

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        """0 for an anchor that no other chunk holds, 1 for others, 2 for the hot ones."""
        released()
        places = [unpack(x.as_py(), np.uint32) for x in table["p"]]
        kinds = np.concatenate([unpack(x.as_py(), np.uint16) for x in table["c"]])
        _, back, held = np.unique(np.concatenate(places), return_inverse=True, return_counts=True)
        code = np.where(np.bincount(back, kinds) > hot, 2, held > 1).astype(np.uint8)[back]
        replies = np.split(code, np.cumsum([len(x) for x in places])[:-1])
        return pa.table({"_chunk": table["chunk"], "bucket": pa.array(np.full(len(places), key[0].as_py(), np.int32)), "c": pa.array([x.tobytes() for x in replies], pa.binary())})

    def units(s: dict[str, np.ndarray], data: np.ndarray, code: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Segments with anchors of several documents, windows where the anchor is hot (doc, start,
        begin, size, key), by the answers for the chunk's anchors; folded."""
        _, back, documents = of_anchors(s, "doc")
        whole = np.flatnonzero((code[back] == 1) | ((code[back] == 0) & (documents[back] > 1)))
        u = {k: s[k][whole] for k in ("doc", "start", "begin", "size")} | {"key": s["anchor"][whole]}
        apart = np.flatnonzero(code[back] == 2)
        if len(apart):
            count = s["size"][apart] - length + 1
            of, off = np.repeat(apart, count), expanded(count)
            begin = s["begin"][of] + off
            roller = Roller(9)
            more = {"doc": s["doc"][of], "start": s["start"][of] + off, "begin": begin, "size": np.full(len(of), length), "key": roller.spans(roller.prefix(data), begin, begin + length)}
            u = {k: np.concatenate([u[k], more[k]]) for k in u}
        return u, *folded(data, u["begin"], u["size"], width)

    def least_of(ids: np.ndarray, kind: np.ndarray, kinds: int) -> np.ndarray:
        least = np.full(kinds, _LAST)
        np.minimum.at(least, kind, ids)
        return least

    def request(left: pa.Table, right: pa.Table) -> pa.Table:
        released()
        shape = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), *((c, pa.binary()) for c in ("p", "i", "k", "z", "t", "codes"))])
        if not len(left) or not len(right):
            return shape.empty_table()
        chunk = left["_chunk"][0].as_py()
        table, ids = in_order(left)
        s, data = parts(table)
        codes = b"".join(x.as_py() for x in right.sort_by("bucket")["c"])
        u, first, kind = units(s, data, np.frombuffer(codes, np.uint8))
        out = [(chunk % n, chunk, b"", b"", b"", b"", b"", len(codes).to_bytes(4, "little") + pa.compress(codes, _CODEC, asbytes=True))]
        least = least_of(ids[u["doc"]], kind, len(first))
        order = np.argsort(u["key"][first], kind="stable")
        at, place = placed(u["key"][first[order]], n)
        for b in np.flatnonzero(np.diff(at)):
            p, cell = order[at[b] : at[b + 1]], place[at[b] : at[b + 1]]
            size = u["size"][first[p]]
            raw = data[np.repeat(u["begin"][first[p]], size) + expanded(size)].tobytes()
            out.append((int(b), chunk, pack(cell), pack(least[p]), pack(p.astype(np.uint32)), size.astype(np.uint8).tobytes(), pa.compress(raw, _CODEC, asbytes=True), None))
        return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(shape)], schema=shape)

    def resolve(key: tuple, table: pa.Table) -> pa.Table:
        released()
        rows = table.to_pylist()
        out = [(r["chunk"], *[b""] * 5, r["codes"]) for r in rows if r["codes"] is not None]
        rows = [r for r in rows if r["codes"] is None]
        if rows:
            number = lambda c, t: np.concatenate([unpack(r[c], t) for r in rows])
            place, ids, name = number("p", np.uint32), number("i", np.int64), number("k", np.uint32)
            chunk = np.repeat([r["chunk"] for r in rows], [len(r["z"]) for r in rows])
            sizes = [np.frombuffer(r["z"], np.uint8).astype(np.int64) for r in rows]
            data = np.frombuffer(b"".join(pa.decompress(r["t"], int(z.sum()), _CODEC, asbytes=True) for r, z in zip(rows, sizes, strict=True)), np.uint8)
            size = np.concatenate(sizes)
            begin = np.cumsum(size) - size
            first, kind = folded(data, begin, size, width)
            least = least_of(ids, kind, len(first))
            which, off, common = maximal_repeats(data, begin[first], size[first], place[first], least, length, width)
            # A leaf's occurrences: all documents but the least lose the segment. What the least
            # shares with smaller ones, by the intervals, is told to those that hold it for the least.
            later = np.flatnonzero(ids > least[kind])
            owner = np.flatnonzero(ids == least[kind])
            owner = owner[np.argsort(kind[owner], kind="stable")]
            count = np.bincount(kind[owner], minlength=len(first))
            begins = np.cumsum(count) - count
            to = owner[np.repeat(begins[which], count[which]) + expanded(count[which])]
            off, common = np.repeat(off, count[which]), np.repeat(common, count[which])
            for c in np.unique(np.concatenate([chunk[later], chunk[to]])):
                x, y = later[chunk[later] == c], chunk[to] == c
                out.append((int(c), pack(name[x]), pack(least[kind[x]]), pack(name[to[y]]), off[y].astype(np.uint8).tobytes(), common[y].astype(np.uint8).tobytes(), None))
        return pa.table([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[k] for r in out], pa.binary()) for k in range(1, 7))], names=["_chunk", "l", "m", "k", "o", "c", "codes"])

    names = ["_id", *keep, "n_bytes", "n_removed", "n_spans", "kept"]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        released()
        table, ids = in_order(left)
        d = b = e = np.empty(0, np.int64)
        codes = [x.as_py() for x in right["codes"] if x.is_valid]
        if codes:
            s, data = parts(table)
            u, first, kind = units(s, data, np.frombuffer(pa.decompress(codes[0][4:], int.from_bytes(codes[0][:4], "little"), _CODEC, asbytes=True), np.uint8))
            number = lambda c, t: np.concatenate([unpack(x.as_py(), t) for x in right[c]])
            own = ids[u["doc"]]
            least = least_of(own, kind, len(first))
            told = least.copy()
            np.minimum.at(told, number("l", np.uint32), number("m", np.int64))
            copy = np.flatnonzero(own > told[kind])
            of, off, common = number("k", np.uint32), *(np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in right[c]]).astype(np.int64) for c in ("o", "c"))
            # The ranges of a kind that smaller documents hold, in each of its copies in the least.
            owner = np.flatnonzero(own == least[kind])
            owner = owner[np.argsort(kind[owner], kind="stable")]
            count = np.bincount(kind[owner], minlength=len(first))
            begins = np.cumsum(count) - count
            to = owner[np.repeat(begins[of], count[of]) + expanded(count[of])]
            off, common = np.repeat(off, count[of]), np.repeat(common, count[of])
            d, b, e = merged(np.concatenate([u["doc"][copy], u["doc"][to]]), np.concatenate([u["start"][copy], u["start"][to] + off]), np.concatenate([u["start"][copy] + u["size"][copy], u["start"][to] + off + common]))
        ends = np.searchsorted(d, np.arange(len(table) + 1))
        size, gone, spans, kept = [], [], [], []
        for j, x in enumerate(table["_text"]):
            raw, at, pieces = x.as_py().encode(), 0, []
            for k in range(ends[j], ends[j + 1]):
                pieces.append(raw[at : b[k]])
                at = int(e[k])
            pieces.append(raw[at:])
            kept.append(b"".join(pieces))
            size.append(len(raw))
            gone.append(len(raw) - len(kept[-1]))
            spans.append(int(ends[j + 1] - ends[j]))
        return pa.table([table["_id"], *(table[k] for k in keep), *(pa.array(x, pa.int64()) for x in (size, gone, spans)), pa.array(kept, pa.binary())], names=names)

    answered = dealt.groupBy("_chunk").applyInArrow(ask, "bucket int, chunk int, p binary, c binary").groupBy("bucket").applyInArrow(answer, "_chunk int, bucket int, c binary")
    requested = dealt.groupBy("_chunk").cogroup(answered.groupBy("_chunk")).applyInArrow(request, "bucket int, chunk int, p binary, i binary, k binary, z binary, t binary, codes binary")
    ranges = requested.groupBy("bucket").applyInArrow(resolve, "_chunk int, l binary, m binary, k binary, o binary, c binary, codes binary")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]]
    return dealt.groupBy("_chunk").cogroup(ranges.groupBy("_chunk")).applyInArrow(finish, ", ".join([*fields, "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"]))
