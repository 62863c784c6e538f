"""A counterfactual-regularised toxicity classifier.

Logistic regression over the words of a text and their beginnings. Besides the usual losses it is
charged for the change of its score under counterfactuals of the labelled texts, so that the mention
of a group does not move it: the identity terms of a text are swapped for others of the same kind,
in several ways, and a mention is put into each text as it would be into a neutral sentence. Fitting
takes a bounded sample of labelled rows; scoring is array work on blocks of texts in one Arrow map.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.exchange import released
from palimpsest.llm.textblocks import Block, Roller, blocks, mix

#: Most labelled rows of each class that fit() reads, features it keeps, and rows a feature needs.
MAX_ROWS, MAX_FEATURES, MIN_ROWS = 6000, 4096, 4
#: Bytes of the word beginnings that are features besides whole words.
STARTS = (4, 5, 6, 7)
#: Weights of the charges: score change under a swap, squares, absolute values.
SWAP, RIDGE, LASSO = 1.0, 1e-5, 5e-5
#: Training ends where no entry of the gradient exceeds this, or after so many steps.
TOLERANCE, MAX_STEPS = 1e-5, 5000

#: Ways in which the terms of a text are swapped.
SHIFTS = (1, 2)
#: Terms of one kind are swapped for each other.
IDENTITY = (
    ("women", "men", "girls", "boys", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("deaf", "blind", "disabled", "elderly", "young"),
)


@dataclass(frozen=True)
class Model:
    """Sorted 64-bit feature keys with their weights; bounded by MAX_FEATURES."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float


def swap_terms(text: str, shift: int = 1, terms: tuple[tuple[str, ...], ...] = IDENTITY) -> str:
    """text with each identity term replaced by the one shift places on in its kind."""
    swap = {t: kind[(i + shift) % len(kind)] for kind in terms for i, t in enumerate(kind)}
    if not swap:
        return text
    return re.sub(r"\b(" + "|".join(swap) + r")\b", lambda m: swap[m[0]], text)


def _letters() -> np.ndarray:
    out = np.zeros(256, bool)
    out[0x80:] = True
    out[ord("a") : ord("z") + 1] = True
    return out


def features(block: Block, roller: Roller) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words and word beginnings of lower-case texts, and the text of each."""
    starts, ends, owner = block.edges(_letters()[block.data])
    prefix, keys, owners = roller.prefix(block.data), [], []
    keys.append(roller.spans(prefix, starts, ends))
    owners.append(owner)
    for k in STARTS:
        long = ends - starts >= k
        keys.append(mix(roller.spans(prefix, starts[long], starts[long] + k) + np.uint64(k)))
        owners.append(owner[long])
    return np.concatenate(keys), np.concatenate(owners)


def lowered(batch: pa.RecordBatch, i: int) -> pa.Array:
    return pc.utf8_lower(batch.column(i))


def _distinct(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[first], owner[first]


def sample_rows(labelled: DataFrame, label: str, key: str, most: int = MAX_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """About `most` rows of each class at most, by the hash of key; how many there are of each."""
    counts = {int(r[0]): r[1] for r in labelled.filter(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    share = lambda y: min(1.0, most / max(1, counts.get(y, 0)))
    unit = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    return labelled.filter(((F.col(label) == 1) & (unit < share(1))) | ((F.col(label) == 0) & (unit < share(0)))), counts


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches (label, text) the rows of either label that have a feature, block by block: some 80 times a
    block's bytes are in use at once, so that blocks are small."""
    roller = Roller(3)
    for batch in batches:
        y = batch.column(0).to_numpy()
        for at, block in blocks(lowered(batch, 1)):
            keys, owner = _distinct(*features(block, roller))
            one = y[at + owner]
            order = np.argsort(keys)
            keys, first = np.unique(keys[order], return_index=True)
            if len(keys):
                ones = np.add.reduceat(one[order], first)
                every = np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array((every - ones).astype(np.int64)), pa.array(ones.astype(np.int64))], names=["k", "a", "b"])
    released()


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, terms: tuple[tuple[str, ...], ...] = IDENTITY) -> Model:
    """Learn from the docs that labels covers; terms are the identity terms by kind (lower case). Labels other than 0 and 1 (null too) are left out;
    with only one class, or without labels, every text gets the share of label 1 as its score."""
    labelled = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y")).filter("_key is not null")
    chosen, counts = sample_rows(labelled, "_y", "_key", max_rows)
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    base = float(np.log((n1 + 0.5) / (n0 + 0.5))) if n1 and n0 else (-30.0 if not n1 else 30.0)
    if not n0 or not n1:
        return Model(np.empty(0, np.uint64), np.empty(0), base)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_key").select("_y", "_text")

    seen = rows.mapInArrow(_tally, "k bigint, a bigint, b bigint").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share0, share1 = F.col("a") / float(min(n0, max_rows)), F.col("b") / float(min(n1, max_rows))
    gap = F.abs(share1 - share0) / F.sqrt(share1 + share0 + 1e-4)
    kept = seen.filter(F.col("a") + F.col("b") >= MIN_ROWS).orderBy(gap.desc(), "k").limit(max_features).select("k").toPandas()
    keys = np.sort(kept["k"].to_numpy(np.int64).view(np.uint64))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(3)
        for batch in batches:
            y = batch.column(0).to_numpy()
            for at, block in blocks(lowered(batch, 1)):
                own = _hits(block, roller, keys)
                texts = [block.text(i).decode(errors="replace") for i in range(len(block))]
                turned = [{swap_terms(t, shift, terms) for shift in SHIFTS} - {t} for t in texts]
                swapped = [[_hits(next(blocks(pa.array([x])))[1], roller, keys)[0] for x in sorted(others)] for others in turned]
                yield pa.RecordBatch.from_arrays([pa.array(y[at : at + len(block)].astype(np.int32)), pa.array(own, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.list_(pa.int32())))], names=["y", "f", "g"])
        released()

    table = rows.mapInArrow(gather, "y int, f array<int>, g array<array<int>>").toPandas()
    y = table["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return Model(np.empty(0, np.uint64), np.empty(0), base)
    swaps = [(f, g) for f, others in zip(table["f"], table["g"], strict=True) for g in others]
    swaps += mentions(list(table["f"]), keys, terms)
    weights, bias = _train(list(table["f"]), y, swaps, len(keys))
    bias += base - float(np.log(y.sum() / (len(y) - y.sum())))  # classes were sampled unevenly
    used = np.abs(weights) > 0
    return Model(keys[used], weights[used], bias)


def mentions(rows: list, keys: np.ndarray, terms: tuple[tuple[str, ...], ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text (places of its features among keys) itself, and itself with one of the terms put in;
    left out where the term has no feature that the text lacks."""
    every = [t for kind in terms for t in kind]
    if not every:
        return []
    held = [np.array(h, np.int64) for h in _hits(next(blocks(pa.array(every)))[1], Roller(3), keys)]
    pairs = [(np.asarray(f, np.int64), held[int(np.sum(f)) % len(every)]) for f in rows]
    return [(f, np.union1d(f, h)) for f, h in pairs if len(np.setdiff1d(h, f))]


def _hits(block: Block, roller: Roller, wanted: np.ndarray) -> list[list[int]]:
    keys, owner, at = _found(block, roller, wanted)
    order = np.lexsort((at, owner))
    at, owner = at[order], owner[order]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    return [x.tolist() for x in np.split(at[first], np.searchsorted(owner[first], np.arange(1, len(block))))]


def _found(block: Block, roller: Roller, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of a block that are wanted: key, text, and place in wanted."""
    keys, owner = features(block, roller)
    if not len(wanted):
        return keys[:0], owner[:0], np.empty(0, np.int64)
    gate = np.zeros(1 << 16, bool)
    gate[(wanted >> np.uint64(48)).astype(np.int64)] = True
    near = gate[(keys >> np.uint64(48)).astype(np.int64)]
    keys, owner = keys[near], owner[near]
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    same = wanted[at] == keys
    return keys[same], owner[same], at[same]


def _train(rows: list, y: np.ndarray, swaps: list, n: int, tolerance: float = TOLERANCE, most: int = MAX_STEPS) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on mean log loss + charges, until no entry of the gradient
    (after the proximal step) exceeds tolerance. A swap counts by the features that it changes."""
    cols = np.concatenate([np.asarray(f, np.int64) for f in rows]) if rows else np.empty(0, np.int64)
    who = np.repeat(np.arange(len(rows)), [len(f) for f in rows])
    gone = [(np.setdiff1d(f, g), np.setdiff1d(g, f)) for f, g in swaps]
    d_cols = np.concatenate([np.r_[f, g].astype(np.int64) for f, g in gone]) if gone else np.empty(0, np.int64)
    d_sign = np.concatenate([np.r_[np.ones(len(f)), -np.ones(len(g))] for f, g in gone]) if gone else np.empty(0)
    d_who = np.repeat(np.arange(len(gone)), [len(f) + len(g) for f, g in gone]) if gone else np.empty(0, np.int64)

    def smooth(w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        score = np.bincount(who, w[cols], len(rows)) + bias
        off = (1 / (1 + np.exp(-np.clip(score, -500, 500))) - y) / len(rows)
        value = float(np.mean(np.logaddexp(0, score) - y * score)) + RIDGE / 2 * float(w @ w)
        grad = np.bincount(cols, off[who], n) + RIDGE * w
        if len(d_cols):
            change = np.bincount(d_who, d_sign * w[d_cols], len(swaps))
            value += SWAP * float(change @ change) / len(swaps)
            grad += SWAP * 2 / len(swaps) * np.bincount(d_cols, d_sign * change[d_who], n)
        return value, grad, float(off.sum())

    w, bias, v, v_bias, t, curve = np.zeros(n), 0.0, np.zeros(n), 0.0, 1.0, 1.0
    for _ in range(most):
        value, grad, slope = smooth(v, v_bias)
        while True:  # the curvature is raised until it bounds the loss where the step leads
            new = v - grad / curve
            new = np.sign(new) * np.maximum(np.abs(new) - LASSO / curve, 0)
            new_bias = v_bias - slope / curve
            by, by_bias = new - v, new_bias - v_bias
            bound = value + float(grad @ by) + slope * by_bias + curve / 2 * (float(by @ by) + by_bias**2)
            if smooth(new, new_bias)[0] <= bound + 1e-12:
                break
            curve *= 2
        if curve * max(abs(by_bias), float(np.abs(by).max(initial=0.0))) <= tolerance:
            return new, float(new_bias)
        if float(by @ (new - w)) + by_bias * (new_bias - bias) < 0:
            t = 1.0  # it went past the minimum: without momentum again
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, v_bias = new + (t - 1) / after * (new - w), new_bias + (t - 1) / after * (new_bias - bias)
        w, bias, t = new, new_bias, after
    return w, float(bias)


def score(docs: DataFrame, model: Model, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and score of each whole text, between 0 and 1. Null and empty texts, and texts without
    a known feature, get the score that the bias alone gives. Keys may be null or repeated."""
    # Plain values: a broadcast class would have to be installed on the executors.
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))
    rows = docs.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, model = Roller(3), Model(*shared.value)
        for batch in batches:
            for at, block in blocks(lowered(batch, len(keys))):
                _, owner, place = _found(block, roller, model.keys)
                pairs = np.unique(owner * np.int64(len(model.keys) + 1) + place)
                owner, place = np.divmod(pairs, len(model.keys) + 1)
                total = np.bincount(owner, model.weights[place], len(block)) + model.bias if len(pairs) else np.full(len(block), model.bias)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(block)) for i in range(len(keys))), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], names=[*keys, "score"])
        released()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "score double"]))


def toxic(score: str = "score") -> Column:
    return F.col(score) >= 0.5
