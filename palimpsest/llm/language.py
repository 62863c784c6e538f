"""Language identification by word-first backoff.

A word that training has seen is scored by its log frequency in each language. For an unseen word
every character position is scored by the longest character n-gram beginning there that is known,
falling back to shorter ones. Scores are centred over the languages, so that only differences
count. Fitting takes a bounded sample of labelled rows; prediction is one Arrow map.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textblocks import Block, Roller, blocks, mix

#: Most training rows, most languages, most words and n-grams that the model keeps.
MAX_ROWS, MAX_LANGUAGES, MAX_WORDS, MAX_GRAMS = 8000, 500, 200_000, 100_000
#: Characters of the longest n-gram; how often a word or n-gram must occur to be known.
LONGEST, MIN_COUNT = 5, 3
SMOOTH = 0.5
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    words: tuple[np.ndarray, np.ndarray]  #: sorted keys, centred log frequency by language
    grams: tuple[np.ndarray, np.ndarray]


def word_runs(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of lower-case ASCII letters and of bytes of other characters."""
    inside = np.zeros(256, bool)
    inside[0x80:] = True
    inside[ord("a") : ord("z") + 1] = True
    return block.edges(inside[block.data])


def gram_keys(block: Block, roller: Roller, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the n-character n-grams of some words: key, the word's place, first character."""
    chars = np.append(np.flatnonzero(block.char_starts()), len(block.data))
    first, last = np.searchsorted(chars, starts), np.searchsorted(chars, ends)
    count = np.maximum(last - first - n + 1, 0)
    word = np.repeat(np.arange(len(starts)), count)
    char = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + first[word]
    return mix(roller.spans(prefix, chars[char], chars[char + n]) + np.uint64(n)), word, char


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """Learn from rows whose lang is not null: about max_rows at most, as many of each language as
    far as there are so many, by the hash of key."""
    known = docs.filter(F.col(lang).isNotNull())
    counts = sorted((r[0], r[1]) for r in known.groupBy(lang).count().collect())
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"{len(counts)} languages; the model takes {MAX_LANGUAGES} at most")
    languages = tuple(x for x, _ in counts)
    empty = np.empty(0, np.uint64), np.empty((0, len(languages)))
    if not languages:
        return Model(languages, empty, empty)
    each = max_rows / len(counts)
    spark = docs.sparkSession
    shares = F.broadcast(spark.createDataFrame([(x, i, min(1.0, each / n)) for i, (x, n) in enumerate(counts)], "_lang string, _l int, _share double"))
    unit = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    rows = known.select(F.col(lang).alias("_lang"), unit.alias("_unit"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).join(shares, "_lang").filter("_unit < _share").select("_l", "_text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(4)
        for batch in batches:
            who = batch.column(0).to_numpy().astype(np.int64)
            for at, block in blocks(pc.utf8_lower(batch.column(1)), 4 << 20):
                starts, ends, owner = word_runs(block)
                prefix = roller.prefix(block.data)
                for n in range(LONGEST + 1):
                    keys, word = (roller.spans(prefix, starts, ends), np.arange(len(starts))) if not n else gram_keys(block, roller, prefix, starts, ends, n)[:2]
                    which = who[at + owner[word]]
                    for i in np.unique(which):
                        k, c = np.unique(keys[which == i], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), n, np.int32)), pa.array(k.view(np.int64)), pa.array(np.full(len(k), i, np.int32)), pa.array(c.astype(np.int64))], names=["n", "k", "l", "c"])

    tallied = rows.mapInArrow(tally, "n int, k bigint, l int, c bigint")
    by = [F.sum(F.when(F.col("l") == i, F.col("c")).otherwise(0)).alias(f"c{i}") for i in range(len(languages))]
    summed = tallied.groupBy(F.least("n", F.lit(1)).alias("n"), "k").agg(F.sum("c").alias("c"), *by).filter(F.col("c") >= MIN_COUNT)

    def table(n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        found = summed.filter(F.col("n") == n).orderBy(F.desc("c"), "k").limit(most).drop("n", "c").toPandas()
        keys = found["k"].to_numpy(np.int64).view(np.uint64)
        got = found.drop(columns="k").to_numpy(float)
        logs = np.log((got + SMOOTH) / (got.sum(axis=0) + SMOOTH * (len(got) + 1)))
        order = np.argsort(keys)
        return keys[order], (logs - logs.mean(axis=1, keepdims=True))[order]

    return Model(languages, table(0, MAX_WORDS), table(1, MAX_GRAMS))


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def evidence(block: Block, model: Model, roller: Roller) -> tuple[np.ndarray, np.ndarray]:
    """Summed centred scores by language of each text, and its number of words."""
    n, m = len(block), len(model.languages)
    starts, ends, owner = word_runs(block)
    prefix = roller.prefix(block.data)
    keys, back = np.unique(roller.spans(prefix, starts, ends), return_inverse=True)
    at = _place(model.words[0], keys)
    scores = np.zeros((len(keys), m))
    scores[at >= 0] = model.words[1][at[at >= 0]]
    example = np.zeros(len(keys), np.int64)
    example[back] = np.arange(len(back))
    unseen = np.flatnonzero(at < 0)
    s, e = starts[example[unseen]], ends[example[unseen]]
    done = np.zeros(len(block.data) + 1, bool)  # by character, so each position counts once
    for k in range(LONGEST, 0, -1):
        grams, word, char = gram_keys(block, roller, prefix, s, e, k)
        open_ = ~done[char]
        grams, word, char = grams[open_], word[open_], char[open_]
        place = _place(model.grams[0], grams)
        hit = place >= 0
        done[char[hit]] = True
        for i in range(m):
            scores[:, i] += np.bincount(unseen[word[hit]], model.grams[1][place[hit], i], len(keys)) / LONGEST
    return np.stack([np.bincount(owner, scores[back, i], n) for i in range(m)], axis=1) if m else np.zeros((n, 0)), np.bincount(owner, minlength=n)


def predict(docs: DataFrame, model: Model, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, lang_pred and score (the language's share of belief, 0 to 1) of each whole text.

    A null text, or one without a letter, is 'und' with score 0, and so is everything if nothing
    was learned. Of languages that tie, the first by name is taken."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.words, model.grams))  # bounded by MAX_WORDS and MAX_GRAMS
    rows = docs.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, model = Roller(4), Model(*shared.value)
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for at, block in blocks(pc.utf8_lower(batch.column(len(keys)))):
                total, words = evidence(block, model, roller)
                lettered = words > 0
                for i in np.flatnonzero(lettered):
                    lettered[i] = _has_letter(block, i)
                if not model.languages:
                    lettered[:] = False
                    total = np.zeros((len(block), 1))
                soft = total / np.maximum(words, 1)[:, None] * np.minimum(words, 20)[:, None]
                soft = np.exp(soft - soft.max(axis=1, keepdims=True))
                best = total.argmax(axis=1)
                score = (soft / soft.sum(axis=1, keepdims=True))[np.arange(len(best)), best]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(block)) for i in range(len(keys))), pa.array(names[np.where(lettered, best, len(names) - 1)], pa.string()), pa.array(np.where(lettered, score, 0.0))], names=[*keys, "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double"]))


def _has_letter(block: Block, i: int) -> bool:
    part = block.data[block.offsets[i] : block.offsets[i + 1]]
    if ((part >= ord("a")) & (part <= ord("z"))).any():
        return True
    return any(c.isalpha() for c in part.tobytes().decode(errors="ignore"))
