"""A hidden Markov language model.

Every distinct word of a chunk of documents is counted over the whole corpus by a blob exchange,
which also turns the texts into numbers: words of the model vocabulary keep their own number, all
others share one class in which they are told apart by their corpus counts. The vocabulary holds the
most frequent words of all training documents and grows with the root of their number of words.
Baum-Welch runs over the numbers of all training documents: each task adds up expected counts, Spark
sums them, and the driver makes the next model from sums of states times vocabulary. Sequences of a
batch advance together through the scaled forward recursion, which gives exact likelihoods.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.exchange import chunked, cuts, pack, unpack, written
from palimpsest.llm.textblocks import Block, Roller, blocks, totals

#: Hidden states; words with numbers of their own, at least, and for each root of the number of
#: training words; passes of Baum-Welch over all training documents.
STATES, VOCABULARY, GROWTH, PASSES = 8, 16_384, 4, 14
#: Training takes sequences whole up to so many tokens, and longer ones in pieces of that size, each a
#: sequence of its own; sequences advance together up to so many tokens; added counts.
CUT, BATCH_TOKENS, ADDED, PRIOR = 1 << 17, 1 << 19, 0.1, 50.0
#: Tokens that training gathers before it deals them into batches: long sequences meet there.
GATHERED = 1 << 22


@dataclass(frozen=True)
class Model:
    start: np.ndarray  #: states
    move: np.ndarray  #: states x states
    emit: np.ndarray  #: symbols x states


def lower_az(block: Block) -> Block:
    data = block.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    return Block(data, block.offsets)


def word_keys(block: Block, roller: Roller) -> tuple[np.ndarray, np.ndarray]:
    block = lower_az(block)
    starts, ends, owner = block.words()
    return roller.spans(roller.prefix(block.data), starts, ends), owner


def batches_of(sequences: list[np.ndarray], tokens: int = BATCH_TOKENS) -> Iterator[np.ndarray]:
    """Places of sequences that may advance together: by falling length, bounded by the sum of their
    lengths. A batch takes as many steps as its longest sequence has, so that short ones go along with it."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-lengths, kind="stable")
    upto = np.cumsum(lengths[order])
    at = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(upto, tokens + (upto[at - 1] if at else 0), "right")))
        yield order[at:to]
        at = to


def in_steps(sequences: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all sequences at the first step, then at the second and so on, and where each
    step begins. Sequences fall in length, so a step holds those that are still going, from the first."""
    lengths = np.array([len(sequences[i]) for i in which])
    going = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
    begins = np.concatenate([[0], np.cumsum(going)])
    out = np.empty(begins[-1], np.int64)
    for j, i in enumerate(which):
        out[begins[: lengths[j]] + j] = sequences[i]
    return out, begins


def forward(model: Model, emitted: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities of each symbol (a row of emitted), and their scales."""
    out, scales, ones = np.empty_like(emitted), np.empty(len(emitted), emitted.dtype), np.ones(emitted.shape[1], emitted.dtype)
    for t in range(len(begins) - 1):
        at, to = begins[t], begins[t + 1]
        now, scale = out[at:to], scales[at:to]
        if t:
            np.matmul(out[begins[t - 1] : begins[t - 1] + to - at], model.move, out=now)
            now *= emitted[at:to]
        else:
            np.multiply(model.start, emitted[at:to], out=now)
        np.matmul(now, ones, out=scale)
        now /= scale[:, None]
    return out, scales


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log of the probability of each (non-empty) sequence."""
    out = np.zeros(len(sequences))
    for which in batches_of(sequences):
        symbols, begins = in_steps(sequences, which)
        _, scales = forward(model, np.take(model.emit, symbols, axis=0), begins)
        place = np.arange(len(symbols)) - np.repeat(begins[:-1], np.diff(begins))
        out[which] = np.bincount(place, np.log(scales.astype(float)), len(which))
    return out


def expected(model: Model, sequences: list[np.ndarray], tokens: int = BATCH_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of some sequences: starts, moves, emissions; and their log likelihood. Chances have the
    precision of the model; sums over them are double."""
    k, v = len(model.start), len(model.emit)
    start, move, emit, logs = np.zeros(k), np.zeros((k, k)), np.zeros((v, k)), 0.0
    turned = np.ascontiguousarray(model.move.T)
    for which in batches_of(sequences, tokens):
        symbols, begins = in_steps(sequences, which)
        ahead = np.take(model.emit, symbols, axis=0)
        chances, scales = forward(model, ahead, begins)
        logs += float(np.log(scales).sum(dtype=float))
        ahead /= scales[:, None]
        # From here on, ahead becomes the scaled emission times the backward probability.
        for t in range(len(begins) - 3, -1, -1):
            m = begins[t + 2] - begins[t + 1]
            ahead[begins[t] : begins[t] + m] *= ahead[begins[t + 1] : begins[t + 2]] @ turned
        after, first = ahead[begins[1] :], begins[1]
        before = np.arange(first, len(symbols)) - np.repeat(np.diff(begins)[:-1], np.diff(begins)[1:])
        for at in range(0, len(after), 1 << 16):
            some, rows = after[at : at + (1 << 16)], before[at : at + (1 << 16)]
            was = chances[rows]
            move += was.T @ some * model.move
            chances[rows] = was * (some @ turned)
        start += chances[:first].sum(axis=0, dtype=float)
        for j in range(k):
            emit[:, j] += np.bincount(symbols, chances[:, j], v)
    return start, move, emit, logs


def improved(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    """The model that expected counts give, each state leaning on the common word frequencies."""
    common = emit.sum(axis=1) + ADDED
    common = common / common.sum()
    emit = emit + PRIOR * common[:, None]
    move = move + 1.0
    start = start + 1.0
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def first_model(frequency: np.ndarray, states: int, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    emit = (frequency + ADDED)[:, None] * rng.uniform(0.5, 1.5, (len(frequency), states))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def symbol_type(symbols: int) -> type:
    """What holds the numbers of so many symbols."""
    return np.uint16 if symbols <= 1 << 16 else np.uint32


def gathered(batches: Iterator[pa.RecordBatch], kind: type, tokens: int = GATHERED) -> Iterator[list[np.ndarray]]:
    """Training pieces of the sequences of batches (column 0), about so many tokens at a time."""
    held, n = [], 0
    for batch in batches:
        for x in batch.column(0):
            s = np.frombuffer(x.as_py(), kind)
            held += [s[a : a + CUT] for a in range(0, len(s), CUT)]
            n += len(s)
            if n >= tokens:
                yield held
                held, n = [], 0
    if held:
        yield held


def baum_welch(encoded: DataFrame, model: Model) -> tuple[Model, float]:
    """One pass over the rows of encoded (column ids): counts by partition, summed by Spark, of as
    many partitions as there are cores, since each sends up to a row for every symbol. A pass without
    rows leaves the model as it is."""
    shared = encoded.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))
    k, v = len(model.start), len(model.emit)
    columns = [f"s{j}" for j in range(k)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        # Single precision: chances are scaled at each step, and batches of twice as many tokens fit.
        total, model = None, Model(*(x.astype(np.float32) for x in shared.value))
        for pieces in gathered(batches, symbol_type(v)):
            got = expected(model, pieces, 2 * BATCH_TOKENS)
            total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
        if total is not None:
            start, move, emit, logs = total
            used = np.flatnonzero(emit.any(axis=1))
            rows = np.concatenate([start[None], move, np.full((1, k), logs), emit[used]])
            names = np.concatenate([[-1], -2 - np.arange(k), [-2 - k], used])
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *(pa.array(rows[:, j]) for j in range(k))], names=["w", *columns])

    counted = encoded.select("ids").coalesce(encoded.sparkSession.sparkContext.defaultParallelism).mapInArrow(count, ", ".join(["w int", *(f"{c} double" for c in columns)]))
    sums = counted.groupBy("w").agg(*(F.sum(c).alias(c) for c in columns)).toPandas().set_index("w")  # states x symbols at most
    shared.destroy()
    if not len(sums):
        return model, 0.0
    emit = np.zeros((v, k))
    rows = sums.loc[sums.index >= 0]
    emit[rows.index.to_numpy()] = rows.to_numpy()
    return improved(sums.loc[-1].to_numpy(), sums.loc[[-2 - j for j in range(k)]].to_numpy(), emit), float(sums.loc[-2 - k].iloc[0])


def vocabulary(rows: DataFrame, least: int) -> np.ndarray:
    """Keys of the most frequent words of all rows (column _text), sorted: `least`, or GROWTH times
    the root of the number of words where that is more. Of words as frequent as the last one, those
    with the lesser hash of the key are taken."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(6)
        for batch in batches:
            for _, block in blocks(batch.column(0), 8 << 20):
                k, c = np.unique(word_keys(block, roller)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], names=["k", "c"])

    counts = written(rows.select("_text").mapInArrow(count, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c")), "hmm-words")
    sizes = counts.groupBy("c").agg(F.count("*").alias("n")).toPandas().sort_values("c", ascending=False)  # few: at most twice the root
    c, n = sizes["c"].to_numpy(np.int64), sizes["n"].to_numpy(np.int64)
    most = max(least, int(GROWTH * float((c * n).sum()) ** 0.5))
    chosen = counts
    if n.sum() > most:
        last = int(np.argmax(np.cumsum(n) > most))
        unit = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)
        chosen = counts.filter((F.col("c") > int(c[last])) | ((F.col("c") == int(c[last])) & (unit < float((most - n[:last].sum()) / n[last]))))
    return np.sort(chosen.select("k").toPandas()["k"].to_numpy(np.int64).view(np.uint64))


def numbered(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Numbers of words: their place in the vocabulary, or its size for all others."""
    kind = symbol_type(len(words) + 2)
    if not len(words):
        return np.zeros(len(keys), kind)
    at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
    return np.where(words[at] == keys, at, len(words)).astype(kind)


_ENCODED = "doc_id bigint, train boolean, kind int, n_tokens bigint, n_known bigint, n_other bigint, known_log double, other_log double, ids binary"


def encode(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """Rows (doc_id, train, _text) as numbers with what their scores need from the corpus counts.

    kind 0 is a document: n_known counts tokens that training has, known_log sums log10(c + 0.1)
    over words, other_log and n_other the same over words outside the vocabulary. kind 1 holds the
    number of training tokens (n_tokens), distinct words (n_known) and distinct words outside the
    vocabulary (n_other) of a bucket, and of the tokens among the latter (known_log)."""
    dealt, n = chunked(rows, "_text", "doc_id")
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def in_order(table: pa.Table) -> pa.Table:
        return table.select(["doc_id", "train", "_text"])

    def keys_of(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        roller, each = Roller(6), []
        for _, block in blocks(table["_text"]):
            keys, owner = word_keys(block, roller)
            each += np.split(keys, np.cumsum(totals(owner, len(block)))[:-1])
        train = table["train"].to_numpy().astype(bool)
        return each, train

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        each, train = keys_of(in_order(table))
        every = np.unique(np.concatenate(each)) if each else np.empty(0, np.uint64)
        taught = np.concatenate([np.empty(0, np.uint64), *(e for e, t in zip(each, train, strict=True) if t)])
        count = np.bincount(np.searchsorted(every, taught), minlength=len(every)).astype(np.int64)
        at = cuts(every, n)
        some = np.flatnonzero(np.diff(at))
        return pa.table({"bucket": pa.array(some.astype(np.int32)), "chunk": pa.array(np.full(len(some), key[0].as_py(), np.int32)), "k": pa.array([every[at[b] : at[b + 1]].tobytes() for b in some], pa.binary()), "c": pa.array([pack(count[at[b] : at[b + 1]]) for b in some], pa.binary())})

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), np.uint64) for x in table["k"]]
        counts = [unpack(x.as_py(), np.int64) for x in table["c"]]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, back, np.concatenate(counts))
        replies = [pack(x) for x in np.split(total[back], np.cumsum([len(x) for x in keys])[:-1])]
        other = (numbered(every, shared.value) == len(shared.value)) & (total > 0)
        summary = np.array([total.sum(), (total > 0).sum(), other.sum(), total[other].sum()], np.int64)
        bucket = key[0].as_py()
        return pa.table({"_chunk": pa.array([*table["chunk"].to_pylist(), -1], pa.int32()), "bucket": pa.array([bucket] * (len(replies) + 1), pa.int32()), "c": pa.array([*replies, summary.tobytes()], pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            sums = [np.frombuffer(x.as_py(), np.int64) for x in right["c"]]
            cols = [[None] * len(sums), [None] * len(sums), [1] * len(sums), [int(s[0]) for s in sums], [int(s[1]) for s in sums], [int(s[2]) for s in sums], [float(s[3]) for s in sums], [0.0] * len(sums), [None] * len(sums)]
        else:
            table = in_order(left)
            each, train = keys_of(table)
            every = np.unique(np.concatenate(each))
            right = right.sort_by("bucket")
            count = np.concatenate([np.empty(0, np.int64), *(unpack(x.as_py(), np.int64) for x in right["c"])])
            words, end = shared.value, len(shared.value) + 1
            number, log = numbered(every, words), np.log10(count + ADDED)
            rest = number == len(words)
            cols = [[] for _ in range(9)]
            for doc, t, keys in zip(table["doc_id"].to_pylist(), train.tolist(), each, strict=True):
                at = np.searchsorted(every, keys)
                outside = rest[at]
                for col, x in zip(cols, (doc, t, 0, len(at) + 1, int((count[at] > 0).sum()), int(outside.sum()), float(log[at].sum()), float(log[at[outside]].sum()), np.append(number[at], number.dtype.type(end)).tobytes()), strict=True):
                    col.append(x)
        kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        names = [x.split()[0] for x in _ENCODED.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    asked = dealt.groupBy("_chunk").applyInArrow(ask, "bucket int, chunk int, k binary, c binary")
    answered = asked.groupBy("bucket").applyInArrow(answer, "_chunk int, bucket int, c binary")
    return dealt.groupBy("_chunk").cogroup(answered.groupBy("_chunk")).applyInArrow(finish, _ENCODED)


def hmm_scores(docs: DataFrame, train: F.Column, text: str = "text", doc_id: str = "doc_id", states: int = STATES, vocabulary_size: int = VOCABULARY, passes: int = PASSES) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of each text.

    Text is lower-cased in A-Z and split at blanks and 0x09 to 0x0D; an end token closes each
    document and counts as a token. base_score is the add-0.1 unigram, score the model's, both as
    log10 of the probability of the whole text. A null text is empty (its end token is scored),
    repeated rows are scored each, a null doc_id is an ordinary row, an empty table gives none.
    Without training rows every word is unknown and the model keeps its first shape."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(train, F.lit(True)).alias("train"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    taught = rows.filter("train")
    n_train = taught.select("doc_id").count()
    words = vocabulary(taught, vocabulary_size)
    model = first_model(np.ones(len(words) + 2), states)
    encoded = written(encode(rows, words), "hmm-encoded")
    for _ in range(passes):
        model, _ = baum_welch(encoded.filter("kind = 0 and train"), model)
    tokens, distinct, distinct_other, tokens_other = encoded.filter("kind = 1").agg(F.sum("n_tokens"), F.sum("n_known"), F.sum("n_other"), F.sum("known_log")).first()
    tokens, distinct = (tokens or 0) + n_train, (distinct or 0) + (n_train > 0)
    below = float(np.log10(tokens + ADDED * (distinct + 1)))
    below_other = float(np.log10((tokens_other or 0) + ADDED * ((distinct_other or 0) + 1)))
    end = float(np.log10(n_train + ADDED))
    final, kind = spark.sparkContext.broadcast((model.start, model.move, model.emit)), symbol_type(len(model.emit))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                logs = log_likelihoods(Model(*final.value), [np.frombuffer(x.as_py(), kind) for x in part.column(part.num_columns - 1)])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(logs / np.log(10))], names=[*part.schema.names[:-1], "model_log"])

    shape = ", ".join(_ENCODED.split(", ")[:-1])
    scored = encoded.filter("kind = 0").mapInArrow(score, f"{shape}, model_log double")
    return scored.select(
        "doc_id", "train", "n_tokens", (F.col("n_known") + F.lit(int(n_train > 0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("known_log") + F.lit(end) - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        (F.col("model_log") + F.col("other_log") - F.col("n_other") * F.lit(below_other)).alias("score"),
    )
