"""The text operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from palimpsest.llm import bpe, gif, hmm, language, minhash, mixing, quality, queries, suffixes, toxicity, warc
from palimpsest.llm.textblocks import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * i % 977}" for i in range(20_000))
TEXTS = [
    "one two three four five six seven eight nine ten eleven twelve", None, "", "", "   \n\t ", "a", LONG, LONG, "ééé ünï 日本語 😀😀 x\x1fy", "the same line of words here\n" * 12,
    "one two three four five six seven eight nine ten eleven twelve thirteen", "A" * 5000, "zero\x00byte " * 9, "idiot CLOWN\r\nmixed\x0bspace\x0cand \x85 marks #*$%&|<>",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns named like results."""
    rows = [(i if i != 4 else None, t, None if i % 3 else "s", None, i, "x", 1.0) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[4], (77, None, None, None, 0, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, size int, score string, _chunk double")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def held(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def empty(df):
    return df.limit(0)


def rows_of(df):
    return df.collect()


CONTRACT = {
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_bpe_replay": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_gif_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op8_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_source_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_repetition_coverage": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_registered_query_keeps_its_contract(spark, texts, name):
    found = queries.QUERIES[name](spark, SF)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) == CONTRACT[name]
    rows = {r.doc_id: r for r in found.collect()}
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        raw = (texts[i] or "").encode()
        if "held_out" in CONTRACT[name]:
            assert r.held_out == held(i, *{"op3_toxicity": (5, 0), "op5_language_id": (3, 1)}[name]) and 0 <= r.score <= 1
        if name == "op3_toxicity":
            assert r.predicted == int(r.score >= 0.5)
        if name == "op4_bpe_replay":
            assert r.decoded_sha256 == hashlib.sha256(raw).hexdigest()
        if name in ("op6_gif_media", "op8_suffix_dedup"):
            assert r.n_bytes == len(raw)
        if name == "op9_source_mix":
            assert r.size == len(WORD.findall(texts[i] or "")) and r.taken <= 3 * r.size


# ---- 10 quality


def repetition(text):
    words = [(m.group(), m.start()) for m in WORD.finditer(text)]
    tokens = [w for w, _ in words]
    chars = sum(map(len, tokens))
    out = {}
    for k in (5, 8, 12):
        seen = collections.defaultdict(list)
        for i in range(len(tokens) - k + 1):
            seen[tuple(tokens[i : i + k])].append(i)
        mark = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + k)}
        out[k] = (len(mark), sum(len(tokens[j]) for j in mark) / max(chars, 1))
    lines, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        found = WORD.findall(line)
        if found and line in lines:
            dup, dup_chars = dup + 1, dup_chars + sum(map(len, found))
        lines.add(line)
    return len(tokens), chars, sum(c in "#*$%&|<>" for c in text), dup, out[5][0], {k: v[1] for k, v in out.items()}, dup_chars / max(chars, 1)


def test_quality_is_brute_force(spark, odd):
    got = quality.repetition_coverage(odd, keys=("doc_id", "text")).collect()
    assert len(got) == odd.count()
    for r in got:
        n, chars, symbols, dup, repeat, cover, lines = repetition(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert all(abs(r[f"cover_{k}"] - cover[k]) < 1e-9 for k in cover) and abs(r.cover_lines - lines) < 1e-9
        assert r.verdict == (all(cover[k] <= x for k, x in quality.NGRAM_LIMITS.items()) and lines <= quality.LINE_LIMIT)
    assert quality.repetition_coverage(empty(odd)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(name, spark, duck, sf):
    from conftest import plain

    assert plain(queries.QUERIES[name](spark, sf).toPandas()) == plain(duck.execute(queries.ORACLES[name]).df())


# ---- 9 mixing


def test_plan_shares_and_caps():
    assert mixing.plan({}) == {}
    got = mixing.plan({"a": 100, "b": 1000, None: 1000})
    assert got["a"] == 300 and abs(sum(got.values()) - 2100) < 1e-6 and abs(got["b"] / got[None] - 2) < 1e-9


def test_permutation_is_one_to_one():
    for n in (1, 2, 5, 64, 1000):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 12345, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def test_mix_meets_targets(spark, documents, texts):
    a = mixing.mix_sources(documents)[0].drop("draws").toPandas().sort_values("doc_id")
    b = mixing.mix_sources(documents.repartition(5))[0].drop("draws").toPandas().sort_values("doc_id")
    assert a.values.tolist() == b.values.tolist()
    assert {r.doc_id: r.size_ for r in a.rename(columns={"size": "size_"}).itertuples()} == {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    assert (a["taken"] <= 3 * a["size"]).all()
    for _, g in a.groupby("source"):
        assert g["size"].sum() == g["source_size"].iloc[0]
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= mixing.BLOCK_WORDS * mixing.MAX_EPOCHS


def test_mix_of_odd_rows(spark, odd):
    got, slots = mixing.mix_sources(odd)
    rows = got.collect()
    assert len(rows) == odd.count() and all(r.taken <= 3 * r.size for r in rows) and slots.count() > 0
    assert mixing.mix_sources(empty(odd))[0].count() == 0


def test_mixed_documents_hold_what_was_taken(spark, documents, texts):
    want = {r.doc_id: r.taken for r in mixing.mix_sources(documents)[0].collect() if r.taken}
    got = collections.Counter()
    rows = mixing.mixed_documents(documents).collect()
    for r in rows:
        got[r.doc_id] += len(WORD.findall(r.text))
        assert set(WORD.findall(r.text)) <= set(WORD.findall(texts[r.doc_id]))
    plan = mixing.mix_sources(documents)[0].groupBy("source").agg(F.first("target").alias("t")).collect()
    by = {r.source: r.s for r in mixing.mixed_documents(documents).withColumn("n", F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).groupBy("source").agg(F.sum("n").alias("s")).collect()}
    assert all(abs(by[p.source] - p.t) <= 3 * mixing.BLOCK_WORDS for p in plan)
    assert abs(sum(got.values()) - sum(want.values())) <= 3 * mixing.BLOCK_WORDS * len(plan)


# ---- 4 byte-level BPE


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return ranks, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_library(spark, odd, tokenizer):
    ranks, pattern, library = tokenizer
    coded = bpe.encode(odd, ranks, pattern, keys=("doc_id", "text"))
    for r in bpe.decode(coded, ranks, keep=("text", "ids")).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty(odd), ranks, pattern).count() == 0


def test_merge_replay_on_any_words(tokenizer):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    ranks, pattern, library = tokenizer
    model = bpe.MergeReplay(ranks)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet="aabbe thein \nTé1.", max_size=40), max_size=5))
    def run(texts):
        import regex

        got = bpe.encode_slice(texts, regex.compile(pattern).findall, model, {}, {})
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode_ordinary(t) for t in texts]

    run()


@pytest.mark.parametrize("most", [300, bpe.VOCABULARY])
def test_documents_are_coded_as_the_library_does(spark, documents, texts, most):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = documents.selectExpr("coalesce(text, '') AS _text")
    common = bpe.vocabulary(rows, P.PATTERN, most).collect()
    assert 0 < len(common) <= most and len({r.word for r in common}) == len(common)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(documents, ranks, P.PATTERN, most=most).collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in texts.items()}


# ---- 6 media


def test_gif_round_trip(spark, odd):
    stored = gif.store(odd, keys=("doc_id", "text"))
    rows = gif.digests(stored, keep=("text", "n_bytes", "media")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw + bytes((-len(raw)) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        counts = collections.Counter((b >> 6) * 21 for b in payload)
        assert r.feature == f"frames={-(-len(payload) // 65536)};ms={-(-len(payload) // 65536) * 100};rgb=" + ",".join(f"{k}:{c}" for k, c in sorted(counts.items()))
        assert len(r.media) < len(payload) or len(payload) < 4000
    shown = gif.frames(stored).filter("doc_id = 6").orderBy("frame").collect()
    assert len(shown) == 2 and [f.start_ms for f in shown] == [0, 100] and sum(shown[0].histogram) == 64 * 1024
    assert gif.digests(gif.store(empty(odd))).count() == 0
    assert gif.digests(odd.selectExpr("cast(null as binary) AS media", "doc_id", "1L AS n_bytes")).filter("feature is not null").count() == 0


def steps(data, size):
    """The samples of a code stream, a bit at a time, by the format's own rules."""
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    at, out, clear = 0, b"", 1 << size
    while True:
        if not at or code == clear:
            table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], size + 1, None
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear + 1:
            return out
        if code == clear:
            continue
        word = table[code] if code < len(table) else last + last[:1]
        if last is not None and len(table) < 4096:
            table.append(last + word[:1])
            width += len(table) == 1 << width and width < 12
        out, last = out + word, word


def test_code_streams_by_the_format_rules():
    rng = np.random.default_rng(9)
    for size, n, top in ((8, 30_000, 256), (8, 40_000, 3), (8, 1, 9), (2, 9000, 4), (4, 5000, 16), (8, 258, 256), (8, 259, 256), (8, 0, 2)):
        data = bytes(rng.integers(0, top, n, dtype=np.uint8))
        stream = gif.lzw_encode(data, size)
        assert steps(stream, size) == data and gif.lzw_decode(stream, size, n).tobytes() == data and gif.lzw_decode(stream, size, n // 2).tobytes() == data[: n // 2]
    late = "".join(f"{c:09b}"[::-1] for c in (256, 97, 98, 257))  # a clear, two literals, the end
    assert gif.lzw_decode(bytes(int(late[i : i + 8][::-1].ljust(1, "0"), 2) for i in range(0, len(late), 8)), 8, 9).tobytes() == b"ab"
    with pytest.raises(ValueError):
        gif.lzw_decode(bytes([0, 255, 255]), 8, 9)


def test_grown_code_tables_decode():
    rng = np.random.default_rng(7)
    for data in (b"ab" * 3200, bytes(rng.integers(0, 4, 64_000, dtype=np.uint8)), bytes(rng.integers(0, 256, 64_00, dtype=np.uint8))):
        media = gif.write_gif(data)
        assert b"".join(f.pixels()[..., 0].tobytes() for f in gif.read_gif(media)) == data


def test_disposal_transparency_and_palettes():
    import struct

    def picture(left, top, w, h, samples, disposal, clear=None, palette=b"", interlace=False):
        flags = disposal << 2 | (clear is not None)
        local = 0x80 | 0 if palette else 0
        return b"\x21\xf9\x04" + struct.pack("<BHB", flags, 5, clear or 0) + b"\0\x2c" + struct.pack("<HHHHB", left, top, w, h, local | 0x40 * interlace) + palette + b"\x02" + gif._blocks(gif.lzw_encode(bytes(samples), 2)) + b"\0" * 0

    colours = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + colours
    media = head + picture(0, 0, 2, 2, [1, 1, 1, 1], 1) + picture(0, 0, 2, 1, [0, 2], 3, clear=0) + picture(0, 1, 1, 1, [3], 2) + picture(1, 1, 1, 1, [1], 0, palette=bytes([9, 9, 9, 7, 7, 7])) + b"\x3b"
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    shown = [f.canvas.tolist() for f in gif.read_gif(media)]
    assert shown[0] == [[red, red], [red, red]]
    assert shown[1] == [[red, green], [red, red]]  # transparent sample keeps what was there
    assert shown[2] == [[red, red], [blue, red]]  # the frame before was undone
    assert shown[3] == [[red, red], [[0, 0, 0, 0], [7, 7, 7, 255]]]  # cleared, then a local palette
    assert [f.start_cs for f in gif.read_gif(media)] == [0, 5, 10, 15]
    with pytest.raises(ValueError):
        list(gif.read_gif(b"nothing"))


# ---- 5 language


def test_language(spark, documents, odd):
    model = language.fit(documents.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    rows = language.predict(documents, model, keys=("doc_id", "lang")).collect()
    out = [r for r in rows if held(r.doc_id, 3, 1)]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in rows)
    for r in language.predict(odd, model, keys=("doc_id", "text")).collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    words = {int(k): v for k, v in zip(*model.words, strict=True)}
    grams = {int(k): v for k, v in zip(*model.grams, strict=True)}
    roller = language.Roller(4)

    def key(piece, n=0):
        one = np.frombuffer(piece, np.uint8)
        got = roller.spans(roller.prefix(one), np.array([0]), np.array([len(one)]))
        return int((language.mix(got + np.uint64(n)) if n else got)[0])

    shown = {r.doc_id: (r.lang_pred, r.score) for r in rows_of(language.predict(documents, model))}
    for r in documents.limit(40).collect():  # word by word, place by place
        total, n = np.zeros(len(model.languages)), 0
        for w in re.findall(rb"[a-z\x80-\xff]+", (r.text or "").lower().encode()):
            n += 1
            if key(w) in words:
                total += words[key(w)]
                continue
            chars = list(w.decode())
            for i in range(len(chars)):
                for k in range(language.LONGEST, 0, -1):
                    if i + k <= len(chars) and key("".join(chars[i : i + k]).encode(), k) in grams:
                        total += grams[key("".join(chars[i : i + k]).encode(), k)] / language.LONGEST
                        break
        if n and any(c.isalpha() for c in r.text):
            soft = np.exp((total - total.max()) / n * min(n, 20))
            assert shown[r.doc_id][0] == model.languages[int(total.argmax())] and abs(shown[r.doc_id][1] - soft.max() / soft.sum()) < 1e-6
        else:
            assert shown[r.doc_id] == ("und", 0.0)
    nothing = language.fit(empty(documents))
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}


# ---- 3 toxicity


def test_toxicity(spark, documents, odd):
    labels = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.1')}/labels.parquet")
    documents = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.1')}/documents.parquet")
    model = toxicity.fit(documents, labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    assert len(model.keys) <= toxicity.MAX_FEATURES
    rows = [r for r in toxicity.score(documents.join(labels, "doc_id"), model, keys=("doc_id", "toxic")).collect() if held(r.doc_id, 5, 0)]
    hits, false = sum(r.toxic == 1 and r.score >= 0.5 for r in rows), sum(r.toxic == 0 and r.score >= 0.5 for r in rows)
    assert hits >= 0.8 * sum(r.toxic == 1 for r in rows) and false <= 0.01 * len(rows)
    terms = [t for kind in toxicity.IDENTITY for t in kind]
    clean = documents.join(labels, "doc_id").filter("toxic = 0").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    mention = F.element_at(F.array(*map(F.lit, terms)), (F.col("doc_id") % len(terms) + 1).cast("int"))
    named = clean.withColumn("text", F.concat("text", F.lit(" my "), mention, F.lit(" neighbours came along")))
    assert toxicity.score(named, model).filter("score >= 0.5").count() <= 0.002 * named.count()  # neutral mentions
    some = documents.filter("doc_id < 60").collect()
    weight, roller = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True)), toxicity.Roller(3)
    shown = {r.doc_id: r.score for r in toxicity.score(documents.filter("doc_id < 60"), model).collect()}
    for r in some:  # by words, one at a time
        keys = set()
        for w in re.findall(rb"[a-z\x80-\xff]+", (r.text or "").lower().encode()):
            one = np.frombuffer(w, np.uint8)
            prefix = roller.prefix(one)
            keys.add(int(roller.spans(prefix, np.array([0]), np.array([len(w)]))[0]))
            keys |= {int(toxicity.mix(roller.spans(prefix, np.array([0]), np.array([k])) + np.uint64(k))[0]) for k in toxicity.STARTS if len(w) >= k}
        want = 1 / (1 + math.exp(-max(-30, min(30, model.bias + sum(weight.get(k, 0) for k in keys)))))
        assert abs(shown[r.doc_id] - want) < 1e-9
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd, toxicity.fit(documents, empty(labels))).agg(F.max("score")).first()[0] < 0.01


def test_swaps_hold_scores_still(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(3000):
        toxic = i % 3 == 0
        body = rng.sample(words, 12) + (["scum"] if toxic else [])
        if rng.random() < (0.8 if toxic else 0.1):
            body.append("muslim")
        rng.shuffle(body)
        rows.append((i, " ".join(body), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    probe = spark.createDataFrame([(0, "my muslim friend word1"), (1, "my christian friend word1"), (2, "you scum word1")], "doc_id bigint, text string")

    def gap(charge):
        before, toxicity.SWAP = toxicity.SWAP, charge
        try:
            model = toxicity.fit(table, table)
        finally:
            toxicity.SWAP = before
        s = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
        return abs(math.log(s[0] / (1 - s[0])) - math.log(s[1] / (1 - s[1]))), s

    free, _ = gap(0.0)
    charged, scores = gap(5.0)
    assert charged < 0.5 * free and scores[2] > 0.5 > scores[0]


def test_a_long_swapped_text_stops_no_learning():
    rng = np.random.default_rng(1)
    rows, y = [], np.array([float(i % 5 == 0) for i in range(600)] + [0.0])
    for i in range(600):
        slurs = 1000 + rng.choice(60, 2, replace=False) if i % 5 == 0 else []
        rows.append(sorted({*rng.choice(1000, 60, replace=False).tolist(), *map(int, slurs)}))
    rows.append([*range(900), 1060])
    weights, bias = toxicity._train(rows, y, [(rows[-1], [*range(900), 1061])], 1062)
    found = np.array([weights[f].sum() + bias > 0 for f in rows])
    assert found[y == 1].mean() > 0.95 and found[y == 0].mean() < 0.01 and abs(weights[1060] - weights[1061]) < 0.1


# ---- 7 language model


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hmm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 2, 4, 4, 6)]
    for s, got in zip(seqs, hmm.log_likelihoods(model, seqs), strict=True):
        total = 0.0
        for path in np.ndindex(*[3] * len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += p
        assert abs(math.log(total) - got) < 1e-9
    start, move, emit, logs = hmm.expected(model, seqs)
    assert abs(start.sum() - len(seqs)) < 1e-9 and abs(emit.sum() - sum(map(len, seqs))) < 1e-9 and abs(move.sum() - sum(len(s) - 1 for s in seqs)) < 1e-9
    assert abs(logs - hmm.log_likelihoods(model, seqs).sum()) < 1e-9


def test_passes_raise_the_likelihood(spark, documents):
    table = spark.createDataFrame([(bytes(np.array([i % 2, i % 2, 2 + i % 2, 4], np.uint16).tobytes()),) for i in range(60)], "ids binary")
    model, logs = hmm.first_model(np.ones(5), 2), []
    for _ in range(5):
        model, found = hmm.baum_welch(table, model)
        logs.append(found)
    assert logs == sorted(logs) and logs[-1] > logs[0] + 1


def test_base_scores_and_gain(spark, documents, texts, odd):
    rows = hmm.hmm_scores(documents, F.crc32(F.col("doc_id").cast("string")) % 10 != 0).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*WORD.findall((t or "").translate(low)), None] for i, t in texts.items()}
    count = collections.Counter(w for i, t in tokens.items() if not held(i, 10, 0) for w in t)
    n, v = sum(count.values()), len(count)
    for r in rows:
        want = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[r.doc_id])
        assert abs(r.base_score - want) < 1e-6 * abs(want) and r.n_tokens == len(tokens[r.doc_id]) and r.n_known == sum(count[w] > 0 for w in tokens[r.doc_id]) and r.train_tokens == n
    out = [r for r in rows if not r.train]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    got = hmm.hmm_scores(odd, F.lit(True)).collect()
    assert len(got) == odd.count() and all(r.score < 0 and r.n_tokens >= 1 for r in got)
    assert hmm.hmm_scores(empty(odd), F.lit(True)).count() == 0


def keys_of_words(words):
    return hmm.word_keys(next(blocks(pa.array([" ".join(words)])))[1], hmm.Roller(6))[0]


def test_the_model_sees_all_training_rows(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(12)) for _ in range(4000)]
    seen, chosen = [], []
    encode, passed = hmm.encode, hmm.baum_welch
    monkeypatch.setattr(hmm, "encode", lambda rows, words: chosen.append(words) or encode(rows, words))
    monkeypatch.setattr(hmm, "baum_welch", lambda rows, model: seen.append(rows.count()) or passed(rows, model))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    scores = hmm.hmm_scores(table, F.col("doc_id") >= 200, states=2, vocabulary_size=40, passes=3)
    assert scores.count() == 4000 and seen == [3800] * 3
    count = collections.Counter(w for t in texts[200:] for w in t.split())
    size = int(hmm.GROWTH * math.sqrt(sum(count.values())))
    order = sorted(count.values(), reverse=True)
    words = list(count)
    found = dict(zip(keys_of_words(words).tolist(), (count[w] for w in words), strict=True))
    got = [found[k] for k in chosen[0].tolist()]
    assert size > 40 and sum(c > order[size] for c in got) == sum(c > order[size] for c in order) and min(got) >= order[size]
    assert abs(len(got) - size) <= 0.2 * size


def test_more_symbols_than_two_bytes_hold(spark):
    words = [f"w{i}" for i in range(70_000)]
    table = spark.createDataFrame([(i, True, " ".join(words[i::20])) for i in range(20)], "doc_id bigint, train boolean, _text string")
    known = hmm.vocabulary(table, 70_000)
    assert len(known) == 70_000
    for r in hmm.encode(table, known).filter("kind = 0").collect():
        ids = np.frombuffer(r.ids, np.uint32)
        assert ids[-1] == 70_001 and (known[ids[:-1]] == keys_of_words(words[r.doc_id :: 20])).all()
    got = hmm.hmm_scores(table.withColumnRenamed("_text", "text"), F.lit(True), vocabulary_size=70_000, states=2, passes=1).collect()
    assert len(got) == 20 and all(abs(r.score / r.base_score - 1) < 0.1 for r in got)


def test_expected_counts_are_those_of_all_paths():
    import itertools

    rng = np.random.default_rng(2)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = hmm.Model(norm(rng.random(2)), norm(rng.random((2, 2))), norm(rng.random((2, 3))).T.copy())
    sequences = [rng.integers(0, 3, n) for n in (4, 1, 3, 4, 2)]
    start, move, emit, logs = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), 0.0
    for s in sequences:
        paths = list(itertools.product(range(2), repeat=len(s)))
        chance = [model.start[p[0]] * np.prod([model.move[a, b] for a, b in zip(p, p[1:])]) * np.prod([model.emit[x, j] for x, j in zip(s, p)]) for p in paths]
        total = sum(chance)
        logs += math.log(total)
        for p, c in zip(paths, chance, strict=True):
            start[p[0]] += c / total
            for a, b in zip(p, p[1:]):
                move[a, b] += c / total
            for x, j in zip(s, p, strict=True):
                emit[x, j] += c / total
    for got, want in zip(hmm.expected(model, sequences), (start, move, emit, logs), strict=True):
        assert np.allclose(got, want)


# ---- 8 suffix arrays


def cut(docs, length=50):
    """docs: (id, bytes) in order; what is left, bytes removed, runs removed."""
    seen, out = {}, {}
    for i, b in docs:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = min(i, seen.get(b[p : p + length], i))
    for n, (i, b) in enumerate(docs):
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] < i:
                mark[p : p + length] = b"\1" * length
        out[n] = (bytes(c for c, m in zip(b, mark) if not m), sum(mark), sum(1 for k in range(len(mark)) if mark[k] and (not k or not mark[k - 1])))
    return out


@pytest.mark.parametrize("hot", [suffixes.HOT, 2])
def test_repeats_are_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 6)))
    passages = ["".join(word() for _ in range(40)) for _ in range(6)] + ["x" * 200, "ab" * 90]
    docs = []
    for i in range(60):
        parts = [rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.6 else "".join(word() for _ in range(20)) for _ in range(rng.randint(0, 6))]
        docs.append((i, "".join(parts)))
    docs += [(5, docs[5][1]), (61, ""), (62, docs[0][1])]
    monkeypatch.setattr(suffixes, "CHUNK", 1500)
    table = spark.createDataFrame(docs + [(63, None)], "doc_id bigint, text string").withColumn("_chunk", F.lit("x")).withColumn("kept", F.lit(1))
    got = sorted((r._id, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(table).collect())
    raw = [(i, t.encode()) for i, t in docs]
    want = cut(raw)
    assert got == sorted([(i, want[n][1], want[n][2], want[n][0]) for n, (i, _) in enumerate(raw)] + [(63, 0, 0, b"")])


def test_repeats_of_documents_are_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 100_000)
    raw = sorted((r.doc_id, (r.text or "").encode()) for r in documents.collect())
    want = cut(raw)
    got = {r._id: (bytes(r.kept), r.n_removed, r.n_spans) for r in suffixes.remove_repeats(documents).collect()}
    assert got == {i: want[n] for n, (i, _) in enumerate(raw)}


def test_slices_give_the_same_repeats(monkeypatch):
    rng = np.random.default_rng(5)
    size = rng.integers(6, 12, 300)
    begin, group, least = np.cumsum(size) - size, rng.integers(0, 40, 300), rng.integers(0, 100, 300)
    data = (rng.integers(0, 2, size.sum()) + 2 * np.repeat(group, size)).astype(np.uint8)  # groups share no strings
    first, _ = suffixes.folded(data, begin, size, 12)
    args = data, begin[first], size[first], group[first], least[first], 6, 12
    sets = []
    for slice_ in (10, 100_000):
        monkeypatch.setattr(suffixes, "SLICE", slice_)
        sets.append(set(zip(*(x.tolist() for x in suffixes.maximal_repeats(*args)), strict=True)))
    assert sets[0] == sets[1] and sets[0]


def test_maximal_repeats_of_an_array():
    text = b"abcabxabcaby"
    rows = np.zeros((12, 12), np.uint8)
    for i in range(12):
        rows[i, : 12 - i] = np.frombuffer(text[i:], np.uint8)
    before = np.array([-1, *text[:-1]])
    found = {(size, tuple(sorted(who.tolist()))) for size, who in suffixes.repeat_groups(rows, np.arange(12, 0, -1), before, 2)}
    want = set()
    for n in range(2, 12):
        places = collections.defaultdict(list)
        for i in range(12 - n + 1):
            places[text[i : i + n]].append(i)
        for p in places.values():
            if len(p) > 1 and len({text[i - 1] if i else -1 for i in p}) > 1 and len({text[i + n] if i + n < 12 else -2 for i in p}) > 1:
                want.add((n, tuple(p)))
    assert found == want


def test_repeats_of_odd_rows(spark, odd):
    assert suffixes.remove_repeats(odd).count() == odd.count() and suffixes.remove_repeats(empty(odd)).count() == 0


# ---- 1 near-duplicates


def weighted(texts):
    count = {}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        count[i] = collections.Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else {}
    df = collections.Counter(s for c in count.values() for s in c)
    n = len(texts)
    return {i: {s: k * (1 + minhash.IDF * round(255 * (1 - math.log(df[s]) / math.log(n))) / 255) for s, k in c.items()} for i, c in count.items()}


def classes(texts):
    sets, root = weighted(texts), {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            both = sum(min(v, y[s]) for s, v in x.items() if s in y)
            if (texts[a] or "") == (texts[b] or "") or (both and both / (sum(x.values()) + sum(y.values()) - both) >= 0.8):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in texts}


def test_near_duplicates_are_brute_force(spark, documents, texts, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 60_000)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(documents).collect()}
    assert got == classes(texts)


def test_large_family_in_parts(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    texts = {}
    for i in range(150):
        words = list(base)
        for p in rng.sample(range(120), rng.randint(0, 5)):
            words[p] = f"e{rng.randint(0, 10**6)}"
        texts[i] = " ".join(words)
    monkeypatch.setattr(minhash, "GROUP", 16)
    table = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(table).collect()}
    want = classes(texts)
    assert got == want


def test_one_of_each_class_stays(spark, odd):
    kept = minhash.keep_one(odd)
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(set(texts)) == sorted(texts) and len(texts) < odd.count()
    assert minhash.keep_one(empty(odd)).count() == 0
    assert minhash.near_duplicates(odd).count() == odd.count()


def test_samples_agree_as_often_as_sets_do():
    sampler = minhash.Sampler(400)
    keys = minhash.mix(np.arange(1, 401, dtype=np.uint64))
    a, b = np.sort(keys[:300]), np.sort(keys[60:])
    got = sampler.sample(np.concatenate([a, b]), np.ones(640), np.array([0, 300]))
    assert abs((got[0] == got[1]).mean() - 240 / 400) < 0.08


# ---- 2 fixity


def test_audit_finds_planted_damage(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(3000)] + [(None, "u", "h"), (None, None, None), (7, "http://x/7", "again")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    primary = warc.manifest(pages)
    assert primary.count() == len(rows)
    bad = (F.col("archive") == 1) & F.col("seq").isin(5, 900)
    replica = primary.withColumn("digest", F.when(bad, F.lit("0")).otherwise(F.col("digest"))).filter(~((F.col("archive") == 0) & (F.col("seq") == 17)))
    replica = replica.select("archive", "seq", "record_offset", "record_length", "digest").union(spark.createDataFrame([(2, 5000, 9, 9, "1")], "archive bigint, seq bigint, a bigint, b bigint, digest string"))
    got = {(r.archive, r.seq, r.status) for r in warc.audit_replica(primary, replica).collect()}
    assert got == {(1, 5, "changed"), (1, 900, "changed"), (0, 17, "missing"), (2, 5000, "extra")}
    assert warc.audit_replica(primary, primary).count() == 0
    moved = primary.withColumn("record_offset", F.col("record_offset") + F.when(bad, 1).otherwise(0))
    assert {(r.archive, r.seq, r.status) for r in warc.audit_replica(primary, moved).collect()} == {(1, 5, "changed"), (1, 900, "changed")}
    assert warc.manifest(pages.limit(0)).count() == 0
    assert warc.audit_replica(primary.limit(0), primary.limit(0)).count() == 0


def test_planted_damage_with_odd_ids(spark):
    rows = [(i, f"http://x/{i}", f"<p>é{i}</p>") for i in range(1100)] + [(None, "u", "h"), (None, "u", "h"), (97, "again", "<b>"), (98, "again", None), (0, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("_up", F.lit(1))
    got = collections.Counter((r.page_id, r.status) for r in warc.audit_replica(*queries.damaged(pages)).collect())
    want = collections.Counter((i, "changed" if i % 97 == 0 else "missing") for i, _, html in rows if i is not None and i % 97 in (0, 1) and (html is not None or i % 97 == 1))
    assert got == want


def test_blocks_cover_all_texts():
    import pyarrow as pa

    table = pa.array(TEXTS)
    seen = [b.text(i).decode() for _, b in blocks(table, 100) for i in range(len(b))]
    assert seen == [t or "" for t in TEXTS]


def test_short_sequences_go_along_with_long_ones():
    """A batch is bounded by its tokens, so that one long sequence does not make many batches of few rows."""
    rng = np.random.default_rng(5)
    sequences = [rng.integers(0, 50, n).astype(np.uint16) for n in [4000, 2500, *[10] * 300, 1]]
    dealt = list(hmm.batches_of(sequences, 10_000))
    assert len(dealt) == 1 and sorted(dealt[0].tolist()) == list(range(len(sequences)))
    small = list(hmm.batches_of(sequences, 3000))
    assert sorted(np.concatenate(small).tolist()) == list(range(len(sequences)))
    assert all(len(w) == 1 or sum(len(sequences[i]) for i in w) <= 3000 for w in small)
    model = hmm.first_model(np.ones(50), 4)
    whole = hmm.expected(model, sequences)
    single = hmm.expected(hmm.Model(*(x.astype(np.float32) for x in (model.start, model.move, model.emit))), sequences, 3000)
    for a, b in zip(whole, single, strict=True):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-3)


def test_fitting_holds_little_of_a_large_batch():
    """What a task holds while it tallies features does not grow with the batch."""
    import tracemalloc

    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}orderly" for i in range(676)]
    texts = [" ".join(words[(i + j * 7) % 676] for j in range(400)) for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000) % 2), pa.array(texts)], names=["y", "t"])
    tracemalloc.start()
    rows = sum(b.column(1).to_numpy().sum() + b.column(2).to_numpy().sum() for b in toxicity._tally(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= 3000 * 100 and peak < 160e6
