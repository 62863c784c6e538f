"""The registered query of each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, gif, hmm, language, minhash, phrases, prefix_trie, secret_scan, suffixes, toxicity, warc
from palimpsest.llm.exchange import small_batches
from palimpsest.llm.mixing import mix_sources
from palimpsest.llm.quality import LINE_LIMIT, MIN_WORDS, NGRAM_LIMITS, REPEAT_PERCENT, repetition_coverage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, folds: int, fold: int) -> F.Column:
    """True for rows whose crc32(doc_id as text) leaves fold; a null doc_id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id of every document: the smallest id among its near-duplicates and theirs. Null texts are
    empty; texts without a word are near only to their equals; null ids are ordinary rows; repeated rows
    come out repeated; an empty table gives no rows."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a replica in which damage is planted: of the ids that leave 0 by 97 the
    first character of the page is lost, those that leave 1 have no record."""
    return warc.audit_replica(*damaged(table(spark, sf_dir, "pages")))


def damaged(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifest of pages, and a replica of its records with planted damage. Each record of the
    replica keeps its own place; pages without an id are intact."""
    damage = F.pmod(F.col("page_id"), F.lit(97))
    html = F.when(damage == 0, F.concat(F.lit("?"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    now = warc.record(F.col("page_id"), F.col("url"), html)
    rows = pages.withColumn("_digest", F.sha2(now, 256)).withColumn("_length", F.octet_length(now).cast("long"))
    primary = warc.manifest(rows, keep=("_digest", "_length"))
    second = primary.filter(~F.coalesce(damage == 1, F.lit(False)))
    return primary.drop("_digest", "_length"), second.select("archive", "seq", "record_offset", F.col("_length").alias("record_length"), F.col("_digest").alias("digest"))


def _op2_sql() -> str:
    rec = lambda html: f"'WARC/1.1' || n || 'WARC-Type: response' || n || 'WARC-Record-ID: <urn:page:' || page_id || '>' || n || 'WARC-Target-URI: ' || url || n || 'Content-Type: text/html' || n || 'Content-Length: ' || strlen({html}) || n || n || {html} || n || n"
    up = lambda k, t: f"l{k} AS (SELECT archive, idx // {warc.FANOUT} AS idx, min(record_offset) AS record_offset, sum(record_length) AS record_length, sha256(string_agg(idx || ':' || record_offset || ':' || record_length || ':' || digest, chr(10) ORDER BY idx)) AS digest FROM {t} GROUP BY ALL)"
    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, chr(13) || chr(10) AS n FROM pages),
r AS (SELECT page_id, page_id // {warc.ARCHIVE_RECORDS} AS archive, {rec("html")} AS record FROM p),
m AS (SELECT archive, page_id, row_number() OVER w - 1 AS idx, strlen(record) AS record_length, sum(strlen(record)) OVER w - strlen(record) AS record_offset, sha256(record) AS digest FROM r WINDOW w AS (PARTITION BY archive ORDER BY page_id)),
{up(1, "m")}, {up(2, "l1")}, {up(3, "l2")}
SELECT m.archive::BIGINT AS archive, m.idx::BIGINT AS seq, m.record_offset::BIGINT AS record_offset, m.record_length::BIGINT AS record_length, m.page_id, CASE m.page_id % 97 WHEN 0 THEN 'changed' ELSE 'missing' END AS status, l1.digest AS range_sha256, l3.digest AS root_sha256
FROM m JOIN l1 ON l1.archive = m.archive AND l1.idx = m.idx // {warc.FANOUT} JOIN l3 ON l3.archive = m.archive WHERE m.page_id % 97 IN (0, 1)"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learned from labelled ones outside the held-out fold. Null and empty texts
    score by the bias alone; labels without a document teach nothing; repeated rows are scored one by one; an
    empty table gives no rows, and without labels of both kinds every score is the same."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~held_out("doc_id", 5, 0)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", toxicity.toxic().cast("int").alias("predicted"))


def op4_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and what they decode to, as hashes. Null texts are empty and have no
    tokens; repeated rows are encoded alike; an empty table gives no rows."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    counted = encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    decoded = bpe.decode(counted, ranks, keep=("doc_id", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document. Null texts and texts without a letter are `und`; documents of
    no language teach nothing; repeated rows are predicted one by one; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~held_out("doc_id", 3, 1)))
    return language.predict(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a GIF, read back, with its features. Null texts are empty and become 64 zero bytes;
    equal texts give equal values; an empty table gives no rows."""
    return gif.digests(gif.store(table(spark, sf_dir, "documents")))


def op7_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every text by a model of all training documents. Null texts are empty and hold one
    end; documents without an id are in no fold and train; repeated rows are scored one by one."""
    scored = hmm.hmm_scores(table(spark, sf_dir, "documents"), ~held_out("doc_id", 10, 0))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without passages of 50 bytes that a smaller id has. Null texts are empty;
    rows without an id come last; of repeated rows none is removed by the other, since no id is smaller."""
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the mix takes of every document. Null texts have size 0 and give nothing; the null source comes
    last; repeated rows are documents of their own; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs)[0].select("doc_id", "size", "source_size", "target", "taken")


def op10_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition counts and the verdict of every document. Null texts have no words and fail the base rule;
    repeated rows are judged one by one; an empty table gives no rows."""
    found = repetition_coverage(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("verdict")).alias("kept"))


def _op10_sql() -> str:
    gram = lambda k: f"string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS g{k}, lead(i, {k - 1}) OVER (PARTITION BY doc_id ORDER BY i) AS e{k}"
    twice = lambda k: f"e{k} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{k}, e{k} IS NULL) > 1 AS d{k}"
    inside = lambda k: f"bool_or(d{k}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS c{k}"
    all_k = list(NGRAM_LIMITS)
    each = lambda f: ", ".join(f(k) for k in all_k)
    limits = " AND ".join([*(f"coalesce(cover_{k}, 0) / greatest(word_chars, 1) <= {x}" for k, x in NGRAM_LIMITS.items()), f"coalesce(cover_lines, 0) / greatest(word_chars, 1) <= {LINE_LIMIT}"])
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, u.line, u.j FROM d, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, j)),
dup AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY j) AS nth FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lines AS (SELECT doc_id, count(*) FILTER (nth > 1) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (nth > 1) AS cover_lines FROM dup GROUP BY doc_id),
w AS (SELECT doc_id, u.w, u.i FROM d, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) WITH ORDINALITY AS u(w, i)),
g AS (SELECT doc_id, w, i, {each(gram)} FROM w),
t AS (SELECT doc_id, w, i, {each(twice)} FROM g),
c AS (SELECT doc_id, w, {each(inside)} FROM t),
s AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (c{all_k[0]}) AS n_repeat_words, {each(lambda k: f"sum(length(w)) FILTER (c{k}) AS cover_{k}")} FROM c GROUP BY doc_id),
a AS (SELECT d.doc_id, coalesce(s.n_words, 0)::BIGINT AS n_words, coalesce(s.word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, {", ".join(f"cover_{k}" for k in all_k)}, cover_lines FROM d LEFT JOIN s USING (doc_id) LEFT JOIN lines USING (doc_id)),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {limits} AS kept FROM b"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations. Rows without a conv_id are left out, null roles and
    texts are empty, turns that tie are ordered by role and text, repeated rows are turns of their own;
    without any conversation there are no nodes."""
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, sf_dir, "conversations"))))


def _op11_sql() -> str:
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN regexp_extract_all(conv_id::VARCHAR, '.')]), lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda b, i: xor(b // 2, 3988292384 * (b % 2)))), 4294967295)"
    return rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc} % 4 AS h, n, least(coalesce(b.n_base, 0), h) AS k FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY 1) LEFT JOIN (SELECT conv_id AS b_id, count(*) AS n_base FROM t GROUP BY 1) b ON b.b_id = conv_id - conv_id % 20),
r AS (SELECT c.conv_id, t.i AS p, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.k UNION ALL SELECT c.conv_id, t.i - c.h + c.k, role, text FROM c JOIN t USING (conv_id) WHERE t.i > c.h),
s AS (SELECT conv_id, list(sha256(strlen(role) || ':' || role || text) ORDER BY p) AS keys, list(len(regexp_extract_all(text, '[^ 	-
]+')) ORDER BY p) AS words FROM r GROUP BY 1),
e AS (SELECT conv_id, coalesce(keys, []) AS keys, coalesce(words, []) AS words FROM c LEFT JOIN s USING (conv_id)),
m AS (SELECT conv_id, d, sha256(array_to_string(keys[1:d], ',')) AS prefix, words[d] AS said, d = len(keys) AS ends FROM (SELECT *, unnest(range(len(keys) + 1)) AS d FROM e)),
n AS (SELECT d, prefix, min(conv_id) AS id, count(*) AS n_convs, coalesce(any_value(said), 0) AS said, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY ALL),
o AS (SELECT m.conv_id, m.d, n.id FROM m JOIN n USING (d, prefix)),
k AS (SELECT n.*, o.id AS parent FROM n LEFT JOIN o ON o.conv_id = n.id AND o.d = n.d - 1),
ch AS (SELECT d - 1 AS d, parent AS id, count(*) AS n_children FROM k WHERE d > 0 GROUP BY ALL),
f AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN ch USING (d, id)),
up AS (SELECT o.d, o.id, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * said) AS saved FROM f JOIN o ON o.conv_id = f.id AND o.d <= f.d GROUP BY ALL)
SELECT id::BIGINT AS conv_id, d::BIGINT AS depth, parent::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256 FROM f JOIN up USING (d, id)"""


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of each language over all whole texts. Null texts are empty, null
    languages are `und`, repeated rows count again, an empty table gives no rows."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def _op12_sql() -> str:
    part = lambda x, a, b: f"array_to_string({x}[{a}:{b}], ' ')"
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?
-
]')) AS piece FROM d),
w AS (SELECT lang, ws FROM (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM p) WHERE len(ws) > 0),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY 1),
g AS ({" UNION ALL ".join(f"SELECT lang, {k} AS size, unnest([{part('ws', 'i', f'i + {k - 1}')} FOR i IN range(1, len(ws) - {k - 2})]) AS phrase FROM w" for k in range(1, phrases.MOST_WORDS + 1))}),
f AS (SELECT lang, size, phrase, count(*) AS f, string_split(phrase, ' ') AS ws FROM g GROUP BY lang, size, phrase HAVING count(*) >= {phrases.MIN_COUNT}),
inside AS (SELECT DISTINCT lang, f, {part("ws", "i", "i + k - 1")} AS phrase FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM f WHERE size > 2))),
kept AS (SELECT * FROM f WHERE size > 1 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = f.lang AND i.phrase = f.phrase AND 100 * i.f >= {phrases.SUBSUMED} * f.f)),
cuts AS (SELECT *, {part("ws", "1", "k")} AS p1, {part("ws", "k + 1", "size")} AS p2 FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, ({phrases.SCALE}::HUGEINT * c.f) // (x.f + y.f) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p1 JOIN f y ON y.lang = c.lang AND y.phrase = c.p2),
weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored) WHERE nth = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {phrases.TOP}"""


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base matches and random strings of every whole document. The models are trained on the strings of
    about 8,000 documents (`secret_scan.SAMPLE_DOCUMENTS`), labelled by the base patterns; null texts
    are empty, repeated rows are scanned one by one, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    weights = secret_scan.fit(secret_scan.samples(secret_scan.sampled(docs)))
    found = secret_scan.find_secrets(docs, weights)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.digest("base_spans"), 256).alias("base_sha256"), secret_scan.digest("spans").alias("spans"))


def _op13_sql() -> str:
    s = secret_scan
    text = lambda x: "'" + x.replace("'", "''") + "'"
    known, run = text(s.KNOWN), text(f"{s.VALUE}{{{s.RUN},}}")

    def spans(name: str, pattern: str) -> str:
        return f"""{name}_parts AS (SELECT id, unnest(regexp_split_to_array(text, {pattern})) AS gap, unnest(list_append(regexp_extract_all(text, {pattern}), NULL)) AS m, unnest(range(len(regexp_extract_all(text, {pattern})) + 1)) AS i FROM d),
{name} AS (SELECT * FROM (SELECT id, m, sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY id ORDER BY i) - length(m) AS b FROM {name}_parts) WHERE m IS NOT NULL)"""

    kinds = [("assign", text(s.ASSIGN), f"length(regexp_extract(m, {text(s.ASSIGN)}, 2)) >= {s.LEAST_VALUE}"), ("access", text(s.ACCESS), "true"), ("hex", text(s.HEX), "true")]
    smooth = lambda label, even: f"CASE WHEN any_{label} > 0 THEN {even} / {len(s.ALPHABET)} + (1 - {even}) * coalesce(n_{label} / any_{label}, 0) ELSE 1 / {len(s.ALPHABET)} END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
{", ".join(spans(k, pattern) for k, pattern, _ in kinds)}, {spans("run", run)},
base AS ({" UNION ALL ".join(f"SELECT id, {o} AS o, '{k}' AS kind, b::BIGINT AS b, (b + length(m))::BIGINT AS e, m FROM {k} WHERE {keep}" for o, (k, _, keep) in enumerate(kinds))}),
chosen AS (SELECT id, text FROM d WHERE (SELECT count(*) FROM d) <= {s.SAMPLE_DOCUMENTS} OR substr(md5(doc_id::VARCHAR), 1, 8) < (SELECT printf('%08x', floor({s.SAMPLE_DOCUMENTS} / count(*) * 4294967296)::BIGINT) FROM d)),
strings AS (SELECT CASE kind WHEN 'assign' THEN regexp_extract(m, {text(s.ASSIGN)}, 2) ELSE m END AS v, true AS label FROM base SEMI JOIN chosen USING (id)
  UNION ALL SELECT v, false FROM (SELECT unnest(regexp_extract_all(regexp_replace(text, {text(s.ASSIGN)}, ' ', 'g'), '{s.VALUE}{{2,}}')) AS v FROM chosen) WHERE NOT regexp_matches(v, {known})),
pairs AS (SELECT label, substr(v, i, 1) AS a, substr(v, i + 1, 1) AS b, sum(n) AS n FROM (SELECT v, label, n, unnest(range(1, length(v))) AS i FROM (SELECT v, label, count(*) AS n FROM strings GROUP BY ALL)) GROUP BY ALL),
letters AS (SELECT unnest(regexp_extract_all('{s.ALPHABET}', '.')) AS a),
cells AS (SELECT x.a, y.a AS b, t.n AS n_true, f.n AS n_false, (SELECT sum(n) FROM pairs WHERE label AND a = x.a) AS any_true, (SELECT sum(n) FROM pairs WHERE NOT label AND a = x.a) AS any_false
  FROM letters x CROSS JOIN letters y LEFT JOIN pairs t ON t.label AND t.a = x.a AND t.b = y.a LEFT JOIN pairs f ON NOT f.label AND f.a = x.a AND f.b = y.a),
model AS (SELECT a, b, round(1000 * (ln({smooth("true", s.EVEN_RANDOM)}) - ln({smooth("false", s.EVEN_ORDINARY)})))::BIGINT AS w FROM cells),
tried AS (SELECT id, b, b + length(m) AS e, m FROM run WHERE regexp_matches(m, '[A-Za-z]') AND regexp_matches(m, '[0-9]') AND NOT regexp_matches(m, {known})),
fresh AS (SELECT * FROM tried t WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.id = t.id AND base.kind = 'assign' AND base.e = t.e)),
random AS (SELECT f.id, f.b, f.e FROM (SELECT *, unnest(range(1, length(m))) AS i FROM fresh) f JOIN model ON model.a = substr(f.m, f.i, 1) AND model.b = substr(f.m, f.i + 1, 1) GROUP BY ALL HAVING sum(w) >= {s.MARGIN}),
every AS (SELECT id, o, kind, b, e FROM base UNION ALL SELECT id, {len(s.KINDS)}, '{s.METHOD}', b, e FROM random),
told AS (SELECT id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in s.KINDS)}, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) FILTER (o < {len(s.KINDS)}) AS based, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) AS spans FROM every GROUP BY id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in s.KINDS)}, sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_warc_fixity": op2_warc_fixity,
    "op3_toxicity": op3_toxicity,
    "op4_bpe_replay": op4_bpe_replay,
    "op5_language_id": op5_language_id,
    "op6_gif_media": op6_gif_media,
    "op7_hmm_lm": op7_hmm_lm,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_source_mix": op9_source_mix,
    "op10_repetition_coverage": op10_repetition_coverage,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_secret_scan": op13_secret_scan,
}

ORACLES: dict[str, str] = {
    "op2_warc_fixity": _op2_sql(),
    "op10_repetition_coverage": _op10_sql(),
    "op11_prefix_trie": _op11_sql(),
    "op12_phrase_mining": _op12_sql(),
    "op13_secret_scan": _op13_sql(),
}
