"""Secrets in texts: fixed patterns, and random strings by two character Markov models.

The patterns (an assignment to a name such as password, an access key, long hexadecimal numbers) are
the base. The method adds runs of letters, digits and `+/_.=-` that look random: two first-order
Markov chains over characters, one of random strings and one of ordinary identifiers, are trained
from labelled samples, and a run is a secret if the sum of its log-likelihood ratios reaches a margin.

All of it is DataFrame expressions. A model is a table of 68 x 68 weights whatever the corpus, held
by the driver and by the plan as a literal. Scanning has no shuffle, and of a text it keeps lists of
its matches only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The three patterns, the least length of what they match, and their order.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
VALUE = "[A-Za-z0-9+/_.=-]"
KINDS = ("assign", "access", "hex")
LEAST_VALUE, ACCESS, HEX = 8, "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"


def _either_case(pattern: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


#: A short value fails but is passed over all the same, so that its length is tested afterwards.
ASSIGN = rf"""({"|".join(map(_either_case, NAMES))})["']?\x20*[:=]\x20*["']?({VALUE}+)"""
#: What holds a base match is not reported again.
KNOWN = f"{ACCESS}|{HEX}"

#: What the method calls its spans, and the least length of a run that it judges (with a letter and a digit).
METHOD, RUN = "markov", 16
#: Least sum of log-likelihood ratios of a secret, in thousandths of a nat.
MARGIN = 25_000
#: Share of the even distribution in the transitions of random strings, and of identifiers.
EVEN_RANDOM, EVEN_ORDINARY = 0.5, 0.01
#: The characters of a run, in the order of the model's rows.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Documents, on average, whose strings are the labelled samples of the query.
SAMPLE_DOCUMENTS = 8_000


def let(value: Column, use) -> Column:
    """use(value), with value computed once for a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column) -> Column:
    """Running sums of an array, in blocks of 256, so that no array is grown item by item."""
    block = 256
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))
    blocks = F.transform(starts, lambda b: F.slice(values, b * block + 1, F.lit(block)))
    within = lambda xs, before: F.transform(xs, lambda _, i: before + total(F.slice(xs, F.lit(1), i + 1)))
    return let(blocks, lambda bs: let(F.transform(bs, total), lambda sums: F.flatten(F.transform(bs, lambda xs, b: let(total(F.slice(sums, F.lit(1), b)), lambda before: within(xs, before))))))


def matches(text: Column, pattern: str) -> Column:
    """start, end (code points, end exclusive) and value of the leftmost non-overlapping matches. The
    parts between them give the places; they are taken of texts that hold a match only."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    sizes = lambda found: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, m: F.length(gap) + F.length(m))
    placed = lambda found: let(sizes(found), lambda xs: F.zip_with(found, _running(xs), lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value"))))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def base_matches(text: Column) -> dict[str, Column]:
    """The matches of each kind of the base; assign keeps those whose value has 8 characters or more."""
    long = lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= LEAST_VALUE
    return {"assign": F.filter(matches(text, ASSIGN), long), "access": matches(text, ACCESS), "hex": matches(text, HEX)}


def samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """value, is_random, n: strings of docs by label, with their counts. What the base patterns find is
    random; all other runs of two characters and more are ordinary."""
    base = base_matches(F.col("_text"))
    values = F.transform(base["assign"], lambda m: F.regexp_extract(m["value"], ASSIGN, 2))
    known = F.concat(values, F.transform(base["access"], lambda m: m["value"]), F.transform(base["hex"], lambda m: m["value"]))
    rest = F.regexp_extract_all(F.regexp_replace("_text", ASSIGN, " "), F.lit(f"{VALUE}{{2,}}"), F.lit(0))
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    labelled = lambda xs, label: F.transform(xs, lambda v: F.struct(v.alias("value"), F.lit(label).alias("is_random")))
    both = F.concat(labelled(known, True), labelled(F.filter(rest, lambda v: ~v.rlike(KNOWN)), False))
    return texts.select(F.explode(both).alias("v")).groupBy("v.value", "v.is_random").agg(F.count("*").alias("n"))


def sampled(docs: DataFrame, key: str = "doc_id", documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """A sample of about so many rows, by the hash of their key: all of them if there are no more. Rows
    of one key are in it or out of it together; rows without a key are out."""
    share = documents / max(docs.count(), 1)
    if share >= 1:
        return docs
    return docs.filter(F.substring(F.md5(F.col(key).cast("string")), 1, 8) < f"{int(share * (1 << 32)):08x}")


def fit(labelled: DataFrame) -> list[int]:
    """The weights of all pairs of characters (rows: the first), in thousandths of a nat, from samples
    (value, is_random, n). Transitions never seen have the even share; without any samples of a label
    its transitions are even. Null values and characters outside the alphabet are passed over."""
    chars = F.split("value", "")
    pairs = F.filter(F.transform(chars, lambda c, i: F.struct(c.alias("a"), F.get(chars, i + 1).alias("b"))), lambda p: p["b"].isNotNull() & (p["b"] != ""))
    of = lambda label: F.sum(F.when(F.col("is_random") == label, F.col("n")))
    seen = labelled.filter(F.length("value") > 1).select("is_random", "n", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(of(True).alias("n_true"), of(False).alias("n_false"))
    letters = labelled.sparkSession.range(1).select(F.explode(F.array([F.lit(c) for c in ALPHABET])).alias("a"))
    cells = letters.crossJoin(letters.withColumnRenamed("a", "b")).join(seen, ["a", "b"], "left")  # 68 x 68

    def smooth(label: str, even: float) -> Column:
        n, begun = F.coalesce(F.col(f"n_{label}"), F.lit(0)), F.sum(f"n_{label}").over(Window.partitionBy("a"))
        return F.when(begun > 0, F.lit(even) / len(ALPHABET) + (1 - even) * n / begun).otherwise(1 / len(ALPHABET))

    weight = F.round(1000 * (F.log(smooth("true", EVEN_RANDOM)) - F.log(smooth("false", EVEN_ORDINARY)))).cast("int")
    found = {(r.a, r.b): r.w for r in cells.select("a", "b", weight.alias("w")).collect()}
    return [found[a, b] for a in ALPHABET for b in ALPHABET]


def ratio(run: Column, weights: list[int]) -> Column:
    """The log-likelihood ratio of a run of ALPHABET, in thousandths of a nat, by one pass over it."""
    table = F.lit(weights)
    code = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("bigint").alias("sum"))
    step = lambda acc, c: F.struct(code(c).alias("last"), (acc["sum"] + F.when(acc["last"] >= 0, F.coalesce(F.get(table, acc["last"] * len(ALPHABET) + code(c)), F.lit(0))).otherwise(0)).alias("sum"))
    return F.aggregate(F.filter(F.split(run, ""), lambda c: c != ""), start, step, lambda acc: acc["sum"])


def find_secrets(docs: DataFrame, weights: list[int], text: str = "text", keys: tuple[str, ...] = ("doc_id",), margin: int = MARGIN) -> DataFrame:
    """keys, n_assign, n_access, n_hex, base_spans and spans (arrays of start, order, end, kind and
    value, sorted by start and order), one row for each document. The method's spans are runs of 16
    characters and more, with a letter and a digit, that hold no match of the base and do not end
    where an assigned value ends.

    Null texts are empty and have no spans. Repeated rows are scanned one by one, keys may be null,
    other columns are not read; a text without any match costs its scan by four patterns."""
    rows = docs.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    base = base_matches(F.col("_text"))
    rows = rows.select(*keys, *(base[k].alias(f"_{k}") for k in KINDS), matches(F.col("_text"), f"(?<!{VALUE}){VALUE}{{{RUN},}}+").alias("_runs"))
    ends = F.transform("_assign", lambda m: m["end"])
    new = lambda m: ~m["value"].rlike(KNOWN) & ~F.array_contains(ends, m["end"])
    mixed = lambda m: m["value"].rlike("[A-Za-z]") & m["value"].rlike("[0-9]")
    runs = F.filter("_runs", lambda m: mixed(m) & new(m) & (ratio(m["value"], weights) >= margin))
    named = lambda xs, kind, order: F.transform(xs, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")))
    based = F.concat(*(named(f"_{k}", k, i) for i, k in enumerate(KINDS)))
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(*keys, *counts, F.array_sort(based).alias("base_spans"), F.array_sort(F.concat(based, named(runs, METHOD, len(KINDS)))).alias("spans"))


def digest(spans: str) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")
