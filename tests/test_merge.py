"""The merge by matrices against the same rules as columns, one pair at a time; learned options."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import seq as S
from palimpsest.operators import merge, prescan, tables

PAIR = "ord bigint, header string, seq1 string, qual1 string, seq2 string, qual2 string"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def by_columns(pairs, o):
    """merge_pairs as a composition of column functions."""
    found = merge.overlapped(pairs, o)
    pair = lambda s, q: F.struct(F.col(s).alias("s"), F.col(q).alias("q"))
    whole = F.when(F.col("phase") < 5, merge.cut_front(pair("seq", "qual"), o.linker, o, whole=True)).otherwise(pair("seq", "qual"))
    whole = merge.cut_back(merge.cut_front(whole, merge.reverse_complement(o.adapter2[:12]), o), o.adapter1, o)
    found = found.withColumn("_m", F.when(F.col("phase") >= 0, whole)).withColumn("_1", merge.clipped(pair("seq1", "qual1"), o.adapter1, o.adapter2, o)).withColumn("_2", merge.clipped(pair("seq2", "qual2"), o.adapter2, o.adapter1, o))
    junk = merge.homopolymer("seq1") & merge.homopolymer("seq2")
    bad = merge.technical("_m.s", (o.adapter1, o.adapter2)) | merge.homopolymer("_m.s")
    for i, x in ((1, o.adapter1), (2, o.adapter2)):
        found = found.withColumn(f"_ok{i}", merge.passes(F.col(f"_{i}.s"), o, o.gates[i - 1]) & ~merge.dimer(f"_{i}.s", x))
    found = found.withColumn("_good", F.col("_m").isNotNull() & merge.passes(F.col("_m.s"), o)).withColumn("_bad", F.col("_m").isNotNull() & bad)
    route = F.when(junk | F.col("_bad"), "dropped").when(F.col("_good"), "merged").when(F.col("_ok1") & F.col("_ok2"), "unmerged").when(F.col("_ok1") | F.col("_ok2"), "orphan").otherwise("dropped")
    out = found.withColumn("route", route)
    is_ = lambda r: F.col("route") == r
    mate = lambda i, c: F.when(is_("unmerged") | (is_("orphan") & F.col(f"_ok{i}")), F.col(f"_{i}.{c}")).alias(("seq" if c == "s" else "qual") + str(i))
    return out.select(S.clean_name("header").alias("header"), "ord", "route", F.when(is_("merged"), F.col("phase")).otherwise(-1).cast("int").alias("phase"), "overlap", F.when(is_("merged"), F.col("_m.s")).alias("seq"), F.when(is_("merged"), F.col("_m.q")).alias("qual"), mate(1, "s"), mate(1, "q"), mate(2, "s"), mate(2, "q"))


def worn(rng, s, rate):
    out = []
    for b in s:
        x = rng.random()
        out.append("" if x < rate / 3 else rng.choice("ACGTN") if x < rate else b + rng.choice("ACGT") if x < rate * 1.3 else b)
    return "".join(out)


def messy_pairs(n, seed, linker=""):
    rng = random.Random(seed)
    a1, a2 = merge.ADAPTER1, merge.ADAPTER2
    some = lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    rows = []
    for i in range(n):
        kind, insert = i % 12, some(rng.choice([0, 3, 10, 14, 18, 25, 30, 36, 45, 60, 75]))
        s1, s2 = insert + a1, rc(insert) + a2
        if kind == 1:
            s1, s2 = a1[rng.randrange(5) :] + some(20), a2[rng.randrange(5) :] + some(20)
        elif kind == 2:
            s1, s2 = rng.choice("ACGT") * 50, rng.choice("ACGTG") * 50
        elif kind == 3:
            s1, s2 = some(30) + "G" * rng.randrange(20), some(30) + "G" * rng.randrange(20)
        elif kind == 4:
            piece = rng.choice([a1, a2, rc(a1), rc(a2)])[rng.randrange(6) :]
            s1, s2 = piece[: rng.randrange(12, 34)] + a1, rc(piece[: rng.randrange(12, 34)]) + a2
        elif kind == 5:
            s1, s2 = some(50), some(50)
        elif kind == 6:
            s1, s2 = merge.UNIVERSAL + insert + a1, rc(insert) + a2
        elif kind == 7:
            s1, s2 = linker + insert + a1, rc(linker + insert) + a2
        elif kind == 8:
            s1, s2 = "AC" * 20 + some(6), some(4) + "T" * 30
        elif kind == 9:
            s1, s2 = some(rng.randrange(25)), some(rng.randrange(25))
        rate = rng.choice([0, 0, 0.02, 0.05])
        s1, s2 = worn(rng, s1, rate)[: rng.choice([50, 50, 44])], worn(rng, s2, rate)[: rng.choice([50, 50, 47])]
        q = lambda s: "".join(chr(33 + rng.choice([2, 20, 37, 40])) for _ in s)
        rows.append((i, f"@r{i}/1" if i % 2 else f"@r{i}", s1, q(s1), s2, q(s2)))
    return [*rows, (n, "@x", None, None, "ACGT", "IIII"), (n + 1, None, "", "", "", ""), (n + 2, "@n", "N" * 40, "#" * 40, "N" * 40, "#" * 40)]


LINKER = "GATTACAGATTACAGT"
SETTINGS = [
    merge.Options(),
    merge.Options(linker=LINKER, poly_g=4, gates=((1.2, 0.7), (0.9, 0.8)), extra_adapters=("CTGTCTCTTATACACATCT",)),
    merge.Options(min_length=25, max_length=60, max_n_rate=0.05, min_entropy=1.3, clip_5p=2, skip_terminal=2, poly_g=0),
    merge.Options(adapter1="AGATCGGA", adapter2="CTGTCTCTTATACACATCT", min_overlap=8),
]


@pytest.mark.parametrize("which", range(len(SETTINGS)))
def test_whole_rows_equal_those_of_columns(spark, which):
    o = SETTINGS[which]
    rows = spark.createDataFrame(messy_pairs(420, which, o.linker), PAIR).repartition(4)
    key = lambda r: r.ord
    got, want = sorted(merge.merge_pairs(rows, o).collect(), key=key), sorted(by_columns(rows, o).collect(), key=key)
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert {"merged", "unmerged", "orphan", "dropped"} <= {r.route for r in got}


def test_no_pairs(spark):
    assert merge.merge_pairs(spark.createDataFrame([], PAIR)).count() == 0


# ---- Learned options

OWN1, OWN2, OWN_LINKER = "CTGTCTCTTATACACATCTCCGAGCCCACGAGAC", "CTGTCTCTTATACACATCTGACGCTGCCGACGA", "CGCAATGCTCATTGGCAGGACTCAA"


def library(n, adapter1, adapter2, linker="", linked=0.0, seed=1, kind="ds", damage=0.0):
    rng, rows = random.Random(seed), []
    for i in range(n):
        x = "".join(rng.choice("ACGT") for _ in range(rng.randrange(20, 70)))
        if damage and rng.random() < damage and "C" in x[:4]:
            at = x.index("C")
            top = x[:at] + "T" + x[at + 1 :]
        else:
            top = x
        if rng.random() < linked:
            top = x = linker
        s1, s2 = (top + adapter1)[:60], (rc(x) + adapter2)[:60]
        rows.append((7 * i + (i % 3), f"@r{i}", s1, "I" * len(s1), s2, "I" * len(s2)))
    return rows


def test_planted_library_comes_back(spark):
    rows = library(3_000, OWN1, OWN2)
    pairs = spark.createDataFrame(rows, PAIR).repartition(5)
    found = prescan.learn(pairs, first=2_000)
    assert found.kind == "ds" and found.treatment == "full" and found.linker == "" and found.options.skip_terminal == 0
    assert OWN1.startswith(found.options.adapter1) and len(found.options.adapter1) >= 18
    assert OWN2.startswith(found.options.adapter2) and len(found.options.adapter2) >= 18
    assert found.options.gates[0][0] > 0.5 and found.options.gates[1][1] < 0.95 and 4 <= found.options.poly_g <= 6
    merged, again = prescan.learn_and_merge(pairs, first=2_000)
    assert again == found
    whole = {o: s for o, _, s, *_ in rows}
    right = sum(r.seq is not None and whole[r.ord].startswith(r.seq[:50]) and len(r.seq) < 70 for r in merged.collect())
    usual = sum(r.seq is not None and whole[r.ord].startswith(r.seq[:50]) and len(r.seq) < 70 for r in merge.merge_pairs(pairs).collect())
    assert right >= 0.98 * len(rows) and right >= usual


def test_linker_and_single_strand_are_learned(spark):
    rows = library(1_500, merge.UNIVERSAL + "CACACGTCTGAACTCC", "GGAAGAGCGTCGTGTAGGGAAAGAGTGT", linker=OWN_LINKER, linked=0.2)
    # Mate 1 of single-stranded libraries reads on into the splint without the stem before it.
    rows = [(o, h, s1.replace(merge.UNIVERSAL, "GGAAGAGCGTCG"), q1, s2, q2) for o, h, s1, q1, s2, q2 in rows]
    rows = [(o, h, s1, "I" * len(s1), s2, q2) for o, h, s1, _, s2, q2 in rows]
    found = prescan.learn(spark.createDataFrame(rows, PAIR))
    assert found.kind == "ss" and prescan.SPLINT in found.options.extra_adapters
    assert found.linker[:20] == OWN_LINKER[:20] and found.options.linker == found.linker
    assert prescan.learn(spark.createDataFrame(rows, PAIR), declared="ds").linker == ""


def test_nothing_to_learn_leaves_options(spark):
    rng = random.Random(4)
    apart = [(i, "@x", "".join(rng.choices("ACGT", k=40)), "I" * 40, "".join(rng.choices("ACGT", k=40)), "I" * 40) for i in range(50)]
    for rows in (apart[:0], [(1, None, None, None, None, None)]):
        found = prescan.learn(spark.createDataFrame(rows, PAIR))
        assert found.options == merge.Options() and found.inserts == 0
    assert prescan.learn(spark.createDataFrame(apart, PAIR)).options.adapter1 == merge.ADAPTER1


def test_head_takes_the_first_rows_whatever_the_gaps(spark):
    rows = spark.range(50_000).withColumn("ord", F.col("id") * 1_048_576 + F.col("id") % 7).repartition(7)
    for n in (0, 1, 100, 49_999, 50_000, 60_000):
        assert sorted(r.id for r in tables.head(rows, "ord", n).select("id").collect()) == list(range(min(n, 50_000)))
