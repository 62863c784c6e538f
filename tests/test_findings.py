"""What the findings of round 3 name: the work that a plan does, and the same results on odd rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import derived, sketch
from palimpsest.functions import seq as S
from palimpsest.operators import errors, graph, merge
from palimpsest.plans import correction

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_qualities_of_a_batch_at_once(spark):
    """F32, F36, F37, F43 and all on clusters: no lambda runs for every base."""
    rows = [(0, "ACGT"), (7, ""), (1 << 58, "TTGCA" * 12), (40, "N")]
    got = spark.createDataFrame(rows, "ord long, seq string").select("ord", "seq", derived.quality().alias("q"))
    assert "lambda" not in plan(got)
    for r in got.collect():
        assert r.q == "".join(chr(33 + (ord(c) * 7 + i * 3 + 3 + r.ord) % 41) for i, c in enumerate(r.seq))


def test_reads_of_odd_texts(spark, tmp_path):
    texts = [None, "", "Élan K2 K İx", "ab" * 45 + "ß", "x" * 29, "Q" * 30, "a-b c\n" * 50]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.ord % derived.PER_DOCUMENT): r.seq for r in derived.reads(spark, str(tmp_path)).collect()}
    table = str.maketrans(derived.LETTERS, derived.AS_BASES)
    expected = {}
    for d, text in enumerate(texts):
        bases = "".join(c for c in (text or "").lower() if c in derived.LETTERS).translate(table)
        expected |= {(d, i // 60): bases[i : i + 60] for i in range(0, len(bases), 60) if len(bases[i : i + 60]) >= 30}
    assert got == expected


@pytest.mark.parametrize("k", [5, 17])
def test_numbered_kmers_are_those_of_the_letters(spark, k):
    """k-mers are numbers from the reads to the counts."""
    rng = random.Random(k)
    seqs = ["".join(rng.choices("ACGT", k=rng.randint(1, 60))) for _ in range(60)] + ["ACGTN" * 8, "acgtacgtacgtACGTACCGTACGTATTAC", "A" * 30, "AC" * 15, "", "ÉACGGTACCATTGACCATGGA"]
    seqs += [seqs[0]] * 300
    expected = {}
    for s in seqs:
        for i in range(len(s) - k + 1):
            x = s[i : i + k]
            if set(x) - set("ACGT") or len({x[j : j + 2] for j in range(k - 1)}) < 3:
                continue
            rc = x[::-1].translate(COMPLEMENT)
            after, before = s[i + k : i + k + 1], s[i - 1 : i].translate(COMPLEMENT) if i else ""
            f, r = (after, before) if x <= rc else (before, after)
            expected.setdefault(min(x, rc), Counter()).update({("f", f): 1, ("r", r): 1})
    found = graph.kmer_edges(spark.createDataFrame([(s,) for s in seqs], "seq string"), k)
    assert "MapInArrow" in plan(found)
    got = {r.canon: {c: r[c] for c in found.columns[1:]} for r in found.collect()}
    assert got == {x: {f"{c}_{b}": min(255, n[c, b]) for c in "fr" for b in "ACGT"} for x, n in expected.items()}


def test_differences_are_counted_without_a_list(spark):
    """F42."""
    rows = [("ACGT", "ACGA"), ("ACGT", "AC"), ("", ""), (None, "A"), ("A", None), ("éa", "éb"), ("T" * 60, "A" * 60)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(S.differences("a", "b").alias("x"), S.hamming("a", "b").alias("y"), S.hamming_capped("a", "b", 8).alias("c"))
    assert [r.x for r in got.collect()] == [r.y for r in got.collect()]
    assert "lambda" not in plan(df.select(S.hamming_capped("a", "b", 8)))


def test_cap_report_moves_numbers_of_keys_that_few_share(spark):
    """sequences are grouped only where more than the cap share the number of a key."""
    rng = random.Random(1)
    one = "".join(rng.choices("ACGT", k=40))
    near = [one, *(one[:i] + ("A" if one[i] != "A" else "C") + one[i + 1 :] for i in range(5))]
    rows = [(s, 1) for s in near + ["".join(rng.choices("ACGT", k=40)) for _ in range(50)]]
    clusters = spark.createDataFrame(rows, "canon string, n long")
    report = errors.over_cap(clusters, errors.Rules(bucket_cap=3))
    assert "Window" in plan(report)
    parts = Counter()
    for s, _ in rows:
        q = [s[10 * i : 10 * i + 10] for i in range(4)]
        parts.update((10 * i + j, q[i], q[j]) for i in range(4) for j in range(i + 1, 4))
    assert {(r.tag, r.p, r.q): r.n for r in report.collect()} == {k: n for k, n in parts.items() if n > 3}


def test_pair_keys_are_grouped_once(spark, sf):
    """no row is copied for a second distinct count."""
    assert "Expand" not in plan(correction.pair_keys(spark, sf))


def test_occupancy_reads_clusters_once(spark, sf):
    """clusters are a table, and not made anew for each side of the join."""
    assert "documents" not in "".join(correction.bundle_occupancy(spark, sf).inputFiles())


def test_substitutions_are_counted_once(spark):
    """one count by place and length of the overlap; both ends and the whole come from it."""
    df = spark.createDataFrame([("ACGTN", "ACTTA"), ("AC", "AC")], "left string, right string")
    got = merge.substitution_tensor(df, most=2)
    assert "Union" not in plan(got)
    rows = {(r.strand, r.pos, r.b1, r.b2): r.n for r in got.collect()}
    assert rows[("fwd", 0, "A", "A")] == 2 and rows[("rev", 0, "C", "C")] == 1 and rows[("rev", 1, "T", "T")] == 1
    assert rows[("all", None, "G", "T")] == 1 and ("fwd", 2, "G", "T") not in rows and not any(k[2] == "N" for k in rows)


def close_by_hand(found, cut=lambda s: s):
    want = set()
    for a, n in found.items():
        for b, m in found.items():
            if a != b and len(a) == len(b) and (n > m or (n == m and a < b)):
                for turned, s in ((0, b), (1, b[::-1].translate(COMPLEMENT))):
                    mm = [(i, x, y) for i, (x, y) in enumerate(zip(a, s, strict=True)) if x != y]
                    if 1 <= len(mm) <= 2:
                        want.add((a, b, n, m, s, turned, tuple(mm), len(mm)))
    return want


@pytest.mark.parametrize("hot", [1024, 3])
def test_close_pairs_carry_their_bases(spark, hot):
    """F11, F18, F19 and all on close pairs: rows of a key meet with their bases, once for both strands, and are joined to
    nothing; palindromes, whose keys read both strands, lose and double no pair."""
    rng = random.Random(hot)
    found = {}
    for size in (20, 21, 40, 64, 65, 130):
        half = "".join(rng.choices("ACGT", k=size // 2))
        for base in ("".join(rng.choices("ACGT", k=size)), half + "A" * (size % 2) + half[::-1].translate(COMPLEMENT), "AT" * (size // 2)):
            for _ in range(12):
                s = list(base)
                for p in rng.sample(range(len(s)), rng.choice((0, 1, 2, 3))):
                    s[p] = rng.choice("ACGT")
                s = "".join(s)
                found[min(s, s[::-1].translate(COMPLEMENT))] = rng.randint(1, 3)
    pairs = errors.close_pairs(spark.createDataFrame(list(found.items()), "canon string, n long"), errors.Rules(hot_parts=hot))
    assert "Join" not in plan(pairs) and "Window" not in plan(errors._best(pairs.filter("NOT twin")).filter("NOT false")).split("Union")[0]
    got = [(r.parent, r.child, r.n_parent, r.n_child, r.oriented, r.turned, tuple(tuple(m) for m in r.mm), r.h) for r in pairs.collect()]
    want = close_by_hand(found)
    assert len(got) == len(set(got)) > 100 and set(got) == want
    both = {(a, b) for a, b, *_, turned, _, _ in want if turned} & {(a, b) for a, b, *_, turned, _, _ in want if not turned}
    assert both and {(r.parent, r.child) for r in pairs.filter("twin").collect()} == both


def test_capped_keys_lose_their_pairs(spark):
    """A pair whose every key more than the cap share is left out, and no other."""
    rng = random.Random(2)
    base = "".join(rng.choices("ACGT", k=40))
    near = [base, *(base[:i] + "CGTA"["ACGT".index(base[i])] + base[i + 1 :] for i in (0, 1, 2, 12, 22, 32))]
    found = {min(s, s[::-1].translate(COMPLEMENT)): 9 - i for i, s in enumerate(near)}
    rows = errors.close_pairs(spark.createDataFrame(list(found.items()), "canon string, n long"), errors.Rules(bucket_cap=4)).collect()
    quarter = lambda s: [s[10 * i : 10 * i + 10] for i in range(4)]
    keys = lambda s: {(i, j, quarter(s)[i], quarter(s)[j]) for i in range(4) for j in range(i + 1, 4)}
    count = Counter(k for s in found for k in keys(s))
    want = {(x[0], x[1], x[5]) for x in close_by_hand(found) if any(count[k] <= 4 for k in keys(x[0]) & keys(x[4]))}
    assert len(rows) == len(want) and {(r.parent, r.child, r.turned) for r in rows} == want and len(want) < len(close_by_hand(found))


@pytest.mark.parametrize("k, m, offset, most", [(11, 7, 2, 8), (13, 7, 3, 16), (5, 2, 1, 3)])
def test_sketches_of_a_batch_at_once(spark, k, m, offset, most):
    """the hashes are those of the expression, without a lambda for every place."""
    rng = random.Random(k)
    seqs = [None, "", "ACGT", "A" * 40, "AT" * 30, "ACGTN" * 9, "acgtRYACGGTA" * 4, *("".join(rng.choices("ACGT", k=n)) for n in (10, 11, 12, 13, 59, 60, 60, 75, 200) for _ in range(20))]
    rows = spark.createDataFrame([(s,) for s in seqs], "s string").coalesce(1)
    got = rows.select(sketch.syncmer_hashes("s", (k, m, offset, most), (k, m, offset, most), 75).alias("x"))
    assert "lambda" not in plan(got)
    want = rows.select(F.transform(S.syncmers("s", k, m, offset, most), lambda x: x["hash"]).alias("y")).collect()
    assert [r.x for r in got.collect()] == [r.y or [] for r in want] and sum(len(r.y or []) for r in want) > 100


def test_far_pairs_are_told_before_they_are_aligned(spark, sf):
    """the bounded edit distance stands in the plan, and no lambda tries every deletion."""
    assert "levenshtein" in plan(errors.moderate_pairs(spark.createDataFrame([("ACGT", 1)], "canon string, n long"), near=True))
    found = errors.adjacent_lengths(spark.createDataFrame([("ACGTACGTAC", 3), ("ACGTACGTC", 2), ("ACGTACGTT", 1)], "canon string, n long"), end=2)
    assert "lambda" not in plan(found) and "levenshtein" in plan(found)


def test_damage_is_set_back_for_a_batch_at_once(spark):
    """no lambda runs for every base; nulls stay null."""
    rules = correction.DEAM
    seqs = [None, "", "T", "TTAA", "TA" * 30, "ACGTN" * 13]
    got = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", errors.deaminated(F.col("s"), rules).alias("x"))
    assert "lambda" not in plan(got)
    for s, x in got.collect():
        chance = lambda i, n: max(0.4 * 2.718281828459045 ** (-0.12 * i), 0.4 * 2.718281828459045 ** (-0.12 * (n - 1 - i)))
        want = None if s is None else "".join(c if chance(i, len(s)) < 0.01 else c.replace("T", "C") if i < len(s) // 2 else c.replace("A", "G") for i, c in enumerate(s))
        assert x == want


def test_edges_of_a_parent_meet_once(spark):
    """F12, F20 and all on scores: support and dispersion come without a join, and are those of the signatures."""
    rng = random.Random(9)
    base = "".join(rng.choices("ACGT", k=40))
    near = {base: 50}
    for _ in range(40):
        s = list(base)
        for p in rng.sample(range(40), rng.choice((1, 2))):
            s[p] = rng.choice("ACGT")
        near.setdefault("".join(s), rng.randint(1, 3))
    edges = errors._best(errors.close_pairs(spark.createDataFrame(list(near.items()), "canon string, n long")))
    found = errors.with_signatures(edges)
    assert "Join" not in plan(found) and "Join" not in plan(errors.with_support(edges))
    reads = Counter()
    rows = found.collect()
    for r in rows:
        reads.update({(r.parent, m.pos, m.b): r.n_child for m in r.mm})
    assert len(rows) == edges.count() > 30
    adjust = {r.parent: r.adjust for r in errors.dispersion(edges).collect()}
    for r in rows:
        assert r.support == [reads[(r.parent, m.pos, m.b)] for m in r.mm] and r.adjust == adjust[r.parent]
