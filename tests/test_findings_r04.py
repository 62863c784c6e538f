"""What the findings of round 4 name."""

import itertools
import random

import numpy as np
import pytest

from palimpsest.functions import seq as S
from palimpsest.operators import closepairs, errors, graph, indels, prescan, store, tables
from palimpsest.operators.damage import Profile
from palimpsest.plans import queries

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(COMPLEMENT)


def test_tasks_of_the_prescan_need_no_session(spark):
    """merge_learned: what a task runs is sent by value; a module that it names would go with the functions that a
    session has bound before, which cannot be sent."""
    assert spark.createDataFrame([("A", "C")], "a string, b string").select(S.differences("a", "b").alias("x")).first().x == 1
    pairs = spark.createDataFrame([(1, "ACGT" * 5, "ACGT" * 5)], "ord long, seq1 string, seq2 string")
    assert prescan.inserts(pairs).count() == 1


def test_all_reads_are_paired(spark, sf):
    """every read has its mate, not every fourth."""
    assert queries.fastq_pairs(spark, sf).count() == queries.reads(spark, sf).count()
    assert "%" not in queries.ORACLES["fastq_pairs"].split("SELECT '@read_'")[1]


def test_nodes_stand_as_they_are_nearer(spark):
    """a path may turn a node away from the direction in which it is nearer to its root."""
    root = "ACGTTGCATGCAACGT"
    node = rc(root)[:-1] + "A"
    rows = [(1, root, root, False), (1, root, node, False), (1, root, "ACGTTGCATGCAACGA", True), (1, "ATATAT", "ATATAT", True)]
    got = {(r.node): r.line for r in store.grid(spark.createDataFrame(rows, "cluster_id long, root string, node string, flip boolean"), nearer=True).collect()}
    want = {}
    for _, top, x, _ in rows:
        far = lambda y, top=top: sum(a != b for a, b in zip(top, y, strict=True))
        best = x if far(x) <= far(rc(x)) else rc(x)
        want[x] = "".join("." if a == b else b for a, b in zip(top, best, strict=True))
    assert got == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def crowd(rng, middle, n, end=12):
    """Sequences of one bundle, few edits apart from one or another."""
    head, tail = "".join(rng.choices("ACGT", k=end)), "".join(rng.choices("ACGT", k=end))
    found = {"".join(rng.choices("ACGT", k=middle))}
    while len(found) < n:
        x = list(rng.choice(sorted(found)))
        for _ in range(rng.choice((1, 1, 2, 3))):
            at = rng.randrange(len(x) + 1)
            kind = rng.choice(("sub", "ins", "del"))
            if kind == "ins" or not x:
                x.insert(at, rng.choice("ACGT"))
            elif kind == "del":
                x.pop(min(at, len(x) - 1))
            else:
                x[min(at, len(x) - 1)] = rng.choice("ACGT")
        found.add("".join(x))
    return sorted(head + x + tail for x in found)


@pytest.mark.parametrize("middle", [0, 4, 33])
def test_crowded_bundles_keep_their_pairs(spark, middle):
    """bundles of fifty clusters and more have partners too, all of those within two edits."""
    rng = random.Random(middle)
    rows = [(s, rng.randint(1, 3), "I" * len(s)) for s in crowd(rng, middle, 90) + crowd(rng, middle, 60)]
    clusters = spark.createDataFrame(rows, "canon string, n long, qual string")
    got = errors.crowded_pairs(clusters, keep=("qual",)).collect()
    want = set()
    for (a, n, _), (b, m, _) in itertools.permutations(rows, 2):
        if a[:12] == b[:12] and a[-12:] == b[-12:] and (n > m or (n == m and a < b)) and abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2:
            want.add((a, b))
    assert len(got) == len(want) > 50 and {(r.parent, r.child) for r in got} == want
    assert errors.moderate_pairs(clusters, near=True).count() == 0
    bins = spark.createDataFrame([("T>C", 3, 0, 0, 5, 0.05, 9)], "class string, dist int, occ int, dmg int, n bigint, p_real double, total bigint")
    rescued = {r.child for r in indels.rescue_scored(clusters, bins, inserted=0.0, deleted=0.0).collect()}
    assert rescued >= {b for a, b in want if len(a) != len(b) and edits(a, b) == 1} and rescued <= {b for _, b in want}


@pytest.mark.parametrize("most", [512, 6, 1])
def test_sketches_of_a_bundle_meet_once(spark, most):
    """rows of a bundle travel once, with all their hashes; bundles of very many rows are spread, and lose nothing."""
    rng = random.Random(most)
    rows = [(f"r{i}", f"b{min(i % 40, 25)}", None if i == 7 else rng.choices(range(-9, 9), k=rng.randint(0, 6))) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, bundle string, hashes array<long>")
    found = errors.sketch_hits(df, top=5, most=most)
    assert most < 512 or "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for (a, x, p), (b, y, q) in itertools.permutations(rows, 2):
        hits = len(set(p or ()) & set(q or ()))
        if x == y and a < b and hits >= 2:
            want.setdefault(b, []).append((-hits, a))
    want = {(a, b, -h) for b, held in want.items() for h, a in sorted(held)[:5]}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) > 100 and set(got) == want


@pytest.mark.parametrize("k", [5, 17])
def test_walks_begin_alike_by_numbers_and_by_names(spark, k, monkeypatch):
    """k-mers of reads meet the graph as sorted numbers, in blobs; what they find is what strings find."""
    rng = random.Random(k)
    long = "".join(rng.choices("ACGT", k=400))
    seqs = [long[i : i + rng.randint(k - 1, 60)] for i in (rng.randrange(380) for _ in range(150))]
    seqs += [rc(s) for s in seqs[:40]] + [s[:-3] + rng.choice("ACGTN") + s[-2:] for s in seqs[:60]] + [None, "", "é" + long[:40] + "é", long[50:90].lower(), long[100:160]]
    reads = spark.createDataFrame(list(enumerate(seqs)), "ord int, seq string")
    edges = graph.kmer_edges(reads, k)
    assert "Aggregate" not in edges._jdf.queryExecution().optimizedPlan().toString()  # counted from blobs
    profile = Profile(0.5, 0.1, 0.5, 0.1, 0.01, 0.01)
    for p in (None, profile):
        found = {r.ord: (r.left, r.right, r.extended) for r in graph.extend(reads, edges, k, most=30, profile=p).collect()}
        with monkeypatch.context() as m:
            m.setattr(graph, "LONGEST", 0)  # strings
            named = {r.ord: (r.left, r.right, r.extended) for r in graph.extend(reads, edges, k, most=30, profile=p).collect()}
        assert found == named and len(found) == len(seqs)
    assert k == 5 or sum(bool(a or b) for a, b, _ in found.values()) > 30
    steps = graph.successors(edges, k).select(graph._coded("node"), graph._coded("next")).collect()
    assert sorted(map(tuple, steps)) == sorted(map(tuple, graph._successors(edges, k, graph.SEEN).collect()))
    codes = [r.x for r in edges.select(graph._coded("canon").alias("x")).collect()]
    assert list(graph._unmixed(graph._mixed(np.array(codes), k), k)) == codes


def test_spent_graph_is_removed(spark):
    rows = spark.createDataFrame([(i, "ACGGTCATTGCA" * 2) for i in range(3)], "ord long, seq string")
    edges = tables.written(graph.kmer_edges(rows, 5), "graph")
    assert graph.extend(rows, edges, 5, spend=True).count() == 3
    with pytest.raises(Exception, match="(?i)exist|found"):
        edges.collect()


@pytest.mark.parametrize("hot", [1024, 4])
def test_rows_of_close_pairs_are_dealt_as_blobs(spark, hot, monkeypatch):
    """neither keys nor ids travel; buckets that gather very many rows tell hot keys in between, and lose no pair."""
    monkeypatch.setattr(closepairs, "CHUNK", 40)
    monkeypatch.setattr(closepairs, "GATHERED", 50)
    rng, found = random.Random(hot), {}
    for size in (20, 33, 60):
        for _ in range(3):
            base = "".join(rng.choices("ACGT", k=size))
            for _ in range(60):
                s = list(base)
                for p in rng.sample(range(size), rng.choice((0, 1, 1, 2))):
                    s[p] = rng.choice("ACGT")
                found[min("".join(s), rc("".join(s)))] = rng.randint(1, 3)
    rules = errors.Rules(hot_parts=hot)
    pairs = errors.close_pairs(spark.createDataFrame(list(found.items()), "canon string, n long").repartition(3), rules)
    got = [(r.parent, r.child, r.n_parent, r.n_child, r.turned, r.oriented, r.h) for r in pairs.collect()]
    want = set()
    for (a, n), (b, m) in itertools.permutations(found.items(), 2):
        if len(a) == len(b) and (n > m or (n == m and a < b)):
            for turned, s in ((0, b), (1, rc(b))):
                h = sum(x != y for x, y in zip(a, s, strict=True))
                if 1 <= h <= 2:
                    want.add((a, b, n, m, turned, s, h))
    assert len(got) == len(set(got)) > 300 and set(got) == want
    fit = spark.createDataFrame([("ACGTTGCA" * 8, 3), ("TTGCA" * 7, 1 << 40)], "canon string, n long")
    blobs = closepairs.dealt(fit, 0, 0, True, 5)
    assert blobs.columns == ["bucket", "data"]
    keyed = closepairs.keyed(fit.withColumn("id", errors.F.lit(0).cast("long")), 0, 0, True).collect()
    rows = closepairs._keyed_rows([bytes(r.data) for r in blobs.collect()], 0, 0, True).to_pylist()
    plain = lambda x: (x["key"], x["ref"], x["n"], x["meta"], bytes(x["code"]))
    assert sorted(map(plain, rows)) == sorted(plain(r.asDict()) for r in keyed)


def test_dropped_tables_are_gone(spark):
    table = tables.written(spark.range(5), "some")
    assert table.count() == 5
    tables.dropped(table)
    with pytest.raises(Exception, match="(?i)exist|found"):
        table.collect()


def test_short_sequences_are_told_apart(spark):
    """What joins by sequences carry is another value for each."""
    rng = random.Random(3)
    seqs = ["", "A", "AA", "AAA", "AAAA", "AAAAA", "C", "N", "AN", "ACGT", "ACGN", "acgt", "é", "\x04", "\x00A"] + ["".join(rng.choices("ACGT", k=rng.randint(1, 70))) for _ in range(200)]
    seqs = sorted(set(seqs))
    rows = spark.createDataFrame([(s,) for s in [None, *seqs]], "s string").coalesce(1).select("s", store._short("s").alias("x")).collect()
    assert rows[0].x is None and len({bytes(r.x) for r in rows[1:]}) == len(seqs)
    assert all(len(r.x) == 1 + -(-len(r.s) // 4) for r in rows[1:] if not set(r.s) - set("ACGT"))
