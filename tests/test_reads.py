"""Small exact cases of the read operators."""

import gzip
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import seq as S
from palimpsest.operators import damage, dedup, errors, generate, graph, merge, pairblocks, profile, sorting, store
from palimpsest.sources import fastq
from palimpsest.streaming import counts


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "ord bigint, seq string")


def test_reverse_complement_pair_is_one_molecule(spark):
    pair = frame(spark, ["AAAACCCC", "GGGGTTTT"])
    assert dedup.deduplicate(pair).count() == 1
    assert dedup.deduplicate(pair, both_strands=False).count() == 2


BASE = "GCTTAGGCATACCAGTTGACATGCAAGTCTAGGATCCATG"


@pytest.mark.parametrize("pos,molecules", [(1, 1), (5, 2)])
def test_masked_damage(spark, pos, molecules):
    damaged = BASE[:pos] + "T" + BASE[pos + 1 :]
    base = BASE[:pos] + "C" + BASE[pos + 1 :]
    rows = frame(spark, [base, damaged])
    assert dedup.deduplicate(rows, five=2, three=2).count() == molecules


def test_damaged_reverse_complement_merges(spark):
    damaged = BASE[0] + "T" + BASE[2:]
    base = BASE[0] + "C" + BASE[2:]
    turned = damaged[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert dedup.deduplicate(frame(spark, [base, turned]), five=2, three=2).count() == 1


def test_representative_has_the_greatest_damage_score(spark):
    rows = frame(spark, ["GC" + BASE[2:], "GT" + BASE[2:], "GT" + BASE[2:]])
    found = dedup.deduplicate(rows, five=2, three=2).first()
    assert (found.n, found.rep_ord, found.first_ord) == (3, 1, 0)


def test_longest_mate_wins_and_ties_go_to_the_first(spark):
    rows = spark.createDataFrame([(0, "AAAC", "AA"), (1, "AAAC", "AAAA"), (2, "GTTT", "CCCC")], "ord bigint, ext string, non string")
    found = dedup.deduplicate_pairs(rows).first()
    assert (found.pair_count, found.rep_ord, found.non_len) == (3, 1, 4)


def test_lockstep_errors(spark):
    left = spark.createDataFrame([(0, "a", "A"), (1, "b", "C")], "ord bigint, read_id string, seq string")
    with pytest.raises(ValueError, match="unequal"):
        dedup.require_lockstep(dedup.lockstep(left, left.limit(1)))
    other = left.withColumn("read_id", F.lit("a"))
    with pytest.raises(ValueError, match="IDs differ"):
        dedup.require_lockstep(dedup.lockstep(left, other))
    assert dedup.require_lockstep(dedup.lockstep(left, other), allow_id_mismatch=True).count() == 2


def test_stable_sorts(spark):
    rows = spark.createDataFrame([(0, "read_10"), (1, "read_2"), (2, "read"), (3, "read_2")], "ord bigint, read_id string")
    assert [r.ord for r in sorting.sort_reads(rows).collect()] == [2, 0, 1, 3]
    assert [r.ord for r in sorting.sort_reads(rows, by_number=True).collect()] == [2, 1, 3, 0]


PARENT = "TGACCATTGCAGGATTCACGTCAATGCTAGCCATTAGGCA"
LOW, SURE = "0", "I"


def canon(s):
    return min(s, rc(s))


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def changed(*at, seq=PARENT):
    """seq with the bases at some places replaced by their partner (T and A, C and G), or by a transition."""
    out = list(seq)
    for p, way in at:
        out[p] = dict(zip("ACGT", "TGCA" if way == "v" else "GTAC"))[out[p]]
    return "".join(out)


def with_quality(spark, reads):
    """reads: (sequence, times, places of low quality)."""
    rows = []
    for seq, times, low in reads:
        qual = "".join(LOW if i in low else SURE for i in range(len(seq)))
        rows += [(seq, qual)] * times
    return spark.createDataFrame([(i, s, q) for i, (s, q) in enumerate(rows)], "ord bigint, seq string, qual string")


def test_absorption(spark):
    one, pair, transition = changed((15, "v")), changed((8, "v"), (21, "v")), changed((18, "t"))
    sure, often, worn = changed((24, "v")), changed((10, "v"), (28, "v")), changed((12, "v"), (30, "t"), (1, "v"))
    rows = with_quality(spark, [(PARENT, 100, ()), (one, 1, (15,)), (pair, 1, (8, 21)), (transition, 1, (18,)), (sure, 1, ()), (often, 3, (10, 28)), (worn, 1, (1, 12, 30))])
    clusters = dedup.deduplicate(rows, quality="qual")
    edges = errors.candidate_edges(clusters)
    found = {r.child: r.h for r in edges.filter(F.col("parent") == canon(PARENT)).collect()}
    assert found == {canon(one): 1, canon(pair): 2, canon(sure): 1}
    gone = {r.child: r.root for r in errors.absorbed(clusters, edges).collect()}
    assert gone == {canon(one): canon(PARENT), canon(pair): canon(PARENT)}
    plain = dedup.deduplicate(rows)  # without qualities nothing is sure
    assert canon(sure) in {r.child for r in errors.absorbed(plain, errors.candidate_edges(plain)).collect()}
    protected = errors.vetoed(errors.candidate_edges(plain), errors.Rules(protect_transversions=True))
    assert protected.count() == 0


def test_equal_variants_both_stay(spark):
    other = changed((17, "v"))
    two = dedup.deduplicate(with_quality(spark, [(PARENT, 200, ()), (other, 200, (17,))]), quality="qual")
    assert errors.absorbed(two, errors.candidate_edges(two)).count() == 0
    lone = dedup.deduplicate(with_quality(spark, [(PARENT, 200, ()), (other, 1, (17,))]), quality="qual")
    gone = errors.absorbed(lone, errors.candidate_edges(lone))
    assert [(r.child, r.root) for r in gone.collect()] == [(canon(other), canon(PARENT))]
    assert [(r.n, r.members) for r in errors.roll_up(lone, gone).collect()] == [(201, 2)]


def test_many_deaminated_places(spark):
    seq = "".join("C" if i % 3 else "G" for i in range(20)) + "TGACCATTGCAGGATTCACGTCAATGCTAGCCATTAGGCA"
    worn = seq[:12] + seq[12:19].replace("C", "T") + seq[19:]
    rules = errors.Rules(profile=damage.Profile(0.4, 0.12, 0.4, 0.12))
    rows = frame(spark, [seq] * 60 + [worn])
    clusters = dedup.deduplicate(rows)
    assert errors.merges_deaminated(clusters, rules) and not errors.merges_deaminated(clusters, errors.Rules())
    assert [(r.child, r.root, r.h) for r in errors.merge_deaminated(clusters, rules).collect()] == [(canon(worn), canon(seq), 4)]
    again = dedup.deduplicate(frame(spark, [seq] * 60 + [worn] + ["A" + worn[1:]]))  # the same bases in another bundle
    assert errors.merge_deaminated(again, rules).count() == 0


def test_edges_are_those_of_brute_force(spark):
    import random

    rng = random.Random(5)
    seqs = []
    for _ in range(40):
        s = "".join(rng.choice("ACGT") for _ in range(32))
        seqs += [s] * 3
        for _ in range(3):
            t = list(s)
            for p in rng.sample(range(32), rng.choice([1, 2])):
                t[p] = rng.choice("ACGT")
            seqs.append("".join(t))
    clusters = dedup.deduplicate(frame(spark, seqs)).cache()
    table = {r.canon: r.n for r in clusters.collect()}
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = set()
    for p, c in itertools.permutations(table, 2):
        if table[p] > table[c] or (table[p] == table[c] and p < c):
            for o in (c, rc(c)):
                mm = [(i, a, b) for i, (a, b) in enumerate(zip(p, o)) if a != b]
                bad = any((a + b in ("CT", "TC") and i < 5) or (a + b in ("GA", "AG") and i >= 27) for i, a, b in mm)
                if (len(mm) == 1 and mm[0][1] + mm[0][2] in ("AT", "TA", "CG", "GC")) or (len(mm) == 2 and table[c] <= 2 and not bad):
                    want.add((p, c))
    assert {(r.parent, r.child) for r in errors.candidate_edges(clusters).collect()} == want


def test_ascent_is_the_serial_replay(spark):
    """Edges one by one, in order, each with the counts of the cluster that holds the parent by then."""
    import random

    rng, seqs = random.Random(8), []
    for _ in range(12):
        s = "".join(rng.choice("ACGT") for _ in range(44))
        seqs += [(s, rng.choice([3, 9, 40]), ())]
        for _ in range(5):
            at = rng.sample(range(12, 32), rng.choice([1, 2, 2]))
            t = changed(*((p, "v") for p in at), seq=s)
            seqs.append((t, 1, at))
            more = rng.sample(range(12, 32), 2)
            seqs.append((changed(*((p, "v") for p in more), seq=t), 1, (*at, *more)))
    clusters = dedup.deduplicate(with_quality(spark, seqs), quality="qual")
    scored = errors.edge_scores(errors.candidate_edges(clusters), clusters)
    kept = errors.vetoed(scored).collect()
    known = {r.canon: (r.n, r.occ) for r in errors.occupancy(clusters).select("canon", "n", S.occupancy_bin(F.col("occupancy")).alias("occ")).collect()}
    root = {}
    for r in sorted(kept, key=lambda r: (-r.n_parent, r.parent, r.mm[0].pos, r.mm[0].b, r.child)):
        top = root.get(r.parent, r.parent)
        n, occ = known[top]
        if r.child not in root and r.terms[occ] + len(r.mm) * math.log((n + 1) / (r.n_child + 1)) + r.adjust > 0:
            root[r.child] = top
    assert {r.child: r.root for r in errors.ascend(errors.vetoed(scored), clusters).collect()} == root
    assert len(root) > 20 and any(root[c] != p for c, p in ((r.child, r.parent) for r in kept) if c in root)


def test_extension_walks_a_genome(spark):
    import random

    rng = random.Random(2)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    rows = frame(spark, [genome[i : i + 60] for i in range(0, 240, 3)] * 2)
    found = graph.extend(rows, graph.kmer_edges(rows), most=40)
    for r in found.filter("ord between 20 and 40").collect():
        assert r.extended in genome and len(r.right) == 40 and len(r.left) >= 20


def test_walks_from_inner_anchors(spark):
    """Serial walks over a dictionary of the same edges, from the last k-mer that adds bases."""
    import random

    rng, k = random.Random(6), 7
    genome = "".join(rng.choice("ACGT") for _ in range(160))
    seqs = [genome[i : i + 30] for i in range(0, 130, 2)] * 2
    seqs += [s[:-2] + "AC" for s in seqs[3:20]]  # ends that no other read supports
    rows = frame(spark, seqs)
    edges = graph.kmer_edges(rows, k)
    steps = {r.node: (r.base, r.next) for r in graph.successors(edges, k).collect()}

    def walk(node, most=12):
        out = ""
        while node in steps and len(out) < most:
            base, node = steps[node]
            out += base
        return out

    def side(s):
        for back in range(len(s) - k + 1):
            more = walk(s[len(s) - k - back : len(s) - back], 12 + back)[back:]
            if more:
                return more
        return ""

    found = {r.ord: (r.left, r.right) for r in graph.extend(rows, edges, k, most=12).collect()}
    assert found == {i: (rc(side(rc(s))), side(s)) for i, s in enumerate(seqs)}
    assert any(side(s) and not walk(s[-k:]) for s in seqs)


def serial_sides(s, counts, k, seen, most, p):
    """Right and left extension of one read, a base at a time, over counts of (k-mer, next base)."""

    def ahead(node):
        return {b: counts[node, b] for b in "ACGT" if counts[node, b] >= seen}

    def walk(node, back, d, rate, base):
        out = ""
        while len(out) < most + back:
            found, place, sure = ahead(node), back - 1 - len(out), False
            pick = next(iter(found)) if len(found) == 1 else None
            if len(found) == 2 and p is not None and place >= 0 and set(found) in ({"C", "T"}, {"A", "G"}):
                whole, changed = ("C", "T") if "C" in found else ("G", "A")
                ratio = found[changed] / sum(found.values())
                if ratio <= min(0.25, d * math.exp(-rate * place) + base + 0.05) and found[whole] >= 2 * found[changed]:
                    pick, sure = whole, True
            if pick is None:
                break
            after = node[1:] + pick
            if not sure and len(ahead(rc(after))) != 1:
                break
            out, node = out + pick, after
        return out[back:]

    def side(s, *rates):
        return next((more for back in range(len(s) - k + 1) if (more := walk(s[len(s) - k - back : len(s) - back], back, *rates))), "")

    own = (p.d3, p.l3, p.bg3), (p.d5, p.l5, p.bg5)
    return rc(side(rc(s), *own[1])), side(s, *own[0])


def test_damaged_branches_are_passed_inside_reads(spark):
    """Walks equal serial ones over reads with planted C>T at the 5' and G>A at the 3' end."""
    import collections
    import random

    rng, k = random.Random(4), 9
    genome = "".join(rng.choice("ACGT") for _ in range(700))
    p = damage.Profile(0.4, 0.3, 0.35, 0.3, 0.01, 0.02)
    seqs = []
    for _ in range(420):
        at, size = rng.randrange(660), rng.randrange(20, 50)
        s = list(genome[at : at + size])
        for i in range(len(s)):
            if s[i] == "C" and rng.random() < p.d5 * math.exp(-p.l5 * i):
                s[i] = "T"
            if s[-1 - i] == "G" and rng.random() < p.d3 * math.exp(-p.l3 * i):
                s[-1 - i] = "A"
        seqs.append("".join(s) if rng.random() < 0.5 else rc("".join(s)))
    seqs += [seqs[0][:k], seqs[0][: k - 1], "N" * 30, seqs[1][:12] + "N" + seqs[1][13:]]
    rows = frame(spark, seqs)
    edges = graph.kmer_edges(rows, k)
    counts = collections.Counter()
    for r in edges.collect():
        for c, node in (("f", r.canon), ("r", rc(r.canon))):
            counts.update({(node, b): r[f"{c}_{b}"] for b in "ACGT"})
    found = {r.ord: (r.left, r.right) for r in graph.extend(rows, edges, k, most=25, profile=p).collect()}
    want = {i: serial_sides(s, counts, k, 2, 25, p) if len(s) >= k else ("", "") for i, s in enumerate(seqs)}
    assert found == want
    plain = {r.ord: (r.left, r.right) for r in graph.extend(rows, edges, k, most=25).collect()}
    assert sum(a != b for a, b in zip(found.values(), plain.values(), strict=True)) > 0 and sum(len(a + b) for a, b in found.values()) > sum(len(a + b) for a, b in plain.values())


def test_damaged_branch_depends_on_its_place(spark):
    """One branch, a fifth changed: passed where damage is that likely, not with less of it."""
    stem, rest = "ACGTTGCATCAGGA", "CATTGCCGATAAGCTTAC"
    changed = stem + "T" + rest[1:]
    seqs = [stem + rest] * 16 + [changed] * 4 + [stem + "G"]  # the last read ends with a base that no other has
    seqs += [(stem + rest)[2:26]] * 2
    rows = frame(spark, seqs)
    edges = graph.kmer_edges(rows, 7)
    last = lambda p: graph.extend(rows, edges, 7, most=9, profile=p).filter(f"ord = {20}").first().right
    assert last(damage.Profile(0.3, 0.3, 0.3, 0.3, 0.0, 0.0)) == "ATTGCC"
    assert last(damage.Profile(0.05, 0.3, 0.05, 0.3, 0.0, 0.0)) == ""


def serial_overlap(x, qx, y, qy, o):
    """The rules of merge.overlaps for one pair, one place at a time: phase, overlap, begin in y."""
    low = lambda i, j: min(ord(qx[i]), ord(qy[j])) - 33
    unlike = lambda a, b: a != b and "N" not in (a, b)

    def find(s, adapter, first, most, size):
        want = adapter[:size]
        for i in range(first, len(s) - len(want) + 1):
            if sum(s[i + j] != w for j, w in enumerate(want)) <= most:
                return i
        return -1

    def fits(k, rate):
        at = len(y) - k
        return k >= o.min_overlap and at >= 0 and k <= len(x) and sum(low(i, at + i) / 30 for i in range(k) if unlike(x[i], y[at + i])) / k <= rate

    p1, p2 = find(x, o.adapter1, o.min_overlap, 2, 12), find(y, rc(o.adapter2[:12]), 0, 2, 12)
    ov2 = len(y) - p2 - 12 if p2 >= 0 else -1
    good = [k for k in (p1, ov2) if k >= o.min_overlap]
    if good:
        k = p1 if len(good) == 2 and abs(p1 - ov2) <= 2 else min(good)
        if k <= len(y):
            return 0, k, len(y) - k
    for size, most, share in ((8, 1, 1.0), (6, 0, 0.6)):
        k = find(x, o.adapter1, o.min_overlap, most, size)
        if fits(k, o.max_mm_rate * share):
            return 2, k, len(y) - k
    for t in range(5, 0, -1):
        if x.endswith(o.adapter1[:t]):
            if fits(len(x) - t, o.max_mm_rate * 0.5):
                return 3, len(x) - t, len(y) - len(x) + t
            break
    best, grace, total = -1, 0, 0.0
    for k in range(1, min(len(x), len(y)) + 1):
        total += low(k - 1, k - 1) / 30 if unlike(x[k - 1], y[k - 1]) else 0
        if k >= o.min_overlap:
            if total / k <= 0.10:
                best, grace = k, 0
            elif best >= 0:
                grace += 1
                if grace >= 4:
                    break
    if best >= 0:
        return 4, best, 0
    for k in range(o.min_overlap, min(len(x), len(y)) + 1):
        misses = sum(unlike(a, b) for a, b in zip(x[len(x) - k :], y))
        if misses / k <= o.max_mm_rate:
            best = k
        elif best >= 0 and misses - int(best * o.max_mm_rate) >= 3:
            break
    return (5, best, 0) if best >= 0 else (-1, 0, 0)


def test_overlaps_are_those_of_one_pair_at_a_time():
    import random

    import numpy as np

    rng, o = random.Random(12), merge.Options()
    seen = set()
    for _ in range(60):
        la, lb, pairs = rng.randint(30, 60), rng.randint(30, 60), []
        for _ in range(20):
            insert = "".join(rng.choice("ACGT") for _ in range(rng.choice([12, 20, rng.randint(25, 58), la - rng.randint(1, 8), 80])))
            one, two = (insert + o.adapter1 * 3)[:la], (rc(insert) + o.adapter2 * 3)[:lb]
            noise = lambda s: "".join(rng.choice("ACGTN") if rng.random() < 0.04 else c for c in s)
            qual = lambda n: "".join(chr(33 + rng.randint(2, 40)) for _ in range(n))
            pairs.append((noise(one), qual(la), rc(noise(two)), qual(lb)))
        grid = lambda j: np.array([list(p[j].encode()) for p in pairs], np.uint8)
        got = merge.overlaps(grid(0), grid(1).astype(int) - 33, grid(2), grid(3).astype(int) - 33, o)
        want = [serial_overlap(*p, o) for p in pairs]
        assert list(zip(*(x.tolist() for x in got))) == [(p, k, at if p >= 0 else 0) for p, k, at in want]
        seen |= {p for p, _, _ in want}
    assert seen == {-1, 0, 2, 3, 4, 5}


def test_models_round_trip_and_guard_their_input(spark, tmp_path):
    rows = frame(spark, ["ACGTACGT", "TTTTACGA"])
    p = damage.Profile(0.2, 0.3, 0.1, 0.4, 0.02, 0.03, mask=(True, False))
    lods = spark.createDataFrame([(0, 1, 5, 0.5, -0.5)], "bin int, pos int, end int, lod_hit double, lod_ref double")
    of = profile.digest(rows)
    assert of == profile.digest(rows.orderBy(F.desc("ord"))) != profile.digest(rows.limit(1))
    profile.save_model(spark, f"{tmp_path}/m", p, of, 0.25, lods)
    assert profile.load_model(spark, f"{tmp_path}/m", of) == (p, 0.25)
    assert spark.read.parquet(f"{tmp_path}/m/lods").collect() == lods.collect()
    with pytest.raises(ValueError, match="another input"):
        profile.load_model(spark, f"{tmp_path}/m", "x")
    assert profile.load_model(spark, f"{tmp_path}/m", "x", override=True)[0] == p
    table = profile.profile_table(profile.end_counts(rows), p)
    profile.write_tsv(table, f"{tmp_path}/tsv", "pos")
    lines = "".join(x.read_text() for x in sorted((tmp_path / "tsv").glob("part-*"))).splitlines()
    assert lines[0].split("\t")[:3] == ["pos", "end5", "freq5"] and len(lines) == 1 + table.count()
    profile.write_cluster_tsv(dedup.cluster_table(dedup.deduplicate(rows)), f"{tmp_path}/clusters")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/clusters").count() == 2


def test_thresholds_and_fits():
    import numpy as np

    assert profile.split_threshold(0.0, "detected", 0.5) == 0 and profile.split_threshold(0.0, "detected", 0.2) > 1.3
    assert profile.split_threshold(0.0, "low_abundance", 0.01, 2.5) == 2.5 and profile.split_threshold(0.0, "abstain", 0.0) == math.inf
    assert profile.dedup_threshold(0.0, 0.15) == 0 and profile.dedup_threshold(0.0, 0.29) < 0
    places = np.arange(15)
    d, rate, background = profile.decay_by_grid(0.02 + 0.3 * np.exp(-0.4335 * places), np.full(15, 1000))
    assert abs(d - 0.3) < 0.02 and abs(rate - 0.4335) < 0.04 and abs(background - 0.02) < 0.005
    assert profile.decay_by_grid(np.zeros(15), np.r_[np.zeros(13), 1, 1])[0] == -1
    assert profile.mask_from_model(damage.Profile(0.2, 0.5, 0.1, 0.5), 0.05, 4) == (True, True, True, False)
    assert merge.resolve_library(None, "ss", "ds", 0.9)[1] and merge.resolve_library("ds", "ss", "ds", 0.9) == ("ds", None)
    with pytest.raises(ValueError):
        merge.resolve_library(None, "ss", "ds", 0.9, strict=True)


def test_merge_finds_the_insert(spark):
    import random

    rng = random.Random(3)
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    short = "".join(rng.choice("ACGT") for _ in range(30))
    long = "".join(rng.choice("ACGT") for _ in range(80))
    apart = "".join(rng.choice("ACGT") for _ in range(200))
    mates = [((short + merge.ADAPTER1)[:50], (rc(short) + merge.ADAPTER2)[:50]), (long[:50], rc(long)[:50]), (apart[:50], rc(apart)[:50]), (None, "ACGT")]
    rows = spark.createDataFrame([(i, f"@r{i}/1", a, a and "I" * len(a), b, "I" * len(b)) for i, (a, b) in enumerate(mates)], "ord bigint, header string, seq1 string, qual1 string, seq2 string, qual2 string")
    found = {r.ord: r for r in merge.merge_pairs(rows).collect()}
    assert (found[0].route, found[0].phase, found[0].seq, found[0].header) == ("merged", 0, short, "@r0")
    assert (found[1].route, found[1].phase, found[1].seq) == ("merged", 5, long)
    assert set(found[0].qual) == {chr(60 + 33)}
    assert found[2].route == "unmerged" and found[3].route == "dropped"


def test_profile_recovers_damage(spark):
    rows = generate.generate(spark, n=30_000, damaged=1.0, d5=0.3, d3=0.3, l5=0.3, l3=0.3, seed=4)
    p = damage.fit_profile(rows)
    assert abs(p.d5 - 0.3) < 0.08 and abs(p.d3 - 0.3) < 0.08 and p.mask[0]
    clean = damage.fit_profile(generate.generate(spark, n=30_000, damaged=0.0, seed=5))
    assert clean.d5 < 0.02 and not any(clean.mask)


def test_scores_tell_damaged_reads(spark):
    p = damage.Profile(0.3, 0.3, 0.3, 0.3, 0.5, 0.5)
    rows = generate.generate(spark, n=20_000, damaged=0.5, d5=0.6, d3=0.6, seed=6)
    mean = {r.label: r.m for r in rows.select("label", damage.llr("seq", p).alias("llr")).groupBy("label").agg(F.avg("llr").alias("m")).collect()}
    assert mean["damaged"] > mean["undamaged"] + 0.1


def test_generator_does_not_depend_on_partitions(spark):
    a = generate.generate(spark, n=500, seed=9).collect()
    b = generate.generate(spark, n=500, seed=9).repartition(7).orderBy("ord").collect()
    assert a == b


def test_library_types():
    assert damage.library_type({"ct5": (300, 1000), "ga3": (300, 1000), "ct3": (20, 1000)}, 0.02, 0.02) == "ds"
    assert damage.library_type({"ct5": (300, 1000), "ga3": (20, 1000), "ct3": (300, 1000)}, 0.02, 0.02) == "ss"
    assert damage.library_type({"ct5": (20, 1000), "ga3": (20, 1000), "ct3": (20, 1000)}, 0.02, 0.02) == "none"
    assert merge.polyg_threshold(0.25) == 5 and merge.geometry(0.1)[0] == "ss" and merge.geometry(0.1, 200, 0.2)[0] == "ds"


FASTQ = "@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\nII\n"


def test_fastq_plain_equals_gzip(spark, tmp_path):
    (tmp_path / "a.fq").write_text(FASTQ)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(FASTQ)
    spark.dataSource.register(fastq.FastqSource)
    read = lambda p: [(r.read_id, r.seq, r.qual) for r in spark.read.format("fastq").load(str(p)).orderBy("ord").collect()]
    assert read(tmp_path / "a.fq") == read(tmp_path / "b.fq.gz") == [("r1", "ACGT", "IIII"), ("r2", "GG", "II")]
    lanes = spark.read.format("fastq").load(f"{tmp_path}/a.fq,{tmp_path}/b.fq.gz").orderBy("ord").collect()
    assert [r.read_id for r in lanes] == ["r1", "r2", "r1", "r2"]
    binary = fastq.read_fastq(spark, f"{tmp_path}/a.fq", f"{tmp_path}/b.fq.gz").orderBy("ord").collect()
    assert [(r.ord, r.seq) for r in binary] == [(r.ord, r.seq) for r in lanes]
    fastq.write_fastq(fastq.read_fastq(spark, f"{tmp_path}/a.fq"), f"{tmp_path}/out")
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == FASTQ


@pytest.mark.parametrize("cut", [3, 12, 20])
def test_truncated_fastq_fails(spark, tmp_path, cut):
    (tmp_path / "t.fq").write_text("\n".join(FASTQ.split("\n")[:6]) + "\n")
    data = gzip.compress((FASTQ * 50).encode())
    (tmp_path / "t.fq.gz").write_bytes(data[: len(data) - cut])
    for name in ("t.fq", "t.fq.gz"):
        with pytest.raises(Exception, match="Truncated FASTQ"):
            fastq.read_fastq(spark, f"{tmp_path}/{name}").count()


def test_adapters_and_names():
    got = fastq.adapters(">a\nACGT\nAA\n>b\nTTTT\n>c\nGG\n")
    assert got == {"r1": ["ACGTAA", "GG"], "r2": ["TTTT"], "r2_front": ["AAAA"]}
    assert fastq.final_name("x.fq.gz.tmp") == "x.fq.gz" and fastq.final_name("x.fq") == "x.fq"


def test_one_edit_functions(spark):
    row = spark.range(1).select(
        S.one_deletion(F.lit("ACGT"), F.lit("AGT")).alias("a"), S.one_deletion(F.lit("ACGT"), F.lit("GGT")).alias("b"), S.clip_stubs(F.lit("A" * 20 + "TTTCCC" * 2), [], ["TTTCCC"]).alias("c"),
        S.find_tolerant(F.lit("AAAAAGATCGGAAGAGC"), "AGATCGGAAGAGC").alias("d"), S.adapter_tail(F.lit("CCCAGA"), "AGATC").alias("e"), S.revcomp(F.lit("ACGTNRacg")).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (True, False, "A" * 20, 4, 3, "cgtNNACGT")
    assert S.mismatch_tolerance(60, 0, 0.5, 0, 0.5)[1] == 0 and S.mismatch_tolerance(60, 0.3, 0.3, 0.3, 0.3)[1] >= 3


def test_store_views(spark, tmp_path):
    clusters = spark.createDataFrame([("AAAA", 5, 0), ("AAAT", 2, 7), ("CCCC", 2, 3), ("ATTA", 1, 9)], "canon string, n bigint, first_ord bigint")
    gone = spark.createDataFrame([("AAAT", "AAAA", "AAAA", 1.0), ("ATTA", "AAAA", "AAAT", 2.0)], "child string, root string, parent string, score double")
    edges = spark.createDataFrame([("AAAA", "AAAT", 0, [(3, "A", "T")]), ("AAAT", "ATTA", 1, [(1, "A", "A"), (3, "T", "T")]), ("AAAA", "ATTA", 0, [(1, "A", "T"), (2, "A", "T")])], "parent string, child string, turned int, mm array<struct<pos:int,a:string,b:string>>")
    store.write_store(store.genealogy(clusters, gone, edges), f"{tmp_path}/store")
    kept = spark.read.parquet(f"{tmp_path}/store")
    assert store.header(kept).first().asDict() == {"clusters": 2, "members": 10, "edges": 2}
    assert [(r.cluster_id, r.n_members, r.n_edges) for r in store.top(kept).collect()] == [(0, 8, 2), (3, 2, 0)]
    assert {r.node: r.line for r in store.grid(kept).collect()} == {"AAAA": "....", "CCCC": "....", "AAAT": "...T", "ATTA": "T..T"}  # TAAT, as it stands turned
    reads = frame(spark, ["aaat", "GGGG", "ACAC", "ATTA"]).withColumn("read_id", F.concat(F.lit("r"), "ord"))
    assert [r.cluster_id for r in store.member_of(kept, reads).orderBy("ord").collect()] == [0, 3, -1, 0]
    assert sorted((r.cluster_id, r.member_id) for r in store.members(kept, reads).collect()) == [(0, "r0"), (0, "r3"), (3, "r1")]
    assert [(r.depth, r.parent, r.node) for r in store.tree(kept, 0).collect()] == [(1, "AAAA", "AAAT"), (2, "AAAT", "ATTA")]
    steps = {(r["from"], r.to, r.pos) for r in store.steps(kept).collect()}
    assert steps == {("AAAA", "AAAT", 3), ("AAAT", "ATTA/1", 1), ("ATTA/1", "ATTA", 3)}
    assert store.bundles(kept, end=2, least=1).count() == 2 and store.bundle_grid(kept, "AA", "AA", 4, 2).count() == 3
    nodes = spark.createDataFrame([(1, "ACGT")] * 80 + [(1, "ACGA")], "cluster_id bigint, seq string")
    found = store.consensus(nodes).first()
    # p = (top + 1) / (N + 4): 82/85 is Q14 (/), 81/85 is Q13 (.)
    assert (found.consensus, found.qual) == ("ACGT", "///.")


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    rows = frame(spark, ["ACGTACGTACGTACGTACGTACGTACGTACGTACGT", "TTTTACGTACGTACGTACGTACGTACGTACGTAAAA"] * 20)
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    counts.accumulate(stream, damage.terminal_counts, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    got = counts.total(spark, f"{tmp_path}/out", ["pos"]).orderBy("pos").collect()
    assert got == damage.terminal_counts(rows).select(*counts.total(spark, f"{tmp_path}/out", ["pos"]).columns).orderBy("pos").collect()


def test_streamed_molecules_are_seen_once(spark, tmp_path):
    rows = spark.createDataFrame([("ACCC", "2024-01-01 00:00:00"), ("GGGT", "2024-01-01 00:10:00"), ("ACCT", "2024-01-01 00:20:00")], "seq string, at string").selectExpr("seq", "to_timestamp(at) AS ts")
    rows.write.parquet(f"{tmp_path}/in")
    stream = counts.first_seen(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.canon for r in spark.sql("SELECT canon FROM seen").collect()) == ["ACCC", "ACCT"]


def test_sketch_hits_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(4)
    rows = [(f"m{i:03d}", f"b{i % 3}", rng.sample(range(30), 6) + [7]) for i in range(90)]
    table = spark.createDataFrame(rows, "id string, bundle string, hashes array<bigint>")
    want = set()
    for y, by, hy in rows:
        hits = sorted(((-len(set(hx) & set(hy)), x) for x, bx, hx in rows if x < y and bx == by and len(set(hx) & set(hy)) >= 2))
        want |= {(x, y, -n) for n, x in hits[:5]}
    assert {(r.a, r.b, r.hits) for r in errors.sketch_hits(table, top=5).collect()} == want


@pytest.mark.parametrize("rules", [errors.Rules(five=3, three=1), errors.Rules(hot_parts=1), errors.Rules(five=2, three=2, hot_parts=1)])
def test_close_pairs_are_those_of_brute_force(spark, rules):
    """Keys that travel are numbers, without sequences, and lose no pair: with ends left out, and where every
    key that two clusters share is split."""
    rng = random.Random(7)
    found = {}
    for _ in range(25):
        base = "".join(rng.choice("ACGT") for _ in range(rng.choice((30, 31))))
        for _ in range(6):
            s = list(base)
            for p in rng.sample(range(len(s)), rng.choice((0, 1, 2, 3))):
                s[p] = rng.choice("ACGT")
            s = "".join(s)
            turned = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
            found[min(s, turned)] = found.get(min(s, turned), 0) + rng.randint(1, 3)
    cut = lambda s: s[rules.five : len(s) - rules.three]
    want = set()
    for (a, n), (b, m) in itertools.permutations(found.items(), 2):
        if len(a) == len(b) and (n > m or (n == m and a < b)):
            for turned, s in ((0, b), (1, b[::-1].translate(str.maketrans("ACGT", "TGCA")))):
                if 1 <= sum(x != y for x, y in zip(cut(a), cut(s), strict=True)) <= 2:
                    want.add((a, b, turned, s))
    clusters = spark.createDataFrame(list(found.items()), "canon string, n bigint")
    keys = errors.routed(errors.eligible(clusters, rules).withColumn("id", F.monotonically_increasing_id()), rules)
    assert dict(keys.dtypes) == {"key": "bigint", "ref": "bigint"}
    rows = errors.close_pairs(clusters, rules).select("parent", "child", "turned", "oriented").collect()
    assert len(rows) == len(want) > 20 and {tuple(r) for r in rows} == want


def test_molecules_are_grouped_by_numbers(spark):
    """Without masked ends no string goes through the aggregation, which so needs no sort."""
    found = dedup.deduplicate(frame(spark, [BASE, BASE, S_TURNED]), strand=True)
    assert "SortAggregate" not in found._jdf.queryExecution().toString()
    assert found.select("n", "fwd_n", "rep_ord", "first_ord", "first_fwd", "seq").first() == (3, 2 if BASE < S_TURNED else 1, 0, 0, BASE < S_TURNED, min(BASE, S_TURNED))


S_TURNED = BASE[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_candidates_are_settled_by_words_of_their_bases(spark):
    """Two words tell the differences among the first 62 bases; longer reads are told apart by their letters."""
    rng = random.Random(3)
    base = "".join(rng.choice("ACGT") for _ in range(80))
    other = lambda s, *at: "".join("CGTA"["ACGT".index(x)] if i in at else x for i, x in enumerate(s))
    pairs = [(base[:n], other(base[:n], *at)) for n in (20, 31, 32, 60, 80) for at in ((), (0, 19), (3, 7, 11))] + [("T" * 62, "A" * 62)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    apart = sum((errors.differing(errors.packed(F.col("a"), i), errors.packed(F.col("b"), i)) for i in range(errors.WORDS)), F.lit(0))
    assert [(r.a, r.b, r.x) for r in rows.withColumn("x", apart).collect()] == [(a, b, sum(x != y for x, y in zip(a, b, strict=True))) for a, b in pairs]
    long = [base, other(base, 70), other(base, 5, 79), other(base, 64, 70, 79)]
    found = errors.close_pairs(spark.createDataFrame([(s, 9 - i) for i, s in enumerate(long)], "canon string, n bigint")).select("parent", "child", "h").collect()
    assert {tuple(r) for r in found} >= {(long[0], long[1], 1), (long[0], long[2], 2)} and (long[0], long[3], 3) not in {tuple(r) for r in found}


def test_finer_keys_are_made_of_hot_clusters_only(spark, monkeypatch):
    """Where a few keys are hot, the other clusters' keys are not made again."""
    rng, made, own = random.Random(5), [], errors.routed
    half = "".join(rng.choice("ACGT") for _ in range(20))
    hot = [half + "".join(rng.choice("ACGT") for _ in range(20)) for _ in range(8)]
    cold = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(50)]

    def watched(fit, rules, fine=False):
        if fine:
            made.append({r.canon for r in fit.select("canon").collect()})
        return own(fit, rules, fine)

    monkeypatch.setattr(errors, "routed", watched)
    errors.close_pairs(spark.createDataFrame([(s, 1) for s in hot + cold], "canon string, n bigint"), errors.Rules(hot_parts=3)).count()
    assert made == [set(hot)]


def test_worst_windows_of_blocks_are_those_of_the_expression(spark):
    rng = random.Random(11)
    seqs = [None, "", "ACGT", "A" * 20, "ACGTN" * 9, *("".join(rng.choice(letters) for _ in range(n)) for letters in ("ACGT", "AC", "A") for n in (19, 20, 21, 60, 300))]
    rows = spark.createDataFrame(list(enumerate(seqs)), "ord bigint, seq string")
    found = rows.select(pairblocks.worst_windows("seq").alias("a"), S.worst_window("seq").alias("b")).collect()
    for r in found:
        assert (r.a.entropy is None) == (r.b.entropy is None) and (r.a.dominance is None) == (r.b.dominance is None)
        assert r.a.entropy is None or (r.a.entropy == pytest.approx(r.b.entropy) and r.a.dominance == pytest.approx(r.b.dominance))


def test_mates_meet_by_position_however_their_streams_are_cut(spark, tmp_path):
    """Each stream is written by several tasks, into files of other sizes."""
    rows = spark.range(50).select(F.col("id").alias("ord"), F.concat(F.lit("@r"), "id").alias("header"), F.lit("ACGT").alias("seq"), F.lit("+").alias("plus"), F.lit("IIII").alias("qual"))
    streams = []
    for name, at in (("a", 10), ("b", 33)):
        files = []
        for i, part in enumerate((rows.filter(F.col("ord") < at), rows.filter(F.col("ord") >= at))):
            fastq.write_fastq(part.coalesce(1).withColumn("seq", F.concat("seq", F.translate(F.col("ord").cast("string"), "0123456789", "ACGTACGTAC"))).withColumn("qual", F.repeat(F.lit("I"), F.length("seq"))), str(tmp_path / f"{name}{i}"))
            files += fastq.parts_of(spark, str(tmp_path / f"{name}{i}"))
        streams.append(fastq.read_fastq(spark, *files))
    found = fastq.paired(*streams).orderBy("ord").collect()
    assert [r.ord for r in found] == list(range(50)) and all(r.seq1 == r.seq2 for r in found) and [r.header for r in found] == [f"@r{i}" for i in range(50)]
