"""Estimators: planted parameters come back from tables made of them, and tables equal slow counts."""

import collections
import itertools
import math
import random

import numpy as np
import pytest

from palimpsest.operators import errors, indels, lengthmix, overhang, oxidation, split
from palimpsest.operators.damage import Profile, llr


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "ord bigint, seq string")


def some_reads(n, low, high, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices("ACGTN", [30, 20, 20, 29, 1], k=rng.randrange(low, high))) for _ in range(n)]


# ---- Overhangs


def expected_cells(spark, pi, s5, s3, r5, r3, t5=0.3, t3=0.3, n=2e9, bin_=0, skew=1.0):
    """Cells of the model: marks of an undamaged place have t; a damaged molecule's overhang covers place p with
    s^(p+1), and a covered place is marked with t + r in place of t. skew lengthens overhangs at one end only."""
    cover = lambda s: [(1 - s, 0), (s - s**4, 1), (s**4 - s**7, 2), (s**7, 3)]  # places of PLACES that are covered
    out = collections.Counter()
    for kind, chance in ((0, 1 - pi), (1, pi)):
        for (w5, k5), (w3, k3) in itertools.product(cover(s5) if kind else [(1, 0)], cover(s3) if kind else [(1, 0)]):
            p = [t5 + r5 * (i < k5) for i in range(3)] + [t3 + r3 * (i < k3) for i in range(3)] + [t5] * 3 + [t3] * 3
            for code in range(4096):
                bits = [(code >> i) & 1 for i in range(12)]
                out[code] += chance * w5 * w3 * math.prod(q if b else 1 - q for q, b in zip(p, bits, strict=True))
    return spark.createDataFrame([(bin_, "ds", c, round(x * n)) for c, x in out.items()], "bin int, channel string, code int, n bigint")


@pytest.mark.parametrize(("pi", "s5", "s3"), [(0.2, 0.6, 0.55), (0.4, 0.7, 0.5), (0.05, 0.5, 0.5)])
def test_planted_overhangs_come_back(spark, pi, s5, s3):
    found = overhang.fit_overhang(expected_cells(spark, pi, s5, s3, 0.35, 0.3))
    assert found.reason == "" and found.bin == 0
    assert found.pi == pytest.approx(pi, abs=0.003) and found.solved_far == pytest.approx(pi, abs=0.01)
    assert (found.s5, found.s3) == pytest.approx((s5, s3), abs=1e-3)
    assert (found.rate5, found.rate3) == pytest.approx((0.35, 0.3), rel=0.02)
    assert found.term5 == pytest.approx(s5 * 0.35, rel=0.02) and 0 < found.se < 0.05


def test_overhang_guards_name_their_reason(spark):
    assert overhang.fit_overhang(expected_cells(spark, 0.2, 0.6, 0.6, 0.3, 0.3, n=4e4)).reason == "no_bin"
    none = overhang.fit_overhang(expected_cells(spark, 0.0, 0.6, 0.6, 0.3, 0.3))
    assert none.reason != "" and none.pi is None
    assert overhang.fit_overhang(expected_cells(spark, 0.2, 0.6, 0.6, 0.3, 0.3).limit(0)).reason == "no_bin"
    # Marks that go together at one end without the other: the same end no longer fits the cross-end decay.
    rows = [(r.code, r.n) for r in expected_cells(spark, 0.2, 0.6, 0.6, 0.35, 0.35).collect()]
    bent = [(0, "ds", c, n + (n // 5 if (c & 0b101) == 0b101 else 0)) for c, n in rows]
    found = overhang.fit_overhang(spark.createDataFrame(bent, "bin int, channel string, code int, n bigint"))
    assert found.pi is None and found.reason == "overhang_s5_mismatch" and found.solved is not None


def test_overhang_cells_by_hand(spark):
    seqs = [*some_reads(400, 25, 140), "T" * 30, "a" * 49, None]
    want = collections.Counter()
    for s in seqs:
        if not s or len(s) < 30:
            continue
        s = s.upper()
        n, q = len(s), len(s) // 4
        for channel, base in (("ds", "A"), ("ss", "T")):
            bits = [s[p] == "T" for p in (0, 3, 6)] + [s[n - 1 - p] == base for p in (0, 3, 6)] + [s[q + p] == "T" for p in (0, 3, 6)] + [s[n - 1 - q - p] == base for p in (0, 3, 6)]
            want[sum(n >= x for x in (50, 70, 90, 120)), channel, sum(b << i for i, b in enumerate(bits))] += 1
    cells = overhang.overhang_cells(frame(spark, seqs))
    assert {(r.bin, r.channel, r.code): r.n for r in cells.collect()} == want
    row = overhang.overhang_covariances(cells).filter("bin = 0 AND channel = 'ds'").first()
    marks = np.array([[(c >> i) & 1 for i in range(12)] for (b, ch, c), k in want.items() if (b, ch) == (0, "ds") for _ in range(k)], float)
    cov = lambda i, j: np.cov(marks[:, i], marks[:, j], bias=True)[0, 1]
    assert row.cross_00 == pytest.approx(cov(0, 3) - cov(6, 9)) and row.three_6 == pytest.approx(cov(3, 5) - cov(9, 11)) and row.five_3 == pytest.approx(cov(0, 1) - cov(6, 7))


# ---- Lengths


def lengths(spark, *parts, seed=2):
    rng = np.random.default_rng(seed)
    sizes = np.concatenate([np.exp(rng.normal(math.log(m), d, n)) for m, d, n in parts]).round().astype(int)
    return spark.createDataFrame([(int(x), int(c)) for x, c in collections.Counter(np.clip(sizes, 30, 500)).items()], "size int, n bigint")


def test_edges_of_planted_parts(spark):
    two = lengthmix.auto_edges(lengths(spark, (45, 0.12, 60_000), (110, 0.15, 40_000)))
    assert len(two) == 1 and 66 <= two[0] <= 76
    three = lengthmix.auto_edges(lengths(spark, (40, 0.08, 30_000), (80, 0.1, 30_000), (200, 0.1, 30_000)))
    assert len(three) == 2 and 52 <= three[0] <= 60 and 120 <= three[1] <= 135
    assert lengthmix.auto_edges(lengths(spark, (80, 0.2, 50_000))) == []
    assert lengthmix.auto_edges(spark.createDataFrame([(60, 10)], "size int, n bigint")) == [] == lengthmix.auto_edges(lengths(spark, (80, 0.2, 50)).limit(0))


def test_likelihood_of_parts_rises_with_passes():
    x, w = np.log(np.arange(30, 200.0)), np.random.default_rng(1).integers(1, 50, 170).astype(float)
    told = [lengthmix.normal_parts(x, w, 3, passes=p)[3] for p in range(1, 30)]
    assert all(b >= a - 1e-9 for a, b in itertools.pairwise(told))


def test_each_bin_has_its_fit_or_says_why_not(spark):
    rng = np.random.default_rng(4)
    seqs = []
    for size, d, n in ((40, 0.4, 6_000), (100, 0.05, 6_000), (200, 0.3, 50)):
        bases = rng.choice(list("ACGT"), (n, size))
        for p in range(15):
            change = rng.random((n, 2)) < d * math.exp(-0.3 * p)
            bases[(bases[:, p] == "C") & change[:, 0], p] = "T"
            bases[(bases[:, -1 - p] == "G") & change[:, 1], -1 - p] = "A"
        seqs += ["".join(r) for r in bases]
    ends = lengthmix.bin_ends(frame(spark, seqs), [70, 150])
    rows = {r["bin"]: r for r in lengthmix.fit_bins(ends, [70, 150], least=1_000)}
    assert [(rows[b]["low"], rows[b]["high"], rows[b]["n"], rows[b]["status"]) for b in range(3)] == [(30, 70, 6_000, "fit"), (71, 150, 6_000, "fit"), (151, None, 50, "insufficient_reads")]
    assert rows[0]["d5"] == pytest.approx(0.4, abs=0.06) and rows[0]["d3"] == pytest.approx(0.4, abs=0.06) and rows[0]["l5"] == pytest.approx(0.3, abs=0.08)
    assert rows[1]["d5"] < 0.12 and rows[2]["d5"] is None


def mixture_table(spark, d, shares, n=1_000_000, base=(0.4, 0.55)):
    """Expected numbers of each code for cells with planted shares of damaged reads."""
    rows = []
    for i, w in enumerate(shares):
        b = base[i % len(base)]
        inside = 50_000_000
        for code in itertools.product("10.", repeat=4):
            chance = lambda p: math.prod(0.5 * (q if x == "1" else 1 - q) if x != "." else 0.5 for q, x in zip(p, code, strict=True))  # noqa: E731, B023
            k = round(n * (w * chance([b + (1 - b) * x for x in d]) + (1 - w) * chance([b] * 4)))
            rows.append((i, 5, "".join(code), k, round(inside * b) if code == ("1",) * 4 else 0, round(inside * (1 - b)) if code == ("1",) * 4 else 0, round(inside * b) if code == ("1",) * 4 else 0, round(inside * (1 - b)) if code == ("1",) * 4 else 0))
    return spark.createDataFrame(rows, "bin int, gc int, code string, n bigint, t bigint, c bigint, a bigint, g bigint")


def test_planted_mixture_comes_back_and_likelihood_rises(spark):
    d, shares = (0.5, 0.35, 0.45, 0.3), (0.6, 0.25, 0.1)
    m = lengthmix.fit_mixture(mixture_table(spark, d, shares))
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(m.likelihoods))
    assert m.converged and m.separated
    assert m.d == pytest.approx(d, abs=0.02) and [c[3] for c in sorted(m.cells)] == pytest.approx(shares, abs=0.02)
    assert m.pi == pytest.approx(sum(shares) / 3, abs=0.02) and m.population == pytest.approx(m.pi * m.d[0])
    assert not lengthmix.fit_mixture(mixture_table(spark, (0.0,) * 4, (0.5, 0.5))).separated
    assert lengthmix.fit_mixture(mixture_table(spark, d, shares).limit(0)) is None


def test_length_gc_cells_by_hand(spark):
    seqs = [*some_reads(300, 28, 90), "T" * 60]
    want = {}
    for s in seqs:
        if len(s) < 30:
            continue
        inner = s[10:-10]
        gc = min(9, (inner.count("G") + inner.count("C")) * 10 // len(inner))
        five, three = str.maketrans("TCAGN", "10..."), str.maketrans("AGTCN", "10...")
        key = (sum(len(s) > x for x in (40, 60)), gc, s[:2].translate(five) + s[::-1][:2].translate(three))
        want[key] = tuple(a + b for a, b in zip(want.get(key, (0,) * 5), (1, *(inner.count(b) for b in "TCAG")), strict=True))
    found = lengthmix.length_gc_cells(frame(spark, seqs), [40, 60]).collect()
    assert {(r.bin, r.gc, r.code): (r.n, r.t, r.c, r.a, r.g) for r in found} == want


# ---- Edit scripts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def applied(a, script):
    out, at = [], 0
    for kind, pos, old, new in script:
        out.append(a[at:pos])
        assert old is None or a[pos] == old
        out.append(new or "")
        at = pos + (kind != "ins")
    return "".join(out) + a[at:]


def edited(rng, s, k):
    for _ in range(k):
        i, how = rng.randrange(len(s) + 1), rng.randrange(3)
        s = s[:i] + rng.choice("ACGT") + s[i:] if how == 0 else s[:i] + s[i + 1 :] if how == 1 else s[:i] + rng.choice("ACGT") + s[i + 1 :]
    return s


@pytest.mark.parametrize("most", [1, 2, 3])
def test_scripts_are_shortest_and_give_the_child(most):
    rng = random.Random(most)
    for la, lb in itertools.product((0, 1, 2, 5, 12, 30), repeat=2):
        if abs(la - lb) > most:
            continue
        pairs = []
        for _ in range(60):
            a = "".join(rng.choice("ACGT") for _ in range(la))
            b = edited(rng, a, rng.randrange(most + 2))
            pairs.append((a, b if len(b) == lb else "".join(rng.choice("AC") for _ in range(lb))))
        rows = lambda i, w: np.frombuffer("".join(p[i] for p in pairs).encode(), np.uint8).reshape(len(pairs), w)  # noqa: E731, B023
        edits, found = indels.scripts(rows(0, la), rows(1, lb), most)
        for (a, b), e, script in zip(pairs, edits, found, strict=True):
            d = distance(a, b)
            assert (e == d) if d <= most else e > most
            if 0 < d <= most:
                assert len(script) == d and applied(a, script) == b
            else:
                assert script == []


def test_edit_scripts_of_a_table(spark):
    rng = random.Random(9)
    rows = [(a, edited(rng, a, rng.randrange(4)), i) for i in range(300) for a in ["".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 50)))]]
    rows += [(None, "A", -1), ("A", None, -2), ("ACGT", "ACGT", -3), ("A" * 10, "T" * 3, -4), rows[0]]
    found = indels.edit_scripts(spark.createDataFrame(rows, "parent string, child string, n int").repartition(3)).collect()
    assert sorted((r.parent or "", r.child or "", r.n) for r in found) == sorted((a or "", b or "", n) for a, b, n in rows)
    for r in found:
        d = None if r.parent is None or r.child is None else distance(r.parent, r.child)
        assert r.edits == (d if d is not None and d <= 2 else None)
        assert r.script is None if r.edits is None else applied(r.parent, [tuple(s) for s in r.script]) == r.child


def test_rescue_takes_the_best_score_not_the_fewest_edits(spark):
    """A sure substitution counts against a parent one edit away; a charge for an indel is less."""
    head, tail, rules = "ACGTTGCATGCA", "GGATCCTTAGCA", errors.Rules(five=2, three=2)
    middle = "TTGACCATGCAAGTCTAGG"
    child = head + middle + tail
    one = head + middle[:9] + "T" + middle[10:] + tail  # a substitution of high quality
    gap = head + middle[:5] + middle[6:] + tail  # one base fewer
    far = head + middle[::-1] + tail
    qual = lambda s: "I" * len(s)
    clusters = spark.createDataFrame([(one, 9, qual(one)), (gap, 5, qual(gap)), (child, 1, qual(child)), (far, 7, qual(far))], "canon string, n bigint, qual string")
    bins = spark.createDataFrame([("T>C", 3, occ, 0, 5, 0.05, 9) for occ in range(3)], "class string, dist int, occ int, dmg int, n bigint, p_real double, total bigint")
    fewest = {r.child: (r.parent, r.edits) for r in errors.rescue_indels(clusters).collect()}
    assert fewest[child] == (one, 1)
    scored = {r.child: r for r in indels.rescue_scored(clusters, bins, rules).collect()}
    assert scored[child].parent == gap and (scored[child].edits, scored[child].n_ins, scored[child].n_del) == (1, 1, 0)
    assert scored[child].score == pytest.approx(3.0 - 2.0) and far not in scored
    # In a masked end an indel has a bonus; dearer ones leave nothing.
    ended = spark.createDataFrame([(child, 9, qual(child)), (child[:1] + child[2:], 1, qual(child[1:]))], "canon string, n bigint, qual string")
    kept = errors.moderate_pairs(ended, end=0, keep=("qual",))
    assert kept.count() == 1
    assert indels.rescue_scored(ended, bins, rules, end=0).first().score == pytest.approx(3.0 - 2.0 + 1.0)
    assert indels.rescue_scored(clusters, bins, rules, inserted=5.0, deleted=5.0).filter(f"child = '{child}'").count() == 0


def test_moderate_bundles_only(spark):
    same = [("ACGTTGCATGCA" + "ACGT"[i % 4] * (i // 4) + "GGATCCTTAGCA", 1) for i in range(60)]
    assert errors.moderate_pairs(spark.createDataFrame(same, "canon string, n bigint")).count() == 0
    some = spark.createDataFrame(same[:12], "canon string, n bigint")
    want = sum(abs(len(a) - len(b)) <= 2 for a, b in itertools.combinations(sorted({x for x, _ in same[:12]}), 2))
    assert errors.moderate_pairs(some.distinct()).count() == want


# ---- Oxidation

WORN = Profile(0.5, 0.3, 0.5, 0.3, 0.5, 0.5)


def oxidised(n, seed, oxo=0.0, both=0.0, single=False):
    """Reads of 60, half of them damaged: C>T from the 5' end (and G>A from the 3' end), and inside damaged ones G
    read as T with chance oxo, C read as A with chance both."""
    rng = np.random.default_rng(seed)
    bases = rng.choice(list("ACGT"), (n, 60))
    damaged = rng.random(n) < 0.5
    for p in range(15):
        now = damaged & (rng.random(n) < 0.9 * math.exp(-0.3 * p))
        bases[now & (bases[:, p] == "C"), p] = "T"
        if not single:
            now = damaged & (rng.random(n) < 0.9 * math.exp(-0.3 * p))
            bases[now & (bases[:, -1 - p] == "G"), -1 - p] = "A"
    middle = bases[:, 20:40]
    for old, new, chance in (("G", "T", oxo), ("C", "A", both)):
        middle[(middle == old) & (rng.random(middle.shape) < chance) & damaged[:, None]] = new
    return ["".join(r) for r in bases]


def test_oxidation_is_found_and_controls_stay_silent(spark):
    test = lambda seqs, p: oxidation.oxidation_test(oxidation.oxidation_moments(frame(spark, seqs), p, 0.5))
    single = Profile(0.9, 0.3, 0.0, 0.3, 0.5, 0.5, single=True)
    found = test(oxidised(20_000, 1, oxo=0.1, single=True), single)
    assert found["oxo"].detected and found["oxo"].difference > 0.005 and not found["control"].detected
    clean = test(oxidised(20_000, 2, single=True), single)
    assert not clean["oxo"].detected and not clean["control"].detected and abs(clean["oxo"].z) < 3
    mixed = test(oxidised(20_000, 3, oxo=0.1, both=0.1, single=True), single)
    assert mixed["control"].detected and not mixed["oxo"].detected and mixed["oxo"].z > 3
    few = test(oxidised(20, 4), WORN)
    assert few["oxo"].difference is None and not few["oxo"].detected


def test_oxidation_moments_by_hand(spark):
    seqs = [*some_reads(300, 25, 90), "t" * 40]
    comp = str.maketrans("ACGTN", "TGCAN")
    want = collections.defaultdict(lambda: np.zeros(14))

    def weigh(s):
        total = 0.0
        for p, b in enumerate(s[:10]):
            hit = 0.5 + 0.5 * 0.5 * math.exp(-0.3 * p)
            total += math.log(hit / 0.5) if b == "T" else math.log((1 - hit) / 0.5) if b == "C" else 0.0
        return 1 / (1 + math.exp(-(math.log(0.2 / 0.8) + total)))

    for s in (x.upper() for x in seqs if len(x) >= 30):
        f, b = weigh(s), weigh(s[::-1].translate(comp))
        third = s[len(s) // 3 : len(s) - len(s) // 3]
        x, q = (third.translate(comp), b) if b > f else (third, f)
        for name, (one, two) in oxidation.CHANNELS.items():
            t, m = x.count(one), x.count(one) + x.count(two)
            if m:
                v = [q * t, q * m, (1 - q) * t, (1 - q) * m]
                side = max(0, len(s) // 3 - 10)
                around = s[10 : 10 + side] + s[len(s) - 10 - side : len(s) - 10]
                want[min(9, (around.count("G") + around.count("C")) * 10 // (2 * side)) if side else -1, name] += [*v, *(v[i] * v[j] for i in range(4) for j in range(i, 4))]
    found = oxidation.oxidation_moments(frame(spark, seqs), WORN, 0.2).collect()
    assert {(r.gc, r.channel) for r in found} == set(want)
    for r in found:
        assert [r[a] for a in oxidation.FIRST] + [r[f"{a}_{b}"] for a, b in oxidation.SECOND] == pytest.approx(list(want[r.gc, r.channel]))


# ---- Splits


def worn_reads(n, share, seed, d=0.7):
    rng = np.random.default_rng(seed)
    bases = rng.choice(list("ACGT"), (n, 50))
    damaged = rng.random(n) < share
    for p in range(12):
        for at, old, new in ((p, "C", "T"), (-1 - p, "G", "A")):
            bases[damaged & (rng.random(n) < d * math.exp(-0.3 * p)) & (bases[:, at] == old), at] = new
    return ["".join(r) for r in bases], damaged


@pytest.mark.parametrize(("share", "state"), [(0.5, "detected"), (0.0, "abstain")])
def test_planned_splits(spark, share, state, tmp_path):
    seqs, damaged = worn_reads(30_000, share, 3)
    rows = frame(spark, seqs)
    plan = split.plan_split(rows)
    assert plan.state == state
    routes = {r.ord: r.route for r in split.split(rows, plan).collect()}
    called = np.array([routes[i] == "damaged" for i in range(len(seqs))])
    if state == "abstain":
        assert not called.any()
        return
    assert plan.pi == pytest.approx(share, abs=0.15) and called[damaged].mean() > called[~damaged].mean() + 0.3
    split.save_plan(spark, f"{tmp_path}/plan", plan)
    again = split.load_plan(spark, f"{tmp_path}/plan", rows)
    assert (again.profile, again.edges, again.state, again.pi) == (plan.profile, plan.edges, plan.state, plan.pi)
    assert {r.ord: r.route for r in split.split(rows, again).collect()} == routes
    with pytest.raises(ValueError, match="another input"):
        split.load_plan(spark, f"{tmp_path}/plan", frame(spark, seqs[1:]))
    assert split.load_plan(spark, f"{tmp_path}/plan", frame(spark, seqs[1:]), override=True).pi == plan.pi


def test_cuts_by_state(spark):
    seqs, _ = worn_reads(8_000, 0.3, 5)
    rows = frame(spark, [*seqs, "A" * 20])
    p = Profile(0.6, 0.3, 0.6, 0.3, 0.5, 0.5)
    few = split.split(rows, split.plan_of(rows, p, [40], "low_abundance", 0.02)).collect()
    cut = min(r.score for r in few if r.route == "damaged")
    got = sum(r.route == "damaged" for r in few)
    assert 0.02 * 8_001 <= got and got == sum(r.score >= cut for r in few)
    assert sum(r.score >= cut + 0.02 for r in few) < 0.02 * 8_001 or got - sum(r.score > cut for r in few) >= 1
    sure = split.split(rows, split.plan_of(rows, p, [40], "detected", 0.3), least=30).collect()
    assert len(sure) == 8_000 and all((r.route == "damaged") == (r.score >= -math.log(0.3 / 0.7)) for r in sure)
    with pytest.raises(ValueError, match="state"):
        split.plan_of(rows, p, [40], "unsure", 0.3)
    assert split.state_of(p, 0.01, True) == "low_abundance" and split.state_of(p, 0.5, False) == "abstain" == split.state_of(Profile(), 0.5, True)


@pytest.mark.parametrize("single", [False, True])
def test_strata_by_hand(spark, single):
    p = Profile(0.4, 0.3, 0.4, 0.3, 0.5, 0.5, single)
    seqs = some_reads(250, 28, 70)
    df = frame(spark, seqs)
    called = {r.ord: r.damaged for r in df.select("ord", (llr("seq", p) >= 0.1).alias("damaged")).collect()}
    want = collections.Counter()
    for i, s in enumerate(seqs):
        if len(s) < 30:
            continue
        b = sum(len(s) > x for x in (40, 55))
        for pos in range(15):
            last = len(s) - 1 - pos
            three = (s[last + 1 : last + 2] == "G") if single else (last > 0 and s[last - 1] == "C")
            for end, x, cpg in ((5, s[pos], s[pos + 1 : pos + 2] == "G"), (3, s[last], three)):
                for level, key in ((0, (b, end, pos, called[i], cpg)), (1, (b, end, pos, called[i], None)), (3, (b, end, pos, None, None)), (19, (None, end, pos, None, None))):
                    want[(level, *key, x)] += 1
                    want[(level, *key, "n")] += 1
    rows = lengthmix.strata(df, p, [40, 55], 0.1).collect()
    got = {(r.level, *(r[c] for c in lengthmix.STRATA), x): k for r in rows for x, k in (("A", r.a), ("C", r.c), ("G", r.g), ("T", r.t), ("n", r.n)) if k}
    assert got == {k: v for k, v in want.items() if k[-1] != "N"}
