"""Column functions on base and quality strings. All of them but differences() stay in built-in expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Complements of the bases, every other IUPAC letter to N, case kept.
BASES, COMPLEMENTS = "ACGTacgtRYSWKMBDHVNryswkmbdhvn", "TGCAtgcaNNNNNNNNNNNnnnnnnnnnnn"
# The six strand-collapsed substitution classes by base pair.
SUBSTITUTIONS = {"CT": "C>T", "GA": "C>T", "CA": "C>A", "GT": "C>A", "CG": "C>G", "GC": "C>G", "TA": "T>A", "AT": "T>A", "TC": "T>C", "AG": "T>C", "TG": "T>G", "AC": "T>G"}
# Upper ends of the bins of terminal distance and of bundle occupancy.
DISTANCE_ENDS, OCCUPANCY_ENDS = (2, 5, 10), (1, 3, 7, 15, 63)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def read_id(header: Column | str) -> Column:
    """The header without its mark, up to the first blank or tab."""
    return F.regexp_extract(col(header), r"^[@>]?([^ \t]*)", 1)


def clean_name(header: Column | str) -> Column:
    """The header without a trailing mate number."""
    return F.regexp_replace(col(header), r"/[12]$", "")


def revcomp(s: Column | str) -> Column:
    """Reverse complement; case stays, letters other than ACGT become N. Null stays null."""
    return F.translate(F.reverse(col(s)), BASES, COMPLEMENTS)


def revcomp_upper(s: Column | str) -> Column:
    return revcomp(F.upper(col(s)))


def canonical(s: Column | str, both_strands: bool = True) -> Column:
    """The lesser of a sequence and its reverse complement, which names the molecule exactly."""
    return F.least(col(s), revcomp(s)) if both_strands else col(s)


def is_forward(s: Column | str) -> Column:
    return col(s) <= revcomp(s)


def part(s: Column, start: Column | int, size: Column | int) -> Column:
    """substring by 1-based start, both of which may be columns."""
    return s.substr(start if isinstance(start, Column) else F.lit(start), size if isinstance(size, Column) else F.lit(size))


def masked(s: Column | str, five: int, three: int, single: bool = False) -> Column:
    """Damage-prone bases of the terminal zones made equal: C and T to 1 at the 5' end, G and A to
    2 at the 3' end; single-stranded libraries have both changes in both zones. Where the zones
    meet in a short read the 5' zone comes first."""
    s = col(s)
    n = F.length(s)
    k5 = F.least(F.lit(five), n)
    k3 = F.least(F.lit(three), n - k5)
    both = ("CTctGAga", "11112222")
    head = F.translate(part(s, 1, k5), *(both if single else ("CTct", "1111")))
    tail = F.translate(part(s, n - k3 + 1, k3), *(both if single else ("GAga", "2222")))
    return F.concat(head, part(s, k5 + 1, n - k5 - k3), tail)


def masked_canonical(s: Column | str, five: int, three: int, single: bool = False) -> Column:
    return F.least(masked(s, five, three, single), masked(revcomp(s), five, three, single))


def zones(s: Column | str, five: int, three: int) -> tuple[Column, Column]:
    """Sizes of the two masked ends in a read."""
    n = F.length(col(s))
    k5 = F.least(F.lit(five), n)
    return k5, F.least(F.lit(three), n - k5)


def damage_score(s: Column | str, positions: list[int]) -> Column:
    """Number of damaged-looking bases at masked positions (T from the 5' end, A from the 3')."""
    s, n = col(s), F.length(col(s))
    total = F.lit(0)
    for p in positions:
        inside = n > p
        total = total + F.when(inside & (part(s, p + 1, 1) == "T"), 1).otherwise(0) + F.when(inside & (part(s, n - p, 1) == "A"), 1).otherwise(0)
    return F.least(total, F.lit(255))


def damage_probability(pos: Column, size: Column, d5: float, l5: float, d3: float, l3: float) -> Column:
    """Chance of damage at a 0-based position, by exponential decay from both ends."""
    return F.greatest(d5 * F.exp(-l5 * pos), d3 * F.exp(-l3 * (size - 1 - pos)))


def mismatch_tolerance(size: int, d5: float, l5: float, d3: float, l3: float, background: float = 0.0, pcr: float = 0.0, level: float = 0.99) -> tuple[float, int]:
    """Expected mismatches of two copies of one molecule, and the least count whose Poisson
    distribution function reaches level."""
    mean = 2.0 * size * pcr
    for p in range(size):
        d = max(d5 * math.exp(-l5 * p), d3 * math.exp(-l3 * (size - 1 - p)))
        mean += 2 * d * (1 - d) * (1 - background)
    k, term = 0, math.exp(-mean)
    total = term
    while total < level:
        k += 1
        term *= mean / k
        total += term
    return mean, k


def bundle(s: Column | str, end: int = 12, with_length: bool = True) -> Column:
    """What the ends and the length of a read say about its molecule, exactly."""
    s = col(s)
    k = F.least(F.lit(end), F.floor(F.length(s) / 2).cast("int"))
    ends = [part(s, 1, k).alias("head"), part(s, F.length(s) - k + 1, k).alias("tail")]
    return F.struct(*ends, F.length(s).alias("size")) if with_length else F.struct(*ends)


def substitution_class(a: Column, b: Column) -> Column:
    pair = F.concat(a, b)
    out = F.when(pair.isin(*[k for k, v in SUBSTITUTIONS.items() if v == "C>T"]), "C>T")
    for name in ("C>A", "C>G", "T>A", "T>C", "T>G"):
        out = out.when(pair.isin(*[k for k, v in SUBSTITUTIONS.items() if v == name]), name)
    return out


def _binned(x: Column, ends: tuple[int, ...]) -> Column:
    out = F.when(x <= ends[0], 0)
    for i, end in enumerate(ends[1:], 1):
        out = out.when(x <= end, i)
    return out.otherwise(len(ends))


def distance_bin(pos: Column, size: Column) -> Column:
    """Bin of the distance to the nearer end."""
    return _binned(F.least(pos, size - 1 - pos), DISTANCE_ENDS)


def occupancy_bin(n: Column) -> Column:
    return _binned(n, OCCUPANCY_ENDS)


def phred(char: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(60), F.ascii(char) - 33))


def log_error_third(q: Column) -> Column:
    """log of a third of the error probability of a quality score."""
    return F.log(F.pow(F.lit(10.0), -q / 10.0) / 3)


def mismatches(a: Column | str, b: Column | str) -> Column:
    """Array of (pos, a, b) where two strings of equal length differ; pos from 0."""
    # Each string is taken apart once; substr() would count characters anew for every place.
    pairs = F.zip_with(F.split(col(a), ""), F.split(col(b), ""), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    placed = F.transform(pairs, lambda m, i: F.struct(i.alias("pos"), m["a"].alias("a"), m["b"].alias("b")))
    return F.filter(placed, lambda m: m["a"] != m["b"])


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.size(mismatches(a, b))


@F.arrow_udf(IntegerType())
def _differences(a: pa.Array, b: pa.Array) -> pa.Array:
    left, right = a.to_pylist() if len(a) else [], b.to_pylist() if len(b) else []
    known = np.array([x is not None and y is not None for x, y in zip(left, right, strict=True)], bool)
    if not known.any():
        return pa.nulls(len(a), pa.int32())
    size = np.array([min(len(x), len(y)) if k else 0 for x, y, k in zip(left, right, known, strict=True)])
    pieces = lambda rows: np.frombuffer("".join(x[:n] for x, n in zip(rows, size, strict=True) if n).encode("utf-32-le"), np.uint32)
    apart = np.concatenate([[0], np.cumsum(pieces(left) != pieces(right))])
    ends = np.concatenate([[0], np.cumsum(size)])
    return pa.array((apart[ends[1:]] - apart[ends[:-1]]).astype(np.int32), mask=~known)


def differences(a: Column | str, b: Column | str) -> Column:
    """hamming() for the rows of a batch at once, which does not list the places; not for use in a lambda."""
    return _differences(col(a), col(b))


def hamming_capped(a: Column | str, b: Column | str, cap: int) -> Column:
    """The number of mismatches, or cap + 1 for all that exceed cap."""
    return F.least(differences(a, b), F.lit(cap + 1))


def first_mismatches(a: Column | str, b: Column | str, most: int = 2) -> Column:
    """mismatches() where there are at most `most` of them, else null."""
    return F.when(differences(a, b) <= most, mismatches(a, b))


def damage_pair(a: Column, b: Column) -> Column:
    """Substitutions that deamination makes, on either strand."""
    return F.concat(a, b).isin("CT", "TC", "GA", "AG")


def complement_pair(a: Column, b: Column) -> Column:
    """A for T or C for G, the substitutions that damage cannot make and one error can."""
    return F.concat(a, b).isin("AT", "TA", "CG", "GC")


def terminal_damage(a: Column, b: Column, pos: Column, size: Column, margin: int = 5, single: bool = False) -> Column:
    """A damage pair within margin bases of the end where it occurs."""
    ct, ga = F.concat(a, b).isin("CT", "TC"), F.concat(a, b).isin("GA", "AG")
    five, three = pos < margin, pos >= size - margin
    return (ct | ga) & (five | three) if single else (ct & five) | (ga & three)


def quarters(s: Column | str) -> list[Column]:
    """Four parts of a string, whose sizes depend on its length only."""
    s = col(s)
    n = F.length(s)
    cut = [F.lit(0), *(F.floor(n * i / 4).cast("int") for i in (1, 2, 3)), n]
    return [part(s, cut[i] + 1, cut[i + 1] - cut[i]) for i in range(4)]


def one_deletion(longer: Column | str, shorter: Column | str) -> Column:
    """True if taking one base out of longer gives shorter."""
    a, b = col(longer), col(shorter)
    fits = F.exists(F.sequence(F.lit(1), F.length(a)), lambda i: F.concat(a.substr(F.lit(1), i - 1), a.substr(i + 1, F.length(a))) == b)
    return (F.length(a) == F.length(b) + 1) & fits


def within_edits(a: Column | str, b: Column | str, most: int = 2) -> Column:
    return F.levenshtein(col(a), col(b), most) >= 0


def kmers(s: Column | str, k: int) -> Column:
    """All k-mers in order; none of a shorter string."""
    s = col(s)
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: s.substr(i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def syncmers(s: Column | str, k: int, m: int, offset: int, most: int) -> Column:
    """Open syncmers as (hash, pos): canonical k-mers whose least-hashed m-mer begins at offset;
    the `most` of them with the least hashes."""
    found = F.transform(kmers(s, k), lambda x, i: F.struct(F.least(x, revcomp(x)).alias("kmer"), i.alias("pos")))
    order = lambda x, j: F.struct(F.xxhash64(x.substr(j, F.lit(m))).alias("hash"), j.alias("place"))
    kept = F.filter(found, lambda x: F.array_min(F.transform(F.sequence(F.lit(1), F.lit(k - m + 1)), lambda j: order(x["kmer"], j))).getField("place") == offset + 1)
    return F.slice(F.array_sort(F.transform(kept, lambda x: F.struct(F.xxhash64(x["kmer"]).alias("hash"), x["pos"].alias("pos")))), 1, most)


def base_count(s: Column | str, base: str) -> Column:
    s = col(s)
    return F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))


def _entropy(counts: list[Column], total: Column) -> Column:
    out = F.lit(0.0)
    for c in counts:
        p = c / total
        out = out - F.when(c > 0, p * F.log2(p)).otherwise(0.0)
    return out


def entropy(s: Column | str) -> Column:
    """Bits per base of the ACGT composition, over the whole length; null of an empty string."""
    return _entropy([base_count(s, b) for b in "ACGT"], F.nullif(F.length(col(s)), F.lit(0)))


def dominance(s: Column | str) -> Column:
    """Share of the most frequent base; null of an empty string."""
    return F.greatest(*[base_count(s, b) for b in "ACGT"]) / F.nullif(F.length(col(s)), F.lit(0))


def worst_window(s: Column | str, size: int = 20) -> Column:
    """(entropy, dominance) of the least entropy and the greatest dominance over windows."""
    windows = kmers(s, size)
    return F.struct(F.array_min(F.transform(windows, entropy)).alias("entropy"), F.array_max(F.transform(windows, dominance)).alias("dominance"))


def distinct_kmers(s: Column | str, k: int) -> Column:
    return F.size(F.array_distinct(kmers(s, k)))


def few_dimers(s: Column | str) -> Column:
    """True for strings (of four bases or more) of fewer than three distinct dimers: one base but for the first or last
    place, or two bases in turn. A pattern says so at a fraction of the cost of a distinct count."""
    return col(s).rlike(r"^(?:(.)\1*.|.(.)\2*|(.)(.)(?:\3\4)*\3?)$")


def adapter_tail(s: Column | str, adapter: str, most: int = 5) -> Column:
    """Size of the longest suffix of at most `most` bases that begins the adapter."""
    out = F.lit(0)
    for t in range(1, min(most, len(adapter)) + 1):
        out = F.when(F.endswith(col(s), F.lit(adapter[:t])), t).otherwise(out)
    return out


def find_tolerant(s: Column | str, adapter: str, most: int = 1, first: int = 0, anchor: int = 12) -> Column:
    """First 0-based place from `first` on where the adapter's first bases fit with at most `most`
    mismatches, or -1."""
    s, k = col(s), min(anchor, len(adapter))
    fits = lambda i: F.size(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda j: s.substr(i + j, F.lit(1)) != F.lit(adapter[:k]).substr(j, F.lit(1)))) <= most
    places = F.when(F.length(s) - k >= first, F.filter(F.sequence(F.lit(first), F.length(s) - k), fits)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(places, F.lit(0)), F.lit(-1))


def trim_run(s: Column | str, base: str = "G", least: int = 10) -> Column:
    """The read without a run of at least `least` bases at its 3' end."""
    return F.regexp_replace(col(s), f"{base}{{{least},}}$", "")


def clip_stubs(s: Column | str, five: list[str], three: list[str], floor: int = 12) -> Column:
    """The read without one stub at its 5' end and without stubs at its 3' end as long as it has
    floor bases or more."""
    s = F.regexp_replace(col(s), f"^(?:{'|'.join(five)})", "") if five else col(s)
    if not three:
        return s
    step = lambda x, _: F.when(F.length(x) >= floor, F.regexp_replace(x, f"(?:{'|'.join(three)})$", "")).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length(s) / min(map(len, three))).cast("int"))), s, step)


def log_length_bin(size: Column, bins: int = 20, low: float = 30.0, high: float = 501.0) -> Column:
    step = (math.log(high) - math.log(low)) / bins
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.log(size) - math.log(low)) / step).cast("int")))


def agreed(b1: Column, q1: Column, b2: Column, q2: Column) -> Column:
    """(base, quality) that two calls of one position give: qualities add up to 60 where they
    agree, the better one wins where they do not, and N yields to a call."""
    call = lambda base, q: F.struct(base.alias("base"), q.alias("q"))
    better = call(F.when(q1 >= q2, b1).otherwise(b2), F.greatest(F.abs(q1 - q2), F.lit(1)))
    return F.when((b1 == b2) | (b2 == "N"), call(b1, F.least(q1 + q2, F.lit(60)))).when(b1 == "N", call(b2, q2)).otherwise(better)


def wilson_lower(k: Column, n: Column, z: float = 1.96) -> Column:
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def binomial_lrt(k: Column, n: Column, p0: Column | float) -> Column:
    """Twice the log ratio of the best to the given success probability."""
    p, p0 = k / n, p0 if isinstance(p0, Column) else F.lit(p0)
    term = lambda c, a, b: F.when(c > 0, c * F.log(a / b)).otherwise(0.0)
    return 2 * (term(k, p, p0) + term(n - k, 1 - p, 1 - p0))


def digest(*cols: Column | str) -> Column:
    """Order-free digest of rows, for aggregation with bit_xor."""
    return F.xxhash64(*[col(c) for c in cols])
