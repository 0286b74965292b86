"""Column functions on sequences, read names, qualities and distributions; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq: C) -> Column:
    """Reverse complement; case is kept, letters other than A, C, G, T stay themselves."""
    return F.translate(F.reverse(_c(seq)), "ACGTacgt", "TGCAtgca")


def rc_position(length: C, pos: C) -> Column:
    """Position on the reverse complement axis."""
    return _c(length) - _c(pos) - 1


def dna_from_key(key: C) -> Column:
    """A deterministic 32-letter sequence made from any key."""
    return F.translate(F.md5(_c(key).cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")


def encode_two_bit(seq: C) -> Column:
    """Up to 31 letters as a number, first letter highest (A0 C1 G2 T3); null if a letter is none of these."""
    s = F.upper(_c(seq))
    return F.when(s.rlike("^[ACGT]+$"), F.conv(F.translate(s, "ACGT", "0123"), 4, 10).cast("long"))


def encode_two_bit_rl(seq: C) -> Column:
    """The same with the first letter lowest."""
    return encode_two_bit(F.reverse(_c(seq)))


def decode_two_bit(code: C, k: int) -> Column:
    """Letters of a k-letter code."""
    return F.translate(F.lpad(F.conv(_c(code).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def encode_four_bit(seq: C) -> Column:
    """One hexadecimal digit a letter: A0 C1 G2 T3 N4, lower case (masked) 8 more."""
    return F.translate(_c(seq), "ACGTNacgtn", "0123489abc")


def decode_four_bit(code: C) -> Column:
    return F.translate(_c(code), "0123489abc", "ACGTNacgtn")


def condense(seq: C) -> Column:
    """Each run of equal letters as one letter."""
    return F.regexp_replace(_c(seq), r"(.)\1+", "$1")


def homopolymer_runs(seq: C) -> Column:
    """The runs of equal letters among A, C, G, T, N, as strings in order."""
    return F.regexp_extract_all(_c(seq), F.lit("(A+|C+|G+|T+|N+)"), 1)


def longest_run(seq: C, letters: str = "ACGT") -> Column:
    """Length of the longest run of one letter; 0 if there is none."""
    runs = F.regexp_extract_all(_c(seq), F.lit("(" + "|".join(f"{x}+" for x in letters) + ")"), 1)
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def count_letter(seq: C, letter: str) -> Column:
    return F.length(_c(seq)) - F.length(F.replace(_c(seq), F.lit(letter), F.lit("")))


def gc_count(seq: C) -> Column:
    return count_letter(seq, "G") + count_letter(seq, "C")


def mask_outside(seq: C, start: C, end: C) -> Column:
    """Letters outside [start, end) as N; everything is masked where start >= end."""
    s, n = _c(seq), F.length(_c(seq))
    a, b = F.least(F.greatest(_c(start), F.lit(0)), n), F.least(F.greatest(_c(end), F.lit(0)), n)
    return F.when(a < b, F.concat(F.repeat(F.lit("N"), a), F.substring(s, a + 1, b - a), F.repeat(F.lit("N"), n - b))).otherwise(F.repeat(F.lit("N"), n))


def trim_to(seq: C, start: C, end: C) -> Column:
    return F.substring(_c(seq), _c(start) + 1, F.greatest(_c(end) - _c(start), F.lit(0)))


def subread_title(title: C, start: C, end: C) -> Column:
    return F.concat(_c(title), F.lit("/"), _c(start).cast("string"), F.lit("_"), _c(end).cast("string"))


def parse_read_name(name: C) -> dict[str, Column]:
    """movie, hole and the bounds of ``movie/hole/start_end[/start_end]``; a nested pair is relative to the first."""
    n = _c(name)
    part = lambda g: F.when(F.regexp_extract(n, r"^([^/]+)/(\d+)/(\d+)_(\d+)(?:/(\d+)_(\d+))?$", g) != "", F.regexp_extract(n, r"^([^/]+)/(\d+)/(\d+)_(\d+)(?:/(\d+)_(\d+))?$", g))
    s, e, s2, e2 = (part(g).cast("int") for g in (3, 4, 5, 6))
    return {"movie": part(1), "hole": part(2).cast("int"), "start": s + F.coalesce(s2, F.lit(0)), "end": F.coalesce(s + e2, e)}


def read_group_id(movie: C) -> Column:
    """First ten letters of the md5 of the movie name."""
    return F.substring(F.md5(_c(movie)), 1, 10)


def base_title(title: C) -> Column:
    """A title up to its first white space."""
    return F.regexp_extract(_c(title), r"^(\S*)", 1)


def wrap(seq: C, width: int = 50) -> Column:
    """The sequence in lines of ``width`` letters."""
    return F.regexp_replace(_c(seq), f"(.{{{width}}})(?=.)", "$1\n")


def in_ranges(value: C, ranges: str) -> Column:
    """Whether a number lies in a list such as ``1,2,10-12`` (bounds included)."""
    test = F.lit(False)
    for part in ranges.split(","):
        lo, _, hi = part.strip().partition("-")
        test = test | _c(value).between(int(lo), int(hi or lo))
    return test


def hamming(a: C, b: C) -> Column:
    """Differing places of two strings over the shorter length."""
    pairs = F.zip_with(F.split(_c(a), ""), F.split(_c(b), ""), lambda x, y: F.when(x.isNotNull() & y.isNotNull() & (x != y), 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)


def hamming_ends(a: C, b: C, width: int = 6) -> Column:
    """Differing places among the first and last ``width`` letters; 0 where a string is shorter than both ends."""
    n = F.least(F.length(_c(a)), F.length(_c(b)))
    ends = lambda s: F.concat(F.substring(s, 1, width), F.right(s, F.lit(width)))
    return F.when(n < 2 * width, 0).otherwise(hamming(ends(_c(a)), ends(_c(b))))


def phred(p: C) -> Column:
    return -10 * F.log10(_c(p))


def inverse_phred(q: C) -> Column:
    """Probability of error of a quality on the odds scale."""
    return 1 / (1 + F.pow(F.lit(10.0), _c(q) / 10.0))


def qv_error(q: C) -> Column:
    return F.pow(F.lit(10.0), -_c(q) / 10.0)


def mean_quality(qual: C) -> Column:
    """Mean of an array of qualities without its nulls; null if none is left."""
    known = F.filter(_c(qual), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(known))


def has_quality(qual: C) -> Column:
    """Whether any quality is above 0."""
    return F.coalesce(F.exists(_c(qual), lambda x: x > 0), F.lit(False))


def log10_add(a: C, b: C) -> Column:
    """log10(10^a + 10^b)."""
    m = F.greatest(_c(a), _c(b))
    return m + F.log10(F.pow(F.lit(10.0), _c(a) - m) + F.pow(F.lit(10.0), _c(b) - m))


def log_factorial(n: C) -> Column:
    """Natural logarithm of n!, by Stirling's series above 15 (error below 1e-9)."""
    x = _c(n).cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    small = F.element_at(F.array(*(F.lit(math.lgamma(i + 1)) for i in range(16))), F.least(_c(n), F.lit(15)).cast("int") + 1)
    return F.when(_c(n) <= 15, small).otherwise(series)


def binomial_pmf(n: C, k: C, p: C) -> Column:
    choose = log_factorial(_c(n)) - log_factorial(_c(k)) - log_factorial(_c(n) - _c(k))
    return F.exp(choose + _c(k) * F.log(_c(p)) + (_c(n) - _c(k)) * F.log(1 - _c(p)))


def poisson_pmf(k: C, mean: C) -> Column:
    return F.exp(_c(k) * F.log(_c(mean)) - _c(mean) - log_factorial(_c(k)))


def poisson_cdf(k: C, mean: C) -> Column:
    """Sum of the terms up to k; k of some hundreds at most."""
    terms = F.transform(F.sequence(F.lit(0), _c(k).cast("int")), lambda i: F.exp(i * F.log(_c(mean)) - _c(mean) - log_factorial(i)))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def normal_pdf(x: C, mean: C, sd: C) -> Column:
    return F.exp(-F.pow((_c(x) - _c(mean)) / _c(sd), 2) / 2) / (_c(sd) * math.sqrt(2 * math.pi))


def normal_cdf(x: C, mean: C, sd: C) -> Column:
    """By a rational approximation of the error function; absolute error below 1.5e-7."""
    z = (_c(x) - _c(mean)) / (_c(sd) * math.sqrt(2))
    t = 1 / (1 + 0.3275911 * F.abs(z))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return (1 + F.when(z < 0, -erf).otherwise(erf)) / 2


def exponential_pdf(x: C, rate: C) -> Column:
    return _c(rate) * F.exp(-_c(rate) * _c(x))


def exponential_cdf(x: C, rate: C) -> Column:
    return 1 - F.exp(-_c(rate) * _c(x))


def gamma_pdf(x: C, shape: int, rate: C) -> Column:
    """Gamma density of a whole shape."""
    return F.exp(shape * F.log(_c(rate)) + (shape - 1) * F.log(_c(x)) - _c(rate) * _c(x)) / math.factorial(shape - 1)


def match_probability(accuracy: C, length: int) -> Column:
    """Probability that ``length`` letters in a row are read without error."""
    return F.pow(_c(accuracy), F.lit(length))


def expected_waiting(accuracy: C, length: int) -> Column:
    """Expected letters until ``length`` error-free ones in a row have been read."""
    p = _c(accuracy)
    return (1 - F.pow(p, F.lit(length))) / ((1 - p) * F.pow(p, F.lit(length)))
