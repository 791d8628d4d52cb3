"""Column functions over nucleotide strings. All are built-in expressions.

``k`` is always a parameter. Functions that build arrays of windows give an empty
array for strings shorter than a window. Nulls give nulls.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product
from operator import xor

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandworks.functions.bind import let

BASES = "ACGT"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revcomp(seq: Column | str) -> Column:
    """Reverse complement; letters other than ACGT stay."""
    return F.translate(F.reverse(_c(seq)), "ACGT", "TGCA")


def canonical(kmer: Column | str) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(_c(kmer), revcomp(kmer))


def windows(seq: Column | str, k: int) -> Column:
    """All substrings of length k, in order."""
    s = _c(seq)
    made = let(s, lambda v: F.transform(F.sequence(F.lit(1), F.length(v) - k + 1), lambda i: F.substring(v, i, F.lit(k))))
    return F.when(F.length(s) >= k, made).when(s.isNotNull(), F.array().cast("array<string>"))


def gc_count(seq: Column | str) -> Column:
    """Number of C and G; any other letter counts as A."""
    return F.length(_c(seq)) - F.length(F.translate(_c(seq), "GC", ""))


def digits(seq: Column | str) -> Column:
    """Bases as digits of base 4: A 0, C 1, G 2, T 3."""
    return F.translate(F.upper(_c(seq)), "ACGT", "0123")


WORD = LONGEST = 31  # bases of a BIGINT


def pack(kmer: Column | str) -> Column:
    """A k-mer of up to 31 bases as a BIGINT of two bits a base."""
    return F.conv(digits(kmer), 4, 10).cast("bigint")


def unpack(number: Column | str, k: int) -> Column:
    """The k-mer of a number made by :func:`pack`."""
    return F.translate(F.lpad(F.conv(_c(number).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def code(kmer: Column | str) -> Column:
    """A k-mer of up to 31 bases as a BIGINT with a leading one, so that its length is known and codes of one k sort as k-mers do."""
    return F.conv(F.concat(F.lit("1"), digits(kmer)), 4, 10).cast("bigint")


def kmer_of(number: Column | str) -> Column:
    """The k-mer of a number made by :func:`code`."""
    return F.translate(F.substring(F.conv(_c(number).cast("string"), 10, 4), 2, LONGEST), "0123", "ACGT")


def rc_code(number: Column | str, k: int) -> Column:
    """:func:`code` of the reverse complement of a k-mer of which this is the code: bases swap places by halves."""
    top = 1 << 2 * k
    lit = lambda v: F.lit(v).cast("long")
    x = _c(number).bitwiseXOR(lit(2 * top - 1))  # complements the bases and drops the leading one
    for shift, keep in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = F.shiftrightunsigned(x, shift).bitwiseAND(lit(keep)).bitwiseOR(F.shiftleft(x.bitwiseAND(lit(keep)), shift))
    return F.shiftrightunsigned(x, 64 - 2 * k).bitwiseOR(lit(top))


def canonical_code(number: Column | str, k: int) -> Column:
    """The lesser of a code and that of the other strand."""
    return F.least(_c(number), rc_code(number, k))


def substitutions(k: int, distance: int = 1) -> list[int]:
    """What to XOR to a code of k bases to change exactly ``distance`` of them."""
    each = [[x << 2 * i for x in (1, 2, 3)] for i in range(k)]
    return [reduce(xor, masks) for some in combinations(each, distance) for masks in product(*some)]


def pack_whole(seq: Column | str) -> Column:
    """A sequence of any length as ``words, bases, marks``.

    ``words``: BIGINTs of up to WORD bases each, two bits a base, the last one
    shorter; ``marks``: ``at`` (1-based) and ``base`` of letters other than ACGT,
    which count as A in the words.
    """
    def made(s: Column) -> Column:
        n = F.length(s)
        plain = F.regexp_replace(s, "[^ACGT]", "A")
        words = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(WORD)), lambda i: pack(F.substring(plain, i + 1, F.lit(WORD))))
        odd = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, F.lit(1)).rlike("[^ACGT]")), lambda i: F.struct(i.alias("at"), F.substring(s, i, F.lit(1)).alias("base")))
        return F.when(s.isNotNull(), F.struct(F.when(n > 0, words).otherwise(F.array().cast("array<bigint>")).alias("words"), n.alias("bases"), odd.alias("marks")))

    return let(_c(seq), made)


def unpack_whole(packed: Column | str) -> Column:
    """The sequence of a value made by :func:`pack_whole`."""
    def made(p: Column) -> Column:
        four = F.transform(p["words"], lambda w, i: F.lpad(F.conv(w.cast("string"), 10, 4), F.least(F.lit(WORD), p["bases"] - i * WORD), F.lit("0")))
        plain = F.translate(F.array_join(four, ""), "0123", "ACGT")
        return F.aggregate(p["marks"], plain, lambda s, m: F.overlay(s, m["base"], m["at"], F.lit(1)))

    return let(_c(packed), made)


def neighbours(kmer: Column | str, k: int) -> Column:
    """The 3k k-mers with exactly one substitution."""
    def made(m: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.transform(F.array(*map(F.lit, BASES)), lambda b: F.overlay(m, b, i, F.lit(1))))
        return F.filter(F.flatten(each), lambda x: x != m)

    return let(_c(kmer), made)


def neighbours_within(kmer: Column | str, k: int, distance: int) -> Column:
    """The k-mers with 1 to ``distance`` substitutions, each once."""
    m = _c(kmer)
    found = neighbours(m, k)
    for _ in range(distance - 1):
        found = F.array_distinct(F.flatten(F.transform(found, lambda x: F.concat(F.array(x), neighbours(x, k)))))
    return F.filter(found, lambda x: x != m)


def extensions(kmer: Column | str, right: bool = True) -> Column:
    """The four k-mers that follow (or precede) a k-mer by one base."""
    m = _c(kmer)
    if right:
        return F.transform(F.array(*map(F.lit, BASES)), lambda b: F.concat(F.substring(m, F.lit(2), F.length(m) - 1), b))
    return F.transform(F.array(*map(F.lit, BASES)), lambda b: F.concat(b, F.substring(m, F.lit(1), F.length(m) - 1)))


def first_markup(seq: Column | str, letters: str = "NX") -> Column:
    """0-based position of the first of ``letters``; the length if there is none."""
    s = _c(seq)
    at = F.regexp_instr(s, F.lit(f"[{letters}]"))
    return F.when(at > 0, at - 1).otherwise(F.length(s))


def mask(seq: Column | str, offset: Column | int, length: Column | int) -> Column:
    """Replace a range (0-based offset) by X."""
    s = _c(seq)
    off = offset if isinstance(offset, Column) else F.lit(offset)
    n = length if isinstance(length, Column) else F.lit(length)
    n = F.greatest(F.lit(0), F.least(n, F.length(s) - off))
    return F.concat(F.substring(s, F.lit(1), off), F.repeat(F.lit("X"), n), F.substring(s, off + n + 1, F.length(s)))


def circularize(seq: Column | str, n: int) -> Column:
    """Append the first n bases."""
    return F.concat(_c(seq), F.substring(_c(seq), 1, n))


def shred(seq: Column | str, length: int, step: int, whole_only: bool = False) -> Column:
    """Overlapping pieces as ``struct(offset, piece)``.

    By default pieces start at every step up to the end and the last may be short;
    with ``whole_only`` a piece must end before the last base, so a string of
    exactly ``length`` bases gives none.
    """
    s = _c(seq)
    last = F.length(s) - length - 1 if whole_only else F.length(s) - 1
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), last), F.lit(step))
    made = F.transform(at, lambda o: F.struct(o.alias("offset"), F.substring(s, o + 1, F.lit(length)).alias("piece")))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<struct<offset:int,piece:string>>"))


def common_name(name: Column | str) -> Column:
    """A read's name without its mate letter: ``x/1`` gives ``x/``."""
    return F.regexp_replace(_c(name), "/[^/]$", "/")


def read_number(name: Column | str, comment: Column | str | None = None) -> Column:
    """1 or 2 for mates (``/1 /A /F``, ``/2 /B /R``, or a comment ``1:N:0:``), else 0."""
    n = _c(name)
    said = F.when(n.rlike("/[1AF]$"), 1).when(n.rlike("/[2BR]$"), 2)
    if comment is not None:
        said = said.when(_c(comment).rlike("^[12]:[YN]:"), F.substring(_c(comment), 1, 1).cast("int"))
    return said.otherwise(0)


def mismatches(a: Column | str, b: Column | str) -> Column:
    """Positions at which two strings differ, over the shorter length."""
    def count(s: Column) -> Column:
        n = F.least(F.length(s["a"]), F.length(s["b"]))
        differ = lambda i: F.substring(s["a"], i, F.lit(1)) != F.substring(s["b"], i, F.lit(1))
        return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), n), differ))).otherwise(0)

    return let(F.struct(_c(a).alias("a"), _c(b).alias("b")), count)
