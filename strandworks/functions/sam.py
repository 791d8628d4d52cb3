"""Alignment flags, ranks and geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the SAM format.
FLAGS = {
    "paired": 0x1, "proper": 0x2, "unmapped": 0x4, "mate_unmapped": 0x8, "reverse": 0x10, "mate_reverse": 0x20,
    "read1": 0x40, "read2": 0x80, "secondary": 0x100, "qcfail": 0x200, "duplicate": 0x400,
}


def has(flag: Column | str, name: str) -> Column:
    f = F.col(flag) if isinstance(flag, str) else flag
    return f.bitwiseAND(F.lit(FLAGS[name])) != 0


def reference_length(cigar: Column | str) -> Column:
    """Reference bases that a CIGAR covers (M, D, N, X and =)."""
    c = F.col(cigar) if isinstance(cigar, str) else cigar
    ops = F.regexp_extract_all(c, F.lit("([0-9]+)[MDN=X]"), F.lit(1))
    return F.aggregate(F.transform(ops, lambda x: x.cast("int")), F.lit(0), lambda a, x: a + x)


def aligned_bases(cigar: Column | str) -> Column:
    c = F.col(cigar) if isinstance(cigar, str) else cigar
    ops = F.regexp_extract_all(c, F.lit("([0-9]+)[M=X]"), F.lit(1))
    return F.aggregate(F.transform(ops, lambda x: x.cast("int")), F.lit(0), lambda a, x: a + x)


def rank_score(flag: Column, nm: Column, mapq: Column, aligned: Column, length: Column) -> Column:
    """Lower is better: edits, then mapping quality, then the unaligned share; unmapped and missing come last."""
    unaligned = F.least(F.lit(127), F.floor((length - aligned) * 100 / F.greatest(length, F.lit(1)))).cast("bigint")
    mapped = F.shiftleft(F.least(nm, F.lit(31)).cast("bigint"), 14) + F.shiftleft((F.lit(127) - F.least(mapq, F.lit(127))).cast("bigint"), 7) + unaligned
    return F.when(flag.isNull(), F.lit(1 << 30).cast("bigint")).when(has(flag, "unmapped"), F.lit(1 << 20).cast("bigint")).otherwise(mapped)


def pair_terms(flag: Column, apart: Column) -> Column:
    """What a paired record adds to its rank: for an unmapped mate, else for no proper pair and for mates on two references."""
    loose = F.when(has(flag, "proper"), 0).otherwise(1 << 23) + F.when(apart, 1 << 25).otherwise(0)
    return F.when(has(flag, "mate_unmapped"), 255 << 21).otherwise(loose).cast("bigint")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Shared positions of two inclusive ranges."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (a_end >= b_end)


def identity(matches: Column, length: Column) -> Column:
    return F.when(length > 0, matches / length).otherwise(0.0)


def at_end(start: Column, end: Column, length: Column, slack: int = 0) -> Column:
    """Does a 0-based inclusive range touch either end of a sequence?"""
    return (start <= slack) | (end >= length - 1 - slack)
