"""Column functions over quality strings and Phred values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandworks.functions.bind import let

REFERENCE_PHRED = 127  # quality of bases that come without one


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def phreds(qual: Column | str, base: int = 33) -> Column:
    """Integer qualities of a quality string."""
    return F.transform(F.split(_c(qual), ""), lambda c: F.ascii(c) - base)


def quality_text(q: Column | str, base: int = 33) -> Column:
    """A quality string of integer qualities."""
    return F.array_join(F.transform(_c(q), lambda v: F.char(v + base)), "")


def p_correct(q: Column, min_quality: int = 3) -> Column:
    """Probability that a base is right; 0 below ``min_quality``, 1 without quality."""
    return F.when(q.isNull() | (q >= REFERENCE_PHRED), 1.0).when(q < min_quality, 0.0).otherwise(1 - F.pow(F.lit(10.0), -q / 10.0))


def p_table(min_quality: int = 3) -> np.ndarray:
    """:func:`p_correct` of the Phred values 0 to REFERENCE_PHRED."""
    q = np.arange(REFERENCE_PHRED + 1)
    return np.where(q >= REFERENCE_PHRED, 1.0, np.where(q < min_quality, 0.0, 1 - 10.0 ** (-q / 10.0)))


def to_phred(p: Column) -> Column:
    """Phred value of a probability, at most 40."""
    return F.when(p >= 0.9999, 40).otherwise(F.least(F.floor(-10 * F.log10(1 - p) + 1e-6), F.lit(40)).cast("int"))


def rescale(qual: Column | str, from_base: int, to_base: int) -> Column:
    """Move a quality string from one base to another."""
    lo = range(from_base, 127)
    pairs = [(chr(c), chr(c - from_base + to_base)) for c in lo if 33 <= c - from_base + to_base < 127]
    return F.translate(_c(qual), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def qual_numbers(qual: Column | str, base: int = 33) -> Column:
    """Qualities as numbers with spaces between."""
    return F.array_join(F.transform(phreds(qual, base), lambda v: v.cast("string")), " ")


def longest_run_text(marks: Column) -> Column:
    """``struct(bl, bo)`` of a string of 1 and 0: length and 0-based offset of the longest run of 1, the earliest on ties.

    String functions only: the longest piece between zeros, and where it first occurs.
    """
    def run(s: Column) -> Column:
        best = F.array_max(F.transform(F.split(s, "0"), F.length))
        return let(best, lambda n: F.struct(n.alias("bl"), F.when(n > 0, F.instr(s, F.repeat(F.lit("1"), n)) - 1).otherwise(0).alias("bo")))

    return let(marks, run)


def longest_run(flags: Column) -> Column:
    """:func:`longest_run_text` of an array of booleans; null counts as false."""
    return longest_run_text(F.array_join(F.transform(flags, lambda ok: F.when(ok, "1").otherwise("0")), ""))


def good_marks(qual: Column | str, min_quality: int, base: int = 33) -> Column:
    """A string with 1 for each quality of at least ``min_quality`` and 0 for others."""
    codes = range(33, 127)
    return F.translate(_c(qual), "".join(map(chr, codes)), "".join("1" if c - base >= min_quality else "0" for c in codes))


def passes_length(length: Column, of: Column, minimum: float) -> Column:
    """The length rule: at most one base fails; a minimum up to 1 is a share of ``of``, above it is bases."""
    return (length > 1) & ((of * F.lit(minimum) <= length) if minimum <= 1 else (length >= minimum))
