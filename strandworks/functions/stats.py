"""Vector, rank and distribution functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandworks.functions.bind import let


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column | str) -> Column:
    """The vector over its L2 norm; zeros stay."""
    norm = l2_norm(v)
    return let(F.struct(norm.alias("n"), _c(v).alias("v")), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(0.0)))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def average_ranks(v: Column | str) -> Column:
    """Ranks from 1, ties share their mean rank."""
    def ranks(a: Column) -> Column:
        less = lambda x: F.size(F.filter(a, lambda y: y < x))
        same = lambda x: F.size(F.filter(a, lambda y: y == x))
        return F.transform(a, lambda x: less(x) + (same(x) + 1) / 2.0)

    return let(_c(v), ranks)


def spearman_distance(rank_a: Column | str, rank_b: Column | str) -> Column:
    """(1 - rho) / 2 of two rank vectors."""
    a, b = _c(rank_a), _c(rank_b)
    mean = (F.size(a) + 1) / 2.0
    fold = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    cross = fold(F.zip_with(a, b, lambda x, y: (x - mean) * (y - mean)))
    square = lambda v: fold(F.transform(v, lambda x: (x - mean) * (x - mean)))
    return (1 - cross / F.sqrt(square(a) * square(b))) / 2


def upper_median(v: Column | str) -> Column:
    """The upper of the middle values."""
    return F.expr("element_at(sort_array({0}), cast(size({0}) div 2 AS INT) + 1)".format(v)) if isinstance(v, str) else F.element_at(F.sort_array(v), (F.floor(F.size(v) / 2) + 1).cast("int"))


def poisson_deviation(mean: Column, variance: Column) -> Column:
    """Spread used for depth: the variance, but at least the square root of the mean."""
    return F.greatest(variance, F.sqrt(mean))


def random_bits(key: Column | str, seed: int = 0) -> Column:
    """60 reproducible random bits of a key, as a BIGINT."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string"))), 1, 15), 16, 10).cast("bigint")


def random_int(key: Column | str, bound: int, seed: int = 0) -> Column:
    """A reproducible random number from 0 to ``bound`` - 1."""
    return random_bits(key, seed) % bound


def random_double(key: Column | str, seed: int = 0) -> Column:
    """A reproducible random number from 0 to 1 (excluded)."""
    return random_bits(key, seed) / F.lit(float(1 << 60))


def list_hash(names: Column | str) -> Column:
    """A name for a list of names, such as the files of an input: the MD5 of the names, a line each."""
    return F.md5(F.array_join(F.transform(_c(names), lambda n: F.concat(n, F.lit("\n"))), ""))


def change_point(values: Column | str) -> Column:
    """Index at which a series splits into two levels with the greatest gap against both spreads; 0 if no split separates them.

    The spread of a level is the root of its variance, at least of the root of its mean.
    """
    def level(part: Column) -> Column:
        n = F.size(part)
        mean = F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / n
        square = let(F.struct(part.alias("p"), mean.alias("m")), lambda z: F.aggregate(z["p"], F.lit(0.0), lambda s, x: s + (x - z["m"]) * (x - z["m"])))
        return F.struct(mean.alias("m"), F.greatest(F.when(n > 1, square / (n - 1)).otherwise(0.0), F.sqrt(F.abs(mean))).alias("s"))

    def best(v: Column) -> Column:
        def gap(i: Column) -> Column:
            two = F.struct(level(F.slice(v, F.lit(1), i)).alias("a"), level(F.slice(v, i + 1, F.size(v) - i)).alias("b"))
            return let(two, lambda t: F.struct((F.abs(t["a"]["m"] - t["b"]["m"]) - F.sqrt(t["a"]["s"]) - F.sqrt(t["b"]["s"])).alias("g"), (-i).alias("i")))

        top = F.array_max(F.transform(F.sequence(F.lit(1), F.size(v) - 1), gap))
        return F.when(F.size(v) < 2, 0).otherwise(let(top, lambda t: F.when(t["g"] > 0, -t["i"]).otherwise(0)))

    return let(F.transform(_c(values), lambda x: x.cast("double")), best)
