"""Read-level operators: trimming, pairing, scoring, selection, sampling, splitting, conversion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandworks.config import KmerOptions, SelectOptions
from strandworks.functions import dna, quality, stats
from strandworks.functions.bind import let
from strandworks.lineage import keep
from strandworks.operators import covers, kmers, ordered, runs, windows


def quality_trim(reads: DataFrame, min_quality: int = 3, min_length: float = 0.40) -> DataFrame:
    """Longest run of bases with at least ``min_quality``: ``read_id, trim_offset, trim_length, trimmed, discarded``.

    A read that is one whole run is left alone; a run that fails the length rule
    discards the read.
    """
    run = reads.withColumn("_r", quality.longest_run_text(quality.good_marks("qual", min_quality)))
    whole = F.col("_r.bl") == F.length("seq")
    return run.select(
        "read_id", F.col("_r.bo").alias("trim_offset"), F.col("_r.bl").alias("trim_length"), (~whole).alias("trimmed"),
        (~whole & ~quality.passes_length(F.col("_r.bl"), F.length("seq"), min_length)).alias("discarded"),
    )


def apply_quality_trim(reads: DataFrame, min_quality: int = 3, min_length: float = 0.40) -> DataFrame:
    """Reads cut to their longest good run, labelled ``AFTrim:off+len``, or marked discarded. One pass, no join."""
    def made(s: Column) -> Column:
        n, off, size = s["r"]["bl"], s["r"]["bo"], F.length(s["seq"])
        whole, ok = n == size, quality.passes_length(n, size, min_length)
        cut = lambda c: F.when(whole | ~ok, s[c]).otherwise(F.substring(s[c], off + 1, n))
        label = F.when(~whole & ok, F.format_string("AFTrim:%d+%d", off, n))
        return F.struct(cut("seq").alias("seq"), cut("qual").alias("qual"), label.alias("label"), (~whole & ~ok).alias("discarded"))

    run = quality.longest_run_text(quality.good_marks("qual", min_quality))
    out = reads.withColumn("_o", let(F.struct(run.alias("r"), F.col("seq").alias("seq"), F.col("qual").alias("qual")), made))
    kept = [c for c in reads.columns if c not in ("seq", "qual", "label", "discarded")]
    return out.select(*kept, "_o.seq", "_o.qual", "_o.label", "_o.discarded")


def rescue_runs(reads: DataFrame, min_quality: int = 3, min_length: float = 0.40) -> DataFrame:
    """Second-best quality runs that pass the length rule, as reads named ``<name>-qtrim``."""
    from strandworks.operators.artifacts import quality_runs

    run = F.col("_r.second")
    cut = lambda c: F.substring(c, run["bo"] + 1, run["bl"]).alias(c)
    runs_of = reads.withColumn("_r", quality_runs(quality.good_marks("qual", min_quality)))
    return runs_of.where(quality.passes_length(run["bl"], F.length("seq"), min_length)).select("read_id", F.concat("name", F.lit("-qtrim")).alias("name"), cut("seq"), cut("qual"))


def with_pair_key(reads: DataFrame) -> DataFrame:
    comment = F.col("comment") if "comment" in reads.columns else None
    return reads.withColumn("pair_key", dna.common_name("name")).withColumn("read_num", dna.read_number("name", comment))


def identify_pairs(reads: DataFrame) -> DataFrame:
    """``pair_key, read1, read2``: ids of mates by common name; a missing mate is null.

    Several reads with the same name and number: the least id wins, the others are
    pairs of their own.
    """
    keyed = with_pair_key(reads)
    twin = F.row_number().over(Window.partitionBy("pair_key", "read_num").orderBy("read_id"))
    turn = F.when((F.col("read_num") > 0) & (F.col("_t") == 1), F.lit(-1)).otherwise(F.col("read_id"))
    one = lambda n: F.min(F.when(F.col("read_num") == n, F.col("read_id")))
    found = keyed.withColumn("_t", twin).groupBy("pair_key", turn.alias("_turn")).agg(F.coalesce(one(1), one(0)).alias("read1"), one(2).alias("read2"))
    return found.select("pair_key", "read1", "read2")


def window_scores(observations: DataFrame, spectrum: DataFrame, min_depth: int, reads: DataFrame, k: int) -> DataFrame:
    """``read_id, values``: depth of each window of a read in order; missing or shallow k-mers are 0.

    Only windows before the first letter other than ACGT count. Reads without any
    window have no row, discarded ones neither. Windows of k-mers that are deep enough
    are all that is shuffled by read; zeros are filled in from the read's length.
    """
    key = kmers.key_of(observations, spectrum)
    depth = spectrum.select(key, "n").where(F.col("n") >= min_depth)
    hits = observations.select("read_id", "pos", key).join(depth, key).groupBy("read_id").agg(F.collect_list(F.struct("pos", "n")).alias("hits"))
    src = reads.where("NOT discarded") if "discarded" in reads.columns else reads
    held = src.where(F.col("seq").rlike(f"[ACGT]{{{k}}}"))
    sized = held.select("read_id", F.greatest(F.length(F.regexp_extract("seq", "^[ACGT]*", 0)) - (k - 1), F.lit(0)).alias("size"))
    return windows.spread(sized.join(hits, "read_id", "left"))


def read_depths(reads: DataFrame, k: int, min_depth: int, min_quality: int | None = None, min_weight: float = 0.0) -> DataFrame:
    """:func:`window_scores` of reads against their own spectrum, which counts windows above ``min_weight`` if a ``min_quality`` is given.

    Up to 31 bases runs of windows are shuffled, once by k-mer and once by read, see :mod:`runs`.
    """
    kind = reads.schema["read_id"].dataType.simpleString()
    if k <= dna.LONGEST and kind in ("tinyint", "smallint", "int", "bigint"):
        table = None if min_quality is None else quality.p_table(min_quality)
        return runs.depths(reads, k, min_depth, table, min_weight).withColumn("read_id", F.col("read_id").cast(kind))
    obs = kmers.observe(reads, k)
    counted = obs if min_quality is None else kmers.observe(reads, k, weighted=True, options=KmerOptions(k=k, min_quality=min_quality, min_weight=min_weight))
    return window_scores(obs, kmers.spectrum(counted, min_depth, coded=k <= dna.LONGEST), min_depth, reads, k)


def score(values: Column, how: str) -> Column:
    """Score of a read's window values; null for none."""
    how = how.upper()
    if how == "MAX":
        return F.array_max(values).cast("double")
    if how == "MIN":
        return F.array_min(values).cast("double")
    if how == "MEDIAN":
        return stats.upper_median(values).cast("double")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return total if how == "SUM" else total / F.size(values)


def score_and_trim(scores: DataFrame, k: int, how: str = "MEDIAN") -> DataFrame:
    """Longest run of windows with depth: ``read_id, trim_offset, trim_length, score, windows``; length in bases, 0 for none."""
    run = scores.withColumn("_r", quality.longest_run(F.transform("values", lambda v: v > 0)))
    inside = F.slice("values", F.col("_r.bo") + 1, F.greatest(F.col("_r.bl"), F.lit(0)))
    found = F.col("_r.bl") > 0
    return run.select(
        "read_id", F.col("_r.bo").alias("trim_offset"), F.when(found, F.col("_r.bl") + k - 1).otherwise(0).alias("trim_length"),
        F.when(found, score(inside, how)).otherwise(0.0).alias("score"), F.size("values").alias("windows"),
    )


def bimodal_splits(scores: DataFrame) -> DataFrame:
    """``read_id, split``: the number of windows before the drop or rise that divides a read's values best; 0 if none does.

    A split has the difference of the two means less the root of either side's spread,
    which is the variance, but at least the root of the mean. A read's values are one
    array, so nothing is shuffled; reads with fewer than two values have no row.
    """
    kind = scores.schema["read_id"].dataType.simpleString()

    def spread(n: np.ndarray, s: np.ndarray, q: np.ndarray, mean: np.ndarray) -> np.ndarray:
        whole = s.astype(np.float64)  # the square of a sum of depths may have over 64 bits
        return np.maximum(np.where(n > 1, (q - whole * whole / n) / np.maximum(n - 1, 1), 0.0), np.sqrt(mean))

    def split(ids: pa.Array, v: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        """Of reads with two values at least."""
        end = np.cumsum(count)
        begin = end - count
        n = np.arange(len(v)) - np.repeat(begin, count) + 1
        so_far = lambda x: (c := np.cumsum(x)) - np.repeat(c[begin] - x[begin], count)
        s, q = so_far(v), so_far(v * v)
        inside = n < np.repeat(count, count)
        m, t, u = (np.repeat(x, count)[inside] for x in (count, s[end - 1], q[end - 1]))
        n, s, q = n[inside], s[inside], q[inside]
        left, right = s / n, (t - s) / (m - n)
        gap = 1e9 * (np.abs(left - right) - np.sqrt(spread(n, s, q, left)) - np.sqrt(spread(m - n, t - s, u - q, right)))
        gap = np.trunc(gap + np.copysign(0.5, gap)) / 1e9  # to nine places, so that like gaps are equal
        at = np.cumsum(count - 1) - (count - 1)
        most = np.maximum.reduceat(gap, at)
        best = np.flatnonzero(gap == np.repeat(most, count - 1))
        first = best[np.searchsorted(best, at)]
        return pa.RecordBatch.from_arrays([ids, pa.array(np.where(most > 0, n[first], 0))], ["read_id", "split"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("values")
            count = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            v, some = pc.fill_null(values.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64), count > 1
            v, ids, count = v[np.repeat(some, count)], batch.column("read_id").filter(pa.array(some)), count[some]
            held, a = np.cumsum(count), 0
            while a < len(count):  # reads of some SEGMENT values, or one longer read
                before = int(held[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(held, before + windows.SEGMENT, side="right")))
                yield split(ids.slice(a, b - a), v[before : held[b - 1]], count[a:b])
                a = b

    return scores.select("read_id", "values").mapInArrow(run, f"read_id {kind}, split bigint")


def passes(trimmed: DataFrame, reads: DataFrame, options: SelectOptions = SelectOptions()) -> DataFrame:
    """Reads with ``passes``: enough score and length (against the read's length), and not discarded."""
    both = reads.join(trimmed, "read_id", "left")
    ok = (F.coalesce("score", F.lit(0.0)) >= options.min_score) & quality.passes_length(F.coalesce("trim_length", F.lit(0)), F.length("seq"), options.min_length)
    if "discarded" in reads.columns:
        ok &= ~F.col("discarded")
    return both.withColumn("passes", ok)


def select_pairs(tested: DataFrame, min_passing: int = 1) -> DataFrame:
    """Whole pairs: those with enough mates that pass; 2 is asked only of pairs with both mates."""
    sums = tested.groupBy("pair_key").agg(F.count_if("passes").alias("_ok"), F.count("*").alias("_of"))
    good = sums.where(F.col("_ok") >= F.least(F.lit(min_passing), F.col("_of"))).where("_ok > 0")
    return tested.join(good.select("pair_key"), "pair_key", "left_semi")


def filter_reads(reads: DataFrame, k: int, options: SelectOptions = SelectOptions(), min_quality: int = 3, min_depth: int = 2, min_weight: float = 0.10, trim_min_length: float = 0.40) -> DataFrame:
    """The filtering pipeline: quality trim, count k-mers, score and trim, select pairs.

    ``reads`` need ``read_id, name, comment, seq, qual``. Returned reads keep the
    columns of the pipeline; :func:`as_output` cuts and labels them.
    """
    tested = test_reads(reads, k, options, min_quality, min_depth, min_weight, trim_min_length)
    return select_pairs(tested, options.min_passing_in_pair)


def test_reads(reads: DataFrame, k: int, options: SelectOptions = SelectOptions(), min_quality: int = 3, min_depth: int = 2, min_weight: float = 0.10, trim_min_length: float = 0.40) -> DataFrame:
    """All reads of the filtering pipeline with their trims, scores and ``passes``, before pairs are selected.

    Trimmed reads, and what their scores say, are written tables: both are read several times.
    """
    first = keep(with_pair_key(apply_quality_trim(reads, min_quality, trim_min_length)), "trimmed")
    # All windows are scored, those with enough weight are counted.
    trimmed = keep(score_and_trim(read_depths(first, k, min_depth, min_quality, min_weight), k, options.scoring), "scores")
    return passes(trimmed, first, options)


def cover_units(picked: DataFrame, k: int) -> DataFrame:
    """Pairs of a filtering as units of :func:`optimal_cover`: the k-mers of their trimmed reads, with depths among all that were picked."""
    cut = picked.where("trim_length > 0 AND NOT discarded").select("read_id", "pair_key", F.substring("seq", F.col("trim_offset") + 1, F.col("trim_length")).alias("seq"))
    obs = kmers.observe(cut, k)
    deep = obs.join(kmers.spectrum(obs, 1, coded=True).select("code", "n"), "code").select("read_id", "code", "n")
    own = deep.join(cut.select("read_id", "pair_key"), "read_id").groupBy(F.col("pair_key").alias("unit")).agg(F.collect_list(F.struct("code", "n")).alias("x"))
    sizes = cut.groupBy(F.col("pair_key").alias("unit")).agg(F.sum(F.length("seq")).alias("size"))
    return own.join(sizes, "unit").select("unit", "size", F.col("x.code").alias("kmers"), F.col("x.n").alias("depths"))


def as_output(picked: DataFrame, k: int, scoring: str = "MEDIAN", base: int = 33) -> DataFrame:
    """``read_id, name, labels, seq, qual`` as written: cut, labelled, or the N placeholder for reads without a trim."""
    some = F.coalesce("trim_length", F.lit(0)) > 1
    cut = lambda c: F.substring(c, F.col("trim_offset") + 1, F.col("trim_length"))
    shorter = F.col("trim_length") - k + 1 < F.col("windows")
    trim = F.when(shorter, F.format_string("Trim:%d+%d", F.col("trim_offset"), F.col("trim_length")))
    value = F.concat(F.lit({"MEDIAN": "MedianScore:", "MAX": "MaxScore:", "MIN": "MinScore:", "AVG": "AvgScore:", "SUM": "SumScore:"}[scoring]), F.floor(F.col("score") + 0.5).cast("string"))
    gone = F.col("discarded") | ~some
    return picked.select(
        "read_id", "name", F.when(gone, F.lit("")).otherwise(F.concat_ws(" ", "label", trim, value)).alias("labels"),
        F.when(gone, "N").otherwise(cut("seq")).alias("seq"), F.when(gone, F.lit(chr(base + 1))).otherwise(cut("qual")).alias("qual"),
    )


def depth_ladder(top: int, least: int) -> list[int]:
    """top, top/2, top/4, ..., not below ``least``."""
    steps = []
    while top >= max(least, 1):
        steps.append(top)
        top //= 2
    return steps


def partition_by_depth(scored: DataFrame, top: int, least: int) -> DataFrame:
    """Add ``partition``: the greatest of top, top/2, top/4, ... (not below ``least``) that the score reaches; null for none."""
    cases = None
    for depth in depth_ladder(top, least):
        hit = F.col("score") >= depth
        cases = F.when(hit, depth) if cases is None else cases.when(hit, depth)
    return scored.withColumn("partition", cases if cases is not None else F.lit(None).cast("int"))


def partition_pairs(tested: DataFrame, top: int, least: int, options: SelectOptions = SelectOptions(), remainder_length: float = 0.0) -> DataFrame:
    """``pair_key, partition``: the greatest depth at which enough mates of a pair pass; 0 for the remainder.

    ``tested`` has ``pair_key, score, trim_length, length``. The remainder, with a
    ``remainder_length``, are pairs not picked so far of which one mate passes the least
    depth with at least that length; other pairs are left out.
    """
    long_enough = quality.passes_length(F.coalesce("trim_length", F.lit(0)), F.col("length"), options.min_length)
    of = F.count("*")
    picks = [F.count_if(long_enough & (F.coalesce("score", F.lit(0.0)) >= d)).alias(f"_{d}") for d in depth_ladder(top, least)]
    rest = quality.passes_length(F.coalesce("trim_length", F.lit(0)), F.col("length"), remainder_length) if remainder_length else F.lit(False)
    sums = tested.groupBy("pair_key").agg(*picks, of.alias("_of"), F.count_if(rest & (F.coalesce("score", F.lit(0.0)) >= least)).alias("_rest"))
    chosen = F.coalesce(*(F.when((F.col(f"_{d}") > 0) & (F.col(f"_{d}") >= F.least(F.lit(options.min_passing_in_pair), F.col("_of"))), d) for d in depth_ladder(top, least)), F.when(F.col("_rest") > 0, 0))
    return sums.select("pair_key", chosen.cast("int").alias("partition")).where("partition IS NOT NULL")


def normalize_random(pairs: DataFrame, target: int, key: str = "pair_key", log_scale: bool = False) -> DataFrame:
    """Pairs kept by depth: all up to ``target``; above, pairs whose hash modulo the score is at most ``target``.

    With ``log_scale`` the bound above is target * ln(score / target), so deep pairs are kept more often.
    """
    whole = F.floor("score").cast("bigint")
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    bound = F.lit(float(target)) * F.log(whole / float(target)) if log_scale else F.lit(target)
    return pairs.where((whole <= target) | (draw % F.greatest(whole, F.lit(1)) <= bound))


def optimal_cover(units: DataFrame, target: int, ratio: float = 1.0, rounds: list[int] | None = None) -> DataFrame:
    """``unit, layer``: reads or pairs picked, best score first, so that k-mers are covered up to ``target`` times.

    ``units`` has ``unit, score, size`` and ``kmers`` (array of keys, with depth ``depth``
    for each in ``depths``). In layer d = 1, 2, ..., ``target`` a unit is skipped if one
    of its k-mers was picked d times before, by any unit of the table; else its score
    is the sum over its k-mers of depth times what is left of d, over its size, and
    the best unit comes first. Ties go by a hash of the unit, then by the unit.

    The greedy order is kept without one sequential task: in each round every open unit
    that is the best of all open units on *all* its k-mers is picked, which is what the
    sequential pass would do with it, for no other unit can change its k-mers before.
    Then pick counts grow, full units leave, scores are made anew. Units that share no
    k-mer never wait for each other; the rounds of a layer are as many as the longest
    chain of falling ranks among units that do. With ``ratio`` over 1 scores are compared by
    level, powers of it, and units of a level by their hash: ranks are then random within a
    level, so a chain has some log of its units for each level, whatever the scores are
    (exact scores along a tiling of reads may fall one by one). The choice is the sequential
    one for these ranks. ``rounds``, if given, gets the number of rounds of each layer.
    """
    kind = units.schema["unit"].dataType.simpleString()
    each = keep(units.select("unit", "size", F.explode(F.arrays_zip("kmers", "depths")).alias("x")).select("unit", "size", F.col("x.kmers").alias("kmer"), F.col("x.depths").cast("long").alias("depth")), "cover")
    names = None
    if kind != "bigint":  # numbers in the order that ties go by
        order = F.struct(F.xxhash64("unit").alias("tie"), "unit").alias("_o")
        names = keep(ordered.running_sum(each.select("unit").distinct().select("unit", order, F.lit(1).cast("long").alias("_1")), "_o", "_1", "_no").select("unit", "_no"), "cover")
        each = each.join(names, "unit").drop("unit").withColumnRenamed("_no", "unit")
    if each.schema["kmer"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        of = each.select("kmer").distinct().withColumn("_1", F.lit(1).cast("long"))
        each = each.join(keep(ordered.running_sum(of, "kmer", "_1", "_no").select("kmer", "_no"), "cover"), "kmer").drop("kmer").withColumnRenamed("_no", "kmer")
    links = each.select("unit", F.col("kmer").cast("long").alias("class"), F.col("depth").alias("weight"), F.lit(None).cast("double").alias("size"))
    sizes = each.groupBy("unit").agg(F.first("size").cast("double").alias("size")).select("unit", F.lit(covers.OWN).alias("class"), F.lit(0).cast("long").alias("weight"), "size")
    found = covers.cover(links.unionByName(sizes), target, ratio, names is None, rounds)
    return found if names is None else found.join(names.withColumnRenamed("unit", "_u"), found["unit"] == names["_no"]).select(F.col("_u").alias("unit"), "layer")


def pair_cover(reads: DataFrame, k: int, target: int, ratio: float = 1.0, min_depth: int = 2) -> DataFrame:
    """:func:`optimal_cover` of units of ``reads`` (``unit, seq``) by their k-mers of at least ``min_depth``; sizes are bases.

    K-mers that the same units have are one class, and those of one unit alone are a number.
    """
    found = keep(covers.classes(reads, k, "unit", min_depth), "classes")
    none = F.lit(None).cast("double").alias("size")
    own = F.lit(covers.OWN).alias("class")
    shared = found.where(F.size("units") > 1).groupBy("units").agg(F.min("class").alias("class"), F.sum("weight").alias("weight"))
    links = shared.select(F.explode("units").alias("unit"), "class", "weight", none)
    alone = found.where(F.size("units") == 1).select(F.get("units", F.lit(0)).alias("unit"), own, "weight", none)
    sizes = reads.groupBy("unit").agg(F.sum(F.length("seq")).cast("double").alias("size")).select("unit", own, F.lit(0).cast("long").alias("weight"), "size")
    return covers.cover(links.unionByName(alone).unionByName(sizes), target, ratio, True)


def unique_outputs(reads: DataFrame) -> DataFrame:
    """Reads without those whose sequence another read of lesser id has; sequences are compared by two 64-bit hashes."""
    named = reads.withColumns({"_a": F.xxhash64("seq"), "_b": F.xxhash64(F.lit(1), "seq")})
    first = named.groupBy("_a", "_b").agg(F.min("read_id").alias("read_id"))
    return reads.join(first.select("read_id"), "read_id", "left_semi")


def in_file_order(picked: DataFrame) -> DataFrame:
    """Picks of each task sorted by read, so that a writer goes through its source once."""
    return picked.sortWithinPartitions("read_id")


def totals(reads: DataFrame) -> DataFrame:
    """One row: ``reads, pairs, bases, longest``."""
    keyed = reads if "pair_key" in reads.columns else with_pair_key(reads)
    whole = keyed.groupBy("pair_key").agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("b"), F.max(F.length("seq")).alias("m"))
    return whole.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reads"), F.count("*").alias("pairs"), F.coalesce(F.sum("b"), F.lit(0)).alias("bases"), F.coalesce(F.max("m"), F.lit(0)).alias("longest"))


def output_size(name: str = "name", seq: str = "seq", label: str = "labels", fastq: bool = True) -> Column:
    """Bytes of a record as it will be written."""
    said = F.coalesce(F.length(label), F.lit(0))
    return F.length(name) + F.when(said > 0, said + 1).otherwise(0) + (F.length(seq) * 2 + 6 if fastq else F.length(seq) + 3)


def fake_mates(reads: DataFrame) -> DataFrame:
    """A stand-in for each missing mate: one N of least quality, the other number, ``:fakePair`` behind the comment."""
    keyed = with_pair_key(reads).where("read_num > 0")
    alone = keyed.groupBy("pair_key").agg(F.countDistinct("read_num").alias("_n")).where("_n = 1").select("pair_key")
    rows = keyed.join(alone, "pair_key", "left_semi")
    comment = F.col("comment").cast("string") if "comment" in reads.columns else F.lit(None).cast("string")
    by_comment = F.coalesce(comment.rlike("^[12]:[YN]:"), F.lit(False)) & ~F.col("name").rlike("/[12AFBR]$")
    other = (3 - F.col("read_num")).cast("string")
    common = F.col("pair_key")
    name = F.when(by_comment, F.col("name")).otherwise(F.concat(common, F.when(common.endswith("/"), "").otherwise("/"), other))
    said = F.concat(F.when(by_comment, F.concat(other, F.substring(comment, 2, 1 << 30))).otherwise(F.coalesce(comment, F.lit(""))), F.lit(":fakePair"))
    return rows.select("read_id", "pair_key", name.alias("name"), said.alias("comment"), F.lit("N").alias("seq"), F.lit(chr(34)).alias("qual"))


def sequential_pairs(reads: DataFrame) -> DataFrame:
    """``pair_key, read1, read2``: mates that follow each other in a file; a read is in one pair at most, the first that fits.

    Such reads share a pair key, so the windows are of one key.
    """
    keyed = with_pair_key(reads).where("read_num > 0")
    order = Window.partitionBy("file_id", "pair_key").orderBy("read_id")
    linked = (F.lag("read_id").over(order) == F.col("read_id") - 1) & (F.lag("read_num").over(order) != F.col("read_num"))
    chain = keyed.withColumn("_new", F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1)).withColumn("_c", F.sum("_new").over(order))
    place = Window.partitionBy("file_id", "pair_key", "_c").orderBy("read_id")
    mates = chain.withColumn("_at", F.row_number().over(place)).withColumns({"_before": F.lag("read_id").over(place), "_num": F.lag("read_num").over(place)}).where("_at % 2 = 0")
    return mates.select("pair_key", F.when(F.col("_num") == 1, F.col("_before")).otherwise(F.col("read_id")).alias("read1"), F.when(F.col("_num") == 1, F.col("read_id")).otherwise(F.col("_before")).alias("read2"))


def hash_order(key: str, seed: int = 0) -> Column:
    """A reproducible random order: hex digits of the MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def random_sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all): the first n in hash order. A top-n, without a full sort."""
    return rows.orderBy(hash_order(key, seed), key).limit(n)


def split_parts(reads: DataFrame, parts: int, chunks: int = 0) -> DataFrame:
    """Add ``part``: contiguous ranges of pair numbers, or with ``chunks`` an even interleave of that many pairs."""
    if chunks:
        return reads.withColumn("part", F.expr(f"cast(pair_no div {chunks} % {parts} as int)"))
    top = reads.agg(F.max("pair_no").alias("_m"))
    share = F.expr(f"cast(cast(pair_no as decimal(20, 0)) * {parts} div (cast(_m as decimal(20, 0)) + 1) as int)")
    return reads.crossJoin(F.broadcast(top)).withColumn("part", share).drop("_m")


def split_mates(reads: DataFrame, min_length: int = 0) -> DataFrame:
    """Add ``file``: 1 and 2 for records in turn, mates side by side; reads without a mate go to 0 if they have ``min_length`` bases."""
    keyed = reads if "pair_key" in reads.columns else with_pair_key(reads)
    sizes = keyed.groupBy("pair_key").agg(F.countDistinct("read_num").alias("_n"))
    both = keyed.join(sizes, "pair_key")
    return both.withColumn("file", F.when(F.col("_n") == 2, F.col("read_num")).otherwise(0)).where((F.col("file") > 0) | (F.length("seq") >= min_length)).drop("_n")


def split_by_bases(reads: DataFrame, bases: int) -> DataFrame:
    """Add ``part`` to reads with ``pair_no``: files of some ``bases`` bases, of which the lesser mate of a pair counts."""
    sizes = reads.groupBy("pair_no").agg(F.min(F.length("seq")).cast("long").alias("_b"))
    placed = ordered.running_sum(sizes, "pair_no", "_b", "_s")
    return reads.join(placed.select("pair_no", F.expr(f"cast((_s - _b) div {bases} as int)").alias("part")), "pair_no")


def fasta_record() -> Column:
    return F.concat(F.lit(">"), "name", F.lit("\n"), "seq")


def fastq_record(columns: list[str]) -> Column:
    head = F.concat_ws(" ", F.concat(F.lit("@"), "name"), F.nullif(F.col("labels"), F.lit(""))) if "labels" in columns else F.concat(F.lit("@"), "name")
    return F.concat_ws("\n", head, "seq", F.lit("+"), "qual")


def to_fasta(reads: DataFrame) -> DataFrame:
    return reads.select("read_id", fasta_record().alias("record"))


def to_fastq(reads: DataFrame) -> DataFrame:
    return reads.select("read_id", fastq_record(reads.columns).alias("record"))


def to_qual(reads: DataFrame) -> DataFrame:
    return reads.select("read_id", F.concat(F.lit(">"), "name", F.lit("\n"), quality.qual_numbers("qual")).alias("record"))


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two read sets; ids of the second go on behind the first's greatest."""
    top = a.agg(F.coalesce(F.max("read_id"), F.lit(-1)).alias("_m"))
    moved = b.crossJoin(F.broadcast(top)).withColumn("read_id", F.col("read_id") + F.col("_m") + 1).drop("_m")
    return a.unionByName(moved)
