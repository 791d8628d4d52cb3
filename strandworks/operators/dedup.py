"""Duplicate fragments and their consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandworks.config import DedupOptions
from strandworks.functions import dna, quality, stats
from strandworks.lineage import cut, keep
from strandworks.operators import piles

# Ties between bases of equal weight go to T, then G, then C, then A.
_TIE = {"A": 0, "C": 1, "G": 2, "T": 3}


def fragment_key(seq1: Column, seq2: Column, length: int = 24, offset: int = 0, mode: int = 1) -> Column:
    """Start of read 1 and reverse complement of the start of read 2; mode 2 takes the lesser of both orders. Null if too short."""
    cut = lambda s: F.substring(s, offset + 1, length)
    key = F.concat(cut(seq1), dna.revcomp(cut(seq2)))
    key = F.least(key, dna.revcomp(key)) if mode == 2 else key
    return F.when((F.length(seq1) >= offset + length) & (F.length(seq2) >= offset + length), key)


def duplicate_groups(pairs: DataFrame, length: int = 24, offset: int = 0, mode: int = 1) -> DataFrame:
    """``frag_key, members, first_pair``: fragments that occur at least twice. ``pairs`` has ``pair_id, seq1, seq2``."""
    keyed = pairs.select("pair_id", fragment_key(F.col("seq1"), F.col("seq2"), length, offset, mode).alias("frag_key")).where("frag_key IS NOT NULL")
    return keyed.groupBy("frag_key").agg(F.count("*").alias("members"), F.min("pair_id").alias("first_pair")).where("members >= 2")


def single_key(seq: Column, length: int = 24, offset: int = 0, mode: int = 1) -> Column:
    """Key of an unpaired read: its first ``2 * length`` bases; mode 2 takes the lesser strand. Null if too short."""
    key = F.substring(seq, offset + 1, 2 * length)
    key = dna.canonical(key) if mode == 2 else key
    return F.when(F.length(seq) >= offset + 2 * length, key)


def duplicate_reads(reads: DataFrame, length: int = 24, offset: int = 0, mode: int = 1) -> DataFrame:
    """``frag_key, members, first_read``: starts of unpaired reads that occur at least twice."""
    keyed = reads.select("read_id", single_key(F.col("seq"), length, offset, mode).alias("frag_key")).where("frag_key IS NOT NULL")
    return keyed.groupBy("frag_key").agg(F.count("*").alias("members"), F.min("read_id").alias("first_read")).where("members >= 2")


def nearest_roots(counts: DataFrame, mode: int = 1) -> DataFrame:
    """``frag_key, n, root`` of ``frag_key, n``: where each key ends by going to its strongest neighbour, again and again.

    Neighbours differ in one base; stronger is the greater count, then the greater key,
    and only a stronger neighbour is followed, so there are no cycles. Keys with one
    base masked meet in groups of at most four (eight with mode 2, where both strands
    of a key count). Such keys have a half in common, so only keys that share one with
    another are masked, in the other half. Paths are halved in each round.
    """
    counts = keep(counts.select("frag_key", "n"), "keys")
    strands = F.array(F.col("frag_key"), dna.revcomp("frag_key")) if mode == 2 else F.array("frag_key")
    each = counts.select("frag_key", "n", F.explode(strands).alias("s"))
    half = F.floor(F.length("s") / 2).cast("int")
    sides = F.array(*(F.struct(F.lit(i).alias("no"), whole.alias("whole"), rest.alias("rest")) for i, whole, rest in (
        (0, F.substring("s", F.lit(1), half), F.substring("s", half + 1, F.length("s"))), (1, F.substring("s", half + 1, F.length("s")), F.substring("s", F.lit(1), half)))))
    halves = each.select("frag_key", "n", F.explode(sides).alias("h")).select("frag_key", "n", "h.no", "h.whole", "h.rest", F.xxhash64("h.no", "h.whole").alias("_h"))
    shared = halves.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h")
    masks = F.transform(F.sequence(F.lit(1), F.length("rest")), lambda i: F.overlay("rest", F.lit("*"), i, F.lit(1)))
    top = F.max(F.struct("n", "frag_key"))
    some = keep(halves.join(shared, "_h", "left_semi").where("length(rest) > 0"), "halves")
    near = some.select("frag_key", "n", "no", "whole", F.explode(masks).alias("mask")).withColumn("t", top.over(Window.partitionBy("no", "whole", "mask"))).select("frag_key", "n", "t")
    near = near.unionByName(counts.select("frag_key", "n", F.struct("n", "frag_key").alias("t")))  # keys without a neighbour stay
    step = cut(near.groupBy("frag_key", "n").agg(F.max("t").alias("t")).select("frag_key", "n", F.col("t.frag_key").alias("root")))
    while True:
        ahead = step.select(F.col("frag_key").alias("root"), F.col("root").alias("next"))
        step = cut(step.join(ahead, "root").select("frag_key", "n", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if step.where("moved").isEmpty():
            return step.drop("moved")
        step = step.drop("moved")


def consensus(reads: DataFrame) -> DataFrame:
    """Consensus of each group of reads: ``grp, cons_seq, cons_qual, members``.

    ``reads`` has ``grp, seq`` and ``q`` (array of integers). A base adds its
    probability to its letter and a third of the rest to the others; the best
    letter wins. Its quality is that of the surest base that says the letter, or of
    the mean weight where another letter is the surest. See :mod:`piles` for the sums;
    the size of a group does not matter.
    """
    sums = piles.sums(reads.select("grp", "seq", "q"))
    best = lambda x: F.array_max(F.array(*(F.struct(F.round(x[b], 9).alias("w"), F.lit(t).alias("t")) for b, t in _TIE.items())))
    top = F.transform(F.arrays_zip(*_TIE, "of", "sure", "letter"), lambda x: F.struct(best(x).alias("m"), x["of"].alias("of"), x["sure"].alias("sure"), x["letter"].alias("letter")))
    sure = lambda x: F.when(x["letter"] == x["m"]["t"], x["sure"]).otherwise(x["m"]["w"] / x["of"])
    sign = lambda x: F.char(quality.to_phred(F.least(F.greatest(sure(x), F.lit(0.0)), F.lit(1.0))) + 33)
    text = lambda of: F.array_join(F.transform("r", of), "")
    return sums.select("grp", top.alias("r"), "members").select("grp", text(lambda x: F.substring(F.lit("".join(_TIE)), x["m"]["t"] + 1, F.lit(1))).alias("cons_seq"), text(sign).alias("cons_qual"), "members")


def centroid(reads: DataFrame, consensus_table: DataFrame) -> DataFrame:
    """``grp, read_id, distance``: the read nearest to its group's consensus; the least id on ties."""
    near = reads.join(consensus_table.select("grp", "cons_seq"), "grp").select("grp", "read_id", dna.mismatches("seq", "cons_seq").alias("distance"))
    return near.groupBy("grp").agg(F.min(F.struct("distance", "read_id")).alias("m")).select("grp", "m.read_id", "m.distance")


def dedup_fragments(pairs: DataFrame, length: int = 24, offset: int = 0, mode: int = 1, edit_distance: int = 0, by_consensus: bool = True, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Pairs that are no duplicates, and what stands for each duplicate group: ``name, seq, qual, members`` of both mates.

    ``pairs`` has ``pair_id, seq1, seq2, q1, q2`` (arrays of integers). With
    ``edit_distance`` 1 groups whose keys differ in one base are one, see
    :func:`nearest_roots`. A group gives the consensus ``C<n>-<first>``, or without
    ``by_consensus`` one pair by hash order.
    """
    if edit_distance > 1:
        raise ValueError("keys are merged at a distance of 1")
    keyed = pairs.withColumn("frag_key", fragment_key(F.col("seq1"), F.col("seq2"), length, offset, mode))
    if edit_distance:
        counts = keyed.where("frag_key IS NOT NULL").groupBy("frag_key").agg(F.count("*").alias("n"))
        keyed = keyed.join(nearest_roots(counts, mode).drop("n"), "frag_key", "left").withColumn("frag_key", F.coalesce("root", "frag_key")).drop("root")
    groups = cut(keyed.where("frag_key IS NOT NULL").groupBy("frag_key").agg(F.count("*").alias("members"), F.min("pair_id").alias("first_pair"), F.min(F.struct(stats.random_bits("pair_id", seed), "pair_id")).alias("_s")).where("members >= 2"))
    single = keyed.join(groups.select("frag_key"), "frag_key", "left_anti").drop("frag_key")
    several = keyed.join(groups.select("frag_key", F.col("members").alias("_m"), "first_pair", F.col("_s.pair_id").alias("_one")), "frag_key")
    out = None
    for mate in (1, 2):
        seq, q = F.col(f"seq{mate}").alias("seq"), F.col(f"q{mate}").alias("q")
        if by_consensus:
            rows = several.select(F.col("frag_key").alias("grp"), seq, q)
            made = consensus(rows).join(groups.select(F.col("frag_key").alias("grp"), "first_pair"), "grp").select("members", "first_pair", F.col("cons_seq").alias("seq"), F.col("cons_qual").alias("qual"))
        else:
            made = several.where("pair_id = _one").select(F.col("_m").alias("members"), "first_pair", seq, quality.quality_text(q).alias("qual"))
        made = made.select(F.format_string("C%d-%d/%d", "members", "first_pair", F.lit(mate)).alias("name"), "seq", "qual", "members")
        out = made if out is None else out.unionByName(made)
    return single, out


def dedup_reads(reads: DataFrame, options: DedupOptions = DedupOptions()) -> DataFrame:
    """``name, seq, qual, members``: reads without duplicate fragments, and what stands for those.

    ``reads`` has ``read_id, name, comment, seq, qual``. Reads without a mate stay as
    they are, or with ``options.single`` are deduplicated by their own starts.
    """
    from strandworks.operators import reads as rd

    found = rd.identify_pairs(reads)
    side = lambda n: reads.select(F.col("read_id").alias(f"read{n}"), F.col("seq").alias(f"seq{n}"), quality.phreds("qual").alias(f"q{n}"))
    pairs = found.where("read1 IS NOT NULL AND read2 IS NOT NULL").withColumn("pair_id", F.col("read1")).join(side(1), "read1").join(side(2), "read2")
    single, made = dedup_fragments(pairs, options.length, options.offset, options.mode, options.edit_distance, options.consensus)
    kept = reads.join(single.select(F.explode(F.array("read1", "read2")).alias("read_id")), "read_id", "left_semi")
    alone = reads.join(found.where("read1 IS NULL OR read2 IS NULL").select(F.coalesce("read1", "read2").alias("read_id")), "read_id", "left_semi")
    plain = lambda df: df.select("name", "seq", "qual", F.lit(1).cast("long").alias("members"))
    out = plain(kept).unionByName(made)
    if not options.single:
        return out.unionByName(plain(alone))
    keyed = alone.withColumn("frag_key", single_key(F.col("seq"), options.length, options.offset, options.mode))
    groups = cut(duplicate_reads(alone, options.length, options.offset, options.mode))
    rows = keyed.join(groups.select("frag_key"), "frag_key").select(F.col("frag_key").alias("grp"), "seq", quality.phreds("qual").alias("q"))
    ones = consensus(rows).join(groups.select(F.col("frag_key").alias("grp"), "first_read"), "grp").select(F.format_string("C%d-%d", "members", "first_read").alias("name"), F.col("cons_seq").alias("seq"), F.col("cons_qual").alias("qual"), "members")
    return out.unionByName(plain(keyed.join(groups.select("frag_key"), "frag_key", "left_anti"))).unionByName(ones)
