"""Matching reads to contigs, and extending contigs from read k-mers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.config import ExtendOptions, MatchOptions
from strandworks.functions import dna, sam
from strandworks.lineage import keep
from strandworks.operators import kmers, ordered


class Matcher(Protocol):
    """Finds reads for contigs: ``contig_id, read_id`` pairs."""

    def __call__(self, contigs: DataFrame, reads: DataFrame) -> DataFrame: ...


Assembler = Callable[[DataFrame, DataFrame], DataFrame]  # contigs (contig_id, seq) and reads -> candidates (cand_id, seq)


def contig_kmers(contigs: DataFrame, k: int, edge: int) -> DataFrame:
    """k-mers within ``edge`` bases of either end: ``contig_id, contig_pos, kmer``."""
    each = contigs.where(F.length("seq") >= k).select("contig_id", F.length("seq").alias("n"), F.posexplode(dna.windows("seq", k)).alias("contig_pos", "f"))
    return each.where((F.col("contig_pos") < edge) | (F.col("contig_pos") + k > F.col("n") - edge)).select("contig_id", "contig_pos", dna.canonical("f").alias("kmer"), (dna.canonical("f") == F.col("f")).alias("contig_fwd"))


def match(contigs: DataFrame, observations: DataFrame, k: int, options: MatchOptions = MatchOptions()) -> DataFrame:
    """``contig_id, read_id, shared``: reads sharing k-mers with a contig's ends, by hits; one equi-join on the k-mer."""
    ends, key = contig_kmers(contigs, k, options.max_from_edge), kmers.key_of(observations)
    if key == "code":  # some thousand k-mers a contig, so that the reads' stay numbers
        ends = ends.where(~F.col("kmer").rlike("[^ACGT]")).withColumn("code", dna.code("kmer"))
    hits = ends.select("contig_id", key).distinct().join(observations.select("read_id", key), key)
    return hits.groupBy("contig_id", "read_id").agg(F.countDistinct(key).alias("shared"))


def complete_mates(matches: DataFrame, reads: DataFrame) -> DataFrame:
    """Matches and the mates of matched reads."""
    keyed = matches.join(reads.select("read_id", "pair_key"), "read_id").select("contig_id", "pair_key").distinct()
    return keyed.join(reads.select("read_id", "pair_key"), "pair_key").select("contig_id", "read_id").distinct()


def limit_matches(matches: DataFrame, options: MatchOptions = MatchOptions(), seed: int = 0) -> DataFrame:
    """At most ``max_read_matches`` reads of each contig, the first in hash order."""
    from strandworks.operators.reads import hash_order

    return ordered.top_of_group(matches, "contig_id", [hash_order("read_id", seed), "read_id"], options.max_read_matches)


def best_contig(contigs: DataFrame, candidates: DataFrame, k: int, least_share: float) -> DataFrame:
    """``contig_id, cand_id, overlap``: the longer candidate with the most windows in common with a contig; null if none has enough.

    ``candidates`` has ``cand_id, seq``; enough is ``least_share`` of the contig's bases.
    """
    own = kmers.observe(contigs.withColumnRenamed("contig_id", "read_id"), k)
    key = kmers.key_of(own)
    own = own.select(F.col("read_id").alias("contig_id"), key).distinct()
    theirs = kmers.observe(candidates.withColumnRenamed("cand_id", "read_id"), k).select(F.col("read_id").alias("cand_id"), "pos", key)
    shared = own.join(theirs, key).groupBy("contig_id", "cand_id").agg(F.countDistinct("pos").alias("overlap"))
    sized = shared.join(contigs.select("contig_id", F.length("seq").alias("n")), "contig_id").join(candidates.select("cand_id", F.length("seq").alias("m")), "cand_id")
    good = sized.where((F.col("m") > F.col("n")) & (F.col("overlap") >= F.floor(F.col("n") * least_share)))
    best = good.groupBy("contig_id").agg(F.max(F.struct("overlap", (-F.col("cand_id")).alias("neg"))).alias("b"))
    return contigs.select("contig_id").join(best, "contig_id", "left").select("contig_id", (-F.col("b.neg")).alias("cand_id"), "b.overlap")


def seed_alignments(contigs: DataFrame, reads: DataFrame, k: int, options: MatchOptions = MatchOptions()) -> DataFrame:
    """Best ungapped alignment of each matched pair on a seed diagonal, over both strands of the read.

    ``contig_id, read_id, strand, shift, overlap, mismatches``: the contig position of
    base 0 of the read (``strand`` 0) or of its reverse complement (1) is ``shift``; the
    best has the most matching bases, then the least shift, then strand 0.
    """
    at = contigs.where(F.length("seq") >= k).select("contig_id", F.length("seq").alias("n"), F.posexplode(dna.windows("seq", k)).alias("cp", "kmer"))
    at = at.where((F.col("cp") < options.max_from_edge) | (F.col("cp") + k > F.col("n") - options.max_from_edge)).drop("n")
    turned = reads.select("read_id", F.explode(F.array(F.struct(F.lit(0).alias("strand"), F.col("seq").alias("seq")), F.struct(F.lit(1).alias("strand"), dna.revcomp("seq").alias("seq")))).alias("x")).select("read_id", "x.strand", "x.seq")
    seeds = turned.where(F.length("seq") >= k).select("read_id", "strand", F.posexplode(dna.windows("seq", k)).alias("rp", "kmer"))
    lines = at.join(seeds, "kmer").select("contig_id", "read_id", "strand", (F.col("cp") - F.col("rp")).alias("shift")).distinct()
    full = lines.join(contigs.select("contig_id", F.col("seq").alias("cs")), "contig_id").join(turned.select("read_id", "strand", F.col("seq").alias("rs")), ["read_id", "strand"])
    c0, r0 = F.greatest(F.lit(0), F.col("shift")), F.greatest(F.lit(0), -F.col("shift"))
    n = F.least(F.length("cs") - c0, F.length("rs") - r0)
    cut = full.withColumn("overlap", n).withColumn("mismatches", dna.mismatches(F.substring("cs", c0 + 1, n), F.substring("rs", r0 + 1, n)))
    best = F.max(F.struct((F.col("overlap") - F.col("mismatches")).alias("m"), (-F.col("shift")).alias("s"), (-F.col("strand")).alias("t"), "overlap", "mismatches")).alias("b")
    return cut.groupBy("contig_id", "read_id").agg(best).select("contig_id", "read_id", (-F.col("b.t")).alias("strand"), (-F.col("b.s")).alias("shift"), "b.overlap", "b.mismatches")


def screen_overhangs(alignments: DataFrame, lengths: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """Alignments that reach over a contig's end with enough overlap and identity. ``lengths``: contig_id, n, read_id, m."""
    a = alignments.join(lengths, ["contig_id", "read_id"])
    over = (F.col("shift") < 0) | (F.col("shift") + F.col("m") > F.col("n"))
    good = (F.col("overlap") >= options.min_overlap) & (sam.identity(F.col("overlap") - F.col("mismatches"), F.col("overlap")) >= options.min_identity)
    return a.where(good & (over if options.overlap_only else F.lit(True)))


def covered_bases(contigs: DataFrame, spectrum: DataFrame, k: int) -> DataFrame:
    """``contig_id, covered``: bases of a contig under k-mers of the spectrum."""
    at = contigs.select("contig_id", F.posexplode(dna.windows("seq", k)).alias("p", "f")).select("contig_id", "p", dna.canonical("f").alias("kmer"))
    # Of the spectrum, which may be large, only the contigs' k-mers are looked up.
    known = keep(spectrum.select("kmer").join(at.select("kmer").distinct(), "kmer", "left_semi"), "covered")
    hit = at.join(known, "kmer", "left_semi")
    return hit.select("contig_id", F.explode(F.sequence("p", F.col("p") + k - 1)).alias("base")).groupBy("contig_id").agg(F.countDistinct("base").alias("covered"))


def extend_step(contigs: DataFrame, spectrum: DataFrame, k: int, options: ExtendOptions = ExtendOptions(), value: str = "n") -> DataFrame:
    """One base to the right: ``contig_id, seq, base, edge, total, top``; base null where the contig stops.

    A base is taken if the four extensions' depths sum to ``min_coverage``, are
    more than ``max_delta`` of the edge k-mer's, and one has ``min_consensus`` of
    them; ties go to the greater base.
    """
    edge = F.substring("seq", F.length("seq") - k + 1, F.lit(k))
    # base 0 is the edge k-mer itself, so that one pass over the spectrum finds all five depths
    probe = contigs.select("contig_id", F.posexplode(F.concat(F.array(edge), dna.extensions(edge))).alias("b", "x"))
    probe = probe.select("contig_id", F.when(F.col("b") > 0, F.substring(F.lit("ACGT"), F.col("b"), F.lit(1))).alias("base"), dna.canonical("x").alias("kmer"))
    key = "code" if "code" in spectrum.columns else "kmer"
    if key == "code":  # numbers are joined, so that the spectrum needs no text
        probe = probe.where(~F.col("kmer").rlike("[^ACGT]")).withColumn("code", dna.code("kmer"))
    hit = probe.join(spectrum.select(key, F.col(value).alias("d")), key)
    grows = F.col("base").isNotNull()
    sums = hit.groupBy("contig_id").agg(F.sum(F.when(grows, F.col("d"))).alias("total"), F.max(F.when(grows, F.struct("d", "base"))).alias("t"), F.max(F.when(~grows, F.col("d"))).alias("edge"))
    j = contigs.join(sums, "contig_id", "left")
    take = (F.col("total") >= options.min_coverage) & (F.col("total") / F.col("edge") > options.max_delta) & (F.col("t.d") / F.col("total") >= options.min_consensus)
    return j.select("contig_id", "seq", F.when(take, F.col("t.base")).alias("base"), "edge", "total", F.col("t.d").alias("top"))


def extend(contigs: DataFrame, spectrum: DataFrame, k: int, options: ExtendOptions = ExtendOptions()) -> DataFrame:
    """Extend contigs to the right step by step: ``contig_id, seq, added``.

    A contig stops at ``max_steps``, at ``max_contig`` bases, where no base is taken,
    and where its new edge k-mer already lies in it (a repeat).
    """
    now = contigs.select("contig_id", "seq", F.lit(0).alias("added"), F.lit(True).alias("open"))
    for _ in range(options.max_steps):
        active = now.where("open")
        made = extend_step(active.select("contig_id", "seq"), spectrum, k, options).select("contig_id", "base")
        j = now.join(made, "contig_id", "left")
        longer = F.concat("seq", "base")
        seen = F.expr(f"instr(seq, substring(concat(seq, base), length(seq) + 2 - {k}, {k})) > 0")
        fresh = F.col("base").isNotNull() & ~seen & (F.length("seq") < options.max_contig)
        now = j.select("contig_id", F.when(F.col("open") & fresh, longer).otherwise(F.col("seq")).alias("seq"), (F.col("added") + F.when(F.col("open") & fresh, 1).otherwise(0)).alias("added"), (F.col("open") & fresh).alias("open"))
        now = keep(now, "extend")
        if now.where("open").isEmpty():
            break
    return now.select("contig_id", "seq", "added")


def extend_both(contigs: DataFrame, spectrum: DataFrame, k: int, options: ExtendOptions = ExtendOptions()) -> DataFrame:
    """Extend right, then left (as the right end of the reverse complement): ``contig_id, seq, left, right``."""
    right = extend(contigs, spectrum, k, options)
    turned = extend(right.select("contig_id", dna.revcomp("seq").alias("seq")), spectrum, k, options)
    return turned.select("contig_id", dna.revcomp("seq").alias("seq"), F.col("added").alias("left")).join(right.select("contig_id", F.col("added").alias("right")), "contig_id")


def rename(name: str = "name", left: str = "left", right: str = "right"):
    """``<name>-l<left>r<right>`` with the sums of all rounds in the suffix."""
    base = F.regexp_replace(name, "-l[0-9]+r[0-9]+$", "")
    had = lambda g: F.coalesce(F.nullif(F.regexp_extract(name, "-l([0-9]+)r([0-9]+)$", g), F.lit("")).cast("int"), F.lit(0))
    return F.format_string("%s-l%dr%d", base, had(1) + F.col(left), had(2) + F.col(right))


def near_reads(contigs: DataFrame, reads: DataFrame, k: int, options: MatchOptions = MatchOptions(), matcher: Matcher | None = None) -> DataFrame:
    """Reads for the contigs' ends: matched, screened for overhang, limited by contig, and with ``include_mate`` their mates.

    A ``matcher`` takes the place of the matching by k-mers.
    """
    hits = matcher(contigs, reads) if matcher is not None else match(contigs, kmers.observe(reads, k), k, options)
    if options.overlap_only:
        some = reads.join(hits.select("read_id").distinct(), "read_id", "left_semi")
        placed = seed_alignments(contigs, some, k, options)
        sizes = placed.select("contig_id", "read_id").join(contigs.select("contig_id", F.length("seq").alias("n")), "contig_id").join(some.select("read_id", F.length("seq").alias("m")), "read_id")
        hits = screen_overhangs(placed, sizes, options).select("contig_id", "read_id")
    hits = limit_matches(hits.select("contig_id", "read_id"), options)
    if options.include_mate and "pair_key" in reads.columns:
        hits = complete_mates(hits, reads)
    return reads.join(hits.select("read_id").distinct(), "read_id", "left_semi")


def assemble(
    contigs: DataFrame, reads: DataFrame, k: int, options: ExtendOptions = ExtendOptions(), match_options: MatchOptions = MatchOptions(overlap_only=False),
    rounds: int | None = None, greatest_k: int | None = None, step_k: int = 2, assembler: Assembler | None = None, matcher: Matcher | None = None,
) -> DataFrame:
    """Match reads, count their k-mers, extend; until no contig grows or all have ``max_contig`` bases.

    Where no contig grows with k, k + ``step_k``, ... up to ``greatest_k`` are tried
    before the end. An ``assembler`` takes the place of the extension: it makes longer
    candidates of ``contig_id, seq`` and the reads (``cand_id, seq``), of which the best by
    :func:`best_contig` is taken.
    """
    now, size = contigs.select("contig_id", "seq"), k
    for _ in range(rounds or options.max_iterations):
        near = near_reads(now, reads, k, match_options, matcher)
        if assembler is not None:
            made = keep(assembler(now, near), "candidates")
            best = best_contig(now, made, k, 0.5).join(made.select("cand_id", F.col("seq").alias("longer")), "cand_id", "left")
            grown = keep(now.join(best, "contig_id").select("contig_id", F.coalesce("longer", "seq").alias("seq"), F.lit(0).alias("left"), F.when(F.col("longer").isNotNull(), F.length("longer") - F.length("seq")).otherwise(0).alias("right")), "grown")
        else:
            grown = keep(extend_both(now, kmers.spectrum(kmers.observe(near, size)), size, options), "grown")
        now = grown.select("contig_id", "seq")
        if grown.where("left + `right` > 0").isEmpty():
            if assembler is not None or greatest_k is None or size + step_k > greatest_k:
                break
            size += step_k
    return now
