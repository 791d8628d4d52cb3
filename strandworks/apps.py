"""Command-line programs: ``python -m strandworks.apps <program> ...``.

Each program is one pipeline over files; options default to what ``config`` says.
Outputs are folders of parts in order, which can be concatenated.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks import lineage
from strandworks.config import ArtifactOptions, DedupOptions, ExtendOptions, KmerOptions, MatchOptions, SelectOptions
from strandworks.operators import align, artifacts, assembly, dedup, kmers, nucleate, reads, size, vectors
from strandworks.session import session
from strandworks.sources import constants, fastx, sam, writers


def _reads(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return fastx.read_any(spark, *a.input)


def filter_reads(spark, a) -> None:
    """Trim, count, score and select reads."""
    r = _reads(spark, a)
    if a.artifacts:
        table = constants.artifacts(spark, a.mask_simple_repeats, a.reference, a.control, constants.CIRCULAR)
        found = artifacts.artifact_filter(r, table, ArtifactOptions(edit_distance=a.edits), a.min_quality, a.min_read_length, by_pair=True)
        if a.discarded:
            found = lineage.keep(found, "artifact-filter")
            gone = artifacts.discarded_reads(r, found, table)
            print("\n".join(writers.write_read_files(gone, a.discarded, writers.FASTQ, key="out_file", template="{Key}.fastq", single=True)))
        r = artifacts.apply_filter(r, found).where("NOT discarded")
    options = SelectOptions(scoring=a.scoring, min_length=a.min_read_length, min_passing_in_pair=a.min_passing_in_pair)
    tested = reads.test_reads(r, a.kmer_size, options, a.min_quality, a.min_depth, a.min_weight, a.min_read_length)
    if a.partition_by_depth > 0:
        parts = reads.partition_pairs(tested.withColumn("length", F.length("seq")), a.partition_by_depth, a.min_depth, options, a.remainder_trim)
        found = lineage.keep(tested.join(parts, "pair_key"), "partitions")
        key = F.when(F.col("partition") > 0, F.concat(F.lit("depth-"), F.col("partition").cast("string"))).otherwise("remainder")
        out = reads.as_output(found, a.kmer_size, a.scoring).join(found.select("read_id", key.alias("out_file")), "read_id")
        print("\n".join(writers.write_read_files(out, a.output, a.format, key="out_file", template="{Key}.fastq" if a.format in (0, 2) else "{Key}.fasta", single=True)))
        return
    picked = reads.select_pairs(tested, a.min_passing_in_pair)
    if a.max_depth > 0 and a.normalization == "OPTIMAL":
        cover = reads.optimal_cover(reads.cover_units(picked, a.kmer_size), a.max_depth, ratio=1.1)
        picked = picked.join(cover.select(F.col("unit").alias("pair_key")), "pair_key", "left_semi")
    elif a.max_depth > 0:
        top = picked.groupBy("pair_key").agg(F.max("score").alias("score"))
        picked = picked.join(reads.normalize_random(top, a.max_depth).select("pair_key"), "pair_key", "left_semi")
    writers.write_reads(reads.as_output(picked, a.kmer_size, a.scoring), a.output, a.format)


def dedup_reads(spark, a) -> None:
    """Replace duplicate fragments by their consensus; reads without a mate stay."""
    made = dedup.dedup_reads(_reads(spark, a), DedupOptions(mode=a.mode, length=a.length, edit_distance=a.edits, single=a.single))
    writers.write_reads(made.withColumn("read_id", F.xxhash64("name", "seq")), a.output, writers.FASTQ)


def mer_count(spark, a) -> None:
    """k-mer counts and extension tables, both strands."""
    obs = kmers.observe(_reads(spark, a), a.kmer_size, weighted=True, extensions=True, options=KmerOptions(k=a.kmer_size, min_quality=2, min_weight=a.min_weight))
    spec = kmers.spectrum(obs, a.min_depth, extension_quality=20)
    writers.write_mercount(spec, f"{a.output}/mercount")
    writers.write_mergraph(spec, f"{a.output}/mergraph")


def histogram(spark, a) -> None:
    """Depth histogram and the table of G+C by depth, with weights and percentages."""
    spec = lineage.keep(kmers.build_spectrum(_reads(spark, a), KmerOptions(k=a.kmer_size, min_depth=1)), "spectrum")
    found = kmers.weighted_histogram(spec)
    writers.write_table_text(found, f"{a.output}/histogram", *found.columns, order="bucket")
    writers.write_table_text(kmers.gc_heatmap(spec), f"{a.output}/gc", "n", "gc", "kmers", "visits", "weight", order="n")


def estimate_size(spark, a) -> None:
    """Fit a genome size to the growth of the spectrum."""
    print(size.estimate(_reads(spark, a), a.kmer_size, a.fraction, a.partitions))


def compare(spark, a) -> None:
    """k-mers that two files have in common."""
    one, two = (kmers.build_spectrum(fastx.read_any(spark, p), KmerOptions(k=a.kmer_size, min_depth=1), weighted=False) for p in a.input[:2])
    kmers.compare_report(kmers.compare(one, two, whole=True)).show(truncate=False)


def tnf(spark, a) -> None:
    """Frequency vectors of files and their distances."""
    r = _reads(spark, a).withColumn("g", F.col("file_id").cast("string"))
    vectors.distances(vectors.vectors(r, "g", a.kmer_size), "g", a.formula).show(10_000, truncate=False)


def extend(spark, a) -> None:
    """Extend the contigs of the first file with the reads of the others."""
    contigs = fastx.read_any(spark, a.input[0]).select(F.col("read_id").alias("contig_id"), "seq")
    r = reads.with_pair_key(fastx.read_any(spark, *a.input[1:]))
    made = assembly.assemble(contigs, r, a.kmer_size, ExtendOptions(max_steps=a.steps), rounds=a.rounds)
    made.select(F.concat(F.lit(">"), F.col("contig_id").cast("string"), F.lit("\n"), "seq").alias("value")).write.text(a.output)


def nucleate_contigs(spark, a) -> None:
    """Grow the contigs of the first file with the reads of the others, each in a group of its own; one FASTA file."""
    contigs = fastx.read_any(spark, a.input[0]).select(F.col("read_id").alias("contig_id"), "name", "seq")
    r = reads.with_pair_key(fastx.read_any(spark, *a.input[1:]))
    options = nucleate.NucleateOptions(k=a.kmer_size, k_steps=a.k_steps, extend=ExtendOptions(max_contig=a.max_contig, min_coverage=a.min_coverage), match=MatchOptions(max_read_matches=a.max_read_matches))
    made = nucleate.nucleate(contigs, r, options, nucleate.command_assembler(a.assembler) if a.assembler else None)
    named = made.join(contigs.select("contig_id", "name"), "contig_id").withColumn("name", F.when(F.col("rounds") > 0, assembly.rename()).otherwise(F.col("name")))
    writers.write_read_files(named.withColumn("read_id", F.col("contig_id")), a.output, writers.FASTA, template="contigs.fasta", single=True)


def sample(spark, a) -> None:
    """Exactly n reads or pairs."""
    r = reads.with_pair_key(_reads(spark, a))
    if a.by_pair:
        picked = reads.random_sample(r.select("pair_key").distinct(), a.n, "pair_key", a.seed)
        r = r.join(picked, "pair_key", "left_semi")
    else:
        r = reads.random_sample(r, a.n, "read_id", a.seed)
    writers.write_reads(r, a.output, a.format)


def split(spark, a) -> None:
    """Cut a file into parts by pairs, a folder each; or with ``--mates`` into files of first mates, second mates and others."""
    r = _reads(spark, a).withColumn("pair_no", F.expr("read_id div 2"))
    if a.mates:
        name = F.element_at(F.array(*map(F.lit, ("unpaired", "read1", "read2"))), F.col("file") + 1)
        split = reads.split_mates(r, a.min_read_length).withColumn("out_file", name)
        print("\n".join(writers.write_read_files(split, a.output, a.format, key="out_file", template=a.template, single=not a.in_parts)))
    else:
        writers.write_reads(reads.split_parts(r, a.parts, a.chunks), a.output, a.format, key="part")


def convert(spark, a) -> None:
    """FASTQ to FASTA, and the qualities as numbers."""
    r = _reads(spark, a)
    writers.write_reads(r, f"{a.output}/fasta", writers.FASTA)
    reads.to_qual(r.where("qual IS NOT NULL")).repartitionByRange("read_id").sortWithinPartitions("read_id").select("record").write.text(f"{a.output}/qual")


def bam_sort(spark, a) -> None:
    """Sort alignments; unmapped reads go to FASTQ by kind."""
    records = sam.read_alignments(spark, a.input[0])
    header, refs = sam.read_header(spark, a.input[0])
    kinds = align.split_unmapped(records)
    parts = writers.write_bam(kinds.where("kind = 'mapped'"), f"{a.output}/sorted", sam.sorted_header(header), refs)
    for kind in ("single", "pair_unmapped", "mate_mapped"):
        writers.write_unmapped(kinds.where(F.col("kind") == kind), f"{a.output}/{kind}")
    print("\n".join(parts))


PROGRAMS = {f.__name__.removesuffix("_contigs").replace("_", "-"): f for f in (filter_reads, dedup_reads, mer_count, histogram, estimate_size, compare, tnf, extend, nucleate_contigs, sample, split, convert, bam_sort)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandworks", description=__doc__)
    sub = top.add_subparsers(dest="program", required=True)
    for name, f in PROGRAMS.items():
        p = sub.add_parser(name, help=f.__doc__)
        p.add_argument("input", nargs="+")
        p.add_argument("--output")
        p.add_argument("--format", type=int, default=0, choices=range(4))
        p.add_argument("--kmer-size", type=int, default=4 if name == "tnf" else 23)
        if name in ("filter-reads", "mer-count"):
            p.add_argument("--min-depth", type=int, default=2)
            p.add_argument("--min-weight", type=float, default=0.10 if name == "filter-reads" else 0.0)
        if name == "filter-reads":
            p.add_argument("--scoring", default="MAX", choices=["MAX", "MIN", "MEDIAN", "AVG", "SUM"])
            p.add_argument("--min-read-length", type=float, default=0.40)
            p.add_argument("--min-passing-in-pair", type=int, default=1)
            p.add_argument("--min-quality", type=int, default=3)
            p.add_argument("--max-depth", type=int, default=-1)
            p.add_argument("--normalization", default="RANDOM", choices=["RANDOM", "OPTIMAL"])
            p.add_argument("--partition-by-depth", type=int, default=-1, help="files for this depth, a half, a quarter, ... of it")
            p.add_argument("--remainder-trim", type=float, default=0.0, help="also a file of pairs that no depth takes, of which one mate has this length")
            p.add_argument("--artifacts", action="store_true")
            p.add_argument("--edits", type=int, default=2)
            p.add_argument("--mask-simple-repeats", action="store_true", help="simple repeats are artifacts too")
            p.add_argument("--reference", help="FASTA of further artifacts; reads that end in one are discarded")
            p.add_argument("--control", help="FASTA of control genomes such as PhiX; their pairs are discarded")
            p.add_argument("--discarded", help="folder for the discarded reads, Control.fastq and Artifact.fastq")
        elif name == "dedup-reads":
            p.add_argument("--length", type=int, default=24)
            p.add_argument("--mode", type=int, default=1)
            p.add_argument("--edits", type=int, default=0)
            p.add_argument("--single", action="store_true")
        elif name == "tnf":
            p.add_argument("--formula", default="EUCLIDEAN", choices=["EUCLIDEAN", "SPEARMAN"])
        elif name == "extend":
            p.add_argument("--steps", type=int, default=50)
            p.add_argument("--rounds", type=int, default=1000)
        elif name == "sample":
            p.add_argument("-n", type=int, default=1000)
            p.add_argument("--by-pair", action=argparse.BooleanOptionalAction, default=True)
            p.add_argument("--seed", type=int, default=0)
        elif name == "split":
            p.add_argument("--parts", type=int, default=2)
            p.add_argument("--chunks", type=int, default=0)
            p.add_argument("--mates", action="store_true")
            p.add_argument("--in-parts", action="store_true", help="a file for each partition instead of one")
            p.add_argument("--template", default="{Key}.fastq", help="names of files: {Key} {FileNum} {NumFiles} {Uniq}")
            p.add_argument("--min-read-length", type=int, default=0)
        elif name == "estimate-size":
            p.add_argument("--fraction", type=float, default=0.5)
            p.add_argument("--partitions", type=int, default=100)
        elif name == "nucleate":
            p.add_argument("--k-steps", type=int, default=0)
            p.add_argument("--max-contig", type=int, default=3000)
            p.add_argument("--max-read-matches", type=int, default=450)
            p.add_argument("--min-coverage", type=float, default=4.8)
            p.add_argument("--assembler", nargs=argparse.REMAINDER, help="a command that reads a contig and its reads as FASTA and writes contigs")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    PROGRAMS[a.program](spark or session(), a)


if __name__ == "__main__":
    main(sys.argv[1:])
