"""Assembly around contigs: each contig grows in a group of its own, with the reads that lie at its ends.

A round is one job whatever the contigs grow by: reads are matched to the ends of all
contigs, limited by contig, and each contig meets its reads in one group of bounded
size, where it is extended base by base over the k-mers of these reads. Contigs that did
not grow, or are long enough, are final; the others go on.

The limit holds before pairs are made. A contig's first reads in hash order are, for each
of its seeds, among the first reads with that seed; so a seed k-mer keeps as many reads
as a contig may have, and however often a repeat stands in the reads, a contig's seed
joins that many. The result is the same as if all pairs were made and cut afterwards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks import lineage
from strandworks.config import ExtendOptions, MatchOptions
from strandworks.functions import dna
from strandworks.operators import kmers, ordered
from strandworks.operators.assembly import contig_kmers
from strandworks.operators.reads import hash_order
from strandworks.sources import pipes

#: Of one contig and its reads (name, seq, qual): candidates for a longer contig.
LocalAssembler = Callable[[str, list[tuple[str, str, str | None]]], list[str]]

_TURN = str.maketrans("ACGT", "TGCA")


# ------------------------------------------------------------------------ matching


def _ends(contigs: DataFrame, key: str, k: int, options: MatchOptions) -> DataFrame:
    """``contig_id`` and the k-mers of its ends."""
    ends = contig_kmers(contigs, k, options.max_from_edge)
    if key == "code":
        ends = ends.where(~F.col("kmer").rlike("[^ACGT]")).withColumn("code", dna.code("kmer"))
    return ends.select("contig_id", key).distinct()


def kept_reads(fraction: float, seed: int = 0) -> Column:
    """Is this read one of the ``fraction`` that may match? The same reads for all contigs."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"f{seed}:"), F.col("read_id").cast("string"))), 1, 8), 16, 10).cast("double")
    return draw < F.lit(float(fraction) * 2.0**32)


def match_limited(contigs: DataFrame, observations: DataFrame, k: int, options: MatchOptions = MatchOptions(), fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """``contig_id, read_id``: at most ``max_read_matches`` reads of each contig that share a k-mer with its ends, the first in hash order.

    With ``fraction`` only that share of the reads, picked by hash, may match. No seed
    joins more reads than a contig may have, so rows are bounded by the contigs' seeds.
    """
    key = kmers.key_of(observations)
    ends = lineage.keep(_ends(contigs, key, k, options), "contig-ends")
    some = observations.where(kept_reads(fraction, seed)) if fraction < 1 else observations
    seeds = some.select("read_id", key).join(ends.select(key).distinct(), key, "left_semi").distinct()
    order = [hash_order("read_id", seed), "read_id"]
    few = ordered.top_of_group(seeds, key, order, options.max_read_matches)
    pairs = ends.join(few, key).select("contig_id", "read_id").distinct()
    return ordered.top_of_group(pairs, "contig_id", order, options.max_read_matches)


def shared_kmers(pairs: DataFrame, contigs: DataFrame, observations: DataFrame, k: int, options: MatchOptions = MatchOptions()) -> DataFrame:
    """``contig_id, read_id, shared``: how many k-mers of the contig's ends a matched read has."""
    key = kmers.key_of(observations)
    pairs = lineage.keep(pairs, "pairs")  # few, so that only matched reads' windows are compared
    own = observations.select("read_id", key).join(pairs, "read_id").join(_ends(contigs, key, k, options), ["contig_id", key])
    return own.groupBy("contig_id", "read_id").agg(F.countDistinct(key).alias("shared"))


# --------------------------------------------------------------- one contig's growth


class Depths:
    """Counts of the k-mers of some reads, for any k; made when they are asked for."""

    def __init__(self, seqs: list[str]) -> None:
        self.seqs, self.made = seqs, {}

    def of(self, k: int) -> Counter:
        if k not in self.made:
            self.made[k] = Counter(canonical(s[i : i + k]) for s in self.seqs for i in range(len(s) - k + 1))
        return self.made[k]


def canonical(kmer: str) -> str:
    return min(kmer, kmer.translate(_TURN)[::-1])


def next_base(contig: str, depths: Counter, k: int, seen: set[str], options: ExtendOptions) -> str | None:
    """The base behind the contig's right end, if depths agree on one and its k-mer is not in the contig yet."""
    edge, near = contig[len(contig) - k :], contig[len(contig) - k + 1 :]
    around = depths.get(canonical(edge), 0)
    found = sorted((depths.get(canonical(near + b), 0), b) for b in "ACGT")
    total, (top, base) = sum(n for n, _ in found), found[-1]
    if not around or total < options.min_coverage or total / around <= options.max_delta or top / total < options.min_consensus:
        return None
    return None if canonical(near + base) in seen else base


def grow(contig: str, seqs: list[str], ks: list[int], options: ExtendOptions) -> tuple[str, int, int]:
    """The contig and how many bases it got left and right.

    In each step either end gets a base by the least k that gives one, until neither
    does, or after ``max_steps`` steps, or at ``max_contig`` bases.
    """
    depths, added = Depths(seqs), [0, 0]
    ks = [k for k in ks if k <= len(contig)]
    seen = {k: {canonical(contig[i : i + k]) for i in range(len(contig) - k + 1)} for k in ks}
    open_ = [True, True]
    for _ in range(options.max_steps):
        for side in (0, 1):
            if not open_[side] or len(contig) >= options.max_contig:
                continue
            turned = contig if side else contig.translate(_TURN)[::-1]
            base = next((b for k in ks if (b := next_base(turned, depths.of(k), k, seen[k], options))), None)
            open_[side] = base is not None
            if base is not None:
                turned += base
                for k in ks:
                    seen[k].add(canonical(turned[len(turned) - k :]))
                contig = turned if side else turned.translate(_TURN)[::-1]
                added[side] += 1
        if not any(open_) or len(contig) >= options.max_contig:
            break
    return contig, added[0], added[1]


def ladder(seqs: list[str], k: int, steps: int) -> list[int]:
    """k, and up to ``steps`` greater ones, an even number apart, below the reads' length."""
    longest, mean = max(map(len, seqs), default=0), sum(map(len, seqs)) // max(len(seqs), 1)
    least = min(longest, mean)
    top = max(k, min(int(least * 0.95), least - 1))
    if not steps:
        return [k]
    apart = (top - k) // steps
    apart = max(2, apart + apart % 2)
    return list(range(k, top + 1, apart))


def best_candidate(contig: str, candidates: list[str], k: int, least_share: float = 0.5) -> str | None:
    """The longer candidate, either way round, with the most windows of the contig; None if none has ``least_share`` of its bases."""
    own, best = {canonical(contig[i : i + k]) for i in range(len(contig) - k + 1)}, None
    for i, c in enumerate(candidates):
        shared = sum(canonical(c[j : j + k]) in own for j in range(len(c) - k + 1))
        if len(c) > len(contig) and shared >= int(len(contig) * least_share) and (best is None or shared > best[0]):
            best = (shared, -i)
    if best is None:
        return None
    found = candidates[-best[1]]
    turned = found.translate(_TURN)[::-1]
    forward = sum(found[j : j + k] in contig for j in range(len(found) - k + 1))
    return found if 2 * forward >= best[0] else turned


def command_assembler(command: list[str]) -> LocalAssembler:
    """An assembler that is a command: it reads the contig and its reads as FASTA and writes contigs as FASTA."""

    def run(contig: str, reads: list[tuple[str, str, str | None]]) -> list[str]:
        text = f">contig\n{contig}\n" + "".join(f">{name}\n{seq}\n" for name, seq, _ in reads)
        out = b"".join(data for _, data in pipes.run(command, [text.encode()])).decode()
        return ["".join(x.split("\n")[1:]).strip().upper() for x in out.split(">")[1:]]

    return run


# --------------------------------------------------------------------------- rounds


@dataclass(frozen=True)
class NucleateOptions:
    k: int = 21
    k_steps: int = 0  # greater k-mers tried where the least gives no base
    extend: ExtendOptions = ExtendOptions()
    match: MatchOptions = MatchOptions()
    fraction: float = 1.0
    seed: int = 0


def one_round(contigs: DataFrame, reads: DataFrame, observations: DataFrame, options: NucleateOptions, assembler: LocalAssembler | None = None) -> DataFrame:
    """Each contig grown once: ``contig_id, seq, left, right``; contigs without reads stay as they are.

    ``reads`` have ``read_id, name, pair_key, seq, qual``; groups are the contig and at most
    ``max_read_matches`` reads, with their mates if ``include_mate`` is set.
    """
    pairs = lineage.keep(match_limited(contigs, observations, options.k, options.match, options.fraction, options.seed), "contig-pairs")
    near = pairs.join(reads, "read_id")
    if options.match.include_mate:
        keys = near.select("contig_id", "pair_key").distinct()
        near = keys.join(reads, "pair_key")
    near = near.select("contig_id", "read_id", "name", "seq", "qual")

    def made(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        rows = []
        some = sorted(zip(*(r.column(c).to_pylist() for c in ("read_id", "name", "seq", "qual"))))
        for contig_id, seq in zip(t.column("contig_id").to_pylist(), t.column("seq").to_pylist()):
            if assembler is not None:
                best = best_candidate(seq, assembler(seq, [x[1:] for x in some]), options.k) if some else None
                at = best.find(seq) if best else 0
                left = max(at, 0) if best else 0
                rows.append((contig_id, best or seq, left, len(best) - len(seq) - left if best else 0))
            else:
                seqs = [x[2] for x in some]
                rows.append((contig_id, *grow(seq, seqs, ladder(seqs, options.k, options.k_steps), options.extend)))
        return pa.table([pa.array(c, t_) for c, t_ in zip(zip(*rows), (t.schema.field("contig_id").type, pa.string(), pa.int64(), pa.int64()))], ["contig_id", "seq", "left", "right"])

    kind = contigs.schema["contig_id"].dataType.simpleString()
    return contigs.select("contig_id", "seq").groupBy("contig_id").cogroup(near.groupBy("contig_id")).applyInArrow(made, f"contig_id {kind}, seq string, left long, right long")


def nucleate(contigs: DataFrame, reads: DataFrame, options: NucleateOptions = NucleateOptions(), assembler: LocalAssembler | None = None) -> DataFrame:
    """Rounds until every contig is final: ``contig_id, seq, left, right, rounds``.

    A contig is final when a round adds nothing, or when it has ``max_contig`` bases.
    ``left`` and ``right`` are all bases added, ``rounds`` those in which it grew.
    Contigs are told apart by ``contig_id``, which has to be unique; null and empty
    sequences stay as they are. What a round leaves is a written table.
    """
    seeds = lineage.keep(kmers.observe(reads, options.k).select("read_id", "code" if options.k <= dna.LONGEST else "kmer"), "read-seeds")
    live = lineage.keep(contigs.select("contig_id", F.coalesce("seq", F.lit("")).alias("seq"), F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right"), F.lit(0).alias("rounds")), "contigs")
    final = None
    for _ in range(options.extend.max_iterations):
        grown = one_round(live, reads, seeds, options, assembler).select("contig_id", F.col("seq").alias("longer"), F.col("left").alias("l"), F.col("right").alias("r"))
        more = F.col("l") + F.col("r") > 0
        after = live.join(grown, "contig_id").select("contig_id", F.col("longer").alias("seq"), (F.col("left") + F.col("l")).alias("left"), (F.col("right") + F.col("r")).alias("right"), (F.col("rounds") + more.cast("int")).alias("rounds"), (more & (F.length("longer") < options.extend.max_contig)).alias("open"))
        after = lineage.keep(after, "contigs")
        done = after.where("NOT open").drop("open")
        final = done if final is None else final.unionByName(done)
        live = after.where("open").drop("open")
        if live.isEmpty():
            return final
    return final.unionByName(live) if final is not None else live
