"""Matching reads to known artifacts by k-mers within an edit distance, and what follows from a hit."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.config import ArtifactOptions
from strandworks.functions import dna, quality
from strandworks.functions.bind import let
from strandworks.lineage import cut
from strandworks.operators import runs, windows
from strandworks.operators.reads import with_pair_key

#: A side is broadcast only below this many k-mers; beyond, the join shuffles.
BROADCAST_KMERS = 2_000_000


def artifact_kmers(artifacts: DataFrame, k: int, edits: int) -> DataFrame:
    """``kmer, artifact_id``: all k-mers within ``edits`` substitutions of an artifact, on both strands; the least id wins."""
    own = artifacts.select("artifact_id", F.explode(dna.windows("seq", k)).alias("kmer")).where(~F.col("kmer").rlike("[^ACGT]")).distinct()
    if edits:
        own = own.select("artifact_id", F.explode(F.concat(F.array("kmer"), dna.neighbours_within("kmer", k, edits))).alias("kmer"))
    both = own.select("artifact_id", F.explode(F.array(F.col("kmer"), dna.revcomp("kmer"))).alias("kmer"))
    return both.groupBy("kmer").agg(F.min("artifact_id").alias("artifact_id"))


def match(reads: DataFrame, artifacts: DataFrame, k: int = 24, edits: int = 1, stride: int = 4) -> DataFrame:
    """``read_id, artifact_id, hit_start, hit_end``: each read's least artifact and the range of its hits.

    Only every ``stride``-th window is probed. The artifact side is small and fixed
    (its k-mers are counted before it is broadcast).
    """
    small = artifact_kmers(artifacts, k, edits)
    count = small.count()
    small = F.broadcast(small) if count <= BROADCAST_KMERS else small
    probes = reads.where(F.length("seq") >= k).select("read_id", F.explode(F.sequence(F.lit(0), F.length("seq") - k, F.lit(stride))).alias("pos"), "seq")
    probes = probes.select("read_id", "pos", F.substring("seq", F.col("pos") + 1, F.lit(k)).alias("kmer"))
    hits = probes.join(small, "kmer")
    best = hits.groupBy("read_id", "artifact_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    return best.groupBy("read_id").agg(F.min(F.struct("artifact_id", "a", "b")).alias("m")).select(
        "read_id", "m.artifact_id", F.col("m.a").alias("hit_start"), (F.col("m.b") + k).alias("hit_end")
    )


def trim_artifacts(reads: DataFrame, hits: DataFrame, artifacts: DataFrame, min_length: float = 0.40) -> DataFrame:
    """Reads with ``action, keep_offset, keep_length``: the longer flank of a hit is kept if it passes the length rule.

    Hits of kind ``reference`` or ``control`` discard the read.
    """
    joined = reads.join(hits.join(artifacts.select("artifact_id", F.col("name").alias("artifact"), "kind"), "artifact_id"), "read_id", "left")
    n = F.length("seq")
    left, right = F.col("hit_start"), n - F.col("hit_end")
    keep = F.greatest(left, right)
    action = F.when(F.col("artifact_id").isNull(), "none").when(F.col("kind").isin("reference", "control") | ~quality.passes_length(keep, n, min_length), "discarded").otherwise("trimmed")
    return joined.withColumns({
        "action": action,
        "keep_offset": F.when(action == "none", 0).when(left >= right, 0).otherwise(F.col("hit_end")),
        "keep_length": F.when(action == "none", n).when(action == "discarded", 0).otherwise(keep),
    })


def summary(trimmed: DataFrame) -> DataFrame:
    """Reads and bases trimmed and discarded by artifact."""
    hit = trimmed.where("action <> 'none'")
    return hit.groupBy("artifact_id").agg(
        F.count_if(F.col("action") == "trimmed").alias("reads_trimmed"), F.count_if(F.col("action") == "discarded").alias("reads_discarded"),
        F.sum(F.length("seq") - F.col("keep_length")).cast("bigint").alias("bases_removed"),
    )


PARTS = 4  # of a window; two substitutions leave two of them whole
_PAIRS = list(combinations(range(PARTS), 2))
SLOTS = 1 << 22  # bits for each pair of parts in the table of an artifact set's seeds


def _seeds(code: str, k: int) -> Column:
    """The pairs of parts of a code, numbered, as an array to explode."""
    bits = 2 * -(-k // PARTS)
    part = lambda i: F.shiftright(F.col(code), i * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    return F.array(*(F.lit(n << 40).cast("long").bitwiseOR(F.shiftleft(part(i), bits)).bitwiseOR(part(j)) for n, (i, j) in enumerate(_PAIRS)))


def _seed(codes: np.ndarray, n: int, k: int) -> np.ndarray:
    """:func:`_seeds` of codes, of one pair of parts."""
    bits = 2 * -(-k // PARTS)
    i, j = (codes >> np.int64(at * bits) & np.int64((1 << bits) - 1) for at in _PAIRS[n])
    return np.int64(n << 40) | i << np.int64(bits) | j


def _slot(seeds: np.ndarray) -> np.ndarray:
    return runs.mixed(seeds) % np.uint32(SLOTS)


def _seed_table(codes: DataFrame, k: int) -> np.ndarray:
    """Bits of the slots that have a seed, for each pair of parts; the driver gets PARTS * SLOTS / 32 words at most, whatever the set's size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column("near").to_numpy()
            at = np.unique(np.concatenate([_slot(_seed(code, n, k)).astype(np.int64) + n * SLOTS for n in range(len(_PAIRS))]))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["word", "bits"])

    words = codes.select("near").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    table = np.zeros(len(_PAIRS) * SLOTS // 32, np.uint32)
    table[[w.word for w in words]] = [w.bits for w in words]
    return table


def _probes(reads: DataFrame, k: int, stride: int, table: np.ndarray) -> DataFrame:
    """``read_id, pos, code, s``: windows from ``first`` to ``last``, each ``stride``-th, with the seeds of theirs that the table has a bit for."""
    kind = reads.schema["read_id"].dataType.simpleString()
    packed = lambda a, b, m, n: a << np.int64(2 * n) | b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = windows._text(batch.column("seq"), "")
            lengths, ids = np.diff(off), batch.column("read_id")
            low, high = (batch.column(c).to_numpy().astype(np.int64) for c in ("first", "last"))
            for a, b, at, end in windows._segments(lengths, k, windows.SEGMENT):
                lo, hi = (int(off[a]), int(off[b])) if end < 0 else (int(off[a]) + at, int(off[a]) + end + k - 1)
                begin = low[a:b] if end < 0 else np.maximum(low[a:b], -(-at // stride) * stride)
                stop = np.minimum(high[a:b], lengths[a:b] - k if end < 0 else end - 1)
                count = np.maximum((stop - begin) // stride + 1, 0)
                row = np.repeat(np.arange(b - a), count)
                pos = begin[row] + stride * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
                start = off[a:b][row] - lo + pos
                codes = windows._CODE[data[lo:hi]]
                bad = np.append(0, np.cumsum(codes > 3))
                fine = bad[start + k] == bad[start]
                row, pos, start = row[fine], pos[fine], start[fine]
                if not len(row):
                    continue
                code = windows.composed(codes.astype(np.int64) & 3, k, packed)[start] | np.int64(1) << np.int64(2 * k)
                for n in range(len(_PAIRS)):
                    seed = _seed(code, n, k)
                    slot = _slot(seed) + np.uint32(n * SLOTS)
                    hit = np.flatnonzero(table[slot >> np.uint32(5)] >> (slot & np.uint32(31)) & np.uint32(1))
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[hit] + a)), pa.array(pos[hit].astype(np.int32)), pa.array(code[hit]), pa.array(seed[hit])], ["read_id", "pos", "code", "s"])

    return reads.mapInArrow(run, f"read_id {kind}, pos int, code long, s long")


def _substitutions(a: str, b: str) -> Column:
    """Bases in which two codes of one length differ."""
    d = F.col(a).bitwiseXOR(F.col(b))
    return F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseAND(F.lit(0x5555555555555555).cast("long")))


def quality_runs(marks: Column) -> Column:
    """``struct(best, second)`` of a string of 1 and 0: the two longest runs of 1 as ``struct(bl, bo)``, earlier ones first on ties."""
    def made(p):
        runs = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.struct((-F.length(F.get(p, i))).alias("m"), (F.length(F.array_join(F.slice(p, F.lit(1), i), "0")) + F.when(i > 0, 1).otherwise(0)).alias("bo")))
        one = lambda x: F.struct(F.coalesce(-x["m"], F.lit(0)).alias("bl"), F.coalesce(x["bo"], F.lit(0)).alias("bo"))
        return let(F.sort_array(runs), lambda r: F.struct(one(F.get(r, F.lit(0))).alias("best"), one(F.get(r, F.lit(1))).alias("second")))

    return let(F.split(marks, "0"), made)


def artifact_filter(
    reads: DataFrame, artifacts: DataFrame, options: ArtifactOptions = ArtifactOptions(), min_quality: int = 3, min_length: float = 0.40, by_pair: bool = False
) -> DataFrame:
    """What is kept of each read: ``read_id, artifact_id, action, keep_offset, keep_length, rescue_offset, rescue_length``.

    The longest run of good quality comes first. Every ``stride``-th window in it that
    lies within ``edit_distance`` substitutions of an artifact, on either strand, is a
    hit on the nearest artifact, the least id on ties; candidates share two quarters of
    the window with an artifact. The hits' range is cut out of the run, and the longer flank
    stays, the left one on ties. A simple repeat with one and a half windows of good
    bases on both sides is let be. The artifact is that of the last hit. If that is of
    kind ``reference``, the read is discarded; a hit on a ``control`` genome anywhere
    comes before all and discards it too. A read of which only the quality took
    something has the next free id, and its second run, if long enough, is rescued. What
    fails the length rule is discarded.

    ``by_pair``: reads of one common name answer for each other. A control hit discards
    them all, a reference those of them that lose something.
    """
    k = options.match_length
    if options.edit_distance > PARTS - 2 or k > dna.LONGEST:
        raise ValueError(f"at most {PARTS - 2} substitutions in at most {dna.LONGEST} bases")
    seq_len = F.length("seq")
    trimmed = reads.withColumn("_r", quality_runs(quality.good_marks("qual", min_quality)))
    trimmed = trimmed.withColumn("_lo", F.when(F.col("_r.best.bl") > 0, F.col("_r.best.bo")).otherwise(0)).withColumn("_hi", F.col("_lo") + F.col("_r.best.bl"))
    last = F.floor((F.col("_hi") + options.stride - 1) / options.stride) - k // options.stride - F.when(seq_len % options.stride == 0, 0).otherwise(1)
    first = F.floor(F.col("_lo") / options.stride)
    probed = trimmed.where(seq_len >= k).select("read_id", "seq", (first * options.stride).cast("long").alias("first"), (last * options.stride).cast("long").alias("last")).where("first <= last")
    own = artifacts.where(F.length("seq") >= k).select("artifact_id", "kind", F.explode(dna.windows("seq", k)).alias("f")).where(~F.col("f").rlike("[^ACGT]"))
    own = own.select("artifact_id", "kind", F.explode(F.array(F.col("f"), dna.revcomp("f"))).alias("f")).distinct()
    codes = own.select("artifact_id", "kind", dna.code("f").alias("near"))
    own = codes.select("artifact_id", "kind", "near", F.explode(_seeds("near", k)).alias("s"))
    own = F.broadcast(own) if own.count() <= BROADCAST_KMERS else own
    hits = _probes(probed, k, options.stride, _seed_table(codes, k)).join(own, "s").where(_substitutions("code", "near") <= options.edit_distance)
    nearest = hits.groupBy("read_id", "pos").agg(F.min(F.struct(_substitutions("code", "near").alias("d"), "artifact_id", "kind")).alias("h"))
    found = nearest.groupBy("read_id").agg(
        F.min("pos").alias("_a"), (F.max("pos") + k).alias("_b"), F.max_by("h", "pos").alias("_last"),
        F.min(F.when(F.col("h.kind") == "control", F.col("h.artifact_id"))).alias("_control_id"),
    )
    if by_pair:
        found = cut(found)
        grave = found.where((F.col("_last.kind") == "reference") | F.col("_control_id").isNotNull()).join(with_pair_key(reads).select("read_id", "pair_key"), "read_id")
        grave = grave.groupBy("pair_key").agg(F.min("_control_id").alias("_mate_id"), F.lit(True).alias("_mate"))
        j = with_pair_key(trimmed).join(found, "read_id", "left").join(grave, "pair_key", "left").withColumn("_control_id", F.coalesce("_control_id", "_mate_id"))
    else:
        j = trimmed.join(found, "read_id", "left").withColumn("_mate", F.lit(None).cast("boolean"))
    lo, hi, a, b = (F.col(c) for c in ("_lo", "_hi", "_a", "_b"))
    margin = 3 * k // 2
    control = F.col("_control_id").isNotNull()
    let_be = (F.col("_last.kind") == "repeat") & ~control & (a - lo >= margin) & (hi - b >= margin)
    hit = a.isNotNull() & ~F.coalesce(let_be, F.lit(False))
    left = (a - lo) >= (hi - b)
    keep_lo = F.when(hit & ~left, b).otherwise(lo)
    keep_hi = F.when(hit & left, a).otherwise(hi)
    size = F.greatest(keep_hi - keep_lo, F.lit(0))
    only_quality = ~hit & (hi - lo != seq_len)
    quality_id = artifacts.agg(F.coalesce(F.max(F.when(~F.col("kind").isin("control", "reference"), F.col("artifact_id"))), F.lit(-1)) + 1).first()[0]
    lost = (hit & (F.col("_last.kind") == "reference")) | ((hit | only_quality) & F.coalesce("_mate", F.lit(False)))
    fails = ~quality.passes_length(size, seq_len, min_length)
    action = F.when(control | lost, "discarded").when(hit | only_quality, F.when(fails, "discarded").otherwise("trimmed")).otherwise("none")
    rescued = only_quality & quality.passes_length(F.col("_r.second.bl"), seq_len, min_length)
    return j.select(
        "read_id", F.when(control, F.col("_control_id")).when(hit, F.col("_last.artifact_id")).when(only_quality, quality_id).cast("int").alias("artifact_id"), action.alias("action"),
        F.when(action == "discarded", 0).otherwise(keep_lo).cast("int").alias("keep_offset"), F.when(action == "discarded", 0).otherwise(size).cast("int").alias("keep_length"),
        F.when(rescued, F.col("_r.second.bo")).alias("rescue_offset"), F.when(rescued, F.col("_r.second.bl")).alias("rescue_length"),
    )


def discarded_reads(reads: DataFrame, found: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Whole reads that :func:`artifact_filter` discards, labelled with the artifact's name, with ``out_file``: ``Control`` or ``Artifact``."""
    named = F.broadcast(artifacts.select("artifact_id", F.col("name").alias("_artifact"), "kind"))  # of artifacts, not of reads
    gone = reads.drop("label").join(found.where("action = 'discarded'").select("read_id", "artifact_id"), "read_id").join(named, "artifact_id", "left")
    kept = [c for c in reads.columns if c != "label"]
    return gone.select(*kept, F.coalesce("_artifact", F.lit("MinQualityTrim")).alias("label"), F.when(F.col("kind") == "control", "Control").otherwise("Artifact").alias("out_file"))


def apply_filter(reads: DataFrame, found: DataFrame) -> DataFrame:
    """Reads cut as :func:`artifact_filter` says, labelled, with ``discarded``; rescued runs follow as ``<name>-qtrim``.

    Rescued reads go on behind the greatest id.
    """
    j = reads.join(found, "read_id")
    trimmed = F.col("action") == "trimmed"
    part = lambda c: F.when(trimmed, F.substring(c, F.col("keep_offset") + 1, F.col("keep_length"))).otherwise(F.col(c)).alias(c)
    kept = [c for c in reads.columns if c not in ("seq", "qual", "label", "discarded")]
    out = j.select(*kept, part("seq"), part("qual"), F.when(trimmed, F.format_string("AFTrim:%d+%d", "keep_offset", "keep_length")).alias("label"), (F.col("action") == "discarded").alias("discarded"))
    second = lambda c: F.substring(c, F.col("rescue_offset") + 1, F.col("rescue_length")).alias(c)
    top = reads.agg(F.coalesce(F.max("read_id"), F.lit(-1)).alias("_m"))
    named = [F.concat("name", F.lit("-qtrim")).alias("name") if c == "name" else (F.col("read_id") + F.col("_m") + 1).alias("read_id") if c == "read_id" else F.col(c) for c in kept]
    more = j.where("rescue_length IS NOT NULL").crossJoin(F.broadcast(top)).select(*named, second("seq"), second("qual"), F.format_string("AFTrim:%d+%d", "rescue_offset", "rescue_length").alias("label"), F.lit(False).alias("discarded"))
    return out.unionByName(more)
