"""Alignment records: order, merging, mates, unmapped reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.functions import sam


def sort_columns(references: list[str] | None = None) -> list[Column]:
    """Coordinate order: reference (by header order if given), position, name, mapped first, read 1 first; unmapped last."""
    if references:
        order = F.create_map(*(F.lit(x) for i, r in enumerate(references) for x in (r, i)))
        tid = F.coalesce(order[F.col("rname")], F.lit(len(references)))
    else:
        tid = F.col("rname")
    lost = F.col("rname").isNull() | (F.col("rname") == "*")
    return [lost.cast("int"), F.when(~lost, tid), F.col("pos"), F.col("qname"), sam.has("flag", "unmapped").cast("int"), sam.has("flag", "read2").cast("int"), F.col("flag")]


def coordinate_sort(records: DataFrame, references: list[str] | None = None) -> DataFrame:
    """Global coordinate sort: range partitions, each sorted."""
    keys = [k.alias(f"_o{i}") for i, k in enumerate(sort_columns(references))]
    keyed = records.select("*", *keys)
    names = [f"_o{i}" for i in range(len(keys))]
    return keyed.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)


def split_unmapped(records: DataFrame) -> DataFrame:
    """Add ``kind``: mapped, single, pair_unmapped, or mate_mapped."""
    un, paired, mate = (sam.has("flag", n) for n in ("unmapped", "paired", "mate_unmapped"))
    return records.withColumn("kind", F.when(~un, "mapped").when(~paired, "single").when(mate, "pair_unmapped").otherwise("mate_mapped"))


def keep_aligned(records: DataFrame) -> DataFrame:
    """Records of which the read, or in a pair either mate, is mapped."""
    return records.where(~sam.has("flag", "unmapped") | (sam.has("flag", "paired") & ~sam.has("flag", "mate_unmapped")))


def decode_flags(records: DataFrame) -> DataFrame:
    return records.select("*", *(sam.has("flag", n).alias(f"is_{n}") for n in sam.FLAGS))


def best_alignments(records: DataFrame) -> DataFrame:
    """The best record of each ``(qname, mate)`` over index parts: least rank, then greatest score, then least part.

    ``records`` has ``qname, flag, nm, mapq, cigar, seq_len, as_score, part``.
    """
    mate = F.when(sam.has("flag", "read2"), 2).when(sam.has("flag", "read1"), 1).otherwise(0)
    ranked = records.withColumn("mate", mate).withColumn("rank", sam.rank_score(F.col("flag"), F.col("nm"), F.col("mapq"), sam.aligned_bases("cigar"), F.col("seq_len")))
    rest = [c for c in ranked.columns if c not in ("qname", "mate", "rank", "as_score", "part")]
    top = F.min(F.struct("rank", (-F.col("as_score")).alias("neg"), "part", *rest)).alias("b")
    out = ranked.groupBy("qname", "mate").agg(top)
    return out.select("qname", "mate", "b.rank", (-F.col("b.neg")).alias("as_score"), "b.part", *(f"b.{c}" for c in rest))


def best_pairs(records: DataFrame) -> DataFrame:
    """The best record of each ``(qname, mate)``, mates of one index part ranked together: ``qname, mate, part, together, rank``.

    The pair of least summed rank comes first, then of the greatest summed score, then
    of the least part. It stands if both mates are proper or lie on one reference;
    else each mate has its own best record, as has one without a mate.
    """
    mate = F.when(sam.has("flag", "read2"), 2).otherwise(1)
    own = records.withColumn("mate", mate).withColumn("_s", sam.rank_score(F.col("flag"), F.col("nm"), F.col("mapq"), F.col("aligned") if "aligned" in records.columns else sam.aligned_bases("cigar"), F.col("seq_len")))
    side = lambda n: own.where(F.col("mate") == n).select("qname", "part", *(F.col(c).alias(f"{c}{n}") for c in ("flag", "rname", "_s", "as_score")))
    both = side(1).join(side(2), ["qname", "part"])
    apart = F.col("rname1") != F.col("rname2")
    rank = sum((F.col(f"_s{n}") + sam.pair_terms(F.col(f"flag{n}"), apart) for n in (1, 2)), F.lit(0).cast("bigint"))
    proper = sam.has("flag1", "proper") & sam.has("flag2", "proper")
    best = both.groupBy("qname").agg(F.min(F.struct(rank.alias("rank"), (-F.col("as_score1") - F.col("as_score2")).alias("neg"), "part", (proper | ~apart).alias("together"))).alias("p"))
    single = own.groupBy("qname", "mate").agg(F.min(F.struct("_s", (-F.col("as_score")).alias("neg"), "part")).alias("o"))
    j = single.join(best, "qname", "left")
    together = F.coalesce("p.together", F.lit(False))
    return j.select("qname", "mate", F.when(together, F.col("p.part")).otherwise(F.col("o.part")).alias("part"), together.alias("together"), F.when(together, F.col("p.rank")).alias("rank"))


def fix_mates(records: DataFrame) -> DataFrame:
    """Set RNEXT, PNEXT, mate flags and TLEN from the mate with the same name.

    TLEN spans the outer ends of two mates on one reference, positive for the left one.
    """
    clear = ~(0x2 | 0x8 | 0x20) & 0xFFFF
    ends = records.withColumn("_end", F.col("pos") + F.greatest(F.lit(1), sam.reference_length("cigar")) - 1)
    mate = ends.select("qname", sam.has("flag", "read1").alias("_r1"), F.col("flag").alias("m_flag"), F.col("rname").alias("m_rname"), F.col("pos").alias("m_pos"), F.col("_end").alias("m_end"))
    mate = mate.withColumn("_other", ~F.col("_r1")).drop("_r1")
    both = ends.withColumn("_r1", sam.has("flag", "read1"))
    j = both.join(mate, (both["qname"] == mate["qname"]) & (both["_r1"] == mate["_other"]), "left").drop(mate["qname"])
    found = F.col("m_flag").isNotNull()
    here, there = ~sam.has("flag", "unmapped"), ~sam.has("m_flag", "unmapped")
    same = here & there & (F.col("rname") == F.col("m_rname"))
    span = F.greatest("_end", "m_end") - F.least("pos", "m_pos") + 1
    sign = F.when((F.col("pos") < F.col("m_pos")) | ((F.col("pos") == F.col("m_pos")) & F.col("_r1")), 1).otherwise(-1)
    flag = F.col("flag").bitwiseAND(F.lit(clear)).bitwiseOR(F.when(found & ~there, 0x8).otherwise(0)).bitwiseOR(F.when(found & sam.has("m_flag", "reverse"), 0x20).otherwise(0)).bitwiseOR(F.when(same, 0x2).otherwise(0))
    return j.select(
        "qname", F.when(found, flag).otherwise(F.col("flag")).cast("int").alias("flag"), "rname", "pos",
        F.when(~found, "*").when(same, "=").otherwise(F.col("m_rname")).alias("rnext"), F.when(found, F.col("m_pos")).otherwise(0).cast("int").alias("pnext"),
        F.when(same, sign * span).otherwise(0).cast("int").alias("tlen"),
    )


def mapped_percent(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("reads"), F.count_if(~sam.has("flag", "unmapped")).alias("mapped"), (F.count_if(~sam.has("flag", "unmapped")) * 100.0 / F.count("*")).alias("percent"))
