import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.functions import dna, quality, sam, stats
from strandworks.operators import size, vectors


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first().y


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_reverse_complement_and_canonical(spark):
    for s in ("", "A", "ACGTN", "TTTACG"):
        assert one(spark, s, dna.revcomp("x")) == rc(s) and one(spark, s, dna.revcomp(dna.revcomp("x"))) == s
        assert one(spark, s, dna.canonical("x")) == min(s, rc(s)) == one(spark, rc(s), dna.canonical("x"))


def test_windows_and_short_reads(spark):
    assert one(spark, "ACGTA", dna.windows("x", 3)) == ["ACG", "CGT", "GTA"]
    assert one(spark, "AC", dna.windows("x", 3)) == [] and one(spark, None, dna.windows("x", 3)) is None


def test_pack_and_unpack(spark):
    for s in ("A" * 31, "T" * 31, "ACGT" * 7):
        assert one(spark, one(spark, s, dna.pack("x")), dna.unpack("x", len(s)), "long") == s


def test_neighbours(spark):
    k = "ACGT"
    want = {k[:i] + b + k[i + 1 :] for i in range(4) for b in "ACGT"} - {k}
    assert set(one(spark, k, dna.neighbours("x", 4))) == want and len(one(spark, k, dna.neighbours("x", 4))) == 12
    two = one(spark, k, dna.neighbours_within("x", 4, 2))
    every = {"".join(p) for p in itertools.product("ACGT", repeat=4) if 1 <= sum(a != b for a, b in zip(p, k)) <= 2}
    assert set(two) == every and len(two) == len(every)


def test_masks_and_pieces(spark):
    assert one(spark, "ACGTACGT", dna.mask("x", 2, 3)) == "ACXXXCGT" and one(spark, "ACGT", dna.mask("x", 2, 30)) == "ACXX"
    assert one(spark, "ACNTX", dna.first_markup("x")) == 2 and one(spark, "ACGT", dna.first_markup("x")) == 4
    assert [tuple(p) for p in one(spark, "ACGTAC", dna.shred("x", 4, 2))] == [(0, "ACGT"), (2, "GTAC"), (4, "AC")]
    assert [p.offset for p in one(spark, "ACGTACG", dna.shred("x", 4, 2, True))] == [0, 2] and one(spark, "ACGT", dna.shred("x", 4, 2, True)) == []
    assert one(spark, "ACGT", dna.circularize("x", 2)) == "ACGTAC"


def test_headers(spark):
    for name, number, common in (("r/1", 1, "r/"), ("r/2", 2, "r/"), ("r/A", 1, "r/"), ("r/B", 2, "r/"), ("r/F", 1, "r/"), ("r/R", 2, "r/"), ("r", 0, "r")):
        assert one(spark, name, dna.read_number("x")) == number and one(spark, name, dna.common_name("x")) == common
    assert one(spark, "2:N:0:ACGT", dna.read_number(F.lit("r"), F.col("x"))) == 2


def test_qualities(spark):
    assert one(spark, "!#I", quality.phreds("x")) == [0, 2, 40] and one(spark, "!#I", quality.quality_text(quality.phreds("x"))) == "!#I"
    assert one(spark, "BI", quality.rescale("x", 33, 64)) == "ah" and one(spark, "ah", quality.rescale("x", 64, 33)) == "BI"
    assert one(spark, 2, quality.p_correct(F.col("x")), "int") == 0 and one(spark, 20, quality.p_correct(F.col("x")), "int") == 0.99 and one(spark, None, quality.p_correct(F.col("x")), "int") == 1
    assert one(spark, 0.99, quality.to_phred(F.col("x")), "double") in (19, 20) and one(spark, 1.0, quality.to_phred(F.col("x")), "double") == 40
    assert one(spark, "!#I", quality.qual_numbers("x")) == "0 2 40"


@pytest.mark.parametrize("flags", ["", "0", "1", "0110111011", "1110111", "000", "1111"])
def test_longest_run(spark, flags):
    got = one(spark, [c == "1" for c in flags], quality.longest_run(F.col("x")), "array<boolean>")
    best = max((len(r) for r in flags.split("0")), default=0)
    assert got.bl == best and got.bo == (flags.index("1" * best) if best else 0)


def test_ranks_and_distances(spark):
    v = [float(i // 2) for i in range(10)]
    assert one(spark, v, stats.average_ranks("x"), "array<double>") == [2 * (i // 2) + 1.5 for i in range(10)]
    a = one(spark, v, stats.spearman_distance(stats.average_ranks("x"), stats.average_ranks(F.reverse("x"))), "array<double>")
    assert abs(a - 1) < 1e-12
    assert one(spark, [3.0, 4.0], stats.unit("x"), "array<double>") == [0.6, 0.8]
    assert one(spark, [5, 1, 9, 7], stats.upper_median(F.col("x")), "array<int>") == 7


def test_change_point(spark):
    assert one(spark, [30.0, 34.0, 31.0, 34.0, 33.0, 29.0, 4.0, 3.0, 2.0, 4.0], stats.change_point("x"), "array<double>") == 6
    assert [one(spark, v, stats.change_point("x"), "array<double>") for v in ([], [1.0], [5.0, 5.0, 5.0])] == [0, 0, 0]


def test_cigars(spark):
    assert one(spark, "10S20M5D3I10M", sam.reference_length("x")) == 35 and one(spark, "10S20M5D3I10M", sam.aligned_bases("x")) == 30


def test_size_fit():
    x = np.linspace(1e4, 2e6, 40)
    got = size.fit(x, size.unique_growth(x, 0.03, 3e5))
    assert abs(got["error_rate"] - 0.03) < 1e-3 and abs(got["genome_kmers"] / 3e5 - 1) < 0.01
    assert size.saturating_fit(x, size.unique_growth(x, 0.03, 3e5))["genome_kmers"] > 1e5


def test_cluster_and_dimension(spark):
    assert len(vectors.canonical_kmers(4)) == 136
    assert [r.kmer for r in vectors.dimension(spark, 4).orderBy("idx").collect()] == vectors.canonical_kmers(4)
    assert sorted(vectors.cluster(["a", "b", "c"], np.array([[9, 1], [18, 2.1], [1, 9]]), 0.2)) == [["a", "b"], ["c"]]


def test_whole_sequences_are_packed(spark):
    from strandworks.functions import dna

    seqs = ["", "A", "ACGT" * 8, "T" * 31, "G" * 62, "ACGTNNRA" + "TTGCA" * 30 + "N", "N", None]
    rows = spark.createDataFrame(list(enumerate(seqs)), "i int, s string").select("i", dna.pack_whole("s").alias("p")).select("i", "p", dna.unpack_whole("p").alias("u")).collect()
    for r in rows:
        assert r.u == seqs[r.i]
        if r.p is not None:
            assert r.p.bases == len(seqs[r.i]) and len(r.p.words) == -(-len(seqs[r.i]) // 31)
