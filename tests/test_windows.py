"""Windows as numbers against windows as text and against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandworks.config import KmerOptions
from strandworks.functions import dna, quality
from strandworks.operators import kmers, windows

SCHEMA = "read_id long, seq string, qual string"


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(60):
        n = rnd.choice([0, 1, 4, 10, 11, 12, 35, 90, 200])
        s = "".join(rnd.choice("ACGTACGTACGTACGTN") for _ in range(n))
        q = "".join(chr(33 + rnd.choice([2, 10, 30, 40])) for _ in range(n))
        rows.append((i, s, None if i % 7 == 0 else q[:-3] if i % 11 == 0 else q))
    rows += [(100, None, None), (101, "acgtacgtacgtacgt", "I" * 16), (102, "ACGT" * 20, None), (102, "ACGT" * 20, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def brute(rows, k):
    out = []
    for i, s, q in rows:
        for p in range(len(s or "") - k + 1):
            f = s[p : p + k]
            if not set(f) <= set("ACGT"):
                continue
            r = f[::-1].translate(str.maketrans("ACGT", "TGCA"))
            v = [None if q is None else ord(q[j]) - 33 if j < len(q) else -1 for j in range(len(s))]
            w = math.prod(1 if x is None else 0 if x < 3 else 1 - 10 ** (-x / 10) for x in v[p : p + k])
            before, after = (s[p - 1] if p else "X"), (s[p + k] if p + k < len(s) else "X")
            flip = {"A": "T", "C": "G", "G": "C", "T": "A"}
            left, right = (before, after) if f <= r else (flip.get(after, after), flip.get(before, before))
            out.append((i, p, min(f, r), f <= r, round(w, 9), left, right))
    return sorted(out)


@pytest.mark.parametrize("k", [1, 2, 4, 11, 21, 31, 33])
def test_windows(odd, k):
    rows, df = odd
    got = kmers.observe(df, k, weighted=True, extensions=True, every=True)
    assert ("code" in got.columns) == (k <= 31)
    have = sorted((r.read_id, r.pos, r.kmer, r.is_fwd, round(r.weight, 9), r.left, r.right) for r in got.collect())
    assert have == brute(rows, k)
    some = kmers.observe(df, k, weighted=True, options=KmerOptions(k=k, min_weight=0.5))
    assert some.count() == sum(1 for b in brute(rows, k) if b[4] > 0.5)


@pytest.mark.parametrize("segment", [128, 40])
def test_long_sequences_go_in_pieces(spark, segment):
    rnd = random.Random(9)
    seqs = ["".join(rnd.choice("ACGTACGTACGTACGTN") for _ in range(n)) for n in (700, 30, 129, 128, 4, 1000)]
    df = spark.createDataFrame([(i, s, "".join(chr(35 + j % 40) for j in range(len(s)))) for i, s in enumerate(seqs)], SCHEMA).coalesce(1)
    got = windows.windows(df, 21, quality.p_table(), True, segment=segment).withColumn("kmer", dna.kmer_of("code")).collect()
    letter = (windows.LETTERS + "?").__getitem__
    assert sorted((r.read_id, r.pos, r.kmer, r.is_fwd, round(r.weight, 9), letter(r.left), letter(r.right)) for r in got) == brute([tuple(r) for r in df.collect()], 21)


def test_codes(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ACGT") for _ in range(n)) for n in (1, 5, 15, 16, 30, 31) for _ in range(20)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", dna.code("t").alias("c")).withColumn("back", dna.kmer_of("c")).collect()
    assert all(r.t == r.back for r in got)
    of = {r.t: r.c for r in got}
    for n in (5, 31):
        same = sorted(t for t in of if len(t) == n)
        assert [of[t] for t in same] == sorted(of[t] for t in same)


def test_empty_and_discarded(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert kmers.observe(none, 21).count() == 0
    assert kmers.spectrum(kmers.observe(none, 21, weighted=True), coded=True).columns == ["kmer", "n", "n_fwd", "w", "code"]
    gone = spark.createDataFrame([(1, "ACGT" * 9, "I" * 36)], SCHEMA).withColumn("discarded", F.lit(True))
    assert kmers.observe(gone, 21).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 7, 8])
@pytest.mark.parametrize("segment", [1 << 20, 16])
def test_short_kmers_are_counted_in_a_table(odd, monkeypatch, k, segment):
    monkeypatch.setattr(windows, "SEGMENT", segment)
    _, df = odd
    want = kmers.spectrum(kmers.observe(df, k), 2, coded=True)
    got = kmers.count(df, k, 2, coded=True)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert kmers.count(df.withColumn("discarded", F.lit(True)), k).count() == 0


@pytest.mark.parametrize("name", ["extend_kmer", "permute_neighbors", "permuted_scores"])
def test_windows_of_short_kmers_are_not_dealt_out_by_minimizer(spark, sf, monkeypatch, name):
    """Of 7 bases there are some 32 minimizers, whatever the input: a task would hold a large part of all windows."""
    from strandworks.operators import runs
    from strandworks.plans import catalogue

    dealt, made = [], runs._by_bucket
    monkeypatch.setattr(runs, "_by_bucket", lambda *a, **b: dealt.append(a) or made(*a, **b))
    assert catalogue.queries()[name](spark, sf).count() > 0 and not dealt


def test_starts_of_md5_are_those_of_the_text():
    import hashlib

    import numpy as np

    rnd = random.Random(9)
    for k in range(1, dna.LONGEST + 1):
        mers = ["".join(rnd.choices("ACGT", k=k)) for _ in range(40)]
        codes = np.array([int("1" + "".join(f"{'ACGT'.index(b):02b}" for b in m), 2) for m in mers])
        assert windows.md5_start(codes, k).tolist() == [int(hashlib.md5(m.encode()).hexdigest()[:8], 16) for m in mers]


@pytest.mark.parametrize("k", [5, 21, 33])
def test_a_sample_is_taken_before_rows_are_made(spark, sf, odd, k):
    from strandworks.plans import catalogue

    _, df = odd
    for weighted in (False, True):
        want = kmers.observe(df, k, weighted, weighted).where(kmers.in_sample("kmer", 3))
        assert sorted(map(str, kmers.observe(df, k, weighted, weighted, sample=3).collect())) == sorted(map(str, want.collect()))
    for name in ("kmer_subsample", "sampled_totals"):
        assert "md5" not in catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
