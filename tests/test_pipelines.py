"""Read and assembly pipelines against brute force, and invariance under repartitioning."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandworks.config import ArtifactOptions, ExtendOptions, KmerOptions, SelectOptions, VariantOptions
from strandworks.functions import dna
from strandworks.operators import artifacts, assembly, dedup, kmers
from strandworks.operators import reads as rd
from strandworks.sources import constants

from .oracle import assert_equal, tables

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(RC)


def genome(n, seed=3):
    rnd = random.Random(seed)
    return "".join(rnd.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def sample():
    rnd, g, rows = random.Random(8), genome(600), []
    for i in range(60):
        a = rnd.randrange(0, 500)
        for mate in (1, 2):
            s = g[a : a + 80] if mate == 1 else rc(g[a + 20 : a + 100])
            s = "".join(rnd.choice("ACGTN") if rnd.random() < 0.01 else c for c in s)
            q = [rnd.choice([2, 20, 30, 40]) if rnd.random() < 0.1 else 35 for _ in s]
            rows.append((len(rows), f"f{i}/{mate}", None, s, "".join(chr(33 + v) for v in q)))
    return rows


@pytest.fixture(scope="module")
def reads(spark, sample):
    return spark.createDataFrame(sample, "read_id long, name string, comment string, seq string, qual string").cache()


def run_of(flags):
    best, i = (0, 0), 0
    while i < len(flags):
        j = i
        while j < len(flags) and flags[j]:
            j += 1
        if j - i > best[1]:
            best = (i, j - i)
        i = max(j, i + 1)
    return best


def brute_filter(rows, k, minimum, both):
    cut = []
    for i, name, _, s, q in rows:
        flags = [ord(c) - 33 >= 3 for c in q]
        off, n = run_of(flags)
        ok = n > 1 and (len(s) * minimum <= n if minimum <= 1 else n >= minimum)
        if n == len(s):
            cut.append((i, name, s, q, None, False))
        elif ok:
            cut.append((i, name, s[off : off + n], q[off : off + n], f"AFTrim:{off}+{n}", False))
        else:
            cut.append((i, name, s, q, None, True))
    count = Counter()
    for _, _, s, q, _, gone in cut:
        if gone:
            continue
        for p in range(len(s) - k + 1):
            m = s[p : p + k]
            w = math.prod(0 if ord(c) - 33 < 3 else 1 - 10 ** (-(ord(c) - 33) / 10) for c in q[p : p + k])
            if set(m) <= set("ACGT") and w > 0.1:
                count[min(m, rc(m))] += 1
    out = {}
    for i, name, s, q, label, gone in cut:
        # Windows from the first letter other than ACGT on are not scored.
        end = next((j for j, c in enumerate(s) if c not in "ACGT"), len(s))
        vals = [count[min(s[p : p + k], rc(s[p : p + k]))] for p in range(end - k + 1)]
        vals = [v if v >= 2 else 0 for v in vals] if not gone else []
        off, n = run_of([v > 0 for v in vals])
        med = sorted(vals[off : off + n])[n // 2] if n else 0
        length = n + k - 1 if n else 0
        ok = not gone and med >= 2 and length > 1 and (len(s) * minimum <= length if minimum <= 1 else length >= minimum)
        out[i] = (name.rsplit("/", 1)[0], ok, off, length, med)
    pairs = defaultdict(list)
    for v in out.values():
        pairs[v[0]].append(v[1])
    good = {p for p, oks in pairs.items() if sum(oks) >= min(both, len(oks)) and any(oks)}
    return {i: v[1:] for i, v in out.items() if v[0] in good}


@pytest.mark.parametrize("minimum,both", [(0.4, 1), (25, 2), (0.85, 1), (1, 2)])
def test_filter_reads(reads, sample, minimum, both):
    got = rd.filter_reads(reads, 15, SelectOptions(scoring="MEDIAN", min_length=minimum, min_passing_in_pair=both), trim_min_length=minimum).collect()
    want = brute_filter(sample, 15, minimum, both)
    assert {g.read_id: (g.passes, g.trim_offset or 0, g.trim_length or 0, int(g.score or 0)) for g in got} == want


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_spectrum_does_not_depend_on_partitions(reads, sample, parts):
    want = Counter()
    for *_, s, _q in sample:
        for p in range(len(s) - 10):
            m = s[p : p + 11]
            if set(m) <= set("ACGT"):
                want[min(m, rc(m))] += 1
    got = kmers.build_spectrum(reads.repartition(parts), KmerOptions(k=11, min_depth=1), weighted=False)
    assert {r.kmer: r.n for r in got.collect()} == dict(want)
    h = kmers.histogram(got).orderBy("bucket").collect()
    assert sum(r.visits for r in h) == sum(want.values()) and h[0].cum_kmers == len(want)


def test_discarded_reads_and_subtraction(reads):
    none = reads.withColumn("discarded", F.lit(True))
    assert kmers.observe(none, 11).count() == 0
    spec = kmers.spectrum(kmers.observe(reads, 11))
    assert kmers.subtract_kmers(spec, spec.where("n > 1")).where("n > 1").count() == 0
    same = kmers.compare(spec, spec).first()
    assert same.common == same.total_a == same.total_b and same.visits_a == same.visits_b


def test_pairs(spark):
    rows = [(0, "a/1", None), (1, "a/2", None), (2, "b/1", None), (3, "c", "2:N:0:"), (4, "c", "1:N:0:"), (5, "d/2", None), (6, "a/1", None), (7, "e", None)]
    got = rd.identify_pairs(spark.createDataFrame(rows, "read_id long, name string, comment string")).collect()
    assert sorted((g.read1, g.read2) for g in got if g.read1 is not None and g.read2 is not None) == [(0, 1), (4, 3)]
    assert sorted(g.read1 for g in got if g.read2 is None) == [2, 6, 7] and [g.read2 for g in got if g.read1 is None] == [5]


def test_artifacts(spark):
    adapter = dict((n, s) for _, n, _, s in constants.artifact_rows())["PE_Adapters1"]
    assert len(constants.artifact_rows()) == 188 == len(constants.ADAPTERS) + len(constants.REPEAT_UNITS) + 1
    body = genome(60, 11)
    one = adapter[:10] + ("A" if adapter[10] != "A" else "C") + adapter[11:]
    rows = [(0, body), (1, adapter + body), (2, body + one), (3, body[:5] + rc(adapter)), (4, adapter)]
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    table = constants.artifacts(spark)
    hits = artifacts.match(reads, table, ArtifactOptions().match_length, 1, 4)
    got = {r.read_id: (r.action, r.keep_offset, r.keep_length) for r in artifacts.trim_artifacts(reads, hits, table).collect()}
    assert got[0] == ("none", 0, 60) and got[1][0] == "trimmed" and got[1][1] >= 24 and got[2][0] == "trimmed" and got[2][1] == 0 and got[3][0] == got[4][0] == "discarded"
    s = artifacts.summary(artifacts.trim_artifacts(reads, hits, table)).collect()
    assert sum(r.reads_trimmed for r in s) == 2 and sum(r.reads_discarded for r in s) == 2


def test_duplicates_and_consensus(spark):
    g = genome(200, 12)
    a, b = g[:60], rc(g[100:160])
    bad = a[:40] + ("A" if a[40] != "A" else "C") + a[41:]
    rows = [(1, a, b), (2, bad, b), (3, a, b), (4, b, a), (5, g[50:110], b)]
    q = [30] * 60
    pairs = spark.createDataFrame([(i, s, t, q, q) for i, s, t in rows], "pair_id long, seq1 string, seq2 string, q1 array<int>, q2 array<int>")
    assert [(r.members, r.first_pair) for r in dedup.duplicate_groups(pairs).collect()] == [(3, 1)]
    assert [(r.members, r.first_pair) for r in dedup.duplicate_groups(pairs, mode=2).collect()] == [(4, 1)]
    single, made = dedup.dedup_fragments(pairs)
    assert sorted(r.pair_id for r in single.collect()) == [4, 5]
    assert sorted((r.name, r.seq) for r in made.collect()) == [("C3-1/1", a), ("C3-1/2", b)]
    near = dedup.centroid(spark.createDataFrame([("k", 7, bad), ("k", 8, a)], "grp string, read_id long, seq string"), spark.createDataFrame([("k", a)], "grp string, cons_seq string"))
    assert (near.first().read_id, near.first().distance) == (8, 0)


def test_sampling_and_splitting(spark):
    rows = spark.range(1000).withColumnRenamed("id", "read_id").withColumn("pair_no", F.floor(F.col("read_id") / 2))
    a = rd.random_sample(rows, 137, "read_id", 5).collect()
    assert len(a) == 137 and {r.read_id for r in a} == {r.read_id for r in rd.random_sample(rows.repartition(9), 137, "read_id", 5).collect()}
    parts = rd.split_parts(rows, 7).collect()
    assert Counter(r.part for r in parts).keys() == set(range(7))
    by = sorted((r.read_id, r.part) for r in parts)
    assert [p for _, p in by] == sorted(p for _, p in by) and all(x[1] == y[1] for x, y in zip(by[::2], by[1::2]))
    assert rd.append(rows, rows).select("read_id").distinct().count() == 2000


def test_a_read_matches_itself_and_a_genome_is_rebuilt(spark):
    g = genome(400, 21)
    reads = spark.createDataFrame([(i, f"x{i}/1", g[a : a + 60], f"x{i}/") for i, a in enumerate([*range(0, 341, 4)] * 2)], "read_id long, name string, seq string, pair_key string")
    seed = spark.createDataFrame([(1, g[150:220])], "contig_id long, seq string")
    same = assembly.match(reads.where("read_id = 3").select(F.col("read_id").alias("contig_id"), "seq"), kmers.observe(reads, 21), 21)
    assert 3 in {r.read_id for r in same.collect()}
    options = ExtendOptions(max_steps=4, min_coverage=4.8)
    grown = assembly.assemble(seed, reads, 21, options, rounds=1).first().seq
    assert grown in g and len(grown) == 78
    spec = kmers.spectrum(kmers.observe(reads, 21))
    assert assembly.covered_bases(spark.createDataFrame([(1, g)], "contig_id long, seq string"), spec, 21).first().covered == 400
    assert spark.createDataFrame([("c-l3r4", 1, 2), ("c", 5, 0)], "name string, left int, right int").select(assembly.rename().alias("n")).collect()[0].n == "c-l4r6"


def test_variants_are_purged(spark):
    strong = "ACGTACGTTAC"
    weak = strong[:5] + "A" + strong[6:]
    two = weak[:8] + "G" + weak[9:]
    rows = [(min(m, rc(m)), n) for m, n in ((strong, 1000), (weak, 10), (two, 10), ("TTTTTGGGGGC", 10))]
    spec = spark.createDataFrame(rows, "kmer string, n long")
    left = lambda **o: {r.kmer for r in kmers.purge_variants(spec, 11, VariantOptions(**o)).collect()}
    keep = lambda *ms: {min(m, rc(m)) for m in ms}
    assert left(sigmas=3.0) == keep(strong, "TTTTTGGGGGC")
    assert left(sigmas=3.0, edit_distance=1) == keep(strong, two, "TTTTTGGGGGC")
    assert left(sigmas=3.0, distance_factor=200.0) == keep(strong, two, "TTTTTGGGGGC")
    assert left() == {m for m, _ in rows}


def test_codes_of_neighbours(spark):
    rnd = random.Random(3)
    for k in (1, 4, 11, 31):
        own = ["".join(rnd.choice("ACGT") for _ in range(k)) for _ in range(6)]
        df = spark.createDataFrame([(m,) for m in own], "kmer string").withColumn("code", dna.code("kmer"))
        assert {r.kmer: r.o for r in df.select("kmer", dna.kmer_of(dna.rc_code("code", k)).alias("o")).collect()} == {m: rc(m) for m in own}
        for d in (1, 2):
            if d > k or (k == 31 and d == 2):
                continue
            got = {(r.kmer, r.p) for r in kmers.probes(df, k, d).select("kmer", dna.kmer_of("probe").alias("p")).collect()}
            want = set()
            for m in own:
                for at in itertools.combinations(range(k), d):
                    for new in itertools.product("ACGT", repeat=d):
                        x = list(m)
                        for i, b in zip(at, new):
                            x[i] = b
                        if sum(a != b for a, b in zip(x, m)) == d:
                            want.add((m, min("".join(x), rc("".join(x)))))
            assert got == {w for w in want if w[0] != w[1]}


def test_stream_equals_batch(spark, tmp_path, reads):
    from strandworks.streaming import kmers as streaming

    reads.select("read_id", "seq").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streaming.stream_of(spark, str(tmp_path / "in"), "read_id long, seq string")
    counts = streaming.Counts(spark, f"file://{tmp_path}/counts", 11)
    assert counts.counts().count() == 0 and counts.sizes().count() == 0
    streaming.run_available(stream, counts, str(tmp_path / "ck"))
    want = sorted(map(tuple, kmers.spectrum(kmers.observe(reads, 11)).select("kmer", "n").collect()))
    assert sorted(map(tuple, counts.counts().collect())) == want
    sizes = counts.sizes().orderBy("batch").collect()
    assert len(sizes) > 1 and (sizes[-1].raw, sizes[-1].distinct_kmers, sizes[-1].singletons) == (sum(n for _, n in want), len(want), sum(n == 1 for _, n in want))
    assert all(b.raw >= a.raw * 1.05 for a, b in zip(sizes, sizes[1:]))
    counts.add(reads, counts.state()["batch"])  # a batch that comes again
    assert sorted(map(tuple, counts.counts().collect())) == want


def test_purge_bounds_the_running_table(spark, tmp_path, reads):
    from strandworks.streaming import kmers as streaming

    counts = streaming.Counts(spark, f"file://{tmp_path}/purged", 11, growth=1.0, purge_every=2)
    parts = [reads.where(f"read_id % 4 = {i}") for i in range(4)]
    want, purged = Counter(), 0
    for i, part in enumerate(parts):
        counts.add(part, i)
        want.update({r.kmer: r.n for r in kmers.spectrum(kmers.observe(part, 11)).collect()})
        if i % 2:
            purged += sum(n == 1 for n in want.values())
            want = Counter({m: n for m, n in want.items() if n > 1})
    assert {r.kmer: r.n for r in counts.counts().collect()} == dict(want)
    assert counts.state()["purged"] == purged and counts.state()["batches"] == []
    assert streaming.sampling_rounds(reads, streaming.Counts(spark, f"file://{tmp_path}/rounds", 11), 5, 0.5) == 0.6


def test_discarded_mate_is_a_placeholder(spark):
    picked = spark.createDataFrame([(0, "a/1", "ACGT", "IIII", None, True, None, None, None, None)], "read_id long, name string, seq string, qual string, label string, discarded boolean, trim_offset int, trim_length int, score double, windows int")
    row = rd.as_output(picked, 3).first()
    assert (row.seq, row.qual, row.labels) == ("N", '"', "") and dna.common_name(F.lit("a/1")) is not None


def test_contigs_grow_by_more_than_five_bases(spark, tmp_path):
    import random

    from strandworks.plans import catalogue

    letters = "".join(random.Random(5).choices("ABCD", k=400))
    spark.createDataFrame([(i, letters) for i in range(6)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, letters[:392])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    grown = catalogue.contig_extend(spark, str(tmp_path))
    r = grown.first()
    assert (r["left"], r["right"]) == (0, 8)
    assert_equal(grown, tables(str(tmp_path)), catalogue.oracle_sql()["contig_extend"])


def test_size_from_snapshots_of_a_sample(spark):
    """The same curve as counting the sampled reads one after another, and its fit."""
    from strandworks.operators import size

    g, rnd, k = genome(3000, 41), random.Random(9), 15
    rows = [(i, g[a : a + 60]) for i, a in enumerate(rnd.randrange(0, 2940) for _ in range(900))]
    got = size.estimate(spark.createDataFrame(rows, "read_id long, seq string"), k, fraction=0.32, partitions=10)
    some = [(i, s) for i, s in rows if int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 10 < 4]
    limit, raw, seen, curve = 128, 0, set(), {}
    for _, s in some:
        part = sum(x <= raw for x in kmers.growth_limits(10**6))
        for w in (s[j : j + k] for j in range(len(s) - k + 1)):
            seen.add(min(w, rc(w)))
            raw += 1
        curve[part] = (raw, len(seen))
    x, u = zip(*(curve[p] for p in sorted(curve)))
    want = size.fit(x, u)
    assert got["fraction"] == 0.4 and got["snapshots"] == len(x) and got["raw_kmers"] == raw / 0.4
    assert abs(got["genome_kmers"] - want["genome_kmers"]) < 1e-6 * want["genome_kmers"] and abs(got["error_rate"] - want["error_rate"]) < 1e-9
    assert abs(got["genome_kmers"] - 2986) < 300
    assert size.estimate(spark.createDataFrame([(1, "ACGT")], "read_id long, seq string"), k) == {}
