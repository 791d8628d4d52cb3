"""Artifact filter, duplicates, covers and pairing against brute force."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandworks.config import ArtifactOptions, DedupOptions, MatchOptions
from strandworks.operators import artifacts, assembly, dedup, ordered
from strandworks.operators import reads as rd
from strandworks.sources import constants

from .test_pipelines import genome, rc

READ = "read_id long, name string, comment string, seq string, qual string"


def brute_filter(seq, qual, table, min_length, k=24, edits=2, stride=4):
    runs, i = [], 0
    while i <= len(qual):
        j = i
        while j < len(qual) and ord(qual[j]) - 33 >= 3:
            j += 1
        runs.append((i, j - i))
        i = j + 1
    runs.sort(key=lambda r: (-r[1], r[0]))
    (lo, n), second = runs[0], (runs[1] if len(runs) > 1 else (0, 0))
    lo, hi = (lo, lo + n) if n else (0, 0)
    last = (hi + stride - 1) // stride - k // stride - (0 if len(seq) % stride == 0 else 1)
    hits = []
    differ = lambda x, y: sum(a != b for a, b in zip(x, y))
    for p in range(lo // stride * stride, last * stride + 1, stride):
        f = seq[p : p + k]
        if len(f) < k or set(f) - set("ACGT"):
            continue
        at = []
        for ident, _, kind, art in table:
            for w in range(len(art) - k + 1):
                m = art[w : w + k]
                if not set(m) - set("ACGT"):
                    at.append((min(differ(f, m), differ(f, rc(m))), ident, kind))
        if min(at, default=(k,))[0] <= edits:
            hits.append((p, *min(at)[1:]))
    hit = control = False
    ident = None
    keep = (lo, hi)
    if hits:
        a, b = min(h[0] for h in hits), max(h[0] for h in hits) + k
        at_end = max(hits)[1:]
        refs = [h[1] for h in hits if h[2] == "control"]
        control = bool(refs) or at_end[1] == "reference"
        hit = control or not (at_end[1] == "repeat" and a - lo >= 36 and hi - b >= 36)
        if hit:
            ident = min(refs) if refs else at_end[0]
            keep = (lo, a) if a - lo >= hi - b else (b, hi)
    size = max(keep[1] - keep[0], 0)
    enough = lambda v: v > 1 and len(seq) * min_length <= v
    only = not hit and hi - lo != len(seq)
    action = "none" if not hit and not only else "discarded" if control or not enough(size) else "trimmed"
    if only:
        ident = max(t[0] for t in table if t[2] not in ("control", "reference")) + 1
    rescue = second if only and enough(second[1]) else None
    return ident, action, keep[0] if action != "discarded" else 0, size if action != "discarded" else 0, rescue


def test_artifact_filter(spark):
    rnd = random.Random(6)
    table = [(0, "a", "adapter", "GATCGGAAGAGCGGTTCAGCAGGAATGCCGAG"), (1, "b", "adapter", "ACACTCTTTCCCTACACGACGCTCTTCCGATCT"), (2, "(CAG)n", "repeat", "CAG" * 40), (3, "odd", "adapter", "GCGSSCGCGCCTCTCTGCGCC"), (9, "phi", "control", genome(300, 77)), (11, "own", "reference", genome(200, 78))]
    rows = []
    for i in range(120):
        n = rnd.choice([20, 60, 90, 100, 151])
        s = list(genome(n, 1000 + i))
        kind = i % 7
        if kind < 5 and n >= 60:
            src = table[[0, 1, 2, 4, 5][kind]][3]
            a = rnd.randrange(0, max(1, len(src) - 40))
            piece = list(src[a : a + rnd.choice([28, 32, 40])])
            for _ in range(rnd.randrange(4)):
                piece[rnd.randrange(len(piece))] = rnd.choice("ACGTN")
            piece = list(rc("".join(piece))) if rnd.random() < 0.5 else piece
            at = rnd.randrange(0, n - len(piece) + 1)
            s[at : at + len(piece)] = piece
        q = [40] * n
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            q[rnd.randrange(n)] = 2
        rows.append((i, f"r{i}", None, "".join(s), "".join(chr(33 + v) for v in q)))
    reads = spark.createDataFrame(rows, READ)
    found = artifacts.artifact_filter(reads, spark.createDataFrame(table, "artifact_id int, name string, kind string, seq string"))
    got = {r.read_id: (r.artifact_id, r.action, r.keep_offset, r.keep_length, None if r.rescue_length is None else (r.rescue_offset, r.rescue_length)) for r in found.collect()}
    want = {r[0]: brute_filter(r[3], r[4], table, 0.40) for r in rows}
    assert got == want and {w[1] for w in want.values()} == {"none", "trimmed", "discarded"} and any(w[4] for w in want.values())
    out = {r.name: r for r in artifacts.apply_filter(reads, found).collect()}
    assert sum(n.endswith("-qtrim") for n in out) == sum(w[4] is not None for w in want.values())
    for i, w in want.items():
        r = out[f"r{i}"]
        assert r.discarded == (w[1] == "discarded") and (w[1] != "trimmed" or (r.seq == rows[i][3][w[2] : w[2] + w[3]] and r.label == f"AFTrim:{w[2]}+{w[3]}"))
    assert len({r.read_id for r in out.values()}) == len(out)
    none = spark.createDataFrame([], READ)
    assert artifacts.artifact_filter(none, constants.artifacts(spark)).count() == 0
    with pytest.raises(ValueError):
        artifacts.artifact_filter(reads, constants.artifacts(spark), ArtifactOptions(edit_distance=3))


def test_artifact_filter_of_pairs(spark, tmp_path):
    """A control hit takes the mate along, a reference the mate that loses something; windows run round the end of an artifact."""
    phi, own = genome(200, 77), genome(200, 78)
    adapter = dict((n, s) for _, n, _, s in constants.artifact_rows())["Solexa_5_prime_adapter"]
    clean = [genome(100, 500 + i) for i in range(8)]
    good, bad = "I" * 100, "I" * 60 + "#" * 40
    (tmp_path / "phi.fa").write_text(f">phi\n{phi}\n")
    (tmp_path / "own.fa").write_text(f">own\n{own}\n")
    rows = [
        ("a/1", phi[190:] + phi[:14] + clean[0][24:], good), ("a/2", clean[1], good),  # over the control's end
        ("b/1", clean[2][:60] + own[20:60], good), ("b/2", clean[3], bad),
        ("c/1", clean[4][:60] + own[20:60], good), ("c/2", clean[5], good),
        ("d/1", clean[6][:70] + (adapter * 2)[25:49] + clean[6][94:], good), ("d/2", clean[7], bad),  # over the adapter's end
        ("e/1", clean[0][:50] + (own[190:] + own[:40]) + clean[1][:0], good[:100]),
    ]
    reads = spark.createDataFrame([(i, n, None, s, q) for i, (n, s, q) in enumerate(rows)], READ)
    table = constants.artifacts(spark, False, str(tmp_path / "own.fa"), str(tmp_path / "phi.fa"), constants.CIRCULAR)
    found = artifacts.artifact_filter(reads, table, by_pair=True)
    got = {rows[r.read_id][0]: (r.artifact_id, r.action, r.keep_length) for r in found.collect()}
    assert {n: got[n][1] for n in got} == {"a/1": "discarded", "a/2": "discarded", "b/1": "discarded", "b/2": "discarded", "c/1": "discarded", "c/2": "none", "d/1": "trimmed", "d/2": "trimmed", "e/1": "discarded"}
    assert got["a/1"][0] == got["a/2"][0] == constants.CONTROL_ID and got["b/1"][0] == constants.REFERENCE_ID and got["d/2"][0] == len(constants.ADAPTERS) and got["d/2"][2] == 60
    alone = {rows[r.read_id][0]: r.action for r in artifacts.artifact_filter(reads, table).collect()}
    assert alone["a/1"] == "discarded" and alone["a/2"] == "none" and alone["b/2"] == "trimmed"
    gone = {r.name: (r.label, r.out_file, len(r.seq)) for r in artifacts.discarded_reads(reads, found, table).collect()}
    assert set(gone) == {n for n in got if got[n][1] == "discarded"} and gone["a/2"] == ("phi", "Control", 100) and gone["b/1"] == ("own", "Artifact", 100)


def brute_cover(units, target, ratio=1.0):
    """Sequential: best score (or level of it) first, made anew before each pick."""
    tie, picked, counts = {u: t for u, t, *_ in units}, {}, defaultdict(int)
    for layer in range(1, target + 1):
        while True:
            best = None
            for u, _, size, ks in units:
                if u in picked or any(counts[k] >= layer for k in ks):
                    continue
                score = sum(d * (layer - counts[k]) for k, d in ks.items()) / size
                score = math.floor(math.log(score) / math.log(ratio)) if ratio > 1 else score
                best = max(best or (score, tie[u], u), (score, tie[u], u))
            if best is None:
                break
            picked[best[2]] = layer
            for k in next(ks for u, _, _, ks in units if u == best[2]):
                counts[k] += 1
    return picked


@pytest.mark.parametrize("target,ratio", [(1, 1.0), (3, 1.0), (2, 1.3)])
def test_optimal_cover_is_the_sequential_one(spark, target, ratio):
    rnd = random.Random(target)
    depth = {k: rnd.randrange(2, 6) for k in range(25)}
    sets = [sorted(rnd.sample(range(25), rnd.randrange(1, 5))) for _ in range(40)]
    rows = [(u, 10.0, ks, [depth[k] for k in ks]) for u, ks in enumerate(sets)]
    df = spark.createDataFrame(rows, "unit long, size double, kmers array<long>, depths array<int>")
    tie = {r.unit: r.h for r in df.select("unit", F.xxhash64("unit").alias("h")).collect()}
    got = {r.unit: r.layer for r in rd.optimal_cover(df, target, ratio).collect()}
    assert got == brute_cover([(u, tie[u], 10.0, {k: depth[k] for k in ks}) for u, _, ks, _ in rows], target, ratio)


def test_levels_bound_the_rounds_of_a_cover(spark):
    """Units along a tiling whose scores fall one by one: a chain as long as the tiling, but for levels."""
    rows = [(i, 1000.0, [i, i + 1], [5000 - i, 5000 - i]) for i in range(60)]
    df = spark.createDataFrame(rows, "unit long, size double, kmers array<long>, depths array<int>")
    tie = {r.unit: r.h for r in df.select("unit", F.xxhash64("unit").alias("h")).collect()}
    exact, level = [], []
    assert {r.unit for r in rd.optimal_cover(df, 1, rounds=exact).collect()} == set(range(0, 60, 2))
    got = {r.unit: r.layer for r in rd.optimal_cover(df, 1, 1.1, level).collect()}
    assert got == brute_cover([(u, tie[u], s, dict(zip(ks, ds))) for u, s, ks, ds in rows], 1, 1.1)
    assert level[0] < exact[0] / 2 and exact[0] >= 30


@pytest.mark.parametrize("few", [0, 1 << 21])
def test_a_cover_by_classes_is_one_by_kmers(spark, monkeypatch, few):
    """K-mers that the same pairs have are one; rounds of many links are whole steps, the last ones of a layer are in one task."""
    from strandworks.operators import covers, kmers

    monkeypatch.setattr(covers, "FEW", few)
    rnd, g = random.Random(3), genome(300, 4)
    rows = [(u * 10**9 + m, u, g[at : at + rnd.randrange(20, 60)]) for u in range(40) for m in (0, 1) for at in [rnd.randrange(280)]] + [(5, 99, "A" * 90), (6, 100, "ACG"), (7, 101, None)]
    df = spark.createDataFrame(rows, "read_id long, unit long, seq string")
    obs = kmers.observe(df, 11).join(df.select("read_id", "unit"), "read_id")
    deep = obs.join(kmers.spectrum(obs, 2, coded=True).select("code", "n"), "code").select("unit", "code", "n").distinct().collect()
    have, size, depth = defaultdict(dict), defaultdict(int), {r.code: r.n for r in deep}
    for r in deep:
        have[r.unit][r.code] = r.n
    for _, u, s in rows:
        size[u] += len(s or "")
    tie = {r.unit: r.h for r in df.select("unit", F.xxhash64("unit").alias("h")).collect()}
    want = brute_cover([(u, tie[u], size[u], ks) for u, ks in have.items()], 2, 1.1)
    assert {r.unit: r.layer for r in rd.pair_cover(df, 11, 2, 1.1).collect()} == want and set(want.values()) == {1, 2}
    found = covers.classes(df, 11, "unit")
    assert found.count() < len(depth) and found.agg(F.sum("weight")).first()[0] == sum(depth.values())
    names = spark.createDataFrame([(f"pair {u}", float(size[u]), list(ks), list(ks.values())) for u, ks in have.items()], "unit string, size double, kmers array<long>, depths array<long>")
    tie = {r.unit: r.h for r in names.select("unit", F.xxhash64("unit").alias("h")).collect()}
    want = brute_cover([(f"pair {u}", tie[f"pair {u}"], size[u], ks) for u, ks in have.items()], 2, 1.1)
    assert {r.unit: r.layer for r in rd.optimal_cover(names, 2, 1.1).collect()} == want


def test_hashes_of_units_are_those_of_spark(spark):
    import numpy as np

    from strandworks.operators import covers

    x = [0, 1, -1, 10**12, -(1 << 63), (1 << 63) - 1]
    want = [r.h for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i long, v long").orderBy("i").select(F.xxhash64("v").alias("h")).collect()]
    assert covers.ties(np.array(x)).tolist() == want


def test_dedup_reads(spark):
    g = genome(400, 31)
    a, b = g[:60], rc(g[200:260])
    near_a = a[:3] + ("A" if a[3] != "A" else "C") + a[4:]
    rows, q = [], "I" * 60
    for i, (s, t) in enumerate([(a, b), (a, b), (near_a, b), (g[80:140], b)]):
        rows += [(2 * i, f"p{i}/1", None, s, q), (2 * i + 1, f"p{i}/2", None, t, q)]
    rows += [(20, "x/1", None, g[300:360], q), (21, "y/1", None, g[300:360], "5" * 60)]
    reads = spark.createDataFrame(rows, READ)
    exact = {r.name: r for r in dedup.dedup_reads(reads).collect()}
    assert set(exact) == {"C2-0/1", "C2-0/2", "p2/1", "p2/2", "p3/1", "p3/2", "x/1", "y/1"}
    assert exact["C2-0/1"].seq == a and exact["C2-0/1"].qual == q
    close = {r.name: r for r in dedup.dedup_reads(reads, DedupOptions(edit_distance=1, single=True)).collect()}
    assert set(close) == {"C3-0/1", "C3-0/2", "p3/1", "p3/2", "C2-20"}
    assert close["C3-0/1"].seq == a and close["C2-20"].seq == g[300:360] and close["C2-20"].qual == q
    one = dedup.dedup_reads(reads, DedupOptions(consensus=False))
    assert {r.seq for r in one.where("members = 2").collect()} == {a, b}


def test_roots_follow_the_strongest_neighbour(spark):
    rows = [("AAAA", 9), ("AAAC", 5), ("AACC", 3), ("GGGG", 9), ("GGGT", 9), ("TCTC", 1)]
    got = {r.frag_key: r.root for r in dedup.nearest_roots(spark.createDataFrame(rows, "frag_key string, n long")).collect()}
    assert got == {"AAAA": "AAAA", "AAAC": "AAAA", "AACC": "AAAA", "GGGG": "GGGT", "GGGT": "GGGT", "TCTC": "TCTC"}


def test_mates(spark):
    rows = [(0, "a/1", None, "ACGT", "IIII"), (1, "a/2", None, "ACGT", "IIII"), (2, "b/1", None, "ACGTA", "IIIII"), (3, "c", "2:N:0:X", "AC", "II"), (4, "d/2", "z", "A", "I"), (5, "a/1", None, "A", "I"), (6, "e", None, "A", "I")]
    reads = spark.createDataFrame(rows, READ).withColumn("file_id", F.lit(0))
    fake = {r.read_id: (r.name, r.comment, r.seq) for r in rd.fake_mates(reads).collect()}
    assert fake == {2: ("b/2", ":fakePair", "N"), 3: ("c", "1:N:0:X:fakePair", "N"), 4: ("d/1", "z:fakePair", "N")}
    assert {(r.read1, r.read2) for r in rd.sequential_pairs(reads).collect()} == {(0, 1)}
    files = {r.read_id: r.file for r in rd.split_mates(reads, 3).collect()}
    assert files[0] == 1 and files[1] == 2 and files[2] == 0 and 4 not in files
    t = rd.totals(reads).first()
    assert (t.reads, t.bases, t.longest) == (7, 18, 5)


def test_running_sum_and_top_of_group(spark):
    rows = spark.range(1000).selectExpr("id k", "id % 7 v", "IF(id < 900, 0, id % 3) g").repartition(9)
    total, want = 0, {}
    for i in range(1000):
        total += i % 7
        want[i] = total
    assert {r.k: r.s for r in ordered.running_sum(rows, "k", "v", "s").collect()} == want
    top = ordered.top_of_group(rows, "g", [F.desc("k")], 5).collect()
    assert sorted(r.k for r in top if r.g == 0) == [r for r in range(1000) if r in {*(i for i in range(1000) if i < 900 or i % 3 == 0)}][-5:]


def test_reads_of_both_strands_overhang(spark):
    g = genome(300, 41)
    contigs = spark.createDataFrame([(1, g[100:200])], "contig_id long, seq string")
    reads = spark.createDataFrame([(0, "p/1", g[60:140], "p/"), (1, "p/2", rc(g[150:240]), "p/"), (2, "q/1", g[10:90], "q/"), (3, "q/2", rc(g[120:180]), "q/")], "read_id long, name string, seq string, pair_key string")
    placed = {r.read_id: (r.strand, r.shift, r.mismatches) for r in assembly.seed_alignments(contigs, reads, 21, MatchOptions(min_overlap=30)).collect()}
    assert placed == {0: (0, -40, 0), 1: (1, 50, 0), 3: (1, 20, 0)}
    near_ones = {r.read_id for r in assembly.near_reads(contigs, reads, 21, MatchOptions(min_overlap=30, include_mate=False)).collect()}
    assert near_ones == {0, 1}
    grown = assembly.assemble(contigs, reads, 21, rounds=1, assembler=lambda c, r: spark.createDataFrame([(7, g[90:210]), (8, g[20:130])], "cand_id long, seq string")).first()
    assert grown.seq == g[90:210]


def test_only_windows_with_a_seed_of_an_artifact_are_joined(spark, sf, monkeypatch):
    import random

    from strandworks.operators import artifacts
    from strandworks.plans import derived

    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    art = word(40)
    table = spark.createDataFrame([(0, "a", "adapter", art)], "artifact_id int, name string, kind string, seq string")
    near = art[:5] + ("A" if art[5] != "A" else "C") + art[6:20] + ("G" if art[20] != "G" else "T") + art[21:]
    seqs = [word(200) + near + word(100), word(400), word(30) + art[3:38] + word(50), word(36) + near, "N" * 40, word(10)]
    reads = spark.createDataFrame([(i, f"r{i}", s, "I" * len(s)) for i, s in enumerate(seqs)], "read_id long, name string, seq string, qual string")
    want = sorted(map(tuple, artifacts.artifact_filter(reads, table).collect()))
    assert [r[0] for r in want if r[1] == 0] == [0, 2, 3]
    codes = table.selectExpr("0L as near").where("false")
    none = artifacts._seed_table(codes, 24)
    probed = derived.reads(spark, sf).selectExpr("read_id", "seq", "0L as first", "96L as last")
    assert not none.any() and artifacts._probes(probed, 24, 4, none).count() == 0
    every = artifacts._probes(probed, 24, 4, ~none).select("read_id", "pos", "code")
    assert every.count() == 6 * every.distinct().count() > 0
    monkeypatch.setattr(artifacts.windows, "SEGMENT", 64)  # long rows come in pieces
    assert sorted(map(tuple, artifacts.artifact_filter(reads, table).collect())) == want
    assert artifacts._probes(probed, 24, 4, ~none).count() == 6 * every.distinct().count()


def test_splits_are_those_of_each_place(spark, monkeypatch):
    from fractions import Fraction

    monkeypatch.setattr(rd.windows, "SEGMENT", 50)
    rnd = random.Random(8)
    rows = [(1, []), (2, [7]), (3, None), (4, [5, 5]), (5, [0, 9]), (6, [0] * 9), (7, [0, 0, 50, 50, 0, 0]), (8, [4 * 10**9, 4 * 10**9, 1, 1]), (9, [3] * 120 + [300] * 90), (None, [1, 1, 90, 90])]
    rows += [(i, [rnd.choice([0, 2, 3, 40])] * rnd.randrange(1, 6) + [rnd.randrange(60) for _ in range(rnd.randrange(9))]) for i in range(10, 60)]

    def spread(x):
        mean = Fraction(sum(x), len(x))
        return max(float(sum((y - mean) ** 2 for y in x) / (len(x) - 1)) if len(x) > 1 else 0.0, math.sqrt(mean))

    def best(v):
        gap = lambda n: round(float(abs(Fraction(sum(v[:n]), n) - Fraction(sum(v[n:]), len(v) - n))) - math.sqrt(spread(v[:n])) - math.sqrt(spread(v[n:])), 6)
        top = max(range(1, len(v)), key=lambda n: (gap(n), -n))
        return top if gap(top) > 0 else 0

    df = spark.createDataFrame(rows, "read_id long, values array<bigint>")
    found = rd.bimodal_splits(df)
    assert {r.read_id: r.split for r in found.collect()} == {i: best(v) for i, v in rows if v and len(v) > 1}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
