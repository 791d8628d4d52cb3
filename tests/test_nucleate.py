"""Assembly around contigs against a plain version, with limits, mates, repeats and commands."""

import hashlib
import random
import sys

import pytest
from pyspark.sql import functions as F

from strandworks.config import ExtendOptions, MatchOptions
from strandworks.operators import kmers, nucleate, reads as rd

K = 21


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def canon(s):
    return min(s, rc(s))


def windows(s, k):
    return [canon(s[i : i + k]) for i in range(len(s) - k + 1)]


def order(i):
    return hashlib.md5(f"0:{i}".encode()).hexdigest(), i


def plain_step(contig, count, opts):
    """One base to the right or nothing, by looking at every read window anew."""
    edge = count(canon(contig[-K:]))
    sums = {b: count(canon(contig[1 - K :] + b)) for b in "ACGT"}
    total = sum(sums.values())
    base = max("ACGT", key=lambda b: (sums[b], b))
    good = edge and total >= opts.min_coverage and total / edge > opts.max_delta and sums[base] / total >= opts.min_consensus
    return base if good and canon(contig[1 - K :] + base) not in windows(contig, K) else None


def plain(contigs, reads, opts, limit, edge):
    """The rounds with everything in lists. ``reads``: (id, name, seq)."""
    final = {}
    live = {c: (s, 0, 0, 0) for c, s in contigs}
    held = {i: set(windows(s, K)) for i, _, s in reads}
    while live:
        then = {}
        for c, (s, left, right, rounds) in live.items():
            n = len(s)
            ends = {canon(s[p : p + K]) for p in range(n - K + 1) if p < edge or p + K > n - edge}
            near = sorted((i for i in held if held[i] & ends), key=order)[:limit]
            stems = {name[:-1] for i, name, _ in reads if i in set(near)}
            seqs = [q for _, name, q in sorted(reads) if name[:-1] in stems]
            counts = {}
            for q in seqs:
                for w in windows(q, K):
                    counts[w] = counts.get(w, 0) + 1
            grown, more, open_ = s, [0, 0], [len(s) >= K] * 2
            for _ in range(opts.max_steps):
                for side in (0, 1):
                    if open_[side] and len(grown) < opts.max_contig:
                        turned = grown if side else rc(grown)
                        b = plain_step(turned, lambda w: counts.get(w, 0), opts)
                        open_[side] = b is not None
                        if b:
                            grown, more[side] = (turned + b if side else rc(turned + b)), more[side] + 1
            row = (grown, left + more[0], right + more[1], rounds + (sum(more) > 0))
            (then if sum(more) and len(grown) < opts.max_contig else final)[c] = row
        live = then
    return {c: r for c, r in final.items()}


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(12)
    genome = "".join(rnd.choice("ACGT") for _ in range(900))
    repeat = "".join(rnd.choice("ACGT") for _ in range(60))
    rows = []
    for i in range(260):
        a = rnd.randrange(0, 840)
        s, t = genome[a : a + 60], rc(genome[min(a + 90, 840) : min(a + 90, 840) + 60])
        rows += [(2 * i, f"p{i}/1", s), (2 * i + 1, f"p{i}/2", t)]
    rows += [(10_000 + i, f"x{i}/1", repeat) for i in range(700)]
    contigs = [(1, genome[300:380]), (2, rc(genome[500:570])), (3, "ACGT" * 20), (4, ""), (5, "ACGTACGTA"), *((10 + i, repeat + genome[i * 7 : i * 7 + 40]) for i in range(6))]
    reads = spark.createDataFrame([(i, n, s, "I" * len(s)) for i, n, s in rows], "read_id long, name string, seq string, qual string")
    return genome, rows, contigs, rd.with_pair_key(reads), spark.createDataFrame(contigs, "contig_id long, seq string")


@pytest.mark.parametrize("limit,steps,longest", [(450, 50, 3000), (40, 9, 300)])
def test_equals_plain_rounds(planted, limit, steps, longest):
    genome, rows, contigs, reads, seeds = planted
    opts = ExtendOptions(max_steps=steps, max_contig=longest, min_coverage=2.0)
    got = nucleate.nucleate(seeds, reads, nucleate.NucleateOptions(k=K, extend=opts, match=MatchOptions(max_read_matches=limit, max_from_edge=50)))
    found = {r.contig_id: (r.seq, r.left, r.right, r.rounds) for r in got.collect()}
    assert found == plain(contigs, rows, opts, limit, 50)
    assert found[3][1:] == found[4][1:] == found[5][1:] == (0, 0, 0)
    if limit == 450:
        assert found[1][0] in genome and len(found[1][0]) > 700 and rc(found[2][0]) in genome and found[1][3] > 2


def test_limit_holds_before_pairs_are_made(spark, planted):
    _, rows, contigs, reads, seeds = planted
    obs, few = kmers.observe(reads, K), MatchOptions(max_read_matches=15)
    got = {(r.contig_id, r.read_id) for r in nucleate.match_limited(seeds, obs, K, few).collect()}
    want = set()
    for c, s in contigs:
        ends = set(windows(s, K))
        want |= {(c, i) for i in sorted((i for i, _, q in rows if ends & set(windows(q, K))), key=order)[:15]}
    assert got == want and len([c for c, _ in got if c >= 10]) == 6 * 15
    share = nucleate.match_limited(seeds, obs, K, fraction=0.4)
    all_ = nucleate.match_limited(seeds, obs, K, MatchOptions(max_read_matches=10**6))
    assert {tuple(r) for r in share.collect()} <= {tuple(r) for r in all_.collect()} and 0.3 < share.where("contig_id = 1").count() / all_.where("contig_id = 1").count() < 0.5


def test_greater_k_where_the_least_is_ambiguous():
    rnd = random.Random(3)
    bases = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    shared, a, b = bases(30), bases(60), bases(60)
    one, two = a + shared + bases(60), b + shared + bases(60)
    seqs = [g[i : i + 70] for g in (one, two) for i in range(0, len(g) - 69, 2) for _ in range(3)]
    opts = ExtendOptions(max_steps=200)
    short, long_ = nucleate.grow(a[-40:] + shared, seqs, [21], opts), nucleate.grow(a[-40:] + shared, seqs, nucleate.ladder(seqs, 21, 6), opts)
    assert long_[2] > short[2] and long_[0] in one
    assert nucleate.ladder([], 21, 6) == [21] and nucleate.ladder(seqs, 21, 0) == [21] and nucleate.ladder(seqs, 21, 6)[:2] == [21, 29]


def test_plug_in_assemblers(spark, planted):
    genome, rows, contigs, reads, seeds = planted
    some = seeds.where("contig_id in (1, 2, 4)")
    opts = nucleate.NucleateOptions(k=K, extend=ExtendOptions(max_iterations=1))
    join = lambda contig, near: [rc(genome[250:420]), "ACGT" * 50]
    got = {r.contig_id: r for r in nucleate.nucleate(some, reads, opts, join).collect()}
    assert got[1].seq == genome[250:420] and (got[1].left, got[1].right) == (50, 40) and got[2].seq == contigs[1][1] and got[4].seq == ""
    script = "import sys\nt = sys.stdin.read().split('>')[1:]\nprint('>c\\n' + t[0].split()[1] + 'ACG')"
    got = {r.contig_id: r for r in nucleate.nucleate(some, reads, opts, nucleate.command_assembler([sys.executable, "-c", script])).collect()}
    assert got[1].seq == contigs[0][1] + "ACG" and got[1].right == 3
    with pytest.raises(Exception, match="ended with 1"):
        nucleate.nucleate(some, reads, opts, nucleate.command_assembler(["false"])).collect()


def test_jobs_follow_rounds_not_bases(spark, planted):
    *_, reads, seeds = planted
    one = seeds.where("contig_id = 1")
    grown = lambda steps: nucleate.one_round(one, reads, kmers.observe(reads, K), nucleate.NucleateOptions(k=K, extend=ExtendOptions(max_steps=steps, min_coverage=2.0)))
    tracker = spark.sparkContext.statusTracker()
    counts = []
    for steps in (1, 40):
        spark.sparkContext.setJobGroup(f"grow{steps}", "")
        added = grown(steps).agg(F.sum("left") + F.sum("right")).first()[0]
        counts.append((added, len(tracker.getJobIdsForGroup(f"grow{steps}"))))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0][0] == 2 and counts[1][0] > 30 and abs(counts[1][1] - counts[0][1]) <= 2
