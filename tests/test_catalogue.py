"""Every query of the engine's own operators against its SQL twin."""

import math

import numpy as np
import pytest

from strandworks.plans import catalogue

from .oracle import assert_equal, tables

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return tables(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, sf, con, name):
    assert_equal(QUERIES[name](spark, sf), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["kmer", "n"]
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_sorted_results_come_in_order(spark, sf):
    got = [tuple(r) for r in QUERIES["coordinate_sort"](spark, sf).collect()]
    key = lambda r: (r[2] == "*", r[2], r[3], r[0], r[1] & 4 > 0, r[1] & 128 > 0, r[1])
    assert got == sorted(got, key=key) and len({r[2] for r in got}) > 3
    near = [tuple(r) for r in QUERIES["tnf_distance_sorted"](spark, sf).collect()]
    assert near == sorted(near, key=lambda r: (r[2], r[0], r[1]))


def test_ids_have_room_for_long_texts(spark, tmp_path):
    """A text of over 600,000 letters keeps its reads apart from those of the next document."""
    from strandworks.plans import derived

    spark.createDataFrame([(1, "ACGTTGCA" * 90_000), (2, "ABC" * 60), (3, None), (4, "x"), (5, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    reads = derived.reads(spark, str(tmp_path))
    assert reads.count() == reads.select("read_id").distinct().count() == 12_000 + 3 + 1
    assert {r.doc_id for r in reads.select("doc_id").distinct().collect()} == {1, 2, 4}


def test_clusters_are_those_of_plain_merging(spark, sf):
    """The closest two clusters merge, their counts summed, until none are within the threshold."""
    vecs = [({r.g}, [float(x) for x in r.v]) for r in sorted(catalogue._vectors(spark, sf).collect(), key=lambda r: r.g)]
    unit = lambda v: [x / (math.sqrt(sum(y * y for y in v)) or 1.0) for x in v]
    while len(vecs) > 1:
        near = min((math.dist(unit(vecs[i][1]), unit(vecs[j][1])), i, j) for i in range(len(vecs)) for j in range(i))
        if near[0] > 0.01:
            break
        _, i, j = near
        (a, x), (b, y) = vecs[i], vecs[j]
        vecs[j] = (a | b, [p + q for p, q in zip(x, y)])
        del vecs[i]
    got = {}
    for r in QUERIES["tnf_cluster"](spark, sf).collect():
        got.setdefault(r.cluster, set()).add(r.g)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g, _ in vecs)
    assert 1 <= len(vecs)


def test_size_fit_is_not_beaten_by_a_grid(spark, sf):
    from strandworks.operators import kmers, size

    curve = sorted(kmers.size_history(catalogue._obs(spark, sf, catalogue.K)).collect(), key=lambda r: r.part)
    x, u = np.array([float(r.raw) for r in curve]), np.array([float(r.distinct_kmers) for r in curve])
    loss = lambda a, b: float((((size.unique_growth(x, a, b) - u) * np.log(np.maximum(x, 2))) ** 2).sum())
    r = {r.model: r for r in QUERIES["estimate_size_fit"](spark, sf).collect()}["growth"]
    least = min(loss(a, b) for a in np.linspace(0.001, 0.999, 300) for b in np.geomspace(10, 1e9, 300))
    assert loss(r.error_rate, r.genome_kmers) <= least * (1 + 1e-6)


@pytest.mark.parametrize("name", ["dedup_groups", "consensus_read", "split_parts", "split_by_bases", "quality_trim", "spectrum_size_history", "sequential_pairs", "kmer_weighted_count"])
def test_ids_of_any_size(spark, tmp_path, name):
    """doc_ids beyond what a double, or a product of ids, can hold exactly."""
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(60, 900))) for _ in range(8)]
    ids = [9_000_001, 9_000_002, 138_547_333, 200_000_001, 10**12, 10**12 + 1, 10**12 + 2, 10**12 + 3]
    pq.write_table(pa.table({"doc_id": ids, "text": texts[:5] + texts[:3]}), f"{tmp_path}/documents.parquet")
    assert_equal(QUERIES[name](spark, str(tmp_path)), tables(str(tmp_path)), ORACLES[name])
