"""Steps that whole tables used to go through more often, or in more rows, than they need."""

import pytest
from pyspark.sql import functions as F

from strandworks import lineage
from strandworks.operators import assembly, dedup, kmers, nucleate, reads as rd
from strandworks.plans import catalogue, derived

QUERIES = catalogue.queries()


def kept(monkeypatch, module):
    """Row counts of what a module writes from now on, by tag."""
    seen = {}

    def keep(df, tag):
        out = lineage.keep(df, tag)
        seen[tag] = out.count()
        return out

    monkeypatch.setattr(module, "keep", keep)
    return seen


@pytest.mark.parametrize("name", ["consolidate_1edit", "error_neighbors", "variant_purge"])
def test_a_spectrum_read_several_times_is_written_once(spark, sf, monkeypatch, name):
    seen = kept(monkeypatch, kmers)
    assert QUERIES[name](spark, sf).count() > 0 and seen["spectrum"] > 0


def test_only_keys_with_a_half_in_common_are_masked(spark, monkeypatch):
    seen = kept(monkeypatch, dedup)
    rows = [("AAAACCCCGA", 3), ("AAAACCCCGT", 1), ("GATTACAGAT", 2), ("CTCTGTGTCA", 1)]
    found = dedup.nearest_roots(spark.createDataFrame(rows, "frag_key string, n long"))
    assert {(r.frag_key, r.root) for r in found.collect()} == {(k, "AAAACCCCGA" if k == "AAAACCCCGT" else k) for k, _ in rows}
    assert seen["halves"] == 2


def test_rescued_runs_need_no_shuffle(spark, sf):
    assert "hashpartitioning" not in rd.rescue_runs(derived.reads(spark, sf))._jdf.queryExecution().executedPlan().toString()


def test_windows_of_unmatched_reads_are_not_made_distinct(spark, sf):
    contigs, obs = catalogue._contigs(spark, sf), kmers.observe(derived.reads(spark, sf), catalogue.K)
    plan = nucleate.shared_kmers(nucleate.match_limited(contigs, obs, catalogue.K), contigs, obs, catalogue.K)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(read_id" not in plan


def test_a_contig_meets_its_own_kmers_only(spark, sf, monkeypatch):
    seen = kept(monkeypatch, assembly)
    assert QUERIES["covered_bases"](spark, sf).count() > 0
    assert 0 < seen["covered"] <= derived.load(spark, sf, "benchmark").agg(F.sum(F.length("text"))).first()[0]


def test_reads_without_a_seed_are_not_aligned(spark, sf, monkeypatch):
    seen = kept(monkeypatch, catalogue)
    assert QUERIES["overhang_screen"](spark, sf).count() > 0 and 0 < seen["near"] < derived.reads(spark, sf).count() / 4


def test_a_batch_of_a_stream_is_counted_from_runs(spark, tmp_path, monkeypatch):
    from strandworks.streaming import kmers as streaming

    calls, made = [], streaming.runs.counts
    monkeypatch.setattr(streaming.runs, "counts", lambda *a, **b: calls.append(a) or made(*a, **b))
    counts = streaming.Counts(spark, f"file://{tmp_path}/counts", 5)
    counts.add(spark.createDataFrame([(1, "ACGTTGCATT")], "read_id long, seq string"), 0)
    assert len(calls) == 1 and counts.counts().agg(F.sum("n")).first()[0] == 6


def test_snapshots_are_found_by_a_search(spark, sf):
    from strandworks.operators import windows

    rows = spark.createDataFrame([(None,), (-5,), (3,), (4,), (9,), (100,)], "x long")
    assert [r.p for r in windows.placed(rows, "x", [4, 9], "p").collect()] == [0, 0, 0, 1, 2, 2]
    assert [r.p for r in windows.placed(rows, "x", [4, 9], "p", [7, 8]).collect()] == [7, 7, 7, 7, 8, 8]
    assert [r.p for r in windows.placed(rows, "x", [], "p", []).collect()] == [0] * 6
    plan = kmers.size_history_growth_of(derived.reads(spark, sf), 11)._jdf.queryExecution().executedPlan().toString()
    assert "filter(" not in plan and "lambda" not in plan


def test_a_step_joins_numbers(spark, sf):
    plan = QUERIES["contig_extend_step"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "spectrum" not in plan and "kmer string" not in plan and "code" in plan


def test_a_step_by_codes_is_one_by_text(spark):
    reads = spark.createDataFrame([(i, s) for i, s in enumerate(["ACGTTGCATT", "CGTTGCATTG", "GTTGCATTGA"] * 4)], "read_id long, seq string")
    contigs = spark.createDataFrame([(1, "ACGTTGCATT"), (2, "TTGN"), (3, "AC"), (4, "GGGGGGGG"), (5, None)], "contig_id long, seq string")
    spec = kmers.count(reads, 5, coded=True)
    a, b = (sorted(map(str, assembly.extend_step(contigs, s, 5).collect())) for s in (spec, spec.drop("code")))
    assert a == b and "base='G'" in "".join(a)
