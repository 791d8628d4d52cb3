import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from strandworks.llm import mixing, packing

from .test_dedup import words


def padding(edges, counts, sums, chosen):
    total = 0
    for e, c, s in zip(edges, counts, sums):
        total += c * min(b for b in chosen if b >= max(e, 1)) - s
    return total


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    edges = sorted(map(int, rng.choice(np.arange(0, 60 if seed % 2 else 40_000), 9, replace=False)))
    counts = list(map(int, rng.integers(1, 30, 9)))
    sums = [c * e for c, e in zip(counts, edges)]
    for k in (1, 2, 3, 5, 9, 12):
        got = packing.optimal_boundaries(edges, counts, k)
        best = min(padding(edges, counts, sums, [*some, edges[-1]]) for n in range(k) for some in combinations([max(e, 1) for e in edges[:-1]], n))
        assert len(got) <= k and got[-1] == edges[-1] and padding(edges, counts, sums, got) == best
        assert sorted(set(got)) == got
    assert packing.optimal_boundaries([], [], 3) == [] and packing.optimal_boundaries([0], [5], 3) == [1]


def test_boundaries_of_long_documents():
    """Every length counts, whatever its size."""
    assert packing.optimal_boundaries([2100, 5001, 19000], [50, 50, 10], 16) == [2100, 5001, 19000]


def test_boundaries_of_many_lengths():
    """The bounded search finds what the full one finds."""
    rng = np.random.default_rng(3)
    lengths, counts = np.unique((rng.lognormal(5, 1.5, 4000)).astype(int) + 1, return_counts=True)
    docs, total = (np.append(0, np.cumsum(x)) for x in (counts, counts * lengths))
    best = np.append(0, lengths * docs[1:] - total[1:]).astype(float)
    for _ in range(7):
        best = np.append(0, [min(best[i] + lengths[j - 1] * (docs[j] - docs[i]) - (total[j] - total[i]) for i in range(j)) for j in range(1, len(best))])
    got = packing.optimal_boundaries(lengths, counts, 8)
    assert padding(lengths.tolist(), counts.tolist(), (counts * lengths).tolist(), got) == best[-1]


@pytest.mark.parametrize("budget,shard", [(65_536, 20_000), (130, 3)])
def test_packing(docs, rows, monkeypatch, budget, shard):
    monkeypatch.setattr(packing, "SHARD_ROWS", shard)
    got = packing.pack(docs, buckets=4, budget=budget).collect()
    assert Counter((g.doc_id, g.n_tokens) for g in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    limits = sorted({(g.bucket, g.bucket_len) for g in got})
    assert len(limits) <= 4
    batches = defaultdict(list)
    for g in got:
        lower = max((b for _, b in limits if b < g.bucket_len), default=-1)
        assert lower < g.n_tokens <= g.bucket_len
        batches[g.bucket, g.batch].append(g.slot)
    sizes = defaultdict(list)
    for (bucket, batch), slots in sorted(batches.items()):
        held = max(1, budget // dict(limits)[bucket])
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= held
        sizes[bucket].append(len(slots))
    for bucket, s in sizes.items():
        held = max(1, budget // dict(limits)[bucket])
        assert all(x == held for x in s[:-1])  # only the last batch is short


def test_packing_edges(wide, empty, rows):
    assert packing.pack(wide).count() == len(rows)
    assert packing.pack(empty).count() == 0


def entropy(w):
    return -sum(x * math.log(x) for x in w if x > 0)


def weights(tokens, a):
    p = [t / sum(tokens) for t in tokens]
    z = sum(x**a for x in p)
    return [x**a / z for x in p]


@pytest.mark.parametrize("gap,max_repeats,blocks", [(0.5, 4.0, 1000), (0.9, 4.0, 2), (1.0, 1.3, 2), (0.0, 4.0, 1)])
def test_mixing(docs, rows, monkeypatch, gap, max_repeats, blocks):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", blocks)
    got = mixing.copies(docs, gap=gap, max_repeats=max_repeats).collect()
    assert Counter((g.doc_id, g.source, g.n_tokens) for g in got) == Counter((r[0], r[3], len(words(r[1]))) for r in rows)
    tokens = defaultdict(int)
    for r in rows:
        tokens[r[3]] += len(words(r[1]))
    names = [n for n, t in tokens.items() if t]
    have = [tokens[n] for n in names]
    total = sum(have)
    target = entropy(weights(have, 1)) + gap * (entropy(weights(have, 0)) - entropy(weights(have, 1)))
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(weights(have, mid)) >= target else (lo, mid)
    a = hi
    lo, hi = 0.0, 1.0
    most = lambda x: max(w * total / t for w, t in zip(weights(have, x), have))
    if most(0.0) > max_repeats:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if most(mid) > max_repeats else (lo, mid)
        a = max(a, hi)
    for name, w, t in zip(names, weights(have, a), have):
        mine = [g for g in got if g.source == name]
        used = sum(g.n_tokens * g.passes for g in mine)
        assert used <= w * total * (1 + 1e-4) + 1
        assert len({g.passes for g in mine if g.n_tokens}) <= 2
        assert used >= w * total * (1 - 1e-4) - max(g.n_tokens for g in mine) * 3 - 1  # rows with equal text share their fate
        assert all(g.passes <= math.ceil(max_repeats) for g in mine)


def test_part_of_a_pass_is_a_prefix(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 2)
    found = mixing.copies(docs, gap=0.9)
    order = mixing.schedule(found.selectExpr("doc_id", "source", "n_tokens", "_mx_k", "_mx_l", "block", "100 passes")).collect()
    took = {(g._mx_k, g._mx_l): g.passes for g in found.collect()}
    keys = {(g.doc_id, g.n_tokens, g.source): (g._mx_k, g._mx_l) for g in found.collect()}
    for source in {o.source for o in order}:
        whole = min(took[keys[o.doc_id, o.n_tokens, o.source]] for o in order if o.source == source)
        line = sorted((o for o in order if o.source == source and o["pass"] == whole), key=lambda o: (o.block_order, o.doc_order))
        flags = [took[keys[o.doc_id, o.n_tokens, o.source]] > whole for o in line]
        assert flags == sorted(flags, reverse=True)


def test_mix_keeps_columns(docs, wide, empty, rows):
    out = mixing.mix(docs)
    want = Counter()
    for g in mixing.copies(docs).collect():
        want[g.doc_id] += g.passes
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == +want
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in rows}
    assert mixing.mix(wide).columns == wide.columns and mixing.mix(wide).count() == out.count()
    assert mixing.mix(empty).count() == 0 and mixing.schedule(mixing.copies(empty)).count() == 0
