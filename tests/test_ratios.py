"""Error ratios against a plain count, and that no window or pair of neighbours is a row of a shuffle."""

import random
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from strandworks.operators import ratios


def plain(texts, k, strong):
    turn = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    windows = [(min(w, turn(w)), p) for t in texts for p in range(len(t) - k + 1) if set(w := t[p : p + k]) <= set("ACGT")]
    n, at = Counter(w for w, _ in windows), defaultdict(Counter)
    for w, p in windows:
        at[w][p] += 1
    out = {}
    for s in (w for w in n if n[w] > strong):
        near = {min(x, turn(x)) for i in range(k) for b in "ACGT" if (x := s[:i] + b + s[i + 1 :]) != s} - {s}
        solid, weak = [n[x] for x in near if n[x] > strong], [x for x in near if 0 < n[x] <= strong]
        for p in {p for x in weak for p in at[x]}:
            v = sorted(at[x][p] for x in weak if p in at[x])
            mass = v[len(v) // 2] * len(v)
            out[s, p] = mass / (n[s] + sum(solid)) - mass * sum(1 / m for m in solid) if solid else mass / n[s]
    return out


@pytest.mark.parametrize("k, strong", [(3, 20), (11, 4), (12, 4), (31, 4), (6, 100)])
def test_ratios_are_those_of_a_plain_count(spark, k, strong):
    rnd = random.Random(k)
    base, texts = "".join(rnd.choices("ACGT", k=60)), []
    for _ in range(120):
        t = list(base[rnd.randrange(3) :])
        for _ in range(rnd.randrange(3)):
            t[rnd.randrange(len(t))] = rnd.choice("ACGTN")
        texts.append("".join(t))
    texts += ["", "AC", "A" * 200, "ACGT" * 80]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "read_id long, seq string")
    got = {(r.kmer, r.pos): r.ratio for r in ratios.error_ratios(rows, k, strong).collect()}
    assert got == pytest.approx(plain(texts, k, strong)) and got


def test_nothing_is_strong(spark):
    rows = spark.createDataFrame([(1, "ACGTTGCATT"), (2, None)], "read_id long, seq string")
    assert ratios.error_ratios(rows, 5, 99).count() == ratios.error_ratios(rows.limit(0), 5, 99).count() == 0


def test_neighbours_are_neither_broadcast_nor_grouped_by_position(spark, sf):
    plan = entry.queries()["error_ratios"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "pos" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)
