"""Quality rules: measures and verdicts against plain Python, bounds against summed probabilities, and SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import comb

import pytest

from strandworks.llm import riskrules

from .. import oracle
from .cases import SCHEMA, prose


def measured(text):
    text = text or ""
    words = re.findall("[^ \t-\r]+", text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + j for places in windows.values() if len(places) > 1 for i in places for j in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_lines": len(lines), "n_capitals": len(re.findall("[A-Z]", text)), "n_letters": len(re.findall("[A-Za-z]", text)),
    }


def binned(m):
    n = max(m["n_words"], 1)
    mean = min(127, 10 * m["word_chars"] // n)
    return {
        "symbols": min(127, 20 * m["n_symbols"] // n), "capitals": 100 * m["n_capitals"] // max(m["n_letters"], 1), "dup_lines": 100 * m["n_dup_lines"] // max(m["n_lines"], 1),
        "repeats": 100 * m["n_repeat_words"] // n, "long_words": mean, "short_words": 127 - mean,
    }


def tail(k, n, rate):
    p = Fraction(rate)
    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def brute(rows, labels, alpha=riskrules.ALPHA, delta=riskrules.DELTA, least=riskrules.LEAST_ODDS):
    quality = {}
    for doc_id, q, _ in labels:
        if q in (0, 1) and doc_id is not None:
            quality[doc_id] = min(q, quality.get(doc_id, 1))
    seen, texts = [], {}
    for doc_id, text, lang, *_ in rows:
        m = measured(text)
        failed = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
        seen.append((doc_id, lang, m, binned(m), failed))
        if not failed and doc_id in quality:
            key = (lang, hashlib.md5((text or "").encode()).hexdigest())
            texts[key] = (min(quality[doc_id], texts.get(key, (1,))[0]), binned(m))
    first = [v for k, v in texts.items() if int(k[1][-1], 16) % 2 == 0]

    def rank(bins):
        best = 0.0
        for rule, at in bins.items():
            for b in range(at + 1):
                bad, good = (sum(x[rule] >= b for q, x in first if q == want) for want in (0, 1))
                best = max(best, (2 * bad + 1) / (2 * good + 1))
        return best

    memo = {}

    def cached(bins):
        key = tuple(bins.items())
        if key not in memo:
            memo[key] = rank(bins)
        return memo[key]

    values = {cached({rule: b}) for rule in riskrules.RULES for b in range(128)}
    values = sorted((v for v in values if v >= least), reverse=True)
    held = defaultdict(list)
    for (lang, digest), (q, bins) in texts.items():
        if q == 1 and int(digest[-1], 16) % 2:
            held[lang].append(cached(bins))
    strata = max(1, sum((1 - alpha) ** len(x) <= delta for x in held.values()))
    cut = {}
    for lang, ranks in held.items():
        for v in values:
            if tail(sum(r >= v for r in ranks), len(ranks), alpha) > Fraction(delta) / strata:
                break
            cut[lang] = v
    out = Counter()
    for doc_id, lang, m, bins, failed in seen:
        c = cut.get(lang)
        out[(doc_id, *(m[x] for x in riskrules.MEASURES[:5]), failed, not failed and (c is None or cached(bins) < c), cached(bins), c)] += 1
    return out


@pytest.fixture(scope="module")
def corpus(rows):
    rnd = random.Random(11)
    made = list(rows)
    for i in range(900):
        lang = ["en", "en", "de", None, "xx"][i % 5] if i % 97 else "rare"
        text = prose(100 + i, 25 + rnd.randrange(30))
        if i % 4 == 0:
            text = rnd.choice([text.upper(), text.replace(" ", " | "), "\n".join(text.split("\n")[:1] * 3) + "\n" + text, " ".join(w + "###" for w in text.split())])
        made.append((1000 + i, text, lang, "s", len(text)))
    made += [(5000 + i, made[30 + i][1], made[30 + i][2], "copy", 1) for i in range(60)]
    labels = [(1000 + i, int(i % 4 != 0) if rnd.random() < 0.97 else None if rnd.random() < 0.2 else int(i % 4 == 0), 0) for i in range(0, 880)]
    labels += [(5000 + i, 1, 0) for i in range(60)] + [(None, 1, 1), (1004, 0, 0), (7, 1, None)]
    return made, labels


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("alpha,least", [(0.05, 4.0), (0.12, 0.5)])
def test_equals_plain_version(spark, corpus, alpha, least):
    rows, labels = corpus
    got = riskrules.judge(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(labels, LABELS), alpha=alpha, least_odds=least).collect()
    want = brute(rows, labels, alpha=alpha, least=least)
    assert Counter(map(tuple, got)) == want
    assert any(not r.base_failed and not r.kept for r in got) and len({r.cutoff for r in got}) > 1


def test_measures(rows):
    import pyarrow as pa

    texts = [r[1] for r in rows] + ["a\n\na\n a\na", "\n", "x\n", "x\ny\nx\n", "", "Ü ü\nÜ ü\r\nÜ ü", "|" * 50, prose(9, 9000) + "\n" + prose(9, 50)]
    for arr in (pa.array(texts), pa.array(texts).slice(3, 9), pa.array(["", None]), pa.array([], pa.string()), pa.array(["tail\n", "", "\nhead"])):
        got = riskrules.measure(arr)
        assert [{k: int(v[i]) for k, v in got.items()} for i in range(len(arr))] == [measured(t) for t in arr.to_pylist()]


def test_bounds():
    for n, k, rate in [(60, 0, 0.05), (300, 4, 0.05), (1000, 30, 0.05), (50, 40, 0.3), (5, 5, 0.5), (2000, 150, 0.1)]:
        assert abs(riskrules.binomial_tail(k, n, rate) - float(tail(k, n, rate))) < 1e-9
    n = riskrules.least_good(0.05, 0.05)
    assert tail(0, n, 0.05) <= Fraction(0.05) < tail(0, n - 1, 0.05)
    assert riskrules.binomial_tail(49_000_000, 10**9, 0.05) < 1e-300


def test_false_rejections_stay_below_the_limit():
    """Over many draws of labels, the true rate of the chosen cutoff is over the limit at most as often as delta says."""
    rnd, values, over, runs = random.Random(2), [float(v) for v in range(40, 0, -1)], 0, 600
    for _ in range(runs):
        lost = Counter()
        for _ in range(400):
            r = 41 * rnd.random()  # a cutoff v loses (41 - v) / 41 of the good
            lost[float(int(r)) if r >= 1 else 0.0] += 1
        cut = riskrules.choose(values, {k: v for k, v in lost.items() if k > 0}, 400, 0.1, 0.05)
        over += cut is not None and (41 - cut) / 41 > 0.1
    assert over <= runs * 0.08


def test_empty_and_clashing(spark, rows, docs, wide, empty):
    none = spark.createDataFrame([], LABELS)
    assert riskrules.judge(empty, none).count() == 0
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], LABELS)
    assert riskrules.judge(empty, labels).count() == 0
    got = Counter(map(tuple, riskrules.judge(docs, none).collect()))
    assert got == brute(rows, [])
    assert Counter(map(tuple, riskrules.judge(wide.withColumns({c: wide.key for c in ("stratum", "digest", "cutoff", "symbols", "good")}), none).collect())) == got


def test_sql_twin(spark, sf):
    oracle.assert_equal(riskrules.op11_quality_rules(spark, sf), oracle.tables(sf), riskrules.OP11_SQL)
