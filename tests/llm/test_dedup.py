"""Substring, SimHash, winnowing and line dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from strandworks.llm import components, linedup, simhash, substring, winnow
from strandworks.llm.bytegrid import split_words, text_bytes

from .cases import prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


# ------------------------------------------------------------ substring


def brute_substring(texts, width):
    seen = defaultdict(list)
    for d, t in enumerate(texts):
        w = words(t)
        for i in range(len(w) - width + 1):
            seen[tuple(w[i : i + width])].append((d, i))
    gone = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + width))
    out = []
    for d, t in enumerate(texts):
        w = words(t)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone[d])
        out.append((len(w), len(gone[d]), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("width,gram,cells", [(35, 16, 1 << 27), (35, 16, 1 << 16), (5, 3, 1 << 16), (8, 8, 1 << 16)])
def test_substring(docs, rows, width, gram, cells):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(docs, width, gram, cells).collect())
    want = Counter((r[0], *b) for r, b in zip(rows, brute_substring([r[1] for r in rows], width)))
    assert got == want


def test_full_sketch_loses_nothing(docs, rows):
    """A sketch so small that nearly all cells are full only means more exact work."""
    keyed = docs.selectExpr("doc_id", "text", "xxhash64(text) k1", "xxhash64(1L, text) k2")
    sketch = np.full((substring.ROWS, 8), 255, np.uint8)
    got = substring.removed_ranges(keyed, sketch, 64, 8).collect()
    exact = substring.removed_ranges(keyed, substring.repeated_sketch(keyed, 1 << 16), 1 << 16, 8).collect()
    assert {(r.k1, tuple(r.begin), tuple(r["size"])) for r in got} == {(r.k1, tuple(r.begin), tuple(r["size"])) for r in exact}


def test_anchors_do_not_depend_on_the_chunk(monkeypatch):
    """Hashes that differ in their last bits only give the same anchor in a short and in a long chunk."""
    def offset(n):
        seq = substring.Sequences(split_words(*text_bytes(pa.array([" ".join(f"w{i}" for i in range(n))]))))
        hashes = np.full(n - 15, (1 << 63) + (1 << 40), np.uint64)
        hashes[3], hashes[9] = (1 << 62) + 5, (1 << 62) + 4
        monkeypatch.setattr(seq, "hashes", lambda first, size, which: hashes)
        starts, text = seq.windows(35)
        return substring.anchors(seq, starts, text, 35, 16)[0][0]

    assert offset(35) == offset(300_000) == 9


def test_rerun_tasks_send_the_same_names(spark, docs):
    """What a task asks, chunk names included, is the same each time it runs."""
    keyed = docs.selectExpr("doc_id", "text", "xxhash64(text) k1", "xxhash64(1L, text) k2")
    sketch = substring.repeated_sketch(keyed, 1 << 16)
    runs = [sorted(tuple(map(bytes, (r.chunk, r.body))) + (r.bucket,) for r in substring.asked_windows(keyed, sketch, 1 << 16, 8, 3).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and runs[0]
    few = substring.removed_ranges(keyed, sketch, 1 << 16, 64, tasks=3).collect()  # a task that answers many buckets
    many = substring.removed_ranges(keyed, sketch, 1 << 16, 64).collect()
    assert {(r.k1, tuple(r.begin)) for r in few} == {(r.k1, tuple(r.begin)) for r in many}


def test_substring_edges(wide, empty, rows):
    assert substring.substring_dedup(wide).count() == len(rows)
    assert substring.substring_dedup(empty).count() == 0


# ------------------------------------------------------------ SimHash


def brute_fingerprint(text):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, bits=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash(docs, rows, wide, empty):
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = Counter(zip((r[0] for r in rows), (f"{f:016x}" for f in fps), brute_components([r[0] for r in rows], fps)))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert Counter(map(tuple, simhash.near_duplicates(wide).collect())) == want
    assert simhash.near_duplicates(empty).count() == 0


def near_fingerprints():
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for base in list(fps[:20]):
        for _ in range(6):
            f = base
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                f ^= 1 << int(b)
            fps.append(f)
    centre = int(rng.integers(0, 1 << 63))
    for _ in range(120):  # a dense group
        f = centre
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            f ^= 1 << int(b)
        fps.append(f)
    return sorted(set(fps))


@pytest.mark.parametrize("cap", [1024, 8, 0])
def test_pigeonring_finds_all_components(spark, cap):
    fps = near_fingerprints()
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(s,) for s in signed], "fp long")
    pairs = simhash.links(table, cap)
    for u, v in pairs.collect():
        assert ((u ^ v) & (1 << 64) - 1).bit_count() <= 3
    if cap == 1024:
        want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
        assert {(min(p), max(p)) for p in pairs.collect()} == want
    root = dict(map(tuple, components.connected(pairs).collect()))
    got = defaultdict(set)
    for s in signed:
        got[root.get(s, s)].add(s)
    wanted = defaultdict(set)
    for s, c in zip(signed, brute_components(list(range(len(fps))), fps)):
        wanted[c].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_components_on_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = dict(map(tuple, components.connected(edges).collect()))
    assert {got[i] for i in range(201)} == {0} and got[500] == got[501] == 500
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one(docs, rows):
    kept = simhash.keep_one(docs).collect()
    comp = brute_components(list(range(len(rows))), [brute_fingerprint(r[1]) for r in rows])
    assert len(kept) == len(set(comp))
    assert {tuple(k) for k in kept} <= {tuple(r) for r in rows}


# ------------------------------------------------------------ winnowing


def java_longs(spark, texts):
    """XXH64 of Spark, as the operator uses it."""
    rows = spark.createDataFrame([(t,) for t in sorted(set(texts))], "t string").selectExpr("t", "xxhash64(t) h").collect()
    return {r.t: r.h for r in rows}


def brute_winnow(spark, text, hashes, k=5, w=4):
    h = [hashes[x] for x in words(text)]
    if not h:
        return []
    r = [x & ((1 << 62) - 1) for x in h]
    if len(h) >= k:  # one residue of a gram after the other, rolled from the gram before
        parts = []
        for base, ws in ((winnow.BASES[0], [x >> 31 for x in r]), (winnow.BASES[1], [x & winnow.PRIME for x in r])):
            at = 0
            for x in ws[:k]:
                at = (at * base + x) % winnow.PRIME
            lane = [at]
            for old, new in zip(ws, ws[k:]):
                at = ((at - old * pow(base, k - 1, winnow.PRIME)) * base + new) % winnow.PRIME
                lane.append(at)
            parts.append(lane)
        grams = [(x << 31) | y for x, y in zip(*parts)]
    else:
        grams = [spark.createDataFrame([(r,)], "a array<long>").selectExpr("xxhash64(a) h").first().h]
    low = ~3
    chosen = []
    for i in range(max(1, len(grams) - w + 1)):
        part = grams[i : i + w]
        at = max(j for j, x in enumerate(part) if (x & low) == min(y & low for y in part)) + i if len(grams) >= w else max(j for j, x in enumerate(part) if (x & low) == min(y & low for y in part))
        if not chosen or chosen[-1][0] != at:
            chosen.append((at, grams[at]))
    return chosen


def test_winnowing(spark, docs, rows):
    got = winnow.winnow(docs.selectExpr("doc_id", "coalesce(text, '') text"), "text", "a_").collect()
    short = [r for r in got if len(r.text) < 2000]
    hashes = java_longs(spark, [x for r in short for x in words(r.text)])
    for r in short:
        assert list(zip(r.a_pos, r.a_hash)) == brute_winnow(spark, r.text, hashes), r.text[:40]


@pytest.mark.parametrize("k", [1, 2, 3, 4, 7, 12])
def test_rolled_hashes_of_any_length(spark, k):
    xs = [(i * 0x9E3779B97F4A7C15) % (1 << 62) for i in range(1, 16)]
    got = winnow.rolled(spark.createDataFrame([(xs,), (xs[:k],), ([],)], "w array<long>"), "w", {k: "g"}).collect()
    lane = lambda ws, b: sum(x * pow(b, k - 1 - j, winnow.PRIME) for j, x in enumerate(ws)) % winnow.PRIME
    gram = lambda ws: (lane([x >> 31 for x in ws], winnow.BASES[0]) << 31) | lane([x & winnow.PRIME for x in ws], winnow.BASES[1])
    want = xs if k == 1 else [gram(xs[i : i + k]) for i in range(len(xs) - k + 1)]
    assert got[0].g == want and len(got[1].g) == 1 and got[2].g == []


def test_match_guarantee(spark):
    """Texts that share K + W - 1 words share a chosen hash."""
    shared = prose(9, winnow.K + winnow.W - 1).replace("\n", " ")
    a, b = f"{prose(10, 30)} {shared} {prose(11, 30)}", f"{prose(12, 17)} {shared} {prose(13, 44)}"
    x, y = (set(r.a_hash) for r in winnow.winnow(spark.createDataFrame([(a,), (b,)], "text string"), "text", "a_").collect())
    assert x & y
    p, q = (dict(zip(r.hashes, r.positions)) for r in winnow.fingerprint_report(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).orderBy("doc_id").collect())
    common = [(p[h], q[h]) for h in p.keys() & q.keys()]
    assert common and all(words(a)[i : i + winnow.K] == words(b)[j : j + winnow.K] for i, j in common)


@pytest.mark.parametrize("range_rows", [2000, 3])
def test_edited_texts_and_likeness(docs, rows, monkeypatch, range_rows):
    monkeypatch.setattr(winnow, "RANGE_ROWS", range_rows)
    got = winnow.fingerprint_report(docs).collect()
    assert len(got) == len(rows)
    tie = {r.text: r.h for r in docs.selectExpr("coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").collect()}
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), tie[r[1] or ""]))
    want = Counter()
    for r, n in zip(order, order[1:] + order[:1]):
        t, u = r[1] or "", n[1] or ""
        e = len(t) // 3
        edited = t[: len(t) - e] + u[:e]
        want[(r[0], len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter((g.doc_id, g.n_chars, g.edited_sha256) for g in got) == want
    for g in got:
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
        if g.fingerprint == g.edited_fingerprint:
            assert g.near_edited == 1.0


def test_rows_without_id_are_several_ranges(spark, monkeypatch):
    """Null ids and an id that many rows have are cut by text hash, and neighbours stay those of the whole order."""
    monkeypatch.setattr(winnow, "RANGE_ROWS", 5)
    rows = [(None, f"text {i} of none") for i in range(60)] + [(7, f"text {i} of seven") for i in range(60)] + [(i, f"text {i}") for i in range(40)] + [(None, "same"), (None, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tie = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), tie[r[1]]))
    got = winnow.with_next(df).where("NOT guest").select("doc_id", "text", "range").collect()
    assert Counter(r["range"] for r in got).most_common(1)[0][1] < 20
    assert len({r["range"] for r in got if r.doc_id is None}) > 4
    want = Counter((r[0], hashlib.sha256((r[1][: len(r[1]) - len(r[1]) // 3] + n[1][: len(r[1]) // 3]).encode()).hexdigest()) for r, n in zip(order, order[1:] + order[:1]))
    assert Counter((r.doc_id, r.edited_sha256) for r in winnow.fingerprint_report(df).select("doc_id", "edited_sha256").collect()) == want


def test_winnowing_edges(wide, empty, rows, spark):
    assert winnow.fingerprint_report(wide).count() == len(rows)
    assert winnow.fingerprint_report(empty).count() == 0
    only = winnow.fingerprint_report(spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")).first()
    assert only.near_next == 1.0


def test_short_and_unspaced_texts_survive_the_edit(spark):
    """Texts of few words, or without white space, share fingerprints with their edited texts."""
    unspaced = "".join(chr(0x4E00 + i * 7919 % 20000) for i in range(3000))
    dna = "".join("ACGT"[(i * i * 31 + i // 7) % 4] for i in range(2000))
    far = "".join(chr(0x20000 + i * 31 % 40000) for i in range(500))
    texts = ["alpha beta gamma", "seven little words are all it has", "extraordinarily", "a few", unspaced, dna, far, prose(3, 40) + " " + unspaced[:900], "nine words are in this text as it is"]
    got = winnow.fingerprint_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)).collect()
    assert len(got) == len(texts)
    for r in got:
        if len(texts[r.doc_id]) >= 6:
            assert r.near_edited > 0, texts[r.doc_id][:40]
    for r in got:
        if r.doc_id in (4, 6):
            assert r.near_edited > 0.3
    assert {r.near_next for r in got if r.doc_id in (5, 6)} == {0.0}


# ------------------------------------------------------------ lines


def brute_lines(rows, keys, min_lines, min_words):
    """Kept text of each distinct (doc_id, text), by definition: later copies of long enough repeated runs go."""
    docs = sorted({(r[0] is not None, r[0] or 0, keys[(r[0], r[1])], r[0], r[1]) for r in rows if r[1] is not None})
    seqs = []
    for *_, ident, text in docs:
        lines = text.split("\n")
        seqs.append((ident, text, [(i, x) for i, x in enumerate(lines) if words(x)]))
    first, gone = {}, defaultdict(set)
    for size in (1, min_lines):
        first = {}
        for d, (_, _, seq) in enumerate(seqs):
            for p in range(len(seq) - size + 1):
                run = tuple(x for _, x in seq[p : p + size])
                if run not in first:
                    first[run] = (d, p)
                elif size == min_lines or len(words(run[0])) >= min_words:
                    gone[d].update(i for i, _ in seq[p : p + size])
    return {(i, t): "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]) for d, (i, t, _) in enumerate(seqs)}


@pytest.mark.parametrize("min_lines,min_words,fold", [(2, 10, 5), (3, 10**6, 2), (5, 8, 1), (4, 10**6, 5)])
def test_line_dedup(docs, rows, min_lines, min_words, fold):
    keys = {(r.doc_id, r.text): (r.a, r.b) for r in docs.selectExpr("doc_id", "text", "xxhash64(doc_id, text) a", "xxhash64(1, doc_id, text) b").collect()}
    want = brute_lines(rows, keys, min_lines, min_words)
    got = linedup.dedup_lines(docs.withColumn("orig", docs.text), min_lines, min_words, fold=fold).collect()
    assert len(got) == len(rows)
    for g in got:
        assert g.text == (want[(g.doc_id, g.orig)] if g.orig is not None else None)
        if g.orig is not None:
            assert g._ld_gone == len(g.orig.split("\n")) - (len(g.text.split("\n")) if g._ld_gone < len(g.orig.split("\n")) else 0)


def test_texts_are_not_sorted_to_meet_their_deleted_lines(docs):
    """The join that texts go through hashes the deleted lines; a sort would hold whole texts in pages."""
    plan = linedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join [_ld_k" in x and "LeftOuter" in x]
    assert len(joins) == 1 and "ShuffledHashJoin" in joins[0]


def test_line_dedup_edges(wide, empty, rows):
    got = linedup.dedup_lines(wide)
    assert got.count() == len(rows) and "x-n" in {r.n for r in got.collect()}
    assert linedup.dedup_lines(empty).count() == 0


def brute_runs(texts):
    """(text, line, lines) of maximal runs: the longest common prefix of each suffix with any other, by comparing all."""
    seqs = [[(i, x) for i, x in enumerate(t.split("\n")) if words(x)] for t in texts]
    suffixes = [(d, p) for d, s in enumerate(seqs) for p in range(len(s))]
    longest = {}
    for d, p in suffixes:
        best = 0
        for e, q in suffixes:
            if (d, p) != (e, q):
                n = 0
                while p + n < len(seqs[d]) and q + n < len(seqs[e]) and seqs[d][p + n][1] == seqs[e][q + n][1]:
                    n += 1
                best = max(best, n)
        longest[d, p] = best
    return {(d, seqs[d][p][0], n) for (d, p), n in longest.items() if n and longest.get((d, p - 1), 0) <= n}


def run_texts():
    """Runs of 1 to 20 lines that repeat across and inside documents, copies, and texts of one line."""
    rng = np.random.default_rng(8)
    line = lambda: " ".join(f"w{v}" for v in rng.integers(0, 10**6, 3))
    passages = [[line() for _ in range(n)] for n in (1, 2, 3, 4, 5, 7, 8, 9, 16, 20)]
    texts = []
    for _ in range(14):
        parts = []
        for k in rng.permutation(len(passages))[:3]:
            cut = rng.integers(0, len(passages[k]))
            parts += [*passages[k][cut:], *(line() for _ in range(rng.integers(0, 3))), *([""] if rng.integers(2) else [])]
        texts.append("\n".join(parts))
    return [*texts, texts[0], texts[1] + "\n" + texts[1], "same\n" * 37, "same\n" * 9 + "other", passages[5][0], passages[5][0], ""]


@pytest.mark.parametrize("fold", [2, 5])
def test_maximal_runs(spark, monkeypatch, fold):
    """The suffix array's runs, whatever the number of doublings a round and the ranges of the sort."""
    monkeypatch.setattr(linedup, "KEYS_A_RANGE", 20)
    texts = run_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in linedup.maximal_runs(docs, fold).collect()} == brute_runs(texts)


def test_suffix_array_is_in_order(spark, monkeypatch):
    """Ranks sort suffixes by their lines, and neighbours have the common prefix that is said."""
    monkeypatch.setattr(linedup, "KEYS_A_RANGE", 20)
    texts = run_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    single, files = linedup.repeated_lines(docs)
    levels = linedup.suffix_array(single, files, fold=1)
    ids = defaultdict(dict)
    for r in single.collect():
        ids[r._ld_doc][r._ld_pos] = r.id

    def sequence(d, p):
        out = []
        while p in ids[d]:
            out.append(ids[d][p])
            p += 1
        return out

    assert len(levels) > 4
    for level in levels:
        keys = {(k._ld_a, k._ld_b): k for k in level.keys.collect()}
        members = sorted(((keys[m._ld_a, m._ld_b], sequence(m._ld_doc, m._ld_pos)) for m in level.members.collect()), key=lambda x: x[0].rank)
        cut = [(k, s[: 2 * level.h]) for k, s in members]
        assert [s for _, s in cut] == sorted(s for _, s in cut)
        for (a, s), (b, t) in zip(members, members[1:]):
            if a.rank != b.rank:
                common = next((i for i, (x, y) in enumerate(zip(s, t)) if x != y), min(len(s), len(t)))
                assert b.lcp == a.lcp_next == common
