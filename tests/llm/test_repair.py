"""Conversation repair: edits against every way there is, whole results against a plain version and SQL."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandworks.llm import repair

from .. import oracle

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def every_way(letters):
    """Least (cost, audit) by trying all edits with up to two inserts at a place."""
    best = None
    options = []
    for c in letters:
        more = [("D", "", 3)]
        if c != "x":
            extra = c.isupper()
            more += [("K", c.lower(), extra), ("R", "u", 2 + extra), ("R", "a", 2 + extra)]
        options.append(more)
    gaps = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(*options):
        for some in itertools.product(gaps, repeat=len(letters) + 1):
            roles = "".join(g + e[1] for g, e in zip(some, edits)) + some[-1]
            if GOOD.fullmatch(roles):
                audit = "".join("I" * len(g) + e[0] for g, e in zip(some, edits)) + "I" * len(some[-1])
                way = (sum(e[2] for e in edits) + 2 * sum(map(len, some)), audit)
                best = way if best is None else min(best, way)
    return best


def plain(letters):
    """Least (cost, audit) from the end backwards, with whole strings."""
    after = {"": "", "s": "s", "u": "u", "a": "a"}
    value = {}
    for i in range(len(letters), -1, -1):
        ends = {"": (0, ""), "a": (0, ""), "u": None, "s": None}
        now = {s: ends[s] if i == len(letters) else None for s in after}
        if i < len(letters):
            for s in after:
                c, ways = letters[i], [(3 + value[s][0], "D" + value[s][1])]
                extra = c.isupper()
                for role in "sua":
                    if (role == "s" and s == "") or (role == "u" and s != "u") or (role == "a" and s == "u"):
                        if c != "x" and c.lower() == role:
                            ways.append((extra + value[role][0], "K" + value[role][1]))
                        if c != "x" and role != "s":
                            ways.append((2 + extra + value[role][0], "R" + value[role][1]))
                now[s] = min(ways)
        for _ in range(3):  # inserts: to the next role
            for s in after:
                t = "a" if s == "u" else "u"
                if now[t] is not None:
                    way = (2 + now[t][0], "I" + now[t][1])
                    now[s] = way if now[s] is None else min(now[s], way)
        value = now
    return value[""]


def brute(rows):
    white = " \t\n\x0b\f\r"
    convs = {}
    for conv_id, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        held = convs.setdefault(conv_id, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return convs, white


def result(conv_id, rows, white):
    seen, letters, count = set(), "", Counter()
    for _, role, text in rows:
        bare = text.rstrip(white)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        count[fault] += 1
        c = role[:1] if role[:1] in ("s", "u", "a") else "o"
        letters += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = plain(letters)
    out, at, state = [], 0, ""
    for e in audit:
        new = "assistant" if state == "u" else "user"
        if e == "I":
            out.append(f"{new}:")
            state = new[0]
            continue
        _, role, text = rows[at]
        at += 1
        if e != "D":
            role = new if e == "R" else role
            out.append(f"{role}:{text}")
            state = role[0]
    return (conv_id, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(), len(rows))


def expected(spark, rows):
    convs, white = brute(rows)
    flat = [(c, t, r, x) for c, held in convs.items() for t, r, x in held]
    h = {(r.role, r.text): r.h for r in spark.createDataFrame(flat or [(1, 1, "", "")], SCHEMA).selectExpr("role", "text", "xxhash64(role, text) h").distinct().collect()}
    order = lambda x: (x[0] is not None, x[0] or 0, h[(x[1], x[2])])
    return Counter(result(c, sorted(held, key=order), white) for c, held in convs.items())


def test_layers_equal_every_way():
    rnd = random.Random(5)
    for letters in ["", *"suaoSUAOx", *map("".join, itertools.product("sUaox", repeat=2)), *("".join(rnd.choice("suaoSUAOx") for _ in range(3)) for _ in range(12))]:
        trie = repair.Trie((0,))
        assert repair.compose([trie.answers(letters)]) == plain(letters) == every_way(letters)


def test_trie_shares_prefixes_and_blocks_compose():
    rnd = random.Random(7)
    some = sorted({"".join(rnd.choice("suauauaoSUAx") for _ in range(rnd.randrange(40))) for _ in range(400)})
    trie, prefixes = repair.Trie((0,)), set()
    for s in some:
        assert repair.compose([trie.answers(s)]) == plain(s)
        prefixes.update(s[:i] for i in range(1, len(s) + 1))
    assert trie.made == len(prefixes)
    for s in some[::3]:
        inner, parts = repair.Trie((0, 1, 2, 3)), [s[i : i + 4] for i in range(0, len(s), 4)]
        assert repair.compose([inner.answers(p) for p in parts]) == plain(s)


@pytest.fixture(scope="module")
def talk():
    rnd = random.Random(3)
    rows = []
    for c in range(150):
        for t in range(rnd.randrange(1, 12)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c if c else None, rnd.choice([t, t, t, None, 3]) if c % 4 == 0 else t, role, rnd.choice(["Hello there.", "Well", "What? ", None, "", " \n", f"Some text {t}!", "é漢."])))
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"line {t % 700}.") for t in range(5000)]  # longer than a block
    rows += [(1001, 5, "user", "the same.")] * 1500 + [(1002, None, "assistant", "x" * 200_000)]
    rows += rows[5:8]
    return rows


def test_equals_plain_version(spark, talk):
    df = spark.createDataFrame(talk, SCHEMA)
    want = expected(spark, talk)
    for parts in (3, 11):
        got = Counter(tuple(r) for r in repair.repair(repair.damage(df.repartition(parts))).collect())
        assert got == want
    wide = df.select("*", *(F.lit("q").alias(x) for x in ("c", "z", "h", "tag", "kind", "block", "first", "n", "sig", "gone")))
    assert Counter(tuple(r) for r in repair.repair(repair.damage(wide)).collect()) == want


def test_empty_and_dropped(spark):
    assert repair.repair(repair.damage(spark.createDataFrame([], SCHEMA))).count() == 0
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (r,) = repair.repair(repair.damage(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA))).collect()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), 0)


def test_sql_twin(spark, sf):
    oracle.assert_equal(repair.op12_conversation_repair(spark, sf), oracle.tables(sf), repair.OP12_SQL)
