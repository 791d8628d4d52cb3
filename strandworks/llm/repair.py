"""Operator 12, conversation structure repair by dynamic programming over a trie.

A row of a conversation is one letter: its role's initial (``s``, ``u``, ``a``, else
``o``), in capitals if its text is truncated, or ``x`` if it is blank or a duplicate
and must go. The letters of a conversation are its signature. Few signatures are
different, and those that differ often begin alike: the distinct ones are sorted by
range, each task walks its share as a prefix trie, a layer of the programme is
computed once for each prefix, and answers are given where a signature ends.

The edits: Keep (0), Rerole to user or assistant (2), Delete (3), Insert an empty row
of user or assistant (2); a truncated row that stays adds 1. The roles that are left
are nothing, or at most one system, then user and assistant in turn. A layer has the
best way to each of four states (nothing yet, after system, user, assistant). Of equal
costs the least string of initials wins. No way's string begins with that of another
way of the same layer, for each has taken the same rows and ends with the edit of the
last one; so ranks of the four strings are enough to compare them, a layer has fixed
size, and strings are put together at the end from what each layer came from.

Long conversations are cut in blocks of ``BLOCK`` rows. A block's answer holds the best
way from each state to each, with the order of their strings, and blocks are put
together in their order. Rows are dealt out by range of (conversation, turn, hash), so
that one conversation with most of the rows is many tasks up to here. Only the last
step, the hash of a repaired conversation, takes one conversation's rows in one task,
in a stream: SHA-256 reads them one after another. What is held is its audit and
answers, some 16 bytes a row at most, never texts.

Edge cases: a null role or text is one space, in the key of the damage also a null
conv_id or turn; a null conv_id is a conversation of its own; null turns come first;
rows of one turn are in the order of their hash, equal rows next to each other; an
empty role has no initial, so it can not be kept; an empty table gives an empty
result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep

BLOCK = 1024
WHITE = " \t\n\x0b\f\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: The state after one more user or assistant, and that row's role.
TURN = {NOTHING: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: Inserts that lead from a state to a proper end.
END = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LEGAL = {"su", "ua", "au"}


def _moves(letter: str, state: int) -> list[tuple[int, int, str]]:
    """``(state after, cost, edits)`` of one row: some inserts, then the row's own edit; the best for each state after."""
    best: dict[int, tuple[int, str]] = {}
    at = state
    for inserts in range(3):
        more = [(at, DELETE, "D")]
        if letter != "x":
            extra = TRUNCATED if letter.isupper() else 0
            after, role = TURN[at]
            more.append((after, REROLE + extra, "R"))
            if letter.lower() == role[0]:
                more.append((after, KEEP + extra, "K"))
            if letter.lower() == "s" and at == NOTHING:
                more.append((SYSTEM, KEEP + extra, "K"))
        for after, cost, edit in more:
            way = (INSERT * inserts + cost, "I" * inserts + edit)
            best[after] = min(best.get(after, way), way)
        at = TURN[at][0]
    return [(after, *way) for after, way in best.items()]


MOVES = {letter: [_moves(letter, state) for state in range(4)] for letter in "suaoSUAOx"}

#: A layer: for each state (cost, rank of its string, state before, edits), or None.
Layer = list


def first_layer(state: int) -> Layer:
    return [(0, 0, -1, "") if s == state else None for s in range(4)]


def next_layer(layer: Layer, letter: str) -> Layer:
    best: list = [None] * 4
    for state, (way, moves) in enumerate(zip(layer, MOVES[letter])):
        if way is None:
            continue
        for after, cost, edits in moves:
            new = (way[0] + cost, way[1], edits, state)
            if best[after] is None or new < best[after]:
                best[after] = new
    order = sorted((b[1], b[2], s) for s, b in enumerate(best) if b is not None)
    rank = {s: i for i, (_, _, s) in enumerate(order)}
    return [None if b is None else (b[0], rank[s], b[3], b[2]) for s, b in enumerate(best)]


def spell(layers: list[Layer], state: int) -> str:
    """The edits of the best way to a state of the last layer."""
    out = []
    for layer in reversed(layers):
        _, _, state, edits = layer[state]
        out.append(edits)
        if state < 0:
            break
    return "".join(reversed(out))


class Trie:
    """The path of a prefix trie that sorted signatures walk, with the layers of each node on it.

    ``made`` counts the layers computed, one for each prefix and starting state.
    """

    def __init__(self, starts: tuple[int, ...]) -> None:
        self.path, self.stacks, self.starts, self.made = "", [[first_layer(s)] for s in starts], starts, 0

    def answers(self, signature: str) -> list[tuple[int, int, int, int, str]]:
        """``(start, state, cost, rank, edits)`` at the node of ``signature``."""
        shared = next((i for i, (a, b) in enumerate(zip(self.path, signature)) if a != b), min(len(self.path), len(signature)))
        for stack in self.stacks:
            del stack[shared + 1 :]
            for letter in signature[shared:]:
                stack.append(next_layer(stack[-1], letter))
        self.made += len(signature) - shared
        self.path = signature
        return [(start, state, way[0], way[1], spell(stack, state)) for start, stack in zip(self.starts, self.stacks) for state, way in enumerate(stack[-1]) if way is not None]


def compose(blocks: list[list[tuple[int, int, int, int, str]]]) -> tuple[int, str]:
    """Cost and edits of a whole conversation from the answers of its blocks."""
    now = {NOTHING: (0, 0)}  # state: cost, rank
    came: list[dict[int, tuple[int, str]]] = []
    for answers in blocks:
        best: dict[int, tuple] = {}
        for start, state, cost, rank, edits in answers:
            if start in now:
                new = (now[start][0] + cost, now[start][1], rank, start, edits)
                if state not in best or new[:2] < best[state][:2]:
                    best[state] = new
        order = sorted(best, key=lambda s: best[s][1:3])
        now = {s: (best[s][0], order.index(s)) for s in best}
        came.append({s: best[s][3:] for s in best})
    state = min(now, key=lambda s: (now[s][0] + INSERT * len(END[s]), now[s][1]))
    cost, out = now[state][0] + INSERT * len(END[state]), [END[state]]
    for step in reversed(came):
        state, edits = step[state]
        out.append(edits)
    return cost, "".join(reversed(out))


class Repair:
    """Applies edits to rows as they come and hashes the repaired ``role:text`` lines."""

    def __init__(self, edits: str) -> None:
        self.edits, self.at, self.state, self.any, self.hash = edits, 0, NOTHING, False, sha256()

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _insert(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            self.state, role = TURN[self.state]
            self._put(role, "")

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "D":
            return
        if edit == "K" and role[0] == "s":
            self.state = SYSTEM
        else:
            self.state, new = TURN[self.state]
            role = new if edit == "R" else role
        self._put(role, text)

    def end(self) -> str:
        self._insert()
        return self.hash.hexdigest()


# ------------------------------------------------------------------------ in Spark


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage: ``conv_id, turn, role, text, gone``; a dropped row stays as ``gone``, a repeated one comes twice."""
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")))
    kind = plain.withColumn("kind", F.crc32(key) % 20)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return kind.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("_copy")).drop("_copy")


def _fault(text: str) -> Column:
    """``x`` blank, ``t`` truncated, else empty."""
    bare = F.rtrim(F.col(text), F.lit(WHITE))
    return F.when(bare == "", "x").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "").otherwise("t")


_KEYS = ["z", "c", "turn", "h"]
_BLOCK_COLUMNS = "n long, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long, early long, late long, inner boolean, sig string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to blocks; the first block of a task may go on with a conversation of the task before."""
    names = [x.split()[0] for x in f"z boolean, c long, turn long, h long, seq long, {_BLOCK_COLUMNS}".split(", ")]
    types = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 5, pa.bool_(), pa.string()]
    seq, conv, before, rows, done, begun = 0, None, None, [], [], False

    def close(inner: bool) -> None:
        nonlocal seq
        letters, known = [], [t for _, _, t, *_ in rows if t is not None]
        count = {"x": 0, "d": 0, "t": 0}
        for _, _, _, _, initial, fault in rows:
            if fault:
                count[fault] += 1
            letter = initial if initial in ("s", "u", "a") else "o"
            letters.append("x" if fault in ("x", "d") else letter.upper() if fault == "t" else letter)
        initials = [r[4] for r in rows]
        illegal = sum(a + b not in LEGAL for a, b in pairwise(initials))
        turns = len({*known})
        z, c, turn, h = rows[0][:4]
        done.append((z, c, turn, h, seq, len(rows), count["x"], count["d"], count["t"], illegal, initials[0], initials[-1], min(known, default=None), max(known, default=None), turns, known[0] if known else None, known[-1] if known else None, inner, "".join(letters)))
        seq += 1

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], names)
        done.clear()
        return out

    inner = True
    for batch in batches:
        for z, c, turn, h, initial, fault, later in zip(*(batch.column(x).to_pylist() for x in (*_KEYS, "initial", "fault", "later"))):
            if conv != (z, c):
                if rows:
                    close(inner)
                    rows.clear()
                conv, inner, begun = (z, c), not begun, True
            elif len(rows) >= BLOCK:
                close(inner)
                rows.clear()
                inner = True
            if fault != "x" and (later or before == (z, c, turn, h)):
                fault = "d"
            before = (z, c, turn, h)
            rows.append((z, c, turn, h, initial, fault))
        if len(done) > 2000:
            yield flush()
    if rows:
        close(inner)
    if done:
        yield flush()


_ANSWERS = "array<struct<start: int, state: int, cost: long, rank: int, edits: string>>"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct signatures to answers: a trie for those that begin a conversation, one for the others."""
    tries = {False: Trie((NOTHING,)), True: Trie((NOTHING, SYSTEM, USER, ASSISTANT))}
    kind = pa.list_(pa.struct([("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("edits", pa.string())]))
    names = ("start", "state", "cost", "rank", "edits")
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            found = [[dict(zip(names, a)) for a in tries[inner].answers(sig)] for inner, sig in zip(part.column("inner").to_pylist(), part.column("sig").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("inner"), part.column("sig"), pa.array(found, kind)], ["inner", "sig", "answers"])


_RESULT = [("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("n_rows", pa.int64())]


class _Conversation:
    """One conversation of the last step: first its blocks, then its rows."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.blocks, self.answers, self.repair = conv_id, [], [], None

    def block(self, b: dict) -> None:
        self.answers.append([tuple(a[k] for k in ("start", "state", "cost", "rank", "edits")) for a in b.pop("answers")])
        self.blocks.append(b)

    def _solve(self) -> None:
        if self.repair is None:
            self.cost, self.audit = compose(self.answers)
            self.repair, self.answers = Repair(self.audit), []

    def row(self, role: str, text: str) -> None:
        self._solve()
        self.repair.row(role, text)

    def result(self) -> tuple:
        self._solve()
        b = self.blocks
        known = [x for x in b if x["turns"]]
        total = {k: sum(x[k] for x in b) for k in ("blank", "duplicate", "truncated", "illegal", "n")}
        total["illegal"] += sum(x["last"] + y["first"] not in LEGAL for x, y in pairwise(b))
        turns = sum(x["turns"] for x in known) - sum(x["late"] == y["early"] for x, y in pairwise(known))
        gaps = max(x["most"] for x in known) - min(x["least"] for x in known) + 1 - turns if known else 0
        return (self.conv_id, gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"], self.cost, self.audit, self.repair.end(), total["n"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*done), _RESULT)], [n for n, _ in _RESULT])
        done.clear()
        return out

    key = None
    for batch in batches:
        for z, c, tag, role, text, block in zip(*(batch.column(x).to_pylist() for x in ("z", "c", "tag", "role", "text", "block"))):
            if key != (z, c):
                if now is not None:
                    done.append(now.result())
                key, now = (z, c), _Conversation(None if z else c)
            if tag == 1:
                now.block(block)
            elif tag == 2:
                now.row(role, text)
        if len(done) > 2000:
            yield flush()
    if now is not None:
        done.append(now.result())
    if done:
        yield flush()


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and hash of the repaired text of each conversation.

    ``rows`` are ``conv_id, turn, role, text, gone`` as :func:`damage` gives them; a
    conversation whose rows are all gone has a row too. Returns ``conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256, n_rows``.
    """
    keyed = rows.select(F.col("conv_id").isNotNull().alias("known"), F.coalesce("conv_id", F.lit(0)).alias("c"), "turn", "role", "text", "gone").select(
        (~F.col("known")).alias("z"), "c", "turn", F.xxhash64("role", "text").alias("h"), "role", "text", "gone"
    )
    narrow = keep(keyed.where(~F.col("gone")).select(*_KEYS, F.left("role", F.lit(1)).alias("initial"), _fault("text").alias("fault")), "repair-rows")
    # A row is a duplicate if its hash comes at an earlier turn; equal rows of one turn meet in one task, next to each other.
    place = F.struct(F.col("turn").isNotNull().alias("k"), F.coalesce("turn", F.lit(0)).alias("t"))
    first = narrow.groupBy("z", "c", "h").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("z", "c", "h", "first")
    marked = narrow.join(first, ["z", "c", "h"], "left").withColumn("later", F.coalesce(place > F.col("first"), F.lit(False)))
    blocks = marked.repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS).select(*_KEYS, "initial", "fault", "later").mapInArrow(_cut, f"z boolean, c long, turn long, h long, seq long, {_BLOCK_COLUMNS}")
    blocks = keep(blocks, "repair-blocks")
    signatures = blocks.groupBy("inner", "sig").agg(F.count("*").alias("n")).select("inner", "sig")
    answers = keep(signatures.repartitionByRange("inner", "sig").sortWithinPartitions("inner", "sig").mapInArrow(_solve, f"inner boolean, sig string, answers {_ANSWERS}"), "repair-answers")
    solved = blocks.join(answers, ["inner", "sig"])
    held = [x.split()[0] for x in _BLOCK_COLUMNS.split(", ") if x.split()[0] not in ("inner", "sig")]
    none = F.lit(None).cast("string")
    one = solved.select(*_KEYS, "seq", F.lit(1).alias("tag"), none.alias("role"), none.alias("text"), F.struct(*held, "answers").alias("block"))
    two = keyed.select(*_KEYS, F.lit(0).cast("long").alias("seq"), F.when(F.col("gone"), 3).otherwise(2).alias("tag"), F.when(~F.col("gone"), F.col("role")).alias("role"), F.when(~F.col("gone"), F.col("text")).alias("text"), F.lit(None).alias("block"))
    both = one.unionByName(two.withColumn("block", F.col("block").cast(one.schema["block"].dataType)))
    order = ["z", "c", "tag", "turn", "h", "seq"]
    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in _RESULT)
    return both.repartition("z", "c").sortWithinPartitions(*order).select("z", "c", "tag", "role", "text", "block").mapInArrow(_finish, schema)


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _sql_moves() -> str:
    """Rows (q, letter, q2, cost, edits, put, edit, role) of every best move, ``put`` the inserted lines."""
    out = []
    for letter, by_state in MOVES.items():
        for state, moves in enumerate(by_state):
            for after, cost, edits in moves:
                at, put = state, ""
                for _ in edits[:-1]:
                    at, role = TURN[at]
                    put += f"{role}:\n"
                out.append(f"({state}, '{letter}', {after}, {cost}, '{edits}', '{put}', '{edits[-1]}', '{TURN[at][1]}')")
    return ", ".join(out)


#: Unsigned CRC-32 of the ASCII string ``{0}``; 3988292384 is the reflected polynomial.
_CRC32 = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split({0}, ''), lambda x: ascii(x)::UBIGINT)),
  lambda c, b: xor(c >> 8, list_reduce(list_concat([xor(c, b) & 255], list_transform(range(8), lambda k: k::UBIGINT)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))), 4294967295)"""
_END_LINES = {SYSTEM: "user:\nassistant:\n", USER: "assistant:\n"}

OP12_SQL = f"""
WITH RECURSIVE p AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
k AS MATERIALIZED (SELECT *, {_CRC32.format('key')} % 20 AS kind FROM p),
d AS MATERIALIZED (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS twin FROM k WHERE kind <> 0),
o AS MATERIALIZED (SELECT *, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, twin) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, twin) AS seen FROM d),
f AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 'x' WHEN seen > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS l, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM o),
e AS MATERIALIZED (SELECT *, CASE WHEN fault IN ('x', 'd') THEN 'x' WHEN fault = 't' THEN upper(l) ELSE l END AS letter FROM f),
t(q, letter, q2, cost, edits, put, edit, new) AS (VALUES {_sql_moves()}),
w(conv_id, i, q, b) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': '', 'said': ''}} FROM e
  UNION ALL
  SELECT conv_id, i, q, min(b) FROM (
    SELECT w.conv_id, e.i, t.q2 AS q, {{'cost': (w.b).cost + t.cost, 'audit': (w.b).audit || t.edits,
      'said': (w.b).said || t.put || CASE t.edit WHEN 'K' THEN e.role || ':' || e.text || chr(10) WHEN 'R' THEN t.new || ':' || e.text || chr(10) ELSE '' END}} AS b
    FROM w JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 JOIN t ON t.q = w.q AND t.letter = e.letter) GROUP BY conv_id, i, q),
s AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE fault = 'x') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
  count(*) FILTER (WHERE prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM e GROUP BY conv_id),
z AS (SELECT s.conv_id, min({{'cost': (b).cost + CASE q WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'audit': (b).audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
  'said': (b).said || CASE q WHEN 1 THEN '{_END_LINES[SYSTEM]}' WHEN 2 THEN '{_END_LINES[USER]}' ELSE '' END}}) AS b
  FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i GROUP BY s.conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce((b).cost, 0) AS BIGINT) AS cost, coalesce((b).audit, '') AS audit, sha256(CASE WHEN b IS NULL OR (b).said = '' THEN '' ELSE left((b).said, length((b).said) - 1) END) AS repaired_sha256, coalesce(n, 0) AS n_rows
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
"""
