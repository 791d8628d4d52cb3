"""Operator 11, quality rules with risk-controlled thresholds.

Each document is measured: symbols, capitals, repeated lines, repeated 8-word windows,
long or short words. A document that fails the base rule goes. The others go if a
measure reaches a cutoff, and the cutoffs are chosen so that few good documents are
lost in any stratum (a language):

1. Labelled documents (``quality`` 1 or 0) that pass the base rule are cut in halves by
   the digest of their text, each text once, so that copies neither weigh more nor
   stand in both halves.
2. The first half ranks the rules. The tail of a rule from a bin on has the odds of
   bad to good documents in it, ``(2 bad + 1) / (2 good + 1)``; a document's rank is the
   best odds of all tails it is in. So each odds value is one cutoff for every rule.
3. The second half, which the ranking has not seen, tests the values in order, greatest
   first, in each stratum: a value holds if the exact binomial tail says that a false
   rejection rate over ``ALPHA`` would give so few rejected good documents with a
   probability of at most ``DELTA`` divided by the number of strata. The first value
   that does not hold ends the sequence. So with confidence 1 - DELTA no stratum loses
   more than ALPHA of its good documents: values of one stratum are tested in a fixed
   order, which needs no correction, strata by Bonferroni's.

Only values of odds from ``LEAST_ODDS`` on are tried. A stratum with too few good
documents to hold any value, were none of them lost, has no cutoffs, and loses
nothing beyond the base rule.

The driver gets counts by (rule, bin, label) and by (stratum, value, label), strata of
enough good documents only: the first is a table of fixed size, the second has at most
RULES x BINS rows for every so many labelled texts (59 at these settings).

Edge cases: a null text has no words; a null lang is a stratum; labels without quality
are left out, of several labels of one document or text the worst counts; documents
with a null doc_id have no label; rows repeat as they are; an empty table of documents
or labels gives no cutoffs. A text longer than a megabyte is a numpy batch of its own,
in memory in proportion to it. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytegrid import P1, chunks, lanes64, split_words, splitmix, text_bytes, xxh64
from .scratch import keep

ALPHA, DELTA = 0.05, 0.05
LEAST_ODDS = 4.0
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters"]
BINS = 128
_SYMBOL, _CAPITAL, _LETTER = (np.zeros(256, np.int64) for _ in range(3))
_SYMBOL[list(b"#*$%&|<>")] = 1
_CAPITAL[ord("A") : ord("Z") + 1] = 1
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = 1

#: Bins of a document by rule, in SQL: a greater bin is worse. For documents with words.
RULES = {
    "symbols": "least(127, (20 * n_symbols) div n_words)",
    "capitals": "(100 * n_capitals) div greatest(n_letters, 1)",
    "dup_lines": "(100 * n_dup_lines) div greatest(n_lines, 1)",
    "repeats": "(100 * n_repeat_words) div n_words",
    "long_words": "least(127, (10 * word_chars) div n_words)",
    "short_words": "127 - least(127, (10 * word_chars) div n_words)",
}


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """:data:`MEASURES` of each text."""
    data, off = text_bytes(texts)
    n = len(off) - 1

    def by_text(values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[off[1:]] - total[off[:-1]]

    words = split_words(data, off)
    inside = np.zeros(len(words.norm) + 1, np.int64)
    np.cumsum((words.norm & 0xC0) != 0x80, out=inside[1:])
    ends = np.append(words.start, len(words.norm))  # of norm: each word is followed by a space
    chars = inside[ends[words.first[1:]]] - inside[ends[words.first[:-1]]] - words.counts
    lines, dup = _lines(data, off)
    return {
        "n_words": words.counts, "word_chars": chars, "n_symbols": by_text(_SYMBOL[data]), "n_dup_lines": dup, "n_repeat_words": _repeats(words, n),
        "n_lines": lines, "n_capitals": by_text(_CAPITAL[data]), "n_letters": by_text(_LETTER[data]),
    }


def _again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys stand elsewhere too, and which stand earlier too."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    shared, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    shared[order[1:]] = same
    later[order[1:]] = same
    shared[order[:-1]] |= same
    return shared, later


def _lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word of each text, and those equal to an earlier one."""
    n = len(off) - 1
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.concatenate([off[:-1], breaks + 1]))
    of = np.searchsorted(off, begin, side="right") - 1
    # A break that ends a text begins no line of the next; an empty text has its one empty line where the next text begins.
    begin, of = begin[of < n], of[of < n]
    end = np.minimum(np.append(begin[1:], len(data)), off[of + 1])
    end = np.where((end > begin) & (data[np.maximum(end - 1, 0)] == 0x0A), end - 1, end)
    black = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~np.isin(data, [0x20, *range(0x09, 0x0E)]), out=black[1:])
    worded = black[end] > black[begin]
    begin, end, of = begin[worded], end[worded], of[worded]
    with np.errstate(over="ignore"):
        key = xxh64(lanes64(data), begin, end - begin) ^ splitmix(of.astype(np.uint64) * P1)
    _, later = _again(key)
    return np.bincount(of, minlength=n), np.bincount(of, weights=later, minlength=n).astype(np.int64)


def _repeats(words, n: int) -> np.ndarray:
    """Words in windows that stand twice or more in their text, by text."""
    total = int(words.first[-1])
    out = np.zeros(n, np.int64)
    if total < WINDOW:
        return out
    h = splitmix(xxh64(lanes64(words.norm), words.start, words.length))
    of = np.repeat(np.arange(n), words.counts)
    at = np.flatnonzero(of[: total - WINDOW + 1] == of[WINDOW - 1 :])
    key = splitmix(of[at].astype(np.uint64) * P1)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            key = splitmix(key * P1 + h[at + j])
    shared, _ = _again(key)
    cover = np.cumsum(np.bincount(at[shared], minlength=total + 1) - np.bincount(at[shared] + WINDOW, minlength=total + 1))
    return np.bincount(of, weights=cover[:-1] > 0, minlength=n).astype(np.int64)


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id, stratum, digest`` (MD5 of the text) and :data:`MEASURES` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = measure(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "stratum", "digest")), *(pa.array(found[c], pa.int64()) for c in MEASURES)], ["doc_id", "stratum", "digest", *MEASURES])

    text = F.col("text").cast("string")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"), text.alias("text"))
    return picked.mapInArrow(run, f"doc_id long, stratum string, digest string, {', '.join(f'{c} long' for c in MEASURES)}")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _binned(rows: DataFrame) -> DataFrame:
    held = rows.withColumn("n_words", F.greatest("n_words", F.lit(1)))
    return held.select(*(c for c in rows.columns if c not in MEASURES), *(F.expr(f"cast({sql} as int)").alias(rule) for rule, sql in RULES.items()))


def labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """``stratum, digest, good`` and the bins of each labelled text that passes the base rule, once for each stratum."""
    worst = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("good"))
    rows = _binned(found.where(~base_failed())).join(worst, "doc_id")
    return rows.groupBy("stratum", "digest", *RULES).agg((F.min("good") == 1).alias("good"))


def second_half() -> Column:
    """Whether a text tests cutoffs; the others rank the rules."""
    return F.right("digest", F.lit(1)).isin(*"13579bdf")


def odds(counts: list[tuple[str, int, bool, int]]) -> dict[str, list[float]]:
    """Best odds of the tails that hold each bin, by rule; ``counts`` are (rule, bin, good, texts)."""
    held = {rule: np.zeros((2, BINS), np.int64) for rule in RULES}
    for rule, at, good, n in counts:
        held[rule][int(good), at] += n
    out = {}
    for rule, table in held.items():
        good, bad = (np.cumsum(x[::-1])[::-1] for x in (table[1], table[0]))
        out[rule] = np.maximum.accumulate((2 * bad + 1) / (2 * good + 1)).tolist()
    return out


def _rank(ranked: dict[str, list[float]]) -> Column:
    return F.greatest(*(F.element_at(F.array(*map(F.lit, ranked[rule])), F.col(rule) + 1) for rule in RULES))


def binomial_tail(k: int, n: int, rate: float) -> float:
    """Probability of at most k of n at ``rate``; summed from k down until terms no longer count."""
    if k >= n:
        return 1.0
    if k + 1 >= n * rate:  # about half or more: no bound near it is of use, so sum it all
        i = np.arange(k + 1)
        logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i.tolist()]
        return min(1.0, float(np.sum(np.exp(np.array(logs) + i * math.log(rate) + (n - i) * math.log1p(-rate)))))
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate))
    total, i = 0.0, k
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i * (1 - rate) / ((n - i + 1) * rate)
        i -= 1
    return total


def least_good(alpha: float, delta: float) -> int:
    """Good documents without which no cutoff can hold, were none lost."""
    return math.ceil(math.log(delta) / math.log1p(-alpha))


def choose(values: list[float], lost: dict[float, int], n: int, alpha: float, delta: float) -> float | None:
    """The last of ``values`` (descending) before the first that does not hold; ``lost`` are good documents by rank, of n."""
    k, best, ranks = 0, None, sorted(lost, reverse=True)
    for value in values:
        while ranks and ranks[0] >= value:
            k += lost[ranks.pop(0)]
        if k >= n * alpha or binomial_tail(k, n, alpha) > delta:
            break
        best = value
    return best


def calibrate(rows: DataFrame, alpha: float = ALPHA, delta: float = DELTA, least_odds: float = LEAST_ODDS) -> tuple[dict[str, list[float]], DataFrame]:
    """Odds of each rule's bins, and ``stratum, good, cutoff`` of each stratum that has a cutoff."""
    first = rows.where(~second_half())
    stacked = first.select("good", F.expr(f"stack({len(RULES)}, {', '.join(f'{rule!r}, {rule}' for rule in RULES)}) as (rule, bin)"))
    ranked = odds([tuple(r) for r in stacked.groupBy("rule", "bin", "good").agg(F.count("*").alias("n")).collect()])
    values = sorted({v for by_bin in ranked.values() for v in by_bin if v >= least_odds}, reverse=True)
    good = rows.where(second_half() & F.col("good")).select("stratum", _rank(ranked).alias("rank"))
    level = F.when(F.col("rank") >= least_odds, F.col("rank")).otherwise(0.0)
    lost = keep(good.groupBy("stratum", level.alias("rank")).agg(F.count("*").alias("n")), "risk-lost")
    enough = lost.groupBy("stratum").agg(F.sum("n").alias("good")).where(F.col("good") >= least_good(alpha, delta))
    strata = max(1, enough.count())

    def pick(t: pa.Table) -> pa.Table:
        n = sum(t.column("n").to_pylist())
        found = choose(values, {r: c for r, c in zip(t.column("rank").to_pylist(), t.column("n").to_pylist()) if r > 0}, n, alpha, delta / strata)
        return pa.table({"stratum": t.column("stratum").slice(0, 1), "good": pa.array([n], pa.int64()), "cutoff": pa.array([found], pa.float64())})

    return ranked, keep(lost.groupBy("stratum").applyInArrow(pick, "stratum string, good long, cutoff double").where("cutoff is not null"), "risk-cutoffs", 1)


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, least_odds: float = LEAST_ODDS) -> DataFrame:
    """Measures and verdict of each row of ``docs``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, odds, cutoff``: the row goes if its ``odds`` reach its stratum's
    ``cutoff``; null, if the stratum has none.
    """
    found = keep(measures(docs), "risk-measures")
    ranked, cutoffs = calibrate(keep(labelled(found, labels), "risk-labelled"), alpha, delta, least_odds)
    out = _binned(found.withColumns({f"_{c}": F.col(c) for c in MEASURES}).withColumn("base_failed", base_failed())).withColumn("odds", _rank(ranked))
    met = out.join(cutoffs.select(F.col("stratum").alias("_of"), "cutoff"), F.col("stratum").eqNullSafe(F.col("_of")), "left")
    kept = ~F.col("base_failed") & (F.col("cutoff").isNull() | (F.col("odds") < F.col("cutoff")))
    return met.select("doc_id", *(F.col(f"_{c}").alias(c) for c in MEASURES[:5]), "base_failed", kept.alias("kept"), "odds", "cutoff")


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all documents, with cutoffs from the labels."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_SQL_BINS = {rule: sql.replace(" div ", " // ") for rule, sql in RULES.items()}
_RANK = "greatest(" + ", ".join(f"(SELECT max(odds) FROM tails t WHERE t.rule = '{rule}' AND t.bin <= x.{rule})" for rule in RULES) + ")"

OP11_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS MATERIALIZED (SELECT id, line, row_number() OVER (PARTITION BY id, line) AS seen FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lc AS (SELECT id, count(*) AS n_lines, count(*) FILTER (WHERE seen > 1) AS n_dup_lines FROM l GROUP BY id),
g AS (SELECT id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
gr AS MATERIALIZED (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, s) AS n FROM g) WHERE n > 1),
rc AS (SELECT id, count(DISTINCT i + j) AS n_repeat_words FROM gr, unnest(range(8)) u(j) GROUP BY id),
m AS MATERIALIZED (SELECT d.id, doc_id, lang, md5(text) AS digest, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM d LEFT JOIN lc USING (id) LEFT JOIN rc USING (id)),
b AS MATERIALIZED (SELECT id, doc_id, lang, digest, raw AS n_words, base_failed, {', '.join(f'{sql} AS {rule}' for rule, sql in _SQL_BINS.items())}
  FROM (SELECT * EXCLUDE (n_words), n_words AS raw, greatest(n_words, 1) AS n_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)),
y AS MATERIALIZED (SELECT lang, digest, {', '.join(RULES)}, min(good) AS good, right(digest, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS second
  FROM b JOIN (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
st AS (SELECT good, u.* FROM y, unnest([{', '.join(f"{{'rule': '{rule}', 'bin': {rule}}}" for rule in RULES)}]) q(u) WHERE NOT second),
tails AS MATERIALIZED (SELECT k.rule, v.bin, (2 * count(*) FILTER (WHERE st.bin >= v.bin AND good = 0) + 1) / (2 * count(*) FILTER (WHERE st.bin >= v.bin AND good = 1) + 1) AS odds
  FROM unnest([{', '.join(f"'{rule}'" for rule in RULES)}]) k(rule), range({BINS}) v(bin), st WHERE st.rule = k.rule GROUP BY k.rule, v.bin),
vals AS (SELECT DISTINCT max(odds) OVER (PARTITION BY rule ORDER BY bin) AS v FROM tails),
h AS MATERIALIZED (SELECT lang, {_RANK} AS rank FROM y x WHERE second AND good = 1),
n AS (SELECT lang, count(*) AS n FROM h GROUP BY lang),
s AS (SELECT count(*) AS strata FROM n WHERE n >= {least_good(ALPHA, DELTA)}),
k AS (SELECT n.lang, n, v, (SELECT count(*) FROM h WHERE h.lang IS NOT DISTINCT FROM n.lang AND h.rank >= v) AS k FROM n, vals WHERE v >= {LEAST_ODDS}),
p AS MATERIALIZED (SELECT lang, v, k < n * {ALPHA} AND list_sum(list_transform(generate_series(0, k), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) <= {DELTA} / greatest(strata, 1) AS holds FROM k, s),
c AS (SELECT lang, min(v) AS cutoff FROM p WHERE holds AND NOT EXISTS (SELECT 1 FROM p o WHERE o.lang IS NOT DISTINCT FROM p.lang AND o.v > p.v AND NOT o.holds) GROUP BY lang),
r AS (SELECT x.*, {_RANK} AS odds FROM b x)
SELECT r.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, base_failed, NOT base_failed AND (cutoff IS NULL OR odds < cutoff) AS kept, coalesce(odds, 1.0) AS odds, cutoff
FROM r JOIN m USING (id) LEFT JOIN c ON c.lang IS NOT DISTINCT FROM r.lang
"""
