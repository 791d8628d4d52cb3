"""Operator 8, toxicity by a convolutional text classifier over hashed words.

A word (ASCII letters lower-cased, edge punctuation cut) is the sum of three
hashed embeddings: the whole word, its first four and its first six bytes, so
inflected forms share features. Filters of several widths run over the whole
text, the maximum of each is taken, and a logistic layer gives a raw probability.

Training, in numpy, takes at most SAMPLE_ROWS labelled documents, half of them
toxic as far as there are so many, drawn by a hash. Calibration takes every
labelled row that is not held out, once: rows of the sample with the raw value of
a network trained on the other half of the sample, all others with the raw value
of the network itself. Their counts by language, label and bin of the raw value,
so at the true class shares, give the raw threshold of best F1 of each language
(with the threshold of all languages as a prior for small groups). At scoring
time the language of a text is what the network of ``langid`` reads from the
text; the language's threshold is moved to 0.7 by a piecewise linear map, so
``score >= 0.7`` is the calibrated decision in every language.

Edge cases: null and empty texts have the score of a text without features; very
long texts are scored whole; equal texts get equal scores; if only one class or
no labelled row is there, every score is 0; an empty table gives an empty result.
Repeated label rows of a document count as toxic if one of them is. Only doc_id,
text, and for training the labels and languages, are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import langid, scratch
from .bytegrid import chunks, lanes64, split_words, text_bytes, xxh64
from .langid import Adam, bucket_of

BUCKETS = 1 << 15
EMBED = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (4, 6)
SAMPLE_ROWS = 6_000
EPOCHS = 6
MIN_STEPS = 600  # small samples are passed over more often
SEED = 11
HELD_OUT = (3, 1)  # crc32(doc_id) mod 3 = 1
DECISION = 0.7
FOLDS = 2
BINS = 4096  # of the raw value, for thresholds
_TEXTS_AT_ONCE = 200

_EDGE = np.zeros(256, bool)
_EDGE[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def word_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets (n words, 1 + len(PREFIXES)) and each text's first word (n texts + 1)."""
    words = split_words(data, off, lower=True)
    start, length = words.start.copy(), words.length.copy()
    for _ in range(3):  # up to three punctuation marks at either edge
        front = (length > 1) & _EDGE[words.norm[start]]
        start[front] += 1
        length[front] -= 1
        back = (length > 1) & _EDGE[words.norm[start + length - 1]]
        length[back] -= 1
    lanes = lanes64(words.norm)
    mask = np.uint64(BUCKETS - 1)
    cols = [xxh64(lanes, start, length, 1) & mask]
    cols += [xxh64(lanes, start, np.minimum(length, n), 2 + k) & mask for k, n in enumerate(PREFIXES)]
    return np.stack(cols, 1).astype(np.int32), words.first


def features_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`word_features` of a list of texts, some of them at a time."""
    parts = [word_features(*text_bytes(pa.array(texts[i : i + _TEXTS_AT_ONCE], pa.string()))) for i in range(0, len(texts), _TEXTS_AT_ONCE)]
    feats = np.concatenate([f for f, _ in parts])
    return feats, np.append(0, np.cumsum(np.concatenate([np.diff(first) for _, first in parts])))


@dataclass
class WordNet:
    """Weights: an embedding for each kind of feature, filters by width, logistic layer, thresholds."""

    embed: list[np.ndarray]
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray
    threshold: float = 0.5
    by_language: dict[str, float] = field(default_factory=dict)

    def embedded(self, feats: np.ndarray) -> np.ndarray:
        e = self.embed[0].take(feats[:, 0], axis=0)
        for k in range(1, feats.shape[1]):
            e += self.embed[k].take(feats[:, k], axis=0)
        return e

    def pooled(self, feats: np.ndarray, first: np.ndarray, where: bool = False):
        """Maximum of each filter over each text (0 for texts too short), with ``where`` the word it starts at."""
        n = len(first) - 1
        out, at = [], []
        e = self.embedded(feats)
        sizes = np.diff(first)
        for w, f in self.filters.items():
            best, pos = np.full((n, FILTERS), -1.0), np.full((n, FILTERS), -1)
            some = np.flatnonzero(sizes >= w)
            if len(some):
                begin, end = first[:-1][some], first[1:][some] - w + 1  # starts of runs that lie in the text
                conv = sum(e[j : j + len(e) - w + 1] @ f[j].astype(e.dtype) for j in range(w))
                cuts = np.stack([begin, end], 1).ravel()  # every second segment is what lies between two texts
                best[some] = np.maximum.reduceat(conv, cuts[:-1] if end[-1] == len(conv) else cuts, axis=0)[::2] + self.bias[w]
                if where:
                    for t, a, b in zip(some, begin, end):
                        pos[t] = a + conv[a:b].argmax(0)
            out.append(best)
            at.append(pos)
        return (out, at) if where else np.concatenate(out, 1)

    def raw(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        logits = np.maximum(self.pooled(feats, first), 0) @ self.dense + self.dense_bias
        return 1 / (1 + np.exp(-logits))

    def calibrated(self, raw: np.ndarray, langs: list[str]) -> np.ndarray:
        t = np.array([self.by_language.get(v, self.threshold) for v in langs])
        return np.where(raw < t, DECISION * raw / t, DECISION + (1 - DECISION) * (raw - t) / (1 - t))


def train(texts: list[str], toxic: list[int], seed: int = SEED, epochs: int = EPOCHS) -> WordNet:
    rng = np.random.default_rng(seed)
    feats, first = features_of(texts)
    y = np.array(toxic, np.float64)
    net = WordNet(
        [rng.normal(0, 0.05, (BUCKETS, EMBED)).astype(np.float32) for _ in range(1 + len(PREFIXES))],
        {w: rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
        np.abs(rng.normal(0.3, 0.1, FILTERS * len(WIDTHS))).astype(np.float32) * np.where(np.arange(FILTERS * len(WIDTHS)) % 4 == 3, -1, 1), np.zeros(1, np.float32),
    )
    net.dense = net.dense.astype(np.float32)
    params = [*net.embed, *net.filters.values(), *net.bias.values(), net.dense, net.dense_bias]
    opt, size = Adam(params, 0.01), 32
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    epochs = max(epochs, -(-MIN_STEPS * size // max(1, len(y))))
    for epoch in range(epochs):
        opt.rate = 0.01 * 0.12 ** (epoch / epochs)
        turn = rng.permutation(len(y))
        for i in range(0, len(y), size):
            pick = turn[i : i + size]
            spans = [np.arange(first[t], first[t + 1]) for t in pick]
            fb = feats[np.concatenate(spans)]
            at0 = np.append(0, np.cumsum([len(s) for s in spans]))
            best, at = net.pooled(fb, at0, where=True)
            z = np.concatenate(best, 1)
            a = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-(a @ net.dense + net.dense_bias)))
            d = ((p - y[pick]) * weight[pick] / len(pick))[:, None]
            da = d * net.dense[None, :] * (z > 0)
            g_embed = [np.zeros_like(e) for e in net.embed]
            g_filters, g_bias = [], []
            e = net.embedded(fb)
            for k, w in enumerate(WIDTHS):
                dk = da[:, k * FILTERS : (k + 1) * FILTERS]
                pos = np.maximum(at[k], 0)[:, :, None] + np.arange(w)
                pos = np.minimum(pos, len(fb) - 1)
                g_filters.append(np.einsum("nf,nfwe->wef", dk, e[pos]).astype(np.float32))
                ge = dk[:, :, None, None] * net.filters[w].transpose(2, 0, 1)[None]
                for g, col in zip(g_embed, fb.T):
                    np.add.at(g, col[pos], ge)
                g_bias.append(dk.sum(0).astype(np.float32))
            opt.step([*g_embed, *g_filters, *g_bias, (a.T @ d[:, 0]).astype(np.float32) + 1e-4 * net.dense, d.sum(0).astype(np.float32)])
    return net


def best_threshold(counts: np.ndarray) -> float:
    """The raw value between two filled bins of a histogram (clean and toxic, BINS) at which F1 is best; of a tie the lowest."""
    full = np.flatnonzero(counts.sum(0))[::-1]
    hit, taken = np.cumsum(counts[1, full]), np.cumsum(counts.sum(0)[full])
    f1 = 2 * hit / (taken + hit[-1])
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)[-1]
    below = full[top + 1] + 1 if top + 1 < len(full) else 0
    return float(np.clip((full[top] + below) / 2 / BINS, 0.02, 0.98))


def set_thresholds(net: WordNet, cells: list[tuple[str, int, int, int]]) -> None:
    """Thresholds from ``(lang, toxic, bin, rows)``."""
    by_language: dict[str, np.ndarray] = {}
    for lang, toxic, at, rows in cells:
        by_language.setdefault(lang, np.zeros((2, BINS), np.int64))[toxic, at] += rows
    every = sum(by_language.values(), np.zeros((2, BINS), np.int64))
    if every[1].sum() >= 3:
        net.threshold = best_threshold(every)
    for lang, counts in sorted(by_language.items()):
        clean, pos = (int(n) for n in counts.sum(1))
        if pos >= 10 and clean >= 10:
            own, weight = best_threshold(counts), pos / (pos + 20)
            net.by_language[lang] = weight * own + (1 - weight) * net.threshold


def raw_of(net: WordNet, texts: list[str]) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(net.raw(*features_of(texts[i : i + _TEXTS_AT_ONCE])) for i in range(0, len(texts), _TEXTS_AT_ONCE))])


def calibrate(net: WordNet, texts: list[str], toxic: list[int], langs: list[str]) -> None:
    """Thresholds from labelled texts that the network has not seen."""
    bins = np.minimum(raw_of(net, texts) * BINS, BINS - 1).astype(int)
    set_thresholds(net, [(lang, int(y), int(at), 1) for lang, y, at in zip(langs, toxic, bins)])


def known_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, toxic)`` of the labelled documents that are not held out."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.where(bucket_of(HELD_OUT[0]) != HELD_OUT[1])


def text_key():
    """A hash of the text; null for a null one."""
    return F.when(F.col("text").isNotNull(), F.xxhash64(F.col("text").cast("string")))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list:
    """About ``rows`` labelled ``(text, toxic, doc_id, key)``, half of them toxic if there are so many; bounded by ``rows``."""
    known = known_labels(labels)
    counts = {int(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect() if r["toxic"] in (0, 1)}
    if len(counts) < 2:
        return []
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.when(F.col("toxic") == 1, min(1.0, rows / 2 / counts[1])).otherwise(min(1.0, rows / 2 / counts[0]))
    drawn = F.broadcast(known.withColumn("draw", draw).where(F.col("draw") < share).orderBy("draw", "doc_id").limit(2 * rows))  # three numbers a row, of bounded count
    got = docs.select("doc_id", F.col("text").cast("string").alias("text"), text_key().alias("key")).where("text IS NOT NULL AND doc_id IS NOT NULL").join(drawn, "doc_id")
    got = got.orderBy("draw", "doc_id", "key").limit(2 * rows)  # ordered: repeated ids give the same sample each time
    return sorted(got.select("text", "toxic", "doc_id", "key").collect(), key=lambda r: (r.doc_id, r.text))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[WordNet | None, list]:
    """The network of the training sample, and ``(doc_id, key, own)`` of its rows.

    ``own`` is the raw value by a network trained on the folds that the text is not
    in; -1 where those folds lack a class. Equal texts are in one fold.
    """
    got = labelled_sample(docs, labels, rows)
    if len({r.toxic for r in got}) < 2:
        return None, []
    texts, toxic = [r.text for r in got], [int(r.toxic) for r in got]
    fold: dict[str, int] = {}
    for y in (0, 1):
        for i, t in enumerate(dict.fromkeys(t for t, v in zip(texts, toxic) if v == y and t not in fold)):
            fold[t] = i % FOLDS
    of = np.array([fold[t] for t in texts])
    own = np.full(len(got), -1.0)
    for k in range(FOLDS):
        inside, outside = np.flatnonzero(of != k), np.flatnonzero(of == k)
        if len(outside) and len({toxic[i] for i in inside}) == 2:
            own[outside] = raw_of(train([texts[i] for i in inside], [toxic[i] for i in inside]), [texts[i] for i in outside])
    return train(texts, toxic), list({(r.doc_id, r.key): (r.doc_id, r.key, float(v)) for r, v in zip(got, own)}.values())


def calibration_cells(raws: DataFrame, labels: DataFrame, sampled: list) -> DataFrame:
    """``(lang, toxic, bin, rows)`` over all labelled rows of ``raws`` (doc_id, key, lang, raw) that are not held out.

    Only numbers and languages are shuffled; the sample's rows are broadcast.
    """
    own = raws.sparkSession.createDataFrame(sampled, "doc_id long, key long, own double")
    known = known_labels(labels).where("toxic IN (0, 1)")
    rows = raws.where("key IS NOT NULL").select("doc_id", "key", "raw", F.coalesce("lang", F.lit("")).alias("lang")).join(known, "doc_id")
    rows = rows.join(F.broadcast(own), ["doc_id", "key"], "left").withColumn("raw", F.coalesce("own", "raw")).where("raw >= 0")
    return rows.groupBy("lang", "toxic", F.least(F.floor(F.col("raw") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("rows"))


def fit(docs: DataFrame, labels: DataFrame) -> WordNet | None:
    """Train on a sample of the labelled rows that are not held out, calibrate on all of them."""
    net, sampled = learn(docs, labels)
    if net is not None:
        raws = raw_scores(docs.where(bucket_of(HELD_OUT[0]) != HELD_OUT[1]).withColumn("key", text_key()), net, None, "doc_id", "key", "lang")
        set_thresholds(net, [tuple(r) for r in calibration_cells(raws, labels, sampled).collect()])
    return net


def raw_scores(docs: DataFrame, net: WordNet, languages: langid.ByteNet | None, *carry: str) -> DataFrame:
    """``(*carry, raw, lang_read)`` for each row: the raw value and the language that ``languages`` reads from the text."""
    names = list(carry)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "raw double", "lang_read string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = languages.tables() if languages is not None else None
        for batch in batches:
            for part in chunks(batch, "_text"):
                data, off = text_bytes(part.column("_text"))
                raw = np.round(np.asarray(net.raw(*word_features(data, off)), np.float64), 6)  # as far as the order of sums has no part in it
                if tables is None or not len(data):
                    langs = [""] * part.num_rows
                else:
                    langs = [languages.labels[k] for k in langid.text_log_probs(languages, tables, data, off).argmax(1)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(raw, pa.float64()), pa.array(langs, pa.string())], [*names, "raw", "lang_read"])

    return docs.select(*names, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def decided(raws: DataFrame, net: WordNet | None, *carry: str) -> DataFrame:
    """``(*carry, score, predicted)`` of :func:`raw_scores`; without a network every score is 0."""
    if net is None:
        return raws.select(*carry, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    t = F.lit(net.threshold)
    if net.by_language:
        t = F.coalesce(F.create_map(*(F.lit(x) for pair in sorted(net.by_language.items()) for x in pair))[F.col("lang_read")], t)
    raw = F.col("raw")
    score = F.when(raw < t, DECISION * raw / t).otherwise(DECISION + (1 - DECISION) * (raw - t) / (1 - t))
    rows = raws.select(*carry, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= DECISION).cast("int"))


def score(docs: DataFrame, net: WordNet | None, languages: langid.ByteNet | None, *carry: str) -> DataFrame:
    """``(*carry, score, predicted)`` for each row; ``carry`` names columns that go along unread."""
    return decided(docs if net is None else raw_scores(docs, net, languages, *carry), net, *carry)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.withColumn("held_out", bucket_of(HELD_OUT[0]) == HELD_OUT[1]).withColumn("key", text_key())
    net, sampled = learn(docs, labels)
    if net is None:
        return decided(rows, None, "doc_id", "held_out")
    # The language network of operator 7; it learns from lang alone, on rows held in by this operator's rule too.
    languages = langid.fit(docs.where(bucket_of(HELD_OUT[0]) != HELD_OUT[1]))
    # Every text is scored once; thresholds and decisions read the numbers.
    raws = scratch.keep(raw_scores(rows, net, languages, "doc_id", "held_out", "key", "lang"), "toxicity")
    set_thresholds(net, [tuple(r) for r in calibration_cells(raws, labels, sampled).collect()])
    return decided(raws, net, "doc_id", "held_out")
