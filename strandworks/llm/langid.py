"""Operator 7, language identification by a byte convolutional network.

Bytes are folded to about 160 classes (case of A-Z folded, digits, other ASCII
and white space each one class, every byte from 0x80 on its own). A text is cut
into windows of WINDOW bytes that cover all of it. Class embeddings pass through
filters of several widths, the maximum over the window is taken, and a softmax
layer gives language probabilities; a text's are the mean log-probabilities of
its windows, weighted by their letters. The network is trained in numpy (Adam) on
a bounded sample of labelled rows: at most SAMPLE_ROWS documents, spread evenly
over the languages by a hash of doc_id and text.

For inference, embedding and filters are multiplied out into lookup tables for
pairs of classes, so a filter of width 4 is two table rows added.

Edge cases: a null text, or one without any letter, is ``und`` with score 0; very
long texts are many windows; equal texts get equal results; with no labelled row
to learn from, every text is ``und``; an empty table gives an empty result. Only
doc_id, text and, for training, lang are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytegrid import chunks, text_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
SAMPLE_ROWS = 6_000
SAMPLE_WINDOWS = 24_000
EPOCHS = 5
SEED = 7
HELD_OUT_MOD = 5

# Classes: a-z 0-25, white space 26, digits 27, other ASCII 28, bytes 0x80-0xFF 29-156.
CLASSES = 29 + 128
_FOLD = np.full(256, 28, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = np.arange(26)
_FOLD[[0x20, *range(0x09, 0x0E)]] = 26
_FOLD[ord("0") : ord("9") + 1] = 27
_FOLD[128:] = 29 + np.arange(128)
_LETTERISH = np.array([*[1] * 26, 0, 0, 0, *[1] * 128], np.float32)
_AT_ONCE = 512
_TEXTS_AT_ONCE = 200


def text_windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class windows (n, WINDOW) of all texts, the last of each padded with white space, and each window's text."""
    sizes = np.diff(off)
    n = -(-sizes // WINDOW)
    first = np.append(0, np.cumsum(n))
    flat = np.full(first[-1] * WINDOW, 26, np.uint8)
    flat[np.arange(len(data)) + np.repeat(first[:-1] * WINDOW - off[:-1], sizes)] = _FOLD[data]
    return flat.reshape(-1, WINDOW), np.repeat(np.arange(len(n)), n)


@dataclass
class ByteNet:
    """Weights: embedding (CLASSES, EMBED), filters by width (w, EMBED, FILTERS), dense layer."""

    labels: list[str]
    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width, one table for each pair of neighbouring classes (or a last single one)."""
        out = {}
        for w, f in self.filters.items():
            each = [(self.embed @ f[j]).astype(np.float32) for j in range(w)]
            out[w] = [(each[j][:, None] + each[j + 1][None, :]).reshape(-1, f.shape[2]) if j + 1 < w else each[j] for j in range(0, w, 2)]
        return out

    def pooled(self, windows: np.ndarray, tables: dict[int, list[np.ndarray]], where: bool = False):
        """Maximum of each filter over each window, before the ReLU; with ``where`` also its position."""
        pair = windows[:, :-1].astype(np.int32) * CLASSES + windows[:, 1:]
        best, at = [], []
        for w, parts in tables.items():
            span = WINDOW - w + 1
            conv = parts[0].take(pair[:, :span], axis=0)
            for j, table in enumerate(parts[1:], 1):
                last_single = 2 * j + 1 == w
                conv += table.take(windows[:, 2 * j : 2 * j + span] if last_single else pair[:, 2 * j : 2 * j + span], axis=0)
            if where:
                at.append(conv.argmax(1))
            best.append(conv.max(1) + self.bias[w])
        return (best, at) if where else np.concatenate(best, 1)

    def log_probs(self, windows: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        out = np.empty((len(windows), len(self.labels)))
        for i in range(0, len(windows), _AT_ONCE):
            logits = np.maximum(self.pooled(windows[i : i + _AT_ONCE], tables), 0) @ self.dense + self.dense_bias
            logits -= logits.max(1, keepdims=True)
            out[i : i + _AT_ONCE] = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return out


class Adam:
    """Adam over a list of arrays, in place."""

    def __init__(self, params: list[np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = ([np.zeros_like(p) for p in params] for _ in range(2))

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def train(texts: list[str], langs: list[str], seed: int = SEED, epochs: int = EPOCHS) -> ByteNet:
    """Fit a network on whole texts cut into windows (at most SAMPLE_WINDOWS of them, drawn evenly)."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    pieces = []
    for i in range(0, len(texts), _TEXTS_AT_ONCE):
        some, text = text_windows(*text_bytes(pa.array(texts[i : i + _TEXTS_AT_ONCE], pa.string())))
        wordy = _LETTERISH[some].sum(1) >= 16
        pieces.append((some[wordy], np.array([labels.index(v) for v in langs[i : i + _TEXTS_AT_ONCE]])[text[wordy]]))
    x, y = (np.concatenate([p[k] for p in pieces]) for k in range(2))
    pick = rng.permutation(len(x))[:SAMPLE_WINDOWS]
    x, y = x[pick], y[pick]
    net = ByteNet(
        labels, rng.normal(0, 0.3, (CLASSES, EMBED)),
        {w: rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS},
        {w: np.zeros(FILTERS) for w in WIDTHS}, rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(labels))), np.zeros(len(labels)),
    )
    params = [net.embed, *net.filters.values(), *net.bias.values(), net.dense, net.dense_bias]
    opt, size = Adam(params, 0.01), 64
    for epoch in range(epochs):
        opt.rate = 0.01 * 0.5**epoch
        turn = rng.permutation(len(x))
        for i in range(0, len(x), size):
            xb, yb = x[turn[i : i + size]], y[turn[i : i + size]]
            n, rows = len(xb), np.arange(len(xb))
            best, at = net.pooled(xb, net.tables(), where=True)
            z = np.concatenate(best, 1)
            a = np.maximum(z, 0)
            logits = a @ net.dense + net.dense_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[rows, yb] -= 1
            p /= n
            da = (p @ net.dense.T) * (z > 0)
            g_embed, g_filters, g_bias = np.zeros_like(net.embed), [], []
            for k, w in enumerate(WIDTHS):
                d = da[:, k * FILTERS : (k + 1) * FILTERS]
                seen = xb[rows[:, None, None], at[k][:, :, None] + np.arange(w)]  # (n, FILTERS, w)
                e = net.embed[seen]
                g_filters.append(np.einsum("nf,nfwe->wef", d, e))
                np.add.at(g_embed, seen, d[:, :, None, None] * net.filters[w].transpose(2, 0, 1)[None])
                g_bias.append(d.sum(0))
            opt.step([g_embed, *g_filters, *g_bias, a.T @ p, p.sum(0)])
    return net


def _has_letter(data: np.ndarray, off: np.ndarray, arr: pa.Array) -> np.ndarray:
    ascii_letter = _FOLD[data] < 26
    has = np.diff(np.append(0, np.cumsum(ascii_letter))[off]) > 0
    for i in np.flatnonzero(~has & (np.diff(off) > 0)):
        has[i] = any(c.isalpha() for c in arr[int(i)].as_py())
    return has


def text_log_probs(net: ByteNet, tables, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Log-probabilities of each text, from the mean over its windows."""
    windows, text = text_windows(data, off)
    weight = _LETTERISH[windows].sum(1).astype(np.float64) + 1e-6
    scores = net.log_probs(windows, tables)
    sums = np.stack([np.bincount(text, weight * scores[:, c], len(off) - 1) for c in range(scores.shape[1])], 1)
    mean = sums / np.maximum(np.bincount(text, weight, len(off) - 1), 1e-9)[:, None]
    mean -= mean.max(1, keepdims=True)
    return mean - np.log(np.exp(mean).sum(1, keepdims=True))


def bucket_of(mod: int, ident: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo ``mod``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary")) % mod


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame | None:
    """``text, lang`` of about ``rows`` rows, as many of each language as there are, in one part by hash order; None without a label.

    The driver gets the number of rows of each language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()}
    if not counts:
        return None
    each = max(1, rows // len(counts))
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*(F.lit(x) for k, v in counts.items() for x in (k, min(1.0, each / v))))
    return known.where(draw < share[F.col("lang")]).orderBy(draw).limit(rows).select("text", "lang")


def predict(docs: DataFrame, net: ByteNet | None, *carry: str) -> DataFrame:
    """``(*carry, lang_pred, score)`` for each row; ``carry`` names columns that go along unread."""
    names = list(carry)
    fields = [f for f in docs.schema.fields if f.name in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted(fields, key=lambda f: names.index(f.name))), "lang_pred string", "score double"])
    blank = net is None or not net.labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None if blank else net.tables()
        for batch in batches:
            for part in chunks(batch, "_text"):
                data, off = text_bytes(part.column("_text"))
                if blank or len(data) == 0:
                    pred, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                else:
                    has = _has_letter(data, off, part.column("_text"))
                    logp = text_log_probs(net, tables, data, off)
                    best = logp.argmax(1)
                    pred = [net.labels[b] if h else "und" for b, h in zip(best, has)]
                    score = np.where(has, np.exp(logp[np.arange(len(best)), best]), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return docs.select(*names, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def fit(docs: DataFrame) -> ByteNet | None:
    """Train on the labelled rows that are not held out, in a task: the driver, whose memory is the narrowest, gets the weights."""
    sample = labelled_sample(docs.where(bucket_of(HELD_OUT_MOD) != 0))
    if sample is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, v) for b in batches for t, v in zip(b.column("text").to_pylist(), b.column("lang").to_pylist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(*map(list, zip(*rows))))], pa.binary())], ["net"])

    made = sample.mapInArrow(run, "net binary").collect()
    return pickle.loads(made[0].net) if made else None


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.withColumn("held_out", bucket_of(HELD_OUT_MOD) == 0)
    return predict(rows, fit(docs), "doc_id", "held_out")
