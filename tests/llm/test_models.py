import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandworks.llm import langid, toxicity
from strandworks.llm.bytegrid import text_bytes


def test_convolution_tables_equal_plain_convolution():
    rng = np.random.default_rng(1)
    net = langid.train(["ab cd ef gh " * 40, "xy zw uv st " * 40], ["a", "b"], epochs=1)
    x = rng.integers(0, langid.CLASSES, (3, langid.WINDOW)).astype(np.uint8)
    got = net.pooled(x, net.tables())
    e = net.embed[x]
    want = []
    for w, f in net.filters.items():
        conv = sum(e[:, j : langid.WINDOW - w + 1 + j] @ f[j] for j in range(w))
        want.append(conv.max(1) + net.bias[w])
    assert np.allclose(got, np.concatenate(want, 1), atol=1e-4)


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = {r.doc_id: r for r in langid.op7_language_id(spark, sf.replace("0.001", "0.01")).collect()}
    truth = {r.doc_id: r for r in docs.collect()}
    assert got.keys() == truth.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in truth[i].text or ""):
            assert r.lang_pred == "und"
    held = [i for i, r in got.items() if r.held_out and truth[i].lang]
    assert np.mean([got[i].lang_pred == truth[i].lang for i in held]) > 0.95


def test_language_edges(docs, rows, wide, empty):
    net = langid.fit(docs)
    got = langid.predict(docs, net, "doc_id", "text").collect()
    assert len(got) == len(rows)
    by_text = {}
    for g in got:
        assert by_text.setdefault(g.text, (g.lang_pred, g.score)) == (g.lang_pred, g.score)
        if not any(c.isalpha() for c in g.text or ""):
            assert (g.lang_pred, g.score) == ("und", 0.0)
        else:
            assert g.lang_pred in net.labels
    assert langid.predict(wide, net, *wide.columns[:5]).count() == len(rows)
    assert langid.predict(empty, net, "doc_id").count() == 0
    assert langid.fit(empty) is None
    assert {r.lang_pred for r in langid.predict(docs, None, "doc_id").collect()} == {"und"}


def test_network_is_trained_in_a_task(docs, monkeypatch):
    """The texts of the sample do not go through the driver."""
    monkeypatch.setattr(langid, "train", lambda texts, langs: os.getpid())
    assert langid.fit(docs) not in (None, os.getpid())


def brute_language(net, text):
    """Label and score of one text by plain loops over its bytes, windows and filters."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    kind = lambda b: 29 + b - 128 if b >= 128 else 26 if b in b" \t\n\v\f\r" else 27 if chr(b).isdigit() else ord(chr(b).lower()) - 97 if chr(b).isalpha() else 28
    classes = [kind(b) for b in text.encode()]
    total, mass = np.zeros(len(net.labels)), 0.0
    for i in range(0, len(classes), langid.WINDOW):
        part = classes[i : i + langid.WINDOW]
        window = net.embed[part + [26] * (langid.WINDOW - len(part))]
        pooled = [max(float((window[j : j + w] * f[:, :, c]).sum()) for j in range(langid.WINDOW - w + 1)) + net.bias[w][c] for w, f in net.filters.items() for c in range(langid.FILTERS)]
        logits = np.maximum(pooled, 0) @ net.dense + net.dense_bias
        letters = sum(c < 26 or c > 28 for c in part) + 1e-6
        total += letters * (logits - logits.max() - np.log(np.exp(logits - logits.max()).sum()))
        mass += letters
    p = np.exp(total / mass)
    return net.labels[int(p.argmax())], float(p.max() / p.sum())


def test_language_of_a_text_by_plain_loops(spark):
    net = langid.train(["the cat sat on the mat and ran away " * 30, "der hund und die katze waren im haus " * 30, "le chat et le chien sont dans la maison " * 30] * 4, ["en", "de", "fr"] * 4, epochs=2)
    texts = [None, "", "  \n", "12 + 34", "a", "The cat is 9 years old.", "die Katze war müde " * 31, "é" * 128 + "x", "日本語の文 " * 40, "le chien\tdort\x0bici " * 26, "x" * 256, "y" * 257, "ª½"]
    got = {r.i: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3), net, "i").collect()}
    for i, text in enumerate(texts):
        label, score = brute_language(net, text)
        assert got[i][0] == label and abs(got[i][1] - score) < 1e-4, (text, got[i], label, score)


def test_long_text_is_read_to_its_end():
    net = langid.train(["ab cd ef gh " * 60, "xy zw uv st " * 60] * 20, ["a", "b"] * 20, epochs=8)
    texts = ["ab cd ef gh " * 200 + "xy zw uv st " * 4000, "xy zw uv st " * 200 + "ab cd ef gh " * 4000]
    logp = langid.text_log_probs(net, net.tables(), *text_bytes(pa.array(texts)))
    assert [net.labels[k] for k in logp.argmax(1)] == ["b", "a"]


def make_toxic(n):
    rng = np.random.default_rng(4)
    plain = [f"word{k}" for k in range(300)]
    texts, labels = [], []
    for i in range(n):
        w = list(rng.choice(plain, 80))
        if i % 4 == 0:
            for _ in range(3):
                w[rng.integers(80)] = f"vile{rng.integers(100)}"
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_toxicity_learns_word_forms():
    texts, labels = make_toxic(900)
    net = toxicity.train(texts[:600], labels[:600])
    toxicity.calibrate(net, texts[600:750], labels[600:750], ["x"] * 150)
    raw = net.raw(*toxicity.word_features(*text_bytes(pa.array(texts[750:]))))
    score = net.calibrated(raw, ["x"] * 150)
    assert np.mean((score >= toxicity.DECISION) == np.array(labels[750:])) > 0.95
    assert ((score >= toxicity.DECISION) == (raw >= net.by_language.get("x", net.threshold))).all()


def brute_raw(net, text):
    """Score of one text, run by run."""
    feats = toxicity.word_features(*text_bytes(pa.array([text])))[0]
    e = np.stack([sum(net.embed[k][b].astype(float) for k, b in enumerate(f)) for f in feats]) if len(feats) else np.zeros((0, toxicity.EMBED))
    z = []
    for w, f in net.filters.items():
        runs = [sum(e[i + j] @ f[j] for j in range(w)) for i in range(len(e) - w + 1)]
        z.append(np.max(runs, 0) + net.bias[w] if runs else np.full(toxicity.FILTERS, -1.0))
    return 1 / (1 + np.exp(-(np.maximum(np.concatenate(z), 0) @ net.dense + net.dense_bias[0])))


@pytest.mark.parametrize("seed", range(5))
def test_pooling_stays_within_texts(seed):
    """Short texts behind long ones, in any order, as by a convolution over each text alone."""
    texts, labels = make_toxic(40)
    net = toxicity.train(texts, labels, epochs=1, seed=seed)
    rng = np.random.default_rng(seed)
    net.dense = rng.normal(0, 1, len(net.dense)).astype(np.float32)
    net.filters = {w: rng.normal(0, 3, f.shape).astype(np.float32) for w, f in net.filters.items()}
    some = ["the quick brown fox", "x", "y", "z", *texts[:8], "one two", "", "", "a b c", "q", "the quick brown fox"]
    some = [some[i] for i in rng.permutation(len(some))]
    together = net.raw(*toxicity.word_features(*text_bytes(pa.array(some))))
    assert np.allclose(together, [brute_raw(net, t) for t in some], atol=1e-5)


def test_toxicity_of_held_out_documents(spark, sf):
    """Labels of documents that no fit has seen, against each label's own rate."""
    big = sf.replace("0.001", "0.1")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    got = [(truth[r.doc_id], r.predicted, r.score) for r in toxicity.op8_toxicity(spark, big).where("held_out").collect() if truth.get(r.doc_id) is not None]
    toxic, clean = ([p for y, p, _ in got if y == v] for v in (1, 0))
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.05


def test_toxicity_table(spark, sf):
    big = sf.replace("0.001", "0.01")
    got = toxicity.op8_toxicity(spark, big).collect()
    assert len(got) == spark.read.parquet(f"{big}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_toxicity_edges(spark, docs, rows, wide, empty):
    labels = spark.createDataFrame([(r[0], 1, int(i % 2)) for i, r in enumerate(rows)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    net = toxicity.fit(docs, labels)
    assert toxicity.score(docs, net, None, "doc_id").count() == len(rows)
    assert toxicity.score(wide, net, langid.fit(docs), "doc_id", "score_" if "score_" in wide.columns else "source").count() == len(rows)
    assert toxicity.fit(docs, labels.limit(0)) is None and toxicity.fit(empty, labels) is None
    assert {r.score for r in toxicity.score(docs, None, None, "doc_id").collect()} == {0.0}
    assert toxicity.score(empty, net, None, "doc_id").count() == 0


def test_toxicity_thresholds_cover_all_labelled_rows(spark, monkeypatch):
    """Every held-in labelled row counts once, and a language of few labels has its own threshold."""
    monkeypatch.setattr(toxicity, "MIN_STEPS", 60)
    texts, _ = make_toxic(800)
    rows = [(i, t, ("en", "de", "fr")[i % 3 if i % 10 < 5 else 0]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)], "doc_id long, toxic int")
    held_in = [i for i in range(800) if zlib.crc32(str(i).encode()) % 3 != 1]
    want = Counter((rows[i][2], int(i % 4 == 0)) for i in held_in)
    assert min(want[v, 1] for v in ("de", "fr")) >= 10 > max(want[v, 1] for v in ("de", "fr")) // 5
    net = toxicity.fit(docs, labels)
    assert set(net.by_language) == {"en", "de", "fr"}
    net, sampled = toxicity.learn(docs, labels, rows=100)
    assert len(sampled) < 200
    raws = toxicity.raw_scores(docs.withColumn("key", toxicity.text_key()), net, None, "doc_id", "key", "lang")
    got = Counter()
    for r in toxicity.calibration_cells(raws, labels, sampled).collect():
        got[r.lang, r.toxic] += r.rows
    assert got == want
