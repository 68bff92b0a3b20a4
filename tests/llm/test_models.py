"""The two trained models: gradients, updates, held-out accuracy, awkward rows."""

import numpy as np
from cases import FOLDER, docs, empty
from pyspark.sql import functions as F

from docledger.llm import language, quality, queries


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"], 3, 1)
    net.p = {n: v.astype(np.float64) for n, v in net.p.items()}
    codes, target = rng.integers(0, 5, (7, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    weight = (np.arange(7)[:, None] < np.array([7, 3, 5, 1])[None, :]).astype(np.float64)

    def loss():
        states = np.concatenate([net._states(codes, 0), net._states(codes, 1)], axis=2) @ net.p["out"] + net.p["bias"]
        p = np.exp(states) / np.exp(states).sum(axis=2, keepdims=True)
        return -(np.log(p[:, np.arange(4), target]) * weight).sum() / weight.sum()

    _, g = net.gradients(codes, target, weight)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        for i in rng.choice(min(len(flat), 15 if "table" in name else len(flat)), 4):
            old, step = flat[i], 1e-2
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - g[name].reshape(-1)[i]) < 2e-4, name


def test_pooling_covers_every_byte():
    net = language.Network(["a", "b"], 4, 2)
    texts = [b"x", b"abc" * 50, bytes(range(256)) * 3, b"q" * language.WINDOW]
    got = net.pooled(texts)
    for t, row in zip(texts, got):
        parts = [t[i : i + language.WINDOW] for i in range(0, len(t), language.WINDOW)]
        total = sum(net.position_labels(np.frombuffer(p, np.uint8)[:, None])[:, 0].sum(axis=0) for p in parts)
        # a shorter last window is read with the zero bytes after it
        assert np.allclose(row.sum(), 1, atol=1e-5)
        if len(t) % language.WINDOW == 0:
            assert np.allclose(row, total / len(t), atol=1e-5)


def test_language_query_on_held_out_rows(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op10_language(spark, FOLDER).collect()
    held = [r for r in rows if r.held_out]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(rows) == 200
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_awkward_rows(spark):
    rows = language.identify(docs(spark), steps=3).collect()
    assert len(rows) == 15
    by = {r.doc_id: r for r in rows}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (2, 3, 4))
    assert all(r.lang_pred == "en" for r in rows if r.doc_id not in (2, 3, 4))
    unknown = language.identify(docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}
    assert language.identify(empty(spark)).collect() == []
    kept = language.predict(docs(spark), None)
    assert kept.columns == [c for c in docs(spark).columns if c != "score"] + ["lang_pred", "score"]


def test_leader_updates_are_the_textbook_ones():
    m = quality.Model(6)
    rng = np.random.default_rng(3)
    z, n = np.zeros(65), np.zeros(65)
    for _ in range(60):
        f, y = rng.integers(0, 64, 9), int(rng.integers(0, 2))
        x = np.zeros(65)
        for i in f:
            x[i] += quality._SCALE / 9
        x[64] = 1
        w = np.array([0 if abs(z[i]) <= m.l1 else -(z[i] - np.sign(z[i]) * m.l1) / ((m.beta + n[i] ** 0.5) / m.alpha + m.l2) for i in range(65)])
        p = 1 / (1 + np.exp(-w @ x))
        for i in range(65):
            g = (p - y) * x[i]
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / m.alpha * w[i]
            n[i] += g * g
        m.update(f, y)
    assert np.allclose(m.z, z) and np.allclose(m.n, n)


def test_features_do_not_depend_on_parts(monkeypatch):
    text = "Of%%% the the the&&& THEN 42 times, été. " * 9
    whole = np.sort(quality.Features(12)(text))
    monkeypatch.setattr(quality, "_PART", 7)
    assert np.array_equal(np.sort(quality.Features(12)(text)), whole)
    assert len(quality.Features(12)(None)) == 0


def test_quality_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op9_quality(spark, folder).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == 1000 and len(held) > 40
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (9, 5), (11, 1), (11, 0)], "doc_id long, quality int")
    rows = quality.classify(docs(spark), labels).collect()
    assert len(rows) == 15 and all(0 <= r.score <= 1 for r in rows)
    blank = {r.score for r in rows if r.doc_id in (2, 3, 4)}
    assert len(blank) == 1
    assert {r.score for r in quality.classify(docs(spark), labels.filter("false")).collect()} == {0.5}
    assert quality.classify(empty(spark), labels).collect() == []
