import zlib

import numpy as np

from pixelloom.llm import quality

SCHEMA = "doc_id long, text string, score string, c0 int"


def corpus():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeinorst"), rng.integers(2, 9))) for _ in range(500)]
    rows, labels = [], []
    for k in range(400):
        w = list(rng.choice(words, 60))
        bad = k % 4 == 0
        text = " ".join([x + "***" for x in w] if bad and k % 8 else [w[0]] * 60 if bad else w) + "."
        rows.append((k, text, "x", k))
        labels.append((k, int(not bad), 0))
    return rows, labels


def test_tables_hold_the_model():
    rows, labels = corpus()
    x = np.array([quality.features(r[1].encode()) for r in rows])
    y = np.array([q for _, q, _ in labels], float)
    model = quality.train(x, y)
    for k in (0, 1, 8):
        total = model.base + sum(t[np.searchsorted(c, v, side="right")] for c, t, v in zip(model.cuts, model.tables, x[k], strict=True))
        total += sum(v[np.searchsorted(model.coarse[i], x[k, i], side="right"), np.searchsorted(model.coarse[j], x[k, j], side="right")] for (i, j), v in model.pairs.items())
        assert abs(model.score(x)[k] - 1 / (1 + np.exp(-total))) < 1e-12
    assert len(model.pairs) == 8 and all(np.abs(v).max() > 0 for v in model.pairs.values())


def test_a_pair_that_single_features_cannot_tell():
    """Label 1 where exactly one of two features is high: each alone says nothing, their table says all."""
    rng = np.random.default_rng(1)
    x = rng.random((3000, 5))
    y = ((x[:, 1] > 0.5) != (x[:, 3] > 0.5)).astype(float)
    model = quality.train(x[:2000], y[:2000])
    assert (3, 1) in model.pairs and np.mean((model.score(x[2000:]) > 0.5) == y[2000:]) > 0.9


def test_rounds_that_do_not_help_are_not_kept():
    rng = np.random.default_rng(2)
    x, y = rng.random((40, 3)), np.tile([0.0, 1.0], 20)
    noise = quality.train(x, y, rounds=3, rate=50.0)
    assert all(not t.any() for t in noise.tables) and not any(v.any() for v in noise.pairs.values())


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = quality.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r["score_"] for r in quality.score_quality(docs, model).collect()}
    fold = [k for k, _, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(fold) > 40
    assert np.mean([(got[k] >= 0.3) == (k % 4 != 0) for k in fold]) > 0.97


def test_edges(spark):
    rows = [(1, None, None, 1), (None, "", "s", None), (2, "x" * 400_000, "s", 2), (2, "tie", "s", 2), (2, "tie", "s", 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(docs, none)
    got = quality.score_quality(docs, model)
    assert got.columns == ["doc_id", "text", "score", "c0", "score_"]
    assert [r["score_"] for r in got.collect()] == [0.5] * 5
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 1)], "doc_id long, quality int")
    assert quality.fit_quality(docs, odd).tables == []
    assert quality.score_quality(spark.createDataFrame([], SCHEMA), model).collect() == []
