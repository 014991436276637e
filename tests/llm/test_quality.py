import zlib

import numpy as np

from tarn.llm import quality as Q


def corpus(n=600, seed=0):
    rng = np.random.default_rng(seed)
    words = np.array([f"{a}{b}{c}" for a in ("th", "re", "an", "lo") for b in ("in", "er", "ou") for c in ("ed", "ly", "tion", "s")])
    rows, labels = [], []
    for i in range(n):
        w = rng.choice(words, int(rng.integers(5, 80)))
        bad = i % 4 == 0
        text = " ".join(x.upper() + "!!" for x in w) if bad and i % 8 else " ".join(np.repeat(w, 10)) if bad else " ".join(w).capitalize() + "."
        rows.append((i, text))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def make(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "0 as score", "0 as quality"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_folds(spark):
    rows, labels = corpus()
    got = {r.doc_id: r for r in Q.classify(*make(spark, rows, labels)).collect()}
    want = dict(labels)
    held = [i for i in got if got[i].held_out]
    assert set(held) == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([got[i].predicted == want[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus(200)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    a = {r.doc_id: r.score for r in Q.classify(*make(spark, rows, labels)).collect()}
    b = {r.doc_id: r.score for r in Q.classify(*make(spark, rows, flipped)).collect()}
    assert a == b


def test_scores_by_brute_force():
    """A score is the plain sparse dot product of features and weights."""
    rng = np.random.default_rng(1)
    w = rng.normal(size=(1 << Q.BITS) + 1)
    for text in ("One two two THREE!! four", "a", "x x x x x"):
        at, x = Q.sparse(text)
        assert np.isclose(w[at] @ x, Q.SCALE * sum(w[f].mean() for f in Q.features(text) if len(f)))


def test_ftrl_updates_by_brute_force():
    """Against the published per-coordinate rule, coordinate by coordinate."""
    rng = np.random.default_rng(2)
    model = Q.Ftrl(6)
    z, n = np.zeros(7), np.zeros(7)
    for _ in range(50):
        at = np.append(rng.choice(6, 3, replace=False), 6)
        x, y = rng.random(4), int(rng.integers(2))
        weight = [0.0 if abs(z[i]) <= Q.L1 else -(z[i] - np.sign(z[i]) * Q.L1) / ((Q.BETA + n[i] ** 0.5) / Q.ALPHA + Q.L2) for i in at]
        p = 1 / (1 + np.exp(-np.dot(weight, x)))
        for i, wi, xi in zip(at, weight, x, strict=True):
            g = (p - y) * xi
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / Q.ALPHA
            z[i] += g - s * wi
            n[i] += g * g
        model.update(at, x, y)
        assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_odd_rows(spark):
    rows, labels = corpus(100)
    rows += [(500, None), (501, ""), (None, "text"), (3, rows[3][1]), (502, "w" * 2_000_000)]
    labels += [(None, 1), (7, None), (3, 0)]
    docs, tags = make(spark, rows, labels)
    got = Q.classify(docs, tags).collect()
    assert len(got) == len(rows)
    scores = {r.doc_id: r.score for r in got}
    assert scores[500] == scores[501]
    assert Q.classify(docs.limit(0), tags).count() == 0
    assert {r.score for r in Q.classify(docs, tags.limit(0)).collect()} == {0.5}
    kept = Q.accepted(docs, tags)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)
