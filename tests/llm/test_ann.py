import math

import numpy as np

from tarn.llm import ann


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")


def brute(rows, k, query):
    """For each query row its nearest other rows, as (id, score), equal scores by id."""
    good = [(i, v) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = []
    for a, (q, x) in enumerate(good):
        if query(q):
            s = sorted((-sum(float(np.float32(c)) * float(np.float32(d)) for c, d in zip(x, v, strict=True)), i) for b, (i, v) in enumerate(good) if a != b and len(v) == len(x))
            out.append((q, [(i, -y) for y, i in s[:k]]))
    return out


def answers(found):
    """Lists of (id, score) by query id; a query id with several rows has as many lists."""
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return by


def test_recall_order_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 1024)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 8] + 0.6 * rng.normal(size=16)]) for i in range(2500)]
    hot = rows[17][1]
    rows += [(3000 + i, hot) for i in range(700)]  # one vector for a fifth of all rows
    want = dict(brute(rows, 20, lambda i: i % 20 == 0))
    found = ann.nearest(table(spark, rows), 20, queries=lambda i: i % 20 == 0).collect()
    assert all(1 <= r.probed < r.leaves for r in found)  # not all of them are looked into
    got = answers(found)
    assert set(got) == set(want)
    hits = 0
    for q, mine in got.items():
        mine.sort()
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for i, _ in want[q]})
        exact = dict(want[q])
        assert all(abs(s - exact[i]) < 1e-12 for _, i, s in mine if i in exact)
    assert hits / (20 * len(want)) >= 0.9


def test_deep_trees_and_small_blocks(spark, monkeypatch):
    for name, value in (("LEAF", 60), ("FAN", 4), ("BLOCK_ROWS", 40), ("BLOCK_QUERIES", 7)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(3)
    centres = 3 * rng.normal(size=(40, 12))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 40] + 0.4 * rng.normal(size=12)]) for i in range(1500)]
    rows += [(5000 + i, rows[3][1]) for i in range(300)]
    rows += [(9000 + i, [1.0 + 1e-6 * i, 2.0]) for i in range(150)]  # another length, hardly to be told apart
    want = dict(brute(rows, 10, lambda i: i % 20 == 0))
    found = ann.nearest(table(spark, rows), 10, queries=lambda i: i % 20 == 0).collect()
    assert max(r.leaves for r in found) > 16 and np.mean([r.probed / r.leaves for r in found]) < 0.5
    got = answers(found)
    assert set(got) == set(want) and all(sorted(r for r, _, _ in mine) == list(range(1, 11)) for mine in got.values())
    hits = sum(len({i for _, i, _ in mine} & {i for i, _ in want[q]}) for q, mine in got.items())
    assert hits / (10 * len(want)) >= 0.9
    assert all(all(i < 9000 or q >= 9000 for _, i, _ in mine) for q, mine in got.items())


def test_odd_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (8, [-1.0, -0.0]), (9, [1.0, 2.0, 3.0]), (12, [3.0, 1.0, 0.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(table(spark, rows), 20, queries=lambda i: i % 4 == 0).collect())
    assert got == sorted((q, k, i, s) for q, found in brute(rows, 20, lambda i: i % 4 == 0) for k, (i, s) in enumerate(found, 1))
    few = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(table(spark, rows), 1).collect())
    assert few == sorted((q, k, i) for q, found in brute(rows, 1, lambda i: True) for k, (i, _) in enumerate(found, 1))
    assert ann.nearest(table(spark, rows).limit(0), 20).count() == 0


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(1)
    x = ann.unit(np.repeat(np.eye(8), 50, 0) + 0.1 * rng.normal(size=(400, 8)))
    graph = ann.neighbours(x, x, 10, np.arange(400))
    part = ann.balanced_partition(x, graph, 8, rng)
    assert np.bincount(part, minlength=8).max() <= math.ceil(50 * (1 + ann.SLACK))
    assert (part[graph] != part[:, None]).mean() < 0.5


def test_starved_partitions_give_whole_lists(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(1300)]
    rows += [(5000 + i, rows[0][1]) for i in range(700)]  # a third of all rows in one place

    def starved(x, m, k, recall=0.95, seed=5):
        """Looks into one partition; the last ones hold next to nothing."""
        router = ann.Router(x.shape[1], m, np.random.default_rng(seed))
        router.weights[3] = np.where(np.arange(m) < 3, 0.0, -2.0)
        router.probes = 1
        return router

    monkeypatch.setattr(ann, "fit", starved)
    monkeypatch.setattr(ann, "LEAF", 256)
    parts = np.bincount(starved(np.zeros((1, 8)), math.ceil(2 * 1300 / ann.LEAF), 20).odds(np.array([v for _, v in rows[:1300]])).argmax(1))
    assert ((parts > 0) & (parts < 21)).any()
    got = {}
    for r in ann.nearest(table(spark, rows), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == {i for i, _ in rows}
    for q, found in got.items():
        assert sorted(r for r, _ in found) == list(range(1, 21)) and len({i for _, i in found} - {q}) == 20
    few = ann.nearest(table(spark, rows[:15]), 20).collect()
    assert len(few) == 15 * 14
