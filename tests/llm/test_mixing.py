import re

import numpy as np

from tarn.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes: dict, weights, most):
    """Water filling, one full source at a time."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, left = float(sum(sizes.values())), {}, set(names)
    while left:
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        full = [s for s in left if share[s] >= most * sizes[s]]
        if not full:
            return target | share
        for s in full:
            target[s] = float(most * sizes[s])
        left -= set(full)
        total -= sum(target[s] for s in full)
    return target


def make(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "b", "B", "é", "z", None], p=[0.5, 0.02, 0.2, 0.1, 0.08, 0.1])
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 60))) if i % 11 else None, source, 5, "clash"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string")


def test_targets_and_taken(spark):
    docs = make(spark)
    rows = docs.collect()
    got = mixing.mix(docs, (5, 2, 1), slice_rows=200).collect()
    assert len(got) == len(rows)
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    by = {}
    for r in rows:
        by[r.source] = by.get(r.source, 0) + size[r.doc_id]
    want = brute_targets(by, (5, 2, 1), 3)
    taken = {}
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == by[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 61, (s, taken[s], t)  # within one document
    assert sum(taken.values()) <= sum(by.values())
    again = mixing.mix(docs.repartition(7), (5, 2, 1), slice_rows=200).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_order_by_brute_force(spark, monkeypatch):
    """The documents taken are the first of the global order of finish times that fit the budget."""
    monkeypatch.setattr(mixing, "BLOCK_SLICES", 3)
    docs = make(spark, 300, 5)
    got = mixing.mix(docs, (1, 4), slice_rows=50)
    h = {r.doc_id: r.h for r in docs.select("doc_id", mixing.shuffled(docs.doc_id, 7).alias("h")).collect()}
    rows = [(r.source, r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got.collect()]
    turns = []
    for s in {r[0] for r in rows}:
        so_far, own = 0, sorted((r for r in rows if r[0] == s), key=lambda r: h[r[1]])
        for _, i, n, total, target, _ in own:
            so_far += n
            turns += [((k * total + so_far) / target if target else 0.0, h[i], i, n) for k in range(3)]
    budget, taken = sum(r[2] for r in rows), {}
    for _, _, i, n in sorted(turns):
        if budget < n:
            break
        budget -= n
        taken[i] = taken.get(i, 0) + n
    assert {r[1]: r[5] for r in rows} == {r[1]: taken.get(r[1], 0) for r in rows}


def test_documents_repeat_and_edges(spark):
    docs = make(spark, 500).union(make(spark, 3))
    want = {}
    for r in mixing.mix(docs, (5, 2, 1)).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    out = mixing.mixed_documents(docs, (5, 2, 1))
    assert out.columns == docs.columns
    seen = {}
    for r in out.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {k: n for k, n in want.items() if n}
    empty = docs.limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "  ", "s")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0]
