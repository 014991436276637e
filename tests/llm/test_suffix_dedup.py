import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import suffix_dedup as S


def brute(rows):
    """Kept bytes per row: every 50-byte window that starts in a row of smaller id is removed."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, S.NO_ID), S.NO_ID if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (S.NO_ID if i is None else i):
                gone[p : p + 50] = True
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcé \n"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(rng.choice([49, 50, 51, 80, 300])) for _ in range(8)]
    rows = []
    for _ in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else text(rng.randrange(0, 120)) for _ in range(rng.randrange(5))]
        rows.append((len(rows), "".join(parts)))
    rows += [(len(rows) + k, "same line again and again, over fifty bytes in all of them") for k in range(40)]
    rows += [(900, "ab" * 200), (901, "b" + "ab" * 150), (902, "x" * 500), (903, "x" * 60), (904, None), (905, ""), (None, "ab" * 40), (906, "z" * 49), (907, "z" * 49), (3, rows[3][1]), (5, passages[4])]
    rng.shuffle(rows)
    return rows


def test_removal_by_brute_force(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "0 as kept", "0 as batch").repartition(3)
        got = [(r.doc_id, r.n_bytes, sum(s.length for s in r.spans), len(r.spans), bytes(r.kept)) for r in S.remove_repeats(df).collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r[1:])
        assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_texts_keep_other_columns(spark):
    rows = [(1, "é" * 60, 60, "a"), (2, "é" * 60, 60, "b"), (3, None, None, None), (4, "short", 5, "c"), (5, "tail " + "é" * 60, 65, "d")]
    got = {r.doc_id: r for r in S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string")).collect()}
    assert got[1].text == "é" * 60 and got[2].text == "" and got[2].n_chars == 0 and got[3].text is None and got[4].text == "short"
    assert got[5].text == "tail " and got[5].n_chars == 5 and got[5].source == "d"
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(empty).count() == 0 and S.without_repeats(empty).count() == 0


@given(st.text("ab", max_size=40), st.integers(1, 4))
@settings(max_examples=80, deadline=None)
def test_maximal_repeats_by_brute_force(text, least):
    """Over one text, the groups are exactly its maximal repeats with all of their occurrences."""
    b = np.frombuffer(text.encode() or b"a", np.uint8)
    n = len(b)
    starts = np.arange(n)
    order, found = S.maximal_repeats(b, starts, np.full(n, n), starts == 0, np.zeros(n, np.int64), least, n)
    got = {(bytes(b[order[a] : order[a] + k]), tuple(sorted(order[a : z + 1].tolist()))) for k, a, z, _ in found.tolist()}
    want = set()
    s = bytes(b)
    for k in range(least, n):
        for w in {s[i : i + k] for i in range(n - k + 1)}:
            at = [i for i in range(n - k + 1) if s[i : i + k] == w]
            left = {s[i - 1 : i] if i else None for i in at}
            right = {s[i + k : i + k + 1] if i + k < n else i for i in at}
            if len(at) > 1 and (len(left) > 1 or None in left) and len(right) > 1:
                want.add((w, tuple(at)))
    assert got == want


def test_row_names_tell_rows_apart():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 2, (500, S.WIDTH)).astype(np.uint8)
    rows[250:] = rows[:250]
    key = np.arange(500, dtype=np.uint64) % np.uint64(250) << np.uint64(40)
    assert len(np.unique(S.row_names(rows, key))) == 250
