import numpy as np
import pyarrow as pa
import pytest

from tarn.llm import batches as B
from tarn.llm import jaccard_join as J
from tarn.llm import suffix_dedup as S
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_jaccard_join import corpus as texts
from tests.llm.test_suffix_dedup import brute as without
from tests.llm.test_suffix_dedup import corpus as passages


def test_counts_in_a_byte():
    n = np.unique(np.concatenate([np.arange(2000), 2 ** np.arange(33)]))
    code = B.coded(n)
    assert (np.diff(code.astype(int)) >= 0).all() and (B.coded(B.counted(code)) == code).all()
    assert (B.counted(code) <= n).all() and (B.counted(code) >= 0.9 * n).all() and (B.counted(code)[n <= 32] == n[n <= 32]).all()


@pytest.mark.parametrize("bits, fan, crate", [(0, 10, 1024), (3, 10, 1024), (7, 3, 2), (9, 2, 5)])
def test_answers_by_brute_force(spark, monkeypatch, bits, fan, crate):
    monkeypatch.setattr(B, "CRATE_BATCHES", crate)
    rng = np.random.default_rng(bits)
    pool = rng.integers(0, 1 << 63, 3000, np.uint64) * np.uint64(2)
    pool[0] = np.uint64((1 << 64) - 1)
    own = {b: np.unique(rng.choice(pool[: 50 if b % 3 else 3000], 400)) for b in range(11)}
    own[11] = np.zeros(0, np.uint64)
    counts = {b: rng.integers(1, 6, len(k)) for b, k in own.items()}
    want = {}
    for b, k in own.items():
        for x, n in zip(k.tolist(), counts[b].tolist(), strict=True):
            want[x] = want.get(x, 0) + n
    rows = pa.concat_tables([pa.Table.from_batches([B.sent(b, own[b], counts[b], bits, fan)]) for b in own if len(own[b])])
    assert len({(r["bucket"], r["batch"]) for r in rows.to_pylist()}) == rows.num_rows <= 12 << min(bits, fan)
    got = B.answered(spark.createDataFrame(rows.to_pandas(), B.SENT).repartition(3), bits, fan, 12).toArrow()
    for b, k in own.items():
        mine = B.totals_of(got.filter(pa.compute.equal(got["batch"], b)))
        assert mine.tolist() == B.coded([want[x] for x in k.tolist()]).tolist()


@pytest.fixture
def small(monkeypatch):
    """Many buckets, small batches, two steps to the buckets and parted anchors, all at the size of a test."""
    monkeypatch.setattr(B, "BATCH_BYTES", 2_000)
    monkeypatch.setattr(B, "BUCKET_KEYS", 40)
    monkeypatch.setattr(B, "FAN_BITS", 2)
    monkeypatch.setattr(B, "CRATE_BATCHES", 3)
    monkeypatch.setattr(S, "HOT", 6)


def test_joins_in_small_steps(spark, small):
    rows = texts(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_classes(df).collect()]
    assert sorted(got, key=str) == sorted(components(rows), key=str)


@pytest.mark.parametrize("crate", [3, 1000])
def test_repeats_in_small_steps(spark, small, monkeypatch, crate):
    monkeypatch.setattr(B, "CRATE_BATCHES", crate)
    rows = passages(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_bytes, sum(s.length for s in r.spans), len(r.spans), bytes(r.kept)) for r in S.remove_repeats(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(without(rows), key=key)


def test_parts_of_a_segment_hold_each_window_once():
    rng = np.random.default_rng(2)
    data = bytes(rng.integers(97, 100, 4000).tolist())
    whole = S.Anchors(data, np.array([0, 30, 1000, 1060, 4000]))
    windows = sorted(int(x) for f, w in zip(whole.first, whole.windows, strict=True) for x in range(f, f + w))
    for level in range(1, len(S.PARTS)):
        parts = whole.parted(np.arange(len(whole.first)), level)
        assert sorted(int(x) for f, w in zip(parts.first, parts.windows, strict=True) for x in range(f, f + w)) == windows
        string = {}
        for f, w, a, k in zip(parts.first, parts.windows, parts.anchor, parts.key, strict=True):
            least = next(x for x, y in zip(S.PARTS[level], S.PARTS[level][1:], strict=False) if x <= a - f < y)
            most = next(y for x, y in zip(S.PARTS[level], S.PARTS[level][1:], strict=False) if x <= a - f < y)
            assert all(least <= a - p < most for p in range(f, f + w))
            shared = least, data[a - least : a + S.LENGTH - most + 1]
            assert len(shared[1]) == S.LENGTH - (most - 1 - least) and string.setdefault(shared, k) == k
        assert len(set(string.values())) == len(string)


def test_portions_of_suffixes_give_the_same_answers(monkeypatch):
    rng = np.random.default_rng(5)
    passage = bytes(rng.integers(97, 100, 120).tolist())
    data = b"".join(bytes(rng.integers(97, 100, int(rng.integers(0, 60))).tolist()) + passage[int(rng.integers(30)) :][: int(rng.integers(60, 120))] for _ in range(60))
    whole = S.Anchors(data, np.arange(0, len(data) + 1, len(data) // 40))
    rows, _, _, _ = whole.segments(np.ones(len(whole.first), bool))
    owner = rng.integers(0, 1000, len(rows))
    want, base = S.smallest_per_window(rows, owner)
    for most in (5, 60, 400):
        monkeypatch.setattr(S, "SUFFIXES", most)
        got, _ = S.smallest_per_window(rows, owner)
        assert (got == want).all()
    each = {}
    for r, o, b in zip(rows, owner.tolist(), base.tolist(), strict=False):
        for k in range(int(r[S.WINDOWS_AT])):
            w = bytes(r[k : k + S.LENGTH])
            each[w] = min(each.get(w, 1 << 60), o)
    assert want.tolist() == [each[bytes(r[k : k + S.LENGTH])] for r in rows for k in range(int(r[S.WINDOWS_AT]))]


def test_long_texts(spark):
    """One text of over 4 MB beside short ones, whole."""
    rng = np.random.default_rng(3)
    word = ["".join(chr(c) for c in rng.integers(97, 123, 5)) for _ in range(5000)]
    long_ = " ".join(word[i] for i in rng.integers(0, 5000, 720_000))
    tail = long_[-400:]
    rows = [(1, "head " + tail), (2, long_), (3, long_ + " x"), (4, "other words only")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(long_) > 4 << 20
    assert sorted((r.doc_id, r.component_id) for r in J.jaccard_classes(df).collect()) == [(1, 1), (2, 2), (3, 2), (4, 4)]
    got = {r.doc_id: (r.n_bytes, [(s.start, s.length) for s in r.spans]) for r in S.remove_repeats(df).collect()}
    assert got[2] == (len(long_), [(len(long_) - 400, 400)]) and got[3] == (len(long_) + 2, [(0, len(long_))]) and got[4][1] == []
