import hashlib
import os
import random

import numpy as np
import pytest

from tarn.functions.lineage import setting
from tarn.llm import edit_fingerprint as E
from tarn.llm import queries


def slow(text):
    """The fingerprint's places and steps, one step at a time."""
    letters = np.array(sorted({ord(c) for c in text}))
    number = {int(c): i for i, c in enumerate(letters)}
    at, j, best = 0, 0, {}
    while at < len(text):
        u = int(E.priorities(j, 1)[0])
        if j % E.SLOTS not in best or u < best[j % E.SLOTS][0]:
            best[j % E.SLOTS] = u, at, j
        at += int(E.coins(letters, j // E.STRIDE)[0][number[ord(text[at])]]) >> j % E.STRIDE & 1
        j += 1
    return best


def read(text, best):
    out = bytearray(E.SLOTS)
    for s, (_, at, j) in best.items():
        x = np.zeros(1, np.uint64)
        for g in range(E.GRAM):
            x = E._mix(x + np.uint64(ord(text[at + g]) + 1 if at + g < len(text) else 0) + np.uint64(g << 32))
        out[s] = int(E._mix(x + np.uint64(j))[0] % np.uint64(255)) + 1
    return bytes(out)


def test_fingerprints_by_walking_step_by_step():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdé 𝒳\n\0") for _ in range(n)) for n in (0, 1, 2, 7, 63, 64, 65, 100, 999, 300, 301, 302, 303, 304, 305, 306, 307, 2000, 41, 42, 43)] + ["", "a", "aaaaaaaa" * 90]
    want = [read(t, slow(t)) for t in texts]
    together = E.fingerprints_of(texts)
    assert len(texts) > E.FEW and [f.tobytes() for f in together] == want  # side by side
    assert [E.fingerprint(t) for t in texts] == want  # one by one
    assert [f.tobytes() for f in E.fingerprints_of(texts[::-1])] == want[::-1]


def test_coins_have_no_period_and_are_fair():
    letters = np.arange(97, 123)
    words = E.coins(letters, 0, 400)[:, :-1]
    bits = ((words[:, :, None] >> E._SHIFTS) & np.uint64(1)).astype(int)
    assert abs(bits.mean() - 0.5) < 0.01 and (E.coins(letters, 7)[:, -1] == 0).all()
    walk = bits.transpose(1, 0, 2).reshape(len(letters), -1) * 2 - 1
    for lag in (1, 2, 8, 16, 64, 128, 1024):
        assert abs((walk[:, lag:] * walk[:, :-lag]).mean()) < 0.02, lag
    assert abs((walk[0] * walk[1]).mean()) < 0.03


def plain_likeness(rng, x, y):
    """Share of the steps at which two walks by independent coins, drawn step by step, read the same."""
    both, steps, a, b = 0, 0, 0, 0
    while a < len(x) or b < len(y):
        draws = {}
        p, q = x[a : a + E.GRAM], y[b : b + E.GRAM]
        both, steps = both + (p == q and a < len(x) and b < len(y)), steps + 1
        for c in sorted({p[:1], q[:1]}):
            draws[c] = rng.random() < 0.5
        a, b = a + (draws[p[:1]] if p else 0), b + (draws[q[:1]] if q else 0)
    return both / steps


def test_likeness_is_that_of_walks_by_independent_coins():
    rng = random.Random(4)
    base = ["".join(rng.choice("etaoin shrdlu") for _ in range(1500)) for _ in range(200)]

    def change(t, kind):
        at = rng.randrange(len(t))
        return t[:at] + {"replace": "#", "insert": "#" + t[at], "delete": ""}[kind] + t[at + 1 :]

    own = E.fingerprints_of(base)
    for kind in ("replace", "insert", "delete"):
        other = [change(t, kind) for t in base]
        ours = E.likenesses(own, E.fingerprints_of(other))
        plain = [plain_likeness(rng, x, y) for x, y in zip(base, other, strict=True)]
        assert np.percentile(ours, 10) >= np.percentile(plain, 10) - 0.05, kind
        assert abs(ours.mean() - np.mean(plain)) < 0.03, kind
    means = []
    for k in (1, 4, 16):
        other = base
        for _ in range(k):
            other = [change(t, rng.choice(("replace", "insert", "delete"))) for t in other]
        means.append(E.likenesses(own, E.fingerprints_of(other)).mean())
    assert means[0] > means[1] + 0.03 > means[2] + 0.1


def test_one_edit_in_a_very_long_text():
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(650_000))
    assert len(text) > 4 << 20
    f = E.fingerprints_of([text, text[:2_000_000] + "#" + text[2_000_000:]])
    assert E.likenesses(f[:1], f[1:])[0] > 0.6


def test_likeness_follows_edits():
    rng = random.Random(2)
    text = "".join(rng.choice("etaoin shrdlu") for _ in range(3000))
    few = text[:1000] + "x" + text[1001:2000] + text[2003:]
    assert E.likeness(E.fingerprint(text), E.fingerprint(text)) == 1.0
    half = text[:1500] + "".join(rng.choice("etaoin shrdlu") for _ in range(1500))
    other = "".join(rng.choice("etaoin shrdlu") for _ in range(3000))
    a, b, c = (E.likeness(E.fingerprint(text), E.fingerprint(t)) for t in (few, half, other))
    assert a > 0.5 and 0.35 < b < 0.65 and c < 0.1
    assert E.likeness(E.fingerprint(""), E.fingerprint(None)) == 1.0 and E.likeness(E.fingerprint("a"), E.fingerprint("")) == 0.0


def test_compare_with_next_by_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(3 * i, "".join(rng.choice("abc é𝒳") for _ in range(rng.randrange(0, 40)))) for i in range(300)] + [(-5, None), (None, "no id"), (30, "same id"), (9999, "")]
    want = []
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for k, (i, t) in enumerate(ordered):
        t, n = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), E.fingerprint(t).hex(), E.fingerprint(edited).hex(), E.likeness(E.fingerprint(t), E.fingerprint(edited)), E.likeness(E.fingerprint(t), E.fingerprint(n))))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "0 as slice", "0 as n_chars").repartition(5)
    key = lambda r: tuple(map(str, r))
    monkeypatch.setattr(E, "BLOCK_PARTS", 3)
    for partitions in ("1", "17"):
        with setting(spark, "spark.sql.shuffle.partitions", partitions), setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
            got = [tuple(r) for r in E.compare_with_next(df).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert E.compare_with_next(df.limit(0)).count() == 0
    same = spark.createDataFrame([(5, "same")] * 7 + [(None, "same")] * 5, "doc_id long, text string")
    rows = E.compare_with_next(same).collect()
    assert len(rows) == 12 and {(r.near_next, r.n_chars) for r in rows} == {(1.0, 4)} and sum(r.doc_id is None for r in rows) == 5
    one = E.compare_with_next(df.where("doc_id = 3")).first()
    assert one.near_next == 1.0


def test_near_copies_finds_pairs_that_the_hub_of_their_bands_is_not_like(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_MEMBERS", 3)
    rng = random.Random(7)
    prints = []
    for _ in range(12):
        x = bytes([0x80 + rng.randrange(64) for _ in range(E.SLOTS)])
        lower = bytes(c - 0x40 if rng.random() < 0.3 else c for c in x)  # the smallest of the bands it shares
        prints += [x, bytes(c ^ 1 if rng.random() < 0.08 else c for c in x), bytes(c ^ 2 if rng.random() < 0.08 else c for c in x), bytes([1]) + lower[1:]]
    slots = np.random.default_rng(11).permuted(np.tile(np.arange(E.SLOTS), (E.BANDS, 1)), axis=1)[:, : E.BAND_SLOTS]
    want = set()
    for x in prints:
        for y in prints:
            if y < x and any(all(x[s] == y[s] for s in row) for row in slots) and E.likeness(x, y) >= 0.75:
                want.add((x.hex(), y.hex()))
    entries = spark.createDataFrame([(p.hex(),) for p in prints], "key string").selectExpr("key", "key as fingerprint")

    def verify(batches):
        for b in batches:
            yield b.filter([E.likeness(bytes.fromhex(x), bytes.fromhex(y)) >= 0.75 for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True)])

    near = lambda every: [(r.b, r.a) for r in E._near(entries, every, lambda pairs: pairs.mapInArrow(verify, "a string, b string")).collect()]
    got = near(True)
    assert len(got) == len(want) and set(got) == want

    def groups(links):
        of = {p.hex(): {p.hex()} for p in prints}
        for a, b in links:
            both = of[a] | of[b]
            for p in both:
                of[p] = both
        return {frozenset(g) for g in of.values()}

    fewer = set(near(False))
    assert fewer <= want and groups(fewer) == groups(want) and any(len(g) > 1 for g in groups(want))


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance_by_brute_force():
    rng = random.Random(8)
    for _ in range(600):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(14))) for _ in range(2))
        want = slow_distance(a, b)
        for most in (0, 1, want, want + 3):
            assert E.edits_within(a, b, most) == (want if want <= most else None)


def edited(rng, text, k):
    for _ in range(k):
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(("", "#", text[at] + "#")) + text[at + 1 :]
    return text


def test_defaults_find_edited_texts(spark):
    """Recall by edit rate with the default thresholds."""
    rng = random.Random(9)
    names = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    base = [" ".join(rng.choice(names) for _ in range(260)) for _ in range(60)]
    copies = {k: [edited(rng, b, k) for b in base] for k in (1, 3, 8, 12)}
    rows = [*base, *(t for some in copies.values() for t in some), base[0], "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    pair = lambda x, y: (max(x, y), min(x, y))
    text_of = {digest(t): t for t in rows if t}
    got = {(r.sha256, r.other): r for r in E.near_texts(df).collect()}
    for (x, y), r in got.items():
        assert r.edits == E.edits_within(text_of[x], text_of[y], 40) and r.similarity >= 0.99
    for k, some in copies.items():
        want = [p for p in (pair(digest(a), digest(b)) for a, b in zip(base, some, strict=True)) if E.edits_within(text_of[p[0]], text_of[p[1]], len(text_of[p[0]]) // 120) is not None]
        assert sum(p in got for p in want) >= 0.9 * len(want) and len(want) >= 50, k


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_near_texts_query_by_brute_force(spark):
    texts = sorted({r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text}, key=len)
    want, start = set(), 0
    for i, b in enumerate(texts):
        while len(texts[start]) < 0.99 * len(b) - 1:
            start += 1
        for a in texts[start:i]:
            found = E.edits_within(a, b, int(0.01 * len(b) + 1e-9))
            if found is not None:
                x, y = (hashlib.sha256(t.encode()).hexdigest() for t in (a, b))
                want.add((max(x, y), min(x, y), found))
    got = {(r.sha256, r.other, r.edits) for r in queries.edit_near_texts(spark, "/root/testdata/sf0.01").collect()}
    print(len(want), "pairs,", len(got), "found")
    assert got <= want and len(got) >= 0.9 * len(want)
