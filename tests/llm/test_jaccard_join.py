import random
import re
from itertools import combinations

from tarn.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, percent=80, width=5):
    """Per row: set size and the smallest id reachable by links, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[top(a)] = top(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def corpus(seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choice(words) for _ in range(40)]
    rows = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 6, 30, 120]))]
        if rng.random() < 0.5:
            base += shared
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [rng.choice(words)]
            rows.append((len(rows), rng.choice([" ", "\n", " \t"]).join(copy)))
    base = [rng.choice(words) for _ in range(60)]  # a large group of near copies, and one of exact ones
    for _ in range(60):
        copy = list(base)
        copy[rng.randrange(60)] = rng.choice(words)
        rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, "SAME text As the Others of its group") for i in range(50)]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "É"), (9006, "é"), (9007, "a\u00a0b c"), (None, rows[0][1]), (5, rows[5][1])]
    rng.shuffle(rows)
    return rows


def test_components_by_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as n_shingles", "1 as component_id")
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in J.jaccard_classes(df).collect())
        assert got == sorted((d if d is not None else -1, n, c) for d, n, c in brute(rows))


def test_first_of_each_and_empty(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in J.first_of_each(df).collect() if r.doc_id is not None)
    assert kept == sorted(d for d, _, c in brute(rows) if d is not None and d == c)
    assert J.jaccard_classes(df.limit(0)).count() == 0 and J.first_of_each(df.limit(0)).count() == 0


def test_shingles_do_not_cross_documents():
    import numpy as np

    texts = ["a b c d e f", "", "x", "g h i j k", "a b c d e f g"]
    data = "".join(texts).encode()
    starts = np.cumsum([0, *map(len, texts)])
    sizes = [len(s) for s in J.token_sets(data, starts)]
    assert sizes == [2, 0, 1, 1, 3]
    assert [s.tolist() for s in J.token_sets(data, starts)] == [J.shingle_hashes(t).tolist() for t in texts]


def test_long_chain_is_one_component(spark):
    links = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert J.components(links).select("label").distinct().count() == 1


def test_link_counts_by_brute_force(spark):
    rows = corpus(4)
    sets = [set(J.shingle_hashes(t or "").tolist()) for _, t in rows]
    want = []
    for i, a in enumerate(sets):
        linked = sum(1 for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= 80 * len(a | b))
        want.append((-1 if rows[i][0] is None else rows[i][0], linked))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_links) for r in J.link_counts(df).collect()) == sorted(want)
