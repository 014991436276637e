import hashlib
import random
import zlib

import pytest

from tarn.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    order = lambda x: (x[0], x[1], hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest())
    own = {c: [x[2:] for x in sorted(v, key=order)] for c, v in own.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple([*own.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h], *mine[h:]])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    saved, leaves = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += children[p] == 0
    out = []
    for p, m in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(c for c in m if paths[c] == p))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha))
    return sorted(out, key=str)


def found(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted((tuple(r) for r in T.trie(df, **options).collect()), key=str)


def corpus(seed, n=60, longest=6):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 900), n):
        for turn in range(rng.randrange(longest + 1)):
            rows.append((c, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "bot", None, ""]), rng.choice(["a", "b", "é😀", "", None])))
    return rows + rng.sample(rows, 5) + [(None, 1, "user", "x"), (200, 0, "u", "a"), (100, 0, None, None)]


@pytest.mark.parametrize("seed", range(2))
def test_tree_by_brute_force(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows) == brute(rows)


def test_small_blocks_and_chunks_and_long_conversations(spark, monkeypatch):
    """Blocks of 4 turns: the order, the digests, the search and the sums go over several blocks."""
    monkeypatch.setattr(T, "BLOCK", 4)
    monkeypatch.setattr(T, "CHUNK_BYTES", 40)
    rows = corpus(5, n=25, longest=4)
    for c, turns in ((7, 30), (8, 30), (9, 17), (10, 31), (205, 30)):
        rows += [(c, k, "user", "same" if k < 15 + c % 4 else f"{c}") for k in range(turns)]
    rows += [(c, 0, "u", "hi") for c in range(300, 340)]
    assert found(spark, rows) == brute(rows)


def test_steps_of_a_staircase(spark):
    """Each conversation leaves the path of the one before it one turn later, so chains hang on chains."""
    rows = [(c, k, "u", "x" if k < c else f"own {c}") for c in range(12) for k in range(c + 1)]
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_other_columns(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None, None, None)]) == []
    assert found(spark, [(4, None, None, None, 9)], SCHEMA + ", n_convs long") == brute([(4, None, None, None)])
    long = [(1, 0, "user", "y" * 300_000), (2, 0, "user", "y" * 300_000), (0, 0, "user", "z")]
    assert found(spark, long) == brute(long)
