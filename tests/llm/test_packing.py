import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarn.llm import packing
from tarn.llm.queries import vocabulary


@given(st.lists(st.integers(1, 30), max_size=80))
@settings(max_examples=60, deadline=None)
def test_bins_hold_what_fits(sizes):
    bins, offsets = packing.sum_of_squares(sizes, 30)
    held = defaultdict(list)
    for b, o, s in zip(bins, offsets, sizes, strict=True):
        held[b].append((o, s))
    for rows in held.values():
        at = 0
        for o, s in sorted(rows):
            assert o == at
            at += s
        assert at <= 30


def test_rule_by_brute_force():
    """Each place taken makes the sum over gaps of squared counts as small as any open bin could."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 20, 200).tolist()
    bins, _ = packing.sum_of_squares(sizes, 20)
    gaps = {}
    for s, b in zip(sizes, bins, strict=True):
        def cost(changed):
            counts = defaultdict(int)
            for g in changed.values():
                if 0 < g < 20:
                    counts[g] += 1
            return sum(n * n for n in counts.values())

        open_ = [k for k, g in gaps.items() if s <= g < 20]
        if open_:
            assert b in gaps
            assert cost(gaps | {b: gaps[b] - s}) == min(cost(gaps | {k: gaps[k] - s}) for k in open_)
        else:
            assert b not in gaps
        gaps[b] = gaps.get(b, 20) - s


def test_pieces_sequences_and_waste(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{rng.integers(50)}" for _ in range(int(rng.integers(0, 900)))) or None, "x") for i in range(400)] + [(7, "again", "x"), (None, "no id", "x")]
    path = vocabulary("word_bpe_49k.json")
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length string"), path, capacity=512).collect()
    library = Tokenizer.from_file(path)
    want = defaultdict(list)
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for p, a in enumerate(range(0, len(ids), 512)):
            want[i, p, a].append((len(ids[a : a + 512]), zlib.crc32(np.array(ids[a : a + 512], "<u4").tobytes())))
    seen, held = defaultdict(list), defaultdict(list)
    for r in got:
        seen[r.doc_id, r.piece, r.start].append((r.length, r.ids_crc32))
        held[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    for places in held.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 512
    least = -(-sum(r.length for r in got) // 512)
    assert len(held) <= least * 1.03 + 1


def test_shards_keep_sequences_apart(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "int(1 + id % 97) as length")
    got = packing.pack(rows, capacity=100, shard_rows=500).collect()
    held = defaultdict(int)
    for r in got:
        held[r.sequence_id] += r.length
    assert len(got) == 3000 and max(held.values()) <= 100
