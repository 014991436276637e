import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tarn.llm import token_alignment as T
from tarn.llm.queries import vocabulary
from tarn.llm.token_count import byte_letters

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ALPHABET = "aAé'É.,!? \n\t <|endoftext|>▁s ΣσİK1２½中文👍́e-_ẞß\x1c　\x00"


def texts(n=300):
    rng = random.Random(8)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(n)]
    made += [" ".join(rng.choice(["word", "words.", "thing,", "naïve", "x1.", "\nnew", "U.S.", "(a)", "don't"]) for _ in range(30)) for _ in range(40)]
    return [*made, "", None, "<|endoftext|>", "<s>x</s> <0x41>", " lead", "trail ", "a  b", "a\n\nb", "a \n b", "a\nb", "\n", " ", "w" * 2000, "same text", "same text"]


def sides(t):
    """Ids and bytes of each token by the libraries on the whole text."""
    a = Tokenizer.from_file(A) if not hasattr(sides, "a") else sides.a
    b = sentencepiece.SentencePieceProcessor(model_file=B) if not hasattr(sides, "b") else sides.b
    a.encode_special_tokens = True
    sides.a, sides.b, letter = a, b, byte_letters()
    ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
    raw_a = [bytes(letter[c] for c in a.id_to_token(i)) for i in ia]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    return ia, ib, raw_a, raw_b


def brute(rows):
    docs, corpus = [], Counter()
    for i, t in rows:
        found, groups = [], []
        ia, ib, raw_a, raw_b = sides(t) if t else ([], [], [], [])
        if t and b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
            at = lambda raw: [(sum(map(len, raw[:k])), sum(map(len, raw[: k + 1]))) for k in range(len(raw))]
            ra, rb = at(raw_a), at(raw_b)
            found = [(ia[x], ib[y]) for x in range(len(ia)) for y in range(len(ib)) if ra[x][0] < rb[y][1] and rb[y][0] < ra[x][1]]
            both = sorted({z for _, z in ra} & {z for _, z in rb})
            for lo, hi in zip([0, *both], both, strict=False):
                groups.append(",".join(str(k) for k, r in zip(ia, ra, strict=True) if lo < r[1] <= hi) + "|" + ",".join(str(k) for k, r in zip(ib, rb, strict=True) if lo < r[1] <= hi))
        else:
            ia = ib = []
        corpus.update(found)
        docs.append((i, len(ia), len(ib), len(groups), found, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = {}
    for (_, b), n in corpus.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(((i, a, b, g, len(f), sum(corpus[p] == most[p[1]] for p in f), sum(corpus[p] for p in f), s) for i, a, b, g, f, s in docs), key=str)


@pytest.mark.parametrize("size, cached", [(8 << 20, 100_000), (300, 20)])
def test_links_by_brute_force(spark, monkeypatch, size, cached):
    """One batch for each task, and many small ones whose words are soon let go."""
    monkeypatch.setattr(T, "BATCH_BYTES", size)
    monkeypatch.setattr(T, "CACHED", cached)
    T._loaded.clear()
    rows = [*enumerate(texts()), (None, "a null id"), (7, "words."), (7, "words.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n_a", "'x' as batch").repartition(3)
    got = sorted((tuple(r) for r in T.align_tokens(df, A, B).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[1] > 0 for r in got) > 200


def test_links_are_one_fewer_than_ends():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        ends = [np.append(np.flatnonzero(rng.random(n - 1) < 0.4) + 1, n) for _ in range(2)]
        ga, gb, a, b = T.links(*ends)
        assert len(a) == len(np.union1d(*ends)) and ga[-1] == gb[-1] and (ga[a] == gb[b]).all()


def test_empty_table_and_long_text(spark):
    assert T.align_tokens(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    none = T.align_tokens(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B).collect()
    assert sorted(map(tuple, none)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    long = " ".join(f"w{i % 977} and" for i in range(60_000))
    (row,) = T.align_tokens(spark.createDataFrame([(1, long)], "doc_id long, text string"), A, B).collect()
    ia, ib, _, _ = sides(long)
    assert (row.n_a, row.n_b) == (len(ia), len(ib))
