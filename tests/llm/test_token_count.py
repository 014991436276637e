import random

import pytest
from tokenizers import Tokenizer

from tarn.llm import packing, token_count
from tarn.llm.queries import vocabulary

ALPHABET = "aAé'É.,!? \n\t <|endoftext>ΣσİK1２½中文👍́e-_ẞß"


def texts(n=800):
    rng = random.Random(4)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [*made, "", "<|endoftext|>", "a <|endoftext|><|endoftext|>b", "   ", "a   b  ", "x" * 3000, "it's they'll", "\r\n\r\n a"]


def test_counts_are_the_librarys(spark):
    rows = [*enumerate(texts()), (-1, None), (None, "hello world")]
    path = vocabulary("byte_bpe_50k.json")
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n_tokens")
    got = token_count.count_tokens(df, path, limit=10).collect()
    library = Tokenizer.from_file(path)
    want = sorted((i if i is not None else -9, len(t.encode()) if t else 0, n, n > 10) for (i, t), n in ((r, len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows))
    assert sorted((r.doc_id if r.doc_id is not None else -9, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_merges_take_one_symbol_each():
    c = token_count.counter(vocabulary("byte_bpe_50k.json"))
    assert c.merged(b"a") == 1 and c.merged(b"") == 0
    assert c.count(None) == c.count("") == 0


def test_ids_by_parts_are_the_librarys():
    path = vocabulary("word_bpe_49k.json")
    import numpy as np

    library, cache = Tokenizer.from_file(path), packing.id_cache(path)
    for t, got in zip(texts(), cache.texts(texts()), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("schema", ["doc_id long, text string"])
def test_empty_table(spark, schema):
    empty = spark.createDataFrame([], schema)
    assert token_count.count_tokens(empty, vocabulary("byte_bpe_50k.json")).count() == 0
    assert packing.pack_documents(empty, vocabulary("word_bpe_49k.json")).count() == 0
