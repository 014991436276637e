"""The pipeline on a small corpus: each stage against brute force on its own input."""

import os
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tarn.llm import quality, queries
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_mixing import WORD, brute_targets
from tests.llm.test_suffix_dedup import brute as without


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("th", "re", "an", "lo", "si") for b in ("in", "er", "ou", "ed", "ly", "tion", "s")]
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows, labels = [], []
    for _ in range(260):
        w = [rng.choice(words) for _ in range(rng.randrange(10, 150))]
        bad = rng.random() < 0.15
        text = " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w)
        if not bad and rng.random() < 0.3:
            text += "\n" + passage
        for k in range(rng.choice([1, 1, 1, 3])):
            rows.append((len(rows), text if k == 0 else text + " end", "en", rng.choice(["src0", "src0", "src1", "src2"]), len(text)))
            labels.append((len(labels), int(not bad), 0))
    rows += [(9000, None, None, None, None), (9001, "", "en", "src1", 0)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


def test_stages_by_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, outs = docs.columns, [docs]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, outs[-1], folder).write.parquet(str(tmp_path / str(i)))
        outs.append(spark.read.parquet(str(tmp_path / str(i))))
    start, good, distinct, cut, mixed, packed = (o.collect() for o in outs)
    assert all(o.columns == columns for o in outs[:-1])

    kept = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    assert {r.doc_id for r in good} == kept
    clean = {r.doc_id for r in start if r.text and "!!" not in r.text}
    assert len(clean - kept) == 0 and len({r.doc_id for r in start if r.text and "!!" in r.text} & kept) == 0

    assert {r.doc_id for r in distinct} == {d for d, _, c in components([(r.doc_id, r.text) for r in good]) if d == c}
    want = {i: kept for i, *_, kept in without([(r.doc_id, r.text) for r in distinct])}
    assert {r.doc_id: (r.text or "").encode() for r in cut} == {i: b.decode("utf-8", "ignore").encode() for i, b in want.items()}
    assert all(r.n_chars == len(r.text) for r in cut if r.text is not None)

    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in cut}
    by, taken = {}, {}
    for r in cut:
        by[r.source] = by.get(r.source, 0) + size[r.doc_id]
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
    longest = max(size.values())
    assert all(abs(taken.get(s, 0) - t) <= longest for s, t in brute_targets(by, (5, 2, 1), 3).items())

    library = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    pieces = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)
    expect = []
    for r in mixed:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        expect += [(r.doc_id, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for a in range(0, len(ids), 2048)]
    assert pieces == sorted(expect)


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"edit_near_texts"}))  # that one may find nothing; it is held against brute force
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_null_and_repeated_ids(spark):
    from tarn.llm import jaccard_join, suffix_dedup

    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, c, d, e = (text(60) for _ in range(5))
    rows = [(1, a), (1, a), (1, b), (None, a), (None, c), (None, c), (2, b + " x"), (3, d)]
    kept = jaccard_join.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 99, r.text) for r in kept) == sorted([(1, a), (1, b), (99, c), (3, d)])

    rows = [(1, a), (5, b + "K" + a), (5, c + "L" + a), (None, d + "M" + a), (None, e + "N" + a), (None, None)]
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 99, r.text or "") for r in got) == sorted([(1, a), (5, b + "K"), (5, c + "L"), (99, d + "M"), (99, e + "N"), (99, "")])
