import re

import pyarrow as pa

from tarn.llm import common


def test_words_split_at_ascii_white_space_only():
    for t in ("a b", " a\tb\nc\x0bd\x0ce\rf ", "a b c\x1cd", "", "   "):
        assert common.words(t) == re.findall(r"[^\x20\x09-\x0D]+", t)
    assert common.ascii_lower("ABC É ß İ") == "abc É ß İ"


def test_slices_keep_all_rows_and_bounds():
    texts = ["x" * n for n in (10, 10, 100, 0, 5, 5, 5)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["i", "t"])
    parts = list(common.sliced([batch, batch.slice(0, 0)], max_bytes=20, max_rows=3))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(8))
    assert all(p.num_rows <= 3 and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 20) for p in parts)


def test_two_generations_stay_bounded():
    c = common.TwoGenerations(10)
    for i in range(1000):
        c.put(i, i)
        assert len(c.young) + len(c.old) <= 20
    assert c.get(999) == 999 and c.get(0) is None


def test_caches_go_when_another_operator_starts():
    one, two = {"a": 1}, {"b": 2}
    with common.working("one", one):
        pass
    assert one
    with common.working("one", one):
        assert one
    with common.working("two", two):
        assert not one and two
    assert two


def test_bounds_of_the_session_stay(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1000")
        common.bounded_batches(spark)
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before)


def test_cut_uses_the_sessions_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert common.shared_dir(spark) and spark.sparkContext.getCheckpointDir()
    assert folder in spark.sparkContext.getCheckpointDir()
    assert common.cut(spark.range(5)).count() == 5
