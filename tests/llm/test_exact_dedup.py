import hashlib
import random
import re

import pytest

from tarn.llm import exact_dedup as X


def brute(rows):
    """Rows with their place; equal rows of a group keep the first."""
    groups = {}
    for r in rows:
        plain = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        groups.setdefault(plain, []).append(r)
    out = []
    for plain, g in groups.items():
        keep = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        first = True
        for r in g:
            kept = first and r == keep
            first = first and not kept
            out.append((r[0], keep[0], len(g), kept, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a b", "ab", "a\x0bb ", "a\x1cb", "é ü", "éü", None, "", " \n", "A b", f"own {i}", f"own{i // 2}"])) for i in rng.sample(range(5000), n)]
    return rows + rng.sample(rows, 20) + [(None, "ab"), (None, "null id"), (None, "null  id"), (-1, "x" * 200_000), (-2, "x" * 100_000 + " " + "x" * 100_000)]


def written(spark, rows, folder, parts=5, schema="doc_id long, text string"):
    path = f"{folder}/documents.parquet"
    df = spark.createDataFrame(rows, schema)
    df.selectExpr("*", "'x' as kept", "1 as file", "2 as digest").repartition(parts).write.parquet(path)
    return path


@pytest.mark.parametrize("bytes_, per_batch", [(32, 1000), (1, 2)])
def test_groups_by_brute_force(spark, tmp_path, bytes_, per_batch):
    """Also with digests of one byte, which many texts share, and two files in each batch of the stream."""
    rows = corpus(bytes_)
    got = X.deduplicate(spark, written(spark, rows, tmp_path), digest_bytes=bytes_, files_per_batch=per_batch)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_state_goes_on_with_new_files(spark, tmp_path):
    first, later = corpus(7, 60), [(9000 + i, "a b" if i % 2 else f"own {i}") for i in range(40)]
    path, location = written(spark, first, tmp_path), str(tmp_path / "state")
    X.deduplicate(spark, path, location=location).count()
    spark.createDataFrame(later, "doc_id long, text string").write.mode("append").parquet(path)
    assert sorted((tuple(r) for r in X.deduplicate(spark, path, location=location).collect()), key=str) == brute(first + later)


def test_single_file_and_empty_table(spark, tmp_path):
    rows = corpus(3, 40)
    folder = written(spark, rows, tmp_path, parts=1)
    (file,) = (tmp_path / "documents.parquet").glob("part-*.parquet")
    assert folder and sorted((tuple(r) for r in X.deduplicate(spark, str(file)).collect()), key=str) == brute(rows)
    (tmp_path / "none").mkdir()
    assert X.deduplicate(spark, written(spark, [], tmp_path / "none")).count() == 0


def test_no_python_in_the_plan(spark, tmp_path):
    plan = X.deduplicate(spark, written(spark, corpus(1, 30), tmp_path))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
