"""Findings of the third round: odd texts and larger tables."""

import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tarn.functions import rules
from tarn.functions import text as T
from tarn.llm import edit_fingerprint
from tarn.operators import fusion as U
from tarn.operators import products, tagging, understanding
from tarn.operators import retrieval as R
from tarn.plans import answers, catalog


def beside_sql(spark, folder, name, **tables):
    """The rows of a query and of its SQL over tables of (rows, schema)."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(folder))
    return sorted(map(tuple, got.collect())), sorted(con.execute(f"select {', '.join(got.columns)} from ({catalog.SQL[name]})").fetchall())


TURNS = ("labé report", "test́ it", "étest now", "what is\rthe test", "what\nof the test", "lİst the urgent plané", "TREAT it", "", None, "test test_ test9 test-", "whİch test, what   test")


def test_intent_words_end_at_letters_beyond_ascii(spark, tmp_path):
    got, want = beside_sql(spark, tmp_path, "intent_classes", conversations=([(i, 0, t) for i, t in enumerate(TURNS)], "conv_id long, turn long, text string"))
    assert got == want


AGES = ("45 y.o. man", "age 3000000000", "age 99999999999999999999", "70\u000byear old", "age\u000b12", "age\n12", "7-yo, 8-year-old", "", None, "A 9 YO")


def test_ages_by_three_forms_and_64_bits(spark, tmp_path):
    got, want = beside_sql(spark, tmp_path, "patient_ages", documents=([(i, t) for i, t in enumerate(AGES)], "doc_id long, text string"))
    assert got == want
    assert spark.createDataFrame([("45 y.o. man",)], "t string").select(understanding.age(F.col("t"))).first()[0] == 45


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_products_by_blocks_keep_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(products, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(products, "BLOCK_ROWS", 7)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i * 7 % 5), float(i * 3 % 4), 1.0]) for i in range(60)] + [(100, [nan, 1.0, 0.0]), (150, [inf, 1.0, 0.0]), (200, None), (203, [None, 1.0, 1.0]), (204, [1.0]), (None, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0")
    key = lambda s: (2, 0.0) if s is None else (0, 0.0) if s != s else (1, -round(s, 9))

    def dot(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        return sum(x * y for x, y in zip(a, b, strict=True))

    want = []
    for q, v in ((q, v) for q, v in rows if q is not None and q % 50 == 0):
        found = sorted(((key(dot(v, w)), i) for i, w in rows if i is not None and i != q))[:4]
        want += [(q, rk, i) for rk, (_, i) in enumerate(found, 1)]
    got = R.cosine_search(df, asked, 4)
    assert sorted((r.qid, r.rk, r.vec_id) for r in got.collect()) == sorted(want)


def test_no_plan_of_all_pairs_of_vectors(spark, tmp_path):
    spark.createDataFrame([(i, [i % 3 * 1.0, 1.0]) for i in range(120)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("cosine_topk", "cosine_threshold"):
        plan = plan_of(catalog.QUERIES[name](spark, str(tmp_path)))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_hashed_search_gives_the_rows_of_the_join(spark, monkeypatch):
    monkeypatch.setattr(products, "TOGETHER", 64)
    words = "alpha beta gamma delta épsilon zeta eta theta".split()
    text = lambda i: " ".join(words[j % 8] for j in range(i % 7, i % 7 + i % 5))
    docs = spark.createDataFrame([(i, text(i)) for i in range(90)] + [(5, "beta beta zeta"), (200, None), (201, ""), (None, "alpha"), (None, "beta")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha beta beta"), (2, "épsilon theta"), (3, None), (4, "nothing here")], "item_id long, text string")
    rows = lambda df: sorted(((r.qid, r.rk, r.doc_id, round(r.score, 9)) for r in df.collect()), key=str)
    want = rows(R.top_k(R.hashed_cosine(docs, asked, dim=16), 6))
    assert want and rows(R.hashed_search(docs, asked, 6, dim=16)) == want
    monkeypatch.setattr(R, "BROADCAST_TERMS", 2)
    assert rows(R.hashed_search(docs, asked, 6, dim=16)) == want


def test_bm25_search_gives_the_rows_of_the_join_and_passes_on_the_best(spark, monkeypatch):
    monkeypatch.setattr(products, "TOGETHER", 64)
    words = "alpha beta gamma delta épsilon zeta eta theta".split()
    text = lambda i: " ".join(words[j % 8] for j in range(i % 7, i % 7 + i % 5))
    docs = spark.createDataFrame([(i, text(i)) for i in range(90)] + [(5, "beta beta zeta"), (5, "zeta beta eta"), (6, "x"), (200, None), (201, ""), (None, "alpha"), (None, "beta beta")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha beta beta"), (2, "épsilon theta unheard"), (3, None), (4, "nothing here"), (None, "zeta")], "item_id long, text string")
    rows = lambda df: sorted(((r.qid, r.rk, r.doc_id, round(r.score, 9)) for r in df.collect()), key=str)
    for k, least in ((6, 0.0), (1, 0.0), (500, 0.0), (6, 2.0)):
        want = rows(R.top_k(R.bm25_scores(docs, asked).where(F.col("score") >= least), k))
        assert want and rows(R.bm25_search(docs, asked, k, least)) == want
    plan = plan_of(R.bm25_search(docs, asked, 6))
    assert "MapInArrow" in plan and "Generate" not in plan  # pairs of document and query are no rows
    assert R.bm25_search(docs.where("doc_id < 0"), asked, 6).count() == 0 and R.bm25_search(docs, asked.where("item_id = 3"), 6).count() == 0
    monkeypatch.setattr(R, "DENSE", 2)
    assert rows(R.bm25_search(docs, asked, 6)) == rows(R.top_k(R.bm25_scores(docs, asked), 6)) and "Generate" in plan_of(R.bm25_search(docs, asked, 6))


def test_what_is_kept_of_blocks_is_the_best_of_all(monkeypatch):
    rng = np.random.default_rng(0)
    for k in (1, 3, 40):
        scores = rng.integers(-2, 6, (300, 7)) / 4.0
        top = products.Best(7, k)
        top.most = 50
        for i in range(0, 300, 25):
            top.add(list(range(1000 + i, 1000 + i + 25)), scores[i : i + 25])
        top.prune()
        for q in range(7):
            got = sorted((-s, top.ids[p]) for x, s, p in zip(top.q.tolist(), top.s.tolist(), top.p.tolist(), strict=True) if x == q)
            assert got[:k] == sorted((-s, 1000 + i) for i, s in enumerate(scores[:, q].tolist()) if s > 0)[:k] and len(got) <= 2 * max(k, 5 * k)


def test_two_rankings_cut_the_corpus_into_tokens_once(spark):
    docs = spark.createDataFrame([(1, "alpha b beta")], "doc_id long, text string").mapInArrow(lambda x: x, "doc_id long, text string")
    assert R.tokenised(docs).sameSemantics(R.tokenised(docs))
    odd = [("a bb _c d9 9",), ("",), (None,), ("é éé İi x\u0301x",), ("𝒜 𝒜𝒜 a𝒜",)]
    plain = F.filter(F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda t: F.length(t) >= 2)
    for r in spark.createDataFrame(odd, "t string").select(T.tokens(F.col("t")).alias("x"), plain.alias("y")).collect():
        assert r.x == r.y


def test_texts_of_ranked_rows_leave_the_corpus_where_it_is(spark):
    large = lambda df: df.mapInArrow(lambda x: x, df.schema)  # noqa: E731  (the planner does not know its size)
    docs = large(spark.createDataFrame([(i, f"text {i}", "title") for i in range(9)], "doc_id long, text string, title string"))
    ranked = large(spark.createDataFrame([(1, 3, 1, 0.5), (2, 3, 1, 0.4), (2, 99, 2, 0.1)], "qid long, doc_id long, rk int, score double"))
    out = answers.with_texts(ranked, docs, 3)
    assert "BroadcastHashJoin" in plan_of(out) and sorted((r.qid, r.content) for r in out.collect()) == [(1, "text 3"), (2, "text 3")]


def test_parts_of_the_corpus_grow_with_it(spark, monkeypatch):
    monkeypatch.setattr(R, "PART_CHARS", 1_000, raising=False)
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(400)], "doc_id long, text string")
    assert R.tokenised(docs).rdd.getNumPartitions() == 40


def test_appended_lists_are_read_once(spark):
    a = spark.createDataFrame([(1, 10, 1, 0.9)], "qid long, doc_id long, rk int, score double").repartition(3, "qid").mapInArrow(lambda x: x, "qid long, doc_id long, rk int, score double")
    assert plan_of(U.appended(a, a.where("doc_id > 10"), 5)).count("MapInArrow") <= 2


def test_pairs_of_a_band_are_of_sizes_that_can_be_similar(spark, monkeypatch):
    monkeypatch.setattr(edit_fingerprint, "BLOCK_MEMBERS", 5)
    sizes = [1 + i * i // 7 for i in range(80)]
    entries = spark.createDataFrame([(i * 37 % 80, s, "ab" * edit_fingerprint.SLOTS) for i, s in enumerate(sizes)], "key long, size long, fingerprint string")
    want = {tuple(sorted((i * 37 % 80, j * 37 % 80))) for i, a in enumerate(sizes) for j, b in enumerate(sizes[:i]) if a - b <= 0.01 * a + 1e-9}
    got = edit_fingerprint._near(entries, True, lambda pairs: pairs).collect()
    assert want and len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_case_features_lower_the_text_once(spark):
    rows = [("BP: 180/110, HR 120. temp 39.5, SPO2 88% on room air",), ("Known asthma, PLT 90, taking aspirin 75 mg daily, on insulin 5 units",), ("known  ;platelets: 12 g/dl, x10 4 x10^9",), ("",), (None,)]
    df = spark.createDataFrame(rows, "case_text string")
    out = tagging.case_features(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1 and "low" not in out.columns
    first = lambda text, ps: next((m[1] for p in ps for m in [re.search("(?i)" + p, text)] if m and m[1]), None)
    for r in out.where("case_text is not null").collect():
        assert r.vitals == {k: v for k, ps in rules.VITALS.items() if (v := first(r.case_text, ps))} and r.labs == {k: v for k, ps in rules.LABS.items() if (v := first(r.case_text, ps))}
        named = [w.strip() for p in rules.MEDICATION_FORMS for w in re.findall(p, r.case_text.lower())]
        assert r.medications == sorted({t for t in rules.MEDICATIONS if t in r.case_text.lower()} | {w for w in named if len(w) > 3})
