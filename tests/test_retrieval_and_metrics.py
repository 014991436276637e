"""Hand-computed fixtures and small brute-force checks for retrieval, fusion, metrics and calibration."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators import calibration as C
from tarn.operators import fusion as U
from tarn.operators import metrics as M
from tarn.operators import retrieval as R


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


DOCS = [(1, "Heart attack and heart failure"), (2, "stroke of the brain"), (3, ""), (4, None), (5, "Éclair heart naïve_token x"), (6, "heart heart heart stroke")]


def bm25(query, k1=1.5, b=0.75):
    import re

    toks = {i: [w for w in re.findall(r"\b\w+\b", (t or "").lower()) if len(w) >= 2] for i, t in DOCS}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for ws in toks.values() for w in set(ws))
    out = {}
    for i, ws in toks.items():
        tf = Counter(ws)
        s = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ws) / avg)) for w in query.lower().split() if tf[w])
        if s:
            out[i] = s
    return out


def test_bm25_by_brute_force_with_repeated_query_terms(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "heart heart stroke"), (2, "éclair"), (3, "nothing here"), (4, "")], "item_id long, text string")
    got = {(r.qid, r.doc_id): r.score for r in R.bm25_scores(docs, queries).collect()}
    want = {(q, d): s for q, t in ((1, "heart heart stroke"), (2, "éclair")) for d, s in bm25(t).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    top = R.bm25_search(docs, queries, 2)
    full = R.padded(top, docs, queries, 3).collect()
    assert Counter(r.qid for r in full) == {1: 3, 2: 3, 3: 3, 4: 3}
    assert [r.doc_id for r in sorted(full, key=lambda r: (r.qid, r.rk)) if r.qid == 4] == [1, 2, 3]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "qid long, doc_id long, rk int, score double")


def test_fusions(spark):
    a, b = ranked(spark, [(1, 10, 1, 0.9), (1, 11, 2, 0.5)]), ranked(spark, [(1, 11, 1, 7.0), (1, 12, 2, 3.0)])
    rrf = {r.doc_id: r.score for r in U.reciprocal_rank(a, b, 5).collect()}
    assert rrf[11] == pytest.approx(0.5 / 62 + 0.5 / 61) and rrf[10] == pytest.approx(0.5 / 61)
    swapped = {r.doc_id: r.score for r in U.reciprocal_rank(b, a, 5).collect()}
    assert rrf == pytest.approx(swapped)
    assert {r.doc_id: r.score for r in U.linear(a, b, 5).collect()} == pytest.approx({10: 0.585, 11: 0.325 + 2.45, 12: 1.05})
    assert [(r.doc_id, r.both) for r in U.prioritised(a, b, 5).orderBy("rk").collect()] == [(11, 1), (10, 0)]
    assert {r.doc_id: r.found_by for r in U.best_of(b, a, 5).collect()} == {10: "faiss", 11: "bm25+faiss", 12: "bm25"}
    assert {r.doc_id: r.score for r in U.first_seen([a, b], 5).collect()}[11] == 0.5
    assert {r.doc_id: r.score for r in U.first_seen([a, b], 5, best=True).collect()}[11] == 7.0
    assert {r.doc_id: r.score for r in U.appended(a, b, 5).collect()} == pytest.approx({10: 0.9, 11: 0.5, 12: 3.6})
    tie = R.top_k(ranked(spark, [(1, 5, 1, 0.5), (1, 3, 2, 0.5)]).drop("rk"), 2).orderBy("rk").collect()
    assert [r.doc_id for r in tie] == [3, 5]


def test_retrieval_metrics(spark):
    rows = ranked(spark, [(1, d, i, 1.0 - i / 10) for i, d in enumerate((1, 2, 3, 4, 5), 1)])
    rel = spark.createDataFrame([(1, 1), (1, 3), (1, 9), (2, 4)], "qid long, doc_id long")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    judged = M.judged(rows, rel, queries)
    at = {r.qid: r for r in M.at_k(judged, (1, 3, 10)).collect()}
    assert (at[1].p_1, at[1].r_3, at[1].p_10) == (1.0, pytest.approx(2 / 3), pytest.approx(2 / 5))
    assert (at[2].p_3, at[2].r_3, at[3].p_1, at[3].r_1) == (0, 0, 0, 0)
    ap = {r.qid: (r.ap, r.rr) for r in M.average_precision(judged).collect()}
    assert ap[1] == (pytest.approx((1 + 2 / 3) / 3), 1.0) and ap[2] == ap[3] == (0, 0)
    mixed = M.interleaved(rows.withColumn("g", F.when(F.col("doc_id") < 3, "A").otherwise("B")), "g").orderBy("rk").collect()
    assert [r.id for r in mixed] == ["A_1", "A", "A_2", "B_3", "B", "B_4", "B_5"]


def test_bins_are_those_of_linspace(spark):
    assert np.linspace(0, 1, 11).tolist() == list(M.EDGES)
    cs = [0.0, 0.3, 0.6, 0.7, 1.0, 0.95, -0.1]
    got = [r.b for r in spark.createDataFrame([(i, c) for i, c in enumerate(cs)], "i int, c double").orderBy("i").select(M.bin_of(F.col("c")).alias("b")).collect()]
    assert got == [0, 2, 5, 6, None, 9, None]


def test_calibration_error_and_brier(spark):
    rows = [(0.95, True), (0.95, False), (1.0, True), (0.15, False)]
    df = spark.createDataFrame(rows, "confidence double, is_correct boolean")
    assert M.calibration_error(df).first().ece == pytest.approx((2 * abs(0.5 - 0.95) + abs(0 - 0.15)) / 4)
    assert M.brier(df).first().brier == pytest.approx(np.mean([(c - o) ** 2 for c, o in rows]))
    assert M.brier(df.limit(0)).first().brier == 1.0
    grid = {round(r.t, 1): r.ece for r in C.temperature_grid(df).collect()}
    assert len(grid) == 20 and grid[1.0] == pytest.approx(M.calibration_error(df).first().ece)


def test_confusion_and_classes(spark):
    rows = [("A", "A"), ("A", "B"), ("B", "B"), ("B", "Cannot answer"), ("C", "A")]
    df = spark.createDataFrame(rows, "correct_answer string, selected_answer string")
    m = {(r.actual, r.predicted): r.n for r in M.confusion(df, ("A", "B", "C")).collect()}
    assert m == {("A", "A"): 1, ("A", "B"): 1, ("B", "B"): 1, ("B", "UNK"): 1, ("C", "A"): 1}
    compat = {(r.actual, r.predicted): r.n for r in M.confusion(df, ("A", "B", "C"), compat=True).collect()}
    assert compat[("B", "B")] == 2
    c = {r.label: r for r in M.per_class(M.confusion(df, ("A", "B", "C")), ("A", "B", "C")).collect()}
    assert (c["A"].tp, c["A"].fp, c["A"].fn, c["A"].tn) == (1, 1, 1, 2) and c["C"].f1 == 0 and c["B"].recall == 0.5


def test_reasoning_summary(spark):
    rows = [("A", "A", 0.9, True, 3, 2, "CoT"), ("B", "A", 0.85, False, 1, 0, "ToT"), ("Cannot answer", "C", 0.1, False, 0, 0, "ToT")]
    df = spark.createDataFrame(rows, "selected_answer string, correct_answer string, confidence double, is_correct boolean, n_steps int, n_evidence int, method string")
    r = M.reasoning_summary(df).first()
    assert r.exact_match == pytest.approx(1 / 3) and r.chain_completeness == pytest.approx(1.4 / 3)
    assert r.hallucination_rate == 0.5 and r.cannot_answer_misuse == pytest.approx(1 / 3) and r.cot_tot_delta == -1
    assert r.dangerous_errors == 1 and r.safety_score == pytest.approx(2 / 3)
    assert r.evidence_utilisation == pytest.approx(1 / 3 * (2 / 3) / 2)


def test_sentences_and_tokens(spark):
    t = "Dr. Smith came. He saw e.g. A case! mail me@x.org? Yes"
    assert one(spark, T.sentences(F.col("t")), t=t) == ["Dr. Smith came.", "He saw eg. A case! mail me.x.org?", "Yes"]
    assert one(spark, T.tokens(F.col("t")), t="Éa b_c d 12 x Ünï") == ["éa", "b_c", "12", "ünï"]
    assert one(spark, T.scenario_hash(F.col("t")), t="Age  45\nX") == one(spark, T.scenario_hash(F.col("t")), t="age 9 x")
    assert one(spark, T.excerpt(F.lit("needle"), F.col("t"), 20), t="a" * 50 + "needle" + "b" * 50).startswith("...a")
    assert one(spark, T.bounded(F.col("t"), ("the", "then")), t="then the other") == ["the", "then"]


def test_similarity_join_loses_no_pair_and_tries_few(spark):
    """All pairs over the threshold by brute force, with fewer tried than share a dimension."""
    import math
    import random

    from tarn.operators import semantic_match as S

    rng = random.Random(3)
    side = lambda n, most: {i: {b: rng.random() for b in rng.sample(range(40), rng.randint(1, most))} for i in range(n)}
    unit = lambda rows: {i: {b: w / math.sqrt(sum(x * x for x in v.values())) for b, w in v.items()} for i, v in rows.items()}
    a, b = unit(side(60, 4)), unit(side(200, 12))
    frame = lambda rows, k: spark.createDataFrame([(1 if i % 3 else 2, i, d, w) for i, v in rows.items() for d, w in v.items()], f"qid long, {k} long, bucket long, w double")
    fa, fb = frame(a, "x"), frame(b, "y")
    group = lambda i: 1 if i % 3 else 2
    cos = {(x, y): sum(w * b[y].get(d, 0) for d, w in a[x].items()) for x in a for y in b if group(x) == group(y)}
    for least in (0.25, 0.6, 0.9):
        got = {(r.x, r.y): r.similarity for r in S.near(fa, fb, ["qid", "x"], ["qid", "y"], least).collect()}
        want = {k: v for k, v in cos.items() if round(v, 9) >= least}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        tried = S.near_candidates(fa, fb, ["qid", "x"], ["qid", "y"], least).count()
        assert len(want) <= tried < sum(v > 0 for v in cos.values())


def test_matches_of_nulls_and_empties(spark):
    from tarn.operators import option_match as O
    from tarn.operators import semantic_match as S

    passages = spark.createDataFrame([(1, 1, None), (1, 2, ""), (1, 3, "Treatment: aspirin 75 mg daily.\nAvoid it.")], "qid long, doc_id long, content string")
    options = spark.createDataFrame([(1, "A", None), (1, "B", ""), (1, "C", "Aspirin 75 mg orally")], "qid long, label string, option string")
    found = {(r.label, r.doc_id, r.term, r.similarity) for r in S.semantic_matches(passages, options, 0.6).collect()}
    assert found == {("C", 3, "aspirin", 1.0), ("C", 3, "mg", 1.0)}
    pairs = O.prepared(passages).join(options, "qid").selectExpr("*", "true as initial")
    got = {(r.label, r.doc_id): r for r in O.pair_tiers(pairs).collect()}
    assert len(got) == 9 and got["C", 3].tier == "drug" and got["C", 3].tier_score == 0.99 and got["C", 3].context == 1.3
    assert got["C", 2].tier is None and got["B", 2].tier == "exact" and not got["A", 1].against
    assert O.matches(pairs.limit(0)).count() == 0
