"""The question-answering plan: questions -> variants -> two ranked lists, fused -> context -> evidence -> answer ->
second looks, vote, grounding and safety.

A batch of questions is one plan. Ranked rows are cut once (they feed several steps); texts are joined to ranked
rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import adjust, calibration, evidence, fusion, quality_checks, rerank, retrieval, safety, understanding


def ranked_for(questions: DataFrame, docs: DataFrame, k: int = 25, text: str = "question") -> DataFrame:
    """qid, doc_id, rk, score over up to four variants of each question; a document keeps its first variant's score."""
    v = understanding.variants(questions.select("qid", F.col(text).alias("text")))
    v = v.select(F.concat_ws("#", "qid", "variant").alias("vid"), "qid", "variant", "variant_text")
    found = retrieval.bm25_search(docs, v, k, query_id="vid", query_text="variant_text").withColumnRenamed("qid", "vid").join(v.select("vid", "qid", "variant"), "vid")
    first = F.row_number().over(W.partitionBy("qid", "doc_id").orderBy("variant", "rk"))
    one = found.withColumn("turn", first).where("turn = 1").select("qid", "doc_id", "score")
    return retrieval.top_k(one, k)


def with_texts(ranked: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """Ranked rows, at most so many, with content and title. The corpus stays where it is."""
    return docs.select("doc_id", F.col("text").alias("content"), "title").join(retrieval.sized(ranked, most), "doc_id")


def second_looks(options: DataFrame, kept: DataFrame) -> DataFrame:
    """qid, minimal, fallback: the option that the two best texts hold most of, and the one that word counts over the
    whole context choose."""
    pairs = options.join(kept, "qid")
    held = pairs.where("rk <= 2").groupBy("qid", "label").agg(F.avg(quality_checks.option_in_context(F.col("option"), F.lower("content"))).alias("held"))
    minimal = held.groupBy("qid").agg(F.max_by("label", F.struct(F.round("held", 9), -F.ascii("label"))).alias("minimal"))
    texts = kept.groupBy("qid").agg(F.concat_ws(" ", F.collect_list("content")).alias("context"))  # a few texts to a question
    chosen = quality_checks.fallback_choice(options.join(texts, "qid")).select("qid", F.col("selected").alias("fallback"))
    return minimal.join(chosen, "qid", "full_outer")


def answered(questions: DataFrame, docs: DataFrame, *, k: int = 25, context: int = 3, temperature: float = 1.5, dim: int = 1024) -> DataFrame:
    """qid, selected, confidence, margin, n_sources, votes, grounded, safety, is_correct (null without a correct answer).

    Documents are ranked by BM25 over the variants of a question and by hashed vectors, fused by weight. The answer
    is the one that two of three ways of looking agree on, else that of the evidence; its confidence is calibrated,
    lowered by doubts, missing grounds, danger and disagreement.

    questions: qid, question, case_description, options map<label,text>, correct_answer (may be null). docs:
    doc_id, text, title. A question without any ranked document cannot be answered (confidence 0).
    """
    asked = questions.select("qid", "question")
    vectors = retrieval.hashed_search(docs, asked, k, query_id="qid", query_text="question", dim=dim)
    ranked = fusion.linear(vectors, ranked_for(questions, docs, k), k)
    rows = with_texts(ranked, docs, k * questions.count()).join(questions.select("qid", "question"), "qid")
    words = F.array_distinct(F.filter(F.split(F.lower("question"), r"\s+"), lambda w: F.length(w) > 4))
    kept = cut(rerank.pruned(rows, words, context, 0.0).select("qid", "doc_id", "content", "title", "rk"))
    options = questions.select("qid", F.explode("options").alias("label", "option"))
    scored = evidence.option_scores(evidence.pair_scores(options.join(kept, "qid")))
    chosen = evidence.choose(scored).withColumnRenamed("selected", "first").join(second_looks(options, kept), "qid")
    vote = adjust.agreement(F.col("first"), F.col("minimal"), F.col("fallback"))
    chosen = chosen.withColumn("vote", vote).withColumns({"selected": F.col("vote.answer"), "votes": F.col("vote.votes")}).drop("first", "minimal", "fallback", "vote")
    chosen = chosen.join(scored.select("qid", F.col("label").alias("selected"), "total", "n_sources"), ["qid", "selected"])
    # At most `context` texts to a question.
    texts = kept.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rk", "content"))), lambda x: x["content"]), " ").alias("texts"))
    out = questions.join(chosen, "qid", "left").join(texts, "qid", "left")
    raw = calibration.combined(F.coalesce("confidence", F.lit(0.0)), F.coalesce("total", F.lit(0.0)), F.coalesce("n_sources", F.lit(0)), temperature)
    picked = F.try_element_at("options", F.col("selected"))
    others = F.map_values(F.map_filter("options", lambda l, _: l != F.col("selected")))
    d = adjust.doubts(F.col("question"), F.coalesce("case_description", F.lit("")), F.coalesce(picked, F.lit("")), F.coalesce(others, F.array().cast("array<string>")), F.coalesce("texts", F.lit("")))
    out = out.withColumns({"confidence": adjust.after_doubts(raw, d), "picked": F.coalesce(picked, F.lit("")), "grounded": evidence.grounded(F.coalesce(picked, F.lit("")), F.coalesce("texts", F.lit("")))})
    cases = out.select("qid", F.concat_ws(" ", "case_description", "question").alias("case_text"), F.col("picked").alias("answer"), F.lit(None).cast("string").alias("category"))
    out = out.join(safety.assessed(cases, safety.rule_violations(cases)).select("qid", F.col("level").alias("safety"), "safe"), "qid")
    dangerous = F.col("safety").isin("DANGEROUS", "CRITICAL")
    confidence = adjust.finished(F.col("confidence"), F.col("grounded"), F.col("safe"), dangerous, F.coalesce(F.col("votes") >= 2, F.lit(False)))
    none = F.col("selected").isNull()
    correct = F.when(F.col("correct_answer").isNotNull(), F.upper(F.coalesce("selected", F.lit(""))) == F.upper("correct_answer"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "qid", F.when(none, "Cannot answer").otherwise(F.col("selected")).alias("selected"), F.when(none, 0.0).otherwise(confidence).alias("confidence"), F.coalesce("margin", F.lit(0.0)).alias("margin"),
        zero("n_sources").alias("n_sources"), zero("votes").alias("votes"), F.coalesce(F.col("grounded") & ~none, F.lit(False)).alias("grounded"), "safety", correct.alias("is_correct"),
    )
