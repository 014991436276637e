"""Fusion of ranked lists (qid, doc_id, rk, score): outer joins, priorities and merges. Lists are short: top-k rows per query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .retrieval import top_k


def outer(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both lists side by side: a_rk, a_score, b_rk, b_score; ranks null and scores 0 where a list lacks the row."""
    x = a.select("qid", "doc_id", F.col("rk").alias("a_rk"), F.col("score").alias("a_score"))
    y = b.select("qid", "doc_id", F.col("rk").alias("b_rk"), F.col("score").alias("b_score"))
    return x.join(y, ["qid", "doc_id"], "full_outer").withColumns({"a_score": F.coalesce("a_score", F.lit(0.0)), "b_score": F.coalesce("b_score", F.lit(0.0))})


def reciprocal_rank(a: DataFrame, b: DataFrame, k: int, *, weights: tuple[float, float] = (0.5, 0.5), constant: int = 60) -> DataFrame:
    part = lambda w, r: F.coalesce(F.lit(w) / (constant + F.col(r)), F.lit(0.0))
    return top_k(outer(a, b).withColumn("score", part(weights[0], "a_rk") + part(weights[1], "b_rk")), k)


def linear(a: DataFrame, b: DataFrame, k: int, weights: tuple[float, float] = (0.65, 0.35)) -> DataFrame:
    """Weighted sum of raw scores."""
    return top_k(outer(a, b).withColumn("score", weights[0] * F.col("a_score") + weights[1] * F.col("b_score")), k)


def prioritised(first: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """Rows of first that are in other too, then the rest of first; both in the order of first."""
    found = first.join(other.select("qid", "doc_id", F.lit(1).alias("both")), ["qid", "doc_id"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    order = W.partitionBy("qid").orderBy(F.col("both").desc(), F.col("rk").asc())
    return found.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select("qid", "rk", "doc_id", "score", "both")


def best_of(a: DataFrame, b: DataFrame, k: int, tags: tuple[str, str] = ("bm25", "faiss")) -> DataFrame:
    """The larger score of either list, and which lists have the row."""
    tag = F.concat_ws("+", F.when(F.col("a_rk").isNotNull(), tags[0]), F.when(F.col("b_rk").isNotNull(), tags[1]))
    return top_k(outer(a, b).withColumn("score", F.greatest("a_score", "b_score")).withColumn("found_by", tag), k).select("qid", "rk", "doc_id", "score", "found_by")


def concatenated(lists: list[DataFrame]) -> DataFrame:
    """Variant results one after the other: variant, rk and at, the place in the whole (from 0)."""
    every = reduce(DataFrame.unionByName, (x.select("qid", "doc_id", "rk", "score").withColumn("variant", F.lit(i)) for i, x in enumerate(lists)))
    return every.withColumn("at", F.row_number().over(W.partitionBy("qid").orderBy("variant", "rk")) - 1)


def first_seen(lists: list[DataFrame], k: int, best: bool = False) -> DataFrame:
    """One row per document, with the score of the first variant that has it (or, if asked, the best score)."""
    order = [F.col("score").desc(), F.col("at").asc()] if best else [F.col("at").asc()]
    one = concatenated(lists).withColumn("turn", F.row_number().over(W.partitionBy("qid", "doc_id").orderBy(*order))).where("turn = 1")
    return top_k(one.drop("rk"), k).select("qid", "rk", "doc_id", "score", "variant")


def variant_fusion(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Sum over occurrences of 1 / (constant + place + 1) + 0.3 score, halved and at most 1."""
    part = 1 / (F.col("at") + constant + 1) + 0.3 * F.col("score")
    return top_k(concatenated(lists).groupBy("qid", "doc_id").agg(F.least(F.lit(1.0), F.sum(part) / 2).alias("score")), k).select("qid", "rk", "doc_id", "score")


def appended(ranked: DataFrame, more: DataFrame, k: int, factor: float = 1.2) -> DataFrame:
    """Rows of more that ranked lacks, at factor times their score, ranked together with the rest."""
    # Each list is read once.
    score = F.when(F.col("a_rk").isNotNull(), F.col("a_score")).otherwise(F.col("b_score") * factor)
    return top_k(outer(ranked, more).select("qid", "doc_id", score.alias("score")), k).select("qid", "rk", "doc_id", "score")


def quota(ranked: DataFrame, matched: str, k: int) -> DataFrame:
    """Matched rows first, filled up with the others, each by score."""
    order = W.partitionBy("qid").orderBy(F.col(matched).desc(), F.round("score", 9).desc(), F.col("doc_id").asc())
    return ranked.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)
