"""Index statistics and ranked retrieval for many queries at once: BM25, exact inner products, sparse cosines.

A query is a row, never a call. A plan reads the documents and cuts them into tokens once; the tokens are dealt by
document, so that scores are added up where the document is and only pairs of query and document go on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from .products import bm25_best, hashed_best, nearest_in_blocks

K1, B = 1.5, 0.75
#: Terms of queries that are broadcast at most (tens of MB); more are joined by shuffle.
BROADCAST_TERMS = 200_000
#: Asked terms by queries that a task holds as a matrix (128 MB) at most; more are joined.
DENSE = 1 << 24
#: Characters of text that a task takes; what a task holds stays as it is when the corpus grows.
PART_CHARS = 16_000_000


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of documents, mean and total length in tokens (empty documents count)."""
    n = F.size(tokens(F.col(text)))
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.coalesce(n, F.lit(0))).alias("avgdl"), F.sum(F.coalesce(n, F.lit(0))).alias("n_tokens"))


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def listed(df: DataFrame, array: Column, name: str, *keep) -> DataFrame:
    """A row for each element of an array. The plain explode lets the planner filter by the array first, which works
    the array out twice, and keeps equal exchanges below it from being one."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def term_idf(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """term, df, idf for every term. Each document sends a term once, so the shuffle is of distinct terms."""
    terms = listed(docs, F.array_distinct(tokens(F.col(text))), "term")
    return terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # one row


def sized(df: DataFrame, rows: int) -> DataFrame:
    """The side of the queries for a join with the corpus: broadcast up to a bound, else merged. Left to its estimates
    the planner may take the corpus side for the smaller one."""
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df.hint("merge")


def query_terms(queries: DataFrame, id_: str, text: str) -> DataFrame:
    """qid, term, times: how often a query names a term."""
    return listed(queries, tokens(F.col(text)), "term", F.col(id_).alias("qid")).groupBy("qid", "term").agg(F.count("*").alias("times"))


def tokenised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chars: int | None = None) -> DataFrame:
    """doc_id, known: the tokens of every document, dealt by id. All that is counted per document starts here, so one
    plan cuts the corpus into tokens once (the exchange is reused) and what is added up by document and query is
    added up where the document is. The parts are as many as the length of the corpus (chars, if known) asks for."""
    if chars is None:
        chars = docs.agg(F.sum(F.length(text)).alias("n")).first()["n"] or 0
    parts = max(-(-chars // PART_CHARS), min(docs.sparkSession.sparkContext.defaultParallelism, chars // (PART_CHARS // 16)), 1)
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("known")).repartition(int(parts), "doc_id")


def bm25_scores(docs: DataFrame, queries: DataFrame, *, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """qid, doc_id, score for every pair that shares a term; a query's term counts as often as it names it."""
    asked = query_terms(queries, query_id, query_text)
    n_asked = asked.count()
    held, wanted = tokenised(docs, doc_id, text), sized(asked.select("term").distinct(), n_asked)
    stats = held.agg(F.count("*").alias("n"), F.avg(F.size("known")).alias("avgdl"))
    df = listed(held, F.array_distinct("known"), "term").join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weighted = asked.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    weighted = weighted.select("qid", "term", "times", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    postings = listed(held, F.col("known"), "term", "doc_id", F.size("known").alias("dl")).join(wanted, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return postings.join(sized(weighted, n_asked), "term").groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, *, by: str = "score", ties: str = "doc_id", query: str = "qid") -> DataFrame:
    """Adds rk and keeps ranks up to k; scores equal to nine places are ties, which go to the smaller id."""
    order = W.partitionBy(query).orderBy(F.round(by, 9).desc(), F.col(ties).asc())
    return scored.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def counted(docs: DataFrame, terms: list[str], text: str = "text") -> tuple[int, float, int, dict[str, int]]:
    """Number, mean length in tokens and characters of the documents, and how many hold each of the terms, in one pass.
    Every document sends an empty term too, which no token is."""
    wanted = docs.sparkSession.createDataFrame([(t,) for t in ["", *terms]], "term string").coalesce(1)
    held = docs.select(F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("known"), F.coalesce(F.length(text), F.lit(0)).alias("chars"))
    sent = listed(held, F.array_append(F.array_distinct("known"), F.lit("")), "term", F.size("known").alias("dl"), "chars")
    sums = sent.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"), F.sum("dl").alias("dl"), F.sum("chars").alias("chars"))  # as many as terms
    found = {r["term"]: r for r in sums.collect()}
    n, dl, chars = (found[""]["n"], found[""]["dl"], found[""]["chars"]) if found else (0, 0, 0)
    return n, dl / n if n else 0.0, chars, {t: r["n"] for t, r in found.items() if t}


def bm25_search(docs: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.0, *, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """qid, rk, doc_id, score. Documents without a shared term score 0 and are not ranked here; see padded().

    bm25_scores() of the k best documents of each query. Up to BROADCAST_TERMS terms of queries, and DENSE of terms by
    queries, are given to the tasks, which pass on their best documents alone; more are joined."""
    asked = query_terms(queries, query_id, query_text)
    rows = asked.limit(BROADCAST_TERMS + 1).collect()
    terms = list(dict.fromkeys(r["term"] for r in rows))
    if len(rows) > BROADCAST_TERMS or len(terms) * len({r["qid"] for r in rows}) > DENSE:
        scored = bm25_scores(docs, queries, doc_id=doc_id, text=text, query_id=query_id, query_text=query_text, k1=k1, b=b)
    else:
        n, avgdl, chars, df = counted(docs, terms, text)
        weights = [{"id": r["qid"], "term": r["term"], "w": r["times"] * math.log((n - df[r["term"]] + 0.5) / (df[r["term"]] + 0.5) + 1)} for r in rows if r["term"] in df]
        scored = bm25_best(tokenised(docs, doc_id, text, chars), weights, avgdl, k, asked.schema["qid"].dataType, k1, b)
    return top_k(scored.where(F.col("score") >= threshold), k).select("qid", "rk", "doc_id", "score")


def padded(ranked: DataFrame, docs: DataFrame, queries: DataFrame, k: int, query_id: str = "item_id") -> DataFrame:
    """Ranks below k filled up with the first documents that match nothing, at score 0, in id order.

    Only the k smallest ids can be needed beyond those that are ranked, so 2 k ids stand for all documents.
    """
    first = docs.select("doc_id").orderBy("doc_id").limit(2 * k)
    blank = queries.select(F.col(query_id).alias("qid")).crossJoin(F.broadcast(first)).join(ranked.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    return top_k(ranked.select("qid", "doc_id", "score").unionByName(blank.withColumn("score", F.lit(0.0))), k).select("qid", "rk", "doc_id", "score")


def cosine_search(vectors: DataFrame, queries: DataFrame, k: int = 5, threshold: float | None = None, *, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """qid, rk, vec_id, score by exact inner product; the threshold applies after the rank, as in the index.

    A stated query set against all rows, as products of blocks: a task holds some thousands of queries and rows, and
    the best of each block go on.
    """
    scored = nearest_in_blocks(vectors, queries, k, id_=id_, vector=vector).withColumnRenamed("id", "vec_id")
    out = top_k(scored, k, ties="vec_id").select("qid", "rk", "vec_id", "score")
    return out if threshold is None else out.where(F.col("score") >= threshold)


def bucket(term: Column, dim: int) -> Column:
    return F.conv(F.substring(F.md5(term), 1, 7), 16, 10).cast("bigint") % dim


def hashed_vectors(df: DataFrame, id_: str, text: str, dim: int) -> DataFrame:
    """id, bucket, w: term counts in dim hash buckets, of unit length. The default embedding without a model."""
    terms = listed(tokenised(df, id_, text), F.col("known"), "term", F.col("doc_id").alias("id")).groupBy("id", "term").agg(F.count("*").alias("n"))
    counts = terms.groupBy("id", bucket(F.col("term"), dim).alias("bucket")).agg(F.sum("n").alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))
    return counts.select("id", "bucket", (F.col("w") / norm).alias("w"))


def hashed_cosine(docs: DataFrame, queries: DataFrame, *, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", dim: int = 4096) -> DataFrame:
    """qid, doc_id, score: cosine of hashed term vectors, for pairs that share a bucket."""
    q = hashed_vectors(queries, query_id, query_text, dim).select(F.col("id").alias("qid"), "bucket", F.col("w").alias("qw"))
    d = hashed_vectors(docs, doc_id, text, dim).select(F.col("id").alias("doc_id"), "bucket", "w")
    return d.join(sized(q, q.count()), "bucket").groupBy("qid", "doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))


def hashed_search(docs: DataFrame, queries: DataFrame, k: int, *, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", dim: int = 4096) -> DataFrame:
    """hashed_cosine() of the k best documents of each query, with rk. Up to BROADCAST_TERMS entries of queries are given to
    the tasks, which pass on their best documents alone; more are joined."""
    q = hashed_vectors(queries, query_id, query_text, dim)
    weights = q.limit(BROADCAST_TERMS + 1).collect()
    if len(weights) > BROADCAST_TERMS:
        return top_k(hashed_cosine(docs, queries, doc_id=doc_id, text=text, query_id=query_id, query_text=query_text, dim=dim), k)
    return top_k(hashed_best(tokenised(docs, doc_id, text), weights, k, dim, q.schema["id"].dataType), k)


def holding(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """pid, doc_id: documents (doc_id, text) that hold a passage (pid, passage) word for word. A document that does
    has every inner token of the passage, so only those with its longest one are looked through; a passage of fewer
    than three tokens has none and is held against all documents."""
    words = F.regexp_extract_all(F.lower("passage"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    inner = F.slice(words, F.lit(2), F.greatest(F.lit(0), F.size(words) - 2))
    best = F.array_max(F.transform(inner, lambda t: F.struct(F.length(t).alias("n"), t.alias("term"))))["term"]
    keyed = passages.select("pid", "passage", best.alias("term"))
    terms = listed(docs, F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))), "term", "doc_id")
    met = terms.join(keyed.select("pid", "term"), "term").select("doc_id", "pid")
    met = met.join(docs.select("doc_id", "text"), "doc_id").join(keyed.select("pid", "passage"), "pid").where(F.contains("text", "passage")).select("pid", "doc_id")
    short = keyed.where("term is null").select("pid", "passage")
    return met.unionByName(docs.select("doc_id", "text").join(short, F.contains("text", "passage")).select("pid", "doc_id"))
