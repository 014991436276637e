"""Boosts, reranking and pruning of candidate rows: conditional sums in a projection, ranks in a window.

Candidates have qid, query (text), doc_id, content, score and where needed title, category. Terms are given as
arrays per query or as weights that become one expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import contained, weight_of
from .calibration import clamp
from .retrieval import top_k

#: Fixed values of the pruning rule.
TREATMENT = ("treatment", "therapy", "management", "medication", "drug", "dose", "dosage", "first-line", "recommended", "protocol", "guideline", "indication", "contraindication")
SECTIONS = ("treatment:", "management:", "diagnosis:", "first[- ]line", "recommended", "protocol")


def mentions(content: Column, term: Column) -> Column:
    """A term is in the text as it stands, or by all of its words over two letters, or as a word over three."""
    words, own = F.split(content, r"\s+"), F.split(term, r"\s+")
    several = (F.size(own) > 1) & F.forall(F.filter(own, lambda w: F.length(w) > 2), lambda w: F.array_contains(words, w))
    return F.contains(content, term) | several | ((F.size(own) == 1) & (F.length(term) > 3) & F.array_contains(words, term))


def matches(content: Column, terms: Column) -> Column:
    """How many terms of the array the text mentions."""
    return F.size(F.filter(terms, lambda t: mentions(content, F.lower(F.trim(t)))))


def prefiltered(rows: DataFrame, k: int) -> DataFrame:
    """Symptom prefilter: rows with matches first, by matches and boosted score; filled up with the others.

    rows: qid, doc_id, score, content, critical and terms (arrays).
    """
    low = F.lower("content")
    rows = rows.withColumn("n", 2 * matches(low, F.col("critical")) + matches(low, F.col("terms")))
    rows = rows.withColumn("score", F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("score") + 0.15 * F.col("n"))).otherwise(F.col("score")))
    order = W.partitionBy("qid").orderBy((F.col("n") > 0).desc(), F.col("n").desc(), F.round("score", 9).desc(), "doc_id")
    return rows.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def first_stage_boost(query: Column, category: Column, title: Column, content: Column) -> Column:
    """Category words in the query .15, title words .20 or .30, initial treatment .12; at most .70 in all."""
    q = F.lower(query)
    words = F.split(q, r"\s+")
    by_category = F.when(F.exists(F.split(F.lower(category), r"\s+"), lambda w: (F.length(w) > 0) & F.contains(q, w)), 0.15).otherwise(0.0)
    n = F.size(F.filter(F.split(F.lower(title), r"\s+"), lambda w: (F.length(w) > 3) & F.array_contains(words, w)))
    by_title = F.when(n >= 2, 0.30).when(n == 1, 0.20).otherwise(0.0)
    asks = F.contains(q, F.lit("initial")) & (F.contains(q, F.lit("treatment")) | F.contains(q, F.lit("therapy")) | F.contains(q, F.lit("management")))
    first = F.when(asks & F.lower(content).rlike("(initial|first-line|primary) treatment|initial therapy"), 0.12).otherwise(0.0)
    return F.least(F.lit(0.70), by_category + by_title + first)


def squash(score: Column) -> Column:
    """1 - 1 / (1 + s) for positive scores, else 0."""
    return F.when(score > 0, 1 - 1 / (1 + score)).otherwise(F.lit(0.0))


def keyword_stage(first: DataFrame, bm25: DataFrame, k: int, weights: tuple[float, float]) -> DataFrame:
    """Left join of first-stage rows to keyword ranks; a missing score is 0 and a missing rank one past the
    candidates; ordered by the weighted sum of the first score and the squashed second."""
    n = F.count("*").over(W.partitionBy("qid"))
    b = bm25.select("qid", "doc_id", F.col("score").alias("s2"), F.col("rk").alias("r2"))
    rows = first.withColumnsRenamed({"score": "s1", "rk": "r1"}).withColumn("n", n).join(b, ["qid", "doc_id"], "left")
    rows = rows.withColumns({"s2": squash(F.coalesce("s2", F.lit(0.0))), "r2": F.coalesce("r2", F.col("n") + 1)})
    return top_k(rows.drop("n").withColumn("order", weights[0] * F.col("s1") + weights[1] * F.col("s2")), k, by="order").drop("order")


def normalised_weights(w: tuple[float, float, float]) -> tuple[float, float, float]:
    return tuple(x / sum(w) for x in w)


def final_stage(rows: DataFrame, weights: tuple[float, float, float], cross: Column | None = None) -> DataFrame:
    """Third score and final score. Without a cross-scorer the third score is the weighted sum of the first two;
    with one it is brought to 0..1 within the query (all equal: .5), its three best raised by 15, 10 and 5 %.
    The second score is squashed again, as in the original; ×1.1 if two stages pass .6."""
    one = W.partitionBy("qid")
    if cross is None:
        rows = rows.withColumn("s3", weights[0] * F.col("s1") + weights[1] * F.col("s2"))
    else:
        low, high = F.min("x").over(one), F.max("x").over(one)
        rows = rows.withColumn("x", cross).withColumn("s3", F.when(high > low, (F.col("x") - low) / (high - low)).otherwise(F.lit(0.5))).withColumn("flat", high == low)
        place = F.row_number().over(one.orderBy(F.col("s3").desc(), "doc_id"))
        rows = rows.withColumn("place", place).withColumn("s3", F.when(~F.col("flat") & (F.col("place") <= 3), F.least(F.lit(1.0), F.col("s3") * (1.2 - 0.05 * F.col("place")))).otherwise(F.col("s3"))).drop("x", "flat", "place")
    a, b, c = clamp(F.col("s1")), squash(F.col("s2")), clamp(F.col("s3"))
    base = weights[0] * a + weights[1] * b + weights[2] * c
    high = sum(((x > 0.6).cast("int") for x in (a, b, c)), F.lit(0))
    return rows.withColumn("score", F.when(high >= 2, F.least(F.lit(1.0), base * 1.1)).otherwise(base))


def guideline_boost(content: Column, keywords: tuple[str, ...], diseases: Column) -> Column:
    """.04 for each keyword up to .20 and .10 for each disease of the query up to .30."""
    low = F.lower(content)
    return F.least(F.lit(0.20), weight_of(low, dict.fromkeys(keywords, 0.04))) + F.least(F.lit(0.30), 0.10 * F.size(F.filter(diseases, lambda d: F.contains(low, d))))


def term_boost(content: Column, title: Column, primary: dict[str, float], secondary: dict[str, float], sections: dict[str, float], diseases: Column) -> Column:
    """Weights of primary terms, of secondary ones up to .2, of section terms in text or title, .3 once for a
    disease in either and .2 once for one in the title; at most 1."""
    low, head = F.lower(content), F.lower(title)
    by_section = sum((F.when(F.contains(low, F.lit(t)) | F.contains(head, F.lit(t)), w).otherwise(0.0) for t, w in sections.items()), F.lit(0.0))
    some = lambda w, *texts: F.when(F.exists(diseases, lambda d: reduce(Column.__or__, (F.contains(t, d) for t in texts))), w).otherwise(0.0)
    return F.least(F.lit(1.0), weight_of(low, primary) + F.least(F.lit(0.2), weight_of(low, secondary)) + by_section + some(0.3, low, head) + some(0.2, head))


def named_diseases(text: Column) -> Column:
    """Diseases of the table in the text, and the first thing of over three characters that each form of words names."""
    low = F.lower(text)
    forms = (F.trim(F.regexp_extract(low, p, 1)) for p in R.DISEASE_FORMS)
    return F.array_distinct(F.concat(contained(low, R.DISEASES), F.filter(F.array(*forms), lambda x: F.length(x) > 3)))


def reranked(rows: DataFrame, boost: Column, k: int | None = None) -> DataFrame:
    """Score plus boost, which may pass 1."""
    out = rows.withColumn("boost", boost).withColumn("score", F.col("score") + F.col("boost"))
    return top_k(out, k if k is not None else 2_147_483_647)


def by_specialty(rows: DataFrame, category: str, keywords: tuple[str, ...], focus: str) -> DataFrame:
    """Order by 2 for the category and 1 for each keyword only; earlier ranks decide ties."""
    hits = F.when(F.contains(F.lower(category), F.lit(focus)), 2.0).otherwise(0.0) + weight_of(F.lower("content"), dict.fromkeys(keywords, 1.0))
    rows = rows.withColumn("fit", hits)
    return rows.withColumn("rk", F.row_number().over(W.partitionBy("qid").orderBy(F.col("fit").desc(), "rk")))


def relevance(content: Column, keywords: Column) -> Column:
    """Pruning score: .2 + length / 50 for each keyword in the text, .15 for each treatment word, .1 for each
    section pattern; halved under 100 characters, ×.8 over 2000; at most 1."""
    low = F.lower(content)
    found = F.filter(keywords, lambda t: F.contains(low, t))
    score = F.aggregate(found, F.lit(0.0), lambda s, t: s + 0.2 + F.length(t) / F.lit(50.0))
    score = score + weight_of(low, dict.fromkeys(TREATMENT, 0.15)) + sum((F.when(low.rlike(p), 0.1).otherwise(0.0) for p in SECTIONS), F.lit(0.0))
    score = score * F.when(F.length(content) < 100, 0.5).otherwise(1.0) * F.when(F.length(content) > 2000, 0.8).otherwise(1.0)
    return F.least(F.lit(1.0), score)


def pruned(rows: DataFrame, keywords: Column, most: int = 3, least: float = 0.1) -> DataFrame:
    """The best rows of each query by relevance."""
    return top_k(rows.withColumn("score", relevance(F.col("content"), keywords)).where(F.col("score") >= least), most)


def budgeted(rows: DataFrame, chars: int = 3000) -> DataFrame:
    """Rows in rank order while their texts fit the budget; the first that does not is cut to what is left if
    that is over 100 characters (three dots mark it), and nothing follows it."""
    before = F.coalesce(F.sum(F.length("content")).over(W.partitionBy("qid").orderBy("rk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before)
    left = chars - F.col("before")
    whole = F.length("content") <= left
    text = F.when(whole, F.col("content")).when((F.col("before") <= chars) & (left > 100), F.concat(F.expr(f"substring(content, 1, cast({chars} - before as int))"), F.lit("...")))
    return rows.withColumn("kept", text).where(F.col("kept").isNotNull()).drop("before")
