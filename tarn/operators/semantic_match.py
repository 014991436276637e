"""Terms of an option in a passage by name, by synonym, or by likeness to a sentence; weights by context and place; sums
over documents; concepts that no document holds.

Likeness is the cosine of sparse vectors over a threshold. The join is by shared dimensions of prefixes: dimensions are
ordered from the rarest, and only those are kept from which on the norm of what is left reaches the threshold. Two
vectors whose cosine does share a dimension that both keep, so no pair is lost and none is tried that shares none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import contained, loose_sentences, tokens
from .retrieval import bucket, listed

# Synonym groups in the order in which they are looked through, and words that tell a context.
MEDICATIONS = {
    "gentamicin": ["gentamicin", "gentamycin", "garamycin"], "ceftriaxone": ["ceftriaxone", "rocephin"], "azithromycin": ["azithromycin", "zithromax"],
    "metronidazole": ["metronidazole", "flagyl"], "ampicillin": ["ampicillin", "principen"], "cefotaxime": ["cefotaxime", "claforan"],
    "aspirin": ["aspirin", "asa", "acetylsalicylic acid"], "paracetamol": ["paracetamol", "acetaminophen", "tylenol"],
    "morphine": ["morphine", "morphine sulfate"], "insulin": ["insulin", "regular insulin", "human insulin"],
}
SYMPTOMS = {
    "chest pain": ["chest pain", "angina", "chest discomfort", "precordial pain"], "shortness of breath": ["shortness of breath", "dyspnea", "sob", "breathlessness"],
    "fever": ["fever", "pyrexia", "elevated temperature", "hyperthermia"], "headache": ["headache", "cephalgia", "head pain"],
    "nausea": ["nausea", "feeling sick", "queasiness"], "vomiting": ["vomiting", "emesis", "throwing up"],
}
PROCEDURES = {
    "surgery": ["surgery", "operation", "surgical procedure", "operation"], "biopsy": ["biopsy", "tissue sampling", "specimen collection"],
    "endoscopy": ["endoscopy", "endoscopic procedure", "scope"],
}
GROUPS = MEDICATIONS | SYMPTOMS | PROCEDURES
UNITS = (r"(?i)\d+\s*(mg|g|ml|kg|days?|hours?|times?)", r"(?i)\d+\s*(stat|daily|bid|tid|qid)")
CONTEXTS = {
    "treatment": ["treatment", "therapy", "management", "intervention", "medication", "prescribe", "administer", "dose", "dosage"],
    "contraindication": ["contraindicated", "avoid", "not recommended", "should not", "do not use", "contraindication"],
    "indication": ["indicated", "recommended", "should be used", "appropriate", "indication"],
    "background": ["background", "introduction", "overview", "general"],
    "complication": ["complication", "adverse", "side effect", "risk"],
}
CONTEXT_WEIGHTS = {"treatment": 1.3, "indication": 1.2, "contraindication": 0.3, "complication": 0.7}


def medical_terms(text: Column) -> Column:
    """Distinct: of each group the first name in the lower-cased text, and the units that follow a number."""
    named = [F.try_element_at(contained(text, names), F.lit(1)) for names in GROUPS.values()]
    units = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in UNITS]
    return F.array_distinct(F.concat(F.array_compact(F.array(*named)), *units))


def synonym_in(term: Column, text: Column) -> Column:
    """The first name in the text of a group whose head is part of the term; null without one."""
    return F.coalesce(*(F.when(F.contains(term, F.lit(head)), F.try_element_at(contained(text, names), F.lit(1))) for head, names in GROUPS.items()))


def context_of(low: Column, found: Column, reach: int = 200) -> Column:
    at = F.instr(low, found)
    start = F.greatest(F.lit(1), at - reach)
    window = F.substring(low, start, at + F.length(found) + reach - start)
    out = F.lit("general")
    for name, words in reversed(CONTEXTS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(window, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return F.when(at == 0, "unknown").otherwise(out)


def location_of(low: Column, found: Column) -> Column:
    at, n = F.instr(low, found) - 1, F.length(low)
    return F.when(at < 0, "unknown").when(at < n * 0.2, "beginning").when(at < n * 0.6, "middle").otherwise("end")


def sparse(rows: DataFrame, keys: list[str], text: str, dim: int) -> DataFrame:
    """keys, bucket, w: token counts in dim hash buckets, of unit length."""
    counts = listed(rows, tokens(F.col(text)), "_token", *keys).groupBy(*keys, bucket(F.col("_token"), dim).alias("bucket")).agg(F.count("*").cast("double").alias("w"))
    return counts.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*keys))))


def prefix(vectors: DataFrame, keys: list[str], often: DataFrame, least: float) -> DataFrame:
    """The dimensions from which on the norm of what is left is at least the threshold; often has a row a dimension."""
    order = W.partitionBy(*keys).orderBy(F.coalesce("often", F.lit(0)), "bucket").rowsBetween(W.currentRow, W.unboundedFollowing)
    left = vectors.join(F.broadcast(often), "bucket", "left").withColumn("left", F.sum(F.col("w") * F.col("w")).over(order))  # dim rows at most
    return left.where(F.sqrt("left") >= least - 1e-9).select(*keys, "bucket")


def near_candidates(a: DataFrame, b: DataFrame, a_keys: list[str], b_keys: list[str], least: float) -> DataFrame:
    """Pairs (a_keys, b_keys) that share a dimension of both prefixes; keys that both have must be equal."""
    often = b.groupBy("bucket").agg(F.count("*").alias("often"))
    both = [k for k in a_keys if k in b_keys]
    return prefix(a, a_keys, often, least).join(prefix(b, b_keys, often, least), [*both, "bucket"]).drop("bucket").distinct()


def near(a: DataFrame, b: DataFrame, a_keys: list[str], b_keys: list[str], least: float) -> DataFrame:
    """a_keys, b_keys, similarity of all pairs of vectors whose cosine is at least the threshold."""
    tried = near_candidates(a, b, a_keys, b_keys, least).join(a.withColumnRenamed("w", "wa"), a_keys).join(b.withColumnRenamed("w", "wb"), [*b_keys, "bucket"])
    keys = [*a_keys, *(k for k in b_keys if k not in a_keys)]
    return tried.groupBy(*keys).agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity")).where(F.round("similarity", 9) >= least)


def semantic_matches(passages: DataFrame, options: DataFrame, threshold: float = 0.6, *, dim: int = 1024) -> DataFrame:
    """qid, label, doc_id, term, matched, similarity, context, location from passages (qid, doc_id, content) and options
    (qid, label, option): 1.0 for a term that is in the passage, .9 for a synonym, else each sentence whose cosine is
    at least the threshold (.05 less up to .5). Null texts hold nothing; an option without terms has no rows."""
    least = threshold - 0.05 if threshold <= 0.5 else threshold
    asked = options.select("qid", "label", F.explode(medical_terms(F.lower("option"))).alias("term"))
    texts = passages.select("qid", "doc_id", "content", F.lower("content").alias("low"))
    pairs = texts.join(asked.select("qid", "term").distinct(), "qid").withColumn("named", F.when(F.contains("low", "term"), F.col("term")).otherwise(synonym_in(F.col("term"), F.col("low"))))
    by_name = pairs.where("named is not null").select("qid", "doc_id", "term", F.col("named").alias("matched"), F.when(F.col("named") == F.col("term"), 1.0).otherwise(0.9).alias("similarity"), context_of(F.col("low"), F.col("named")).alias("context"), location_of(F.col("low"), F.col("named")).alias("location"))

    open_ = pairs.where("named is null").select("qid", "doc_id", "term")
    said = texts.join(open_.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi").select("qid", "doc_id", F.posexplode(loose_sentences(F.col("content"))).alias("i", "sentence"))
    found = near(sparse(open_.withColumn("text", F.col("term")), ["qid", "doc_id", "term"], "text", dim), sparse(said, ["qid", "doc_id", "i"], "sentence", dim), ["qid", "doc_id", "term"], ["qid", "doc_id", "i"], least)
    low = F.lower("sentence")
    by_sense = found.join(said, ["qid", "doc_id", "i"]).join(texts.select("qid", "doc_id", "low"), ["qid", "doc_id"])
    by_sense = by_sense.select("qid", "doc_id", "term", F.substring("sentence", 1, 100).alias("matched"), "similarity", context_of(F.col("low"), low).alias("context"), location_of(F.col("low"), low).alias("location"))
    return asked.join(by_name.unionByName(by_sense), ["qid", "term"]).select("qid", "label", "doc_id", "term", "matched", "similarity", "context", "location")


def match_score() -> Column:
    """Similarity by context, by likeness (1.1 from .95) and by place (1.05 before the last part)."""
    by_context = F.lit(1.0)
    for name, w in CONTEXT_WEIGHTS.items():
        by_context = F.when(F.col("context") == name, w).otherwise(by_context)
    return F.col("similarity") * by_context * F.when(F.col("similarity") >= 0.95, 1.1).otherwise(1.0) * F.when(F.col("location").isin("beginning", "middle"), 1.05).otherwise(1.0)


def over_documents(found: DataFrame) -> DataFrame:
    """qid, label, n_matches, n_docs, score: the mean, a fifth more if several documents support it, 1 at most."""
    rows = found.withColumn("score", match_score()).groupBy("qid", "label").agg(F.count("*").alias("n_matches"), F.count_distinct("doc_id").alias("n_docs"), F.avg("score").alias("score"))
    return rows.withColumn("score", F.least(F.lit(1.0), F.col("score") * F.when(F.col("n_docs") > 1, 1.2).otherwise(1.0)))


def missing_concepts(asked: DataFrame, passages: DataFrame, most: int = 3) -> DataFrame:
    """qid, missing: terms over four letters of (qid, text) that no passage of the question names, itself or by a
    synonym, the first ones in alphabetical order."""
    terms = asked.select("qid", F.explode(medical_terms(F.lower("text"))).alias("term")).where(F.length("term") > 4)
    texts = passages.select("qid", "doc_id", F.lower("content").alias("low"))
    hit = (F.array_contains(medical_terms(F.col("low")), F.col("term"))) | synonym_in(F.col("term"), F.col("low")).isNotNull()
    held = terms.join(texts, "qid").where(hit).select("qid", "term").distinct()
    left = terms.join(held, ["qid", "term"], "left_anti").groupBy("qid").agg(F.array_sort(F.collect_set("term")).alias("missing"))  # as many as there are groups at most
    return asked.select("qid").distinct().join(left, "qid", "left").select("qid", F.coalesce(F.slice("missing", 1, most), F.array().cast("array<string>")).alias("missing"))
