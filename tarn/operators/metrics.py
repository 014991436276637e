"""Evaluation: retrieval metrics over ranked lists, answer metrics over a results table, as plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)
#: Lower edges of ten bins in binary floating point; some are a step above the decimal (0.3, 0.6, 0.7).
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


def judged(ranked: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, doc_id, rk, rel, n_rel for each ranked row; a query without rows keeps one with nulls."""
    n = relevant.groupBy("qid").agg(F.count("*").alias("n_rel"))
    rows = ranked.select("qid", "doc_id", "rk").join(relevant.select("qid", "doc_id", F.lit(1).alias("rel")), ["qid", "doc_id"], "left")
    return queries.select("qid").join(rows, "qid", "left").join(n, "qid", "left").withColumns({"rel": F.coalesce("rel", F.lit(0)), "n_rel": F.coalesce("n_rel", F.lit(0))})


def at_k(rows: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """qid and precision and recall at each k: hits by rows retrieved (at most k), hits by relevant rows; 0 for none."""
    out = []
    for k in ks:
        inside = F.coalesce(F.col("rk") <= k, F.lit(False))
        hits = F.sum(F.when(inside, F.col("rel")).otherwise(0))
        out += [F.coalesce(F.try_divide(hits, F.count_if(inside)), F.lit(0.0)).alias(f"p_{k}"), F.coalesce(F.try_divide(hits, F.max("n_rel")), F.lit(0.0)).alias(f"r_{k}")]
    return rows.groupBy("qid").agg(*out)


def average_precision(rows: DataFrame) -> DataFrame:
    """qid, ap, rr: precision summed over hits by relevant rows, and 1 by the rank of the first hit; 0 for none."""
    so_far = F.sum("rel").over(W.partitionBy("qid").orderBy("rk").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("so_far", so_far)
    total = F.sum(F.when(F.col("rel") == 1, F.col("so_far") / F.col("rk")).otherwise(0.0))
    first = F.min(F.when(F.col("rel") == 1, F.col("rk")))
    return rows.groupBy("qid").agg(F.coalesce(F.try_divide(total, F.max("n_rel")), F.lit(0.0)).alias("ap"), F.coalesce(1 / first, F.lit(0.0)).alias("rr"))


def interleaved(ranked: DataFrame, group: str) -> DataFrame:
    """The id list that mixes chunks and their groups: each chunk's id, and after the first chunk of a group the
    group's id; ranks run over the mixed list."""
    first = F.row_number().over(W.partitionBy("qid", group).orderBy("rk")) == 1
    ids = F.array_compact(F.array(F.concat_ws("_", F.col(group), F.col("doc_id")), F.when(F.col("first") & (F.col(group) != ""), F.col(group))))
    flat = ranked.withColumn("first", first).select("qid", "rk", F.posexplode(ids).alias("pos", "id"))
    return flat.select("qid", "id", F.row_number().over(W.partitionBy("qid").orderBy("rk", "pos")).alias("rk"))


def coverage(ranked: DataFrame, docs: DataFrame, concepts: DataFrame) -> DataFrame:
    """qid, coverage: share of a query's concepts (qid, concept) that occur in one of its ranked texts (doc_id, content)."""
    texts = ranked.select("qid", "doc_id").join(docs, "doc_id")
    hit = concepts.join(texts, "qid", "left").groupBy("qid", "concept").agg(F.max(F.coalesce(F.contains(F.lower("content"), F.lower("concept")), F.lit(False)).cast("int")).alias("hit"))
    return hit.groupBy("qid").agg(F.avg("hit").alias("coverage"))


def same_answer(a: Column, b: Column) -> Column:
    return F.upper(F.trim(a)) == F.upper(F.trim(b))


def bin_of(confidence: Column) -> Column:
    """0 to 9 by EDGES, closed below; null outside, so also for 1.0."""
    out = F.lit(None).cast("int")
    for i in range(10):
        out = F.when((confidence >= F.lit(EDGES[i])) & (confidence < F.lit(EDGES[i + 1])), F.lit(i)).otherwise(out)
    return out


def brier(results: DataFrame, confidence: str = "confidence", correct: str = "is_correct") -> DataFrame:
    """Mean squared gap of confidence and outcome; 1 for no rows."""
    return results.agg(F.coalesce(F.avg(F.pow(F.col(confidence) - F.col(correct).cast("double"), F.lit(2.0))), F.lit(1.0)).alias("brier"))


def calibration_error(results: DataFrame, confidence: str = "confidence", correct: str = "is_correct", by: tuple[str, ...] = ()) -> DataFrame:
    """Expected calibration error: rows in no bin count in the denominator only; 1 for no rows."""
    bins = results.groupBy(*by, bin_of(F.col(confidence)).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("acc"), F.avg(confidence).alias("conf"))
    gap = F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0))
    return bins.groupBy(*by).agg(F.coalesce(F.try_divide(gap, F.sum("n")), F.lit(1.0)).alias("ece"))


def calibration_bins(results: DataFrame, confidence: str = "confidence", correct: str = "is_correct") -> DataFrame:
    """bin, n, predicted, accuracy: tenths by their number (10 for 1.0), the middle of each and the share that is right.
    Rows that are neither right nor wrong are left out."""
    rows = results.where(F.col(correct).isNotNull()).withColumn("bin", F.floor(F.col(confidence) * 10))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy")).withColumn("predicted", (F.col("bin") + 0.5) / 10)


def histogram(results: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Rows per tenth; 1.0 has a tenth of its own."""
    i = F.floor(F.col(confidence) * 10)
    label = F.concat((i * 10).cast("string"), F.lit("-"), ((i + 1) * 10).cast("string"), F.lit("%"))
    return results.groupBy(label.alias("bin")).agg(F.count("*").alias("n"))


def confusion(results: DataFrame, labels: tuple[str, ...], gold: str = "correct_answer", predicted: str = "selected_answer", compat: bool = False) -> DataFrame:
    """actual, predicted, n. A prediction outside the labels is UNK; with compat it counts as correct, as the
    original count has it, and a gold label outside them counts as the first."""
    known = lambda c: F.col(c).isin(*labels)
    actual = F.when(known(gold), F.col(gold)).otherwise(F.lit(labels[0]) if compat else F.lit("UNK"))
    got = F.when(known(predicted), F.col(predicted)).otherwise(actual if compat else F.lit("UNK"))
    return results.groupBy(actual.alias("actual"), got.alias("predicted")).agg(F.count("*").alias("n"))


def per_class(matrix: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """label, tp, fp, fn, tn, precision, recall, f1, support; 0 where a share has no denominator."""
    each = matrix.withColumn("label", F.explode(F.array(*(F.lit(x) for x in labels))))
    own, got = F.col("actual") == F.col("label"), F.col("predicted") == F.col("label")
    c = lambda cond, name: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name)
    each = each.groupBy("label").agg(c(own & got, "tp"), c(~own & got, "fp"), c(own & ~got, "fn"), c(~own & ~got, "tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return each.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "support": tp + fn})


def summary_of_classes(classes: DataFrame) -> DataFrame:
    """Macro means, support-weighted F1 and balanced accuracy."""
    return classes.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("weighted_f1"), F.avg("recall").alias("balanced_accuracy"))


def unanswered(answer: Column) -> Column:
    return F.contains(F.lower(answer), F.lit("cannot answer"))


def reasoning_summary(results: DataFrame) -> DataFrame:
    """One pass: exact, partial credit, completeness, evidence use, hallucination, misuse, Brier, CoT/ToT delta.

    results: selected_answer, correct_answer, confidence, is_correct, n_steps, n_evidence, method.
    """
    sure = F.col("is_correct") & (F.col("confidence") > 0.7)
    chain = F.when(F.col("n_steps") >= 3, 1.0).when(F.col("n_steps") == 2, 0.7).when(F.col("n_steps") == 1, 0.4).otherwise(0.0)
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    n, none = F.count("*"), unanswered(F.col("selected_answer"))
    of = lambda m: F.coalesce(F.avg(F.when(F.col("method") == m, F.col("is_correct").cast("double"))), F.lit(0.0))
    return results.agg(
        share(F.count_if(same_answer(F.col("selected_answer"), F.col("correct_answer"))), n).alias("exact_match"),
        share(F.count_if(sure), n).alias("partial_credit"),
        F.coalesce(F.avg(chain), F.lit(0.0)).alias("chain_completeness"),
        (share(F.count_if(F.col("n_evidence") > 0), n) * F.least(F.lit(1.0), F.coalesce(F.avg("n_evidence"), F.lit(0.0)) / 2)).alias("evidence_utilisation"),
        share(F.count_if(~none & (F.col("n_evidence") == 0)), F.count_if(~none)).alias("hallucination_rate"),
        share(F.count_if(none & (F.col("correct_answer") != "") & ~unanswered(F.col("correct_answer"))), n).alias("cannot_answer_misuse"),
        (of("ToT") - of("CoT")).alias("cot_tot_delta"),
        F.count_if(~F.col("is_correct") & (F.col("confidence") > 0.8)).alias("dangerous_errors"),
        F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(F.count_if(~F.col("is_correct") & (F.col("confidence") > 0.8)).cast("double"), n.cast("double")), F.lit(1.0))).alias("safety_score"),
    )


def segmented(results: DataFrame, dimensions: tuple[str, ...], correct: str = "is_correct") -> DataFrame:
    """dimension, segment, n, accuracy for each dimension in one pass over the table (grouping sets)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment")) for d in dimensions)))
    flat = results.select(pairs.alias("x"), F.col(correct).cast("double").alias("ok"))
    return flat.groupBy("x.dimension", "x.segment").agg(F.count("*").alias("n"), F.avg("ok").alias("accuracy"))


def complexity_level(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.length(low) > 3000, "complex").when(F.length(low) > 1000, "moderate").otherwise("simple")


def confidence_range(confidence: Column) -> Column:
    return F.when(confidence < 0.3, "low").when(confidence < 0.7, "medium").otherwise("high")


def confused_pairs(matrix: DataFrame, k: int) -> DataFrame:
    """The k most frequent pairs off the diagonal; ties by name."""
    return matrix.where(F.col("actual") != F.col("predicted")).orderBy(F.col("n").desc(), "actual", "predicted").limit(k)


def similarity_split(results: DataFrame, groups: dict[str, str], gold: str, predicted: str) -> DataFrame:
    """Errors within one group of alike conditions or across groups; conditions in no group are alike to none."""
    group = F.create_map(*(F.lit(x) for kv in groups.items() for x in kv))
    of = lambda c: F.coalesce(F.try_element_at(group, F.lower(F.trim(F.coalesce(c, F.lit("unknown"))))), F.lit("other"))
    wrong = results.where(F.lower(F.trim(F.col(gold))) != F.lower(F.trim(F.col(predicted)))).select(of(F.col(gold)).alias("g"), of(F.col(predicted)).alias("p"))
    kind = F.when((F.col("g") == F.col("p")) & (F.col("g") != "other"), "similar").otherwise("different")
    return wrong.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def error_kinds(results: DataFrame) -> DataFrame:
    """error_kind, n, share over wrong rows: nothing relevant retrieved, no word of the reasoning in the
    evidence (knowledge), otherwise reasoning. results: is_correct, n_relevant, overlap."""
    kind = F.when(F.col("n_relevant") == 0, "retrieval").when(F.col("overlap") == 0, "knowledge").otherwise("reasoning")
    wrong = results.where(~F.col("is_correct")).groupBy(kind.alias("error_kind")).agg(F.count("*").alias("n"))
    return wrong.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))
