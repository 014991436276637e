"""Safety rules as joins of lexicon tables. A rule table is data: (term, ...) rows that the caller loads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import contained

#: Severities from low to high.
LEVELS = ("SAFE", "CAUTION", "WARNING", "DANGEROUS", "CRITICAL")


def red_flags(cases: DataFrame, flags: DataFrame) -> DataFrame:
    """qid, kind, detail, level: flags (term, level) that a case text contains. Rule tables are small and the
    planner broadcasts them by their size."""
    hits = cases.join(flags, F.contains(F.lower("case_text"), F.lower("term")))
    return hits.select("qid", F.lit("red_flag").alias("kind"), F.col("term").alias("detail"), "level")


def contraindications(cases: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (drug, condition) with the drug in the answer and the condition in the case."""
    hits = cases.join(pairs, F.contains(F.lower("answer"), F.lower("drug")) & F.contains(F.lower("case_text"), F.lower("condition")))
    return hits.select("qid", F.lit("contraindication").alias("kind"), F.concat_ws("/", "drug", "condition").alias("detail"), F.lit("DANGEROUS").alias("level"))


def interactions(cases: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (drug, other) that an answer names both."""
    hits = cases.join(pairs, F.contains(F.lower("answer"), F.lower("drug")) & F.contains(F.lower("answer"), F.lower("other")))
    return hits.select("qid", F.lit("interaction").alias("kind"), F.concat_ws("+", "drug", "other").alias("detail"), F.lit("WARNING").alias("level"))


def missing_steps(cases: DataFrame, protocols: DataFrame, flagged: DataFrame) -> DataFrame:
    """Steps (protocol, keyword, step, level) missing from the answer, for protocols that the case calls for by
    keyword, or by any red flag at all, as the original has it."""
    called = cases.join(flagged.select("qid", F.lit(True).alias("any_flag")).distinct(), "qid", "left").join(protocols, F.contains(F.lower("case_text"), F.lower("keyword")) | F.coalesce("any_flag", F.lit(False)))
    missed = called.where(~F.contains(F.lower("answer"), F.lower("step")))
    return missed.select("qid", F.lit("protocol").alias("kind"), F.concat_ws(": ", "protocol", "step").alias("detail"), "level").distinct()


def verdicts(cases: DataFrame, found: DataFrame) -> DataFrame:
    """qid, n_violations, level, safe: the highest severity found; unsafe from DANGEROUS on."""
    place = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    worst = found.groupBy("qid").agg(F.count("*").alias("n_violations"), F.max(place).alias("worst"))
    out = cases.select("qid").join(worst, "qid", "left").withColumn("worst", F.coalesce("worst", F.lit(1)))
    return out.select("qid", F.coalesce("n_violations", F.lit(0)).alias("n_violations"), F.element_at(F.array(*map(F.lit, LEVELS)), F.col("worst").cast("int")).alias("level"), (F.col("worst") < 4).alias("safe"))


def rule_violations(cases: DataFrame) -> DataFrame:
    """qid, kind, detail, level: what the rule tables hold against an answer. cases: qid, case_text, answer and
    category (of the patient, may be null).

    Each term is looked for once in the case and once in the answer; the rules then work on the terms found, so a
    case stays one row and nothing is joined.
    """
    flags = [f for some in R.RED_FLAGS.values() for f in some]
    steps = [x for some in R.PROTOCOLS.values() for x in some]
    emergencies = [w for name in R.PROTOCOLS for w in name.split("_")]
    conditions = [x for some in R.CONTRAINDICATED.values() for x in some]
    pairs = [x for pair in R.INTERACTIONS for x in pair]
    unique = lambda *lists: list(dict.fromkeys(x for some in lists for x in some))
    in_case = unique(flags, steps, emergencies, conditions, R.RULED_OUT, pairs, ["sepsis", "septic", "shock", "hypotension"])
    in_answer = unique(steps, R.CONTRAINDICATED, *R.RULED_OUT.values(), pairs, R.PEDIATRIC_DRUGS, R.URGENCY, R.ANTIBIOTICS, R.FLUIDS)
    low = cases.select("qid", F.lower("case_text").alias("c"), F.lower("answer").alias("a"), "category")
    found = low.select("qid", "category", contained(F.col("c"), in_case).alias("c"), contained(F.col("a"), in_answer).alias("a"), F.col("a").rlike(R.DOSE_MENTION).alias("dosed"))
    case, answer = (lambda t: F.array_contains("c", t)), (lambda t: F.array_contains("a", t))
    some = lambda test, terms: reduce(Column.__or__, map(test, terms))
    flagged = F.arrays_overlap("c", F.array(*map(F.lit, flags)))
    out = []

    def rule(when: Column, kind: str, detail: str, level: str) -> None:
        out.append(F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(detail).alias("detail"), F.lit(level).alias("level"))))

    for drug, of in R.CONTRAINDICATED.items():
        for x in of:
            rule(answer(drug) & case(x), "contraindication", f"{drug}/{x}", "CRITICAL")
    for condition, drugs in R.RULED_OUT.items():
        here = case(condition) | F.coalesce(F.col("category") == condition, F.lit(False))
        for drug in drugs:
            rule(here & answer(drug), "condition_contraindication", f"{condition}/{drug}", "CRITICAL")
    for name, needed in R.PROTOCOLS.items():
        called = some(case, name.split("_")) | flagged
        for x in needed:
            rule(called & ~answer(x) & ~case(x), "missing_emergency_step", f"{name}: {x}", "DANGEROUS" if name in R.DANGEROUS_PROTOCOLS else "WARNING")
    for a, b in R.INTERACTIONS:
        rule(answer(a) & case(b), "drug_interaction", f"{a}+{b}", "CRITICAL")
    child = F.coalesce(F.col("category").isin("pediatric", "neonatal"), F.lit(False))
    for drug in R.PEDIATRIC_DRUGS:
        rule(child & F.col("dosed") & answer(drug), "pediatric_dosing", drug, "WARNING")
    rule(flagged & ~some(answer, R.URGENCY), "omitted_urgency", "", "WARNING")
    rule((case("sepsis") | case("septic")) & ~some(answer, R.ANTIBIOTICS), "missing_antibiotics", "", "CRITICAL")
    rule((case("shock") | case("hypotension")) & ~some(answer, R.FLUIDS), "missing_resuscitation", "", "CRITICAL")
    return found.select("qid", F.explode(F.array_compact(F.array(*out))).alias("v")).select("qid", "v.*")


def assessed(cases: DataFrame, violations: DataFrame) -> DataFrame:
    """qid, n_violations, level, safe: DANGEROUS if any violation is, else CRITICAL, WARNING or SAFE in this order."""
    n = lambda level: F.count_if(F.col("level") == level)
    worst = F.when(n("DANGEROUS") > 0, "DANGEROUS").when(n("CRITICAL") > 0, "CRITICAL").when(n("WARNING") > 0, "WARNING").otherwise("SAFE")
    found = violations.groupBy("qid").agg(F.count("*").alias("n_violations"), worst.alias("level"))
    out = cases.select("qid").join(found, "qid", "left")
    level = F.coalesce("level", F.lit("SAFE"))
    return out.select("qid", F.coalesce("n_violations", F.lit(0)).alias("n_violations"), level.alias("level"), level.isin("WARNING", "SAFE").alias("safe"))
