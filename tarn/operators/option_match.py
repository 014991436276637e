"""Tiers of evidence of an option in a passage, and what speaks against it.

A passage is prepared once, however many options meet it: its lower-cased and punctuation-free forms, its keywords,
the places of all words that the tiers ask for, and the lines that hold a warning. A pair of option and passage then
compares places; a window around an option is a comparison of bounds and never a second search of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keywords, positions

# Fixed values of the rules, in the order in which they apply.
DRUGS = (
    "metronidazole", "ceftriaxone", "azithromycin", "doxycycline", "ciprofloxacin", "amoxicillin", "penicillin", "aspirin",
    "insulin", "furosemide", "morphine", "beta blocker", "gentamicin", "ampicillin", "cloxacillin", "cefotaxime",
    "nitrofurantoin", "trimethoprim", "sulfamethoxazole", "cephalexin", "clindamycin", "vancomycin", "labetalol",
    "nifedipine", "magnesium sulfate", "oxytocin", "methylergonovine", "acetaminophen", "ibuprofen", "paracetamol", "diclofenac",
    "clopidogrel", "nitroglycerin", "metoprolol", "dextrose", "phenobarbitone", "diloxanide", "tinidazole", "paromomycin",
)
DRUG_FORMS = (r"\b([a-z]+(?:mycin|cycline|floxacin|penem|azole|pril|olol|sartan))\b", r"\b(aspirin|insulin|morphine|furosemide|metformin|gentamicin|ampicillin|ceftriaxone|azithromycin)\b")
DOSES = (r"(\d+)\s*(mg|g|ml)", r"(\d+)\s*(days?|hours?|times?)", r"(\d+)\s*(stat|daily|bid|tid)")
NEAR_PHRASE = ("treatment", "therapy", "medication", "management", "prescribe", "administer")
NEAR_DRUG = ("treatment", "therapy", "medication", "prescribe", "administer", "dose", "dosage")
CONTEXTS = {
    1.3: ("treatment", "therapy", "management", "medication", "prescribe", "administer", "dose", "dosage", "recommended", "indicated"),
    0.3: ("contraindicated", "avoid", "not recommended", "should not", "do not use", "contraindication"),
    1.2: ("indicated", "recommended", "appropriate", "should be used"),
    0.8: ("complication", "adverse", "side effect", "risk"),
}
WARNINGS = ("not recommended", "contraindicated", "should not", "avoid", "not indicated", "do not use", "never use", "avoid in", "contraindicated in", "not safe", "should be avoided")
MEASURES = ("mg", "g", "ml", "kg", "hourly", "daily", "stat", "day", "bid", "tid", "qid")
ROUTES = ("im", "iv", "oral", "po", "intramuscular", "intravenous")
STOP = ("that", "this", "with", "from", "have", "been", "were", "will", "would", "should")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def drug_named(text: Column) -> Column:
    """The longest known drug in a lower-cased text, of equal lengths the first listed; null without one."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(d)), F.lit(d)) for d in sorted(DRUGS, key=len, reverse=True)))


def option_drug(text: Column) -> Column:
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in DRUG_FORMS]
    return F.coalesce(drug_named(text), *found)


def option_dose(text: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in DOSES))


def plain(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def has_any(text: Column, terms: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(text, F.lit(t))
    return hit


def places(text: Column, terms: tuple[str, ...]) -> Column:
    """Array of struct(at, match), a term at a time: none of the terms of a list may hide one that starts inside it."""
    return F.concat(*(positions(text, t) for t in terms))


def prepared(passages: DataFrame, text: str = "content") -> DataFrame:
    """Adds low, clean, words, the places of each group of words, warnings (first place of each) and warned lines."""
    out = passages.withColumn("low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    low = F.col("low")
    first = F.filter(F.array(*(F.struct(F.lit(w).alias("phrase"), F.instr(low, F.lit(w)).alias("at")) for w in WARNINGS)), lambda x: x["at"] > 0)
    out = out.withColumns({"clean": plain(low), "words": F.array_distinct(keywords(low, 20, STOP)), "warnings": first})
    out = out.withColumns({"near_phrase": places(low, NEAR_PHRASE), "near_drug": places(low, NEAR_DRUG)} | {f"context_{i}": places(low, c) for i, c in enumerate(CONTEXTS.values())})
    lines = F.filter(F.split(low, "\n"), lambda x: has_any(x, WARNINGS))
    return out.withColumn("warned", F.when(F.size("warnings") > 0, lines).otherwise(F.array().cast("array<string>")))


def around(found: Column, at: Column, size: Column, reach: int) -> Column:
    """A word lies whole within reach of the piece of the given size at a place."""
    return F.exists(found, lambda x: (x["at"] >= at - reach) & (x["at"] + F.length(x["match"]) <= at + size + reach))


def pair_tiers(pairs: DataFrame) -> DataFrame:
    """Adds at, tier (exact, clean, drug or null), tier_score, keyword_score (0 if too low), against and context to rows
    of a prepared passage and an option; initial marks questions about first measures. An empty option matches
    everywhere, as the empty string does."""
    o = F.lower(F.coalesce(F.col("option"), F.lit("")))
    rows = pairs.withColumns({"o": o, "at": F.instr(F.col("low"), o)})
    rows = rows.withColumns({"drug": option_drug(F.col("o")), "named": drug_named(F.col("o")), "dose": option_dose(F.col("o")), "own": keywords(F.col("o"), 20, STOP), "o_clean": plain(F.col("o"))})
    low, size = F.col("low"), F.length("o")
    rows = rows.withColumn("drug_at", F.coalesce(F.instr(low, F.col("drug")), F.lit(0)))
    treated, dosed = around(F.col("near_drug"), F.col("drug_at"), F.length("drug"), 200), F.coalesce(F.contains(low, F.col("dose")), F.lit(False))
    # Found at the very start counts as not found, and passes the question on; absent does not.
    begins = lambda w, then: F.when(F.instr(low, F.lit(w)) == 1, then).otherwise(F.instr(low, F.lit(w)) > 0)
    protocol = begins("treatment", begins("medication", F.contains(low, F.lit("key_medications"))))
    first = F.when(F.col("initial") & has_any(F.col("o"), ("stat", "immediate", "first")), 1.2).otherwise(1.0)
    exact, clean = F.col("at") > 0, F.contains("clean", F.col("o_clean")) & (F.length("o_clean") > 10)
    drug = (F.col("drug_at") > 0) & (protocol | dosed | treated)
    tier = F.when(exact, "exact").when(clean, "clean").when(drug, "drug")
    score = F.when(exact, F.when(around(F.col("near_phrase"), F.col("at"), size, 100), 1.0).otherwise(0.95)).when(clean, 0.95)
    score = score.when(drug, F.when(dosed & treated, 0.99).when(dosed | treated, 0.97).otherwise(0.95) * first)

    own, parts = F.array_distinct("own"), F.filter(F.split("o", r"\s+"), lambda w: F.length(w) > 5)
    important = F.filter("own", lambda k: has_any(k, MEASURES) | has_any(k, ROUTES) | drug_named(k).isNotNull())
    important = F.concat(important, F.filter(F.transform(parts, drug_named), lambda d: d.isNotNull() & F.contains(low, d)))
    shared = F.size(F.array_intersect(F.array_distinct(important), "words"))
    ratio = F.try_divide(F.size(F.array_intersect(own, "words")).cast("double"), F.size(own).cast("double"))
    ratio = F.when(shared > 0, F.least(F.lit(1.0), ratio + shared / F.greatest(F.lit(1), F.size(important)) * 0.4)).otherwise(ratio)
    kept = F.when(ratio > 0.5, ratio).when(ratio > 0.3, ratio * 0.8).when(ratio > 0.15, ratio * 0.7).otherwise(0.0)

    near = lambda at: F.exists("warnings", lambda w: F.abs(w["at"] - at) < 100)
    leading = F.filter(F.transform(F.slice("own", 1, 3), lambda k: F.instr(low, k)), lambda i: i > 0)
    against = F.exists("warned", lambda line: F.contains(line, F.col("named"))) | F.exists(leading, near) | (exact & near(F.col("at")))

    other = F.try_element_at(F.filter(F.transform(F.filter(F.split("o", r"\s+"), lambda w: F.length(w) > 4), lambda w: F.instr(low, w)), lambda i: i > 0), F.lit(1))
    spot = F.coalesce(F.nullif(F.col("at"), F.lit(0)), other)
    context = F.lit(1.0)
    for i, factor in reversed(list(enumerate(CONTEXTS))):
        context = F.when(around(F.col(f"context_{i}"), spot, size, 300), factor).otherwise(context)
    return rows.withColumns({"tier": tier, "tier_score": score, "keyword_score": F.coalesce(kept, F.lit(0.0)), "against": F.coalesce(against, F.lit(False)), "context": context})


def matches(pairs: DataFrame) -> DataFrame:
    """qid, label, doc_id, kind, score, supports: a row for each piece of evidence of a pair, scores of support times the
    context factor. What evidence.strength() takes."""
    rows = pair_tiers(pairs)
    piece = lambda kind, score, yes: F.struct(kind.alias("kind"), score.alias("score"), F.lit(yes).alias("supports"))
    found = F.array_compact(F.array(
        F.when(F.col("tier").isNotNull(), piece(F.col("tier"), F.col("tier_score") * F.col("context"), True)),
        F.when(F.col("keyword_score") > 0, piece(F.lit("keyword"), F.col("keyword_score") * F.col("context"), True)),
        F.when(F.col("against"), piece(F.lit("against"), F.lit(0.5), False)),
    ))
    return rows.select("qid", "label", "doc_id", F.inline(found))
