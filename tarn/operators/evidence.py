"""Evidence for answer options and the choice among them. A pair of option and document is a row; options of a
question are aggregated, then compared in a window over the question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import contained, positions
from .calibration import clamp

#: Fixed values of the scoring rules.
TREATMENT = "treatment|therapy|medication|management|prescribe|recommend"
IMPORTANT = ("treatment", "medication", "dose", "mg", "therapy", "management", "drug", "prescribe")
AGAINST = ("contraindicated", "not recommended", "avoid", "should not")
WEIGHTS = {"direct": 0.6, "inferred": 0.3, "guideline": 0.1, "against": -0.4}


def context_score(content: Column, at: Column, reach: int = 300) -> Column:
    """Factor by the words around a place: treatment 1.3, contraindication .3, indication 1.2, complication .8."""
    around = F.substring(F.lower(content), F.greatest(F.lit(1), at - reach), F.lit(2 * reach))
    return F.when(around.rlike("treatment|therapy|management|first-line"), 1.3).when(around.rlike("contraindicat|avoid"), 0.3).when(around.rlike("indicat"), 1.2).when(around.rlike("complication|adverse"), 0.8).otherwise(1.0)


def contradicts(option: Column, content: Column, within: int = 100) -> Column:
    """A warning phrase first occurs within so many characters of the option's first occurrence."""
    low, o = F.lower(content), F.lower(option)
    near = [(F.instr(low, F.lit(p)) > 0) & (F.abs(F.instr(low, o) - F.instr(low, F.lit(p))) < within) for p in AGAINST]
    hit = near[0]
    for x in near[1:]:
        hit = hit | x
    return (F.instr(low, o) > 0) & hit


def pair_scores(pairs: DataFrame) -> DataFrame:
    """qid, label, doc_id, direct, inferred, against (0 or 1), guideline for rows (qid, label, option, doc_id, content, title)."""
    low, o = F.lower("content"), F.lower("option")
    at = F.instr(low, o)
    around = F.substring(low, F.greatest(F.lit(1), at - 150), F.length(o) + F.least(at - 1, F.lit(150)) + 150)
    direct = F.when((at > 0) & (F.length(o) > 0), F.when(around.rlike(TREATMENT), 1.0).otherwise(0.95))
    own = F.array_distinct(F.filter(F.split(o, r"\s+"), lambda w: F.length(w) > 0))
    shared = F.array_intersect(own, F.split(low, r"\s+"))
    important = F.size(F.array_intersect(shared, F.array(*map(F.lit, IMPORTANT))))
    inferred = F.when(F.size(shared) >= 1, F.least(F.lit(1.0), F.size(shared) / F.greatest(F.lit(1), F.size(own)) * (1 + 0.15 * important) * 1.5))
    guide = F.when((at > 0) & F.contains(F.lower("title"), F.lit("guideline")), 0.3).otherwise(0.0)
    names = F.contains(low, F.lit("guideline")) | F.contains(F.lower("title"), F.lit("guideline"))
    return pairs.select("qid", "label", "doc_id", direct.alias("direct"), inferred.alias("inferred"), contradicts(F.col("option"), F.col("content")).cast("int").alias("against"), guide.alias("guide"), names.cast("int").alias("names_guideline"))


def option_scores(scored: DataFrame) -> DataFrame:
    """qid, label, direct, inferred, against, total, guideline, n_sources: means raised for several sources,
    weighted, clamped."""
    d, i = F.count("direct"), F.count("inferred")
    direct = F.coalesce(F.avg("direct"), F.lit(0.0)) * F.when(d > 2, 1.15).when(d > 1, 1.12).otherwise(1.0)
    inferred = F.coalesce(F.avg("inferred"), F.lit(0.0)) * F.when(i > 3, 1.10).when(i > 2, 1.08).otherwise(1.0)
    named = F.sum(F.col("names_guideline") * (F.col("direct").isNotNull().cast("int") + F.col("inferred").isNotNull().cast("int")))
    out = scored.groupBy("qid", "label").agg(direct.alias("direct"), inferred.alias("inferred"), F.max("against").alias("against"), F.least(F.lit(1.0), F.sum("guide")).alias("align"), (d + i).alias("n_sources"), F.least(F.lit(1.0), named / F.lit(3.0)).alias("guideline"))
    total = WEIGHTS["direct"] * F.col("direct") + WEIGHTS["inferred"] * F.col("inferred") + WEIGHTS["guideline"] * F.col("align") + WEIGHTS["against"] * F.col("against")
    return out.withColumn("total", clamp(total))


def choose(options: DataFrame) -> DataFrame:
    """qid, selected, confidence, margin: .8 of the total and .2 of the guideline score, ×1.1 for strong evidence
    from several sources; ×.95 for a margin under .10, ×1.10 over .25; at least .5 with any evidence."""
    base = 0.8 * F.col("total") + 0.2 * F.col("guideline")
    rows = options.withColumn("final", F.when((F.col("total") > 0.5) & (F.col("n_sources") > 1), F.least(F.lit(1.0), base * 1.1)).otherwise(base))
    order = W.partitionBy("qid").orderBy(F.round("final", 9).desc(), "label")
    rows = rows.withColumns({"rk": F.row_number().over(order), "next": F.lead("final").over(order)}).where("rk = 1")
    margin = F.coalesce(F.col("final") - F.col("next"), F.lit(0.0))
    c = F.when(margin < 0.10, F.col("final") * 0.95).when(margin > 0.25, F.least(F.lit(1.0), F.col("final") * 1.10)).otherwise(F.col("final"))
    c = F.when(F.col("total") > 0.05, F.greatest(c, F.lit(0.5))).otherwise(c)
    return rows.select("qid", F.col("label").alias("selected"), clamp(c).alias("confidence"), margin.alias("margin"))


def strength(matches: DataFrame) -> DataFrame:
    """qid, label, n, against, strength, match_type from rows (qid, label, score, supports).

    Scores count double, 1.5 or 1.2 times by tier (.7, .5, .3); several sources, good sources and medium ones
    raise the sum; contradictions take 2.5 times their sum away; divided by ln(1 + n / 2) and clamped.
    """
    s, yes = F.col("score"), F.col("supports")
    tier = s * F.when(s > 0.7, 2.0).when(s > 0.5, 1.5).when(s > 0.3, 1.2).otherwise(1.0)
    agg = matches.groupBy("qid", "label").agg(
        F.sum(F.when(yes, tier).otherwise(0.0)).alias("sum"), F.count_if(yes).alias("n"), F.count_if(yes & (s > 0.7)).alias("good"), F.count_if(yes & (s > 0.5) & (s <= 0.7)).alias("medium"),
        F.sum(F.when(~yes, s).otherwise(0.0)).alias("against"), F.count_if(~yes).alias("n_against"),
    )
    n, good, medium = F.col("n"), F.col("good"), F.col("medium")
    x = F.col("sum") * F.when(n > 3, 1.4).when(n > 2, 1.3).when(n > 1, 1.2).otherwise(1.0)
    x = x * F.when(good > 2, 1.35).when(good > 1, 1.3).when((good == 1) & (n > 1), 1.2).otherwise(1.0) * F.when(medium >= 3, 1.15).when(medium >= 2, 1.1).otherwise(1.0)
    x = F.when(F.col("n_against") > 0, F.greatest(F.lit(0.0), x - 2.5 * F.col("against"))).otherwise(x)
    x = clamp(x / F.ln(1 + 0.5 * F.greatest(F.lit(1), n)))
    x = F.when(n > 1, F.least(F.lit(1.0), x * 1.1)).otherwise(x)
    x = F.when(F.col("n_against") > 0, F.least(x, F.when(F.col("against") > 0.5, 0.7).otherwise(0.85))).otherwise(x)
    out = agg.withColumn("strength", F.when(n == 0, 0.0).otherwise(x))
    kind = F.when(F.col("strength") > 0.6, "direct").when(F.col("strength") > 0.3, "inferred").when(F.col("strength") > 0.1, "weak").otherwise("none")
    return out.select("qid", "label", "n", "n_against", "against", "strength", kind.alias("match_type"))


def select_by_strength(matches: DataFrame) -> DataFrame:
    """qid, selected, confidence from strength(): scores by match type, then the gap of the best two decides how
    far the best is trusted (within .20 by sources, type and strength), and strong contradictions cap it."""
    m, n, free = F.col("match_type"), F.col("n"), F.col("n_against") == 0
    x = F.col("strength") * F.when(~free & (F.col("against") > 0.5), 0.6).when(~free & (F.col("against") > 0.3), 0.75).otherwise(1.0)
    x = x * F.when((m == "direct") & free, 1.8 * F.when(n > 1, 1.15).otherwise(1.0) * F.when(F.col("strength") > 0.8, 1.1).otherwise(1.0)).otherwise(1.0)
    x = x * F.when((m == "inferred") & free, 1.4 * F.when(n > 2, 1.1).otherwise(1.0)).otherwise(1.0) * F.when(m == "weak", 0.85 * F.when(n > 2, 1.05).otherwise(1.0)).otherwise(1.0)
    quality = F.when(m == "direct", 3).when(m == "inferred", 2).when(m == "weak", 1).otherwise(0)
    rows = matches.withColumns({"score": clamp(x), "quality": quality})
    order = W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "label")
    rows = rows.withColumns({"rk": F.row_number().over(order)} | {f"{c}2": F.lead(c).over(order) for c in ("score", "n", "quality", "strength")}).where("rk = 1")
    gap = F.col("score") - F.col("score2")
    lead = 0.4 * (n - F.col("n2")) + 0.3 * (F.col("quality") - F.col("quality2")) + 1.5 * (F.col("strength") - F.col("strength2"))
    trust = F.when(lead > 0.5, F.greatest(F.lit(0.90), 0.85 + (lead - 0.5) * 0.2)).when(lead > 0, F.greatest(F.lit(0.80), 0.75 + lead * 0.2)).otherwise(F.greatest(F.lit(0.70), gap / 0.20))
    clear = F.least(F.lit(1.0), F.col("score") * F.when(gap > 0.25, 1.1).when(gap > 0.15, 1.05).otherwise(1.0))
    clear = F.when(F.col("score2").isNull(), F.col("score")).otherwise(clear)
    clear = F.when(F.col("n_against") > 0, F.least(clear, F.when(F.col("against") > 0.5, 0.6).otherwise(0.75))).otherwise(clear)
    close = gap < 0.20
    return rows.select("qid", F.col("label").alias("selected"), F.when(close, F.greatest(F.lit(0.25), F.col("score") * trust)).otherwise(clear).alias("confidence"))


def grounded(claim: Column, evidence: Column) -> Column:
    """A claim is in the evidence as it stands, or by at least half of its words over four letters."""
    c, e = F.lower(claim), F.lower(evidence)
    long_ = F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 4)
    return F.contains(e, c) | ((F.size(long_) > 0) & (F.size(F.filter(long_, lambda w: F.contains(e, w))) >= 0.5 * F.size(long_)))


def hallucination(claims: DataFrame, most: float = 0.3, count: int = 3) -> DataFrame:
    """qid, n_bad, n_good, score, flagged from rows (qid, ok): flagged over the share or at so many bad claims."""
    bad, good = F.count_if(~F.col("ok")), F.count_if(F.col("ok"))
    score = F.coalesce(F.try_divide(bad.cast("double"), (bad + good).cast("double")), F.lit(0.0))
    return claims.groupBy("qid").agg(bad.alias("n_bad"), good.alias("n_good"), score.alias("score"), ((score > most) | (bad >= count)).alias("flagged"))


def checked_claims(answers: DataFrame) -> DataFrame:
    """qid, n_claims, n_bad, n_good, n_doses, n_doses_named, score, flagged for rows (qid, reasoning, context).

    Claims of treatment, diagnosis and contraindication count as good if grounded; a dose after a known drug is good
    as it is (no range ever refutes one), and n_doses_named tells how many the context names; a duration counts only
    if the context lacks it, as bad.
    """
    every = lambda p, g: F.regexp_extract_all("reasoning", F.lit("(?i)" + p), F.lit(g))
    rows = answers.select("qid", "reasoning", F.lower("context").alias("context"))
    before = lambda x: F.lower(F.substring(F.col("reasoning"), F.greatest(F.lit(1), x["at"] - 50), F.least(x["at"] - 1, F.lit(50))))
    drug = lambda x: F.try_element_at(contained(before(x), R.DOSED), F.lit(1))
    dose = lambda x: F.regexp_extract(x["match"], "^([0-9]+(?:\\.[0-9]+)?)", 1).cast("double")
    rows = rows.select("qid", "context", F.transform(F.concat(*(every(p, 1) for p in R.CLAIMS)), lambda c: F.trim(c)).alias("claims"),
        F.filter(F.transform(positions(F.col("reasoning"), "(?i)" + R.DOSE), lambda x: F.struct(drug(x).alias("drug"), dose(x).alias("dose"))), lambda d: d["drug"].isNotNull()).alias("doses"),
        F.arrays_zip(every(R.DURATION, 1).alias("n"), every(R.DURATION, 2).alias("unit")).alias("durations"))
    holds = lambda t: F.contains("context", t)
    named = lambda d: holds(d["drug"]) & (holds(d["dose"].cast("string")) | holds(F.floor(d["dose"]).cast("string")))
    lasting = lambda d: holds(F.concat_ws(" ", d["n"].cast("int").cast("string"), d["unit"])) | holds(F.concat_ws(" ", d["n"].cast("int").cast("string"), F.regexp_replace(d["unit"], "s+$", "")))
    good = F.size(F.filter("claims", lambda c: grounded(c, F.col("context")))) + F.size("doses")
    bad = F.size("claims") - F.size(F.filter("claims", lambda c: grounded(c, F.col("context")))) + F.size(F.filter("durations", lambda d: ~lasting(d)))
    out = rows.select("qid", F.size("claims").alias("n_claims"), bad.alias("n_bad"), good.alias("n_good"), F.size("doses").alias("n_doses"), F.size(F.filter("doses", named)).alias("n_doses_named"))
    score = F.coalesce(F.try_divide(F.col("n_bad").cast("double"), (F.col("n_bad") + F.col("n_good")).cast("double")), F.lit(0.0))
    return out.withColumn("score", score).withColumn("flagged", (F.col("score") > 0.3) | (F.col("n_bad") >= 3))
