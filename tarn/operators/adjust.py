"""Confidence adjustments after an answer: doubts, a second look at less context, agreement, grounding and safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calibration import clamp

#: Symptoms looked for in case and context; phrases that warn.
CASE_SYMPTOMS = ("pain", "fever", "cough", "bleeding", "vomiting", "diarrhea", "headache", "weakness", "fatigue", "seizure", "confusion")
WARNINGS = ("contraindicated", "not recommended", "avoid", "should not")


def long_words(text: Column, over: int = 4) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > over)


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def doubts(question: Column, case: Column, selected: Column, others: Column, context: Column) -> Column:
    """struct(errors, missing, alternatives, risk, grounding). others: array of the other options' texts; context:
    the texts of the first documents in one string."""
    low = F.struct(F.lower(context).alias("c"), F.lower(selected).alias("s"), F.lower(case).alias("k"))
    return let(low, lambda x: _doubts(question, x["k"], x["s"], others, x["c"]))


def _doubts(question: Column, case: Column, s: Column, others: Column, c: Column) -> Column:
    unsupported = (F.length(s) > 0) & ~F.contains(c, s) & ~F.exists(long_words(s), lambda w: F.contains(c, w))

    def warns(p: str) -> Column:
        around = F.substring(c, F.greatest(F.lit(1), F.instr(c, F.lit(p)) - 100), F.lit(200))
        return F.contains(c, F.lit(p)) & F.exists(long_words(s), lambda w: F.contains(around, w))

    warned = sum((warns(p).cast("int") for p in WARNINGS), F.lit(0))
    errors = unsupported.cast("int") + warned

    def rival(o: Column) -> Column:
        ws = long_words(o)
        hits = F.size(F.filter(ws, lambda w: F.contains(c, w)))
        return (hits >= 3) & (hits / F.greatest(F.lit(1), F.size(ws)) > 0.6)

    alternatives = F.size(F.filter(others, rival))
    in_case = [F.contains(case, F.lit(x)) for x in CASE_SYMPTOMS]
    n = sum((x.cast("int") for x in in_case), F.lit(0))
    both = sum(((x & F.contains(c, F.lit(t))).cast("int") for x, t in zip(in_case, CASE_SYMPTOMS, strict=True)), F.lit(0))
    asks = F.lower(question).rlike("treatment|therapy|management|prescribe|medication") & ~c.rlike("treatment:|therapy:|medication:|first-line|dose")
    missing = F.when((n > 0) & (both / F.greatest(F.lit(1), n) < 0.5), 1).otherwise(0) + asks.cast("int")
    counted = F.struct(errors.alias("errors"), missing.alias("missing"), alternatives.alias("alternatives"))
    return let(counted, _weighed)


def _weighed(n: Column) -> Column:
    risk = F.least(F.lit(1.0), 0.2 * n["errors"] + 0.15 * n["missing"])
    grounding = F.greatest(F.lit(0.0), 1 - 0.5 * risk - 0.1 * n["alternatives"])
    return F.struct(n["errors"].alias("errors"), n["missing"].alias("missing"), n["alternatives"].alias("alternatives"), risk.alias("risk"), grounding.alias("grounding"))


def after_doubts(confidence: Column, doubted: Column) -> Column:
    return let(doubted, lambda d: _after(confidence, d))


def _after(confidence: Column, d: Column) -> Column:
    x = (confidence - 0.1 * d["errors"] - 0.08 * d["missing"] - 0.05 * d["alternatives"]) * (1 - 0.3 * d["risk"])
    x = x * F.when(d["grounding"] > 0.8, 1.1).when(d["grounding"] < 0.5, 0.8).otherwise(1.0)
    return clamp(x, 0.05, 0.95)


def agreement(initial: Column, minimal: Column, differential: Column) -> Column:
    """The answer two of three give, else the first; and how many agree with it."""
    vote = F.when((initial == minimal) | (initial == differential), initial).when(minimal == differential, minimal).otherwise(initial)
    n = (initial == vote).cast("int") + (minimal == vote).cast("int") + F.coalesce((differential == vote).cast("int"), F.lit(0))
    return F.struct(vote.alias("answer"), n.alias("votes"))


def finished(confidence: Column, grounded: Column, safe: Column, dangerous: Column, agrees: Column) -> Column:
    """×.6 if not grounded; at most .2 if dangerous, ×1.05 up to .95 if safe; under .65 ×.8 on disagreement, ×1.1 up to .7 on agreement."""
    x = F.when(grounded, confidence).otherwise(confidence * 0.6)
    x = F.when(dangerous, F.least(x, F.lit(0.2))).when(safe, F.least(F.lit(0.95), x * 1.05)).otherwise(x)
    return F.when((x < 0.65) & ~agrees, x * 0.8).when((x < 0.65) & agrees, F.least(F.lit(0.7), x * 1.1)).otherwise(x)
