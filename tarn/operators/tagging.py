"""Tags of texts: lexicon tags of chunks, symptoms with severity and negation, vital signs, claims."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import rules as R
from ..functions.text import contained, positions


def pattern_tags(text: Column, pattern: str, most: int = 10) -> Column:
    """Distinct matches between word boundaries in alphabetical order, at most `most`."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"\b({pattern})\b"), F.lit(1)))), 1, most)


def chunk_tags(chunks: DataFrame, text: str = "content") -> DataFrame:
    """Adds diseases, symptoms, treatments and whether the text has a treatment protocol or diagnostic part."""
    c, low = F.col(text), F.lower(text)
    return chunks.withColumns({"diseases": pattern_tags(c, L.CHUNK_DISEASES), "symptoms": pattern_tags(c, L.CHUNK_SYMPTOMS), "treatments": pattern_tags(c, L.CHUNK_TREATMENTS), "has_treatment_protocol": low.contains("treatment") | low.contains("management"), "has_diagnostic_info": low.contains("diagnos") | low.contains("criteria")})


def section_tags(text: Column) -> Column:
    low = F.lower(text)
    rules = {"red_flags": "red flag", "diagnosis": "diagnostic|diagnosis", "management": "treatment|management", "investigations": "investigation|ecg|troponin", "risk_stratification": "risk"}
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(k)) for k, p in rules.items())))


def numbers(text: Column) -> Column:
    """struct of vital signs as numbers; null where a text has none."""
    low = F.lower(text)
    get = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit("")).try_cast("double")
    return F.struct(
        get(r"(?:hr|heart rate|pulse)\D{0,10}(\d{2,3})").alias("heart_rate"), get(r"(?:bp|blood pressure)\D{0,10}(\d{2,3})\s*/").alias("systolic"),
        get(r"(?:temp|temperature)\D{0,10}(\d{2,3}(?:\.\d+)?)").alias("temperature"), get(r"(?:rr|respiratory rate)\D{0,10}(\d{1,2})").alias("respiratory_rate"), get(r"(?:spo2|oxygen saturation|o2 sat)\D{0,10}(\d{2,3})").alias("spo2"),
    )


def abnormal(vital: str, value: Column) -> Column:
    """Outside the usual range; an unreadable value is not."""
    v = value.try_cast("double")
    limits = {"heart_rate": (60, 100), "systolic": (90, 140), "temperature": (36, 38), "respiratory_rate": (12, 20), "spo2": (95, None)}
    low, high = limits[vital]
    out = v < low
    return F.coalesce(out if high is None else out | (v > high), F.lit(False))


def weighted_terms(text: Column, terms: list[str], strong: list[str], least: float = 0.1) -> Column:
    """struct(score, positive): share of terms found, .2 more for each strong one, at most 1; positive over least."""
    low = F.lower(text)
    n = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    m = sum((F.contains(low, F.lit(t)).cast("int") for t in strong), F.lit(0))
    score = F.least(F.lit(1.0), n / F.lit(float(len(terms))) + 0.2 * m)
    return F.struct(score.alias("score"), (score > least).alias("positive"))


def occurrences(texts: DataFrame, lexicon: dict[str, tuple[str, list[str]]], *, id_: str = "doc_id", text: str = "text", cues: tuple[str, ...] = ("no ", "denies", "without", "absence of", "negative for", "not ", "ruled out", "free of"), before: int = 50) -> DataFrame:
    """id, symptom, severity, position (from 0), negated: every whole-word occurrence of a symptom's variants; it is
    negated if a cue is among the characters before it. The worst come first, then by place. lexicon: symptom ->
    (severity, variants)."""
    def places(symptom: str, severity: str, variants: list[str]) -> Column:
        pattern = r"\b(?:" + "|".join(map(re.escape, sorted(variants, key=len, reverse=True))) + r")\b"
        rank = {"critical": 0, "moderate": 1, "mild": 2}.get(severity, 3)
        return F.transform(positions(F.col("low"), pattern), lambda x: F.struct(F.lit(rank).alias("rank"), (x["at"] - 1).alias("position"), F.lit(symptom).alias("symptom"), F.lit(severity).alias("severity")))

    low = texts.select(id_, F.lower(text).alias("low"))
    found = F.concat(*(places(symptom, *of) for symptom, of in lexicon.items()))
    rows = low.select(id_, "low", F.explode(F.array_sort(found)).alias("x")).select(id_, "low", "x.*")
    ahead = F.substring(F.col("low"), F.greatest(F.lit(1), F.col("position") + 1 - before), F.least(F.col("position"), F.lit(before)))
    negated = F.lit(False)
    for c in cues:
        negated = negated | F.contains(ahead, F.lit(c))
    return rows.select(id_, "symptom", "severity", "position", negated.alias("negated"))


def needed(pattern: str) -> list[str]:
    """Lower-cased literals of which every match of the pattern holds one: those of its first group of alternatives, or
    what it begins with; empty if neither tells."""
    group = re.search(r"\(\?:([^()]*)\)(?![?*{])", pattern)
    parts = group[1].split("|") if group else [pattern]
    plain = [re.sub(r".$", "", m[0]) if x[m.end() : m.end() + 1] in ("?", "*", "{") else m[0] for x in parts for m in [re.match(r"[A-Za-z0-9 /]*", x)]]
    return [x.lower() for x in plain] if all(plain) else []


def lacking(low: Column, pattern: str) -> Column:
    """Whether the lower-cased text cannot have a match, as no literal that the pattern needs is in it."""
    out = F.lit(bool(needed(pattern)))
    for x in needed(pattern):
        out = out & ~F.contains(low, F.lit(x))
    return out


def first_matches(text: Column, table: dict[str, list[str]], low: Column | None = None) -> Column:
    """map(name, value): of each name the first capture of its first pattern that matches, whatever the case. low is the
    lower-cased text."""
    low = F.lower(text) if low is None else low
    found = lambda p: F.when(~lacking(low, p), F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")))
    first = lambda ps: F.coalesce(*map(found, ps))
    return F.map_filter(F.create_map(*(c for k, ps in table.items() for c in (F.lit(k), first(ps)))), lambda _, v: v.isNotNull())


def named(text: Column, terms: tuple[str, ...], forms: tuple[str, ...] = ()) -> Column:
    """Terms that are in the lower-cased text, and what forms of words name in over three characters; sorted."""
    none = F.array().cast("array<string>")
    others = (F.when(lacking(text, p), none).otherwise(F.regexp_extract_all(text, F.lit(p), F.lit(1))) for p in forms)
    more = F.filter(F.transform(F.concat(none, *others), lambda x: F.trim(x)), lambda x: F.length(x) > 3)
    return F.array_sort(F.array_distinct(F.concat(contained(text, terms), more)))


def case_features(cases: DataFrame, text: str = "case_text") -> DataFrame:
    """Adds vitals and labs (maps), abnormal (names of vitals out of range), diseases, risks and medications."""
    low, v = F.col("low"), F.col("vitals")
    names = {"HR": "heart_rate", "BP": "systolic", "Temp": "temperature", "RR": "respiratory_rate", "SpO2": "spo2"}
    value = lambda k: F.regexp_extract(v[k], "^([0-9]+(?:[.][0-9]+)?)", 1)
    # The lower-cased text is a column of its own, as an expression it would be worked out anew for each pattern.
    out = cases.withColumn("low", F.lower(text)).withColumns({"vitals": first_matches(F.col(text), R.VITALS, low), "labs": first_matches(F.col(text), R.LABS, low), "diseases": named(low, R.CHRONIC, R.CHRONIC_FORMS), "risks": contained(low, R.RISKS), "medications": named(low, R.MEDICATIONS, R.MEDICATION_FORMS)}).drop("low")
    return out.withColumn("abnormal", F.array_compact(F.array(*(F.when(abnormal(kind, value(k)), F.lit(k)) for k, kind in names.items()))))


def claims(text: Column, patterns: list[str]) -> Column:
    """Captures of all patterns, in their order."""
    return F.concat(*(F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(1)) for p in patterns))
