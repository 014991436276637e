"""Text functions as column expressions: tokens, sentences, keywords, excerpts and the three kinds of lexicon match.

Everything here stays inside generated code; nothing is a Python function of a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
LONG_TOKEN = r"[\p{L}\p{N}_]{2,}+"
#: Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = (r"Dr\.", r"vs\.", r"e\.g\.", r"i\.e\.", r"etc\.")
#: Words that are no keywords.
STOP_WORDS = ("that", "this", "with", "from", "have", "been", "were", "what", "which", "most")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of two characters or more, in order, repeats kept. No
    lambda: its variable has a name of its own in every plan, so that equal exchanges above it would not be one."""
    return F.regexp_extract_all(F.lower(text), F.lit(LONG_TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences end at white space after . ! or ? and before a capital A-Z; dots of known abbreviations are
    masked by @, and afterwards every @ of the text becomes a dot."""
    masked = text
    for a in ABBREVIATIONS:
        plain = a.replace("\\", "")
        masked = F.replace(masked, F.lit(plain), F.lit(plain.replace(".", "", plain.count(".") - 1).replace(".", "@")))
    parts = F.split(masked, r"(?<=[.!?])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("@"), F.lit(".")))), lambda s: F.length(s) > 0)


def loose_sentences(text: Column, least: int = 10) -> Column:
    """Parts between marks and white space, stripped, of more than `least` characters."""
    return F.filter(F.transform(F.split(text, r"[.!?]\s+"), lambda x: F.trim(x)), lambda s: F.length(s) > least)


def keywords(text: Column, most: int = 20, stop: Sequence[str] = STOP_WORDS) -> Column:
    """The first words of four letters or more that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.slice(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*stop)), 1, most)


def excerpt(query: Column, content: Column, size: int = 400) -> Column:
    """Up to size characters around the first hit of the query, else around its first keyword that occurs, else
    the head; three dots mark a cut."""
    low = F.lower(content)
    hit = F.instr(low, F.lower(query))
    other = F.try_element_at(F.filter(F.transform(keywords(query), lambda k: F.instr(low, k)), lambda i: i > 0), F.lit(1))
    at = F.coalesce(F.nullif(hit, F.lit(0)), other)
    start = F.greatest(F.lit(1), at - size // 2)
    end = F.least(F.length(content), at + size // 2)
    middle = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(content, start, end - start + 1), F.when(end < F.length(content), "...").otherwise(""))
    head = F.when(F.length(content) > size, F.concat(F.substring(content, 1, size), F.lit("..."))).otherwise(content)
    return F.when(at.isNull(), head).otherwise(middle)


def scenario_hash(text: Column) -> Column:
    """Sixteen hexadecimal digits that texts share which differ in case, numbers and spacing only."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "N"), r"\s+", " ")
    return F.substring(F.md5(plain), 1, 16)


def contained(text: Column, terms: Sequence[str]) -> Column:
    """Terms that are substrings of the text, in the order given. The text, which may be lower-cased here, is worked
    out once and not for each term."""
    found = lambda x: F.array_compact(F.array(*(F.when(F.contains(x, F.lit(t)), F.lit(t)) for t in terms)))
    return F.element_at(F.transform(F.array(text), found), 1)


def bounded(text: Column, terms: Sequence[str]) -> Column:
    """Distinct terms found between word boundaries, in alphabetical order."""
    import re

    pattern = r"\b(" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + r")\b"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))


def word_set(text: Column) -> Column:
    """Distinct words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words by all words of two arrays of distinct words; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def weight_of(text: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the terms that are substrings of the text."""
    total = F.lit(0.0)
    for term, w in weights.items():
        total = total + F.when(F.contains(text, F.lit(term)), F.lit(float(w))).otherwise(F.lit(0.0))
    return total


def positions(text: Column, pattern: str) -> Column:
    """Array of struct(at, match): the matches of a pattern and where each starts, from 1. The parts between the
    matches tell; a match is never empty."""
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))
    at = lambda i: size(F.slice(parts, F.lit(1), i + 1)) + size(F.slice(found, F.lit(1), i)) + 1
    return F.transform(found, lambda m, i: F.struct(at(i).alias("at"), m.alias("match")))
