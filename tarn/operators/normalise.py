"""Terminology of a text in four ordered passes: abbreviations, synonyms, units, terms of a specialty.

Each pass is a fold of rewritings over the lower-cased text inside generated code: the result of one is what the next
one sees, so what an earlier one has added can be met again, as the published rules have it. The tables are
parameters; those below are fixed values.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units after a number, and terms of a specialty with what is put behind them (the first two).
UNITS = {
    "c": "celsius", "f": "fahrenheit", "kg": "kilogram", "lb": "pound", "mg": "milligram", "g": "gram", "mcg": "microgram", "μg": "microgram",
    "ml": "milliliter", "l": "liter", "mmhg": "millimeters of mercury", "bpm": "beats per minute", "mmol/l": "millimoles per liter",
    "mg/dl": "milligrams per deciliter", "meq/l": "milliequivalents per liter",
}
PEDIATRIC = {
    "newborn": ["neonate", "neonatal", "infant 0-28 days"], "infant": ["baby", "young child", "infant 1-12 months"], "toddler": ["young child", "child 1-3 years"],
    "child": ["pediatric patient", "juvenile"], "adolescent": ["teenager", "teen", "young adult"],
}
PREGNANCY = {
    "pregnant": ["gravid", "gestational", "prenatal", "antenatal"], "postpartum": ["postnatal", "after delivery", "puerperal"], "labor": ["labour", "contractions", "active labor"],
    "delivery": ["birth", "childbirth", "parturition"], "trimester": ["first trimester", "second trimester", "third trimester"], "fetus": ["foetus", "unborn baby", "intrauterine"],
}
EMERGENCY = {
    "emergency": ["urgent", "critical", "life-threatening", "acute"], "resuscitation": ["resus", "cpr", "life support"],
    "shock": ["hemodynamic instability", "circulatory failure"], "arrest": ["cardiac arrest", "respiratory arrest", "code"],
}
SPECIALTY = PEDIATRIC | PREGNANCY | EMERGENCY
#: A letter, digit or underscore of any alphabet, which a word boundary stands beside.
WORD = r"[\p{L}\p{N}_]"


def with_abbreviations(text: Column, table: Mapping[str, str]) -> Column:
    """Behind each abbreviation that stands as a word, what it means."""
    for short, long in table.items():
        text = F.regexp_replace(text, f"(?<!{WORD}){re.escape(short)}(?!{WORD})", f"{short} {long}")
    return text


def with_added(text: Column, table: Mapping[str, Sequence[str]], most: int = 2) -> Column:
    """Behind each term, wherever it is, the first `most` terms of its row."""
    for term, more in table.items():
        text = F.replace(text, F.lit(term), F.lit(" ".join([term, *more[:most]])))
    return text


def with_units(text: Column, table: Mapping[str, str] = UNITS) -> Column:
    """A number and a unit become the number, one space and the unit's name. A unit ends where a word does."""
    for unit, name in table.items():
        text = F.regexp_replace(text, rf"([0-9]+)\s*{re.escape(unit)}(?!{WORD})", f"$1 {name}")
    return text


def normalised(text: Column, abbreviations: Mapping[str, str], synonyms: Mapping[str, Sequence[str]], units: Mapping[str, str] = UNITS, specialty: Mapping[str, Sequence[str]] = SPECIALTY) -> Column:
    """All four passes in order; null stays null. Synonyms come with lower-cased terms, as the reader gives them."""
    return with_added(with_units(with_added(with_abbreviations(F.lower(text), abbreviations), synonyms), units), specialty)
