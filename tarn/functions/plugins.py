"""Models as plug-ins: embedders, cross-scorers and text generators wrapped as Arrow-batched functions.

A plug-in is a factory: it is called once in each worker and gives a function of a list. Without a model, the
library falls back on hashed vectors, the weighted sum of earlier scores, and the rule-based path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F


def embedder(factory: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64):
    """Column function text -> array<float>."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in parts:
            rows = texts.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(rows), batch) for v in model(rows[i : i + batch])], dtype=object)

    return embed


def cross_scorer(factory: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], longest: int = 500):
    """Column function (query, text) -> double; only the first `longest` characters of the text are scored."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for q, t in parts:
            yield pd.Series(model([(a or "", (b or "")[:longest]) for a, b in zip(q, t, strict=True)]), dtype="float64")

    return score


def generator(factory: Callable[[], Callable[[str], str]]):
    """Column function prompt -> answer; an error of the model gives null for that row."""

    @F.pandas_udf("string")
    def answer(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()

        def one(prompt):
            try:
                return model(prompt)
            except Exception:  # the rule-based path takes over
                return None

        for prompts in parts:
            yield prompts.map(one)

    return answer


def parsed_answer(text):
    """struct(answer, confidence) from a generated text."""
    letter = F.nullif(F.regexp_extract(text, r"(?i)answer\s*[:\-]?\s*\(?([A-E])\b", 1), F.lit(""))
    share = F.nullif(F.regexp_extract(text, r"(?i)confidence\s*[:\-]?\s*(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    return F.struct(F.upper(letter).alias("answer"), F.when(share > 1, share / 100).otherwise(share).alias("confidence"))
