"""Terms of a lexicon in texts as joins: the lexicon is a table of any size, and the work follows the texts, not the
number of terms times the texts. A term is keyed by how it starts, a text by what it has of such starts, and what meets
is verified in full. Three kinds of match: as a run of whole tokens, between word boundaries, and anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from .retrieval import listed, sized

#: Characters by which a term is keyed where it may begin anywhere.
START = 3
_WORDS = lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))


def ready(lexicon: DataFrame, term: str = "term", group: str = "grp", rank: str = "place") -> tuple[DataFrame, int]:
    """(term, grp, place) with lower-cased, trimmed, distinct terms that are not empty, and their number."""
    out = lexicon.select(F.trim(F.lower(term)).alias("term"), F.col(group).alias("grp"), F.col(rank).alias("place")).where("term <> ''")
    out = out.groupBy("term", "grp").agg(F.min("place").alias("place"))
    return out, out.count()


def token_runs(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """id, at, term, grp, place: every place (token number from 0) where a term stands as a run of whole tokens.

    texts has id and text. A token goes on with as many followers as the longest term has, and only if a term starts
    with it: a walk down a tree of tokens whose first step is the join. Terms without a token match nothing.
    """
    words, n = ready(lexicon)
    words = words.withColumn("run", _WORDS(F.col("term"))).where(F.size("run") > 0)
    longest = words.agg(F.max(F.size("run"))).first()[0] or 1
    words = sized(words.withColumn("first", F.element_at("run", 1)), n)
    held = texts.select("id", _WORDS(F.lower("text")).alias("all"))
    steps = F.transform("all", lambda t, i: F.struct(i.alias("at"), t.alias("first"), F.slice("all", i + 1, longest).alias("ahead")))
    here = listed(held, steps, "x", "id").select("id", "x.at", "x.first", "x.ahead")
    met = here.join(words, "first").where(F.slice("ahead", F.lit(1), F.size("run")) == F.col("run"))
    return met.select("id", F.col("at").cast("long").alias("at"), "term", "grp", "place")


def bounded_terms(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """id, term, grp, place: terms that stand in a text with no letter, digit or underscore right before or after, once
    each. A term has to start and end with such a character; its first token is then a token of the text."""
    words, n = ready(lexicon)
    words = sized(words.where(F.col("term").rlike(r"^[\p{L}\p{N}_](.*[\p{L}\p{N}_])?$")).withColumn("first", F.element_at(_WORDS(F.col("term")), 1)), n)
    keys = listed(texts, F.array_distinct(_WORDS(F.lower("text"))), "first", "id")
    met = keys.join(words, "first").select("id", "term", "grp", "place")
    edge = r"[\p{L}\p{N}_]"
    pattern = F.concat(F.lit(f"(?<!{edge})\\Q"), "term", F.lit(f"\\E(?!{edge})"))
    return met.join(texts.select("id", F.lower("text").alias("low")), "id").where(F.regexp_like("low", pattern)).select("id", "term", "grp", "place")


def contained_terms(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """id, term, grp, place: terms that are anywhere in a text, once each. Keys are the first START characters; a text has
    each run of so many characters once."""
    words, n = ready(lexicon)
    sizes = sorted(r[0] for r in words.select(F.least(F.length("term"), F.lit(START))).distinct().collect())  # START rows at most
    words = sized(words.withColumn("start", F.substring("term", 1, START)), n)
    low = F.lower(F.coalesce("text", F.lit("")))
    runs = [F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))) for k in sizes] or [F.array().cast("array<string>")]
    met = listed(texts, F.concat(*runs), "start", "id").join(words, "start").select("id", "term", "grp", "place")
    return met.join(texts.select("id", F.lower("text").alias("low")), "id").where(F.contains("low", "term")).select("id", "term", "grp", "place")


def first_of_groups(found: DataFrame) -> DataFrame:
    """id, grp, term, n: of each group the term that comes first in the lexicon, and how many of it were found."""
    return found.groupBy("id", "grp").agg(F.min_by("term", F.struct("place", "term")).alias("term"), F.count_distinct("term").alias("n"))


def injected(texts: DataFrame, lexicon: DataFrame, found: DataFrame, most: int = 3) -> DataFrame:
    """id, text with, for each group found (in the lexicon's order), its first `most` other terms added at the end; texts
    without a group stay as they are."""
    words, n = ready(lexicon)
    heads = found.groupBy("id", "grp").agg(F.collect_set("term").alias("own"), F.min("place").alias("at"))  # as many as a group has terms
    more = heads.join(sized(words, n), "grp").where(~F.array_contains("own", F.col("term")))
    more = more.withColumn("k", F.row_number().over(W.partitionBy("id", "grp").orderBy("place", "term"))).where(F.col("k") <= most)
    added = more.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "grp", "k", "term"))).alias("more"))
    out = texts.select("id", "text").join(added, "id", "left")
    return out.select("id", F.concat_ws(" ", "text", F.transform("more", lambda x: x["term"])).alias("text"))
