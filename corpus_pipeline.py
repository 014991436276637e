"""A corpus pipeline of operators of tarn.llm; each stage works on all that the one before it kept."""

from __future__ import annotations

from tarn.llm import jaccard_join, mixing, packing, quality, suffix_dedup
from tarn.llm.common import cut
from tarn.llm.queries import vocabulary


def good(spark, docs, sf_dir):
    """Documents that the quality classifier does not reject."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), 0.3)


def distinct(spark, docs, sf_dir):
    """One document, the one of smallest id, of each group of near copies."""
    return jaccard_join.first_of_each(docs, 80, width=5)


def unrepeated(spark, docs, sf_dir):
    """Texts without the bytes that an earlier document has as well."""
    return suffix_dedup.without_repeats(docs)


def mixed(spark, docs, sf_dir):
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs, (5, 2, 1), max_repeat=3)


def packed(spark, docs, sf_dir):
    """Pieces of the documents with their training sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), capacity=2048)


STAGES = [("quality classifier", good), ("n-gram Jaccard join", distinct), ("suffix-array dedup", unrepeated), ("mixing sources to target weights", mixed), ("best-fit packing", packed)]
#: Hashed models, components and packing are not to be had in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
