"""Writers: indexes, guideline texts, question sets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_index(chunks: DataFrame, path: str) -> None:
    """Chunks with metadata and vectors in one Parquet table."""
    chunks.write.mode("overwrite").parquet(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_texts(docs: DataFrame, path: str, id_: str = "guideline_id", text: str = "content") -> None:
    """One folder of text per document."""
    docs.select(F.col(id_).alias("_id"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("_id").text(path)


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """section, row (JSON): small result tables in one table, to be written or shown. Nothing is gathered here."""
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = one if out is None else out.unionByName(one)
    return out


def distributions(rows: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """dimension, value, n in one pass."""
    pair = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions)))
    return rows.select(pair.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
