"""Parameter sweeps: the grid is a table that is joined before fusion, so one job scores all settings."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .calibration import clamp
from .rerank import squash


def grid(spark: SparkSession, **values) -> DataFrame:
    """One row per combination, numbered by config; driver-made, as many rows as the caller lists."""
    names = list(values)
    rows = [(i, *map(float, x)) for i, x in enumerate(product(*values.values()))]
    return spark.createDataFrame(rows, "config int, " + ", ".join(f"{n} double" for n in names))


def near_one(settings: DataFrame, names: tuple[str, ...], slack: float) -> DataFrame:
    """Settings whose weights add up to 1 within slack."""
    return settings.where(F.abs(sum((F.col(n) for n in names), F.lit(0.0)) - 1) <= slack + 1e-9)


def swept_fusion(pairs: DataFrame, settings: DataFrame, k: int) -> DataFrame:
    """config, qid, rk, doc_id, score: weighted sums of a_score and b_score under every setting (wa, wb)."""
    scored = pairs.crossJoin(F.broadcast(settings)).withColumn("score", F.col("wa") * F.col("a_score") + F.col("wb") * F.col("b_score"))
    order = W.partitionBy("config", "qid").orderBy(F.round("score", 9).desc(), "doc_id")
    return scored.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select("config", "qid", "rk", "doc_id", "score")


def swept_metrics(ranked: DataFrame, relevant: DataFrame, queries: int, k: int = 5) -> DataFrame:
    """config, precision, recall, objective = F1 + .3 MRR, over all queries (those without hits count as 0)."""
    n = relevant.groupBy("qid").agg(F.count("*").alias("n_rel"))
    rows = ranked.join(relevant.withColumn("rel", F.lit(1)), ["qid", "doc_id"], "left").join(n, "qid", "left")
    each = rows.groupBy("config", "qid").agg((F.sum(F.coalesce("rel", F.lit(0))) / k).alias("p"), F.coalesce(F.sum(F.coalesce("rel", F.lit(0))) / F.max("n_rel"), F.lit(0.0)).alias("r"), F.coalesce(F.max(F.col("rel") / F.col("rk")), F.lit(0.0)).alias("rr"))
    out = each.groupBy("config").agg((F.sum("p") / queries).alias("precision"), (F.sum("r") / queries).alias("recall"), (F.sum("rr") / queries).alias("mrr"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("objective", f1 + 0.3 * F.col("mrr"))


def within(settings: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Settings that lie within the least and most values given; None leaves an end open."""
    for name, (least, most) in bounds.items():
        if least is not None:
            settings = settings.where(F.col(name) >= least)
        if most is not None:
            settings = settings.where(F.col(name) <= most)
    return settings


def validated(ranked: DataFrame, relevant: DataFrame, queries: int, k: int = 5) -> DataFrame:
    """config, precision and recall at k, map, errors of ranked rows (config, qid, rk, doc_id), over all queries.

    map adds 1 / rank of all relevant documents that are ranked, by their number; errors are queries that have
    relevant documents, none of which is ranked.
    """
    n = relevant.groupBy("qid").agg(F.count("*").alias("n_rel"))
    hits = ranked.join(relevant.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi").join(n, "qid")
    each = hits.groupBy("config", "qid").agg(F.count_if(F.col("rk") <= k).alias("near"), F.max("n_rel").alias("n_rel"), F.sum(1 / F.col("rk")).alias("gain"))
    sums = each.groupBy("config").agg((F.sum("near") / k).alias("p"), F.sum(F.col("near") / F.col("n_rel")).alias("r"), F.sum(F.col("gain") / F.col("n_rel")).alias("m"), F.count("*").alias("met"))
    every = ranked.select("config").distinct().join(sums, "config", "left").crossJoin(F.broadcast(n.agg(F.count("*").alias("asked"))))  # one row
    mean = lambda c: F.coalesce(F.col(c) / queries, F.lit(0.0))
    return every.select("config", mean("p").alias("precision"), mean("r").alias("recall"), mean("m").alias("map"), (F.col("asked") - F.coalesce("met", F.lit(0))).alias("errors"))


def objective(precision, recall, mean_ap, errors, kind: str = "balanced"):
    """precision, recall, f1, or .4 precision + .4 recall + .2 MAP - .05 errors."""
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return {"precision": precision, "recall": recall, "f1": f1}.get(kind, 0.4 * precision + 0.4 * recall + 0.2 * mean_ap - 0.05 * errors)


KINDS = ("precision", "recall", "f1", "balanced")


def optimised(metrics: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """kind, config, score, best: every setting under every objective; the best is the first of those with most."""
    scores = F.array(*(F.struct(F.lit(k).alias("kind"), objective(*(F.col(c) for c in ("precision", "recall", "map", "errors")), k).alias("score")) for k in kinds))
    rows = metrics.select("config", F.inline(scores))
    first = F.row_number().over(W.partitionBy("kind").orderBy(F.round("score", 9).desc(), "config"))  # settings are as many as the caller lists
    return rows.select("kind", "config", "score", (first == 1).alias("best"))


def swept_stages(pairs: DataFrame, triples: tuple[tuple[float, float, float], ...], k: int, thresholds: tuple[float, ...] = (0.0,)) -> DataFrame:
    """config, qid, rk, doc_id, score of the three-stage score under every triple of weights and every least score;
    pairs: qid, doc_id, s1, s2. Settings are numbered by triple, then by threshold."""
    spark = pairs.sparkSession
    rows = [(i * len(thresholds) + j, *map(float, w), float(t)) for i, w in enumerate(triples) for j, t in enumerate(thresholds)]
    settings = spark.createDataFrame(rows, "config int, w1 double, w2 double, w3 double, least double")
    x = pairs.crossJoin(F.broadcast(settings))  # as many rows as the caller lists
    a, b = clamp(F.col("s1")), squash(F.col("s2"))
    c = clamp(F.col("w1") * F.col("s1") + F.col("w2") * F.col("s2"))
    base = F.col("w1") * a + F.col("w2") * b + F.col("w3") * c
    high = sum(((y > 0.6).cast("int") for y in (a, b, c)), F.lit(0))
    x = x.withColumn("score", F.when(high >= 2, F.least(F.lit(1.0), base * 1.1)).otherwise(base)).where(F.col("score") >= F.col("least"))
    order = W.partitionBy("config", "qid").orderBy(F.round("score", 9).desc(), "doc_id")
    return x.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select("config", "qid", "rk", "doc_id", "score")


def place_of(id_, seed: int):
    """A number below 2 ** 28 for an id: the head of a digest that any SQL engine can work out."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string"))), 1, 7), 16, 10).cast("long")


def split(rows: DataFrame, id_: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds fold: train or test, by a seeded digest of the id, so that it never changes with the plan."""
    return rows.withColumn("fold", F.when(place_of(F.col(id_), seed) % 10_000 < int(share * 10_000), "train").otherwise("test"))


def sampled(rows: DataFrame, id_: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same ones whatever the partitions."""
    return rows.orderBy(place_of(F.col(id_), seed), id_).limit(n)
