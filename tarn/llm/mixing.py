"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document gets a virtual finish time: the words its source has handed out up to and including it,
divided by the source's target. All sources run on this one clock, so ordering all documents by it and
stopping where the budget is spent takes each source in proportion to its target. Documents repeat in up
to max_repeat passes over their source.

Running sums never meet in one task: rows are dealt to slices of a fixed number of rows by the leading
part of the sort key, slices are summed, and only the slice totals are added up across slices, by blocks of them
and then across blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut

SLICE_ROWS = 2_000
#: Slice totals that are added up in one task.
BLOCK_SLICES = 4_096
#: Tables of up to so many rows (a few MB) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffled(id_: Column, seed: int) -> Column:
    """A place in the shuffled order: 60 bits of a digest that any SQL engine can work out."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], max_repeat: int) -> DataFrame:
    """Adds sid, target and slices to a table (source, n, source_size); null sources come last.

    Weights repeat over the sources by code point. All words are shared by weight; a source is full at
    max_repeat times its own words, and what it cannot take is shared by weight among the others. Taken in
    order of limit per unit of weight, each source is full or not at the level of all that are left, and
    the level of the first one that is not holds for the rest.
    """
    everyone = W.partitionBy(F.lit(0))
    by_name, by_limit = everyone.orderBy(F.col("source").asc_nulls_last()), everyone.orderBy("unit", "sid")
    sid = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("sid", sid).withColumn("weight", weight).withColumn("limit", (max_repeat * F.col("source_size")).cast("double"))
    s = s.withColumn("unit", F.col("limit") / F.col("weight"))
    spent = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_limit.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(everyone).cast("double") - spent) / left)
    s = s.withColumn("level", F.min(F.when(F.col("unit") > F.col("level"), F.struct("unit", "sid", "level"))).over(everyone)["level"])
    s = s.withColumn("target", F.least("limit", F.coalesce(F.col("weight") * F.col("level"), F.col("limit"))))
    return s.select("source", "sid", "n", "source_size", "target")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def running(totals: DataFrame, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds upto, the sum of words in the order up to the row; order holds whole numbers, once for each keys."""
    totals = cut(totals.withColumn("block", F.floor(F.col(order) / BLOCK_SLICES)))
    earlier = F.sum("held").over(W.partitionBy(*keys, F.lit(0)).orderBy("block").rowsBetween(W.unboundedPreceding, -1))  # a row for each block
    blocks = totals.groupBy(*keys, "block").agg(F.sum("words").alias("held")).select(*keys, "block", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    inside = F.sum("words").over(W.partitionBy(*keys, "block").orderBy(order))
    return totals.withColumn("inside", inside).join(blocks, [*keys, "block"]).withColumn("upto", F.col("inside") + F.col("earlier")).drop("block", "inside", "earlier")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), *, max_repeat: int = 3, seed: int = 7, slice_rows: int = SLICE_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, source, size (words), source_size, target, copies (0 to max_repeat) and taken = copies * size.

    A null text has size 0; such rows cost nothing. A null source is a source of its own, named last. Rows
    with the same id, source and size share one place in the order and one decision. An empty table gives
    an empty result. Other columns are not read. The order within a source is a seeded hash of the id.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = cut(rows.withColumn("h", shuffled(F.col("id"), seed)))
    sources = cut(targets(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), weights, max_repeat))
    per = sources.withColumn("slices", F.ceil(F.col("n") / slice_rows))
    rows = rows.withColumnRenamed("source", "own_source").join(small(per, sources.count()), F.col("own_source").eqNullSafe(F.col("source"))).drop("own_source")
    rows = rows.withColumn("slice", F.floor(F.shiftrightunsigned("h", 29) * F.col("slices") / F.lit(2.0**31)))

    totals = rows.groupBy("sid", "slice").agg(F.sum("size").alias("words"))
    totals = cut(running(totals, "slice", ("sid",)).select("sid", "slice", (F.col("upto") - F.col("words")).alias("before")))
    within = W.partitionBy("sid", "slice").orderBy("h", "id", "size")  # equal rows are peers: one sum for all
    rows = rows.withColumn("so_far", F.sum("size").over(within)).join(small(totals, totals.count()), ["sid", "slice"])
    rows = rows.withColumn("so_far", F.col("so_far") + F.col("before"))
    finish = lambda k: F.coalesce(F.try_divide((k * F.col("source_size") + F.col("so_far")).cast("double"), F.col("target")), F.lit(0.0))
    rows = cut(rows.select("id", "source", "h", "size", "source_size", "target", F.array(*(finish(F.lit(k)) for k in range(max_repeat))).alias("finish")))

    # The global order, by ranges of the clock: whole ranges fit until one crosses the budget.
    n = max(1, -(-rows.count() // slice_rows))
    turns = rows.select("id", "h", "size", F.explode("finish").alias("finish")).withColumn("range", F.floor(F.col("finish") * n))
    by_range = running(turns.groupBy("range").agg(F.sum("size").alias("words")), "range")
    budget = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget"))
    crossing = by_range.crossJoin(F.broadcast(budget)).where(F.col("upto") > F.col("budget"))  # budget is one row
    crossing = cut(crossing.orderBy("range").limit(1).select("range", (F.col("budget") - F.col("upto") + F.col("words")).alias("room")))
    inside = turns.join(F.broadcast(crossing), "range")  # one row
    inside = inside.withColumn("upto", F.sum("size").over(W.partitionBy("range").orderBy("finish", "h", "id", "size")))
    last = inside.where(F.col("upto") <= F.col("room")).agg(F.max(F.struct("finish", "h", "id", "size")).alias("last"))
    ends = F.broadcast(last.crossJoin(F.broadcast(crossing.agg(F.min("range").alias("cross")))))  # one row each
    rows = rows.crossJoin(ends)
    at = lambda f: F.struct(f.alias("finish"), "h", "id", "size")
    taken = lambda f: F.coalesce(F.floor(f * n) < F.col("cross"), F.lit(True)) | F.coalesce((F.floor(f * n) == F.col("cross")) & (at(f) <= F.col("last")), F.lit(False))
    copies = F.size(F.filter("finish", taken))
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; columns as in docs.

    Rows are found again by id, source and size, so equal rows meet the decision they share.
    """
    mine = mix(docs, weights, **options).where("copies > 0").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.first("copies").alias("_copies"))
    keyed = docs.withColumn("_own", word_count(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_own") == F.col("_size"))
    return keyed.join(mine, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
