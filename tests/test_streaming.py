"""Streams of the event files, read in several batches, against the batch plans over the same rows."""

import os

import pytest

from pyspark.sql import functions as F
from tarn.streaming import events as X

EVENTS = "/root/testdata/sf0.001/events.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(EVENTS), reason="no test tables")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events in six files in order of time, so that no row is late, and then some of them once more."""
    path = str(tmp_path_factory.mktemp("stream") / "events")
    rows = spark.read.parquet(EVENTS).select("event_id", F.col("ts").cast("timestamp"), "user_id", "event_type", "value", F.col("props").cast("string"))
    ends = rows.selectExpr("percentile_approx(ts, array(.2, .4, .6, .8))").first()[0]
    for lo, hi in zip([None, *ends], [*ends, None], strict=True):
        part = rows.where((F.lit(lo is None) | (F.col("ts") > F.lit(lo))) & (F.lit(hi is None) | (F.col("ts") <= F.lit(hi))))
        part.coalesce(1).write.mode("append").parquet(path)
    rows.orderBy(F.desc("ts")).limit(40).coalesce(1).write.mode("append").parquet(path)
    return path


def streamed(spark, folder, build, mode, tmp_path):
    name = f"out_{abs(hash((build.__name__, mode)))}"
    query = build(X.source(spark, folder, files=1)).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) >= 6
    return spark.table(name)


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in df.collect())


@pytest.mark.parametrize("build", [X.tumbling, X.sessions])
def test_last_state_equals_the_batch(spark, folder, tmp_path, build):
    """In complete mode the last batch holds every window that state has gathered over the batches."""
    got = streamed(spark, folder, build, "complete", tmp_path)
    assert rows(got) == rows(build(spark.read.schema(X.SCHEMA).parquet(folder)))


def test_windows_are_put_out_once_the_watermark_has_passed(spark, folder, tmp_path):
    got = streamed(spark, folder, X.tumbling, "append", tmp_path)
    batch = rows(X.tumbling(spark.read.schema(X.SCHEMA).parquet(folder)))
    sent = rows(got)
    assert 0 < len(sent) <= len(batch) and set(sent) <= set(batch)


def test_events_seen_before_are_dropped(spark, folder, tmp_path):
    got = streamed(spark, folder, lambda e: X.deduplicated(e, "3650 days"), "append", tmp_path)
    every = spark.read.schema(X.SCHEMA).parquet(folder)
    assert every.count() == got.count() + 40 and got.select("event_id").distinct().count() == got.count()
