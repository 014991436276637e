"""Exact deduplication as a stateful stream, in DataFrame operations only.

The files of a table are read as a stream. Its state, kept on disk by the RocksDB provider and never expired, has a
row for each digest of a normalised text: the number of rows seen, and the stable id and content locator (file and
row) of the row that stays. After the stream has caught up, every text of a digest that was hit is read again and
compared in full; digests under which different texts have met are parted by the texts themselves.
"""

from __future__ import annotations

import uuid
from contextlib import ExitStack

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import setting
from .common import cut, shared_dir

#: Characters that do not count when texts are compared.
IGNORED = " \t\n\x0b\x0c\r"
#: State on disk, with one bound of memory for all stores of an executor.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store sets megabytes of disk aside
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
FILES_PER_BATCH = 1_000


def located(rows: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    """(id, text without the ignored characters, chars of the original, sha, digest, file, row)."""
    original = F.coalesce(F.col(text_col), F.lit(""))
    rows = rows.select(F.col(id_col).alias("id"), F.translate(original, IGNORED, "").alias("plain"), F.length(original).cast("long").alias("chars"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.withColumn("sha", F.unhex(F.sha2("plain", 256))).withColumn("digest", F.substring("sha", 1, digest_bytes))


def best() -> Column:
    """The row that stays: most characters, then smallest id (null last), then place."""
    return F.min(F.struct((-F.col("chars")).alias("m"), F.col("id").isNull().alias("no_id"), "id", "file", "row"))


def remembered(spark: SparkSession, path: str, location: str, *, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = FILES_PER_BATCH, digest_bytes: int = 32) -> DataFrame:
    """(digest, n, best): the state after the stream has read all files of the path that it has not read before.

    location is the stream's checkpoint: with the same one a later call goes on where the last one ended and reads
    new files only. A batch that fails is repeated from there.
    """
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    found = f"{path[:-1]}[{path[-1]}]"  # a pattern, as the stream takes no single file by name
    with ExitStack() as held:
        for k, v in STORE.items():
            held.enter_context(setting(spark, k, v))
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").parquet(found)
        state = located(rows, id_col, text_col, digest_bytes).groupBy("digest").agg(F.count("*").alias("n"), best().alias("best"))
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", location).trigger(availableNow=True).start()
        query.awaitTermination()
        kept = spark.read.format("statestore").load(location)
        return cut(kept.select("key.digest", F.col("value.count").alias("n"), F.col("value.min").alias("best")))


def deduplicate(spark: SparkSession, path: str, *, location: str | None = None, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = FILES_PER_BATCH, digest_bytes: int = 32) -> DataFrame:
    """Per row of the Parquet table at the path: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are without blanks and the control characters from tab to return; null counts as
    empty. The row with most characters stays, then the smallest id, null ids last; of rows that share all this
    the first by file and place, so exactly one row of a group stays. Repeated rows come back as often as they are
    there. Other columns are not read. An empty table gives no rows. digest_bytes shortens the digest that keys
    the state; texts that then share one are told apart by the texts.
    """
    location = location or f"{shared_dir(spark)}/exact-dedup-{uuid.uuid4().hex}"
    state = remembered(spark, path, location, id_col=id_col, text_col=text_col, files_per_batch=files_per_batch, digest_bytes=digest_bytes)
    rows = located(spark.read.parquet(path), id_col, text_col, digest_bytes)
    hit = cut(rows.join(state.where("n > 1").select("digest"), "digest", "left_semi"))
    mixed = cut(hit.groupBy("digest").agg(F.min("plain").alias("a"), F.max("plain").alias("z")).where("a <> z").select("digest"))
    whole = state.join(mixed, "digest", "left_anti")
    found = rows.select("id", "sha", "digest", "file", "row").join(whole, "digest")
    parted = hit.join(mixed, "digest", "left_semi")
    groups = parted.groupBy("digest", "plain").agg(F.count("*").alias("n"), best().alias("best"))
    parted = parted.join(groups, ["digest", "plain"])
    columns = ["id", "sha", "file", "row", "n", "best.id", "best.file", "best.row"]
    every = found.select(*columns).toDF(*(names := ["id", "sha", "file", "row", "n", "keep", "keep_file", "keep_row"])).unionByName(parted.select(*columns).toDF(*names))
    kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    return every.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
