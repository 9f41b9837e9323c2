"""Streams: debounced file events, batched keyword refreshes and incremental upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def debounce(events: DataFrame, gap: str = "2 seconds", late: str | None = None) -> DataFrame:
    """One row per path and burst of events: ``path, opened, closed, deleted, events``.

    A burst ends when no event of the path comes for ``gap``; the latest operation wins. ``events``: ts, path,
    deleted. The same function serves batches and, with a watermark of ``late``, streams.
    """
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy("path", F.session_window("ts", gap).alias("w")).agg(
        F.max_by("deleted", F.struct("ts", "deleted")).alias("deleted"), F.count("*").alias("events")
    ).select("path", F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "deleted", "events")


def read_events(spark: SparkSession, folder: str, schema: str = "ts timestamp, path string, deleted boolean", files: int = 100) -> DataFrame:
    """A stream of event files, at most so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def refresh_batches(requests: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "2 seconds", once: bool = False):
    """Keyword refresh requests (project, id) in batches of distinct ids; ``handle`` gets each batch."""
    def run(batch: DataFrame, n: int) -> None:
        handle(batch.dropDuplicates(["project", "id"]), n)

    w = requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


#: Parts of a streamed table; a batch rewrites only those that it touches.
BUCKETS = 64


def upsert_stream(new: DataFrame, folder: str, columns: list[str], checkpoint: str, once: bool = False, buckets: int = BUCKETS):
    """Node requests merged into a Parquet table in buckets of the id, with one folder per batch for the buckets that
    the batch touches; a repeated batch writes the same folder.

    A batch reads the newest version of its buckets before its own, so a batch that is run again after a failure
    gives the same result, and its work grows with the buckets it touches, not with the table. ``buckets`` must stay
    the same for a folder. :func:`latest_snapshot` reads the table, :func:`drop_superseded` deletes old versions.
    """
    from ..operators.mutations import upsert_nodes

    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets))

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            touched = [r[0] for r in batch.where("id is not null").select(bucket).distinct().collect()]  # at most ``buckets`` numbers
            old = latest_snapshot(spark, folder, n - 1, touched)
            if old is None:
                none = F.lit(None).cast("timestamp")
                old = batch.select("id", *columns, "source_hash", none.alias("created_at"), none.alias("updated_at"), none.alias("last_indexed_at"), F.lit(0).cast("long").alias("change_count")).limit(0)
            merged = upsert_nodes(old, batch, batch.agg(F.max("ts")).scalar(), columns)
            merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/v{n:012d}")
        finally:
            batch.unpersist()

    w = new.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def _versions(spark: SparkSession, folder: str, most: int) -> list[tuple[int, int, str]]:
    """(bucket, version, path) of all complete versions of at most that number."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    p = path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    out = []
    for v in fs.listStatus(p):
        name = v.getPath().getName()
        if name.startswith("v") and int(name[1:]) <= most and fs.exists(path(f"{folder}/{name}/_SUCCESS")):
            for b in fs.listStatus(v.getPath()):
                part = b.getPath().getName()
                if part.startswith("bucket="):
                    out.append((int(part[len("bucket="):]), int(name[1:]), f"{folder}/{name}/{part}"))
    return out


def latest_snapshot(spark: SparkSession, folder: str, most: int, only: list[int] | None = None) -> DataFrame | None:
    """The newest complete version of at most that number of each bucket, or of some buckets; None if there is none."""
    newest: dict[int, tuple[int, str]] = {}
    for b, v, path in _versions(spark, folder, most):
        if (only is None or b in only) and (b not in newest or v > newest[b][0]):
            newest[b] = v, path
    return spark.read.parquet(*[p for _, p in newest.values()]) if newest else None


def drop_superseded(spark: SparkSession, folder: str, before: int) -> int:
    """Delete versions of buckets that have a newer one of at most the number ``before``; how many were deleted."""
    all_ = _versions(spark, folder, before)
    newest = {b: max(v for c, v, _ in all_ if c == b) for b, _, _ in all_}
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    gone = [p for b, v, p in all_ if v < newest[b]]
    for p in gone:
        path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(p), True)
    return len(gone)
