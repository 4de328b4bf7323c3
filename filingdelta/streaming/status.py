"""Latest processing status per document, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_status(events: DataFrame) -> DataFrame:
    """The last update wins; updates at the same time are ordered by event id.

    One aggregation with map-side combine: a document with any share of the
    events sends one row per task. Works on batches and on streams.
    """
    last = F.max(F.struct("ts", "event_id", "processing_status")).alias("last")
    return events.groupBy("document_id").agg(last, F.count(F.lit(1)).alias("n_updates")).select(
        "document_id", F.col("last.processing_status").alias("processing_status"),
        F.col("last.ts").alias("updated_at"), F.col("last.event_id").alias("event_id"), "n_updates",
    )


def run_status(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what each micro-batch brings, one row per document, to a folder of its own below ``out``.

    The rows add up: the newest of a document's rows is its status, their ``n_updates`` its number of updates, so the stream
    keeps no state however many documents there have been, and a late event counts like any other. A batch that is run
    again after a failure overwrites its folder. ``compact_log`` keeps the log as small as its documents.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest_status(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_status(log: DataFrame) -> DataFrame:
    """Newest state per document from the log of the micro-batches."""
    last = F.max(F.struct("updated_at", "event_id", "processing_status")).alias("last")
    return log.groupBy("document_id").agg(last, F.sum("n_updates").alias("n_updates")).select(
        "document_id", "last.processing_status", "last.updated_at", "last.event_id", "n_updates"
    )


def _folders(spark: SparkSession, out: str) -> dict[int, str]:
    """The log's folders by number. A compacted one, named by the last micro-batch in it, stands for all before it."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return {}
    names = [s.getPath().getName() for s in files.listStatus(path) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    numbered = [(*n.split("="), n) for n in names if n.startswith(("batch=", "upto="))]
    upto = max((int(k) for kind, k, _ in numbered if kind == "upto"), default=-1)
    return {int(k): f"{out}/{n}" for kind, k, n in numbered if kind == "upto" and int(k) == upto or kind == "batch" and int(k) > upto}


def read_log(spark: SparkSession, out: str) -> DataFrame:
    """The log's rows, each micro-batch once; only complete folders count."""
    folders = _folders(spark, out)
    if not folders:
        raise FileNotFoundError(f"no log below {out}")
    return spark.read.parquet(*folders.values())


def compact_log(spark: SparkSession, out: str) -> None:
    """Replace the log's folders by one that has a row per document; for use between runs of the stream.

    The new folder counts from the moment it is complete; the old ones go afterwards, so a failure in between loses and repeats nothing.
    """
    folders = _folders(spark, out)
    if not folders:
        return
    last = max(folders)
    if list(folders.values()) != [f"{out}/upto={last}"]:
        current_status(spark.read.parquet(*folders.values())).write.mode("overwrite").parquet(f"{out}/upto={last}")
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(path):
        if status.getPath().getName() != f"upto={last}":
            files.delete(status.getPath(), True)
