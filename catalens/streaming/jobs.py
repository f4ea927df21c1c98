"""Structured Streaming: sources, running a stream to its end, and the jobs that built-in operators express.

A job takes a streaming DataFrame with the event time ``at`` under a watermark and returns one.
``drain`` runs it over what is there (availableNow) and then lets time pass the last event by a
closing row, so that windows, sessions and held rows all come out; a lasting stream runs the same
job with its own checkpoint and without that row.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The event time of the closing row, later than any event.
CLOSING = "2200-01-01 00:00:00"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """The files of a Parquet table as a stream, up to ``files_per_trigger`` a micro-batch."""
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)
    # a stream reads folders, so a table of one file is its folder filtered by that name
    one_file = any(f.rstrip("/").endswith(f"/{name}.parquet") for f in table.inputFiles())
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if one_file else reader.parquet(path)


def work_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="catalens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(source: DataFrame, job: Callable[[DataFrame], DataFrame], late: str = "1 day") -> DataFrame:
    """Everything that ``job`` makes of ``source`` (with the event time ``at``), whose events come at most ``late`` out of order.

    The job gets the source, under its watermark, with the column ``closing``: the closing row's is
    true and its others are null. Stateful jobs must not count that row.
    """
    spark, folder = source.sparkSession, work_folder(source.sparkSession)
    last = spark.createDataFrame([()], "").select(*[(F.lit(CLOSING) if f.name == "at" else F.lit(None)).cast(f.dataType).alias(f.name) for f in source.schema], F.lit(True).alias("closing"))
    end = f"{folder}/closing"
    last.limit(0).write.parquet(end)
    both = source.withColumn("closing", F.lit(False)).union(spark.readStream.schema(last.schema).parquet(end)).withWatermark("at", late)
    made = job(both)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    for closing in (False, True):
        if closing:
            last.coalesce(1).write.mode("append").parquet(end)
        out = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/out")


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give every micro-batch of what is there to ``write`` with its number; a batch that failed comes again under the same number."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, key: str, size: str = "1 hour") -> DataFrame:
    """(start, ``key``, n): counts of each key in tumbling windows."""
    counts = events.groupBy(F.window("at", size).alias("w"), key).agg(F.count("*").alias("n"), F.max("closing").alias("closing"))
    return counts.filter("NOT closing").select("w.start", key, "n")


def sessions(events: DataFrame, key: str, kind: str, kinds: list[str], gap: str = "30 minutes") -> DataFrame:
    """(``key``, start, end, n, n_<kind> for each of ``kinds``): a key's events with less than ``gap`` between them; ``end`` is the last one's time plus the gap."""
    counts = [F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds]
    found = events.groupBy(F.session_window("at", gap).alias("w"), key).agg(F.count("*").alias("n"), *counts, F.max("closing").alias("closing"))
    return found.filter("NOT closing").select(key, "w.start", "w.end", "n", *[f"n_{k}" for k in kinds])


def delivered_once(events: DataFrame, keys: list[str]) -> DataFrame:
    """``events`` without repeated deliveries: of rows with equal ``keys`` (which tell an event, not only its kind) within the watermark one stays; state expires with it."""
    return events.dropDuplicatesWithinWatermark(keys).filter("NOT closing").drop("closing")
