"""Replay of an update log as a stream: each micro-batch is a batch update and one snapshot version."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vertexloom.graph import endpoints
from vertexloom.operators.updates import held_log, net_effect
from vertexloom.sources.binary import FILE_ROWS
from vertexloom.sources.snapshots import SnapshotStore
from vertexloom.streaming.progress import Progress, observed_segments

LOG_SCHEMA = "seq long, src long, dst long, weight double"
SEGMENT_SCHEMA = "segment long, path string, updates long, deletes long"


@dataclass
class Replayed:
    """Records of the batches that a replay finished, and whether it was stopped as its time was over."""

    records: list[dict] = field(default_factory=list)
    timed_out: bool = False


def write_segments(log: DataFrame, folder: str, segments: int, files: int = 1, file_rows: int = FILE_ROWS, batch: int | None = None) -> None:
    """A log as numbered segments, each a range of ``seq``: ``folder`` gets a file for each that names its updates.

    ``batch`` is how many numbers a segment has; without it there are ``segments`` of them. The updates
    are Parquet files beside ``folder``, ranges of ``seq`` too, of at most ``file_rows`` updates and ``files``
    a segment or more. An edge's updates may so be in any number of files, and a segment has to be taken
    as a whole. One task writes the names, one after the other, so that a stream takes them in order.
    """
    spark = log.sparkSession
    low, high, rows = log.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    numbers = 0 if low is None else high - low + 1
    width = batch if batch else max(1, -(-numbers // segments))
    segments = max(1, -(-numbers // width)) if batch else segments
    parts = log.select("seq", "src", "dst", "weight", F.floor((F.col("seq") - (low or 0)) / width).alias("segment"))
    counts = parts.groupBy("segment").agg(F.count("*").alias("updates"), F.count_if(F.col("weight") < 0).alias("deletes"))
    path = f"{folder}.updates/{uuid.uuid4().hex}"
    ranges = parts.repartitionByRange(max(segments * files, -(-rows // file_rows)), "seq").sortWithinPartitions("seq")
    ranges.write.option("maxRecordsPerFile", file_rows).partitionBy("segment").parquet(path)
    named = spark.range(segments).join(F.broadcast(counts), F.col("id") == F.col("segment"), "left")
    named = named.select("id", F.concat(F.lit(f"{path}/segment="), F.col("id").cast("string")), F.coalesce("updates", F.lit(0)), F.coalesce("deletes", F.lit(0)))
    named = named.toDF(*[c.split()[0] for c in SEGMENT_SCHEMA.split(", ")])
    named.coalesce(1).sortWithinPartitions("segment").write.option("maxRecordsPerFile", 1).mode("append").parquet(folder)


def await_end(query: StreamingQuery, timeout: float = 0) -> bool:
    """Wait for the query's end; stop it when ``timeout`` seconds have passed and say so. A failure raises."""
    end = time.monotonic() + timeout if timeout else None
    while not query.awaitTermination(0.2 if end is not None else 3600):
        if end is not None and time.monotonic() > end:
            query.stop()
            return True
    return False


def replay(
    spark: SparkSession,
    folder: str,
    store: SnapshotStore,
    checkpoint: str,
    files: int = 1,
    on_duplicate: str = "ignore",
    timeout: float = 0,
) -> Replayed:
    """Apply the log that ``write_segments`` put in ``folder`` as a stream into ``store``.

    The file source takes ``files`` segments at a time, oldest first. Batch k makes version k + 1 by its
    changes alone, so its work follows the batch; a batch that is run again after a failure finds its
    version or makes it anew, so the store must belong to the stream and its checkpoint alone. When
    ``timeout`` seconds have passed the query is stopped: the batch that runs is given up, those before
    keep their versions and records, and another call goes on after them.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        if epoch + 1 in store.versions():
            return
        named = batch.where("updates > 0").collect()  # a row per segment
        paths = [r["path"] for r in named]
        log = spark.read.schema(LOG_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], LOG_SCHEMA)
        effect = net_effect(held_log(log, store.directed), on_duplicate)
        if on_duplicate == "overwrite":
            effect = effect.withColumn("fresh", F.lit(True))
        store.change(effect, endpoints(log.where("weight >= 0")), epoch + 1)

    with Progress(spark) as progress:
        stream = spark.readStream.schema(SEGMENT_SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)
        writer = observed_segments(stream).writeStream.queryName(progress.name).foreachBatch(step)
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        late = await_end(query, timeout)
    done = set(store.versions())
    return Replayed([r for r in progress.records() if r["version"] in done], late)


def updates_per_second(log: DataFrame, time_column: str) -> DataFrame:
    """``(second, updates)`` of a log with event times; seconds without updates are left out."""
    return log.groupBy(F.date_trunc("second", time_column).alias("second")).agg(F.count("*").alias("updates"))
