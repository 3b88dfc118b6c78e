"""Updates as a stream with keyed state: each edge's state is held by Spark, and a batch's work follows what it touches.

A graph's edges are dealt over buckets, which are the keys: an edge's own key would cost some milliseconds a
batch, a bucket's costs that once for all of its edges. A bucket's state are the weights of its edges that are there, as
two arrays, and with ``wait`` the operations that could not be done yet; an absent edge without such has no
state at all. Every operation that is decided comes out as a row, so the results are a table of outcomes: the
graph at any time is the last accepted operation of each edge, by ``at`` and ``turn``. A batch reads and
writes the buckets that it has updates for, so one with fewer updates than buckets touches a part of the graph.

``wait`` is a retry: an insertion of an edge that is there, or a deletion of one that is not, is held until
another operation lets it happen, and is given up when its timer fires, which is in a batch after that
time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vertexloom.graph import canonical, endpoints
from vertexloom.sources.snapshots import SnapshotStore
from vertexloom.streaming.progress import observed
from vertexloom.streaming.replay import LOG_SCHEMA

OUTCOMES = "seq long, src long, dst long, weight double, accepted boolean, at long, turn int"
TOLD = [column.split()[0] for column in OUTCOMES.split(", ")]
#: Timers and several state variables of a key need this kind of state store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Buckets of edges, which are the keys of the state. It has to stay the same for a checkpoint.
BUCKETS = 2048


class EdgeStates(StatefulProcessor):
    """Decides the operations of a bucket's edges, those of one edge in the order of ``seq``.

    ``at`` is the ``seq`` of the operation whose arrival decided a row, ``turn`` the row's place among those
    that it decided. What a timer gives up has the ``seq`` of its own.
    """

    def __init__(self, on_duplicate: str = "ignore", wait: float = 0):
        self.overwrite, self.wait = on_duplicate == "overwrite", int(wait * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.edges = handle.getValueState("edges", "ends binary, weights binary")
        if self.wait:
            self.waiting = handle.getListState("waiting", "seq long, src long, dst long, weight double, until long")

    def _there(self) -> dict[tuple[int, int], float]:
        held = self.edges.get()
        if held is None:
            return {}
        ends = np.frombuffer(held[0], "<i8").reshape(2, -1).tolist()
        return dict(zip(zip(*ends), np.frombuffer(held[1], "<f8").tolist()))

    def _left(self) -> dict[tuple[int, int], list[tuple]]:
        """What waits, by edge, in the order of its arrival."""
        left = {}
        for seq, src, dst, weight, until in self.waiting.get() if self.wait else ():
            left.setdefault((src, dst), []).append((seq, weight, until))
        return left

    def _put_left(self, left: dict[tuple[int, int], list[tuple]]) -> None:
        rows = [(seq, *edge, weight, until) for edge, queue in left.items() for seq, weight, until in queue]
        if rows:
            self.waiting.put(rows)
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        there, left = self._there(), self._left()
        timers = {until for queue in left.values() for *_, until in queue}
        now = timerValues.getCurrentProcessingTimeInMs() if self.wait else 0
        new = pd.concat(list(rows)).sort_values(["seq", "weight"])
        told, changed, moved = [], False, False
        for seq, src, dst, w in zip(*(new[c].tolist() for c in ("seq", "src", "dst", "weight"))):
            edge, put = (src, dst), w >= 0
            here = edge in there
            can = (not here or self.overwrite) if put else here
            if not can and self.wait:
                left.setdefault(edge, []).append((seq, w, now + self.wait))
                moved = True
                continue
            told.append((seq, src, dst, w, can, seq, 0))
            if not can:
                continue
            changed = True
            if put:
                there[edge] = w
            else:
                del there[edge]
            # What waits is of one kind, and the first of it now has its turn.
            queue = left.get(edge)
            if queue and (queue[0][1] >= 0) == (edge not in there):
                first, w, _ = queue.pop(0)
                moved = True
                if w >= 0:
                    there[edge] = w
                else:
                    del there[edge]
                told.append((first, src, dst, w, True, seq, 1))
        if changed:
            if there:
                ends, weights = np.array(list(there), "<i8").T, np.fromiter(there.values(), "<f8")
                self.edges.update((np.ascontiguousarray(ends).tobytes(), weights.tobytes()))
            else:
                self.edges.clear()
        if moved:
            self._put_left(left)
            for until in {until for queue in left.values() for *_, until in queue} - timers:
                self.handle.registerTimer(until)
        if told:
            yield pd.DataFrame(told, columns=TOLD)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, left = expiredTimerInfo.getExpiryTimeInMs(), self._left()
        over = [(seq, *edge, weight, False, seq, 0) for edge, queue in left.items() for seq, weight, until in queue if until <= now]
        if over:
            self._put_left({edge: [w for w in queue if w[2] > now] for edge, queue in left.items()})
            yield pd.DataFrame(over, columns=TOLD)

    def close(self) -> None:
        pass


def write_feed(log: DataFrame, folder: str, segments: int, files: int = 1, directed: bool = False) -> None:
    """A log as it arrives: ``segments`` ranges of ``seq``, one after the other, as files of updates in ``folder``.

    A file source takes older files first. All operations of an edge in a segment are in one of its
    ``files`` files, so the source gives them in the order of ``seq`` wherever it ends a batch.
    """
    spark = log.sparkSession
    log = log.select("seq", "src", "dst", "weight")
    log = log if directed else canonical(log).select("seq", "src", "dst", "weight")
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    if low is None:
        low, high = 0, 0
    width = max(1, -(-(high - low + 1) // segments))
    staged = f"{folder.rstrip('/')}.staged/{uuid.uuid4().hex}"
    log.withColumn("segment", F.floor((F.col("seq") - low) / width)).write.partitionBy("segment").parquet(staged)
    arrived = spark.read.parquet(staged) if high >= low and log.limit(1).count() else None
    for k in range(segments):
        own = spark.createDataFrame([], LOG_SCHEMA) if arrived is None else arrived.where(F.col("segment") == k).drop("segment")
        own.repartition(files, "src", "dst").sortWithinPartitions("seq").write.mode("append").parquet(folder)


def outcome_stream(
    spark: SparkSession, folder: str, out: str, checkpoint: str, on_duplicate: str = "ignore", wait: float = 0, files: int = 1, trigger: dict | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Start the stream from the updates in ``folder`` to the table of outcomes ``out``.

    A batch takes ``files`` files. A query that is started again on the same checkpoint goes on where
    the last one ended, with the same state; the table has every decided operation once. ``trigger`` are
    ``DataStreamWriter.trigger``'s arguments; unless given, what is there is done and the query ends.
    Updates are counted for a ``Progress`` that has the query's ``name``.
    """
    if wait and on_duplicate == "overwrite":
        raise ValueError("an insertion that overwrites never waits")
    settings = {"spark.sql.streaming.stateStore.providerClass": STORE}
    if wait and trigger is None:
        # Timers fire in batches that have updates; without this a query with timers never has done all.
        settings["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)  # a query keeps the settings that it starts with
    try:
        updates = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)
        bucket = F.pmod(F.xxhash64("src", "dst"), F.lit(BUCKETS)).alias("bucket")
        keyed = observed(updates).select("*", bucket).groupBy("bucket")
        decided = keyed.transformWithStateInPandas(EdgeStates(on_duplicate, wait), OUTCOMES, "append", "processingTime" if wait else "none")
        writer = decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
        writer = writer.queryName(name) if name else writer
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def run_outcomes(spark: SparkSession, folder: str, out: str, checkpoint: str, **options) -> DataFrame:
    """``outcome_stream`` over what is there, to its end; returns all outcomes so far."""
    outcome_stream(spark, folder, out, checkpoint, **options).awaitTermination()
    return outcomes(spark, out)


def outcomes(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(OUTCOMES).parquet(out)


def edges_of(told: DataFrame) -> DataFrame:
    """Edges that are there after the outcomes: what the last accepted operation of each left."""
    last = told.where("accepted").groupBy("src", "dst").agg(F.max_by("weight", F.struct("at", "turn")).alias("weight"))
    return last.where("weight >= 0")


def changes_of(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What outcomes do to edges, as a version's changes, and the vertices that they make."""
    done = told.where("accepted").groupBy("src", "dst").agg(F.max_by("weight", F.struct("at", "turn")).alias("weight"))
    present = F.col("weight") >= 0
    effect = done.select("src", "dst", present.alias("present"), F.when(present, F.col("weight")).alias("weight"), F.lit(True).alias("fresh"))
    return effect, endpoints(told.where("accepted and weight >= 0"))


def publish_stream(spark: SparkSession, out: str, store: SnapshotStore, checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """Start the stream that publishes a version of what has been decided since the last one, every so many seconds.

    It runs beside the stream of outcomes and reads what that has finished. Without ``seconds`` it
    publishes what is left, if anything, as one last version and ends. The store belongs to it alone.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        if epoch + 1 not in store.versions():
            store.change(*changes_of(batch), epoch + 1)

    source = spark.readStream.schema(OUTCOMES).parquet(out)
    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"availableNow": True} if seconds is None else {"processingTime": f"{int(seconds * 1000)} milliseconds"})).start()
