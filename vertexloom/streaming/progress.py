"""Progress of a stream of updates, as its query reports it: counts are observed while batches run.

A streaming DataFrame that ``observed`` marked counts its updates in the pass that a batch makes anyway,
and ``Progress`` listens to the reports of one query. What is kept is a row per micro-batch.
"""

from __future__ import annotations

import threading
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from vertexloom.functions.statistics import trial_statistics

METRIC = "updates"
BATCHES = "version long, updates long, inserts long, deletes long, microseconds long, ended long"


def observed(updates: DataFrame) -> DataFrame:
    """A stream of updates ``(..., weight)`` that counts its rows by kind."""
    return updates.observe(METRIC, F.count("*").alias("updates"), F.count_if(F.col("weight") < 0).alias("deletes"))


def observed_segments(named: DataFrame) -> DataFrame:
    """A stream of segments that sums what each has."""
    return named.observe(METRIC, F.sum("updates").alias("updates"), F.sum("deletes").alias("deletes"))


class Progress(StreamingQueryListener):
    """Batches of the query that is called ``name``; ``ended`` is set when it is over."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name, self.run, self.error = spark, f"updates-{uuid.uuid4().hex}", None, None
        self.batches: list[dict] = []
        self.over = threading.Event()

    def __enter__(self) -> Progress:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        if self.run is not None:
            self.over.wait(30)  # reports come behind the query
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = event.runId

    def onQueryProgress(self, event) -> None:
        report = event.progress
        counts = report.observedMetrics.get(METRIC) if report.name == self.name else None
        if counts is None or counts["updates"] is None or not report.numInputRows:
            return
        took = report.durationMs.get("triggerExecution", 0) * 1000
        began = int(datetime.fromisoformat(report.timestamp.replace("Z", "+00:00")).timestamp() * 1e6)
        self.batches.append({
            "version": report.batchId + 1, "updates": counts["updates"], "inserts": counts["updates"] - counts["deletes"], "deletes": counts["deletes"],
            "microseconds": took, "began": began,
        })

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            self.over.set()

    def records(self) -> list[dict]:
        """A record per batch in their order; ``ended`` is its end, in microseconds since the first began."""
        rows = sorted(self.batches, key=lambda b: b["version"])
        start = rows[0]["began"] if rows else 0
        return [{k: v for k, v in b.items() if k != "began"} | {"ended": b["began"] - start + b["microseconds"]} for b in rows]


def batch_table(spark: SparkSession, records: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in BATCHES.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in records], BATCHES)


def by_second(records: list[dict]) -> list[dict]:
    """``second, updates``: how many updates were done at the end of each second, up to the last batch's."""
    last = -(-max((r["ended"] for r in records), default=0) // 1_000_000)
    return [{"second": s, "updates": sum(r["updates"] for r in records if r["ended"] <= s * 1_000_000)} for s in range(1, last + 1)]


def at_multiples(records: list[dict], final_edges: int, step: float = 1.0) -> list[dict]:
    """``multiple, updates, microseconds``: when ``step``, 2 ``step``, ... times the final edges were reached, by the batch that did."""
    if step <= 0:
        raise ValueError(f"step: {step}")
    done, passed, found = 0, 0, []
    for r in sorted(records, key=lambda r: r["version"]):
        done += r["updates"]
        reached = int(done / (final_edges * step)) if final_edges else 0
        found += [{"multiple": k * step, "updates": done, "microseconds": r["ended"]} for k in range(passed + 1, reached + 1)]
        passed = max(passed, reached)
    return found


def latencies(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Statistics by ``kind``, insertions, deletions and all: an update takes as long as its batch."""
    rows = batch_table(spark, records)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("n")) for k, c in (("insert", "inserts"), ("delete", "deletes"), ("all", "updates"))]))
    return trial_statistics(rows.select("microseconds", kinds.alias("k")).select("k.kind", "k.n", "microseconds"), ["kind"], "microseconds", weight="n")
