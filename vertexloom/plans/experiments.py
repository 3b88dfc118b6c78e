"""Experiments: insertion from nothing, replay of a log, the kernel suite, scans.

Each runs as Spark jobs and gives records, which ``sinks.write_records`` keeps.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from vertexloom.functions.statistics import trial_statistics
from vertexloom.graph import EDGE_SCHEMA, Graph
from vertexloom.kernels import clustering, ranking, traversal
from vertexloom.kernels.deadline import limited
from vertexloom.operators import algebra, updates, validate
from vertexloom.sources.snapshots import SnapshotStore
from vertexloom.streaming import replay, state
from vertexloom.streaming.progress import Progress
from vertexloom.streaming.replay import Replayed

#: Kernels in the order in which a round runs them.
KERNELS = ("bfs", "cdlp", "lcc", "pagerank", "sssp", "wcc")


def insert_only(edges: DataFrame, folder: str, batches: int, seed: int, timeout: float = 0, batch: int | None = None) -> tuple[SnapshotStore, Replayed]:
    """Insert an edge stream in a seeded random order, in batches, of ``batch`` updates if given; each publishes a version."""
    placed = algebra.permuted_places(edges.select("src", "dst", "weight"), seed, "src", "dst", number="seq")
    replay.write_segments(placed, f"{folder}/log", batches, batch=batch)
    store = SnapshotStore(edges.sparkSession, f"{folder}/versions", directed=False)
    return store, replay.replay(edges.sparkSession, f"{folder}/log", store, f"{folder}/progress", timeout=timeout)


def latest(store: SnapshotStore) -> Graph:
    """The last version; of a run that was stopped before its first an empty graph."""
    if store.versions():
        return store.load()
    return Graph(store.spark.createDataFrame([], "id long"), store.spark.createDataFrame([], EDGE_SCHEMA), store.directed)


def aging(log: DataFrame, temporary: DataFrame, folder: str, batches: int, timeout: float = 0, batch: int | None = None) -> tuple[Graph, Replayed]:
    """Replay a log in batches, then remove its temporary vertices. A run that is late has what it did by then."""
    replay.write_segments(log, f"{folder}/log", batches, batch=batch)
    store = SnapshotStore(log.sparkSession, f"{folder}/versions", directed=False)
    replayed = replay.replay(log.sparkSession, f"{folder}/log", store, f"{folder}/progress", timeout=timeout)
    return updates.remove_vertices(latest(store), temporary), replayed


def aging_stream(
    log: DataFrame, temporary: DataFrame, folder: str, batches: int, timeout: float = 0, build_every: float = 0, files: int = 1, wait: float = 0
) -> tuple[Graph, Replayed, list[int]]:
    """Replay a log through keyed state; versions are published every ``build_every`` seconds meanwhile, and once at the end.

    The graph, the records of the batches and the versions come back. The stream of updates and the
    one that publishes run side by side on their own checkpoints.
    """
    spark = log.sparkSession
    feed, out = f"{folder}/feed", f"{folder}/outcomes"
    state.write_feed(log, feed, batches, files)
    store = SnapshotStore(spark, f"{folder}/versions", directed=False)
    publisher = None
    with Progress(spark) as progress:
        query = state.outcome_stream(spark, feed, out, f"{folder}/progress", wait=wait, files=1, name=progress.name)
        try:
            if build_every:
                publisher = state.publish_stream(spark, out, store, f"{folder}/published", build_every)
            late = replay.await_end(query, timeout)
        finally:
            if publisher is not None:
                publisher.stop()
    state.publish_stream(spark, out, store, f"{folder}/published").awaitTermination()
    return updates.remove_vertices(latest(store), temporary), Replayed(progress.records(), late), store.versions()


def kernel_calls(graph: Graph, parameters: dict[str, dict], timeout: float = 0) -> dict[str, Callable[[], DataFrame]]:
    """The kernels of ``parameters``, as ``text.kernel_parameters`` gives them, ready to be run."""
    kernels = {"bfs": traversal.bfs, "cdlp": ranking.cdlp, "lcc": clustering.lcc, "pagerank": ranking.pagerank, "sssp": traversal.sssp, "wcc": clustering.wcc}
    rounds = {"bfs", "cdlp", "pagerank", "sssp"}  # these look at the time between rounds
    return {k: partial(kernels[k], graph, **p, **({"timeout": timeout} if k in rounds else {})) for k, p in parameters.items()}


def mismatches(kernel: str, result: DataFrame, expected: DataFrame) -> DataFrame:
    """By the kernel's rule: equal, nearly equal, or equal up to names."""
    if kernel in ("bfs", "cdlp"):
        return validate.exact_mismatches(result, expected)
    return validate.equivalence_mismatches(result, expected) if kernel == "wcc" else validate.epsilon_mismatches(result, expected)


def kernel_suite(
    graph: Graph,
    source: int | None = None,
    repetitions: int = 1,
    timeout: float = 3600,
    without: Iterable[str] = (),
    expected: dict[str, DataFrame] | None = None,
    iterations: int = 10,
    damping: float = 0.85,
    parameters: dict[str, dict] | None = None,
) -> list[dict]:
    """Run all kernels but those in ``without`` so many times; a record ``kernel, trial, microseconds, error`` each.

    ``parameters`` has each kernel's own; without it all six run with ``source``, ``iterations`` and
    ``damping``. A kernel that is late or whose result is not as expected gets -1 and is left out of
    later rounds.
    """
    if parameters is None:
        parameters = {"bfs": {"source": source}, "cdlp": {"iterations": iterations}, "lcc": {}, "pagerank": {"iterations": iterations, "damping": damping}, "sssp": {"source": source}, "wcc": {}}
    calls = kernel_calls(graph, parameters, timeout)
    active, records = [k for k in KERNELS if k in calls and k not in set(without)], []
    for trial in range(repetitions):
        for kernel in list(active):
            began, error = time.perf_counter(), None
            try:
                result = limited(graph.spark, timeout, lambda k=kernel: _forced(calls[k]()))
                took = int((time.perf_counter() - began) * 1e6)
                if expected and kernel in expected:
                    validate.require(mismatches(kernel, result, expected[kernel]), 10)
            except (TimeoutError, validate.ValidationError) as caught:
                took, error = -1, str(caught)
                active.remove(kernel)
            records.append({"kernel": kernel, "trial": trial, "microseconds": took, "error": error})
    return records


def _forced(df: DataFrame) -> DataFrame:
    df.write.format("noop").mode("overwrite").save()
    return df


def suite_statistics(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Statistics of each kernel's trials."""
    rows = spark.createDataFrame([(r["kernel"], r["microseconds"]) for r in records], "kernel string, microseconds long")
    return trial_statistics(rows, ["kernel"], "microseconds")


def scan_benchmark(graph: Graph, repetitions: int = 5) -> list[dict]:
    """Degrees, point look-ups and scans, each timed so many times; a total that changes is an error."""
    scans = {"degrees": algebra.sum_of_degrees, "first_neighbour": algebra.sum_of_first_neighbours, "all_neighbours": algebra.sum_of_all_neighbours}
    records, totals = [], {}
    for trial in range(repetitions):
        for name, scan in scans.items():
            began = time.perf_counter()
            total = scan(graph).first()[0]
            records.append({"scan": name, "trial": trial, "microseconds": int((time.perf_counter() - began) * 1e6), "total": total})
            if totals.setdefault(name, total) != total:
                raise ValueError(f"{name}: {total} after {totals[name]}")
    return records
