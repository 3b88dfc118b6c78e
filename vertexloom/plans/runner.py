"""A whole run in one call: dataset, experiment, records.

``run`` takes what a run's command line would have, does the experiment with Spark jobs and keeps what
came out of it below one folder: ``parameters``, then the tables of the experiment. Each is appended
under the run's id, so that many runs share a folder and are compared by a query over it.

    python -m vertexloom.plans.runner GRAPH --records FOLDER [--log LOG] [--repetitions N] ...
"""

from __future__ import annotations

import argparse
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.quantities import parse_duration
from vertexloom.functions.statistics import medians
from vertexloom.graph import Graph, endpoints
from vertexloom.operators import algebra, validate
from vertexloom.plans import experiments
from vertexloom.session import cut
from vertexloom.sources import binary, load, sinks, text
from vertexloom.streaming import progress

#: Columns of each table of records, besides the run's id.
RECORDS = {
    "parameters": "name string, value string",
    "kernels": "kernel string, trial int, microseconds long, error string",
    "statistics": "kernel string, n long, timeouts long, mean long, stddev long, min long, max long, median long, p90 long, p95 long, p97 long, p99 long",
    "batches": "experiment string, version long, updates long, inserts long, deletes long, microseconds long",
    "progress": "experiment string, multiple double, updates long, microseconds long",
    "seconds": "experiment string, second long, updates long",
    "latencies": "experiment string, kind string, n long, timeouts long, mean long, stddev long, min long, max long, median long, p90 long, p95 long, p97 long, p99 long",
    "totals": "experiment string, updates long, microseconds long, build_microseconds long, snapshots long, vertices long, edges long, expected_vertices long, expected_edges long, temporary_vertices long, timed_out boolean",
    "scans": "scan string, trial long, microseconds long, total long",
    "validation": "kernel string, valid boolean, error string",
}


@dataclass(frozen=True)
class Options:
    """What a run does. ``graph`` is a dataset in any format, ``log`` an update log to replay instead of inserting the graph.

    ``batches`` cuts the updates into so many batches, ``batch`` into batches of so many. ``timeout`` is
    each kernel's time, ``aging_timeout`` that of the updates: they end there and what they did counts.
    ``aging_step`` is the part of the final edges at which progress is kept. ``build_every`` seconds a version is
    published while a log runs through keyed state; without it each batch is one. ``latency`` keeps
    statistics of the updates' latencies, ``scans`` repeats the scan benchmark. ``load`` takes the graph as
    it is read; an undirected one is inserted otherwise, a directed one only can be loaded. ``remap`` is
    the dataset that the results in ``validate`` are of, whose vertices are named otherwise.
    """

    graph: str
    records: str
    log: str | None = None
    directed: bool = False
    repetitions: int = 5
    batches: int = 10
    batch: int | None = None
    seed: int = 42
    max_weight: int = 1
    timeout: float = 3600
    aging_timeout: float = 0
    aging_step: float = 1.0
    build_every: float = 0
    latency: bool = False
    scans: int = 0
    load: bool = False
    validate: str | None = None
    remap: str | None = None
    without: tuple[str, ...] = ()
    insert: bool = True
    source: int | None = None


def write_records(spark: SparkSession, folder: str, run_id: str, name: str, rows: list[dict] | DataFrame) -> None:
    """Append to a table of records; a missing field is null."""
    kinds = RECORDS[name]
    names = [part.split()[0] for part in kinds.split(", ")]
    if isinstance(rows, list):
        rows = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kinds)
    rows.select(F.lit(run_id).alias("run"), *names).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def read_records(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(f"run string, {RECORDS[name]}").parquet(f"{folder}/{name}")


def _expected(spark: SparkSession, folder: str, kernels: list[str]) -> dict[str, DataFrame]:
    """Results to compare with: ``folder-BFS`` and the like, as far as ``folder`` names a dataset's prefix."""
    names = {kernel: name.upper() for name, kernel in text.ALGORITHMS.items()}
    return {k: sinks.read_result(spark, f"{folder}-{names[k]}", "long" if k in ("bfs", "cdlp", "wcc") else "double") for k in kernels}


def _updates(spark: SparkSession, options: Options, run_id: str, graph: Graph | None) -> Graph:
    """Insert the graph or replay the log in batches, and keep what each batch took."""
    name, began = ("aging" if options.log else "insert_only"), time.monotonic()
    folder = f"{options.records}/work/{run_id}"
    told = {}
    if options.log:
        log, vertices = load.log_updates(spark, options.log, float(options.max_weight)), load.log_vertices(spark, options.log)
        temporary = vertices.where("temporary")
        if options.build_every:
            final, replayed, versions = experiments.aging_stream(log, temporary, folder, options.batches, options.aging_timeout, options.build_every)
        else:
            final, replayed = experiments.aging(log, temporary, folder, options.batches, options.aging_timeout, options.batch)
            versions = [r["version"] for r in replayed.records]
        told = binary.final_sizes(load.log_properties(spark, options.log))
        told["temporary_vertices"] = temporary.count()
    else:
        store, replayed = experiments.insert_only(graph.edges, folder, options.batches, options.seed, options.aging_timeout, options.batch)
        versions = store.versions()
        final = experiments.latest(store)
        told = {"vertices": graph.vertices.join(endpoints(graph.edges), "id", "left_semi").count(), "edges": graph.num_edges(), "temporary_vertices": 0}
    took = int((time.monotonic() - began) * 1e6)
    built = time.monotonic()
    final = Graph(cut(final.vertices), cut(final.edges), final.directed)
    build = int((time.monotonic() - built) * 1e6)
    sizes = {"vertices": final.num_vertices(), "edges": final.num_edges()}
    records = replayed.records

    def keep(table: str, rows: list[dict]) -> None:
        write_records(spark, options.records, run_id, table, [{"experiment": name} | r for r in rows])

    keep("batches", records)
    keep("progress", progress.at_multiples(records, told.get("edges") or sizes["edges"], options.aging_step))
    keep("seconds", progress.by_second(records))
    if options.latency:
        write_records(spark, options.records, run_id, "latencies", progress.latencies(spark, records).withColumn("experiment", F.lit(name)))
    total = {"updates": sum(r["updates"] for r in records), "microseconds": took, "build_microseconds": build, "snapshots": len(versions), "timed_out": replayed.timed_out}
    expected = {f"expected_{k}": told.get(k) for k in ("vertices", "edges")} | {"temporary_vertices": told["temporary_vertices"]}
    keep("totals", [total | sizes | expected])
    if not replayed.timed_out:
        wrong = [f"{sizes[k]} {k} instead of {told[k]}" for k in ("vertices", "edges") if told.get(k) is not None and sizes[k] != told[k]]
        if wrong:
            raise ValueError(f"after the updates there are {' and '.join(wrong)}")
    return final


def run(spark: SparkSession, options: Options) -> str:
    """Do all that ``options`` ask for; returns the run's id, under which its records are."""
    run_id = uuid.uuid4().hex
    write_records(spark, options.records, run_id, "parameters", [{"name": k, "value": str(v)} for k, v in asdict(options).items()])
    kind = text.format_of(options.graph)
    graph = load.load_graph(spark, options.graph, options.directed, options.max_weight)
    graph = Graph(cut(graph.vertices), cut(graph.edges), graph.directed)
    graph.check()
    if options.log or (options.insert and not options.load):
        if graph.directed:
            raise ValueError("updates are of undirected graphs; load a directed one")
        _updates(spark, options, run_id, graph)
    if options.scans:
        scans = experiments.scan_benchmark(graph, options.scans)
        write_records(spark, options.records, run_id, "scans", scans)
        medians_of = medians(read_records(spark, options.records, "scans").where(F.col("run") == run_id), ["scan"], "microseconds")
        sinks.write_json(medians_of.coalesce(1), f"{options.records}/scans-{run_id}.json")
        sinks.write_degrees(algebra.csr_offsets(graph), f"{options.records}/degrees-{run_id}")
    if options.repetitions:
        parameters = text.kernel_parameters(text.read_properties(spark, options.graph)) if kind == "ldbc" else None
        source = options.source if options.source is not None else graph.vertices.agg(F.min("id")).first()[0]
        active = [k for k in experiments.KERNELS if (parameters is None or k in parameters) and k not in options.without]
        expected = _expected(spark, options.validate, active) if options.validate else None
        if expected and options.remap:
            mapping = load.dataset_mapping(spark, options.remap, options.graph)
            expected = {k: cut(validate.relabelled(df, mapping, k == "cdlp")) for k, df in expected.items()}
        records = experiments.kernel_suite(graph, source, options.repetitions, options.timeout, options.without, expected, parameters=parameters)
        write_records(spark, options.records, run_id, "kernels", records)
        write_records(spark, options.records, run_id, "statistics", experiments.suite_statistics(spark, records))
        if expected:
            errors = {r["kernel"]: r["error"] for r in records if r["error"]}
            write_records(spark, options.records, run_id, "validation", [{"kernel": k, "valid": k not in errors, "error": errors.get(k)} for k in active])
    return run_id


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Run an experiment on a graph and keep its records.")
    parser.add_argument("graph")
    parser.add_argument("--records", required=True)
    parser.add_argument("--log")
    parser.add_argument("--directed", action="store_true")
    parser.add_argument("--repetitions", type=int, default=5)
    parser.add_argument("--batches", type=int, default=10)
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--max-weight", type=int, default=1)
    parser.add_argument("--timeout", type=parse_duration, default=3600)
    parser.add_argument("--batch", type=int, help="updates of a batch, in place of a number of batches")
    parser.add_argument("--aging-timeout", type=parse_duration, default=0)
    parser.add_argument("--aging-step", type=float, default=1.0, help="progress is kept at multiples of this part of the final edges")
    parser.add_argument("--build-every", type=parse_duration, default=0, help="publish versions by time while a log runs through keyed state")
    parser.add_argument("--latency", action="store_true")
    parser.add_argument("--scans", type=int, default=0)
    parser.add_argument("--load", action="store_true", help="take the graph as it is read, without inserting it")
    parser.add_argument("--validate", help="prefix of the files with expected results")
    parser.add_argument("--remap", help="property file of the dataset that the expected results are of")
    parser.add_argument("--without", nargs="*", default=[], choices=experiments.KERNELS)
    parser.add_argument("--no-insert", dest="insert", action="store_false")
    parser.add_argument("--source", type=int)
    given = vars(parser.parse_args(arguments))
    spark = SparkSession.builder.getOrCreate()
    print(run(spark, Options(**(given | {"without": tuple(given["without"])}))))


if __name__ == "__main__":
    main()
