"""Breadth-first search and shortest paths by frontiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph, swapped
from vertexloom.kernels.arcs import HeldArcs
from vertexloom.kernels.deadline import Deadline
from vertexloom.session import cut

UNREACHABLE = 9223372036854775807
#: Rounds after which what has been visited is written anew, which bounds the plan's size.
COMPACT = 8


def _start(graph: Graph, source: int) -> None:
    if not graph.vertices.where(F.col("id") == source).limit(1).count():
        raise KeyError(f"no vertex {source}")


#: A frontier pulls if its arcs are more than this part of those into what is not visited yet.
PULL_SHARE = 1.0


def bfs(graph: Graph, source: int, timeout: float = 0, direction: str = "push") -> DataFrame:
    """``(id, hops)`` over outgoing arcs; unreachable vertices have the largest long.

    A round either pushes, from the frontier over its arcs, or pulls, from the vertices that are not
    visited over the arcs into them, of which one from the frontier is enough. ``"auto"`` takes the way
    with fewer arcs, by the degrees of both, which costs two sums a round; ``"push"`` and ``"pull"`` force one. Pulling holds the reversed arcs
    too in a directed graph.
    """
    if direction not in ("auto", "push", "pull"):
        raise ValueError(direction)
    _start(graph, source)
    deadline = Deadline(timeout)
    out = HeldArcs(graph.arcs.select("src", "dst")) if direction != "pull" or not graph.directed else None
    into = None if direction == "push" else out if not graph.directed else HeldArcs(swapped(graph.arcs.select("src", "dst")))
    try:
        frontier = cut(graph.vertices.where(F.col("id") == source).select("id"))
        visited, hops = frontier.withColumn("hops", F.lit(0).cast("long")), 0
        if direction == "auto":
            outgoing, incoming = (cut(held.arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("arcs"))) for held in (out, into))
            left = incoming.agg(F.sum("arcs")).first()[0] or 0
        while True:
            deadline.check()
            hops += 1
            pull = direction == "pull"
            if direction == "auto":
                ahead = frontier.join(outgoing, "id").agg(F.sum("arcs")).first()[0] or 0
                left -= frontier.join(incoming, "id").agg(F.sum("arcs")).first()[0] or 0
                pull = ahead > PULL_SHARE * left
            if pull:
                waiting = graph.vertices.join(visited, "id", "left_anti").select("id")
                near = frontier.select(F.col("id").alias("dst"))
                frontier = cut(into.meet(waiting, "id").join(near, "dst", "left_semi").select("id").distinct())
            else:
                reached = out.meet(frontier, "id").select(F.col("dst").alias("id")).distinct()
                frontier = cut(reached.join(visited, "id", "left_anti"))
            if not frontier.limit(1).count():
                break
            visited = visited.unionAll(frontier.withColumn("hops", F.lit(hops).cast("long")))
            if hops % COMPACT == 0:
                visited = cut(visited.repartition("id"))
        return cut(graph.vertices.join(visited, "id", "left").select("id", F.coalesce("hops", F.lit(UNREACHABLE)).alias("hops")))
    finally:
        for held in {id(h): h for h in (out, into) if h is not None}.values():
            held.unpersist()


def sssp(graph: Graph, source: int, timeout: float = 0) -> DataFrame:
    """``(id, distance)`` by arcs of non-negative weight; infinity where there is no path.

    Only vertices whose distance fell in the last round are expanded, and only these are written; an
    offer counts if no distance that was written before is as small.
    """
    _start(graph, source)
    deadline = Deadline(timeout)
    arcs = HeldArcs(graph.arcs)
    try:
        if arcs.arcs.where("weight < 0 or weight is null").limit(1).count():
            raise ValueError("negative or missing weight")
        frontier = cut(graph.vertices.where(F.col("id") == source).select("id", F.lit(0.0).alias("distance")))
        known, rounds = frontier, 0
        while True:
            deadline.check()
            rounds += 1
            offers = (
                arcs.meet(frontier, "id")
                .groupBy(F.col("dst").alias("id"))
                .agg(F.min(F.col("distance") + F.col("weight")).alias("offer"))
            )
            had = known.select(F.col("id").alias("had_id"), F.col("distance").alias("had"))
            better = offers.join(had, (F.col("id") == F.col("had_id")) & (F.col("had") <= F.col("offer")), "left_anti")
            frontier = cut(better.select("id", F.col("offer").alias("distance")))
            if not frontier.limit(1).count():
                break
            known = known.unionAll(frontier)
            if rounds % COMPACT == 0:
                known = cut(known.groupBy("id").agg(F.min("distance").alias("distance")))
        known = known.groupBy("id").agg(F.min("distance").alias("distance"))
        return cut(graph.vertices.join(known, "id", "left").select("id", F.coalesce("distance", F.lit(float("inf"))).alias("distance")))
    finally:
        arcs.unpersist()


def delta_stepping(graph: Graph, source: int, delta: float | None = None, timeout: float = 0, written: list[int] | None = None) -> DataFrame:
    """``(id, distance)`` as ``sssp`` gives it, by buckets of distances ``delta`` wide.

    The nearest bucket is settled first: arcs no longer than ``delta`` are followed within it until it
    changes no more, then the longer ones of all that it settled, once. Far vertices so are not expanded
    before what may shorten their way is known, which ``sssp`` does again and again where weights differ
    much; it takes more rounds for that. Unless given, ``delta`` is the mean weight. Each round's improvements
    are written; ``written`` gets their numbers.
    """
    _start(graph, source)
    deadline, written = Deadline(timeout), [] if written is None else written
    least, mean, missing = graph.arcs.agg(F.min("weight"), F.avg("weight"), F.count_if(F.col("weight").isNull())).first()
    if missing or (least or 0) < 0:
        raise ValueError("negative or missing weight")
    delta = mean if delta is None else delta
    if delta is not None and delta <= 0:
        delta = 1.0
    arcs = HeldArcs(graph.arcs.withColumn("light", F.col("weight") <= F.lit(delta if delta is not None else 0.0)))
    best = F.min("distance").alias("distance")

    def improved(expanded: DataFrame, light: bool, known: DataFrame) -> DataFrame:
        """What arcs of one kind offer that is less than what is known; written."""
        offers = arcs.meet(expanded, "id").where(F.col("light") == light)
        offers = offers.groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("distance"))
        had = known.select(F.col("id").alias("had_id"), F.col("distance").alias("had"))
        better = cut(offers.join(had, (F.col("id") == F.col("had_id")) & (F.col("had") <= F.col("distance")), "left_anti"))
        written.append(better.count())
        return better

    try:
        # Known distances are rows that were written; a vertex's least one counts. Those before ``low`` are settled.
        known = cut(graph.vertices.where(F.col("id") == source).select("id", F.lit(0.0).alias("distance")))
        rounds, low = 0, 0.0
        while True:
            ahead = known.groupBy("id").agg(best).where(F.col("distance") >= low).agg(F.min("distance")).first()[0]
            if ahead is None or delta is None:
                break
            bucket = int(ahead // delta)
            low, high = bucket * delta, (bucket + 1) * delta
            if high <= low or high <= ahead:  # widths are lost in such large distances
                low, high = ahead, float(np.nextafter(ahead, np.inf))
            within = (F.col("distance") >= low) & (F.col("distance") < high)
            current = cut(known.groupBy("id").agg(best).where(within))
            while True:
                deadline.check()
                better = improved(current, True, known)
                if not written[-1]:
                    break
                known, rounds = known.unionAll(better), rounds + 1
                if rounds % COMPACT == 0:
                    known = cut(known.groupBy("id").agg(best))
                current = better.where(within)
            settled = known.groupBy("id").agg(best).where(within)
            better = improved(settled, False, known)
            known, rounds = known.unionAll(better), rounds + 1
            if rounds % COMPACT == 0:
                known = cut(known.groupBy("id").agg(best))
            low = high
        known = known.groupBy("id").agg(best)
        return cut(graph.vertices.join(known, "id", "left").select("id", F.coalesce("distance", F.lit(float("inf"))).alias("distance")))
    finally:
        arcs.unpersist()
