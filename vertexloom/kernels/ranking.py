"""PageRank and label propagation: a fixed number of synchronous rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph, swapped
from vertexloom.kernels.arcs import HeldArcs
from vertexloom.kernels.deadline import Deadline
from vertexloom.operators.algebra import degrees_of_all
from vertexloom.session import cut


def pagerank(graph: Graph, iterations: int, damping: float = 0.85, timeout: float = 0) -> DataFrame:
    """``(id, score)`` after so many rounds; the rank of vertices without outgoing arcs goes to all.

    Each vertex's share is computed once a round and summed by destination, with partial sums before
    the shuffle. Arcs stay partitioned by source.
    """
    deadline = Deadline(timeout)
    arcs = HeldArcs(graph.arcs.select("src", "dst"))
    try:
        ranks = cut(degrees_of_all(graph).repartition("id"))
        n = ranks.count()
        ranks = ranks.withColumn("score", F.lit(1.0 / n if n else 0.0))
        dangling = ranks.where("degree = 0").limit(1).count() > 0
        for _ in range(iterations):
            deadline.check()
            lost = (ranks.where("degree = 0").agg(F.sum("score")).first()[0] or 0.0) if dangling else 0.0
            shares = ranks.where("degree > 0").select("id", (F.col("score") / F.col("degree")).alias("share"))
            sums = arcs.meet(shares, "id").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
            score = F.lit((1 - damping) / n + damping * lost / n) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
            ranks = cut(ranks.join(sums, "id", "left").select("id", "degree", score.alias("score")))
        return ranks.select("id", "score")
    finally:
        arcs.unpersist()


def cdlp(graph: Graph, iterations: int, isolated_label: int | None = None, timeout: float = 0) -> DataFrame:
    """``(id, label)``: each round a vertex takes its neighbours' most frequent label, the smallest of ties.

    In a directed graph arcs of both directions count, so a mutual neighbour counts twice. A vertex
    without neighbours keeps its own label, or gets ``isolated_label``. It ends early if no label moves.
    """
    deadline = Deadline(timeout)
    votes = graph.arcs.select("src", "dst")
    if graph.directed:
        votes = votes.unionAll(swapped(votes))
    votes = HeldArcs(votes)
    try:
        labels = cut(graph.vertices.select("id", F.col("id").alias("label")))
        for _ in range(iterations):
            deadline.check()
            counted = votes.meet(labels, "id").groupBy("dst", "label").agg(F.count("*").alias("n"))
            best = counted.groupBy("dst").agg(F.max(F.struct("n", (-F.col("label")).alias("m"))).alias("b"))
            merged = labels.join(best, F.col("id") == F.col("dst"), "left").select(
                "id", "label", F.coalesce(-F.col("b.m"), F.col("label")).alias("next")
            )
            merged = cut(merged)
            labels = merged.select("id", F.col("next").alias("label"))
            if not merged.where("next <> label").limit(1).count():
                break
        if isolated_label is None:
            return labels
        touched = votes.arcs.select(F.col("dst").alias("id")).distinct().withColumn("_t", F.lit(True))
        out = labels.join(touched, "id", "left")
        return cut(out.select("id", F.when(F.col("_t"), F.col("label")).otherwise(F.lit(isolated_label)).alias("label")))
    finally:
        votes.unpersist()
