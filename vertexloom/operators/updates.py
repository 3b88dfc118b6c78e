"""Insertions and deletions on graphs, one by one in meaning and as whole batches in execution.

A batch is ordered by ``seq``. Its sequential result follows from each edge's own operations alone:
the last one says whether the edge is there, and under ``ignore`` its weight is that of the first
insertion after the last deletion, under ``overwrite`` that of the last insertion. So a batch is an
aggregation by edge, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph, canonical, endpoints
from vertexloom.operators.ordering import places_within, with_previous


def _held(graph: Graph, edges: DataFrame) -> DataFrame:
    return held_log(edges, graph.directed)


def held_log(edges: DataFrame, directed: bool) -> DataFrame:
    """Edges, or a log of them, as a graph holds them."""
    return edges if directed else canonical(edges)


def add_vertices(graph: Graph, ids: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph with the vertices, and ``(id, accepted)``: false for those that were there."""
    new = ids.select("id").distinct()
    told = graph.has_vertex(new).select("id", (~F.col("found")).alias("accepted"))
    fresh = told.where("accepted").select("id")
    return Graph(graph.vertices.unionAll(fresh), graph.edges, graph.directed), told


def remove_vertices(graph: Graph, ids: DataFrame) -> Graph:
    """The graph without the vertices and the edges that touch them."""
    gone = ids.select("id").distinct()
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti").select("src", "dst", "weight")
    return Graph(graph.vertices.join(gone, "id", "left_anti"), edges, graph.directed)


def add_edges(graph: Graph, edges: DataFrame, on_duplicate: str = "ignore") -> tuple[Graph, DataFrame]:
    """The graph with the edges whose ends both exist, and ``(src, dst, accepted)``.

    ``edges`` has each edge once. One that is there already is refused under ``ignore``; under
    ``overwrite`` it gets the new weight.
    """
    new = _held(graph, edges.select("src", "dst", "weight"))
    for end in ("src", "dst"):
        new = new.join(graph.vertices.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    there = graph.edges.select("src", "dst", F.lit(True).alias("_there"))
    told = new.join(there, ["src", "dst"], "left")
    ends = F.coalesce(F.col("_src") & F.col("_dst"), F.lit(False))
    ok = ends & F.col("_there").isNull() if on_duplicate == "ignore" else ends
    told = told.select("src", "dst", "weight", ok.alias("accepted"))
    fresh = told.where("accepted").select("src", "dst", "weight")
    kept = graph.edges if on_duplicate == "ignore" else graph.edges.join(fresh, ["src", "dst"], "left_anti")
    out = Graph(graph.vertices, kept.select("src", "dst", "weight").unionAll(fresh), graph.directed)
    return out, told.select("src", "dst", "accepted")


def add_edges_v2(graph: Graph, edges: DataFrame, on_duplicate: str = "ignore") -> tuple[Graph, DataFrame]:
    """As ``add_edges``, but missing ends are made."""
    grown, _ = add_vertices(graph, endpoints(edges))
    return add_edges(grown, edges, on_duplicate)


def remove_edges(graph: Graph, edges: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph without the edges, and ``(src, dst, accepted)``: false for those that were not there."""
    gone = _held(graph, edges.select("src", "dst")).distinct()
    there = graph.edges.select("src", "dst", F.lit(True).alias("_there"))
    told = gone.join(there, ["src", "dst"], "left").select("src", "dst", F.col("_there").isNotNull().alias("accepted"))
    return Graph(graph.vertices, graph.edges.join(gone, ["src", "dst"], "left_anti").select("src", "dst", "weight"), graph.directed), told


def split_updates(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insertions and deletions of a log, by the weight's sign."""
    return log.where("weight >= 0"), log.where("weight < 0")


def partition_updates(log: DataFrame, workers: int) -> DataFrame:
    """The log with the worker that an edge's updates belong to, and so partitioned."""
    return log.withColumn("worker", F.pmod(F.col("src") + F.col("dst"), F.lit(workers))).repartition(workers, "worker")


def net_effect(log: DataFrame, on_duplicate: str = "ignore") -> DataFrame:
    """``(src, dst, present, weight, fresh)`` of each edge that the log has.

    ``fresh``: the log deletes the edge, so what was there before does not count.
    """
    inserted = F.col("weight") >= 0
    last = F.max_by("weight", "seq")
    gone = F.max(F.when(~inserted, F.col("seq")))
    per = log.groupBy("src", "dst").agg(last.alias("_last"), gone.alias("_gone"))
    if on_duplicate == "overwrite":
        return per.select(
            "src", "dst", (F.col("_last") >= 0).alias("present"), F.when(F.col("_last") >= 0, F.col("_last")).alias("weight"), F.col("_gone").isNotNull().alias("fresh")
        )
    joined = log.where(inserted).join(per.where("_last >= 0").select("src", "dst", "_gone"), ["src", "dst"])
    first = joined.where("_gone is null or seq > _gone").groupBy("src", "dst").agg(F.min_by("weight", "seq").alias("weight"))
    return per.join(first, ["src", "dst"], "left").select(
        "src", "dst", (F.col("_last") >= 0).alias("present"), "weight", F.col("_gone").isNotNull().alias("fresh")
    )


def apply_batch(graph: Graph, log: DataFrame, on_duplicate: str = "ignore") -> Graph:
    """The graph after a log ``(seq, src, dst, weight)``; missing ends are made, deletions keep vertices."""
    effect = net_effect(held_log(log, graph.directed), on_duplicate)
    old = graph.edges.withColumnRenamed("weight", "_old")
    merged = old.join(effect, ["src", "dst"], "full_outer")
    kept = F.col("_old").isNotNull() & ~F.coalesce("fresh", F.lit(False))
    own = F.coalesce("_old", "weight") if on_duplicate == "ignore" else F.coalesce("weight", "_old")
    weight = F.when(F.col("present").isNull(), F.col("_old")).when(kept, own).otherwise(F.col("weight"))
    edges = merged.where(F.coalesce("present", F.lit(True))).select("src", "dst", weight.alias("weight"))
    ends = endpoints(log.where("weight >= 0"))
    return Graph(graph.vertices.unionAll(ends).distinct(), edges, graph.directed)


def final_counts(graph: Graph, temporary: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph without the log's temporary vertices, and its numbers of vertices and edges."""
    left = remove_vertices(graph, temporary)
    v = left.vertices.select(F.lit("vertices").alias("what"))
    return left, v.unionAll(left.edges.select(F.lit("edges").alias("what"))).groupBy("what").agg(F.count("*").alias("n"))


def _valid(graph: Graph, log: DataFrame, ends: str) -> tuple[DataFrame, DataFrame]:
    """Operations that can be done at all, and insertions that can't as an end is missing (``ends="require"``)."""
    ops = _held(graph, log.select("seq", "src", "dst", "weight"))
    if ends == "make":
        return ops, ops.limit(0)
    for end in ("src", "dst"):
        ops = ops.join(graph.vertices.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    lost = F.coalesce((F.col("weight") >= 0) & ~(F.coalesce("_src", F.lit(False)) & F.coalesce("_dst", F.lit(False))), F.lit(False))
    marked = ops.select("seq", "src", "dst", "weight", lost.alias("_lost"))
    return marked.where("not _lost").drop("_lost"), marked.where("_lost").drop("_lost")


def batch_outcomes(graph: Graph, log: DataFrame, on_duplicate: str = "ignore", ends: str = "make") -> DataFrame:
    """``(seq, src, dst, weight, accepted)``: what each operation of a batch would have returned, one after the other.

    An insertion is refused if the edge is there (under ``ignore``; ``overwrite`` takes it), a deletion if
    it is not. Whether it is there is told by the edge's operation before, whatever became of that, and
    by the graph for its first one. With ``ends="require"`` an insertion is refused, and changes nothing, if
    the graph lacks one of its ends; with ``"make"`` missing ends are made. An edge with very many operations
    is over several partitions; only first operations are joined with the graph.
    """
    ops, lost = _valid(graph, log, ends)
    chain = with_previous(ops, ["src", "dst", "seq"], {"_src": "src", "_dst": "dst", "_weight": "weight"})
    again = F.coalesce((F.col("_src") == F.col("src")) & (F.col("_dst") == F.col("dst")), F.lit(False))
    chain = chain.withColumn("_again", again)
    there = graph.edges.select("src", "dst", F.lit(True).alias("_there"))
    first = chain.where("not _again").join(there, ["src", "dst"], "left")
    inserted = F.col("weight") >= 0

    def told(rows: DataFrame, before: Column) -> DataFrame:
        taken = F.when(inserted, ~before if on_duplicate == "ignore" else F.lit(True)).otherwise(before)
        return rows.select("seq", "src", "dst", "weight", taken.alias("accepted"))

    out = told(chain.where("_again"), F.col("_weight") >= 0).unionAll(told(first, F.col("_there").isNotNull()))
    return out.unionAll(lost.select("seq", "src", "dst", "weight", F.lit(False).alias("accepted")))


def batch_outcomes_forced(graph: Graph, log: DataFrame, ends: str = "make") -> DataFrame:
    """``(seq, src, dst, weight, accepted, turn)`` of a batch in which a refused operation waits until it can be done.

    The edge is there or not, so what is done on it are insertions and deletions by turns, each kind in
    the order of ``seq``, however they arrive: the k-th insertion into an absent edge is the (2k - 1)-th turn,
    the k-th deletion the 2k-th. An operation is done if the other kind has as many as its turn needs.
    ``turn`` is null for those that wait in vain. Duplicates are ignored, not overwritten.
    """
    ops, lost = _valid(graph, log, ends)
    placed = places_within(ops.withColumn("_put", F.col("weight") >= 0), ["src", "dst", "_put"], ["seq"], "_k")
    counts = ops.groupBy("src", "dst").agg(F.count_if(F.col("weight") >= 0).alias("_puts"), F.count_if(F.col("weight") < 0).alias("_gone"))
    there = graph.edges.select("src", "dst", F.lit(True).alias("_there"))
    counts = counts.join(there, ["src", "dst"], "left").withColumn("_there", F.col("_there").isNotNull())
    leads = F.col("_put") != F.col("_there")  # this kind has the first turn
    turn = 2 * F.col("_k") + F.when(leads, 1).otherwise(2)
    others = F.when(F.col("_put"), F.col("_gone")).otherwise(F.col("_puts"))
    taken = F.when(leads, F.col("_k") <= others).otherwise(F.col("_k") < others)
    out = placed.join(counts, ["src", "dst"]).select("seq", "src", "dst", "weight", taken.alias("accepted"), F.when(taken, turn).alias("turn"))
    return out.unionAll(lost.select("seq", "src", "dst", "weight", F.lit(False).alias("accepted"), F.lit(None).cast("long").alias("turn")))


def all_accepted(outcomes: DataFrame) -> bool:
    """What a whole batch returns: that no operation was refused; true for none."""
    return outcomes.where("not accepted").limit(1).count() == 0


def apply_outcomes(graph: Graph, outcomes: DataFrame, order: str = "seq") -> DataFrame:
    """Edges after a batch whose outcomes are known: the last accepted operation of each edge, by ``order``."""
    done = outcomes.where("accepted").groupBy("src", "dst").agg(F.max_by("weight", order).alias("_new"))
    merged = graph.edges.join(done, ["src", "dst"], "full_outer")
    return merged.where("coalesce(_new, weight) >= 0").select("src", "dst", F.coalesce("_new", "weight").alias("weight"))
