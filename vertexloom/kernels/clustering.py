"""Components, triangles and local clustering coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.files import stored
from vertexloom.graph import Graph
from vertexloom.kernels.components import star_components
from vertexloom.operators.algebra import neighbour_degree, triangles
from vertexloom.session import cut


def wcc(graph: Graph) -> DataFrame:
    """``(id, component)``: the smallest id that is reachable by arcs of either direction."""
    found = star_components(graph.edges)
    return graph.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def triangles_per_vertex(graph: Graph) -> DataFrame:
    """``(id, triangles)`` of vertices with any."""
    corners = triangles(graph).select(F.explode(F.array("a", "b", "c")).alias("id"))
    return corners.groupBy("id").agg(F.count("*").alias("triangles"))


def triangle_count(graph: Graph) -> DataFrame:
    return triangles(graph).agg(F.count("*").alias("triangles"))


def lcc(graph: Graph) -> DataFrame:
    """``(id, coefficient)``: arcs among a vertex's neighbours, of all that there could be.

    Triangles of the undirected skeleton are found once. A corner is credited with the arcs between
    the other two, two in an undirected graph; in a directed one a second arc is looked up.
    """
    degree = stored(neighbour_degree(graph))
    found = triangles(graph, degree)
    if graph.directed:
        corners = [("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b")]
        credit = [F.struct(F.col(v).alias("id"), F.least(x, y).alias("x"), F.greatest(x, y).alias("y")) for v, x, y in corners]
        found = found.select(F.explode(F.array(*credit)).alias("t")).select("t.*")
        there = graph.arcs.select("src", "dst")
        mutual = there.groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(F.count("*").alias("k"))
        credits = found.join(mutual, ["x", "y"]).groupBy("id").agg(F.sum("k").alias("arcs"))
    else:
        credits = found.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg((F.count("*") * 2).alias("arcs"))
    k = F.coalesce(F.col("degree"), F.lit(0)).cast("double")
    share = F.when(k >= 2, F.coalesce("arcs", F.lit(0)) / (k * (k - 1))).otherwise(F.lit(0.0))
    joined = graph.vertices.join(degree.hint("merge"), "id", "left").join(credits, "id", "left")
    return cut(joined.select("id", share.alias("coefficient")))
