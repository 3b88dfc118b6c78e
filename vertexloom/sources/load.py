"""Whole graphs from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.files import readable
from vertexloom.graph import Graph
from vertexloom.operators.ordering import running
from vertexloom.operators.updates import apply_batch, remove_vertices
from vertexloom.operators.validate import remap_vertices
from vertexloom.session import cut
from vertexloom.sources import binary, packed, text


# Packed files are read where they lie; of file systems that only Spark knows each file is a cell.


def packed_edges(spark: SparkSession, path: str, weighted: bool, max_weight: float) -> DataFrame:
    if readable(path):
        return packed.read_edges(spark, path, weighted, max_weight)
    return binary.unpack_edges(binary.files(spark, path), weighted, max_weight)


def packed_vertices(spark: SparkSession, path: str) -> DataFrame:
    return packed.read_vertices(spark, path) if readable(path) else binary.unpack_vertices(binary.files(spark, path))


def log_vertices(spark: SparkSession, path: str) -> DataFrame:
    return packed.log_vertices(spark, path) if readable(path) else binary.log_vertices(binary.files(spark, path))


def log_updates(spark: SparkSession, path: str, max_weight: float = 1.0) -> DataFrame:
    return packed.log_updates(spark, path, max_weight) if readable(path) else binary.log_updates(binary.files(spark, path), max_weight)


def log_properties(spark: SparkSession, path: str) -> DataFrame:
    """``(key, value)`` of a log's header, or of all its files'."""
    return packed.log_properties(spark, path).select("key", "value") if readable(path) else binary.log_properties(binary.files(spark, path))


def vertices_in_order(spark: SparkSession, properties: dict[str, str]) -> DataFrame:
    """``(position, id)``: a dataset's vertices numbered from 0 as its vertex file, text or packed, lists them."""
    path = properties["vertex-file"]
    if "compression" not in properties:
        lines = text.numbered_lines(spark, path, "#").where("line <> ''").select(F.col("number").alias("row"), F.split("line", " ")[0].cast("long").alias("id"))
    else:
        lines = packed_vertices(spark, path).select(F.monotonically_increasing_id().alias("row"), "id")
    return running(lines, ["row"], "position").select("position", "id")


def dataset_mapping(spark: SparkSession, expected: str, own: str) -> DataFrame:
    """``(id, other_id)``: each vertex of the dataset that results are expected for, and the same one of our own.

    Our dataset has to say that its vertices were renamed in the order of the other's file
    (``meta.stable-map``), and both that they have as many; the files must bear that out.
    """
    theirs, ours = (text.read_properties(spark, p) for p in (expected, own))
    counts = [p.get("meta.vertices") for p in (theirs, ours)]
    if None in counts or int(counts[0]) != int(counts[1]):
        raise ValueError(f"meta.vertices: {counts[0]} against {counts[1]}")
    if ours.get("meta.stable-map", "").lower() != "true":
        raise ValueError(f"{own} does not have its vertices in the order of {expected}: meta.stable-map is not true")
    one, other = (cut(vertices_in_order(spark, p)) for p in (theirs, ours))
    if one.count() != int(counts[0]):
        raise ValueError(f"{expected} has {one.count()} vertices instead of {counts[0]}")
    return cut(remap_vertices(one, other))


def load_graph(spark: SparkSession, path: str, directed: bool = True, max_weight: int = 1) -> Graph:
    """The graph of a file in any format; ``directed`` counts where the format does not say.

    An undirected edge that repeats gets its smallest weight. That the rest is a simple graph is not
    looked for here, as it takes a pass over all edges: ``Graph.check`` does that.
    """
    kind = text.format_of(path)
    if kind == "ldbc":
        p = text.read_properties(spark, path)
        weighted = "edge-properties.names" in p
        if "compression" in p:
            edges, vertices = packed_edges(spark, p["edge-file"], weighted, float(max_weight)), packed_vertices(spark, p["vertex-file"])
        else:
            edges = text.read_ldbc_edges(spark, p["edge-file"], weighted, float(max_weight))
            vertices = text.read_ldbc_vertices(spark, p["vertex-file"])
        return Graph.from_edges(edges, text.is_directed(p), vertices)
    if kind == "log":
        vertices = log_vertices(spark, path)
        empty = Graph(vertices.select("id"), spark.createDataFrame([], "src long, dst long, weight double"), False)
        full = apply_batch(empty, log_updates(spark, path, float(max_weight)))
        return remove_vertices(full, vertices.where("temporary"))
    if kind == "plain":
        edges = text.read_plain(spark, path, max_weight)
    elif kind == "metis":
        edges = text.read_metis(spark, path, max_weight)
    else:
        edges = (text.read_weighted if kind == "weighted" else text.read_dimacs9)(spark, path)
    graph = Graph.from_edges(edges, directed)
    # Files that list an undirected edge from both ends, or repeat one, give it once.
    return graph if directed else Graph(graph.vertices, graph.edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), False)
