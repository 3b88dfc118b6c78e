"""Graphs as DataFrames.

A graph is ``vertices(id)`` and ``edges(src, dst, weight)``. An undirected graph holds each edge once,
as (least, greatest); ``arcs`` shows it from both ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SCHEMA = "src long, dst long, weight double"


def swapped(edges: DataFrame) -> DataFrame:
    """Edges with their ends exchanged."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def canonical(edges: DataFrame) -> DataFrame:
    """Edges as (least, greatest)."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *rest)


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct ends of the edges, as ``id``."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool

    @classmethod
    def from_edges(cls, edges: DataFrame, directed: bool, vertices: DataFrame | None = None) -> Graph:
        """A simple graph of an edge stream.

        Self loops are refused, repeats too; both are found by the first job that counts on them, not
        here: ``check`` does that. Vertices are the edges' ends unless given.
        """
        edges = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
        edges = edges if directed else canonical(edges)
        return cls(endpoints(edges) if vertices is None else vertices.select("id").distinct(), edges, directed)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def arcs(self) -> DataFrame:
        return self.edges if self.directed else self.edges.unionAll(swapped(self.edges).select("src", "dst", "weight"))

    @property
    def neighbours(self) -> DataFrame:
        """Distinct (id, nbr) over arcs of either direction."""
        pairs = self.arcs.select(F.col("src").alias("id"), F.col("dst").alias("nbr"))
        if not self.directed:
            return pairs
        return pairs.unionAll(self.arcs.select(F.col("dst").alias("id"), F.col("src").alias("nbr"))).distinct()

    def check(self) -> None:
        """Raise if the graph is not simple or a weight is negative or missing."""
        bad = self.edges.where("src = dst or src is null or dst is null or weight is null or weight < 0").limit(1).count()
        if bad:
            raise ValueError("self loop, missing end, or missing or negative weight")
        if self.edges.groupBy("src", "dst").count().where("count > 1").limit(1).count():
            raise ValueError("repeated edge")

    def has_vertex(self, probes: DataFrame) -> DataFrame:
        """Probes ``(id)`` with ``found``."""
        hits = self.vertices.select(F.col("id").alias("_id"), F.lit(True).alias("_hit")).distinct()
        return probes.join(hits, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("_hit", F.lit(False)).alias("found"))

    def get_weight(self, probes: DataFrame) -> DataFrame:
        """Probes ``(src, dst)`` with ``weight``, null where there is no such edge."""
        arcs = self.edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), "weight")
        s, d = (F.col("src"), F.col("dst")) if self.directed else (F.least("src", "dst"), F.greatest("src", "dst"))
        return probes.join(arcs, (s == F.col("_s")) & (d == F.col("_d")), "left").select("src", "dst", "weight")

    def has_edge(self, probes: DataFrame) -> DataFrame:
        return self.get_weight(probes).select("src", "dst", F.col("weight").isNotNull().alias("found"))

    def weight_of(self, src: int, dst: int) -> float:
        """The weight of one edge, NaN if it is not there."""
        row = self.get_weight(self.spark.createDataFrame([(src, dst)], "src long, dst long")).first()
        return float("nan") if row["weight"] is None else row["weight"]

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()
