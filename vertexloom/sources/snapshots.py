"""Versions of a graph as folders of Parquet. A version never changes once it is there.

A version is a whole graph, or the changes that a batch makes to the version before it. Changes are
written from the batch alone; a version is read as the last whole one before it and the changes since,
which are put together edge by edge. Every few versions a whole one is written, so a read puts a bounded
number of changes together, and writing costs a batch and a part of the graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.graph import EDGE_SCHEMA, Graph

#: Versions from one whole graph to the next.
WHOLE_EVERY = 8
_LISTED = "version long, whole boolean"
CHANGES = "src long, dst long, present boolean, weight double, fresh boolean"


class SnapshotStore:
    """Numbered versions below a folder on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str, directed: bool):
        self.spark, self.folder, self.directed = spark, folder.rstrip("/"), directed

    def _path(self, version: int, part: str) -> str:
        return f"{self.folder}/v={version:06d}/{part}"

    def _listed(self) -> dict[int, bool]:
        """Finished versions, and whether each is whole; a row per version, which is written last."""
        try:
            rows = self.spark.read.schema(_LISTED).parquet(f"{self.folder}/versions").collect()
        except AnalysisException:
            return {}
        return {r["version"]: r["whole"] for r in sorted(rows)}

    def versions(self) -> list[int]:
        return list(self._listed())

    def _list(self, version: int, whole: bool) -> int:
        row = self.spark.createDataFrame([(version, whole)], _LISTED).coalesce(1)
        row.write.mode("append").parquet(f"{self.folder}/versions")
        return version

    def _next(self, version: int | None) -> int:
        return (self.versions() or [0])[-1] + 1 if version is None else version

    def build(self, graph: Graph, version: int | None = None) -> int:
        """Write the graph as a version, the next one unless given."""
        version = self._next(version)
        graph.vertices.write.mode("overwrite").parquet(self._path(version, "vertices"))
        graph.edges.repartitionByRange("src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(self._path(version, "edges"))
        return self._list(version, True)

    def change(self, effect: DataFrame, vertices: DataFrame, version: int | None = None) -> int:
        """Write what a batch does, as ``updates.net_effect`` gives it, and the vertices that it makes as a version.

        ``effect`` has each edge once; ``fresh`` says that the weight before does not count. Every
        ``WHOLE_EVERY`` versions the graph is written whole as well.
        """
        version = self._next(version)
        effect.select(*[c.split()[0] for c in CHANGES.split(", ")]).write.mode("overwrite").parquet(self._path(version, "changes"))
        vertices.select("id").write.mode("overwrite").parquet(self._path(version, "new_vertices"))
        if version % WHOLE_EVERY:
            return self._list(version, False)
        return self.build(self._put_together(version, self._listed() | {version: False}), version)

    def _read(self, version: int, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._path(version, part))

    def _whole(self, version: int) -> Graph:
        return Graph(self._read(version, "vertices", "id long"), self._read(version, "edges", EDGE_SCHEMA), self.directed)

    def _put_together(self, version: int, listed: dict[int, bool]) -> Graph:
        """The last whole version before it and the changes since, as far as these are there."""
        base = max((v for v, whole in listed.items() if whole and v < version), default=0)
        later = [v for v in listed if base < v <= version]
        changes = [self._read(v, "changes", CHANGES).withColumn("v", F.lit(v)) for v in later]
        vertices = [self._read(v, "new_vertices", "id long") for v in later]
        if base:
            whole = self._whole(base)
            changes.append(whole.edges.select("src", "dst", F.lit(True).alias("present"), "weight", F.lit(True).alias("fresh"), F.lit(base).alias("v")))
            vertices.append(whole.vertices)
        # An edge has at most one change a version, so its list is as short as the versions are few.
        steps = F.array_sort(F.collect_list(F.struct("v", "present", "fresh", "weight")))
        start = F.struct(F.lit(False).alias("present"), F.lit(None).cast("double").alias("weight"))

        def then(held, c):
            weight = F.when(held["present"] & ~c["fresh"], held["weight"]).otherwise(c["weight"])
            return F.struct(c["present"].alias("present"), F.when(c["present"], weight).alias("weight"))

        folded = reduce(DataFrame.unionAll, changes).groupBy("src", "dst").agg(F.aggregate(steps, start, then).alias("held"))
        edges = folded.where("held.present").select("src", "dst", F.col("held.weight").alias("weight"))
        return Graph(reduce(DataFrame.unionAll, vertices).distinct(), edges, self.directed)

    def load(self, version: int | None = None) -> Graph:
        listed = self._listed()
        version = max(listed) if version is None else version
        return self._whole(version) if listed[version] else self._put_together(version, listed)
