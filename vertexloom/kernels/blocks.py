"""Arcs in compressed two-dimensional blocks, and rounds over them that are vectorised within a block.

Vertices are numbered from 0 by id and cut into ranges. A block has the arcs from one range to another as
offsets by source and targets, in arrays. A round sends each range's vector to the blocks of its row,
where the arcs are summed up by target at once, and adds up what the blocks of a column give, so what is
shuffled are vectors, not arcs. A block with more arcs than a bound is held in several parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.files import only_last, stored
from vertexloom.graph import Graph
from vertexloom.operators.algebra import degrees_of_all
from vertexloom.operators.ordering import running
from vertexloom.session import cut

#: Vertices of a range, and arcs of a part of a block.
RANGE, PART_ARCS = 1 << 16, 1 << 20
#: Parts of a block that one task packs, about, and vertices whose values are broadcast in a round; more meet the blocks in a shuffle.
TASK_PARTS, BROADCAST_VERTICES = 16, 1 << 23


class ArcBlocks:
    """A graph's arcs in blocks: ``ids`` is ``(id, logical, degree)``, ``blocks`` is ``(row, column, part, sources, offsets, targets)``."""

    def __init__(self, graph: Graph, size: int = RANGE, part_arcs: int = PART_ARCS):
        self.size = size
        self.ids = cut(running(degrees_of_all(graph), ["id"], "logical"))
        self.n = self.ids.count()
        with only_last():
            ends = graph.edges.select("src", "dst")
            for end in ("src", "dst"):
                names = self.ids.select(F.col("id").alias(end), F.col("logical").alias(f"_{end}"))
                ends = stored(ends.join(names, end).drop(end))
            s, d = F.col("_src"), F.col("_dst")
            both = [F.struct(s.alias("s"), d.alias("d"))] + [F.struct(d.alias("s"), s.alias("d"))] * (not graph.directed)
            self.blocks = stored(self._packed(ends.select(F.inline(F.array(*both))), part_arcs))

    def _packed(self, arcs: DataFrame, part_arcs: int) -> DataFrame:
        """Arcs ``(s, d)`` as blocks; each is packed as its sorted arcs stream by, a very large one by several tasks."""
        size = self.size

        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block, k, held, n = None, 0, [], 0

            def packed() -> pd.DataFrame:
                (row, column, turn), (s, d) = block, np.concatenate(held, axis=1)
                sources, starts = np.unique(s - row * size, return_index=True)
                arrays = {"sources": [sources.astype(np.int32)], "offsets": [np.append(starts, len(s)).astype(np.int32)], "targets": [(d - column * size).astype(np.int32)]}
                return pd.DataFrame({"row": [row], "column": [column], "part": [(k << 20) + turn]} | arrays)

            for frame in frames:
                s, d, turn = (frame[c].to_numpy() for c in ("s", "d", "turn"))
                keys = np.stack([s // size, d // size, turn])
                cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), len(s)]
                for at, end in zip(cuts, cuts[1:]):
                    own = tuple(int(x) for x in keys[:, at])
                    if own != block:
                        if n:
                            yield packed()
                        block, k, held, n = own, 0, [], 0
                    while at < end:
                        to = min(end, at + part_arcs - n)
                        held.append(np.stack([s[at:to], d[at:to]]))
                        n, at = n + to - at, to
                        if n == part_arcs:
                            yield packed()
                            k, held, n = k + 1, [], 0
            if n:
                yield packed()

        row, column = F.floor(F.col("s") / size), F.floor(F.col("d") / size)
        large = arcs.groupBy(row.alias("_row"), column.alias("_column")).agg(F.ceil(F.count("*") / (TASK_PARTS * part_arcs)).alias("_turns")).where("_turns > 1")
        turn = F.coalesce(F.pmod(F.xxhash64("s"), F.col("_turns")), F.lit(0)).cast("int")  # at most so many as all arcs need
        dealt = arcs.join(F.broadcast(large), (row == F.col("_row")) & (column == F.col("_column")), "left").select("s", "d", turn.alias("turn"))
        dealt = dealt.repartition(row, column, "turn").sortWithinPartitions(row, column, "turn", "s", "d")
        return dealt.mapInPandas(pack, "row long, column long, part long, sources array<int>, offsets array<int>, targets array<int>")

    def vectors(self, values: DataFrame) -> DataFrame:
        """``(logical, value)`` as ``(range, xs)``, a vector for each range."""
        size, n = self.size, self.n

        def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            xs = np.zeros(min(size, n - key[0] * size))
            xs[rows["logical"].to_numpy() - key[0] * size] = rows["value"].to_numpy()
            return pd.DataFrame({"range": [key[0]], "xs": [xs]})

        ranged = values.select(F.floor(F.col("logical") / size).alias("range"), "logical", "value")
        return ranged.groupBy("range").applyInPandas(gather, "range long, xs array<double>")

    def sums(self, vectors: DataFrame) -> DataFrame:
        """``(range, ys)``: for every vertex the sum of the values of those with arcs to it."""
        size, n = self.size, self.n

        def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for xs, column, sources, offsets, targets in zip(*(frame[c] for c in ("xs", "column", "sources", "offsets", "targets"))):
                    each = np.repeat(np.asarray(xs)[sources], np.diff(offsets))
                    yield pd.DataFrame({"range": [column], "ys": [np.bincount(targets, each, min(size, n - column * size))]})

        def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"range": [key[0]], "ys": [np.sum(np.stack(parts["ys"].to_numpy()), axis=0)]})

        vectors = F.broadcast(vectors) if n <= BROADCAST_VERTICES else vectors
        met = vectors.join(self.blocks, F.col("range") == F.col("row")).select("xs", "column", "sources", "offsets", "targets")
        partial = met.mapInPandas(multiply, "range long, ys array<double>")
        # In two steps: what the many blocks of a column give is first added up in a few groups.
        some = partial.withColumn("group", F.pmod(F.monotonically_increasing_id(), F.lit(16)))
        some = some.groupBy("range", "group").applyInPandas(add, "range long, ys array<double>")
        return some.groupBy("range").applyInPandas(add, "range long, ys array<double>")


def pagerank_blocks(graph: Graph, iterations: int, damping: float = 0.85, size: int = RANGE, part_arcs: int = PART_ARCS) -> DataFrame:
    """``(id, score)`` as ``ranking.pagerank`` gives it, by rounds over blocks of arcs."""
    held = ArcBlocks(graph, size, part_arcs)
    n = held.n
    if not n:
        return graph.spark.createDataFrame([], "id long, score double")
    degrees = cut(held.vectors(held.ids.select("logical", F.col("degree").cast("double").alias("value"))).withColumnRenamed("xs", "ds"))
    share = F.zip_with("xs", "ds", lambda x, d: F.when(d > 0, x / d).otherwise(F.lit(0.0)))
    lost = F.aggregate(F.zip_with("xs", "ds", lambda x, d: F.when(d > 0, 0.0).otherwise(x)), F.lit(0.0), lambda a, x: a + x)
    ranks = cut(degrees.select("range", F.transform("ds", lambda d: F.lit(1.0 / n)).alias("xs"), "ds"))
    for _ in range(iterations):
        given = ranks.agg(F.sum(lost)).first()[0] or 0.0
        sums = held.sums(ranks.select("range", share.alias("xs")))
        base = F.lit((1 - damping) / n + damping * given / n)
        ys = F.coalesce("ys", F.transform("ds", lambda d: F.lit(0.0)))
        scores = F.transform(ys, lambda y: base + F.lit(damping) * y)  # noqa: B023, used at once
        ranks = cut(ranks.join(sums, "range", "left").select("range", scores.alias("xs"), "ds"))
    flat = ranks.select("range", F.posexplode("xs").alias("at", "score")).select((F.col("range") * size + F.col("at")).alias("logical"), "score")
    return held.ids.join(flat, "logical").select("id", "score")
