"""Arcs held for many rounds, with those of hubs dealt over several partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.session import cut

#: Arcs of one source in one partition, about; a source with more is a hub.
HUB = 1 << 20
#: Hubs that are broadcast, a few bytes each; more are joined as Spark sees fit.
BROADCAST_HUBS = 1 << 20


class HeldArcs:
    """Arcs ``(src, dst, ...)``, cached by source, so that a round only moves rows of vertices.

    A hub's arcs are dealt by destination over as many parts as it needs, and a hub's row meets each of
    them. No partition so has to hold or read all arcs of a hub, which adaptive execution could not
    split, as cached arcs are not shuffled again.
    """

    def __init__(self, arcs: DataFrame):
        degrees = arcs.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > HUB)
        hubs = cut(degrees.select(F.col("src").alias("hub"), F.ceil(F.col("n") / HUB).cast("int").alias("parts")))
        count = hubs.count()
        self.hubs = None if not count else F.broadcast(hubs) if count <= BROADCAST_HUBS else hubs
        if self.hubs is not None:
            part = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int"), F.lit(0))
            arcs = arcs.join(self.hubs, F.col("src") == F.col("hub"), "left").select(*arcs.columns, part.alias("part")).repartition("src", "part")
        else:
            arcs = arcs.repartition("src")
        self.arcs = arcs.persist()

    def meet(self, rows: DataFrame, key: str) -> DataFrame:
        """``rows`` joined with the arcs whose source is their ``key``."""
        if self.hubs is None:
            return rows.join(self.arcs, F.col(key) == F.col("src"))
        parts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))
        dealt = rows.join(self.hubs, F.col(key) == F.col("hub"), "left").select(*rows.columns, parts.alias("own_part"))
        return dealt.join(self.arcs, (F.col(key) == F.col("src")) & (F.col("own_part") == F.col("part"))).drop("own_part", "part")

    def unpersist(self) -> None:
        self.arcs.unpersist()
