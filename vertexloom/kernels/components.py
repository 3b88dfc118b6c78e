"""Connected components by alternating stars.

Every round rewires edges towards the smallest neighbour: the large star moves a vertex's larger
neighbours to its minimum, the small star its smaller ones. Edges only ever become shorter paths to
the component's minimum, and the number of rounds grows with the logarithm of the component's size,
not with its diameter. A hub's edges are joined with one row that holds its minimum, so adaptive
execution can split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.session import cut


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(lowest.select("u", F.col("m").alias("v")))


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every vertex that is not the minimum of its component.

    Direction and repeats do not matter, self loops and rows with a null end are ignored. A vertex
    that does not come back is its own component.
    """
    state = cut(
        edges.where(f"{src} <> {dst}").select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    )
    before = _stamp(state)
    for _ in range(max_rounds):
        if not before[0]:
            break
        large = _large_star(state).where("u <> v").distinct()
        state = cut(_small_star(large).where("u <> v").distinct())
        after = _stamp(state)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return state.select(F.col("u").alias("id"), F.col("v").alias("component"))
