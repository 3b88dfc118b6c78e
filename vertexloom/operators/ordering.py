"""Global order without a single task: range partitions, then offsets per partition.

A window without a partition key would move all rows into one task. Here rows are range-partitioned
by the sort key and sorted within; a row's number is its place in its partition, raised by the rows
of the partitions before. Only one row per partition is gathered for that. Where values of other rows
are needed, windows run within partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.session import cut

#: Bits of ``monotonically_increasing_id`` that hold the place within a partition.
_PLACE_BITS = 33


def _ranged(df: DataFrame, keys: list) -> DataFrame:
    """Rows with ``_part`` and ``_at``, written once so that both stay as they are."""
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    at = F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return cut(placed.select(*df.columns, F.shiftright("_id", _PLACE_BITS).alias("_part"), at.alias("_at")))


def running(df: DataFrame, keys: list, number: str = "n", sums: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with each row's number from 0 in the order of ``keys`` and running sums before the row."""
    sums = sums or {}
    rows = _ranged(df.select("*", *[c.alias(f"_v_{k}") for k, c in sums.items()]), keys)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(F.count("*").alias("_rows"), *[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    parts = parts.select(  # a row per partition
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums],
    )
    earlier = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(parts), F.col("_part") == F.col("_p")).select(
        *df.columns,
        (F.col("_n0") + F.col("_at")).alias(number),
        *[(F.col(f"_o_{k}") + F.coalesce(F.sum(f"_v_{k}").over(earlier), F.lit(0))).alias(k) for k in sums],
    )


def with_next(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """``df`` with values of the next row in the order of ``keys``: ``columns`` maps new names to columns."""
    rows = _ranged(df, keys)
    own, following = Window.partitionBy("_part").orderBy("_at"), Window.orderBy("_part")
    firsts = rows.where("_at = 0").select(  # a row per partition
        F.col("_part").alias("_p"), *[F.lead(c).over(following).alias(f"_f_{n}") for n, c in columns.items()]
    )
    last = F.lead(F.lit(True)).over(own).isNull()
    near = rows.select("*", last.alias("_last"), *[F.lead(c).over(own).alias(f"_n_{n}") for n, c in columns.items()])
    return near.join(F.broadcast(firsts), F.col("_part") == F.col("_p")).select(
        *df.columns, *[F.when(F.col("_last"), F.col(f"_f_{n}")).otherwise(F.col(f"_n_{n}")).alias(n) for n in columns]
    )


def with_previous(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """``df`` with values of the row before in the order of ``keys``: ``columns`` maps new names to columns."""
    rows = _ranged(df, keys)
    own, before = Window.partitionBy("_part").orderBy("_at"), Window.orderBy("_part")
    lasts = rows.groupBy("_part").agg(*[F.max_by(F.struct(c), "_at").alias(f"_l_{n}") for n, c in columns.items()])
    lasts = lasts.select(  # a row per partition
        F.col("_part").alias("_p"), *[F.lag(F.col(f"_l_{n}")[c]).over(before).alias(f"_f_{n}") for n, c in columns.items()]
    )
    near = rows.select("*", *[F.lag(c).over(own).alias(f"_n_{n}") for n, c in columns.items()])
    return near.join(F.broadcast(lasts), F.col("_part") == F.col("_p")).select(
        *df.columns, *[F.when(F.col("_at") == 0, F.col(f"_f_{n}")).otherwise(F.col(f"_n_{n}")).alias(n) for n in columns]
    )


def places_within(df: DataFrame, groups: list[str], keys: list[str], number: str = "n") -> DataFrame:
    """``df`` with each row's number from 0 among those of equal ``groups``, in the order of ``keys``.

    A group may be over any number of partitions, so no group is one task's work: a row's number in its
    partition is raised by the group's rows in the partitions before, which only the last group of a
    partition can have left behind.
    """
    rows = _ranged(df, [*groups, *keys])
    own = Window.partitionBy("_part").orderBy("_at")
    rows = rows.withColumn("_g", F.struct(*groups))
    first = F.when(F.col("_at") == 0, True).otherwise(~F.col("_g").eqNullSafe(F.lag("_g").over(own)))
    rows = rows.withColumn("_start", F.max(F.when(first, F.col("_at"))).over(own))
    ends = rows.groupBy("_part").agg(F.max_by("_g", "_at").alias("_g"), F.max("_start").alias("_from"), (F.max("_at") + 1).alias("_rows"))
    ends = ends.withColumn("_new", F.when(F.col("_from") > 0, F.col("_part")))  # a row per partition
    same = F.col("_g").eqNullSafe(F.lag("_g").over(Window.orderBy("_part")))
    ends = ends.withColumn("_run", F.when(F.coalesce(same, F.lit(False)) & F.col("_new").isNull(), 0).otherwise(1))
    ends = ends.withColumn("_run", F.sum("_run").over(Window.orderBy("_part")))
    left = F.sum(F.col("_rows") - F.col("_from")).over(Window.partitionBy("_run").orderBy("_part"))
    ends = ends.withColumn("_left", left)
    ends = ends.select(F.col("_part").alias("_p"), F.lag("_g").over(Window.orderBy("_part")).alias("_lg"), F.lag("_left").over(Window.orderBy("_part")).alias("_carry"))
    joined = rows.join(F.broadcast(ends), F.col("_part") == F.col("_p"))
    carried = F.when((F.col("_start") == 0) & F.col("_g").eqNullSafe(F.col("_lg")), F.coalesce("_carry", F.lit(0))).otherwise(0)
    return joined.select(*df.columns, (F.col("_at") - F.col("_start") + carried).alias(number))
