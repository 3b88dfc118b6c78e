"""Statistics of trials and latencies, in integer arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.ordering import running

PERCENTILES = (90, 95, 97, 99)


def _same(keys: list[str], prefix: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys], F.lit(True))


def _ranked(df: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """Distinct values of each group with how many rows come before them, in the order of range partitions: a group may span many."""
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.sum(weight).alias("_c")).where("_c > 0")
    placed = running(counts, [*keys, "_v"], "_n", {"_all": F.col("_c")})
    firsts = placed.groupBy(*[F.col(k).alias(f"_f_{k}") for k in keys]).agg(F.min("_all").alias("_first"))
    return placed.join(firsts, _same(keys, "_f_")).select(*keys, "_v", "_c", (F.col("_all") - F.col("_first")).alias("_before"))


def trial_statistics(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Per group: count, timeouts, mean, ``stddev``, min, max, median and percentiles of a long column.

    A row counts ``weight`` times, if that is given: as often as a long column of it says.

    Negative values are timeouts and count for nothing else; a group of timeouts alone has no other
    statistics (``n`` is 0, the rest null), and rows with a null key are a group. All is truncated to
    integers, and ``stddev`` is the mean of squares minus the square of the mean. Percentile p is the
    element at place ``p * n / 100 - 1``, the first at least; an even number's median is the mean of two.
    """
    times = F.lit(1).cast("long") if weight is None else F.col(weight)
    good = F.when((F.col(value) >= 0) & (times > 0), F.col(value))
    wide = good if weight is None else good.cast("decimal(38,0)")
    n, mean = F.col("n"), F.expr("case when n > 0 then total div n end")
    base = df.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(good.isNotNull(), times)), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col(value) < 0, times)), F.lit(0)).alias("timeouts"),
        F.sum(wide * times).alias("total"),
        F.sum(wide * good * times).alias("squares"),
        F.min(good).alias("min"),
        F.max(good).alias("max"),
    )
    sizes = base.select(*[F.col(k).alias(f"_b_{k}") for k in keys], "n")
    ranked = _ranked(df.where(F.col(value) >= 0), keys, value, times).join(sizes, _same(keys, "_b_"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_c")), F.col("_v")))

    places = {f"p{p}": F.greatest(F.expr(f"({p} * n) div 100 - 1"), F.lit(0)) for p in PERCENTILES}
    places |= {"_hi": F.expr("n div 2"), "_lo": F.greatest(F.expr("n div 2 - 1"), F.lit(0))}
    marks = ranked.groupBy(*[F.col(k).alias(f"_m_{k}") for k in keys]).agg(*[at(place).alias(name) for name, place in places.items()])
    median = F.when(n % 2 == 1, F.col("_hi")).otherwise(F.expr("(_hi + _lo) div 2"))
    stddev = F.expr("case when n > 0 then squares div n - (total div n) * (total div n) end")
    return base.join(marks, _same(keys, "_m_"), "left").select(
        *keys, "n", "timeouts", mean.alias("mean"), stddev.alias("stddev"), "min", "max", median.alias("median"), *[f"p{p}" for p in PERCENTILES]
    )


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return trial_statistics(df, keys, value).select(*keys, "median")
