"""Graphs that the given relational tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.operators.ordering import with_next
from vertexloom.session import table

#: Added to ids of a second kind of entity, whose numbers overlap with the first's.
OFFSET = 100_000_000


def _pairs(lines: DataFrame) -> DataFrame:
    """Parts a < b of one order; weight: pairs of lines."""
    a = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("src"))
    b = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("dst"))
    joined = a.join(b, "o").where("src < dst")
    return joined.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def part_cooccur(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.from_edges(_pairs(table(spark, sf_dir, "lineitem")), directed=False)


def part_cooccur_sparse(spark: SparkSession, sf_dir: str) -> Graph:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 40")
    return Graph.from_edges(_pairs(lines), directed=False)


def part_supp(spark: SparkSession, sf_dir: str) -> Graph:
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.groupBy(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + OFFSET).alias("dst"))
    return Graph.from_edges(edges.agg(F.min("l_extendedprice").alias("weight")), directed=False)


def cust_part(spark: SparkSession, sf_dir: str) -> Graph:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    edges = joined.groupBy(F.col("o_custkey").alias("src"), (F.col("l_partkey") + OFFSET).alias("dst"))
    return Graph.from_edges(edges.agg(F.sum("l_quantity").alias("weight")), directed=True)


def consecutive_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the user of the next one, both different."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", "event_type", "value")
    return with_next(events, ["ts", "event_id"], {"next_user": "user_id"}).where("user_id <> next_user")


def user_transition(spark: SparkSession, sf_dir: str) -> Graph:
    steps = consecutive_events(spark, sf_dir)
    edges = steps.groupBy(F.col("user_id").alias("src"), F.col("next_user").alias("dst"))
    return Graph.from_edges(edges.agg(F.round(F.avg("value"), 6).alias("weight")), directed=True)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update log ``(seq, src, dst, weight)``; a weight of -1 deletes."""
    return consecutive_events(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        F.least("user_id", "next_user").alias("src"),
        F.greatest("user_id", "next_user").alias("dst"),
        F.when(F.col("event_type") == "error", F.lit(-1.0)).otherwise(F.col("value")).alias("weight"),
    )
