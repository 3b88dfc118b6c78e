"""Writers of kernel results, graphs, edge files and experiment records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.files import only_last, shuffles_go, stored
from vertexloom.graph import Graph
from vertexloom.operators.ordering import places_within, running
from vertexloom.session import cut


def write_result(result: DataFrame, path: str) -> None:
    """``id value`` per line, unsorted, a file per partition."""
    result.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in result.columns]).alias("value")).write.mode("overwrite").text(path)


def read_result(spark, path: str, value_type: str = "double") -> DataFrame:
    """``(id, value)`` of such lines; blank lines and ids that repeat are errors."""
    lines = spark.read.text(path)
    if lines.where("trim(value) = ''").limit(1).count():
        raise ValueError("blank line")
    w = F.split(F.trim("value"), r"\s+")
    value = F.when(F.lower(F.get(w, F.lit(1))).isin("infinity", "inf"), F.lit("Infinity")).otherwise(F.get(w, F.lit(1)))
    rows = lines.select(F.get(w, F.lit(0)).cast("long").alias("id"), value.cast(value_type).alias("value"))
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("repeated vertex")
    return rows


#: Arcs of one line of a dump; a vertex with more has several.
LINE_ARCS = 1 << 16


def adjacency_lines(graph: Graph, most: int = LINE_ARCS) -> DataFrame:
    """``(id, part, line)``: each vertex with its arcs, readable; one with more than ``most`` arcs in several lines.

    Arcs of such a hub are numbered over partitions, so no row and no task gets all of them.
    """
    arc = F.concat(F.col("dst").cast("string"), F.lit(" (w="), F.col("weight").cast("string"), F.lit(")"))
    arcs = graph.arcs.select("src", "dst", arc.alias("text"))
    hubs = cut(arcs.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > most).select("src"))
    parted = arcs.withColumn("part", F.lit(0).cast("long"))
    if hubs.limit(1).count():
        numbered = places_within(arcs.join(hubs, "src", "left_semi"), ["src"], ["dst"], "k")
        large = numbered.select("src", "dst", "text", F.floor(F.col("k") / most).alias("part"))
        parted = parted.join(hubs, "src", "left_anti").select("src", "dst", "text", "part").unionAll(large)
    lists = parted.groupBy("src", "part").agg(F.array_sort(F.collect_list(F.struct("dst", "text"))).alias("as"))
    joined = graph.vertices.join(lists, F.col("id") == F.col("src"), "left")
    texts = F.coalesce(F.array_join(F.transform("as", lambda a: a["text"]), ", "), F.lit(""))
    return joined.select("id", F.coalesce("part", F.lit(0)).alias("part"), F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), texts).alias("line"))


def write_graph_dump(graph: Graph, path: str) -> None:
    adjacency_lines(graph).orderBy("id", "part").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_edges(edges: DataFrame, path: str, weighted: bool = True) -> None:
    """An edge list as text."""
    columns = ["src", "dst", "weight"] if weighted else ["src", "dst"]
    edges.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode("overwrite").text(path)


def write_degrees(degrees: DataFrame, path: str) -> None:
    """One degree per line in the order of ``logical``."""
    degrees.orderBy("logical").select(F.col("degree").cast("string").alias("value")).write.mode("overwrite").text(path)


def write_records(spark, rows: list[dict], path: str) -> None:
    """An experiment's records, appended as Parquet."""
    spark.createDataFrame(rows).write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_metis(graph: Graph, path: str, compression: str = "none") -> None:
    """An undirected graph as adjacency lines with edge weights, vertices numbered from 1 by id."""
    with only_last(0):
        ids = cut(running(graph.vertices, ["id"], "n").select("id", (F.col("n") + 1).alias("k")))
        src = ids.select(F.col("id").alias("src"), F.col("k").alias("a"))
        dst = ids.select(F.col("id").alias("dst"), F.col("k").alias("b"))
        a, b, w = F.col("a"), F.col("b"), F.col("weight").cast("long").alias("w")
        named = stored(stored(graph.edges.join(src, "src").select("a", "dst", w)).join(dst, "dst").select("a", "b", "w"))
        arcs = named.select(F.inline(F.array(F.struct(a.alias("k"), b.alias("b"), "w"), F.struct(b.alias("k"), a.alias("b"), "w"))))
        # A row for each line, the header's too, so that vertices without neighbours have theirs; lines are made in the ranges that are written.
        lines = graph.spark.range(ids.count() + 1).select(F.col("id").alias("k"), *[F.lit(None).cast("long").alias(c) for c in "bw"])
        item = F.when(F.col("b").isNotNull(), F.struct("b", F.concat_ws(" ", F.col("b").cast("string"), F.col("w").cast("string")).alias("t")))
        lists = lines.unionAll(arcs).repartitionByRange("k").groupBy("k").agg(F.sort_array(F.collect_list(item)).alias("ts"))
        text = F.array_join(F.transform("ts", lambda t: t["t"]), " ")
        value = F.when(F.col("k") == 0, F.lit(f"{ids.count()} {graph.num_edges()} 001")).otherwise(text)
        with shuffles_go(graph.spark):
            lists.sortWithinPartitions("k").select(value.alias("value")).write.mode("overwrite").text(path, compression)
