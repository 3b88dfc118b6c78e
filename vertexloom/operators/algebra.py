"""Operators on graphs and edge streams that are one plan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.files import stored
from vertexloom.graph import Graph, endpoints, swapped
from vertexloom.operators.closing import closed
from vertexloom.operators.ordering import running


def symmetrize(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    return edges.unionAll(swapped(edges).select(*edges.columns))


def out_degree(graph: Graph) -> DataFrame:
    return graph.arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def in_degree(graph: Graph) -> DataFrame:
    return graph.arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))


def neighbour_degree(graph: Graph) -> DataFrame:
    """Distinct neighbours over arcs of either direction."""
    return graph.neighbours.groupBy("id").agg(F.count("*").alias("degree"))


def degrees_of_all(graph: Graph) -> DataFrame:
    """Out-degree of every vertex, 0 for those without arcs."""
    return graph.vertices.join(out_degree(graph), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def vertex_table(edges: DataFrame) -> DataFrame:
    """How often each vertex is an end of an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("occurrences"))


def vertex_list(edges: DataFrame) -> DataFrame:
    return endpoints(edges).orderBy("id")


def stream_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(
        F.count("*").alias("num_edges"),
        F.max(F.greatest("src", "dst")).alias("max_vertex_id"),
        F.max("weight").alias("max_weight"),
    )


def graph_counts(graph: Graph) -> DataFrame:
    v = graph.vertices.select(F.lit("vertices").alias("what"))
    e = graph.edges.select(F.lit("edges").alias("what"))
    return v.unionAll(e).groupBy("what").agg(F.count("*").alias("n"))


def common_neighbours(graph: Graph) -> DataFrame:
    """``(src, dst, n)``: common neighbours of each edge's ends; edges without any are left out.

    Each triangle is found once and counts for its three edges.
    """
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    found = triangles(graph)
    pairs = found.select(F.explode(F.array(*[F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")) for x, y in ((a, b), (a, c), (b, c))])).alias("p"))
    return pairs.groupBy("p.src", "p.dst").agg(F.count("*").alias("n"))


#: Vertices of the highest degrees that are ordered by degree, at least; the rows are broadcast.
RANKED = 1 << 18


def triangles(graph: Graph, degree: DataFrame | None = None) -> DataFrame:
    """Each triangle (a, b, c) of the undirected skeleton once; ``degree`` is ``neighbour_degree``'s result, if it is there.

    Arcs go to the higher of two vertices. Those of the highest degrees are above all others, by degree; the
    others are by id. As many are ranked as the square root of twice the edges, so no list is longer than that.
    """
    degree = stored(neighbour_degree(graph)) if degree is None else degree
    kinds = [(r["degree"], r["n"]) for r in degree.groupBy("degree").agg(F.count("*").alias("n")).sort(F.desc("degree")).collect()]
    most = max(RANKED, int(sum(d * n for d, n in kinds) ** 0.5))
    least, ranked = 0, 0
    for d, n in kinds:
        ranked += n
        if ranked > most:
            least = d  # of the degrees above this one there are not too many
            break
    high = degree.where(F.col("degree") > least)
    rank = [F.broadcast(high.select(F.col("id").alias(end), F.col("degree").alias(f"_{end}"))) for end in ("src", "dst")]
    pairs = graph.neighbours.where("id < nbr").toDF("src", "dst") if graph.directed else graph.edges.select("src", "dst")
    placed = pairs.join(rank[0], "src", "left").join(rank[1], "dst", "left")
    of = {end: F.struct(F.coalesce(f"_{end}", F.lit(0)), F.col(end)) for end in ("src", "dst")}
    up = of["src"] < of["dst"]
    a, b = F.when(up, F.col("src")).otherwise(F.col("dst")), F.when(up, F.col("dst")).otherwise(F.col("src"))
    return closed(placed.select(a.alias("a"), b.alias("b")), degree)


def sort_edges(edges: DataFrame, by_destination: bool = False) -> DataFrame:
    return edges.orderBy("dst", "src") if by_destination else edges.orderBy("src", "dst")


def hashed(seed: int, *keys: str) -> Column:
    """The first 52 bits of the MD5 of the seed and the keys: the same number in any engine that has MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def permute(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Rows in an order that depends on the seed and the keys alone."""
    return df.orderBy(hashed(seed, *keys), *keys)


def permuted_places(df: DataFrame, seed: int, *keys: str, number: str = "position") -> DataFrame:
    """Rows with their place, from 0, in the order of ``permute``."""
    return running(df.withColumn("_h", hashed(seed, *keys)), ["_h", *keys], number).drop("_h")


def edge_at(edges: DataFrame, position: int) -> DataFrame:
    """The edge at a place, from 0, of the stream sorted by source and destination."""
    found = running(edges, ["src", "dst"], "position").where(F.col("position") == position)
    if not found.limit(1).count():
        raise IndexError(position)
    return found


def dense_ids(graph: Graph) -> DataFrame:
    """``(id, logical)``: vertices numbered from 0 by id."""
    return running(graph.vertices, ["id"], "logical")


def csr_offsets(graph: Graph) -> DataFrame:
    """``(id, logical, degree, start)``: where each vertex's arcs start when all are sorted by source."""
    return running(degrees_of_all(graph), ["id"], "logical", {"start": F.col("degree")})


def csr_arcs(graph: Graph) -> DataFrame:
    """Arcs by logical ids, range-partitioned and sorted by source."""
    ids = dense_ids(graph)
    src = ids.select(F.col("id").alias("src"), F.col("logical").alias("logical_src"))
    dst = ids.select(F.col("id").alias("dst"), F.col("logical").alias("logical_dst"))
    arcs = graph.arcs.join(src, "src").join(dst, "dst").select("logical_src", "logical_dst", "weight")
    return arcs.repartitionByRange("logical_src").sortWithinPartitions("logical_src", "logical_dst")


def random_vertex(graph: Graph, seed: int) -> DataFrame:
    """One vertex, drawn by the seed."""
    return permute(graph.vertices, seed, "id").limit(1)


def integer_weight(seed: int, max_weight: int) -> Column:
    """A weight of 1 to ``max_weight`` that depends on the seed and the edge's ends alone."""
    if max_weight == 1:
        return F.lit(1.0)
    return (hashed(seed, "src", "dst") % F.lit(max_weight) + 1).cast("double")


def real_weight(seed: int, max_weight: float) -> Column:
    """A weight over 0 and up to ``max_weight`` that depends on the seed and the edge's ends alone."""
    steps = 1 << 52
    return (hashed(seed, "src", "dst") + 1) / F.lit(float(steps)) * F.lit(float(max_weight))


def sum_of_degrees(graph: Graph) -> DataFrame:
    return out_degree(graph).agg(F.sum("degree").alias("total"))


def sum_of_first_neighbours(graph: Graph) -> DataFrame:
    """Sum of each vertex's smallest neighbour."""
    return graph.arcs.groupBy("src").agg(F.min("dst").alias("first")).agg(F.sum("first").alias("total"))


def sum_of_all_neighbours(graph: Graph) -> DataFrame:
    return graph.arcs.agg(F.sum("dst").alias("total"))
