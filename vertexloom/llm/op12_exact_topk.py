"""Exact top-k search with block-at-a-time pruning.

A vector's components are terms, each with a positive and a negative side, and its values their weights.
Rows are put in an order that keeps similar vectors together and cut into ranges of it, the blocks. A
block has a forward index, its rows' values, and each term's least and greatest value. For a query the
sum of its weights times these extremes bounds all scores of the block. Each query takes blocks in the
order of falling bounds and scores them through their forward indexes, until the bounds fall below its
kth score; blocks whose bound equals it are scored, as they may hold ties. Results so are exact.

Queries and blocks meet in tiles of a bounded number of both, one task each; what tiles find is merged by
query. A tile takes a query's blocks in rounds, each as many as all before it, so that queries that want
the same block are scored together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.session import cut, table

SCALE, K, QUERY_STEP = 256, 5, 50
#: Rows of a block, rows of a tile, queries that are scored together, and such groups in a tile. None changes results.
BLOCK, TILE_ROWS, GROUP, TILE_GROUPS = 128, 1 << 16, 2048, 16
#: First components whose signs order the rows.
SIGNS = 16
#: Scaled components count as this if they are over it.
LARGEST = 1e100
_NO_ID = np.iinfo(np.int64).max


def whole(vector: Column) -> Column:
    """True of vectors that are there and have finite components only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def _matrix(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """Vectors as rows of scaled whole numbers, shorter ones filled with zeros."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dim))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = values[offsets[0] : offsets[-1]]
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * scale), -LARGEST, LARGEST)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _cut_up(rows: DataFrame, dim: int, scale: float, size: int) -> DataFrame:
    """``(ids, forward, low, high)``: so many rows after one another each, with extremes by component; matrices as bytes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values = np.empty(0, np.int64), np.empty((0, dim))

        def packed(n: int) -> pa.RecordBatch:
            own = values[:n]
            arrays = [pa.array([ids[:n].tobytes()]), pa.array([own.tobytes()]), pa.array([own.min(axis=0).tobytes()]), pa.array([own.max(axis=0).tobytes()])]
            return pa.RecordBatch.from_arrays(arrays, ["ids", "forward", "low", "high"])

        for batch in batches:
            ids = np.concatenate([ids, _ids(batch.column("vec_id"))])
            values = np.concatenate([values, _matrix(batch.column("v"), dim, scale)])
            while len(ids) >= size:
                yield packed(size)
                ids, values = ids[size:], values[size:]
        if len(ids):
            yield packed(len(ids))

    return rows.select("vec_id", "v").mapInArrow(build, "ids binary, forward binary, low binary, high binary")


class Best:
    """The k best scores of each query so far; of equal ones the smaller id."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), _NO_ID)

    def offer(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of some queries with the same rows; -inf for none."""
        hit = np.flatnonzero((scores >= self.scores[queries, -1][:, None]).any(axis=1))
        if not len(hit):
            return
        queries = queries[hit]
        scores = np.concatenate([self.scores[queries], scores[hit]], axis=1)
        ids = np.concatenate([self.ids[queries], np.broadcast_to(ids, (len(hit), len(ids)))], axis=1)
        order = np.lexsort((ids, -scores), axis=-1)[:, : self.scores.shape[1]]
        self.scores[queries] = np.take_along_axis(scores, order, axis=1)
        self.ids[queries] = np.take_along_axis(ids, order, axis=1)


def search(own: np.ndarray, queries: np.ndarray, ids: list[np.ndarray], forward: list[np.ndarray], low: np.ndarray, high: np.ndarray, k: int) -> tuple[Best, int]:
    """The k best rows of blocks for each query, its own id left out, and how many blocks were scored."""
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    bounds += np.abs(bounds) * 1e-9  # beyond 2^53 sums are rounded
    order = np.argsort(-bounds, axis=1, kind="stable")
    best, done, scored, n = Best(len(queries), k), 0, 0, order.shape[1]
    while done < n:
        alive = np.flatnonzero(bounds[np.arange(len(queries)), order[:, done]] >= best.scores[:, -1])
        if not len(alive):
            break
        ahead = order[alive, done : min(n, max(1, 2 * done))]
        query, block = np.repeat(alive, ahead.shape[1]), ahead.ravel()
        by = np.argsort(block, kind="stable")
        query, block = query[by], block[by]
        edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            b, wanted = int(block[start]), query[start:end]
            wanted = wanted[bounds[wanted, b] >= best.scores[wanted, -1]]
            if len(wanted):
                scored += len(wanted)
                scores = queries[wanted] @ forward[b].T
                scores[own[wanted][:, None] == ids[b][None, :]] = -np.inf
                best.offer(wanted, ids[b], scores)
        done = max(1, 2 * done)
    return best, scored


def top_k(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = K, scale: float = SCALE, block: int = BLOCK, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each row of ``queries`` the ``k`` rows with the greatest inner product.

    Components are multiplied by ``scale`` and floored. Scores are exact below 2^53; beyond, they are
    rounded, and clipped to longs. Ties go to the smaller id. A row of the query's own id is left out, so
    of rows that repeat an id no one is found by another. Null vectors and those with null or non-finite
    components take no part, neither do queries without an id; a row without one ranks last of its
    ties, and the largest long stands for it inside. Shorter vectors are filled with zeros. Repeated
    queries each get their ranks; empty tables give no rows; other columns are not read.
    """

    def clean(df: DataFrame) -> DataFrame:
        own = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        return own.where(whole(F.col("v")))

    spark = rows.sparkSession
    rows, queries = clean(rows), clean(queries).where("vec_id is not null")
    count, longest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    asked, longest_query = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    if not count or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(longest, longest_query, 1)
    # Tiles hold a bounded number of rows; smaller tables make as many tiles as there are cores.
    shards = max(-(-count // tile_rows), min(spark.sparkContext.defaultParallelism, -(-count // (4 * block))))
    cells = -(-asked // (GROUP * TILE_GROUPS))

    signs = sum((F.when(F.coalesce(F.get("v", F.lit(i)), F.lit(0.0)) >= 0, 1 << i).otherwise(0) for i in range(SIGNS)), F.lit(0))
    ordered = rows.withColumn("code", signs).repartitionByRange("code", "vec_id").sortWithinPartitions("code", "vec_id")
    blocks = cut(_cut_up(ordered, dim, scale, block).withColumn("block", F.monotonically_increasing_id()))
    blocks = blocks.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards))).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    groups = cut(_cut_up(queries.repartition(max(1, -(-asked // GROUP))), dim, scale, GROUP).select(F.monotonically_increasing_id().alias("group"), "ids", "forward"))
    groups = groups.withColumn("cell", F.pmod(F.xxhash64("group"), F.lit(cells)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def tile(asking: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        ids = [np.frombuffer(b, np.int64) for b in given["ids"]]
        forward = [np.frombuffer(b).reshape(-1, dim) for b in given["forward"]]
        low, high = (np.frombuffer(b"".join(given[name])).reshape(-1, dim) for name in ("low", "high"))
        found = []
        for group, own, matrix in zip(asking["group"], asking["ids"], asking["forward"]):
            own = np.frombuffer(own, np.int64)
            if ids:
                best, _ = search(own, np.frombuffer(matrix).reshape(-1, dim), ids, forward, low, high, k)
                at = np.repeat(np.arange(len(own)), k)
                there = best.scores.ravel() > -np.inf
                parts = {"group": group, "at": at, "query_id": own[at], "vec_id": best.ids.ravel(), "score": best.scores.ravel()}
                found.append(pd.DataFrame(parts)[there])
        return pd.concat(found) if found else pd.DataFrame({"group": [], "at": [], "query_id": [], "vec_id": [], "score": []})

    kinds = "group long, at long, query_id long, vec_id long, score double"
    met = groups.groupBy("cell", "shard").cogroup(blocks.groupBy("cell", "shard")).applyInPandas(tile, kinds)
    rank = F.row_number().over(Window.partitionBy("group", "at").orderBy(F.desc("score"), "vec_id"))
    top = met.withColumn("rank", rank).where(F.col("rank") <= k)
    score = F.when(F.col("score") >= 2.0**63, F.lit(2**63 - 1)).when(F.col("score") <= -(2.0**63), F.lit(-(2**63))).otherwise(F.col("score").cast("long"))
    return top.select("query_id", "rank", F.when(F.col("vec_id") != int(_NO_ID), F.col("vec_id")).alias("vec_id"), score.alias("score"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % QUERY_STEP == 0), "vec_id", "embedding")


SQL = f"""with v as (select vec_id, [floor({SCALE} * cast(x as double)) for x in embedding] as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % {QUERY_STEP} = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= {K}"""
