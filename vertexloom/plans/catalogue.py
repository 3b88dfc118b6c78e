"""Registered queries of the graph engine and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.files import only_last, scratch, stored
from vertexloom.functions.statistics import medians, trial_statistics
from vertexloom.graph import Graph
from vertexloom.kernels import blocks, clustering, ranking, traversal
from vertexloom.operators import algebra, updates, validate
from vertexloom.operators.ordering import running
from vertexloom.plans import experiments, sql
from vertexloom.sources import load, packed, projections, sinks, text
from vertexloom.sources.snapshots import SnapshotStore
from vertexloom.session import cut, table
from vertexloom.streaming import replay, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Rounds of the iterative kernels' queries, and the seed of hashed orders and weights.
PAGERANK_ROUNDS, CDLP_ROUNDS, SEED = 5, 3, 42


def query(oracle: str | None = None):
    """Register a function ``(spark, sf_dir)`` under its name."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return put


def _held(graph: Graph) -> Graph:
    """The graph written once, for kernels that read it again and again."""
    return Graph.from_edges(stored(graph.edges), graph.directed)


def _source(graph: Graph) -> int:
    return graph.vertices.agg(F.min("id")).first()[0]


# Kernels.


def _kernel(projection: str, run, name: str, oracle: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        with only_last():
            return stored(run(_held(getattr(projections, projection)(spark, sf_dir))))

    QUERIES[name] = f
    ORACLE_SQL[name] = oracle


def _rounded(column: str, places: int):
    return lambda df: df.withColumn(column, F.round(column, places))


for _kind, _on in (("undirected", "part_cooccur"), ("directed", "user_transition")):
    _kernel(_on, lambda g: traversal.bfs(g, _source(g)), f"bfs_{_kind}", sql.bfs(_on, _kind))
    _kernel(_on, lambda g: _rounded("distance", 4)(traversal.sssp(g, _source(g))), f"sssp_{_kind}", sql.sssp(_on, _kind))
    for _way in ("auto", "pull"):
        _kernel(_on, lambda g, way=_way: traversal.bfs(g, _source(g), direction=way), f"bfs_{_way}_{_kind}", sql.bfs(_on, _kind))
    _kernel(_on, lambda g: _rounded("distance", 4)(traversal.delta_stepping(g, _source(g))), f"sssp_delta_{_kind}", sql.sssp(_on, _kind))
    _kernel(_on, lambda g: _rounded("score", 9)(ranking.pagerank(g, PAGERANK_ROUNDS)), f"pagerank_{_kind}", sql.pagerank(_on, _kind, PAGERANK_ROUNDS))
    _kernel(_on, lambda g: _rounded("score", 9)(blocks.pagerank_blocks(g, PAGERANK_ROUNDS)), f"pagerank_blocks_{_kind}", sql.pagerank(_on, _kind, PAGERANK_ROUNDS))
    _kernel(_on, lambda g: ranking.cdlp(g, CDLP_ROUNDS), f"cdlp_{_kind}", sql.cdlp(_on, _kind, CDLP_ROUNDS))
    _kernel(_on, lambda g: _rounded("coefficient", 9)(clustering.lcc(g)), f"lcc_{_kind}", sql.lcc(_on, _kind))

# One round over a graph in which parts only have incoming arcs, so that their rank is given to all.
_kernel("cust_part", lambda g: _rounded("score", 12)(ranking.pagerank(g, 1)), "pagerank_iter1", sql.pagerank("cust_part", "directed", 1).replace("round(s, 9)", "round(s, 12)"))
_kernel("part_cooccur_sparse", clustering.wcc, "wcc", sql.wcc("\nselect id, c as component from c30"))
_kernel(
    "part_cooccur_sparse",
    lambda g: clustering.wcc(g).groupBy("component").agg(F.count("*").alias("size")),
    "wcc_sizes",
    sql.wcc("\nselect c as component, count(*) as size from c30 group by c"),
)
_kernel(
    "part_cooccur",
    clustering.triangles_per_vertex,
    "triangles_per_vertex",
    sql.over("part_cooccur", "undirected", f", {sql.NEIGHBOURS}, {sql.TRIANGLES} select id, count(*) as triangles from (select unnest([a, b, c]) as id from t) group by id"),
)
_kernel(
    "part_cooccur",
    clustering.triangle_count,
    "triangle_count",
    sql.over("part_cooccur", "undirected", f", {sql.NEIGHBOURS}, {sql.TRIANGLES} select count(*) as triangles from t"),
)
_kernel(
    "part_cooccur",
    algebra.common_neighbours,
    "common_neighbours",
    sql.over("part_cooccur", "undirected", f""", {sql.NEIGHBOURS}, {sql.TRIANGLES}
select src, dst, count(*) as n from (select a as src, b as dst from t union all select a, c from t union all select b, c from t) group by 1, 2"""),
)

# Graph algebra.


def _algebra(projection: str, run, name: str, oracle: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(getattr(projections, projection)(spark, sf_dir))
    if oracle is not None:
        ORACLE_SQL[name] = oracle


_PC, _UT = "part_cooccur", "user_transition"
_algebra(_PC, algebra.out_degree, "out_degree", sql.over(_PC, "undirected", " select src as id, count(*) as degree from arcs group by 1"))
_algebra(_PC, algebra.neighbour_degree, "neighbour_degree", sql.over(_PC, "undirected", f", {sql.NEIGHBOURS} select id, count(*) as degree from nb group by 1"))
_algebra(_PC, lambda g: algebra.symmetrize(g.edges), "symmetrize", sql.over(_PC, "undirected", " select * from arcs"))
_algebra(_PC, algebra.sum_of_degrees, "bm_degree_sum", sql.over(_PC, "undirected", " select count(*) as total from arcs"))
_algebra(_PC, algebra.sum_of_first_neighbours, "bm_point_sum", sql.over(_PC, "undirected", " select cast(sum(f) as bigint) as total from (select min(dst) as f from arcs group by src)"))
_algebra(_PC, algebra.sum_of_all_neighbours, "bm_scan_sum", sql.over(_PC, "undirected", " select cast(sum(dst) as bigint) as total from arcs"))
_algebra(_UT, algebra.in_degree, "in_degree", sql.over(_UT, "directed", " select dst as id, count(*) as degree from arcs group by 1"))
_algebra(_UT, lambda g: g.neighbours, "neighbours", sql.over(_UT, "directed", f", {sql.NEIGHBOURS} select id, nbr from nb"))
_OFFSETS = """, d as (select src as id, count(*) as degree from arcs group by 1)
select id, row_number() over (order by id) - 1 as logical, degree, cast(sum(degree) over (order by id) - degree as bigint) as start from d"""
# Over parts with their suppliers, and as ``whole_`` over all pairs of parts.
for _on, _prefix in (("part_supp", ""), (_PC, "whole_")):
    _algebra(_on, algebra.graph_counts, f"{_prefix}graph_counts", sql.over(_on, "undirected", " select 'vertices' as what, count(*) as n from v union all select 'edges', count(*) from e"))
    _algebra(_on, algebra.dense_ids, f"{_prefix}dense_ids", sql.over(_on, "undirected", " select id, row_number() over (order by id) - 1 as logical from v"))
    _algebra(_on, algebra.csr_offsets, f"{_prefix}csr_offsets", sql.over(_on, "undirected", _OFFSETS))
    _algebra(
        _on,
        lambda g: algebra.csr_offsets(g).select("logical", "degree").orderBy("logical"),
        f"{_prefix}edges_per_vertex",
        sql.over(_on, "undirected", ", d as (select src as id, count(*) as degree from arcs group by 1) select row_number() over (order by id) - 1 as logical, degree from d"),
    )
_algebra("part_supp", lambda g: algebra.vertex_table(g.edges), "vertex_table", sql.over("part_supp", "", " select id, count(*) as occurrences from (select unnest([src, dst]) as id from e) group by 1"))
_algebra("part_supp", lambda g: algebra.vertex_list(g.edges), "vertex_list", sql.over("part_supp", "", " select distinct unnest([src, dst]) as id from e"))
_algebra(
    "cust_part", lambda g: algebra.stream_stats(g.edges), "stream_stats",
    sql.over("cust_part", "", " select count(*) as num_edges, max(greatest(src, dst)) as max_vertex_id, max(weight) as max_weight from e"),
)
_algebra("cust_part", lambda g: algebra.sort_edges(g.edges), "sort_src_dst", sql.over("cust_part", "", " select * from e order by src, dst"))
_algebra("cust_part", lambda g: algebra.sort_edges(g.edges, True), "sort_dst_src", sql.over("cust_part", "", " select * from e order by dst, src"))
_algebra(
    "part_supp", lambda g: algebra.permuted_places(g.edges, SEED, "src", "dst"), "permute_edges",
    sql.over("part_supp", "", f" select *, row_number() over (order by {sql.hashed(SEED, 'src', 'dst')}, src, dst) - 1 as position from e"),
)
_algebra(
    "part_supp", lambda g: algebra.permuted_places(g.vertices, SEED, "id"), "permute_vertices",
    sql.over("part_supp", "directed", f" select id, row_number() over (order by {sql.hashed(SEED, 'id')}, id) - 1 as position from v"),
)
_algebra(
    "part_supp", lambda g: algebra.edge_at(g.edges, 100), "edge_at",
    sql.over("part_supp", "", " select src, dst, weight, position from (select *, row_number() over (order by src, dst) - 1 as position from e) where position = 100"),
)
_algebra(
    _PC, lambda g: algebra.random_vertex(g, SEED), "random_vertex",
    sql.over(_PC, "undirected", f" select id from v order by {sql.hashed(SEED, 'id')}, id limit 1"),
)
_algebra(
    _PC, lambda g: sinks.adjacency_lines(g).drop("part"), "dump_graph",
    sql.over(_PC, "undirected", " select src as id, '[' || src || '] ' || string_agg(dst || ' (w=' || cast(weight as varchar) || ')', ', ' order by dst) as line from arcs group by src"),
)


@query(sql.over("part_supp", "", f" select src, dst, cast({sql.hashed(SEED, 'src', 'dst')} % 100 + 1 as double) as weight from e"))
def weights_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.part_supp(spark, sf_dir).edges.withColumn("weight", algebra.integer_weight(SEED, 100))


@query(sql.over("part_supp", "", f" select src, dst, cast({sql.hashed(SEED, 'src', 'dst')} + 1 as double) / 4503599627370496 * 2.5::double as weight from e"))
def weights_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.part_supp(spark, sf_dir).edges.withColumn("weight", algebra.real_weight(SEED, 2.5))


def _probes(graph: Graph) -> DataFrame:
    """Every edge from its other end, and as many pairs that are mostly no edges."""
    turned = graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return turned.unionAll(graph.edges.select("src", (F.col("dst") + 7).alias("dst"))).distinct()


_PROBES = "p as (select dst as src, src as dst from e union select src, dst + 7 from e)"


@query(sql.over("part_supp", "directed", ", p as (select id + d as id from v, (values (0), (13)) t(d)) select distinct p.id, v.id is not null as found from p left join v using (id)"))
def has_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = projections.part_supp(spark, sf_dir)
    return graph.has_vertex(graph.vertices.select(F.explode(F.array("id", F.col("id") + 13)).alias("id")).distinct())


_WEIGHTS = f", {_PROBES} select p.src, p.dst, {{}} from p left join e on e.src = least(p.src, p.dst) and e.dst = greatest(p.src, p.dst)"


@query(sql.over("part_supp", "", _WEIGHTS.format("e.weight is not null as found")))
def has_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = projections.part_supp(spark, sf_dir)
    return graph.has_edge(_probes(graph))


@query(sql.over("part_supp", "", _WEIGHTS.format("e.weight")))
def get_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = projections.part_supp(spark, sf_dir)
    return graph.get_weight(_probes(graph))


# Updates. The log's first half makes a graph, its second half is applied to it where an operator needs one.

_LOG = sql.EDGES["event_log"]
_HALF = "(select max(event_id) // 2 from events)"
_OLD = f"old as (select * from log where seq <= {_HALF}), new as (select * from log where seq > {_HALF}), {sql.NET.format(log='old')}"
_NEW_EDGES = "ne as (select src, dst, min_by(weight, seq) as weight from new where weight >= 0 group by 1, 2)"
_ENDS = "ov as (select distinct unnest([src, dst]) as id from net)"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    log = cut(projections.event_log(spark, sf_dir))
    middle = (table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) // 2
    effect = updates.net_effect(log.where(F.col("seq") <= middle)).where("present").select("src", "dst", "weight")
    return Graph.from_edges(cut(effect), directed=False), log.where(F.col("seq") > middle)


def _inserted(log: DataFrame) -> DataFrame:
    return log.where("weight >= 0").groupBy("src", "dst").agg(F.min_by("weight", "seq").alias("weight"))


@query(f"with {_LOG} select case when weight >= 0 then 'insert' else 'delete' end as kind, seq, src, dst, weight from log")
def split_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    put, gone = updates.split_updates(projections.event_log(spark, sf_dir))
    return put.select(F.lit("insert").alias("kind"), "*").unionAll(gone.select(F.lit("delete").alias("kind"), "*"))


@query(f"with {_LOG} select seq, src, dst, weight, (src + dst) % 8 as worker from log")
def partition_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates.partition_updates(projections.event_log(spark, sf_dir), 8)


@query(f"with {_LOG}, {_OLD}, {_ENDS} select distinct user_id as id, ov.id is null as accepted from events left join ov on user_id = ov.id")
def add_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = _halves(spark, sf_dir)
    return updates.add_vertices(graph, table(spark, sf_dir, "events").select(F.col("user_id").alias("id")))[1]


@query(f"with {_LOG}, {_OLD} select src, dst, weight from net where src % 3 <> 0 and dst % 3 <> 0")
def remove_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = _halves(spark, sf_dir)
    return updates.remove_vertices(graph, graph.vertices.where("id % 3 = 0")).edges


@query(f"""with {_LOG}, {_OLD}, {_NEW_EDGES}, kept as (select * from net where src % 3 <> 0 and dst % 3 <> 0),
kv as (select distinct unnest([src, dst]) as id from net where src % 3 <> 0 or dst % 3 <> 0)
select src, dst, src % 3 <> 0 and dst % 3 <> 0 and src in (select id from kv) and dst in (select id from kv) and k.src is null as accepted
from (select ne.src, ne.dst, k.src as ks from ne left join kept k on k.src = ne.src and k.dst = ne.dst) x left join kept k using (src, dst)""")  # fmt: skip
def add_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, new = _halves(spark, sf_dir)
    thinned = updates.remove_vertices(graph, graph.vertices.where("id % 3 = 0"))
    return updates.add_edges(thinned, _inserted(new))[1]


@query(f"with {_LOG}, {_OLD}, {_NEW_EDGES} select src, dst, coalesce(net.weight, ne.weight) as weight from net full join ne using (src, dst)")
def add_edges_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, new = _halves(spark, sf_dir)
    return updates.add_edges_v2(graph, _inserted(new))[0].edges


@query(f"with {_LOG}, {_OLD}, gone as (select distinct src, dst from new where weight < 0) select src, dst, weight from net anti join gone using (src, dst)")
def remove_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, new = _halves(spark, sf_dir)
    return updates.remove_edges(graph, updates.split_updates(new)[1])[0].edges


_NET_ALL = f"with {_LOG}, {sql.NET.format(log='log')} "


@query(_NET_ALL + "select src, dst, weight from net")
def apply_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, new = _halves(spark, sf_dir)
    return updates.apply_batch(graph, new).edges


@query(f"with {_LOG} select src, dst, max_by(weight, seq) as weight from log group by 1, 2 having max_by(weight, seq) >= 0")
def apply_batch_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = Graph(spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long, weight double"), False)
    return updates.apply_batch(empty, projections.event_log(spark, sf_dir), "overwrite").edges


_STEPWISE = """with recursive {log}, {old},
k as (select seq, src, dst, weight, row_number() over (partition by src, dst order by seq) as k from new),
r as (select k.*, net.src is not null as before from k left join net using (src, dst) where k = 1
  union all select k.*, r.weight >= 0 from r join k on k.src = r.src and k.dst = r.dst and k.k = r.k + 1)
select seq, src, dst, weight, before <> (weight >= 0) as accepted from r"""


@query(_STEPWISE.format(log=_LOG, old=_OLD))
def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, new = _halves(spark, sf_dir)
    return updates.batch_outcomes(graph, new)


#: One operation after the other, with those that wait counted.
_WAITING = """with recursive {log}, {old},
k as (select seq, src, dst, weight, row_number() over (partition by src, dst order by seq) as k,
  row_number() over (partition by src, dst, weight >= 0 order by seq) as own from new),
r as (select src, dst, cast(0 as bigint) as k, max(net.src is not null) as here, 0 as puts, 0 as gone, 0 as wait_put, 0 as wait_gone from k left join net using (src, dst) group by 1, 2
  union all select src, dst, k + 1, case when waits then here when frees then here else not here end,
    puts + cast(put and not waits as int) + cast(not put and frees as int), gone + cast(not put and not waits as int) + cast(put and frees as int),
    wait_put + cast(put and waits as int) - cast(not put and frees as int), wait_gone + cast(not put and waits as int) - cast(put and frees as int)
  from (select r.*, k.weight >= 0 as put, (k.weight >= 0) = r.here as waits,
      (k.weight >= 0) <> r.here and case when k.weight >= 0 then wait_gone else wait_put end > 0 as frees
    from r join k on k.src = r.src and k.dst = r.dst and k.k = r.k + 1)),
done as (select src, dst, max_by(puts, k) as puts, max_by(gone, k) as gone from r group by 1, 2)
select seq, src, dst, weight, own <= case when weight >= 0 then puts else gone end as accepted from k join done using (src, dst)"""


@query(_WAITING.format(log=_LOG, old=_OLD))
def batch_outcomes_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, new = _halves(spark, sf_dir)
    return updates.batch_outcomes_forced(graph, new).drop("turn")


@query(_NET_ALL + """, k as (select * from net where src % 5 <> 0 and dst % 5 <> 0)
select 'edges' as what, count(*) as n from k union all
select 'vertices', count(*) from (select distinct unnest([src, dst]) as id from log where weight >= 0) where id % 5 <> 0""")  # fmt: skip
def final_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = Graph(spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long, weight double"), False)
    graph = updates.apply_batch(empty, cut(projections.event_log(spark, sf_dir)))
    return updates.final_counts(graph, graph.vertices.where("id % 5 = 0"))[1]


@query(f"with {_LOG} select date_trunc('second', ts) as second, count(*) as updates from log group by 1")
def ops_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = projections.consecutive_events(spark, sf_dir)
    return replay.updates_per_second(steps, "ts").withColumn("second", F.col("second").cast("timestamp_ntz"))


@query(_NET_ALL + "select src, dst, weight from net")
def stream_apply_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    replay.write_segments(projections.event_log(spark, sf_dir), f"{folder}/log", 3)
    store = SnapshotStore(spark, f"{folder}/versions", directed=False)
    replay.replay(spark, f"{folder}/log", store, f"{folder}/progress")
    return store.load().edges


@query(_NET_ALL + "select src, dst, weight from net")
def stream_state_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log through keyed state in two micro-batches; edges are what its outcomes leave."""
    folder = scratch(spark)
    files = spark.sparkContext.defaultParallelism
    state.write_feed(projections.event_log(spark, sf_dir), f"{folder}/feed", 2, files)
    return state.edges_of(state.run_outcomes(spark, f"{folder}/feed", f"{folder}/out", f"{folder}/progress", files=files))


def _inserted_stream(graph: Graph) -> DataFrame:
    store, _ = experiments.insert_only(graph.edges, scratch(graph.spark), 3, SEED)
    return store.load().edges


@query(sql.over("part_supp", "", " select * from e"))
def insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inserted_stream(projections.part_supp(spark, sf_dir))


@query(sql.over("part_cooccur", "", " select * from e"))
def whole_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inserted_stream(projections.part_cooccur(spark, sf_dir))


@query(f"with {_LOG}, {_OLD}, n2 as (select count(*) as n from (select src, dst from log group by 1, 2 having max_by(weight, seq) >= 0)) "
       "select 1 as version, count(*) as edges from net union all select 2, n from n2")  # fmt: skip
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, new = _halves(spark, sf_dir)
    store = SnapshotStore(spark, scratch(spark), directed=False)
    store.build(graph)
    store.build(updates.apply_batch(store.load(), new))
    counts = [store.load(v).edges.agg(F.lit(v).alias("version"), F.count("*").alias("edges")) for v in store.versions()]
    return counts[0].unionAll(counts[1])


@query(_NET_ALL + ", a as (select src, dst, weight from net union all select dst, src, weight from net), "
       "p as (select src, dst, weight as wanted from log where weight >= 0), pp as (select * from p union all select dst, src, wanted from p) "
       "select pp.src, pp.dst, pp.wanted, a.weight from pp left join a using (src, dst) where a.weight is distinct from pp.wanted")  # fmt: skip
def validate_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = cut(projections.event_log(spark, sf_dir))
    empty = Graph(spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long, weight double"), False)
    return validate.update_mismatches(updates.apply_batch(empty, log), log.where("weight >= 0"))


# Validation: degrees against neighbour counts, changed in a rule-given part, so that there is something to find.

_DEG = ", a as (select src as id, count(*) as x from arcs group by 1)"


def _degree_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    graph = projections.user_transition(spark, sf_dir)
    degree = cut(algebra.out_degree(graph).toDF("id", "value"))
    wrong = degree.where("id % 11 <> 0").withColumn("value", F.when(F.col("id") % 7 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return wrong, degree.where("id % 13 <> 0")


_WRONG = f"{_DEG}, r as (select id, case when id % 7 = 0 then x + 1 else x end as result from a where id % 11 <> 0), e2 as (select id, x as expected from a where id % 13 <> 0)"


@query(sql.over("user_transition", "directed", f"{_WRONG} select id, result, expected from r full join e2 using (id) where result is distinct from expected"))
def validate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.exact_mismatches(*_degree_pair(spark, sf_dir))


@query(sql.over("user_transition", "directed", f"""{_WRONG} select id, cast(result as double) as result, cast(expected as double) as expected
from r full join e2 using (id) where result is null or expected is null or abs(result - expected) > 0.02 * expected"""))  # fmt: skip
def validate_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong, degree = (df.withColumn("value", F.col("value").cast("double")) for df in _degree_pair(spark, sf_dir))
    return validate.epsilon_mismatches(wrong, degree, 0.02)


@query(sql.over("user_transition", "directed", f"""{_DEG}, b as (select id, x as expected, case when id % 7 = 0 then x + 1 else x end as result from a), p as (select distinct expected, result from b)
select 'expected' as side, expected as label, count(*) as n from p group by 2 having count(*) > 1 union all
select 'result', result, count(*) from p group by 2 having count(*) > 1"""))  # fmt: skip
def validate_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    degree = cut(algebra.out_degree(projections.user_transition(spark, sf_dir)).toDF("id", "value"))
    wrong = degree.withColumn("value", F.when(F.col("id") % 7 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return validate.equivalence_mismatches(wrong, degree)


@query("""with a as (select o_orderkey as id, row_number() over (order by o_orderkey) - 1 as position from orders),
b as (select o_orderkey as other_id, row_number() over (order by o_totalprice, o_orderkey) - 1 as position from orders) select id, other_id from a join b using (position)""")  # fmt: skip
def remap_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by their key and by their price, as two orders of one set of vertices."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return validate.remap_vertices(running(orders, ["id"], "position"), running(orders, ["price", "id"], "position"))


# Statistics of event values, in hundredths; those of errors count as timeouts where the query says so.

_VALUES = "select event_type, {} as x from events"


_LATE = _VALUES.format("case when event_id % 10 = 0 then -1 else cast(round(value * 100) as bigint) end")


@query(sql.statistics("event_type", f"{_LATE} union all select 'late', -1 from events union all select null, x from ({_LATE}) where event_type = 'click'"))
def exec_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By event type, with a group of timeouts alone and one without a name, which repeats the clicks."""
    x = F.when(F.col("event_id") % 10 == 0, F.lit(-1)).otherwise(F.round(F.col("value") * 100)).cast("long")
    rows = table(spark, sf_dir, "events").select("event_type", x.alias("x"))
    late = rows.select(F.lit("late").alias("event_type"), F.lit(-1).cast("long").alias("x"))
    unnamed = rows.where("event_type = 'click'").select(F.lit(None).cast("string").alias("event_type"), "x")
    return trial_statistics(rows.unionAll(late).unionAll(unnamed), ["event_type"], "x")


@query(sql.statistics("kind", "select case when event_type = 'error' then 'delete' else 'insert' end as kind, cast(round(value * 100) as bigint) as x from events union all select 'all', cast(round(value * 100) as bigint) from events"))
def latency_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.round(F.col("value") * 100).cast("long").alias("x")
    kind = F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("insert"))
    rows = table(spark, sf_dir, "events").select(F.explode(F.array(kind, F.lit("all"))).alias("kind"), x)
    return trial_statistics(rows, ["kind"], "x")


@query(f"select event_type, median from ({sql.statistics('event_type', _VALUES.format('cast(round(value * 100) as bigint)'))})")
def bm_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.round(F.col("value") * 100).cast("long").alias("x")
    return medians(table(spark, sf_dir, "events").select("event_type", x), ["event_type"], "x")


# Readers: a projection is written in the format and read again.


def _written(spark: SparkSession, sf_dir: str, weighted: bool, prefix: str = "") -> str:
    path = scratch(spark)
    edges = projections.part_supp(spark, sf_dir).edges
    if prefix:
        edges = edges.select(F.concat(F.lit(prefix), F.col("src").cast("string")).alias("src"), "dst", F.floor("weight").alias("weight"))
    sinks.write_edges(edges, path, weighted)
    return path


@query(sql.over("part_supp", "", " select src, dst, 1.0 as weight from e"))
def read_el(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_plain(spark, _written(spark, sf_dir, False))


@query(sql.over("part_supp", "", " select * from e"))
def read_wel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_weighted(spark, _written(spark, sf_dir, True))


@query(sql.over("part_supp", "", " select src, dst, floor(weight) as weight from e"))
def read_dimacs9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_dimacs9(spark, _written(spark, sf_dir, True, "a "))


def _metis_again(graph: Graph) -> DataFrame:
    with only_last():  # the arcs that were read
        path = scratch(graph.spark)
        with only_last(0):
            sinks.write_metis(_held(graph), path, "gzip")
        return text.read_metis(graph.spark, path)


_METIS = """, k as (select id, row_number() over (order by id) as k from v)
select a.k as src, b.k as dst, floor(weight) as weight from arcs join k a on arcs.src = a.id join k b on arcs.dst = b.id"""


@query(sql.over("part_supp", "undirected", _METIS))
def read_metis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metis_again(projections.part_supp(spark, sf_dir))


@query(sql.over("part_cooccur", "undirected", _METIS))
def whole_read_metis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metis_again(projections.part_cooccur(spark, sf_dir))


@query(sql.over("part_supp", "directed", " select id from v"))
def read_ldbc_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    projections.part_supp(spark, sf_dir).vertices.select(F.col("id").cast("string")).write.text(path)
    return text.read_ldbc_vertices(spark, path)


@query(sql.over("part_supp", "", " select * from e"))
def read_ldbc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_ldbc_edges(spark, _written(spark, sf_dir, True))


@query(sql.over("part_supp", "", " select * from e"))
def read_ldbc_zlib(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    packed.write_packed(projections.part_supp(spark, sf_dir).edges, path)
    return packed.read_edges(spark, path)


def _packed_log(spark: SparkSession, sf_dir: str) -> str:
    """The log as files of ranges of ``seq``, as many as its updates need."""
    path = scratch(spark)
    packed.write_log(projections.event_log(spark, sf_dir), path)
    return path


@query(f"with {_LOG} select 'updates' as key, count(*) as n from log")
def graphlog_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of updates that the files' headers state, over all files."""
    told = packed.log_properties(spark, _packed_log(spark, sf_dir)).where("key = 'updates'")
    return told.groupBy("key").agg(F.sum(F.col("value").cast("long")).alias("n"))


@query(f"with {_LOG} select distinct unnest([src, dst]) as id, false as temporary from log")
def graphlog_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.log_vertices(spark, _packed_log(spark, sf_dir)).distinct()


@query(f"with {_LOG} select src, dst, weight from log")
def graphlog_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.log_updates(spark, _packed_log(spark, sf_dir)).select("src", "dst", "weight")


def _loaded_again(graph: Graph) -> DataFrame:
    path = scratch(graph.spark) + ".wel"
    sinks.write_edges(algebra.symmetrize(graph.edges), path)
    return load.load_graph(graph.spark, path, directed=False).edges


@query(sql.over("part_supp", "", " select * from e"))
def load_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded_again(projections.part_supp(spark, sf_dir))


@query(sql.over("part_cooccur", "", " select * from e"))
def whole_load_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded_again(projections.part_cooccur(spark, sf_dir))
