"""The graph queries in DuckDB's SQL."""

from __future__ import annotations

PAIRS = """select a.l_partkey as src, b.l_partkey as dst, cast(count(*) as double) as weight
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey{where} group by 1, 2"""
SPARSE = " and a.l_returnflag = 'R' and a.l_quantity >= 40 and b.l_returnflag = 'R' and b.l_quantity >= 40"
STEPS = """select event_id, ts, user_id, event_type, value, lead(user_id) over (order by ts, event_id) as next_user from events"""
#: Edges ``e(src, dst, weight)`` of each projection; undirected ones have the smaller id first.
EDGES = {
    "part_cooccur": f"e as ({PAIRS.format(where='')})",
    "part_cooccur_sparse": f"e as ({PAIRS.format(where=SPARSE)})",
    "part_supp": "e as (select l_partkey as src, l_suppkey + 100000000 as dst, min(l_extendedprice) as weight from lineitem group by 1, 2)",
    "cust_part": """e as (select o_custkey as src, l_partkey + 100000000 as dst, sum(l_quantity) as weight
  from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)""",
    "user_transition": f"""s as ({STEPS}),
e as (select user_id as src, next_user as dst, round(avg(value), 6) as weight from s where user_id <> next_user group by 1, 2)""",
    "event_log": f"""s as ({STEPS}),
log as (select event_id as seq, least(user_id, next_user) as src, greatest(user_id, next_user) as dst,
  case when event_type = 'error' then -1.0 else value end as weight, ts from s where user_id <> next_user)""",
}
SWAP = "select src, dst, weight from e union all select dst, src, weight from e"
UNDIRECTED = f"arcs as ({SWAP}), v as (select distinct src as id from arcs)"
DIRECTED = "arcs as (select * from e), v as (select src as id from e union select dst from e)"


def over(projection: str, kind: str, body: str, recursive: bool = False) -> str:
    """A query with the projection's edges, arcs and vertices before it."""
    parts = [EDGES[projection]] + ([UNDIRECTED] if kind == "undirected" else [DIRECTED] if kind == "directed" else [])
    return f"with {'recursive ' * recursive}{', '.join(parts)}{body}"


def hashed(seed: int, *keys: str) -> str:
    """A number of 52 bits of the seed and the keys."""
    return f"cast('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 13) as bigint)"


def bfs(projection: str, kind: str) -> str:
    return over(projection, kind, """,
levels as (select min(id) as id, cast(0 as bigint) as hops from v
  union select a.dst, l.hops + 1 from levels l join arcs a on a.src = l.id where l.hops < 6)
select v.id, coalesce(min(hops), 9223372036854775807) as hops from v left join levels using (id) group by v.id""", True)  # fmt: skip


def sssp(projection: str, kind: str, rounds: int = 12) -> str:
    parts = ["d0 as (select id, case when id = (select min(id) from v) then cast(0 as double) else cast('infinity' as double) end as d from v)"]
    for k in range(1, rounds + 1):
        parts.append(f"""d{k} as materialized (select id, min(d) as d from (select * from d{k - 1} union all
  select a.dst, p.d + a.weight from d{k - 1} p join arcs a on a.src = p.id) group by id)""")
    return over(projection, kind, ",\n" + ",\n".join(parts) + f"\nselect id, round(d, 4) as distance from d{rounds}")


def pagerank(projection: str, kind: str, rounds: int) -> str:
    parts = ["deg as (select src as id, count(*) as k from arcs group by 1)", "n as (select count(*) as n from v)", "r0 as (select id, 1.0 / n as s from v, n)"]
    for k in range(1, rounds + 1):
        parts.append(f"""r{k} as materialized (select v.id, 0.15 / n + 0.85 * (coalesce(g.s, 0) + (select coalesce(sum(s), 0) from r{k - 1} anti join deg using (id)) / n) as s
  from n, v left join (select a.dst as id, sum(p.s / deg.k) as s from r{k - 1} p join deg using (id) join arcs a on a.src = p.id group by 1) g using (id))""")
    return over(projection, kind, ",\n" + ",\n".join(parts) + f"\nselect id, round(s, 9) as score from r{rounds}")


def cdlp(projection: str, kind: str, rounds: int) -> str:
    votes = "votes as (select src, dst from arcs" + (" union all select dst, src from arcs)" if kind == "directed" else ")")
    parts = [votes, "l0 as (select id, id as label from v)"]
    for k in range(1, rounds + 1):
        parts.append(f"""l{k} as materialized (select id, label from (select dst as id, label, row_number() over (partition by dst order by count(*) desc, label) as k
  from votes join l{k - 1} on src = id group by dst, label) where k = 1)""")
    return over(projection, kind, ",\n" + ",\n".join(parts) + f"\nselect id, coalesce(l{rounds}.label, id) as label from v left join l{rounds} using (id)")


NEIGHBOURS = "nb as (select src as id, dst as nbr from arcs union select dst, src from arcs)"
TRIANGLES = """t as (select x.id as a, x.nbr as b, y.nbr as c from nb x join nb y on x.nbr = y.id and x.id < x.nbr and y.id < y.nbr
  join nb z on z.id = x.id and z.nbr = y.nbr)"""


def lcc(projection: str, kind: str) -> str:
    return over(projection, kind, f""", {NEIGHBOURS}, {TRIANGLES},
m as (select least(src, dst) as x, greatest(src, dst) as y, count(*) as k from arcs group by 1, 2),
q as (select a as id, b as x, c as y from t union all select b, a, c from t union all select c, a, b from t),
credit as (select id, sum(k) as arcs from q join m using (x, y) group by id),
deg as (select id, count(*) as k from nb group by id)
select id, round(case when k < 2 then 0.0 else coalesce(arcs, 0) / (cast(k as double) * (k - 1)) end, 9) as coefficient
from v left join deg using (id) left join credit using (id)""")  # fmt: skip


def wcc(tail: str) -> str:
    parts = ["c0 as (select id, id as c from v)"]
    for k in range(1, 31):
        parts.append(f"c{k} as materialized (select id, min(c) as c from (select * from c{k - 1} union all select a.dst, p.c from c{k - 1} p join arcs a on a.src = p.id) group by id)")
    return over("part_cooccur_sparse", "undirected", ",\n" + ",\n".join(parts) + tail)


#: The last operation of each edge of a log, and the weight that it leaves.
NET = """g as (select src, dst, max_by(weight, seq) as last, max(case when weight < 0 then seq end) as gone from {log} group by 1, 2),
net as (select g.src, g.dst, min_by(l.weight, l.seq) as weight from g join {log} l
  on l.src = g.src and l.dst = g.dst and l.weight >= 0 and l.seq > coalesce(g.gone, -1) where g.last >= 0 group by 1, 2)"""


def statistics(keys: str, source: str) -> str:
    marks = ", ".join(f"max(case when k = greatest(({p} * n) // 100 - 1, 0) then x end) as p{p}" for p in (90, 95, 97, 99))
    return f"""with x as ({source}),
r as (select {keys}, x, row_number() over (partition by {keys} order by x) - 1 as k, count(*) over (partition by {keys}) as n from x where x >= 0),
late as (select {keys}, count(*) filter (x < 0) as timeouts from x group by {keys})
select late.{keys}, coalesce(any_value(n), 0) as n, any_value(timeouts) as timeouts, cast(sum(x) // any_value(n) as bigint) as mean,
  cast(sum(x * x) // any_value(n) - (sum(x) // any_value(n)) * (sum(x) // any_value(n)) as bigint) as stddev, min(x) as min, max(x) as max,
  case when any_value(n) % 2 = 1 then max(case when k = n // 2 then x end)
    else (max(case when k = n // 2 then x end) + max(case when k = n // 2 - 1 then x end)) // 2 end as median, {marks}
from late left join r on late.{keys} is not distinct from r.{keys} group by late.{keys}"""
