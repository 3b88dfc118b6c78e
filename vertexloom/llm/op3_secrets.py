"""Secret scan with corpus-wide ownership frequency.

Patterns give candidate spans in every text. The candidates' values are hashed and counted over the
whole corpus by the distinct repositories and owners that have them: a value that several owners have,
or that one has in many repositories, is an example that was copied around; one that a single owner has
in few looks live. The base patterns' spans always stay; further kinds are added only where their value
looks live.

All of it is built-in functions. Where matches start is found by splitting the text at them: pieces
and matches alternate, so a running sum of their lengths in code points gives every place. The sum runs
over rows, one per match, so a text of a million matches costs a sort of them and no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.session import cut, spread, table

# Kind, pattern, the group that holds the value, its least length. An access key's or a
# hex run's least length is in the pattern: a run that is too short has no longer one within it.
BASE = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
# Prefixes of keys that services hand out, and signed web tokens.
ADDED = (
    (
        "vendor",
        r"(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,})",
        0,
        14,
    ),
    ("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 20),
)
#: A value that more owners than this have is an example, and one that is in more repositories.
MAX_OWNERS, MAX_REPOS = 1, 2

_MATCH = "array<struct<rank:int,k:int,p:int,m:int,v:int,h:bigint>>"
_CANDIDATE = "struct<s:int,rank:int,e:int,kind:string,h:bigint>"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _rendered(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def scan(docs: DataFrame, id_col: str, text_col: str, repo: Column, owner: Column, base=BASE, added=ADDED) -> DataFrame:
    """``(row, doc_id, repo, owner, found)``: a row per row of ``docs``.

    ``found`` has for each match, of kind number ``rank``, the lengths of the piece before it, of itself
    and of its value, and the value's hash; null without matches.
    """
    kinds = [*base, *added]
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        repo.cast("string").alias("repo"),
        owner.cast("string").alias("owner"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.select("*", *[_matches(F.col("text"), p).alias(f"m{i}") for i, (_, p, _, _) in enumerate(kinds)])

    def found(i: int) -> Column:
        _, pattern, group, _ = kinds[i]
        matches = F.col(f"m{i}")
        values = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else matches
        pieces = F.slice(F.split("text", pattern, -1), F.lit(1), F.size(matches))
        each = F.transform(
            F.arrays_zip(pieces.alias("p"), matches.alias("m"), values.alias("v")),
            lambda x, k: F.struct(
                F.lit(i).alias("rank"), k.alias("k"), F.length(x["p"]).alias("p"), F.length(x["m"]).alias("m"), F.length(x["v"]).alias("v"), F.xxhash64(x["v"]).alias("h")
            ),
        )
        return F.when(F.size(matches) > 0, each).otherwise(F.array().cast(_MATCH))

    every = F.concat(*[found(i) for i in range(len(kinds))])
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repo", "owner", every.alias("found"))


def candidates(scanned: DataFrame, base=BASE, added=ADDED) -> DataFrame:
    """``(row, owner, repo, h, c)``: a row per match whose value is long enough, ``c`` with its place and kind."""
    kinds = [*base, *added]
    each = scanned.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("f"))
    before = Window.partitionBy("row", "f.rank").orderBy("f.k").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.select("*", F.sum(F.col("f.p") + F.col("f.m")).over(before).cast("int").alias("e"))
    least = F.element_at(F.array(*[F.lit(n) for *_, n in kinds]), F.col("f.rank") + 1)
    kind = F.element_at(F.array(*[F.lit(name) for name, *_ in kinds]), F.col("f.rank") + 1)
    span = F.struct((F.col("e") - F.col("f.m")).alias("s"), F.col("f.rank").alias("rank"), F.col("e").alias("e"), kind.alias("kind"), F.col("f.h").alias("h"))
    return placed.where(F.col("f.v") >= least).select("row", "owner", "repo", F.col("f.h").alias("h"), span.alias("c"))


def ownership(candidates: DataFrame) -> DataFrame:
    """``(h, n_owners, n_repos)`` of every candidate hash; rows are ``(h, owner, repo)``.

    Each step groups by one column less, so a value that a third of all rows has is added up where
    it is read, and no set of owners or repositories is ever held in one row.
    """
    return (
        candidates.groupBy("h", "owner", "repo")
        .agg(F.count("*").alias("n"))
        .groupBy("h", "owner")
        .agg(F.count("*").alias("n_repos"), F.sum("n").alias("n"))
        .groupBy("h")
        .agg(F.count("*").alias("n_owners"), F.sum("n_repos").alias("n_repos"), F.sum("n").alias("n_uses"))
    )


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo: Column | None = None,
    owner: Column | None = None,
    max_owners: int = MAX_OWNERS,
    max_repos: int = MAX_REPOS,
) -> DataFrame:
    """Secrets of every row of ``docs``.

    Returns ``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied)``. ``spans``
    has ``kind:start:end`` of the base spans and of the added ones that look live, by start, then by
    kind in the order of the pattern lists; places are code points, ends exclusive. ``n_live`` and
    ``n_copied`` count all candidates by whether their value has ``max_owners`` owners at most and is
    in ``max_repos`` of their repositories at most.

    ``owner`` is the column ``source`` unless given, ``repo`` source and language; null ones are one
    owner or repository of their own. A null text counts as empty: no spans, and the SHA-256 of
    nothing. Repeated rows stay, an empty table gives no rows, other columns are not read.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    scanned = cut(scan(docs, id_col, text_col, repo, owner))
    every = candidates(scanned)
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    judged = every.join(ownership(every.select("h", "owner", "repo")), "h").select("row", "c", live.alias("live"))
    base = F.col("c.rank") < len(BASE)
    by_row = judged.groupBy("row").agg(
        *[F.count_if(F.col("c.rank") == i).alias(f"n_{kind}") for i, (kind, *_) in enumerate(BASE)],
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
        F.array_sort(F.collect_list(F.when(base, F.col("c")))).alias("base"),
        F.array_sort(F.collect_list(F.when(base | F.col("live"), F.col("c")))).alias("all"),
    )
    none = F.array().cast(f"array<{_CANDIDATE}>")
    return scanned.select("row", "doc_id").join(by_row, "row", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{kind}", F.lit(0)).alias(f"n_{kind}") for kind, *_ in BASE],
        F.sha2(F.encode(_rendered(F.coalesce("base", none)), "UTF-8"), 256).alias("base_sha256"),
        _rendered(F.coalesce("all", none)).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spread(table(spark, sf_dir, "documents")))


def _sql() -> str:
    """The base patterns as the contract words them, short runs included, and the ownership of values."""
    worded = [(BASE[0][0], BASE[0][1], 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), *ADDED]
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(worded):
        quoted = pattern.replace("'", "''")
        parts.append(f"""k{rank} as (
  select doc_id, source, lang, {rank} as rank, '{kind}' as kind, v,
    sum(length(p) + length(m)) over (partition by doc_id order by i) - length(m) as s,
    sum(length(p) + length(m)) over (partition by doc_id order by i) as e
  from (select doc_id, source, lang, unnest(ms) as m, unnest(vs) as v, unnest(ps[1 : len(ms)]) as p, unnest(range(1, len(ms) + 1)) as i
    from (select doc_id, source, lang, regexp_extract_all(text, '{quoted}') as ms, regexp_extract_all(text, '{quoted}', {group}) as vs,
      regexp_split_to_array(text, '{quoted}') as ps from d))
  qualify length(v) >= {least})""")
    every = " union all ".join(f"select * from k{rank}" for rank in range(len(worded)))
    counts = ", ".join(f"count(*) filter (kind = '{kind}') as n_{kind}" for kind, *_ in BASE)
    n = len(BASE)
    text = "kind || ':' || s || ':' || e"
    return f"""with d as (select doc_id, source, lang, coalesce(text, '') as text from documents),
{", ".join(parts)},
c as ({every}),
o as (select v, count(distinct coalesce(source, chr(0))) <= {MAX_OWNERS}
    and count(distinct (coalesce(source, chr(0)), concat_ws('/', source, lang))) <= {MAX_REPOS} as live from c group by v)
select d.doc_id, {counts},
  sha256(coalesce(string_agg({text}, ',' order by s, rank) filter (rank < {n}), '')) as base_sha256,
  coalesce(string_agg({text}, ',' order by s, rank) filter (rank < {n} or live), '') as spans,
  count(*) filter (live) as n_live, count(*) filter (not live) as n_copied
from d left join c using (doc_id) left join o using (v) group by d.doc_id"""


SQL = _sql()
