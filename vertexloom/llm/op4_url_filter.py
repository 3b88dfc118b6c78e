"""URL filter: ordered host and path rules, then exact list membership by a Bloom filter cascade.

The cascade's even levels hold listed keys, its odd levels the other keys that got through the level
above, taken over the complete set of keys in the corpus. A key goes down the levels until one does
not have it; the parity of that level says whether it is listed. Over the key universe it was built
from, this is exact: no key is looked up in the list again.

Keys are dealt by a hash over as many filters as the list needs, each a row that holds the bits of its
levels as arrays of longs. Rows get the filter of their key, broadcast where all filters together are
small, and built-in functions test the bits. The filters are made, kept and tested on executors; the
driver sees a count per level.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.text import UPPER
from vertexloom.session import cut, table

# The contract's rules as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# Name parts of hosts that the list of unwanted sites has.
LISTED_LABELS = ("adult-x", "spam-farm", "cheap-pills", "ads-track", "casino-win", "free-bets")

#: Listed keys of one filter, about, and the bytes up to which all filters are broadcast.
FILTER_KEYS, BROADCAST_BYTES = 1 << 15, 32 << 20


@dataclass(frozen=True)
class Cascade:
    """``filters``: (part, w0, w1, ...), a row per part and the bits of each level; ``hashes``: how many each level takes."""

    filters: DataFrame
    parts: int
    hashes: tuple[int, ...]
    n_bytes: int


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(parts)).cast("int")


def _places(key: Column, bits: Column, hashes: int, depth: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(1000 * (depth + 1) + i)), bits) for i in range(hashes)]


def _contains(key: Column, words: Column, hashes: int, depth: int) -> Column:
    """Whether a level has the key; one without bits has none."""
    found = words.isNotNull()
    for at in _places(key, 64 * F.size(words).cast("long"), hashes, depth):
        word = F.get(words, F.floor(at / 64).cast("int"))
        found = found & (F.bit_get(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
    return F.coalesce(found, F.lit(False))


def _level(keys: DataFrame, bits_per_key: float, hashes: int, depth: int) -> DataFrame:
    """``(part, words)``: the bits of ``keys(part, key)``."""
    sized = keys.groupBy("part").agg(F.ceil(F.count("*") * bits_per_key / 64).cast("int").alias("n"))
    at = F.explode(F.array(*_places(F.col("key"), 64 * F.col("n").cast("long"), hashes, depth)))
    set_bits = keys.join(sized, "part").select("part", at.alias("at")).select(
        "part",
        F.floor(F.col("at") / 64).cast("int").alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int")).alias("bits"),
    )
    none = sized.select("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("word"), F.lit(0).cast("long").alias("bits"))
    whole = set_bits.unionAll(none).groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
    ordered = whole.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("ws"))
    return ordered.select("part", F.transform("ws", lambda w: w["bits"]).alias("words"))


def build_cascade(keys: DataFrame, filter_keys: int = FILTER_KEYS) -> Cascade | None:
    """Filters for ``keys(key, listed)``, one row per key of the universe; None if nothing is listed.

    The first level's rate follows the ratio of listed to other keys, which makes the whole cascade
    about as small as it can be; later levels use one half. The levels end with the first that lets
    no foreign key through.
    """
    counts = {row["listed"]: row["n"] for row in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    inside, outside = counts.get(True, 0), counts.get(False, 0)
    if not inside:
        return None
    parts = max(1, -(-inside // filter_keys))
    rate = min(0.5, max(1e-6, inside * math.sqrt(0.5) / max(outside, 1)))
    alive, count, levels, hashes, n_bytes = keys.select(_part(F.col("key"), parts).alias("part"), "key", "listed"), inside, [], [], 0
    while count:
        depth = len(levels)
        polarity = depth % 2 == 0
        bits = math.log2(1 / rate) / math.log(2)
        hashes.append(max(1, round(bits * math.log(2))))
        own = cut(_level(alive.where(F.col("listed") == polarity), bits, hashes[-1], depth))
        levels.append(own.select("part", F.lit(depth).alias("depth"), "words"))
        through = alive.join(own, "part").where(_contains(F.col("key"), F.col("words"), hashes[-1], depth))
        alive = cut(through.select("part", "key", "listed"))
        n_bytes += int(count * bits / 8) + 8 * parts
        count = alive.where(F.col("listed") != polarity).count()
        rate = 0.5
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.unionAll(level)
    columns = [F.max(F.when(F.col("depth") == d, F.col("words"))).alias(f"w{d}") for d in range(len(levels))]
    return Cascade(cut(rows.groupBy("part").agg(*columns)), parts, tuple(hashes), n_bytes)


def with_listed(rows: DataFrame, key: str, cascade: Cascade | None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` and ``listed``: exact for every key of the universe that the cascade was built from."""
    if cascade is None:
        return rows.select("*", F.lit(False).alias("listed"))
    filters = F.broadcast(cascade.filters) if cascade.n_bytes <= broadcast_bytes else cascade.filters
    joined = rows.select("*", _part(F.col(key), cascade.parts).alias("part")).join(filters, "part", "left")
    depths = len(cascade.hashes)
    flag = F.lit(depths % 2 == 1)
    for depth in reversed(range(depths)):
        flag = F.when(_contains(F.col(key), F.col(f"w{depth}"), cascade.hashes[depth], depth), flag).otherwise(F.lit(depth % 2 == 1))
    return joined.select(*rows.columns, flag.alias("listed"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def labelled_hosts(pages: DataFrame, url_col: str = "url", labels=LISTED_LABELS) -> DataFrame:
    """``(host)``: a list of unwanted hosts, those of the corpus that have one of the labels between their dots."""
    hosts = pages.select(url_parts(F.col(url_col))[0].alias("host")).distinct()
    return hosts.where(F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, labels))))


def key_universe(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """Every key of the corpus once, with whether the first column of ``listed`` has it."""
    marks = listed.select(F.col(listed.columns[0]).alias("l")).where("l is not null").distinct()
    keys = rows.select(F.col(key).alias("key")).distinct().join(marks, F.col("key") == F.col("l"), "left")
    return cut(keys.select("key", F.col("l").isNotNull().alias("listed")))


def filter_urls(
    pages: DataFrame,
    listed: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    filter_keys: int = FILTER_KEYS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(id, host, path, rule, verdict, listed)`` for every row of ``pages``.

    ``listed`` is a table of unwanted hosts in its first column, of any size, in lower case as hosts
    are here; without it the list is ``labelled_hosts``. Hosts that no page has, nulls and repeats in
    it do not matter, and a listed host does not stand for its subdomains. A rule's verdict holds where
    one fits; elsewhere a listed host is blocked and any other allowed. Null urls and urls without
    ``://`` have an empty host and path, which no rule fits. Repeated rows stay; other columns are not
    read.
    """
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    universe = key_universe(parts, "host", labelled_hosts(pages, url_col) if listed is None else listed)
    told = with_listed(parts, "host", build_cascade(universe, filter_keys), broadcast_bytes)
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return told.select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"), "listed"
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, labelled_hosts(pages))


SQL = r"""
with parts as (
  select page_id,
    case when url is null or position('://' in url) = 0 then ''
      else translate(regexp_extract(substr(url, position('://' in url) + 3), '^[^/?#]*'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end as host,
    case when url is null or position('://' in url) = 0 then ''
      else regexp_extract(substr(url, position('://' in url) + 3), '^[^/?#]*([^?#]*)', 1) end as path
  from pages),
ruled as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule,
    len(list_intersect(string_split(host, '.'),
      ['adult-x', 'spam-farm', 'cheap-pills', 'ads-track', 'casino-win', 'free-bets'])) > 0 as listed
  from parts)
select page_id, host, path, rule, listed, case
  when rule in ('example.net/en/', 'org/fr/') then 'allow'
  when rule in ('example.com/de/', 'net/') then 'block'
  when listed then 'block' else 'allow' end as verdict
from ruled
"""
