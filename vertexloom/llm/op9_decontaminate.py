"""Benchmark decontamination by winnowing.

Every text's k-word grams are hashed and of each ``w`` consecutive hashes the smallest is kept. Two
texts that share ``k + w - 1`` words in a row share all hashes of that span, so also the smallest one:
each shared window is found by a join of the kept hashes. A hit names a diagonal, the distance between
the places in both texts; each diagonal is extended once, word by word, and only runs as long as a
window count. So no shared window is missed and none is made up, whatever the hashes do.

Benchmark items shorter than a window are windows of their own length, with a ``k`` and ``w`` that
guarantee spans of that length. Everything is built-in functions.

Documents are winnowed once. Their fingerprints carry no words, and neither do the benchmark's: words
are fetched afterwards, for the diagonals alone. What is broadcast is measured before; where it is over
``broadcast_bytes`` the same join is left to Spark, which shuffles both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.text import as_row, from_row, lower_ascii
from vertexloom.session import cut, spread, table

WINDOW = 13
#: A document is hit beyond this share of its words: one in so many.
SHARE = 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Documents and items are matched in blocks of so many words; a place in a block fits the low bits of a packed gram.
BLOCK, ITEM_BLOCK, POSITION_BITS = 1 << 12, 256, 20
#: Fingerprints, diagonals and item words are broadcast up to so many bytes each.
BROADCAST_BYTES = 16 << 20
#: Bytes of a fingerprint's or diagonal's row in a broadcast table, and of a word, about.
ROW_BYTES, WORD_BYTES = 100, 24
#: Fingerprints are below; a row that is the document's own has a key from here on.
NO_KEY = 1 << 62


def words_of(text: Column) -> Column:
    """Lower-cased words (A-Z only); none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _over(values: Column, span: int, join) -> Column:
    """``join`` over every ``span`` values in a row, by doubling: each step joins two halves, which may overlap."""

    def halves(by: int):
        def joined(v: Column) -> Column:
            n = F.size(v) - by
            return F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, F.lit(by + 1), n), join)

        return joined

    reach = 1
    while reach < span:
        by = min(reach, span - reach)
        values = _with(values, halves(by))
        reach += by
    return values


def _fingerprint(words: Column, span: int) -> Column:
    """The smallest gram of every ``w`` in a row, each once; the gram's hash is in the high bits, its place in the low ones.

    ``words`` must have ``span`` of them at least.
    """
    k = max(1, span // 2)
    w, low = span - k + 1, (1 << POSITION_BITS) - 1
    grams = _over(F.transform(words, lambda x: F.xxhash64(x, F.lit(span))), k, lambda x, y: F.xxhash64(x, y))
    placed = F.transform(grams, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    return F.array_distinct(_over(placed, w, lambda x, y: F.least(x, y)))


def _fingerprints(rows: DataFrame, spans: list[int], only: Column | None = None) -> DataFrame:
    """A row for each kept gram of ``words``: ``key`` and ``at``, besides the other columns but ``words``; one with nulls for the row itself.

    ``only``: the span of each row, else all spans are taken of every row.
    """
    names = [c for c in rows.columns if c != "words"]
    none = F.array().cast("array<bigint>")

    def own(span: int) -> Column:
        fits = F.size("words") >= span
        return F.when(fits if only is None else fits & (only == span), _fingerprint(F.col("words"), span)).otherwise(none)

    kept = F.concat(F.array(F.lit(None).cast("bigint")), *[own(s) for s in spans])
    packed = rows.select(*names, kept.alias("f")).select(*names, F.explode("f").alias("f"))
    at = F.col("f").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")
    return packed.select(*names, F.shiftright("f", POSITION_BITS).alias("key"), at.alias("at"))


def _blocks(rows: DataFrame, block: int, window: int) -> DataFrame:
    """Rows ``(..., words)`` cut into blocks that overlap by a window but one: ``(..., block, words)``; block: its first place."""
    names = [c for c in rows.columns if c != "words"]
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(block - window + 1))
    cut_up = rows.select(*names, F.col("words").alias("all"), F.explode(starts).alias("block"))
    words = F.when(F.size("all") <= block, F.col("all")).otherwise(F.slice("all", F.col("block") + 1, F.lit(block)))
    return cut_up.select(*names, "block", words.alias("words"))


def _with_own_keys(rows: DataFrame) -> DataFrame:
    """A document's own row gets a key beyond those of fingerprints, one of its own, so that a join deals these rows over all tasks."""
    own = F.pmod(F.xxhash64("doc_id", "digest", F.monotonically_increasing_id()), F.lit(1 << 40)) + F.lit(NO_KEY)
    return rows.withColumn("key", F.coalesce("key", own))


def _small(df: DataFrame, size: int, most: int) -> DataFrame:
    return F.broadcast(df) if size <= most else df


def _runs(words: Column, item: Column, shift: Column, least: Column) -> Column:
    """Runs of equal words on a diagonal that have at least ``least``, as places in ``words``."""
    start, stop = F.greatest(F.lit(0), -shift), F.least(F.size(item), F.size(words) - shift)

    def step(acc: Column, j: Column) -> Column:
        same = F.get(words, j + shift) == F.get(item, j)
        begin = F.when(same, F.coalesce(acc["begin"], j + shift))
        ended = ~same & (j + shift - acc["begin"] >= least)
        run = F.array(F.struct(acc["begin"].alias("s"), (j + shift).alias("e")))
        return F.struct(begin.alias("begin"), F.when(ended, F.concat(acc["out"], run)).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        run = F.array(F.struct(acc["begin"].alias("s"), (stop + shift).alias("e")))
        return F.when(stop + shift - acc["begin"] >= least, F.concat(acc["out"], run)).otherwise(acc["out"])

    zero = F.struct(F.lit(None).cast("int").alias("begin"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    return F.aggregate(F.sequence(start, stop - 1), zero, step, finish)


def _covered(runs: Column) -> Column:
    """Number of places within any run; runs are sorted."""

    def step(acc: Column, r: Column) -> Column:
        more = F.greatest(F.lit(0), r["e"] - F.greatest(r["s"], acc["end"]))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["end"], r["e"]).alias("end"))

    return F.aggregate(runs, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]


def matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, digest, n_words)`` of all documents, and shared runs ``(doc_id, digest, item_id, run)``.

    docs is ``(doc_id, digest, text)``, bench ``(item_id, text)``.
    """
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 0).distinct().withColumn("least", F.least(F.size("words"), F.lit(window)))
    parts = _blocks(items, ITEM_BLOCK, window)
    parts = cut(parts.select(F.monotonically_increasing_id().alias("part"), "item_id", "least", "words"))
    spans = sorted(row["least"] for row in parts.select("least").distinct().collect())  # 1 to ``window``
    prints = _fingerprints(parts.select("part", "least", "words"), spans, F.col("least")).where("key is not null")
    prints = cut(prints.select("key", F.col("at").alias("item_at"), "part"))

    # One pass: a row of its own for each document, and one for each of its diagonals.
    split = docs.select("doc_id", "digest", words_of(F.col("text")).alias("words"))
    split = split.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), "words")
    met = _fingerprints(_blocks(split, BLOCK, window), spans)
    met = _with_own_keys(met.where(F.col("key").isNotNull() | (F.col("block") == 0)))
    met = met.join(_small(prints, ROW_BYTES * prints.count(), broadcast_bytes), "key", "left")
    itself = F.col("key") >= NO_KEY
    met = met.where(itself | F.col("part").isNotNull()).select(
        "doc_id",
        "digest",
        "block",
        "part",
        (F.col("at") - F.col("item_at")).alias("shift"),
        F.when(itself, F.col("n_words")).alias("n_words"),
        F.when(itself, F.monotonically_increasing_id()).alias("own"),
    )
    met = cut(met.distinct())
    rows = met.where("own is not null").select("doc_id", "digest", "n_words")
    diagonals = met.where("own is null").select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), F.col("block").alias("b"), "part", "shift")

    # Words of the documents that are hit, then of the items.
    size = ROW_BYTES * diagonals.count()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g"))
    hit = docs.join(_small(diagonals.select("d", "g").distinct(), size, broadcast_bytes), same, "left_semi")
    blocks = _blocks(hit.select("doc_id", "digest", words_of(F.col("text")).alias("words")), BLOCK, window)
    found = blocks.join(_small(diagonals, size, broadcast_bytes), same & (F.col("block") == F.col("b"))).drop("d", "g", "b")
    item_words = parts.select("part", "item_id", "least", F.col("words").alias("item"))
    n_words = parts.agg(F.sum(F.size("words"))).first()[0] or 0
    found = found.join(_small(item_words, WORD_BYTES * n_words, broadcast_bytes), "part")
    runs = _runs(F.col("words"), F.col("item"), F.col("shift"), F.col("least"))
    found = found.select("doc_id", "digest", "item_id", "block", F.explode(runs).alias("r"))
    run = F.struct((F.col("r.s") + F.col("block")).alias("s"), (F.col("r.e") + F.col("block")).alias("e"))
    return rows, found.select("doc_id", "digest", "item_id", run.alias("run"))


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, share: int = SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, digest)`` for every row of ``docs``.

    docs has ``doc_id`` and ``text``, bench ``item_id`` and ``text``; other columns are not read. A
    null text has no words and is not contaminated; an item without words has no window. An item_id
    that repeats counts once, a null one as the empty string. Repeated rows of docs all come back;
    ``digest`` is a hash of the text that tells rows of one doc_id apart. A very long text is taken in
    blocks; one that repeats a word of the benchmark over and over costs a diagonal of at most
    ``ITEM_BLOCK`` words for each of its places and block of an item.
    """
    rows, runs = matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest")), bench, window, broadcast_bytes)
    by_doc = (
        runs.groupBy("doc_id", "digest")
        .agg(F.array_sort(F.collect_set("run")).alias("runs"), F.array_sort(F.collect_set("item_id")).alias("items"))
        .select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), _covered(F.col("runs")).alias("hit"), "items")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest"))
    n_hit = F.coalesce(F.col("hit").cast("long"), F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(by_doc, same, "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(items, ","), "UTF-8"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        "digest",
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, whatever these are called.

    Null and empty texts have no words and stay; very long ones are taken in blocks. Repeated rows stay or
    go together, and so do those of null ids with one text; an empty table gives no rows.
    """
    out = decontaminate(docs, bench).where("contaminated").select(F.col("doc_id").alias("out"), F.col("digest").alias("out_digest")).distinct()
    named = docs.select(as_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("digest"))
    same = F.col("id").eqNullSafe(F.col("out")) & (F.col("digest") == F.col("out_digest"))
    return from_row(named.join(out, same, "left_anti"), docs)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")).drop("digest")


SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words
  from documents),
i as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words
  from benchmark),
iw as (
  select distinct item_id, least(13, len(words)) as n,
    array_to_string(words[p : p + least(13, len(words)) - 1], ' ') as gram
  from i, unnest(range(1, greatest(len(words) - 12, 1) + 1)) as u(p) where len(words) > 0),
dw as (
  select doc_id, n, p, array_to_string(words[p : p + n - 1], ' ') as gram
  from w, (select distinct n from iw), unnest(range(1, len(words) - n + 2)) as u(p)),
hits as (select doc_id, item_id, p, iw.n from dw join iw using (n, gram)),
places as (select doc_id, count(distinct q) as n_hit from hits, unnest(range(p, p + n)) as u(q) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as item_id from hits) group by doc_id)
select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from w left join places using (doc_id) left join items using (doc_id)
"""
