"""SimHash near-dedup with a segment-popcount embedding.

A fingerprint is mapped to the bit counts of its segments. Two fingerprints that differ in two bits at
most are at most two apart in the Manhattan distance of these counts, so the counts are a grid, and such
partners are in one cell, in cells one step apart, or both one step from a cell between. Every
fingerprint goes to its own cell and to those one step from it, and partners meet in one of these; where
they could meet in several, only one counts. What meets is verified bit by bit inside the join.

A cell is named by a sum that gives each segment's count a fixed random factor, so a step adds or takes
a factor whatever the cell. Cells that share a name by chance cost a verification and change nothing.
With 24 segments, a random fingerprint meets about 4 of 10^9 others, so the work is the 74 cells of each
fingerprint at every size.

Equal fingerprints are one node from the start, so copies meet in no join. A fingerprint has at most
2,080 others within two bits, which bounds the links of a group of near copies by its size, however
many they are. Groups are connected components over the links.

Two bits find copies that differ very little. Texts that share four fifths of their five-word shingles
differ in some ten bits, where a grid of bit counts keeps nearly everything. ``alike`` finds these by the
prefixes of their shingle sets in one order of all shingles: sets that are similar share a shingle of
their prefixes, so no similar pair is lost. How many shingles a set has before the shared one bounds how
large a partner can be, so most sets of a shingle have none there. Those that may are held against one of
them first. Then every two sets that links leave in different groups at some shingle meet, and parities rule out
nearly all of them inside the join. Where a shingle has too many for that, its sets are first counted anew, by
themselves: shingles of one group only come first in their order. ``keep_one`` uses both kinds of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.kernels.components import star_components
from vertexloom.llm.text import as_row, from_row
from vertexloom.session import cut, spread, table

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Segments of a fingerprint: more thin the cells out and give each fingerprint more cells.
SEGMENTS = 24
#: Near copies: words of a shingle, least similarity of the shingle sets.
WIDE, SIMILARITY = 5, 0.8
#: Frequent shingles come last in the order. They are counted by so many hashes at once; so many are listed. Neither changes a pair.
CHUNK, LISTED = 1 << 19, 1 << 16
#: 64-bit words of a set's parities, of those of sets over ``LARGE`` hashes; texts' marks; sets of a slice of a shingle's sets.
WORDS, LARGE_WORDS, LARGE = 16, 128, 1600
MARKS, SLICE = 1 << 26, 512
#: Sets of a shingle that all meet at once, which bounds what a set meets there; where more are left, they are counted anew.
FEW = 64
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint; bytes.lower() and split() touch ASCII only, as the rules ask."""
    from xxhash import xxh64_intdigest

    words = b"" if text is None else text.encode().lower()
    words = words.split()
    if not words:
        return 0
    if len(words) < shingle:
        spans = [b" ".join(words)]
    else:
        spans = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxh64_intdigest(s, seed) for s in spans), "<u8", n)
    octets = hashes.view(np.uint8).reshape(n, 8)
    if n < 256:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _fps(texts: pd.Series, shingle: int) -> np.ndarray:
    return np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` for every row; fp is the fingerprint's 64 bits as a signed long."""

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": _fps(frame["text"], shingle)}).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(compute, "doc_id long, fp long")


def _factors(segments: int) -> list[int]:
    """A fixed random factor for each segment's count, as signed longs."""
    rng = np.random.default_rng(SEED)
    return [int(x) for x in rng.integers(-(1 << 55), 1 << 55, segments)]  # sums of 64 of them do not overflow


def _cell(fp: Column, segments: int) -> Column:
    """The name of a fingerprint's cell."""
    cell = F.lit(0).cast("long")
    for i, factor in enumerate(_factors(segments)):
        low, high = 64 * i // segments, 64 * (i + 1) // segments
        part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        cell = cell + F.bit_count(part).cast("long") * F.lit(factor)
    return cell


def links(nodes: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """``(a, b)``: every pair of distinct fingerprints ``fp`` that differ in at most ``distance`` bits, once.

    A step is the number of a segment from 1 on, negative downwards, 0 for the own cell. Counts that
    differ by nothing meet in their own cell; by one step, where the lower one steps up; by a step up
    and one down, where both step up; by two steps up, between, in the order of the segments.
    """
    cells = nodes.select("fp", _cell(F.col("fp"), segments).alias("own"))
    factors = _factors(segments)

    def around(steps: list[int], fp: str, step: str) -> DataFrame:
        moves = [F.struct(F.lit(s).alias("s"), F.lit(0 if not s else factors[abs(s) - 1] * (1 if s > 0 else -1)).cast("long").alias("by")) for s in steps]
        out = cells.select("fp", "own", F.explode(F.array(*moves)).alias("m"))
        return out.select(F.col("fp").alias(fp), F.col("m.s").alias(step), (F.col("own") + F.col("m.by")).alias("cell"))

    ups = list(range(1, segments + 1))
    left, right = around([0, *ups], "a", "p"), around([0, *ups, *[-s for s in ups]], "b", "q")
    p, q = F.col("p"), F.col("q")
    once = ((p == 0) & (q == 0) & (F.col("a") < F.col("b"))) | ((p > 0) & (q == 0)) | ((p > 0) & (q > p)) | ((p > 0) & (q <= -p))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, distance)
    return left.join(right, (left["cell"] == right["cell"]) & once & near).select("a", "b")


def shingle_set(text: str | None, shingle: int = WIDE, seed: int = SEED) -> np.ndarray:
    """Distinct hashes of a text's shingles in rising order; of fewer words, of all; without words none."""
    from xxhash import xxh64_intdigest

    words = b"" if text is None else text.encode().lower()
    words = words.split()
    if not words:
        return np.zeros(0, np.uint64)
    spans = map(b" ".join, zip(*[islice(words, i, None) for i in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxh64_intdigest(s, seed) for s in spans), np.uint64))


def prefix_of(hashes: np.ndarray, often: np.ndarray, rank: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first hashes of a set, as many as two sets must share one of if they are similar.

    The order of all hashes: those not in ``often`` (sorted) by value, then the others by ``rank``. A set of n shares
    at least ``similarity`` * n with a similar one, so of n less that and one more each the least common hash is in both.
    """
    keep = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1 if len(hashes) else 0
    if not len(often):
        return hashes[:keep]
    at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
    listed = often[at] == hashes
    rare = hashes[~listed][:keep]
    return np.concatenate([rare, hashes[listed][np.argsort(rank[at[listed]])][: keep - len(rare)]])


def parities_of(hashes: np.ndarray) -> np.ndarray:
    """Of each remainder of the hashes whether an odd number of them has it, as 64-bit words. The words of two
    sets differ in at most as many bits as hashes are in one of the sets only. Many words fold to few by exclusive or."""
    bits = 64 * (LARGE_WORDS if len(hashes) > LARGE else WORDS)
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _mark(text: Column) -> Column:
    """A number from 1 to ``MARKS`` for a text."""
    return F.pmod(F.xxhash64(text), F.lit(MARKS)) + 1


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, own, n, parities, mark, often, times)``. For every row, beside the fingerprint, a number for the
    shingle set, equal for equal sets, its size and its parities, null for texts without words, and the text's mark.

    Further rows, the only ones with ``often``, hold shingles that several texts of those read together have, and how many.
    """

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            own, n, parities = [], [], []
            for found in map(shingle_set, frame["text"]):
                own.append(_number(found) if len(found) else None)
                n.append(len(found) or None)
                parities.append(parities_of(found) if len(found) else None)
                held.append(found)
                size += len(found)
                if size > CHUNK:
                    yield _shared(held)
                    held, size = [], 0
            told = {"doc_id": frame["doc_id"].astype("Int64"), "fp": _fps(frame["text"], shingle), "own": pd.Series(own, dtype="Int64")}
            told |= {"n": pd.Series(n, dtype="Int64"), "parities": parities, "mark": frame["mark"], "often": None, "times": None}
            yield pd.DataFrame(told)
        if held:
            yield _shared(held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _mark(F.col(text_col)).alias("mark"))
    kinds = "doc_id long, fp long, own long, n long, parities array<long>, mark long, often array<long>, times array<long>"
    return rows.mapInPandas(compute, kinds)


def _shared(sets: list[np.ndarray]) -> pd.DataFrame:
    """The row of ``profiles`` with the hashes that several of the sets have."""
    hashes, times = np.unique(np.concatenate(sets), return_counts=True)
    several = times > 1
    row = {"doc_id": None, "fp": None, "own": None, "n": None, "parities": None, "mark": None}
    row |= {"often": hashes[several].view(np.int64), "times": times[several]}
    return pd.DataFrame([row]).astype({c: "Int64" for c in ("doc_id", "fp", "own", "n", "mark")})


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of ``profiles``' rows the shingles most often told, sorted, and each one's rank, the rarest first."""
    told = rows.where("often is not null").select(F.explode(F.arrays_zip("often", "times")).alias("t"))
    told = told.groupBy(F.col("t.often").alias("hash")).agg(F.sum("t.times").alias("times"))
    top = told.orderBy(F.desc("times"), "hash").limit(LISTED).collect()
    hashes = np.array([r.hash for r in reversed(top)], np.int64).view(np.uint64)
    rank = np.argsort(hashes)
    return hashes[rank], rank


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(own, hashes)`` of texts with words."""
    for frame in frames:
        out, size = [], 0
        for text in frame["text"]:
            found = shingle_set(text)
            if len(found):
                out.append((_number(found), found.view(np.int64)))
                size += len(found)
            if size > 1 << 20:
                yield pd.DataFrame(out, columns=["own", "hashes"])
                out, size = [], 0
        yield pd.DataFrame(out, columns=["own", "hashes"])


def _number(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _keys(docs: DataFrame, often: np.ndarray, rank: np.ndarray, similarity: float, text_col: str) -> DataFrame:
    """``(own, n, key, most)``: a row for every hash of the prefix of each text's set, with the set's size and ``_most``."""

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(_number(s), len(s), prefix_of(s, often, rank, similarity).view(np.int64)) for s in map(shingle_set, frame["text"]) if len(s)]
            yield pd.DataFrame(out, columns=["own", "n", "keys"])

    found = docs.select(F.col(text_col).alias("text")).mapInPandas(compute, "own long, n long, keys array<long>")
    return found.select("own", "n", F.posexplode("keys").alias("at", "key")).select("own", "n", "key", _most(similarity).alias("most"))


def _most(similarity: float) -> Column:
    """Size of the largest set that may be similar to one of ``n`` hashes if the first that they share is that at ``at``.

    They share ``n - at`` at most, and must share as many as (1 + similarity) / similarity times which both sizes are.
    """
    return F.floor(F.lit((1 + similarity) / similarity) * (F.col("n") - F.col("at")) - F.col("n") + F.lit(1e-6))


def _able(rows: DataFrame, group: str) -> DataFrame:
    """Of ``(n, key, most)`` with a ``group`` those rows whose key has several groups and a set that is not too large."""
    holders = Window.partitionBy("key")
    ends = [F.min(group).over(holders).alias("low"), F.max(group).over(holders).alias("high"), F.min("n").over(holders).alias("least")]
    return rows.select("*", *ends).where("low <> high and most >= least").drop("low", "high", "least")


def _marked(docs: DataFrame, marks: DataFrame, text_col: str = "text") -> DataFrame:
    """The texts of ``docs`` whose mark is one of ``marks``. Marks are broadcast as bits, 8 MB at most whatever their number."""
    bits = marks.groupBy(F.bitmap_bucket_number("mark").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("mark")).alias("bits"))
    texts = docs.select(F.col(text_col).alias("text"), _mark(F.col(text_col)).alias("mark"))
    texts = texts.select("text", F.bitmap_bucket_number("mark").alias("bucket"), F.bitmap_bit_position("mark").alias("at"))
    octet = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    there = octet.bitwiseAND(F.expr("shiftleft(1, cast(at % 8 as int))")) != 0
    return texts.join(F.broadcast(bits), "bucket").where(there).select("text")


def _folded(name: str) -> Column:
    """A set's parities as ``WORDS`` words."""
    words = [F.lit(0).cast("long")] * WORDS
    for i in range(LARGE_WORDS):
        words[i % WORDS] = words[i % WORDS].bitwiseXOR(F.col(name)[i])
    return F.when(F.size(name) == WORDS, F.col(name)).otherwise(F.array(*words))


def _allowed(both: Column, similarity: float) -> Column:
    """In how many hashes two similar sets may differ that have ``both`` together."""
    return F.lit((1 - similarity) / (1 + similarity)) * both + F.lit(1e-6)


def _differing(one: str, other: str) -> Column:
    """In how many bits two sets' parities differ."""

    def apart(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda found, x: found + x)

    return F.when(F.size(one) == F.size(other), apart(F.col(one), F.col(other))).otherwise(apart(_folded(one), _folded(other)))


def _similar(pairs: DataFrame, owners: DataFrame, docs: DataFrame, similarity: float, text_col: str) -> DataFrame:
    """``(a, b)``: nodes of those ``pairs`` ``(x, y)`` of sets that are similar.

    Sizes and parities rule out most pairs that are not; of the others the whole sets are compared.
    """
    for end in "xy":
        own = owners.select(F.col("own").alias(end), F.struct("n", "parities", "node", "mark").alias(f"of_{end}"))
        pairs = pairs.join(own, end)
    both = F.col("of_x.n") + F.col("of_y.n")
    size_fits = F.least("of_x.n", "of_y.n") >= F.lit(similarity) * F.greatest("of_x.n", "of_y.n")
    parities_fit = _differing("of_x.parities", "of_y.parities") <= _allowed(both, similarity)
    pairs = pairs.where(size_fits).where(parities_fit)
    pairs = cut(pairs.select("x", "y", *[F.col(f"of_{end}.{c}").alias(f"{c}_{end}") for end in "xy" for c in ("node", "mark")]))
    marks = pairs.select(F.col("mark_x").alias("mark")).unionAll(pairs.select("mark_y"))
    held = _marked(docs, marks, text_col).mapInPandas(_sets, "own long, hashes array<long>").repartition("own").dropDuplicates(["own"])
    for end in "xy":
        pairs = pairs.join(held.select(F.col("own").alias(end), F.col("hashes").alias(f"h{end}")), end)
    common = F.size(F.array_intersect("hx", "hy"))
    near = pairs.where(common >= F.lit(similarity) * (F.size("hx") + F.size("hy") - common))
    return cut(near.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")))


def alike(rows: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, text_col: str = "text", linked: DataFrame | None = None) -> DataFrame:
    """``(a, b)``: nodes of ``rows`` whose sets of five-word shingles are similar, each pair once. Groups by these
    links, with ``linked`` ones where given, are those by all similar pairs.

    ``rows`` has ``node`` and what ``profiles`` tells of the texts of ``docs``.

    Similar sets share a shingle of their prefixes, and the similarity of pairs that meet so is exact, from the whole
    texts. The sets of a shingle meet the one of them that can have the largest partners for its size. Then those meet
    that links leave in different groups at a shingle, through ``_across`` where they are many: a group is joined, not
    all its pairs given.
    Several texts may carry one node; texts without words are like none.
    """
    often, rank = _frequent(rows)
    rows = rows.where("own is not null")
    told = [F.min("node").alias("node"), F.first("n").alias("n"), F.first("parities").alias("parities"), F.min("mark").alias("mark")]
    owners = cut(rows.groupBy("own").agg(*told))
    widest = F.max(F.struct((F.col("most") / F.col("n")).alias("reach"), "own", "n", "most")).over(Window.partitionBy("key"))
    shared = cut(_able(_keys(docs, often, rank, similarity, text_col), "own").withColumn("to", widest))
    met = shared.where("own <> to.own and n <= to.most and to.n <= most").select(F.least("own", "to.own").alias("x"), F.greatest("own", "to.own").alias("y"))
    near = _similar(met.distinct(), owners, docs, similarity, text_col)
    # Texts with equal sets are alike too: their nodes meet the least of them.
    same = rows.select("own", F.col("node").alias("a")).distinct().join(owners.select("own", F.col("node").alias("b")), "own")
    near = near.unionAll(same.select("a", "b")).where("a <> b")

    parts = star_components(near if linked is None else near.unionAll(linked.select("a", "b")), "a", "b")
    left = shared.where("own <> to.own").select("own", "n", "key", "most").join(owners.select("own", "mark", F.col("node").alias("id")), "own")
    left = left.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id"))
    left = cut(_able(left, "part").select("own", "mark", "part", "n", "key", "most", F.count("*").over(Window.partitionBy("key")).alias("held")))
    many = cut(left.where(F.col("held") > FEW).select("own", "mark", "part").distinct())
    few = left.where(F.col("held") <= FEW).drop("mark")
    met = _meetings(few, owners, similarity).unionAll(_across(many, owners, docs, similarity, text_col)).distinct()
    out = near.unionAll(_similar(met, owners, docs, similarity, text_col)).where("a <> b")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _across(left: DataFrame, owners: DataFrame, docs: DataFrame, similarity: float, text_col: str) -> DataFrame:
    """``(x, y)``: all pairs of the sets of ``left`` ``(own, mark, part)`` that are of different parts and may be similar.

    A shingle that one part alone has is in no pair sought, so those come first in the order, then the others by how many
    sets of ``left`` have them. Many sets have none of the others in their prefix, or too late for any partner's size.
    """
    held = _marked(docs, left.select("mark"), text_col).mapInPandas(_sets, "own long, hashes array<long>").repartition("own").dropDuplicates(["own"])
    sets = held.join(left.select("own", "part"), "own").select("own", "part", F.size("hashes").cast("long").alias("n"), F.explode("hashes").alias("key"))
    holders, own = Window.partitionBy("key"), Window.partitionBy("own")
    told = [F.count("*").over(holders).alias("times"), F.min("part").over(holders).alias("low"), F.max("part").over(holders).alias("high")]
    known = sets.select("*", *told).where("low <> high")
    at = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("times", "key")) - 1
    keys = known.withColumn("at", at).withColumn("most", _most(similarity)).where(F.col("most") >= F.lit(similarity) * F.col("n") - F.lit(1e-6))
    keys = cut(_able(keys.select("own", "part", "n", "key", "most"), "part").withColumn("held", F.count("*").over(holders)))
    return _meetings(keys, owners, similarity)


def _meetings(keys: DataFrame, owners: DataFrame, similarity: float) -> DataFrame:
    """``(x, y)``: of ``(own, part, n, key, most, held)`` each two sets of a key that are of different parts and fit each
    other's ``most``, without those that the parities of ``owners`` rule out."""
    keys = keys.withColumn("slices", F.ceil(F.col("held") / SLICE)).join(owners.select("own", _folded("parities").alias("parities")), "own")
    one, other = (keys.select("key", "slices", *[F.col(c).alias(f"{c}_{end}") for c in ("part", "n", "most", "parities")], F.col("own").alias(end)) for end in "xy")
    one = one.withColumn("slice", F.pmod("x", "slices")).drop("slices")
    other = other.withColumn("slice", F.explode(F.expr("sequence(0L, slices - 1)"))).drop("slices")
    differing = sum((F.bit_count(F.col("parities_x")[i].bitwiseXOR(F.col("parities_y")[i])) for i in range(WORDS)), F.lit(0))
    fit = F.expr("x < y and part_x <> part_y and n_x <= most_y and n_y <= most_x") & (differing <= _allowed(F.col("n_x") + F.col("n_y"), similarity))
    return one.join(other, (one["key"] == other["key"]) & (one["slice"] == other["slice"]) & fit).select("x", "y")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    similarity: float | None = None,
) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    A text without words, null included, has fingerprint zero and links like any other; one of fewer
    words than a shingle has one shingle of all its words. ``component_id`` is the smallest doc_id of
    the rows that links reach, null ids aside. Repeated rows all come back, an empty table gives no
    rows, other columns are not read. With ``similarity``, rows link too whose sets of five-word
    shingles are at least so similar.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"partners meet one step from both, so up to {DISTANCE} bits")
    if similarity is None:
        fps = cut(fingerprints(docs, id_col, text_col, shingle))
    else:
        told = cut(profiles(docs, id_col, text_col, shingle))
        fps = told.where("often is null").select("doc_id", "fp")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("lowest")))
    found = links(nodes, distance)
    if similarity is not None:
        found = cut(found)
        found = found.unionAll(alike(told.withColumnRenamed("fp", "node"), docs, similarity, text_col, found))
    parts = star_components(found, "a", "b")
    placed = nodes.join(parts, F.col("fp") == F.col("id"), "left").select(
        "fp", "lowest", F.coalesce("component", "fp").alias("part")
    )
    lowest = placed.groupBy("part").agg(F.min("lowest").alias("component_id"))
    named = cut(placed.join(lowest, "part").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, similarity: float | None = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each group, with all their columns, whatever these are called.

    Groups are those of fingerprints within two bits and of five-word shingles with at least ``similarity``
    (None: of fingerprints alone). Where ids repeat, one row of a group stays all the same: the one with the
    smallest fingerprint.
    """
    stay = near_groups(docs, similarity=similarity).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = stay.groupBy(F.col("component_id").alias("keep")).agg(F.min("fp").alias("keep_fp"))
    named = docs.select(as_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    same_id = F.col("id").eqNullSafe(F.col("keep"))
    if not docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return from_row(named.join(stay, same_id, "left_semi"), docs)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(_fps(texts, SHINGLE))

    named = named.select("row", "id", fp("text").alias("fp"))
    return from_row(named.join(stay, same_id & (F.col("fp") == F.col("keep_fp")), "left_semi").dropDuplicates(["id", "fp"]), docs)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(spread(table(spark, sf_dir, "documents")))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
