"""Periodic runs of words by uniting suffix classes in the order of falling LCP.

A run is a stretch of words that repeats itself with a smallest period q, at least three times over.
Its words from the start on and those from q on agree for all but q of its length, so these two
suffixes share that many words. Suffixes are sorted, neighbours are edges weighted by their longest
common prefix, and edges are taken from the longest down (Kruskal's order). Union-find keeps each class
with its places in order. When two classes unite at a level, places that become neighbours at a distance
within the level are a seed: the words there repeat at that distance. A place between a run's start and
the one q later would repeat at a smaller distance too and contradict q, so every run is seeded.

A run's own two suffixes share at least ``least_level`` words; no edge below can seed one. So texts in
which no window of so many words occurs twice have no runs, which equal hashes of all windows tell: equal
windows always have equal hashes, and equal hashes of other windows only cost the sort.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.session import spread, table

MIN_LENGTH, MIN_EXPONENT = 24, 3
#: Words that are handled together, about; a longer text is handled by itself. Bounds memory, not results.
WORDS = 200_000
#: Places in one block of an ordered set.
BLOCK = 1024
RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN_FIELDS = [pa.field(name, pa.int64()) for name in ("start", "length", "period")]


def least_level(min_length: int, min_exponent: int) -> int:
    """Words that a run's start and its place one period later share at least."""
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))


class Places:
    """An ordered set of places in blocks, so that an insertion moves few of them."""

    def __init__(self, place: int):
        self.blocks, self.ends, self.size = [[place]], [place], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, place: int) -> tuple[int, int]:
        """Insert a new place; returns its neighbours below and above, -1 for none."""
        blocks, ends = self.blocks, self.ends
        b = min(bisect_left(ends, place), len(ends) - 1)
        block = blocks[b]
        i = bisect_left(block, place)
        below = block[i - 1] if i else blocks[b - 1][-1] if b else -1
        above = block[i] if i < len(block) else -1
        block.insert(i, place)
        self.size += 1
        ends[b] = block[-1]
        if len(block) > BLOCK:
            half = len(block) // 2
            blocks[b : b + 1] = [block[:half], block[half:]]
            ends[b : b + 1] = [block[half - 1], block[-1]]
        return below, above


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def repeating(words: np.ndarray, owner: np.ndarray, level: int) -> np.ndarray:
    """Owners in which a window of ``level`` words, or some more texts, occurs twice."""
    h = _mixed(words.astype(np.uint64) ^ _mixed(owner.astype(np.uint64) + np.uint64(1)))
    k = 1
    while 2 * k <= level:
        h = _mixed(h[:-k] * np.uint64(3) + h[k:])
        k *= 2
    whole = np.flatnonzero(owner[: len(h)] == owner[k - 1 : k - 1 + len(h)])
    order = whole[np.argsort(h[whole], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    return np.unique(owner[order[1:][same]])


def sorted_suffixes(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """All places in the order of their suffixes, and ranks by prefixes of 1, 2, 4, ... words.

    Suffixes of other owners never are equal. Each owner ends with a word that occurs once. By doubling:
    only places that share their rank with others are sorted again.
    """
    n = len(words)
    order = np.lexsort((words, owner))
    new = np.ones(n, bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    starts = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    shared = np.repeat(np.diff(np.append(starts, n)) > 1, np.diff(np.append(starts, n)))
    active, levels, k = order[shared], [rank.astype(np.int32)], 1
    while len(active):
        key = rank[active] * n + rank[active + k]
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = rank[active]
        new = np.append(True, key[1:] != key[:-1])
        group = np.append(True, old[1:] != old[:-1])
        at = np.arange(len(active))
        starts = np.maximum.accumulate(np.where(new, at, 0))
        groups = np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[active] = old + starts - groups
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(active)))
        active = active[np.repeat(sizes > 1, sizes)]
        levels.append(rank.astype(np.int32))
        k *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, levels


def edges(words: np.ndarray, owner: np.ndarray, level: int) -> tuple[list[int], list[int], list[int]]:
    """Neighbours in the order of suffixes that share ``level`` words or more, longest first: both places and the LCP."""
    order, ranks = sorted_suffixes(words, owner)
    a, b = order[:-1], order[1:]
    shared = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = ranks[k][a + shared] == ranks[k][b + shared]
        shared[same] += 1 << k
    keep = np.flatnonzero(shared >= level)
    keep = keep[np.argsort(-shared[keep], kind="stable")]
    return a[keep].tolist(), b[keep].tolist(), shared[keep].tolist()


def seeds(words: np.ndarray, owner: np.ndarray, min_length: int, min_exponent: int) -> set[tuple[int, int]]:
    """``(distance, place)`` where neighbours in a united class repeat for long enough."""
    parent: dict[int, int] = {}
    classes: dict[int, Places] = {}
    found: set[tuple[int, int]] = set()

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for a, b, level in zip(*edges(words, owner, least_level(min_length, min_exponent))):
        a, b = root(a), root(b)
        into, small = classes.get(a) or Places(a), classes.pop(b, None) or Places(b)
        if into.size < small.size:
            a, b, into, small = b, a, small, into
        classes.pop(b, None)
        parent[b], classes[a] = a, into
        for x in small:
            below, above = into.add(x)
            if below >= 0 and level + x - below >= min_length and level >= (min_exponent - 1) * (x - below):
                found.add((x - below, below))
            if above >= 0 and level + above - x >= min_length and level >= (min_exponent - 1) * (above - x):
                found.add((above - x, x))
    return found


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """How many first values agree."""
    at, step, n = 0, 64, min(len(x), len(y))
    while at < n:
        end = min(n, at + step)
        differ = np.flatnonzero(x[at:end] != y[at:end])
        if len(differ):
            return at + int(differ[0])
        at, step = end, step * 2
    return n


def runs_of(words: np.ndarray, owner: np.ndarray, min_length: int, min_exponent: int) -> dict[int, list[tuple[int, int, int]]]:
    """``(start, length, period)`` of every run, by owner. Starts are places in ``words``.

    Each owner's words end with one that occurs once, and another such one is before them all.
    """
    periods: dict[tuple[int, int], int] = {}
    last, end = 0, 0
    for distance, place in sorted(seeds(words, owner, min_length, min_exponent)):
        if distance == last and place + 2 * distance <= end:
            continue  # within the run that was found last
        start = place - _agree(words[place - 1 :: -1], words[place + distance - 1 :: -1]) if place else 0
        last, end = distance, place + distance + _agree(words[place:], words[place + distance :])
        periods[start, end] = min(distance, periods.get((start, end), distance))
    found: dict[int, list[tuple[int, int, int]]] = {}
    for (start, end), period in sorted(periods.items(), key=lambda x: (x[0][0], x[1])):
        if end - start >= max(min_length, min_exponent * period):
            found.setdefault(int(owner[start]), []).append((start, end - start, period))
    return found


def _group(texts: list[list[bytes]], min_length: int, min_exponent: int) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Runs and collapsed texts of texts that are given as words."""
    ids: dict[bytes, int] = {}
    level = least_level(min_length, min_exponent)
    parts = [np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)) for words in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    owner = np.repeat(np.arange(len(parts)), sizes)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    again = repeating(np.concatenate(parts), owner, level).tolist() if len(owner) > level else []
    if again:
        # A word of its own before all, and one behind each text, which end the comparisons.
        own, at = [np.array([-1])], 1
        starts, owners = {}, [np.array([-1])]
        for i in again:
            starts[i] = at
            own += [parts[i], np.array([-2 - i])]
            owners.append(np.full(len(parts[i]) + 1, i))
            at += len(parts[i]) + 1
        for i, found in runs_of(np.concatenate(own), np.concatenate(owners), min_length, min_exponent).items():
            runs[i] = [(s - starts[i], n, q) for s, n, q in found]
    collapsed = []
    for words, found in zip(texts, runs):
        if found:
            steps = np.zeros(len(words) + 1, np.int64)
            for start, length, period in found:
                steps[start + period] += 1
                steps[start + length] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
        collapsed.append(b" ".join(words))
    return runs, collapsed


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for every row of ``docs``.

    ``runs`` has the maximal stretches of ``min_length`` words or more that repeat with a smallest
    period ``min_exponent`` times or more (three at least), as start, length and period in words, by
    start, then period. ``collapsed`` is the text without the words that a run repeats: of each run its
    first period stays, and what another run drops of that goes. Words are what white space (ASCII)
    parts. Null texts count as empty: no words, no runs, an empty result. Repeated rows and null ids
    stay, an empty table gives no rows, other columns are not read. A very long text is one task's work,
    some 200 bytes of memory a word.
    """
    if min_exponent < 3 or min_length < 2:
        raise ValueError("runs repeat three times at least and have two words or more")

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, count, start = [], 0, 0
            for i, text in enumerate(batch.column("text")):
                held.append(text.as_py().encode().split())
                count += len(held[-1])
                if count >= WORDS or i + 1 == batch.num_rows:
                    yield _batch(batch.column("doc_id").slice(start, len(held)), held)
                    held, count, start = [], 0, i + 1

    def _batch(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs, collapsed = _group(texts, min_length, min_exponent)
        flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
        offsets = np.append(0, np.cumsum([len(r) for r in runs])).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=_RUN_FIELDS)
        columns = [ids, pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(offsets, structs), pa.array([c.decode() for c in collapsed], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(detect, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period; of ties the first."""
    more = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(r, best), r).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: of documents whose id hashes to a multiple of ten the words from a place on repeat a first stretch of them.

    The place, and the stretch's length, follow from the hash (the query's contract). Other texts stay.
    """
    words = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.crc32(F.col("doc_id").cast("long").cast("string")).alias("h"),
    )
    words = words.withColumn("w", F.when(F.col("h") % 10 == 0, F.array_remove(F.split("text", r"[ \t\n\x0B\f\r]+"), "")))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    placed = words.withColumns({"n": n, "a": F.when(n > 0, a), "p": F.when(n > 0, p)})
    n, a, p = F.col("n"), F.col("a"), F.col("p")
    block = F.slice("w", a + 1, p)
    rest = F.slice("w", a + 1, ((n - a) % p).cast("int"))
    repeated = F.concat(F.slice("w", F.lit(1), a), F.flatten(F.array_repeat(block, F.floor((n - a) / p).cast("int"))), rest)
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(spread(table(spark, sf_dir, "documents"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n")))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
