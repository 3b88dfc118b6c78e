"""Triangles of oriented arcs by parts of the vertices.

Vertices are cut by id into ranges with a bounded sum of degrees. A range's task holds the lists of its own
vertices; the list of any other vertex comes to it once, in chunks, if it names one of them, and is met with
theirs. So a list is sent once for each range that it touches, not once for each of its entries, and where ids
that are near are neighbours, once or twice in all. Chunks are streamed, and a range to which very many come is
dealt over several tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.files import stored
from vertexloom.operators.ordering import running

#: Sum of the degrees of a range, arcs of a chunk, arcs that come to one task of a range, pairs that are tested at a time.
RANGE_DEGREES, CHUNK_ARCS, DEALT_ARCS, TESTED = 1 << 24, 1 << 17, 1 << 24, 1 << 21
_CHUNKS = "part long, own boolean, arcs long, a binary, b binary"


def _squeeze(xs: np.ndarray) -> bytes:
    """Longs as compressed bytes: differences, their signs last, the bytes of one place together."""
    steps = np.diff(xs, prepend=np.int64(0))
    return zlib.compress(((steps << 1) ^ (steps >> 63)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _spread(data: bytes) -> np.ndarray:
    zs = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)
    return np.cumsum((zs >> np.uint64(1)).astype(np.int64) ^ -(zs & np.uint64(1)).astype(np.int64))


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and where each begins, with the end of all."""
    begins = np.flatnonzero(np.diff(sorted_keys, prepend=sorted_keys[:1] - 1)) if len(sorted_keys) else np.array([], np.int64)
    return sorted_keys[begins], np.append(begins, len(sorted_keys))


def _ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


def _chunk(part: int, own: bool, a: np.ndarray, b: np.ndarray) -> dict:
    return {"part": part, "own": own, "arcs": len(a), "a": _squeeze(a), "b": _squeeze(b)}


def _deal(bounds: np.ndarray):
    """Arcs sorted by ``a`` as chunks: for the range that ``a`` is in, and for each range with ends of its arcs."""

    def put(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        home, to = np.searchsorted(bounds, a, "right"), np.searchsorted(bounds, b, "right")
        _, begins = _runs(a)
        run = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        out = []
        for part in np.unique(home):
            out.append(_chunk(part, True, a[home == part], b[home == part]))
        for part in np.unique(to):
            named = np.zeros(len(begins) - 1, bool)
            named[run[to == part]] = True
            sent = named[run]
            out.append(_chunk(part, False, a[sent], b[sent]))
        return pd.DataFrame(out)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            held.append(frame.to_numpy(np.int64))
            n += len(frame)
            if n >= CHUNK_ARCS:  # whole lists; the last one may go on
                rows = np.concatenate(held)
                whole = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
                if whole:
                    yield put(rows[:whole, 0], rows[:whole, 1])
                held, n = [rows[whole:]], len(rows) - whole
        if n:
            rows = np.concatenate(held)
            yield put(rows[:, 0], rows[:, 1])

    return deal


def _met(keys: np.ndarray, begins: np.ndarray, targets: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pd.DataFrame]:
    """Triangles of the lists in a chunk ``(a, b)`` with the lists of ``keys``."""
    heads, own = _runs(a)
    run = np.repeat(np.arange(len(heads)), np.diff(own))
    place = np.minimum(np.searchsorted(keys, b), len(keys) - 1)
    arcs = np.flatnonzero(keys[place] == b)
    if not len(arcs):
        return
    # Lists of those met, without ends that no list of the chunk has.
    met, which = np.unique(place[arcs], return_inverse=True)
    names, sizes = np.unique(b), begins[met + 1] - begins[met]
    ends = targets[_ragged(begins[met], sizes)]
    code = np.minimum(np.searchsorted(names, ends), len(names) - 1)
    there = names[code] == ends
    code = code[there]
    sizes = np.bincount(np.repeat(np.arange(len(met)), sizes)[there], minlength=len(met))
    starts = np.cumsum(sizes) - sizes
    width = len(names)
    keyed = run * width + np.searchsorted(names, b)
    table = None
    if len(heads) * width <= 1 << 27:
        table = np.zeros(len(heads) * width, bool)
        table[keyed] = True
    pairs = sizes[which]
    at, total = 0, np.cumsum(pairs)
    while at < len(arcs):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + TESTED, "right")))
        some, n = arcs[at:to], pairs[at:to]
        c = code[_ragged(starts[which[at:to]], n)]
        arc = np.repeat(some, n)
        wanted = run[arc] * width + c
        if table is not None:
            hit = table[wanted]
        else:
            hit = keyed[np.minimum(np.searchsorted(keyed, wanted), len(keyed) - 1)] == wanted
        if hit.any():
            arc = arc[hit]
            yield pd.DataFrame({"a": a[arc], "b": b[arc], "c": names[c[hit]]})
        at = to


def _meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks sorted by task, a range's own first, as triangles."""
    task, held, lists = None, [], None
    for frame in frames:
        for part, turn, own, a, b in zip(*(frame[c] for c in ("part", "turn", "own", "a", "b"))):
            if task != (part, turn):
                task, held, lists = (part, turn), [], None
            if own:
                held.append((_spread(a), _spread(b)))
                continue
            if lists is None and held:
                sources, targets = (np.concatenate(x) for x in zip(*held))
                order, held = np.argsort(sources, kind="stable"), []
                lists = (*_runs(sources[order]), targets[order])
            if lists is not None:
                yield from _met(*lists, _spread(a), _spread(b))


def closed(oriented: DataFrame, degree: DataFrame) -> DataFrame:
    """``(a, b, c)`` of each triangle once, of distinct arcs ``(a, b)`` without cycles; ``degree`` is ``(id, degree)``."""
    ranges = running(degree, ["id"], "n", {"before": F.col("degree")})
    ranges = ranges.groupBy(F.floor(F.col("before") / RANGE_DEGREES).alias("r")).agg(F.min("id").alias("low")).sort("low")
    bounds = np.array([r["low"] for r in ranges.collect()][1:], np.int64)  # a row per range
    dealt = oriented.select("a", "b").repartitionByRange("a").sortWithinPartitions("a")
    chunks = stored(dealt.mapInPandas(_deal(bounds), _CHUNKS))
    come = chunks.where("not own").groupBy("part").agg(F.ceil(F.sum("arcs") / DEALT_ARCS).cast("int").alias("turns"))
    chunks = chunks.join(F.broadcast(come), "part")  # a row per range; one to which nothing comes has no triangles
    turns = F.when(F.col("own"), F.sequence(F.lit(0), F.col("turns") - 1)).otherwise(F.array(F.pmod(F.xxhash64("a", "b"), "turns").cast("int")))
    tasks = chunks.select("part", F.explode(turns).alias("turn"), "own", "a", "b")
    tasks = tasks.repartition("part", "turn").sortWithinPartitions("part", "turn", F.desc("own"))
    return tasks.mapInPandas(_meet, "a long, b long, c long")
