"""Periodic runs against a brute force over all places and periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from vertexloom.llm import op11_periodic_runs as op11

DOCS = "doc_id long, text string, runs string, collapsed string, w string, n long"


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def slow_runs(w, min_length=24, exponent=3):
    """Every maximal stretch of every period, unless a smaller one has the same."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, exponent * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def slow_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def detected(words, min_length, exponent):
    found, collapsed = op11._group([[str(x).encode() for x in words]], min_length, exponent)
    return sorted(found[0]), collapsed[0].decode()


def test_all_short_words_over_two_letters():
    for n in range(0, 13):
        for x in range(1 << n):
            w = [str(x >> i & 1) for i in range(n)]
            expected = slow_runs(w, 3, 3)
            assert detected(w, 3, 3) == (sorted(expected), slow_collapsed(w, expected)), w


def test_random_repeats():
    rng = random.Random(11)
    for _ in range(300):
        w = []
        while len(w) < rng.choice([30, 120, 400]):
            part = rng.choices("abc" if rng.random() < 0.5 else "abcdefghijkl", k=rng.randint(1, 30))
            w += (part * rng.randint(1, 9))[: rng.randint(1, 120)]
        for least, exponent in ((24, 3), (7, 3), (12, 4)):
            expected = slow_runs(w, least, exponent)
            assert detected(w, least, exponent) == (expected, slow_collapsed(w, expected))


def test_level_and_sets():
    assert op11.least_level(24, 3) == 16
    rng, places, seen = random.Random(3), op11.Places(5000), [5000]
    for x in rng.sample([i for i in range(10_000) if i != 5000], 6000):
        found = places.add(x)
        if len(seen) < 300:
            assert found == (max((y for y in seen if y < x), default=-1), min((y for y in seen if y > x), default=-1))
        seen.append(x)
    assert list(places) == sorted(seen) and places.size == len(seen) and len(places.blocks) > 3


def test_windows_across_texts_do_not_count():
    words = np.array(list(range(40)) * 2)
    assert op11.repeating(words, np.repeat([0, 1], 40), 16).tolist() == []
    assert op11.repeating(words, np.zeros(80, int), 16).tolist() == [0]


def test_odd_rows(spark):
    base = "one two three four five six seven eight"
    texts = [None, "", " \n\t", "one", base, f"{base}\n" * 3, f"{base} " * 2, "x " * 23, "x " * 24, "é b c\x1cd " * 12, "huge " * 150_000]
    rows = [(i, t, "r", None, "w", 1) for i, t in enumerate(texts)] + [(5, texts[5], "", "", "", None), (None, texts[8], "", "", "", None)]
    found = op11.find_runs(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    for i, text in enumerate(texts[:-1]):
        w = words_of(text)
        expected = slow_runs(w)
        assert (by[i].n_words, [tuple(r) for r in by[i].runs], by[i].collapsed) == (len(w), expected, slow_collapsed(w, expected))
    assert [tuple(r) for r in by[10].runs] == [(0, 150_000, 1)] and by[10].collapsed == "huge"
    assert by[5].collapsed == base and [tuple(r) for r in by[None].runs] == [(0, 24, 1)]
    assert op11.find_runs(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        op11.find_runs(spark.createDataFrame(rows, DOCS), min_exponent=2)


def planted(doc_id, text):
    w, h = words_of(text), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_whole_table_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in op11.op11_periodic_runs(spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs) and any(r.n_runs for r in found.values())
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for d in docs:
        w = planted(d.doc_id, d.text)
        runs = slow_runs(w) if len(w) < 1500 or d.doc_id % 5 == 0 else None
        r = found[d.doc_id]
        if runs is None:
            continue
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if runs else None
        expected = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *expected)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r.collapsed_sha256 == sha(slow_collapsed(w, runs))
