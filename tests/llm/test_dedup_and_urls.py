"""Exact dedup and the URL filter on odd rows, and the chunker."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vertexloom.llm import op2_exact_dedup as op2
from vertexloom.llm import op4_url_filter as op4
from vertexloom.llm.text import lower_ascii

DOCS = "doc_id long, text string, recipe string, keep_id string, n_chars long"


def test_lower_ascii(spark):
    texts = ["ABC xyz ÀÉß", "ÄB\nC", "İıKÅ", "plain", "", "ⅣⒶ𐐀 Dž", None, "ᾼΣς"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", lower_ascii(F.col("t")).alias("low"))
    for t, low in rows.collect():
        assert low == (None if t is None else t.encode().lower().decode())


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 400), st.integers(1, 8))
def test_chunks_cover_and_keep_bounds(seed, repeat, bits):
    data = seed * repeat
    ends = op2.chunk_ends(data, 32, 256, bits)
    assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert all(n <= 256 for n in sizes) and all(n >= 32 for n in sizes[:-1])


def test_shared_passages_share_chunks():
    rng = random.Random(1)
    common = rng.randbytes(60_000)

    def names(data):
        ends = op2.chunk_ends(data)
        return {hashlib.sha256(data[a:b]).digest() for a, b in zip([0, *ends], ends)}

    assert len(names(rng.randbytes(3000) + common) & names(rng.randbytes(7001) + common)) >= 8


def test_groups_of_odd_rows(spark):
    long = "Lorem Ipsum " * 20_000
    rows = [
        (1, "Same", "x", "y", 1), (5, "sAME", "x", "y", 1), (2, "SAME", "x", "y", 1), (2, "SAME", "x", "y", 1),
        (3, None, "x", None, None), (4, "", None, None, None), (6, long, "", "", 0), (7, long.upper(), "", "", 0),
        (8, long + "!", "", "", 0), (9, "ÀB", "", "", 0), (10, "àb", "", "", 0), (None, "same", "", "", 0),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    found = op2.exact_groups(docs).collect()
    brute = {}
    for doc_id, text, *_ in rows:
        brute.setdefault((text or "").encode().lower(), []).append(doc_id)
    assert len(found) == len(rows)
    for key, ids in brute.items():
        sha = hashlib.sha256(key).hexdigest()
        own = [r for r in found if r.text_sha256 == sha]
        assert sorted(str(r.doc_id) for r in own) == sorted(map(str, ids))
        keep = max(x for x in ids if x is not None)
        assert {(r.keep_id, r.group_size) for r in own} == {(keep, len(ids))}
        assert sum(r.kept for r in own) == 1 and all(r.doc_id == keep for r in own if r.kept)
    stay = op2.drop_copies(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(max(x for x in v if x is not None) for v in brute.values())
    assert op2.exact_groups(spark.createDataFrame([], DOCS)).count() == 0
    assert op2.drop_copies(spark.createDataFrame([], DOCS)).count() == 0


def test_chunks_used_more_than_once_are_verified(spark):
    rng = random.Random(3)
    common = "".join(rng.choices("abcdefgh ", k=30_000))
    texts = [common, common + "x", "y" + common, common, "alone " * 900, None, ""]
    texts += ["".join(rng.choices("abcdefgh ", k=9000)) for _ in range(5)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    uses = {}
    for t in texts:
        data, start = (t or "").encode(), 0
        for end in op2.chunk_ends(data):
            uses.setdefault(data[start:end], []).append(t)
            start = end
    names = {hashlib.sha256(body).digest(): (len(own), len(body)) for body, own in uses.items()}
    recipes = docs.select(F.col("doc_id"), F.col("text")).mapInPandas(op2._recipes, "doc_id long, text_sha256 string, recipe binary")
    counted = op2.chunk_uses(recipes.withColumn("copies", F.lit(1)))
    assert {bytes(r.chunk): r.n_uses for r in counted.collect()} == {k: n for k, (n, _) in names.items()}
    store = op2.chunk_store(docs, counted.where("n_uses > 1")).collect()
    assert {bytes(r.chunk): r.n_bytes for r in store} == {k: size for k, (n, size) in names.items() if n > 1}
    assert store and all(r.verified for r in store)


def test_two_bodies_of_one_identifier_stop_the_job(spark, monkeypatch):
    class Weak:
        def __init__(self, body):
            self.body = body

        def digest(self):
            return (b"short" if len(self.body) < 1000 else b"long").ljust(32)

        def hexdigest(self):
            return hashlib.sha1(self.body).hexdigest()

    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z" * 5000)], "doc_id long, text string")
    monkeypatch.setattr(op2, "_recipes", _weakly(op2._recipes, Weak))
    monkeypatch.setattr(op2, "_chunks", _weakly(op2._chunks, Weak))
    with pytest.raises(RuntimeError, match="same SHA-256"):
        op2.exact_groups(docs)


def _weakly(function, weak):
    """``function`` with another digest, also where it runs in a worker."""

    def run(frames):
        function.__globals__["hashlib"] = type("Hashes", (), {"sha256": weak})
        try:
            yield from function(frames)
        finally:
            function.__globals__["hashlib"] = hashlib

    return run


def test_kept_rows_where_an_id_repeats_with_other_texts(spark):
    rows = [(1, "a", "", "", 0), (1, "b", "", "", 0), (1, "B", "", "", 0), (0, "b", "", "", 0)]
    stay = op2.drop_copies(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.text.lower()) for r in stay) == [(1, "a"), (1, "b")]


PAGES = "page_id long, url string, html string, host string, listed string"
URLS = [
    (None, "", "", None, "allow"),
    ("no scheme/en/", "", "", None, "allow"),
    ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
    ("http://example.net", "example.net", "", None, "allow"),
    ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
    ("https://x.example.com/de/a", "x.example.com", "/de/a", "example.com/de/", "block"),
    ("https://casino-win.example.org/fr/", "casino-win.example.org", "/fr/", "org/fr/", "allow"),
    ("https://www.casino-win.example.org/en/", "www.casino-win.example.org", "/en/", None, "block"),
    ("https://not-casino-win.example.org/en/", "not-casino-win.example.org", "/en/", None, "allow"),
    ("x://y://z/p#q", "y:", "//z/p", None, "allow"),
    ("http://?q", "", "", None, "allow"),
    ("http://h.org#f/fr/", "h.org", "", None, "allow"),
]


def check_urls(spark, **more):
    rows = [(i, u[0], "h", "x", None) for i, u in enumerate(URLS)] * 2
    found = op4.filter_urls(spark.createDataFrame(rows, PAGES), **more).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:]


def test_odd_urls(spark):
    check_urls(spark)
    assert op4.filter_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_filters_that_are_not_broadcast(spark):
    check_urls(spark, broadcast_bytes=0)
    check_urls(spark, broadcast_bytes=0, filter_keys=1)


def test_a_list_that_is_a_table(spark):
    hosts = [f"h{i}.example.org" for i in range(300)]
    bad = [h for i, h in enumerate(hosts) if i * 7919 % 11 < 3] + ["elsewhere.org", None]
    rows = [(i, f"http://{h}/x", "", "", "") for i, h in enumerate(hosts)]
    listed = spark.createDataFrame([(h, "note") for h in bad + bad], "name string, host string")
    for filter_keys in (1 << 15, 20):
        found = op4.filter_urls(spark.createDataFrame(rows, PAGES), listed, filter_keys=filter_keys).collect()
        assert len(found) == 300 and all((r.verdict == "block") == r.listed == (r.host in bad) for r in found)
    nothing = op4.filter_urls(spark.createDataFrame(rows, PAGES), listed.limit(0)).collect()
    assert {r.verdict for r in nothing} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("host"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed")).cache()
    for filter_keys in (1 << 15, 300):
        cascade = op4.build_cascade(keys, filter_keys)
        assert len(cascade.hashes) > 2 and cascade.filters.count() == cascade.parts == max(1, -(-2858 // filter_keys))
        told = op4.with_listed(keys.withColumnRenamed("listed", "wanted"), "key", cascade)
        assert told.count() == 20_000 and told.where("listed <> wanted").count() == 0
        words = cascade.filters.select(sum(F.coalesce(F.size(c), F.lit(0)) for c in cascade.filters.columns[1:]).alias("n"))
        assert 8 * words.agg(F.sum("n")).first()[0] < 20_000 * 2 / 8
