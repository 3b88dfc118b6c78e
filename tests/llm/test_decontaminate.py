"""Decontamination against a brute-force search of every window."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from vertexloom.llm import op9_decontaminate as op9

DOCS = "doc_id long, text string, row string, digest string, out string"
BENCH = "item_id long, text string, key string"


def words(text):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]


def brute(text, bench):
    own, hit, items = words(text), set(), set()
    for item_id, other in bench:
        other = words(other)
        n = min(13, len(other))
        grams = {tuple(other[i : i + n]) for i in range(len(other) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                items.add("" if item_id is None else str(item_id))
    joined = ",".join(sorted(items)).encode()
    return len(own), len(hit), len(items), hashlib.sha256(joined).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)


def check(spark, docs, bench, **more):
    frame = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], DOCS)
    found = op9.decontaminate(frame, spark.createDataFrame([(i, t, "k") for i, t in bench], BENCH), **more).collect()
    assert len(found) == len(docs)
    expected = sorted(((i, *brute(t, bench)) for i, t in docs), key=str)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found), key=str)
    assert got == expected
    return frame


def random_case(seed, vocabulary, n_docs):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    bench = [(i, text(rng.choice([0, 1, 2, 5, 12, 13, 14, 40]))) for i in range(25)]
    docs = []
    for i in range(n_docs):
        body = text(rng.randrange(80))
        for _ in range(rng.randrange(4)):
            _, other = rng.choice(bench)
            own = other.split()
            a = rng.randrange(len(own) + 1)
            body += "! " + " ".join(own[a : a + rng.choice([5, 12, 13, 30])]).upper() + ".. " + text(rng.randrange(9))
        docs.append((i, body))
    return docs, bench


def test_random_texts(spark):
    check(spark, *random_case(1, [f"w{i}" for i in range(500)], 150))
    check(spark, *random_case(2, ["a", "b", "é"], 60))


def test_nothing_broadcast(spark):
    check(spark, *random_case(3, [f"w{i}" for i in range(50)], 60), broadcast_bytes=0)


def test_a_word_repeated_over_and_over(spark):
    check(spark, [(1, "x " * 5_000), (2, "x " * 14 + "y " * 9_000 + "x " * 12), (3, "x")], [(1, "x " * 300), (2, "y y")])
    frame = spark.createDataFrame([(1, "x " * 200_000, "", "", "")], DOCS)
    found = op9.decontaminate(frame, spark.createDataFrame([(1, "x " * 60, "")], BENCH)).first()
    assert (found.n_words, found.n_hit, found.n_items) == (200_000, 200_000, 1)


def test_blocks_lose_no_window(spark, monkeypatch):
    monkeypatch.setattr(op9, "BLOCK", 40)
    monkeypatch.setattr(op9, "ITEM_BLOCK", 17)
    check(spark, *random_case(4, [f"w{i}" for i in range(40)], 60))


def test_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(20))
    bench = [(1, item), (1, item), (None, item), (2, None), (3, ""), (4, "..."), (10, "w1 w2 w3")]
    docs = [(1, None), (1, None), (2, ""), (3, item), (3, item), (3, item + " x"), (None, item.upper()), (4, "... --- é"),
            (5, (item + " ") * 3000), (6, "Ä " + item), (7, "x " * 70_000 + item)]
    frame = check(spark, docs, bench)
    stay = op9.drop_contaminated(frame, spark.createDataFrame([(i, t, "k") for i, t in bench], BENCH))
    assert stay.columns == frame.columns
    assert sorted(r.doc_id for r in stay.collect()) == [1, 1, 2, 4, 7]


def test_a_very_long_item(spark):
    rng = random.Random(8)
    item = " ".join(rng.choices([f"w{i}" for i in range(5000)], k=30_000)).split()
    docs = [(i, "x y " * 20 + " ".join(item[a : a + n])) for i, (a, n) in enumerate([(0, 20), (250, 13), (236, 30), (29_987, 13), (100, 12)])]
    check(spark, docs, [(1, " ".join(item)), (2, "w1 w2")])


def test_empty_tables(spark):
    check(spark, [], [(1, "a b c")])
    check(spark, [(1, "a b c")], [])
    check(spark, [(1, "a b c")], [(1, None)])


def test_rows_of_documents_are_dealt_over_all_tasks(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("digest"), F.lit(None).cast("long").alias("key"))
    keys = op9._with_own_keys(rows)
    assert keys.where(F.col("key") < op9.NO_KEY).count() == 0
    sizes = [r["count"] for r in keys.repartition(8, "key").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 800
