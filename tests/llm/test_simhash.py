"""SimHash fingerprints, links and groups against brute force."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from vertexloom.llm import op7_simhash as op7

DOCS = "doc_id long, text string, fp string, row string, keep_fp string"


def slow_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    spans = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(2)
    texts = [None, "", " \n", "One", "one TWO", "a b c", "a b c\x1cd", "É é", "x y z " * 300]
    texts += [" ".join(rng.choices(["a", "B", "ç", "dd"], k=rng.choice([3, 4, 50, 400]))) for _ in range(40)]
    for text in texts:
        assert op7.fingerprint(text) == slow_fingerprint(text)


def groups_of(fps):
    left, groups = set(range(len(fps))), []
    while left:
        group, edge = set(), [left.pop()]
        while edge:
            i = edge.pop()
            group.add(i)
            near = {j for j in left if (fps[i] ^ fps[j]).bit_count() <= 2}
            left -= near
            edge += near
        groups.append(group)
    return groups


def test_links_are_all_pairs_within_two_bits(spark):
    rng = random.Random(4)
    fps = {0, 1, 3, 7, (1 << 64) - 1, (1 << 64) - 2, 1 << 63}
    for _ in range(120):
        x = rng.getrandbits(64)
        fps |= {x} | {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(6)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    mask = (1 << 64) - 1
    expected = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 2}
    for segments in (8, 24, 32):
        found = [frozenset((r.a, r.b)) for r in op7.links(nodes, 2, segments).collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_groups_of_odd_rows(spark):
    rng = random.Random(7)
    base = " ".join(rng.choices([f"w{i}" for i in range(300)], k=600))
    texts = [None, "", " ", "One", "one", "one two", base, base.upper(), base + " tail", base + " other tail"]
    texts += [base.replace("w7 ", "w8 "), base[:-40], "huge " * 60_000, "huge  " * 60_000]
    rows = [(20 - i, t, "x", "y", None) for i, t in enumerate(texts)] + [(20, None, "x", "y", None), (None, "One", "", "", "")]
    found = op7.near_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == len(rows)
    fps = [slow_fingerprint(r[1]) if r[1] is None or len(r[1]) < 100_000 else op7.fingerprint(r[1]) for r in rows]
    lowest = {}
    for group in groups_of(fps):
        for i in group:
            lowest[rows[i][0], fps[i]] = min(rows[j][0] for j in group if rows[j][0] is not None)
    for r in found:
        assert r.component_id == lowest[r.doc_id, r.fp & ((1 << 64) - 1)]
    docs = spark.createDataFrame(rows, DOCS)
    stay = op7.keep_one(docs, None)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted({x for x in lowest.values()})


def test_empty_table_and_unique_ids(spark):
    empty = spark.createDataFrame([], DOCS)
    assert op7.near_groups(empty).count() == 0 and op7.keep_one(empty).count() == 0
    rows = [(1, "a b c", "", "", ""), (2, "A b  c", "", "", ""), (3, "d", "", "", "")]
    assert sorted(r.doc_id for r in op7.keep_one(spark.createDataFrame(rows, DOCS)).collect()) == [1, 3]


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar_pairs(sets, least=0.8):
    """All pairs at least so similar, through the shingles that they share."""
    holders, shared = {}, {}
    for i, own in enumerate(sets):
        for s in own:
            holders.setdefault(s, []).append(i)
    for own in holders.values():
        for y, j in enumerate(own):
            for i in own[:y]:
                shared[i, j] = shared.get((i, j), 0) + 1
    return {(i, j) for (i, j), n in shared.items() if n >= least * (len(sets[i]) + len(sets[j]) - n)}


def test_shingle_sets():
    assert [len(op7.shingle_set(t)) for t in (None, "", " ", "a", "a b c d", "a b c d e", "a b c d e f", "x " * 50)] == [0, 0, 0, 1, 1, 1, 2, 1]


def test_prefixes_and_parities_rule_out_no_similar_sets():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 1 << 64, 4000, np.uint64))
    often = np.sort(rng.choice(pool, 900, replace=False))
    orders = [(often[:0], np.zeros(0, np.int64)), (often, rng.permutation(len(often)))]
    similar = 0
    for n in (1, 2, 4, 5, 9, 40, 400):
        for _ in range(40):
            a = np.sort(rng.choice(pool, n, replace=False))
            b = np.unique(np.concatenate([rng.choice(a, n - rng.integers(0, n // 8 + 1), replace=False), rng.choice(pool, rng.integers(0, n // 8 + 1))]))
            common = len(np.intersect1d(a, b))
            differing = int(np.bitwise_count((op7.parities_of(a) ^ op7.parities_of(b)).view(np.uint64)).sum())
            assert differing <= len(a) + len(b) - 2 * common
            if common >= 0.8 * (len(a) + len(b) - common):
                similar += 1
                assert all(len(np.intersect1d(op7.prefix_of(a, *order), op7.prefix_of(b, *order))) for order in orders)
    assert similar > 100
    assert not len(op7.prefix_of(often[:0], *orders[1])) and set(op7.prefix_of(often, *orders[1])) <= set(often)


def test_alike_links_only_similar_texts_and_joins_whole_groups(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = []
    for size in (1, 2, 2, 3, 60):
        base = rng.choices(vocabulary, k=400)
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    half = texts[0].split()
    texts += [" ".join(half[:200] + rng.choices(vocabulary, k=200)), " ".join(half[:340]), None, "", "one two", "One  two", "one three"]
    texts += ["tick " * 40_000, "tick " * 30_000 + "end"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node long, text string")
    rows = op7.profiles(docs, "node").withColumnRenamed("doc_id", "node")
    found = [(r.a, r.b) for r in op7.alike(rows, docs).collect()]
    expected = similar_pairs([shingles(t) for t in texts])
    assert len(found) == len(set(found)) and set(found) <= expected
    assert len(found) <= 2 * 24 * len(texts)
    assert components(found, len(texts)) == components(expected, len(texts))
    assert op7.alike(rows.limit(0), docs.limit(0)).count() == 0


def test_alike_loses_no_link_among_texts_that_share_much(spark):
    # Each text is alike every other by some 0.75, so all meet at most shingles; few pairs are similar.
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]

    def changed(words, k):
        own = list(words)
        for i in rng.sample(range(len(own)), k):
            own[i] = f"x{rng.getrandbits(40)}"
        return own

    texts = []
    for i in range(200):
        texts.append(changed(base, 6))
        if i % 4 == 0:
            texts.append(changed(texts[-1], 7))
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node long, text string").repartition(8)
    rows = op7.profiles(docs, "node").withColumnRenamed("doc_id", "node")
    expected = similar_pairs([shingles(t) for t in texts])
    found = {(r.a, r.b) for r in op7.alike(rows, docs).collect()}
    assert found <= expected
    label = components(expected, len(texts))
    assert len(set(label)) > 100 and components(found, len(texts)) == label


def components(pairs, n):
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return label


def test_keep_one_catches_near_copies_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    pairs = similar_pairs([shingles(r.text) for r in rows])
    label = components(pairs, len(rows))
    copies = {rows[i].doc_id for i, own in enumerate(label) if own != i}
    stay = {r.doc_id for r in op7.keep_one(docs).select("doc_id").collect()}
    by_fingerprint = {r.doc_id for r in op7.keep_one(docs, None).select("doc_id").collect()}
    assert stay <= by_fingerprint
    assert len(copies) > 50 and len(copies - stay) >= 0.95 * len(copies)
    gone = {r.doc_id for r in rows} - stay - copies
    assert gone <= {r.doc_id for r in rows} - by_fingerprint
    print("near copies", len(copies), "caught", len(copies - stay), "by fingerprints alone", len(copies - by_fingerprint))


def test_whole_table_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in op7.op7_simhash(spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet").orderBy("doc_id").select("doc_id", F.col("text")).collect()
    fps = [slow_fingerprint(r.text) for r in docs]
    for group in groups_of(fps):
        lowest = min(docs[i].doc_id for i in group)
        for i in group:
            assert (found[docs[i].doc_id].component_id, found[docs[i].doc_id].fingerprint) == (lowest, f"{fps[i]:016x}")


def test_parities_of_large_and_small_sets(spark):
    rng = np.random.default_rng(9)
    pool = np.unique(rng.integers(0, 1 << 64, 6000, np.uint64))
    sets = [pool[:1500], pool[:1600], pool[:1700], pool[:5000], pool[100:1800]]
    rows = [(i, j, op7.parities_of(a).tolist(), op7.parities_of(b).tolist()) for i, a in enumerate(sets) for j, b in enumerate(sets)]
    assert {len(r[2]) for r in rows} == {op7.WORDS, op7.LARGE_WORDS}
    found = spark.createDataFrame(rows, "i int, j int, a array<long>, b array<long>").select("i", "j", op7._differing("a", "b").alias("n"))
    for r in found.collect():
        assert (r.n == 0) == (r.i == r.j) and r.n <= len(np.setxor1d(sets[r.i], sets[r.j]))


def test_alike_compares_few_pairs_of_a_large_group(spark, monkeypatch):
    # Copies of one text with up to five words changed: all meet, a quarter of the pairs is similar, many texts have no similar one.
    rng = random.Random(13)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(400):
        own = list(base)
        for at in rng.sample(range(len(own)), 1 + i % 5):
            own[at] = f"x{rng.getrandbits(40)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node long, text string").repartition(8)
    rows = op7.profiles(docs, "node").withColumnRenamed("doc_id", "node")
    compared, similar = [], op7._similar

    def counted(pairs, *more):
        compared.append(pairs.count())
        return similar(pairs, *more)

    monkeypatch.setattr(op7, "_similar", counted)
    found = {(r.a, r.b) for r in op7.alike(rows, docs).collect()}
    expected = similar_pairs([shingles(t) for t in texts])
    assert found <= expected
    label = components(expected, len(texts))
    assert len(set(label)) > 100 and components(found, len(texts)) == label
    print("pairs compared", compared, "of", len(texts) * (len(texts) - 1) // 2, "similar", len(expected))
    assert sum(compared) <= 10 * len(texts)


def test_alike_counts_no_sets_anew_where_few_share_a_shingle(spark, monkeypatch):
    # Twelve texts begin with each passage and end with different, more frequent ones: they meet and are not alike.
    rng = random.Random(17)
    new = lambda n: [f"x{rng.getrandbits(40)}" for _ in range(n)]
    begins, ends = [new(60) for _ in range(30)], [new(80) for _ in range(12)]
    texts = [a + b for a in begins for b in ends]
    texts += [t[:-2] + new(2) for t in texts[::40]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "node long, text string").repartition(1)
    rows = op7.profiles(docs, "node").withColumnRenamed("doc_id", "node")
    anew, met, across, similar = [], [], op7._across, op7._similar

    def counted(left, *more):
        anew.append(left.count())
        return across(left, *more)

    def compared(pairs, *more):
        met.append(pairs.count())
        return similar(pairs, *more)

    monkeypatch.setattr(op7, "_across", counted)
    monkeypatch.setattr(op7, "_similar", compared)
    found = {(r.a, r.b) for r in op7.alike(rows, docs).collect()}
    expected = similar_pairs([shingles(" ".join(t)) for t in texts])
    assert found <= expected and components(found, len(texts)) == components(expected, len(texts))
    print("sets counted anew", anew, "pairs compared", met, "similar", len(expected))
    assert len(expected) >= 9 and anew == [0] and sum(met) <= 3 * len(texts)
