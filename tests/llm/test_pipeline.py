"""The pipeline against the stages' rules, computed plainly on whole tables."""

import inspect

import pytest

pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

from tests.llm.test_decontaminate import brute as contaminated  # noqa: E402
from tests.llm.test_simhash import components, shingles, similar_pairs, slow_fingerprint  # noqa: E402
from tests.llm.test_tokens import BYTES, check_bins  # noqa: E402
from vertexloom.llm import op6_quality, op10_packing  # noqa: E402

PATH = "/root/testdata/sf0.001"


def test_stages_have_the_agreed_form():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]


def test_result_is_that_of_the_rules(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    labels = spark.read.parquet(f"{PATH}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    model = op6_quality.train(docs, labels)
    scores = model.scores([t for _, t in rows])
    good = [r for r, s in zip(rows, scores) if s >= 0.3]
    last = {}
    for doc_id, text in good:
        key = text.encode().lower()
        last[key] = max(last.get(key, (doc_id, text)), (doc_id, text))
    single = sorted(last.values())
    fps = [slow_fingerprint(t) for _, t in single]
    near = {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 2}
    label = components(near | similar_pairs([shingles(t) for _, t in single]), len(single))
    apart = [single[i] for i, lowest in enumerate(label) if lowest == i]
    clean = {d: t for d, t in apart if not contaminated(t, bench)[-1]}
    assert len(rows) > len(good) > len(single) >= len(apart) > len(clean) > 0

    found = corpus_pipeline.run(spark, PATH).collect()
    assert {r.doc_id for r in found} == set(clean)
    check_bins(found, 2048)
    ids = dict(zip(clean, op10_packing.encoder(BYTES).library(list(clean.values()))))
    for doc_id, own in ids.items():
        assert sum(r.length for r in found if r.doc_id == doc_id) == len(own) // 4 + 1


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), PATH)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns


def test_odd_rows_and_clashing_names_go_through_all_stages(spark):
    names = "row id sha keep keep_sha keep_fp fp score digest out out_digest component_id shard part _doc _keep"
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names.split())
    prose = "The old house by the river was sold in spring. Nobody knew who had bought it, and few people asked. "
    texts = [(1, prose), (1, prose), (1, prose + "It rained."), (2, None), (None, prose * 2), (None, None), (3, prose.upper()), (4, prose * 300), (5, "")]
    docs = spark.createDataFrame([(i, t, *["x"] * len(names.split())) for i, t in texts], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, PATH)
        if name != "packing":
            assert out.schema == docs.schema
        rows = out.collect()
        if name == "exact_dedup":
            assert sorted(str((r.doc_id, len(r.text or ""))) for r in rows) == sorted(
                str(x) for x in [(3, len(prose)), (1, len(prose) + 10), (5, 0), (None, 2 * len(prose)), (4, 300 * len(prose))]
            )
        if name == "decontamination":
            assert len(rows) == len(texts)
        if name == "packing":
            check_bins(rows, 2048)
            assert {r.doc_id for r in rows} == {i for i, _ in texts}
        else:
            docs, texts = spark.createDataFrame(rows, schema), [(r.doc_id, r.text) for r in rows]
