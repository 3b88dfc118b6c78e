"""Loaders, numberings and streams take all pairs of parts."""

import pytest

from vertexloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
VERTICES, EDGES = 200, 8_899  # FIXTURES.md, part_cooccur
ROWS = {
    "dump_graph": VERTICES, "whole_dense_ids": VERTICES, "whole_csr_offsets": VERTICES, "whole_edges_per_vertex": VERTICES,
    "whole_insert_only": EDGES, "whole_load_graph": EDGES, "whole_read_metis": 2 * EDGES,
}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_all_rows(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() == ROWS[name]


def test_counts_and_drawing(spark):
    assert {r.what: r.n for r in catalogue.QUERIES["whole_graph_counts"](spark, FOLDER).collect()} == {"vertices": VERTICES, "edges": EDGES}
    everyone = catalogue.projections.part_cooccur(spark, FOLDER).vertices
    assert catalogue.QUERIES["random_vertex"](spark, FOLDER).collect() == catalogue.algebra.random_vertex(catalogue.Graph(everyone, None, False), catalogue.SEED).collect()
