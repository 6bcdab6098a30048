"""Near copies of a whole test table against brute force, which compares all sets that share a shingle."""

import os

import pyarrow.parquet as pq
import pytest

from docgrid.llm import registry

from .test_dedup import brute_components

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_near_copies_of_a_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = {tuple(r) for r in registry.queries()["op4_ngram_join"](spark, SF).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute_components(rows) and len({c for *_, c in got}) < len(got)
