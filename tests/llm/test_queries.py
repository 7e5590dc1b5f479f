"""The registered queries against SQL, and the pipeline against its stages by brute force."""

from __future__ import annotations

from collections import Counter

import cases
import pytest
from check_oracles import compare, connect

import corpus_pipeline
from barloom.llm import quality
from barloom.llm.common import read, ready
from barloom.llm.queries import QUERIES, SQL
from barloom.session import store

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    problem, n = compare(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name])
    assert not problem and n > 0


@pytest.mark.parametrize("name", ["op3_quality", "op4_secret_scan", "op5_best_fit_pack", "op6_token_id_files", "op9_simhash", "op13_byte_pairs"])
def test_a_row_per_document(spark, name):
    found = QUERIES[name](spark, FOLDER).select("doc_id").collect()
    assert {r.doc_id for r in found} == {r.doc_id for r in read(spark, FOLDER, "documents").collect()}


def test_every_operator():
    import __spark_entry__ as contract

    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in contract.queries() and set(SQL) <= set(contract.oracle_sql())


def test_pipeline(spark):
    """Each stage on what its predecessor kept, recomputed in plain Python."""
    docs = read(ready(spark), FOLDER, "documents")
    columns, steps = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(store(stage(spark, steps[-1], FOLDER), f"test-{name.replace(' ', '-')}"))
    pairs = [[(r.doc_id, r.text) for r in d.collect()] for d in steps[:-1]]
    assert all(d.columns == columns for d in steps[:-1])

    model = quality.fit(docs)
    assert Counter(pairs[1]) == Counter((i, t) for i, t in pairs[0] if model.score(quality.traits(t)) >= quality.LEAST_SCORE)
    deduped = cases.line_dedup(pairs[1], lambda p: cases.least(p[0]))
    assert Counter(pairs[2]) == Counter((i, t) for i, t, n, gone in deduped if gone < n or not n)
    assert Counter(i for i, _ in pairs[3]) == cases.near_kept(pairs[2])
    items = [(r.item_id, r.text) for r in read(spark, FOLDER, "benchmark").collect()]
    assert Counter(pairs[4]) == Counter((i, t) for i, t in pairs[3] if not cases.hits(t, items)[1])
    assert {r.doc_id for r in steps[-1].collect()} == {i for i, _ in pairs[4]}
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())
    assert corpus_pipeline.run(spark, FOLDER).columns == steps[-1].columns


def test_pipeline_of_odd_rows(spark):
    docs = cases.frame(ready(spark), cases.rows())
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, FOLDER), f"test-odd-{name.replace(' ', '-')}")
    assert docs.count() > 0
    none = cases.frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        none = store(stage(spark, none, FOLDER), f"test-none-{name.replace(' ', '-')}")
    assert none.count() == 0
